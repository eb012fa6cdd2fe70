"""Parts of paragraphs: classes of items, formulas that are text, orders, placeholders and what comes back for them."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: More placeholders than this are too many: the text is built again without style pairs.
MOST_PLACEHOLDERS = 40
ENTER, STAY = 0.79, 1.1


def classes_of(items: list[dict]) -> list[str]:
    """formula, corner or text for each item of a line (formula: is it one alone; bullet; space; size).

    A state machine: a corner is entered below ENTER times the size before and left at STAY
    times the corner's size; a space keeps the state; a bullet that opens the line stays text,
    and so do its like.
    """
    out: list[str] = []
    state, size, opened = "text", None, False
    for k, item in enumerate(items):
        if k == 0 and item["bullet"]:
            opened = True
        if item["space"]:
            out.append(state)
            continue
        smaller = size is not None and item["size"] < ENTER * size
        if smaller or state == "corner" and item["size"] < STAY * size:
            state = "corner"
        elif item["formula"] and not (opened and item["bullet"]):
            state = "formula"
        else:
            state = "text"
        out.append(state)
        size = item["size"]
    return out


def classified(items: DataFrame, *keys: str) -> DataFrame:
    """Items of each line (seq, formula, bullet, space, size) with their class: one pass over a line's array."""
    lines = items.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("seq", "formula", "bullet", "space", "size"))).alias("items"))

    @F.pandas_udf("array<string>")
    def name(arrays: pd.Series) -> pd.Series:
        return pd.Series([classes_of(list(a)) for a in arrays], dtype=object)

    both = lines.select(*keys, F.explode(F.arrays_zip(F.col("items.seq").alias("seq"), name("items").alias("class"))).alias("r"))
    return both.select(*keys, "r.seq", "r.class")


def is_translatable(text: Column, y_offset: Column, all_in_layout: Column) -> Column:
    """Whether a formula is plain text: digits, spaces, commas and points, hardly raised, not wholly of formula layouts."""
    return ~all_in_layout & (y_offset <= 0.1) & text.rlike(r"^[0-9, .]+$")


def splits_at_commas(text: Column, all_in_layout: Column) -> Column:
    """Whether a formula is cut at commas: it has one, and signs other than digits, square brackets and white space."""
    return ~all_in_layout & text.contains(",") & (F.regexp_replace(text, r"[0-9\[\],\s]", "") != "")


def kinds(formulas: DataFrame) -> DataFrame:
    """Compositions with their kind: a translatable formula that is no corner mark becomes a line."""
    plain = is_translatable(F.col("text"), F.col("y_offset"), F.col("all_in_layout")) & ~F.col("corner")
    return formulas.withColumn("kind", F.when(plain, "line").otherwise("formula")).withColumn("split", splits_at_commas(F.col("text"), F.col("all_in_layout")))


def styled_runs(items: DataFrame, *keys: str) -> DataFrame:
    """Runs of one style in order: formulas are runs of their own, and the style before one goes on behind it.

    Items: seq, is_formula, style.  Columns: run, and continued for a run whose style is that
    of the run before the formula.
    """
    w = Window.partitionBy(*keys).orderBy("seq")
    carried = F.last(F.when(~F.col("is_formula"), F.col("style")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    flagged = items.withColumn("was", F.lag("is_formula").over(w)).withColumn("carried", carried)
    new = F.col("was").isNull() | (F.col("was") != F.col("is_formula")) | (~F.col("is_formula") & ~F.col("style").eqNullSafe(F.col("carried")))
    runs = flagged.withColumn("new", new.cast("int")).withColumn("run", F.sum("new").over(w))
    opens = ~F.col("is_formula") & F.coalesce(F.col("was"), F.lit(False)) & F.col("style").eqNullSafe(F.col("carried"))
    return runs.withColumn("goes_on", opens).drop("new", "was", "carried")


def folded_style(styles: str) -> Column:
    """The common style of an ordered array of (font, size, state): fields that differ become null, and once the size
    is null the next style takes the place of what was common."""
    fields = ("font", "size", "state")  # each as an array of one value, or none

    def one(x: Column) -> Column:
        return F.struct(*[F.array_compact(F.array(x[f])).alias(f) for f in fields])

    def step(s: Column, x: Column) -> Column:
        return F.when(F.size(s["size"]) == 0, x).otherwise(F.struct(*[F.array_intersect(s[f], x[f]).alias(f) for f in fields]))

    each = F.transform(styles, one)
    common = F.aggregate(F.slice(each, 2, F.size(styles)), F.get(each, F.lit(0)), step)
    return F.struct(*[F.get(common[f], F.lit(0)).alias(f) for f in fields])


def render_orders(items: DataFrame, *keys: str) -> DataFrame:
    """Items with their place in the paragraph (sub_order) and the paragraph's least render order; the sentinel counts as none."""
    least = F.min(F.when(F.col("render_order") < 9999999999999999, F.col("render_order"))).over(Window.partitionBy(*keys))
    return items.withColumn("sub_order", F.row_number().over(Window.partitionBy(*keys).orderBy("seq"))).withColumn("paragraph_order", least)


def same_layouts(items: DataFrame, *keys: str) -> DataFrame:
    """Whether neighbouring groups of items lie in one and the same formula layout (spaces and missing ones do not count)."""
    sets = items.groupBy(*keys, "part").agg(F.collect_set(F.when(F.col("word") != " ", F.col("layout"))).alias("ids"))
    nxt = F.lead("ids").over(Window.partitionBy(*keys).orderBy("part"))
    return sets.withColumn("same", F.coalesce((F.size("ids") == 1) & (F.col("ids") == nxt), F.lit(False)))


def ends(items: DataFrame, *keys: str) -> DataFrame:
    """The first and the last item of each composition."""
    return items.groupBy(*keys).agg(F.min_by("word", "seq").alias("first"), F.max_by("word", "seq").alias("last"), F.count("*").alias("n"))


# placeholders


def tokens_of(kind: str, number: int) -> tuple[str, ...]:
    return (f"{{v{number}}}",) if kind == "formula" else (f"<style id='{number}'>", "</style>")


def placeholder_text(parts: list[tuple[str, str]], source: str, most: int = MOST_PLACEHOLDERS, rich: bool = True) -> tuple[str, list[tuple[str, int]], bool]:
    """The text with placeholders for its parts (kind, text), the placeholders (kind, number), and whether styles have them.

    Numbers count up, by one behind a formula and by two behind a style; one is passed over
    if the source text begins with its token, whatever the case.  More than ``most``
    placeholders: again, without styles.
    """
    out, used, number = [], [], 1
    start = source.lower()
    for kind, text in parts:
        if kind == "text" or kind == "style" and not rich:
            out.append(text)
            continue
        while any(start.startswith(t.lower()) for t in tokens_of(kind, number)):
            number += 1
            if kind == "style" and start.startswith("</style>"):
                break  # the closing token is the same for all numbers
        tokens = tokens_of(kind, number)
        out.append(tokens[0] if kind == "formula" else tokens[0] + text + tokens[1])
        used.append((kind, number))
        number += 1 if kind == "formula" else 2
    if rich and len(used) > most:
        return placeholder_text(parts, source, most, False)
    return "".join(out), used, rich


_TOKEN = re.compile(r"\{\s*v\s*([0-9]+)\s*\}|<\s*style\s+id\s*=\s*'\s*([0-9]+)\s*'\s*>|<\s*/\s*style\s*>", re.IGNORECASE)


def parsed_output(output: str, used: list[tuple[str, int]], allowed: list[str] = ()) -> tuple[list[tuple[str, int | None, str]], int]:
    """Compositions (kind, number, text) of an answer, and how many tokens were removed.

    Tokens are found whatever their case and spaces.  A known formula token is a formula; a
    known style token up to the next closing one is a style; style tokens without a partner
    and tokens that were never given fall, unless allowed as they are.
    """
    formulas, styles = {n for k, n in used if k == "formula"}, {n for k, n in used if k == "style"}
    out: list[tuple[str, int | None, str]] = []
    removed, at, open_ = 0, 0, None

    def text(t: str) -> None:
        if not t:
            return
        kind, number = ("style", open_) if open_ is not None else ("text", None)
        if out and out[-1][:2] == (kind, number):
            out[-1] = (kind, number, out[-1][2] + t)
        else:
            out.append((kind, number, t))

    matches = list(_TOKEN.finditer(output))
    closers = [m.start() for m in matches if m[1] is None and m[2] is None]
    for m in matches:
        text(output[at : m.start()])
        at = m.end()
        if m[1] and int(m[1]) in formulas and open_ is None:
            out.append(("formula", int(m[1]), ""))
        elif m[2] and int(m[2]) in styles and open_ is None and any(c > m.start() for c in closers):
            open_ = int(m[2])
        elif m[1] is None and m[2] is None and open_ is not None:
            open_ = None
        elif m[0] in allowed:
            text(m[0])
        else:
            removed += 1
    text(output[at:])
    return out, removed


def with_placeholders(paragraphs: DataFrame, parts: str = "parts", source: str = "text") -> DataFrame:
    """Paragraphs (parts: an ordered array of kind and text) with their input, its placeholders and whether styles have some."""

    @F.pandas_udf("input string, used array<struct<kind:string,number:int>>, rich boolean")
    def build(parts: pd.Series, source: pd.Series) -> pd.DataFrame:
        got = [placeholder_text([(p["kind"], p["text"]) for p in ps], s or "") for ps, s in zip(parts, source, strict=True)]
        return pd.DataFrame({"input": [g[0] for g in got], "used": [[{"kind": k, "number": n} for k, n in g[1]] for g in got], "rich": [g[2] for g in got]})

    return paragraphs.withColumn("built", build(parts, source)).select("*", "built.input", "built.used", "built.rich").drop("built")


def from_output(answers: DataFrame, output: str = "output", used: str = "used", allowed: str = "allowed") -> DataFrame:
    """Answers with their compositions and the number of tokens removed."""

    @F.pandas_udf("compositions array<struct<kind:string,number:int,text:string>>, removed int")
    def parse(outputs: pd.Series, used: pd.Series, allowed: pd.Series) -> pd.DataFrame:
        got = [parsed_output(o or "", [(u["kind"], u["number"]) for u in us], list(al)) for o, us, al in zip(outputs, used, allowed, strict=True)]
        return pd.DataFrame({"compositions": [[{"kind": k, "number": n, "text": t} for k, n, t in g[0]] for g in got], "removed": [g[1] for g in got]})

    return answers.withColumn("parsed", parse(output, used, allowed)).select("*", "parsed.compositions", "parsed.removed").drop("parsed")


def answered(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """Requests of batches (batch_id, id, input) with their answers (batch_id, raw): output, and route.

    An answer of another number of items than the batch has, or none that can be read, fails the
    batch: each of its paragraphs goes alone.  In a good one an item without text goes alone.
    """
    from quillframe.operators.text import parsed_answers

    parsed = answers.select("batch_id", parsed_answers(F.col("raw")).alias("items"))
    sizes = requests.groupBy("batch_id").agg(F.count("*").alias("n"))
    state = sizes.join(parsed, "batch_id", "left").withColumn("good", F.coalesce(F.size("items") == F.col("n"), F.lit(False)))
    each = state.where("good").select("batch_id", F.explode("items").alias("a")).select("batch_id", F.col("a.id").alias("id"), F.col("a.text").alias("output"))
    each = each.groupBy("batch_id", "id").agg(F.first("output", ignorenulls=True).alias("output"))
    got = requests.join(state.select("batch_id", "good"), "batch_id").join(each, ["batch_id", "id"], "left")
    route = F.when(~F.col("good"), "batch failed").when(F.col("output").isNull(), "alone").otherwise("batch")
    return got.withColumn("route", route).drop("good")

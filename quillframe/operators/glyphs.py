"""Characters: expansion of text runs, positions, visual boxes, validity, spaces, lines of a paragraph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillframe.functions import arrays as A
from quillframe.functions import geometry as G

PAGE = ("doc_id", "page_no")


def glyphs(runs: DataFrame, advance: Callable[[Column], Column]) -> DataFrame:
    """A row for each character (ch) of each run (word), with its place i and its advance; x0 is the pen before it.

    ``advance`` gives the advance of a character.  A run's characters come from its own row and
    the pen moves within it, so characters are neither shuffled nor sorted.
    """
    chars = A.bound(F.split("word", ""), lambda cs: A.bound(F.transform(cs, advance), lambda ws: F.arrays_zip(cs.alias("ch"), ws.alias("advance"), A.running(ws, "double").alias("before"))))
    each = runs.select("*", F.posexplode(chars).alias("i", "c")).where("c.ch <> ''")
    return each.select(*runs.columns, "i", "c.ch", "c.advance", (F.col("x") + F.col("c.before")).alias("x0"))


def placed(wide: Column, low: Column, high: Column, m: list[Column]) -> tuple[Column, Column, Column, Column]:
    """The box of a glyph of a width between two heights under an affine matrix: corners are mapped, then ordered."""
    corners = [G.applied(m, x, y) for x, y in ((F.lit(0.0), low), (wide, high))]
    (x, y), (x2, y2) = corners
    return F.least(x, x2), F.least(y, y2), F.greatest(x, x2), F.greatest(y, y2)


def is_vertical(a: Column, d: Column) -> Column:
    return (a == 0) & (d == 0)


def is_upright(a: Column, b: Column) -> Column:
    """A rotation of nearly 0 or 90 degrees."""
    angle = G.rotation(a, b)
    return angle.between(-0.1, 0.1) | angle.between(89.9, 90.1)


def one_space(ch: Column) -> Column:
    """Any white space as one plain space."""
    return F.when(ch.rlike(r"^(?U)\s+$"), " ").otherwise(ch)


def visual_box(box: tuple, descent: Column, size: Column, vertical: Column, glyph: tuple) -> tuple[Column, ...]:
    """The box moved by the font's descent, along x if vertical; a glyph box of an area over 1 counts instead."""
    by = descent * size / 1000
    moved = tuple(c + F.when(vertical == F.lit(k in (0, 2)), by).otherwise(0.0) for k, c in enumerate(box))
    use = F.coalesce(G.area(glyph) > 1, F.lit(False))
    return tuple(F.when(use, g).otherwise(m) for g, m in zip(glyph, moved, strict=True))


def reject_reason(ch: Column, size: Column, has_font: Column, cid: Column) -> Column:
    """Why a character is left out: no size, no font, an ornament of an isolated formula, a control category, an undecoded code; else null."""
    return (
        F.when(size == 0, "size")
        .when(~has_font, "font")
        .when(cid.between(122, 125), "ornament")
        .when(~ch.rlike(r"^(?U)\s+$") & ch.rlike(r"^[\p{Cc}\p{Cs}\p{Co}\p{Cn}]"), "category")
        .when(ch.contains("(cid:"), "cid")
    )


def tiny(chars: DataFrame, share: float = 0.05) -> DataFrame:
    """The median area of each page's boxes, and how many boxes are below a share of it."""
    # both from one reading: the areas of a page are an array beside their median
    sized = chars.select(*PAGE, G.area(G.box()).alias("area")).groupBy(*PAGE).agg(F.median("area").alias("median_area"), F.collect_list("area").alias("areas"))
    return sized.select(*PAGE, "median_area", F.size(F.filter("areas", lambda a: a < share * F.col("median_area"))).cast("long").alias("n_tiny"))


def modal(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """The most frequent value of each key, the first seen on ties."""
    n = rows.groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(order).alias("s"))
    return n.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("n"), F.col("s"))).alias(value))


def formula_boxes(items: DataFrame) -> DataFrame:
    """Boxes of formulas (doc_id, page_no, formula): in y those items count whose height is reliable, all if none is."""
    steady = lambda f, c: F.coalesce(f(F.when(F.col("steady"), F.col(c))), f(c))
    return items.groupBy(*PAGE, "formula").agg(F.min("x").alias("x"), steady(F.min, "y").alias("y"), F.max("x2").alias("x2"), steady(F.max, "y2").alias("y2"), F.min("seq").alias("first_seq"))


def formula_layout(boxes: str = "formula_boxes", least: float = 0.4) -> Column:
    """The first formula layout (by order) that covers more than least of a character; null without one."""
    hits = F.filter(boxes, lambda b: G.overlap_ratio(G.box(), (b["x"], b["y"], b["x2"], b["y2"])) > least)
    return F.get(hits, F.lit(0))["layout_id"]


def isolated_formulas(formulas: DataFrame, texts: DataFrame, least: float = 0.5) -> DataFrame:
    """Formula layouts with their label: isolate_formula if no text layout of the page covers least of them."""
    t = texts.select(*PAGE, F.struct("x", "y", "x2", "y2").alias("b")).groupBy(*PAGE).agg(F.collect_list("b").alias("texts"))
    covered = F.exists("texts", lambda b: G.overlap_ratio(G.box(), (b["x"], b["y"], b["x2"], b["y2"])) >= least)
    return formulas.join(t, list(PAGE), "left").withColumn("label", F.when(F.coalesce(covered, F.lit(False)), F.col("label")).otherwise("isolate_formula")).drop("texts")


def is_newline(before: tuple, box: tuple) -> Column:
    """Below the previous box, or more than ten character widths left of it."""
    width = F.greatest(box[2] - box[0], before[2] - before[0])
    return F.coalesce((box[3] < before[1]) | (box[2] < before[0] - width * 10), F.lit(False))


def spaces(words: DataFrame, gaps: DataFrame) -> DataFrame:
    """The space characters to set into lines: behind a word whose gap is at least the line's reference gap, as wide as the smaller of both."""
    line = Window.partitionBy(*PAGE, "row_no").orderBy("seq")
    gap = words.withColumn("gap", F.lead("x").over(line) - F.col("x2")).join(gaps, [*PAGE, "row_no"])
    wide = F.least("gap", "ref_gap")
    return gap.where(F.col("gap") >= F.col("ref_gap")).select(*PAGE, "row_no", "seq", F.col("x2").alias("x"), (F.col("x2") + wide).alias("x2"), "y", "y2")


def joined_text(words: DataFrame, gaps: DataFrame | None = None) -> DataFrame:
    """Paragraph texts: a space where the gap reaches the line's reference gap or a line ends, squeezed and trimmed.

    Without a table of gaps the words carry their line's ref_gap, and are not shuffled to meet it.
    """
    para = Window.partitionBy(*PAGE, "para_seq").orderBy("seq")
    after = [F.lead(c).over(para) for c in ("x", "y", "x2", "y2")]
    with_gap = (words if gaps is None else words.join(gaps, [*PAGE, "row_no"])).withColumn("space", (after[0] - F.col("x2") >= F.col("ref_gap")) | is_newline(G.box(), tuple(after)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.concat("word", F.when(F.col("space"), " ").otherwise("")).alias("t")))), lambda w: w["t"]), "")
    return with_gap.groupBy(*PAGE, "para_seq").agg(F.trim(F.regexp_replace(text, " +", " ")).alias("text"))


def y_lines(words: DataFrame, step: float = 0.25, low: float = 5.0) -> DataFrame:
    """Words of each paragraph with their line: a new one where nothing covers a scan position below all words before.

    From the top down, a word opens a line if its upper edge lies a step below the lowest edge
    so far.  A paragraph lower than ``low`` is one line.
    """
    para = Window.partitionBy(*PAGE, "para_seq")
    down = para.orderBy(F.desc("y2"), "seq")
    lowest = F.min("y").over(down.rowsBetween(Window.unboundedPreceding, -1))
    flat = F.max("y2").over(para) - F.min("y").over(para) < low
    opened = words.withColumn("new", F.when(flat, 0).otherwise(F.coalesce((F.col("y2") <= lowest - step).cast("int"), F.lit(0))))
    return opened.withColumn("line_idx", F.sum("new").over(down.rowsBetween(Window.unboundedPreceding, 0))).drop("new")


def lines_of(words: DataFrame, *keys: str) -> DataFrame:
    """Boxes, word counts and texts of lines, numbered from the top down, then left to right, by their mean centres."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "word"))), lambda w: w["word"]), " ")
    got = words.groupBy(*PAGE, *keys).agg(
        F.min("x").alias("x"), F.min("y").alias("y"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.count("*").alias("n_words"),
        F.avg((F.col("y") + F.col("y2")) / 2).alias("cy"), F.avg((F.col("x") + F.col("x2")) / 2).alias("cx"), text.alias("text"),
    )
    order = Window.partitionBy(*PAGE).orderBy(F.desc("cy"), "cx", *keys)
    return got.withColumn("place", F.row_number().over(order)).drop("cy", "cx")

"""Paragraph text rules: gates, candidates, glossary, terms, placeholders, answers, prompts, memo."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BODY = ("text", "plain text", "paragraph_hybrid")


def normalized(term: Column) -> Column:
    """Lower case, white space (of any script) squeezed to one space and trimmed."""
    return F.trim(F.regexp_replace(F.lower(term), r"(?U)\s+", " "))


def is_numeric(text: Column) -> Column:
    return F.trim(text).rlike(r"^-?[0-9]+(\.[0-9]+)?$")


def is_digits_or_space(text: Column) -> Column:
    return text.rlike(r"^[0-9\s]*$")


def is_cid(token: Column) -> Column:
    return token.rlike(r"^\(cid:[0-9]+\)$")


def cid_gate(tokens: DataFrame, key: str, token: str, most: float = 0.8) -> DataFrame:
    """Share of CID tokens for each key, and whether it rejects the key."""
    share = F.avg(is_cid(F.col(token)).cast("double"))
    return tokens.groupBy(key).agg(share.alias("cid_share"), (share > most).alias("rejected"))


def candidates(paras: DataFrame, done: DataFrame, least: int = 5) -> DataFrame:
    """Body paragraphs of at least ``least`` characters that are not numeric and not done yet."""
    want = (F.length("text") >= least) & F.col("label").isin(*BODY) & ~is_numeric(F.col("text")) & ~F.col("text").contains("(cid:")
    return paras.where(want).join(done, ["doc_id", "para_no"], "left_anti")


def page_ranges(spec: Column) -> Column:
    """A page list such as 1,2,1-,-3,3-5 as an array of (first, last); an open end is null."""
    part = F.filter(F.split(spec, ","), lambda p: F.trim(p) != "")
    number = lambda s: F.try_to_number(s, F.lit("999999999")).cast("long")

    def one(p: Column) -> Column:
        p = F.trim(p)
        first = F.when(p.startswith("-"), F.lit(1)).otherwise(number(F.split_part(p, F.lit("-"), F.lit(1))))
        last = F.when(~p.contains("-"), number(p)).when(p.endswith("-"), F.lit(None).cast("long")).otherwise(number(F.split_part(p, F.lit("-"), F.lit(2))))
        return F.struct(first.cast("long").alias("first"), last.alias("last"))

    return F.transform(part, one)


def page_selected(page: Column, ranges: Column) -> Column:
    """No list selects all pages, an empty one none; else any range that holds the page (from 1)."""
    hit = F.exists(ranges, lambda r: (page >= r["first"]) & (r["last"].isNull() | (page <= r["last"])))
    return F.when(ranges.isNull(), True).otherwise(hit)


def deduplicated_terms(terms: DataFrame) -> DataFrame:
    """The first entry (by seq) of each normalized source."""
    first = Window.partitionBy("norm").orderBy("seq")
    return terms.withColumn("norm", normalized(F.col("source"))).withColumn("r", F.row_number().over(first)).where("r = 1").drop("r")


def language_fits(row: Column, wanted: Column) -> Column:
    """A blank language fits all; others after lower case and - to _."""
    canon = lambda c: F.replace(F.lower(F.trim(c)), F.lit("-"), F.lit("_"))
    return (F.coalesce(F.trim(row), F.lit("")) == "") | (canon(row) == canon(wanted))


def folded(text: Column) -> Column:
    """A-Z lower-cased, no other letters."""
    return F.translate(text, UPPER, LOWER)


def matched_terms(texts: DataFrame, terms: DataFrame, per_pass: int = 200_000) -> DataFrame:
    """Terms that texts contain anywhere, letters A-Z of either case alike, once each: doc_id, term.

    White space of the text is squeezed first, that of the terms is not.  A text is walked
    once through an automaton of all terms; a glossary of more than per_pass terms takes
    several passes, so a task holds per_pass terms at most.
    """
    schema = f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, term string"
    listed = sorted({r[0] for r in terms.where("term <> ''").select("term").distinct().toLocalIterator()})
    squeezed = texts.select("doc_id", folded(F.regexp_replace("text", r"(?U)\s+", " ")).alias("f"))

    def found(some: list[str]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            by_fold: dict[str, list[str]] = {}
            for t in some:
                by_fold.setdefault("".join(c.lower() if "A" <= c <= "Z" else c for c in t), []).append(t)
            automaton = ahocorasick.Automaton()
            for f, originals in by_fold.items():
                automaton.add_word(f, originals)
            automaton.make_automaton()
            for batch in batches:
                ids, hits = [], []
                for k, f in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                    for t in {t for _, originals in automaton.iter(f or "") for t in originals}:
                        ids.append(k.as_py())
                        hits.append(t)
                yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(hits, pa.string())], names=["doc_id", "term"])

        return squeezed.mapInArrow(run, schema)

    parts = [found(listed[i : i + per_pass]) for i in range(0, len(listed), per_pass)]
    out = texts.sparkSession.createDataFrame([], schema) if not parts else parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def voted(pairs: DataFrame) -> DataFrame:
    """The translation of each source term with most votes, the first seen (seq) on ties."""
    ok = (F.col("src") != "") & (F.col("tgt") != "") & (F.length("src") < 100) & ~((F.col("src") == F.col("tgt")) & (F.length("src") < 3))
    votes = pairs.where(ok).groupBy("src", "tgt").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    return votes.groupBy("src").agg(F.min_by("tgt", F.struct(-F.col("n"), F.col("first"))).alias("tgt"), F.max("n").alias("votes"))


def placeholder_counts(texts: DataFrame) -> DataFrame:
    """How often each {vN} or style token occurs in a text."""
    found = texts.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"(\{v[0-9]+\}|</?style[^>]*>)"), 1)).alias("token"))
    return found.groupBy("doc_id", "token").agg(F.count("*").alias("n"))


def token_stream(output: Column) -> Column:
    """Placeholders of an answer in order, spaces and case of the token ignored."""
    raw = F.regexp_extract_all(output, F.lit(r"(?i)(\{ *v *[0-9]+ *\}|< */? *style[^>]*>)"), 1)
    return F.transform(raw, lambda t: F.lower(F.regexp_replace(t, " ", "")))


def cleaned_answer(raw: Column) -> Column:
    """An answer without its wrapper tags and code fences."""
    out = F.trim(raw)
    for pattern in (r"^<json>", r"</json>$", r"^```json", r"^```", r"```$"):
        out = F.trim(F.regexp_replace(out, pattern, ""))
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def parsed_answers(raw: Column) -> Column:
    """Rows (id, text) of an answer: a lone object is a list of one, garbage is null; output counts before input."""
    items = F.from_json(cleaned_answer(raw), "array<struct<id:bigint,output:string,input:string>>")
    return F.transform(items, lambda a: F.struct(a["id"].alias("id"), F.coalesce(a["output"], a["input"]).alias("text")))


def reason(source: Column, target: Column, n_source: Column, n_target: Column) -> Column:
    """Why an answer is rejected, or ok."""
    ratio = F.try_divide(n_target.cast("double"), n_source.cast("double"))
    return (
        F.when(target.isNull(), "missing")
        .when((source == target) & (n_source > 10), "same")
        .when(ratio.isNull(), "error")
        .when((ratio <= 0.3) | (ratio >= 3), "ratio")
        .when((n_source > 20) & (F.levenshtein(source, target, 4) >= 0), "near")
        .otherwise("ok")
    )


def batch_numbers(tokens: list[int], most_tokens: int, most_items: int) -> list[int]:
    """The batch of each item in order: one closes when it holds more than most_tokens tokens or most_items items."""
    out, batch, total, n = [], 0, 0, 0
    for t in tokens:
        out.append(batch)
        total, n = total + t, n + 1
        if total > most_tokens or n > most_items:
            batch, total, n = batch + 1, 0, 0
    return out


def batches(rows: DataFrame, most_tokens: int, most_items: int) -> DataFrame:
    """Rows of each document dealt into batches in order (see batch_numbers).

    The running sum starts anew at each close, so it is a fold over the document's token
    counts: one pass over an array, Arrow batch by batch.
    """
    items = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("para_no", "n_tokens"))).alias("items"))

    @F.pandas_udf("array<long>")
    def numbers(tokens: pd.Series) -> pd.Series:
        return pd.Series([batch_numbers(t.tolist(), most_tokens, most_items) for t in tokens], dtype=object)

    both = items.select("doc_id", F.arrays_zip(F.col("items.para_no").alias("para_no"), numbers(F.col("items.n_tokens")).alias("batch")).alias("r"))
    return both.select("doc_id", F.explode("r").alias("r")).select("doc_id", "r.para_no", "r.batch")


def requests(rows: DataFrame) -> DataFrame:
    """One JSON request for each batch: an array of id, input and label, ids from 0 in order."""
    order = Window.partitionBy("doc_id", "batch").orderBy("para_no")
    item = F.struct((F.row_number().over(order) - 1).alias("id"), F.col("text").alias("input"), F.col("label").alias("layout_label"))
    listed = rows.withColumn("item", item).groupBy("doc_id", "batch").agg(F.array_sort(F.collect_list("item")).alias("items"))
    return listed.select("doc_id", "batch", F.size("items").alias("n"), F.to_json("items").alias("request"))


def prompt(lang_out: str, title: Column, terms: Column, request: Column) -> Column:
    """A prompt of role, context, glossary and request blocks; blocks without content fall."""
    return F.concat_ws(
        "\n\n",
        F.lit(f"Translate every input into {lang_out}. Keep all placeholders."),
        F.when(title.isNotNull(), F.concat(F.lit("Title: "), title)),
        F.when(F.length(terms) > 0, F.concat(F.lit("Terms: "), terms)),
        F.concat(F.lit("Inputs: "), request),
    )


def canonical_json(raw: Column) -> Column:
    """An object's JSON with the keys of every object sorted, without spaces; null stays null."""

    @F.pandas_udf("string")
    def sort_keys(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else json.dumps(json.loads(t), sort_keys=True, separators=(",", ":"), ensure_ascii=False) for t in texts], dtype=object)

    return sort_keys(raw)


def chunked(items: Column, size: int) -> Column:
    """An array in arrays of ``size``, the last one shorter; an empty one has none."""
    starts = F.when(F.size(items) > 0, F.sequence(F.lit(1), F.size(items), F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(items, i, size))


def zstd_packed(text: Column) -> Column:
    """A text's UTF-8, compressed, with its length before it."""

    @F.pandas_udf("binary")
    def pack(texts: pd.Series) -> pd.Series:
        raw = [None if t is None else t.encode("utf-8", "replace") for t in texts]
        return pd.Series([None if r is None else len(r).to_bytes(8, "little") + pa.compress(r, "zstd", asbytes=True) for r in raw], dtype=object)

    return pack(text)


def zstd_unpacked(data: Column) -> Column:
    """The bytes of a packed text."""

    @F.pandas_udf("binary")
    def unpack(blobs: pd.Series) -> pd.Series:
        return pd.Series([None if b is None else pa.decompress(b[8:], int.from_bytes(b[:8], "little"), "zstd", asbytes=True) for b in blobs], dtype=object)

    return unpack(data)


def error_code(name: Column) -> Column:
    """The code of an error by its class name."""
    return F.when(F.lower(name).contains("scanned"), "scanned_pdf").when(name == "TimeoutError", "timeout").when(name.isin("FileNotFoundError", "ValueError"), "invalid_output").otherwise("failed")


def hints(formulas: DataFrame, most_cid: float = 0.8) -> DataFrame:
    """For each document a map from placeholder to its formula's text; formulas of mostly undecoded codes have none."""
    order = Window.partitionBy("doc_id").orderBy("first_seq")
    named = formulas.withColumn("k", F.row_number().over(order)).where(F.col("cid_share") <= most_cid)
    entry = F.struct("k", F.concat(F.lit("{v"), F.col("k"), F.lit("}")).alias("token"), "text")
    listed = named.groupBy("doc_id").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    return listed.select("doc_id", F.map_from_entries(F.transform("e", lambda x: F.struct(x["token"], x["text"]))).alias("hint"))


def memo_latest(memo: DataFrame, keep: int = 50_000) -> DataFrame:
    """The last row (by id) of each (engine, params, text), of these the newest ``keep``."""
    last = memo.groupBy("engine", "params_json", "text").agg(F.max_by("translation", "id").alias("translation"), F.max("id").alias("id"))
    return last.orderBy(F.desc("id")).limit(keep)


def memo_joined(requests_: DataFrame, memo: DataFrame) -> DataFrame:
    """Requests with their remembered translation; hit tells whether there is one."""
    got = requests_.join(memo.select("engine", "params_json", "text", "translation"), ["engine", "params_json", "text"], "left")
    return got.withColumn("hit", F.col("translation").isNotNull())

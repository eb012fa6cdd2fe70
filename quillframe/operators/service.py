"""Requests, queues, rates and results of the service side, as tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def send_times(requests: DataFrame, per_second: float, *keys: str) -> DataFrame:
    """When each request (at, seq) is sent under a rate limit: not before it comes, nor sooner than one interval after the last.

    The k-th is sent at the latest of all earlier arrivals, each with the intervals between:
    a running maximum, so no fold is needed.
    """
    order = Window.partitionBy(*keys).orderBy("at", "seq")
    k = (F.row_number().over(order) - 1) / per_second
    slack = requests.withColumn("k", k).withColumn("slack", F.col("at") - F.col("k"))
    return slack.withColumn("send_at", F.max("slack").over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.col("k")).drop("k", "slack")


def admitted_of(starts: list[float], lasts: list[float]) -> list[bool]:
    """Which requests are taken when only one runs at a time: a request that comes while one runs is refused."""
    free, out = float("-inf"), []
    for at, last in zip(starts, lasts, strict=True):
        out.append(at >= free)
        if at >= free:
            free = at + last
    return out


def in_flight_of(lasts: list[float], size: int) -> list[float]:
    """When each result is handed on, in order, if at most size tasks are in flight: a task starts when the one size before it is handed on."""
    out: list[float] = []
    for k, last in enumerate(lasts):
        start = out[k - size] if k >= size else 0.0
        out.append(max(out[-1] if out else 0.0, start + last))
    return out


def throttled_of(times: list[float], small: list[bool], interval: float) -> list[bool]:
    """Which updates pass: those at least an interval after the last that passed, and all of stages of few steps."""
    last, out = float("-inf"), []
    for at, few in zip(times, small, strict=True):
        passes = few or at - last >= interval
        out.append(passes)
        if passes:
            last = at
    return out


def _folded(rows: DataFrame, keys: tuple[str, ...], order: list[str], inputs: list[str], kind: str, name: str, fold) -> DataFrame:
    """rows with a column that a fold over each key's ordered arrays of inputs gives: one pass over an array."""
    listed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, *[c for c in rows.columns if c not in (*keys, *order)]))).alias("r"))

    @F.pandas_udf(f"array<{kind}>")
    def run(*arrays: pd.Series) -> pd.Series:
        return pd.Series([fold(*[list(a) for a in some]) for some in zip(*arrays, strict=True)], dtype=object)

    both = listed.select(*keys, F.explode(F.arrays_zip("r", run(*[F.col(f"r.{c}") for c in inputs]).alias(name))).alias("x"))
    return both.select(*keys, "x.r.*", f"x.{name}")


def admitted(requests: DataFrame, *keys: str) -> DataFrame:
    """Requests (at, seq, lasts) with whether each is taken."""
    return _folded(requests, keys, ["at", "seq"], ["at", "lasts"], "boolean", "taken", admitted_of)


def handed_on(tasks: DataFrame, size: int, *keys: str) -> DataFrame:
    """Tasks (seq, lasts) with the time at which each result is handed on."""
    return _folded(tasks, keys, ["seq"], ["lasts"], "double", "yield_at", lambda lasts: in_flight_of(lasts, size))


def passed(updates: DataFrame, interval: float, *keys: str) -> DataFrame:
    """Updates (at, seq, total) that pass the throttle; stages of at most three steps always do."""
    some = updates.withColumn("few", F.col("total") <= 3)
    return _folded(some, keys, ["at", "seq"], ["at", "few"], "boolean", "passes", lambda at, few: throttled_of(at, few, interval)).where("passes").drop("few", "passes")


def closed(log: DataFrame, terminal: str = "error") -> DataFrame:
    """A log in which every execution ends: one without a terminal event gets it, behind its last."""
    ends = log.groupBy("execution_id").agg(F.max("sequence").alias("last"), F.max((F.col("type") == terminal).cast("int")).alias("done"))
    made = ends.where("done = 0").select("execution_id", (F.col("last") + 1).cast("int").alias("sequence"), F.lit("missing_terminal").alias("type"))
    return log.select("execution_id", "sequence", "type").unionByName(made)


def incomplete_ends(stages: DataFrame) -> DataFrame:
    """Stages (current, total) at their end with whether the end event goes out: only if all steps are done; else a warning."""
    return stages.withColumn("emit", F.col("current") >= F.col("total")).withColumn("warning", F.when(F.col("current") < F.col("total"), F.format_string("%d of %d", "current", "total")))


def part_progress(parts: DataFrame) -> DataFrame:
    """Overall progress of executions whose parts (part_no, total_parts, percent) have a share each."""
    return parts.groupBy("execution_id").agg((F.sum("percent") / F.max("total_parts")).alias("percent"))


def part_totals(parts: DataFrame) -> DataFrame:
    """Seconds over all parts, and the running maximum of memory in the order of parts."""
    order = Window.partitionBy("execution_id").orderBy("part_no")
    return parts.withColumn("peak", F.max("memory").over(order)).withColumn("seconds_all", F.sum("seconds").over(Window.partitionBy("execution_id")))


def sliding(events: DataFrame, width: str = "2 hours", slide: str = "1 hour") -> DataFrame:
    """Counts per sliding window and type."""
    return events.groupBy(F.window("ts", width, slide).alias("w"), "type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "type", "n")


def tracking(pages: DataFrame, pairs: DataFrame) -> DataFrame:
    """One JSON of each document: its paragraphs, and its pairs over pages."""
    a = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("para_no", "n_tokens"))).alias("page"))
    b = pairs.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("left_no", "right_no"))).alias("cross_page"))
    whole = a.join(b, "doc_id", "left").withColumn("cross_page", F.coalesce("cross_page", F.array().cast("array<struct<left_no:int,right_no:int>>")))
    return whole.select("doc_id", F.to_json(F.struct("page", "cross_page")).alias("json"))


def moved_toc(toc: DataFrame, slots: DataFrame) -> DataFrame:
    """Outline entries (level, title, page_no) at the place of their page in the new document; entries of lost pages fall."""
    return toc.join(slots, ["doc_id", "page_no"]).select("doc_id", "level", "title", "slot")


REQUEST = "id string, pages array<int>, lang_out string, qps double"


def checked_requests(raw: DataFrame) -> DataFrame:
    """JSON requests with their fields, or what is wrong: no JSON object, a field missing, a number out of range."""
    r = F.from_json("body", REQUEST)
    wrong = F.when(~F.coalesce(F.trim("body").rlike(r"(?s)^\{.*\}$"), F.lit(False)), "no object").when(r["id"].isNull(), "id").when(r["lang_out"].isNull(), "lang_out").when(r["qps"] <= 0, "qps")
    return raw.select("request_id", wrong.alias("wrong"), F.when(wrong.isNull(), r["lang_out"]).alias("lang_out"), F.when(wrong.isNull(), F.coalesce(r["qps"], F.lit(4.0))).alias("qps"))


def boxes_of(responses: DataFrame, points: float = 0.5) -> DataFrame:
    """Typed boxes of detector responses (JSON), from pixels to points; boxes that lack an edge fall."""
    items = F.from_json("body", "struct<boxes:array<struct<label:string,score:double,xyxy:array<double>>>>")["boxes"]
    each = responses.select("page_id", F.posexplode(items).alias("det_id", "b")).where("size(b.xyxy) = 4")
    return each.select("page_id", "det_id", "b.label", "b.score", *[(F.col("b.xyxy")[k] * points).alias(c) for k, c in enumerate(("x", "y", "x2", "y2"))])


def fonts_by_id(dumps: DataFrame, pattern: str) -> DataFrame:
    """Distinct fonts of the paragraphs in page dumps (JSON) whose debug id matches."""
    p = F.explode(F.from_json("body", "struct<paragraphs:array<struct<debug_id:string,runs:array<struct<font:string>>>>>")["paragraphs"])
    runs = dumps.select(p.alias("p")).where(F.col("p.debug_id").rlike(pattern)).select(F.explode("p.runs").alias("r"))
    return runs.select("r.font").where("font IS NOT NULL").distinct()


def hocr(lines: DataFrame) -> DataFrame:
    """One hOCR fragment of each page from its lines (place, x, y, x2, y2, text)."""
    escaped = F.replace(F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    box = F.concat_ws(" ", *[F.col(c).cast("long") for c in ("x", "y", "x2", "y2")])
    line = F.concat(F.lit("<span class='ocr_line' title='bbox "), box, F.lit("'>"), escaped, F.lit("</span>"))
    listed = lines.groupBy("doc_id", "page_no").agg(F.array_sort(F.collect_list(F.struct("place", line.alias("t")))).alias("l"))
    return listed.select("doc_id", "page_no", F.concat(F.lit("<div class='ocr_page'>"), F.array_join(F.transform("l", lambda x: x["t"]), ""), F.lit("</div>")).alias("html"))


def known_text(text: Column, known: str) -> Column:
    """A text with the characters that have a glyph, spaces squeezed; compatibility forms are plain first."""
    from quillframe.functions.strings import nfkc

    return F.trim(F.regexp_replace(F.regexp_replace(nfkc(text), f"[^{known}]", ""), " +", " "))


def similarity(pairs: DataFrame, *keys: str, top: float = 255.0) -> DataFrame:
    """The structural similarity (SSIM) of two images given by pixels a and b, over the whole image."""
    c1, c2 = (0.01 * top) ** 2, (0.03 * top) ** 2
    s = pairs.groupBy(*keys).agg(F.avg("a").alias("ma"), F.avg("b").alias("mb"), F.var_pop("a").alias("va"), F.var_pop("b").alias("vb"), F.covar_pop("a", "b").alias("ab"))
    m = F.col("ma"), F.col("mb")
    return s.select(*keys, ((2 * m[0] * m[1] + c1) * (2 * F.col("ab") + c2) / ((m[0] * m[0] + m[1] * m[1] + c1) * (F.col("va") + F.col("vb") + c2))).alias("ssim"))


def bands_of(centres: list[float], lows: list[float], highs: list[float], share: float = 0.5) -> list[int]:
    """The line of each character in order: the latest band that holds at least share of its height, which it widens; else a new one."""
    bands: list[list[float]] = []
    out = []
    for _, low, high in zip(centres, lows, highs, strict=True):
        hit = next((k for k in range(len(bands) - 1, -1, -1) if min(high, bands[k][1]) - max(low, bands[k][0]) >= share * (high - low)), None)
        if hit is None:
            bands.append([low, high])
            hit = len(bands) - 1
        else:
            bands[hit] = [min(low, bands[hit][0]), max(high, bands[hit][1])]
        out.append(hit)
    return out


def banded(chars: DataFrame, *keys: str) -> DataFrame:
    """Characters (seq, y, y2) of a page with their band."""
    return _folded(chars.select(*keys, "seq", "y", "y2"), keys, ["seq"], ["seq", "y", "y2"], "int", "band", bands_of)


def inherited(nodes: DataFrame, levels: int = 16) -> DataFrame:
    """Each node (id, parent, value) with the value of its nearest ancestor that has one, itself first, up to levels above it."""
    now = nodes.select("id", F.col("parent").alias("up"), "value")
    base = nodes.select(F.col("id").alias("b_id"), F.col("parent").alias("b_up"), F.col("value").alias("b_value"))
    for _ in range(levels):
        met = now.join(base, F.col("value").isNull() & (F.col("up") == F.col("b_id")), "left")
        now = met.select("id", F.when(F.col("value").isNull(), F.col("b_up")).otherwise(F.col("up")).alias("up"), F.coalesce("value", "b_value").alias("value"))
    return now.select("id", "value")

"""Repeated passages: paragraphs that say the same, exactly or nearly, in several places.

A paragraph is a section of the word sequence between two cuts, wherever line breaks lie.  A
word begins one if the hash of the pair it ends is the least of all within ``reach`` words
on both sides, so cuts depend on nearby words only and copies of a passage are cut alike
wherever they stand.  Each paragraph has MinHash values over five-word shingles in bands,
tuned so that a pair at the threshold meets in some band with the wished recall.  Paragraphs
that meet are verified by exact Jaccard similarity (see linking.py); verified links make
components.  The first place of a component (by key, text, word) stays, the others go.

A run of such places that follow on one another is a passage.  At both ends it grows, word
by word, as long as the words are those beside the place that stays (up to MARGIN words, far
more than a cut depends on), and counts if it then has at least ``least`` words.  A
word that goes always has an equal or similar one at an earlier place, so some copy stays.

Defined cases: null and empty texts have no paragraphs; a text without a cut is one
paragraph, shorter ones than a shingle are one shingle; passages shorter than ``least`` stay;
repeated rows (key and text) are one document, texts of one key are told apart; a null key
comes first; very long texts are cut like others, words that repeat without end have no cut;
an empty table gives an empty one; further columns stay, whatever their names.  Paragraphs
are told apart by 64-bit hashes.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillframe.llm.common import dropped, free_name, written
from quillframe.llm.linking import linked, shared_buckets

SHINGLE = 5
THRESHOLD = 0.8
#: A cut is the least of this many words before and after it: one cut in 2 * REACH + 1 words.
REACH = 6
#: The shortest passage that goes, in words.
LEAST = 40
#: How many words a passage may grow at an end.
MARGIN = 48
WORD = re.compile(r"[^\x20\x09-\x0D]+")
_TOP = np.uint64(2**64 - 1)


def tuned(threshold: float = THRESHOLD, recall: float = 0.99, rows: int = 1) -> int:
    """The least number of bands of rows values each that lets a pair at the threshold meet with the recall."""
    bands = 1
    while 1 - (1 - threshold**rows) ** bands < recall:
        bands += 1
    return bands


def normal(text: str) -> list[bytes]:
    """The words of a text, A-Z lower-cased."""
    return text.encode("utf-8", "replace").lower().split()


def hashed(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(31))


def folded(each: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """A hash of each n words that follow on one another."""
    total = np.zeros(max(0, len(each) - n + 1), np.uint64)
    for k in range(n):
        total = _mixed(total ^ each[k : k + len(total)])
    return total


def shingles(words: list[bytes], n: int = SHINGLE) -> np.ndarray:
    """64-bit hashes of the n-word shingles, in order (a shorter list is one shingle)."""
    each = hashed(words)
    return folded(each, min(n, len(each)))


def signatures(flat: np.ndarray, starts: np.ndarray, bands: int, rows: int, seed: int = 5) -> np.ndarray:
    """Band keys, one row for each set of shingles (from one start in flat to the next): a hash of the band's MinHash values and its number."""
    rng = np.random.default_rng(seed)
    out = np.empty((len(starts), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(starts), b + 1, np.uint64)
        for _ in range(rows):
            flip, factor = rng.integers(0, 2**63, 2, dtype=np.uint64)
            least = np.minimum.reduceat((flat ^ flip) * (factor | np.uint64(1)), starts)
            key = (key ^ least) * np.uint64(0xD6E8FEB86659FD93)
            key ^= key >> np.uint64(32)
        out[:, b] = key
    return out


def cuts(each: np.ndarray, sizes: np.ndarray, reach: int = REACH) -> np.ndarray:
    """Where paragraphs begin in the hashed words of texts of these sizes (none 0) that follow on one another."""
    text = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(each)) + reach * (text + 1)  # with room between texts, so that no window sees two
    pairs = np.full(len(each) + reach * (len(sizes) + 1), _TOP)
    first = np.cumsum([0, *sizes[:-1]])
    before = np.concatenate([np.zeros(1, np.uint64), each[:-1]]) if len(each) else each
    before[first] = 0
    pairs[place] = _mixed(_mixed(before) ^ each) >> np.uint64(1)
    n = len(pairs)
    least = np.ones(n, bool)
    for k in range(1, reach + 1):
        least[k:] &= pairs[k:] < pairs[: n - k]
        least[: n - k] &= pairs[: n - k] <= pairs[k:]
    begins = least[place]
    begins[first] = True
    return np.flatnonzero(begins)


def sections(each: np.ndarray, sizes: np.ndarray, reach: int = REACH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Begin, words and name of each paragraph of these texts, and the shingles of all with where each paragraph's begin."""
    begins = cuts(each, sizes, reach)
    ns = np.diff([*begins, len(each)])
    nth = np.repeat(np.arange(len(begins)), ns)
    inside = (np.arange(len(each)) - begins[nth]).astype(np.uint64)
    pids = _mixed(np.add.reduceat(_mixed(_mixed(each) + inside * np.uint64(0xC2B2AE3D27D4EB4F)), begins) + ns.astype(np.uint64))
    whole = inside.astype(np.int64) + SHINGLE <= ns[nth]  # a shingle begins here and ends in the paragraph
    values = np.zeros(len(each), np.uint64)
    values[: max(0, len(each) - SHINGLE + 1)] = folded(each)
    short = ns < SHINGLE
    values[begins[short]] = pids[short]
    whole[begins[short]] = True
    return begins, ns, pids, values[whole], np.cumsum([0, *np.maximum(1, ns - SHINGLE + 1)[:-1]])


def paragraphs(docs: DataFrame, bands: int, rows: int, key: str, text: str, at_once: int = 200_000) -> DataFrame:
    """pid, (k, th) (the document: key and hash of the text), start and n (in words) and the band keys of every paragraph.

    Of equal paragraphs that are read at once (about at_once words) only the first has band
    keys, so a passage that stands in very many documents is pre-aggregated.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key_type = batch.schema.field(0).type
            at, sizes, words = [], [], []

            def out() -> pa.RecordBatch:
                each, counts = hashed(words), np.array(sizes)
                begins, ns, pids, flat, starts = sections(each, counts)
                doc = np.searchsorted(np.cumsum(counts), begins, "right")
                _, first = np.unique(pids, return_index=True)
                keys = signatures(flat, starts, bands, rows).view(np.int64)[np.sort(first)]
                has = np.zeros(len(pids), np.int64)
                has[first] = 1
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(has * bands)]), pa.int32()), pa.array(keys.ravel()))
                own = pa.array(np.array(at)[doc])
                columns = [pa.array(pids.view(np.int64)), batch.column(0).take(own).cast(key_type), batch.column(2).take(own)]
                columns += [pa.array((begins - np.cumsum([0, *counts])[doc]).astype(np.int32)), pa.array(ns.astype(np.int32)), lists]
                for x in (at, sizes, words):
                    x.clear()
                return pa.RecordBatch.from_arrays(columns, names=["pid", "k", "th", "start", "n", "bands"])

            for i, t in enumerate(batch.column(1)):
                if found := normal(t.as_py() or ""):
                    at.append(i)
                    sizes.append(len(found))
                    words += found
                if len(words) > at_once:
                    yield out()
            if words:
                yield out()

    return docs.select(key, text, F.xxhash64(text)).mapInArrow(run, f"pid long, k {kind}, th long, start int, n int, bands array<long>")


def read_places(docs: DataFrame, wanted: DataFrame, key: str, text: str, read: Callable, schema: str) -> DataFrame:
    """read(hashed words of the text, its places) of each document with wanted places (k, th, and a struct of others), as rows of the schema."""
    lists = written(wanted.groupBy(F.col("k").alias("k_"), F.col("th").alias("th_")).agg(F.collect_list("at").alias("at")), "wanted")  # of one document
    texts = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.xxhash64(text).alias("th"))
    found = texts.join(lists, F.col("k").eqNullSafe(F.col("k_")) & (F.col("th") == F.col("th_"))).select("t", "at", "k", "th")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, 256):  # a few texts at a time
                some = batch.slice(part, 256)
                columns: list[list] = [[] for _ in names]
                for t, at, k, th in zip(*(c.to_pylist() for c in some.columns), strict=True):
                    each = hashed(normal(t or ""))
                    for a in at:
                        for column, value in zip(columns, read(each, a, k, th), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(schema).fields
    names, kinds = [f.name for f in fields], [to_arrow_type(f.dataType) for f in fields]
    return found.mapInArrow(run, schema)


def shingle_sets(docs: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """pid and the sorted distinct shingle hashes of the paragraphs at the wanted places (k, th, at: start, n, pid)."""

    def read(each: np.ndarray, a: dict, k: object, th: int) -> tuple:
        own = each[a["start"] : a["start"] + a["n"]]
        return a["pid"], np.unique(folded(own)).view(np.int64) if len(own) >= SHINGLE else np.array([a["pid"]])

    return read_places(docs, wanted, key, text, read, "pid long, sh array<long>").dropDuplicates(["pid"])


def margins(docs: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """k, th, start of the wanted places (k, th, at: start, n) and hashes of the words before (nearest first) and after them."""
    kind = docs.schema[key].dataType.simpleString()

    def read(each: np.ndarray, a: dict, k: object, th: int) -> tuple:
        low, high = a["start"], a["start"] + a["n"]
        short = (each[max(0, low - MARGIN) : high + MARGIN] >> np.uint64(32)).astype(np.uint32).view(np.int32)
        own = low - max(0, low - MARGIN)
        return k, th, low, short[:own][::-1], short[own + a["n"] :]

    return read_places(docs, wanted, key, text, read, f"k {kind}, th long, start int, before array<int>, after array<int>")


def repeats(where: DataFrame, found: DataFrame) -> DataFrame:
    """k, th, start, n, class_id and f (k, th, start, n of the class's first place) of every place of a class with several; written."""
    often = where.groupBy("pid").agg(F.count("*").alias("often"))
    classed = often.join(found.withColumnRenamed("node", "pid"), "pid", "left").where("often > 1 OR component IS NOT NULL")
    named = written(classed.select("pid", F.coalesce("component", "pid").alias("class_id")), "repeated")
    places = written(where.select("pid", "k", "th", "start", "n").join(named, "pid").select("k", "th", "start", "n", "class_id").distinct(), "places")
    order = F.struct(F.col("k").isNotNull().alias("s"), "k", "th", "start", "n")
    first = written(places.groupBy("class_id").agg(F.min(order).alias("f"), F.count("*").alias("of")).where("of > 1"), "first")
    out = written(places.join(first, "class_id").select("k", "th", "start", "n", "class_id", F.struct("f.k", "f.th", "f.start", "f.n").alias("f")), "classes")
    for table in (named, places, first):
        dropped(table)
    return out


def _alike(a: str, b: str) -> Column:
    """How many leading elements two arrays share."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    differs = F.array_position(same, False)
    return F.when(differs > 0, differs - 1).otherwise(F.size(same)).cast("int")


def grown(docs: DataFrame, gone: DataFrame, key: str, text: str) -> DataFrame:
    """gone (k, th, start, n, class_id, f, left, right) with low and high: where left or right says that a run
    ends, it grows while the words beside it are those beside its class's first place."""
    edges = written(gone.where("left OR right"), "edges")
    firsts = edges.select("class_id", "f").distinct()
    wanted = edges.select("k", "th", "start", "n").unionByName(firsts.select("f.*")).distinct()
    beside = written(margins(docs, wanted.select("k", "th", F.struct("start", "n").alias("at")), key, text), "margins")

    def at(rows: DataFrame, place: str, names: tuple[str, str]) -> DataFrame:
        m = beside.select(F.col("k").alias("k_"), F.col("th").alias("th_"), F.col("start").alias("start_"), F.col("before").alias(names[0]), F.col("after").alias(names[1]))
        meet = F.col(f"{place}k").eqNullSafe(F.col("k_")) & (F.col(f"{place}th") == F.col("th_")) & (F.col(f"{place}start") == F.col("start_"))
        return rows.join(m, meet).drop("k_", "th_", "start_")

    both = at(edges, "", ("b", "a")).join(at(firsts, "f.", ("fb", "fa")).drop("f"), "class_id")
    low = F.col("start") - F.when(F.col("left"), _alike("b", "fb")).otherwise(0)
    high = F.col("start") + F.col("n") + F.when(F.col("right"), _alike("a", "fa")).otherwise(0)
    inner = gone.where("NOT left AND NOT right").withColumn("low", F.col("start")).withColumn("high", F.col("start") + F.col("n"))
    return both.withColumn("low", low).withColumn("high", high).select(*inner.columns).unionByName(inner)


def classes(
    docs: DataFrame, least: int = LEAST, threshold: float = THRESHOLD, recall: float = 0.99, rows: int = 1, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Every place of every paragraph of a passage that repeats: key, text_hash, start, n_words, class_id, removed, low, high.

    Places are counted in words.  text_hash tells texts of one key apart.  class_id is the
    component's smallest paragraph hash.  One place of each class, the first by key (null
    first), text_hash and start, is not removed.  low and high bound the words that go
    with a removed place: its own, and those that its passage grew by.
    """
    bands = tuned(threshold, recall, rows)
    where = written(paragraphs(docs, bands, rows, key, text), "paragraphs")
    met = written(shared_buckets(where.select("pid", F.explode("bands").alias("bucket"))), "buckets")
    some = where.where("size(bands) > 0").join(met.select("pid").distinct(), "pid", "left_semi")
    one = some.groupBy("pid").agg(F.min(F.struct("k", "th", "start", "n")).alias("p"))
    sets = written(shingle_sets(docs, one.select("p.k", "p.th", F.struct("p.start", "p.n", "pid").alias("at")), key, text), "shingles")
    found = linked(met, sets, threshold)
    dropped(met)
    dropped(sets)
    places = repeats(where, found)
    dropped(where)
    dropped(found)
    own, end = F.struct("k", "th", "start", "n"), F.col("start") + F.col("n")
    doc = Window.partitionBy("k", "th").orderBy("start")
    gone = places.where(~own.eqNullSafe(F.col("f"))).withColumn("left", F.coalesce(F.lag(end).over(doc) != F.col("start"), F.lit(True)))
    gone = written(gone.withColumn("right", F.coalesce(F.lead("start").over(doc) != end, F.lit(True))), "runs")
    run = F.sum(F.col("left").cast("int")).over(doc.rowsBetween(Window.unboundedPreceding, 0))
    words = F.sum(F.col("high") - F.col("low")).over(Window.partitionBy("k", "th", "run"))
    passages = written(grown(docs, gone, key, text).withColumn("run", run).withColumn("words", words).where(F.col("words") >= least), "passages")
    dropped(gone)
    firsts = passages.select("class_id", "f").distinct()
    stay = firsts.select("f.*", "class_id", F.lit(False).alias("removed"), F.col("f.start").alias("low"), (F.col("f.start") + F.col("f.n")).alias("high"))
    out = passages.select("k", "th", "start", "n", "class_id", F.lit(True).alias("removed"), "low", "high").unionByName(stay)
    return out.select(F.col("k").alias(key), F.col("th").alias("text_hash"), "start", F.col("n").alias("n_words"), "class_id", "removed", "low", "high")


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the words low..high-1 of each span; a line break among them stays one."""
    places = [m.span() for m in WORD.finditer(text)]
    out, at = [], 0
    for low, high in spans:
        begin, end = places[low][0], places[high][0] if high < len(places) else len(text)
        if begin < at:
            begin = at  # spans may overlap
        if end <= at:
            continue
        out.append(text[at:begin])
        if "\n" in text[begin:end] and begin > 0 and text[begin - 1] != "\n":
            out.append("\n")
        at = end
    out.append(text[at:])
    return "".join(out)


def deduplicated(docs: DataFrame, least: int = LEAST, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the words of removed places left out of the text; every row and other column stays."""
    gone = classes(docs, least, threshold, key=key, text=text).where("removed")
    k, th, spans = free_name(docs, "k_"), free_name(docs, "th_"), free_name(docs, "gone_")
    lists = gone.groupBy(F.col(key).alias(k), F.col("text_hash").alias(th)).agg(F.sort_array(F.collect_set(F.struct("low", "high"))).alias(spans))  # of one document
    both = docs.join(written(lists, "spans"), F.col(key).eqNullSafe(F.col(k)) & (F.xxhash64(text) == F.col(th)), "left")

    @F.pandas_udf("string")
    def left_of(texts: pd.Series, gone: pd.Series) -> pd.Series:
        return pd.Series([t if g is None else cut(t, [(p["low"], p["high"]) for p in g]) for t, g in zip(texts, gone, strict=True)], dtype=object)

    return both.withColumn(text, left_of(F.col(text), F.col(spans))).select(*docs.columns)

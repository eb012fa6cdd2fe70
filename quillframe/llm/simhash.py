"""SimHash near-duplicates by meeting in the middle.

A fingerprint has 64 bits over word shingles.  Two fingerprints within 2r bits share a
variant within r bits of both, so every distinct fingerprint emits its ball of radius r (65
variants for r = 1), variants are shuffled, and fingerprints that meet are linked after
their distance is verified.  Work is on distinct fingerprints: equal ones, however many,
are one row before any variant exists, and a variant meets at most its own ball of them.

Defined cases: a text without words (or null) has fingerprint zero and links as any other;
a text of fewer words than a shingle is one shingle; a null key is carried but its row's
component is that of the others with its fingerprint (null if alone); repeated rows stay;
an empty table gives an empty one; further columns are not carried by ``fingerprinted``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillframe.llm.common import dropped, free_name, written
from quillframe.llm.components import components
from quillframe.llm.linking import apart, joined, linked, shared_buckets
from quillframe.llm.passages import normal, shingles, signatures, tuned

BITS = 64


def fingerprint(text: str | None, shingle: int, seed: int = 42) -> int:
    """Bit i is set if more than half of the shingles' XXH64 have it.  Equal shingles count each."""
    from xxhash import xxh64_intdigest

    found = (text or "").encode("utf-8", "replace").lower().split()  # of bytes: ASCII only, both
    if not found:
        return 0
    if len(found) < shingle:
        return xxh64_intdigest(b" ".join(found), seed)
    joined = map(b" ".join, zip(*(found[k:] for k in range(shingle)), strict=False))
    hashes = np.fromiter(map(xxh64_intdigest, joined, repeat(seed)), "<u8", len(found) - shingle + 1)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprinted(docs: DataFrame, shingle: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and fp, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], names=[key, "fp"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, fp long")


def variants(fp: Column, radius: int) -> Column:
    """All values within radius bits of fp, itself included, as an array."""
    masks, ring = [0], [(0, -1)]
    for _ in range(radius):
        ring = [(m | 1 << b, b) for m, top in ring for b in range(top + 1, BITS)]
        masks += [m for m, _ in ring]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    return F.transform(F.array(*map(F.lit, signed)), lambda m: fp.bitwiseXOR(m))


def links(prints: DataFrame, distance: int = 2) -> DataFrame:
    """Edges (u, v) between distinct values of fp that keep every link of at most distance bits.

    The values that meet in a variant all lie within half the distance of it, so each is
    linked to the next one in order: a chain keeps their component whole without all pairs.
    """
    if distance % 2:
        raise ValueError("distance must be even: the radius is half of it")
    ball = prints.select(F.col("fp"), F.explode(variants(F.col("fp"), distance // 2)).alias("variant"))
    meet = ball.withColumn("next", F.lead("fp").over(Window.partitionBy("variant").orderBy("fp")))
    pairs = meet.where("next IS NOT NULL").select(F.col("fp").alias("u"), F.col("next").alias("v")).distinct()
    return pairs.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= distance)


def grouped(prints: DataFrame, key: str, distance: int) -> DataFrame:
    """fp and component_id, the smallest key of those whose fingerprints are linked to fp's."""
    least = prints.groupBy("fp").agg(F.min(key).alias("least"))
    groups = components(links(least.select("fp"), distance))
    # components of fingerprints, then the smallest key of each
    placed = written(least.join(groups, least["fp"] == groups["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component")), "placed")
    dropped(groups)
    first = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    return placed.join(first, "component").select("fp", "component_id")


def clustered(docs: DataFrame, shingle: int = 3, distance: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fp and component_id, the smallest key reachable over links."""
    prints = written(fingerprinted(docs, shingle, key, text), "fingerprints")
    return prints.join(grouped(prints, key, distance), "fp").select(key, "fp", "component_id")


def counted(words: list[bytes], shingle: int) -> np.ndarray:
    """Hashes of the shingles and of how often each came before: the Jaccard similarity of two such sets is that of all shingles, repeats included."""
    each = np.sort(shingles(words, shingle))
    first = np.flatnonzero(np.concatenate([np.ones(1, bool), each[1:] != each[:-1]]))
    times = np.arange(len(each)) - np.repeat(first, np.diff(np.append(first, len(each))))
    return np.unique((each ^ times.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93))


def near_texts(
    docs: DataFrame, threshold: float, recall: float, rows: int, key: str, text: str, names: tuple[str, str], shingle: int = 3, distance: int = 2
) -> DataFrame:
    """key, the two name columns and class_id of each row.

    Texts whose fingerprints are linked (``grouped``: ball hashing) meet, and are verified by
    the exact Jaccard similarity of the shingles that the fingerprint counts, repeats included.
    A contiguous edit (a part appended or cut) moves far more bits of a SimHash than scattered
    ones of the same similarity, so what balls do not reach meets by MinHash bands of five-word
    shingles as well: the chance to meet depends on that similarity alone.  A pair at the
    threshold meets there with the recall, and is verified by exact Jaccard similarity.
    """
    kind = docs.schema[key].dataType.simpleString()
    bands = tuned(threshold, recall, rows)

    def signed(sets: list[np.ndarray]) -> np.ndarray:
        return signatures(np.concatenate(sets), np.cumsum([0, *map(len, sets)])[:-1], bands, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            pids, prints, keys, sets, held = [], [], [], [], 0
            for t in batch.column(3):
                found = normal(t.as_py() or "")
                pids.append(xxh64_intdigest(b" ".join(found), 2))
                prints.append(fingerprint(t.as_py(), shingle))
                sets.append(shingles(found) if found else np.zeros(1, np.uint64))
                held += len(found)
                if held > 500_000:
                    keys.append(signed(sets))
                    sets, held = [], 0
            if sets:
                keys.append(signed(sets))
            if not pids:
                continue
            flat = np.concatenate(keys).view(np.int64).ravel()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, bands), pa.int32()), pa.array(flat))
            both = [pa.array(np.array(x, np.uint64).view(np.int64), pa.int64()) for x in (pids, prints)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), *both, lists], names=[key, *names, "pid", "fp", "bands"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [normal(t.as_py() or "") for t in batch.column(1)]
            sets = [np.unique(shingles(w)).view(np.int64) if w else np.zeros(0, np.int64) for w in found]
            every = [counted(w, shingle).view(np.int64) if w and ball.as_py() else np.zeros(0, np.int64) for w, ball in zip(found, batch.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.list_(pa.int64())) for x in (sets, every))], names=["pid", "sh", "every"])

    r, h = names
    prints = written(docs.select(key, r, h, text).mapInArrow(run, f"`{key}` {kind}, `{r}` long, `{h}` long, pid long, fp long, bands array<long>"), "signatures")
    single = prints.select("pid", "fp", "bands").dropDuplicates(["pid"])
    groups = grouped(prints.select("pid", "fp"), "pid", distance)
    balls = written(shared_buckets(single.join(groups, "fp").select(F.col("component_id").alias("bucket"), "pid")), "balls")
    met = written(shared_buckets(single.select("pid", F.explode("bands").alias("bucket"))), "buckets")
    asked = balls.select("pid", F.lit(True).alias("ball")).unionByName(met.select("pid", F.lit(False).alias("ball"))).groupBy("pid").agg(F.max("ball").alias("ball"))
    some = prints.select("pid", r, h).join(asked, "pid")
    wanted = written(some.groupBy("pid").agg(F.min(F.struct(r, h)).alias("f"), F.first("ball").alias("ball")).select("pid", "ball", f"f.{r}", f"f.{h}"), "wanted")
    sets = written(docs.join(wanted, [r, h]).dropDuplicates([r, h]).select("pid", text, "ball").mapInArrow(read, "pid long, sh array<long>, every array<long>"), "shingles")
    near = linked(balls, sets.select("pid", F.col("every").alias("sh")), threshold)
    # buckets whose texts the balls have put into one component are decided
    placed = met.join(near.withColumnRenamed("node", "pid"), "pid", "left").withColumn("c", F.coalesce("component", "pid"))
    left = written(apart(placed.select("bucket", "pid", "size", "c")).drop("c"), "buckets")
    more = linked(left, sets.select("pid", "sh"), threshold)
    links_ = near.where("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v"))
    found = joined(more, links_)
    for table in (balls, met, wanted, sets, left, near, more):
        dropped(table)
    return prints.join(found.withColumnRenamed("node", "pid"), "pid", "left").select(key, r, h, F.coalesce("component", "pid").alias("class_id"))


def deduplicated(
    docs: DataFrame, threshold: float = 0.8, recall: float = 0.999, rows: int = 3, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """docs with one row of each group of near copies: the smallest key's (null last; of equal keys, the least hash of key and text).

    Near copies are texts that ball hashing of fingerprints links, and those that only bands find (``near_texts``).
    Rows are named by two hashes of key and text, so the texts are shuffled once at the
    end, and repeated rows of the one that stays are one.
    """
    r, h = free_name(docs, "row_"), free_name(docs, "row2_")
    named = docs.withColumn(r, F.xxhash64(key, text)).withColumn(h, F.xxhash64(F.lit("row"), F.col(text), F.col(key)))
    placed = near_texts(named, threshold, recall, rows, key, text, (r, h))
    first = placed.groupBy("class_id").agg(F.min(F.struct(F.col(key).isNull().alias("n"), key, r, h)).alias("f"))
    keep = first.select(F.col(f"f.{r}").alias(r), F.col(f"f.{h}").alias(h))
    return named.join(keep, [r, h], "left_semi").dropDuplicates([r, h]).select(*docs.columns)

"""Mixing sources to target weights.

A source's words, in a fixed order of its documents, are cut into blocks of a fixed length.
Every output shard draws how many of its slots each source gets (whole parts of the
expectation are certain, the rest is a multinomial draw, so that a small source meets its
target as well), slots are numbered through over shards, and slot s of a source reads the
block that a pseudorandom permutation of its block numbers gives for s, around again after
the last one.  Blocks meet documents by block number.  Shards are drawn in groups, by tasks;
the driver holds one entry for each source.

Defined cases: a null or empty text has size 0 and is never taken; null is a source of its
own, the last; repeated rows are documents each; equal keys are told apart by their place;
a source without words gets nothing; an empty table gives an empty mix; a very long
document spans many blocks; further columns are kept by ``mixed``, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillframe.llm.common import free_name, n_words, written

#: Sources take these weights in turn, in code-point order, null last.
WEIGHTS = (5.0, 2.0, 1.0)
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@dataclass
class Plan:
    """What the driver holds: one entry for each source, and how many shards there are."""

    sources: list[str | None]
    sizes: list[int]
    targets: list[float]
    blocks: list[int]
    want: list[float]  # slots, in the mean
    limits: list[int]  # slots at most, so that no block is read more than ``most`` times
    shards: int
    block: int
    seed: int


def targets(sizes: list[int], weights: list[float], share: float = 1.5, most: float = 2.0) -> list[float]:
    """share of all sizes by weight; a target stops at most times its size, the excess goes to the others."""
    total, out, open_ = share * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        weight = sum(weights[i] for i in open_)
        over = {i for i in open_ if weights[i] / weight * total > most * sizes[i]}
        for i in over or open_:
            out[i] = most * sizes[i] if over else weights[i] / weight * total
        if not over:
            break
        total -= sum(out[i] for i in over)
        open_ -= over
    return out


def shard_counts(slots: np.ndarray, shard: int, shards: int, seed: int) -> np.ndarray:
    """Slots of each source in one output shard.

    The whole part of the expectation is certain and the rest is one multinomial draw of
    what the shard still lacks, so the counts over all shards stay near the targets.
    """
    expect = slots / shards
    sure = np.floor(expect).astype(np.int64)
    rest = expect - sure
    lack = int(np.floor((shard + 1) * rest.sum() + 1e-9)) - int(np.floor(shard * rest.sum() + 1e-9))
    if lack and rest.sum() > 0:
        sure += np.random.default_rng([seed, shard]).multinomial(lack, rest / rest.sum())
    return sure


def plan(sizes: list[tuple[str | None, int]], block: int, seed: int, shard_slots: int, share: float = 1.5, most: float = 2.0) -> Plan:
    """Targets and drawn slots from the size of each source (a small list)."""
    order = sorted(sizes, key=lambda r: (r[0] is None, [ord(c) for c in r[0] or ""]))
    sources, amounts = [r[0] for r in order], [int(r[1]) for r in order]
    goal = targets(amounts, [WEIGHTS[i % len(WEIGHTS)] for i in range(len(order))], share, most)
    blocks = [-(-n // block) for n in amounts]
    # mean words of a slot: the last block of a source may be short
    want = np.array([g / (n / b) if b else 0.0 for g, n, b in zip(goal, amounts, blocks, strict=True)], float)
    limits = [int(b * most) for b in blocks]
    return Plan(sources, amounts, goal, blocks, want.tolist(), limits, max(1, int(want.sum() // shard_slots)), block, seed)


def permuted(place: np.ndarray, n: np.ndarray, seed: int, rounds: int = 4) -> np.ndarray:
    """The image of each place under a pseudorandom permutation of 0..n-1 (n for each place).

    A Feistel network over the next power of four; images outside 0..n-1 walk on along
    their cycle, at most four steps in the mean.
    """
    half = np.maximum(1, np.ceil(np.log2(np.maximum(n, 2)) / 2)).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    x, limit = place.astype(np.uint64), n.astype(np.uint64)
    todo = np.arange(len(x))
    while len(todo):
        h, m = half[todo], mask[todo]
        left, right = x[todo] >> h, x[todo] & m
        for r in range(rounds):
            with np.errstate(over="ignore"):
                f = right * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 0xD1B54A32D192ED03 + r * 0x8CB92BA72F3D8DD7) % 2**64) + limit[todo]
                f ^= f >> np.uint64(29)
                f *= np.uint64(0xBF58476D1CE4E5B9)
                f ^= f >> np.uint64(32)
            left, right = right, left ^ (f & m)
        x[todo] = left << h | right
        todo = todo[x[todo] >= limit[todo]]
    return x.astype(np.int64)


def placed(docs: DataFrame, key: str, text: str, source: str, per_bucket: int = 20_000) -> DataFrame:
    """k, s, size, place (of the first word within the source) and (b, rn), which tell equal rows apart.

    Documents of a source stand in the order of a hash bucket, then the key, so a source
    of any share of the rows has its running sum taken bucket by bucket; only the sums per
    (source, bucket) meet.  The table is written: plan and blocks both read it.
    """
    sized = docs.select(F.col(key).alias("k"), F.col(source).alias("s"), n_words(F.col(text)).alias("size"), F.xxhash64(F.col(text)).alias("h"))
    sized = written(sized, "sizes")
    buckets = max(64, sized.count() // per_bucket)  # from the footers
    sized = sized.withColumn("b", F.pmod(F.xxhash64("k", "h"), F.lit(buckets)).cast("int"))
    sums = sized.groupBy("s", "b").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("s").alias("s_"), F.col("b").alias("b_"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    order = Window.partitionBy("s", "b").orderBy("k", "h", "size")
    ran = sized.select("*", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("ran"), F.row_number().over(order).alias("rn"))
    return ran.join(starts, F.col("s").eqNullSafe(F.col("s_")) & (F.col("b") == F.col("b_"))).select(
        "k", "s", "size", "b", "rn", "h", (F.col("start") + F.col("ran") - F.col("size")).alias("place")
    )


def slots_of(spark: SparkSession, made: Plan, group: int = 16) -> DataFrame:
    """Every slot of the mix: shard, si (index of the source), slot (numbered through) and the block it reads.

    Tasks draw groups of shards; the sums of the groups before give each its first slots.
    """
    want, shards, seed = np.array(made.want), made.shards, made.seed

    def counts(g: int) -> np.ndarray:
        return np.array([shard_counts(want, s, shards, seed) for s in range(g * group, min(shards, (g + 1) * group))])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g in batch.column(0).to_pylist():
                n = counts(g).sum(axis=0)
                yield pa.RecordBatch.from_arrays([pa.array([g] * len(n), pa.int64()), pa.array(range(len(n)), pa.int32()), pa.array(n)], names=["g", "si", "n"])

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, limits = np.array(made.blocks), np.array(made.limits)
        for batch in batches:
            for g, starts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at = np.zeros(len(want), np.int64)
                for x in starts:
                    at[x["si"]] = x["start"]
                for k, n in enumerate(counts(g)):
                    si = np.repeat(np.arange(len(n)), n)
                    slot = np.arange(len(si)) - np.repeat(np.cumsum(n) - n, n) + at[si]
                    at += n
                    fits = slot < limits[si]
                    si, slot = si[fits], slot[fits]
                    block = np.zeros(len(slot), np.int64)
                    for i in np.unique(si):
                        mine = si == i
                        block[mine] = permuted(slot[mine] % blocks[i], np.full(mine.sum(), blocks[i]), seed + 1 + int(i))
                    columns = [np.full(len(si), g * group + k), si.astype(np.int32), slot, block]
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["shard", "si", "slot", "block"])

    if not made.want:
        return spark.createDataFrame([], "shard long, si int, slot long, block long")
    groups = spark.range(-(-shards // group))
    sums = groups.mapInArrow(summed, "g long, si int, n long")
    before = Window.partitionBy("si").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).groupBy("g").agg(F.collect_list(F.struct("si", "start")).alias("starts"))
    # a group is a short row that makes many slots, so tasks are dealt by number, not by bytes
    tasks = min(-(-shards // group), max(200, 4 * spark.sparkContext.defaultParallelism))
    return starts.repartition(tasks, "g").mapInArrow(filled, "shard long, si int, slot long, block long")


def drawn(
    docs: DataFrame, block: int = 64, seed: int = 11, shard_slots: int = 4096, key: str = "doc_id", text: str = "text", source: str = "source"
) -> tuple[DataFrame, DataFrame, Plan]:
    """Documents with their source's index and place, how often each block is read, and the plan."""
    rows = written(placed(docs, key, text, source), "places")
    sizes = [(r[0], r[1]) for r in rows.groupBy("s").agg(F.sum("size")).collect()]
    made = plan(sizes, block, seed, shard_slots)
    names = docs.sparkSession.createDataFrame(
        [(s, i, n, t) for i, (s, n, t) in enumerate(zip(made.sources, made.sizes, made.targets, strict=True))],
        f"s_ {docs.schema[source].dataType.simpleString()}, si int, source_size long, target double",
    )
    rows = rows.join(names, F.col("s").eqNullSafe(F.col("s_"))).drop("s_")
    times = slots_of(docs.sparkSession, made).groupBy("si", "block").agg(F.count("*").alias("times"))
    return rows, times, made


def spans(rows: DataFrame, block: int) -> DataFrame:
    """rows with one line for each block they touch: block, first and last word within the document."""
    first, last = F.floor(F.col("place") / block), F.floor((F.col("place") + F.col("size") - 1) / block)
    touched = rows.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(first, last))))
    low = F.greatest(F.lit(0), F.col("block") * block - F.col("place"))
    return touched.withColumn("low", low).withColumn("high", F.least(F.col("size"), (F.col("block") + 1) * block - F.col("place")))


def taken(docs: DataFrame, block: int = 64, seed: int = 11, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """key, size, source_size, target and taken, the words that the mix takes of the document."""
    rows, times, _ = drawn(docs, block, seed, key=key, text=text, source=source)
    met = spans(rows, block).join(times.hint("merge"), ["si", "block"], "left")  # the planner cannot see how many slots a range of shards has
    got = met.groupBy("si", "b", "rn", "k", "size", "source_size", "target").agg(
        F.coalesce(F.sum(F.col("times") * (F.col("high") - F.col("low"))), F.lit(0)).alias("taken")
    )
    return got.select(F.col("k").alias(key), "size", "source_size", "target", "taken")


def cut(text: str, parts: list[tuple[int, int]]) -> str:
    """The words low..high-1 of each part, verbatim where they follow on one another, else on lines of their own."""
    places = [m.span() for m in WORD.finditer(text)]
    if parts == [(0, len(places))]:
        return text
    return "\n".join(text[places[low][0] : places[high - 1][1]] for low, high in parts)


def mixed(docs: DataFrame, block: int = 64, seed: int = 11, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix as documents: a row for each time that words of a document are read.

    The first row of a document holds the words read at least once, the second those read
    twice; its other columns stay.  A document that the mix does not read has no row.
    """
    rows, times, _ = drawn(docs, block, seed, key=key, text=text, source=source)
    met = spans(rows, block).join(times.hint("merge"), ["si", "block"])
    copies = met.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    k, s, h, n, parts = (free_name(docs, f"{c}_of_row") for c in ("key", "source", "hash", "nth", "parts"))
    reads = copies.groupBy("si", "b", "rn", "copy").agg(
        F.first("k").alias(k), F.first("s").alias(s), F.first("h").alias(h), F.sort_array(F.collect_list(F.struct("low", "high"))).alias(parts)
    )
    # equal rows of a table (key, source, text) are numbered alike on both sides
    reads = reads.withColumn(n, F.row_number().over(Window.partitionBy(k, s, h, "copy").orderBy("rn"))).select(k, s, h, n, parts)
    others = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    twins = Window.partitionBy(F.col(key), F.col(source), F.xxhash64(F.col(text))).orderBy(F.xxhash64(*others))

    @F.pandas_udf("string")
    def words_of(texts: pd.Series, parts: pd.Series) -> pd.Series:
        return pd.Series([cut(t, joined([(int(p["low"]), int(p["high"])) for p in ps])) for t, ps in zip(texts, parts, strict=True)])

    mine = free_name(docs, "nth_of_twins")
    numbered = docs.withColumn(mine, F.row_number().over(twins))
    same = F.col(key).eqNullSafe(F.col(k)) & F.col(source).eqNullSafe(F.col(s)) & (F.xxhash64(F.col(text)) == F.col(h)) & (F.col(mine) == F.col(n))
    return numbered.join(reads.hint("merge"), same).withColumn(text, words_of(F.col(text), F.col(parts))).select(*docs.columns)


def joined(parts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ascending parts with those that follow on one another made one."""
    out: list[tuple[int, int]] = []
    for low, high in parts:
        if out and out[-1][1] == low:
            out[-1] = (out[-1][0], high)
        else:
            out.append((low, high))
    return out

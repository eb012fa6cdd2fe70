"""Scoring by a weighted backoff automaton.

States are the words of the training texts (the end token stands before each text).  From
state u an arc leads by each word v seen after it; its weight is the smoothed bigram
probability (c(uv) + k(u) P(v)) / (c(u) + k(u)).  All other words take the failure arc of
u, weight k(u) / (c(u) + k(u)), to the state without context, where every word has an arc
of weight P(v) = (c(v) + 1) / (N + V + 1), c being 0 for the one unknown type.  So each
state's weights add up to one.  k(u) = c(u) ** power stands for the number of types after
u; the power is fitted so that these numbers add up to the distinct bigrams there are.
A text is walked once, left to right: the state after a token is that token, and the sum
of log10 weights is carried along.

All bigrams of the corpus count, and nothing of the model is held whole anywhere.  Texts
are packed into batches of about PACK bytes, kept as a table.  Each batch sends the hashed
unigrams and bigrams it holds, with its own training counts, to ranges of hashes, as one
row of bytes for each range; a range adds up the counts of all batches and sends the totals
back in the order of the batch's keys.  The number of ranges grows with the input, so a
range stays as large as RANGE bytes of text make it.  A key has 40 bits within its range,
so about two in a million share one with another, at any size.

Defined cases: a null or empty text is the end token alone; without training texts every
probability is 1; null keys and repeated rows are scored each; a very long text is a batch
of its own; an empty table gives an empty one; further columns are not carried.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import written
from quillframe.llm.passages import hashed, normal

#: Bytes of text in a batch, and behind one range of keys.
PACK = 8 << 20
RANGE = 16 << 20
#: Bytes of text that are split into words at once.
PIECE = 1 << 20
#: The hash of the end token: no word is empty.
END = hashed([b""])[0]
#: Tried powers of k(u).
POWERS = tuple(p / 20 for p in range(21))
_LOW = 40


def tokens(text: str | None) -> list[bytes]:
    """A-Z lower-cased words, then the end token."""
    return [*normal(text or ""), b""]


def held_out(key: Column, parts: int = 7, part: int = 2) -> Column:
    """Whether crc32 of the key as text falls into the part that is kept from learning."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % parts == part


def packed(docs: DataFrame, learn: Column, pack: int, key: str, text: str) -> DataFrame:
    """Batches of texts: batch, their keys (ks), which of them teach (learn), bytes (size) and the words (data: a line for each text)."""
    kind = docs.schema[key].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, number = TaskContext.get().partitionId(), 0
        ks, learns, lines, size = [], [], [], 0
        for part in parts:
            for k, t, teaches in zip(*part.columns, strict=True):
                line = b" ".join(normal(t.as_py() or ""))
                ks.append(k)
                learns.append(teaches.as_py())
                lines.append(line)
                size += len(line) + 1
                if size > pack:
                    yield out(at << 32 | number, part.schema.field(0).type, ks, learns, lines, size)
                    number, ks, learns, lines, size = number + 1, [], [], [], 0
        if ks:
            yield out(at << 32 | number, part.schema.field(0).type, ks, learns, lines, size)

    def out(batch: int, key_type: pa.DataType, ks: list, learns: list, lines: list, size: int) -> pa.RecordBatch:
        data = pa.compress(b"\n".join(lines), "zstd", asbytes=True)
        whole = pa.ListArray.from_arrays(pa.array([0, len(ks)], pa.int32()), pa.array([k.as_py() for k in ks], key_type))
        flags = pa.ListArray.from_arrays(pa.array([0, len(ks)], pa.int32()), pa.array(learns, pa.bool_()))
        return pa.RecordBatch.from_arrays([pa.array([batch], pa.int64()), whole, flags, pa.array([size], pa.int64()), pa.array([data], pa.binary())], names=["batch", "ks", "learn", "size", "data"])

    rows = docs.select(F.col(key), F.col(text), F.coalesce(learn, F.lit(False)).alias("learn_"))
    return rows.mapInArrow(run, f"batch long, ks array<{kind}>, learn array<boolean>, size long, data binary")


def unpacked(data: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashed tokens of a batch's texts, one after the other, and how many each text has."""
    end, parts, sizes = np.array([END], np.uint64), [], []
    for line in pa.decompress(data, size - 1, "zstd", asbytes=True).split(b"\n"):
        at, n = 0, 1
        while at < len(line):
            to = line.find(b" ", at + PIECE)
            to = len(line) if to < 0 else to
            parts.append(hashed(line[at:to].split(b" ")))
            at, n = to + 1, n + len(parts[-1])
        parts.append(end)
        sizes.append(n)
    return np.concatenate(parts), np.array(sizes, np.int64)


def bigrams(each: np.ndarray) -> np.ndarray:
    """A hash of each token and the one before it; the end token comes before a text's first."""
    before = np.concatenate([[END], each[:-1]]).astype(np.uint64)
    x = before * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x = (x ^ each) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x * np.uint64(0x94D049BB133111EB)


def keyed(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The first ``bits`` bits of a hash, the range, and 40 further ones."""
    return hashes >> np.uint64(64 - bits - _LOW)


def _small(numbers: np.ndarray) -> np.ndarray:
    """Whole numbers from 0 up in as few bytes as the largest needs."""
    return numbers.astype(next(t for t in ("u1", "<u2", "<u4", "<u8") if numbers.max(initial=0) <= np.iinfo(t).max))


def _numbers(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, {1: "u1", 2: "<u2", 4: "<u4", 8: "<u8"}[len(data) // n]).astype(np.int64)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and how often each is there."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
    return keys[first], np.diff(np.append(first, len(keys)))


def asked(packs: DataFrame, bits: int) -> DataFrame:
    """What each batch holds, by range (rng; unigrams, then bigrams): its keys in order, and its training counts of them."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for i in range(part.num_rows):
                batch, learn, size, data = (part.column(c)[i].as_py() for c in range(4))
                each, sizes = unpacked(data, size)
                teaches = np.repeat(np.array(learn, bool), sizes)
                for kind in range(2):
                    held = keyed(bigrams(each) if kind else each, bits)
                    keys, _ = _distinct(held)
                    taught, often = _distinct(held[teaches])
                    counts = np.zeros(len(keys), np.int64)
                    counts[np.searchsorted(keys, taught)] = often
                    ranges, first = np.unique(keys >> np.uint64(_LOW), return_index=True)
                    edges = [*first.tolist(), len(keys)]
                    low = np.ascontiguousarray(keys).astype("<u8").view(np.uint8).reshape(-1, 8)[:, : _LOW // 8]
                    names = (ranges.astype(np.int64) | kind << 32).tolist()
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([batch] * len(names), pa.int64()),
                            pa.array(names, pa.int64()),
                            pa.array([low[a:b].tobytes() for a, b in zip(edges, edges[1:], strict=False)], pa.binary()),
                            pa.array([_small(counts[a:b]).tobytes() for a, b in zip(edges, edges[1:], strict=False)], pa.binary()),
                        ],
                        names=["batch", "rng", "keys", "counts"],
                    )

    return packs.select("batch", "learn", "size", "data").mapInArrow(run, "batch long, rng long, keys binary, counts binary")


def answered(questions: DataFrame) -> DataFrame:
    """The totals of each batch's keys (batch, rng, totals), and for each range a row without batch: its tokens, types and the sums of its counts' powers."""

    def add(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        blobs = rows["keys"].to_pylist()
        sizes = [len(b) * 8 // _LOW for b in blobs]
        wide = np.zeros((sum(sizes), 8), np.uint8)
        wide[:, : _LOW // 8] = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, _LOW // 8)
        held = wide.view("<u8")[:, 0]
        keys, _ = _distinct(held)
        nth = np.searchsorted(keys, held)
        counts = np.concatenate([_numbers(c, n) for c, n in zip(rows["counts"].to_pylist(), sizes, strict=True)])
        totals = np.zeros(len(keys), np.int64)
        np.add.at(totals, nth, counts)
        edges = np.cumsum([0, *sizes])
        given = [_small(totals[nth[a:b]]).tobytes() for a, b in zip(edges, edges[1:], strict=False)]
        seen = totals[totals > 0].astype(np.float64)
        powers = [[]] * len(given) + [[float((seen**p).sum()) for p in POWERS]]
        rng = rows["rng"][0].as_py()
        return pa.table(
            [
                pa.array([*rows["batch"].to_pylist(), None], pa.int64()),
                pa.array([rng] * (len(given) + 1), pa.int64()),
                pa.array([*given, None], pa.binary()),
                pa.array([None] * len(given) + [int(totals.sum())], pa.int64()),
                pa.array([None] * len(given) + [len(seen)], pa.int64()),
                pa.array(powers, pa.list_(pa.float64())),
            ],
            names=["batch", "rng", "totals", "tokens", "types", "powers"],
        )

    return questions.groupBy("rng").applyInArrow(add, "batch long, rng long, totals binary, tokens long, types long, powers array<double>")


class Model:
    """Training tokens, distinct ones, and the power of k(u)."""

    def __init__(self, tokens: int, types: int, pairs: int, powers: list[float]):
        """pairs: distinct bigrams; powers: the sums of all words' counts to each of POWERS."""
        self.total, self.distinct = tokens, types
        self.power = POWERS[min(range(len(POWERS)), key=lambda i: abs(powers[i] - pairs))] if tokens else 0.0

    def plain(self, c: np.ndarray) -> np.ndarray:
        """P(v) from the count of v."""
        return (c + 1.0) / (self.total + self.distinct + 1.0)

    def arc(self, both: np.ndarray, state: np.ndarray, plain: np.ndarray) -> np.ndarray:
        """The weight from a state: its arc's, or over its failure arc where both is 0."""
        k = np.maximum(state, 1.0) ** self.power
        return (both + k * plain) / (state + k)


def scored(docs: DataFrame, learn: Column, pack: int = PACK, span: int = RANGE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, n_known, train_tokens, base_score and score of every text; the rows where learn is true teach the model."""
    kind = docs.schema[key].dataType.simpleString()
    packs = written(packed(docs, learn, pack, key, text), "texts", arrow_bytes=pack)
    size = packs.agg(F.sum("size")).first()[0] or 0
    bits = min(64 - _LOW, max(0, math.ceil(math.log2(max(1, size / span)))))
    answers = written(answered(asked(packs, bits)), "totals")
    ends = answers.where("batch IS NULL").withColumn("kind", F.shiftright("rng", 32))
    sums = {r.kind: r for r in ends.groupBy("kind").agg(F.sum("tokens").alias("tokens"), F.sum("types").alias("types"), F.array(*[F.sum(F.col("powers")[i]) for i in range(len(POWERS))]).alias("powers")).collect()}
    model = Model(sums[0].tokens, sums[0].types, sums[1].types, list(sums[0].powers)) if sums else Model(0, 0, 0, [])

    def walk(texts: pa.Table, totals: pa.Table) -> pa.Table:
        found: list[dict[int, bytes]] = [{}, {}]
        for rng, blob in zip(totals["rng"].to_pylist(), totals["totals"].to_pylist(), strict=True):
            found[rng >> 32][rng & 0xFFFFFFFF] = blob
        parts = []
        for i in range(texts.num_rows):
            each, sizes = unpacked(texts["data"][i].as_py(), texts["size"][i].as_py())
            counts = []
            for kind, blobs in enumerate(found):
                held = keyed(bigrams(each) if kind else each, bits)
                keys, _ = _distinct(held)
                ranges, n = _distinct(keys >> np.uint64(_LOW))
                of = np.concatenate([_numbers(blobs[int(r)], int(k)) for r, k in zip(ranges, n, strict=True)])
                counts.append(of.astype(np.float64)[np.searchsorted(keys, held)])
            single, both = counts
            plain = model.plain(single)
            # the state before each token is the token before it; the first one's is the end token, the last one of the batch
            weights = model.arc(both, np.concatenate([single[-1:], single[:-1]]), plain)
            begins = np.cumsum([0, *sizes[:-1]])
            columns = [sizes, np.add.reduceat((single > 0).astype(np.int64), begins), np.full(len(sizes), model.total), np.add.reduceat(np.log10(plain), begins), np.add.reduceat(np.log10(weights), begins)]
            parts.append(pa.table([texts["ks"].combine_chunks().slice(i, 1).flatten(), *map(pa.array, columns)], names=names))
        return pa.concat_tables(parts)

    names = [key, "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    schema = f"`{key}` {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    told = answers.where("batch IS NOT NULL").select("batch", "rng", "totals")
    return packs.select("batch", "ks", "size", "data").groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(walk, schema)

"""Cost-balanced packing of whole documents into token sequences.

Each scan task tokenizes its rows and packs them in groups of a fixed number of
sequences, so nothing is shuffled and a task holds one group at a time.  Within a group
documents go in descending size to the sequence of the lowest estimated cost (linear plus
quadratic attention cost) that has room; one that fits nowhere is cut at the room of the
emptiest sequence.  What a group cannot fill to the brim waits for the next one, and the
last few tokens of a task go to sequences of power-of-two sizes, so padding is nil.

Defined cases: a null or empty text is its end id alone; a null key is carried; equal rows
are separate documents; a text of any length is cut into pieces; an empty table packs into
nothing.  Further columns of the input are not carried.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "{key} {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def costs(length: int, hidden: int) -> float:
    """Attention cost of one piece: linear in its tokens plus quadratic, in units of a token's linear cost."""
    return length + length * length / (6.0 * hidden)


def capacities(total: int, length: int, last: bool) -> list[int]:
    """Sizes of the sequences for total tokens: full ones and, at the end, powers of two."""
    sizes = [length] * (total // length)
    rest = total % length
    if last:
        sizes += [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
    return sizes


def assign(sizes: list[int], rooms: list[int], hidden: int) -> list[tuple[int, int, int, int, int]]:
    """Place items of sizes into rooms that hold exactly as much: (item, start, length, room, offset).

    Descending items, ties by position; the lowest-cost room that holds the item, ties by
    position; else the item is cut at the largest remaining room.
    """
    room, left = np.array(rooms, np.int64), np.array(rooms, np.int64)
    cost = np.zeros(len(rooms))
    # two-dimensional work is avoided: a group has few rooms
    todo = [(-n, k, 0) for k, n in enumerate(sizes) if n]
    heapq.heapify(todo)
    placed = []
    while todo:
        negative, k, start = heapq.heappop(todo)
        n = -negative
        fits = left >= n
        if fits.any():
            r, piece = int(np.where(fits, cost, np.inf).argmin()), n
        else:
            r = int(left.argmax())
            piece = int(left[r])
            heapq.heappush(todo, (piece - n, k, start + piece))
        placed.append((k, start, piece, r, int(room[r] - left[r])))
        left[r] -= piece
        cost[r] += costs(piece, hidden)
    return placed


class Packer:
    """Groups of documents to placed pieces."""

    def __init__(self, length: int, group: int, hidden: int):
        self.length, self.group, self.hidden = length, group, hidden
        self.waiting: list[tuple[object, int, np.ndarray, int]] = []  # key, ids before, ids, tokens of the document
        self.tokens, self.sequences = 0, 0

    def add(self, key, ids: np.ndarray) -> bool:
        """Take a document; true if a group is full."""
        self.waiting.append((key, 0, ids, len(ids)))
        self.tokens += len(ids)
        return self.tokens >= self.length * self.group

    def flush(self, last: bool) -> Iterator[tuple]:
        """Pack what waits.  Unless last, the end of the last document stays for the next group."""
        rooms = capacities(self.tokens, self.length, last)
        keep = self.tokens - sum(rooms)
        later = []
        while keep:  # cut off the end
            key, before, ids, total = self.waiting.pop()
            cut = min(keep, len(ids))
            later.append((key, before + len(ids) - cut, ids[len(ids) - cut :], total))
            if len(ids) > cut:
                self.waiting.append((key, before, ids[: len(ids) - cut], total))
            keep -= cut
        for k, start, n, room, offset in assign([len(x[2]) for x in self.waiting], rooms, self.hidden):
            key, before, ids, total = self.waiting[k]
            yield key, before + start, n, ids[start : start + n].astype("<u4").tobytes(), total, self.sequences + room, offset
        self.sequences += len(rooms)
        self.waiting = later[::-1]
        self.tokens = sum(len(x[2]) for x in self.waiting)


def packed(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    length: int = 2048,
    group: int = 256,
    hidden: int = 1024,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Pieces of all documents: key, start, length, ids (little-endian uint32), doc_tokens, sequence_id, offset.

    tokenizer is the path of a vocabulary file that every executor has.  Sequence ids are
    unique over tasks (task index in the upper bits); rerunning a lost task on the same
    split of the input gives the same pieces.
    """
    kind = docs.schema[key].dataType.simpleString()
    schema = SCHEMA.format(key=f"`{key}`", kind=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from quillframe.llm.tokens import Encoder

        encoder, packer = Encoder(tokenizer), Packer(length, group, hidden)
        base = TaskContext.get().partitionId() << 36
        end = np.array([end_id], np.uint32)

        def rows(last: bool) -> Iterator[pa.RecordBatch]:
            got = list(packer.flush(last))
            if got:
                columns = list(zip(*got, strict=True))
                columns[5] = [base + s for s in columns[5]]
                kinds = [key_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[key, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        key_type = pa.int64()
        for batch in batches:
            key_type = batch.schema.field(0).type
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            at = 0
            while at < len(texts):
                stop, chars = at, 0
                while stop < len(texts) and chars < 4_000_000:
                    chars += len(texts[stop] or "")
                    stop += 1
                for k, ids in zip(keys[at:stop], encoder.encode([t or "" for t in texts[at:stop]]), strict=True):
                    if packer.add(k, np.concatenate([ids, end])):
                        yield from rows(False)
                at = stop
        yield from rows(True)

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, schema)

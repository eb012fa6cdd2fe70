"""Chat formatting with minimum-cost role repair.

A legal conversation is an optional system message, then user and assistant in turn,
ending with the assistant.  A dynamic program over this automaton chooses for every turn
whether it keeps its role, is given another one, or is merged into the message before it,
and where empty messages are inserted, at the least total cost; the repaired messages are
rendered with markers.

The cost of a run of turns is a matrix over start and end states, and matrices multiply
(minimum of sums), so a conversation of any length is cut into runs: turns are dealt by
ranges of (conversation, turn), each run becomes a matrix, the few runs of a conversation
are joined by a second dynamic program that fixes the states at their borders, and each
run is then solved on its own.

Defined cases: a null or unknown role must be given a role; null text is empty; null turns
come first, turns of equal number stand in the order of role, text and place in the input;
a null conversation id is a conversation; repeated rows are turns each; very long texts are
rendered whole; "<|" within a text is rendered as "< |", so that no text holds a marker; an empty table gives an empty one; further columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import written

ROLES = ("system", "user", "assistant")
# States: nothing yet, or the role of the open message.
BEGIN, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {BEGIN: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
RELABEL, MERGE, INSERT = 3.0, 1.0, 2.0


def steps(state: int, role: int) -> list[tuple[float, int, int, int]]:
    """Ways to take a turn of a role (1..3, 0 unknown): (cost, state after, role inserted before or 0, merged 0/1)."""
    out = []
    for label in (SYSTEM, USER, ASSISTANT):
        cost = 0.0 if label == role else RELABEL
        if label == state:
            out.append((cost + MERGE, label, 0, 1))
        if label in NEXT[state]:
            out.append((cost, label, 0, 0))
        for between in NEXT[state]:
            if label in NEXT[between]:
                out.append((cost + INSERT, label, between, 0))
    return sorted(out)


def closing(state: int) -> float:
    """The cost of ending in a state: an empty assistant message is inserted where one is missing."""
    return {ASSISTANT: 0.0, USER: INSERT, SYSTEM: 2 * INSERT, BEGIN: 0.0}[state]


STEPS = [[steps(s, r) for s in range(4)] for r in range(4)]
#: The matrix of one turn, for each role.
TURN = np.full((4, 4, 4), np.inf)
for _r in range(4):
    for _s in range(4):
        for _c, _e, _, _ in STEPS[_r][_s]:
            TURN[_r, _s, _e] = min(TURN[_r, _s, _e], _c)


def product(roles: np.ndarray) -> np.ndarray:
    """The matrix of a run of turns."""
    total = np.where(np.eye(4) > 0, 0.0, np.inf)
    for r in roles:
        total = (total[:, :, None] + TURN[r][None]).min(axis=1)
    return total


def path(matrices: list[np.ndarray], start: int, end: int | None) -> tuple[list[int], float]:
    """States at the borders of runs on a cheapest way from start to end (None: any, with its closing cost)."""
    costs = [np.where(np.arange(4) == start, 0.0, np.inf)]
    for m in matrices:
        costs.append((costs[-1][:, None] + m).min(axis=0))
    last = costs[-1] + [closing(s) for s in range(4)] if end is None else np.where(np.arange(4) == end, costs[-1], np.inf)
    state = int(np.argmin(last))
    states = [state]
    for m, before in zip(reversed(matrices), reversed(costs[:-1]), strict=True):
        state = int(np.argmin(before + m[:, state]))
        states.append(state)
    return states[::-1], float(last.min())


def repaired(roles: list[int], start: int, end: int | None) -> list[tuple[int, int, int, float]]:
    """For each turn: its role, the role inserted before it or 0, merged 0/1, its cost."""
    states, _ = path([TURN[r] for r in roles], start, end)
    out = []
    for r, s, e in zip(roles, states, states[1:], strict=False):
        cost, _, between, merged = next(x for x in STEPS[r][s] if x[1] == e)
        out.append((e, between, merged, cost))
    return out


def render(role: int, between: int, merged: int, text: str, state: int) -> str:
    """What a turn adds to the rendered conversation, given the state before it."""
    text = text.replace("<|", "< |")  # no marker in a text
    if merged:
        return "\n" + text
    close = "<|end|>\n" if state != BEGIN else ""
    empty = f"<|{ROLES[between - 1]}|>\n<|end|>\n" if between else ""
    return f"{close}{empty}<|{ROLES[role - 1]}|>\n{text}"


def finish(state: int) -> str:
    """What ends a rendered conversation."""
    if state == BEGIN:
        return ""
    missing = {ASSISTANT: (), USER: (ASSISTANT,), SYSTEM: (USER, ASSISTANT)}[state]
    return "<|end|>\n" + "".join(f"<|{ROLES[m - 1]}|>\n<|end|>\n" for m in missing)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 5000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def formatted(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row for each turn: conversation, seq (its order), turn, role, new_role, inserted_role, merged, cost, rendered.

    The renderings of a conversation in the order of seq make it up; the last one has its end.
    """
    ids, nums = turns.schema[conv].dataType, turns.schema[turn].dataType
    kind, number = ids.simpleString(), nums.simpleString()
    from pyspark.sql.pandas.types import to_arrow_type

    conv_type, turn_type = to_arrow_type(ids), to_arrow_type(nums)
    code = F.coalesce(*[F.when(F.lower(F.trim(role)) == r, F.lit(k + 1)) for k, r in enumerate(ROLES)], F.lit(0)).cast("int")
    rows = turns.select(F.col(conv).alias("c"), F.col(turn).alias("n"), F.col(role).alias("role"), F.col(text).alias("t"), code.alias("code"), F.monotonically_increasing_id().alias("m"))
    order = ["c", "n", "role", F.xxhash64("t"), "m"]

    def number_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([run] * n, pa.int64()), pa.array(range(at, at + n), pa.int64())], names=[*batch.schema.names, "run", "pos"])
            at += n

    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("m")
    dealt = written(sorted_rows.mapInArrow(number_runs, f"c {kind}, n {number}, role string, t string, code int, run long, pos long"), "turns")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = ((c, run, product([r[3] for r in part]).ravel().tolist()) for (c, run), part in groupby(_rows(batches), lambda r: (r[0], r[1])))
        return _batched(found, pa.schema([("c", conv_type), ("run", pa.int64()), ("m", pa.list_(pa.float64()))]))

    def join_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved() -> Iterator[tuple]:
            for c, part in groupby(_rows(batches), lambda r: r[0]):
                runs = list(part)  # at most one for each task of the sort
                states, _ = path([np.array(r[2]).reshape(4, 4) for r in runs], BEGIN, None)
                for k, r in enumerate(runs):
                    yield c, r[1], states[k], states[k + 1], k == len(runs) - 1

        return _batched(solved(), pa.schema([("c", conv_type), ("run", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("last", pa.bool_())]))

    narrow = dealt.select("c", "run", "pos", "code").repartition("c", "run").sortWithinPartitions("c", "run", "pos")
    runs = narrow.mapInArrow(multiply, f"c {kind}, run long, m array<double>")
    ends = runs.repartition("c").sortWithinPartitions("c", "run").mapInArrow(join_runs, f"c {kind}, run long, start int, end int, last boolean")
    ends = ends.select(F.col("c").alias("c_"), F.col("run").alias("run_"), "start", "end", "last")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple]:
            for (c, run), part in groupby(_rows(batches), lambda r: (r[0], r[1])):
                held = list(part)  # a run: part of one task of the sort
                state, end = held[0][7], held[0][8]
                fixed = repaired([r[6] for r in held], state, end)
                for k, (r, (label, between, merged, cost)) in enumerate(zip(held, fixed, strict=True)):
                    shown = render(label, between, merged, r[5] or "", state)
                    if k == len(held) - 1 and r[9]:
                        shown += finish(label)
                        cost += closing(label)
                    yield c, run << 36 | r[2], r[3], r[4], ROLES[label - 1], ROLES[between - 1] if between else None, bool(merged), cost, shown
                    state = label

        fields = [("c", conv_type), ("seq", pa.int64()), ("n", turn_type), ("role", pa.string()), ("new_role", pa.string()), ("inserted_role", pa.string()), ("merged", pa.bool_()), ("cost", pa.float64()), ("rendered", pa.string())]
        return _batched(made(), pa.schema(fields))

    both = dealt.join(ends, F.col("c").eqNullSafe(F.col("c_")) & (F.col("run") == F.col("run_")))
    full = both.select("c", "run", "pos", "n", "role", "t", "code", "start", "end", "last").repartition("c", "run").sortWithinPartitions("c", "run", "pos")
    schema = f"c {kind}, seq long, n {number}, role string, new_role string, inserted_role string, merged boolean, cost double, rendered string"
    return full.mapInArrow(solve, schema).withColumnsRenamed({"c": conv, "n": turn})

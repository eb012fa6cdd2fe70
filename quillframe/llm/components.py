"""Connected components by alternating stars, wholly in DataFrames.

Edges are first contracted where they are read: a task puts the smallest node that its own
edges reach in the place of each node's neighbours, about ``at_once`` edges at a time, so long
chains do not take rounds and what is shuffled are the tasks' stars.  Then each round joins
edges with the smallest neighbour of their ends; rounds end when nothing moves.  Each star's edges are written to the shared folder, which cuts the lineage,
survives lost executors and lets no stage run twice.  A node of very many edges is pre-aggregated before each
shuffle, and adaptive execution splits its side of the join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import dropped, written


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u goes to the smallest of u and its neighbours.  One row an edge: some may repeat."""
    back = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    least = edges.unionByName(back).groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return back.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """u (each edge runs from the larger u to the smaller v) and its smaller neighbours go to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    # the edge to the smallest one stays, so u is there without a row of its own
    return edges.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of the edges that is not the smallest one it reaches over them, and that smallest node."""
    nodes, places = np.unique(np.concatenate([u, v]), return_inverse=True)
    root, (a, b) = np.arange(len(nodes)), np.split(places, 2)
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while len(np.flatnonzero(root[root] != root)):
            root = root[root]
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _contracted(edges: DataFrame, rows: int, at_once: int) -> DataFrame:
    """Edges (u, v), u larger, that link the same nodes: stars, one for each component of about at_once edges of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            found = forest(*(np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in held]) for k in range(2)))
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(found, held[0].schema.types, strict=True)], names=["u", "v"])

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= at_once:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    return edges.select("u", "v").coalesce(max(1, -(-rows // at_once))).mapInArrow(run, edges.select("u", "v").schema)


def components(edges: DataFrame, rounds: int = 60, at_once: int = 1 << 19) -> DataFrame:
    """(node, component) for every node of edges (u, v): component is its smallest reachable node.

    Null ends and loops do not link; repeated edges count once; no edges, no rows.
    ``dropped`` removes the table that the result is read from.
    """
    def size(table: DataFrame) -> tuple:
        """Order-free sums: a star forest stays as it is, so they repeat."""
        return tuple(table.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    ends = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "edges")
    now = written(_contracted(ends, ends.count(), at_once), "edges")  # the count is from the footers
    dropped(ends)
    before = size(now)
    for _ in range(rounds):
        large = written(_large_star(now), "edges")  # read twice: else its join would run twice
        dropped(now)
        after = written(_small_star(large), "edges")
        dropped(large)
        now, found = after, size(after)
        if found == before:
            break
        before = found
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct()
    out = now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
    out._quillframe_path = now._quillframe_path
    return out

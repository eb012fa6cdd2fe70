"""Order-dependent operators of one page: line clusters, fixpoint merges, separation, typesetting.

Each is a pure function of one page's few hundred boxes, run by applyInPandas on the
page key; only the columns named in the select before it are sent.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["doc_id", "page_no"]


def gap_islands(words: DataFrame, factor: float = 3.5) -> DataFrame:
    """Clusters of a row's words whose gaps are at most factor mean character widths (single linkage in one dimension)."""
    row = Window.partitionBy(*KEY, "row_no")
    order = row.orderBy("x", "seq")
    mean = F.avg((F.col("x2") - F.col("x")) / F.col("n")).over(row)
    new = F.coalesce((F.col("x") - F.lag("x2").over(order) > factor * mean).cast("int"), F.lit(0))
    return words.withColumn("new", new).withColumn("cluster", F.sum("new").over(order)).drop("new")


def components_of(x: np.ndarray, y: np.ndarray, eps: float, at_once: int = 4_000_000) -> np.ndarray:
    """Single-linkage clusters of points by Manhattan distance: each point's least index of its cluster.

    A sweep in x gives each point its candidates; labels then fall to the least of the
    linked ones, with pointer jumping, until nothing moves.
    """
    n = len(x)
    order = np.argsort(x, kind="stable")
    xs, ys = x[order], y[order]
    ends = np.searchsorted(xs, xs + eps, "right")
    links = []
    begin = 0
    while begin < n:  # bounded blocks of candidate pairs
        counts = ends[begin:] - np.arange(begin, n) - 1
        stop = begin + max(1, int(np.searchsorted(np.cumsum(counts), at_once, "right")))
        counts = counts[: stop - begin]
        u = np.repeat(np.arange(begin, min(stop, n)), counts)
        v = u + 1 + np.arange(len(u)) - np.repeat(np.cumsum(counts) - counts, counts)
        near = (xs[v] - xs[u]) + np.abs(ys[v] - ys[u]) <= eps
        links.append(np.stack([order[u[near]], order[v[near]]]))
        begin = stop
    u, v = np.concatenate(links, axis=1) if links else np.zeros((2, 0), int)
    top = np.arange(n)
    while True:
        least = np.minimum(top[u], top[v])
        before = top.copy()
        np.minimum.at(top, top[u], least)
        np.minimum.at(top, top[v], least)
        while (top[top] != top).any():
            top = top[top]
        if (top == before).all():
            return top


def clustered(words: DataFrame, factor: float = 3.5) -> DataFrame:
    """Words of a page with the cluster of their centres: linked within factor times the mean character size; named by its first word."""

    def page(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        seqs, x, y, x2, y2 = (pdf[c].to_numpy() for c in ("seq", "x", "y", "x2", "y2"))
        sizes = np.concatenate([(x2 - x) / pdf["n"].to_numpy(), y2 - y])
        eps = factor * (sizes[sizes > 0].mean() if (sizes > 0).any() else 10.0)
        return pd.DataFrame({"doc_id": pdf["doc_id"], "page_no": pdf["page_no"], "seq": seqs, "cluster": seqs[components_of((x + x2) / 2, (y + y2) / 2, eps)]})

    return words.select(*KEY, "seq", "n", "x", "y", "x2", "y2").groupBy(*KEY).applyInPandas(page, "doc_id long, page_no long, seq int, cluster int")


def merge_boxes(boxes: np.ndarray, joins) -> list[list[int]]:
    """Merge the first pair (in order of both) that joins, start again, until none does; groups of indices in order.

    After a merge only the grown group can join with those before it, so it is compared
    with them, at once, and not all pairs again.
    """
    boxes = np.array(boxes, float).reshape(-1, 4)
    groups = [[k] for k in range(len(boxes))]
    k = 0
    while k < len(groups):
        hits = np.flatnonzero(joins(boxes[k], boxes[k + 1 :]))
        if not len(hits):
            k += 1
            continue
        into, other = k, k + 1 + int(hits[0])
        while True:
            boxes[into] = [*np.minimum(boxes[into, :2], boxes[other, :2]), *np.maximum(boxes[into, 2:], boxes[other, 2:])]
            groups[into] += groups.pop(other)
            boxes = np.delete(boxes, other, axis=0)
            earlier = np.flatnonzero(joins(boxes[into], boxes[:into]))
            if not len(earlier):
                break
            into, other = int(earlier[0]), into
        k = into
    return groups


def touching(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether boxes are at most 2 apart in x and share over half of their joint height, or lie over each other by 0.8 of the smaller."""
    high = np.minimum(a[..., 3], b[..., 3]) - np.maximum(a[..., 1], b[..., 1])
    joint = np.maximum(a[..., 3], b[..., 3]) - np.minimum(a[..., 1], b[..., 1])
    wide = np.minimum(a[..., 2], b[..., 2]) - np.maximum(a[..., 0], b[..., 0])
    small = np.minimum((a[..., 2] - a[..., 0]) * (a[..., 3] - a[..., 1]), (b[..., 2] - b[..., 0]) * (b[..., 3] - b[..., 1]))
    return (wide >= -2) & (high > 0.5 * joint) | (wide > 0) & (high > 0) & (wide * high > 0.8 * small)


def any_touch(boxes: np.ndarray) -> bool:
    """Whether any two boxes touch: a sweep in y, as those that touch overlap there."""
    order = boxes[np.argsort(boxes[:, 1], kind="stable")]
    counts = np.maximum(0, np.searchsorted(order[:, 1], order[:, 3], "left") - np.arange(len(order)) - 1)
    u = np.repeat(np.arange(len(order)), counts)
    v = u + 1 + np.arange(len(u)) - np.repeat(np.cumsum(counts) - counts, counts)
    return bool(touching(order[u], order[v]).any())


def by_page(rows: DataFrame, order: str, fold: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, ...]], schema: str, at_once: int = 200_000) -> DataFrame:
    """Boxes (order, x, y, x2, y2) of a page through a fold of its order and boxes, which gives the columns behind doc_id and page_no.

    A page is one row, and a batch of pages one call, so that pages are neither shuffled again
    nor begun one by one; results leave by about at_once boxes.
    """
    boxes = rows.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct(order, "x", "y", "x2", "y2"))).alias("r"))
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.concatenate([[0], np.cumsum(batch.column(2).value_lengths().to_numpy(zero_copy_only=False))])
            first, *edges = (c.to_numpy(zero_copy_only=False) for c in batch.column(2).flatten().flatten())
            begin = 0
            while begin < batch.num_rows:
                stop = max(begin + 1, int(np.searchsorted(ends, ends[begin] + at_once, "right")) - 1)
                got = [fold(first[i:j], np.stack([e[i:j] for e in edges], axis=1)) for i, j in zip(ends[begin:stop], ends[begin + 1 : stop + 1], strict=True)]
                pages = pa.array(np.repeat(np.arange(begin, stop), [len(g[0]) for g in got]))
                columns = [pa.array(np.concatenate(c)) for c in zip(*got, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pages), batch.column(1).take(pages), *columns], names=names)
                begin = stop

    return boxes.mapInArrow(run, schema)


def merged_boxes(items: DataFrame) -> DataFrame:
    """Items (seq and box) of a page with the group they merge into at the fixpoint."""

    def page(seqs: np.ndarray, boxes: np.ndarray) -> tuple[np.ndarray, ...]:
        into = seqs.copy()
        if any_touch(boxes):
            for g in merge_boxes(boxes, touching):
                into[g] = seqs[min(g)]
        return seqs, into

    return by_page(items, "seq", page, "doc_id long, page_no long, seq int, group_seq int")


def separate(boxes: list[list[float]]) -> list[list[float]]:
    """Part vertically overlapping boxes at the middle of their overlap, one unit apart, for at most n rounds over all pairs."""
    boxes = [list(b) for b in boxes]
    for _ in boxes:
        moved = False
        for i, a in enumerate(boxes):
            for b in boxes[i + 1 :]:
                if a[0] < b[2] and b[0] < a[2] and a[1] < b[3] and b[1] < a[3]:
                    upper, lower = (a, b) if a[3] >= b[3] else (b, a)
                    if lower[1] >= upper[1]:
                        continue  # one holds the other
                    middle = (upper[1] + lower[3]) / 2
                    upper[1], lower[3] = middle + 1, middle - 1
                    moved = True
        if not moved:
            break
    return boxes


def separated(paras: DataFrame) -> DataFrame:
    """Paragraph boxes of a page without vertical overlaps."""

    def page(seqs: np.ndarray, boxes: np.ndarray) -> tuple[np.ndarray, ...]:
        return seqs, *np.array(separate(boxes.tolist()), float).T

    return by_page(paras, "para_seq", page, "doc_id long, page_no long, para_seq long, x double, y double, x2 double, y2 double")


def absorbed(paras: list[tuple[int, str, bool]]) -> list[int]:
    """The paragraph each one ends up in: (seq, layout and object, is a line number).

    A paragraph followed by one or more line numbers and then by one of its own layout
    takes the latter in; the numbers stay where they are, so directly following ones of
    the layout are taken in as well.
    """
    target = [p[0] for p in paras]
    k = 0
    while k < len(paras):
        if paras[k][2]:
            k += 1
            continue
        j, numbers = k + 1, 0
        while j < len(paras) and (paras[j][2] or (numbers and paras[j][1] == paras[k][1])):
            if paras[j][2]:
                numbers += 1
            else:
                target[j] = paras[k][0]
            j += 1
        taken = [i for i in range(k + 1, j) if target[i] == paras[k][0]]
        k = max(taken) + 1 if taken else k + 1
    return target


def number_merged(paras: DataFrame) -> DataFrame:
    """Paragraphs of a page with the one that takes them in."""

    def page(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("para_seq").reset_index(drop=True)
        pdf["into"] = absorbed(list(pdf[["para_seq", "label", "is_number"]].itertuples(index=False, name=None)))
        return pdf[["doc_id", "page_no", "para_seq", "into"]]

    return paras.select(*KEY, "para_seq", "label", "is_number").groupBy(*KEY).applyInPandas(page, "doc_id long, page_no long, para_seq long, into long")


def line_starts(widths: np.ndarray, wide: float, scale: float, em: float = 10.0) -> np.ndarray:
    """The first unit of each line when units are set at a scale, one after the other, and wrapped at the width."""
    right = np.cumsum((widths + 0.5 * em) * scale)
    starts, at = [0], 0
    while True:
        left = right[at] - (widths[at] + 0.5 * em) * scale
        # units fit while their right edge, without the space behind them, is within the width
        at = max(at + 1, int(np.searchsorted(right, left + wide + 0.5 * em * scale + 1e-9, "right")))
        if at >= len(widths):
            return np.array(starts)
        starts.append(at)


def fitted(widths: np.ndarray, wide: float, high: float, skip: float = 1.3, em: float = 10.0) -> tuple[float, int, bool]:
    """The first scale from 1 down (steps of 0.05 above 0.6, else 0.1, floor 0.1) at which the units fit, the lines, and whether they fit.

    Lines are found by bisection over running widths, a step for each line.
    """
    steps = 20
    while True:
        scale = steps / 20
        lines = len(line_starts(widths, wide, scale, em))
        fits = ((lines - 1) * skip + 1) * em * scale <= high + 1e-9
        if fits or steps <= 2:
            return scale, lines, fits
        steps -= 1 if scale > 0.6 else 2


def typeset(paras: DataFrame) -> DataFrame:
    """Paragraphs (box and text) with the scale at which their words fit, the number of lines, and whether they fit at all.

    A paragraph is one row, so nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns[3:]), strict=True)
            got = [fitted(6.0 * np.fromiter(map(len, text.split(" ")), float), x2 - x, y2 - y) for text, x, y, x2, y2 in rows]
            scale, lines, fits = zip(*got, strict=True) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(scale, pa.float64()), pa.array(lines, pa.int32()), pa.array(fits, pa.bool_())], names=["doc_id", "page_no", "para_seq", "scale", "n_lines", "fits"])

    return paras.select(*KEY, "para_seq", "text", "x", "y", "x2", "y2").mapInArrow(run, "doc_id long, page_no long, para_seq long, scale double, n_lines int, fits boolean")

"""Rendering order, parts, dual pages, watermark grids, detections, scales, gates over pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillframe.functions import geometry as G

LAST = 9999999999999999


def render_units(*kinds: DataFrame) -> DataFrame:
    """Units (doc_id, page_no, kind, idx, render_order, sub_order) of several kinds in drawing order."""
    out = kinds[0].withColumn("kind_ord", F.lit(0))
    for k, other in enumerate(kinds[1:], 1):
        out = out.unionByName(other.withColumn("kind_ord", F.lit(k)))
    order = Window.partitionBy("doc_id", "page_no").orderBy(F.coalesce("render_order", F.lit(LAST)), F.coalesce("sub_order", F.lit(LAST)), "kind_ord", "idx")
    return out.withColumn("place", F.row_number().over(order))


def parts(pages: DataFrame, size: int) -> DataFrame:
    """First and last page of each part of at most size pages."""
    return pages.groupBy("doc_id", F.expr(f"page_no div {size}").alias("part_no")).agg(F.min("page_no").alias("first_page"), F.max("page_no").alias("last_page"), F.count("*").alias("n_pages"))


def alternating(pages: DataFrame, translated_first: bool = False) -> DataFrame:
    """Slots of a dual document whose pages alternate between the original and the translation."""
    side = F.explode(F.array(F.lit("original"), F.lit("translated"))).alias("side")
    both = pages.select("doc_id", "page_no", side)
    ahead = F.col("side") == ("translated" if translated_first else "original")
    return both.withColumn("slot", 2 * F.col("page_no") + F.when(ahead, 0).otherwise(1))


def side_by_side(original: DataFrame, translated: DataFrame) -> DataFrame:
    """Pages of both, as wide as their sum and as high as the higher one."""
    t = translated.select("doc_id", "page_no", F.col("w").alias("w2"), F.col("h").alias("h2"))
    return original.join(t, ["doc_id", "page_no"]).select("doc_id", "page_no", (F.col("w") + F.col("w2")).alias("w"), F.greatest("h", "h2").alias("h"))


def grid_spacing(page: Column, mark: Column) -> Column:
    """Spacing along one side: the largest of 3, 2.5, 2, 1.5 marks that gives three tiles, then spread evenly."""
    fits = F.coalesce(*[F.when(F.floor(page / (mark * s)) >= 3, mark * s) for s in (3.0, 2.5, 2.0, 1.5)], mark * 1.5)
    return F.try_divide(page, F.floor(page / fits))


def image_to_page(x: Column, limit: Column, flip: Column | None = None) -> Column:
    """Pixel to page units: cut to whole units, flipped where wanted, clipped to 0..limit-1."""
    v = x.cast("int") if flip is None else (flip - x).cast("int")
    return G.clip(v, F.lit(0), (limit - 1).cast("int"))


def unletterbox(v: Column, size: Column, target: int) -> Column:
    """A coordinate of a letterboxed image of side target back in the page of that size."""
    gain = F.least(F.lit(1.0), F.lit(float(target)) / size)
    pad = F.bround((F.lit(float(target)) - size * gain) / 2 - 0.1)
    return (v - pad) / gain


def grown_boxes(boxes: DataFrame, cell: tuple[float, float] = (64.0, 16.0)) -> DataFrame:
    """Text boxes grown to hold the paragraph boxes that are nearly the same (IoU over 0.95).

    Such boxes have centres within a twentieth of their size of each other, so they meet on
    the grid cell of the paragraph's centre.
    """
    edges = ("x", "y", "x2", "y2")
    half = [((F.col(a) + F.col(b)) / 2, (F.col(b) - F.col(a)) / 20) for a, b in (("x", "x2"), ("y", "y2"))]
    p = boxes.where("label = 'paragraph_hybrid'").select("doc_id", "page_no", *[F.floor(m / c).alias(g) for (m, _), c, g in zip(half, cell, ("gx", "gy"), strict=True)], *[F.col(e).alias(f"p{e}") for e in edges])
    t = boxes.where("label = 'text'").select("doc_id", "page_no", "det_id", *edges)
    for (m, d), c, g in zip(half, cell, ("gx", "gy"), strict=True):
        t = t.withColumn(g, F.explode(F.sequence(F.floor((m - d) / c), F.floor((m + d) / c))))
    near = G.iou(G.box(), G.box("p")) > 0.95
    keys = ["doc_id", "page_no", "gx", "gy"]
    met = t.join(p, [*[t[k] == p[k] for k in keys], near], "left").select(t["doc_id"], t["page_no"], "det_id", *edges, *[f"p{e}" for e in edges])
    got = met.groupBy("doc_id", "page_no", "det_id", *edges).agg(F.min("px").alias("px"), F.min("py").alias("py"), F.max("px2").alias("px2"), F.max("py2").alias("py2"))
    grown = [(F.least if e in ("x", "y") else F.greatest)(F.col(e), F.coalesce(f"p{e}", e)).alias(e) for e in edges]
    return got.select("doc_id", "page_no", "det_id", *grown)


def confident(detections: DataFrame, least: float = 0.25) -> DataFrame:
    """Detections above the confidence, numbered by it within their page."""
    order = Window.partitionBy("doc_id", "page_no").orderBy(F.desc("conf"), "det_id")
    return detections.where(F.col("conf") > least).withColumn("place", F.row_number().over(order))


def modal_scale(units: DataFrame) -> DataFrame:
    """The document's most frequent scale by units (least on ties), and each scale clamped to it."""
    votes = units.groupBy("doc_id", "scale").agg(F.sum("n").alias("v"))
    mode = votes.groupBy("doc_id").agg(F.min_by("scale", F.struct(-F.col("v"), F.col("scale"))).alias("mode_scale"))
    return units.join(mode, "doc_id").withColumn("clamped", F.least("scale", "mode_scale"))


def scanned(pages: DataFrame, share: float = 0.8) -> DataFrame:
    """Whether most pages of a document are scanned; one page alone never makes it so."""
    n, s = F.count("*"), F.count_if(F.col("flag"))
    return pages.groupBy("doc_id").agg(n.alias("n_pages"), ((n > 1) & (s >= F.greatest(share * n, F.lit(1)))).alias("scanned"))

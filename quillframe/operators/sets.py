"""Unions, differences and names over glossaries, fonts and layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def active_glossaries(user: DataFrame, auto: DataFrame, extract: bool) -> DataFrame:
    """User glossaries, and the automatic one where terms are extracted (an empty one adds nothing)."""
    return user.unionByName(auto) if extract else user


def free_glossary_name(names: DataFrame, stem: str) -> DataFrame:
    """stem, or with the least #n that no glossary has yet: one row."""
    taken = names.where((F.col("name") == stem) | F.col("name").rlike(f"^{stem}#[0-9]+$")).select(F.when(F.col("name") == stem, 0).otherwise(F.substring_index("name", "#", -1).cast("int")).alias("n")).distinct()
    # the first gap in 0, 1, 2, ...: numbers below their rank are taken without one
    ranked = taken.where("n >= 0").withColumn("r", F.row_number().over(Window.orderBy("n")) - 1)
    gap = ranked.agg(F.count_if(F.col("n") == F.col("r")).alias("n"))
    return gap.select(F.when(F.col("n") == 0, stem).otherwise(F.concat(F.lit(f"{stem}#"), F.col("n"))).alias("name"))


def later_wins(first: DataFrame, second: DataFrame, *keys: str) -> DataFrame:
    """Entries of both maps, the second's where both have a key."""
    both = first.withColumn("p_", F.lit(0)).unionByName(second.withColumn("p_", F.lit(1)))
    values = [c for c in first.columns if c not in keys]
    return both.groupBy(*keys).agg(*[F.max_by(c, "p_").alias(c) for c in values])


def formula_fonts(page: DataFrame, objects: DataFrame) -> DataFrame:
    """Formula fonts of each object of a page: the page's without those that the object declares as others, and its own."""
    scopes = objects.select("doc_id", "page_no", "xobj_id").distinct()
    inherited = scopes.join(page.where("is_formula").select("doc_id", "page_no", "font_id"), ["doc_id", "page_no"])
    other = objects.where(~F.col("is_formula")).select("doc_id", "page_no", "xobj_id", "font_id")
    own = objects.where("is_formula").select("doc_id", "page_no", "xobj_id", "font_id")
    return inherited.join(other, ["doc_id", "page_no", "xobj_id", "font_id"], "left_anti").unionByName(own).distinct()


def with_fallback_lines(layouts: DataFrame, lines: DataFrame) -> DataFrame:
    """Layouts, and lines as further ones: ids go on behind the page's highest, confidence 1, label fallback_line."""
    keys = ["doc_id", "page_no"]
    top = layouts.groupBy(*keys).agg(F.max("layout_id").alias("top"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("line_no"))
    added = lines.join(top, keys, "left").withColumn("layout_id", F.coalesce("top", F.lit(-1)) + place)
    columns = [*keys, "layout_id", "label", "conf", "x", "y", "x2", "y2"]
    return layouts.select(*columns).unionByName(added.withColumn("label", F.lit("fallback_line")).withColumn("conf", F.lit(1.0)).select(*columns))


def with_tables(layouts: DataFrame, boxes: DataFrame) -> DataFrame:
    """Layouts and the boxes of a table model, whose ids begin at 1 again: (source, layout_id) is the key."""
    return layouts.withColumn("source", F.lit("layout")).unionByName(boxes.withColumn("source", F.lit("table")))


def fused(first: DataFrame, second: DataFrame) -> DataFrame:
    """Detections of two models: ids from 1000 and 2000, the second's labels marked, by confidence."""
    a = first.withColumn("det_id", F.col("det_id") + 1000)
    b = second.withColumn("det_id", F.col("det_id") + 2000).withColumn("label", F.concat("label", F.lit("_hybrid")))
    order = Window.partitionBy("doc_id", "page_no").orderBy(F.desc("conf"), "det_id")
    return a.unionByName(b).withColumn("place", F.row_number().over(order))


def allowed_tokens(original: Column, injected: Column) -> Column:
    return F.array_sort(F.array_union(original, injected))


def cross_column(paras: DataFrame, jump: float = 20.0) -> DataFrame:
    """Pairs of body paragraphs of a page that follow on one another where the upper edge jumps up; none is in two pairs.

    Pairs are taken greedily, so in a run of jumps every other one counts.
    """
    page = Window.partitionBy("doc_id", "page_no").orderBy("para_seq")
    up = paras.withColumn("next_seq", F.lead("para_seq").over(page)).withColumn("up", F.coalesce(F.lead("y2").over(page) - F.col("y2") > jump, F.lit(False)))
    breaks = up.withColumn("run", F.sum((~F.col("up")).cast("int")).over(page))
    nth = F.row_number().over(Window.partitionBy("doc_id", "page_no", "run").orderBy("para_seq"))
    return breaks.where("up").withColumn("nth", nth).where("nth % 2 = 1").select("doc_id", "page_no", F.col("para_seq").alias("left_seq"), F.col("next_seq").alias("right_seq"))


def cross_page(ends: DataFrame) -> DataFrame:
    """The last body paragraph of a page with the first of the next, page by page; a paragraph is in one pair only.

    ends: doc_id, page_no, first_no, last_no.  Only a page of one paragraph can be claimed
    twice, so along a chain of such pages every other link counts.
    """
    doc = Window.partitionBy("doc_id").orderBy("page_no")
    links = ends.withColumn("right_no", F.when(F.lead("page_no").over(doc) == F.col("page_no") + 1, F.lead("first_no").over(doc)))
    # a link continues a chain if it begins with the one paragraph that the link before it ends with
    chained = (F.col("first_no") == F.col("last_no")) & F.lag("right_no").over(doc).isNotNull()
    runs = links.withColumn("chain", F.sum((~F.coalesce(chained, F.lit(False))).cast("int")).over(doc)).where("right_no IS NOT NULL")
    nth = F.row_number().over(Window.partitionBy("doc_id", "chain").orderBy("page_no"))
    return runs.withColumn("nth", nth).where("nth % 2 = 1").select("doc_id", "page_no", F.col("last_no").alias("left_no"), "right_no")


def in_cells(boxes: DataFrame, queries: DataFrame, cell: float = 50.0) -> DataFrame:
    """Boxes that meet each query box of their page (query_id, box_id): both go to grid cells, meet there, and are tested once."""
    def dealt(rows: DataFrame, p: str) -> DataFrame:
        across = [F.explode(F.sequence(F.floor(F.col(f"{p}{a}") / cell), F.floor(F.col(f"{p}{b}") / cell))) for a, b in (("x", "x2"), ("y", "y2"))]
        return rows.withColumn("gx", across[0]).withColumn("gy", across[1])

    meet = dealt(boxes, "b").join(dealt(queries, "q"), ["doc_id", "page_no", "gx", "gy"])
    touch = (F.col("bx") < F.col("qx2")) & (F.col("qx") < F.col("bx2")) & (F.col("by") < F.col("qy2")) & (F.col("qy") < F.col("by2"))
    # a pair counts in the cell of its intersection's lower left corner only
    first = (F.col("gx") == F.floor(F.greatest("bx", "qx") / cell)) & (F.col("gy") == F.floor(F.greatest("by", "qy") / cell))
    return meet.where(touch & first).select("doc_id", "page_no", "query_id", "box_id")

"""Formulas, styles, elements and offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillframe.functions import geometry as G


def formula_start(char: Column) -> Column:
    """Marks, symbols, separators, private use, Greek, digits, brackets and bullets; CID tokens."""
    first = F.substring(char, 1, 1)
    return char.contains("(cid:") | ((char != " ") & first.rlike(r"^[\p{Mn}\p{Sk}\p{Sm}\p{Zl}\p{Zp}\p{Zs}\p{Co}Ͱ-Ͽ0-9\[\]•]"))


def formula_middle(char: Column) -> Column:
    return formula_start(char) | char.startswith(",")


def formula_font(name: Column, allow: str = "^(CMMI|CMSY|CMEX|MSBM|Symbol)", deny: str = "(Roman|Times|Arial|Helvetica)", broad: str = "(Math|Symb|Cambria)") -> Column:
    """Precise allow list, then deny list, then broad allow list; a subset prefix before + does not count."""
    plain = F.regexp_replace(name, r"^[A-Z]{6}\+", "")
    return F.when(plain.rlike(allow), True).when(plain.rlike(deny), False).when(plain.rlike(broad), True).otherwise(False)


def runs(rows: DataFrame, partition: list[str], order: str, *tags: str) -> DataFrame:
    """rows with ``run``: 0, 1, ... for stretches of equal tags in order."""
    w = Window.partitionBy(*partition).orderBy(order)
    changed = F.lit(False)
    for t in tags:
        changed = changed | ~F.col(t).eqNullSafe(F.lag(t).over(w))
    flagged = rows.withColumn("new", F.when(F.row_number().over(w) == 1, 0).otherwise(changed.cast("int")))
    return flagged.withColumn("run", F.sum("new").over(w)).drop("new")


def comma_groups(chars: DataFrame) -> DataFrame:
    """Characters (key, seq, c) dealt into groups at commas outside brackets; commas themselves fall.

    Depth never goes below zero: it is the running sum less its running minimum.
    """
    w = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("c").isin("(", "[", "{"), 1).when(F.col("c").isin(")", "]", "}"), -1).otherwise(0)
    depth = chars.withColumn("sum", F.sum(step).over(w))
    depth = depth.withColumn("depth", F.col("sum") - F.least(F.lit(0), F.min("sum").over(w)))
    cut = ((F.col("c") == ",") & (F.col("depth") == 0)).cast("int")
    return depth.withColumn("cut", cut).withColumn("part", F.sum("cut").over(w)).where("cut = 0").select("key", "seq", "c", "part")


def base_style(items: DataFrame) -> DataFrame:
    """The style of a paragraph: each field where all agree, else its most frequent value (first seen on ties)."""
    def mode(c: str) -> DataFrame:
        n = items.groupBy("doc_id", "page_no", c).agg(F.count("*").alias("n"), F.min("seq").alias("s"))
        return n.groupBy("doc_id", "page_no").agg(F.min_by(c, F.struct(-F.col("n"), F.col("s"))).alias(c), F.count("*").alias(f"{c}_kinds"))

    return mode("font_id").join(mode("font_size"), ["doc_id", "page_no"])


def same_style(a: tuple, b: tuple) -> Column:
    """Equal font and graphic state, sizes within 0.02: (font, size, state)."""
    return (a[0] == b[0]) & (F.abs(a[1] - b[1]) < 0.02) & a[2].eqNullSafe(b[2])


def assigned_elements(candidates: DataFrame) -> DataFrame:
    """Each element's best formula: exact before tolerant, higher score, lower formula."""
    best = F.struct((~F.col("exact")).cast("int").alias("t"), -F.col("score"), F.col("formula_id"))
    return candidates.groupBy("doc_id", "page_no", "element_id").agg(F.min_by("formula_id", best).alias("formula_id"))


def kept_lines(curves: DataFrame, figures: DataFrame, paras: DataFrame, most: float = 0.9) -> DataFrame:
    """Curves to remove: not within a figure, but within a paragraph."""
    c = tuple(F.col(f"e{k}") for k in ("x", "y", "x2", "y2"))
    box = F.struct("x", "y", "x2", "y2")
    placed = [rows.where("doc_id IS NOT NULL AND page_no IS NOT NULL").select("doc_id", "page_no", box.alias(k)) for rows, k in ((figures, "figure_"), (paras, "para_"))]
    # curves meet their page's boxes in one window: tables dealt by document stay where they are, a join on pages would shuffle the curves
    all_rows = curves.withColumn("curve_", F.lit(True))
    for rows in placed:
        all_rows = all_rows.unionByName(rows, allowMissingColumns=True)
    page = Window.partitionBy("doc_id", "page_no")
    met = all_rows.withColumn("figures_", F.collect_list("figure_").over(page)).withColumn("paras_", F.collect_list("para_").over(page)).where("curve_")
    within = lambda boxes: F.exists(boxes, lambda b: F.coalesce(G.overlap_ratio(c, (b["x"], b["y"], b["x2"], b["y2"])) > most, F.lit(False)))
    return met.where(~within("figures_") & within("paras_")).select(*curves.columns)


def neighbour_offsets(items: DataFrame) -> DataFrame:
    """For each formula word of a line the horizontal gap to the text word before it, with its dead zones."""
    before = Window.partitionBy("doc_id", "page_no", "row_no").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    text_end = F.last(F.when(~F.col("is_formula"), F.col("x2")), ignorenulls=True).over(before)
    off = items.withColumn("gap", F.col("x") - text_end).where("is_formula")
    zone = F.when(F.abs("gap") < 0.1, 0.0).when(F.col("gap") > 10, 0.0).when(F.col("gap") < -5, 0.0).otherwise(F.col("gap"))
    return off.select("doc_id", "seq", F.coalesce(zone, F.lit(0.0)).alias("x_offset"))


def corner_marks(words: DataFrame, enter: float = 0.79, stay: float = 1.1) -> DataFrame:
    """Words set smaller than what precedes them in their line, with the state in_corner.

    A word enters if its size is below enter times the size before; it stays while its
    size is below stay times the corner's.  So it is a mark if, up to it, the last word that
    entered comes after the last one that could not have stayed: two running maxima.
    """
    line = Window.partitionBy("doc_id", "line_no").orderBy("seq")
    before = F.lag("font_size").over(line)
    enters, breaks = F.col("font_size") < enter * before, ~F.coalesce(F.col("font_size") < stay * before, F.lit(False))
    so_far = line.rowsBetween(Window.unboundedPreceding, 0)
    marked = words.withColumn("e_", F.when(enters, F.col("seq"))).withColumn("b_", F.when(breaks, F.col("seq")))
    corner = F.coalesce(F.max("e_").over(so_far) > F.coalesce(F.max("b_").over(so_far), F.lit(-1)), F.lit(False))
    return marked.select("doc_id", "line_no", "seq", corner.alias("corner"))


def same_but_size(a: tuple, b: tuple) -> Column:
    """Equal font and graphic state, sizes of a ratio between 0.7 and 1.3."""
    ratio = F.try_divide(a[1], b[1])
    return (a[0] == b[0]) & (ratio > 0.7) & (ratio < 1.3) & a[2].eqNullSafe(b[2])


def same_but_font(a: tuple, b: tuple) -> Column:
    """Sizes within 0.02 and equal graphic state."""
    return (F.abs(a[1] - b[1]) < 0.02) & a[2].eqNullSafe(b[2])


def element_candidates(elements: DataFrame, formulas: DataFrame, exact: float = 0.95, tolerance: float = 2.0, cell: tuple[float, float] = (64.0, 16.0)) -> DataFrame:
    """Pairs of elements and formulas of a page: contained exactly, or within the tolerance with a score by distance.

    An element that is held by 0.95 has its centre in the formula's wide box, so both meet on
    the grid cell of that centre: pairs are few, however many boxes a page has.
    """
    e = tuple(F.col(f"e{c}") for c in ("x", "y", "x2", "y2"))
    f = tuple(F.col(f"f{c}") for c in ("x", "y", "x2", "y2"))
    wide = (f[0] - tolerance, f[1] - tolerance, f[2] + tolerance, f[3] + tolerance)
    at = [F.floor((e[k] + e[k + 2]) / 2 / cell[k]) for k in (0, 1)]
    placed = elements.withColumn("gx", at[0]).withColumn("gy", at[1])
    covered = [F.explode(F.sequence(F.floor(wide[k] / cell[k]), F.floor(wide[k + 2] / cell[k]))) for k in (0, 1)]
    dealt = formulas.withColumn("gx", covered[0]).withColumn("gy", covered[1])
    near = F.lit(0.5) + 0.4 * F.greatest(F.lit(0.0), 1 - G.gap_distance(e, f) / 100)
    share, loose = G.overlap_ratio(e, f), G.overlap_ratio(e, wide)
    # both are rows of one table that is grouped by cell: tables dealt by document stay where they are, a join on cells would shuffle them
    cell_keys, known = ["doc_id", "page_no", "gx", "gy"], "doc_id IS NOT NULL AND page_no IS NOT NULL"
    one = placed.where(known).select(*cell_keys, F.struct("element_id", "e_xobj", *[f"e{c}" for c in ("x", "y", "x2", "y2")]).alias("e"))
    two = dealt.where(known).select(*cell_keys, F.struct("formula_id", "f_xobj", *[f"f{c}" for c in ("x", "y", "x2", "y2")]).alias("f"))
    cells = one.unionByName(two, allowMissingColumns=True).groupBy(*cell_keys).agg(F.collect_list("e").alias("es"), F.collect_list("f").alias("fs"))
    met = cells.where((F.size("es") > 0) & (F.size("fs") > 0)).select("doc_id", "page_no", F.explode("es").alias("e"), "fs").select("doc_id", "page_no", "e", F.explode("fs").alias("f"))
    pairs = met.select("doc_id", "page_no", "e.*", "f.*").where(F.col("f_xobj").isNull() | (F.col("e_xobj") == F.col("f_xobj")))
    scored = pairs.select("doc_id", "page_no", "element_id", "formula_id", share.alias("share"), loose.alias("loose"), near.alias("near"))
    kept = scored.where((F.col("share") >= exact) | (F.col("loose") >= exact))
    return kept.select("doc_id", "page_no", "element_id", "formula_id", (F.col("share") >= exact).alias("exact"), F.when(F.col("share") >= exact, F.col("share")).otherwise(F.col("near")).alias("score"))

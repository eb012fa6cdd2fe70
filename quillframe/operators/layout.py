"""Layout, paragraphs and lines over positioned words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from quillframe.functions import geometry as G
from quillframe.functions.labels import PRIORITY, TEXT, rank

def _page() -> WindowSpec:
    """Words of a page in order."""
    return Window.partitionBy("doc_id", "page_no").orderBy("seq")



def label_rank(label):
    """Priority of a label column as a literal map look-up."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(v) for p in PRIORITY for v in (p, rank(p))]), label), F.lit(len(PRIORITY)))


def with_boxes(words: DataFrame, layouts: DataFrame) -> DataFrame:
    """words with the array of their page's layout boxes."""
    one = F.struct("layout_id", "label", label_rank(F.col("label")).alias("rank"), "lx", "ly", "lx2", "ly2")
    return words.join(layouts.groupBy("doc_id", "page_no").agg(F.collect_list(one).alias("boxes")), ["doc_id", "page_no"], "left")


def best_box(boxes: str = "boxes") -> Column:
    """The layout (layout_id, label) of a word: priority first, then the larger share of the word, then order; null without one.

    A page's boxes are a short array in the word's own row, so nothing is joined or grouped by word.
    """
    shared = F.transform(boxes, lambda b: F.struct(b["rank"].alias("rank"), (-G.overlap_ratio(G.box(), (b["lx"], b["ly"], b["lx2"], b["ly2"]))).alias("less"), b["layout_id"].alias("layout_id"), b["label"].alias("label")))
    return F.array_min(F.filter(shared, lambda c: c["less"] < 0))


def assigned_in(words: DataFrame) -> DataFrame:
    """Words with boxes, each with its best layout."""
    # a generator, so that the filters above it do not compute the layout again
    return words.withColumn("best", F.explode(F.array(best_box()))).withColumn("layout_id", F.col("best.layout_id")).withColumn("label", F.col("best.label")).drop("best", "boxes")


def assigned(words: DataFrame, layouts: DataFrame) -> DataFrame:
    """Each word with its best layout of a table of layouts."""
    return assigned_in(with_boxes(words, layouts))


def islands(assigned_words: DataFrame) -> DataFrame:
    """Words with para_seq: a new paragraph where the layout or the XObject changes; other words are set aside."""
    text = assigned_words.where(F.col("label").isin(*sorted(TEXT)))
    changed = ~F.col("layout_id").eqNullSafe(F.lag("layout_id").over(_page())) | ~F.col("xobj_id").eqNullSafe(F.lag("xobj_id").over(_page()))
    return text.withColumn("new", changed.cast("int")).withColumn("para_seq", F.sum("new").over(_page())).drop("new")


def paragraphs(grouped: DataFrame) -> DataFrame:
    """Paragraph text, box and first-line indent from words with para_seq."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "word"))), lambda w: w["word"]), " ")
    return grouped.groupBy("doc_id", "page_no", "para_seq").agg(
        F.first("layout_id").alias("layout_id"), F.first("label").alias("label"), F.count("*").alias("n_words"), text.alias("text"),
        F.min("x").alias("x"), F.min("y").alias("y"), F.max("x2").alias("x2"), F.max("y2").alias("y2"),
        (F.min_by("x", "seq") - F.min("x") > 1).alias("first_line_indent"),
    )


def gap_histogram(words: DataFrame, step: float = 4.0) -> DataFrame:
    """Words covering each scan position of a page: +1 at a box's lower edge, -1 above its upper one, summed up."""
    low, high = F.floor(F.col("y") / step), F.floor(F.col("y2") / step) + 1
    edges = words.select("doc_id", "page_no", F.explode(F.array(F.struct(low.alias("bin"), F.lit(1).alias("d")), F.struct(high.alias("bin"), F.lit(-1).alias("d")))).alias("e")).select("doc_id", "page_no", "e.*")
    bins = edges.groupBy("doc_id", "page_no", "bin").agg(F.sum("d").alias("d"))
    return bins.select("doc_id", "page_no", "bin", F.sum("d").over(Window.partitionBy("doc_id", "page_no").orderBy("bin")).alias("covered"))


def line_widths(words: DataFrame) -> DataFrame:
    """Median line width of each page."""
    lines = words.groupBy("doc_id", "page_no", "row_no").agg((F.max("x2") - F.min("x")).alias("w"))
    return lines.groupBy("doc_id", "page_no").agg(F.median("w").alias("median_width"), F.count("*").alias("n_lines"))


def _gaps(words: DataFrame) -> DataFrame:
    row = Window.partitionBy("doc_id", "page_no", "row_no").orderBy("seq")
    return words.withColumn("gap", F.lead("x").over(row) - F.col("x2"))


def _second(gaps: Column) -> Column:
    return F.coalesce(F.get(gaps, F.least(F.lit(1), F.size(gaps) - 1)), F.lit(1.0))


def second_gap(words: DataFrame) -> DataFrame:
    """The second-smallest distinct gap over 1 between words of a line (the only one, else 1)."""
    sets = _gaps(words).groupBy("doc_id", "page_no", "row_no").agg(F.array_sort(F.collect_set(F.when(F.col("gap") > 1, F.col("gap")))).alias("g"))
    return sets.select("doc_id", "page_no", "row_no", _second(F.col("g")).alias("ref_gap"))


def with_second_gap(words: DataFrame) -> DataFrame:
    """Words with their line's second gap as ref_gap: the two smallest by minima over the line, so nothing is joined."""
    line = Window.partitionBy("doc_id", "page_no", "row_no")
    wide = _gaps(words).withColumn("g_", F.when(F.col("gap") > 1, F.col("gap"))).withColumn("least_", F.min("g_").over(line))
    second = F.min(F.when(F.col("g_") > F.col("least_"), F.col("g_"))).over(line)
    return wide.withColumn("ref_gap", F.coalesce(second, "least_", F.lit(1.0))).drop("gap", "g_", "least_")


def spaced_lines(words: DataFrame, factor: float = 0.45) -> DataFrame:
    """Line texts with a space where the gap exceeds factor of the mean character width."""
    row = Window.partitionBy("doc_id", "page_no", "row_no").orderBy("seq")
    mean = F.avg(F.when(F.col("x2") > F.col("x"), (F.col("x2") - F.col("x")) / F.col("n"))).over(Window.partitionBy("doc_id", "page_no", "row_no"))
    gaps = words.withColumn("sep", F.when(F.lead("x").over(row) - F.col("x2") > factor * mean, " ").otherwise(""))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "word", "sep"))), lambda w: F.concat(w["word"], w["sep"])), "")
    return gaps.groupBy("doc_id", "page_no", "row_no").agg(text.alias("line_text"))


def split_points(words: DataFrame, factor: float = 0.8) -> DataFrame:
    """Lines before which a paragraph splits: after a dotted or a short line, or at a bullet."""
    lines = words.groupBy("doc_id", "page_no", "row_no").agg(
        (F.max("x2") - F.min("x")).alias("w"), F.max(F.col("word").rlike(r"\.{20,}").cast("int")).alias("dots"), F.min_by("word", "seq").alias("first")
    )
    page, order = Window.partitionBy("doc_id", "page_no"), Window.partitionBy("doc_id", "page_no").orderBy("row_no")
    lines = lines.withColumn("m", F.median("w").over(page)).withColumn("pw", F.lag("w").over(order)).withColumn("pd", F.lag("dots").over(order))
    split = (F.col("pd") == 1) | (F.col("pw") < factor * F.col("m")) | F.col("first").rlike("^[•◦·*†‡§-]")
    flag = F.when(F.col("pw").isNull(), 0).otherwise(F.coalesce(split, F.lit(False)).cast("int"))
    return lines.withColumn("s", flag).select("doc_id", "page_no", "row_no", F.sum("s").over(order).alias("part"))


def overlapping_pairs(paras: DataFrame) -> DataFrame:
    """Pairs of paragraphs of a page whose boxes overlap, neither holding the other vertically."""
    a, b = paras.alias("a"), paras.alias("b")
    box = lambda s: tuple(F.col(f"{s}.{c}") for c in ("x", "y", "x2", "y2"))
    on = (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.page_no") == F.col("b.page_no")) & (F.col("a.para_seq") < F.col("b.para_seq"))
    held = (F.col("a.y") >= F.col("b.y")) & (F.col("a.y2") <= F.col("b.y2")) | (F.col("b.y") >= F.col("a.y")) & (F.col("b.y2") <= F.col("a.y2"))
    return a.join(b, on).where(G.overlaps(box("a"), box("b")) & ~held).select("a.doc_id", "a.page_no", F.col("a.para_seq").alias("left_seq"), F.col("b.para_seq").alias("right_seq"))


def free_space(words: DataFrame, width: float = 0.9 * 612) -> DataFrame:
    """Space to the right of each row's end, to the next word that stands in its height, else to width."""
    row = Window.partitionBy("doc_id", "page_no", "row_no").orderBy("seq")
    return words.select("doc_id", "page_no", "seq", (F.coalesce(F.lead("x").over(row), F.greatest(F.col("x2"), F.lit(width))) - F.col("x2")).alias("right_space"))


def gap_below(paras: DataFrame, small: float = 0.5, large: float = 3.0) -> DataFrame:
    """The lower edge that keeps each paragraph clear of those below it within the gap."""
    gap = F.when(F.col("y2") - F.col("y") < 36, small).otherwise(large)
    # the page's boxes are an array beside each paragraph: the words behind them are read once, not for two sides of a join
    boxes = F.collect_list(F.struct("para_seq", "x", "x2", "y2")).over(Window.partitionBy("doc_id", "page_no"))
    near = lambda b: (b["para_seq"] != F.col("para_seq")) & (b["y2"] <= F.col("y2")) & (b["y2"] > F.col("y") - gap) & (F.col("x") < b["x2"]) & (b["x"] < F.col("x2"))
    raised = F.array_max(F.transform(F.filter("boxes_", near), lambda b: b["y2"])) + gap
    return paras.withColumn("boxes_", boxes).select("doc_id", "page_no", "para_seq", F.greatest("y", F.coalesce(raised, "y")).alias("y_clear"))


def trimmed_lines(paragraph_lines: DataFrame) -> DataFrame:
    """Lines without outer spaces; lines of white space only fall."""
    out = paragraph_lines.withColumn("text", F.regexp_replace("text", "^[ \t]+|[ \t]+$", ""))
    return out.where("text <> ''")

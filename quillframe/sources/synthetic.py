"""Positioned words from plain text: a monospace grid of 80 columns and 40 rows a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.functions import arrays as A
from quillframe.functions.labels import rank

COLUMNS, ROWS = 80, 40
TOKEN = r"[A-Za-z]+|[0-9]+|[^ \t\n\rA-Za-z0-9]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokens(text: Column) -> Column:
    """The default token counter: runs of letters, runs of digits, single other signs."""
    return F.regexp_count(text, F.lit(TOKEN)).cast("long")


def words(documents: DataFrame) -> DataFrame:
    """A row for each word with its line, column, virtual row, page, box, font and size.

    Places are running sums over the arrays of a text's own row, so there is no window before
    words exist: one that buffers a long text below another sort of the words in the same task
    gets no memory once that sort has it all.  Texts are dealt by document, words never again.
    """
    dealt = documents.select("doc_id", "text").repartition("doc_id")
    split = F.transform(F.split("text", "\n"), lambda line: F.array_remove(F.split(line, " "), ""))
    # rows of a line: its last word begins at the width of all before it
    rows = lambda ws: F.floor(F.aggregate(F.slice(ws, 1, F.greatest(F.size(ws) - 1, F.lit(0))), F.lit(0).cast("long"), lambda n, w: n + F.length(w) + 1) / COLUMNS) + 1
    placed = lambda ls: F.arrays_zip(ls.alias("ws"), A.running(F.transform(ls, lambda ws: F.size(ws).cast("long"))).alias("seq"), A.running(F.transform(ls, rows)).alias("vrow"), F.concat(F.array(F.lit(None).cast("string")), F.transform(F.slice(ls, 1, F.size(ls) - 1), lambda ws: F.get(ws, F.size(ws) - 1))).alias("before"))
    lines = dealt.select("doc_id", F.posexplode(A.bound(split, placed)).alias("line_no", "l"))
    # a word begins behind a space of the line with single spaces
    spaces = F.transform(F.split(F.array_join("l.ws", " "), ""), lambda ch, i: F.when(ch == " ", i + 1).otherwise(0))
    inner = F.arrays_zip(F.col("l.ws").alias("word"), F.slice(F.concat(F.array(F.lit(0)), F.array_remove(spaces, 0)), 1, F.size("l.ws")).cast("array<long>").alias("col"), F.slice(F.concat(F.array("l.before"), F.col("l.ws")), 1, F.size("l.ws")).alias("before"))
    each = lines.select("doc_id", "line_no", F.col("l.seq").alias("s"), F.col("l.vrow").alias("v"), F.posexplode(inner).alias("word_no", "w"))
    each = each.select("doc_id", "line_no", "word_no", (F.col("s") + F.col("word_no") + 1).cast("int").alias("seq"), "w.word", "w.col", (F.col("v") + F.expr(f"w.col div {COLUMNS}")).alias("vrow"), "w.before")
    font = F.when(F.col("word").rlike("[0-9]"), "f3").when(F.col("word").rlike("^[^a-z]*[A-Z][^a-z]*$") & (F.length("word") > 1), "f2").otherwise("f1")
    return each.select(
        "doc_id",
        "line_no",
        "word_no",
        "seq",
        "word",
        F.length("word").alias("n"),
        F.col("col").cast("long"),
        F.col("vrow").cast("long"),
        F.expr(f"vrow div {ROWS}").alias("page_no"),
        F.expr(f"vrow % {ROWS}").cast("long").alias("row_no"),
        F.expr(f"CAST(36 + 6 * (col % {COLUMNS}) AS DOUBLE)").alias("x"),
        F.expr(f"CAST(506 - 12 * (vrow % {ROWS}) AS DOUBLE)").alias("y"),
        F.expr(f"CAST(36 + 6 * (col % {COLUMNS}) + 6 * length(word) AS DOUBLE)").alias("x2"),
        F.expr(f"CAST(516 - 12 * (vrow % {ROWS}) AS DOUBLE)").alias("y2"),
        (F.col("doc_id") % 3).alias("xobj_id"),
        font.alias("font_id"),
        F.when(F.col("before").rlike("^[0-9]+$"), 7.0).otherwise(10.0).alias("font_size"),
    )


#: The layout bands of every page: label and box; the title band is on page 0 only.
BANDS = (("page_header", 30.0, 504.0, 560.0, 520.0), ("title", 30.0, 504.0, 560.0, 520.0), ("plain text", 30.0, 60.0, 560.0, 506.0), ("footnote", 30.0, 30.0, 560.0, 62.0))


def boxed(words_: DataFrame) -> DataFrame:
    """Words with the layout boxes of their page, as an array: pages carry their layouts as the data model does."""
    page = [F.struct(F.lit(k).alias("layout_id"), F.lit(b[0]).alias("label"), F.lit(rank(b[0])).alias("rank"), *[F.lit(v).alias(c) for c, v in zip(("lx", "ly", "lx2", "ly2"), b[1:], strict=True)]) for k, b in enumerate(BANDS)]
    return words_.withColumn("boxes", F.when(F.col("page_no") == 0, F.array(*page)).otherwise(F.array(*[p for p, b in zip(page, BANDS, strict=True) if b[0] != "title"])))


def layouts(pages: DataFrame) -> DataFrame:
    """The bands of pages (doc_id, page_no) as layout boxes, numbered in order."""
    bands = F.array(*[F.struct(F.lit(k).alias("layout_id"), F.lit(b[0]).alias("label"), *[F.lit(v).alias(c) for c, v in zip(("lx", "ly", "lx2", "ly2"), b[1:], strict=True)]) for k, b in enumerate(BANDS)])
    return pages.select("doc_id", "page_no", F.explode(bands).alias("b")).select("doc_id", "page_no", "b.*").where("label <> 'title' OR page_no = 0")


def paragraphs(documents: DataFrame) -> DataFrame:
    """Non-empty lines as paragraphs: the first line is the title, ten lines a page."""
    lines = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("para_no", "text")).where("text <> ''")
    return lines.select("doc_id", "para_no", "text", F.expr("para_no div 10").alias("page_no"), F.when(F.col("para_no") == 0, "title").otherwise("plain text").alias("label"), tokens(F.col("text")).alias("n_tokens"))

"""Driver queries over order-dependent operators; SQL expresses the one-dimensional clusters only."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillframe.operators import folds as O
from quillframe.operators import styles as Y
from quillframe.plans.layout_queries import WORDS, _paras, _words


def q_lines_split(spark, sf_dir):
    c = O.gap_islands(_words(spark, sf_dir), 2.5)
    return c.groupBy("doc_id", "page_no", "row_no", "cluster").agg(F.count("*").alias("n"), F.min("x").alias("x"), F.max("x2").alias("x2"))


def q_lines_cluster(spark, sf_dir):
    return O.clustered(_words(spark, sf_dir))


def q_formula_merge(spark, sf_dir):
    return O.merged_boxes(_words(spark, sf_dir).where(Y.formula_start(F.col("word"))))


def q_lines_merge(spark, sf_dir):
    return O.merged_boxes(_words(spark, sf_dir)).groupBy("doc_id", "page_no", "group_seq").agg(F.count("*").alias("n"))


def q_fix_overlap(spark, sf_dir):
    return O.separated(_paras(spark, sf_dir).withColumn("y", F.col("y") - 3))


def q_merge_line_numbers(spark, sf_dir):
    return O.number_merged(_paras(spark, sf_dir).withColumn("is_number", F.col("text").rlike("^[0-9 ]*$")))


def q_typeset(spark, sf_dir):
    return O.typeset(_paras(spark, sf_dir))


QUERIES = {k: f for k, f in dict(globals()).items() if k.startswith("q_")}

ORACLE = {
    "q_lines_split": f"""WITH {WORDS}, m AS (SELECT *, avg((x2 - x) / n) OVER (PARTITION BY doc_id, page_no, row_no) AS m, lag(x2) OVER (PARTITION BY doc_id, page_no, row_no ORDER BY x, seq) AS px FROM words),
c AS (SELECT *, (sum(CASE WHEN x - px > 2.5 * m THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_no, row_no ORDER BY x, seq))::BIGINT AS cluster FROM m)
SELECT doc_id, page_no, row_no, cluster, count(*) AS n, min(x) AS x, max(x2) AS x2 FROM c GROUP BY doc_id, page_no, row_no, cluster""",
}

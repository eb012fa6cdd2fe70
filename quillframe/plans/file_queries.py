"""Driver queries over strings, blocks and round trips."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillframe.functions import strings as T
from quillframe.plans.layout_queries import PARAS, _paras
from quillframe.sources import files
from quillframe.sources import synthetic as S


def q_page_labels(spark, sf_dir):
    n = S.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") % 3999 + 1).alias("n"))
    return n.select("l_orderkey", "l_linenumber", T.roman(F.col("n")).alias("roman"), T.alphabetic(F.col("l_linenumber")).alias("label"))


def q_nfkc(spark, sf_dir):
    return S.table(spark, sf_dir, "documents").select("doc_id", T.nfkc("text").alias("text"))


def q_leaders(spark, sf_dir):
    t = S.table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", "the", "." * 25).alias("t"))
    return t.select("doc_id", F.length(T.leaders_collapsed(F.col("t"))).alias("n"), T.safe_message(F.col("t")).alias("message"))


def q_html_blocks(spark, sf_dir):
    return files.html_blocks(S.table(spark, sf_dir, "pages"))


def q_xml_round_trip(spark, sf_dir):
    return files.from_page_xml(files.page_xml(_paras(spark, sf_dir))).select("doc_id", "page_no", "para_seq", "label", F.length("text").alias("n"), "x", "y", "x2", "y2")


def q_event_lines(spark, sf_dir):
    e = S.table(spark, sf_dir, "events").select(F.col("user_id").alias("execution_id"), F.col("event_id").alias("sequence"), F.col("event_type").alias("type"))
    return files.event_lines(e)


def q_numeric_stats(spark, sf_dir):
    li = S.table(spark, sf_dir, "lineitem")
    return li.groupBy("l_linenumber").agg(F.median("l_quantity").alias("median_quantity"), F.count("*").alias("n"), F.max("l_quantity").alias("top"))


QUERIES = {k: f for k, f in dict(globals()).items() if k.startswith("q_")}


def _roman(n: str) -> str:
    def part(unit: int, one: str, five: str, ten: str) -> str:
        forms = ["", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten]
        return "[" + ", ".join(f"'{f}'" for f in forms) + f"][({n} // {unit}) % 10 + 1]"

    return f"repeat('m', {n} // 1000) || {part(100, 'c', 'd', 'm')} || {part(10, 'x', 'l', 'c')} || {part(1, 'i', 'v', 'x')}"


ORACLE = {
    "q_page_labels": f"WITH n AS (SELECT l_orderkey, l_linenumber, l_orderkey % 3999 + 1 AS n FROM lineitem) SELECT l_orderkey, l_linenumber, {_roman('n')} AS roman, repeat(chr((96 + (l_linenumber - 1) % 26 + 1)::INT), (l_linenumber - 1) // 26 + 1) AS label FROM n",
    "q_leaders": "WITH t AS (SELECT doc_id, replace(text, 'the', repeat('.', 25)) AS t FROM documents) SELECT doc_id, length(regexp_replace(t, '[. 。…，]{20,}', '.', 'g'))::INT AS n, CASE WHEN coalesce(split_part(trim(t), chr(10), 1)[1:500], '') = '' THEN 'unknown error' ELSE split_part(trim(t), chr(10), 1)[1:500] END AS message FROM t",
    "q_html_blocks": "WITH b AS (SELECT page_id, regexp_extract_all(html, '<(h1|p|li|td|nav|footer)[ >]', 1) AS t FROM pages), c AS (SELECT page_id, generate_subscripts(t, 1) - 1 AS block_no, unnest(t) AS tag FROM b) SELECT page_id, block_no::INT AS block_no, tag, CASE tag WHEN 'h1' THEN 'title' WHEN 'p' THEN 'text' WHEN 'li' THEN 'list_item' WHEN 'td' THEN 'table_cell' WHEN 'nav' THEN 'page_header' ELSE 'page_footer' END AS label FROM c",
    "q_xml_round_trip": f"WITH {PARAS} SELECT doc_id, page_no, para_seq, label, length(text)::INT AS n, x, y, x2, y2 FROM paras",
    "q_event_lines": """SELECT '{"execution_id":' || user_id || ',"sequence":' || event_id || ',"type":"' || event_type || '"}' AS value FROM events""",
    "q_numeric_stats": "SELECT l_linenumber, median(l_quantity) AS median_quantity, count(*) AS n, max(l_quantity) AS top FROM lineitem GROUP BY 1",
}

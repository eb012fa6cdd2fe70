"""Driver queries over the word grid: layout, paragraphs, lines and spacing, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.operators import layout as L
from quillframe.sources import synthetic as S

#: The word grid in DuckDB SQL.
WORDS = r"""
ln AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents),
wl AS (SELECT doc_id, line_no, list_filter(string_split(line, ' '), lambda x: x <> '') AS ws FROM ln),
we AS (SELECT doc_id, line_no, CASE WHEN len(ws) = 0 THEN [NULL] ELSE ws END AS ws FROM wl),
w0 AS (SELECT doc_id, line_no, generate_subscripts(ws, 1) - 1 AS word_no, unnest(ws) AS word FROM we),
w1 AS (SELECT *, sum(coalesce(length(word) + 1, 0)) OVER (PARTITION BY doc_id, line_no ORDER BY word_no) - coalesce(length(word) + 1, 0) AS col FROM w0),
w2 AS (SELECT *, max(col // 80) OVER (PARTITION BY doc_id, line_no) + 1 AS lrows FROM w1),
w3 AS (SELECT *, sum(CASE WHEN word_no = 0 THEN lrows ELSE 0 END) OVER d - lrows + col // 80 AS vrow, lag(word) OVER d AS before
  FROM w2 WINDOW d AS (PARTITION BY doc_id ORDER BY line_no, word_no)),
words AS (SELECT doc_id, line_no, word_no, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, word_no) AS seq, word, length(word) AS n,
  col::BIGINT AS col, vrow::BIGINT AS vrow, (vrow // 40)::BIGINT AS page_no, (vrow % 40)::BIGINT AS row_no,
  (36 + 6 * (col % 80))::DOUBLE AS x, (506 - 12 * (vrow % 40))::DOUBLE AS y, (36 + 6 * (col % 80) + 6 * length(word))::DOUBLE AS x2,
  (516 - 12 * (vrow % 40))::DOUBLE AS y2, doc_id % 3 AS xobj_id,
  CASE WHEN regexp_matches(word, '[0-9]') THEN 'f3' WHEN regexp_matches(word, '^[^a-z]*[A-Z][^a-z]*$') AND length(word) > 1 THEN 'f2' ELSE 'f1' END AS font_id,
  CASE WHEN regexp_matches(before, '^[0-9]+$') THEN 7.0 ELSE 10.0 END::DOUBLE AS font_size
  FROM w3 WHERE word IS NOT NULL)"""
ASSIGNED = (
    WORDS
    + """,
best AS (SELECT doc_id, seq, least(x2, 560.0) > greatest(x, 30.0) AS wide, least(y2, 520.0) > greatest(y, 504.0) AS head, least(y2, 506.0) > greatest(y, 60.0) AS body,
  least(y2, 62.0) > greatest(y, 30.0) AS foot, page_no FROM words),
named AS (SELECT doc_id, seq, CASE WHEN NOT wide THEN NULL WHEN head AND page_no = 0 THEN 1 WHEN foot THEN 3 WHEN body THEN 2 WHEN head THEN 0 END AS layout_id FROM best),
assigned AS (SELECT w.*, n.layout_id, CASE n.layout_id WHEN 0 THEN 'page_header' WHEN 1 THEN 'title' WHEN 2 THEN 'plain text' WHEN 3 THEN 'footnote' END AS label
  FROM words w JOIN named n USING (doc_id, seq))"""
)
PARAS = (
    ASSIGNED
    + """,
flags AS (SELECT *, CASE WHEN layout_id IS DISTINCT FROM lag(layout_id) OVER p OR xobj_id IS DISTINCT FROM lag(xobj_id) OVER p THEN 1 ELSE 0 END AS f
  FROM assigned WHERE label IS NOT NULL WINDOW p AS (PARTITION BY doc_id, page_no ORDER BY seq)),
grouped AS (SELECT *, sum(f) OVER (PARTITION BY doc_id, page_no ORDER BY seq)::BIGINT AS para_seq FROM flags),
paras AS (SELECT doc_id, page_no, para_seq, any_value(layout_id) AS layout_id, any_value(label) AS label, count(*) AS n_words,
  string_agg(word, ' ' ORDER BY seq) AS text, min(x) AS x, min(y) AS y, max(x2) AS x2, max(y2) AS y2, arg_min(x, seq) - min(x) > 1 AS first_line_indent
  FROM grouped GROUP BY ALL)"""
)


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.words(S.table(spark, sf_dir, "documents"))


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.assigned_in(S.boxed(_words(spark, sf_dir)))


def _paras(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.paragraphs(L.islands(_assigned(spark, sf_dir)))


def q_word_grid(spark, sf_dir):
    return _words(spark, sf_dir).select("doc_id", "seq", "word", "page_no", "x", "y", "x2", "y2", "font_id", "font_size", "xobj_id")


def q_page_summary(spark, sf_dir):
    return _words(spark, sf_dir).groupBy("doc_id", "page_no").agg(
        F.count("*").alias("n_words"), F.min("x").alias("x"), F.min("y").alias("y"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.sum("n").alias("n_chars"), F.countDistinct("font_id").alias("n_fonts")
    )


def q_layout_assign(spark, sf_dir):
    return _assigned(spark, sf_dir).select("doc_id", "seq", "layout_id", "label")


def q_paragraphs(spark, sf_dir):
    return _paras(spark, sf_dir).drop("layout_id")


def q_lines_gap_scan(spark, sf_dir):
    return L.gap_histogram(_words(spark, sf_dir))


def q_median_width(spark, sf_dir):
    return L.line_widths(_words(spark, sf_dir))


def q_second_gap_spaces(spark, sf_dir):
    return L.second_gap(_words(spark, sf_dir))


def q_spaced_lines(spark, sf_dir):
    return L.spaced_lines(_words(spark, sf_dir))


def q_split_short_toc(spark, sf_dir):
    return L.split_points(_words(spark, sf_dir))


def q_box_overlap_pairs(spark, sf_dir):
    return L.overlapping_pairs(_paras(spark, sf_dir))


def q_gap_below(spark, sf_dir):
    return L.gap_below(_paras(spark, sf_dir))


def q_space_right(spark, sf_dir):
    return L.free_space(_words(spark, sf_dir))


def q_trim_lines(spark, sf_dir):
    lines = S.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    return L.trimmed_lines(lines)


QUERIES = {f.__name__: f for f in (q_paragraphs, q_word_grid, q_page_summary, q_layout_assign, q_lines_gap_scan, q_median_width, q_second_gap_spaces, q_spaced_lines, q_split_short_toc, q_box_overlap_pairs, q_gap_below, q_space_right, q_trim_lines)}

ORACLE = {
    "q_word_grid": f"WITH {WORDS} SELECT doc_id, seq, word, page_no, x, y, x2, y2, font_id, font_size, xobj_id FROM words",
    "q_page_summary": f"WITH {WORDS} SELECT doc_id, page_no, count(*) AS n_words, min(x) AS x, min(y) AS y, max(x2) AS x2, max(y2) AS y2, sum(n)::BIGINT AS n_chars, count(DISTINCT font_id) AS n_fonts FROM words GROUP BY ALL",
    "q_layout_assign": f"WITH {ASSIGNED} SELECT doc_id, seq, layout_id, label FROM assigned",
    "q_paragraphs": f"WITH {PARAS} SELECT * EXCLUDE (layout_id) FROM paras",
    "q_lines_gap_scan": f"""WITH {WORDS}, e AS (SELECT doc_id, page_no, floor(y / 4)::BIGINT AS bin, 1 AS d FROM words UNION ALL SELECT doc_id, page_no, floor(y2 / 4)::BIGINT + 1, -1 FROM words),
b AS (SELECT doc_id, page_no, bin, sum(d) AS d FROM e GROUP BY ALL) SELECT doc_id, page_no, bin, (sum(d) OVER (PARTITION BY doc_id, page_no ORDER BY bin))::BIGINT AS covered FROM b""",
    "q_median_width": f"WITH {WORDS}, l AS (SELECT doc_id, page_no, row_no, max(x2) - min(x) AS w FROM words GROUP BY ALL) SELECT doc_id, page_no, median(w) AS median_width, count(*) AS n_lines FROM l GROUP BY ALL",
    "q_second_gap_spaces": f"""WITH {WORDS}, g AS (SELECT *, lead(x) OVER (PARTITION BY doc_id, page_no, row_no ORDER BY seq) - x2 AS gap FROM words),
s AS (SELECT doc_id, page_no, row_no, list_sort(list(DISTINCT gap) FILTER (gap > 1)) AS gs FROM g GROUP BY ALL)
SELECT doc_id, page_no, row_no, CASE WHEN coalesce(len(gs), 0) = 0 THEN 1.0 ELSE gs[least(2, len(gs))] END::DOUBLE AS ref_gap FROM s""",
    "q_spaced_lines": f"""WITH {WORDS}, g AS (SELECT *, avg(CASE WHEN x2 > x THEN (x2 - x) / n END) OVER (PARTITION BY doc_id, page_no, row_no) AS m,
lead(x) OVER (PARTITION BY doc_id, page_no, row_no ORDER BY seq) - x2 AS gap FROM words)
SELECT doc_id, page_no, row_no, string_agg(word || CASE WHEN gap > 0.45 * m THEN ' ' ELSE '' END, '' ORDER BY seq) AS line_text FROM g GROUP BY ALL""",
    "q_split_short_toc": f"""WITH {WORDS}, l AS (SELECT doc_id, page_no, row_no, max(x2) - min(x) AS w, max(regexp_matches(word, '\\.{{20,}}')::INT) AS dots, arg_min(word, seq) AS first FROM words GROUP BY ALL),
f AS (SELECT *, median(w) OVER (PARTITION BY doc_id, page_no) AS m, lag(w) OVER o AS pw, lag(dots) OVER o AS pd FROM l WINDOW o AS (PARTITION BY doc_id, page_no ORDER BY row_no)),
s AS (SELECT *, CASE WHEN pw IS NULL THEN 0 WHEN pd = 1 OR pw < 0.8 * m OR regexp_matches(first, '^[•◦·*†‡§-]') THEN 1 ELSE 0 END AS s FROM f)
SELECT doc_id, page_no, row_no, (sum(s) OVER (PARTITION BY doc_id, page_no ORDER BY row_no))::BIGINT AS part FROM s""",
    "q_box_overlap_pairs": f"""WITH {PARAS} SELECT a.doc_id, a.page_no, a.para_seq AS left_seq, b.para_seq AS right_seq FROM paras a JOIN paras b ON a.doc_id = b.doc_id AND a.page_no = b.page_no AND a.para_seq < b.para_seq
WHERE a.x < b.x2 AND b.x < a.x2 AND a.y < b.y2 AND b.y < a.y2 AND NOT (a.y >= b.y AND a.y2 <= b.y2 OR b.y >= a.y AND b.y2 <= a.y2)""",
    "q_gap_below": f"""WITH {PARAS}, g AS (SELECT *, CASE WHEN y2 - y < 36 THEN 0.5 ELSE 3.0 END AS gap FROM paras),
r AS (SELECT a.doc_id, a.page_no, a.para_seq, a.y, max(b.y2 + a.gap) AS raised FROM g a LEFT JOIN paras b ON a.doc_id = b.doc_id AND a.page_no = b.page_no AND a.para_seq <> b.para_seq
AND b.y2 <= a.y2 AND b.y2 > a.y - a.gap AND a.x < b.x2 AND b.x < a.x2 GROUP BY ALL) SELECT doc_id, page_no, para_seq, greatest(y, coalesce(raised, y))::DOUBLE AS y_clear FROM r""",
    "q_space_right": f"""WITH {WORDS} SELECT doc_id, page_no, seq, (coalesce(lead(x) OVER (PARTITION BY doc_id, page_no, row_no ORDER BY seq), greatest(x2, 0.9 * 612)) - x2)::DOUBLE AS right_space FROM words""",
    "q_trim_lines": r"""WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no, unnest(string_split(text, chr(10))) AS t FROM documents),
t AS (SELECT doc_id, line_no, regexp_replace(t, '^[ \t]+|[ \t]+$', '', 'g') AS text FROM l) SELECT * FROM t WHERE text <> ''""",
}

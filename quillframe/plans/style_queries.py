"""Driver queries over formulas, styles and elements of the word grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillframe.operators import layout as L
from quillframe.operators import styles as Y
from quillframe.plans.layout_queries import ASSIGNED, PARAS, WORDS, _assigned, _paras, _words


def q_formula_chars(spark, sf_dir):
    w = _words(spark, sf_dir)
    return w.select("doc_id", "seq", Y.formula_start(F.col("word")).alias("starts"), Y.formula_middle(F.col("word")).alias("goes_on"))


def q_formula_font(spark, sf_dir):
    name = F.concat(F.when(F.col("font_id") == "f1", "ABCDEF+").otherwise(""), F.element_at(F.array(F.lit("CMMI10"), F.lit("TimesMath"), F.lit("CambriaMath"), F.lit("Arial")), (F.col("seq") % 4 + 1).cast("int")))
    return _words(spark, sf_dir).select("doc_id", "seq", name.alias("font")).select("doc_id", "seq", Y.formula_font(F.col("font")).alias("is_formula"))


def q_font_override(spark, sf_dir):
    w = _words(spark, sf_dir)
    page = w.groupBy("doc_id", "page_no", "font_id").agg(F.max("font_size").alias("page_size"))
    own = w.where("xobj_id = 1").groupBy("doc_id", "page_no", "font_id").agg(F.min("font_size").alias("own_size"))
    return page.join(own, ["doc_id", "page_no", "font_id"], "left").select("doc_id", "page_no", "font_id", F.coalesce("own_size", "page_size").alias("size"))


def q_style_runs(spark, sf_dir):
    r = Y.runs(_words(spark, sf_dir), ["doc_id", "page_no"], "seq", "font_id", "font_size")
    return r.groupBy("doc_id", "page_no", "run").agg(F.min("seq").alias("first_seq"), F.count("*").alias("n"), F.first("font_id").alias("font_id"))


def q_base_style(spark, sf_dir):
    return Y.base_style(_words(spark, sf_dir))


def q_comma_split(spark, sf_dir):
    w = _words(spark, sf_dir).where("word LIKE '%,%' OR word LIKE '%(%'")
    chars = w.select(F.concat_ws("-", "doc_id", "seq").alias("key"), F.posexplode(F.split("word", "")).alias("pos", "c")).where("c <> ''").select("key", F.col("pos").alias("seq"), "c")
    return Y.comma_groups(chars)


def q_corner_marks(spark, sf_dir):
    return Y.corner_marks(_words(spark, sf_dir)).where("corner")


def q_neighbour_offsets(spark, sf_dir):
    return Y.neighbour_offsets(_words(spark, sf_dir).withColumn("is_formula", Y.formula_start(F.col("word"))))


def _elements(spark, sf_dir):
    w = _words(spark, sf_dir)
    return w.select("doc_id", "page_no", F.col("seq").alias("element_id"), F.col("xobj_id").alias("e_xobj"), (F.col("x") + F.col("n") % 5 - 2).alias("ex"), F.col("y").alias("ey"), (F.col("x2") + F.col("n") % 3 - 2).alias("ex2"), F.col("y2").alias("ey2"))


def _formulas(spark, sf_dir):
    w = _words(spark, sf_dir)
    return w.select("doc_id", "page_no", F.col("seq").alias("formula_id"), F.when(F.col("seq") % 2 == 0, F.col("xobj_id")).alias("f_xobj"), F.col("x").alias("fx"), F.col("y").alias("fy"), F.col("x2").alias("fx2"), F.col("y2").alias("fy2"))


def q_element_candidates(spark, sf_dir):
    return Y.element_candidates(_elements(spark, sf_dir), _formulas(spark, sf_dir)).withColumn("score", F.round("score", 6))


def q_element_assign(spark, sf_dir):
    return Y.assigned_elements(Y.element_candidates(_elements(spark, sf_dir), _formulas(spark, sf_dir)).withColumn("score", F.round("score", 6)))


def q_remove_lines(spark, sf_dir):
    figures = _words(spark, sf_dir).where("n > 12").select("doc_id", "page_no", "x", "y", "x2", "y2")
    curves = _elements(spark, sf_dir).select("doc_id", "page_no", "element_id", "ex", "ey", "ex2", "ey2")
    return Y.kept_lines(curves, figures, _paras(spark, sf_dir)).select("doc_id", "element_id")


def q_placeholder_only(spark, sf_dir):
    g = L.islands(_assigned(spark, sf_dir))
    return g.groupBy("doc_id", "page_no", "para_seq").agg(F.every(Y.formula_start(F.col("word"))).alias("placeholder_only"))


def q_line_merge(spark, sf_dir):
    p = _paras(spark, sf_dir)
    r = Y.runs(p.withColumn("digits", F.col("text").rlike("^[0-9 ]*$")), ["doc_id", "page_no"], "para_seq", "label", "digits")
    return r.groupBy("doc_id", "page_no", "run").agg(F.min("para_seq").alias("first_para"), F.sum("n_words").alias("n_words"))


QUERIES = {k: f for k, f in dict(globals()).items() if k.startswith("q_")}

_START = r"(contains(word, '(cid:') OR (word <> ' ' AND regexp_matches(word[1:1], '^[\p{Mn}\p{Sk}\p{Sm}\p{Zl}\p{Zp}\p{Zs}\p{Co}Ͱ-Ͽ0-9\[\]•]')))"
_CAND = """
e AS (SELECT doc_id, page_no, row_no, seq AS element_id, xobj_id AS e_xobj, x + n % 5 - 2 AS ex, y AS ey, x2 + n % 3 - 2 AS ex2, y2 AS ey2 FROM words),
f AS (SELECT doc_id, page_no, row_no, seq AS formula_id, CASE WHEN seq % 2 = 0 THEN xobj_id END AS f_xobj, x AS fx, y AS fy, x2 AS fx2, y2 AS fy2 FROM words),
j AS (SELECT doc_id, page_no, element_id, formula_id,
  greatest(0, least(ex2, fx2) - greatest(ex, fx)) * greatest(0, least(ey2, fy2) - greatest(ey, fy)) / ((ex2 - ex) * (ey2 - ey)) AS share,
  greatest(0, least(ex2, fx2 + 2) - greatest(ex, fx - 2)) * greatest(0, least(ey2, fy2 + 2) - greatest(ey, fy - 2)) / ((ex2 - ex) * (ey2 - ey)) AS loose,
  0.5 + 0.4 * greatest(0, 1 - sqrt(power(greatest(0, fx - ex2, ex - fx2), 2) + power(greatest(0, fy - ey2, ey - fy2), 2)) / 100) AS near
  FROM e JOIN f USING (doc_id, page_no, row_no) WHERE (f_xobj IS NULL OR f_xobj = e_xobj) AND (fx - 2 <= ex2 AND ex <= fx2 + 2)),
c AS (SELECT doc_id, page_no, element_id, formula_id, share >= 0.95 AS exact, round(CASE WHEN share >= 0.95 THEN share ELSE near END, 6)::DOUBLE AS score FROM j WHERE share >= 0.95 OR loose >= 0.95)"""

ORACLE = {
    "q_formula_chars": f"WITH {WORDS} SELECT doc_id, seq, {_START} AS starts, {_START} OR word LIKE ',%' AS goes_on FROM words",
    "q_formula_font": f"""WITH {WORDS}, n AS (SELECT doc_id, seq, CASE seq % 4 WHEN 0 THEN 'CMMI10' WHEN 1 THEN 'TimesMath' WHEN 2 THEN 'CambriaMath' ELSE 'Arial' END AS f FROM words)
SELECT doc_id, seq, CASE WHEN f LIKE 'CMMI%' THEN true WHEN regexp_matches(f, '(Roman|Times|Arial|Helvetica)') THEN false ELSE regexp_matches(f, '(Math|Symb|Cambria)') END AS is_formula FROM n""",
    "q_font_override": f"""WITH {WORDS} SELECT doc_id, page_no, font_id, coalesce(min(font_size) FILTER (xobj_id = 1), max(font_size)) AS size FROM words GROUP BY ALL""",
    "q_style_runs": f"""WITH {WORDS}, f AS (SELECT *, CASE WHEN row_number() OVER p = 1 THEN 0 WHEN font_id IS DISTINCT FROM lag(font_id) OVER p OR font_size IS DISTINCT FROM lag(font_size) OVER p THEN 1 ELSE 0 END AS f FROM words WINDOW p AS (PARTITION BY doc_id, page_no ORDER BY seq)),
r AS (SELECT *, (sum(f) OVER (PARTITION BY doc_id, page_no ORDER BY seq))::BIGINT AS run FROM f) SELECT doc_id, page_no, run, min(seq) AS first_seq, count(*) AS n, any_value(font_id) AS font_id FROM r GROUP BY doc_id, page_no, run""",
    "q_base_style": f"""WITH {WORDS}, a AS (SELECT doc_id, page_no, font_id, count(*) AS n, min(seq) AS s FROM words GROUP BY ALL), b AS (SELECT doc_id, page_no, font_size, count(*) AS n, min(seq) AS s FROM words GROUP BY ALL),
x AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY n DESC, s) AS r, count(*) OVER (PARTITION BY doc_id, page_no) AS k FROM a), y AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY n DESC, s) AS r, count(*) OVER (PARTITION BY doc_id, page_no) AS k FROM b)
SELECT x.doc_id, x.page_no, font_id, x.k AS font_id_kinds, font_size, y.k AS font_size_kinds FROM x JOIN y ON x.doc_id = y.doc_id AND x.page_no = y.page_no AND x.r = 1 AND y.r = 1""",
    "q_comma_split": f"""WITH {WORDS}, w AS (SELECT doc_id || '-' || seq AS key, word FROM words WHERE word LIKE '%,%' OR word LIKE '%(%'),
c AS (SELECT key, generate_subscripts(string_split(word, ''), 1) - 1 AS seq, unnest(string_split(word, '')) AS c FROM w),
d AS (SELECT *, sum(CASE WHEN c IN ('(', '[', '{{') THEN 1 WHEN c IN (')', ']', '}}') THEN -1 ELSE 0 END) OVER (PARTITION BY key ORDER BY seq) AS s FROM c),
e AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY key ORDER BY seq)) AS depth FROM d),
g AS (SELECT *, CASE WHEN c = ',' AND depth = 0 THEN 1 ELSE 0 END AS cut FROM e),
h AS (SELECT *, (sum(cut) OVER (PARTITION BY key ORDER BY seq))::BIGINT AS part FROM g) SELECT key, seq::INT AS seq, c, part FROM h WHERE cut = 0""",
    "q_corner_marks": f"""WITH RECURSIVE {WORDS}, i AS (SELECT doc_id, line_no, seq, font_size, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY seq) AS i FROM words),
l AS (SELECT doc_id, line_no, list(struct_pack(seq := seq, size := font_size) ORDER BY i) AS w FROM i GROUP BY ALL HAVING max(font_size) > min(font_size)),
c AS (SELECT doc_id, line_no, w, 1 AS i, w[1].seq AS seq, w[1].size AS size, false AS corner FROM l
UNION ALL SELECT doc_id, line_no, w, i + 1, w[i + 1].seq, w[i + 1].size, w[i + 1].size < 0.79 * size OR (corner AND w[i + 1].size < 1.1 * size) FROM c WHERE i < len(w))
SELECT doc_id, line_no, seq, corner FROM c WHERE corner""",
    "q_neighbour_offsets": f"""WITH {WORDS}, i AS (SELECT *, {_START} AS is_formula FROM words),
g AS (SELECT *, x - last_value(CASE WHEN NOT is_formula THEN x2 END IGNORE NULLS) OVER (PARTITION BY doc_id, page_no, row_no ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap FROM i)
SELECT doc_id, seq, coalesce(CASE WHEN abs(gap) < 0.1 THEN 0 WHEN gap > 10 THEN 0 WHEN gap < -5 THEN 0 ELSE gap END, 0)::DOUBLE AS x_offset FROM g WHERE is_formula""",
    "q_element_candidates": f"WITH {WORDS}, {_CAND} SELECT * FROM c",
    "q_element_assign": f"WITH {WORDS}, {_CAND}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no, element_id ORDER BY exact DESC, score DESC, formula_id) AS r FROM c) SELECT doc_id, page_no, element_id, formula_id FROM r WHERE r = 1",
    "q_remove_lines": f"""WITH {PARAS}, e AS (SELECT doc_id, page_no, row_no, seq AS element_id, x + n % 5 - 2 AS ex, y AS ey, x2 + n % 3 - 2 AS ex2, y2 AS ey2, row_no FROM words), g AS (SELECT * FROM words WHERE n > 12)
SELECT doc_id, element_id FROM e WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.doc_id = e.doc_id AND g.page_no = e.page_no AND g.row_no = e.row_no AND greatest(0, least(ex2, x2) - greatest(ex, x)) * greatest(0, least(ey2, y2) - greatest(ey, y)) / ((ex2 - ex) * (ey2 - ey)) > 0.9)
AND EXISTS (SELECT 1 FROM paras p WHERE p.doc_id = e.doc_id AND p.page_no = e.page_no AND greatest(0, least(ex2, x2) - greatest(ex, x)) * greatest(0, least(ey2, y2) - greatest(ey, y)) / ((ex2 - ex) * (ey2 - ey)) > 0.9)""",
    "q_placeholder_only": f"WITH {PARAS} SELECT doc_id, page_no, para_seq, bool_and({_START}) AS placeholder_only FROM grouped GROUP BY ALL",
    "q_line_merge": f"""WITH {PARAS}, d AS (SELECT *, regexp_matches(text, '^[0-9 ]*$') AS digits FROM paras),
f AS (SELECT *, CASE WHEN row_number() OVER p = 1 THEN 0 WHEN label IS DISTINCT FROM lag(label) OVER p OR digits IS DISTINCT FROM lag(digits) OVER p THEN 1 ELSE 0 END AS f FROM d WINDOW p AS (PARTITION BY doc_id, page_no ORDER BY para_seq)),
r AS (SELECT *, (sum(f) OVER (PARTITION BY doc_id, page_no ORDER BY para_seq))::BIGINT AS run FROM f) SELECT doc_id, page_no, run, min(para_seq) AS first_para, sum(n_words)::BIGINT AS n_words FROM r GROUP BY doc_id, page_no, run""",
}

"""Driver queries over characters of the word grid, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillframe.functions import geometry as G
from quillframe.operators import glyphs as C
from quillframe.operators import layout as L
from quillframe.operators import styles as Y
from quillframe.plans.layout_queries import PARAS, WORDS, _assigned, _words
from quillframe.sources import synthetic as S

#: Advances of the synthetic font.
_ADVANCE = "CASE WHEN ch IN ('i', 'j', 'l', '.', ',') THEN 3.0D WHEN ch IN ('m', 'w') THEN 9.0D ELSE 6.0D END"


def _glyphs(spark, sf_dir):
    runs = _words(spark, sf_dir).select("doc_id", "page_no", "seq", "word", "x", "y", "font_size", "font_id")
    return C.glyphs(runs, lambda ch: F.when(ch.isin("i", "j", "l", ".", ","), 3.0).when(ch.isin("m", "w"), 9.0).otherwise(6.0))


def q_glyphs(spark, sf_dir):
    return _glyphs(spark, sf_dir).select("doc_id", "seq", "i", "ch", "x0", "advance")


def _matrix():
    """Every fourth run stands upright at 90 degrees, every fourth is slanted."""
    kind = F.col("seq") % 4
    a, b = F.when(kind == 1, 0.0).when(kind == 2, 0.5).otherwise(1.0), F.when(kind == 1, 1.0).when(kind == 2, 0.5).otherwise(0.0)
    return [a, b, -b, a, F.col("x0"), F.col("y")]


def q_glyph_boxes(spark, sf_dir):
    m = _matrix()
    box = C.placed(F.col("advance"), F.lit(-2.0), F.col("font_size") - 2, m)
    upright = C.is_upright(m[0], m[1])
    return _glyphs(spark, sf_dir).where(upright).select("doc_id", "seq", "i", C.is_vertical(m[0], m[3]).alias("vertical"), *[c.alias(n) for c, n in zip(box, ("x", "y", "x2", "y2"), strict=True)])


def q_visual_boxes(spark, sf_dir):
    glyph = tuple(F.when(F.col("seq") % 5 == 0, F.col(c) + d) for c, d in (("x", 1.0), ("y", 1.0), ("x2", -1.0), ("y2", -1.0)))
    descent = F.when(F.col("font_id") == "f1", -200.0).when(F.col("font_id") == "f2", -150.0).otherwise(0.0)
    box = C.visual_box(G.box(), descent, F.col("font_size"), F.col("seq") % 3 == 0, glyph)
    return _words(spark, sf_dir).select("doc_id", "seq", *[c.alias(n) for c, n in zip(box, ("vx", "vy", "vx2", "vy2"), strict=True)])


def q_valid_chars(spark, sf_dir):
    ch = F.when(F.col("i") % 11 == 3, "\u0007").when(F.col("i") % 13 == 4, " ").when(F.col("i") % 17 == 5, "(cid:9)").otherwise(F.col("ch"))
    g = _glyphs(spark, sf_dir).withColumn("c", ch)
    why = C.reject_reason(F.col("c"), F.when(F.col("seq") % 19 == 0, 0.0).otherwise(F.col("font_size")), F.col("font_id") != "f3", F.col("i") + 100)
    return g.select("doc_id", why.alias("why"), C.one_space(F.col("c")).alias("c")).groupBy("doc_id", "why").agg(F.count("*").alias("n"), F.count_if(F.col("c") == " ").alias("n_spaces"))


def q_char_area(spark, sf_dir):
    w = _words(spark, sf_dir).withColumn("x2", F.when(F.col("seq") % 50 == 0, F.col("x") + 0.5).otherwise(F.col("x2")))
    return C.tiny(w)


def q_descent(spark, sf_dir):
    w = _words(spark, sf_dir).withColumn("descent", F.when(F.col("font_id") == "f1", -2.0).when(F.col("font_id") == "f2", -1.5).otherwise(0.0))
    mode = C.modal(w, ["doc_id", "page_no"], "descent", "seq")
    box = w.groupBy("doc_id", "page_no").agg(F.min("y").alias("y"), F.max("y2").alias("y2"))
    return box.join(mode, ["doc_id", "page_no"]).select("doc_id", "page_no", "descent", (F.col("y") - F.col("descent")).alias("y"), (F.col("y2") - F.col("descent")).alias("y2"))


def q_formula_boxes(spark, sf_dir):
    w = _words(spark, sf_dir).withColumn("f", Y.formula_start(F.col("word")))
    runs = Y.runs(w, ["doc_id", "page_no", "row_no"], "seq", "f").where("f")
    items = runs.withColumn("formula", F.struct("row_no", "run")).withColumn("steady", F.col("n") > 1).withColumn("y2", F.when(F.col("n") == 1, F.col("y2") + 7).otherwise(F.col("y2")))
    return C.formula_boxes(items).drop("formula")


#: Formula layouts of every page: id and box.
_FORMULAS = ((0, 100.0, 300.0, 220.0, 420.0), (1, 150.0, 250.0, 400.0, 330.0), (2, 520.0, 20.0, 640.0, 90.0))


def _formula_array():
    return F.array(*[F.struct(F.lit(k).alias("layout_id"), *[F.lit(v).alias(c) for c, v in zip(("x", "y", "x2", "y2"), b, strict=True)]) for k, *b in _FORMULAS])


def q_formula_layout(spark, sf_dir):
    w = _words(spark, sf_dir).withColumn("formula_boxes", _formula_array())
    return w.select("doc_id", "seq", C.formula_layout().alias("formula_layout_id"))


def q_isolated_formulas(spark, sf_dir):
    pages = _words(spark, sf_dir).groupBy("doc_id", "page_no").agg(F.max("row_no").alias("rows"))
    formulas = pages.select("doc_id", "page_no", F.explode(_formula_array()).alias("f"), F.lit("formula").alias("label")).select("doc_id", "page_no", "f.*", "label")
    texts = pages.select("doc_id", "page_no", F.lit(36.0).alias("x"), (F.lit(506.0) - 12 * F.col("rows")).alias("y"), F.lit(516.0).alias("x2"), F.lit(516.0).alias("y2"))
    return C.isolated_formulas(formulas, texts).select("doc_id", "page_no", "layout_id", "label")


def q_newlines(spark, sf_dir):
    page = Window.partitionBy("doc_id", "page_no").orderBy("seq")
    before = tuple(F.lag(c).over(page) for c in ("x", "y", "x2", "y2"))
    return _words(spark, sf_dir).select("doc_id", "seq", C.is_newline(before, G.box()).alias("newline"))


def q_space_chars(spark, sf_dir):
    w = _words(spark, sf_dir)
    return C.spaces(w, L.second_gap(w)).select("doc_id", "seq", "x", "x2")


def q_text_join(spark, sf_dir):
    return C.joined_text(L.islands(L.assigned_in(S.boxed(L.with_second_gap(_words(spark, sf_dir))))))


def q_paragraph_lines(spark, sf_dir):
    return C.lines_of(C.y_lines(L.islands(_assigned(spark, sf_dir))), "para_seq", "line_idx")


def q_box_predicates(spark, sf_dir):
    page = Window.partitionBy("doc_id", "page_no").orderBy("seq")
    a, b = G.box(), tuple(F.lead(c).over(page) for c in ("x", "y", "x2", "y2"))
    p = _words(spark, sf_dir).select("doc_id", "seq", G.overlaps(a, b).alias("overlap"), G.holds_vertically(a, b).alias("vertical"), G.holds_in_x(a, b).alias("in_x"), G.meets_in_y(a, b).alias("in_y"), G.beside_in_x(a, b).alias("beside"), G.y_iou(a, b).alias("y_iou"), G.y_overlap_of_lower(a, b).alias("y_lower"))
    return p.where("in_y IS NOT NULL")


QUERIES = {k: f for k, f in dict(globals()).items() if k.startswith("q_")}

_GLYPHS = WORDS + f""",
g0 AS (SELECT doc_id, page_no, seq, x, y, font_size, font_id, string_split(word, '') AS cs FROM words),
g1 AS (SELECT doc_id, page_no, seq, x, y, font_size, font_id, generate_subscripts(cs, 1) - 1 AS i, unnest(cs) AS ch FROM g0),
g2 AS (SELECT *, {_ADVANCE.replace("0D", "0")} AS advance FROM g1),
glyphs AS (SELECT doc_id, page_no, seq, i::INT AS i, ch, y, font_size, font_id, advance::DOUBLE AS advance, (x + sum(advance) OVER (PARTITION BY doc_id, seq ORDER BY i) - advance)::DOUBLE AS x0 FROM g2)"""
_START = r"(contains(word, '(cid:') OR (word <> ' ' AND regexp_matches(word[1:1], '^[\p{Mn}\p{Sk}\p{Sm}\p{Zl}\p{Zp}\p{Zs}\p{Co}Ͱ-Ͽ0-9\[\]•]')))"
_GAPS = """
gp AS (SELECT *, lead(x) OVER (PARTITION BY doc_id, page_no, row_no ORDER BY seq) - x2 AS gap FROM words),
gs AS (SELECT doc_id, page_no, row_no, list_sort(list(DISTINCT gap) FILTER (gap > 1)) AS gs FROM gp GROUP BY ALL),
refs AS (SELECT doc_id, page_no, row_no, CASE WHEN coalesce(len(gs), 0) = 0 THEN 1.0 ELSE gs[least(2, len(gs))] END::DOUBLE AS ref_gap FROM gs)"""
_BOXES = "(VALUES (0, 100.0, 300.0, 220.0, 420.0), (1, 150.0, 250.0, 400.0, 330.0), (2, 520.0, 20.0, 640.0, 90.0)) f(layout_id, fx, fy, fx2, fy2)"

ORACLE = {
    "q_glyphs": f"WITH {_GLYPHS} SELECT doc_id, seq, i, ch, x0, advance FROM glyphs",
    "q_glyph_boxes": f"""WITH {_GLYPHS}, m AS (SELECT *, CASE seq % 4 WHEN 1 THEN 0.0 WHEN 2 THEN 0.5 ELSE 1.0 END AS a, CASE seq % 4 WHEN 1 THEN 1.0 WHEN 2 THEN 0.5 ELSE 0.0 END AS b FROM glyphs),
c AS (SELECT *, x0 - b * -2 AS px, y + a * -2 AS py, x0 + a * advance - b * (font_size - 2) AS qx, y + b * advance + a * (font_size - 2) AS qy FROM m WHERE seq % 4 <> 2)
SELECT doc_id, seq, i, a = 0 AS vertical, least(px, qx)::DOUBLE AS x, least(py, qy)::DOUBLE AS y, greatest(px, qx)::DOUBLE AS x2, greatest(py, qy)::DOUBLE AS y2 FROM c""",
    "q_visual_boxes": f"""WITH {WORDS}, d AS (SELECT *, CASE font_id WHEN 'f1' THEN -200.0 WHEN 'f2' THEN -150.0 ELSE 0.0 END * font_size / 1000 AS d, seq % 5 = 0 AND (x2 - x - 2) * (y2 - y - 2) > 1 AS g FROM words)
SELECT doc_id, seq, (CASE WHEN g THEN x + 1 WHEN seq % 3 = 0 THEN x + d ELSE x END)::DOUBLE AS vx, (CASE WHEN g THEN y + 1 WHEN seq % 3 = 0 THEN y ELSE y + d END)::DOUBLE AS vy,
(CASE WHEN g THEN x2 - 1 WHEN seq % 3 = 0 THEN x2 + d ELSE x2 END)::DOUBLE AS vx2, (CASE WHEN g THEN y2 - 1 WHEN seq % 3 = 0 THEN y2 ELSE y2 + d END)::DOUBLE AS vy2 FROM d""",
    "q_valid_chars": f"""WITH {_GLYPHS}, c AS (SELECT *, CASE WHEN i % 11 = 3 THEN chr(7) WHEN i % 13 = 4 THEN chr(8195) WHEN i % 17 = 5 THEN '(cid:9)' ELSE ch END AS c FROM glyphs),
w AS (SELECT doc_id, c, CASE WHEN seq % 19 = 0 THEN 'size' WHEN font_id = 'f3' THEN 'font' WHEN i + 100 BETWEEN 122 AND 125 THEN 'ornament'
  WHEN regexp_matches(c, '^[\\p{{Cc}}\\p{{Co}}]') AND c NOT IN (chr(9), chr(10), chr(13)) THEN 'category' WHEN contains(c, '(cid:') THEN 'cid' END AS why FROM c)
SELECT doc_id, why, count(*) AS n, count(*) FILTER (c = chr(8195)) AS n_spaces FROM w GROUP BY ALL""",
    "q_char_area": f"""WITH {WORDS}, a AS (SELECT doc_id, page_no, (CASE WHEN seq % 50 = 0 THEN 0.5 ELSE x2 - x END) * (y2 - y) AS area FROM words),
m AS (SELECT doc_id, page_no, median(area) AS median_area FROM a GROUP BY ALL) SELECT doc_id, page_no, median_area, count(*) FILTER (area < 0.05 * median_area) AS n_tiny FROM a JOIN m USING (doc_id, page_no) GROUP BY ALL""",
    "q_descent": f"""WITH {WORDS}, d AS (SELECT *, CASE font_id WHEN 'f1' THEN -2.0 WHEN 'f2' THEN -1.5 ELSE 0.0 END::DOUBLE AS descent FROM words),
n AS (SELECT doc_id, page_no, descent, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY count(*) DESC, min(seq)) AS r FROM d GROUP BY doc_id, page_no, descent),
b AS (SELECT doc_id, page_no, min(y) AS y, max(y2) AS y2 FROM d GROUP BY ALL) SELECT b.doc_id, b.page_no, descent, y - descent AS y, y2 - descent AS y2 FROM b JOIN n ON n.doc_id = b.doc_id AND n.page_no = b.page_no AND r = 1""",
    "q_formula_boxes": f"""WITH {WORDS}, s AS (SELECT *, {_START} AS f FROM words), b AS (SELECT *, CASE WHEN f IS DISTINCT FROM lag(f) OVER r THEN 1 ELSE 0 END AS new FROM s WINDOW r AS (PARTITION BY doc_id, page_no, row_no ORDER BY seq)),
i AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, page_no, row_no ORDER BY seq) AS run FROM b), j AS (SELECT *, CASE WHEN n = 1 THEN y2 + 7 ELSE y2 END AS z FROM i WHERE f)
SELECT doc_id, page_no, min(x) AS x, coalesce(min(y) FILTER (n > 1), min(y)) AS y, max(x2) AS x2, coalesce(max(z) FILTER (n > 1), max(z)) AS y2, min(seq) AS first_seq FROM j GROUP BY doc_id, page_no, row_no, run""",
    "q_formula_layout": f"""WITH {WORDS}, h AS (SELECT doc_id, seq, min(layout_id) AS l FROM words, {_BOXES} WHERE greatest(0, least(x2, fx2) - greatest(x, fx)) * greatest(0, least(y2, fy2) - greatest(y, fy)) / ((x2 - x) * (y2 - y)) > 0.4 GROUP BY ALL)
SELECT w.doc_id, w.seq, h.l::INT AS formula_layout_id FROM words w LEFT JOIN h ON h.doc_id = w.doc_id AND h.seq = w.seq""",
    "q_isolated_formulas": f"""WITH {WORDS}, p AS (SELECT doc_id, page_no, 506.0 - 12 * max(row_no) AS ty FROM words GROUP BY ALL)
SELECT doc_id, page_no, layout_id::INT AS layout_id, CASE WHEN greatest(0, least(fx2, 516) - greatest(fx, 36)) * greatest(0, least(fy2, 516) - greatest(fy, ty)) / ((fx2 - fx) * (fy2 - fy)) >= 0.5 THEN 'formula' ELSE 'isolate_formula' END AS label FROM p, {_BOXES}""",
    "q_newlines": f"""WITH {WORDS}, l AS (SELECT *, lag(x) OVER p AS px, lag(y) OVER p AS py, lag(x2) OVER p AS px2 FROM words WINDOW p AS (PARTITION BY doc_id, page_no ORDER BY seq))
SELECT doc_id, seq, coalesce(y2 < py OR x2 < px - 10 * greatest(x2 - x, px2 - px), false) AS newline FROM l""",
    "q_space_chars": f"WITH {WORDS}, {_GAPS} SELECT doc_id, seq, x2 AS x, x2 + least(gap, ref_gap) AS x2 FROM gp JOIN refs USING (doc_id, page_no, row_no) WHERE gap >= ref_gap",
    "q_text_join": f"""WITH {PARAS}, {_GAPS}, l AS (SELECT *, lead(x) OVER p AS nx, lead(x2) OVER p AS nx2, lead(y2) OVER p AS ny2 FROM grouped JOIN refs USING (doc_id, page_no, row_no) WINDOW p AS (PARTITION BY doc_id, page_no, para_seq ORDER BY seq)),
s AS (SELECT *, CASE WHEN nx - x2 >= ref_gap OR ny2 < y OR nx2 < x - 10 * greatest(nx2 - nx, x2 - x) THEN ' ' ELSE '' END AS sep FROM l)
SELECT doc_id, page_no, para_seq, trim(regexp_replace(string_agg(word || sep, '' ORDER BY seq), ' +', ' ', 'g')) AS text FROM s GROUP BY ALL""",
    "q_paragraph_lines": f"""WITH {PARAS}, l AS (SELECT *, min(y) OVER (PARTITION BY doc_id, page_no, para_seq ORDER BY y2 DESC, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low, max(y2) OVER q - min(y) OVER q < 5 AS flat FROM grouped WINDOW q AS (PARTITION BY doc_id, page_no, para_seq)),
n AS (SELECT *, sum(CASE WHEN NOT flat AND y2 <= low - 0.25 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_no, para_seq ORDER BY y2 DESC, seq ROWS UNBOUNDED PRECEDING)::BIGINT AS line_idx FROM l),
g AS (SELECT doc_id, page_no, para_seq, line_idx, min(x) AS x, min(y) AS y, max(x2) AS x2, max(y2) AS y2, count(*) AS n_words, string_agg(word, ' ' ORDER BY seq) AS text, avg((y + y2) / 2) AS cy, avg((x + x2) / 2) AS cx FROM n GROUP BY ALL)
SELECT * EXCLUDE (cy, cx), (row_number() OVER (PARTITION BY doc_id, page_no ORDER BY cy DESC, cx, para_seq, line_idx))::INT AS place FROM g""",
    "q_box_predicates": f"""WITH {WORDS}, l AS (SELECT *, lead(x) OVER p AS nx, lead(y) OVER p AS ny, lead(x2) OVER p AS nx2, lead(y2) OVER p AS ny2 FROM words WINDOW p AS (PARTITION BY doc_id, page_no ORDER BY seq)),
o AS (SELECT *, greatest(0, least(y2, ny2) - greatest(y, ny)) AS sh FROM l WHERE nx IS NOT NULL)
SELECT doc_id, seq, x < nx2 AND nx < x2 AND y < ny2 AND ny < y2 AS overlap, (y >= ny AND y2 <= ny2) OR (ny >= y AND ny2 <= y2) AS vertical, (x >= nx AND x2 <= nx2) OR (nx >= x AND nx2 <= x2) AS in_x,
y <= ny2 + 1 AND ny <= y2 + 1 AS in_y, abs(x2 - nx) <= 2 OR abs(nx2 - x) <= 2 AS beside, sh / (greatest(y2, ny2) - least(y, ny)) AS y_iou, sh / least(y2 - y, ny2 - ny) AS y_lower FROM o""",
}

"""Driver queries over character classes, units, fonts, added rows, names and content streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillframe.functions import geometry as G
from quillframe.operators import render as R
from quillframe.plans.layout_queries import PARAS, WORDS, _paras, _words
from quillframe.plans.part_queries import _LAY, _lay
from quillframe.plans.text_queries import PARAS as TEXT_PARAS
from quillframe.plans.text_queries import _paras as _text_paras
from quillframe.sources import content
from quillframe.sources import synthetic as S


def _chars(spark, sf_dir):
    c = _text_paras(spark, sf_dir).select("doc_id", "para_no", F.posexplode(F.split("text", "")).alias("place", "ch")).where("ch <> ''")
    return c.withColumn("ch", F.when(F.col("place") % 9 == 4, "中").when(F.col("place") % 9 == 7, "（").otherwise(F.col("ch")))


def q_char_classes(spark, sf_dir):
    before = F.lag("ch").over(Window.partitionBy("doc_id", "para_no").orderBy("place"))
    c = _chars(spark, sf_dir).select("doc_id", R.character_class(F.col("ch")).alias("class"), R.can_break(F.col("ch")).alias("breaks"), R.mixed_gap(before, F.col("ch")).alias("gap"))
    return c.groupBy("doc_id", "class").agg(F.count("*").alias("n"), F.count_if("breaks").alias("n_breaks"), F.count_if("gap").alias("n_gaps"))


def _glyph_table(spark):
    chars = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 .,"
    return spark.createDataFrame([(c, 300.0 + 10 * k) for k, c in enumerate(chars)], "ch string, width double")


def q_units(spark, sf_dir):
    u = R.units(_text_paras(spark, sf_dir), _glyph_table(spark))
    return u.groupBy("doc_id", "para_no").agg(F.count("*").alias("n"), F.round(F.sum("width"), 6).alias("width"))


def q_wrap(spark, sf_dir):
    paras = _text_paras(spark, sf_dir).withColumn("wide", F.lit(400.0))
    return R.wrapped_texts(paras, _glyph_table(spark)).withColumn("widest", F.round("widest", 6))


def q_relocate(spark, sf_dir):
    old, new = G.box(), (F.lit(10.0), F.lit(20.0), 10 + 2 * (F.col("x2") - F.col("x")), F.lit(40.0))
    t = G.scaled_to(old, new)
    moved = G.relocated(old, (F.col("x") - 5, F.col("y") - 5), F.lit(100.0), F.lit(50.0), F.lit(0.5), F.lit(1.0), F.lit(2.0))
    return _words(spark, sf_dir).select("doc_id", "seq", *[t[k].alias(k) for k in ("scale", "tx", "ty")], *[c.alias(n) for c, n in zip(moved, ("mx", "my", "mx2", "my2"), strict=True)])


def q_matrix_parts(spark, sf_dir):
    m = [F.col("l_quantity"), F.lit(1.0), F.lit(-2.0), F.col("l_tax") + 1, F.col("l_discount"), F.lit(3.0)]
    d, i = G.decomposed(m), G.inverted(m)
    x, y = G.applied(i, *G.applied(m, F.lit(7.0), F.lit(9.0)))
    return S.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[F.round(d[k], 6).alias(k) for k in ("angle", "sx", "sy", "shear")], F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


def q_clip_paths(spark, sf_dir):
    points = F.array(F.struct(F.col("x"), F.col("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))
    old, new = [F.lit(2.0), F.lit(0.0), F.lit(0.0), F.lit(2.0), F.lit(10.0), F.lit(0.0)], [F.lit(0.0), F.lit(1.0), F.lit(-1.0), F.lit(0.0), F.lit(5.0), F.lit(5.0)]
    w = _words(spark, sf_dir).select("doc_id", "seq", F.posexplode(R.clip_moved(points, old, new)).alias("i", "p"))
    return w.select("doc_id", "seq", "i", F.col("p.x").alias("x"), F.col("p.y").alias("y"))


def q_snapshots(spark, sf_dir):
    op = F.element_at(F.array(*map(F.lit, ("w", "Tj", "g", "Tj", "J", "rg", "Tj"))), (F.col("seq") % 7 + 1).cast("int"))
    return R.snapshots(_words(spark, sf_dir).select("doc_id", "seq", op.alias("op"), F.col("n").cast("string").alias("args")))


def q_font_family(spark, sf_dir):
    code = F.element_at(F.array(*map(F.lit, ("zh-CN", "zh-TW", "zh-HK", "ja", "ko-KR", "en", "fr"))), (F.col("doc_id") % 7 + 1).cast("int"))
    return S.table(spark, sf_dir, "documents").select("doc_id", R.font_family(code).alias("family"))


def _fonts(spark):
    """Fonts by kind, and which characters each has."""
    fonts = spark.createDataFrame([("s1", "script", False, True), ("n1", "normal", False, False), ("n2", "normal", True, False), ("b1", "fallback", False, False), ("z1", "other", False, False)], "font string, kind string, bold boolean, italic boolean")
    sets = {"s1": "aeiou", "n1": "abcdefghijklm", "n2": "abcdefghijklmn", "b1": "abcdefghijklmnopqrst", "z1": "abcdefghijklmnopqrstuvwxyz"}
    return fonts, spark.createDataFrame([(f, c) for f, cs in sets.items() for c in cs], "font string, ch string")


def q_font_choice(spark, sf_dir):
    fonts, glyphs = _fonts(spark)
    chars = _text_paras(spark, sf_dir).select(F.explode(F.array_distinct(F.split("text", ""))).alias("ch"), (F.col("doc_id") % 2 == 0).alias("bold"), F.lit(False).alias("italic"))
    return R.chosen_fonts(chars.where("ch rlike '^[a-zA-Z]$'"), fonts, glyphs)


def q_page_fonts(spark, sf_dir):
    w = _words(spark, sf_dir)
    return R.fonts_of_pages(w.select("doc_id", F.col("font_id").alias("font")), w)


def q_backgrounds(spark, sf_dir):
    return R.backgrounds(_paras(spark, sf_dir), _lay(spark, sf_dir))


def q_overlays(spark, sf_dir):
    p = _paras(spark, sf_dir)
    return R.overlays(p, p.select("doc_id", "page_no").distinct())


def q_filter_hints(spark, sf_dir):
    return R.filter_hints(_text_paras(spark, sf_dir).withColumn("error", F.when(F.col("para_no") % 4 == 1, "content_filter")), "Refused.")


def q_first_mark(spark, sf_dir):
    return R.with_mark(_text_paras(spark, sf_dir), "Made by quillframe")


def q_output_names(spark, sf_dir):
    d = S.table(spark, sf_dir, "documents")
    return d.select("doc_id", R.output_name(F.concat(F.lit("doc"), F.col("doc_id")), F.col("doc_id") % 2 == 0, F.col("doc_id") % 3 == 0, "zh", "dual").alias("name"))


def q_page_strings(spark, sf_dir):
    p = _text_paras(spark, sf_dir).where("para_no % 3 <> 1").groupBy("doc_id").agg(F.collect_set(F.col("para_no").cast("long")).alias("pages"))
    return p.select("doc_id", R.page_string(F.col("pages")).alias("pages"))


def q_drawn_curves(spark, sf_dir):
    c = _words(spark, sf_dir).select("doc_id", "seq", (F.col("n") % 3 == 0).alias("passthrough"), (F.col("n") % 5 == 0).alias("debug_info"))
    return R.drawn_curves(c).select("doc_id", "seq")


def q_contained(spark, sf_dir):
    e = _words(spark, sf_dir).select("doc_id", "page_no", "seq", F.col("x").alias("ex"), F.col("y").alias("ey"), F.col("x2").alias("ex2"), F.col("y2").alias("ey2"))
    return R.contained(e, _lay(spark, sf_dir).where("label IN ('title', 'footnote')")).select("doc_id", "seq")


def q_line_spacing(spark, sf_dir):
    lines = _words(spark, sf_dir).groupBy("doc_id", "page_no", "row_no").agg(F.min("y").alias("y"))
    return R.upper_median_gap(lines)


def _content(spark, sf_dir):
    """Pages as content streams: each word is shown at its place, and each page draws a frame and a form."""
    esc = F.regexp_replace("word", r"([()\\])", r"\\$1")
    show = F.concat(F.lit("BT /"), F.col("font_id"), F.lit(" "), F.col("font_size"), F.lit(" Tf 1 0 0 1 "), F.col("x"), F.lit(" "), F.col("y"), F.lit(" Tm ("), esc, F.lit(") Tj ET"))
    pages = _words(spark, sf_dir).groupBy("doc_id", "page_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", show.alias("s")))), lambda x: x["s"]), "\n").alias("shown"))
    stream = F.concat(F.lit("q 0.5 w 30 30 540 490 re S Q q 1 0 0 1 5 7 cm /Fm Do Q\n"), "shown")
    return pages.select("doc_id", "page_no", stream.alias("content"), F.create_map(F.lit("Fm"), F.lit("2 w 0 0 m 10 20 l S /Fm Do")).alias("objects"))


def q_content_events(spark, sf_dir):
    return content.events(_content(spark, sf_dir)).select("doc_id", "page_no", "seq", "kind", "text", "x", "y", "font", "size", "state", "objects")


QUERIES = {k: f for k, f in dict(globals()).items() if k.startswith("q_")}

_CHARS = TEXT_PARAS + """,
c0 AS (SELECT doc_id, para_no, string_split(text, '') AS cs FROM paras), c1 AS (SELECT doc_id, para_no, generate_subscripts(cs, 1) - 1 AS place, unnest(cs) AS ch FROM c0)"""
_GLYPHS = "(SELECT 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 .,'[k + 1:k + 1] AS ch, 300.0 + 10 * k AS width FROM range(65) r(k))"

ORACLE = {
    "q_char_classes": f"""WITH {_CHARS}, c AS (SELECT doc_id, para_no, place, CASE WHEN place % 9 = 4 THEN '中' WHEN place % 9 = 7 THEN '（' ELSE ch END AS ch FROM c1),
h AS (SELECT *, ch IN (',', '.', ':', ';', '?', '!', ')', ']', '}}', '-', '–', '—', '·', '/', '’', '”') AS hang, ch IN ('（', '(', '[', '{{', '“', '‘') AS op, ch IN ('中', '（') AS cjk FROM c),
l AS (SELECT *, lag(ch) OVER p AS pc, lag(hang) OVER p AS ph, lag(op) OVER p AS po, lag(cjk) OVER p AS pk FROM h WINDOW p AS (PARTITION BY doc_id, para_no ORDER BY place)),
k AS (SELECT doc_id, CASE WHEN ch = ' ' THEN 'space' WHEN hang THEN 'hanging' WHEN op THEN 'opening' WHEN cjk THEN 'cjk' ELSE 'other' END AS class, ch = ' ' OR (cjk AND NOT op) OR ch IN ('-', '–', '—') AS b,
coalesce(ch <> ' ' AND NOT hang AND NOT op AND pc <> ' ' AND NOT ph AND NOT po AND cjk <> pk, false) AS g FROM l) SELECT doc_id, class, count(*) AS n, count(*) FILTER (b) AS n_breaks, count(*) FILTER (g) AS n_gaps FROM k GROUP BY ALL""",
    "q_units": f"WITH {_CHARS} SELECT doc_id, para_no, count(*) AS n, round(sum(width / 1000 * 10), 6)::DOUBLE AS width FROM c1 JOIN {_GLYPHS} g USING (ch) GROUP BY ALL",
    "q_relocate": f"""WITH {WORDS} SELECT doc_id, seq, 2.0::DOUBLE AS scale, 10 - x * 2 AS tx, 20 - y * 2 AS ty, 100 + (x - (x - 5) + 1) * 0.5 AS mx, 50 + (y - (y - 5) + 2) * 0.5 AS my,
100 + (x - (x - 5) + 1) * 0.5 + (x2 - x) * 0.5 AS mx2, 50 + (y - (y - 5) + 2) * 0.5 + (y2 - y) * 0.5 AS my2 FROM words""",
    "q_matrix_parts": """WITH m AS (SELECT l_orderkey, l_linenumber, l_quantity AS a, 1.0 AS b, -2.0 AS c, l_tax + 1 AS d FROM lineitem), s AS (SELECT *, sqrt(a * a + b * b) AS sx, a * d - b * c AS det FROM m)
SELECT l_orderkey, l_linenumber, round(degrees(atan2(b, a)), 6) AS angle, round(sx, 6) AS sx, round(det / sx, 6) AS sy, round(degrees(atan2((a * c + b * d) / sx, det / sx)), 6) AS shear, 7.0::DOUBLE AS x, 9.0::DOUBLE AS y FROM s""",
    "q_clip_paths": f"WITH {WORDS} SELECT doc_id, seq, 0 AS i, -(y / 2) + 5 AS x, (x - 10) / 2 + 5 AS y FROM words UNION ALL SELECT doc_id, seq, 1, -(y2 / 2) + 5, (x2 - 10) / 2 + 5 FROM words",
    "q_snapshots": f"""WITH {WORDS}, o AS (SELECT doc_id, seq, ['w', 'Tj', 'g', 'Tj', 'J', 'rg', 'Tj'][seq % 7 + 1] AS op, n::VARCHAR AS args FROM words),
l AS (SELECT doc_id, seq, op, {', '.join(f"max(CASE WHEN op = '{n}' THEN seq END) OVER w AS s_{n}, last_value(CASE WHEN op = '{n}' THEN args END IGNORE NULLS) OVER w AS a_{n}" for n in ('w', 'J', 'g', 'rg'))}
FROM o WINDOW w AS (PARTITION BY doc_id ORDER BY seq ROWS UNBOUNDED PRECEDING))
SELECT doc_id, seq, array_to_string(list_transform(list_sort(list_filter([{', '.join(f"struct_pack(s := s_{n}, t := a_{n} || ' {n}')" for n in ('w', 'J', 'g', 'rg'))}], lambda x: x.s IS NOT NULL)), lambda x: x.t), ' ') AS state FROM l WHERE op = 'Tj'""",
    "q_font_family": "SELECT doc_id, ['CN', 'TW', 'HK', 'JP', 'KR', 'EN', 'EN'][doc_id % 7 + 1] AS family FROM documents",
    "q_font_choice": f"""WITH {TEXT_PARAS}, c AS (SELECT DISTINCT unnest(string_split(text, '')) AS ch, doc_id % 2 = 0 AS bold, false AS italic FROM paras)
SELECT ch, bold, italic, CASE WHEN ch IN ('a', 'e', 'i', 'o', 'u') THEN 's1' WHEN ch BETWEEN 'a' AND 'm' THEN CASE WHEN bold THEN 'n2' ELSE 'n1' END WHEN ch = 'n' THEN 'n2' WHEN ch BETWEEN 'o' AND 't' THEN 'b1' WHEN ch BETWEEN 'u' AND 'z' THEN 'z1' END AS font
FROM c WHERE regexp_matches(ch, '^[a-zA-Z]$')""",
    "q_page_fonts": f"WITH {WORDS}, u AS (SELECT DISTINCT doc_id, font_id AS font FROM words), p AS (SELECT DISTINCT doc_id, page_no, xobj_id FROM words) SELECT p.doc_id, page_no, xobj_id, font FROM p JOIN u ON u.doc_id = p.doc_id",
    "q_backgrounds": f"""WITH {PARAS}, {_LAY} SELECT p.doc_id, p.page_no, para_seq, least(p.x, l.x) AS x, least(p.y, l.y) AS y, greatest(p.x2, l.x2) AS x2, greatest(p.y2, l.y2) AS y2 FROM paras p LEFT JOIN lay l ON l.doc_id = p.doc_id AND l.page_no = p.page_no AND l.layout_id = p.layout_id""",
    "q_overlays": f"WITH {PARAS} SELECT doc_id, page_no, 'paragraph[' || label || ']' AS text, x, y2 AS y FROM paras UNION ALL SELECT DISTINCT doc_id, page_no, 'page ' || (page_no + 1), 50.0, 20.0 FROM paras",
    "q_filter_hints": f"WITH {TEXT_PARAS} SELECT doc_id, para_no, 1 AS sub, text FROM paras UNION ALL SELECT doc_id, para_no, 0, 'Refused.' FROM paras WHERE para_no % 4 = 1",
    "q_first_mark": f"WITH {TEXT_PARAS} SELECT doc_id, page_no, text FROM paras UNION ALL SELECT DISTINCT doc_id, 0, 'Made by quillframe' FROM paras p WHERE page_no = 0",
    "q_output_names": "SELECT doc_id, 'doc' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.debug' ELSE '' END || CASE WHEN doc_id % 3 = 0 THEN '' ELSE '.no_watermark' END || '.zh.dual.pdf' AS name FROM documents",
    "q_page_strings": f"""WITH {TEXT_PARAS}, g AS (SELECT doc_id, para_no, para_no - row_number() OVER (PARTITION BY doc_id ORDER BY para_no) AS g FROM paras WHERE para_no % 3 <> 1),
r AS (SELECT doc_id, min(para_no) + 1 AS a, max(para_no) + 1 AS b FROM g GROUP BY doc_id, g) SELECT doc_id, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ',' ORDER BY a) AS pages FROM r GROUP BY doc_id""",
    "q_drawn_curves": f"WITH {WORDS} SELECT doc_id, seq FROM words WHERE n % 3 = 0 OR n % 5 = 0",
    "q_contained": f"""WITH {WORDS}, {_LAY} SELECT DISTINCT w.doc_id, w.seq FROM words w JOIN lay l ON l.doc_id = w.doc_id AND l.page_no = w.page_no AND label IN ('title', 'footnote')
WHERE greatest(0, least(w.x2, l.x2) - greatest(w.x, l.x)) * greatest(0, least(w.y2, l.y2) - greatest(w.y, l.y)) / ((w.x2 - w.x) * (w.y2 - w.y)) >= 0.95""",
    "q_line_spacing": f"""WITH {WORDS}, l AS (SELECT doc_id, page_no, row_no, min(y) AS y FROM words GROUP BY ALL), g AS (SELECT *, lag(y) OVER (PARTITION BY doc_id, page_no ORDER BY y DESC) - y AS gap FROM l),
s AS (SELECT doc_id, page_no, list_sort(list(gap) FILTER (gap > 0)) AS gs FROM g GROUP BY ALL) SELECT doc_id, page_no, coalesce(gs[len(gs) // 2 + 1], 10.0) AS spacing FROM s""",
    "q_content_events": f"""WITH {WORDS}, p AS (SELECT DISTINCT doc_id, page_no FROM words)
SELECT doc_id, page_no, (row_number() OVER (PARTITION BY doc_id, page_no ORDER BY seq) + 1)::INT AS seq, 'text' AS kind, word AS text, x, y, font_id AS font, font_size AS size, '{{}}' AS state, '' AS objects FROM words
UNION ALL SELECT doc_id, page_no, 0, 'path', 're re re re', 30.0, 30.0, '', 0.0, '{{"w": [0.5]}}', '' FROM p
UNION ALL SELECT doc_id, page_no, 1, 'path', 'm l', 5.0, 7.0, '', 0.0, '{{"w": [2.0]}}', 'Fm' FROM p""",
}

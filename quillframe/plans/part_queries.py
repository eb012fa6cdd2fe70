"""Driver queries over parts of paragraphs and over sets of glossaries, fonts and layouts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillframe.operators import compositions as K
from quillframe.operators import sets as U
from quillframe.operators import styles as Y
from quillframe.operators import text as X
from quillframe.plans.glyph_queries import _START
from quillframe.plans.layout_queries import PARAS, WORDS, _paras, _words
from quillframe.plans.text_queries import PARAS as TEXT_PARAS
from quillframe.plans.text_queries import _batches
from quillframe.plans.text_queries import _paras as _text_paras
from quillframe.sources import synthetic as S


def q_classify(spark, sf_dir):
    items = _words(spark, sf_dir).select("doc_id", "line_no", "seq", Y.formula_start(F.col("word")).alias("formula"), F.col("word").rlike("^[•*-]").alias("bullet"), F.lit(False).alias("space"), F.col("font_size").alias("size"))
    return K.classified(items, "doc_id", "line_no")


def _formulas(spark, sf_dir):
    w = _words(spark, sf_dir).withColumn("f", Y.formula_middle(F.col("word"))).withColumn("corner", F.col("font_size") < 8)
    runs = Y.runs(w, ["doc_id", "page_no", "row_no"], "seq", "f").where("f")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "word"))), lambda x: x["word"]), " ")
    return runs.groupBy("doc_id", "page_no", "row_no", "run").agg(
        F.min("seq").alias("first_seq"), text.alias("text"), F.min(F.when(F.col("x") > 500, F.lit(0.5)).otherwise(0.0)).alias("y_offset"), F.every(F.col("x").between(100, 130)).alias("all_in_layout"), F.every("corner").alias("corner")
    )


def q_translatable(spark, sf_dir):
    return K.kinds(_formulas(spark, sf_dir)).select("doc_id", "first_seq", "text", "kind", "split")


def q_styled_runs(spark, sf_dir):
    items = _words(spark, sf_dir).select("doc_id", "page_no", "seq", Y.formula_start(F.col("word")).alias("is_formula"), F.struct("font_id", "font_size").alias("style"))
    r = K.styled_runs(items, "doc_id", "page_no")
    return r.groupBy("doc_id", "page_no", "run").agg(F.min("seq").alias("first_seq"), F.count("*").alias("n"), F.first("is_formula").alias("is_formula"), F.max("goes_on").alias("goes_on"))


def q_style_equal(spark, sf_dir):
    page = Window.partitionBy("doc_id", "page_no").orderBy("seq")
    one, two = (F.col("font_id"), F.col("font_size"), F.col("xobj_id")), tuple(F.lead(c).over(page) for c in ("font_id", "font_size", "xobj_id"))
    got = _words(spark, sf_dir).select("doc_id", "seq", Y.same_style(one, two).alias("same"), Y.same_but_size(one, two).alias("but_size"), Y.same_but_font(one, two).alias("but_font"), two[0].alias("next"))
    return got.where("next IS NOT NULL").drop("next")


def q_style_fold(spark, sf_dir):
    styles = F.transform(F.array_sort(F.collect_list(F.struct("seq", F.struct(F.col("font_id").alias("font"), F.col("font_size").alias("size"), (F.col("seq") % 2).alias("state")).alias("s")))), lambda x: x["s"])
    got = _words(spark, sf_dir).groupBy("doc_id", "page_no").agg(styles.alias("styles")).withColumn("s", K.folded_style("styles"))
    return got.select("doc_id", "page_no", "s.font", "s.size", "s.state")


def q_render_orders(spark, sf_dir):
    items = _words(spark, sf_dir).withColumn("render_order", F.when(F.col("seq") % 3 == 0, 9999999999999999).otherwise((F.col("seq") * 7) % 1000))
    return K.render_orders(items, "doc_id", "page_no", "row_no").select("doc_id", "seq", "sub_order", "paragraph_order")


def q_layout_sets(spark, sf_dir):
    items = _words(spark, sf_dir).withColumn("part", F.expr("col div 20")).withColumn("layout", F.when(F.col("n") > 3, F.col("row_no") % 3))
    return K.same_layouts(items, "doc_id", "page_no", "row_no").select("doc_id", "page_no", "row_no", "part", "same")


def q_ends(spark, sf_dir):
    return K.ends(_words(spark, sf_dir), "doc_id", "page_no", "row_no")


def _parted(spark, sf_dir):
    """Paragraphs whose words of digits are formulas and whose words in capitals have a style of their own."""
    p = _text_paras(spark, sf_dir)
    kind = lambda w: F.when(w.rlike("[0-9]"), "formula").when(w.rlike("^[A-Z]") & (F.length(w) > 8), "style").otherwise("text")
    return p.withColumn("parts", F.transform(F.split("text", " "), lambda w: F.struct(kind(w).alias("kind"), F.when(kind(w) == "text", F.concat(w, F.lit(" "))).otherwise(w).alias("text"))))


def q_placeholder_input(spark, sf_dir):
    return K.with_placeholders(_parted(spark, sf_dir)).select("doc_id", "para_no", "input", F.size("used").alias("n_used"), "rich")


def q_placeholder_output(spark, sf_dir):
    built = K.with_placeholders(_parted(spark, sf_dir))
    output = F.concat(F.regexp_replace(F.upper("input"), r"\{V1\}", "{ v 1 }"), F.lit(" {v999}"))
    got = K.from_output(built.withColumn("output", output).withColumn("allowed", F.array().cast("array<string>")))
    return got.select("doc_id", "para_no", F.size("compositions").alias("n_parts"), F.size(F.filter("compositions", lambda c: c["kind"] == "style")).alias("n_styles"), "removed")


def q_answers(spark, sf_dir):
    paras = _text_paras(spark, sf_dir)
    rows = X.batches(paras, 200, 5).join(paras, ["doc_id", "para_no"])
    place = F.row_number().over(Window.partitionBy("doc_id", "batch").orderBy("para_no")) - 1
    rows = rows.select((F.col("doc_id") * 100000 + F.col("batch")).alias("batch_id"), place.cast("long").alias("id"), F.md5("text").alias("input"))
    item = F.struct("id", F.when(F.col("id") % 4 != 3, F.reverse("input")).alias("output"))
    raw = rows.groupBy("batch_id").agg(F.array_sort(F.collect_list(item)).alias("a")).select("batch_id", F.when(F.col("batch_id") % 7 == 0, "garbage").when(F.col("batch_id") % 5 == 0, F.to_json(F.slice("a", 2, 99))).otherwise(F.to_json("a")).alias("raw"))
    return K.answered(rows, raw)


def q_cross_column(spark, sf_dir):
    p = _paras(spark, sf_dir).withColumn("y2", F.col("y2") + (F.col("para_seq") * 37 + F.col("doc_id")) % 90)
    return U.cross_column(p)


def q_cross_page(spark, sf_dir):
    p = _text_paras(spark, sf_dir).where("label = 'plain text'").withColumn("page_no", F.expr("CASE WHEN doc_id % 2 = 0 THEN para_no ELSE para_no div 3 END"))
    return U.cross_page(p.groupBy("doc_id", "page_no").agg(F.min("para_no").alias("first_no"), F.max("para_no").alias("last_no")))


def _terms(spark, sf_dir, of):
    return S.table(spark, sf_dir, "benchmark").where(of).select(F.concat(F.lit("g"), F.col("item_id") % 3).alias("name"), F.col("text").alias("source"))


def q_glossary_union(spark, sf_dir):
    user, auto = _terms(spark, sf_dir, "item_id % 2 = 0"), _terms(spark, sf_dir, "item_id % 2 = 1").withColumn("name", F.lit("auto"))
    return U.active_glossaries(user, auto, True).unionByName(U.active_glossaries(user, auto, False)).groupBy("name").agg(F.count("*").alias("n"))


def q_glossary_name(spark, sf_dir):
    names = S.table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 2 == 0, "auto").otherwise(F.concat(F.lit("auto#"), F.col("doc_id") % 8)).alias("name"))
    return U.free_glossary_name(names, "auto").unionByName(U.free_glossary_name(names, "other"))


def q_font_map(spark, sf_dir):
    w = _words(spark, sf_dir)
    page = w.groupBy("doc_id", "font_id").agg(F.min("font_size").alias("size"))
    own = w.where("xobj_id = 1 AND font_id <> 'f2'").groupBy("doc_id", "font_id").agg((F.max("font_size") + 1).alias("size"))
    return U.later_wins(page, own, "doc_id", "font_id")


def q_formula_fonts(spark, sf_dir):
    w = _words(spark, sf_dir).withColumn("is_formula", F.col("font_id") != "f1")
    page = w.select("doc_id", "page_no", "font_id", "is_formula").distinct()
    objects = w.where("n > 6").select("doc_id", "page_no", "xobj_id", F.when(F.col("n") % 2 == 0, "f1").otherwise("f2").alias("font_id"), (F.col("n") % 2 == 0).alias("is_formula")).distinct()
    return U.formula_fonts(page, objects)


def _lay(spark, sf_dir):
    pages = _words(spark, sf_dir).select("doc_id", "page_no").distinct()
    return S.layouts(pages).select("doc_id", "page_no", "layout_id", "label", F.lit(0.9).alias("conf"), F.col("lx").alias("x"), F.col("ly").alias("y"), F.col("lx2").alias("x2"), F.col("ly2").alias("y2"))


def q_layout_union(spark, sf_dir):
    lines = _words(spark, sf_dir).where("row_no % 10 = 0").groupBy("doc_id", "page_no", F.col("row_no").alias("line_no")).agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))
    got = U.with_fallback_lines(_lay(spark, sf_dir), lines)
    return U.with_tables(got, got.where("label = 'footnote'").withColumn("layout_id", F.lit(1))).select("source", "doc_id", "page_no", "layout_id", "label", "x2")


def q_fused_detections(spark, sf_dir):
    a = _lay(spark, sf_dir).select("doc_id", "page_no", F.col("layout_id").alias("det_id"), "label", (F.lit(0.5) + F.col("layout_id") / 10).alias("conf"))
    return U.fused(a, a.withColumn("conf", F.col("conf") - 0.05)).withColumn("conf", F.round("conf", 6))


def q_allowed_tokens(spark, sf_dir):
    words = F.array_distinct(F.slice(F.split("text", " "), 1, 6))
    return S.table(spark, sf_dir, "documents").select("doc_id", F.array_join(U.allowed_tokens(words, F.array(F.lit("{v1}"), F.lit("the"))), "|").alias("tokens"))


def q_same_fonts(spark, sf_dir):
    """Fonts that both odd and even pages of a document use (intersect)."""
    w = _words(spark, sf_dir).select("doc_id", "font_id", "page_no")
    return w.where("page_no % 2 = 0").select("doc_id", "font_id").intersect(w.where("page_no % 2 = 1").select("doc_id", "font_id"))


def q_cube(spark, sf_dir):
    d = S.table(spark, sf_dir, "documents")
    return d.cube("lang", "source").agg(F.count("*").alias("n_docs"), F.sum("n_chars").alias("n_chars"), F.grouping_id().alias("level"))


def q_rank_frames(spark, sf_dir):
    w = Window.partitionBy("lang").orderBy("n_chars", "doc_id")
    near = Window.partitionBy("lang").orderBy("n_chars").rangeBetween(-100, 100)
    d = S.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.rank().over(Window.partitionBy("lang").orderBy("n_chars")).alias("rank"), F.dense_rank().over(Window.partitionBy("lang").orderBy("n_chars")).alias("dense"), F.ntile(4).over(w).alias("quarter"), F.round(F.percent_rank().over(Window.partitionBy("lang").orderBy("n_chars")), 9).alias("percent"), F.count("*").over(near).alias("n_near"))


def q_region_search(spark, sf_dir):
    w = _words(spark, sf_dir)
    boxes = w.select("doc_id", "page_no", F.col("seq").alias("box_id"), F.col("x").alias("bx"), F.col("y").alias("by"), F.col("x2").alias("bx2"), F.col("y2").alias("by2"))
    queries = w.where("seq % 40 = 0").select("doc_id", "page_no", F.col("seq").alias("query_id"), (F.col("x") - 30).alias("qx"), (F.col("y") - 15).alias("qy"), (F.col("x2") + 30).alias("qx2"), (F.col("y2") + 15).alias("qy2"))
    return U.in_cells(boxes, queries)


def q_canonical_params(spark, sf_dir):
    raw = F.concat(F.lit('{"z": 1, "m": {"y": "'), F.col("lang"), F.lit('", "b": [2, 1]}, "a": '), F.col("doc_id"), F.lit("}"))
    return S.table(spark, sf_dir, "documents").select("doc_id", X.canonical_json(raw).alias("params"))


def q_chunks(spark, sf_dir):
    items = F.filter(F.split("text", " "), lambda w: w != "")
    chunks = S.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.chunked(items, 50)).alias("chunk", "items"))
    return chunks.select("doc_id", "chunk", F.size("items").alias("n"), F.get("items", F.lit(0)).alias("first"))


def q_error_codes(spark, sf_dir):
    name = F.element_at(F.array(*map(F.lit, ("ScannedPageError", "TimeoutError", "FileNotFoundError", "ValueError", "KeyError"))), (F.col("doc_id") % 5 + 1).cast("int"))
    return S.table(spark, sf_dir, "documents").select("doc_id", X.error_code(name).alias("code"))


def q_hints(spark, sf_dir):
    f = _formulas(spark, sf_dir).select("doc_id", "first_seq", "text", F.when(F.col("first_seq") % 5 == 0, 0.9).otherwise(0.0).alias("cid_share"))
    return X.hints(f).select("doc_id", F.to_json("hint").alias("hint"))


QUERIES = {k: f for k, f in dict(globals()).items() if k.startswith("q_")}

_FORMULAS = f"""
s0 AS (SELECT *, {_START} OR word LIKE ',%' AS f FROM words),
s1 AS (SELECT *, CASE WHEN f IS DISTINCT FROM lag(f) OVER r THEN 1 ELSE 0 END AS new FROM s0 WINDOW r AS (PARTITION BY doc_id, page_no, row_no ORDER BY seq)),
s2 AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, page_no, row_no ORDER BY seq) AS run FROM s1),
fm AS (SELECT doc_id, page_no, row_no, run, min(seq) AS first_seq, string_agg(word, ' ' ORDER BY seq) AS text, min(CASE WHEN x > 500 THEN 0.5 ELSE 0 END) AS y_offset, bool_and(x BETWEEN 100 AND 130) AS lay, bool_and(font_size < 8) AS corner FROM s2 WHERE f GROUP BY ALL)"""
_LAY = """
pg AS (SELECT DISTINCT doc_id, page_no FROM words),
lay AS (SELECT doc_id, page_no, layout_id, label, lx AS x, ly AS y, lx2 AS x2, ly2 AS y2 FROM pg JOIN (VALUES (0, 'page_header', 30.0, 504.0, 560.0, 520.0), (1, 'title', 30.0, 504.0, 560.0, 520.0),
  (2, 'plain text', 30.0, 60.0, 560.0, 506.0), (3, 'footnote', 30.0, 30.0, 560.0, 62.0)) b(layout_id, label, lx, ly, lx2, ly2) ON label <> 'title' OR page_no = 0)"""

ORACLE = {
    "q_classify": f"""WITH RECURSIVE {WORDS}, i AS (SELECT doc_id, line_no, seq, {_START} AS f, regexp_matches(word, '^[•*-]') AS b, font_size AS size, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY seq) AS i FROM words),
g AS (SELECT doc_id, line_no, list(struct_pack(seq := seq, f := f, b := b, size := size) ORDER BY i) AS w FROM i GROUP BY ALL),
c AS (SELECT doc_id, line_no, w, 1 AS i, w[1].seq AS seq, w[1].size AS size, w[1].b AS opened, CASE WHEN w[1].f AND NOT w[1].b THEN 'formula' ELSE 'text' END AS class FROM g
UNION ALL SELECT doc_id, line_no, w, i + 1, w[i + 1].seq, w[i + 1].size, opened, CASE WHEN w[i + 1].size < 0.79 * size OR (class = 'corner' AND w[i + 1].size < 1.1 * size) THEN 'corner' WHEN w[i + 1].f AND NOT (opened AND w[i + 1].b) THEN 'formula' ELSE 'text' END FROM c WHERE i < len(w))
SELECT doc_id, line_no, seq, class FROM c""",
    "q_translatable": f"""WITH {WORDS}, {_FORMULAS} SELECT doc_id, first_seq, text, CASE WHEN NOT lay AND y_offset <= 0.1 AND regexp_matches(text, '^[0-9, .]+$') AND NOT corner THEN 'line' ELSE 'formula' END AS kind,
NOT lay AND contains(text, ',') AND regexp_replace(text, '[0-9\\[\\],\\s]', '', 'g') <> '' AS split FROM fm""",
    "q_styled_runs": f"""WITH {WORDS}, i AS (SELECT doc_id, page_no, seq, {_START} AS f, font_id || ':' || font_size AS style FROM words),
c AS (SELECT *, lag(f) OVER p AS was, last_value(CASE WHEN NOT f THEN style END IGNORE NULLS) OVER (PARTITION BY doc_id, page_no ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS carried FROM i WINDOW p AS (PARTITION BY doc_id, page_no ORDER BY seq)),
n AS (SELECT *, CASE WHEN was IS NULL OR was <> f OR (NOT f AND style IS DISTINCT FROM carried) THEN 1 ELSE 0 END AS new, NOT f AND coalesce(was, false) AND style IS NOT DISTINCT FROM carried AS goes_on FROM c),
r AS (SELECT *, (sum(new) OVER (PARTITION BY doc_id, page_no ORDER BY seq))::BIGINT AS run FROM n) SELECT doc_id, page_no, run, min(seq) AS first_seq, count(*) AS n, bool_and(f) AS is_formula, bool_or(goes_on) AS goes_on FROM r GROUP BY ALL""",
    "q_style_equal": f"""WITH {WORDS}, l AS (SELECT *, lead(font_id) OVER p AS f2, lead(font_size) OVER p AS s2, lead(xobj_id) OVER p AS o2 FROM words WINDOW p AS (PARTITION BY doc_id, page_no ORDER BY seq))
SELECT doc_id, seq, font_id = f2 AND abs(font_size - s2) < 0.02 AND xobj_id = o2 AS same, font_id = f2 AND font_size / s2 > 0.7 AND font_size / s2 < 1.3 AND xobj_id = o2 AS but_size, abs(font_size - s2) < 0.02 AND xobj_id = o2 AS but_font FROM l WHERE f2 IS NOT NULL""",
    "q_style_fold": f"""WITH RECURSIVE {WORDS}, g AS (SELECT doc_id, page_no, list(struct_pack(font := font_id, size := font_size, state := seq % 2) ORDER BY seq) AS w FROM words GROUP BY ALL),
c AS (SELECT doc_id, page_no, w, 1 AS i, w[1].font AS font, w[1].size AS size, w[1].state AS state FROM g
UNION ALL SELECT doc_id, page_no, w, i + 1, CASE WHEN size IS NULL THEN w[i + 1].font WHEN font = w[i + 1].font THEN font END, CASE WHEN size IS NULL THEN w[i + 1].size WHEN size = w[i + 1].size THEN size END,
CASE WHEN size IS NULL THEN w[i + 1].state WHEN state = w[i + 1].state THEN state END FROM c WHERE i < len(w)) SELECT doc_id, page_no, font, size, state FROM c WHERE i = len(w)""",
    "q_render_orders": f"""WITH {WORDS}, r AS (SELECT *, CASE WHEN seq % 3 <> 0 THEN (seq * 7) % 1000 END AS o FROM words)
SELECT doc_id, seq, row_number() OVER (PARTITION BY doc_id, page_no, row_no ORDER BY seq) AS sub_order, min(o) OVER (PARTITION BY doc_id, page_no, row_no) AS paragraph_order FROM r""",
    "q_layout_sets": f"""WITH {WORDS}, s AS (SELECT doc_id, page_no, row_no, col // 20 AS part, list_sort(coalesce(list(DISTINCT row_no % 3) FILTER (n > 3), [])) AS ids FROM words GROUP BY ALL)
SELECT doc_id, page_no, row_no, part, coalesce(len(ids) = 1 AND ids = lead(ids) OVER (PARTITION BY doc_id, page_no, row_no ORDER BY part), false) AS same FROM s""",
    "q_ends": f"WITH {WORDS} SELECT doc_id, page_no, row_no, arg_min(word, seq) AS first, arg_max(word, seq) AS last, count(*) AS n FROM words GROUP BY ALL",
    "q_answers": f"""WITH RECURSIVE {TEXT_PARAS}, {_batches(200, 5)}, rq AS (SELECT b.doc_id * 100000 + batch AS batch_id, row_number() OVER (PARTITION BY b.doc_id, batch ORDER BY b.para_no) - 1 AS id, md5(p.text) AS input FROM b JOIN paras p ON p.doc_id = b.doc_id AND p.para_no = b.para_no)
SELECT batch_id, id, input, CASE WHEN batch_id % 7 <> 0 AND batch_id % 5 <> 0 AND id % 4 <> 3 THEN reverse(input) END AS output, CASE WHEN batch_id % 7 = 0 OR batch_id % 5 = 0 THEN 'batch failed' WHEN id % 4 = 3 THEN 'alone' ELSE 'batch' END AS route FROM rq""",
    "q_cross_column": f"""WITH {PARAS}, u AS (SELECT doc_id, page_no, para_seq, y2 + (para_seq * 37 + doc_id) % 90 AS z FROM paras),
n AS (SELECT *, lead(para_seq) OVER p AS nxt, coalesce(lead(z) OVER p - z > 20, false) AS up FROM u WINDOW p AS (PARTITION BY doc_id, page_no ORDER BY para_seq)),
r AS (SELECT *, sum(CASE WHEN up THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page_no ORDER BY para_seq) AS run FROM n),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no, run ORDER BY para_seq) AS nth FROM r WHERE up) SELECT doc_id, page_no, para_seq AS left_seq, nxt AS right_seq FROM k WHERE nth % 2 = 1""",
    "q_cross_page": f"""WITH RECURSIVE {TEXT_PARAS}, q AS (SELECT doc_id, para_no, CASE WHEN doc_id % 2 = 0 THEN para_no ELSE para_no // 3 END AS page_no FROM paras WHERE label = 'plain text'),
e AS (SELECT doc_id, page_no, min(para_no) AS f, max(para_no) AS l FROM q GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_no) AS i, lead(page_no) OVER (PARTITION BY doc_id ORDER BY page_no) AS np, lead(f) OVER (PARTITION BY doc_id ORDER BY page_no) AS nf FROM e),
c AS (SELECT doc_id, i, page_no, l, nf, np = page_no + 1 AS taken, CASE WHEN np = page_no + 1 THEN nf END AS claimed FROM o WHERE i = 1
UNION ALL SELECT o.doc_id, o.i, o.page_no, o.l, o.nf, coalesce(o.np = o.page_no + 1, false) AND o.l IS DISTINCT FROM c.claimed, CASE WHEN o.np = o.page_no + 1 AND o.l IS DISTINCT FROM c.claimed THEN o.nf END FROM c JOIN o ON o.doc_id = c.doc_id AND o.i = c.i + 1)
SELECT doc_id, page_no, l AS left_no, nf AS right_no FROM c WHERE taken""",
    "q_glossary_union": "SELECT name, count(*) AS n FROM (SELECT 'g' || item_id % 3 AS name FROM benchmark WHERE item_id % 2 = 0 UNION ALL SELECT 'auto' FROM benchmark WHERE item_id % 2 = 1 UNION ALL SELECT 'g' || item_id % 3 FROM benchmark WHERE item_id % 2 = 0) GROUP BY name",
    "q_glossary_name": """WITH t AS (SELECT DISTINCT CASE WHEN doc_id % 2 = 0 THEN 0 ELSE doc_id % 8 END AS n FROM documents), f AS (SELECT min(i) AS n FROM range(0, 100) r(i) WHERE i NOT IN (SELECT n FROM t))
SELECT CASE WHEN n = 0 THEN 'auto' ELSE 'auto#' || n END AS name FROM f UNION ALL SELECT 'other'""",
    "q_font_map": f"""WITH {WORDS}, o AS (SELECT doc_id, font_id, max(font_size) + 1 AS s FROM words WHERE xobj_id = 1 AND font_id <> 'f2' GROUP BY ALL), p AS (SELECT doc_id, font_id, min(font_size) AS s FROM words GROUP BY ALL)
SELECT p.doc_id, p.font_id, coalesce(o.s, p.s) AS size FROM p LEFT JOIN o ON o.doc_id = p.doc_id AND o.font_id = p.font_id""",
    "q_formula_fonts": f"""WITH {WORDS}, o AS (SELECT DISTINCT doc_id, page_no, xobj_id, CASE WHEN n % 2 = 0 THEN 'f1' ELSE 'f2' END AS font_id, n % 2 = 0 AS f FROM words WHERE n > 6),
i AS (SELECT DISTINCT o.doc_id, o.page_no, o.xobj_id, w.font_id FROM o JOIN words w ON w.doc_id = o.doc_id AND w.page_no = o.page_no AND w.font_id <> 'f1')
(SELECT * FROM i EXCEPT SELECT doc_id, page_no, xobj_id, font_id FROM o WHERE NOT f) UNION SELECT doc_id, page_no, xobj_id, font_id FROM o WHERE f""",
    "q_layout_union": f"""WITH {WORDS}, {_LAY}, l AS (SELECT doc_id, page_no, row_no, max(x2) AS x2 FROM words WHERE row_no % 10 = 0 GROUP BY ALL),
u AS (SELECT doc_id, page_no, layout_id, label, x2 FROM lay UNION ALL SELECT doc_id, page_no, (3 + row_number() OVER (PARTITION BY doc_id, page_no ORDER BY row_no))::INT, 'fallback_line', x2 FROM l)
SELECT 'layout' AS source, * FROM u UNION ALL SELECT 'table', doc_id, page_no, 1, label, x2 FROM u WHERE label = 'footnote'""",
    "q_fused_detections": f"""WITH {WORDS}, {_LAY}, u AS (SELECT doc_id, page_no, layout_id + 1000 AS det_id, label, round(0.5 + layout_id / 10, 6) AS conf FROM lay UNION ALL SELECT doc_id, page_no, layout_id + 2000, label || '_hybrid', round(0.45 + layout_id / 10, 6) FROM lay)
SELECT doc_id, page_no, det_id::INT AS det_id, label, conf::DOUBLE AS conf, (row_number() OVER (PARTITION BY doc_id, page_no ORDER BY conf DESC, det_id))::INT AS place FROM u""",
    "q_allowed_tokens": "SELECT doc_id, array_to_string(list_sort(list_distinct(string_split(text, ' ')[1:6] || ['{v1}', 'the'])), '|') AS tokens FROM documents",
    "q_same_fonts": f"WITH {WORDS} SELECT doc_id, font_id FROM words WHERE page_no % 2 = 0 INTERSECT SELECT doc_id, font_id FROM words WHERE page_no % 2 = 1",
    "q_cube": "SELECT lang, source, count(*) AS n_docs, sum(n_chars)::BIGINT AS n_chars, grouping(lang, source)::BIGINT AS level FROM documents GROUP BY CUBE (lang, source)",
    "q_rank_frames": """SELECT doc_id, rank() OVER w AS rank, dense_rank() OVER w AS dense, ntile(4) OVER (PARTITION BY lang ORDER BY n_chars, doc_id) AS quarter, round(percent_rank() OVER w, 9) AS percent,
count(*) OVER (PARTITION BY lang ORDER BY n_chars RANGE BETWEEN 100 PRECEDING AND 100 FOLLOWING) AS n_near FROM documents WINDOW w AS (PARTITION BY lang ORDER BY n_chars)""",
    "q_region_search": f"""WITH {WORDS} SELECT q.doc_id, q.page_no, q.seq AS query_id, b.seq AS box_id FROM words q JOIN words b ON b.doc_id = q.doc_id AND b.page_no = q.page_no
WHERE q.seq % 40 = 0 AND b.x < q.x2 + 30 AND q.x - 30 < b.x2 AND b.y < q.y2 + 15 AND q.y - 15 < b.y2""",
    "q_canonical_params": """SELECT doc_id, '{"a":' || doc_id || ',"m":{"b":[2,1],"y":"' || lang || '"},"z":1}' AS params FROM documents""",
    "q_chunks": """WITH w AS (SELECT doc_id, list_filter(string_split(text, ' '), lambda x: x <> '') AS ws FROM documents), c AS (SELECT doc_id, ws, unnest(range(0, (len(ws) + 49) // 50)) AS chunk FROM w)
SELECT doc_id, chunk::INT AS chunk, len(ws[chunk * 50 + 1:chunk * 50 + 50])::INT AS n, ws[chunk * 50 + 1] AS first FROM c""",
    "q_error_codes": "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'scanned_pdf' WHEN 1 THEN 'timeout' WHEN 2 THEN 'invalid_output' WHEN 3 THEN 'invalid_output' ELSE 'failed' END AS code FROM documents",
    "q_hints": f"""WITH {WORDS}, {_FORMULAS}, h AS (SELECT doc_id, first_seq, text, row_number() OVER (PARTITION BY doc_id ORDER BY first_seq) AS k FROM fm)
SELECT doc_id, '{{' || string_agg('"{{v' || k || '}}":' || to_json(text)::VARCHAR, ',' ORDER BY k) || '}}' AS hint FROM h WHERE first_seq % 5 <> 0 GROUP BY doc_id""",
}

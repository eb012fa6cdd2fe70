"""Driver queries over pages, parts, detections, matrices and progress events."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillframe.functions import geometry as G
from quillframe.operators import events as V
from quillframe.operators import pages as P
from quillframe.plans.layout_queries import WORDS, _words
from quillframe.sources import synthetic as S


def _pages(spark, sf_dir):
    return _words(spark, sf_dir).groupBy("doc_id", "page_no").agg(F.count("*").alias("n_words"), F.max("x2").alias("w"), F.max("y2").alias("h"))


def q_render_order(spark, sf_dir):
    w = _words(spark, sf_dir)
    chars = w.select("doc_id", "page_no", F.col("seq").cast("long").alias("idx"), F.when(F.col("seq") % 3 > 0, F.col("row_no")).alias("render_order"), F.col("seq").cast("long").alias("sub_order"))
    curves = w.select("doc_id", "page_no", F.col("seq").cast("long").alias("idx"), F.col("row_no").alias("render_order"), F.col("n").cast("long").alias("sub_order"))
    return P.render_units(chars, curves).select("doc_id", "page_no", "kind_ord", "idx", "place")


def q_page_parts(spark, sf_dir):
    return P.parts(_pages(spark, sf_dir), 2)


def q_merge_parts(spark, sf_dir):
    p = P.parts(_pages(spark, sf_dir), 2)
    return p.groupBy("doc_id").agg(F.count("*").alias("n_parts"), F.min("first_page").alias("first_page"), F.max("last_page").alias("last_page"), F.sum("n_pages").alias("n_pages"))


def q_dual_alternating(spark, sf_dir):
    return P.alternating(_pages(spark, sf_dir))


def q_dual_side(spark, sf_dir):
    p = _pages(spark, sf_dir)
    return P.side_by_side(p, p.withColumn("h", F.col("h") + 5))


def q_watermark_grid(spark, sf_dir):
    sizes = _pages(spark, sf_dir).groupBy("w", "h").agg(F.count("*").alias("n_pages"), F.min("doc_id").alias("first_doc"))
    return sizes.select("w", "h", "n_pages", "first_doc", F.round(P.grid_spacing(F.col("w"), F.lit(60.0)), 6).alias("dx"), F.round(P.grid_spacing(F.col("h"), F.lit(25.0)), 6).alias("dy"))


def q_only_translated(spark, sf_dir):
    p = _pages(spark, sf_dir)
    return p.select("doc_id", "page_no").exceptAll(p.where("page_no % 2 = 0").select("doc_id", "page_no"))


def q_coords(spark, sf_dir):
    w = _words(spark, sf_dir)
    return w.select("doc_id", "seq", P.image_to_page(F.col("x") - 1, F.lit(500)).alias("px"), P.image_to_page(F.col("y2") + 1, F.lit(552), F.lit(552)).alias("py"), F.round(P.unletterbox(F.col("x"), F.lit(1800.0), 1024), 6).alias("ux"))


def q_matrix(spark, sf_dir):
    li = S.table(spark, sf_dir, "lineitem")
    m = [F.col(c).cast("double") for c in ("l_quantity", "l_linenumber", "l_suppkey", "l_quantity", "l_partkey", "l_orderkey")]
    n = [F.lit(v) for v in (0.5, 0.25, -0.25, 0.5, 3.0, 4.0)]
    out = G.multiply(m, n)
    return li.select("l_orderkey", "l_linenumber", *[F.round(v, 4).alias(f"m{k}") for k, v in enumerate(out)], F.round(G.rotation(m[0], m[1]), 6).alias("angle"))


def _detections(spark, sf_dir):
    w = _words(spark, sf_dir)
    return w.select("doc_id", "page_no", F.col("seq").alias("det_id"), F.when(F.col("seq") % 2 == 0, "text").otherwise("paragraph_hybrid").alias("label"), (F.floor(F.col("x") / 60) * 60.0).alias("x"), F.col("y"), (F.floor(F.col("x") / 60) * 60.0 + 90 + F.col("n") % 3).alias("x2"), F.col("y2"), (F.col("seq") % 10 / F.lit(10.0)).alias("conf"))


def q_detect_rank(spark, sf_dir):
    return P.confident(_detections(spark, sf_dir)).select("doc_id", "page_no", "det_id", "place")


def q_detect_merge(spark, sf_dir):
    return P.grown_boxes(_detections(spark, sf_dir))


def q_scale_mode(spark, sf_dir):
    w = _words(spark, sf_dir).groupBy("doc_id", "row_no").agg(F.count("*").alias("n"))
    return P.modal_scale(w.select("doc_id", "row_no", "n", (F.lit(1.0) - F.col("n") % 4 / 10.0).alias("scale"))).select("doc_id", "row_no", F.round("mode_scale", 6).alias("mode_scale"), F.round("clamped", 6).alias("clamped"))


def q_xobject_tree(spark, sf_dir):
    S.table(spark, sf_dir, "nation").createOrReplaceTempView("quillframe_nodes")
    return spark.sql("""WITH RECURSIVE tree(root, node, depth) AS (
        SELECT CAST(n_nationkey AS BIGINT), CAST(n_nationkey AS BIGINT), 0 FROM quillframe_nodes WHERE n_nationkey < 3
        UNION ALL SELECT t.root, CAST(n.n_nationkey AS BIGINT), t.depth + 1 FROM tree t JOIN quillframe_nodes n ON (n.n_nationkey - 1) div 2 = t.node AND n.n_nationkey > 2 WHERE t.depth < 64)
        SELECT root, node, depth FROM tree""")


def _log(spark, sf_dir):
    e = S.table(spark, sf_dir, "events")
    return V.sequenced(e.select("event_id", "ts", F.col("user_id").alias("execution_id"), F.col("event_type").alias("type"), "value"))


def q_terminal(spark, sf_dir):
    return _log(spark, sf_dir).select("execution_id", "sequence", "event_id", "type")


def q_replay(spark, sf_dir):
    return V.retained(_log(spark, sf_dir), 5).where("sequence > 3").select("execution_id", "sequence", "event_id")


def q_replay_gap(spark, sf_dir):
    log = V.retained(_log(spark, sf_dir), 5)
    asks = S.table(spark, sf_dir, "events").select(F.col("user_id").alias("execution_id")).distinct().withColumn("after_seq", F.explode(F.array(F.lit(0), F.lit(2), F.lit(1000))))
    return V.replay_state(log, asks)


def q_throttle(spark, sf_dir):
    e = S.table(spark, sf_dir, "events").select("event_id", "ts", F.col("user_id").alias("execution_id"), F.col("event_type").alias("type"))
    return V.throttled(e, 86400)


def _used(spark):
    rows = [(p, k, n, w) for p in (1, 2) for k, (n, w) in enumerate(V.STAGES) if p == 1 or n not in ("table", "terms", "translate")]
    return V.weights(spark.createDataFrame(rows, "plan_id int, idx int, stage string, weight double"))


def q_stage_weights(spark, sf_dir):
    return _used(spark).select("plan_id", "stage", F.round("share", 9).alias("share"))


def q_progress(spark, sf_dir):
    e = S.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("execution_id")).agg(F.count("*").alias("n"))
    stages = F.broadcast(_used(spark).where("plan_id = 1"))  # thirteen rows
    done = e.join(stages, F.col("idx") <= F.col("n")).withColumn("fraction", F.least(F.lit(1.0), (F.col("n") - F.col("idx")) / 5.0))
    return V.overall(done).select("execution_id", F.round("percent", 6).alias("percent"))


def q_window_tumbling(spark, sf_dir):
    return V.tumbling(S.table(spark, sf_dir, "events").select("ts", F.col("event_type").alias("type"), "value"))


def q_session(spark, sf_dir):
    return V.sessions(S.table(spark, sf_dir, "events").select("ts", F.col("user_id").alias("execution_id")), 600).select("execution_id", "start", "last", "n")


QUERIES = {k: f for k, f in dict(globals()).items() if k.startswith("q_")}

_PAGES = "pg AS (SELECT doc_id, page_no, count(*) AS n_words, max(x2) AS w, max(y2) AS h FROM words GROUP BY ALL)"
_LOG = """o AS (SELECT event_id, ts, user_id AS execution_id, event_type AS type, value, row_number() OVER w AS sequence,
coalesce(max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
lg AS (SELECT * FROM o WHERE done = 0), kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY execution_id ORDER BY sequence DESC) AS r FROM lg) WHERE r <= 5)"""
_DET = """dt AS (SELECT doc_id, page_no, seq AS det_id, CASE WHEN seq % 2 = 0 THEN 'text' ELSE 'paragraph_hybrid' END AS label, floor(x / 60) * 60.0 AS x, y, floor(x / 60) * 60.0 + 90 + n % 3 AS x2, y2, (seq % 10 / 10.0)::DOUBLE AS conf FROM words)"""
_USED = "s AS (SELECT * FROM (VALUES " + ", ".join(f"({p}, {k}, '{n}', {w}::DOUBLE)" for p in (1, 2) for k, (n, w) in enumerate(V.STAGES) if p == 1 or n not in ("table", "terms", "translate")) + ") t(plan_id, idx, stage, weight)), sh AS (SELECT *, weight / sum(weight) OVER (PARTITION BY plan_id) AS share FROM s)"


def _grid(side: str, mark: float) -> str:
    fits = " ".join(f"WHEN floor({side} / ({mark} * {s})) >= 3 THEN {mark} * {s}" for s in (3.0, 2.5, 2.0, 1.5))
    fit = f"(CASE {fits} ELSE {mark} * 1.5 END)"
    return f"round({side} / nullif(floor({side} / {fit}), 0), 6)"


ORACLE = {
    "q_render_order": f"""WITH {WORDS}, u AS (SELECT doc_id, page_no, 0 AS kind_ord, seq AS idx, CASE WHEN seq % 3 > 0 THEN row_no END AS ro, seq AS so FROM words UNION ALL SELECT doc_id, page_no, 1, seq, row_no, n FROM words)
SELECT doc_id, page_no, kind_ord, idx, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY coalesce(ro, 9999999999999999), coalesce(so, 9999999999999999), kind_ord, idx) AS place FROM u""",
    "q_page_parts": f"WITH {WORDS}, {_PAGES} SELECT doc_id, page_no // 2 AS part_no, min(page_no) AS first_page, max(page_no) AS last_page, count(*) AS n_pages FROM pg GROUP BY ALL",
    "q_merge_parts": f"WITH {WORDS}, {_PAGES} SELECT doc_id, count(DISTINCT page_no // 2) AS n_parts, min(page_no) AS first_page, max(page_no) AS last_page, count(*) AS n_pages FROM pg GROUP BY doc_id",
    "q_dual_alternating": f"WITH {WORDS}, {_PAGES} SELECT doc_id, page_no, side, 2 * page_no + CASE WHEN side = 'original' THEN 0 ELSE 1 END AS slot FROM pg, (VALUES ('original'), ('translated')) t(side)",
    "q_dual_side": f"WITH {WORDS}, {_PAGES} SELECT doc_id, page_no, w + w AS w, h + 5 AS h FROM pg",
    "q_watermark_grid": f"WITH {WORDS}, {_PAGES} SELECT w, h, count(*) AS n_pages, min(doc_id) AS first_doc, {_grid('w', 60.0)} AS dx, {_grid('h', 25.0)} AS dy FROM pg GROUP BY w, h",
    "q_only_translated": f"WITH {WORDS}, {_PAGES} SELECT doc_id, page_no FROM pg WHERE page_no % 2 <> 0",
    "q_coords": f"""WITH {WORDS} SELECT doc_id, seq, greatest(0, least(trunc(x - 1)::INT, 499)) AS px, greatest(0, least(trunc(552 - (y2 + 1))::INT, 551)) AS py, round((x - round_even((1024.0 - 1800.0 * (1024.0::DOUBLE / 1800.0)) / 2 - 0.1, 0)) / (1024.0::DOUBLE / 1800.0), 6) AS ux FROM words""",
    "q_matrix": """SELECT l_orderkey, l_linenumber, round(l_quantity * 0.5 + l_suppkey * 0.25, 4) AS m0, round(l_linenumber * 0.5 + l_quantity * 0.25, 4) AS m1, round(l_quantity * -0.25 + l_suppkey * 0.5, 4) AS m2,
round(l_linenumber * -0.25 + l_quantity * 0.5, 4) AS m3, round(l_quantity * 3.0 + l_suppkey * 4.0 + l_partkey, 4)::DOUBLE AS m4, round(l_linenumber * 3.0 + l_quantity * 4.0 + l_orderkey, 4)::DOUBLE AS m5, round(degrees(atan2(l_linenumber, l_quantity)), 6) AS angle FROM lineitem""",
    "q_detect_rank": f"WITH {WORDS}, {_DET} SELECT doc_id, page_no, det_id, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY conf DESC, det_id) AS place FROM dt WHERE conf > 0.25",
    "q_detect_merge": f"""WITH {WORDS}, {_DET}, j AS (SELECT t.*, p.x AS px, p.y AS py, p.x2 AS px2, p.y2 AS py2 FROM dt t LEFT JOIN dt p ON p.label = 'paragraph_hybrid' AND p.doc_id = t.doc_id AND p.page_no = t.page_no AND p.y = t.y
AND greatest(0, least(t.x2, p.x2) - greatest(t.x, p.x)) * greatest(0, least(t.y2, p.y2) - greatest(t.y, p.y)) / ((t.x2 - t.x) * (t.y2 - t.y) + (p.x2 - p.x) * (p.y2 - p.y) - greatest(0, least(t.x2, p.x2) - greatest(t.x, p.x)) * greatest(0, least(t.y2, p.y2) - greatest(t.y, p.y))) > 0.95 WHERE t.label = 'text')
SELECT doc_id, page_no, det_id, least(x, coalesce(min(px), x))::DOUBLE AS x, least(y, coalesce(min(py), y))::DOUBLE AS y, greatest(x2, coalesce(max(px2), x2))::DOUBLE AS x2, greatest(y2, coalesce(max(py2), y2))::DOUBLE AS y2 FROM j GROUP BY doc_id, page_no, det_id, x, y, x2, y2""",
    "q_scale_mode": f"""WITH {WORDS}, r AS (SELECT doc_id, row_no, count(*) AS n FROM words GROUP BY ALL), s AS (SELECT *, 1.0::DOUBLE - (n % 4) / 10.0::DOUBLE AS scale FROM r), v AS (SELECT doc_id, scale, sum(n) AS v FROM s GROUP BY ALL),
m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY v DESC, scale) AS k FROM v) WHERE k = 1) SELECT s.doc_id, row_no, round(m.scale, 6) AS mode_scale, round(least(s.scale, m.scale), 6) AS clamped FROM s JOIN m ON m.doc_id = s.doc_id""",
    "q_xobject_tree": """WITH RECURSIVE tree(root, node, depth) AS (SELECT n_nationkey::BIGINT, n_nationkey::BIGINT, 0 FROM nation WHERE n_nationkey < 3
UNION ALL SELECT t.root, n.n_nationkey::BIGINT, t.depth + 1 FROM tree t JOIN nation n ON (n.n_nationkey - 1) // 2 = t.node AND n.n_nationkey > 2 WHERE t.depth < 64) SELECT root, node, depth FROM tree""",
    "q_terminal": f"WITH {_LOG} SELECT execution_id, sequence, event_id, type FROM lg",
    "q_replay": f"WITH {_LOG} SELECT execution_id, sequence, event_id FROM kept WHERE sequence > 3",
    "q_replay_gap": f"""WITH {_LOG}, st AS (SELECT execution_id, min(sequence) AS f, max(sequence) AS l FROM kept GROUP BY 1), a AS (SELECT DISTINCT user_id AS execution_id, after_seq FROM events, (VALUES (0), (2), (1000)) t(after_seq))
SELECT a.execution_id, after_seq, greatest(0, coalesce(l - greatest(after_seq, f - 1), 0))::INT AS n_events, coalesce(after_seq < f - 1, false) AS gap FROM a LEFT JOIN st ON st.execution_id = a.execution_id""",
    "q_throttle": "SELECT user_id AS execution_id, event_type AS type, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id, event_type, date_trunc('day', ts)",
    "q_stage_weights": f"WITH {_USED} SELECT plan_id, stage, round(share, 9) AS share FROM sh",
    "q_progress": f"""WITH {_USED}, e AS (SELECT user_id AS execution_id, count(*) AS n FROM events GROUP BY 1), j AS (SELECT execution_id, share, least(1.0::DOUBLE, (n - idx) / 5.0::DOUBLE) AS fr FROM e JOIN sh ON plan_id = 1 AND idx <= n)
SELECT execution_id, round(CASE WHEN min(fr) >= 1 THEN 100.0 ELSE sum(share * fr) * 100 END, 6)::DOUBLE AS percent FROM j GROUP BY 1""",
    "q_window_tumbling": "SELECT date_trunc('hour', ts)::TIMESTAMP AS start, event_type AS type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "q_session": """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 600 MINUTE THEN 0 ELSE 1 END AS f FROM events),
s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id AS execution_id, min(ts) AS start, max(ts) AS last, count(*) AS n FROM s GROUP BY user_id, s""",
}

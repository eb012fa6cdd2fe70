"""Driver queries over requests, queues, rates, results and small formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillframe.functions import strings as T
from quillframe.operators import glyphs as C
from quillframe.operators import layout as L
from quillframe.operators import pages as P
from quillframe.operators import service as V
from quillframe.operators import styles as Y
from quillframe.operators import text as X
from quillframe.plans.glyph_queries import _START
from quillframe.plans.layout_queries import PARAS, WORDS, _assigned, _paras, _words
from quillframe.plans.page_queries import _log
from quillframe.plans.text_queries import PARAS as TEXT_PARAS
from quillframe.plans.text_queries import _paras as _text_paras
from quillframe.sources import synthetic as S


def _timed(spark, sf_dir):
    e = S.table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("execution_id"), F.unix_timestamp("ts").cast("double").alias("at"), F.col("event_id").alias("seq"), F.col("event_type").alias("type"))


def q_send_times(spark, sf_dir):
    return V.send_times(_timed(spark, sf_dir), 0.0001, "execution_id").select("execution_id", "seq", F.round("send_at", 3).alias("send_at"))


def q_admitted(spark, sf_dir):
    r = _timed(spark, sf_dir).withColumn("lasts", F.col("seq") % 100 * 2000.0)
    return V.admitted(r, "execution_id").select("execution_id", "seq", "taken")


def q_in_flight(spark, sf_dir):
    return V.handed_on(_timed(spark, sf_dir).select("execution_id", "seq", (F.col("seq") % 100).cast("double").alias("lasts")), 3, "execution_id").select("execution_id", "seq", "yield_at")


def q_throttled_updates(spark, sf_dir):
    return V.passed(_timed(spark, sf_dir).withColumn("total", F.col("seq") % 20), 50000.0, "execution_id", "type").select("execution_id", "seq")


def q_closed_log(spark, sf_dir):
    return V.closed(_log(spark, sf_dir).where("event_id % 3 > 0"))


def q_retained(spark, sf_dir):
    from quillframe.operators.events import retained

    return retained(_log(spark, sf_dir), 7).select("execution_id", "sequence")


def q_incomplete_ends(spark, sf_dir):
    s = _timed(spark, sf_dir).groupBy("execution_id", "type").agg(F.count("*").alias("current"), (F.max("seq") % 20).alias("total"))
    return V.incomplete_ends(s)


def q_part_progress(spark, sf_dir):
    p = _timed(spark, sf_dir).groupBy("execution_id", F.col("type").alias("part")).agg((F.count("*") % 101).alias("percent")).withColumn("total_parts", F.lit(5))
    return V.part_progress(p).withColumn("percent", F.round("percent", 6))


def q_part_totals(spark, sf_dir):
    p = _timed(spark, sf_dir).groupBy("execution_id", (F.col("seq") % 4).alias("part_no")).agg(F.count("*").alias("seconds"), (F.max("seq") % 1000).alias("memory"))
    return V.part_totals(p).select("execution_id", "part_no", "peak", "seconds_all")


def q_window_sliding(spark, sf_dir):
    return V.sliding(S.table(spark, sf_dir, "events").select("ts", F.col("event_type").alias("type")))


def q_tracking(spark, sf_dir):
    p = _text_paras(spark, sf_dir).select("doc_id", "para_no", F.col("n_tokens"))
    pairs = p.where("para_no % 10 = 9").select("doc_id", F.col("para_no").alias("left_no"), (F.col("para_no") + 1).alias("right_no"))
    return V.tracking(p, pairs)


def q_toc(spark, sf_dir):
    toc = _text_paras(spark, sf_dir).where("para_no % 7 = 0").select("doc_id", F.lit(1).alias("level"), F.col("text").alias("title"), "page_no")
    slots = P.alternating(_text_paras(spark, sf_dir).select("doc_id", "page_no").distinct()).where("side = 'translated'")
    return V.moved_toc(toc, slots)


def q_checked_requests(spark, sf_dir):
    kind = F.col("doc_id") % 6
    body = F.when(kind == 0, "nonsense").when(kind == 1, '{"lang_out": "zh"}').when(kind == 2, '{"id": "a"}').when(kind == 3, '{"id": "a", "lang_out": "zh", "qps": -1}').when(kind == 4, F.concat(F.lit('{"id": "a", "lang_out": "'), "lang", F.lit('", "qps": 2.5}'))).otherwise('{"id": "a", "lang_out": "zh"}')
    return V.checked_requests(S.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("request_id"), body.alias("body")))


def q_response_boxes(spark, sf_dir):
    item = F.concat(F.lit('{"label": "text", "score": 0.5, "xyxy": ['), "page_id", F.lit(", 2, 30.5"), F.when(F.col("page_id") % 3 == 0, "").otherwise(", 8"), F.lit("]}"))
    body = F.concat(F.lit('{"boxes": ['), item, F.lit(', {"label": "title", "score": 0.9, "xyxy": [1, 2, 3, 4]}]}'))
    return V.boxes_of(S.table(spark, sf_dir, "pages").select("page_id", body.alias("body")))


def q_debug_fonts(spark, sf_dir):
    runs = F.concat(F.lit('[{"font": "F'), F.col("doc_id") % 9, F.lit('"}, {"size": 1}]'))
    body = F.concat(F.lit('{"paragraphs": [{"debug_id": "p'), "doc_id", F.lit('", "runs": '), runs, F.lit("}]}"))
    return V.fonts_by_id(S.table(spark, sf_dir, "documents").select(body.alias("body")), "^p[0-9]*7$")


def q_hocr(spark, sf_dir):
    return V.hocr(C.lines_of(_words(spark, sf_dir), "row_no")).select("doc_id", "page_no", F.md5("html").alias("html"))


def q_known_text(spark, sf_dir):
    return _text_paras(spark, sf_dir).select("doc_id", "para_no", V.known_text(F.col("text"), "a-z ").alias("text"))


def q_scan_gate(spark, sf_dir):
    """Pages as columns of 40 pixels (letters of each row), once with all words and once without those of digits and capitals."""
    w = _words(spark, sf_dir)
    rows = w.groupBy("doc_id", "page_no", "row_no").agg(F.sum("n").cast("double").alias("a"), F.coalesce(F.sum(F.when(F.col("font_id") == "f1", F.col("n"))), F.lit(0)).cast("double").alias("b"))
    pages = V.similarity(rows, "doc_id", "page_no", top=80.0).withColumn("flag", F.col("ssim") > 0.95)
    return P.scanned(pages)


def q_bands(spark, sf_dir):
    return V.banded(_words(spark, sf_dir), "doc_id", "page_no")


def q_table_pages(spark, sf_dir):
    """Pages that have a layout of tables, with its words."""
    lay = _words(spark, sf_dir).where("n > 12").select("doc_id", "page_no").distinct()
    return _words(spark, sf_dir).join(lay, ["doc_id", "page_no"], "left_semi").groupBy("doc_id", "page_no").agg(F.count("*").alias("n_words"))


def q_inherited(spark, sf_dir):
    n = S.table(spark, sf_dir, "documents").select((F.col("doc_id") + 1).alias("id"))
    return V.inherited(n.select("id", F.when(F.col("id") > 1, F.expr("id div 2")).alias("parent"), F.when(F.col("id") % 5 == 1, F.col("id")).alias("value")))


def q_skips(spark, sf_dir):
    """Why a paragraph is not sent: vertical, one formula alone, or none."""
    p = _paras(spark, sf_dir).select("doc_id", "page_no", "para_seq", "n_words", ((F.col("x2") - F.col("x")) * 3 < F.col("y2") - F.col("y")).alias("vertical"), Y.formula_start(F.col("text")).alias("formula"))
    return p.select("doc_id", "page_no", "para_seq", F.when(F.col("vertical"), "vertical").when((F.col("n_words") == 1) & F.col("formula"), "one formula").alias("why"))


def q_paragraph_heights(spark, sf_dir):
    """Characters of a paragraph besides those of formulas, and its highest unit."""
    g = L.islands(_assigned(spark, sf_dir))
    return g.groupBy("doc_id", "page_no", "para_seq").agg(F.coalesce(F.sum(F.when(~Y.formula_start(F.col("word")), F.col("n"))), F.lit(0)).alias("n_chars"), F.max(F.col("y2") - F.col("y")).alias("height"))


def q_stored_text(spark, sf_dir):
    d = S.table(spark, sf_dir, "documents").select("doc_id", X.zstd_packed(F.col("text")).alias("z"))
    return d.select("doc_id", F.sha2(X.zstd_unpacked(F.col("z")), 256).alias("hash"))


def q_plain_text(spark, sf_dir):
    return S.table(spark, sf_dir, "documents").select("doc_id", F.length(T.without_controls(F.concat("text", F.lit("\u0007​")))).alias("n"))


QUERIES = {k: f for k, f in dict(globals()).items() if k.startswith("q_")}

_TIMED = "t AS (SELECT user_id AS execution_id, epoch(date_trunc('second', ts))::DOUBLE AS tm, event_id AS seq, event_type AS type FROM events)"
_SEQ = """lg AS (SELECT user_id AS execution_id, row_number() OVER w AS sequence, event_id, event_type AS type, coalesce(max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), l AS (SELECT * FROM lg WHERE done = 0)"""

ORACLE = {
    "q_send_times": f"""WITH RECURSIVE {_TIMED}, o AS (SELECT *, row_number() OVER (PARTITION BY execution_id ORDER BY tm, seq) AS i FROM t),
s AS (SELECT execution_id, seq, i, tm AS send_at FROM o WHERE i = 1 UNION ALL SELECT o.execution_id, o.seq, o.i, greatest(o.tm, s.send_at + 10000) FROM s JOIN o ON o.execution_id = s.execution_id AND o.i = s.i + 1) SELECT execution_id, seq, round(send_at, 3) AS send_at FROM s""",
    "q_admitted": f"""WITH RECURSIVE {_TIMED}, o AS (SELECT *, row_number() OVER (PARTITION BY execution_id ORDER BY tm, seq) AS i FROM t),
s AS (SELECT execution_id, seq, i, true AS taken, tm + seq % 100 * 2000.0 AS free FROM o WHERE i = 1 UNION ALL SELECT o.execution_id, o.seq, o.i, o.tm >= s.free, CASE WHEN o.tm >= s.free THEN o.tm + o.seq % 100 * 2000.0 ELSE s.free END FROM s JOIN o ON o.execution_id = s.execution_id AND o.i = s.i + 1)
SELECT execution_id, seq, taken FROM s""",
    "q_in_flight": """WITH RECURSIVE o AS (SELECT user_id AS execution_id, event_id AS seq, (event_id % 100)::DOUBLE AS d, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
s AS (SELECT execution_id, seq, i, d AS y1, 0.0::DOUBLE AS y2, 0.0::DOUBLE AS y3 FROM o WHERE i = 1 UNION ALL SELECT o.execution_id, o.seq, o.i, greatest(s.y1, s.y3 + o.d), s.y1, s.y2 FROM s JOIN o ON o.execution_id = s.execution_id AND o.i = s.i + 1) SELECT execution_id, seq, y1 AS yield_at FROM s""",
    "q_throttled_updates": f"""WITH RECURSIVE {_TIMED}, o AS (SELECT *, row_number() OVER (PARTITION BY execution_id, type ORDER BY tm, seq) AS i FROM t),
s AS (SELECT execution_id, type, seq, i, true AS p, tm AS last FROM o WHERE i = 1 UNION ALL SELECT o.execution_id, o.type, o.seq, o.i, o.seq % 20 <= 3 OR o.tm - s.last >= 50000, CASE WHEN o.seq % 20 <= 3 OR o.tm - s.last >= 50000 THEN o.tm ELSE s.last END
FROM s JOIN o ON o.execution_id = s.execution_id AND o.type = s.type AND o.i = s.i + 1) SELECT execution_id, seq FROM s WHERE p""",
    "q_closed_log": f"""WITH {_SEQ}, k AS (SELECT execution_id, sequence, type FROM l WHERE event_id % 3 > 0)
SELECT * FROM k UNION ALL SELECT execution_id, max(sequence) + 1, 'missing_terminal' FROM k GROUP BY execution_id HAVING count(*) FILTER (type = 'error') = 0""",
    "q_retained": f"WITH {_SEQ} SELECT execution_id, sequence FROM (SELECT *, row_number() OVER (PARTITION BY execution_id ORDER BY sequence DESC) AS r FROM l) WHERE r <= 7",
    "q_incomplete_ends": f"WITH {_TIMED}, s AS (SELECT execution_id, type, count(*) AS current, max(seq) % 20 AS total FROM t GROUP BY ALL) SELECT *, current >= total AS emit, CASE WHEN current < total THEN current || ' of ' || total END AS warning FROM s",
    "q_part_progress": f"WITH {_TIMED}, p AS (SELECT execution_id, type, count(*) % 101 AS percent FROM t GROUP BY ALL) SELECT execution_id, round(sum(percent) / 5, 6)::DOUBLE AS percent FROM p GROUP BY 1",
    "q_part_totals": f"""WITH {_TIMED}, p AS (SELECT execution_id, seq % 4 AS part_no, count(*) AS s, max(seq) % 1000 AS memory FROM t GROUP BY ALL)
SELECT execution_id, part_no, max(memory) OVER (PARTITION BY execution_id ORDER BY part_no) AS peak, (sum(s) OVER (PARTITION BY execution_id))::BIGINT AS seconds_all FROM p""",
    "q_window_sliding": "SELECT start, event_type AS type, count(*) AS n FROM (SELECT event_type, date_trunc('hour', ts) - INTERVAL 1 HOUR * unnest([0, 1]) AS start FROM events) GROUP BY ALL",
    "q_tracking": f"""WITH {TEXT_PARAS}, a AS (SELECT doc_id, string_agg('{{"para_no":' || para_no || ',"n_tokens":' || n_tokens || '}}', ',' ORDER BY para_no) AS p, string_agg('{{"left_no":' || para_no || ',"right_no":' || (para_no + 1) || '}}', ',' ORDER BY para_no) FILTER (para_no % 10 = 9) AS c FROM paras GROUP BY 1)
SELECT doc_id, '{{"page":[' || p || '],"cross_page":[' || coalesce(c, '') || ']}}' AS json FROM a""",
    "q_toc": f"WITH {TEXT_PARAS} SELECT doc_id, 1 AS level, text AS title, (2 * page_no + 1) AS slot FROM paras WHERE para_no % 7 = 0",
    "q_checked_requests": """SELECT doc_id AS request_id, CASE doc_id % 6 WHEN 0 THEN 'no object' WHEN 1 THEN 'id' WHEN 2 THEN 'lang_out' WHEN 3 THEN 'qps' END AS wrong, CASE doc_id % 6 WHEN 4 THEN lang WHEN 5 THEN 'zh' END AS lang_out, CASE doc_id % 6 WHEN 4 THEN 2.5 WHEN 5 THEN 4.0 END::DOUBLE AS qps FROM documents""",
    "q_response_boxes": """SELECT page_id, 0 AS det_id, 'text' AS label, 0.5::DOUBLE AS score, page_id * 0.5::DOUBLE AS x, 1.0::DOUBLE AS y, 15.25::DOUBLE AS x2, 4.0::DOUBLE AS y2 FROM pages WHERE page_id % 3 <> 0
UNION ALL SELECT page_id, 1, 'title', 0.9, 0.5, 1.0, 1.5, 2.0 FROM pages""",
    "q_debug_fonts": "SELECT DISTINCT 'F' || doc_id % 9 AS font FROM documents WHERE doc_id % 10 = 7",
    "q_hocr": f"""WITH {WORDS}, l AS (SELECT doc_id, page_no, row_no, min(x) AS x, min(y) AS y, max(x2) AS x2, max(y2) AS y2, string_agg(word, ' ' ORDER BY seq) AS t FROM words GROUP BY ALL),
s AS (SELECT doc_id, page_no, y, '<span class=''ocr_line'' title=''bbox ' || x::BIGINT || ' ' || y::BIGINT || ' ' || x2::BIGINT || ' ' || y2::BIGINT || '''>' || replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</span>' AS h FROM l)
SELECT doc_id, page_no, md5('<div class=''ocr_page''>' || string_agg(h, '' ORDER BY y DESC) || '</div>') AS html FROM s GROUP BY ALL""",
    "q_known_text": f"WITH {TEXT_PARAS} SELECT doc_id, para_no, trim(regexp_replace(regexp_replace(nfc_normalize(text), '[^a-z ]', '', 'g'), ' +', ' ', 'g')) AS text FROM paras",
    "q_scan_gate": f"""WITH {WORDS}, r AS (SELECT doc_id, page_no, row_no, sum(n)::DOUBLE AS a, coalesce(sum(n) FILTER (font_id = 'f1'), 0)::DOUBLE AS b FROM words GROUP BY ALL),
s AS (SELECT doc_id, page_no, avg(a) AS ma, avg(b) AS mb, var_pop(a) AS va, var_pop(b) AS vb, covar_pop(a, b) AS ab FROM r GROUP BY ALL),
f AS (SELECT doc_id, (2 * ma * mb + 0.64) * (2 * ab + 5.76) / ((ma * ma + mb * mb + 0.64) * (va + vb + 5.76)) > 0.95 AS flag FROM s)
SELECT doc_id, count(*) AS n_pages, count(*) > 1 AND count(*) FILTER (flag) >= greatest(0.8 * count(*), 1) AS scanned FROM f GROUP BY doc_id""",
    "q_bands": f"WITH {WORDS} SELECT doc_id, page_no, seq, y, y2, (dense_rank() OVER (PARTITION BY doc_id, page_no ORDER BY row_no) - 1)::INT AS band FROM words",
    "q_table_pages": f"WITH {WORDS} SELECT doc_id, page_no, count(*) AS n_words FROM words GROUP BY ALL HAVING max(n) > 12",
    "q_inherited": """WITH RECURSIVE n AS (SELECT doc_id + 1 AS id FROM documents), t AS (SELECT id, id AS up FROM n UNION ALL SELECT t.id, n.id FROM t JOIN n ON n.id = t.up // 2 WHERE t.up % 5 <> 1)
SELECT id, max(CASE WHEN up % 5 = 1 THEN up END) AS value FROM t GROUP BY id""",
    "q_skips": f"""WITH {PARAS}, f AS (SELECT *, text AS word FROM paras) SELECT doc_id, page_no, para_seq, CASE WHEN (x2 - x) * 3 < y2 - y THEN 'vertical' WHEN n_words = 1 AND {_START} THEN 'one formula' END AS why FROM f""",
    "q_paragraph_heights": f"WITH {PARAS} SELECT doc_id, page_no, para_seq, coalesce(sum(n) FILTER (NOT {_START}), 0)::BIGINT AS n_chars, max(y2 - y) AS height FROM grouped GROUP BY ALL",
    "q_stored_text": "SELECT doc_id, sha256(text) AS hash FROM documents",
    "q_plain_text": "SELECT doc_id, length(replace(replace(replace(text, chr(10), ''), chr(9), ''), chr(13), ''))::INT AS n FROM documents",
}

"""Driver queries over paragraphs: gates, glossary, batches, answers, prompts, memo."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillframe.operators import text as X
from quillframe.session import EngineConf
from quillframe.sources import synthetic as S

PARAS = r"""
ln AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS para_no, unnest(string_split(text, chr(10))) AS text FROM documents),
paras AS (SELECT doc_id, para_no::INT AS para_no, text, para_no // 10 AS page_no, CASE WHEN para_no = 0 THEN 'title' ELSE 'plain text' END AS label,
  len(regexp_extract_all(text, '[A-Za-z]+|[0-9]+|[^ \t\n\rA-Za-z0-9]')) AS n_tokens FROM ln WHERE text <> '')"""


def _paras(spark, sf_dir):
    return S.paragraphs(S.table(spark, sf_dir, "documents"))


def q_cid_gate(spark, sf_dir):
    docs = S.table(spark, sf_dir, "documents")
    each = docs.select("doc_id", F.explode(F.split("text", " ")).alias("w")).select("doc_id", F.when(F.length("w") % 5 == F.col("doc_id") % 5, F.concat(F.lit("(cid:"), F.length("w"), F.lit(")"))).otherwise(F.col("w")).alias("w"))
    return X.cid_gate(each, "doc_id", "w", 0.2).select("doc_id", F.round("cid_share", 6).alias("cid_share"), "rejected")


def q_numeric_only(spark, sf_dir):
    words = F.posexplode(F.regexp_extract_all("text", F.lit(r"(-?[0-9][0-9.]*|[a-z]+)"), 1)).alias("word_no", "t")
    t = S.table(spark, sf_dir, "conversations").select("conv_id", "turn", words)
    return t.select("conv_id", "turn", "word_no", X.is_numeric(F.col("t")).alias("numeric"), X.is_digits_or_space(F.col("t")).alias("digits"))


def q_candidates(spark, sf_dir):
    done = S.table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id", F.lit(1).alias("para_no"))
    return X.candidates(_paras(spark, sf_dir), done, EngineConf.of(spark).min_text_length).select("doc_id", "para_no", "n_tokens")


def q_page_ranges(spark, sf_dir):
    specs = spark.createDataFrame([(1, "1,2,4-"), (2, "-3"), (3, "2-3"), (4, ""), (5, None)], "spec_id int, spec string")
    pages = _paras(spark, sf_dir).groupBy("doc_id").agg(F.max("page_no").alias("last"))
    each = pages.select("doc_id", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("page_no"))
    ranged = F.broadcast(specs.withColumn("r", X.page_ranges(F.col("spec"))))  # five rows
    return each.withColumn("spec_id", F.explode(F.array(*map(F.lit, range(1, 6))))).join(ranged, "spec_id").where(X.page_selected(F.col("page_no") + 1, F.col("r"))).select("spec_id", "doc_id", "page_no")


def q_first_title(spark, sf_dir):
    return _paras(spark, sf_dir).groupBy("doc_id").agg(F.min_by("text", F.when(F.col("label") == "title", F.col("para_no"))).alias("title"))


def q_title_asof(spark, sf_dir):
    from pyspark.sql import Window

    order = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    t = S.table(spark, sf_dir, "conversations").withColumn("title", F.when(F.col("role") == "user", F.col("text")))
    return t.select("conv_id", "turn", F.last("title", ignorenulls=True).over(order).alias("recent_title"))


def q_batches(spark, sf_dir):
    conf = EngineConf.of(spark)
    return X.batches(_paras(spark, sf_dir), conf.batch_tokens, conf.batch_items)


def q_term_batches(spark, sf_dir):
    conf = EngineConf.of(spark)
    return X.batches(_paras(spark, sf_dir), conf.term_tokens, conf.term_items)


def q_priority(spark, sf_dir):
    sums = X.batches(_paras(spark, sf_dir), 200, 5).join(_paras(spark, sf_dir), ["doc_id", "para_no"]).groupBy("doc_id", "batch").agg(F.sum("n_tokens").alias("n"))
    return sums.select("doc_id", "batch", (F.lit(1048576) - F.col("n")).alias("priority"))


def q_glossary_dedupe(spark, sf_dir):
    t = S.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("seq"), F.substring_index("text", " ", 2).alias("source"))
    return X.deduplicated_terms(t.unionByName(t.select((F.col("seq") + 100000).alias("seq"), F.upper("source").alias("source")))).select("seq", "norm")


def q_glossary_lang(spark, sf_dir):
    t = S.table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 4 == 0, "").when(F.col("doc_id") % 4 == 1, F.concat(F.lit(" "), F.upper("lang"), F.lit("-XX"))).otherwise(F.col("lang")).alias("tgt_lng"))
    return t.where(X.language_fits(F.col("tgt_lng"), F.lit("de_xx")) | X.language_fits(F.col("tgt_lng"), F.lit("fr")))


def q_glossary_match(spark, sf_dir):
    terms = S.table(spark, sf_dir, "benchmark").select(F.substring_index("text", " ", 3).alias("term")).distinct()
    return X.matched_terms(S.table(spark, sf_dir, "documents"), terms)


def q_term_vote(spark, sf_dir):
    docs = S.table(spark, sf_dir, "documents")
    pairs = docs.select(F.col("doc_id").alias("seq"), F.split_part("text", F.lit(" "), F.lit(1)).alias("src"), F.split_part("text", F.lit(" "), F.lit(2)).alias("tgt"))
    return X.voted(pairs)


def q_placeholder_counts(spark, sf_dir):
    t = _tokenized(spark, sf_dir)
    return X.placeholder_counts(t)


def _tokenized(spark, sf_dir):
    docs = S.table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.regexp_replace(F.regexp_replace("text", "the ", "{v1} "), "and ", "<style id='2'>x</style> ").alias("text"))


def q_output_parse(spark, sf_dir):
    t = _tokenized(spark, sf_dir).select("doc_id", F.regexp_replace("text", r"\{v1\}", "{ V1 }").alias("text"))
    return t.select("doc_id", F.array_join(X.token_stream(F.col("text")), "|").alias("stream"))


def q_request_json(spark, sf_dir):
    paras = _paras(spark, sf_dir)
    rows = X.batches(paras, 200, 5).join(paras, ["doc_id", "para_no"])
    return X.requests(rows).select("doc_id", "batch", "n", F.get_json_object("request", "$[0].input").alias("first_input"), F.get_json_object("request", "$[0].layout_label").alias("first_label"))


def q_answer_parse(spark, sf_dir):
    docs = S.table(spark, sf_dir, "documents").select("doc_id", F.substring("lang", 1, 2).alias("v"))
    raw = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('```json[{"id":0,"output":"'), "v", F.lit('"},{"id":1,"input":"b"}]```'))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit('<json>{"id":7,"output":"'), "v", F.lit('"}</json>'))).otherwise("not json")
    return docs.select("doc_id", F.explode_outer(X.parsed_answers(raw)).alias("a")).select("doc_id", F.col("a.id").alias("id"), F.col("a.text").alias("text"))


def _pairs(spark, sf_dir):
    p = _paras(spark, sf_dir)
    source, kind = F.col("text"), F.col("para_no") % 5
    target = F.when(kind == 0, source).when(kind == 1, F.concat(F.lit("Xy"), F.substring("text", 3, 1 << 30))).when(kind == 2, F.substring("text", 1, 3)).when(kind == 3, F.reverse("text"))
    return p.withColumn("target", target).withColumn("n_target", S.tokens(F.col("target")))


def q_accept(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    return p.select("doc_id", "para_no", X.reason(F.col("text"), F.col("target"), F.col("n_tokens"), F.col("n_target")).alias("reason"))


def q_usage_counters(spark, sf_dir):
    p = _pairs(spark, sf_dir).withColumn("reason", X.reason(F.col("text"), F.col("target"), F.col("n_tokens"), F.col("n_target")))
    return p.groupBy("page_no").agg(F.count("*").alias("total"), F.count_if(F.col("reason") == "ok").alias("ok"), F.count_if(F.col("reason") != "ok").alias("fallback"), F.sum("n_tokens").alias("prompt_tokens"), F.coalesce(F.sum("n_target"), F.lit(0)).alias("completion_tokens"))


def q_memo(spark, sf_dir):
    c = S.table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.col("role").alias("engine"), F.lit("{}").alias("params_json"), F.split_part("text", F.lit(" "), F.lit(1)).alias("text"), F.concat(F.lit("t:"), F.col("text")).alias("translation"), "turn")
    memo = X.memo_latest(c.where("turn % 2 = 0").drop("turn"))
    return X.memo_joined(c.drop("translation", "turn"), memo).select("id", "translation", "hit")


def q_prompt(spark, sf_dir):
    p = _paras(spark, sf_dir)
    title = p.where("label = 'title'").select("doc_id", F.col("text").alias("title"))
    rows = p.join(title, "doc_id", "left")
    return rows.select("doc_id", "para_no", F.sha2(X.prompt("zh", F.col("title"), F.when(F.col("doc_id") % 2 == 0, "a=b").otherwise(""), F.col("text")), 256).alias("prompt_hash"))


def q_language_totals(spark, sf_dir):
    return S.table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum("n_chars").alias("n_chars"), F.sum(S.tokens(F.col("text"))).alias("n_tokens"))


def q_quarantine(spark, sf_dir):
    docs, labels = S.table(spark, sf_dir, "documents").select("doc_id", "n_chars"), S.table(spark, sf_dir, "labels")
    why = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "quality").when(F.col("n_chars") < 50, "short")
    return docs.join(labels, "doc_id", "left").select("doc_id", why.alias("why")).where("why IS NOT NULL")


QUERIES = {k: f for k, f in dict(globals()).items() if k.startswith("q_")}

_TOK = r"len(regexp_extract_all({}, '[A-Za-z]+|[0-9]+|[^ \t\n\rA-Za-z0-9]'))"


def _batches(tokens: int, items: int) -> str:
    return f"""r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY para_no) AS i FROM paras),
b AS (SELECT doc_id, para_no, i, 0::BIGINT AS batch, CASE WHEN n_tokens > {tokens} THEN 0 ELSE n_tokens END AS s, CASE WHEN n_tokens > {tokens} THEN 0 ELSE 1 END AS n, n_tokens > {tokens} AS closed FROM r WHERE i = 1
UNION ALL SELECT r.doc_id, r.para_no, r.i, b.batch + CASE WHEN b.closed THEN 1 ELSE 0 END, CASE WHEN b.s + r.n_tokens > {tokens} OR b.n + 1 > {items} THEN 0 ELSE b.s + r.n_tokens END,
CASE WHEN b.s + r.n_tokens > {tokens} OR b.n + 1 > {items} THEN 0 ELSE b.n + 1 END, b.s + r.n_tokens > {tokens} OR b.n + 1 > {items}
FROM b JOIN r ON r.doc_id = b.doc_id AND r.i = b.i + 1)"""


_PAIRS = f"""p AS (SELECT *, CASE para_no % 5 WHEN 0 THEN text WHEN 1 THEN 'Xy' || substr(text, 3) WHEN 2 THEN substr(text, 1, 3) WHEN 3 THEN reverse(text) END AS target FROM paras),
j AS (SELECT *, {_TOK.format('target')} AS n_target FROM p),
z AS (SELECT *, CASE WHEN target IS NULL THEN 'missing' WHEN text = target AND n_tokens > 10 THEN 'same' WHEN n_tokens = 0 THEN 'error'
  WHEN n_target::DOUBLE / n_tokens <= 0.3 OR n_target::DOUBLE / n_tokens >= 3 THEN 'ratio' WHEN n_tokens > 20 AND levenshtein(text, target) < 5 THEN 'near' ELSE 'ok' END AS reason FROM j)"""
_TOKENIZED = "(SELECT doc_id, replace(replace(text, 'the ', '{v1} '), 'and ', '<style id=''2''>x</style> ') AS text FROM documents)"

ORACLE = {
    "q_cid_gate": """WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents), c AS (SELECT doc_id, avg(CASE WHEN length(w) % 5 = doc_id % 5 OR regexp_matches(w, '^\\(cid:[0-9]+\\)$') THEN 1.0 ELSE 0.0 END) AS s FROM w GROUP BY 1)
SELECT doc_id, round(s, 6) AS cid_share, s > 0.2 AS rejected FROM c""",
    "q_numeric_only": r"""WITH l AS (SELECT conv_id, turn, regexp_extract_all(text, '(-?[0-9][0-9.]*|[a-z]+)', 1) AS ts FROM conversations), t AS (SELECT conv_id, turn, (generate_subscripts(ts, 1) - 1)::INT AS word_no, unnest(ts) AS t FROM l)
SELECT conv_id, turn, word_no, regexp_matches(trim(t), '^-?[0-9]+(\.[0-9]+)?$') AS numeric, regexp_matches(t, '^[0-9\s]*$') AS digits FROM t""",
    "q_candidates": f"""WITH {PARAS} SELECT doc_id, para_no, n_tokens FROM paras p WHERE length(text) >= 5 AND label = 'plain text' AND NOT regexp_matches(trim(text), '^-?[0-9]+(\\.[0-9]+)?$') AND NOT contains(text, '(cid:')
AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.toxic = 1 AND l.doc_id = p.doc_id AND p.para_no = 1)""",
    "q_page_ranges": f"""WITH {PARAS}, l AS (SELECT doc_id, max(page_no) AS last FROM paras GROUP BY 1), e AS (SELECT doc_id, unnest(range(0, last + 1)) AS page_no FROM l),
s AS (SELECT * FROM (VALUES (1, 1, 1), (1, 2, 2), (1, 4, 1000000), (2, 1, 3), (3, 2, 3), (5, 0, 1000000)) t(spec_id, a, b))
SELECT DISTINCT spec_id, doc_id, page_no FROM e JOIN s ON page_no + 1 BETWEEN a AND b""",
    "q_first_title": f"WITH {PARAS} SELECT doc_id, arg_min(text, para_no) FILTER (label = 'title') AS title FROM paras GROUP BY 1",
    "q_title_asof": "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS recent_title FROM conversations",
    "q_batches": f"WITH RECURSIVE {PARAS}, {_batches(200, 5)} SELECT doc_id, para_no, batch FROM b",
    "q_term_batches": f"WITH RECURSIVE {PARAS}, {_batches(600, 12)} SELECT doc_id, para_no, batch FROM b",
    "q_priority": f"WITH RECURSIVE {PARAS}, {_batches(200, 5)} SELECT b.doc_id, batch, (1048576 - sum(n_tokens))::BIGINT AS priority FROM b JOIN paras p ON p.doc_id = b.doc_id AND p.para_no = b.para_no GROUP BY ALL",
    "q_glossary_dedupe": """WITH t AS (SELECT item_id AS seq, array_to_string(string_split(text, ' ')[1:2], ' ') AS source FROM benchmark), u AS (SELECT * FROM t UNION ALL SELECT seq + 100000, upper(source) FROM t),
n AS (SELECT seq, trim(regexp_replace(lower(source), '\\s+', ' ', 'g')) AS norm FROM u) SELECT min(seq) AS seq, norm FROM n GROUP BY norm""",
    "q_glossary_lang": """WITH t AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN ' ' || upper(lang) || '-XX' ELSE lang END AS tgt_lng FROM documents)
SELECT * FROM t WHERE trim(tgt_lng) = '' OR replace(lower(trim(tgt_lng)), '-', '_') IN ('de_xx', 'fr')""",
    "q_glossary_match": """WITH t AS (SELECT DISTINCT array_to_string(string_split(text, ' ')[1:3], ' ') AS term FROM benchmark),
f AS (SELECT doc_id, translate(regexp_replace(text, '\\s+', ' ', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS f FROM documents)
SELECT DISTINCT doc_id, term FROM f JOIN t ON contains(f, translate(term, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))""",
    "q_term_vote": """WITH p AS (SELECT doc_id AS seq, split_part(text, ' ', 1) AS src, split_part(text, ' ', 2) AS tgt FROM documents),
v AS (SELECT src, tgt, count(*) AS n, min(seq) AS f FROM p WHERE src <> '' AND tgt <> '' AND length(src) < 100 AND NOT (src = tgt AND length(src) < 3) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY n DESC, f) AS r FROM v) SELECT src, tgt, n AS votes FROM r WHERE r = 1""",
    "q_placeholder_counts": f"WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '(\\{{v[0-9]+\\}}|</?style[^>]*>)')) AS token FROM {_TOKENIZED}) SELECT doc_id, token, count(*) AS n FROM t GROUP BY ALL",
    "q_output_parse": f"SELECT doc_id, array_to_string(list_transform(regexp_extract_all(replace(text, '{{v1}}', '{{ V1 }}'), '(?i)(\\{{ *v *[0-9]+ *\\}}|< */? *style[^>]*>)'), lambda t: lower(replace(t, ' ', ''))), '|') AS stream FROM {_TOKENIZED}",
    "q_request_json": f"WITH RECURSIVE {PARAS}, {_batches(200, 5)} SELECT b.doc_id, batch, count(*)::INT AS n, arg_min(p.text, p.para_no) AS first_input, arg_min(p.label, p.para_no) AS first_label FROM b JOIN paras p ON p.doc_id = b.doc_id AND p.para_no = b.para_no GROUP BY ALL",
    "q_answer_parse": """SELECT doc_id, 0::BIGINT AS id, lang[1:2] AS text FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 1, 'b' FROM documents WHERE doc_id % 3 = 0
UNION ALL SELECT doc_id, 7, lang[1:2] FROM documents WHERE doc_id % 3 = 1 UNION ALL SELECT doc_id, NULL, NULL FROM documents WHERE doc_id % 3 = 2""",
    "q_accept": f"WITH {PARAS}, {_PAIRS} SELECT doc_id, para_no, reason FROM z",
    "q_usage_counters": f"""WITH {PARAS}, {_PAIRS} SELECT page_no, count(*) AS total, count(*) FILTER (reason = 'ok') AS ok, count(*) FILTER (reason <> 'ok') AS fallback, sum(n_tokens)::BIGINT AS prompt_tokens, coalesce(sum(n_target), 0)::BIGINT AS completion_tokens FROM z GROUP BY 1""",
    "q_memo": """WITH c AS (SELECT conv_id * 100 + turn AS id, turn, role AS engine, split_part(text, ' ', 1) AS text, 't:' || text AS translation FROM conversations),
m AS (SELECT engine, text, arg_max(translation, id) AS translation FROM c WHERE turn % 2 = 0 GROUP BY ALL)
SELECT c.id, m.translation, m.translation IS NOT NULL AS hit FROM c LEFT JOIN m ON m.engine = c.engine AND m.text = c.text""",
    "q_prompt": f"""WITH {PARAS}, t AS (SELECT doc_id, text AS title FROM paras WHERE label = 'title')
SELECT p.doc_id, p.para_no, sha256('Translate every input into zh. Keep all placeholders.' || coalesce(chr(10) || chr(10) || 'Title: ' || title, '') || CASE WHEN p.doc_id % 2 = 0 THEN chr(10) || chr(10) || 'Terms: a=b' ELSE '' END || chr(10) || chr(10) || 'Inputs: ' || text) AS prompt_hash
FROM paras p LEFT JOIN t ON t.doc_id = p.doc_id""",
    "q_language_totals": f"SELECT lang, count(*) AS n_docs, sum(n_chars)::BIGINT AS n_chars, sum({_TOK.format('text')})::BIGINT AS n_tokens FROM documents GROUP BY 1",
    "q_quarantine": """SELECT * FROM (SELECT d.doc_id, CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 0 THEN 'quality' WHEN n_chars < 50 THEN 'short' END AS why FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id) WHERE why IS NOT NULL""",
}

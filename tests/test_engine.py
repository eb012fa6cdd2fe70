"""Operators on small rows, and the driver's queries against DuckDB at the smallest size."""

import json
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillframe.functions import geometry as G
from quillframe.functions import labels
from quillframe.operators import events as V
from quillframe.operators import folds as O
from quillframe.operators import layout as L
from quillframe.operators import pages as P
from quillframe.operators import styles as Y
from quillframe.operators import text as X
from quillframe.plans import catalogue
from quillframe.sources import files
from quillframe.sources import synthetic as S
from quillframe.streaming import progress

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(f"{v:.9g}" if isinstance(v, float) else repr(v) for v in (r[i] for i in order)) for r in rows)


@pytest.fixture(scope="module")
def few(sf, tmp_path_factory):
    """Tables of few rows, so that every query can be checked here; the driver checks them on whole tables."""
    folder = tmp_path_factory.mktemp("few")
    most = {"documents": 30, "pages": 20, "conversations": 60, "events": 400, "lineitem": 600, "orders": 300}
    for t in TABLES:
        duckdb.sql(f"COPY (SELECT * FROM '{sf}/{t}.parquet' USING SAMPLE reservoir({most.get(t, 1000)} ROWS) REPEATABLE (7)) TO '{folder}/{t}.parquet'")
    return str(folder)


@pytest.mark.parametrize("name", [n for n in sorted(catalogue.QUERIES) if n in catalogue.ORACLE])
def test_query_equals_sql(spark, few, name):
    duck = duckdb.connect()
    for t in TABLES:
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{few}/{t}.parquet'")
    df = catalogue.QUERIES[name](spark, few)
    got = duck.sql(catalogue.ORACLE[name])
    assert sorted(df.columns) == sorted(got.columns)
    assert plain(df.collect(), df.columns) == plain(got.fetchall(), got.columns)


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_order_does_not_matter(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    a = S.words(docs).select("doc_id", "seq", "x", "y", "page_no").collect()
    b = S.words(docs.repartition(7, "source")).select("doc_id", "seq", "x", "y", "page_no").collect()
    assert Counter(a) == Counter(b)


def test_layout_priority_beats_overlap(spark):
    word = spark.createDataFrame([(1, 0, 1, 0.0, 0.0, 10.0, 10.0)], "doc_id long, page_no long, seq int, x double, y double, x2 double, y2 double")
    boxes = [(1, 0, 0, "plain text", 0.0, 0.0, 10.0, 10.0), (1, 0, 1, "title", 8.0, 8.0, 20.0, 20.0), (1, 0, 2, "no such label", 0.0, 0.0, 50.0, 50.0)]
    lay = spark.createDataFrame(boxes, "doc_id long, page_no long, layout_id int, label string, lx double, ly double, lx2 double, ly2 double")
    assert L.assigned(word, lay).first().label == "title"
    assert L.assigned(word, lay.where("layout_id <> 1")).first().label == "plain text"
    assert L.assigned(word, lay.where("layout_id > 5")).first().label is None
    assert labels.rank("number") == 0 and labels.rank("nonsense") == len(labels.PRIORITY)


def test_page_ranges(spark):
    df = spark.createDataFrame([("1,2,4-",), ("-3",), ("3-5",), ("",), (None,)], "s string").select("s", X.page_ranges(F.col("s")).alias("r"))
    got = {r.s: None if r.r is None else [tuple(x) for x in r.r] for r in df.collect()}
    assert got == {"1,2,4-": [(1, 1), (2, 2), (4, None)], "-3": [(1, 3)], "3-5": [(3, 5)], "": [], None: None}
    hits = df.select("s", X.page_selected(F.lit(4), F.col("r")).alias("h")).collect()
    assert {r.s: r.h for r in hits} == {"1,2,4-": True, "-3": False, "3-5": True, "": False, None: True}


def test_answer_reasons(spark):
    rows = [("a b", None, 3, 0, "missing"), ("x", "x", 11, 11, "same"), ("x", "x", 10, 10, "ok"), ("q", "w", 10, 3, "ratio"), ("q" * 9, "w" * 9, 100, 31, "ok"), ("q" * 9, "w" * 9, 10, 30, "ratio"), ("qqqqq", "qqqq", 21, 20, "near"), ("qqqqq", "qqqq", 20, 20, "ok"), ("a", "b", 0, 1, "error")]
    df = spark.createDataFrame(rows, "s string, t string, n long, m long, want string")
    for r in df.select("want", X.reason(F.col("s"), F.col("t"), F.col("n"), F.col("m")).alias("got")).collect():
        assert r.got == r.want


def test_answers_parse(spark):
    rows = [('{"id": 3, "output": "x"}',), ('```json\n[{"id": 0, "input": "y"}]\n```',), ("<json>[]</json>",), ("garbage",)]
    got = [r[0] for r in spark.createDataFrame(rows, "s string").select(X.parsed_answers(F.col("s"))).collect()]
    assert [tuple(x) for x in got[0]] == [(3, "x")] and [tuple(x) for x in got[1]] == [(0, "y")] and got[2] == [] and got[3] is None


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(0, 400), min_size=1, max_size=30))
def test_batches_close_over_the_limit(spark, sizes):
    df = spark.createDataFrame([(1, k, n) for k, n in enumerate(sizes)], "doc_id long, para_no int, n_tokens long")
    got = [r.batch for r in X.batches(df, 200, 5).orderBy("para_no").collect()]
    want, batch, total, count = [], 0, 0, 0
    for n in sizes:
        want.append(batch)
        total, count = total + n, count + 1
        if total > 200 or count > 5:
            batch, total, count = batch + 1, 0, 0
    assert got == want


def test_comma_groups(spark):
    rows = [("a", i, c) for i, c in enumerate("a,,b")] + [("b", i, c) for i, c in enumerate("(a,b),c")]
    got = Y.comma_groups(spark.createDataFrame(rows, "key string, seq int, c string")).orderBy("key", "seq").collect()
    groups = {}
    for r in got:
        groups.setdefault((r.key, r.part), []).append(r.c)
    assert ["".join(v) for v in groups.values()] == ["a", "b", "(a,b)", "c"]


def test_votes_and_modes_break_ties(spark):
    pairs = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "b", "z"), (4, "c", "c")], "seq long, src string, tgt string")
    assert {r.src: r.tgt for r in X.voted(pairs).collect()} == {"a": "x", "b": "z"}
    units = spark.createDataFrame([(1, 1.0, 3), (1, 0.8, 3), (1, 0.9, 1)], "doc_id long, scale double, n long")
    assert sorted(r.clamped for r in P.modal_scale(units).collect()) == [0.8, 0.8, 0.8]


def test_scan_gate_and_spacing(spark):
    pages = spark.createDataFrame([(1, True), (2, True), (2, True), (3, True), (3, False)], "doc_id long, flag boolean")
    assert {r.doc_id: r.scanned for r in P.scanned(pages).collect()} == {1: False, 2: True, 3: False}
    got = spark.range(1).select(P.grid_spacing(F.lit(600.0), F.lit(60.0)), P.grid_spacing(F.lit(100.0), F.lit(60.0)), G.iou((F.lit(0.0),) * 2 + (F.lit(2.0),) * 2, (F.lit(1.0), F.lit(0.0), F.lit(2.0), F.lit(2.0)))).first()
    assert tuple(got) == (200.0, 100.0, 0.5)


def test_merges_and_separation():
    assert O.merge_boxes([[0, 0, 5, 5], [6, 0, 9, 5], [30, 0, 35, 5], [10, 0, 29, 5]], O.touching) == [[0, 1, 3, 2]]
    rng = np.random.default_rng(2)
    for _ in range(30):
        boxes = [[x, y, x + w, y + h] for x, y, w, h in zip(rng.uniform(0, 60, 15), rng.uniform(0, 30, 15), rng.uniform(2, 12, 15), rng.uniform(4, 10, 15), strict=True)]
        groups = [(list(b), [k]) for k, b in enumerate(boxes)]
        while hit := next(((i, j) for i in range(len(groups)) for j in range(i + 1, len(groups)) if O.touching(np.array(groups[i][0]), np.array([groups[j][0]]))[0]), None):
            (a, ia), (b, ib) = groups[hit[0]], groups.pop(hit[1])
            groups[hit[0]] = ([min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])], ia + ib)
        assert O.merge_boxes(boxes, O.touching) == [i for _, i in groups] and O.any_touch(np.array(boxes)) == (len(groups) < 15)
    boxes = O.separate([[0, 0, 10, 10], [0, 8, 10, 20]])
    assert boxes[0][3] < boxes[1][1]
    assert O.absorbed([(1, "t", False), (2, "n", True), (3, "t", False), (4, "t", False), (5, "u", False)]) == [1, 2, 1, 1, 5]
    assert O.absorbed([(1, "t", False), (2, "t", False)]) == [1, 2]
    rng = np.random.default_rng(1)
    for n in (1, 2, 60):
        x, y = rng.uniform(0, 100, n), rng.uniform(0, 100, n)
        want = np.arange(n)
        for _ in range(n):
            for i in range(n):
                for j in range(n):
                    if abs(x[i] - x[j]) + abs(y[i] - y[j]) <= 12:
                        want[i] = want[j] = min(want[i], want[j])
        assert O.components_of(x, y, 12.0, at_once=50).tolist() == want.tolist()


def slow_lines(widths, wide, high, scale, skip=1.3, em=10.0):
    """Units one by one; None if they need more height."""
    x = y = 0.0
    for w in widths:
        if x > 0 and x + w * scale > wide + 1e-9:
            x, y = 0.0, y + em * scale * skip
        if y + em * scale > high + 1e-9:
            return None
        x += w * scale + 0.5 * em * scale
    return round(y / (em * scale * skip)) + 1


@given(st.lists(st.integers(1, 14), min_size=1, max_size=60), st.integers(60, 500), st.integers(10, 400))
def test_typesetting_by_brute_force(letters, wide, high):
    widths = [6.0 * n for n in letters]
    steps = 20
    while steps > 2 and slow_lines(widths, wide, high, steps / 20) is None:
        steps -= 1 if steps / 20 > 0.6 else 2
    scale, lines, fits = O.fitted(np.array(widths), wide, high)
    want = slow_lines(widths, wide, high, steps / 20)
    assert scale == steps / 20 and fits == (want is not None) and (want is None or lines == want)


def test_replay_and_gap(spark):
    log = spark.createDataFrame([(1, k) for k in range(4, 9)], "execution_id long, sequence int")
    asks = spark.createDataFrame([(1, 0), (1, 2), (1, 3), (1, 8), (9, 0)], "execution_id long, after_seq int")
    got = {(r.execution_id, r.after_seq): (r.n_events, r.gap) for r in V.replay_state(log, asks).collect()}
    assert got == {(1, 0): (5, True), (1, 2): (5, True), (1, 3): (5, False), (1, 8): (0, False), (9, 0): (0, False)}


def test_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "ts", F.col("user_id").alias("execution_id"), F.col("event_type").alias("type"), "value")
    events.coalesce(1).write.json(str(tmp_path / "in"))
    got = progress.drained(progress.sequenced(progress.read_events(spark, str(tmp_path / "in"))), "log_stream", str(tmp_path / "c1"))
    want = V.sequenced(events).select("execution_id", "sequence", "event_id", "type")
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))
    counts = progress.drained(progress.tumbling(progress.read_events(spark, str(tmp_path / "in"))), "hour_stream", str(tmp_path / "c2"), "complete")
    assert Counter((r.start, r.type, r.n) for r in counts.collect()) == Counter((r.start, r.type, r.n) for r in V.tumbling(events).collect())


def test_glossary_files(spark, tmp_path):
    path = tmp_path / "terms.csv"
    path.write_text('source,target,tgt_lng\nhello,"say ""hi"", you",zh-CN\nworld,w,\nbye,b,fr\n,x,\n')
    got = files.read_glossary(spark, str(path), "zh_cn").collect()
    assert sorted((r.source, r.target) for r in got) == [("hello", 'say "hi", you'), ("world", "w")] and got[0].glossary_name == "terms"
    files.write_glossary(spark.createDataFrame([("a", 'q"x', None)], "source string, target string, tgt_lng string"), str(tmp_path / "out"))
    assert files.read_glossary(spark, str(tmp_path / "out"), "de").first().target == 'q"x'
    line = files.event_lines(spark.createDataFrame([(1, 2, "end")], "execution_id long, sequence long, type string")).first().value
    assert json.loads(line) == {"execution_id": 1, "sequence": 2, "type": "end"} and " " not in line


def test_glossary_match_folds_ascii_only(spark):
    texts = spark.createDataFrame([(1, "The  (BIG Dog) sat"), (2, "bigdog"), (3, "ÄRGER hier"), (4, None)], "doc_id long, text string")
    terms = spark.createDataFrame([("big dog",), ("Big",), ("big",), ("ärger",), ("big  dog",), ("",)], "term string")
    want = {(1, "big dog"), (1, "Big"), (1, "big"), (2, "Big"), (2, "big")}
    for per_pass in (200_000, 2):
        assert {(r.doc_id, r.term) for r in X.matched_terms(texts, terms, per_pass).collect()} == want
    assert X.matched_terms(texts, terms.where("false")).count() == 0

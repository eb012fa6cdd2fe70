"""Plug-ins, options, files and late events."""

import json
import os

import pytest
from pyspark.sql import functions as F

from quillframe import plugins as B
from quillframe.operators import service as V
from quillframe.operators import text as X
from quillframe.session import EngineConf
from quillframe.sources import files
from quillframe.sources import synthetic as S
from quillframe.streaming import progress


class Moody(B.Reversed):
    def translate(self, text):
        if text == "refuse":
            raise B.Refused
        return text[::-1] if text != "break" else 1 / 0


def test_translators(spark):
    df = spark.createDataFrame([(1, "abc"), (2, "refuse"), (3, "break"), (4, None)], "id long, text string")
    got = {r.id: (r.translation, r.engine, r.error) for r in B.translated(df, Moody(), per_second=1000.0).collect()}
    assert got == {1: ("cba", "reversed", None), 2: (None, "reversed", "content_filter"), 3: (None, "reversed", "failed"), 4: (None, "reversed", None)}
    assert B.answers_prompts(B.Echo()) and not B.answers_prompts(B.Reversed())
    prompt = 'Inputs: [{"id": 0, "input": "héy"}]'
    parsed = spark.createDataFrame([(B.Echo().answer(prompt),)], "raw string").select(X.parsed_answers(F.col("raw"))).first()[0]
    assert [tuple(x) for x in parsed] == [(0, "HÉY")]


def test_retries_and_rates():
    tries, pauses = [], []

    def call(text):
        tries.append(text)
        if len(tries) < 6:
            raise OSError
        return "ok"

    assert B.retried(call, sleep=pauses.append)("x") == "ok" and len(pauses) == 5
    assert all(0.9 * w <= p <= w for p, w in zip(pauses, (1, 2, 4, 8, 15), strict=True))
    with pytest.raises(B.Refused):
        B.retried(lambda t: (_ for _ in ()).throw(B.Refused()), sleep=pauses.append)("x")
    now, slept = [0.0], []
    limiter = B.Limiter(2, lambda: now[0], slept.append)
    for _ in range(3):
        limiter.wait()
    assert slept == [0.5, 1.0]


def test_models_splits_runs(spark):
    pages = spark.createDataFrame([(1, k, 600.0, 300.0) for k in range(5)], "doc_id long, page_no long, w double, h double")
    boxes = B.detections(pages, B.Bands()).where("page_no = 3").orderBy("det_id").collect()
    assert [(b.label, b.y, b.y2) for b in boxes] == [("title", 200.0, 300.0), ("plain text", 100.0, 200.0), ("footnote", 0.0, 100.0)]
    assert sorted((r.first_page, r.last_page) for r in B.by_page_count(2)(pages).collect()) == [(0, 1), (2, 3), (4, 4)]
    kinds = lambda log: [e["type"] for e in log]
    assert kinds(B.executed({"id": 1}, B.FakeRunner())) == ["start", *["progress"] * 5, "finish"]
    assert kinds(B.executed({"id": 1}, B.FakeRunner("block")))[-1] == "error" and len(B.executed({"id": 1}, B.FakeRunner("burst"), most=10)) == 10
    assert kinds(B.executed({"id": 1}, B.FakeRunner(), abort_after=3)) == ["start", "progress", "progress", "error"]
    paras = spark.createDataFrame([("a b c", "Times", False), ("§ 1", "CMR", False)], "text string, font string, f boolean")
    assert [r.n_tokens for r in B.counted(paras, lambda t: F.size(F.split(t, " ")).cast("long")).collect()] == [3, 2]
    mine = B.Patterns(font="^CM", char="^b").is_formula(F.col("font"), F.col("text"), F.col("f"))
    assert [r[0] for r in paras.select(mine).collect()] == [False, True]
    B.register(spark)
    assert spark.sql("SELECT quill_nfkc('ﬁ  x'), quill_batches(array(150, 60, 10), 200, 5)").first()[:] == ("fi x", [0, 0, 1])


def test_options(spark):
    spark.conf.set("quillframe.batch_tokens", "300")
    spark.conf.set("quillframe.split_short_lines", "true")
    try:
        conf = EngineConf.of(spark)
        assert (conf.batch_tokens, conf.split_short_lines, conf.batch_items) == (300, True, 5)
        spark.conf.set("quillframe.batch_tokens", "-1")
        with pytest.raises(ValueError):
            EngineConf.of(spark)
    finally:
        spark.conf.unset("quillframe.batch_tokens")
        spark.conf.unset("quillframe.split_short_lines")
    assert EngineConf.from_toml('[quillframe]\nlang_out = "fr"\nterm_items = 3').term_items == 3
    with pytest.raises(TypeError):
        EngineConf.from_toml("[quillframe]\nnonsense = 1")


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("source,target,tgt_lng\nü,u,\nx,y,fr\n".encode("latin-1"))
    (tmp_path / "b.csv").write_bytes("source,target\nq,\"r, s\"\n".encode("utf-16"))
    (tmp_path / "c.csv").write_bytes(b"nothing,here\n1,2\n")
    got = {(r.glossary_name, r.source, r.target) for r in files.read_glossary_any(spark, str(tmp_path), "de").collect()}
    assert got == {("a", "ü", "u"), ("b", "q", "r, s")}
    (tmp_path / "p.pdf").write_bytes(b"")
    assert files.input_files([f'"{tmp_path}/p.pdf"']) == [f"{tmp_path}/p.pdf"]
    for bad, error in ((f"{tmp_path}/q.pdf", FileNotFoundError), (f"{tmp_path}/a.csv", ValueError)):
        with pytest.raises(error):
            files.input_files([bad])
    assert files.inside(str(tmp_path), "x/../a.csv").endswith("a.csv")
    with pytest.raises(ValueError):
        files.inside(str(tmp_path), "../etc")
    assert files.dumped(spark.range(3), str(tmp_path), "stage").count() == 3


def test_folds_of_the_service():
    assert V.admitted_of([0, 5, 10, 12], [10, 1, 1, 1]) == [True, False, True, True]
    assert V.in_flight_of([5, 1, 1, 9], 2) == [5, 5, 6, 14]
    assert V.throttled_of([0, 0.05, 0.1, 0.15], [False, False, False, True], 0.1) == [True, False, True, True]
    assert V.bands_of([0] * 4, [0, 2, 20, 1], [10, 12, 30, 9]) == [0, 0, 1, 0]


def test_late_events_are_dropped_and_windows_slide(spark, tmp_path):
    rows = lambda *h: "".join(json.dumps({"event_id": k, "ts": f"2024-01-01T{x:02}:30:00", "execution_id": 1, "type": "a", "value": 1.0}) + "\n" for k, x in enumerate(h))
    folder = tmp_path / "in"
    folder.mkdir()
    for k, text in enumerate((rows(10, 20), rows(21), rows(5, 23))):  # a batch each: the last has an event that is too late
        (folder / f"{k}.json").write_text(text)
        os.utime(folder / f"{k}.json", (1e9 + k, 1e9 + k))
    got = progress.drained(progress.sliding(progress.read_events(spark, str(folder), 1)), "slides", str(tmp_path / "c"), "append")
    assert {(r.start.hour, r.n) for r in got.collect()} == {(9, 1), (10, 1), (19, 1)}


def test_executions_that_never_end_are_closed(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    event = lambda k, e, t: json.dumps({"event_id": k, "ts": f"2024-01-01T0{k}:00:00", "execution_id": e, "type": t, "value": 0.0}) + "\n"
    for k, text in enumerate((event(0, 1, "a") + event(1, 1, "error") + event(2, 1, "a") + event(3, 2, "a"), event(9, 3, "error"))):
        (folder / f"{k}.json").write_text(text)
        os.utime(folder / f"{k}.json", (1e9 + k, 1e9 + k))
    got = progress.drained(progress.sequenced(progress.read_events(spark, str(folder), 1), forget="1 hour"), "ends", str(tmp_path / "c"))
    assert {(r.execution_id, r.sequence, r.type) for r in got.collect()} == {(1, 1, "a"), (1, 2, "error"), (2, 1, "a"), (2, 2, "missing_terminal"), (3, 1, "error")}


def test_tokens_are_the_default_counter(spark):
    assert spark.sql("SELECT 'a1 b-c' AS t").select(S.tokens(F.col("t"))).first()[0] == 5

"""The word grid and its characters: places by running sums in a row, without windows, sorts or shuffles of words."""

import random

import pytest
from pyspark.sql import functions as F

from quillframe.functions import arrays as A
from quillframe.operators import glyphs as C
from quillframe.operators import layout as L
from quillframe.operators import render as R
from quillframe.operators import styles as Y
from quillframe.sources import synthetic as S


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def grid(text):
    """Words of a text by a plain loop: seq, line_no, word_no, word, col, vrow, font_size."""
    out, vrow, before = [], 0, None
    for line_no, line in enumerate(text.split("\n")):
        col, rows, words = 0, 1, [w for w in line.split(" ") if w]
        for word_no, w in enumerate(words):
            out.append((len(out) + 1, line_no, word_no, w, col, vrow + col // 80, 7.0 if before and before.isdigit() else 10.0))
            before, rows, col = w, col // 80 + 1, col + len(w) + 1
        before, vrow = (words[-1] if words else None), vrow + rows
    return out


def test_words_equal_a_loop(spark):
    texts = ["a b\n\n  \nc 7 " + "x" * 200 + " d\n", "", " ", "7\n8\n\n9 9", "w 1 " * 3000 + "\n" + "q\n" * 5000, "é😀 ü\nA B"]
    docs = spark.createDataFrame([*enumerate(texts), (99, None)], "doc_id long, text string")
    got = S.words(docs).select("doc_id", "seq", "line_no", "word_no", "word", "col", "vrow", "font_size").collect()
    want = {(k, *row) for k, t in enumerate(texts) for row in grid(t)}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_running_sums(spark):
    rng = random.Random(3)
    lists = [[rng.randrange(99) for _ in range(n)] for n in (0, 1, 2, 63, 64, 65, 128, 1000)]
    got = spark.createDataFrame([(k, x) for k, x in enumerate(lists)], "k int, v array<long>").select("k", A.running(F.col("v")).alias("s")).collect()
    assert {r.k: r.s for r in got} == {k: [sum(x[:i]) for i in range(len(x))] for k, x in enumerate(lists)}


def test_no_window_below_the_words(spark, sf):
    """A window that buffers a long text gets no memory below another sort of the words (q_bands, q_box_predicates, q_lines_split, ...)."""
    p = plan(S.words(S.table(spark, sf, "documents")))
    assert "Window" not in p and "Sort" not in p and p.count("Exchange") == 1


@pytest.mark.parametrize("word", ["mill.", "x" * 300, "w"])
def test_glyphs_move_within_their_word(spark, word):
    advance = lambda ch: F.when(ch == "m", 9.0).otherwise(6.0)
    got = C.glyphs(spark.createDataFrame([(1, 1, word, 5.0)], "doc_id long, seq int, word string, x double"), advance)
    assert "Sort" not in plan(got) and "Exchange" not in plan(got)
    rows = sorted((r.i, r.ch, r.x0, r.advance) for r in got.collect())
    wide = [9.0 if c == "m" else 6.0 for c in word]
    assert rows == [(i, c, 5.0 + sum(wide[:i]), wide[i]) for i, c in enumerate(word)]


def test_pages_are_read_once(spark, sf):
    """q_char_area, q_gap_below and q_text_join read the texts once: nothing is joined."""
    from quillframe.plans import catalogue

    for name in ("q_char_area", "q_gap_below", "q_text_join"):
        p = plan(catalogue.QUERIES[name](spark, sf))
        assert "Join" not in p and p.count("FileScan") == 1, name


def test_second_gap_beside_words(spark, sf):
    w = S.words(S.table(spark, sf, "documents").limit(40))
    line = ["doc_id", "page_no", "row_no"]
    assert L.with_second_gap(w).select(*line, "ref_gap").distinct().exceptAll(L.second_gap(w)).count() == 0


def test_layout_is_found_once_a_word(spark, sf):
    """q_placeholder_only: the filter on labels does not find the layouts again."""
    p = plan(L.islands(L.assigned_in(S.boxed(S.words(S.table(spark, sf, "documents"))))))
    assert p.count("array_min") == 1


def test_wrapped_texts_equal_the_arrays(spark):
    texts = ["The quick brown fox. " * 9, "", "中", "a\nb\nc", "wwwww " * 30 + "x" * 90, "no such sign: é"]
    paras = spark.createDataFrame([(1, k, t, 400.0) for k, t in enumerate(texts)], "doc_id long, para_no int, text string, wide double")
    table = spark.createDataFrame([(c, 300.0 + 10 * k) for k, c in enumerate("abcdefghijklmnopqrstuvwxyzTx .,\n")], "ch string, width double").dropDuplicates(["ch"])
    one = F.array_sort(F.collect_list(F.struct("place", "width", "class")))
    u = R.units(paras, table).withColumn("class", R.character_class(F.col("ch"))).groupBy("doc_id", "para_no").agg(one.alias("u"))
    rows = u.select("doc_id", "para_no", F.lit(400.0).alias("wide"), F.col("u.width").alias("widths"), F.col("u.class").alias("classes"), F.transform("u", lambda x: F.lit(False)).alias("gaps"))
    got = R.wrapped_texts(paras, table)
    assert "Exchange" not in plan(got)  # characters are never rows
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in R.wrapped(rows).collect()}


def test_pages_meet_without_a_join(spark, sf):
    """q_remove_lines, q_element_assign: words are dealt by document once and stay there."""
    from quillframe.plans import catalogue

    for name in ("q_remove_lines", "q_element_assign"):
        df = catalogue.QUERIES[name](spark, sf)
        df.collect()
        p = plan(df).split("== Initial Plan ==")[0]
        kinds = [line for line in p.split("\n") if "Exchange" in line]
        assert "Join" not in p and all("REPARTITION_BY_COL" in line for line in kinds), name


def test_lines_without_a_page_stay_out(spark):
    box = "x double, y double, x2 double, y2 double"
    curves = spark.createDataFrame([(1, 0, 1, 1.0, 1.0, 2.0, 2.0), (1, 0, 2, 5.0, 5.0, 6.0, 6.0), (None, 0, 3, 1.0, 1.0, 2.0, 2.0), (1, 1, 4, 1.0, 1.0, 2.0, 2.0)], "doc_id long, page_no long, element_id int, ex double, ey double, ex2 double, ey2 double")
    paras = spark.createDataFrame([(1, 0, 0.0, 0.0, 9.0, 9.0), (None, 0, 0.0, 0.0, 9.0, 9.0)], f"doc_id long, page_no long, {box}")
    figures = spark.createDataFrame([(1, 0, 5.0, 5.0, 6.0, 6.0)], f"doc_id long, page_no long, {box}")
    assert [r.element_id for r in Y.kept_lines(curves, figures, paras).collect()] == [1]


def test_pages_fold_in_batches(spark, sf):
    """q_lines_merge, q_fix_overlap: pages go through Python by the batch, not one by one, and are not shuffled again."""
    from quillframe.operators import folds as O

    rng = random.Random(5)
    rows = [(d, p, s, float(x := rng.randrange(300)), float(y := rng.randrange(200)), float(x + rng.randrange(5, 40)), float(y + rng.randrange(5, 20))) for d in range(5) for p in range(3) for s in range(rng.randrange(1, 25))]
    items = spark.createDataFrame(rows, "doc_id long, page_no long, seq int, x double, y double, x2 double, y2 double")
    want, apart = set(), set()
    for d, p in {r[:2] for r in rows}:
        page = [r for r in rows if r[:2] == (d, p)]
        want |= {(d, p, page[i][2], page[min(g)][2]) for g in O.merge_boxes([r[3:] for r in page], O.touching) for i in g}
        apart |= {(d, p, r[2], *b) for r, b in zip(page, O.separate([r[3:] for r in page]), strict=True)}
    merged, parted = O.merged_boxes(items), O.separated(items.withColumnRenamed("seq", "para_seq").withColumn("para_seq", F.col("para_seq").cast("long")))
    assert {tuple(r) for r in merged.collect()} == want and {tuple(r) for r in parted.collect()} == apart
    assert "FlatMapGroups" not in plan(merged) and "FlatMapGroups" not in plan(parted)

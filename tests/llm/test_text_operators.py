"""Quality ledger, fingerprints, language ID, packing and LM scoring against plain Python."""

import hashlib
import math
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from quillframe.llm import fingerprints, langid, lm, packing, quality
from quillframe.llm.common import ARROW_BYTES, written
from quillframe.llm.tokens import Encoder
from tests.llm.fixtures import DOC, documents, rows

BPE = public_tokenizers.path("byte_bpe_50k.json")


def split(text):
    return [w for w in re.split("[ \t-\r]+", text or "") if w]


def test_quality_matches_plain_python(spark):
    got = {(r.doc_id, r.n_words, r.n_repeat_words, r.n_dup_lines, r.word_chars, r.n_symbols): r.kept for r in quality.judged(quality.ledger(documents(spark))).collect()}
    for row in rows():
        w, t = split(row[1]), row[1] or ""
        grams = Counter(zip(w, w[1:], w[2:], strict=False))
        marked = {i + d for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for d in range(3)}
        lines = [x for x in t.split("\n") if split(x)]
        key = (row[0], len(w), len(marked), len(lines) - len(set(lines)), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t))
        assert key in got, key
        if len(w) < 50 or 100 * len(marked) > 50 * len(w):
            assert not got[key]


def test_quality_windows_at_the_edges(spark):
    data = [(i, t, None, None, None, None, None, None) for i, t in enumerate(["a b c", "a b c a b c", "a a a a", "a a a", "x y z x y z q"])]
    got = [r.n_repeat_words for r in quality.measured(documents(spark, data)).orderBy("doc_id").collect()]
    assert got == [0, 6, 4, 0, 6]


def test_ablations_count_bits(spark):
    book = quality.ledger(documents(spark))
    n = {r.rule: (r.n_failed, r.n_only) for r in quality.ablations(book).collect()}
    masks = [r.failed for r in book.collect()]
    for k, (rule, _) in enumerate(quality.RULES):
        assert n.get(rule, (0, 0)) == (sum(m >> k & 1 for m in masks), sum(m == 1 << k for m in masks))
    assert quality.ledger(documents(spark, [])).count() == 0


def test_next_and_edited_texts(spark):
    docs = documents(spark).where("doc_id IS NOT NULL")
    got = sorted((r.doc_id, r.text, r.next_text) for r in fingerprints.with_next(docs, "doc_id", "text", rows_per_part=2).collect())
    want = sorted((r[0], r[1] or "") for r in rows() if r[0] is not None)
    assert got == [(k, t, want[(i + 1) % len(want)][1]) for i, (k, t) in enumerate(want)]
    assert fingerprints.with_next(documents(spark, []), "doc_id", "text").count() == 0
    named = docs.withColumn("name", F.concat(F.lit("é"), F.col("doc_id").cast("string")))
    by_name = sorted((r.name.encode(), r.text, r.next_text) for r in fingerprints.with_next(named, "name", "text", rows_per_part=2).collect())
    ring = sorted((f"é{r[0]}".encode(), r[1] or "") for r in rows() if r[0] is not None)
    assert by_name == [(k, t, ring[(i + 1) % len(ring)][1]) for i, (k, t) in enumerate(ring)]
    row = spark.createDataFrame([("abcdé", "xyz")], "a string, b string").select(fingerprints.edited(F.col("a"), F.col("b"))).first()[0]
    assert row == "abcxy"


def test_sketches_estimate_and_merge(spark):
    words = [f"w{i}" for i in range(600)]
    a, b = " ".join(words[:400]), " ".join(words[200:])
    f = fingerprints
    texts = spark.createDataFrame([(1, a), (2, b), (3, a), (4, ""), (5, "one two")], "k int, t string")
    df = texts.select("k", f.hashed_words(F.col("t")).alias("h")).select("k", f.sketch("h").alias("sketch"))
    s = {r.k: r.sketch for r in df.collect()}
    assert s[1] == s[3] and s[4] == [] and len(s[5]) == 1 and len(s[1]) == f.K
    pair = spark.createDataFrame([(s[1], s[2])], "a array<long>, b array<long>").select(f.resemblance(F.col("a"), F.col("b")), f.containment(F.col("a"), F.col("b")), f.distinct_shingles(F.col("a"))).first()
    assert abs(pair[0] - 196 / 596) < 0.15 and abs(pair[1] - 196 / 396) < 0.2 and abs(pair[2] - 396) < 130
    whole = f.merged(df.where("k IN (1, 2)").withColumn("all", F.lit(0)), "all").first().sketch
    assert whole == sorted(set(s[1]) | set(s[2]))[: f.K]


def test_sketches_by_brute_force(spark):
    """The query's fingerprint and likeness from shingles hashed one by one."""
    f = fingerprints
    texts = [r[1] or "" for r in rows() if len(r[1] or "") < 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {r.k: r.s for r in df.select("k", f.hashed_words(F.col("t")).alias("h")).select("k", f.sketch("h").alias("s")).collect()}

    def signed(x):
        return x - 2**64 if x >= 2**63 else x

    def slow(text):
        w = [xxh64_intdigest(x.encode(), 42) for x in split(text)]
        grams = [w[i : i + 5] for i in range(len(w) - 4)] or ([w] if w else [])
        out = set()
        for g in grams:
            h = 42
            for x in g:
                h = xxh64_intdigest(x.to_bytes(8, "little"), h)
            out.add(signed(h))
        return out

    sets = [slow(t) for t in texts]
    for k, s in enumerate(sets):
        assert got[k] == sorted(s)[: f.K]
    pairs = [(i, j, got[i], got[j]) for i in range(len(texts)) for j in range(len(texts))]
    near = spark.createDataFrame(pairs, "i int, j int, a array<long>, b array<long>").select("i", "j", f.resemblance(F.col("a"), F.col("b")).alias("n")).collect()
    for r in near:
        both = sorted(sets[r.i] | sets[r.j])[: f.K]
        want = sum(h in sets[r.i] and h in sets[r.j] for h in both) / len(both) if both else 1.0
        assert r.n == pytest.approx(want)


def test_encoder_equals_the_tokenizer():
    e = Encoder(BPE)
    rng = np.random.default_rng(3)
    alphabet = ["'", "s", "re", "ll", "ve", " ", "  ", "\n", "\t", "é", "ß", "×", "A", "1", "!", '"', "—", "中", "\x85", " ", "\r\n", "²", "<|endoftext|>"]
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 14))) for _ in range(3000)] + [r[1] or "" for r in rows()]
    for text, ids in zip(texts, e.encode(texts), strict=True):
        assert ids.tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("length", [16, 2048])
def test_packing_round_trip(spark, length):
    docs = documents(spark)
    got = packing.packed(docs, BPE, 1, length=length, group=4).collect()
    seqs, used = Counter(), set()
    by_tokens = Counter()
    for r in got:
        assert 0 < r.length and r.offset + r.length <= length and len(r.ids) == 4 * r.length
        seqs[r.sequence_id] += r.length
        cells = {(r.sequence_id, r.offset + i) for i in range(r.length)}
        assert not cells & used
        used |= cells
    assert all(n == length or n & (n - 1) == 0 for n in seqs.values())
    e = Encoder(BPE)
    want = Counter()
    for row in rows():
        ids = np.append(e.encode([row[1] or ""])[0], 1).astype("<u4")
        want[row[0]] += len(ids)
    for r in got:
        by_tokens[r.doc_id] += r.length
    assert by_tokens == want
    single = {row[0]: np.append(e.encode([row[1] or ""])[0], 1).astype("<u4").tobytes() for row in rows() if row[0] not in (None, 4)}
    for k, data in single.items():
        pieces = sorted((r.start, bytes(r.ids)) for r in got if r.doc_id == k)
        assert b"".join(p for _, p in pieces) == data and pieces[0][0] == 0
    assert packing.packed(documents(spark, []), BPE, 1).count() == 0


def test_assignment_balances_cost():
    placed = packing.assign([30, 20, 10, 4], [32, 32], 8)
    assert sum(p[2] for p in placed) == 64 and max(p[4] + p[2] for p in placed) == 32
    rng = np.random.default_rng(5)
    sizes = sorted(rng.integers(5, 400, 60).tolist(), reverse=True)
    rooms = [2048] * -(-sum(sizes) // 2048)
    rooms[-1] = sum(sizes) - 2048 * (len(rooms) - 1)

    def spread(pieces):
        cost = Counter()
        for _, _, n, room, _ in pieces:
            cost[room] += n * 64 + n * n
        full = [cost[k] for k, r in enumerate(rooms) if r == 2048]
        return max(full) - min(full)

    first, room, left = [], 0, rooms[0]
    for k, n in enumerate(sizes):  # first fit of descending documents, cut where a sequence ends
        while n:
            take = min(n, left)
            first.append((k, 0, take, room, 0))
            n, left = n - take, left - take
            if not left and room + 1 < len(rooms):
                room, left = room + 1, rooms[room + 1]
    assert spread(packing.assign(sizes, rooms, 64)) < spread(first) / 2


def test_language_id_learns_and_answers(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    test = docs.where(langid.held_out(F.col("doc_id"))).select("lang", langid.predicted(model, F.col("text")).alias("p")).collect()
    assert sum(r.lang == r.p.lang_pred for r in test) >= 0.95 * len(test)
    hard = documents(spark).select("text", langid.predicted(model, F.col("text")).alias("p")).collect()
    for r in hard:
        assert 0 <= r.p.score <= 1
        assert (r.p.lang_pred == "und") == (r.text is None or not any(c.isalpha() for c in r.text))
        assert langid.answer(model, r.text)[0] == r.p.lang_pred
    for text in ("²", "½ ¾", "Ⅷ", "1 2 _ ?", "", None):
        assert langid.answer(model, text) == ("und", 0.0) and langid.answers(model, [text]) == [("und", 0.0)]
    assert langid.answer(model, "² a")[0] != "und"
    assert langid.train(documents(spark, [])) is None
    assert documents(spark).select(langid.predicted(None, F.col("text")).alias("p")).where("p.lang_pred <> 'und'").count() == 0


def slow_scores(data, learns):
    """Known words, base and score of each text from plain counts."""
    texts = [lm.tokens(t) for t in data]
    taught = [t for t, teaches in zip(texts, learns, strict=True) if teaches]
    c, pairs = Counter(w for t in taught for w in t), Counter(p for t in taught for p in zip([b"", *t], t, strict=False))
    n, v = sum(c.values()), len(c)
    power = min(lm.POWERS, key=lambda p: abs(sum(x**p for x in c.values()) - len(pairs))) if c else 0
    out = []
    for t in texts:
        score = 0.0
        for u, w in zip([b"", *t], t, strict=False):
            k, plain = max(1, c[u]) ** power, (c[w] + 1) / (n + v + 1)
            score += math.log10((pairs[u, w] + k * plain) / (c[u] + k) if pairs[u, w] else k / (c[u] + k) * plain)
        out.append((len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), score))
    return out


@pytest.mark.parametrize("at_once", [400, 8 << 20])
def test_lm_scores_by_brute_force(spark, at_once):
    data = [r[1] for r in rows()] + [f"word{i % 7} word{i % 5} rare{i}\n word{i % 3}" for i in range(60)]
    learns = [i % 3 != 1 for i in range(len(data))]
    df = spark.createDataFrame(list(zip(range(len(data)), data, learns, strict=True)), "doc_id long, text string, t boolean")
    got = {r.doc_id: r[1:] for r in lm.scored(df, F.col("t"), pack=at_once, span=at_once).collect()}  # small batches, several ranges
    assert len(got) == len(data)
    for i, want in enumerate(slow_scores(data, learns)):
        assert got[i] == pytest.approx(want, rel=1e-9, abs=1e-9), data[i]


def test_language_id_by_plain_convolution(spark, sf):
    """probabilities() against loops over windows, filters and places."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.train(docs, per_language=20)
    text = "Die Größe, the size. " * 40
    rows = langid.windows(text)
    assert b"".join(r.tobytes() for r in rows).rstrip(b"\0") == text.lower().encode()
    mean = np.zeros(len(model.languages))
    for row in rows:
        pooled = []
        for table in model.tables:
            places = range(langid.WINDOW - len(table) + 1)
            pooled += [max(sum(float(table[k][row[i + k]][f]) for k in range(len(table))) for i in places) for f in range(langid.FILTERS)]
        z = np.maximum(np.array(pooled) + model.bias, 0) @ model.out + model.out_bias
        mean += np.exp(z - z.max()) / np.exp(z - z.max()).sum() * (row != 0).sum()
    mean /= (np.concatenate(rows) != 0).sum()
    assert langid.answer(model, text) == (model.languages[int(mean.argmax())], pytest.approx(mean.max(), abs=1e-4))


def test_lm_weights_of_a_state_add_up():
    words, model = {"a": 5, "b": 2, "": 3}, lm.Model(10, 3, 6, [10 - p for p in range(21)])
    plain = {w: model.plain(c) for w, c in words.items()} | {"unknown": model.plain(0)}
    assert sum(plain.values()) == pytest.approx(1)
    after = {"a": 1, "": 4}
    assert sum(model.arc(after.get(w, 0), 5.0, p) for w, p in plain.items()) == pytest.approx(1)


def test_lm_beats_single_words(spark, sf):
    got = lm.scored(spark.read.parquet(f"{sf}/documents.parquet"), ~lm.held_out(F.col("doc_id"))).withColumn("h", lm.held_out(F.col("doc_id")))
    sums = {r.h: r for r in got.groupBy("h").agg(F.sum("score").alias("score"), F.sum("base_score").alias("base")).collect()}
    assert sums[True].score > sums[True].base and sums[False].score > sums[False].base


def test_lm_without_training(spark):
    got = lm.scored(documents(spark), F.lit(None).cast("boolean")).collect()
    assert len(got) == len(rows()) and all(r.score <= 0 and r.n_known == 0 for r in got)
    assert lm.scored(documents(spark, []), F.lit(True)).count() == 0
    assert [r.doc_id for r in lm.scored(documents(spark), F.lit(True)).collect()].count(4) == 2


def test_held_out_is_crc32(spark):
    ids = list(range(50))
    df = spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", lm.held_out(F.col("doc_id")).alias("a"), langid.held_out(F.col("doc_id")).alias("b"))
    for r in df.collect():
        crc = zlib.crc32(str(r.doc_id).encode())
        assert (r.a, r.b) == (crc % 7 == 2, crc % 4 == 2)
    assert hashlib.sha256(b"").hexdigest() and DOC


def test_lm_splits_a_batch_piece_by_piece():
    texts = [" ".join(f"{i % 90 + 10}" for i in range(n)) for n in (900_000, 0, 300_000, 1)]  # one is far longer than a piece
    lines = [b" ".join(lm.normal(t)) for t in texts]
    size = sum(map(len, lines)) + len(lines)
    data = pa.compress(b"\n".join(lines), "zstd", asbytes=True)
    tracemalloc.start()
    each, sizes = lm.unpacked(data, size)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sizes.tolist() == [900_001, 1, 300_001, 2]
    assert (each == lm.hashed([w for t in texts for w in lm.tokens(t)])).all()
    assert peak < 15 * size  # words as objects all at once take more


def test_written_bounds_batches_for_python(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    df = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("word "), 200).alias("t"))
    before = spark.conf.get(ARROW_BYTES)
    assert max(r.n for r in written(df.mapInArrow(sizes, "n long"), "sizes", arrow_bytes=1 << 18).collect()) < 1 << 19
    assert spark.conf.get(ARROW_BYTES) == before

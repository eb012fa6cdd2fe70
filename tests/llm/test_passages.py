"""Repeated passages against brute force."""

import random
from collections import defaultdict

import numpy as np
from quillframe.llm import passages
from tests.llm.fixtures import documents, rows
from tests.llm.test_group_operators import merged


def slow_cuts(each, reach):
    pairs = [int(passages._mixed(passages._mixed(np.array([each[i - 1] if i else 0], np.uint64)) ^ each[i : i + 1])[0]) >> 1 for i in range(len(each))]
    return [i for i in range(len(each)) if not i or all(pairs[i] < x for x in pairs[max(0, i - reach) : i]) and all(pairs[i] <= x for x in pairs[i + 1 : i + reach + 1])]


def test_cuts_by_brute_force():
    rng = np.random.default_rng(3)
    texts = [passages.hashed([b"%d" % w for w in rng.integers(0, top, n)]) for top in (3, 50, 10**6) for n in (1, 2, 5, 40, 300)]
    got = passages.cuts(np.concatenate(texts), np.array([len(t) for t in texts]), 6).tolist()
    want, at = [], 0
    for t in texts:
        want += [at + i for i in slow_cuts(t, 6)]
        at += len(t)
    assert got == want


def test_sections_do_not_depend_on_the_batch():
    rng = np.random.default_rng(4)
    texts = [passages.hashed([b"%d" % w for w in rng.integers(0, 500, n)]) for n in (3, 90, 4, 200, 60)]
    texts[4] = texts[1][20:80]
    begins, ns, pids, flat, starts = passages.sections(np.concatenate(texts), np.array([len(t) for t in texts]))
    assert ns.sum() == sum(map(len, texts)) and len(set(pids)) < len(pids)
    alone = [passages.sections(t, np.array([len(t)])) for t in texts]
    assert pids.tolist() == [p for a in alone for p in a[2].tolist()]
    assert flat.tolist() == [p for a in alone for p in a[3].tolist()]
    whole = np.concatenate(texts)
    for i, (b, n, p) in enumerate(zip(begins, ns, pids, strict=True)):
        mine = flat[starts[i] : starts[i + 1] if i + 1 < len(starts) else None]
        assert mine.tolist() == (passages.folded(whole[b : b + n]).tolist() if n >= 5 else [p])


def test_classes_by_brute_force(spark):
    rng = random.Random(4)
    pool = [[f"v{rng.randrange(900)}" for _ in range(rng.choice([25, 60, 120]))] for _ in range(30)]

    def noisy(p):
        w = list(p)
        if rng.random() < 0.7:
            w[rng.randrange(len(w))] = f"edit{rng.randrange(3)}"
        return " ".join(w)

    texts = ["\n".join(noisy(rng.choice(pool)) if rng.random() < 0.6 else "short line" for _ in range(4)) for _ in range(150)]
    data = [(i, t, "en", "s", len(t), 0, "", "") for i, t in enumerate(texts)]
    places, sets = [], []
    for i, t in enumerate(texts):
        each = passages.hashed(passages.normal(t))
        begins, ns, pids, flat, starts = passages.sections(each, np.array([len(each)]))
        for k in range(len(begins)):
            places.append((i, int(begins[k]), int(ns[k])))
            sets.append(set(flat[starts[k] : starts[k + 1] if k + 1 < len(starts) else None].tolist()))
    holders = defaultdict(list)
    for p, s in enumerate(sets):
        for x in s:
            holders[x].append(p)
    near = {(q, p) for h in holders.values() for p in h for q in h if q < p and len(sets[p] & sets[q]) >= 0.8 * len(sets[p] | sets[q])}
    assert any(sets[p] != sets[q] for p, q in near)
    roots = merged(len(sets), near)
    want, found = defaultdict(set), defaultdict(set)
    for p, r in zip(places, roots, strict=True):
        want[r].add(p)
    got = passages.classes(documents(spark, data), least=1, recall=0.9999).collect()
    for r in got:
        found[r.class_id].add((r.doc_id, r.start, r.n_words))
    assert sorted(map(sorted, found.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)
    assert {(r.doc_id, r.start, r.n_words) for r in got if not r.removed} == {min(v, key=lambda x: x[:2]) for v in found.values()}
    assert all(r.low <= r.start and r.high >= r.start + r.n_words for r in got)


def planted(rng, number):
    """Texts with passages of 51 to 120 words at any word, and each text without those that an earlier text has."""
    word = lambda: f"x{rng.randrange(10**6)}"
    pool = [[word() for _ in range(rng.randrange(51, 121))] for _ in range(number)]
    texts, left = [], []
    for i in range(4 * number):
        a, b = [word() for _ in range(rng.randrange(0, 60))], [word() for _ in range(rng.randrange(0, 60))]
        texts.append((a, pool[i % number], b))
        left.append((a + b if i >= number else a + pool[i % number] + b))
    return texts, left


def test_planted_passages_go_whole(spark):
    rng = random.Random(9)
    texts, left = planted(rng, 100)
    data = [(i, "".join(w + rng.choice([" ", " ", "\n"]) for w in a + p + b), "en", "s", 0, 0, "", "") for i, (a, p, b) in enumerate(texts)]
    got = {r.doc_id: r.text.split() for r in passages.deduplicated(documents(spark, data)).collect()}
    # where the paragraphs at an end are similar, not equal, a few words of the passage stay or a few beside it go
    caught = sum(len(set(got[i]) & set(texts[i][1])) <= 5 and len(got[i]) >= len(left[i]) - 5 for i in range(100, 400))
    assert caught >= 0.98 * 300, caught
    assert all(got[i] == left[i] for i in range(100))
    assert sorted({r.doc_id for r in passages.classes(documents(spark, data)).collect()})[:3] == [0, 1, 2]


def test_some_copy_of_every_word_stays(spark):
    rng = random.Random(10)
    pool = [[f"y{rng.randrange(3000)}" for _ in range(40)] for _ in range(12)]
    texts = [" ".join(w for _ in range(5) for w in rng.choice(pool)[rng.randrange(10) :]) for _ in range(60)]
    texts += ["again and again " * 60, "again and again " * 90, "thin " * 400, "thin " * 500, "a few words", "a few words"]
    data = [(i, t, "en", "s", len(t), 0, "", "") for i, t in enumerate(texts)]
    after = [r.text for r in passages.deduplicated(documents(spark, data), least=20).orderBy("doc_id").collect()]
    kept = {w for t in after for w in zip(*(t.split()[k:] for k in range(3)), strict=False)}
    inside = {w for p in pool for w in zip(*(p[10:][k:] for k in range(3)), strict=False)}
    lost = inside & {w for t in texts for w in zip(*(t.split()[k:] for k in range(3)), strict=False)} - kept
    assert len(lost) <= 0.02 * len(inside)
    assert sum(len(t.split()) for t in after[:60]) < 0.4 * sum(len(t.split()) for t in texts[:60])
    assert after[-2:] == texts[-2:]


def test_cut_keeps_what_stands_beside():
    assert passages.cut("a  b\nc d\te", [(1, 3)]) == "a  \nd\te"
    assert passages.cut("a b c", [(0, 3)]) == "" and passages.cut("a b c", [(0, 2), (1, 3)]) == ""
    assert passages.cut("a b c ", [(1, 2)]) == "a c " and passages.cut("x y z w", [(0, 3), (1, 2)]) == "w"


def test_passages_keep_hard_rows(spark):
    out = passages.deduplicated(documents(spark))
    assert out.columns == documents(spark).columns and out.count() == len(rows())
    before = {(r.doc_id, r._n, r.p_, r.k) for r in documents(spark).collect()}
    assert {(r.doc_id, r._n, r.p_, r.k) for r in out.collect()} == before
    assert passages.deduplicated(documents(spark, [])).count() == 0
    assert 1 - (1 - 0.8) ** passages.tuned() >= 0.99

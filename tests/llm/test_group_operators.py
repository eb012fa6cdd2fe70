"""Near-duplicates, passages, mixing, extraction, chat and the pipeline against brute force."""

import importlib
import random
import re
import time
from collections import Counter, defaultdict
from itertools import product as cartesian

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from quillframe.llm import chat, html_text, mixing, simhash
from quillframe.llm.common import settings, written
from quillframe.llm.components import components
from tests.llm.fixtures import documents, rows


def merged(n, links):
    top = list(range(n))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        top[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 180)] + [(7, 7)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    want = merged(260, links)
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: want[x] for x in linked}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_a_round_of_components_runs_few_stages(spark, monkeypatch):
    """With partitions never merged (as on check_h) a round's tasks, and what is logged of each, were the most of the pipeline's disk."""
    rng = random.Random(3)
    links = [(rng.randrange(900), rng.randrange(900)) for _ in range(600)] + [(2000 + i, 2000) for i in range(300)] * 2
    links += [(4000 + i * 37 % 101, 4000 + (i + 1) * 37 % 101) for i in range(100)] + [(5000 + i, 5000 + i // 3) for i in range(200)]
    module, rounds, sc = importlib.import_module("quillframe.llm.components"), [], spark.sparkContext
    monkeypatch.setattr(module, "_small_star", lambda edges, star=module._small_star: rounds.append(1) or star(edges))
    sc.setJobGroup("components", "")
    try:
        with settings(spark, {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}):
            found = components(spark.createDataFrame(links, "u long, v long"))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    got, want = found.collect(), merged(6000, links)
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert sorted((r.node, r.component) for r in got) == sorted((x, want[x]) for x in linked)
    tracker = sc.statusTracker()
    ids = {i for j in tracker.getJobIdsForGroup("components") for i in tracker.getJobInfo(j).stageIds}
    tasks = sum(s.numCompletedTasks for s in map(tracker.getStageInfo, ids) if s) / len(rounds)
    assert tasks <= 6 * 24  # 102; 170 while the large star's join ran twice and its rows were made distinct


def test_long_chains_take_few_rounds_of_components(spark, monkeypatch):
    """Edges are contracted by the tasks that read them; with a few edges at once the stars have all the work."""
    rng = random.Random(11)
    links = [(i, i + 1) for i in range(3000)] + [(rng.randrange(-9000, -5000), rng.randrange(-9000, -5000)) for _ in range(1500)]
    links += [(1 << 62, -(1 << 62)), (9999, 9998), (9998, 9999), (5, None), (None, 5)]
    rng.shuffle(links)
    ends = [x for a, b in links[:] if a is not None and b is not None and a != b for x in (a, b)]
    place = {x: i for i, x in enumerate(sorted(set(ends)))}
    least = merged(len(place), [(place[a], place[b]) for a, b in links if a in place and b in place and a != b])
    want, names = {x: least[i] for x, i in place.items()}, sorted(place)
    module, rounds = importlib.import_module("quillframe.llm.components"), []
    monkeypatch.setattr(module, "_small_star", lambda edges, star=module._small_star: rounds.append(1) or star(edges))
    table = spark.createDataFrame(links, "u long, v long").repartition(3)
    for at_once, most in ((1 << 19, 1), (40, 60)):
        rounds.clear()
        got = components(table, at_once=at_once).collect()
        assert sorted((r.node, r.component) for r in got) == sorted((x, names[want[x]]) for x in place)
        assert 1 <= len(rounds) <= most  # 1 is the round that finds nothing to move; 13 without contraction


def slow_print(text, n):
    w = [x for x in re.split("[ \t-\r]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if x]
    grams = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or ([" ".join(w)] if w else [])
    h = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_links_by_brute_force(spark):
    data = [r for r in rows() if r[0] is not None and len(r[1] or "") < 5000]
    got = {(r.doc_id, r.fp % 2**64): r.component_id for r in simhash.clustered(documents(spark, data)).collect()}
    prints = [slow_print(r[1], 3) for r in data]
    roots = merged(len(data), [(i, j) for i in range(len(data)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2])
    for i, r in enumerate(data):
        assert got[r[0], prints[i]] == min(data[j][0] for j in range(len(data)) if roots[j] == roots[i])
    assert simhash.clustered(documents(spark, [])).count() == 0


def test_ball_links_all_small_distances(spark):
    rng = random.Random(1)
    values = [rng.getrandbits(63) for _ in range(30)]
    values += [v ^ 1 << rng.randrange(63) for v in values] + [v ^ 1 << rng.randrange(63) ^ 1 << rng.randrange(63) for v in values]
    values = sorted(set(values))
    edges = simhash.links(spark.createDataFrame([(v,) for v in values], "fp long")).collect()
    got = merged(len(values), [(values.index(r.u), values.index(r.v)) for r in edges])
    want = merged(len(values), [(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 2])
    assert got == want


def test_near_copies_leave_one(spark):
    rng = random.Random(2)
    base = [[f"w{rng.randrange(5000)}" for _ in range(rng.choice([8, 60, 400]))] for _ in range(25)]
    texts = [" ".join(b) for b in base]
    for b in base[:15]:
        c = list(b)
        c[rng.randrange(len(c))] = "changed"
        texts += [" ".join(c), " ".join(b).upper()]
    data = [(i, t, "en", "s", len(t), 0, "", "") for i, t in enumerate(texts)] + [(3, texts[3], "en", "s", 1, 0, "", "")]

    def sets(t):
        w = t.lower().split()
        return set(zip(*(w[k:] for k in range(5)), strict=False))

    s = [sets(t) for t in texts]
    links = [(i, j) for i in range(len(s)) for j in range(i) if len(s[i] & s[j]) >= 0.8 * len(s[i] | s[j])]
    got = sorted(r.doc_id for r in simhash.deduplicated(documents(spark, data)).collect())
    assert got == sorted(set(merged(len(s), links)))
    hard = simhash.deduplicated(documents(spark))
    assert hard.columns == documents(spark).columns
    assert Counter(r.doc_id for r in hard.collect())[4] == 1
    assert simhash.deduplicated(documents(spark, [])).count() == 0


def test_appended_and_cut_copies_leave_one(spark):
    rng = random.Random(12)
    texts = []
    for k in range(200):
        b = [f"w{rng.randrange(50000)}" for _ in range(rng.choice([100, 400]))]
        new = [f"n{rng.randrange(50000)}" for _ in range(len(b))]
        texts += [" ".join(b), " ".join(b + new[: len(b) // 4 - 2] if k % 2 else b[: -(len(b) // 10)] + new[: len(b) // 10])]
    data = [(i, t, "en", "s", len(t), 0, "", "") for i, t in enumerate(texts)]
    sets = [set(zip(*(t.split()[k:] for k in range(5)), strict=False)) for t in texts]
    assert all(0.8 <= len(a & b) / len(a | b) < 0.84 for a, b in zip(sets[::2], sets[1::2], strict=True))
    got = {r.doc_id for r in simhash.deduplicated(documents(spark, data)).collect()}
    assert got >= set(range(0, 400, 2)) and len(got) <= 202  # a recall of 0.99


def test_balls_of_fingerprints_link_texts_that_bands_do_not(spark):
    """Texts that repeat a few words, with others at the end: all but a few of their shingles are equal, not so the distinct ones (F18)."""
    rng = random.Random(18)
    texts = []
    for k in range(24):
        part = [f"w{rng.randrange(50000)}" for _ in range(7)]
        texts += [" ".join(part * 60 + [f"n{rng.randrange(50000)}" for _ in range(n)]) for n in (8, 8, 300 if k % 2 else 8)]
    prints = [slow_print(t, 3) for t in texts]
    words = [t.split() for t in texts]
    grams = [Counter(zip(*(w[k:] for k in range(3)), strict=False)) for w in words]
    fives = [set(zip(*(w[k:] for k in range(5)), strict=False)) for w in words]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i)]
    by_print = [(i, j) for i, j in pairs if (prints[i] ^ prints[j]).bit_count() <= 2 and (grams[i] & grams[j]).total() >= 0.8 * (grams[i] | grams[j]).total()]
    by_band = [(i, j) for i, j in pairs if len(fives[i] & fives[j]) >= 0.8 * len(fives[i] | fives[j])]
    assert len(by_print) >= 24 and not by_band
    data = [(i, t, "en", "s", len(t), 0, "", "") for i, t in enumerate(texts)]
    got = sorted(r.doc_id for r in simhash.deduplicated(documents(spark, data)).collect())
    assert got == sorted(set(merged(len(texts), by_print)))


def family(rng, members, pairs):
    """Members that share most of a template (Jaccard 0.6 to 0.7), and copies of the first ones with a few words more changed."""
    template = [f"t{i}" for i in range(120)]
    texts = [[*template, *(f"u{rng.randrange(10**9)}" for _ in range(28))] for _ in range(members)]
    for t in texts[:pairs]:
        texts.append([*t[:-12], *(f"u{rng.randrange(10**9)}" for _ in range(12))])
    rng.shuffle(texts)
    return [" ".join(t) for t in texts]


def families(texts):
    """The class of each text by brute force: the least index that its links reach."""
    s = [set(zip(*(t.split()[k:] for k in range(5)), strict=False)) for t in texts]
    often = [g for g, n in Counter(g for x in s for g in x).items() if n > 1]
    held = np.array([[g in x for g in often] for x in s], np.float32)
    size = np.array([len(x) for x in s])
    shared = held @ held.T
    near = shared >= 0.8 * (size[:, None] + size - shared)
    return merged(len(s), np.argwhere(np.tril(near, -1)).tolist())


def test_texts_of_one_template_leave_one_of_each_pair(spark):
    texts = family(random.Random(22), 1200, 60)
    data = [(i, t, "en", "s", len(t), 0, "", "") for i, t in enumerate(texts)]
    got = sorted(r.doc_id for r in simhash.deduplicated(documents(spark, data)).collect())
    assert got == sorted(set(families(texts)))


def test_targets_fill_and_stop():
    assert mixing.targets([100, 100, 100], [5, 2, 1]) == pytest.approx([200, 500 / 3, 250 / 3])
    assert mixing.targets([10, 1000], [5, 2]) == pytest.approx([20, 1495])
    assert mixing.targets([], []) == [] and mixing.targets([0, 10], [5, 2]) == pytest.approx([0, 15])


def test_permutation_is_one():
    for n in (1, 2, 5, 64, 1000):
        got = mixing.permuted(np.arange(n), np.full(n, n), 3)
        assert sorted(got.tolist()) == list(range(n))


def test_mix_meets_targets(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = mixing.taken(docs).collect()
    per = defaultdict(lambda: [0, 0.0])
    source = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        per[source[r.doc_id]][0] += r.taken
        per[source[r.doc_id]][1] = r.target
    assert all(abs(t - g) <= max(192, 0.05 * g) for t, g in per.values())
    again = {(r.doc_id, r.taken) for r in mixing.taken(docs.repartition(7)).collect()}
    assert again == {(r.doc_id, r.taken) for r in got}
    words = Counter()
    for r in mixing.mixed(docs).collect():
        words[r.doc_id] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    assert words == Counter({r.doc_id: r.taken for r in got if r.taken})


def test_mix_replayed_by_brute_force(spark):
    rng = random.Random(13)
    data = [(i, " ".join("w" for _ in range(rng.randrange(0, 700))), "en", rng.choice(["a", "b", None, "Z"]), 0, 0, "", "") for i in range(150)]
    docs = documents(spark, data)
    rows_, _, made = mixing.drawn(docs, 64, 11)
    rows_ = rows_.collect()
    plan = mixing.plan([(s, sum(r.size for r in rows_ if r.s == s)) for s in ("a", "b", None, "Z")], 64, 11, 40)
    assert plan.sources == ["Z", "a", "b", None] and plan.shards > 3
    slots = mixing.slots_of(spark, plan, group=2).collect()
    draws = [mixing.shard_counts(np.array(plan.want), s, plan.shards, 11) for s in range(plan.shards)]
    at, want = [0] * 4, set()
    for shard, counts in enumerate(draws):
        for si, n in enumerate(counts):
            for slot in range(at[si], at[si] + n):
                if slot < 2 * plan.blocks[si]:
                    block = mixing.permuted(np.array([slot % plan.blocks[si]]), np.array([plan.blocks[si]]), 12 + si)[0]
                    want.add((shard, si, slot, int(block)))
            at[si] += int(n)
    assert {tuple(r) for r in slots} == want and len(slots) == len(want)
    whole = Counter((r.si, r.block) for r in mixing.slots_of(spark, made).collect())
    words = {}
    for r in rows_:
        words[r.k] = sum(whole[r.si, p // 64] for p in range(r.place, r.place + r.size))
    assert {r.doc_id: r.taken for r in mixing.taken(docs).collect()} == words


def test_mix_keeps_columns_of_any_name(spark):
    names = ("_n", "_h", "k_", "s_", "h_", "n_", "copy", "parts", "si", "b", "rn", "block", "times", "size", "key_of_row", "nth_of_twins")
    data = [(i, " ".join(f"w{j}" for j in range(20 + i)), f"s{i % 3}", *(1000 * k + i for k in range(len(names)))) for i in range(30)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string, " + ", ".join(f"`{n}` long" for n in names))
    got = mixing.mixed(df).collect()
    assert got and all(r[f] == 1000 * k + r.doc_id for r in got for k, f in enumerate(names))


def test_mix_of_hard_rows(spark):
    got = mixing.taken(documents(spark)).collect()
    assert len(got) == len(rows()) and all(0 <= r.taken <= 2 * r.size for r in got)
    out = mixing.mixed(documents(spark))
    assert out.columns == documents(spark).columns
    assert sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in out.collect()) == sum(r.taken for r in got)
    assert mixing.taken(documents(spark, [])).count() == 0 and mixing.mixed(documents(spark, [])).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>t</title></head><body class="comments-open"><div class="site-header">Home</div>
<div class="wrap has-sidebar"><div class="cookie-notice">We use cookies</div><main><article><header><h1>Ti&amp;tle {n}</h1></header>
<p>One <b>tw</b>o<br>thr&eacute;e {n}<p>Four&nbsp;five <script>x = "</p>"</script>six<div class="share">Share</div>
<form>Sign <input> up</form></article><section id="comments"><article class="comment">Nice</article></section></main>
<aside>Side</aside></div><footer>&copy; all</footer></body></html>"""


def test_structure_of_pages():
    got, bounded = html_text.lines(PAGE.replace("{n}", "1"))
    assert bounded and got == ["Ti&tle 1", "One two thrée 1", "Four five six"]
    assert html_text.lines(None) == ([], False) and html_text.lines("plain &lt;p&gt; text")[0] == ["plain <p> text"]
    assert html_text.lines("<div class=nav>a</div><p>b<!-- c -->d")[0] == ["bd"]


def test_longest_common_lines():
    rng = random.Random(6)

    def slow(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in cartesian(range(len(a)), range(len(b))):
            t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    for _ in range(100):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(9))] for _ in range(2))
        got = html_text.common(a, b)
        it = iter(b)
        assert all(a[k] in it for k in got) and len(got) == slow(a, b)


def test_template_lines_fall_and_copies_stay(spark):
    body = "<div>Same top line</div><p>Body number {n} says {n} and more words {n}</p><div>Same end line</div>"
    data = [(i, f"https://h.example/a/{i}", body.replace("{n}", str(i * 37)), "x") for i in range(8)]
    data += [(20, "https://o.example/b/1", body.replace("{n}", "5"), "x"), (21, "https://o.example/b/2?x=1", body.replace("{n}", "5"), "x"), (22, None, None, "x"), (None, "nonsense", "", "x")]
    df = spark.createDataFrame(data, "page_id long, url string, html string, path string")
    got = {r.page_id: r.text for r in html_text.extracted(df).collect()}
    assert got[3] == "Body number 111 says 111 and more words 111"
    assert got[20] == got[21] == "Same top line Body number 5 says 5 and more words 5 Same end line"
    assert got[22] == "" and got[None] == ""
    assert html_text.extracted(df.where("false")).count() == 0


def test_only_differencing_cleans_an_article(spark):
    """The line stands in every article, in plain paragraphs: structure cannot tell."""
    rng = random.Random(31)
    data = [(i, f"https://h.example/n/{i:04}", f"<article><p>Read our terms first.</p><p>Story {rng.random()} of {i}</p><p>Thanks for reading.</p></article>") for i in range(300)]
    df = spark.createDataFrame(data, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extracted(df).collect()}
    assert all(got[i] == data[i][2].split("<p>")[2].split("</p>")[0] for i in range(300))


def test_text_does_not_depend_on_partitions(spark):
    rng = random.Random(32)
    body = [f"<p>{rng.choice(['menu a', 'menu b', 'menu c'])}</p><p>text {rng.random()}</p><p>{rng.choice(['end x', 'end y'])}</p>" for _ in range(900)]
    body[100:400] = [body[100]] * 300  # copies in a row
    data = [(i, f"https://{'big' if i < 700 else 'h%d' % (i % 5)}.example/p/{i:04}", b) for i, b in enumerate(body)] + [(901, None, "<p>menu a</p>")]
    df = spark.createDataFrame(data, "page_id long, url string, html string")
    found = []
    try:
        for n in (1, 4, 16):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            found.append({r.page_id: r.text for r in html_text.extracted(df.repartition(n + 1), per_bucket=100).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found[0] == found[1] == found[2] and len(found[0]) == 901
    assert len({found[0][i] for i in range(100, 400)}) == 1


def test_differences_by_brute_force(spark):
    """The rule spelled out over a whole host: nearest neighbours that are no copies, lines that most of them have."""
    rng = random.Random(33)
    pages = [[rng.choice("abc") * 9, f"body {rng.random()}", rng.choice("xyz") * 9] for _ in range(40)]
    pages[7] = list(pages[6])
    data = [(i, f"https://h.example/{i:03}", "".join(f"<p>{x}</p>" for x in p)) for i, p in enumerate(pages)]
    got = {r.page_id: r.text for r in html_text.extracted(spark.createDataFrame(data, "page_id long, url string, html string")).collect()}
    for i, own in enumerate(pages):
        near = []
        for side in (pages[:i][::-1], pages[i + 1 :]):
            kept = []
            for other in side:
                if own[1] != other[1] and all(other[1] != x[1] for x in kept) and len(kept) < 4:
                    kept.append(other)
            near += [(pages.index(x), x) for x in kept]
        best = max(near, key=lambda n: html_text.nearness(f"/{i:03}", f"/{n[0]:03}"))[1]
        want = [x for x in own if not (x in best and 2 * sum(x in n for _, n in near) > len(near))]
        assert got[i] == " ".join(want), i


def test_long_alignments_by_bits():
    rng = random.Random(171)

    def length(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            old = list(row)
            for j, y in enumerate(b):
                row[j + 1] = old[j] + 1 if x == y else max(row[j], old[j + 1])
        return row[-1]

    for n in (3, 9, 40, 150):
        for _ in range(20):
            a, b = ([rng.choice("abcdefghijkl"[: rng.choice([2, 4, 12])]) for _ in range(rng.randrange(n))] for _ in range(2))
            got = html_text.common(a, b, most=0)
            it = iter(b)
            assert got == sorted(set(got)) and all(a[k] in it for k in got) and len(got) == length(a, b)
    a, b = ["x", "y"] * 800 + ["end"], ["y"] * 700 + ["x"] * 900 + ["end"]  # over MATCHES places
    assert len(html_text.common(a, b)) == 1 + length(a[:-1], b[:-1])


def slow_texts(pages):
    """The text of each page (path, lines) of a host, all pages looked at."""
    pages = sorted(pages, key=lambda p: p[0].split("/"))
    out = {}
    for i, (path, own) in enumerate(pages):
        sides = []
        for side in (pages[:i][::-1], pages[i + 1 :]):
            sides.append([p for k, p in enumerate(side) if p[1] != own and all(p[1] != x[1] for x in side[:k])])
        usual = html_text.usual_lines(own, [x for side in sides for _, x in side[:8]])
        near = []
        for side in sides:
            found = []
            for p in side:
                theirs = p[1]
                copy = html_text.copies(own, theirs, usual) or any(html_text.copies(theirs, x, usual) for x in [own, *(f[1] for f in found)])
                if len(found) < 4 and not copy:
                    found.append(p)
            near += found
        best = max(near, key=lambda p: html_text.nearness(path, p[0]))[1] if near else []
        drop = html_text.common(own, best)
        out[path] = " ".join(x for k, x in enumerate(own) if not (k in drop and 2 * sum(x in n for _, n in near) > len(near)))
    return out


@pytest.mark.parametrize("per_bucket", [15, 90, 2000])
def test_neighbours_beyond_any_run_of_copies(spark, per_bucket):
    """Runs of equal and of near copies over many buckets, at a host's beginning and within (F17)."""
    rng = random.Random(17)
    tops = ["Top line of the site", "Other top line of it"]
    runs = [(0, "near"), (320, "other"), (345, "equal"), (640, "other"), (670, "mixed"), (760, "end")]
    story, pages = [f"story {rng.random()} " * 6 for _ in range(3)], []
    for (start, kind), (stop, _) in zip(runs, runs[1:], strict=False):
        for i in range(start, stop):
            body = {"near": [story[0], f"part {i}"], "equal": [story[1]], "other": [f"body {rng.random()} " * 4], "mixed": [story[2], f"part {i % 7}"]}[kind]
            pages.append((f"/{i // 50}/{i:04}", [tops[kind == "other" and i % 5 == 0], *body, "Last line"]))
    data = [(i, f"https://h.example{p}", "".join(f"<p>{x}</p>" for x in t)) for i, (p, t) in enumerate(pages)]
    data += [(1000 + i, f"https://{h}.example/{i}", f"<p>Top line of the site</p><p>{h} {i}</p>") for i, h in enumerate("abxyz" * 4)]
    df = spark.createDataFrame(data, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extracted(df, per_bucket=per_bucket).collect()}
    pages = [(p, [" ".join(x.split()) for x in t]) for p, t in pages]
    want = slow_texts(pages)
    assert len(got) == len(data) and not any("Last line" in got[i] for i in range(len(pages)))
    assert [got[i] for i in range(len(pages))] == [want[p] for p, _ in pages]


def test_the_nearest_page_stands_behind_longer_names(spark):
    """/a/b/c shares more parts with /a/b than /a/b-1 does, however many of those there are (F17)."""
    data = [(0, "/a/b", ["motto", "own text of b"]), (1, "/a/b/c", ["motto", "text below b"])]
    data += [(2 + k, f"/a/b-{k}", [f"text {k} beside", "motto" if k % 3 else f"none {k}"]) for k in range(12)]
    df = spark.createDataFrame([(i, f"https://h.example{p}", "".join(f"<p>{x}</p>" for x in t)) for i, p, t in data], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extracted(df).collect()}
    want = slow_texts([(p, t) for _, p, t in data])
    assert got == {i: want[p] for i, p, _ in data} and got[0] == "own text of b"


def slow_cost(codes):
    best = {0: 0.0}
    for c in codes:
        new = {}
        for s, v in best.items():
            for cost, e, _, _ in chat.steps(s, c):
                new[e] = min(new.get(e, 1e9), v + cost)
        best = new
    return min(v + chat.closing(s) for s, v in best.items())


def test_chat_is_legal_and_cheapest(spark):
    rng = random.Random(8)
    roles = ["system", "user", "assistant", " Assistant ", None, "tool"]
    data = [(c, t, rng.choice(roles), rng.choice(["hi <|x|>", None, "", "long " * 3000]), 1) for c in range(40) for t in range(rng.randrange(1, 9))]
    data += [(None, None, "user", "a", 1), (None, 0, "user", "b", 1)] + [(99, 1, "user", "same", 1)] * 3 + [(98, t, "user" if t % 2 else "assistant", str(t), 1) for t in range(3000)]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, run long")
    got = defaultdict(list)
    for r in chat.formatted(df.repartition(5)).orderBy("seq").collect():
        got[r.conv_id].append(r)
    assert sum(map(len, got.values())) == len(data)
    for turns in got.values():
        codes = [next((k + 1 for k, x in enumerate(chat.ROLES) if (r.role or "").strip().lower() == x), 0) for r in turns]
        assert slow_cost(codes) == pytest.approx(sum(r.cost for r in turns))
        text = "".join(r.rendered for r in turns)
        seen = re.findall(r"<\|(system|user|assistant|end)\|>", text)
        assert re.fullmatch(r"(system end )?(user end assistant end )+", " ".join(seen) + " ")
    assert chat.formatted(df.where("false")).count() == 0


def test_runs_multiply():
    rng = np.random.default_rng(2)
    roles = rng.integers(0, 4, 50)
    whole = chat.product(roles)
    parts = [chat.product(roles[i : i + 7]) for i in range(0, 50, 7)]
    assert chat.path(parts, 0, None)[1] == pytest.approx(min(whole[0][s] + chat.closing(s) for s in range(4)))


def test_pipeline_stages(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, rows_in = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns, name
    packed = corpus_pipeline.run(spark, sf)
    assert packed.count() > 0 and packed.select("doc_id").distinct().count() <= rows_in
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, documents(spark), sf).count() >= 0
    assert docs.where(F.col("n_chars") != F.length("text")).count() == 0


def test_written_leaves_no_shuffle_files(spark):
    """They would stay until the driver collects its garbage, and take a block of disk each."""
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        got = disk.getAllFiles().mkString("\n")
        return {f for f in got.split("\n") if "shuffle_" in f}

    before = files()
    counts = written(spark.range(0, 1000, 1, 4).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    end = time.time() + 20
    while files() - before and time.time() < end:
        time.sleep(0.2)
    assert not files() - before
    assert sorted(r["count"] for r in counts.collect()) == [142] * 1 + [143] * 6

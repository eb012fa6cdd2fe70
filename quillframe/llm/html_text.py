"""Main text of web pages: structure first, then differences from the nearest pages of the host.

Pages are read into text lines with the elements around them.  Navigation, forms, notices
and the like fall by their element, role or class; an article or main element, where there
is one, bounds the rest.  Pages then stand by host and URL path; each is paired with the
nearest page that is no copy of it, and their lines are aligned by longest common
subsequence.  A shared line is template text, and is deleted, if most other neighbours of
the host have it too; within an article element, if all of at least three have it.

The neighbours are the REACH nearest on each side that are no copies of the page or of one
another, however far away they stand: copies, equal or near (most of their text beside the
host's common lines is shared), count as one.  Paths are in the order of their parts, so the
first page that is no copy is the nearest one of its side.  Neighbours are found on lines as
hash and length; rows go into buckets by ranges of (host, path), whose bounds are quantiles of a
sample by hash, with the pages on both sides of a border in both.  Pages that find too few
neighbours before the end of what their bucket sees are decided again with ever more buckets
beside it, until the host ends (lists of lines that a bucket repeats come once or twice).  The text depends
neither on the number of partitions nor on the buckets.  Near copies that are not equal are
looked at one by one: in a run of n, the looks are as many as n squared.

Defined cases: a null or empty page gives the empty text; a null URL pairs with nothing;
copies of a page never delete each other's lines; repeated rows stay; unclosed elements
end with their parent; two pages that match in over MATCHES places are aligned by a longest
common subsequence of bits; an empty table gives an empty one; further columns are not carried.
Rows are told apart by two 64-bit hashes of key, URL and page, equal rows have one text.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, OrderedDict
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from html import unescape
from itertools import islice
from operator import itemgetter
from tempfile import SpooledTemporaryFile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillframe.llm.common import bisected, dropped, written

# Elements by how they bear on text.
RAW = "script|style|noscript|template|svg|iframe|textarea|select|title|video|audio|head"
BOILERPLATE = frozenset("nav footer aside form menu dialog button search".split())
CONTENT = frozenset("article main".split())
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: A new one of these ends an open one of the same set.
CLOSING = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "tr": {"tr", "td", "th", "p"}}
#: Parts of class, id and role names that mark text which is not the article.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adslot banner banners breadcrumb breadcrumbs comment comments "
    "commentlist complementary consent contentinfo cookie cookies copyright disclaimer discussion disqus feedback footer form gdpr legal "
    "login masthead menu menus modal nav navbar navigation newsletter notice notices notification notifications pager pagination popup "
    "promo promoted promotion recommended related replies reply respond search share sharing sidebar signup social sponsor sponsored "
    "subscribe subscription toolbar widget widgets alert dialog topbar skip".split()
)
#: Marks that hold for an article element too: a comment or a teaser may be one.
CARDS = frozenset("ad ads advert advertisement comment comments promo promoted related reply sponsored".split())
#: In an article element these fall only for the marks above: a paragraph may be named "legal" or "related".
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th figcaption caption span em strong b i u small".split())
NEGATED = frozenset("has with no without hide open".split())

TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>(?:.*?</\1\s*>|.*\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/a-zA-Z][^>]*>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
NAME = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


def marked(tag: str, attributes: str, content: bool) -> bool:
    """Whether an element's class, id or role, or its being hidden, keeps its text out (within content or not)."""
    marks = CARDS if tag in CONTENT or content and tag in TEXTUAL else MARKS
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
        if name in ("class", "id", "role"):
            before = ""
            for part in NAME.findall(value):
                part = part.lower()
                if (part in marks or part == "header" and not content and tag not in CONTENT) and before not in NEGATED:
                    return True
                before = part
    return False


def lines(html: str | None) -> tuple[list[str], bool]:
    """The text lines of a page outside boilerplate, in order, and whether an article element bounds them."""
    if not html:
        return [], False
    found: list[tuple[str, bool, tuple]] = []  # text, inside content, flags that may fall
    stack: list[tuple[str, list[bool] | None, bool]] = []  # tag, [flag] or None, content
    piece: list[str] = []
    flags: tuple = ()
    content = False

    def end_line() -> None:
        if piece:
            text = " ".join(unescape("".join(piece)).split())
            if text:
                found.append((text, content, flags))
            piece.clear()

    def settle() -> None:
        nonlocal flags, content
        flags = tuple(f for _, f, _ in stack if f is not None)
        content = any(c for _, _, c in stack)

    at = 0
    for m in TOKEN.finditer(html):
        if m.start() > at:
            piece.append(html[at : m.start()])
        at = m.end()
        if m[3] is None:
            continue
        tag = m[3].lower()
        if tag == "br":
            piece.append(" ")
            continue
        if tag not in BLOCKS:
            if tag not in ("span", "a", "label", "small", "em", "strong", "b", "i", "u") or m[2] or not m[4] or not marked(tag, m[4], content):
                if not (m[2] and any(t == tag for t, _, _ in stack)):
                    continue
        elif not m[2]:
            ends = CLOSING.get(tag, {"p"})
            if stack and stack[-1][0] in ends:
                end_line()
                while stack and stack[-1][0] in ends:
                    stack.pop()
                settle()
        end_line()
        if m[2]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
        elif tag != "hr" and not m[4].endswith("/"):
            flag = None
            mine = bool(m[4]) and tag not in ("html", "body") and marked(tag, m[4], content)
            if mine or tag in BOILERPLATE or tag == "header" and not content:
                flag = [True]
            if tag in CONTENT and not mine:
                for _, f, _ in stack:
                    if f is not None:
                        f[0] = False  # what holds the article is no boilerplate
            stack.append((tag, flag, tag in CONTENT and not mine))
        settle()
    piece.append(html[at:])
    end_line()
    kept = [(t, c) for t, c, fs in found if not any(f[0] for f in fs)]
    if any(c for _, c in kept):
        return [t for t, c in kept if c], True
    return [t for t, _ in kept], False


#: Above so many matching places two pages are aligned by bits.
MATCHES = 1_000_000
#: Distinct neighbours on each side that decide, and different pages on each side whose lines may be usual ones.
REACH, SIDE = 4, 8
#: Bytes of a host's lines that a task holds in memory; beyond them they lie in a temporary file.
HELD = 1 << 26


def _lengths(a: list, b: list) -> np.ndarray:
    """The length of a longest common subsequence of a and each beginning of b, with a bit for each line of b."""
    size, full = len(b) // 8 + 1, (1 << len(b)) - 1
    where: dict = {}
    for j, line in enumerate(b):
        where.setdefault(line, []).append(j)
    often: dict = {}  # fewer than 64 lines
    now = full
    for line in a:
        at = where.get(line)
        if at is None:
            continue
        mask = often.get(line)
        if mask is None:
            held = bytearray(size)
            for j in at:
                held[j >> 3] |= 1 << (j & 7)
            mask = int.from_bytes(held, "little")
            if 64 * len(at) > len(b):
                often[line] = mask
        both = now & mask
        now = ((now + both) | (now - both)) & full
    bits = np.unpackbits(np.frombuffer(now.to_bytes(size, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _aligned(a: list, b: list) -> list[int]:
    """Indices in a of a longest common subsequence of a and b, by halves of a: memory grows with the lines, not with their matches."""
    head = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    out, x, y = list(range(head)), a[head:], b[head:]
    tail = next((k for k, (u, v) in enumerate(zip(reversed(x), reversed(y), strict=False)) if u != v), min(len(x), len(y)))
    x, y = x[: len(x) - tail], y[: len(y) - tail]
    if len(x) == 1:
        out += [head] if x[0] in y else []
    elif x and y:
        half = len(x) // 2
        cut = int(np.argmax(_lengths(x[:half], y) + _lengths(x[half:][::-1], y[::-1])[::-1]))
        out += [head + k for k in _aligned(x[:half], y[:cut])] + [head + half + k for k in _aligned(x[half:], y[cut:])]
    return out + list(range(len(a) - tail, len(a)))


def common(a: list, b: list, most: int = MATCHES) -> list[int]:
    """Indices in a of a longest common subsequence of a and b (by runs of matches)."""
    times = Counter(b)
    if sum(times[x] for x in a) > most:
        return _aligned(a, b)
    where: dict = {}
    for j, line in enumerate(b):
        where.setdefault(line, []).append(j)
    tails: list[int] = []
    links: list[tuple[int, object]] = []
    for i, line in enumerate(a):
        for j in reversed(where.get(line, ())):
            k = bisect_left(tails, j)
            node = (i, links[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                links.append(node)
            else:
                tails[k], links[k] = j, node
    out, node = [], links[-1] if links else None
    while node is not None:
        out.append(node[0])
        node = node[1]
    return out[::-1]


def nearness(a: str, b: str) -> tuple[int, int]:
    """Shared leading parts of two URL paths, then shared leading characters."""
    pa_, pb = a.split("/"), b.split("/")
    same = next((k for k, (x, y) in enumerate(zip(pa_, pb, strict=False)) if x != y), min(len(pa_), len(pb)))
    chars = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return same, chars


def copies(own: list, other: list, usual: set, size: Callable = len) -> bool:
    """Whether over half of own's text, beside the host's usual lines, stands in the other page too."""
    if own == other:
        return True
    mine = [x for x in own if x not in usual]
    left = Counter(other)
    shared = 0
    for x in mine:
        if left[x] > 0:
            left[x] -= 1
            shared += size(x)
    return 2 * shared > sum(map(size, mine))


def template(own: list, bounded: bool, path: str, others: list[tuple[str, list]]) -> set[int]:
    """Indices of the lines of own that it shares with its nearest page and that are template text.

    others: path and lines of the neighbours, none of them a copy, the nearest ones of each side.
    """
    if not others:
        return set()
    best = max(others, key=lambda o: nearness(path, o[0]))
    holders = Counter(x for _, theirs in others for x in set(theirs))
    # in an article a line that some pages share may be their authors' own: a licence, a motto
    return {k for k in common(own, best[1]) if (holders[own[k]] == len(others) >= 3 if bounded else 2 * holders[own[k]] > len(others))}


def usual_lines(own: list, pages: list[list], size: Callable = len) -> set:
    """Lines that most of at least three pages have; none if they are nearly all of own, which then is one of many copies."""
    times = Counter(x for p in pages for x in set(p))
    usual = {x for x, n in times.items() if len(pages) > 2 and 2 * n > len(pages)}
    return usual if 5 * sum(size(x) for x in own if x not in usual) >= sum(map(size, own)) else set()


def distinct(pages: Iterable[tuple[object, list]], own: list, usual: set, size: Callable = len) -> list[tuple[object, list]]:
    """The first REACH of the pages (any name, lines) that are copies neither of own nor of one before."""
    out: list[tuple[object, list]] = []
    for name, theirs in pages:
        if not copies(own, theirs, usual, size) and not copies(theirs, own, usual, size) and not any(copies(theirs, x, usual, size) for _, x in out):
            out.append((name, theirs))
            if len(out) == REACH:
                break
    return out


class Sheets:
    """Lists of lines (hash, length) by number, equal ones once."""

    def __init__(self) -> None:
        self.file, self.end, self.places, self.known = SpooledTemporaryFile(HELD), 0, [], {}
        self.lines = lru_cache(64)(self._lines)

    def add(self, hashes: np.ndarray, sizes: np.ndarray) -> int:
        from xxhash import xxh3_128_digest

        raw = np.stack([hashes, sizes]).astype("<i8").tobytes()
        number = self.known.setdefault(xxh3_128_digest(raw), len(self.places))
        if number == len(self.places):
            self.file.seek(self.end)
            self.file.write(raw)
            self.places.append((self.end, len(raw)))
            self.end += len(raw)
        return number

    def _lines(self, number: int) -> list[tuple[int, int]]:
        at, size = self.places[number]
        self.file.seek(at)
        return list(zip(*np.frombuffer(self.file.read(size), "<i8").reshape(2, -1).tolist(), strict=True))


def walked(order: range, ids: list[int]) -> Iterator[tuple[int, Iterator[int]]]:
    """Each page in order, with the last place of every other list of lines that came before, the latest first."""
    last: OrderedDict[int, int] = OrderedDict()
    for i in order:
        yield i, (j for number, j in reversed(last.items()) if number != ids[i])
        last[ids[i]] = i
        last.move_to_end(ids[i])


def decided(paths: list[str], ids: list[int], bounded: list[bool], wanted: list[int], sheets: Sheets, ends: tuple[bool, bool]) -> Iterator[tuple[int, set[int] | None]]:
    """For each wanted page of a host's pages in order, the lines that fall, or None if pages beyond an end may matter.

    ends: whether the host begins with the first page, and ends with the last.
    """
    orders = (range(len(ids)), range(len(ids) - 1, -1, -1))
    near: list[list] = [[()] * len(ids) for _ in orders]
    for side, order in zip(near, orders, strict=True):
        for i, others in walked(order, ids):
            side[i] = tuple(islice(others, SIDE))
    size = itemgetter(1)

    def picked(i: int, others: Iterable[int]) -> list[int]:
        own = sheets.lines(ids[i])
        usual = usual_lines(own, [sheets.lines(ids[j]) for side in near for j in side[i]], size)
        return [j for j, _ in distinct(((j, sheets.lines(ids[j])) for j in others), own, usual, size)]

    wanted = [i for i in wanted if sheets.lines(ids[i])]
    got: list[dict[int, list[int]]] = [{i: picked(i, side[i]) for i in wanted} for side in near]
    for side, found, order in zip(near, got, orders, strict=True):
        far = {i for i in wanted if len(found[i]) < REACH and len(side[i]) == SIDE}
        for i, others in walked(order, ids) if far else ():
            if i in far:
                found[i] = picked(i, others)
    for i in wanted:
        if any(not end and (len(side[i]) < SIDE or len(found[i]) < REACH) for end, side, found in zip(ends, near, got, strict=True)):
            yield i, None
        else:
            yield i, template(sheets.lines(ids[i]), bounded[i], paths[i], [(paths[j], sheets.lines(ids[j])) for found in got for j in found[i]])


def buckets(places: DataFrame, place: str, per_bucket: int, most: int = 16_384, fine: int = 64) -> tuple[list, list, list]:
    """Bounds of buckets of about per_bucket rows by the order of place, and for each the values a little below and above.

    Bounds are quantiles of the values of least hash, ``fine`` of them for each bucket, so they are the same wherever rows lie.
    """
    wanted = min(most, places.count() // per_bucket)
    if wanted < 2:
        return [], [], []
    drawn = places.select(place).distinct().orderBy(F.xxhash64(place)).limit(fine * wanted)
    values = [r[0] for r in drawn.orderBy(place).collect()]
    at = [k for k in range(fine, len(values) - 1, fine)]
    return [values[k] for k in at], [values[k - 1] for k in at], [values[k + 1] for k in at]


def paired(rows: DataFrame, last: int, beside: int) -> DataFrame:
    """(r, h, bucket, keep) of the rows that are no guards and lose lines (keep: which stay) or are not decided (keep: null).

    A bucket holds all rows of as many buckets beside it, of 0 to last, and maybe some more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def closed(more: bool) -> pa.RecordBatch:
            """The rows of a host; more: its bucket has another host after it."""
            bucket, _ = now
            paths, ids, bounded, guard, r, h = zip(*held, strict=True)
            ends = (after or bucket - beside <= 0, more or bucket + beside >= last)
            out = []
            for i, drop in decided(paths, ids, bounded, [i for i, g in enumerate(guard) if not g], sheets, ends):
                if drop is None or drop:
                    out.append((r[i], h[i], bucket, None if drop is None else [k not in drop for k in range(len(sheets.lines(ids[i])))]))
            types = {"r": pa.int64(), "h": pa.int64(), "bucket": pa.int32(), "keep": pa.list_(pa.bool_())}
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(types.values())], names=list(types))

        now, after, held, sheets = None, False, [], Sheets()
        for batch in batches:
            hashes, sizes = batch.column(7), batch.column(8)
            for k, (bucket, host, path, bounded, guard, r, h) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(7)), strict=True)):
                if (bucket, host) != now:
                    if held:
                        yield closed(bucket == now[0])
                    now, after, held, sheets = (bucket, host), now is not None and now[0] == bucket, [], Sheets()
                held.append((path, sheets.add(hashes[k].values.to_numpy(), sizes[k].values.to_numpy()), bounded, guard, r, h))
        if held:
            yield closed(False)

    dealt = rows.repartition("bucket").sortWithinPartitions("bucket", "host", "place", "k", "r", "h", "guard")
    return dealt.select("bucket", "host", "path", "bounded", "guard", "r", "h", "hashes", "sizes").mapInArrow(run, "r long, h long, bucket int, keep array<boolean>")


def kept(pages: DataFrame, per_bucket: int) -> list[DataFrame]:
    """Tables (r, h, keep) of the pages (k, r, h, host, path, place, html) that lose lines."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            got = [lines(x.as_py()) for x in batch.column(6)]
            hashes = [np.array([xxh64_intdigest(x.encode("utf-8", "surrogatepass")) for x in t], np.uint64).view(np.int64) for t, _ in got]
            columns = [pa.array([b for _, b in got], pa.bool_()), pa.array(hashes, pa.list_(pa.int64())), pa.array([[len(x) for x in t] for t, _ in got], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(6)), *columns], names=["k", "r", "h", "host", "path", "place", "bounded", "hashes", "sizes"])

    kind = pages.schema["k"].dataType.simpleString()
    rows = pages.where("host <> ''").select("k", "r", "h", "host", "path", "place", "html").mapInArrow(
        read, f"k {kind}, r long, h long, host string, path string, place string, bounded boolean, hashes array<long>, sizes array<long>"
    )
    lines_ = written(rows, "lines")
    bounds, below, above = buckets(lines_, "place", per_bucket)
    rows = lines_.withColumn("own", bisected(F.col("place"), bounds))
    # rows just below a bound go to the bucket above as well, and the other way round
    beside = F.when(F.col("own") < bisected(F.col("place"), below), F.col("own") + 1).when(F.col("own") > bisected(F.col("place"), above), F.col("own") - 1)

    def pair(bucket: Column, guard: Column) -> Column:
        return F.struct(bucket.cast("int").alias("bucket"), guard.alias("guard"))

    dealt = [pair(F.col("own"), F.lit(False))] + ([F.when(beside.isNotNull(), pair(beside, F.lit(True)))] if bounds else [])
    todo = rows.withColumn("b", F.explode(F.array_compact(F.array(*dealt)))).select("*", "b.bucket", "b.guard")
    out, wide = [], 0
    while True:
        found = written(paired(todo, len(bounds), wide), "kept")
        out.append(found.where("keep IS NOT NULL").select("r", "h", "keep"))
        wide = max(1, 4 * wide)
        open_ = found.where("keep IS NULL").select("r", "h").distinct()
        at = sorted(x[0] for x in found.where("keep IS NULL").select("bucket").distinct().collect())
        if not at:
            dropped(lines_)
            return out
        targets = [(c, b) for b in at for c in range(max(0, b - wide), min(len(bounds), b + wide) + 1)]
        targets = rows.sparkSession.createDataFrame(targets, "own int, bucket int")
        same = Window.partitionBy("own", "host", F.xxhash64("hashes", "sizes")).orderBy("place", "k", "r", "h")
        some = rows.join(F.broadcast(targets.select("own").distinct()), "own", "left_semi")
        # of a list of lines the other buckets need the first and the last place
        some = some.withColumn("edge", F.lag("r").over(same).isNull() | F.lead("r").over(same).isNull())
        some = some.join(F.broadcast(targets), "own").where("edge OR own = bucket").join(open_.withColumn("open", F.lit(True)), ["r", "h"], "left")
        todo = some.withColumn("guard", (F.col("own") != F.col("bucket")) | F.col("open").isNull())


def extracted(pages: DataFrame, per_bucket: int = 2_000, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, url and text of every page."""
    kind = pages.schema[key].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = pa.array([lines(x.as_py())[0] for x in batch.column(4)], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(4)), got], names=["k", "url", "r", "h", "lines"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = pa.array([" ".join(lines(x.as_py())[0]) for x in batch.column(4)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), got], names=[key, "url", "text"])

    place = F.regexp_replace(F.coalesce(F.col(url), F.lit("")), r"[?#].*$", "")
    host = F.lower(F.regexp_extract(place, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:]*)", 1))
    path = F.regexp_extract(place, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*(.*)$", 1)
    names = F.xxhash64(key, url, html).alias("r"), F.xxhash64(F.lit("row"), F.col(html), F.col(url), F.col(key)).alias("h")
    rows = pages.select(F.col(key).alias("k"), F.col(url).alias("url"), *names, host.alias("host"), path.alias("path"), F.col(html).alias("html"))
    # the parts of paths in order: "/" before all other characters
    tables = kept(rows.withColumn("place", F.concat_ws(" ", "host", F.translate("path", "/", "\x01"))), per_bucket)
    rows = rows.select("k", "url", "r", "h", "html")
    tables = [t for t in tables if not t.isEmpty()]
    if not tables:
        return rows.mapInArrow(joined, f"`{key}` {kind}, url string, text string")
    keep = tables[0]
    for table in tables[1:]:
        keep = keep.unionByName(table)
    both = rows.mapInArrow(read, f"k {kind}, url string, r long, h long, lines array<string>").join(keep.dropDuplicates(["r", "h"]), ["r", "h"], "left")
    stay = F.filter("lines", lambda x, i: F.coalesce(F.get("keep", i), F.lit(True)))
    return both.select(F.col("k").alias(key), "url", F.array_join(stay, " ").alias("text"))

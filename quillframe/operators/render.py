"""From paragraphs to what is drawn: character classes, typesetting units, fonts, added rows, names."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillframe.functions import geometry as G

# Punctuation that may hang over a line's end.
HANGING = list(",.:;?!，。．、：；！‼？⁇”’」』)]}）〕〉】〗］｝》～-–—·・‧/／⁄")
# Punctuation that may not end a line.
OPENING = list("“‘「『([{（〔〈《〖〘〚")
# Blocks of scripts set without spaces, as one character class, and their full-width signs.
CJK = (
    r"\x{3000}-\x{303f}\x{3040}-\x{309f}\x{30a0}-\x{30ff}\x{3100}-\x{312f}\x{ac00}-\x{d7af}\x{1100}-\x{11ff}\x{3130}-\x{318f}\x{a960}-\x{a97f}"
    r"\x{d7b0}-\x{d7ff}\x{3190}-\x{319f}\x{3200}-\x{32ff}\x{3300}-\x{33ff}\x{fe30}-\x{fe4f}\x{4e00}-\x{9fff}\x{2e80}-\x{2eff}\x{31c0}-\x{31ef}\x{2f00}-\x{2fdf}\x{fe10}-\x{fe1f}"
    r"\x{3400}-\x{4dbf}\x{f900}-\x{faff}\x{20000}-\x{323af}\x{ff01}-\x{ff60}\x{ffe0}-\x{ffe6}"
)
HALF_SPACES = 4  # a first line's indent


def is_cjk(ch: Column) -> Column:
    return ch.rlike(f"^[{CJK}]$")


def character_class(ch: Column) -> Column:
    """space, hanging, opening, cjk or other."""
    return F.when(ch == " ", "space").when(ch.isin(*HANGING), "hanging").when(ch.isin(*OPENING), "opening").when(is_cjk(ch), "cjk").otherwise("other")


def can_break(ch: Column) -> Column:
    """Whether a line may break at a character: spaces, and scripts set without spaces unless they open something."""
    return (ch == " ") | (is_cjk(ch) & ~ch.isin(*OPENING)) | ch.isin("-", "–", "—")


def mixed_gap(before: Column, ch: Column) -> Column:
    """Whether a half space is set between two characters: one of a script without spaces beside one of another, neither a sign."""
    plain = lambda c: (c != " ") & ~c.isin(*HANGING) & ~c.isin(*OPENING)
    return F.coalesce(plain(before) & plain(ch) & (is_cjk(before) != is_cjk(ch)), F.lit(False))


def units(paras: DataFrame, glyphs: DataFrame, em: float = 10.0) -> DataFrame:
    """Typesetting units of paragraphs (doc_id, para_no, text): a row for each character that has a glyph, with its width.

    glyphs: ch, width in thousandths; line breaks and characters without a glyph fall.
    """
    each = paras.select("doc_id", "para_no", F.posexplode(F.split("text", "")).alias("place", "ch")).where("ch <> '' AND ch <> '\n'")
    return each.join(F.broadcast(glyphs), "ch").select("doc_id", "para_no", "place", "ch", (F.col("width") / 1000 * em).alias("width"))


def wrap(widths: list[float], classes: list[str], gaps: list[bool], wide: float, scale: float, em: float, indent: bool) -> list[tuple[float, int]]:
    """Place (x, line) of each unit: breaks at overflow, at a word that does not fit, and before an opening sign near the
    end; hanging signs may stand over; half spaces between scripts; the first line may be indented."""
    half = 0.25 * em * scale
    x, line, out = HALF_SPACES * half * 2 if indent else 0.0, 0, []
    ahead = [0.0] * (len(widths) + 1)  # the width up to the next place where a line may break
    for k in range(len(widths) - 1, -1, -1):
        ahead[k] = 0.0 if classes[k] in ("space", "cjk") else widths[k] * scale + ahead[k + 1]
    for k, w in enumerate(widths):
        w *= scale
        if gaps[k] and x > 0:
            x += half
        over = x + w > wide and classes[k] != "hanging"
        begins = k == 0 or classes[k - 1] in ("space", "cjk", "hanging")
        word = begins and classes[k] == "other" and ahead[k] <= wide and x + ahead[k] > wide
        opens = classes[k] == "opening" and x + 2 * w > wide
        if x > 0 and (over or word or opens):
            x, line = 0.0, line + 1
            if classes[k] == "space":
                out.append((x, line))
                continue
        out.append((x, line))
        x += w
    return out


def wrapped(rows: DataFrame, scale: float = 1.0, em: float = 10.0) -> DataFrame:
    """Paragraphs (doc_id, para_no, wide, and ordered arrays widths, classes, gaps) with their lines and the widest one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, para, wide, widths, classes, gaps = (c.to_pylist() for c in batch.columns)
            got = [wrap(w, c, g, x, scale, em, False) for w, c, g, x in zip(widths, classes, gaps, wide, strict=True)]
            lines = [g[-1][1] + 1 if g else 0 for g in got]
            most = [max((x + w * scale for (x, _), w in zip(g, ws, strict=True)), default=0.0) for g, ws in zip(got, widths, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lines, pa.int32()), pa.array(most, pa.float64())], names=["doc_id", "para_no", "n_lines", "widest"])

    return rows.select("doc_id", "para_no", "wide", "widths", "classes", "gaps").mapInArrow(run, "doc_id long, para_no int, n_lines int, widest double")


def wrapped_texts(paras: DataFrame, glyphs: DataFrame, scale: float = 1.0, em: float = 10.0) -> DataFrame:
    """Paragraphs (doc_id, para_no, wide, text) with their lines and the widest one, over the units that ``units`` gives, without half spaces.

    A paragraph's units come from its own row and the table of glyphs goes to the tasks, so
    characters are never rows.
    """
    table: dict[str, list[tuple[float, str]]] = {}
    for ch, w, c in glyphs.select("ch", F.col("width") / 1000 * em, character_class(F.col("ch"))).collect():
        if ch and ch != "\n":
            table.setdefault(ch, []).append((w, c))
    table = {ch: sorted(v) for ch, v in table.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, para, wide, text in zip(batch.column(0), batch.column(1), batch.column(2), batch.column(3), strict=True):
                found = [u for ch in text.as_py() or "" for u in table.get(ch, ())]
                if found:
                    widths, classes = map(list, zip(*found, strict=True))
                    got = wrap(widths, classes, [False] * len(widths), wide.as_py(), scale, em, False)
                    rows.append((doc.as_py(), para.as_py(), got[-1][1] + 1, max(x + w * scale for (x, _), w in zip(got, widths, strict=True))))
            columns = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.float64()), strict=True)], names=["doc_id", "para_no", "n_lines", "widest"])

    return paras.select("doc_id", "para_no", "wide", "text").mapInArrow(run, "doc_id long, para_no int, n_lines int, widest double")


def font_family(lang: Column) -> Column:
    """The family of fonts of a language code."""
    code = F.upper(lang)
    return F.when(code.contains("KR"), "KR").when(code.contains("JP") | code.contains("JA"), "JP").when(code.contains("HK"), "HK").when(code.contains("TW"), "TW").when(code.contains("EN"), "EN").when(code.contains("CN"), "CN").otherwise("EN")


def chosen_fonts(chars: DataFrame, fonts: DataFrame, glyphs: DataFrame) -> DataFrame:
    """The font of each distinct character: the first kind that has it in the order script, normal, fallback, then any.

    fonts: font, kind, bold, italic; glyphs: font, ch; chars: ch, bold, italic.  Fonts of the
    character's own flags come before others of the kind.
    """
    order = F.when(F.col("kind") == "script", 0).when(F.col("kind") == "normal", 1).when(F.col("kind") == "fallback", 2).otherwise(3)
    flags = (F.col("f_bold") != F.col("bold")).cast("int") + (F.col("f_italic") != F.col("italic")).cast("int")
    known = glyphs.join(F.broadcast(fonts.withColumnRenamed("bold", "f_bold").withColumnRenamed("italic", "f_italic")), "font")
    met = chars.select("ch", "bold", "italic").distinct().join(known, "ch", "left")
    return met.groupBy("ch", "bold", "italic").agg(F.min_by("font", F.struct(order, flags, "font")).alias("font"))


def fonts_of_pages(used: DataFrame, pages: DataFrame) -> DataFrame:
    """Fonts to register on each page and object: those that the document uses at all."""
    return pages.select("doc_id", "page_no", "xobj_id").distinct().join(used.select("doc_id", "font").distinct(), "doc_id")


def backgrounds(paras: DataFrame, layouts: DataFrame) -> DataFrame:
    """White rectangles: a paragraph's box and its layout's, together."""
    l = layouts.select("doc_id", "page_no", "layout_id", *[F.col(c).alias(f"l{c}") for c in ("x", "y", "x2", "y2")])  # noqa: E741
    got = paras.join(l, ["doc_id", "page_no", "layout_id"], "left")
    edge = lambda f, c: f(F.col(c), F.coalesce(f"l{c}", c)).alias(c)
    return got.select("doc_id", "page_no", "para_seq", edge(F.least, "x"), edge(F.least, "y"), edge(F.greatest, "x2"), edge(F.greatest, "y2"))


def overlays(paras: DataFrame, pages: DataFrame) -> DataFrame:
    """Debug rows: a label above each paragraph, and each page's number (from 1) in its corner."""
    named = paras.select("doc_id", "page_no", F.concat(F.lit("paragraph["), F.col("label"), F.lit("]")).alias("text"), F.col("x"), F.col("y2").alias("y"))
    return named.unionByName(pages.select("doc_id", "page_no", F.concat(F.lit("page "), F.col("page_no") + 1).alias("text"), F.lit(50.0).alias("x"), F.lit(20.0).alias("y")))


def filter_hints(paras: DataFrame, hint: str) -> DataFrame:
    """A hint row above each paragraph whose answer was refused by a content filter."""
    refused = paras.where(F.col("error") == "content_filter")
    return paras.select("doc_id", "para_no", F.lit(1).alias("sub"), "text").unionByName(refused.select("doc_id", "para_no", F.lit(0).alias("sub"), F.lit(hint).alias("text")))


def with_mark(paras: DataFrame, mark: str, first: int = 0) -> DataFrame:
    """Paragraphs and the mark as one more on the first page of each document."""
    pages = paras.groupBy("doc_id").agg(F.min("page_no").alias("page_no")).where(F.col("page_no") == first)
    return paras.select("doc_id", "page_no", "text").unionByName(pages.select("doc_id", "page_no", F.lit(mark).alias("text")))


def output_name(stem: Column, debug: Column, marked: Column, lang: str, kind: str) -> Column:
    """A result's file name."""
    return F.concat_ws(".", stem, F.when(debug, "debug"), F.when(~marked, "no_watermark"), F.lit(lang), F.lit(kind), F.lit("pdf"))


def page_string(pages: Column) -> Column:
    """Page numbers from 0 as ranges from 1: 1-3,5."""
    ordered = F.array_sort(F.array_distinct(pages))
    # pages that follow on one another have the same distance to their place
    groups = F.array_distinct(F.transform(ordered, lambda p, i: p - i.cast("long")))

    def one(g: Column) -> Column:
        run = F.filter(ordered, lambda p, i: p - i.cast("long") == g)
        low, high = F.array_min(run) + 1, F.array_max(run) + 1
        return F.when(low == high, low.cast("string")).otherwise(F.concat(low.cast("string"), F.lit("-"), high.cast("string")))

    return F.array_join(F.transform(groups, one), ",")


def drawn_curves(curves: DataFrame, debug: bool = False) -> DataFrame:
    """Curves worth drawing: passed through or of debug marks; in debug mode all."""
    return curves if debug else curves.where("passthrough OR debug_info")


def contained(elements: DataFrame, boxes: DataFrame, least: float = 0.95) -> DataFrame:
    """Elements that lie within some box of their page."""
    b = boxes.select("doc_id", "page_no", F.struct("x", "y", "x2", "y2").alias("b")).groupBy("doc_id", "page_no").agg(F.collect_list("b").alias("boxes"))
    e = tuple(F.col(f"e{c}") for c in ("x", "y", "x2", "y2"))
    inside = F.exists("boxes", lambda x: G.overlap_ratio(e, (x["x"], x["y"], x["x2"], x["y2"])) >= least)
    return elements.join(b, ["doc_id", "page_no"]).where(inside).drop("boxes")


def upper_median_gap(lines: DataFrame, default: float = 10.0) -> DataFrame:
    """The upper median distance between lines of a page."""
    order = Window.partitionBy("doc_id", "page_no").orderBy(F.desc("y"))
    gaps = lines.withColumn("gap", F.lag("y").over(order) - F.col("y"))
    listed = gaps.groupBy("doc_id", "page_no").agg(F.array_sort(F.collect_list(F.when(F.col("gap") > 0, F.col("gap")))).alias("g"))
    return listed.select("doc_id", "page_no", F.coalesce(F.get("g", F.floor(F.size("g") / 2).cast("int")), F.lit(default)).alias("spacing"))


def snapshots(ops: DataFrame) -> DataFrame:
    """For each text operation the last arguments of every state operator before it, as one string in the order of their setting."""
    order = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    names = ("w", "J", "g", "rg")
    last = ops
    for n in names:
        last = last.withColumn(f"at_{n}", F.max(F.when(F.col("op") == n, F.struct("seq", "args"))).over(order))
    listed = F.array_sort(F.array_compact(F.array(*[F.when(F.col(f"at_{n}").isNotNull(), F.struct(F.col(f"at_{n}.seq").alias("s"), F.concat(F.col(f"at_{n}.args"), F.lit(f" {n}")).alias("t"))) for n in names])))
    return last.where("op = 'Tj'").select("doc_id", "seq", F.array_join(F.transform(listed, lambda x: x["t"]), " ").alias("state"))


def clip_moved(points: Column, old: list[Column], new: list[Column]) -> Column:
    """Points of a clip path kept under one matrix, as they are under another: back through the first, then by the second."""
    m = G.multiply(new, G.inverted(old))
    return F.transform(points, lambda p: F.struct(*[c.alias(n) for c, n in zip(G.applied(m, p["x"], p["y"]), ("x", "y"), strict=True)]))

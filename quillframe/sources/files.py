"""Files in and out: glossaries as CSV, page tables as XML and JSON, event logs as JSON lines."""

from __future__ import annotations

import csv
import io
import os

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.operators.text import language_fits


def read_glossary(spark: SparkSession, path: str, lang_out: str) -> DataFrame:
    """Rows of glossary files that fit the language; the file's stem names the glossary.

    Rows without source or target fall; a file without tgt_lng fits every language.
    """
    rows = spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    if "tgt_lng" not in rows.columns:
        rows = rows.withColumn("tgt_lng", F.lit(None).cast("string"))
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(\.[^./]*)?$", 1)
    kept = rows.where("source IS NOT NULL AND target IS NOT NULL").where(language_fits(F.col("tgt_lng"), F.lit(lang_out)))
    return kept.select(name.alias("glossary_name"), "source", "target", "tgt_lng")


def decoded(content: Column) -> Column:
    """The text of a file: by its byte order mark, else UTF-8, else Latin-1."""

    @F.pandas_udf("string")
    def decode(blobs: pd.Series) -> pd.Series:
        out = []
        for b in blobs:
            marked = next((e for m, e in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")) if b.startswith(m)), None)
            try:
                out.append(b.decode(marked or "utf-8"))
            except UnicodeDecodeError:
                out.append(b.decode("latin-1"))
        return pd.Series(out, dtype=object)

    return decode(content)


def read_glossary_any(spark: SparkSession, path: str, lang_out: str) -> DataFrame:
    """read_glossary for files of any of these encodings; a file without the columns source and target has no rows."""
    whole = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1).alias("glossary_name"), decoded(F.col("content")).alias("text"))

    @F.pandas_udf("array<struct<source:string,target:string,tgt_lng:string>>")
    def rows(texts: pd.Series) -> pd.Series:
        found = []
        for t in texts:
            lines = csv.DictReader(io.StringIO(t))
            known = {"source", "target"} <= set(lines.fieldnames or ())
            found.append([{"source": r["source"], "target": r["target"], "tgt_lng": r.get("tgt_lng") or None} for r in lines if r["source"] and r["target"]] if known else [])
        return pd.Series(found, dtype=object)

    each = whole.select("glossary_name", F.explode(rows("text")).alias("r")).select("glossary_name", "r.*")
    return each.where(language_fits(F.col("tgt_lng"), F.lit(lang_out)))


def input_files(arguments: list[str], suffix: str = ".pdf") -> list[str]:
    """File arguments without quotes and leading dashes; a missing file or another suffix is an error."""
    out = []
    for a in arguments:
        name = a.strip().strip("\"'").lstrip("-").strip("\"'")
        if not name.lower().endswith(suffix):
            raise ValueError(f"{name}: no {suffix} file")
        if not os.path.exists(name):
            raise FileNotFoundError(name)
        out.append(name)
    return out


def inside(root: str, path: str) -> str:
    """The real path, which must lie within the root."""
    top, real = os.path.realpath(root), os.path.realpath(os.path.join(root, path))
    if real != top and not real.startswith(top + os.sep):
        raise ValueError(f"{path} leaves the work folder")
    return real


def dumped(stage: DataFrame, folder: str, name: str) -> DataFrame:
    """A stage written as Parquet and read again: what a later stage sees can be looked at."""
    stage.write.mode("overwrite").parquet(f"{folder}/{name}")
    return stage.sparkSession.read.schema(stage.schema).parquet(f"{folder}/{name}")


def write_glossary(terms: DataFrame, path: str) -> None:
    terms.select("source", "target", "tgt_lng").write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def page_xml(paras: DataFrame) -> DataFrame:
    """One XML document for each page (a page's paragraphs are bounded)."""
    item = F.struct("para_seq", "label", "text", "x", "y", "x2", "y2")
    pages = paras.groupBy("doc_id", "page_no").agg(F.array_sort(F.collect_list(item)).alias("paragraph"))
    return pages.select("doc_id", "page_no", F.to_xml(F.struct("doc_id", "page_no", "paragraph"), {"rowTag": "page"}).alias("xml"))


def from_page_xml(xml: DataFrame) -> DataFrame:
    """The paragraphs of page_xml's documents."""
    schema = "doc_id long, page_no long, paragraph array<struct<para_seq:long,label:string,text:string,x:double,y:double,x2:double,y2:double>>"
    page = xml.select(F.from_xml("xml", schema, {"rowTag": "page"}).alias("p")).select("p.doc_id", "p.page_no", F.explode("p.paragraph").alias("r"))
    return page.select("doc_id", "page_no", "r.*")


def event_lines(events: DataFrame) -> DataFrame:
    """Events as compact JSON lines in the order of their keys."""
    return events.select(F.to_json(F.struct("execution_id", "sequence", "type")).alias("value"))


def html_blocks(pages: DataFrame) -> DataFrame:
    """Blocks of web pages with a layout label by element, in order."""
    label = F.create_map(*[F.lit(v) for kv in (("h1", "title"), ("p", "text"), ("li", "list_item"), ("td", "table_cell"), ("nav", "page_header"), ("footer", "page_footer")) for v in kv])
    opened = F.regexp_extract_all("html", F.lit(r"(?s)<(h1|p|li|td|nav|footer)[ >]"), 1)
    return pages.select("page_id", F.posexplode(opened).alias("block_no", "tag")).withColumn("label", F.element_at(label, F.col("tag")))

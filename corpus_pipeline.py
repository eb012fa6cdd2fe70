"""From documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows of its predecessor.  All but
the last return the columns of documents.  ``run`` writes every stage as Parquet in the
shared folder (spark.checkpoint.dir) and reads it again for the next one.

SQL cannot express the stages (a trained network, drawn slots, sequential packing), so
ORACLE_SQL is None; tests/llm hold each stage against a brute-force version.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.llm import langid, mixing, packing, passages, simhash
from quillframe.llm.common import free_name, written

#: Documents whose best language has less than this probability have none.
MIN_SCORE = 0.3
BPE = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 1


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the network knows; what it rejects goes."""
    model, p = langid.train(docs), free_name(docs, "p_")
    known = docs.withColumn(p, langid.predicted(model, F.col("text")))
    return known.where((F.col(f"{p}.lang_pred") != langid.UNKNOWN) & (F.col(f"{p}.score") >= MIN_SCORE)).drop(p)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies."""
    return simhash.deduplicated(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the paragraphs that an earlier place has already."""
    return _counted(passages.deduplicated(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources in their target proportions: a row for each time that a document is read."""
    return _counted(mixing.mixed(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: the pieces of every document with their ids."""
    return packing.packed(docs, BPE, END_ID)


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("source_mixing", mix_sources),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs

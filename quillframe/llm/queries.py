"""The driver queries of this subpackage: one ``opN_<name>`` per operator, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.llm import chat, fingerprints, html_text, langid, lm, mixing, packing, passages, quality, simhash

#: The vocabulary of op8 and of the pipeline's last stage, and the id that ends a document.
BPE = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 1


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log10 probability under a model of six sevenths of them."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    got = lm.scored(docs, ~lm.held_out(F.col("doc_id")))
    return got.select("doc_id", lm.held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix of all sources takes."""
    return mixing.taken(_table(spark, sf_dir, "documents"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    got = html_text.extracted(_table(spark, sf_dir, "pages"))
    return got.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and the smallest document of its near-duplicate group."""
    got = simhash.clustered(_table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, by a network that learned from three quarters of them."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = langid.held_out(F.col("doc_id"))
    model = langid.train(docs.where(~out))
    got = docs.select("doc_id", out.alias("held_out"), langid.predicted(model, F.col("text")).alias("p"))
    return got.select("doc_id", "held_out", "p.lang_pred", "p.score")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's base measurements and the verdict of policy v1."""
    book = quality.judged(quality.ledger(_table(spark, sf_dir, "documents")))
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed", F.lit(quality.V1.name).alias("policy"))


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents fail each rule, and how many fail it alone, under every version of the policy."""
    book = quality.ledger(_table(spark, sf_dir, "documents"))
    counted = [quality.ablations(book, p).withColumn("policy", F.lit(p.name)) for p in quality.POLICIES.values()]
    return counted[0].unionByName(counted[1]).select("policy", "rule", "n_failed", "n_only")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every paragraph of every document that repeats, its class, and whether it is removed."""
    return passages.classes(_table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of 2048 tokens, with a checksum of their ids."""
    pieces = packing.packed(_table(spark, sf_dir, "documents"), BPE, END_ID)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of every conversation with its repaired role and rendering."""
    return chat.formatted(_table(spark, sf_dir, "conversations"))


def _edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fingerprints.with_next(_table(spark, sf_dir, "documents"), "doc_id", "text")
    return rows.select("doc_id", "text", "next_text", fingerprints.edited(F.col("text"), F.col("next_text")).alias("edited"))


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The length of every document and the hash of its edited text: the part of op10 that SQL has as well."""
    return _edited(spark, sf_dir).select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of every document and of its edited text, and their likeness."""
    f, texts = fingerprints, _edited(spark, sf_dir)
    hashed = texts.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        f.hashed_words(F.col("text")).alias("h"),
        f.hashed_words(F.col("edited")).alias("he"),
        f.hashed_words(F.col("next_text")).alias("hn"),
    )
    sketched = hashed.select("doc_id", "n_chars", "edited_sha256", *[f.sketch(h).alias(s) for h, s in (("h", "a"), ("he", "e"), ("hn", "b"))])
    return sketched.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        f.text_of(F.col("a")).alias("fingerprint"),
        f.text_of(F.col("e")).alias("edited_fingerprint"),
        f.resemblance(F.col("a"), F.col("e")).alias("near_edited"),
        f.resemblance(F.col("a"), F.col("b")).alias("near_next"),
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of corpus_pipeline over documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_source_mixing": op2_source_mixing,
    "op3_html_extraction": op3_html_extraction,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_language_id": op5_language_id,
    "op6_quality_rules": op6_quality_rules,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_packing": op8_packing,
    "op9_chat_formatting": op9_chat_formatting,
    "op10_document_fingerprints": op10_document_fingerprints,
    "pipeline": pipeline,
    "quality_ablations": quality_ablations,
    "edited_texts": edited_texts,
}

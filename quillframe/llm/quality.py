"""Quality rules as a bitmask ledger (built-in functions only).

Every rule is evaluated once per text into one long of failure bits beside its
measurements; a policy is a versioned set of rules, applied as a mask; ablations are
counts over the distinct masks.  One narrow pass over the text, no shuffle.

Defined cases: a null or empty text has no words and fails ``few_words``; repeated rows
are judged each on its own; an empty table gives an empty ledger; further columns of the
input are not carried, so their names cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import words

#: Rules in bit order: name and the SQL condition, over the measurements, under which it fails.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("many_symbols", "10 * n_symbols > n_words"),
    ("duplicate_lines", "10 * n_dup_lines > 3 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 15 * n_words"),
    ("upper_case", "10 * n_upper > 3 * word_chars"),
    ("exclamations", "5 * n_exclamations > n_words"),
)


@dataclass(frozen=True)
class Policy:
    """A version of the verdict: the rules of which none may fail."""

    name: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        names = [n for n, _ in RULES]
        return sum(1 << names.index(r) for r in self.rules)


BASE = Policy("base", ("few_words", "repeated_windows"))
V1 = Policy("v1", tuple(n for n, _ in RULES))
POLICIES = {p.name: p for p in (BASE, V1)}


def measured(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key and the measurements of each text."""
    t = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(F.col(key), t.alias("t"), words(t).alias("ws"))
    words_hashed = base.select(key, "ws", "t", F.expr("transform(ws, w -> xxhash64(w))").alias("hw"))
    hashed = words_hashed.select(
        key,
        "ws",
        "t",
        F.expr("""CASE WHEN size(hw) < 4 THEN CAST(array() AS array<bigint>)
            ELSE transform(sequence(0, size(hw) - 3), i -> xxhash64(hw[i], hw[i + 1], hw[i + 2])) END""").alias("hs"),
        F.expr(r"filter(split(t, '\n'), l -> l rlike '[^ \\x09-\\x0D]')").alias("lines"),
    )
    # sorted (hash, position) pairs, for texts with equal windows only
    paired = hashed.select(
        key,
        "ws",
        "t",
        "lines",
        F.expr("""CASE WHEN size(array_distinct(hs)) = size(hs) THEN NULL
            ELSE sort_array(transform(hs, (h, i) -> struct(h, i))) END""").alias("hp"),
    )
    return paired.select(
        key,
        F.size("ws").cast("long").alias("n_words"),
        F.length(F.array_join("ws", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr("""CASE WHEN hp IS NULL THEN 0L ELSE CAST(size(array_distinct(flatten(transform(
                filter(hp, (x, k) -> (k > 0 AND hp[greatest(k - 1, 0)].h = x.h)
                    OR (k < size(hp) - 1 AND hp[least(k + 1, size(hp) - 1)].h = x.h)),
                x -> array(x.i, x.i + 1, x.i + 2))))) AS LONG) END""").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.regexp_count("t", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count("t", F.lit("!")).cast("long").alias("n_exclamations"),
    )


def ledger(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The measurements with ``failed``: bit k is set if rule k fails."""
    bits = [F.when(F.expr(cond), F.lit(1 << k)).otherwise(F.lit(0)) for k, (_, cond) in enumerate(RULES)]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return measured(docs, text, key).withColumn("failed", failed.cast("long"))


def judged(book: DataFrame, policy: Policy = V1) -> DataFrame:
    """The ledger with ``base_failed`` and the policy's ``kept``."""
    return book.withColumn("base_failed", F.col("failed").bitwiseAND(F.lit(BASE.mask)) != 0).withColumn(
        "kept", F.col("failed").bitwiseAND(F.lit(policy.mask | BASE.mask)) == 0
    )


def ablations(book: DataFrame, policy: Policy = V1) -> DataFrame:
    """For each rule of the policy: texts that fail it, and texts it alone rejects.

    Counts per distinct mask come first (at most 2^rules rows), so nothing here grows
    with the input after the partial aggregation.
    """
    masks = book.groupBy(F.col("failed").bitwiseAND(F.lit(policy.mask)).alias("m")).agg(F.count("*").alias("n"))
    names = [n for n, _ in RULES]
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << names.index(r)).cast("long").alias("bit")) for r in policy.rules]))
    return (
        masks.select("m", "n", rules.alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("m").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("m") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only"),
        )
    )

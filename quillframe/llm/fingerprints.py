"""Bottom-k sketches of shingle hashes (built-in functions only).

A document's sketch is the k smallest distinct 64-bit hashes of its shingles of five words;
a shorter text is one shingle, an empty one none.  Sketches of parts merge into the sketch
of the whole, and two sketches estimate resemblance, containment and distinct shingles.

Defined cases: null counts as the empty text, whose sketch is empty; two empty sketches
resemble each other fully, an empty and another one not at all; equal texts have equal
sketches; repeated rows are sketched each; keys are of any type that has an order, null first; an empty table gives an
empty table; further columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from quillframe.llm.common import bisected, words

K = 128
SHINGLE = 5


def hashed_words(text: Column) -> Column:
    """The 64-bit hash of each word of a text, in order."""
    return F.transform(words(text), lambda w: F.xxhash64(w))


def sketch(hashes: str, k: int = K, n: int = SHINGLE) -> Column:
    """The bottom-k sketch from a column that holds a text's hashed words."""
    at = ", ".join(f"{hashes}[i + {j}]" if j else f"{hashes}[i]" for j in range(n))
    shingles = F.expr(f"""CASE WHEN size({hashes}) = 0 THEN CAST(array() AS array<bigint>)
        WHEN size({hashes}) < {n} THEN array(xxhash64({hashes}))
        ELSE transform(sequence(0, size({hashes}) - {n}), i -> xxhash64({at})) END""")
    return F.slice(F.sort_array(F.array_distinct(shingles)), 1, k)


def union(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity of the shingle sets."""
    both = union(a, b, k)
    shared = F.size(F.array_intersect(F.array_intersect(both, a), b))
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(shared / F.size(both).cast("double"))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k, else from the k-th hash."""
    share = (F.element_at(a, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(k - 1.0) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has too."""
    joint = resemblance(a, b, k) * distinct_shingles(union(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), joint / distinct_shingles(a, k)))


def text_of(a: Column) -> Column:
    """A sketch as a string: 16 hexadecimal digits for each hash."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def merged(parts: DataFrame, key: str, column: str = "sketch", k: int = K) -> DataFrame:
    """One sketch for each key from any number of sketches of its parts.

    Only the k smallest hashes of a key leave each task (the rank filter runs before the
    shuffle as well), so a key with very many parts stays bounded.
    """
    each = parts.select(F.col(key), F.explode(column).alias("h")).distinct()
    ranked = each.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy("h"))).where(F.col("r") <= k)
    return ranked.groupBy(key).agg(F.sort_array(F.collect_list("h")).alias(column))


def with_next(docs: DataFrame, key: str, text: str, rows_per_part: int = 2_000, most_parts: int = 16_384) -> DataFrame:
    """Each row with the text of the next row in ascending (key, text) order; after the last, the first.

    Rows go by ranges of the key into parts (bounds are quantiles of the keys, of a sample by
    hash where they are no numbers; at most most_parts of them), in one shuffle of the texts;
    the first row of each part is repeated at the end of the part before it, so the neighbour
    is always in the same part.  Rows of one key are in one part.
    The driver holds the bounds and each part's first key, nothing else.
    """
    docs = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    parts = max(1, min(most_parts, docs.count() // rows_per_part))
    bounds: list = []
    if parts > 1:
        if isinstance(docs.schema["k"].dataType, NumericType):
            cuts = [i / parts for i in range(1, parts)]
            bounds = sorted(set(docs.agg(F.percentile_approx("k", cuts, 10 * parts)).first()[0] or []))
        else:
            drawn = docs.where("k IS NOT NULL").select("k").distinct().orderBy(F.xxhash64("k")).limit(10 * parts)
            keys = [r[0] for r in drawn.orderBy("k").collect()]
            bounds = keys[len(keys) // parts :: max(1, len(keys) // parts)]
    placed = docs.withColumn("p", bisected(F.col("k"), bounds))
    firsts = sorted(placed.groupBy("p").agg(F.min("k").alias("k"), F.count(F.when(F.col("k").isNull(), 1)).alias("nulls")).collect())
    if not firsts:
        return docs.select(F.col("k").alias(key), F.col("t").alias(text), F.lit("").alias("next_text"))
    ring = [(p, None if nulls else k, firsts[i - 1][0]) for i, (p, k, nulls) in enumerate(firsts)]
    kind = docs.schema["k"].dataType.simpleString()
    heads = docs.sparkSession.createDataFrame(ring, f"p int, k {kind}, before int")
    found = placed.join(F.broadcast(heads), (placed["p"] == heads["p"]) & placed["k"].eqNullSafe(heads["k"]))
    guard = found.groupBy(heads["before"].alias("p"), placed["k"]).agg(F.min("t").alias("t"))
    rows = placed.select("p", "k", "t", F.lit(False).alias("guard")).unionByName(guard.withColumn("guard", F.lit(True)))
    order = Window.partitionBy("p").orderBy("guard", F.col("k").asc_nulls_first(), "t")
    return rows.withColumn("t2", F.lead("t").over(order)).where(~F.col("guard")).select(F.col("k").alias(key), F.col("t").alias(text), F.col("t2").alias("next_text"))


def edited(text: Column, other: Column) -> Column:
    """text with its last half of code points replaced by as many first ones of other, or all it has."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(other, F.lit(1), half))

"""Shared helpers: the ASCII word rule, batches and tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII-only lower case for F.translate.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Spark's settings: shuffles go when their query has ended; the most bytes of a batch for Python.
CLEANUP, ARROW_BYTES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.execution.arrow.maxBytesPerBatch"


def words(text: Column) -> Column:
    """The words of a text, in order; null counts as the empty text.

    Splitting at one plain character takes the JVM's path without a pattern.
    """
    return F.array_remove(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D]", " "), " "), "")


def n_words(text: Column) -> Column:
    """The number of words without building them: starts of runs of other characters."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^ \x09-\x0D]+")).cast("long")


def bisected(key: Column, bounds: list) -> Column:
    """How many of the ascending bounds are at most the key (0 for null), found in two levels."""
    if not bounds:
        return F.lit(0)
    wide = max(1, round(len(bounds) ** 0.5))
    rows = [bounds[i : i + wide] for i in range(0, len(bounds), wide)]
    coarse = F.size(F.filter(F.array(*[F.lit(r[0]) for r in rows]), lambda b: b <= key))
    fine = F.array(*[F.array(*map(F.lit, r)) for r in rows])
    within = F.size(F.filter(F.element_at(fine, F.greatest(coarse, F.lit(1))), lambda b: b <= key))
    return F.when(key.isNull() | (coarse == 0), 0).otherwise((coarse - 1) * wide + within)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that df does not have yet."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and every executor reach, from spark.checkpoint.dir.

    Only where that is unset and everything runs on one machine (tests) is a temporary folder
    taken, and set; on a cluster the executors could not read it, so that is an error.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors reach")
        folder = tempfile.mkdtemp(prefix="quillframe-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/quillframe-{spark.sparkContext.applicationId}"


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session with these settings; afterwards as it was."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def written(df: DataFrame, name: str, arrow_bytes: int = 0) -> DataFrame:
    """df written to the shared folder as Parquet and read again: lineage ends here.

    So its shuffles' files go at once; else they stay until the driver collects its garbage.
    Batches for Python have about arrow_bytes if that is given.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with settings(spark, {CLEANUP: "true"} | ({ARROW_BYTES: str(arrow_bytes)} if arrow_bytes else {})):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quillframe_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Remove a table made by written() that no plan needs any more."""
    path = getattr(df, "_quillframe_path", None)
    if path:
        jvm, spark = df.sparkSession._jvm, df.sparkSession
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)

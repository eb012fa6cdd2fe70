"""Progress events as tables: replay, gaps, terminals, throttling, stage weights, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Shares of the stages in overall progress, in order.
STAGES = (
    ("parse", 14.12), ("detect_scanned", 2.45), ("layout", 14.03), ("table", 1.0), ("paragraphs", 6.26), ("styles", 1.66), ("terms", 30.0),
    ("translate", 46.96), ("typeset", 4.71), ("fonts", 0.61), ("draw", 1.96), ("subset_font", 0.92), ("save", 6.34),
)


def sequenced(events: DataFrame) -> DataFrame:
    """Events of each execution numbered in time order, without what follows its first terminal event."""
    order = Window.partitionBy("execution_id").orderBy("ts", "event_id")
    done = F.max(F.when(F.col("type") == "error", 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return events.withColumn("sequence", F.row_number().over(order)).withColumn("done", F.coalesce(done, F.lit(0))).where("done = 0").drop("done")


def retained(log: DataFrame, keep: int) -> DataFrame:
    """The last ``keep`` events of each execution."""
    last = Window.partitionBy("execution_id").orderBy(F.desc("sequence"))
    return log.withColumn("r", F.row_number().over(last)).where(F.col("r") <= keep).drop("r")


def replay_state(log: DataFrame, requests: DataFrame) -> DataFrame:
    """For each (execution_id, after_seq): how many events follow, and whether some before them are lost."""
    state = log.groupBy("execution_id").agg(F.min("sequence").alias("first"), F.max("sequence").alias("last"))
    got = requests.join(state, "execution_id", "left")
    return got.select("execution_id", "after_seq", F.greatest(F.lit(0), F.coalesce(F.col("last") - F.greatest("after_seq", F.col("first") - 1), F.lit(0))).alias("n_events"), F.coalesce(F.col("after_seq") < F.col("first") - 1, F.lit(False)).alias("gap"))


def weights(used: DataFrame) -> DataFrame:
    """Weights of the used stages, normalized to 1."""
    return used.withColumn("share", F.col("weight") / F.sum("weight").over(Window.partitionBy("plan_id")))


def overall(progress: DataFrame) -> DataFrame:
    """Overall progress in percent from the shares and the stages' fractions; all done is exactly 100."""
    total = F.sum(F.col("share") * F.col("fraction")) * 100
    return progress.groupBy("execution_id").agg(F.when(F.min("fraction") >= 1, 100.0).otherwise(total).alias("percent"))


def throttled(events: DataFrame, seconds: int) -> DataFrame:
    """The first event of each execution and type in every interval of seconds (from the epoch)."""
    slot = F.floor(F.unix_timestamp("ts") / seconds)
    return events.withColumn("slot", slot).groupBy("execution_id", "type", "slot").agg(F.min(F.struct("ts", "event_id")).alias("e")).select("execution_id", "type", F.col("e.event_id").alias("event_id"))


def tumbling(events: DataFrame, width: str = "1 hour") -> DataFrame:
    return events.groupBy(F.window("ts", width).alias("w"), "type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "type", "n", "total")


def sessions(events: DataFrame, minutes: int = 30) -> DataFrame:
    """Stretches of an execution's events less than minutes apart."""
    return events.groupBy("execution_id", F.session_window("ts", f"{minutes} minutes").alias("w")).agg(F.count("*").alias("n"), F.min("ts").alias("start"), F.max("ts").alias("last")).drop("w")

"""Progress events as streams: one numbered log per execution, windows with a watermark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT = "event_id long, ts timestamp, execution_id long, type string, value double"
LOGGED = "execution_id long, sequence long, event_id long, type string"


def read_events(spark: SparkSession, folder: str, files_a_batch: int = 100) -> DataFrame:
    """A stream of newline-delimited JSON events from a folder."""
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_a_batch).json(folder)


def sequenced(events: DataFrame, terminal: str = "error", forget: str = "2 hours") -> DataFrame:
    """Events of each execution numbered as they come; what follows the first terminal event is dropped.

    State per execution is a counter and a flag, and goes when the watermark has passed its
    last event by the time ``forget``: an execution that has not ended by then gets the event
    missing_terminal, one that has leaves nothing behind.
    """
    pause = pd.Timedelta(forget) // pd.Timedelta(milliseconds=1)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, done = state.get if state.exists else (0, False)
        if state.hasTimedOut:
            state.remove()
            if not done:
                yield pd.DataFrame({"execution_id": [key[0]], "sequence": [last + 1], "event_id": pd.array([None], "Int64"), "type": ["missing_terminal"]})
            return
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        newest = int(rows["ts"].max().timestamp() * 1000)
        ends = np.flatnonzero((rows["type"] == terminal).to_numpy())
        rows = rows.iloc[: 0 if done else ends[0] + 1 if len(ends) else len(rows)]
        state.update((int(last + len(rows)), bool(done or len(ends))))
        state.setTimeoutTimestamp(newest + int(pause))
        yield pd.DataFrame({"execution_id": key[0], "sequence": np.arange(last + 1, last + 1 + len(rows)), "event_id": rows["event_id"].to_numpy(), "type": rows["type"].to_numpy()})

    watched = events.withWatermark("ts", forget)
    return watched.groupBy("execution_id").applyInPandasWithState(step, LOGGED, "last long, done boolean", "append", GroupStateTimeout.EventTimeTimeout)


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts per window and type; events later than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "type", "n")


def sliding(events: DataFrame, width: str = "2 hours", slide: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts per sliding window and type, under the same watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, slide).alias("w"), "type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "type", "n")


def drained(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there and return what it has written (a memory table, for tests and small logs)."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)

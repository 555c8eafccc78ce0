"""Streams of events: windowed rates, duplicates dropped, statuses kept.

`batch` twins give what a stream over the same rows must come to.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from screenloom.operators.lifecycle import TRANSITIONS

LIMIT, WINDOW = 30, "60 seconds"


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 8) -> DataFrame:
    """The events table as a stream; its times get a zone, which watermarks ask for."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", name).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def rate_windows(events: DataFrame, key: str = "user_id", window: str = WINDOW, limit: int = LIMIT, late: str | None = None) -> DataFrame:
    """key, window_start, n, limited: events in fixed windows, and whether they pass the limit."""
    rows = events.withWatermark("ts", late) if late else events
    counts = rows.groupBy(F.window(F.col("ts").cast("timestamp"), window) if not late else F.window("ts", window), key).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(key, F.col("window.start").alias("window_start"), "n", (F.col("n") > limit).alias("limited"))


def first_of_each(events: DataFrame, key: str, late: str) -> DataFrame:
    """Events whose key didn't come before, within the watermark: a queue that ignores repeats."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def polling_changes(rows: DataFrame, key: str, order: list[str], signature: Column) -> DataFrame:
    """Rows whose signature differs from the one before."""
    from pyspark.sql import Window

    before = F.lag(signature).over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("changed", ~signature.eqNullSafe(before))


def latest(rows: DataFrame, key: str, request: str, columns: list[str]) -> DataFrame:
    """Of each key the row of the highest request: late answers to earlier ones are dropped."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), request).alias("_r")).select(key, "_r.*")


class StatusProcessor(StatefulProcessor):
    """Keeps each key's status and counts; a batch's events are applied in order of time."""

    steps = {(event, start): to for event, starts, to in TRANSITIONS for start in starts}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("status", "status string, accepted long, refused long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        status, accepted, refused = self.state.get() if self.state.exists() else ("pending", 0, 0)
        for event in pd.concat(rows).sort_values(["ts", "event_id"])["event"]:
            to = self.steps.get((event, status))
            status, accepted, refused = to or status, accepted + (to is not None), refused + (to is None)
        self.state.update((status, accepted, refused))
        yield pd.DataFrame({"user_id": [key[0]], "status": [status], "accepted": [accepted], "refused": [refused]})

    def close(self) -> None:
        pass


def status_stream(events: DataFrame) -> DataFrame:
    """user_id, status, accepted, refused after each batch that has events of the user.

    Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass)."""
    return events.groupBy("user_id").transformWithStateInPandas(
        StatusProcessor(), outputStructType="user_id long, status string, accepted long, refused long", outputMode="Update", timeMode="None"
    )

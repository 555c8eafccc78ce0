"""A consumer of screening jobs: claims, work and results, batch by batch, into a stored table.

The table is a log of batches. A batch is read against what the batches before it left, and written whole
into a folder of its own number, so that a batch that is run again (after a crash, or by another driver)
finds the same state and overwrites its own rows with the same ones. Every SNAPSHOT-th batch also writes the
state after it, so that a batch reads one snapshot and fewer than SNAPSHOT folders, however long the
stream has been running.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screenloom.operators.retries import ATTEMPTS

SNAPSHOT = 16
STATE = "candidate long, status string, tried int, raw_text string, result string, error_code string, error_message string"
LOG = STATE + ", message long, outcome string, reason string"
#: Why a message is passed over.
GONE, CLAIMED = "candidate_gone", "already_claimed"
#: Claimed candidates (with `tried`, the number of this attempt) to what working on them gave: candidate,
#: raw_text, result, error_code, error_message, retryable. error_code is null where it succeeded.
Screen = Callable[[DataFrame], DataFrame]


class StoredTable:
    """The rows of a consumer by batch, in a folder."""

    def __init__(self, spark: SparkSession, path: str, snapshot: int = SNAPSHOT) -> None:
        self.spark, self.path, self.snapshot = spark, path.rstrip("/"), snapshot

    def outcomes(self, batch: int) -> DataFrame:
        return self.spark.read.schema(LOG).parquet(f"{self.path}/batch={batch}")

    def current(self, before: int) -> DataFrame:
        """The state of every candidate that the batches below `before` have touched."""
        since = before // self.snapshot * self.snapshot
        rows = self.spark.createDataFrame([], f"{STATE}, _batch int")
        if since:
            rows = rows.union(self.spark.read.schema(STATE).parquet(f"{self.path}/snapshot={since - 1}").withColumn("_batch", F.lit(-1)))
        for batch in range(since, before):
            own = self.outcomes(batch).filter("outcome <> 'skipped'")
            rows = rows.union(own.drop("message", "outcome", "reason").withColumn("_batch", F.lit(batch)))
        columns = [c for c in rows.columns if c not in ("candidate", "_batch")]
        return rows.groupBy("candidate").agg(F.max_by(F.struct(*columns), "_batch").alias("_s")).select("candidate", "_s.*")

    def put(self, rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        if (batch + 1) % self.snapshot == 0:
            self.current_after(batch).write.mode("overwrite").parquet(f"{self.path}/snapshot={batch}")

    def current_after(self, batch: int) -> DataFrame:
        """The state after a batch, from the snapshot before it."""
        earlier = self.current(batch).withColumn("_batch", F.lit(0))
        own = self.outcomes(batch).filter("outcome <> 'skipped'").drop("message", "outcome", "reason").withColumn("_batch", F.lit(1))
        rows = earlier.unionByName(own)
        columns = [c for c in rows.columns if c not in ("candidate", "_batch")]
        return rows.groupBy("candidate").agg(F.max_by(F.struct(*columns), "_batch").alias("_s")).select("candidate", "_s.*")


def claims(messages: DataFrame, candidates: DataFrame, state: DataFrame) -> DataFrame:
    """messages (message, candidate) with `reason` where they are passed over, and tried. Of a candidate's
    messages in a batch the first one claims it, if it is pending then."""
    first = messages.groupBy("candidate").agg(F.min("message").alias("_first"))
    known = candidates.select("candidate", F.lit(True).alias("_known"))
    facts = first.join(known, "candidate", "left").join(state.select("candidate", "status", "tried"), "candidate", "left")
    rows = messages.join(facts, "candidate")
    free = (F.coalesce("status", F.lit("pending")) == "pending") & (F.col("message") == F.col("_first"))
    reason = F.when(F.col("_known").isNull(), GONE).when(~free, CLAIMED)
    return rows.select("message", "candidate", reason.alias("reason"), F.col("status").alias("_was"), (F.coalesce("tried", F.lit(0)) + F.when(reason.isNull(), 1).otherwise(0)).cast("int").alias("tried"))


def worked(claimed: DataFrame, screen: Screen, attempts: int = ATTEMPTS) -> DataFrame:
    """The claimed messages with what became of their candidates: done; released to pending, if the error
    can be retried and attempts remain; else failed."""
    given = screen(claimed.select("candidate", "tried"))
    rows = claimed.join(given.select("candidate", "raw_text", "result", "error_code", "error_message", "retryable"), "candidate", "left")
    lost = F.coalesce("error_code", F.when(F.col("result").isNull(), F.lit("INTERNAL_ERROR")))
    again = F.coalesce("retryable", F.lit(True)) & (F.col("tried") < attempts)
    outcome = F.when(lost.isNull(), "done").when(again, "released").otherwise("failed")
    status = F.when(outcome == "released", "pending").otherwise(outcome)
    failed = outcome == "failed"
    return rows.select(
        "candidate", status.alias("status"), "tried", "raw_text", F.when(lost.isNull(), F.col("result")).alias("result"), F.when(failed, lost).alias("error_code"), F.when(failed, F.col("error_message")).alias("error_message"), "message", outcome.alias("outcome"), F.lit(None).cast("string").alias("reason")
    )


def consume(messages: DataFrame, batch: int, table: StoredTable, candidates: DataFrame, screen: Screen, attempts: int = ATTEMPTS) -> None:
    """Works on a batch of messages and stores what came of each. Running a batch again changes nothing."""
    rows = claims(messages, candidates, table.current(batch))
    done = worked(rows.filter("reason IS NULL"), screen, attempts)
    passed = rows.filter("reason IS NOT NULL").select("candidate", F.col("_was").alias("status"), "tried", *(F.lit(None).cast("string").alias(c) for c in ("raw_text", "result", "error_code", "error_message")), "message", F.lit("skipped").alias("outcome"), "reason")
    table.put(done.unionByName(passed), batch)


def consumer(table: StoredTable, candidates: DataFrame, screen: Screen, attempts: int = ATTEMPTS) -> Callable[[DataFrame, int], None]:
    """For writeStream.foreachBatch()."""
    return lambda messages, batch: consume(messages, batch, table, candidates, screen, attempts)

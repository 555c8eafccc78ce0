"""Streams over the events table against their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from screenloom.operators.lifecycle import fold_transitions
from screenloom.streaming import events

PATH = "/root/testdata/sf0.001/events.parquet"
NAMES = {"view": "claim", "click": "evaluate", "purchase": "finish", "error": "fail", "signup": "retry"}


def run(stream, mode, name):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return q


def test_windows(spark):
    run(events.rate_windows(events.event_stream(spark, PATH), window="1 hour", late="1 hour"), "complete", "rates")
    batch = events.rate_windows(spark.read.parquet(PATH).withColumn("ts", F.col("ts").cast("timestamp")), window="1 hour")
    assert sorted(map(tuple, spark.table("rates").collect())) == sorted(map(tuple, batch.collect()))


def test_first_of_each(spark):
    run(events.first_of_each(events.event_stream(spark, PATH), "user_id", "3650 days"), "append", "firsts")
    assert spark.table("firsts").count() == spark.read.parquet(PATH).select("user_id").distinct().count()


def test_status(spark):
    kind = F.create_map(*(F.lit(x) for p in NAMES.items() for x in p))
    named = lambda df: df.withColumn("event", kind[F.col("event_type")])
    run(events.status_stream(named(events.event_stream(spark, PATH)).select("user_id", "ts", "event_id", "event")), "update", "statuses")
    batch = fold_transitions(named(spark.read.parquet(PATH)), "user_id", ["ts", "event_id"])
    assert sorted(map(tuple, spark.table("statuses").collect())) == sorted(tuple(r)[:4] for r in batch.collect())

"""Logs in pieces, failure paths, admissions and the consumer: batch forms, streams, and plain Python."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from screenloom.operators import retries
from screenloom.operators.replay import replay
from screenloom.plans.flow_plans import outcomes, screen
from screenloom.streaming import consumer, decisions
from tests.test_streams import run

DATA = "/root/testdata/sf0.001"


def test_replay_in_pieces_is_a_walk(spark):
    r = random.Random(2)
    rows = [(r.choice([1, 1, 1, 2, 3, None]), i, r.choice("abc")) for i in range(400)]
    table = {("x", "a"): "y", ("y", "b"): "z", ("z", "a"): "x", ("z", "c"): "y"}

    def step(state, row):
        out = F.lit(None).cast("string")
        for (s, e), to in table.items():
            out = F.when((state == s) & (row["e"] == e), to).otherwise(out)
        return out

    df = spark.createDataFrame(rows, "k int, i int, e string").repartition(5)
    starts = spark.createDataFrame([(2, "z")], "k int, status string")
    state, want = defaultdict(lambda: "x", {2: "z"}), []
    for k, i, e in rows:
        to = table.get((state[k], e))
        want.append((k, i, e, state[k], to or state[k], to is not None))
        state[k] = to or state[k]
    for chunk in (1, 3, 4096):
        got = replay(df, "k", ["i"], ("x", "y", "z"), step, "x", chunk, starts)
        assert Counter(tuple(x)[:6] for x in got.collect()) == Counter(want)


def plain_failures(rows):
    """rows of (job, at_ms, event_id, code, retryable), in order of time."""
    failed, final, out = Counter(), set(), []
    for job, at, event, code, retryable in rows:
        n = failed[job] + 1
        if job in final:
            out.append((job, event, at, None, "skipped", code, False))
        elif code is None:
            final.add(job)
            out.append((job, event, at, n, "done", None, False))
        elif retryable and n < 3:
            failed[job] = n
            out += [(job, event, at, n, "released", code, False), (job, event, at + 10_000 * 2 ** (n - 1), n + 1, "requeued", None, False)]
        else:
            final.add(job)
            out.append((job, event, at, n, "failed", code, not retryable))
    return Counter(out)


@pytest.mark.parametrize("chunk", [2, 4096])
def test_failure_path(spark, chunk):
    rows = outcomes(spark, DATA).select("job", F.unix_millis("ts").alias("ms"), "event_id", "code", "retryable", "ts").collect()
    got = retries.failure_path(outcomes(spark, DATA), "job", ["ts", "event_id"], chunk=chunk)
    assert Counter(map(tuple, got.select("job", "event_id", "at_ms", "attempt", "action", "code", "unrecoverable").collect())) == plain_failures([tuple(r)[:5] for r in sorted(rows, key=lambda r: (r.ts, r.event_id))])


def by_time(rows, ts, parts, path):
    """Files of a table in order of time, one a micro-batch."""
    ranked = rows.orderBy(ts, "event_id").coalesce(1).collect()
    for k in range(parts):
        piece = ranked[k * len(ranked) // parts : (k + 1) * len(ranked) // parts]
        rows.sparkSession.createDataFrame(piece, rows.schema).coalesce(1).write.parquet(f"{path}/p={k}")
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path).drop("p")


def test_failures_come_back_in_the_stream(spark, tmp_path):
    some = outcomes(spark, DATA).filter("job % 100 < 12")
    last = some.agg(F.max("ts")).first()[0]
    flush = spark.createDataFrame([(-1, "x")], "job long, code string").select("job", (F.lit(last) + F.expr("interval 3 days")).alias("ts"), F.lit(-1).cast("long").alias("event_id"), F.lit(None).cast("string").alias("code"), F.lit(True).alias("retryable"))
    stream = by_time(some.union(flush), "ts", 3, str(tmp_path / "in"))
    run(decisions.failure_stream(stream), "append", "failures")
    batch = retries.failure_path(some, "job", ["ts", "event_id"]).select("job", "event_id", "at_ms", "attempt", "action", "code", "unrecoverable")
    got = Counter(map(tuple, spark.table("failures").filter("job >= 0").collect()))
    assert got == Counter(map(tuple, batch.collect()))
    assert {x[4] for x in got} == {"released", "requeued", "failed", "done", "skipped"} and max(x[3] or 0 for x in got) == 3


def test_admissions(spark, tmp_path):
    rows = spark.read.parquet(f"{DATA}/events.parquet").select((F.col("user_id") % 5).alias("caller"), F.col("ts").cast("timestamp").alias("ts"), "event_id")
    batch = retries.admitted(rows, "caller", "ts", ["ts", "event_id"], "6 hours", 2)
    want, seen = Counter(), Counter()
    for r in sorted(rows.withColumn("us", F.unix_micros("ts")).collect(), key=lambda r: (r.us, r.event_id)):
        start = r.us // 21_600_000_000 * 21_600_000
        seen[r.caller, start] += 1
        passes = seen[r.caller, start] <= 2
        want[r.caller, r.event_id, start, passes, None if passes else -(-(start + 21_600_000 - r.us // 1000) // 1000)] += 1
    assert Counter(map(tuple, batch.select("caller", "event_id", F.unix_millis("window_start"), "admitted", "retry_after_s").collect())) == want
    run(decisions.admission_stream(by_time(rows, "ts", 3, str(tmp_path / "in")), 21_600_000, 2), "append", "admissions")
    assert Counter(map(tuple, spark.table("admissions").collect())) == want


def test_poll_schedule_in_small_pieces(spark):
    from screenloom.plans.flow_plans import polls

    whole = Counter(map(tuple, retries.poll_schedule(polls(spark, DATA), "session", ["ts", "event_id"]).collect()))
    assert whole == Counter(map(tuple, retries.poll_schedule(polls(spark, DATA), "session", ["ts", "event_id"], chunk=2).collect()))
    assert {x[-1] for x in whole} >= {None, "complete", "ignored"}


def test_poll_schedule_replays_its_log_once(spark):
    from screenloom.plans.flow_plans import polls

    plan = retries.poll_schedule(polls(spark, DATA), "session", ["ts", "event_id"])._jdf.queryExecution().optimizedPlan().toString()
    assert "monotonically_increasing_id" not in plan and "events.parquet" not in plan


@pytest.fixture
def store(spark, tmp_path):
    return consumer.StoredTable(spark, str(tmp_path / "store"), snapshot=2)


def messages(spark, *pairs):
    return spark.createDataFrame(pairs, "message long, candidate long")


def known(spark, n=30):
    return spark.range(n).withColumnRenamed("id", "candidate")


def test_a_batch_run_twice_changes_nothing(spark, store):
    first, second = messages(spark, (1, 1), (2, 2), (3, 7)), messages(spark, (4, 2), (5, 4), (6, 3))
    consumer.consume(first, 0, store, known(spark), screen)
    consumer.consume(second, 1, store, known(spark), screen)
    before = [sorted(map(tuple, x.collect()), key=repr) for x in (store.outcomes(0), store.outcomes(1), store.current(2))]
    consumer.consume(first, 0, store, known(spark), screen)
    consumer.consume(second, 1, store, known(spark), screen)
    consumer.consume(second, 1, store, known(spark), screen)
    assert before == [sorted(map(tuple, x.collect()), key=repr) for x in (store.outcomes(0), store.outcomes(1), store.current(2))]
    assert {r.candidate: (r.status, r.tried) for r in store.current(2).collect()} == {1: ("done", 1), 2: ("done", 2), 7: ("failed", 1), 4: ("done", 1), 3: ("done", 1)}


def test_lost_claims_and_attempts(spark, store):
    consumer.consume(messages(spark, (1, 1), (2, 1), (3, 99), (4, 1)), 0, store, known(spark), screen)
    got = {r.message: (r.outcome, r.reason) for r in store.outcomes(0).collect()}
    assert got == {1: ("done", None), 2: ("skipped", "already_claimed"), 3: ("skipped", "candidate_gone"), 4: ("skipped", "already_claimed")}
    busy = lambda claimed: screen(claimed).withColumn("error_code", F.lit("MODEL_TIMEOUT")).withColumn("retryable", F.lit(True))
    for batch, (outcome, status) in enumerate([("released", "pending"), ("released", "pending"), ("failed", "failed"), ("skipped", "failed"), ("skipped", "failed")], 1):
        consumer.consume(messages(spark, (10 + batch, 5)), batch, store, known(spark), busy)
        row = store.outcomes(batch).first()
        assert (row.outcome, row.status) == (outcome, status)
    assert {r.candidate: (r.status, r.tried, r.error_code) for r in store.current(6).collect()} == {1: ("done", 1, None), 5: ("failed", 3, "MODEL_TIMEOUT")}


def test_work_that_gives_nothing_is_an_error(spark, store):
    none = lambda claimed: screen(claimed).filter("false")
    consumer.consume(messages(spark, (1, 5)), 0, store, known(spark), none, attempts=1)
    row = store.outcomes(0).first()
    assert (row.outcome, row.error_code) == ("failed", "INTERNAL_ERROR")


def test_consumer_of_a_stream(spark, store, tmp_path):
    for k in range(5):
        messages(spark, *((10 * k + i, i + k) for i in range(5))).coalesce(1).write.parquet(str(tmp_path / f"in/p={k}"))
    stream = spark.readStream.schema("message long, candidate long, p int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).drop("p")
    go = lambda: stream.writeStream.foreachBatch(consumer.consumer(store, known(spark), screen)).option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start()
    go().awaitTermination(120)
    once = sorted(map(tuple, store.current(5).collect()), key=repr)
    assert len(once) == 9
    commits = sorted((tmp_path / "ckpt/commits").glob("[0-9]*"))
    commits[-1].unlink()  # as if the driver had died before it could note the last batch
    for crc in (tmp_path / "ckpt/commits").glob(".*.crc"):
        crc.unlink()
    go().awaitTermination(120)
    assert once == sorted(map(tuple, store.current(5).collect()), key=repr)

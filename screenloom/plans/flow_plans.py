"""Failure paths, consumed batches, payloads, admissions and polls, over the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screenloom.operators import retries
from screenloom.plans.derived import load, transitions
from screenloom.sources.tables import shared_path
from screenloom.streaming import consumer

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return register


def outcomes(spark: SparkSession, d: str) -> DataFrame:
    """How attempts of jobs ended: a job is a user's day."""
    code = F.when(F.col("event_type") == "error", "TIMEOUT").when(F.col("event_type") == "signup", "BAD_FILE").when(F.col("event_type") != "purchase", "RATE_LIMITED")
    rows = load(spark, d, "events")
    return rows.select((F.col("user_id") * 100 + F.dayofmonth("ts")).alias("job"), F.col("ts").cast("timestamp").alias("ts"), "event_id", code.alias("code"), (F.col("event_type") != "signup").alias("retryable"))


_OUTCOMES = """log AS (
  SELECT *, row_number() OVER (PARTITION BY job ORDER BY ts, event_id) AS n FROM (
    SELECT user_id * 100 + day(ts) AS job, ts, event_id, event_type <> 'signup' AS retryable,
      CASE event_type WHEN 'error' THEN 'TIMEOUT' WHEN 'signup' THEN 'BAD_FILE' WHEN 'purchase' THEN NULL ELSE 'RATE_LIMITED' END AS code FROM events))"""


@query(
    f"""WITH RECURSIVE {_OUTCOMES}, fold AS (
  SELECT job, 0::BIGINT AS n, 0 AS failed, false AS final, NULL::VARCHAR AS action, 0::BIGINT AS event_id, 0::BIGINT AS at_ms, 0 AS attempt, NULL::VARCHAR AS code, false AS unrecoverable FROM log WHERE n = 1
  UNION ALL
  SELECT f.job, l.n, CASE WHEN NOT final AND l.code IS NOT NULL AND l.retryable AND failed < 2 THEN failed + 1 ELSE failed END,
    final OR l.code IS NULL OR NOT l.retryable OR failed >= 2,
    CASE WHEN final THEN 'skipped' WHEN l.code IS NULL THEN 'done' WHEN l.retryable AND failed < 2 THEN 'released' ELSE 'failed' END,
    l.event_id, epoch_us(l.ts) // 1000, CASE WHEN NOT final THEN failed + 1 END, l.code, NOT final AND l.code IS NOT NULL AND NOT l.retryable
  FROM fold f JOIN log l ON l.job = f.job AND l.n = f.n + 1
)
SELECT job, event_id, at_ms, attempt, action, code, unrecoverable FROM fold WHERE n > 0
UNION ALL SELECT job, event_id, at_ms + 10000 * (2 ** (attempt - 1))::BIGINT, attempt + 1, 'requeued', NULL, false FROM fold WHERE action = 'released'"""
)
def failure_path(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of every attempt that fails: three at most, with growing delays between them."""
    return retries.failure_path(outcomes(spark, d), "job", ["ts", "event_id"])


@query(
    """SELECT event_id, caller, epoch_ms(start) AS window_ms, n <= 2 AS admitted,
      CASE WHEN n > 2 THEN ceil((epoch_ms(start) + 21600000 - epoch_us(ts) // 1000) / 1000e0)::BIGINT END AS retry_after_s
      FROM (SELECT *, row_number() OVER (PARTITION BY caller, start ORDER BY ts, event_id) AS n FROM (SELECT event_id, ts, user_id % 10 AS caller, time_bucket(INTERVAL 6 hours, ts) AS start FROM events))"""
)
def admit_requests(spark: SparkSession, d: str) -> DataFrame:
    """The first two requests of each caller in six hours are let in; the others are told when to come back."""
    rows = load(spark, d, "events").select("event_id", "ts", (F.col("user_id") % 10).alias("caller"))
    found = retries.admitted(rows, "caller", "ts", ["ts", "event_id"], "6 hours", 2)
    return found.select("event_id", "caller", F.unix_millis("window_start").alias("window_ms"), "admitted", "retry_after_s")


def polls(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of up to fifteen minutes: a day's events of some users, 96 times as fast."""
    rows = load(spark, d, "events")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    day = F.floor(ms / 86_400_000)
    fails = F.col("event_type").isin("error", "view")
    return rows.select(
        ((F.col("user_id") % 20) * 100_000 + day).alias("session"),
        F.timestamp_millis(day * 86_400_000 + F.floor(F.pmod(ms, F.lit(86_400_000)) / 96)).alias("ts"),
        "event_id",
        F.col("event_type").alias("signature"),
        fails.alias("failed"),
        (F.col("event_id") % 41 == 0).alias("gone"),
        (F.col("event_id") % 23 == 0).alias("complete"),
    )


@query(
    """WITH RECURSIVE log AS (
  SELECT *, row_number() OVER (PARTITION BY session ORDER BY ms, event_id) AS n, min(ms) OVER (PARTITION BY session) AS began FROM (
    SELECT user_id % 20 * 100000 + (epoch_us(ts) // 1000) // 86400000 AS session, (epoch_us(ts) // 1000) // 86400000 * 86400000 + (epoch_us(ts) // 1000) % 86400000 // 96 AS ms, event_id, event_type AS sig,
      event_type IN ('error', 'view') AS fails, event_id % 41 = 0 AS gone, event_id % 23 = 0 AS complete FROM events)
), fold AS (
  SELECT session, 0::BIGINT AS n, 0::BIGINT AS event_id, 0 AS fails, NULL::VARCHAR AS sig, began AS changed, 0::BIGINT AS ms, NULL::VARCHAR AS stop FROM log WHERE n = 1
  UNION ALL
  SELECT f.session, l.n, l.event_id, CASE WHEN l.fails THEN f.fails + 1 ELSE 0 END, CASE WHEN l.fails THEN f.sig ELSE l.sig END,
    CASE WHEN NOT l.fails AND l.sig IS DISTINCT FROM f.sig THEN l.ms ELSE changed END, l.ms,
    CASE WHEN f.stop IS NOT NULL THEN 'ignored' WHEN NOT l.fails AND l.complete THEN 'complete' WHEN l.fails AND l.gone THEN 'not_found'
      WHEN l.fails AND f.fails >= 3 THEN 'failures' WHEN l.ms - l.began >= 600000 THEN 'timeout' END
  FROM fold f JOIN log l ON l.session = f.session AND l.n = f.n + 1
)
SELECT session, event_id, stop, CASE WHEN stop IS NULL THEN ms - changed END AS since_change_ms,
  CASE WHEN stop IS NULL THEN CASE WHEN ms - changed < 60000 THEN 3000 WHEN ms - changed < 120000 THEN 8000 WHEN ms - changed < 180000 THEN 20000 ELSE 30000 END END::BIGINT AS next_ms FROM fold WHERE n > 0"""
)
def poll_schedule(spark: SparkSession, d: str) -> DataFrame:
    """When a watcher asks again, and why it stops."""
    return retries.poll_schedule(polls(spark, d), "session", ["ts", "event_id"]).select("session", "event_id", "stop", "since_change_ms", "next_ms")


@query(
    """WITH RECURSIVE log AS (
  SELECT user_id, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n,
    CASE event_type WHEN 'view' THEN 'claim' WHEN 'click' THEN 'evaluate' WHEN 'purchase' THEN 'finish' WHEN 'error' THEN 'fail' WHEN 'signup' THEN CASE event_id % 3 WHEN 0 THEN 'release' ELSE 'retry' END END AS ev FROM events
), fold AS (
  SELECT DISTINCT user_id, 0::BIGINT AS n, 'pending' AS st, 0::BIGINT AS attempts, NULL::VARCHAR AS raw_text, NULL::VARCHAR AS result, NULL::VARCHAR AS code, NULL::VARCHAR AS message, NULL::BIGINT AS completed FROM events
  UNION ALL
  SELECT user_id, n, coalesce(next, st), attempts + (next IS NOT NULL AND ev = 'retry')::INT,
    CASE WHEN next IS NOT NULL AND ev = 'evaluate' THEN 'text ' || id ELSE raw_text END, CASE WHEN next IS NOT NULL AND ev = 'finish' THEN 'result ' || id ELSE result END,
    CASE WHEN next IS NULL THEN code WHEN ev = 'fail' THEN 'E' || id % 5 WHEN ev IN ('finish', 'retry') THEN NULL ELSE code END,
    CASE WHEN next IS NULL THEN message WHEN ev = 'fail' THEN 'because of ' || id WHEN ev IN ('finish', 'retry') THEN NULL ELSE message END,
    CASE WHEN next IS NULL THEN completed WHEN ev IN ('finish', 'fail') THEN epoch_us(ts) // 1000 WHEN ev = 'retry' THEN NULL ELSE completed END
  FROM (SELECT f.*, l.ts, l.event_id AS id, l.ev, l.n AS n2, CASE WHEN ev = 'claim' AND st = 'pending' THEN 'parsing' WHEN ev = 'evaluate' AND st = 'parsing' THEN 'evaluating' WHEN ev = 'finish' AND st = 'evaluating' THEN 'done'
      WHEN ev = 'fail' AND st IN ('pending', 'parsing', 'evaluating') THEN 'failed' WHEN ev = 'retry' AND st = 'failed' THEN 'pending' WHEN ev = 'release' AND st IN ('parsing', 'evaluating') THEN 'pending' END AS next
    FROM fold f JOIN log l ON f.user_id = l.user_id AND l.n = f.n + 1) AS s(user_id, n0, st, attempts, raw_text, result, code, message, completed, ts, id, ev, n, next)
)
SELECT user_id, st AS status, attempts, raw_text, result, code AS error_code, message AS error_message, completed AS completed_ms FROM fold f WHERE n = (SELECT max(n) FROM log l WHERE l.user_id = f.user_id)"""
)
def payload_fold(spark: SparkSession, d: str) -> DataFrame:
    """What each candidate's log of transitions leaves in its row: status, text, result and error."""
    rows = transitions(spark, d)
    event = F.when((F.col("event") == "retry") & (F.col("event_id") % 3 == 0), "release").otherwise(F.col("event"))
    text = lambda s: F.concat(F.lit(s), F.col("event_id").cast("string"))
    rows = rows.select("user_id", "ts", "event_id", event.alias("event"), text("text ").alias("raw_text"), text("result ").alias("result"), F.concat(F.lit("E"), (F.col("event_id") % 5).cast("string")).alias("error_code"), text("because of ").alias("error_message"))
    return retries.fold_payloads(rows, "user_id", ["ts", "event_id"]).withColumn("completed_at", retries.millis("completed_at")).withColumnRenamed("completed_at", "completed_ms")


def screen(claimed: DataFrame) -> DataFrame:
    """Stands for reading and judging a candidate."""
    bad, busy = F.col("candidate") % 7 == 0, (F.col("candidate") + F.col("tried")) % 3 == 0
    code = F.when(bad, "UNREADABLE").when(busy, "MODEL_TIMEOUT")
    name = F.col("candidate").cast("string")
    return claimed.select("candidate", F.concat(F.lit("cv "), name).alias("raw_text"), F.when(code.isNull(), F.concat(F.lit("score "), name)).alias("result"), code.alias("error_code"), F.concat(F.lit("no luck with "), name).alias("error_message"), (~bad).alias("retryable"))


@query(
    """WITH RECURSIVE messages AS (SELECT user_id AS candidate, event_id AS message, event_id % 5 AS batch, c_custkey IS NOT NULL AS known FROM events LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 10 <> 0) ON c_custkey = user_id),
firsts AS (SELECT candidate, batch, min(message) AS first FROM messages WHERE known GROUP BY ALL),
fold AS (
  SELECT DISTINCT candidate, -1::BIGINT AS batch, 'pending' AS was, 0 AS before, NULL::BIGINT AS first, 'pending' AS status, 0 AS tried, NULL::VARCHAR AS outcome FROM firsts
  UNION ALL
  SELECT candidate, b, status, tried, CASE WHEN took THEN f END,
    CASE WHEN NOT took THEN status WHEN candidate % 7 = 0 THEN 'failed' WHEN (candidate + tried + 1) % 3 <> 0 THEN 'done' WHEN tried < 2 THEN 'pending' ELSE 'failed' END, tried + took::INT,
    CASE WHEN NOT took THEN NULL WHEN candidate % 7 = 0 THEN 'failed' WHEN (candidate + tried + 1) % 3 <> 0 THEN 'done' WHEN tried < 2 THEN 'released' ELSE 'failed' END
  FROM (SELECT o.candidate, o.batch + 1 AS b, o.status, o.tried, s.first AS f, s.first IS NOT NULL AND o.status = 'pending' AS took FROM fold o LEFT JOIN firsts s ON s.candidate = o.candidate AND s.batch = o.batch + 1 WHERE o.batch < 4)
)
SELECT m.message, m.candidate, coalesce(CASE WHEN m.message = f.first THEN f.outcome END, 'skipped') AS outcome,
  CASE WHEN NOT known THEN 'candidate_gone' WHEN m.message IS DISTINCT FROM f.first THEN 'already_claimed' END AS reason,
  CASE WHEN m.message = f.first THEN f.status ELSE CASE WHEN f.before > 0 THEN f.was END END AS status, CASE WHEN m.message = f.first THEN f.tried ELSE coalesce(f.before, 0) END AS tried,
  CASE WHEN m.message = f.first AND f.status = 'done' THEN 'score ' || m.candidate END AS result,
  CASE WHEN m.message = f.first AND f.status = 'failed' THEN CASE WHEN m.candidate % 7 = 0 THEN 'UNREADABLE' ELSE 'MODEL_TIMEOUT' END END AS error_code
FROM messages m LEFT JOIN fold f USING (candidate, batch)"""
)
def consume_batches(spark: SparkSession, d: str) -> DataFrame:
    """The events as messages in five batches, each worked on against the stored state that the ones before
    it left; the second is run twice, as after a crash."""
    table = consumer.StoredTable(spark, shared_path(spark, "consumer"), snapshot=2)
    known = load(spark, d, "customer").filter("c_custkey % 10 <> 0").select(F.col("c_custkey").alias("candidate"))
    messages = load(spark, d, "events").select(F.col("event_id").alias("message"), F.col("user_id").alias("candidate"))
    for batch in (0, 1, 1, 2, 3, 4):
        consumer.consume(messages.filter(F.col("message") % 5 == batch), batch, table, known, screen)
    rows = table.outcomes(0)
    for batch in range(1, 5):
        rows = rows.union(table.outcomes(batch))
    return rows.select("message", "candidate", "outcome", "reason", "status", "tried", "result", "error_code")

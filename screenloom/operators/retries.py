"""What happens to jobs whose attempts fail, and how often a watcher asks: decisions over logs.

These are the batch forms; `screenloom.streaming.decisions` keeps the same decisions in state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from screenloom.sources.tables import shared_path

from .lifecycle import STATUSES, backoff_ms, next_status
from .replay import CHUNK, carried, replay

#: Attempts of a job, the delay before the second one, in milliseconds.
ATTEMPTS, BACKOFF_MS = 3, 10_000
#: How often a watcher asks as long as nothing changes, after each minute without a change;
#: failures in a row that end it, and the time after which it ends.
LADDER_MS, RUNG_MS, MAX_FAILURES, HARD_CAP_MS = (8_000, 20_000, 30_000), 60_000, 4, 600_000


def millis(ts: str) -> Column:
    return F.unix_millis(F.col(ts).cast("timestamp"))


def failure_path(log: DataFrame, key: str, order: list[str], ts: str = "ts", code: str = "code", retryable: str = "retryable", attempts: int = ATTEMPTS, base_ms: int = BACKOFF_MS, chunk: int = CHUNK) -> DataFrame:
    """key, order, at_ms, attempt, action, code and unrecoverable, from a log of how attempts ended (code
    is null where one succeeded).

    A failure that can be retried releases the job while attempts remain, and the job comes back
    (`requeued`, as a row of its own) after its backoff; the last one, or one that can't be retried,
    makes it failed. What comes after the end is skipped: somebody else has moved the job on."""
    waiting = tuple(map(str, range(attempts)))

    def step(state: Column, row: Column) -> Column:
        again = F.coalesce(row[retryable], F.lit(True)) & (state != waiting[-1])
        following = F.when(row[code].isNull(), "done").when(again, (state.cast("int") + 1).cast("string")).otherwise("failed")
        return F.when(state.isin(*waiting), following)

    slim = log.select(key, *[c for c in order if c != ts], ts, code, retryable) if ts in order else log.select(key, *order, ts, code, retryable)
    rows = replay(slim, key, order, (*waiting, "done", "failed"), step, waiting[0], chunk)
    action = F.when(~F.col("accepted"), "skipped").when(F.col("after").isin("done", "failed"), F.col("after")).otherwise("released")
    attempt = F.when(F.col("accepted"), F.col("before").cast("int") + 1)
    rows = rows.select(key, *[c for c in order if c != ts], millis(ts).alias("at_ms"), attempt.alias("attempt"), action.alias("action"), code, (F.col("after").eqNullSafe("failed") & F.col("accepted") & ~F.coalesce(F.col(retryable), F.lit(True))).alias("unrecoverable"))
    # a release is two rows: itself, and the job's return
    returns = F.array(F.struct(F.col("at_ms"), F.col("attempt"), F.col("action"), F.col(code).alias("code")), F.struct((F.col("at_ms") + backoff_ms(F.col("attempt"), base_ms)).alias("at_ms"), (F.col("attempt") + 1).alias("attempt"), F.lit("requeued").alias("action"), F.lit(None).cast("string").alias("code")))
    each = F.explode(F.when(F.col("action") == "released", returns).otherwise(F.slice(returns, 1, 1))).alias("_r")
    return rows.select(key, *[c for c in order if c != ts], each, "unrecoverable").select(key, *[c for c in order if c != ts], "_r.*", "unrecoverable")


def admitted(requests: DataFrame, key: str, ts: str, order: list[str], window: str = "60 seconds", limit: int = 30) -> DataFrame:
    """requests with window_start, admitted and retry_after_s: the first `limit` of each key and fixed
    window pass, in order; others may come back when the window ends.

    The last one that passes is found first, by ranks that Spark cuts off at the limit before it shuffles;
    all requests are then held against it, so that a busy key's requests are never sorted in one task."""
    place = F.struct(*order)
    rows = requests.withColumn("_w", F.window(F.col(ts).cast("timestamp"), window))
    rows = rows.withColumn("window_start", F.col("_w.start")).withColumn("_end", F.col("_w.end")).drop("_w")
    by = Window.partitionBy(key, "window_start").orderBy(*order)
    firsts = rows.select(key, "window_start", *order).withColumn("_n", F.row_number().over(by)).filter(F.col("_n") <= limit)
    bounds = firsts.groupBy(F.col(key).alias("_key"), F.col("window_start").alias("_start")).agg(F.max(place).alias("_last"))
    out = rows.join(bounds, F.col(key).eqNullSafe(F.col("_key")) & (F.col("window_start") == F.col("_start")))
    passes = place <= F.col("_last")
    wait = F.ceil((F.unix_millis("_end") - millis(ts)) / 1000).cast("long")
    return out.withColumn("admitted", passes).withColumn("retry_after_s", F.when(~passes, wait)).drop("_key", "_start", "_last", "_end")


def interval_ms(base_ms: int, since_change: Column) -> Column:
    """How long to wait: the base, then the ladder's rungs, which only ever slow down."""
    steps = F.floor(since_change / RUNG_MS).cast("int")
    rung = F.element_at(F.array(*map(F.lit, LADDER_MS)), F.least(F.greatest(steps, F.lit(1)), F.lit(len(LADDER_MS))))
    return F.when(steps <= 0, F.lit(base_ms)).otherwise(F.greatest(F.lit(base_ms), rung)).cast("long")


def poll_schedule(polls: DataFrame, key: str, order: list[str], ts: str = "ts", signature: str = "signature", failed: str = "failed", gone: str = "gone", complete: str = "complete", base_ms: int = 3_000, chunk: int = CHUNK) -> DataFrame:
    """polls with since_change_ms, next_ms and stop: how long after each poll the next one comes, or why
    there is none (complete, not_found, failures, timeout); next_ms and since_change_ms are null from
    the stop on, and stop is told at the poll that brought it; those after it are `ignored`.

    The clock runs from the last poll that succeeded with another signature than the one before it. The
    replayed rows are kept in the cluster's shared folder, which the result reads."""
    going = tuple(map(str, range(MAX_FAILURES)))
    began = polls.groupBy(F.col(key).alias("_first_of")).agg(F.min(millis(ts)).alias("_began"))
    rows = polls.join(began, F.col(key).eqNullSafe(F.col("_first_of"))).drop("_first_of").withColumn("_ms", millis(ts))

    def step(state: Column, row: Column) -> Column:
        fails = F.coalesce(row[failed], F.lit(False))
        n = F.when(fails, state.cast("int") + 1).otherwise(0)
        late = row["_ms"] - row["_began"] >= HARD_CAP_MS
        then = F.when(~fails & row[complete], "complete").when(fails & row[gone], "not_found").when(n >= MAX_FAILURES, "failures").when(late, "timeout").otherwise(n.cast("string"))
        return F.when(state.isin(*going), then)

    rows = replay(rows, key, order, (*going, "complete", "not_found", "failures", "timeout"), step, going[0], chunk)
    # written once: what follows reads the rows four times, and each time would replay the log again
    path = shared_path(polls.sparkSession, "polls")
    rows.write.option("compression", "zstd").parquet(path)
    rows = polls.sparkSession.read.schema(rows.schema).parquet(path)
    told = F.when(~F.coalesce(F.col(failed), F.lit(False)), F.struct(F.col(signature).alias("is")))
    last = lambda c: F.last(c, ignorenulls=True)
    within = Window.partitionBy(key, "_chunk").orderBy("_at")
    earlier = within.rowsBetween(Window.unboundedPreceding, -1)
    ends = F.max_by(told, F.when(told.isNotNull(), F.col("_at")))
    pieces = rows.groupBy(F.col(key).alias("_of"), F.col("_chunk").alias("_at_chunk")).agg(ends.alias("_v"))
    before = Window.partitionBy("_of").orderBy("_at_chunk").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select("_of", "_at_chunk", last(F.col("_v")).over(before).alias("_old"))
    rows = rows.join(pieces, F.col(key).eqNullSafe(F.col("_of")) & (F.col("_chunk") == F.col("_at_chunk"))).drop("_of", "_at_chunk")
    previous = F.coalesce(last(told).over(earlier), F.col("_old"))
    rows = rows.withColumn("_changed", F.when(told.isNotNull() & ~told.eqNullSafe(previous), F.col("_ms")))
    rows = carried(rows, key, F.col("_changed"), F.max)
    changed = F.greatest(F.max("_changed").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.col("_carried"), F.col("_began"))
    since = F.col("_ms") - changed
    goes_on = F.col("after").isin(*going)
    stop = F.when(~F.col("accepted"), "ignored").when(~goes_on, F.col("after"))
    return rows.withColumn("since_change_ms", F.when(goes_on, since)).withColumn("next_ms", F.when(goes_on, interval_ms(base_ms, since))).withColumn("stop", stop).select(*polls.columns, "since_change_ms", "next_ms", "stop")


def fold_payloads(log: DataFrame, key: str, order: list[str], event: str = "event", ts: str = "ts", raw_text: str = "raw_text", result: str = "result", error: tuple[str, ...] = ("error_code", "error_message"), chunk: int = CHUNK) -> DataFrame:
    """key, status, attempts, raw_text, result, error_code, error_message, completed_at: what each key's
    log leaves in its row.

    Only accepted events write: `evaluate` the text, `finish` the result, `fail` the error; a finish or a
    retry clears the error, a retry the time of completion. The last writer is the one of the largest
    place in the log, so that rows combine in any order and before the shuffle."""
    step = lambda status, row: next_status(status, row[event])
    rows = replay(log, key, order, STATUSES, step, "pending", chunk)
    place = F.struct(*order)
    at = lambda *events: F.max(F.when(F.col("accepted") & F.col(event).isin(*events), place))
    of = lambda c, *events: F.max_by(F.struct(F.col(c).alias("v")), F.when(F.col("accepted") & F.col(event).isin(*events), place))["v"]
    sums = rows.groupBy(key).agg(
        F.max_by("after", place).alias("status"),
        F.count_if(F.col("accepted") & (F.col(event) == "retry")).alias("attempts"),
        of(raw_text, "evaluate").alias("raw_text"),
        of(result, "finish").alias("result"),
        *(of(c, "fail").alias(f"_{c}") for c in error),
        at("fail").alias("_failed"),
        at("finish", "retry").alias("_cleared"),
        at("finish", "fail").alias("_completed"),
        at("retry").alias("_reopened"),
        of(ts, "finish", "fail").alias("_ended"),
    )
    after = lambda a, b: F.col(a).isNotNull() & (F.col(b).isNull() | (F.col(a) > F.col(b)))
    errors = [F.when(after("_failed", "_cleared"), F.col(f"_{c}")).alias(c) for c in error]
    return sums.select(key, "status", "attempts", "raw_text", "result", *errors, F.when(after("_completed", "_reopened"), F.col("_ended")).alias("completed_at"))

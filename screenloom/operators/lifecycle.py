"""The life of a candidate row: statuses, guarded transitions, job reports, stuck rows, retries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Statuses in order, and which of them are final.
STATUSES = ("pending", "parsing", "evaluating", "done", "failed")
TERMINAL = ("done", "failed")
#: Event, statuses it may start from, status it leads to.
TRANSITIONS = (
    ("claim", ("pending",), "parsing"),
    ("evaluate", ("parsing",), "evaluating"),
    ("finish", ("evaluating",), "done"),
    ("fail", ("pending", "parsing", "evaluating"), "failed"),
    ("retry", ("failed",), "pending"),
    ("release", ("parsing", "evaluating"), "pending"),
)

#: Events that are read as one piece.
CHUNK = 4096


def next_status(status: Column, event: Column) -> Column:
    """The status that an event leads to; null if it isn't allowed there."""
    out = F.lit(None).cast("string")
    for name, start, to in TRANSITIONS:
        out = F.when((event == name) & status.isin(*start), F.lit(to)).otherwise(out)
    return out


def chunk_maps(log: DataFrame, key: str, order: list[str], event: str = "event", chunk: int = CHUNK) -> DataFrame:
    """key, chunk, n, maps: pieces of at most `chunk` events of each key's log, in order, and for each
    status in STATUSES what the piece makes of it: status, accepted, refused, attempts."""
    rows = log.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_o{i}") for i, c in enumerate(order)), F.col(event).alias("_event"))
    by = rows.columns
    # numbers of rows in order, a partition's after those of the one before
    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    pieces = dealt.groupBy("_key", F.floor(F.col("_at") / chunk).alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("_at", "_event"))).alias("_events"))

    def step(s: Column, x: Column) -> Column:
        to, e = next_status(s["status"], x["_event"]), x["_event"]
        one = lambda c: F.when(c, 1).otherwise(0).cast("long")
        return F.struct(
            F.coalesce(to, s["status"]).alias("status"),
            (s["accepted"] + one(to.isNotNull())).alias("accepted"),
            (s["refused"] + one(to.isNull())).alias("refused"),
            (s["attempts"] + one(to.isNotNull() & (e == "retry"))).alias("attempts"),
        )

    maps = F.array(*(F.aggregate("_events", start_of(s), step) for s in STATUSES))
    return pieces.select(F.col("_key").alias(key), "chunk", F.size("_events").alias("n"), maps.alias("maps"))


def start_of(status: str) -> Column:
    return F.struct(F.lit(status).alias("status"), *(F.lit(0).cast("long").alias(c) for c in ("accepted", "refused", "attempts")))


def fold_transitions(log: DataFrame, key: str, order: list[str], event: str = "event", chunk: int = CHUNK) -> DataFrame:
    """key, status, accepted, refused, attempts: each key's log, read in order from `pending`.

    A key's log is read in pieces, side by side; what comes together for a key is a map a piece."""

    def then(s: Column, x: Column) -> Column:
        to = F.element_at(x["maps"], F.array_position(F.array(*map(F.lit, STATUSES)), s["status"]).cast("int"))
        return F.struct(to["status"].alias("status"), *((s[c] + to[c]).alias(c) for c in ("accepted", "refused", "attempts")))

    pieces = F.array_sort(F.collect_list(F.struct("chunk", "maps")))
    whole = chunk_maps(log, key, order, event, chunk).groupBy(key).agg(pieces.alias("_pieces"))
    return whole.select(key, F.aggregate("_pieces", start_of("pending"), then).alias("s")).select(key, "s.*")


def status_counts(rows: DataFrame, job: str = "job_id", status: str = "status") -> DataFrame:
    """job, a count for each status, and total."""
    return rows.groupBy(job).agg(*(F.count_if(F.col(status) == s).alias(s) for s in STATUSES), F.count(F.lit(1)).alias("total"))


def job_status() -> Column:
    """A job's status from status_counts(). The order of the cases matters."""
    active = F.col("pending") + F.col("parsing") + F.col("evaluating")
    return (
        F.when(F.col("total") == 0, "completed")
        .when(F.col("pending") == F.col("total"), "queued")
        .when(active > 0, "in_progress")
        .when(F.col("failed") > 0, "completed_with_failures")
        .otherwise("completed")
    )


def job_report(jobs: DataFrame, rows: DataFrame, job: str = "job_id") -> DataFrame:
    """Every job with counts, status and duplicates: files that became no row of their own."""
    counts = status_counts(rows, job)
    out = jobs.join(counts, job, "left").na.fill(0, [*STATUSES, "total"])
    return out.withColumn("job_status", job_status()).withColumn("duplicates", F.col("file_count") - F.col("total"))


def stuck(rows: DataFrame, before: Column, limit: int, updated: str = "updated_at", key: str = "id") -> DataFrame:
    """Rows in no final status that nobody touched since `before`, oldest first."""
    waiting = [s for s in STATUSES if s not in TERMINAL]
    return rows.filter(F.col("status").isin(*waiting) & (F.col(updated) < before)).orderBy(updated, key).limit(limit)


def sweep_counts(found: DataFrame) -> DataFrame:
    """found, released (those that aren't pending already) and enqueued, of stuck rows."""
    return found.agg(F.count(F.lit(1)).alias("found"), F.count_if(F.col("status") != "pending").alias("released"), F.count(F.lit(1)).alias("enqueued"))


def backoff_ms(attempt: Column, base: int = 10_000) -> Column:
    """Delay before a retry: the base, doubled for each attempt after the first."""
    return (F.lit(base) * F.pow(F.lit(2), attempt - 1)).cast("long")


def all_terminal(statuses: Column) -> Column:
    """Whether all are final; true of none."""
    return F.coalesce(F.forall(statuses, lambda s: s.isin(*TERMINAL)), F.lit(True))


def retry_disposition(exists: Column, status: Column, has_file: Column) -> Column:
    return (
        F.when(~exists, "not_found").when(status != "failed", "status_conflict").when(~has_file, "source_file_missing").otherwise("requeued")
    )


def retry_job_id(key: Column, attempt: Column) -> Column:
    """The queue's id of a retry; the first run goes by the row's own id."""
    return F.concat_ws("-", key.cast("string"), F.lit("retry"), attempt.cast("string"))

"""Decisions kept in state: what becomes of failed attempts, and which requests are let in.

`screenloom.operators.retries` has the same over whole logs. All need the RocksDB state store
(spark.sql.streaming.stateStore.providerClass) and a watermark on `ts`; a micro-batch's rows of one key are
put in order before they are read, and files or offsets bound a micro-batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from screenloom.operators.retries import ATTEMPTS, BACKOFF_MS


def in_order(rows: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    yield from pd.concat(rows).sort_values(["ts", "event_id"]).itertuples(index=False)


def ms_of(ts: pd.Timestamp) -> int:
    return ts.value // 1_000_000


class FailureProcessor(StatefulProcessor):
    """Keeps how many attempts of a job have failed. A failure that can be retried sets a timer; when it
    ends, the job comes back."""

    SCHEMA = "job long, event_id long, at_ms long, attempt int, action string, code string, unrecoverable boolean"

    def __init__(self, attempts: int = ATTEMPTS, base_ms: int = BACKOFF_MS) -> None:
        self.attempts, self.base_ms = attempts, base_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.failed = handle.getValueState("failed", "n int, final boolean")
        self.due = handle.getMapState("due", "at_ms long, event_id long", "attempt int")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n, final = self.failed.get() if self.failed.exists() else (0, False)
        out = []
        for row in in_order(rows):
            code, at, attempt, action = row.code, ms_of(row.ts), n + 1, "skipped"
            if final:
                attempt = None
            elif pd.isna(code):
                action, final = "done", True
            elif row.retryable and attempt < self.attempts:
                action, n = "released", attempt
                due = at + self.base_ms * 2 ** (attempt - 1)
                self.due.updateValue((due, row.event_id), (attempt + 1,))
                self.handle.registerTimer(due)
            else:
                action, final = "failed", True
            out.append((key[0], row.event_id, at, attempt, action, None if pd.isna(code) else code, action == "failed" and not row.retryable))
        self.failed.update((n, final))
        yield self.frame(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = expiredTimerInfo.getExpiryTimeInMs()
        due = [(at, event, attempt) for (at, event), (attempt,) in list(self.due.iterator()) if at <= now]
        for at, event, _ in due:
            self.due.removeKey((at, event))
        yield self.frame([(key[0], event, at, attempt, "requeued", None, False) for at, event, attempt in due])

    def frame(self, rows: list[tuple]) -> pd.DataFrame:
        names = [c.split()[0] for c in self.SCHEMA.split(", ")]
        return pd.DataFrame(rows, columns=names).astype({"attempt": "Int32", "unrecoverable": bool, "code": object})

    def close(self) -> None:
        pass


def failure_stream(outcomes: DataFrame, attempts: int = ATTEMPTS, base_ms: int = BACKOFF_MS, late: str = "1 minute") -> DataFrame:
    """What failure_path() gives, from a stream of (job, ts, event_id, code, retryable); a job comes back
    once the watermark has passed its backoff."""
    rows = outcomes.withWatermark("ts", late).groupBy("job")
    return rows.transformWithStateInPandas(FailureProcessor(attempts, base_ms), outputStructType=FailureProcessor.SCHEMA, outputMode="Append", timeMode="EventTime")


class AdmissionProcessor(StatefulProcessor):
    """Counts a key's requests in each fixed window that is still open; windows go when the watermark
    has passed their end."""

    SCHEMA = "caller long, event_id long, window_ms long, admitted boolean, retry_after_s long"

    def __init__(self, window_ms: int, limit: int) -> None:
        self.window_ms, self.limit = window_ms, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getMapState("counts", "window_ms long", "n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        seen: dict[int, int] = {}
        out = []
        for row in in_order(rows):
            at = ms_of(row.ts)
            start = at // self.window_ms * self.window_ms
            if start not in seen:
                seen[start] = self.counts.getValue((start,))[0] if self.counts.containsKey((start,)) else 0
            seen[start] += 1
            passes = seen[start] <= self.limit
            micros = row.ts.value // 1000 - start * 1000
            out.append((key[0], row.event_id, start, passes, None if passes else -(-(self.window_ms - micros // 1000) // 1000)))
        for start, n in seen.items():
            self.counts.updateValue((start,), (n,))
            self.handle.registerTimer(start + self.window_ms)
        yield pd.DataFrame(out, columns=["caller", "event_id", "window_ms", "admitted", "retry_after_s"]).astype({"retry_after_s": "Int64"})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        start = expiredTimerInfo.getExpiryTimeInMs() - self.window_ms
        if self.counts.containsKey((start,)):
            self.counts.removeKey((start,))
        yield pd.DataFrame(columns=["caller", "event_id", "window_ms", "admitted", "retry_after_s"]).astype({"caller": "int64", "event_id": "int64", "window_ms": "int64", "admitted": bool, "retry_after_s": "Int64"})

    def close(self) -> None:
        pass


def admission_stream(requests: DataFrame, window_ms: int = 60_000, limit: int = 30, late: str = "1 minute") -> DataFrame:
    """What admitted() says of each of a stream's requests (caller, ts, event_id)."""
    rows = requests.withWatermark("ts", late).groupBy("caller")
    return rows.transformWithStateInPandas(AdmissionProcessor(window_ms, limit), outputStructType=AdmissionProcessor.SCHEMA, outputMode="Append", timeMode="EventTime")

"""Whitening of embeddings by a tall-skinny QR.

Entries become whole numbers, so that sums over the corpus are exact and rows are centred by them without
rounding. Each task folds its centred rows into one triangular factor R, batch by batch; factors are
stacked and factored again, FAN at a time, until one is left. Its singular values and right vectors
are those of all centred rows, so the covariance is never formed and its condition never squared. Components
are the right vectors in the order of falling variance; a row is whitened by its projections on them over
the standard deviations.

What a task holds is a batch of rows and a few squares of the dimension; the driver holds one such square.
Rows are read once for the sums, once for the factors, once for the check of the whitened rows and once
for the result; they are never shuffled or sorted.

Defined results: rows whose vector is null or holds null or non-finite entries take no part and are not
returned; a vector that is shorter than the longest counts as zeros beyond its end; an entry whose
64-fold lies beyond LARGEST counts as LARGEST (with its sign); components along which rows don't differ, as told
from the rounding of doubles, can't be whitened and are not returned; a deviation that no long holds is
null; repeated rows and null ids are rows like others; no remaining row: no result; columns other than
the id and the vector are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Work, in_batches

UNIT, SHIFT, LARGEST = 64, 1_000_000, 1 << 40
COMPONENTS = 32
#: Factors that are stacked into one, and numbers in a stack of rows that is factored at a time.
FAN, STACK = 16, 1 << 20


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.select(F.col(id_col).alias("id"), v.alias("v")).filter(F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(False)))


def whole_numbers(vectors: pa.Array, dims: int) -> np.ndarray:
    """The vectors' entries as longs, one row each."""
    lengths = np.diff(vectors.offsets.to_numpy())
    flat = vectors.values.slice(vectors.offsets[0].as_py(), int(lengths.sum())).to_numpy(zero_copy_only=False)
    flat = np.clip(np.floor(UNIT * flat), -LARGEST, LARGEST).astype(np.int64) + SHIFT
    if (lengths == dims).all():
        return flat.reshape(-1, dims)
    out = np.full((len(lengths), dims), SHIFT, np.int64)
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


@dataclass(frozen=True)
class Sums:
    """Of all rows: how many, and the sum of each dimension."""

    n: int
    of: tuple[int, ...]

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n*x - S, exact: as longs if they hold it, else as Python's numbers."""
        s = np.array(self.of, object)
        near = np.array([v // self.n for v in self.of], np.int64)
        rest = np.array([v % self.n for v in self.of], np.int64)
        off = x - near  # n*x - S = n * (x - S // n) - S % n
        if len(off) and int(np.abs(off).max(initial=0)) + 1 < (1 << 62) // self.n:
            return off * self.n - rest
        return x.astype(object) * self.n - s


def summed(rows: DataFrame, dims: int) -> Sums:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(dims, np.int64), 0
        for batch in batches:
            x = whole_numbers(batch.column(0), dims)
            total, n = total + x.sum(axis=0), n + len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims, dtype=np.int32)), pa.array(total), pa.array(np.full(dims, n, np.int64))], ["dim", "s", "n"])

    each = in_batches(rows.select("v")).mapInArrow(run, "dim int, s long, n long")
    found = each.groupBy("dim").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).orderBy("dim").collect()  # a row a dimension
    return Sums(found[0]["n"] if found else 0, tuple(r["s"] for r in found))


def factor(stack: np.ndarray) -> np.ndarray:
    """The triangular factor of a stack; it has as many rows as the stack or columns, whichever is less."""
    return np.linalg.qr(stack, mode="r")


def factors(rows: DataFrame, sums: Sums) -> DataFrame:
    """k and r: for each task the triangular factor of its centred rows."""
    dims = len(sums.of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, dims))
        step = max(1, STACK // dims)
        for batch in batches:
            centred = sums.centred(whole_numbers(batch.column(0), dims)).astype(np.float64) / sums.n
            for at in range(0, len(centred), step):
                r = factor(np.concatenate((r, centred[at : at + step])))
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.tobytes()], pa.binary())], ["k", "r"])

    return in_batches(rows.select("v")).mapInArrow(run, "k long, r binary")


def merged(parts: DataFrame, dims: int, work: Work) -> np.ndarray:
    """The factor of all the factors, by a tree."""
    stack = lambda column: np.concatenate([np.frombuffer(x.as_py(), np.float64).reshape(-1, dims) for x in column])

    def merge(table: pa.Table) -> pa.Table:
        in_order = table.sort_by("k")
        return pa.table({"k": pa.array([in_order.column("k")[0].as_py() // FAN], pa.int64()), "r": pa.array([factor(stack(in_order.column("r"))).tobytes()], pa.binary())})

    level = work.table(parts, "factors")
    while level.count() > FAN:
        # numbers of tasks that had rows have gaps, which divide with them
        level = work.table(level.groupBy(F.expr(f"k div {FAN}").alias("_at")).applyInArrow(merge, "k long, r binary"), "factors", instead_of=level)
    last = level.orderBy("k").toArrow()  # FAN factors at most
    return factor(stack(last.column("r"))) if last.num_rows else np.zeros((0, dims))


@dataclass(frozen=True)
class Whitening:
    """What whitens a row: sums of the corpus, and for each component its vector, standard deviation and
    share of the variance."""

    sums: Sums
    vectors: np.ndarray
    deviations: np.ndarray
    explained: np.ndarray

    def centred(self, vectors: pa.Array) -> np.ndarray:
        return self.sums.centred(whole_numbers(vectors, len(self.sums.of)))

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        return (centred.astype(np.float64) / self.sums.n) @ self.vectors.T / self.deviations


def fit(rows: DataFrame, components: int, work: Work) -> Whitening:
    """The whitening of rows, which usable() gives."""
    dims = rows.agg(F.max(F.size("v"))).first()[0] or 0
    if not dims:
        return Whitening(Sums(0, ()), np.zeros((0, 0)), np.zeros(0), np.zeros(0))
    sums = summed(rows, dims)
    _, values, right = np.linalg.svd(merged(factors(rows, sums), dims, work), full_matrices=False)
    real = values > max(values.max(initial=0), 1e-300) * np.finfo(float).eps * max(dims, 16) * 8
    kept = np.flatnonzero(real)[:components]
    signs = np.sign(right[np.arange(len(right)), np.abs(right).argmax(axis=1)]) if len(right) else np.zeros(0)
    variance = values**2 / sums.n
    return Whitening(sums, (right * signs[:, None])[kept], np.sqrt(variance[kept]), variance[kept] / max(variance.sum(), 1e-300))


def identity_error(rows: DataFrame, found: Whitening) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity. Centred rows add up
    to zero exactly, and so do their projections, so products need no further centring."""
    k = len(found.deviations)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            w = found.whitened(found.centred(batch.column(0)))
            total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k, dtype=np.int32)), pa.array(total.ravel())], ["at", "x"])

    each = in_batches(rows.select("v")).mapInArrow(run, "at int, x double").groupBy("at").agg(F.sum("x").alias("x"))
    off = F.abs(F.col("x") / F.lit(found.sums.n) - F.when(F.col("at") % (k + 1) == 0, 1.0).otherwise(0.0))
    return each.agg(F.max(off)).first()[0]


def whiten(rows: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, component (from 1), n, deviation, whitened, explained and identity_error: a row for each row
    that takes part and component."""
    taken = usable(rows, id_col, vector_col)
    with Work(rows.sparkSession) as work:
        found = fit(taken, components, work)
    k = len(found.deviations)
    error = identity_error(taken, found) if k else 0.0
    names = [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"]
    kind = taken.schema["id"].dataType.simpleString()

    def squares(centred: np.ndarray) -> pa.Array:
        if centred.dtype != object and int(np.abs(centred).max(initial=0)) ** 2 * centred.shape[1] < 1 << 63:
            return pa.array((centred * centred).sum(axis=1))
        exact = [sum(int(v) ** 2 for v in row) for row in centred]
        return pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not k:
                continue
            centred = found.centred(batch.column(1))
            n = batch.num_rows
            columns = [
                batch.column(0).take(pa.array(np.repeat(np.arange(n), k))),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)),
                pa.array(np.full(n * k, found.sums.n, np.int64)),
                squares(centred).take(pa.array(np.repeat(np.arange(n), k))),
                pa.array(found.whitened(centred).ravel()),
                pa.array(np.tile(found.explained, n)),
                pa.array(np.full(n * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    return in_batches(taken).mapInArrow(run, f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")

"""Nearest neighbours by largest inner product, with a block matrix join.

Vectors are gathered into blocks of int8 codes. Groups of query blocks meet groups of candidate blocks
by an equi-join on the pair of groups; a pair of blocks is a tile. The product of a tile's codes gives
every inner product but for an error whose bound is known from what rounding left over:
|x.y - x'.y'| <= |x - x'| |y| + |x'| |y - y'|.  So every pair has a lower and an upper bound. Pairs
whose upper bound is below the k-th best lower bound of their query can't matter: first in their group,
then among what all groups leave. The survivors are computed again in double precision from the original
vectors, which only now are joined to them, and the k best of each query are kept. The result is exact.

Defined results: vectors that are null, empty, all zero, or hold null or non-finite components take
no part; vectors of different length don't meet; a query never finds its own row, but rows that
repeat its id or vector like any other; ties go to the smaller id; repeated rows are queries and
candidates each; an empty table gives no rows; columns other than the id and the vector are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

BLOCK = 2048
#: Blocks in a group: with the block size they bound what a task holds.
QUERY_GROUP, CANDIDATE_GROUP = 4, 8
EXACT_DIMS = 1024  # so many products of int8 codes add up exactly in float32


def usable(rows: DataFrame, asks: Column, id_col: str, vector_col: str) -> DataFrame:
    """(id, v, dim, asks) of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = rows.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).filter(~F.coalesce(bad, F.lit(True)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False)))
    return kept.select(F.col(id_col).cast("long").alias("id"), v.alias("v"), F.size(v).alias("dim"), F.coalesce(asks, F.lit(False)).alias("asks"))


class Codes:
    """A block's vectors as int8 codes, and what they leave over."""

    FIELDS = ("keys", "codes", "scale", "norm", "near_norm", "off")

    def __init__(self, dim: int, keys: bytes, codes: bytes, *facts: bytes) -> None:
        self.keys = np.frombuffer(keys, np.int64)
        self.codes = np.frombuffer(codes, np.int8).reshape(-1, dim)
        self.scale, self.norm, self.near_norm, self.off = (np.frombuffer(f, np.float64) for f in facts)

    @staticmethod
    def of(keys: np.ndarray, exact: np.ndarray) -> list[bytes]:
        scale = np.abs(exact).max(axis=1) / 127
        codes = np.rint(exact / scale[:, None])
        near = codes * scale[:, None]
        facts = scale, np.linalg.norm(exact, axis=1), np.linalg.norm(near, axis=1), np.linalg.norm(exact - near, axis=1)
        return [x.tobytes() for x in (keys, codes.astype(np.int8), *facts)]


def in_blocks(rows: DataFrame) -> DataFrame:
    """(dim, block, n) and the fields of Codes: blocks of vectors of one length; block is random."""
    names = ["dim", "block", "n", *Codes.FIELDS]

    def packed(dim: int, keys: list[int], vectors: list[np.ndarray]) -> pa.RecordBatch:
        own = np.array(keys, np.int64)
        name = int(np.bitwise_xor.reduce(own * 2654435761 + 12345) & 0x7FFFFFFF)
        return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([name], pa.int64()), pa.array([len(keys)], pa.int32()), *(pa.array([b]) for b in Codes.of(own, np.stack(vectors)))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = defaultdict(lambda: ([], []))
        for batch in batches:
            flat, offsets = batch.column(1).values.to_numpy(zero_copy_only=False), batch.column(1).offsets.to_numpy()
            for k, one in enumerate(batch.column(0).to_pylist()):
                v = flat[offsets[k] : offsets[k + 1]]
                keys, vectors = held[len(v)]
                keys.append(one)
                vectors.append(np.array(v))
                if len(keys) == BLOCK:
                    yield packed(len(v), keys, vectors)
                    del held[len(v)]
        for dim, (keys, vectors) in held.items():
            yield packed(dim, keys, vectors)

    return rows.select("key", "v").mapInArrow(run, "dim int, block long, n int, " + ", ".join(f"{f} binary" for f in Codes.FIELDS))


def products(q: Codes, c: Codes) -> tuple[np.ndarray, np.ndarray]:
    """Inner products of codes, scaled, and the bounds of their errors."""
    raw = np.zeros((len(q.keys), len(c.keys)))
    for k in range(0, q.codes.shape[1], EXACT_DIMS):
        raw += q.codes[:, k : k + EXACT_DIMS].astype(np.float32) @ c.codes[:, k : k + EXACT_DIMS].astype(np.float32).T
    bound = np.outer(q.off, c.norm) + np.outer(q.near_norm, c.off) + 1e-12 * np.outer(q.norm, c.norm)
    return raw * np.outer(q.scale, c.scale), bound


class Best:
    """What a query block has found: the k best lower bounds of each query, and the pairs that may matter."""

    def __init__(self, q: Codes, k: int) -> None:
        self.q, self.k = q, k
        self.lows = np.full((len(q.keys), k), -np.inf)
        self.found: list[tuple[np.ndarray, ...]] = []

    def add(self, c: Codes) -> None:
        near, bound = products(self.q, c)
        own = self.q.keys[:, None] == c.keys[None, :]
        low = np.where(own, -np.inf, near - bound)
        self.lows = np.partition(np.concatenate((self.lows, low), axis=1), low.shape[1], axis=1)[:, low.shape[1] :]
        rows, cols = np.nonzero((near + bound >= self.lows.min(axis=1)[:, None]) & ~own)
        self.found.append((rows, c.keys[cols], low[rows, cols], near[rows, cols] + bound[rows, cols]))

    def left(self) -> pd.DataFrame:
        rows, keys, low, high = (np.concatenate(x) for x in zip(*self.found, strict=True))
        may = high >= self.lows.min(axis=1)[rows]
        return pd.DataFrame({"asker": self.q.keys[rows[may]], "key": keys[may], "low": low[may], "high": high[may]})


def nearest(rows: DataFrame, asks: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): for each row that asks, the k nearest of the other rows."""
    base = materialise(usable(rows, asks, id_col, vector_col).withColumn("key", F.monotonically_increasing_id()), "vectors")
    # of rows with one vector only the k + 1 of least id can be among the k nearest of any
    same = Window.partitionBy("a", "b").orderBy("id", "key")
    first = base.select("key", "id", F.xxhash64("v").alias("a"), F.xxhash64(F.lit(1), "v").alias("b")).withColumn("_n", F.row_number().over(same)).filter(F.col("_n") <= k + 1)
    offered = base.join(first.select("key"), "key", "left_semi")
    n = base.agg(F.count(F.lit(1)).alias("all"), F.count_if("asks").alias("asks")).first()
    groups_c = max(1, -(-n["all"] // (BLOCK * CANDIDATE_GROUP)), min(8, -(-n["all"] // BLOCK)))
    groups_q = max(1, -(-n["asks"] // (BLOCK * QUERY_GROUP)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = in_blocks(base.filter("asks")).withColumn("gq", F.pmod("block", F.lit(groups_q)).cast("int")).withColumn("gc", every(groups_c))
    right = in_blocks(offered).withColumn("gc", F.pmod("block", F.lit(groups_c)).cast("int")).withColumn("gq", every(groups_q))
    names = ["dim", *Codes.FIELDS]

    def run(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        offered, found = [], []
        if len(q):
            offered = [Codes(*b) for b in c[names].itertuples(index=False)]
        for a in q[names].itertuples(index=False):
            best = Best(Codes(*a), k)
            for b in offered:
                best.add(b)
            if offered:
                found.append(best.left())
        return pd.concat(found) if found else pd.DataFrame({"asker": [], "key": [], "low": [], "high": []}).astype({"asker": "int64", "key": "int64"})

    keys = ["dim", "gq", "gc"]
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, "asker long, key long, low double, high double")
    met = materialise(met, "survivors")
    lows = Window.partitionBy("asker").orderBy(F.desc("low"))
    least = met.select("asker", "low", F.row_number().over(lows).alias("_n")).filter(F.col("_n") <= k).filter(F.col("_n") == k).select("asker", F.col("low").alias("_least"))
    pairs = met.join(least, "asker", "left").filter((F.col("high") >= F.col("_least")) | F.col("_least").isNull()).select("asker", "key")
    pairs = pairs.join(base.select("key", F.col("id"), F.col("v")), "key").join(base.select(F.col("key").alias("asker"), F.col("id").alias("query_id"), F.col("v").alias("w")), "asker")
    score = F.aggregate(F.zip_with("w", "v", lambda a, b: a * b), F.lit(0.0), lambda total, x: total + x)
    order = Window.partitionBy("asker").orderBy(F.desc("score"), id_col)
    best = pairs.select("asker", "query_id", F.col("id").alias(id_col), score.alias("score")).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.select("query_id", "rank", id_col, "score")

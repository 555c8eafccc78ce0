"""Packing documents into sequences by first-fit decreasing, in randomised groups.

A document is its token ids and an end id. Ids are cut into pieces of a whole sequence while they
last; those pieces are sequences of their own. The rest of each document is packed: documents are
dealt at random into groups of about `group_docs`, each group is packed by itself, longest piece
first, each into the first sequence with room. A tournament tree over the sequences' room finds that
one in logarithmic time. Groups bound what a task holds, and a group's padding is that of its last
few sequences.

Sequences of a group that end up at a power of two need no padding; others are padded to `length`.
Defined results: null text is empty and consists of the end id; repeated rows and null ids are
documents like others, dealt by their place in the input; an empty table gives no rows; columns
other than the id and the text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches, materialise
from .tokens import encoder

LENGTH = 2048
GROUP_DOCS = 4096


class Room:
    """A tournament tree of the room in each bin; new bins count as empty."""

    def __init__(self, bins: int, capacity: int) -> None:
        self.leaves = 1 << max(bins - 1, 0).bit_length()
        self.most = [capacity] * (2 * self.leaves)

    def first_with(self, size: int) -> int:
        """The first bin with room for size, which must exist; takes that room."""
        most, k = self.most, 1
        while k < self.leaves:
            k *= 2
            if most[k] < size:
                k += 1
        found = k - self.leaves
        most[k] -= size
        while k > 1:
            k //= 2
            most[k] = max(most[2 * k], most[2 * k + 1])
        return found


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each size; equal sizes go in the order given."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    room, filled = Room(len(sizes), capacity), [0] * len(sizes)
    for k in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[k])
        bins[k] = b = room.first_with(size)
        offsets[k] = filled[b]
        filled[b] += size
    return bins, offsets


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, tokenizer: str | None = None) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, serial), one row a piece; no two share a serial."""
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    names = ["start", "length", "ids_crc32", "doc_tokens", "serial"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, serial = encoder(tokenizer).ids, TaskContext.get().partitionId() << 36
        for batch in batches:
            of, found = [], []
            for k, text in enumerate(batch.column(1)):
                ids = encode(text.as_py())
                data = ids.tobytes()
                for start in range(0, len(ids), length):
                    of.append(k)
                    found.append((start, min(length, len(ids) - start), zlib.crc32(data[4 * start : 4 * (start + length)]), len(ids), serial))
                    serial += 1
            columns = np.array(found, np.int64).reshape(-1, len(names)).T
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), *map(pa.array, columns)], [id_col, *names])

    return in_batches(rows).mapInArrow(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, " + ", ".join(f"{n} long" for n in names))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, group_docs: int = GROUP_DOCS, seed: int = 0, tokenizer: str | None = None) -> DataFrame:
    """One row a piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    cut = materialise(pieces(docs, id_col, text_col, length, tokenizer), "pieces")
    rests = cut.filter(F.col("length") < length)
    groups = max(1, round(rests.count() / group_docs))

    def run(key: tuple[int], rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "serial"], ascending=[False, True])
        bins, offsets = first_fit_decreasing(rows["length"].to_numpy(), length)
        return rows.drop(columns="_group").assign(sequence_id=(int(key[0]) << 32) + bins, offset=offsets)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema)
    grouped = rests.withColumn("_group", F.pmod(F.xxhash64(F.lit(seed), "serial"), F.lit(groups))).groupBy("_group")
    packed = grouped.applyInPandas(run, f"{fields}, sequence_id long, offset long")
    alone = cut.filter(F.col("length") == length).withColumn("sequence_id", F.col("serial").bitwiseOR(F.lit(1 << 62))).withColumn("offset", F.lit(0).cast("long"))
    return packed.union(alone).drop("serial")


def padding(packed: DataFrame, length: int = LENGTH) -> DataFrame:
    """tokens and padding of all sequences, one row."""
    used = packed.groupBy("sequence_id").agg(F.sum("length").alias("used"))
    exact = F.col("used").bitwiseAND(F.col("used") - 1) == 0
    return used.agg(F.sum("used").alias("tokens"), F.sum(F.when(exact, 0).otherwise(F.lit(length) - F.col("used"))).alias("padding"))

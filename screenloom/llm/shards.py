"""Token ids in training order: fixed-stride shards of sequences at permuted places.

Documents are turned into ids, each with an end id, and their ids, one after another, are cut into
sequences of `length`. Sequences are written once, in the order of the input, and so have a number:
that of their file plus their row in it. A keyed Feistel permutation of the numbers, which walks
along its cycle until it is back in range, gives each sequence its slot in training order, without
a sort and without a table. Shard s holds slots [s * shard_size, (s + 1) * shard_size); slot i is
at byte (i - s * shard_size) * stride of it. Every task writes whole shards, so that training reads
them front to back and can go on from any slot.

A shard is written under a name of its attempt and renamed when it is whole, so retries and
speculative attempts can't leave half a shard. A rerun with the same key, over the same files, gives
the same bytes; with `resume`, shards that are there are read along, and written only if they differ.

Ids are stored as unsigned 16-bit numbers if the vocabulary allows, else 32-bit; the last sequence
of each input task is filled up with the padding id. Defined results: null and empty texts consist
of the end id; repeated rows and null ids are documents like others; an empty table gives no rows
and no shard; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches, work_path
from .hashing import mixed
from .tokens import END, encoder

LENGTH, SHARD_SIZE, KEY = 2048, 4096, "training-order"
ROUNDS = 6
#: Shards that a task writes, one after the other.
SHARDS_A_TASK = 8
#: Texts, and characters of each, by which the codec ranks ids.
SAMPLE_TEXTS, SAMPLE_CHARS = 400, 4000


def permuted(numbers: np.ndarray, n: int, key: str = KEY) -> np.ndarray:
    """The slots of numbers below n: a keyed permutation of 0..n-1."""
    bits = np.uint64(max(1, -(-max(n - 1, 1).bit_length() // 2)))
    mask = (np.uint64(1) << bits) - np.uint64(1)
    keys = [np.uint64(int.from_bytes(hashlib.sha256(f"{key}:{k}".encode()).digest()[:8], "little")) for k in range(ROUNDS)]
    out, todo = numbers.astype(np.uint64), np.arange(len(numbers))
    while len(todo):  # the cycle is walked only by those that are out of range
        left, right = out[todo] >> bits, out[todo] & mask
        for k in keys:
            left, right = right, left ^ (mixed(mixed(right ^ k) + k) & mask)
        out[todo] = left << bits | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


class Codec:
    """How ids are held between the steps: as ranks by frequency, byte plane by byte plane, squeezed.
    The ranks come from a small sample of texts; they change how small ids get, and nothing else."""

    def __init__(self, vocabulary: int, sample: list[np.ndarray]) -> None:
        self.kind = "<u4" if vocabulary > 1 << 16 else "<u2"
        uses = np.bincount(np.concatenate([np.zeros(0, np.int64), *sample]), minlength=vocabulary)
        self.by_rank = np.argsort(-uses, kind="stable").astype(self.kind)
        self.rank = np.empty_like(self.by_rank)
        self.rank[self.by_rank] = np.arange(len(self.by_rank))

    def pack(self, ids: np.ndarray) -> bytes:
        width = np.dtype(self.kind).itemsize
        return zstandard.ZstdCompressor(level=3).compress(self.rank[ids].view(np.uint8).reshape(-1, width).T.tobytes())

    def unpack(self, data: bytes) -> np.ndarray:
        width = np.dtype(self.kind).itemsize
        planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(width, -1)
        return self.by_rank[np.ascontiguousarray(planes.T).view(self.kind)[:, 0]]


def fit_codec(docs: DataFrame, text_col: str, tokenizer: str | None) -> Codec:
    rows = docs.select(F.substring(F.col(text_col).cast("string"), 1, SAMPLE_CHARS)).limit(SAMPLE_TEXTS).collect()
    encode = encoder(tokenizer)
    return Codec(encode.size, [encode.ids(r[0]).astype(np.int64) for r in rows])


def sequences(docs: DataFrame, id_col: str, text_col: str, length: int, tokenizer: str | None, codec: Codec) -> DataFrame:
    """(place, row, n_ids, ids_crc32, ids, parts): sequences with their number in their task; ids are
    packed by the codec, and parts tells which ids of which documents they are."""
    sent = docs.sparkSession.sparkContext.broadcast(codec)
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, codec = encoder(tokenizer).ids, sent.value
        place, row = TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []
        parts: list[dict] = []
        room = length

        def full() -> list:
            nonlocal row, room
            ids = np.concatenate(held)
            out = [place, row, len(ids), zlib.crc32(ids.tobytes()), codec.pack(ids), list(parts)]
            held.clear()
            parts.clear()
            row, room = row + 1, length
            return out

        def batch_of(found: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate(types)], ["place", "row", "n_ids", "ids_crc32", "ids", "parts"])

        id_type, types = None, []
        for batch in batches:
            id_type = batch.schema.field(0).type
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.struct([("doc_id", id_type), ("start", pa.int64()), ("length", pa.int64())]))]
            found = []
            for one, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids, at = encode(text.as_py()), 0
                while at < len(ids):
                    taken = min(room, len(ids) - at)
                    held.append(ids[at : at + taken])
                    parts.append({"doc_id": one, "start": at, "length": taken})
                    at, room = at + taken, room - taken
                    if not room:
                        found.append(full())
            yield batch_of(found)
        if held:
            yield batch_of([full()])

    return in_batches(rows).mapInArrow(run, f"place long, row long, n_ids long, ids_crc32 long, ids binary, parts array<struct<doc_id: {kind}, start: long, length: long>>")


def write_shards(
    docs: DataFrame,
    out_dir: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    shard_size: int = SHARD_SIZE,
    key: str = KEY,
    tokenizer: str | None = None,
    resume: bool = False,
) -> DataFrame:
    """Writes shards under out_dir (in the shared folder, if not given) and returns a row for each
    sequence: slot, shard, byte_offset, n_ids, ids_crc32, parts, path."""
    spark = docs.sparkSession
    at = work_path(spark, "sequences")
    codec = fit_codec(docs, text_col, tokenizer)
    made = sequences(docs, id_col, text_col, length, tokenizer, codec)
    made.write.option("compression", "none").parquet(at)
    made = spark.read.schema(made.schema).parquet(at)
    sizes = {r["place"]: r["n"] for r in made.groupBy("place").agg(F.count(F.lit(1)).alias("n")).collect()}  # one number an input task
    before, total = np.zeros(max(sizes, default=0) + 2, np.int64), sum(sizes.values())
    for place, n in sizes.items():
        before[place + 1] = n
    first = spark.sparkContext.broadcast(np.cumsum(before))

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = first.value[batch.column(0).to_numpy()] + batch.column(1).to_numpy()
            slot = permuted(number, total, key)
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array((slot // shard_size).astype(np.int32)), *batch.columns[2:]], ["slot", "shard", *batch.schema.names[2:]])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in made.schema.fields[2:])
    dealt = made.mapInArrow(slots, f"slot long, shard int, {fields}")
    shards = max(1, -(-total // shard_size))
    dealt = dealt.repartitionById(-(-shards // SHARDS_A_TASK), F.floor(F.col("shard") / SHARDS_A_TASK).cast("int")).sortWithinPartitions("slot")
    sent = spark.sparkContext.broadcast(codec)
    target = (out_dir or work_path(spark, "shards")).rstrip("/")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pyarrow.fs.FileSystem.from_uri(target)
        store.create_dir(root, recursive=True)
        unpack, kind = sent.value.unpack, sent.value.kind
        stride = length * np.dtype(kind).itemsize
        out, had, name, whole = None, None, "", ""

        def close() -> None:
            if had is not None:
                had.close()
            if out is not None:
                out.close()
                store.move(name, whole)

        shard = None
        for batch in batches:
            paths = []
            for slot, of, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(4), strict=True):
                if of != shard:
                    close()
                    shard, whole = of, f"{root}/shard-{of:08d}.bin"
                    due = min(shard_size, total - of * shard_size) * stride
                    name = f"{whole}.{uuid.uuid4().hex}"
                    out, had = None, store.open_input_file(whole) if resume and store.get_file_info(whole).size == due else None
                    if had is None:
                        out = store.open_output_stream(name)
                ids = unpack(data.as_py())
                bytes_of = np.concatenate((ids, np.full(length - len(ids), END, kind))).tobytes()
                if had is not None and had.read(stride) != bytes_of:  # a shard of other texts: what was equal so far is copied
                    out = store.open_output_stream(name)
                    had.seek(0)
                    for _ in range(slot % shard_size):
                        out.write(had.read(stride))
                    had.close()
                    had = None
                if out is not None:
                    out.write(bytes_of)
                paths.append(whole)
            slot = batch.column(0).to_numpy()
            offset = (slot % shard_size) * stride
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(offset), batch.column(2), batch.column(3), batch.column(5), pa.array(paths, pa.string())], ["slot", "shard", "byte_offset", "n_ids", "ids_crc32", "parts", "path"])
        close()

    parts = made.schema["parts"].dataType.simpleString()
    rows = dealt.mapInArrow(write, f"slot long, shard int, byte_offset long, n_ids long, ids_crc32 long, parts {parts}, path string")
    listed = work_path(spark, "shard-index")
    rows.write.parquet(listed)
    return spark.read.schema(rows.schema).parquet(listed)

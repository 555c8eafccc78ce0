"""Target-distribution importance resampling over bucket-partitioned inverted postings.

A document's features are its runs of one to three words, each hashed into one of BUCKETS buckets by
crc32. A bucket's gain tells how much likelier it is in the target corpus than among all documents;
a document weighs the sum of its features' gains, and the draw without replacement takes the largest of
weight plus Gumbel noise, which comes from a hash of the id, so that reruns draw the same.

Documents are gathered into blocks of at most BLOCK_POSTINGS postings (bucket, document, count). A block
is cut by ranges of buckets, and each cut is one squeezed row of about a byte a posting. Cuts are shuffled
by range and, as one range outgrows a task with the corpus, by a part of the blocks; each such group is
co-grouped with what both corpora hold of the range's buckets, computes the gains there and then, and
emits what its buckets contribute to each document of a block. Contributions are then reduced by
document: a block's are added up as vectors. A document meets each range once, however often a feature
repeats, and a frequent feature is a row a block and not a row a document.

The draw ranks in ranges of the score, whose sizes give each its offset, so that no task sorts all.

Defined results: null and empty texts have no feature, weight 0 and take no part in the draw; a null id
counts as the empty text in the hash and comes last among equal scores; repeated rows and ids are
documents like others; an empty target or an empty table of documents is fine (no document: no row);
columns other than the id and the texts are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER_ASCII, Work, in_batches, materialise
from .scoring import spread, squeezed

BUCKETS, LONGEST, SCALE = 10_000, 3, 1000
#: Ranges of buckets, postings of a block, words of a text that are looked at together, and bytes of
#: squeezed postings in a group.
RANGES, BLOCK_POSTINGS, PIECE_WORDS, GROUP_BYTES = 16, 1_500_000, 1 << 18, 16 << 20
#: Lower-cases A-Z and makes a blank of each byte that isn't part of a word.
_WORDS_ONLY = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in LOWER_ASCII)
#: Longest word whose crc is combined by table; features with longer ones are hashed whole.
TABLED = 96


@lru_cache(1)
def shifts() -> np.ndarray:
    """[n, k, b]: what n zero bytes make of a crc whose k-th byte is b and the others are zero. crc32 is
    linear, so that the crc of a text follows from those of its halves (see joined())."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(0xEDB88320), one >> 1).astype(np.uint32)
    now = np.array([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    out = [now]
    for _ in range(TABLED + 1):
        now = (now >> np.uint32(8)) ^ one[now & np.uint32(255)]
        out.append(now)
    return np.stack(out)


def joined(left: np.ndarray, right: np.ndarray, length: np.ndarray) -> np.ndarray:
    """crc32 of texts, from that of their left and right parts and the right part's length in bytes."""
    table, out = shifts(), right.copy()
    for k in range(4):
        out ^= table[length, k, (left >> np.uint32(8 * k)) & np.uint32(255)]
    return out


class Words:
    """Numbers for words, with the crc32 of each, alone and behind a blank. It is kept for a block."""

    def __init__(self) -> None:
        self.of: dict[bytes, int] = {}
        self.names: list[bytes] = []
        self.crcs = np.zeros((0, 2), np.uint32)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        of, names = self.of, self.names
        out = np.empty(len(words), np.int64)
        for k, w in enumerate(words):
            n = of.get(w)
            if n is None:
                n = of[w] = len(names)
                names.append(w)
            out[k] = n
        new = names[len(self.crcs) :]
        if new:
            self.crcs = np.concatenate((self.crcs, np.array([[zlib.crc32(w), zlib.crc32(b" " + w)] for w in new], np.uint32)))
        return out


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORDS_ONLY).split()


def buckets_of(words: list[bytes], known: Words, begin: int = 0) -> list[np.ndarray]:
    """The buckets of the runs of each length that end at words from `begin` on."""
    ids = known.numbers(words)
    alone, behind = known.crcs[ids, 0], known.crcs[ids, 1]
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    long = np.flatnonzero(lengths > TABLED)
    out, now = [alone[begin:]], alone
    for n in range(2, LONGEST + 1):
        now = joined(now[:-1], behind[n - 1 :], np.minimum(lengths[n - 1 :], TABLED))
        for end in sorted({e for p in long.tolist() for e in range(max(p, n - 1), min(p + 1, len(words)))}):
            now[end - n + 1] = zlib.crc32(b" ".join(words[end - n + 1 : end + 1]))
        out.append(now[max(begin - n + 1, 0) :])
    return [x % np.uint32(BUCKETS) for x in out]


def posted(words: list[bytes], known: Words) -> tuple[np.ndarray, np.ndarray, int]:
    """The buckets of a text in order, how often it has each, and its features."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    if len(words) <= PIECE_WORDS:
        found, counts = np.unique(np.concatenate(buckets_of(words, known)), return_counts=True)
    else:
        all_of = np.zeros(BUCKETS, np.int64)
        for at in range(0, len(words), PIECE_WORDS):
            back = min(at, LONGEST - 1)
            for x in buckets_of(words[at - back : at + PIECE_WORDS], known, back):
                all_of += np.bincount(x, minlength=BUCKETS)
        found = np.flatnonzero(all_of)
        counts = all_of[found]
    return found.astype(np.int64), counts.astype(np.int64), int(counts.sum())


#: The first bucket of each range, and the end of the last.
EDGES = [r * BUCKETS // RANGES for r in range(RANGES + 1)]


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """For each block a row with its documents (range -1: ids, n_words, n_features) and a row a range with
    what is squeezed: the postings of each bucket, the document and the count of each posting; and the
    number of features in each bucket of the range."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    names = ["block", "range", "ids", "n_words", "n_features", "per_bucket", "docs", "counts", "sums"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        ids: list[pa.Array] = []
        held: list[tuple[np.ndarray, np.ndarray, int, int]] = []
        known = Words()

        def flush() -> pa.RecordBatch:
            nonlocal block, known
            bucket = np.concatenate([h[0] for h in held])
            doc = np.repeat(np.arange(len(held)), [len(h[0]) for h in held])
            n = np.concatenate([h[1] for h in held])
            order = np.argsort(bucket, kind="stable")  # documents stay in order within a bucket
            bucket, doc, n = bucket[order], doc[order], n[order]
            steps = np.where(np.diff(bucket, prepend=-1) > 0, doc, np.diff(doc, prepend=0))
            cuts = np.searchsorted(bucket, EDGES)
            per = np.bincount(bucket, minlength=BUCKETS)
            total = np.bincount(bucket, n, BUCKETS).astype(np.int64)
            spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), EDGES[:-1], EDGES[1:], strict=True))
            none = [None] * RANGES
            columns = [
                pa.array([block] * (RANGES + 1)),
                pa.array([-1, *range(RANGES)], pa.int32()),
                pa.ListArray.from_arrays(pa.array([0] + [len(held)] * (RANGES + 1), pa.int32()), pa.concat_arrays(ids)),
                pa.array([[h[2] for h in held], *none], pa.list_(pa.int64())),
                pa.array([[h[3] for h in held], *none], pa.list_(pa.int64())),
                pa.array([None, *(squeezed(per[a:b].astype("<u4")) for _, _, a, b in spans)], pa.binary()),
                pa.array([None, *(squeezed(steps[a:b].astype("<u4")) for a, b, _, _ in spans)], pa.binary()),
                pa.array([None, *(squeezed(n[a:b].astype("<u4")) for a, b, _, _ in spans)], pa.binary()),
                pa.array([None, *(total[a:b] for _, _, a, b in spans)], pa.list_(pa.int64())),
            ]
            block += 1
            ids.clear()
            held.clear()
            known = Words()
            return pa.RecordBatch.from_arrays(columns, names)

        size = 0
        for batch in batches:
            for k, text in enumerate(batch.column(1)):
                words = words_of(text.as_py())
                found, counts, features = posted(words, known)
                ids.append(batch.column(0).slice(k, 1))
                held.append((found, counts, len(words), features))
                size += len(found) + 1
                if size > BLOCK_POSTINGS:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return in_batches(rows).mapInArrow(run, f"block long, range int, ids array<{kind}>, n_words array<long>, n_features array<long>, per_bucket binary, docs binary, counts binary, sums array<long>")


def bucket_sums(blocks: DataFrame) -> DataFrame:
    """range, at and n: how often a corpus has each bucket of each range. Blocks have added theirs up."""
    each = blocks.filter("range >= 0").select("range", F.posexplode("sums").alias("at", "n"))
    return each.groupBy("range", "at").agg(F.sum("n").alias("n"))


def both_corpora(source: DataFrame, target: DataFrame, work: Work) -> DataFrame:
    """range, s and t (arrays by bucket), S and T: what the corpora hold; RANGES rows in all."""
    s, t = bucket_sums(source).withColumnRenamed("n", "s"), bucket_sums(target).withColumnRenamed("n", "t")
    rows = work.table(s.join(t, ["range", "at"], "full").select("range", "at", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t")), "bucket-sums")
    whole = rows.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("s"), F.coalesce(F.sum("t"), F.lit(0)).alias("t")).first()
    lists = rows.groupBy("range").agg(F.array_sort(F.collect_list(F.struct("at", "s", "t"))).alias("x"))
    return lists.select("range", F.col("x.s").alias("s"), F.col("x.t").alias("t"), F.lit(whole["s"]).alias("all_s"), F.lit(whole["t"]).alias("all_t"))


def gains(s: np.ndarray, t: np.ndarray, all_s: int, all_t: int) -> np.ndarray:
    ratio = ((t + 1.0) * (all_s + float(BUCKETS))) / ((s + 1.0) * (all_t + float(BUCKETS)))
    return np.floor(SCALE * np.log(ratio)).astype(np.int64)


def contributions(cuts: DataFrame, sums: DataFrame, groups: int) -> DataFrame:
    """block and, for each cut, the documents of its postings and what their buckets add to each."""
    salt = F.pmod(F.xxhash64("block"), F.lit(groups)).alias("part")
    left = cuts.select("range", salt, "block", "per_bucket", "docs", "counts")
    right = sums.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))

    def add(cuts: pa.Table, corpora: pa.Table) -> pa.Table:
        of = corpora.to_pylist()
        blocks, out = [], []
        if of:
            s, t = np.array(of[0]["s"], np.int64), np.array(of[0]["t"], np.int64)
            gain = gains(s, t, of[0]["all_s"], of[0]["all_t"])
            for row in range(cuts.num_rows):
                per = spread(cuts.column("per_bucket")[row].as_py(), "<u4").astype(np.int64)
                steps = spread(cuts.column("docs")[row].as_py(), "<u4").astype(np.int64)
                n = spread(cuts.column("counts")[row].as_py(), "<u4").astype(np.int64)
                if not len(n):
                    continue
                # a bucket's first document is given whole, the others by their step
                begins = np.cumsum(per) - per
                begins = begins[per > 0]
                run = np.cumsum(steps)
                run -= np.repeat(run[begins] - steps[begins], per[per > 0])
                total = np.bincount(run, n * np.repeat(gain, per)).astype(np.int64)  # sums of whole numbers, exact in doubles
                blocks.append(cuts.column("block")[row].as_py())
                out.append(squeezed(total.view("<u8")))
        return pa.table({"block": pa.array(blocks, pa.int64()), "sums": pa.array(out, pa.binary())})

    met = left.groupBy("range", "part").cogroup(right.groupBy("range", "part"))
    return met.applyInArrow(add, "block long, sums binary")


def weighed(blocks: DataFrame, sums: DataFrame, groups: int, id_col: str) -> DataFrame:
    """id, n_words, n_features and weight, one row for each document of the blocks."""
    kind = blocks.schema["ids"].dataType.elementType.simpleString()
    heads = blocks.filter("range = -1").select("block", "ids", "n_words", "n_features")
    added = contributions(blocks.filter("range >= 0"), sums, groups)

    def reduce(heads: pa.Table, added: pa.Table) -> pa.Table:
        ids = heads.column("ids").combine_chunks().values
        total = np.zeros(len(ids), np.int64)
        for part in added.column("sums"):
            x = spread(part.as_py(), "<u8").view(np.int64)
            total[: len(x)] += x
        return pa.table([ids, heads.column("n_words").combine_chunks().values, heads.column("n_features").combine_chunks().values, pa.array(total)], ["id", "n_words", "n_features", "weight"])

    return heads.groupBy("block").cogroup(added.groupBy("block")).applyInArrow(reduce, f"id {kind}, n_words long, n_features long, weight long")


def noise(id_: Column, seed: int) -> Column:
    """Gumbel noise from a hash of the id, in thousandths, as a whole number."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-SCALE * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(scored: DataFrame, drawn: int, work: Work) -> DataFrame:
    """scored (id, takes_part, score and more) with rank: 1, 2, 3... for the `drawn` largest scores of those
    that take part."""
    order = [F.col("takes_part").desc(), F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("_at")]
    placed = scored.withColumn("_at", F.monotonically_increasing_id())
    dealt = work.table(placed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()), "ranges")
    part = F.shiftright("_place", 33)
    sizes = dealt.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n"))  # a row a range
    before = [(r["_part"], r["n"]) for r in sizes.collect()]
    offsets, at = [], 0
    for p, n in sorted(before):
        offsets.append((p, at))
        at += n
    starts = F.broadcast(scored.sparkSession.createDataFrame(offsets or [(0, 0)], "_part long, _offset long"))
    place = F.col("_offset") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    out = dealt.withColumn("_part", part).join(starts, "_part").withColumn("rank", F.when(F.col("takes_part") & (place <= drawn), place))
    return out.drop("_part", "_offset", "_place", "_at")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 5, seed: int = 42, least_words: int = 20, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text"
) -> DataFrame:
    """id, n_features, weight, score and rank for every row of docs; rank is null for those that aren't
    drawn. The target's weights are those of `gains`, as thousandths of a natural logarithm."""
    with Work(docs.sparkSession) as work:
        blocks = work.table(postings(docs, id_col, text_col), "postings")
        aims = work.table(postings(target.withColumn("_none", F.lit(0)), "_none", target_text_col), "target-postings")
        sums = both_corpora(blocks, aims, work)
        size = blocks.agg(F.coalesce(F.sum(F.length("docs") + F.length("counts")), F.lit(0))).first()[0]
        found = weighed(blocks, sums, 1 + size // (RANGES * GROUP_BYTES), id_col)
        scored = work.table(found.select("*", (F.col("n_words") >= least_words).alias("takes_part"), (F.col("weight") + noise(F.col("id"), seed)).alias("score")), "scored")
        n = scored.filter("takes_part").count()
        out = materialise(ranked(scored, percent * n // 100, work), "resampled")
    return out.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")

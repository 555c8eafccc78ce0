"""Near-duplicate documents by SimHash fingerprints and meet-in-the-middle ball hashing.

Fingerprints link if they differ in at most RADIUS bits. Two fingerprints that do are both within
half the radius of one in the middle, so if each emits every variant within half the radius, linked
ones meet at a variant, and any two that meet are linked, since both are within half the radius of
it. Over 64 bits that is 2,081 variants a fingerprint. So the balls are first laid over two thirds
of the bits: of the three thirds, the one that differs most holds at least two of four differing
bits, and the other two at most two. Each fingerprint emits, for each third left out, the 44 or so
variants of the rest within one bit: 132 rows. Few fingerprints meet anybody there. Where two meet
at a variant the pair is verified. Where more meet, all are first compared with one of them. What is
then in one group needs no more links; where few are outside a crowd's largest group, these are
compared with all others there, and where many are, all of that crowd emit their full balls of 2,081
variants, in which meeting is proof and each variant is linked to one of those that meet there; no
pairs are made within a group. Equal fingerprints are one node throughout. All components are found.

Defined results: null, empty or blank text has no word and fingerprint zero, and links like any
other; repeated rows and null ids are documents like others, and a component's id is its smallest
id that isn't null (null if it has none); an empty table gives no rows; columns other than the id and the text are
ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER_ASCII, Work, few, in_batches, materialise
from .graph import components
from .hashing import Stretches, gram_hashes, parts, runs_of

RADIUS, SHINGLE, SEED = 4, 4, 42
#: For the groups of keep_one(): the similarity of shingles from which texts are near duplicates.
CHECK_SHINGLE, SIMILARITY = 5, 0.8
#: A shingle is common if it is in COMMON texts or more for every so many characters of all texts; and beyond
#: how many pairs for each shingle of a text those that meet are first compared with one of them. They
#: decide on cost only.
COMMON_CHARS, COMMON, PAIRS = 30_000_000, 3, 16
#: Shingles are first counted in so many buckets, which are summed up in parts.
BUCKETS, BUCKETS_PART = 1 << 22, 1 << 16
#: See signature() and shares().
LIGHT, SKETCH, SHARED = 0.7, 16, 2
#: Texts in a block, of which two meet at a time to be compared.
BLOCK_TEXTS = 64
#: What goes with a text where it meets others.
FACTS = ("h", "n", "own", "place", "root")
#: From more than so many fingerprints outside a crowd's largest group on, the crowd's full balls are laid.
OUTSIDE = 16
IS_SPACE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
#: The bits of the three thirds.
THIRDS = tuple(range(0, 21)), tuple(range(21, 42)), tuple(range(42, 64))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Bit k is set if it is in over half the hashes of the text's word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER_ASCII).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(len(words) - shingle + 1, 1)
    starts = np.concatenate(([0], ends[: n - 1] + 1)).tolist()
    hashed = xxhash.xxh64_intdigest
    hashes = np.array([hashed(joined[a:b], SEED) for a, b in zip(starts, ends[len(words) - n :].tolist(), strict=True)], ">u8")
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 14):
        part = hashes[k : k + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp) with the fingerprint's bits as a signed long."""
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], [id_col, "fp"])

    return in_batches(rows).mapInArrow(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, fp long")


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def ball(bits: tuple[int, ...], radius: int) -> list[int]:
    """The masks of at most `radius` of these bits."""
    return [signed(sum(1 << b for b in some)) for r in range(radius + 1) for some in combinations(bits, r)]


def longs(values: list[int]) -> Column:
    return F.array(*(F.lit(v).cast("long") for v in values))


def around(column: str, masks: list[int]) -> Column:
    """One row for each value that a mask makes of the column's."""
    return F.explode(F.transform(longs(masks), lambda m: m.bitwiseXOR(F.col(column))))


#: For each third left out: its bits, and the masks of the ball over the others.
OUT = [signed(sum(1 << b for b in third)) for third in THIRDS]
BALLS = [ball(tuple(b for t in THIRDS if t is not third for b in t), RADIUS // 4) for third in THIRDS]


def met_at_variants(fps: DataFrame) -> DataFrame:
    """(variant, n, a, b): the variants at which several fingerprints meet, how many, and two of them.

    A variant has ones for the third left out. What is shuffled is the fingerprint with its mask's
    bits flipped and the number of the mask; the variant and the fingerprint follow from these."""
    masks = [m for each in BALLS for m in each]
    left_out = [out for out, each in zip(OUT, BALLS, strict=True) for _ in each]
    emitted = fps.select("fp", F.posexplode(longs(masks)).alias("k", "_mask")).select(F.col("fp").bitwiseXOR(F.col("_mask")).alias("w"), F.col("k").cast("short").alias("k"))
    at = lambda values: F.element_at(longs(values), F.col("k") + 1)
    variant = F.col("w").bitwiseOR(at(left_out))
    dealt = emitted.repartition(variant).select(variant.alias("variant"), F.col("w").bitwiseXOR(at(masks)).alias("fp"))
    return dealt.groupBy("variant").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).filter("n > 1")


def apart(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def links(fps: DataFrame, work: Work) -> DataFrame:
    """Distinct fingerprints (fp) to links (a, b) that join up all of their components."""
    met = work.table(met_at_variants(fps), "variants")
    pairs = met.filter("n = 2").select("a", "b")
    # who met in a crowd: the balls around the crowded variants lead back to the fingerprints
    # (dealt out anew before each explosion, since crowds lie in a few of the written files)
    crowds = met.filter("n > 2").select("variant", F.col("a").alias("center")).repartition("variant")
    whose = [F.when(F.col("variant").bitwiseAND(F.lit(out)) == F.lit(out), longs(each)).otherwise(longs([])) for out, each in zip(OUT, BALLS, strict=True)]
    back = crowds.select("variant", "center", F.explode(F.transform(F.concat(*whose), lambda m: m.bitwiseXOR(F.col("variant")))).alias("rest"))
    rests = fps.select("fp", F.explode(F.array(*(F.col("fp").bitwiseOR(F.lit(out)) for out in OUT))).alias("rest"))
    members = work.table(rests.join(back, "rest").select("variant", "fp", "center").distinct(), "members")
    stars = members.select(F.col("fp").alias("a"), F.col("center").alias("b")).filter("a <> b")
    sure = work.table(pairs.union(stars).filter(apart("a", "b") <= RADIUS).distinct(), "sure_pairs")
    return sure.union(links_across(members, components(sure, work=work), work))


def links_across(members: DataFrame, roots: DataFrame, work: Work) -> DataFrame:
    """Links (a, b) between fingerprints (fp) that meet at a variant (members) and aren't in one
    group by their roots: pairs where few are outside a crowd's largest group, else by full balls."""
    groups = roots.withColumnRenamed("node", "fp")
    rows = work.table(members.select("variant", "fp").join(groups, "fp", "left").select("variant", "fp", F.coalesce("root", "fp").alias("root")), "crowds")
    sizes = rows.groupBy("variant", "root").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.groupBy("variant").agg(F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("large"))
    split = work.table(sizes.select("variant", F.col("large.root").alias("large"), (F.col("n") - F.col("large.n")).alias("outside")).filter("outside > 0"), "split")
    # every pair of a crowd's groups has one outside the largest, so these are OUTSIDE rows a member at most
    outside = rows.join(split.filter(F.col("outside") <= OUTSIDE), "variant").filter("root <> large")
    outside = outside.select("variant", F.col("fp").alias("a"), F.col("root").alias("root_a"))
    others = rows.select("variant", F.col("fp").alias("b"), F.col("root").alias("root_b"))
    near = outside.join(others, "variant").filter((F.col("root_a") != F.col("root_b")) & (apart("a", "b") <= RADIUS)).select("a", "b")
    dense = work.table(rows.join(split.filter(F.col("outside") > OUTSIDE), "variant", "left_semi").select("fp").distinct(), "dense")
    full = dense.repartition("fp").select("fp", around("fp", ball(tuple(range(64)), RADIUS // 2)).alias("variant"))
    # at most 2,081 fingerprints can meet at a variant of 64 bits, so the lists are bounded
    stars = full.groupBy("variant").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
    stars = stars.select(F.explode("fps").alias("a"), F.array_min("fps").alias("b")).filter("a <> b")
    return near.union(stars).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id) for every row of docs."""
    rows = materialise(fingerprints(docs, id_col, text_col), "fingerprints")
    with Work(docs.sparkSession) as work:
        nodes = work.table(rows.select("fp").distinct(), "nodes")
        roots = components(links(nodes, work), work=work).withColumnRenamed("node", "fp")
        roots = nodes.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))
        # least ids by fingerprint first, then by component, so that many copies are one row
        least = rows.groupBy("fp").agg(F.min(id_col).alias("_least")).join(roots, "fp")
        by_root = least.groupBy("root").agg(F.min("_least").alias("component_id"))
        found = materialise(roots.join(by_root, "root").select("fp", "component_id"), "components")
    return rows.join(found, "fp").select(id_col, "fp", "component_id")


def sets_of(texts: list[str | None], shingle: int) -> list[np.ndarray]:
    """The distinct hashes of each text's word shingles, in order; a shorter text is one shingle."""
    out: list[np.ndarray] = []
    for lo, hi in parts(texts):
        raw = [(t or "").encode("utf-8", "surrogatepass").translate(LOWER_ASCII) for t in texts[lo:hi]]
        data = Stretches(b"\n".join(raw))
        starts, ends = runs_of(~IS_SPACE[data.raw])
        hashes = data.hashes(starts, ends)
        edges = np.searchsorted(starts, np.cumsum([0, *(len(r) + 1 for r in raw)]))
        for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            out.append(np.unique(gram_hashes(hashes[i:j], max(1, min(shingle, j - i)))) if j > i else np.zeros(1, np.int64))
    return out


def text_key(text_col: str) -> Column:
    return F.xxhash64(F.col(text_col).cast("string"))


def bucket_of(shingles: np.ndarray) -> np.ndarray:
    return (shingles.view(np.uint64) % np.uint64(BUCKETS)).astype(np.int64)


def full_buckets(texts: DataFrame, least: int) -> np.ndarray:
    """For each bucket, whether the texts have `least` shingles or more in it. A task sends its counts in
    parts, squeezed, and the sums of a part are added up as they come."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int32)
        for batch in batches:
            kinds, n = np.unique(bucket_of(np.concatenate(sets_of(batch.column(0).to_pylist(), CHECK_SHINGLE))), return_counts=True)
            counts[kinds] += n.astype(np.int32)
        for k in range(0, BUCKETS, BUCKETS_PART):
            if (part := counts[k : k + BUCKETS_PART]).any():
                yield pa.RecordBatch.from_arrays([pa.array([k // BUCKETS_PART], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], ["part", "counts"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                total = sums.setdefault(part, np.zeros(BUCKETS_PART, np.int64))
                total += np.frombuffer(zlib.decompress(counts.as_py()), np.int32)
        bits = [np.packbits(total >= least).tobytes() for total in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array([*sums], pa.int32()), pa.array(bits, pa.binary())], ["part", "bits"])

    parts_of = in_batches(texts).mapInArrow(count, "part int, counts binary").repartition("part")
    full = np.zeros(BUCKETS, bool)
    for row in parts_of.mapInArrow(add_up, "part int, bits binary").collect():
        full[row.part * BUCKETS_PART : (row.part + 1) * BUCKETS_PART] = np.unpackbits(np.frombuffer(row.bits, np.uint8)).astype(bool)
    return full


def common_shingles(docs: DataFrame, id_col: str, text_col: str, work: Work) -> np.ndarray:
    """The shingles, in order, that occur in COMMON texts or more for every COMMON_CHARS characters, counted
    over all texts; of equal ones those of the least id count. Their share bounds what reaches the driver.

    Shingles are counted by bucket first, so that only those of buckets that are full enough, which hold
    all common ones, are counted by themselves and shuffled."""
    rows = docs.select(F.col(id_col).alias("id"), text_key(text_col).alias("h"), F.col(text_col).cast("string").alias("text"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    least = max(COMMON, math.ceil(COMMON * chars / COMMON_CHARS))
    again = rows.groupBy(F.col("h").alias("_h")).agg(F.count(F.lit(1)).alias("_n"), F.min("id").alias("_id")).filter("_n > 1").select("_h", "_id")
    texts = rows.join(work.table(again, "again"), F.col("h") == F.col("_h"), "left").filter(F.col("_h").isNull() | F.col("id").eqNullSafe(F.col("_id"))).select("text")
    full = docs.sparkSession.sparkContext.broadcast(np.packbits(full_buckets(texts, least)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.unpackbits(full.value).astype(bool)
        for batch in batches:
            found = np.concatenate(sets_of(batch.column(0).to_pylist(), CHECK_SHINGLE))
            kinds, n = np.unique(found[held[bucket_of(found)]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int64()), pa.array(n.astype(np.int64))], ["shingle", "n"])

    counts = in_batches(texts).mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    found = counts.filter(F.col("n") >= least).select("shingle").toArrow()
    return np.sort(found.column(0).to_numpy())


def signature(found: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Shingles of a text's set by which it meets every text of SIMILARITY or more, their places among
    the set's, rarest first, and how many of the set aren't common, as a negative number if that is a
    small part.

    Let two such texts have the sets A and B of shingles that aren't common. If these are alike to
    LIGHT or more, they have shares() or more of the SKETCH least hashes of A and of B in both. If they
    are less alike, A and B still differ by at most a fifth of the texts' union, so each is a small part
    of its text; then the rarest shingles of the whole text, as many as can differ and one more, are
    sure to hold one of the other's."""
    n = len(found)
    at = np.searchsorted(common, found)
    rare = np.ones(n, bool) if not len(common) else common[np.minimum(at, len(common) - 1)] != found
    own = found[rare]  # in order of their hashes
    if len(own) > (1 - SIMILARITY) / (1 - LIGHT) / SIMILARITY * n:
        return own[:SKETCH], np.arange(min(SKETCH, len(own))), len(own)
    order = np.lexsort((found, ~rare))
    most = max(n - math.ceil(SIMILARITY * n - 1e-6) + 1, min(SKETCH, len(own)))
    return found[order[:most]], np.arange(most), -len(own)


def shares(a: Column, b: Column) -> Column:
    """How many shingles of their signatures two texts of SIMILARITY or more have in both, given the
    numbers that go with the signatures: LIGHT of both sets, where the sketches are all of them; else
    SHARED. Each of the SKETCH least hashes of both together is in both with the chance of their
    similarity, so fewer are shared with a chance of 4e-10 at 0.8, and of 2e-7 at LIGHT, where all that
    the texts differ in is rare and a third of the rest common."""
    both = F.least(F.lit(SHARED), F.ceil(LIGHT * F.greatest(F.abs(a), F.abs(b)) - 1e-6))
    return F.when((a < 0) & (b < 0), 1).otherwise(F.greatest(both, F.lit(1)))


def measured(docs: DataFrame, common: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """(id, h, h2, fp, n, own, firsts, places), one row for each row of docs: two hashes of its text, the
    fingerprint, the number of distinct shingles, and the signature (null where the task has had the
    text) with its number."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), F.xxhash64(F.lit(1), text).alias("h2"), text.alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, tuple[int, int, int]] = {}
        for batch in batches:
            keys, firsts, places = batch.column(1).to_pylist(), [None] * batch.num_rows, [None] * batch.num_rows
            new = [k for k, h in enumerate(keys) if h not in seen and not seen.update({h: (0, 0, 0)})]
            texts = batch.column(3).take(pa.array(new, pa.int64())).to_pylist()
            for k, text, found in zip(new, texts, sets_of(texts, CHECK_SHINGLE), strict=True):
                firsts[k], places[k], own = signature(found, sent.value)
                seen[keys[k]] = fingerprint(text), len(found), own
            fps = np.array([seen[h][0] for h in keys], np.uint64).view(np.int64)
            n, own = ([seen[h][c] for h in keys] for c in (1, 2))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(fps), pa.array(n, pa.int32()), pa.array(own, pa.int32()), pa.array(firsts, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32()))], ["id", "h", "h2", "fp", "n", "own", "firsts", "places"])

    kind = rows.schema["id"].dataType.simpleString()
    return in_batches(rows).mapInArrow(run, f"id {kind}, h long, h2 long, fp long, n int, own int, firsts array<long>, places array<int>")


def can_be_alike(e: str, f: str) -> Column:
    """Whether two texts that meet at a shingle may be similar by its places. What comes before the
    first shingle that they share, in the order of all, is in one of them only; of texts that meet by
    their rarest shingles, similar ones pass at that one."""
    n, place = (lambda x: F.col(f"n_{x}")), (lambda x: F.col(f"place_{x}"))
    left = F.least(n(e) - place(e), n(f) - place(f))
    light = (F.col(f"own_{e}") >= 0) | (F.col(f"own_{f}") >= 0)
    return light | (left >= SIMILARITY / (1 + SIMILARITY) * (n(e) + n(f)) - 1e-6)


def text_links(rows: DataFrame, work: Work) -> DataFrame:
    """(a, b): links between texts (h) of equal or linked fingerprints. The texts of a fingerprint
    are linked to one of them, and linked fingerprints by those ones."""
    own = rows.select("h", "fp").distinct()
    least = work.table(own.groupBy("fp").agg(F.min("h").alias("center")), "centers")
    same = own.join(least, "fp").select(F.col("h").alias("a"), F.col("center").alias("b")).filter("a <> b")
    ends = [least.select(F.col("fp").alias(e), F.col("center").alias(f"c{e}")) for e in ("a", "b")]
    linked = links(least.select("fp"), work).join(ends[0], "a").join(ends[1], "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    return same.union(linked).filter("a <> b").distinct()


def meeting(firsts: DataFrame) -> DataFrame:
    """The rows of firsts whose shingle is in texts of several groups."""
    shared = firsts.groupBy("shingle").agg(F.min("root").alias("_a"), F.max("root").alias("_b")).filter("_a <> _b").select("shingle")
    return firsts.join(shared, "shingle", "left_semi")


def met_in_blocks(pairs: DataFrame, work: Work) -> DataFrame:
    """pairs (a, b, shingle) with the blocks in which their texts meet: the texts of a shingle's pairs
    are dealt at random into blocks of about BLOCK_TEXTS, and `left` and `right` are those of a pair."""
    pairs = work.table(pairs, "candidates")
    ends = pairs.select("shingle", F.col("a").alias("h")).union(pairs.select("shingle", F.col("b").alias("h"))).distinct()
    sizes = ends.groupBy("shingle").agg(F.ceil(F.count(F.lit(1)) / BLOCK_TEXTS).cast("int").alias("blocks"))
    of = lambda h: F.pmod(F.xxhash64(F.lit(2), h), F.col("blocks")).cast("int")
    rows = pairs.join(sizes, "shingle").select("shingle", F.least(of("a"), of("b")).alias("left"), F.greatest(of("a"), of("b")).alias("right"), "a", "b")
    return work.table(rows, "pairs", instead_of=pairs)


def verified(pairs: DataFrame, docs: DataFrame, rows: DataFrame, id_col: str, text_col: str, work: Work) -> DataFrame:
    """The pairs (a, b) of those given, as (a, b, shingle), of texts whose shingles have a Jaccard
    similarity of SIMILARITY or more. A text is sent once to each two blocks in which it has pairs."""
    met = met_in_blocks(pairs, work)
    place = ["shingle", "left", "right"]
    ends = met.select(*place, F.col("a").alias("h")).union(met.select(*place, F.col("b").alias("h"))).distinct()
    ends = few(work.table(ends.join(rows.groupBy("h").agg(F.min("id").alias("id")), "h"), "ends"))
    texts = docs.select(F.col(id_col).alias("_id"), text_key(text_col).alias("_h"), F.col(text_col).cast("string").alias("text"))
    texts = texts.join(ends, (F.col("_h") == ends["h"]) & F.col("_id").eqNullSafe(ends["id"]))
    none = F.lit(None)
    sent = texts.select(*place, F.col("h").alias("a"), none.cast("long").alias("b"), "text").union(met.select(*place, "a", "b", none.cast("string")))
    sent = sent.repartition(*place).sortWithinPartitions(*place, F.col("b").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        at = None
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
            a, b = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            is_text = [k for k, other in enumerate(b) if other is None]
            sets = iter(sets_of(batch.column(5).take(pa.array(is_text, pa.int64())).to_pylist(), CHECK_SHINGLE))
            found = []
            for key, one, other in zip(keys, a, b, strict=True):
                if key != at:
                    held, at = {}, key
                if other is None:
                    held[one] = next(sets)
                else:
                    x, y = held[one], held[other]
                    both = len(x) + len(y) - len(np.union1d(x, y))
                    if both >= SIMILARITY * (len(x) + len(y) - both):
                        found.append((one, other))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(2)], ["a", "b"])

    return in_batches(sent).mapInArrow(run, "a long, b long")


def alike_in_size(a: Column, b: Column) -> Column:
    return F.least(a, b) >= SIMILARITY * F.greatest(a, b) - 1e-6


def grouped(rows: DataFrame, links: DataFrame, work: Work) -> DataFrame:
    """rows (with h and others) with the groups that the links make as `root`; a text that has no link is a group
    by itself. A text's few rows and its root meet in a window."""
    roots = components(links, work=work).withColumnRenamed("node", "h")
    rows = rows.drop("root")
    told = roots.select("h", *(F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields if f.name != "h"), F.col("root").alias("_told"))
    both = rows.withColumn("_told", F.lit(None).cast("long")).unionByName(told)
    both = both.withColumn("root", F.coalesce(F.max("_told").over(Window.partitionBy("h")), "h"))
    return both.filter("_told IS NULL").drop("_told")


def crowds(met: DataFrame, work: Work) -> DataFrame:
    """For each shingle: the pairs of its texts that aren't in one group, and its largest group."""
    groups = met.groupBy("shingle", "root").agg(F.count(F.lit(1)).cast("double").alias("n"))
    pairs = (F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))) / 2
    return work.table(groups.groupBy("shingle").agg(F.sum("n").alias("rows"), pairs.alias("pairs"), F.max(F.struct("n", "root")).getField("root").alias("large")), "crowds")


def similar_links(docs: DataFrame, rows: DataFrame, sure: DataFrame, id_col: str, text_col: str, work: Work) -> DataFrame:
    """(a, b): links that, with those that are sure, join up all pairs of texts of SIMILARITY or more.

    Texts meet at the shingles of their signatures. While these make many pairs, and at least half of
    them go by it, the texts at a shingle are compared with one of them, so that a large group of copies
    is one group at a row a text and shingle. Then every pair that meets often enough and isn't in one group is compared."""
    size = (F.shiftleft(F.col("n").cast("long"), 32) + F.col("own") + F.lit(1 << 31)).alias("size")  # both in one number, for the shuffle
    own = F.col("size").bitwiseAND(F.lit((1 << 32) - 1)) - F.lit(1 << 31)
    each = F.explode(F.arrays_zip("firsts", "places")).alias("e")
    texts = work.table(grouped(rows.filter("firsts IS NOT NULL").select("h", size, "firsts", "places"), sure, work), "grouped")
    firsts = texts.select("h", "size", "root", F.when(own >= 0, F.col("firsts")).alias("sketch"), each)
    firsts = firsts.select("h", "size", "root", "sketch", F.col("e.firsts").alias("shingle"), F.when(own < 0, F.col("e.places")).otherwise(0).alias("place"))
    met = meeting(firsts.repartition("shingle")).dropDuplicates(["shingle", "h"])
    met = work.table(met.select("shingle", "h", "place", F.shiftright("size", 32).cast("int").alias("n"), own.cast("int").alias("own"), "root", "sketch"), "met")
    links, turn, before = sure, 0, math.inf
    while True:
        shingles = crowds(met, work)
        n = shingles.agg(F.sum("rows").alias("rows"), F.sum("pairs").alias("pairs")).first()
        if not n["rows"] or n["pairs"] <= PAIRS * n["rows"] or n["pairs"] > before / 2:
            break
        center = F.min(F.struct(F.xxhash64("h", F.lit(turn)), F.col("h"), "root", "n", "own", "place")).alias("c")
        centers = met.groupBy("shingle").agg(center).select("shingle", *(F.col(f"c.{c}").alias(f"{c}_b") for c in FACTS))
        stars = met.select("shingle", *(F.col(c).alias(f"{c}_a") for c in FACTS)).join(centers, "shingle")
        stars = stars.filter((F.col("root_a") != F.col("root_b")) & alike_in_size(F.col("n_a"), F.col("n_b")) & can_be_alike("a", "b"))
        pairs = stars.groupBy(F.col("h_a").alias("a"), F.col("h_b").alias("b")).agg(F.min("shingle").alias("shingle"))
        links = work.table(links.union(verified(pairs, docs, rows, id_col, text_col, work)), "links", instead_of=links)
        met = work.table(grouped(met, links, work), "met", instead_of=met)
        turn, before = turn + 1, n["pairs"]
    # the texts of a shingle's largest group don't meet each other here, but all others
    sides = [met.select("shingle", *(F.col(c).alias(f"{c}_{e}") for c in (*FACTS, "sketch"))) for e in ("a", "b")]
    outside = sides[0].join(shingles.select("shingle", "large"), "shingle").filter(F.col("root_a") != F.col("large"))
    once = (F.col("root_b") == F.col("large")) | (F.col("h_a") < F.col("h_b"))
    alike = (F.col("root_a") != F.col("root_b")) & alike_in_size(F.col("n_a"), F.col("n_b")) & can_be_alike("a", "b")
    # two sketches tell how much they share, and the pair is made at the least shingle of it
    both_have = F.array_intersect("sketch_a", "sketch_b")
    sketched = F.col("sketch_a").isNotNull() & F.col("sketch_b").isNotNull()
    least = F.coalesce((F.size(both_have) >= shares(F.col("own_a"), F.col("own_b"))) & (F.array_min(both_have) == F.col("shingle")), F.lit(False))
    both = outside.join(sides[1], "shingle").filter(once & alike & (~sketched | least))
    turned = lambda c, e, f: F.when(F.col("h_a") < F.col("h_b"), F.col(f"{c}_{e}")).otherwise(F.col(f"{c}_{f}")).alias(f"{c}_{e}")
    both = both.select("shingle", sketched.alias("told"), *(turned(c, *ends) for c in ("h", "own") for ends in ("ab", "ba")))
    often = both.groupBy(F.col("h_a").alias("a"), F.col("h_b").alias("b"), "told", "own_a", "own_b").agg(F.count(F.lit(1)).alias("times"), F.min("shingle").alias("shingle"))
    pairs = often.filter(F.col("told") | (F.col("times") >= shares(F.col("own_a"), F.col("own_b")))).select("a", "b", "shingle")
    return work.table(links.union(verified(pairs, docs, rows, id_col, text_col, work)), "links", instead_of=links)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs of each group, with its columns: that of the smallest id. Rows that repeat
    an id with another text are documents of their own; rows without an id come last.

    Groups are those of near_duplicates(), joined by all pairs of texts whose five-word shingles have
    a Jaccard similarity of SIMILARITY or more, which similar_links() finds. Texts are told apart by two
    64-bit hashes: of different texts that collide in the first, one takes part in groups, and the
    others stay as documents of their own."""
    with Work(docs.sparkSession) as work:
        rows = work.table(measured(docs, common_shingles(docs, id_col, text_col, work), id_col, text_col), "texts")
        sure = work.table(text_links(rows, work), "sure")
        roots = components(similar_links(docs, rows, sure, id_col, text_col, work), work=work).withColumnRenamed("node", "h")
        first = F.min(F.struct(F.col("id").isNull().alias("none"), "id")).alias("first")
        texts = rows.groupBy("h", "h2").agg(first).groupBy("h").agg(F.array_sort(F.collect_list(F.struct("h2", "first"))).alias("all"))
        texts = texts.join(roots, "h", "left").select(F.coalesce("root", "h").alias("root"), "h", F.posexplode("all").alias("k", "own"))
        least = F.min(F.struct("own.first", "h", "own.h2")).alias("stay")
        stay = texts.groupBy("root", F.when(F.col("k") > 0, F.col("own.h2"))).agg(least)
        stay = materialise(stay.select(F.col("stay.first.id").alias("id"), F.col("stay.h").alias("h"), F.col("stay.h2").alias("h2")), "stay")
    text = F.col(text_col).cast("string")
    kept = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), F.xxhash64(F.lit(1), text).alias("h2"))
    kept = kept.join(stay, (kept["h"] == stay["h"]) & (kept["h2"] == stay["h2"]) & kept["id"].eqNullSafe(stay["id"]), "left_semi")
    same = Window.partitionBy("h", "h2", "id").orderBy("h")
    return kept.withColumn("n", F.row_number().over(same)).filter("n = 1").select("row.*")


def fingerprint_text(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))

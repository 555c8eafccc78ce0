"""Language-model scores of texts by a weighted backoff automaton.

States are the histories that training texts hold: the empty one, the start of a text, and up to ORDER - 1
words. A state h has an arc for each word w seen after it, with the smoothed probability
(c(hw) + PRIOR * p(w | shorter h)) / (c(h) + PRIOR), and a failure arc with the weight
PRIOR / (c(h) + PRIOR) to the state of its shorter history; the root has an arc for every word, the smoothed
unigrams (c + 0.1) / (N + 0.1 (V + 1)). All n-grams that training texts hold are arcs, at any size of the
corpus, and the model sums to one. A text is read once from left to right: the state is carried from word
to word, along failure arcs until there is an arc, and log-probabilities add up.

No task holds the whole automaton, which grows with the corpus. Texts are cut into chunks of about CHUNK
tokens, written as places in the chunk's own list of words. Each chunk asks for the counts of its distinct
words and n-grams, and says how often its training texts hold each: sorted keys, dealt by ranges into
buckets, squeezed, a row for each bucket that has keys of the chunk, so that there are never more rows
than keys. A bucket adds up what all chunks say and replies to each with the sums in the order of its
keys, about a byte a key. Replies go to the buckets of files in which the chunks are; a chunk's texts and replies meet in one task, which makes the part of the
automaton that these texts can reach and reads them by it. A frequent word is a row a chunk there and not a row a token.

Defined results: null and empty texts consist of the end token; without training documents every
probability is one; where `teaches` is null a text doesn't teach; repeated rows and null ids are
documents like others; an empty table gives no rows; columns other than the id and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER_ASCII, bucketed, in_batches, materialise
from .hashing import BASE, Stretches, mixed, parts, runs_of

ORDER, PRIOR, ADDED = 3, 50.0, 0.1
#: Tokens of a chunk (a longer text is one by itself), and characters of the input for each bucket.
CHUNK, BUCKET_CHARS = 2_200_000, 12_000_000
IS_SPACE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
END, START = 0x5EED0E4D, np.uint64(0x57A27)


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Key and text of every token; each text ends with END."""
    raw = [(t or "").encode("utf-8", "surrogatepass").translate(LOWER_ASCII) for t in texts]
    data = Stretches(b"\n".join(raw))
    starts, ends = runs_of(~IS_SPACE[data.raw])
    begins = np.cumsum([0, *(len(p) + 1 for p in raw[:-1])])
    of = np.searchsorted(begins, starts, side="right") - 1
    keys = np.full(len(starts) + len(raw), END, np.uint64)
    keys[np.arange(len(starts)) + of] = data.hashes(starts, ends)
    return keys, np.repeat(np.arange(len(raw)), np.bincount(of, minlength=len(raw)) + 1)


def squeezed(values: np.ndarray) -> bytes:
    """Bytes of unsigned numbers, plane by plane, compressed."""
    width = values.dtype.itemsize
    return zstandard.ZstdCompressor(level=1).compress(values.view(np.uint8).reshape(-1, width).T.tobytes())


def spread(data: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind)[:, 0] if planes.size else np.zeros(0, kind)


def of_sorted(keys: np.ndarray) -> bytes:
    return squeezed(np.diff(keys, prepend=np.uint64(0)))


def sorted_of(data: bytes) -> np.ndarray:
    return np.cumsum(spread(data, "<u8"), dtype=np.uint64)


def small(counts: np.ndarray) -> bytes:
    return squeezed(counts.astype("<u4" if counts.max(initial=0) < 1 << 32 else "<u8")) + bytes([4 if counts.max(initial=0) < 1 << 32 else 8])


def counts_of(data: bytes) -> np.ndarray:
    return spread(data[:-1], f"<u{data[-1]}").astype(np.int64)


def gram_keys(words: np.ndarray, first: np.ndarray, order: int) -> list[np.ndarray]:
    """For each order from 1 the key of the n-gram that ends at each token; zero where the text
    isn't so long. The start of a text counts as a word before it, from order 2 on."""
    before = np.where(first, START, np.concatenate((words[:1], words[:-1])))
    out = [words, mixed(before * BASE + words)] if order > 1 else [words]
    seen = first
    for _ in range(3, order + 1):
        last = out[-1]
        grams = mixed(np.concatenate((last[:1], last[:-1])) * BASE + words)
        out.append(np.where(seen, np.uint64(0), grams))
        seen = seen | np.concatenate(([True], seen[:-1]))
    return out


def chunks(docs: DataFrame, teaches: Column, id_col: str, text_col: str) -> DataFrame:
    """A row for each chunk: its distinct words, the most frequent first, the place of each token in
    them, and ids, teaches and numbers of tokens of its texts."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(teaches, F.lit(False)).alias("teaches"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    names = ["chunk", "words", "places", "ids", "teaches", "lengths"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        held: list[tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal chunk, size
            kinds, place, n = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True, return_counts=True)
            order = np.argsort(-n, kind="stable")
            rank = np.empty(len(order), "<u4")
            rank[order] = np.arange(len(order))
            lengths = np.concatenate([h[1] for h in held])
            ids, learns = (pa.concat_arrays([h[c] for h in held]) for c in (2, 3))
            ends = pa.array([0, len(ids)], pa.int32())
            columns = [pa.array([chunk]), pa.array([squeezed(kinds[order])], pa.binary()), pa.array([squeezed(rank[place])], pa.binary())]
            columns += [pa.ListArray.from_arrays(ends, x) for x in (ids, learns, pa.array(lengths.astype(np.int64)))]
            held.clear()
            chunk, size = chunk + 1, 0
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            texts = batch.column(2).to_pylist()
            for lo, hi in parts(texts):
                words, of = tokens(texts[lo:hi])
                held.append((words, np.bincount(of, minlength=hi - lo), batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo)))
                size += len(words)
                if size > CHUNK:
                    yield flush()
        if held:
            yield flush()

    return in_batches(rows).mapInArrow(run, f"chunk long, words binary, places binary, ids array<{kind}>, teaches array<boolean>, lengths array<long>")


class Chunk:
    """A chunk's texts: the words of all in a row, which of them are a text's first, and the texts' facts."""

    def __init__(self, words: bytes, places: bytes, teaches: np.ndarray, lengths: np.ndarray) -> None:
        self.words = spread(words, "<u8")[spread(places, "<u4")]
        self.teaches, self.lengths = teaches, lengths
        self.starts = np.cumsum(lengths) - lengths
        self.first = np.zeros(len(self.words), bool)
        self.first[self.starts] = True

    @staticmethod
    def of(columns: dict[str, pa.ListScalar]) -> Chunk:
        values = lambda c: columns[c].values.to_numpy(zero_copy_only=False)
        return Chunk(columns["words"].as_py(), columns["places"].as_py(), values("teaches"), values("lengths"))


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The range of keys in which each lies; it grows with the key."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def asked(texts: DataFrame, lowest: int, order: int, buckets: int) -> DataFrame:
    """(chunk, bucket, keys, counts): for each n-gram order from `lowest` on the chunk's distinct keys in the
    bucket, and how often its training texts hold each."""
    names = ["chunk", "bucket", "keys", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                own = Chunk.of({n: batch.column(n)[row] for n in ("words", "places", "teaches", "lengths")})
                weights = np.repeat(own.teaches, own.lengths)
                found: dict[int, list[tuple[bytes, bytes]]] = {}
                for k, keys in enumerate(gram_keys(own.words, own.first, order)[lowest - 1 :]):
                    kinds, place = np.unique(keys, return_inverse=True)
                    n = np.bincount(place, weights, len(kinds)).astype(np.int64)
                    at = bucket_of(kinds, buckets)
                    cuts = [*np.flatnonzero(np.diff(at, prepend=np.uint64(1 << 63))).tolist(), len(kinds)]
                    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                        lists = found.setdefault(int(at[a]), [])
                        lists += [NO_KEYS] * (k - len(lists)) + [(of_sorted(kinds[a:b]), small(n[a:b]))]
                for lists in found.values():
                    lists += [NO_KEYS] * (order - lowest + 1 - len(lists))
                n = len(found)
                yield pa.RecordBatch.from_arrays([pa.array([batch.column("chunk")[row].as_py()] * n, pa.int64()), pa.array(list(found), pa.int64()), *(pa.array([[x[c] for x in lists] for lists in found.values()], pa.list_(pa.binary())) for c in range(2))], names)

    few = in_batches(texts.select("chunk", "words", "places", "teaches", "lengths"))
    return few.mapInArrow(run, "chunk long, bucket long, keys array<binary>, counts array<binary>")


NO_KEYS = of_sorted(np.zeros(0, np.uint64)), small(np.zeros(0, np.int64))


def replies(asked: DataFrame, lowest: int) -> DataFrame:
    """(chunk, bucket, lowest, sums, kinds): for each order the sums of all chunks in the order of the chunk's
    keys; and with one of its chunks, how many keys of the lowest order the bucket has from training texts."""

    def add(table: pa.Table) -> pa.Table:
        sums: list[list[bytes]] = [[] for _ in range(table.num_rows)]
        seen = 0
        for k in range(len(table.column("keys")[0].as_py())):
            keys = [sorted_of(x[k].as_py()) for x in table.column("keys")]
            n = np.concatenate([counts_of(x[k].as_py()) for x in table.column("counts")])
            _, place = np.unique(np.concatenate(keys), return_inverse=True)
            all_of = np.bincount(place, n).astype(np.int64)
            if not k:
                seen = int((all_of > 0).sum())
            cuts = np.cumsum([0, *map(len, keys)])
            for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
                sums[i].append(small(all_of[place[a:b]]))
        rest = [0] * (table.num_rows - 1)
        return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "lowest": pa.array([lowest] * table.num_rows, pa.int32()), "sums": pa.array(sums, pa.list_(pa.binary())), "kinds": pa.array([seen, *rest], pa.int64())})

    return asked.groupBy("bucket").applyInArrow(add, "chunk long, bucket long, lowest int, sums array<binary>, kinds long")


class Automaton:
    """The part of the automaton that a chunk's texts can reach. By the length of the history and the place
    of a token: whether the state there has an arc for the token, the arc's weight, and that of its
    failure arc. Weights are logarithms to base 10."""

    def __init__(self, counts: list[np.ndarray], first: np.ndarray, total: int, kinds: int, texts: int, prior: float) -> None:
        p = (counts[0] + ADDED) / (total + ADDED * (kinds + 1))
        self.known = counts[0] > 0
        self.has, self.weight, self.failure = [np.ones(len(p), bool)], [np.log10(p)], [np.zeros(len(p))]
        for k in range(1, len(counts)):
            history = np.concatenate(([0], counts[k - 1][:-1]))
            history = np.where(first, texts if k == 1 else 0, history)  # the start of a text has no longer history
            p = np.where(history > 0, (counts[k] + prior * p) / (history + prior), p)
            self.has.append(counts[k] > 0)
            self.weight.append(np.log10(p))
            self.failure.append(np.log10(prior / (history + prior)))

    def read(self, start: int, end: int) -> float:
        """The log-probability of a text: one pass that carries the state, which is known by its length."""
        rows = [[x[start:end].tolist() for x in kind] for kind in (self.has, self.weight, self.failure)]
        has, weight, failure = rows
        longest = len(has) - 1
        known = self.known[start:end].tolist()
        state, total = min(1, longest), 0.0
        for i in range(end - start):
            while not has[state][i]:
                total += failure[state][i]
                state -= 1
            total += weight[state][i]
            state = min(state + 1, longest) if known[i] else 0
        return total


def lm_scores(docs: DataFrame, teaches: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, prior: float = PRIOR) -> DataFrame:
    """(id, teaches, n_tokens, n_known, train_tokens, base_score, score) for every row of docs,
    learned from those of them that `teaches` allows."""
    chars = docs.agg(F.sum(F.length(F.col(text_col).cast("string")))).first()[0] or 0
    buckets = 1 + chars // BUCKET_CHARS
    kind = docs.schema[id_col].dataType.simpleString()
    texts = bucketed(chunks(docs, teaches, id_col, text_col), "chunk", chars // (4 * CHUNK), "chunks")
    words = materialise(replies(asked(texts, 1, 1, buckets), 1), "word-counts")
    kinds = words.agg(F.coalesce(F.sum("kinds"), F.lit(0))).first()[0]
    learns = F.arrays_zip("teaches", "lengths")
    taught = texts.select(F.aggregate(learns, F.lit(0).cast("long"), lambda n, x: n + x["teaches"].cast("long")).alias("texts"), F.aggregate(learns, F.lit(0).cast("long"), lambda n, x: n + F.when(x["teaches"], x["lengths"]).otherwise(0)).alias("tokens"))
    known = taught.agg(F.coalesce(F.sum("texts"), F.lit(0)).alias("texts"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")).first()
    learned, total = known["texts"], known["tokens"]
    replied = words.select("chunk", "bucket", "lowest", "sums")
    if order > 1:
        replied = replied.union(replies(asked(texts, 2, order, buckets), 2).select("chunk", "bucket", "lowest", "sums"))
    names = [id_col, "teaches", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def read(texts: pa.Table, replied: pa.Table) -> pa.Table:
        own = Chunk.of({n: texts.column(n)[0] for n in ("words", "places", "teaches", "lengths")})
        lowest, bucket = replied.column("lowest").to_numpy(), replied.column("bucket").to_numpy()
        counts = []
        for k, keys in enumerate(gram_keys(own.words, own.first, order)):
            rows = np.flatnonzero(lowest == min(k + 1, 2))
            rows = rows[np.argsort(bucket[rows])].tolist()
            sums = np.concatenate([counts_of(replied.column("sums")[r][max(k - 1, 0)].as_py()) for r in rows])
            found = sums[np.unique(keys, return_inverse=True)[1]]
            counts.append(found if k < 2 else np.where(keys == 0, 0, found))
        base = score = np.zeros(len(own.lengths))
        if total:
            model = Automaton(counts, own.first, total, kinds, learned, prior)
            base = np.add.reduceat(model.weight[0], own.starts)
            ends = own.starts + own.lengths
            score = np.array([model.read(a, b) for a, b in zip(own.starts.tolist(), ends.tolist(), strict=True)])
        n_known = np.add.reduceat((counts[0] > 0).astype(np.int64), own.starts)
        columns = [texts.column("ids").combine_chunks().values, texts.column("teaches").combine_chunks().values, pa.array(own.lengths), pa.array(n_known), pa.array(np.full(len(own.lengths), total)), pa.array(base), pa.array(score)]
        return pa.table(columns, names)

    both = texts.groupBy("chunk").cogroup(replied.groupBy("chunk"))
    return both.applyInArrow(read, f"`{id_col}` {kind}, teaches boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")

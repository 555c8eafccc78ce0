"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A text is parsed against it from
left to right into the longest phrases that occur in the labelled text: the automaton is followed
while it can be, and where it can't a phrase ends and the next one begins. A text in the language
needs few, long phrases. Phrases are normalised to bits a character (phrases times the bits that
point at a place in the labelled text); the language with the fewest bits wins.

Letters are lower-cased, everything else counts as one blank, and runs of blanks are one. A text is
cut into pieces of PIECE characters whose phrases are summed, so that all pieces of many texts are
parsed side by side, a character a step; every language is charged alike for the cuts.

Defined results: null text, and text without a letter, is `und` with score 0; so is every text if
there is no labelled text. Ties go to the language first in order. Repeated rows get equal results.
Labels that are null, and labelled texts that are null or have no letter, teach nothing. Columns of
the input other than the id, the text and the label are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, in_batches

#: Labelled text for a language: so many different texts, of each so many characters (the bound of
#: the sample; an automaton has at most two states a character).
SAMPLE_TEXTS, SAMPLE_CHARS = 60, 600
#: As many texts again, over this, tell how many bits a character texts of the languages need; a text
#: is foreign beyond FOREIGN times the most of these, not counting FREE phrases (short texts).
CALIBRATE, FOREIGN, FREE = 3, 2.5, 8
#: Symbols that have a code of their own; rarer ones share the last one.
SYMBOLS = 250
#: Symbols of a piece, and how many earlier it begins to be read.
PIECE, WARM = 2048, 256
#: Characters that are parsed side by side.
BATCH_CHARS = 4_000_000
UNDETERMINED = "und"
BLANK = 32


@lru_cache(1)
def letter_table() -> np.ndarray:
    """For every code point its lower case if it is a letter, else a blank."""
    return np.array([ord(c.lower()[0]) if c.isalpha() else BLANK for c in map(chr, range(0x110000))], np.uint32)


def folded(text: str) -> np.ndarray:
    """Code points: letters in lower case, everything else as single blanks; empty if there is no letter."""
    points = letter_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    letters = points != BLANK
    if not letters.any():
        return points[:0]
    return points[letters | np.concatenate(([False], letters[:-1]))]


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """The transitions of each state; state 0 is the start. Every substring of text, and nothing
    else, can be followed from the start."""
    arcs: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        arcs.append({})
        link.append(0)
        length.append(length[last] + 1)
        new, p = len(arcs) - 1, last
        while p >= 0 and c not in arcs[p]:
            arcs[p][c] = new
            p = link[p]
        if p >= 0:
            q = arcs[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                arcs.append(dict(arcs[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                copy = len(arcs) - 1
                while p >= 0 and arcs[p].get(c) == q:
                    arcs[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return arcs


@dataclass
class Model:
    """steps[state * width + code] is the next state times width, plus 1 << bit if a phrase ends there."""

    langs: list[str]
    starts: np.ndarray
    bits: np.ndarray
    steps: np.ndarray
    width: int
    codes: np.ndarray
    bit: int
    bound: float = math.inf


def build_model(texts: dict[str, list[np.ndarray]]) -> Model | None:
    """A model of labelled texts, already folded."""
    blank = np.array([BLANK], np.uint32)
    joined = {lang: np.concatenate([x for t in some for x in (t, blank)]) for lang, some in sorted(texts.items()) if some}
    if not joined:
        return None
    points, n = np.unique(np.concatenate(list(joined.values())), return_counts=True)
    common = points[np.lexsort((points, -n))][:SYMBOLS]
    other, width = len(common), len(common) + 1
    codes = np.full(0x110000, other, np.uint8)
    codes[common] = np.arange(len(common))
    bit, kind = (30, np.int32) if 2 * width * sum(map(len, joined.values())) < 1 << 30 else (62, np.int64)
    tables, starts, at = [], [], 0
    for text in joined.values():
        arcs = suffix_automaton(codes[text].tolist())
        unknown = len(arcs)  # the state after a symbol that the text lacks: a phrase by itself
        steps = np.full((len(arcs) + 1, width), -1, np.int64)
        for state, out in enumerate(arcs):
            steps[state, list(out)] = list(out.values())
        first = np.where(steps[0] >= 0, steps[0], unknown)
        starts_phrase = (first + at) * width + (1 << bit)  # a phrase ends, and the next begins with this symbol
        steps = np.where(steps >= 0, (steps + at) * width, starts_phrase[None, :])
        steps[0] = (first + at) * width
        tables.append(steps.astype(kind))
        starts.append(at * width)
        at += len(arcs) + 1
    return Model(list(joined), np.array(starts, kind), np.log2([len(t) + 1 for t in joined.values()]), np.concatenate(tables).ravel(), width, codes, bit)


def count_phrases(model: Model, texts: list[np.ndarray], piece: int = PIECE) -> np.ndarray:
    """Phrases of each coded text in each language.

    Long texts are read in pieces, side by side. A piece begins WARM symbols early, from the start of the
    automaton, and counts from its own first symbol on. By then it nearly always is in the state that the piece
    before it ends in, and so all that follows is as if the text had been read in one go; texts in which some
    piece isn't are read again, in one go."""
    out = np.zeros((len(texts), len(model.langs)), np.int64)
    lanes = [(k, i, max(i - WARM, 0)) for k, t in enumerate(texts) for i in range(0, len(t), piece)]
    if not lanes:
        return out
    lengths = np.array([min(i + piece, len(texts[k])) - lo for k, i, lo in lanes])
    order = np.argsort(-lengths, kind="stable")
    lengths = lengths[order]
    symbols = np.zeros((lengths[0], len(lanes)), np.int32)
    for lane, j in enumerate(order):
        k, _, lo = lanes[j]
        symbols[: lengths[lane], lane] = texts[k][lo : lo + lengths[lane]]
    early = np.array([lanes[j][1] > 0 for j in order])
    live = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")  # lanes longer than t
    langs, ends = len(model.langs), (1 << model.bit) - 1
    state = np.repeat(model.starts[:, None], len(lanes), axis=1)
    edge = state.copy()
    ended = np.repeat((~early).astype(np.int64)[None, :], langs, axis=0)
    for t in range(lengths[0]):
        n = live[t]
        found = model.steps.take(state[:, :n] + symbols[t, :n])
        ended[:, :n] += (found >> model.bit) if t >= WARM else (found >> model.bit) * ~early[:n]
        state[:, :n] = found & ends
        if t == WARM - 1:
            edge = state.copy()
    np.add.at(out, np.array([lanes[j][0] for j in order]), ended.T)
    place = np.empty(len(lanes), np.int64)
    place[order] = np.arange(len(lanes))
    again = sorted({lanes[j][0] for j in range(1, len(lanes)) if lanes[j][1] and (edge[:, place[j]] != state[:, place[j - 1]]).any()})
    if again:
        out[again] = count_phrases(model, [texts[k] for k in again], max(len(texts[k]) for k in again))
    return out


def judge(model: Model | None, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language and score of each text, and the bits a character that it needs beyond FREE phrases
    (without limit, if it has no letter)."""
    langs, scores, needs = [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.full(len(texts), math.inf)
    if model is None:
        return langs, scores, needs
    todo, size = [], 0
    for k, text in enumerate([*texts, None]):
        if k == len(texts) or size > BATCH_CHARS:
            if todo:
                counts = count_phrases(model, [c for _, c in todo])
                lengths = np.array([[len(c)] for _, c in todo])
                bits = counts * model.bits / lengths
                best = bits.argmin(axis=1)
                share = 2.0 ** -(bits - bits.min(axis=1, keepdims=True))
                beyond = ((counts - FREE) * model.bits / lengths).min(axis=1)
                for row, (i, _) in enumerate(todo):
                    langs[i], scores[i], needs[i] = model.langs[best[row]], share[row, best[row]] / share[row].sum(), beyond[row]
            todo, size = [], 0
        plain = folded(text or "")
        if len(plain):
            todo.append((k, model.codes[plain]))
            size += len(plain)
    return langs, scores, needs


def labelled_sample(docs: DataFrame, text_col: str, lang_col: str, texts: int, chars: int) -> dict[str, list[str]]:
    """Labelled text by language: about `texts` different texts of each, chosen by their hash, and
    of each the `chars` characters from a place that the hash picks. What reaches the driver is
    bounded by that for each language."""
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    known = known.select(F.col(lang_col).cast("string").alias("lang"), F.xxhash64(text_col).alias("h"), F.col(text_col).cast("string").alias("text"))
    n = known.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()
    if not n:
        return {}
    part = F.create_map(*(x for r in n for x in (F.lit(r["lang"]), F.lit(min(1.0, 1.5 * texts / max(r["n"], 1))))))
    place = (F.pmod("h", F.greatest(F.length("text") - chars, F.lit(0)) + 1) + 1).cast("int")
    chosen = known.filter(F.pmod("h", F.lit(1 << 40)) < F.element_at(part, F.col("lang")) * float(1 << 40))
    rows = chosen.groupBy("lang", "h").agg(F.min(F.substring("text", place, F.lit(chars))).alias("text")).collect()
    out: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["h"])):
        if len(out.setdefault(r["lang"], [])) < texts and len(folded(r["text"])):
            out[r["lang"]].append(r["text"])
    return out


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", texts: int = SAMPLE_TEXTS, chars: int = SAMPLE_CHARS) -> Model | None:
    sample = labelled_sample(docs, text_col, lang_col, texts + texts // CALIBRATE, chars)
    model = build_model({lang: [folded(t) for t in some[:texts]] for lang, some in sample.items()})
    if model is not None:
        needs = judge(model, [t for some in sample.values() for t in some[texts:]])[2]
        model.bound = FOREIGN * max(needs, default=math.inf) if (needs > 0).any() else math.inf
    return model


def with_language(docs: DataFrame, model: Model | None, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score", foreign_out: str = "foreign") -> DataFrame:
    """The rows of docs with a language, a score and whether they are foreign to all languages."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores, needs = judge(sent.value, batch.column(at).to_pylist())
            foreign = needs > (math.inf if sent.value is None else sent.value.bound)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores), pa.array(foreign)], [*batch.schema.names, lang_out, score_out, foreign_out])

    added = [T.StructField(lang_out, T.StringType()), T.StructField(score_out, T.DoubleType()), T.StructField(foreign_out, T.BooleanType())]
    return in_batches(docs).mapInArrow(run, T.StructType([*docs.schema.fields, *added]))


def identify(docs: DataFrame, teaches: Column, text_col: str = "text", lang_col: str = "lang", **bounds) -> DataFrame:
    """The rows of docs with lang_pred and score, learned from those of them that `teaches` allows."""
    return with_language(docs, fit(docs.filter(teaches), text_col, lang_col, **bounds), text_col)


def keep_known(docs: DataFrame, teaches: Column, text_col: str = "text", lang_col: str = "lang", **bounds) -> DataFrame:
    """The rows of docs, with their columns, that are in a language of the labelled ones: those have a
    letter and don't need far more bits a character than labelled texts; all where no label teaches any."""
    model = fit(docs.filter(teaches), text_col, lang_col, **bounds)
    if model is None:
        return docs
    lang, score, foreign = fresh(docs, "_lang", "_score", "_foreign")
    told = with_language(docs, model, text_col, lang, score, foreign)
    return told.filter((F.col(lang) != UNDETERMINED) & ~F.col(foreign)).select(*docs.columns)

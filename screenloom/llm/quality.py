"""Quality rules judged with the reputation of the host a document comes from.

Every document is measured once. Rule failures are summed by host; each host's failure rate is
shrunk towards the rate of all hosts by a beta prior that is fitted to the spread of the hosts
(method of moments). A host whose shrunk rate of any rule passes `bad_host_rate` is a bad one, and
its documents have to meet the tight bounds instead of the usual ones.

Defined results: null or empty text has no words and fails `few_words`; a null host is a host of
its own; repeated rows are measured and kept or dropped alike; an empty table gives no rows; columns
of the input other than the id, the host and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACES, few, fresh, in_batches, materialise

WINDOW = 5
SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
RULES = ("few_words", "repeated_words", "symbols", "dup_lines")


@dataclass(frozen=True)
class Bounds:
    """A document fails a rule beyond these; all are per cent but min_words, the first two of words
    and the last of lines."""

    min_words: int = 10
    repeat_percent: int = 20
    symbol_percent: int = 30
    dup_line_percent: int = 50


USUAL = Bounds()
TIGHT = Bounds(min_words=20, repeat_percent=10, symbol_percent=10, dup_line_percent=30)


def count_repeated(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of so many words which the text holds twice or more."""
    n = len(words)
    if n <= window:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    base, codes = len(seen), ids[: n - window + 1]
    for k in range(1, window):
        if int(codes.max() + 1) * base >= 2**62:  # renumber, so that codes stay exact
            codes = np.unique(codes, return_inverse=True)[1]
        codes = codes * base + ids[k : n - window + 1 + k]
    order = np.sort(codes)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    starts = np.flatnonzero(np.isin(codes, twice))
    edges = np.zeros(n + 1, np.int64)
    edges[starts] += 1
    edges[starts + window] -= 1
    return int((np.cumsum(edges[:n]) > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The counts named in COUNTS, of a whole text."""
    if not text:
        return (0,) * len(COUNTS)
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    spaces = len(data) - len(data.translate(None, SPACES))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [x for x in data.split(b"\n") if x.strip()]
    return len(words), len(text) - spaces, symbols, len(lines) - len(set(lines)), count_repeated(words), len(lines)


def measured(docs: DataFrame, id_col: str, host_col: str, text_col: str) -> DataFrame:
    """doc_id, host and COUNTS, one row for each row of docs."""
    kept = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), F.col(text_col).cast("string").alias("text"))
    schema = f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, host {kept.schema['host'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in COUNTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.array([measure(t.as_py()) for t in batch.column(2)], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(counts[:, k]) for k in range(len(COUNTS)))], ["doc_id", "host", *COUNTS])

    return in_batches(kept).mapInArrow(run, schema)


def failures(bounds: Bounds, prefix: str = "") -> dict[str, Column]:
    c = {n: F.col(prefix + n) for n in COUNTS}
    return {
        "few_words": c["n_words"] < bounds.min_words,
        "repeated_words": 100 * c["n_repeat_words"] > bounds.repeat_percent * c["n_words"],
        "symbols": 100 * c["n_symbols"] > bounds.symbol_percent * c["n_words"],
        "dup_lines": 100 * c["n_dup_lines"] > bounds.dup_line_percent * c["n_lines"],
    }


def any_of(columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out | c
    return out


def host_rates(rows: DataFrame, bounds: Bounds = USUAL) -> DataFrame:
    """host, n, and for each rule its failures f_<rule> and shrunk rate r_<rule>.

    The prior of a rule has the mean of all documents, and the strength that explains how far the
    hosts' rates spread beyond chance. One row for each host; only sums reach the driver.
    """
    fails = failures(bounds)
    hosts = materialise(rows.groupBy("host").agg(F.count(F.lit(1)).alias("n"), *(F.sum(fails[r].cast("long")).alias(f"f_{r}") for r in RULES)), "hosts")
    sums = [F.sum("n").alias("n"), F.count(F.lit(1)).alias("h")]
    sums += [F.sum(f"f_{r}").alias(f"f_{r}") for r in RULES]
    sums += [F.sum(F.col(f"f_{r}") * F.col(f"f_{r}") / F.col("n")).alias(f"q_{r}") for r in RULES]
    total = hosts.agg(*sums).first()
    for r in RULES:
        prior, strength = 0.0, 2.0
        if total["n"]:
            prior = total[f"f_{r}"] / total["n"]
            chance = prior * (1 - prior)
            spread = total[f"q_{r}"] / total["n"] - prior * prior - chance * total["h"] / total["n"]
            strength = min(max(chance / spread - 1, 2.0), 1e6) if spread > 0 else 1e6
        hosts = hosts.withColumn(f"r_{r}", (F.col(f"f_{r}") + prior * strength) / (F.col("n") + strength))
    return hosts


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    host_col: str = "source",
    text_col: str = "text",
    bad_host_rate: float = 0.5,
    usual: Bounds = USUAL,
    tight: Bounds = TIGHT,
) -> DataFrame:
    """doc_id, host, the counts, base_failed, bad_host and kept for every row of docs."""
    rows = materialise(measured(docs, id_col, host_col, text_col), "quality")
    bad = bad_hosts(rows, bad_host_rate, usual)
    of = failures(usual)
    joined = rows.join(bad, F.col("host").eqNullSafe(F.col("_of_host")), "left").drop("_of_host")
    joined = joined.withColumn("bad_host", F.coalesce("_bad_host", F.lit(False))).drop("_bad_host")
    rejected = any_of(list(of.values())) | (F.col("bad_host") & any_of(list(failures(tight).values())))
    return joined.withColumn("base_failed", of["few_words"] | of["repeated_words"]).withColumn("kept", ~rejected)


def bad_hosts(rows: DataFrame, bad_host_rate: float, bounds: Bounds = USUAL) -> DataFrame:
    """The hosts that any rule's shrunk rate condemns; sent to every task only if they are few."""
    bad = host_rates(rows, bounds).filter(any_of([F.col(f"r_{r}") > bad_host_rate for r in RULES])).select(F.col("host").alias("_of_host"), F.lit(True).alias("_bad_host"))
    return few(materialise(bad, "bad-hosts"))


def keep_good(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text", bad_host_rate: float = 0.5) -> DataFrame:
    """The rows of docs that the rules keep, with their columns. Texts are measured once and written
    with their counts; bad hosts are then joined to them, so that texts aren't shuffled."""
    at = docs.columns.index(text_col)
    (name,) = fresh(docs, "_counts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.array([measure(t.as_py()) for t in batch.column(at)], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.StructArray.from_arrays([pa.array(counts[:, k]) for k in range(len(COUNTS))], list(COUNTS))], [*batch.schema.names, name])

    text = docs.schema[text_col].dataType
    rows = docs if text == T.StringType() else docs.withColumn(text_col, F.col(text_col).cast("string"))
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))])
    marked = materialise(in_batches(rows).mapInArrow(run, schema), "measured")
    bad = bad_hosts(marked.select(F.col(host_col).alias("host"), f"{name}.*"), bad_host_rate)
    usual, tight = (any_of(list(failures(b, "counts.").values())) for b in (USUAL, TIGHT))
    kept = marked.select(F.struct(*docs.columns).alias("row"), F.col(host_col).alias("host"), F.col(name).alias("counts")).filter(~usual)
    joined = kept.join(bad, F.col("host").eqNullSafe(F.col("_of_host")), "left")
    return joined.filter(~(tight & F.coalesce("_bad_host", F.lit(False)))).select("row.*")

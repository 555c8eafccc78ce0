"""URL filters: host and path rules, and a character language-model ratio where no rule fits.

URLs on which a rule decides teach two character models, one of accepted and one of rejected URLs.
A model is a variable-order Markov model: up to ORDER characters of context, as far back as it was
seen, smoothed by Witten-Bell interpolation down to the uniform distribution over bytes. A URL's
score is the difference of its log-likelihoods in the two models, over its length. The threshold is
calibrated on labelled URLs that taught neither model: where the two classes' scores, taken as
normal distributions, are as many standard deviations off.

The models are fitted to a bounded sample of labelled rows (SAMPLE_URLS of each class, by hash; of a
longer one SAMPLE_CHARS characters from a place that the hash picks); all URLs are scored whole. Defined results: null URLs and
those without `://` have empty host and path and no rule, and are scored as empty; if a class has
no labelled URL every URL without a rule is allowed; repeated rows get equal results; an empty table
gives no rows; columns other than the id and the URL are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER_ASCII
from .hashing import Stretches, mixed

ORDER, SAMPLE_URLS, SAMPLE_CHARS = 5, 10_000, 512
ALLOW, BLOCK = "allow", "block"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: str) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: str) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...], what: str = "name") -> Column:
    """The name (or verdict) of the longest rule that fits a host and path; null if none does."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(getattr(r, what))).otherwise(out)
    return out


def prepared(urls: list[str | None]) -> tuple[Stretches, np.ndarray, np.ndarray]:
    """All URLs as one byte string, each with ORDER blanks before it and an end after it; the places
    of their characters, and whose they are."""
    texts = [(u or "").partition("://")[2].encode("utf-8", "surrogatepass").translate(LOWER_ASCII) + b"\x03" for u in urls]
    data = b"".join(b"\x02" * ORDER + t for t in texts)
    lengths = np.array([len(t) for t in texts], np.int64)
    of = np.repeat(np.arange(len(texts)), lengths)
    return Stretches(data), np.arange(lengths.sum()) + (of + 1) * ORDER, of


def grams(data: Stretches, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k characters before each place, and of those with the place's character."""
    salt = np.uint64(k + 1)
    return mixed(data.hashes(at - k, at) + salt).view(np.int64), mixed(data.hashes(at - k, at + 1) + salt).view(np.int64)


class Table:
    """Numbers by 64-bit key; zero for other keys."""

    def __init__(self, keys: np.ndarray, *values: np.ndarray) -> None:
        order = np.argsort(keys)
        self.keys = keys[order]
        self.values = [v[order] for v in values]

    def get(self, keys: np.ndarray) -> list[np.ndarray]:
        if not len(self.keys):
            return [np.zeros(len(keys)) for _ in self.values]
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        hit = self.keys[at] == keys
        return [np.where(hit, v[at], 0) for v in self.values]


@dataclass
class Markov:
    grams: Table
    contexts: Table

    def log_likelihoods(self, data: Stretches, at: np.ndarray) -> np.ndarray:
        p = np.full(len(at), 1 / 256)
        for k in range(ORDER + 1):
            context, gram = grams(data, at, k)
            n, kinds = self.contexts.get(context)
            (c,) = self.grams.get(gram)
            p = np.where(n > 0, (c + kinds * p) / np.maximum(n + kinds, 1), p)
        return np.log(p)


@dataclass
class Ratio:
    accepted: Markov
    rejected: Markov
    threshold: float = 0.0

    def scores(self, urls: list[str | None]) -> np.ndarray:
        data, at, of = prepared(urls)
        each = self.accepted.log_likelihoods(data, at) - self.rejected.log_likelihoods(data, at)
        return np.bincount(of, each, len(urls)) / np.bincount(of, minlength=len(urls))


def counted(urls: DataFrame) -> DataFrame:
    """(label, context, gram, n) from (label, url)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = np.array(batch.column(0).to_pylist())
            texts = batch.column(1).to_pylist()
            for label in (ALLOW, BLOCK):
                data, at, _ = prepared([t for t, x in zip(texts, labels, strict=True) if x == label])
                for k in range(ORDER + 1):
                    pairs = np.stack(grams(data, at, k), axis=1)
                    kinds, n = np.unique(pairs, axis=0, return_counts=True) if len(at) else (pairs, np.zeros(0, np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array([label] * len(n), pa.string()), pa.array(kinds[:, 0]), pa.array(kinds[:, 1]), pa.array(n.astype(np.int64))], ["label", "context", "gram", "n"])

    found = urls.mapInArrow(run, "label string, context long, gram long, n long")
    return found.groupBy("label", "context", "gram").agg(F.sum("n").alias("n"))


def with_scores(rows: DataFrame, model: Ratio, url_col: str, out: str) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(model)
    at = rows.columns.index(url_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sent.value.scores(batch.column(at).to_pylist()))], [*batch.schema.names, out])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(out, T.DoubleType())]))


def fit(labelled: DataFrame, sample: int = SAMPLE_URLS, chars: int = SAMPLE_CHARS) -> Ratio | None:
    """A model from (label, url); None if either class is empty. One in four URLs calibrates."""
    rows = labelled.withColumn("_h", F.pmod(F.xxhash64("url"), F.lit(1 << 40)))
    n = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.approx_count_distinct("url").alias("n")).collect()}
    if not (n.get(ALLOW) and n.get(BLOCK)):
        return None
    part = F.when(F.col("label") == ALLOW, sample / n[ALLOW]).otherwise(sample / n[BLOCK])
    rows = rows.filter(F.col("_h") < part * float(1 << 40)).dropDuplicates(["label", "url"])
    place = F.pmod("_h", F.greatest(F.length("url") - chars, F.lit(0)) + 1).cast("int") + 1
    rows = rows.withColumn("url", F.when(F.length("url") <= chars, F.col("url")).otherwise(F.concat(F.lit("://"), F.substring("url", place, F.lit(chars)))))
    tests = F.pmod(F.xxhash64("url", F.lit(1)), F.lit(4)) == 0
    found = counted(rows.filter(~tests).select("label", "url")).toPandas()
    models = {}
    for label in (ALLOW, BLOCK):
        own = found[found["label"] == label]
        by = own.groupby("context")["n"].agg(["sum", "size"])
        models[label] = Markov(Table(own["gram"].to_numpy(), own["n"].to_numpy(float)), Table(by.index.to_numpy(np.int64), by["sum"].to_numpy(float), by["size"].to_numpy(float)))
    model = Ratio(models[ALLOW], models[BLOCK])
    told = with_scores(rows.filter(tests).select("label", "url"), model, "url", "s").groupBy("label").agg(F.avg("s").alias("m"), F.stddev_pop("s").alias("d")).collect()
    by = {r["label"]: (r["m"], r["d"] + 1e-9) for r in told}
    if len(by) == 2:
        (a, da), (b, db) = by[ALLOW], by[BLOCK]
        model.threshold = (a * db + b * da) / (da + db)
    return model


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...], id_col: str = "page_id", url_col: str = "url", **sample) -> DataFrame:
    """(id, url, host, path, rule, score, verdict) for every row of pages."""
    rows = pages.select(F.col(id_col), F.col(url_col).cast("string").alias("url"))
    rows = rows.withColumn("host", host_of("url")).withColumn("path", path_of("url"))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("_says", rule_of(F.col("host"), F.col("path"), rules, "verdict"))
    model = fit(rows.filter("_says IS NOT NULL").select(F.col("_says").alias("label"), "url"), **sample)
    if model is None:
        scored, says = rows.withColumn("score", F.lit(0.0)), F.lit(ALLOW)
    else:
        scored, says = with_scores(rows, model, "url", "score"), F.when(F.col("score") >= model.threshold, ALLOW).otherwise(BLOCK)
    return scored.withColumn("verdict", F.coalesce("_says", says)).drop("_says")

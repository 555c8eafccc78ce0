"""The pipeline's stages, each on what the one before kept, against brute force."""

from __future__ import annotations

import re
from collections import Counter

import pytest

import corpus_pipeline
from screenloom.llm import simhash
from screenloom.llm.tokens import encoder
from tests.llm.test_llm_operators import SCHEMA, odd_rows, slow_components, slow_fingerprint, slow_measure, slow_targets

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    """The rows before and after each stage, written and read again in between."""
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, DATA).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((docs, after))
        docs = after
    return out


def test_columns_stay(staged):
    for before, after in staged[:-1]:
        assert before.dtypes == after.dtypes


def test_quality(staged):
    before, after = staged[0]
    kept = {r.doc_id for r in after.collect()}
    for r in before.collect():
        n, _, symbols, dup, repeat = slow_measure(r.text)
        lines = len([x for x in r.text.split("\n") if x.strip()])
        bad = n < 10 or 100 * repeat > 20 * n or 100 * symbols > 30 * n or 100 * dup > 50 * lines
        assert (r.doc_id in kept) == (not bad)  # no source of these is a bad one


def test_language(staged):
    """Every text here with a letter is in a language that labels teach."""
    before, after = staged[1]
    kept = {r.doc_id for r in after.collect()}
    assert kept == {r.doc_id for r in before.collect() if re.search(r"[^\W\d_]", r.text)}


def jaccard(a, b):
    sets = []
    for t in (a, b):
        w = t.encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_near_duplicates(staged):
    before, after = staged[2]
    rows = sorted(before.collect(), key=lambda r: r.doc_id)
    kept = {r.doc_id for r in after.collect()}
    assert len(kept) == after.count()
    roots = slow_components([slow_fingerprint(r.text) for r in rows])
    assert {min(r.doc_id for r, x in zip(rows, roots, strict=True) if x == root) for root in set(roots)} >= kept
    texts = {r.doc_id: r.text for r in rows}
    root_of = {r.doc_id: x for r, x in zip(rows, roots, strict=True)}
    for r in rows:  # what goes is like something with a smaller id
        if r.doc_id not in kept:
            assert any(root_of[i] == root_of[r.doc_id] or jaccard(texts[i], r.text) >= simhash.SIMILARITY for i in texts if i < r.doc_id)


def test_mix(staged):
    before, after = staged[3]
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in before.collect():
        n = len(r.text.encode().split())
        sizes[r.source] += n
        largest[r.source] = max(largest[r.source], n)
    for r in after.collect():
        taken[r.source] += len(r.text.encode().split())
    for s, t in slow_targets(sizes).items():
        assert abs(taken[s] - t) <= largest[s]


def test_packing(staged):
    before, after = staged[4]
    want, got = Counter(), Counter()
    for r in before.collect():
        want[r.doc_id] += len(encoder().ids(r.text))
    for r in after.collect():
        got[r.doc_id] += r.length
    assert want == got


def test_run_is_its_stages(spark, staged):
    got = corpus_pipeline.run(spark, DATA)
    assert Counter((r.doc_id, r.start, r.ids_crc32) for r in got.collect()) == Counter((r.doc_id, r.start, r.ids_crc32) for r in staged[-1][1].collect())


@pytest.mark.parametrize("rows", [odd_rows(), []])
def test_odd_rows_pass_through_all_stages(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
    assert docs.count() >= bool(rows)

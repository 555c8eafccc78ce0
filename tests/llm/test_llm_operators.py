"""Each operator against a brute-force version, and the odd rows that every operator must stand."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from screenloom.llm import language, licenses, mixing, neighbours, packing, quality, scoring, shards, simhash, urls
from screenloom.llm.common import crc_of_id

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, host string, size long"
LOW = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def odd_rows():
    """Nulls, empty and very long texts, ties and repeated rows, and columns with clashing names."""
    r = random.Random(5)
    vocabulary = ["alpha", "beta", "gamma", "delta", "Mit", "license", "the", "of", "général", "été", "x#"]
    rows = []
    for i in range(60):
        text = " ".join(r.choice(vocabulary) for _ in range(r.randrange(1, 60)))
        rows.append((i, text, r.choice(["en", "fr", None]), r.choice(["a", "b", None]), len(text), "h", 1))
    rows += [(100, None, "en", "a", None, None, None), (101, "", None, None, 0, None, None), (102, " \n\t", "en", "b", 3, None, None)]
    rows += [(None, "alpha beta", "en", "a", 10, None, None), (None, None, None, None, None, None, None)]
    rows += [rows[3], rows[3], (103, rows[3][1], "en", "a", 5, "h", 2)]
    rows += [(104, "word " * 30_000, "en", "a", 150_000, "h", 3), (105, "1234 !!", "en", "b", 7, "h", 3), (106, "a\x00b � \U0001f600", "en", "b", 7, "h", 3)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return (text or "").encode().split()


# quality rules


def slow_measure(text):
    w = words(text)
    wins = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(wins)
    covered = {j for i, x in enumerate(wins) if n[x] > 1 for j in range(i, i + 5)}
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for x in lines:
        if x.encode().split():
            dup += x in seen
            seen.add(x)
    return len(w), sum(len(x.decode()) for x in w), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_quality_counts(spark, docs):
    texts = defaultdict(set)
    for r in odd_rows():
        texts[r[0]].add(r[1])
    got = quality.quality_rules(docs).collect()
    assert len(got) == len(odd_rows())
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) in {slow_measure(t) for t in texts[r.doc_id]}
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_repeated_words_stay_exact_with_many_kinds():
    r = random.Random(1)
    w = [b"%d" % r.randrange(40_000) for _ in range(50_000)]
    w += w[100:120]
    wins = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if wins[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    assert quality.count_repeated(w) == len(covered) == 40


def test_bad_host_tightens_bounds(spark):
    clean = " ".join(f"w{i}" for i in range(15))
    rows = [(i, "# # # " * 20, None, "bad", 0, None, None) for i in range(40)] + [(i, " ".join(f"w{i}x{k}" for k in range(30)), None, "good", 0, None, None) for i in range(40, 80)]
    rows += [(90, clean, None, "bad", 0, None, None), (91, clean, None, "good", 0, None, None), (92, " ".join(f"v{k}" for k in range(30)), None, "bad", 0, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    kept = {r.doc_id: r.kept for r in quality.quality_rules(df).collect()}
    assert not kept[90] and kept[91] and kept[92] and not kept[0] and kept[50]
    assert {r.doc_id for r in quality.keep_good(df).collect()} == {k for k, v in kept.items() if v}


# language


def test_phrases_are_greedy_longest_matches():
    r = random.Random(3)
    texts = {x: ["".join(r.choice(a) for _ in range(300))] for x, a in (("u", "abcd"), ("v", "abce"))}
    model = language.build_model({k: [language.folded(t) for t in v] for k, v in texts.items()})
    for _ in range(20):
        t = "".join(r.choice("abcdez") for _ in range(r.randrange(1, 200)))
        for lang, count in zip(model.langs, language.count_phrases(model, [model.codes[language.folded(t)]])[0], strict=True):
            known, n, i = texts[lang][0] + " ", 0, 0
            while i < len(t):
                k = 1
                while i + k < len(t) and t[i : i + k + 1] in known:
                    k += 1
                n, i = n + 1, i + k
            assert n == count


def slow_phrases(known, t):
    n, i = 0, 0
    while i < len(t):
        k = 1
        while i + k < len(t) and t[i : i + k + 1] in known:
            k += 1
        n, i = n + 1, i + k
    return n


@pytest.mark.parametrize("warm", [256, 1])
def test_long_texts_are_parsed_as_in_one_go(warm, monkeypatch):
    monkeypatch.setattr(language, "WARM", warm)  # with 1 most pieces aren't in step, and are read again
    r = random.Random(6)
    learned = {x: "".join(r.choice(a) for _ in range(400)) for x, a in (("u", "abcd"), ("v", "abce"))}
    model = language.build_model({k: [language.folded(v)] for k, v in learned.items()})
    texts = ["".join(r.choice("abcdez") for _ in range(n)) for n in (20_000, 2048, 2049, 5000, 1, 4096)] + ["ab" * 5000, "z" * 3000]
    got = language.count_phrases(model, [model.codes[language.folded(t)] for t in texts])
    for row, t in zip(got.tolist(), texts, strict=True):
        assert row == [slow_phrases(learned[x] + " ", t) for x in model.langs]


def test_predictions_of_a_whole_table(spark):
    """Language and score of every document against a plain parse of its whole text."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    teaches = crc_of_id() % 4 != 2
    sample = language.labelled_sample(df.filter(teaches), "text", "lang", language.SAMPLE_TEXTS + language.SAMPLE_TEXTS // language.CALIBRATE, language.SAMPLE_CHARS)
    show = lambda t: "".join(map(chr, language.folded(t)))
    known = {x: "".join(show(t) + " " for t in some[: language.SAMPLE_TEXTS]) for x, some in sorted(sample.items())}
    for row in language.identify(df, teaches).collect():
        t = show(row.text or "")
        if not t:
            assert row.lang_pred == "und"
            continue
        bits = {x: slow_phrases(k, t) * math.log2(len(k) + 1) / len(t) for x, k in known.items()}
        least = min(bits.values())
        assert abs(bits[row.lang_pred] - least) < 1e-9
        assert abs(row.score - 1 / sum(2 ** (least - b) for b in bits.values())) < 1e-9


def test_language_held_out_accuracy(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = crc_of_id() % 4 == 2
    got = language.identify(df, ~held).filter(held).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a"), F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    assert got["a"] > 0.98 and 0 <= got["lo"] <= got["hi"] <= 1


def test_all_stay_where_no_label_teaches(spark):
    rows = spark.createDataFrame([(1, "some text", None), (2, None, None)], "doc_id long, text string, lang string")
    assert language.keep_known(rows, F.lit(True)).count() == 2


def test_language_of_odd_rows(docs):
    got = language.identify(docs, F.lit(True)).collect()
    assert len(got) == len(odd_rows())
    for r in got:
        assert (r.lang_pred == "und") == (not re.search(r"[^\W\d_]", r.text or ""))
    assert {r.lang_pred for r in language.identify(docs, F.lit(False)).collect()} == {"und"}


# near duplicates


def slow_fingerprint(text):
    w = (text or "").encode().translate(LOW).split()
    sh = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(fps):
    found = dict(enumerate(range(len(fps))))

    def root(x):
        while found[x] != x:
            x = found[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                found[root(i)] = root(j)
    return [root(i) for i in range(len(fps))]


def test_simhash_against_all_pairs(spark, docs):
    got = simhash.near_duplicates(docs).collect()
    rows = odd_rows()
    assert len(got) == len(rows)
    fps = [slow_fingerprint(r[1]) for r in rows]
    roots = slow_components(fps)
    least = {}
    for r, root in zip(rows, roots, strict=True):
        if r[0] is not None:
            least[root] = min(least.get(root, r[0]), r[0])
    want = Counter((r[0], fp, least.get(root)) for r, fp, root in zip(rows, fps, roots, strict=True))
    assert Counter((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in got) == want


def test_links_join_up_planted_balls(spark):
    """Chains and crowds of near fingerprints, found by all pairs and by balls."""
    r = random.Random(11)
    fps = {r.getrandbits(64) for _ in range(150)}
    for start in [r.getrandbits(64) for _ in range(4)]:
        at = start
        for _ in range(25):  # a chain
            at ^= sum(1 << b for b in r.sample(range(64), r.randrange(1, 5)))
            fps.add(at)
        for _ in range(40):  # a crowd
            fps.add(start ^ sum(1 << b for b in r.sample(range(64), r.randrange(1, 4))))
    for b in r.sample(range(64), 5):
        base = r.getrandbits(64)
        fps |= {base, base ^ (1 << b) ^ 0b1110000}
    fps = sorted(fps)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    from screenloom.llm.common import Work
    from screenloom.llm.graph import components

    with Work(spark) as work:
        roots = {x.node & (1 << 64) - 1: x.root for x in components(simhash.links(df, work), work=work).collect()}
    want, got = defaultdict(set), defaultdict(set)
    for f, root in zip(fps, slow_components(fps), strict=True):
        want[root].add(f)
        got[roots.get(f, ("alone", f))].add(f)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, got.values()))


def test_crowds_of_near_copies_lay_few_balls(spark, monkeypatch):
    """A large crowd around one fingerprint needs no full balls, and those beside it are found either way."""
    from screenloom.llm.common import Work
    from screenloom.llm.graph import components

    made = Counter()

    class Counted(Work):
        def table(self, df, name, instead_of=None):
            out = super().table(df, name, instead_of)
            made[name] += out.count()
            return out

    r = random.Random(13)
    start = r.getrandbits(64)
    fps = {start ^ sum(1 << b for b in r.sample(range(64), r.randrange(3))) for _ in range(300)}
    beside = [f ^ (0b111 << k) for k, f in enumerate(sorted(fps)[:20])]
    fps = sorted(fps | set(beside) | {f ^ (1 << 40 | 1 << 50) for f in beside})
    df = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long")
    want = defaultdict(set)
    for f, root in zip(fps, slow_components(fps), strict=True):
        want[root].add(f)
    for most, dense in ((simhash.OUTSIDE, False), (0, True)):
        monkeypatch.setattr(simhash, "OUTSIDE", most)
        made.clear()
        with Counted(spark) as work:
            roots = {x.node & (1 << 64) - 1: x.root for x in components(simhash.links(df, work), work=work).collect()}
        got = defaultdict(set)
        for f in fps:
            got[roots.get(f, ("alone", f))].add(f)
        assert sorted(map(sorted, want.values())) == sorted(map(sorted, got.values()))
        assert made["members"] > len(fps) and (made["dense"] > 0) == dense


def test_keep_one_of_each_group(docs):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    all_rows = odd_rows()
    roots = slow_components([slow_fingerprint(r[1]) for r in all_rows])
    of = {r[:2]: root for r, root in zip(all_rows, roots, strict=True)}
    got = Counter(of[r.doc_id, r.text] for r in rows)
    assert set(got) == set(roots) and set(got.values()) == {1}
    for r in rows:  # without an id only where no other of the group has one
        assert r.doc_id is not None or all(x[0] is None for x, root in zip(all_rows, roots, strict=True) if root == of[None, r.text])


def test_common_shingles_are_counted_over_all_texts(spark, monkeypatch):
    from screenloom.llm.common import Work

    r = random.Random(14)
    rows = [(k, " ".join("w%02d" % r.randrange(3) for _ in range(r.randrange(4, 60)))) for k in range(300)]
    rows += [(300, rows[7][1]), (None, rows[7][1]), (301, None), (302, ""), (None, None)]
    texts = {t for _, t in rows}
    counts = Counter(x for s in simhash.sets_of(sorted(texts, key=str), simhash.CHECK_SHINGLE) for x in s.tolist())
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    chars = sum(len(t or "") for _, t in rows)
    for every in (chars, chars // 3, 30_000_000):
        monkeypatch.setattr(simhash, "COMMON_CHARS", every)
        least = max(simhash.COMMON, math.ceil(simhash.COMMON * chars / every))
        with Work(spark) as work:
            got = simhash.common_shingles(docs, "doc_id", "text", work)
        assert got.tolist() == sorted(x for x, n in counts.items() if n >= least) and len(got) > 10


def test_similar_texts_go_and_others_stay(spark):
    r = random.Random(8)
    base = [["w%05d" % r.randrange(10**5) for _ in range(150)] for _ in range(30)]
    rows = [(k, " ".join(w)) for k, w in enumerate(base)]
    near, far = list(base[4]), list(base[5])
    near[70] = near[71] = "another"
    for k in range(0, 150, 12):
        far[k] = "elsewhere"
    rows += [(100, " ".join(near)), (101, " ".join(far)), (102, rows[6][1])]
    kept = {x.doc_id for x in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {*range(30), 101}


def slow_similarity(a, b):
    sets = []
    for t in (a, b):
        w = words(t)
        sets.append({tuple(w[i : i + simhash.CHECK_SHINGLE]) for i in range(max(1, len(w) - simhash.CHECK_SHINGLE + 1))})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_similar_texts_are_found_whole(spark):
    """Cut, extended, edited and short-worded copies, with production parameters."""
    r = random.Random(11)
    rows = []
    for k in range(120):
        n = (60, 150, 500)[k % 3]
        text = ["%0*x" % ((3, 8)[k % 2], r.randrange(16**3)) for _ in range(n)]
        edited = list(text)
        edited[r.randrange(5, n - 5)] = "x"
        other = (text[: n - n // 8], [*text, *("%08x" % r.randrange(16**8) for _ in range(n // 8))], edited)[k // 6 % 3]
        if slow_similarity(" ".join(text), " ".join(other)) >= simhash.SIMILARITY:
            rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(other))]
    assert len(rows) >= 200
    kept = {x.doc_id for x in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {k for k, _ in rows if k % 2 == 0}


def test_similar_texts_meet_without_their_centre(spark):
    """Texts that are each alike to one other only, all edited copies of one original."""
    r = random.Random(12)
    base, rows = ["w%05d" % r.randrange(10**5) for _ in range(200)], []
    for k in range(40):
        pair = list(base)
        for i in range(5 + k % 7, 195, 25):  # the original and other pairs are below the threshold
            pair[i] = f"p{k}x{i}"
        other = list(pair)
        other[k % 190] = "another"
        rows += [(2 * k + 1, " ".join(pair)), (2 * k + 2, " ".join(other))]
    rows.append((0, " ".join(base)))
    alike = slow_similarity
    roots = list(range(len(rows)))
    prints = [slow_fingerprint(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            if alike(rows[i][1], rows[j][1]) >= simhash.SIMILARITY or (prints[i] ^ prints[j]).bit_count() <= simhash.RADIUS:
                old, new = roots[i], roots[j]
                roots = [new if x == old else x for x in roots]
    want = {min(rows[i][0] for i in range(len(rows)) if roots[i] == root) for root in set(roots)}
    assert len(want) > 10
    kept = {x.doc_id for x in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == want


def test_rows_of_one_id_with_unlike_texts_stay(spark):
    rows = [(1, "one two three four five six"), (1, "red green blue black white grey"), (1, "one two three four five six"), (2, "red green blue black white grey")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((x.doc_id, x.text) for x in kept.collect()) == sorted({*rows[:2]})


# licenses


def test_license_places(docs):
    pattern = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    texts = defaultdict(list)
    for r in odd_rows():
        texts[r[0]].append(r[1])
    got = licenses.scan(docs).collect()
    assert len(got) == len(odd_rows())
    for r in got:
        ok = False
        for t in texts[r.doc_id]:
            w = pattern.findall((t or "").encode().translate(LOW))
            want = [i for i in range(len(w) - 1) if w[i : i + 2] == [b"mit", b"license"]]
            ok |= r.n_words == len(w) and want == [p.first_word for p in r.places if p.whole]
        assert ok


def test_passage_with_a_word_put_in(spark):
    text = "x y z. Redistribution and use in source and also binary forms, with or without modification, are permitted provided that the following conditions are met: a"
    (row,) = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [(p.label, p.first_word) for p in row.places] == [("bsd", 3)] and 0.8 <= row.places[0].cover < 1


def test_spans_are_verified(spark):
    """Swapped, split and repeated passages, and passages with words dropped, put in or exchanged."""
    bsd = next(t for t in licenses.PASSAGES if t.label == "bsd").words
    w = bsd.split()
    cases = {
        "all rights reserved": [("all-rights-reserved", 0)],
        "rights reserved all rights": [],
        "all rights of the rights reserved": [],
        " ".join(["all rights reserved"] * 6): [("all-rights-reserved", 3 * i) for i in range(6)],
        f"{bsd} {bsd} x {bsd}": [("bsd", 0), ("bsd", len(w)), ("bsd", 2 * len(w) + 1)],
        " ".join(w[9:] + w[:9]): [],
        " ".join(w[:9] + ["x"] * 30 + w[9:]): [],
        " ".join(w[:9] + w[11:]): [("bsd", 0)],
        " ".join([*w[:9], "really", *w[9:15], "indeed", *w[15:]]): [("bsd", 0)],
        " ".join([*w[:9], "other", *w[10:]]): [("bsd", 0)],
        " ".join(w[: len(w) // 2]): [],
        " ".join(f"{x} {y}" for x, y in zip(w[::2], ["z"] * len(w), strict=False)): [],
    }
    rows = list(enumerate(cases))
    got = {r.doc_id: [(p.label, p.first_word) for p in r.places] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: cases[t] for k, t in rows}


def test_passages_match_brute_force(spark):
    """Passages with a few words exchanged, among others: found exactly where an alignment of the whole
    template, word by word at one place, holds enough of its pairs of words."""
    r = random.Random(5)
    rows, want = [], {}
    chosen = [t for t in licenses.PASSAGES if len(t.words.split()) >= 12]
    for k in range(60):
        template = chosen[k % len(chosen)]
        w = template.words.split()
        for i in r.sample(range(len(w)), r.randrange(0, 5)):
            w[i] = f"q{i}"
        lead = [f"p{i}" for i in range(r.randrange(5))]
        text = lead + w + ["end"]
        rows.append((k, " ".join(text)))
        want[k] = set()
        for t in licenses.PASSAGES:
            own = t.words.split()
            for at in range(len(text) - len(own) + 1):
                hits = sum(text[at + i : at + i + 2] == own[i : i + 2] for i in range(len(own) - 1))
                if hits >= licenses.LEAST_COVER * (len(own) - 1):
                    want[k].add((t.label, hits / (len(own) - 1)))
    got = {x.doc_id: {(p.label, p.cover) for p in x.places if not p.whole} for x in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and any(want.values()) and not all(want.values())


# URLs


def test_url_rules_and_model(spark):
    r = random.Random(2)
    name = lambda a: "".join(r.choice(a) for _ in range(8))
    rows = [(i, f"http://{name('abcde')}.good/{i}") for i in range(300)] + [(i, f"https://{name('vwxyz')}.BAD/{i}?q") for i in range(300, 600)]
    rows += [(900, f"http://{'abcdeabc'}.net/1"), (901, "http://vwxyzvwx.net/1"), (902, None), (903, ""), (904, "no scheme"), (905, "ftp://X.Good?z#/"), (906, "http://"), (None, "http://a.b/c")]
    rules = (urls.Rule("allow", "good", "/"), urls.Rule("block", "bad", "/"), urls.Rule("block", "x.good", ""))
    got = {x.page_id: x for x in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()}
    assert len(got) == len(rows)
    assert got[0].rule == "good/" and got[0].verdict == "allow" and got[300].verdict == "block" and got[300].path == "/300"
    assert got[900].rule is None and got[900].verdict == "allow" and got[901].verdict == "block"
    assert (got[902].host, got[904].path, got[905].host, got[905].path, got[905].rule) == ("", "", "x.good", "", "x.good")
    only = urls.judge_urls(spark.createDataFrame(rows[:10], "page_id long, url string"), (urls.Rule("allow", "nowhere", "/"),)).collect()
    assert {x.verdict for x in only} == {"allow"}


def slow_markov(texts, order):
    """log p of a text's characters by Witten-Bell interpolation, from plain counts."""
    contexts = defaultdict(Counter)
    padded = lambda t: ["\2"] * order + list(t) + ["\3"]
    for t in texts:
        c = padded(t)
        for i in range(order, len(c)):
            for k in range(order + 1):
                contexts[k, tuple(c[i - k : i])][c[i]] += 1

    def score(t):
        c, total = padded(t), 0.0
        for i in range(order, len(c)):
            p = 1 / 256
            for k in range(order + 1):
                seen = contexts.get((k, tuple(c[i - k : i])))
                if seen:
                    n, kinds = sum(seen.values()), len(seen)
                    p = (seen[c[i]] + kinds * p) / (n + kinds)
            total += math.log(p)
        return total / (len(c) - order)

    return score


def test_url_scores_match_a_plain_model(spark):
    """Scores, threshold and verdicts of URLs that no rule fits, very long and empty ones among them."""
    r = random.Random(3)
    name = lambda a, n: "".join(r.choice(a) for _ in range(n))
    good, bad = ([f"http://{name(a, 8)}.{end}/{name(a, 6)}" for _ in range(120)] for a, end in (("abcde", "good"), ("cdexyz", "bad")))
    other = [f"http://{name('abcdexyz', 8)}.net/{name('abcdexyz', 5)}" for _ in range(60)] + ["http://", "http://" + name("abc", 5000), "no scheme"]
    rows = list(enumerate([*good, *bad, *other]))
    df = spark.createDataFrame(rows, "page_id long, url string")
    got = {x.page_id: x for x in urls.judge_urls(df, (urls.Rule("allow", "good", "/"), urls.Rule("block", "bad", "/"))).collect()}
    tests = {x.url for x in df.filter(F.pmod(F.xxhash64("url", F.lit(1)), F.lit(4)) == 0).collect()}
    rest = lambda u: u.partition("://")[2].lower()
    yes, no = (slow_markov([rest(u) for u in some if u not in tests], urls.ORDER) for some in (good, bad))
    ratio = lambda u: yes(rest(u)) - no(rest(u))
    (a, da), (b, db) = ((float(np.mean(s)), float(np.std(s)) + 1e-9) for s in ([ratio(u) for u in some if u in tests] for some in (good, bad)))
    threshold = (a * db + b * da) / (da + db)
    for k, u in rows:
        assert abs(got[k].score - ratio(u)) < 1e-9
        if k >= 240:
            assert got[k].verdict == ("allow" if ratio(u) >= threshold else "block")


def test_markov_models_sum_to_one():
    data, at, _ = urls.prepared(["://abcab", "://abd"])
    tables = defaultdict(Counter)
    for k in range(urls.ORDER + 1):
        for c, g in zip(*urls.grams(data, at, k), strict=True):
            tables[int(c)][int(g)] += 1
    pairs = [(g, n) for x in tables.values() for g, n in x.items()]
    model = urls.Markov(
        urls.Table(np.array([g for g, _ in pairs]), np.array([n for _, n in pairs], float)),
        urls.Table(np.array(list(tables)), np.array([sum(x.values()) for x in tables.values()], float), np.array([len(x) for x in tables.values()], float)),
    )
    total = 0.0
    for b in range(256):
        probe = urls.Stretches(b"\x02" * urls.ORDER + b"ab" + bytes([b]))
        total += math.exp(model.log_likelihoods(probe, np.array([urls.ORDER + 2]))[0])
    assert abs(total - 1) < 1e-9


# mixing


def slow_targets(sizes, weights=(5, 2, 1)):
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[k % 3] for k, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(sizes.values())
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if w[s] * level >= 2 * sizes[s]}
        if not full:
            return target | {s: w[s] * level for s in open_}
        target |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        open_ -= full
    return target


def test_mix_targets_and_shares(spark):
    r = random.Random(4)
    rows = [(i, " ".join("w" * r.randrange(1, 40)), r.choice(["a", "a", "a", "b", "c", "d", "é", None])) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_report(df).collect()
    again = mixing.mix_report(df.repartition(7)).collect()
    assert sorted((x.doc_id, x.taken) for x in got) == sorted((x.doc_id, x.taken) for x in again)
    sizes, taken, largest = Counter(), Counter(), Counter()
    source = {i: s for i, _, s in rows}
    for x in got:
        s = source[x.doc_id]
        sizes[s] += x.size
        taken[s] += x.taken
        largest[s] = max(largest[s], x.size)
        assert x.taken <= 2 * x.size
    want = slow_targets(sizes)
    for x in got:
        assert math.isclose(x.target, want[source[x.doc_id]]) and x.source_size == sizes[source[x.doc_id]]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s]
    copies = Counter(x.doc_id for x in mixing.mix(df).collect())
    assert all(copies[x.doc_id] == x.times for x in got)


def test_mix_of_odd_rows(docs, empty):
    assert mixing.mix_report(docs).count() == len(odd_rows())
    assert mixing.mix(docs).columns == docs.columns
    assert mixing.mix_report(empty).count() == 0 and mixing.mix(empty).count() == 0


# shards


def test_slots_are_a_permutation():
    for n in (1, 2, 3, 17, 1000, 4097):
        slots = shards.permuted(np.arange(n), n)
        assert sorted(slots.tolist()) == list(range(n))
        assert n < 100 or (slots != shards.permuted(np.arange(n), n, "another key")).any()


def test_shards_round_trip(spark, docs, tmp_path):
    from screenloom.llm.tokens import encoder

    rows = shards.write_shards(docs, str(tmp_path / "out"), length=64, shard_size=32).collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    ids, pieces = Counter(), defaultdict(list)
    for r in rows:
        data = np.memmap(r.path, "<u2", "r")[r.byte_offset // 2 :][:64]
        assert zlib.crc32(data[: r.n_ids].astype("<u4").tobytes()) == r.ids_crc32 and sum(p.length for p in r.parts) == r.n_ids
        at = 0
        for p in r.parts:
            pieces[p.doc_id].append((p.start, data[at : at + p.length].tolist()))
            at += p.length
    for r in odd_rows():
        ids[r[0]] += len(encoder().ids(r[1]))
    assert {k: sum(len(x) for _, x in v) for k, v in pieces.items()} == dict(ids)
    for r in odd_rows():
        if r[0] not in (None, odd_rows()[3][0]):
            assert sum((x for _, x in sorted(pieces[r[0]])), []) == encoder().ids(r[1]).tolist()
    before = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "out").iterdir()}
    shards.write_shards(docs, str(tmp_path / "out"), length=64, shard_size=32, resume=True)
    assert before == {p.name: p.stat().st_mtime_ns for p in (tmp_path / "out").iterdir()}
    # other texts with as many ids: a shard of the right size isn't kept for it
    one = lambda t: docs.sparkSession.createDataFrame([(k, f"{t} {k % 7} one two three") for k in range(200)], "doc_id long, text string")
    for name, turns in (("a", ("red", "blue")), ("b", ("blue",))):
        for turn in turns:
            shards.write_shards(one(turn), str(tmp_path / name), length=64, shard_size=4, resume=True)
    contents = [{p.name: p.read_bytes() for p in (tmp_path / name).iterdir()} for name in "ab"]
    assert contents[0] == contents[1]


def test_ids_are_the_tokenizer_files(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    from screenloom.llm.tokens import encoder

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in [*odd_rows(), (0, "a<|endoftext|>b  <|endoftext|>"), (1, "it's  12345\n\n\nÉté's x‍🙂👍🏽")]:
        assert encoder().ids(r[1]).tolist() == [*whole.encode(r[1] or "", add_special_tokens=False).ids, 1]


# neighbours


def test_neighbours_against_all_pairs(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=12).astype(np.float32).tolist(), 0) for i in range(300)]
    rows += [(300 + i, rows[7][1], 0) for i in range(60)]  # ties
    rows += [rows[20], rows[20], (40, rows[41][1], 0), rows[41]]  # repeated rows, and ids with other vectors
    rows += [(500, None, 0), (501, [], 0), (502, [0.0] * 12, 0), (503, [float("nan")] + [1.0] * 11, 0), (504, [None] + [1.0] * 11, 0), (505, [float("inf")] * 12, 0), (506, [1e30] * 12, 0), (507, [1.0, 2.0], 0), (508, [2.0, 1.0], 0), (None, [1.0] * 12, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = neighbours.nearest(df, F.expr("vec_id % 20 = 0 or vec_id > 490"), 5).collect()
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]

    def product(x, y):
        total = 0.0
        for a, b in zip(x.tolist(), y.tolist(), strict=True):
            total += a * b
        return total

    want = []
    for n, (q, x) in enumerate(ok):
        if q % 20 == 0 or q > 490:
            best = sorted((-product(x, y), c) for m, (c, y) in enumerate(ok) if m != n and len(x) == len(y))[:5]
            want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_error_bounds_hold():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(40, 2100)), rng.normal(size=(50, 2100)) * 100
    q, c = (neighbours.Codes(2100, *neighbours.Codes.of(np.arange(len(v)), v)) for v in (x, y))
    near, bound = neighbours.products(q, c)
    assert (np.abs(near - x @ y.T) <= bound).all()


def test_mix_of_repeated_rows(spark):
    """A source that is copies of few rows comes within one of them of its target."""
    rows = [(1, "w " * 100, None, "a", 0, None, None)] * 40 + [(i, "v " * 50, None, "b", 0, None, None) for i in range(100, 300)] + [(2, "u " * 30, None, "c", 0, None, None)] * 90 + [(3, "t " * 7, None, "c", 0, None, None)] * 50
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    want, got = slow_targets(sizes), mixing.mix_report(df).collect()
    assert len(got) == len(rows)
    taken, mixed = Counter(), Counter()
    for r in got:
        taken[{1: "a", 2: "c", 3: "c"}.get(r.doc_id, "b")] += r.taken
        assert r.taken <= 2 * r.size
    for r in mixing.mix(df).collect():
        mixed[r.source] += len(words(r.text))
    assert taken == mixed
    assert all(abs(taken[s] - want[s]) <= {"a": 100, "b": 50, "c": 30}[s] for s in "abc")
    assert Counter(map(tuple, mixing.mix_report(df.repartition(3)).collect())) == Counter(map(tuple, got))


def left_behind(spark, query, docs):
    """The tables in the shared folder after a query has been planned and run."""
    import os

    from screenloom.llm.common import work_path

    folder = os.path.dirname(work_path(spark, "x")).removeprefix("file:")
    before = set(os.listdir(folder))
    query(docs).collect()
    return sorted(name.rsplit("-", 1)[0] for name in set(os.listdir(folder)) - before)


def test_mix_leaves_what_its_result_reads(spark, docs):
    assert left_behind(spark, mixing.mix, docs) == ["mix-thresholds"]
    assert left_behind(spark, mixing.mix_report, docs) == ["mix-rows", "mix-thresholds"]


# packing


def slow_first_fit(sizes, capacity):
    bins, out = [], {}
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        for b, used in enumerate(bins):
            if used + sizes[k] <= capacity:
                break
        else:
            b = len(bins)
            bins.append(0)
        out[k] = (b, bins[b])
        bins[b] += sizes[k]
    return [out[k] for k in range(len(sizes))]


def test_tournament_tree_is_first_fit():
    r = random.Random(6)
    for n in (1, 2, 7, 200):
        sizes = [r.randrange(1, 100) for _ in range(n)]
        bins, offsets = packing.first_fit_decreasing(np.array(sizes), 100)
        assert list(zip(bins.tolist(), offsets.tolist(), strict=True)) == slow_first_fit(sizes, 100)


def test_packed_pieces_cover_documents(docs, empty):
    from screenloom.llm.tokens import encoder

    rows = packing.pack(docs, length=128, group_docs=16).collect()
    got, used = Counter(), defaultdict(list)
    for r in rows:
        got[r.doc_id] += r.length
        used[r.sequence_id].append((r.offset, r.length))
    want = Counter()
    for r in odd_rows():
        want[r[0]] += len(encoder().ids(r[1]))
    assert got == want
    for spans in used.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 128
    one = [r for r in rows if r.doc_id == 104]
    ids = encoder().ids("word " * 30_000)
    assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids) for r in one)
    assert packing.pack(empty).count() == 0


# language-model scores


def plain_model(texts, order):
    """p(word, history) of a backoff model with Dirichlet priors, from lists of words that end in None."""
    counts, contexts = Counter(), Counter()
    for w in texts:
        counts.update((x,) for x in w)
        padded = ["<s>", *w]
        for i in range(1, len(padded)):
            for k in range(2, order + 1):
                if i - k + 1 >= 0:
                    counts[tuple(padded[i - k + 1 : i + 1])] += 1
                    contexts[tuple(padded[i - k + 1 : i])] += 1
    n, v = sum(c for g, c in counts.items() if len(g) == 1), sum(len(g) == 1 for g in counts)

    def p(word, history):
        history = history[max(0, len(history) - order + 1) :]
        if not history:
            return (counts[(word,)] + 0.1) / (n + 0.1 * (v + 1))
        lower = p(word, history[1:])
        if not contexts[tuple(history)]:
            return lower
        return (counts[(*history, word)] + scoring.PRIOR * lower) / (contexts[tuple(history)] + scoring.PRIOR)

    return p, counts, n, v


def score_of(p, w):
    padded = ["<s>", *w]
    return sum(math.log10(p(padded[i], padded[:i])) for i in range(1, len(padded)))


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_match_a_plain_model(spark, docs, order, monkeypatch):
    r = random.Random(9)
    rows = [(i, " ".join(r.choice("abcdefgh") for _ in range(r.randrange(0, 12)))) for i in range(200)]
    df = spark.createDataFrame([*rows, (200, "zz a b q"), (201, None), (202, "h h c zz")], "doc_id long, text string").repartition(3)
    words_of = lambda t: [*(t or "").encode().translate(LOW).split(), None]
    p, *_ = plain_model([words_of(t) for k, t in rows if k % 3], order)
    got = {x.doc_id: x for x in scoring.lm_scores(df, F.col("doc_id") % 3 != 0, order=order).filter("doc_id < 200 or doc_id % 3 = 0").collect()}
    assert got[201].n_tokens == 1
    p, *_ = plain_model([words_of(t) for k, t in [*rows, (200, "zz a b q"), (202, "h h c zz")] if k % 3], order)
    texts = dict([*rows, (201, None)])
    for k, x in got.items():
        assert abs(x.score - score_of(p, words_of(texts[k]))) < 1e-6
    history = ["<s>", b"a", b"b"]
    assert abs(sum(p(w, history) for w in [*(x.encode() for x in "abcdefgh"), b"zz", b"q", None, b"unknown"]) - 1) < 1e-9


def test_scores_of_odd_rows(docs, empty):
    teaches = crc_of_id() % 10 != 0
    words_of = lambda t: [*(t or "").encode().translate(LOW).split(), None]
    p, counts, n, v = plain_model([words_of(r[1]) for r in odd_rows() if zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 10], scoring.ORDER)
    want = defaultdict(set)
    for r in odd_rows():
        w = words_of(r[1])
        base = sum(math.log10((counts[(x,)] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        want[r[0]].add((len(w), sum(counts[(x,)] > 0 for x in w), round(base, 5), round(score_of(p, w), 5)))
    got = scoring.lm_scores(docs, teaches).collect()
    assert len(got) == len(odd_rows())
    for r in got:
        assert (r.n_tokens, r.n_known, round(r.base_score, 5), round(r.score, 5)) in want[r.doc_id] and r.train_tokens == n and r.score <= 0
    assert scoring.lm_scores(empty, teaches).count() == 0
    assert {r.score for r in scoring.lm_scores(docs, F.lit(False)).collect()} == {0.0}


# all of them


@pytest.mark.parametrize(
    "run",
    [
        quality.quality_rules,
        quality.keep_good,
        lambda d: language.identify(d, F.lit(True)),
        simhash.near_duplicates,
        simhash.keep_one,
        licenses.scan,
        lambda d: urls.judge_urls(d.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url")), (urls.Rule("allow", "a", "/"),)),
        lambda d: neighbours.nearest(d.select(F.col("doc_id").alias("vec_id"), F.array(F.lit(1.0)).alias("embedding")), F.lit(True), 3),
        lambda d: shards.write_shards(d),
    ],
)
def test_empty_tables(empty, run):
    assert run(empty).count() == 0


@pytest.mark.parametrize("keep", [quality.keep_good, lambda d: language.keep_known(d, F.lit(True)), simhash.keep_one, mixing.mix], ids=["good", "known", "one", "mix"])
def test_extra_columns_with_clashing_names(spark, keep):
    """Columns that have the names of the operators' own stay as they are."""
    names = ["_key", "_n", "_counts", "_lang", "_score", "_foreign", "_mix_of", "_mix_times", "_h", "h", "id", "row", "n", "times", "_tight"]
    r = random.Random(4)
    texts = [" ".join("".join(r.choice("abcdefg") for _ in range(5)) for _ in range(30)) for _ in range(6)]
    rows = [(k, t, "en", "s", *(f"{name}{k}" for name in names)) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, ["doc_id", "text", "lang", "source", *names])
    got = keep(df)
    assert got.columns == df.columns
    assert got.count() and {tuple(x) for x in got.collect()} <= set(rows)


def test_every_query_is_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 11)} <= {x.split("_")[0] for x in names} and "pipeline" in names

"""Functions and operators on rows spelled out by hand."""

from __future__ import annotations

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from screenloom.functions import dates, display, markup, profile, text
from screenloom.operators import evidence, experience, ingest, lifecycle, ranking, rules, scoring
from screenloom.sources import files, replies, tables

NOW = 2026 * 12 + 2


def values(spark, rows, f, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x")).alias("y")).collect()]


def test_spaces_and_match_form(spark):
    assert values(spark, [" a ​b\n c﻿", None, ""], text.fold_space) == ["a b c", None, ""]
    assert values(spark, ["“Data‑Driven”  It’s"], text.match_form) == ["\"data-driven\" it's"]
    assert values(spark, ["ﬁn① Ａ"], lambda c: text.match_form(c, compose=True)) == ["fin1 a"]


def test_words(spark):
    assert values(spark, ["C++, C# and Node.js!"], text.words) == [["c++", "c#", "and", "node", "js"]]
    pairs = [("JavaScript", "java", False), ("PostgreSQL administration", "postgresql", True), ("C++", "C", False), ("node js", "Node.js", True), ("x", "", False), ("x", "--", False)]
    df = spark.createDataFrame(pairs, "a string, b string, want boolean")
    assert all(r[0] == r[1] for r in df.select(text.holds_words(F.col("a"), F.col("b")), "want").collect())
    assert [r[0] for r in df.limit(1).select(text.equals_exact(F.lit(" a  b"), F.lit("a b")), ).collect()] == [True]


def test_text_guard(spark):
    good = "experience " + "word " * 50
    got = values(spark, [good, "short", None, "1" * 300, "word " * 60, "year 1999 " + "word " * 60], text.text_failures)
    assert got == [[], ["too_short", "no_cv_signal"], ["too_short", "not_enough_letters", "no_cv_signal"], ["not_enough_letters", "no_cv_signal"], ["no_cv_signal"], []]
    assert values(spark, ["a\x01b\t", ""], text.control_ratio) == [0.25, 0.0]


def test_plain_text_and_replies(spark):
    assert values(spark, ["﻿a  b \r\nc\t d\r\r\n\n\n\ne \n"], text.tidy_lines) == ["a b\nc d\n\ne"]
    assert values(spark, ["```json\n{\"a\": 1}\n```", " {} ", "```\nx\n```"], text.strip_fences) == ['{"a": 1}', "{}", "x"]
    raw = ['platform"}', '{["x"', '"whole"', "}],", 'said "a" and "b"', ' "odd ', None]
    assert values(spark, raw, text.strip_artifacts) == ["platform", '"x"'.strip('"'), "whole", None, 'said "a" and "b"', '"odd', None]
    assert values(spark, ["}]", 'ok"}'], text.clean_reason) == ["}]", "ok"]


@pytest.mark.parametrize(
    ("said", "kind"),
    [
        ("an 82% match", "percentage"), ("82 percent", "percentage"), ("rated 8/10", "out_of_scale"), ("85 / 100 overall", "out_of_scale"),
        ("A score of 80 seems right.", "score_word"), ("Rating: 8", "score_word"), ("we rated Priya 8", "score_word"), ("Scores 85", "score_word"), ("I would score them 90 overall", "score_word"),
        ("their rating reflects 8 years but I would score them 90", "score_word"), ("rated at 8.5", "score_word"), ("scored 8 out of ten", "score_word"), ("scored 8 and more", "score_word"), ("score 8.5.", "score_word"),
        ("matches 4 of the 6 criteria", None), ("scored 8 projects", None), ("rating reflects 8 years", None), ("on 10/10/2023", None), ("4/6 criteria", None), ("scored 8.5 years", None), ("in 2019. Percentages aside", None), (None, None),
    ],
)
def test_score_figures(spark, said, kind):
    assert values(spark, [said], lambda c: text.score_figure(c)["kind"]) == [kind]


def test_dates(spark):
    said = ["2020", "2020-03", "2020/03/31", "2020-13", "Sept. 2019", "march 2019", "Mai 2019", "03/2018", "13/2018", "", None, "Present", "2020–04"]
    got = [tuple(d) if d else None for d in values(spark, said, dates.parse_date)]
    assert got == [(2020, None), (2020, 3), (2020, 3), None, (2019, 9), (2019, 3), None, (2018, 3), None, None, None, None, (2020, 4)]
    assert values(spark, ["To  Date", "now", "then"], dates.is_present_word) == [True, True, False]
    assert values(spark, [2020 * 12, 2020 * 12 + 11], dates.iso_month, "int") == ["2020-01", "2020-12"]
    assert values(spark, [94, 6, 3, 0], dates.years_of, "int") == [7.8, 0.5, 0.3, 0.0]
    assert values(spark, ["2026-02", "2026-03", "2025", "2026", None, "soon"], lambda c: dates.is_expired(c, F.lit(NOW))) == [True, False, True, False, False, False]


def total(spark, entries, now=NOW):
    df = spark.createDataFrame([(1, *e) for e in entries], "p int, s string, e string")
    rows = experience.resolve(experience.from_texts(df, "s", "e", now), ["p"], now, reason="reason")
    (r,) = experience.experience(rows, ["p"], now).collect()
    return r


def test_experience(spark):
    r = total(spark, [("2018-06", "2021-02"), ("2021-03", "present")])
    assert (r.months, r.years) == (94, 7.8)
    assert total(spark, [("2018-06", "2021-02"), ("2021-03", None)]).months == 94
    assert total(spark, [("2020", "2020"), ("2020-06", "2021-06")]).months == 18
    # an end that got lost, with a later role after it: nobody knows
    r = total(spark, [("2018-01", None), ("2021-01", "2021-12")])
    assert (r.months, r.n_open, r.n_covered) == (None, 1, 0)
    # unless other roles cover all of it
    assert total(spark, [("2018-01", None), ("2017-01", "present"), ("2020-01", "2020-06")]).months == 9 * 12 + 3
    r = total(spark, [(None, "2020"), ("x", "2020"), ("2020", "x"), ("2030", None), ("2020-05", "2020-01")])
    assert (r.months, r.n_unusable) == (None, 5)
    assert total(spark, [("2026-01", "2030-01")]).months == 3


def test_merged_intervals_against_month_sets(spark):
    rng = random.Random(7)
    rows = [(k, s, s + rng.randrange(0, 12)) for k in range(60) for s in (rng.randrange(0, 80) for _ in range(rng.randrange(1, 9)))]
    got = experience.merge_intervals(spark.createDataFrame(rows, "k int, start int, end int"), ["k"]).collect()
    for k in range(60):
        months = {m for kk, s, e in rows if kk == k for m in range(s, e + 1)}
        mine = sorted((r.start, r.end) for r in got if r.k == k)
        assert {m for s, e in mine for m in range(s, e + 1)} == months
        assert all(b[0] > a[1] + 1 for a, b in zip(mine, mine[1:], strict=False))


CRITERIA = [(i + 1, i + 1, f"c{i}", w) for i, w in enumerate((30, 20, 20, 15, 10, 5))]


def test_golden_score_and_bounds(spark):
    criteria = spark.createDataFrame(CRITERIA, "criterion_id int, position int, label string, weight int")
    seed, rows = 1, [(0, i + 1, r) for i, r in enumerate((8, 6, 9, 7, 5, 6))]
    for k in range(1, 200):
        for c in range(6):
            seed = (seed * 1103515245 + 12345) % 2147483648
            rows.append((k, c + 1, seed % 11))
    ratings = spark.createDataFrame(rows, "id int, criterion_id int, rating int")
    got = {r.id: r for r in scoring.weighted_score(ratings, criteria, ["id"]).collect()}
    assert (got[0].score_raw, got[0].score) == (725, 72.5)
    assert all(0 <= r.score_raw <= 1000 for r in got.values())
    checked = scoring.matrix_checks(scoring.matrix(ratings, criteria, ["id"]))
    assert checked.filter("not agrees").count() == 0
    with pytest.raises(Exception, match="100"):
        scoring.weighted_score(ratings.filter("criterion_id < 6"), criteria, ["id"]).collect()
    with pytest.raises(Exception, match="ratings"):  # no rating isn't a rating of 0
        scoring.weighted_score(ratings.withColumn("rating", F.when(F.col("criterion_id") != 2, F.col("rating"))), criteria, ["id"]).collect()
    changed = scoring.clean_matrices(scoring.matrix(ratings, criteria, ["id"]), {"label": lambda c: F.when(c == "c3", "x").otherwise(c)})
    assert changed.count() == 200 and scoring.clean_matrices(changed, {"label": lambda c: F.when(c == "c3", "x").otherwise(c)}).count() == 0


def test_tiers(spark):
    scores = [0.0, 64.0, 64.9, 65.0, 84.0, 84.9, 85.0, 86.0, 100.0]
    want = ["unmatched"] * 3 + ["potential_match"] * 3 + ["strong_match"] * 3
    assert values(spark, scores, lambda c: scoring.tier(c, F.lit(False)), "double") == want
    assert set(values(spark, scores, lambda c: scoring.tier(c, F.lit(True)), "double")) == {"unmatched"}
    with pytest.raises(Exception, match="0..100"):
        values(spark, [100.1], lambda c: scoring.tier(c, F.lit(False)), "double")


def test_unknown_rule_type_stops(spark):
    kind = "struct<id:int,label:string,type:string,on_missing:string,years:double,skill:string,matchMode:string,mustBeDemonstrated:boolean,level:string,name:string,countryCodes:array<string>>"
    person = "struct<computedYearsExperience:double,skills:array<struct<name:string,evidenceType:string>>,education:array<struct<level:string>>,certifications:array<struct<name:string,expiryDate:string>>,location:struct<countryCode:string>>"
    rule = lambda t, **k: {"id": 1, "label": t, "type": t, "on_missing": "flag"} | k
    who = {"computedYearsExperience": None, "skills": [{"name": "C++", "evidenceType": "listed"}], "education": [{"level": None}], "certifications": [], "location": None}
    cases = [
        (rule("min_years_experience", years=5.0), "indeterminate"),
        (rule("required_skill", skill="c++", matchMode="normalized", mustBeDemonstrated=False), "pass"),
        (rule("required_skill", skill="c++", matchMode="exact"), "fail"),
        (rule("required_skill", skill="c++", matchMode="normalized", mustBeDemonstrated=True), "fail"),
        (rule("required_education_level", level="none"), "indeterminate"),
        (rule("required_certification", name="x", matchMode="exact"), "indeterminate"),
        (rule("location_allowlist", countryCodes=["GB"]), "indeterminate"),
    ]
    df = spark.createDataFrame([(who, c, w) for c, w in cases], f"p {person}, r {kind}, w string")
    assert [r[0] for r in df.select(rules.outcome(F.col("p"), F.col("r"), F.lit(NOW)), "w").collect()] == [w for _, w in cases]
    with pytest.raises(Exception, match="unknown rule type"):
        spark.createDataFrame([(who, rule("constructor"))], f"p {person}, r {kind}").select(rules.outcome(F.col("p"), F.col("r"), F.lit(NOW))).collect()


def test_profile_fields(spark):
    assert values(spark, [" A@B.co ", "a@b", "see attached", None], profile.email) == ["a@b.co", None, None, None]
    assert values(spark, ["+44 20 7946 0000", "ext 12"], profile.phone) == ["+44 20 7946 0000", None]
    assert values(spark, ["https://www.LinkedIn.com/in/x", "notlinkedin.com/x"], profile.linkedin) == ["https://www.LinkedIn.com/in/x", None]
    assert values(spark, [7.25, -1.0, 81.0, float("nan")], profile.stated_years, "double") == [7.3, None, None, None]
    (r,) = spark.range(1).select(profile.location(*(F.lit(None).cast("string"),) * 3).alias("none"), profile.location(F.lit(" "), F.lit(None).cast("string"), F.lit("England")).alias("blank"), profile.location(F.lit("Cork "), F.lit(None).cast("string"), F.lit("ie")).alias("some")).collect()
    assert r.none is None and tuple(r.blank) == (None, None, None) and tuple(r.some) == ("Cork", None, "IE")


def test_evidence(spark):
    quotes = spark.createDataFrame([(1, "brown fox jumps over the lazy"), (2, "ox"), (3, "own fox ju"), (4, ""), (5, None), (6, "not there at all is it")], "q int, t string")
    texts = spark.createDataFrame([(1, "The quick BROWN  fox\njumps over the lazy dog"), (2, "an ox"), (3, None)], "d int, t string")
    got = evidence.contained(quotes, texts, "q", "t", "d", "t").collect()
    assert sorted(map(tuple, got)) == [(1, 1), (2, 1), (2, 2), (3, 1)]


def test_life_of_rows(spark):
    log = [(1, i, e) for i, e in enumerate(("claim", "claim", "evaluate", "finish", "retry"))] + [(2, i, e) for i, e in enumerate(("fail", "retry", "claim", "release"))]
    got = {r.k: tuple(r)[1:] for r in lifecycle.fold_transitions(spark.createDataFrame(log, "k int, n int, event string"), "k", ["n"]).collect()}
    assert got == {1: ("done", 3, 2, 0), 2: ("pending", 4, 0, 1)}
    (r,) = spark.range(1).select(lifecycle.all_terminal(F.array().cast("array<string>")), lifecycle.all_terminal(F.array(F.lit("done"), F.lit("parsing")))).collect()
    assert tuple(r) == (True, False)
    with pytest.raises(ValueError, match="direction"):
        ranking.ranked(spark.range(1).withColumn("match_score", F.lit(1.0)), "up")
    rows = spark.createDataFrame([(1, 91.5), (2, 64.9), (3, 91.5), (4, None)], "id int, match_score double")
    assert [r.id for r in ranking.ranked(rows).collect()] == [3, 1, 2, 4] and [r.id for r in ranking.ranked(rows, "asc").collect()] == [2, 3, 1, 4]


def test_replace_and_insert(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "sha string, ordinal int")
    got = ingest.insert_new(spark.createDataFrame([("b",)], "sha string"), rows, ["sha"], "ordinal").orderBy("ordinal").collect()
    assert [(r.sha, r.ordinal, r.created) for r in got] == [("a", 1, True), ("b", 2, False)]


def docx(body, types=b"wordprocessingml.document.main", names=("[Content_Types].xml", "word/document.xml")):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for n, data in zip(names, (types, body.encode()), strict=True):
            z.writestr(n, data)
    return out.getvalue()


def test_files(spark, tmp_path):
    body = "<w:p><w:r><w:t>Jane &amp;lt; D&#111;e</w:t><w:tab/><w:t xml:space='preserve'> 2019</w:t></w:r></w:p><w:p/><w:p/><w:p><w:t>a</w:t><w:br/><w:t>b</w:t><w:t/></w:p>"
    given = {
        "a.docx": docx(body), "b.txt": "﻿one\r\ntwo  ".encode(), "c.txt": "x".encode("utf-16"), "d.bin": b"a\0b", "e.bin": b"\xff\xfa\xf0", "f.bin": b"\x01\x02\x03abc",
        "g.pdf": b"junk %PDF-1.7", "h.zip": docx(body, names=("x", "y")), "i.zip": docx(body)[:60], "k.docx": docx(body, types=b"spreadsheet"), "l.txt": ("é" * 5000).encode(),
    }
    for n, data in given.items():
        (tmp_path / n).write_bytes(data)
    rows = files.extracted(files.read_files(spark, str(tmp_path)), F.lit(files.TXT)).collect()
    got = {r.path.rpartition("/")[2]: r for r in rows}
    assert got["a.docx"].text == "Jane &lt; Doe 2019\n\na\nb" and got["a.docx"].type_mismatch
    assert got["b.txt"].text == "one\ntwo" and not got["b.txt"].type_mismatch and got["c.txt"].text == "x" and got["l.txt"].reason == "ok"
    why = {n: got[n].reason for n in given if got[n].text is None}
    assert why == {"d.bin": "nul_byte", "e.bin": "invalid_utf8", "f.bin": "control_characters", "g.pdf": "pdf_unsupported", "h.zip": "not_ooxml", "i.zip": "no_end_of_central_directory", "k.docx": "other_ooxml"}
    assert files.read_text(b"") == files.read_text(None) == (None, None, "empty")
    wanted = spark.createDataFrame([(got["b.txt"].path,), ("nowhere",)], "path string")
    assert [tuple(r) for r in files.missing_files(wanted, files.read_files(spark, str(tmp_path))).collect()] == [("nowhere", "SOURCE_FILE_MISSING")]


def test_entities_and_pages(spark):
    assert values(spark, ["&amp;lt; &#x41;&#66; &nope; &#xD800; &#X41; &#; &#x; &#4g; & &quot;"], markup.decode_entities) == ['&lt; AB &nope; &#xD800; &#X41; &#; &#x; &#4g; & "']
    items = [(1, 1, 2, "b", True), (1, 1, 1, "a ", False), (1, 1, 3, None, True), (1, 2, 1, "  ", True), (1, 3, 1, "c  d", False)]
    df = spark.createDataFrame(items, "doc int, page int, seq int, s string, eol boolean")
    assert markup.assemble(df, "doc", "page", "seq", "s", "eol").first().body == "a b\n\nc d"


def test_strict_replies(spark):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("a", T.IntegerType(), False), T.StructField("b", T.StringType())])
    rows = [('```json\n{"a": 1}\n```',), ('{"a": 1, "b": "x"}',), ('{"a": 1, "c": 2}',), ("nonsense",), ('{"b": "x"}',), ('{"a": "x"}',)]
    got = replies.parse_reply(spark.createDataFrame(rows, "t string"), "t", schema).collect()
    assert [r.outcome for r in got] == ["ok", "ok", "schema_mismatch", "invalid_json", "schema_mismatch", "schema_mismatch"]
    assert values(spark, ['[{"id": 1}, {"name": "x"}]'], lambda c: replies.typed_rows(c, "id:int,name:string"))[0][1].name == "x"


def test_declared_tables(spark, tmp_path):
    tables.append(tables.empty_table(spark, "roles"), str(tmp_path), "roles")
    assert tables.read_table(spark, str(tmp_path), "roles").count() == 0
    spark.range(1).write.parquet(str(tmp_path / "candidates"))
    with pytest.raises(ValueError, match="candidates"):
        tables.read_table(spark, str(tmp_path), "candidates")


def test_long_log_is_read_in_pieces(spark):
    r = random.Random(3)
    names = [name for name, *_ in lifecycle.TRANSITIONS] + [None]
    log = [(k, t, r.choice(names)) for k, n in ((1, 3000), (2, 1), (None, 200)) for t in range(n)]
    want = {}
    for k, _, e in log:
        status, accepted, refused, attempts = want.get(k, ("pending", 0, 0, 0))
        to = next((to for name, start, to in lifecycle.TRANSITIONS if name == e and status in start), None)
        want[k] = (to or status, accepted + (to is not None), refused + (to is None), attempts + (to is not None and e == "retry"))
    r.shuffle(log)
    df = spark.createDataFrame(log, "k int, t int, event string")
    assert {x[0]: tuple(x)[1:] for x in lifecycle.fold_transitions(df, "k", ["t"], chunk=16).collect()} == want
    sizes = [x.n for x in lifecycle.chunk_maps(df, "k", ["t"], chunk=16).collect()]
    assert sum(sizes) == len(log) and max(sizes) <= 16


def test_composed_forms_and_fences(spark):
    """NFKC, ligatures and full-width digits; fences without an end; entities with many digits."""
    from screenloom.functions import dates, markup, text
    from screenloom.functions.markup import decoded

    row = spark.range(1).select(
        text.words(F.lit("Ｊava ﬁnance")).alias("words"),
        dates.parse_date(F.lit("２０２０-06")).alias("date"),
        text.holds_text(F.lit("ﬁnance"), F.lit("finance")).alias("holds"),
        text.strip_fences(F.lit('```json\n{"a": 1}')).alias("open"),
        text.strip_fences(F.lit('```\n{"a": 1}\n```')).alias("closed"),
        text.strip_fences(F.lit("no ``` fence")).alias("none"),
        markup.decode_entities(F.lit("&#x00000041;&amp;lt;&#xD800;&#9999999999;")).alias("entities"),
    ).first()
    assert row.words == ["java", "finance"] and (row.date.year, row.date.month) == (2020, 6) and row.holds
    assert (row.open, row.closed, row.none) == ('{"a": 1}', '{"a": 1}', "no ``` fence")
    assert row.entities == "A&lt;&#xD800;&#9999999999;" and decoded("&#0;") == "\0"


def test_unknown_keys_in_nested_objects(spark):
    from pyspark.sql import types as T

    from screenloom.sources.replies import parse_reply

    schema = T.StructType().add("name", "string").add("at", T.StructType().add("city", "string")).add("skills", T.ArrayType(T.StructType().add("name", "string")))
    said = ['{"name": "x", "at": {"city": "y"}, "skills": [{"name": "z"}]}', '{"name": "x", "at": {"city": "y", "zip": 1}}', '{"skills": [{"name": "z"}, {"nom": "z"}]}', '{"skills": []}', "{"]
    got = parse_reply(spark.createDataFrame([(s,) for s in said], "text string"), "text", schema).collect()
    assert [r.outcome for r in got] == ["ok", "schema_mismatch", "schema_mismatch", "ok", "invalid_json"]


def test_short_quotes_are_found_inside_words(spark):
    from screenloom.operators.evidence import contained

    texts = {1: "We ported the finance stack to C++ and SQL", 2: "Nothing of note", 3: "a sql server", 4: None}
    quotes = {1: "nanc", 2: "sql", 3: "to c", 4: "o", 5: "the finance stack to", 6: "ported the finance stack to C++ and", 7: "absent", 8: " ", 9: "e finance st"}
    got = contained(spark.createDataFrame(list(quotes.items()), "q long, quote string"), spark.createDataFrame(list(texts.items()), "t long, body string"), "q", "quote", "t", "body")
    want = {(q, t) for q, a in quotes.items() for t, b in texts.items() if b and a.strip() and a.strip().lower() in b.lower()}
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)


def test_answers_come_in_the_order_asked(spark):
    asked = spark.createDataFrame([(k, f"s{k % 3}") for k in range(9)], "ordinal long, sha string")
    answers = ingest.insert_new(spark.createDataFrame([("s1",)], "sha string"), asked, ["sha"], "ordinal")
    got = [(r.ordinal, r.sha, r.created) for r in ingest.in_order(answers, asked, ["sha"], "ordinal").collect()]
    assert got == [(k, f"s{k % 3}", k % 3 != 1) for k in range(9)]


def test_candidates_without_ratings_lack_all_criteria(spark):
    criteria = spark.createDataFrame(CRITERIA, "criterion_id int, position int, label string, weight int")
    ratings = spark.createDataFrame([(1, c, 5) for c in range(1, 7)], "id int, criterion_id int, rating int")
    got = scoring.reconcile(ratings, criteria, ["id"], everyone=spark.createDataFrame([(1,), (2,)], "id int")).collect()
    assert {r.id: (r.verdict, r.missing) for r in got} == {1: ("ok", []), 2: ("missing", [1, 2, 3, 4, 5, 6])}


def test_judging_names_what_is_wrong(spark):
    from screenloom.operators import roles

    own = spark.createDataFrame([(r, 3) for r in range(4)], "role_id int, version int")
    criteria = spark.createDataFrame([(0, 1, 60), (0, 2, 40), (1, 1, 60), (1, 2, 30), (3, 1, 100)], "role_id int, criterion_id int, weight int")
    rows = [(1, 0, 1, 10), (1, 0, 2, None), (2, 0, 1, 10), (3, 1, 1, 5), (3, 1, 2, 5), (5, 3, 1, 9), (6, 3, 1, 9), (7, 0, 1, 5), (7, 0, 1, 5), (7, 0, 2, 5), (8, 3, 1, 11), (9, 3, 1, 9)]
    ratings = spark.createDataFrame(rows, "candidate int, role_id int, criterion_id int, rating int")
    everyone = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, 2), (5, 3), (6, 3), (7, 0), (8, 3), (9, 3), (10, 0)], "candidate int, role_id int")
    reports = everyone.filter("candidate <> 9").select("candidate", (F.col("candidate") == 6).alias("eliminated"), F.when(F.col("candidate") == 6, "region").alias("eliminated_by"))
    found = scoring.reconcile(ratings, criteria, ["candidate"], scope=["role_id"], everyone=everyone)
    got = {r.candidate: (r.problem, r.score, r.tier) for r in roles.judged(ratings, found, criteria, reports, own).collect()}
    assert got == {
        1: ("invalid_rating", None, None), 2: ("missing_ratings", None, None), 3: ("weights_not_100", None, None), 4: ("no_criteria", None, None), 5: (None, 90.0, "strong_match"), 6: (None, 90.0, "unmatched"),
        7: ("duplicate_ratings", None, None), 8: ("invalid_rating", None, None), 9: ("no_report", None, None), 10: ("missing_ratings", None, None),
    }


def test_malformed_rules_stop_the_query(spark):
    from screenloom.plans.profile_plans import ROLE, RULE

    def wrong(**changed):
        names = [c.split()[0] for c in RULE.split(", ")]
        rows = [tuple(changed[n] if r[2] == changed["type"] and n in changed else v for n, v in zip(names, r, strict=True)) for r in ROLE]
        df = spark.createDataFrame(rows, RULE)
        return df.select(rules.malformed(F.struct(*df.columns)).alias("m")).filter("m IS NOT NULL").collect()

    assert wrong(type="none") == []
    cases = [("min_years_experience", "years", (None, -1.0, 61.0, 2.5)), ("required_skill", "skill", (None, " ")), ("required_skill", "matchMode", (None, "fuzzy")), ("required_skill", "mustBeDemonstrated", (None,)), ("required_education_level", "level", (None, "phd")), ("required_certification", "name", ("",)), ("location_allowlist", "countryCodes", (None, [], ["gb"], ["GB", None]))]
    for kind, field, values in cases:
        for v in values:
            assert [r.m for r in wrong(type=kind, **{field: v})] == [field]
    df = spark.createDataFrame([(*ROLE[0][:4], 99.0, *ROLE[0][5:])], RULE)
    with pytest.raises(Exception, match="malformed value of rule five years: years"):
        df.agg(F.collect_list(F.struct(*df.columns)).alias("rules")).select(F.size(rules.checked_rules(F.col("rules")))).collect()


def test_reports_with_details(spark):
    from screenloom.plans.derived import NOW
    from screenloom.plans.profile_plans import _judged

    rows = _judged(spark, "/root/testdata/sf0.001").limit(40)
    got = rows.select(rules.report(F.col("profile"), F.col("rules"), F.lit(NOW), details=True, why_no_years=F.lit("no usable employment dates")).alias("r"), "profile").collect()
    for row in got:
        assert row.r.eliminatedBy == next((x.label for x in row.r.results if x.eliminates), None) and row.r.hasIndeterminate == any(x.outcome == "indeterminate" for x in row.r.results)
        assert [x.label for x in row.r.results if x.outcome == "fail"] == row.r.failures and all(x.detail for x in row.r.results)
        skill = row.r.results[1]
        assert skill.type == "required_skill" and ("demonstrated in the CV" in skill.detail) == (skill.outcome == "pass")
        if row.profile.computedYearsExperience is None:
            assert "no usable employment dates" in row.r.results[0].detail


@pytest.mark.parametrize(
    ("said", "span"),
    [
        ("We rated Priya 8.", "rated ... 8"), ("Scores 85", "Scores 85"), ("Their rating reflects 8 years, I would score them 90 overall", "score ... 90"), ("rating: of about 77, or 80%", "80%"),
        ("a score of about 80 seems right", "score of about 80"), ("Rating:  8", "Rating:  8"), ("some 12  per  cent", "12  per  cent"), ("it is 8 / 10 or 9/10", "8 / 10"), ("on 10/10/2023", None), ("matches 4/6", None),
        ("rated " + "extraordinarily" * 4 + " 85", "rated ... 85"), ("scoring: roughly" + " " * 50 + "8", "scoring: roughly" + " " * 24),
    ],
)
def test_score_figures_are_told(spark, said, span):
    assert values(spark, [said], lambda c: text.score_figure(c)["span"]) == [span]


def test_prose_only(spark):
    assert values(spark, ["shipped 12 services", None], text.prose_only) == ["shipped 12 services", None]
    with pytest.raises(Exception, match="has rated ... 8"):
        values(spark, ["we rated Priya 8"], text.prose_only)


def test_sniffing_of_odd_bytes():
    assert files.sniff(b"x" * 1020 + b"%PDF-")[1:] == ("pdf_signature_offset", None, 1020) and files.sniff(b"%PDF-1")[3] == 0 and files.sniff(b"x" * 1024 + b"%PDF-")[0] == files.TXT
    assert [files.sniff(b)[1] for b in (b"", None, b"PK\x05\x06" + b"\0" * 18, b"PK\x07\x08PK\x03\x04")] == ["empty", "empty", "empty_archive", "spanned_archive"]
    assert files.sniff(("é" * 97 + "\x01\x02").encode())[1] == "control_characters"  # 2 of 99 characters, but of 196 bytes
    assert files.sniff(b"\xef\xbb\xbf" + b"a" * 8191 + "é".encode())[1] == "utf8_bom" and files.sniff(b"\xef\xbb\xbf")[1] == "utf8_bom"


def test_lines_of_word_documents():
    xml = '<w:p><w:r><w:t xml:space="preserve">a &amp; b</w:t><w:tab/><w:t>c<x/>d</w:t><w:t/><w:tabs><w:tab w:val="x"/></w:tabs></w:r><w:br w:type="page"/><w:t >e</w:t></w:p><w:p/><w:p /><w:p w:x="1"/><w:cr/>f<w:t>open'
    assert files.word_lines(xml) == ["a & b c<x/>d ", "e", "", "", "", ""]
    assert files.word_lines("") == [""] and files.word_lines("<") == [""] and files.word_lines("<w:t>a</w:t>") == ["a"]


def test_sizes_round_ties_to_the_even_digit(spark):
    # 262144 * 1237 bytes are 309.25 MB; Java would make 309.3 of it
    assert values(spark, [262144 * 1237, 262144 * 1239, 1024 + 256, 1024 + 768, 5], display.bytes_text, "long") == ["309.2 MB", "309.8 MB", "1.2 KB", "1.8 KB", "5 B"]


def test_rules_are_judged_once_and_on_all_cores(spark):
    from screenloom.plans.profile_plans import _judged

    rows = _judged(spark, "/root/testdata/sf0.001")
    assert rows.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism  # one file, a few KB
    got = rows.select(rules.report(F.col("profile"), F.col("rules"), F.lit(NOW)).alias("r")).select("r.eliminated", "r.eliminatedBy", "r.failures", "r.hasIndeterminate")
    assert got._jdf.queryExecution().optimizedPlan().toString().count("unknown rule type") == 1


def test_names_are_composed_beside_lists_in_ascii_and_null_ones(spark):
    rows = spark.createDataFrame([(0, [("ﬁn",), (None,)]), (1, [("b",)]), (2, None), (3, [])], "i int, x array<struct<name:string>>")
    got = rows.orderBy("i").select(text.composed_names(F.col("x")).alias("x")).collect()
    assert [r["x"] if r["x"] is None else [e["name"] for e in r["x"]] for r in got] == [["fin", None], ["b"], None, []]


def test_batches_of_texts_are_small_unless_the_session_says(spark):
    from screenloom.plans import derived

    keys = list(tables.BATCHES)
    for key in keys:
        spark.conf.unset(key)
    sizes = F.pandas_udf(lambda x: x * 0 + len(x), "long", F.PandasUDFType.SCALAR)
    try:
        derived.load(spark, "/root/testdata/sf0.001", "documents")
        rows = spark.range(5000, numPartitions=1)
        assert rows.select(sizes("id").alias("n")).agg(F.max("n")).first()[0] == 1000
        wide = spark.range(100, numPartitions=1).select(F.repeat(F.lit("x"), 1 << 20).alias("t"))
        lengths = F.pandas_udf(lambda t: t.str.len() * 0 + len(t), "long", F.PandasUDFType.SCALAR)
        assert wide.select(lengths("t").alias("n")).agg(F.max("n")).first()[0] < 10
        spark.conf.set(keys[0], "77")
        derived.load(spark, "/root/testdata/sf0.001", "documents")
        assert spark.conf.get(keys[0]) == "77"
    finally:
        for key in keys:
            spark.conf.unset(key)


def test_profiles_are_walked_on_all_cores(spark):
    from screenloom.plans.profile_plans import wire_profiles

    rows = wire_profiles(spark, "/root/testdata/sf0.001")  # one file, a few KB
    assert rows.select("person", profile.normalised(F.col("wire")).alias("n")).rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism


def test_candidates_are_judged_without_lists_and_ratings_are_not_shuffled(spark):
    from screenloom.plans import role_plans

    plan = role_plans.judged_candidates(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    assert not [x for x in lines if "ObjectHashAggregate(keys=[candidate" in x]
    assert not [x for x in lines if "Exchange hashpartitioning(candidate" in x and "criterion_id" in x]
    assert not [x for x in lines if "BroadcastHashJoin [candidate" in x or "BroadcastHashJoin [person" in x]  # orders would go through the driver


def test_sums_of_reconciled_ratings_are_those_of_the_ratings(spark):
    from screenloom.operators import roles

    own = spark.createDataFrame([(r, 3) for r in range(4)], "role_id int, version int")
    criteria = spark.createDataFrame([(0, 1, 60), (0, 2, 40), (1, 1, 60), (1, 2, 30), (3, 1, 100)], "role_id int, criterion_id int, weight int")
    rows = [(1, 0, 1, 10), (1, 0, 2, None), (2, 0, 1, 10), (3, 1, 1, 5), (3, 1, 2, 5), (5, 3, 1, 9), (5, 3, 7, 99), (6, 3, 7, 1), (6, 3, 7, 1), (7, 0, None, 5), (7, 0, None, 5), (7, 0, 1, 5), (7, 0, 2, 5), (8, 3, 1, 11), (9, 3, 1, None)]
    ratings = spark.createDataFrame(rows, "candidate int, role_id int, criterion_id int, rating int")
    everyone = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, 2), (5, 3), (6, 3), (7, 0), (8, 3), (9, 3), (10, 0)], "candidate int, role_id int")
    reports = everyone.withColumn("eliminated", F.lit(False)).withColumn("eliminated_by", F.lit(None).cast("string"))
    found = scoring.reconcile(ratings, criteria, ["candidate"], scope=["role_id"], everyone=everyone, scored=True)
    lists = {r.candidate: (r.verdict, bool(r.duplicates), bool(r.missing)) for r in found.collect()}
    assert all(v == ("duplicate" if d else "missing" if m else "ok") for v, d, m in lists.values()) and {v for v, _, _ in lists.values()} == {"duplicate", "missing", "ok"}
    once, apart = roles.judged(None, found, criteria, reports, own), roles.judged(ratings, found.drop("raw", "valid"), criteria, reports.drop("role_id"), own)
    got = {r.candidate: r for r in once.collect()}
    assert got == {r.candidate: r for r in apart.collect()} and len(got) == 10
    assert [got[c].problem for c in (1, 5, 6, 7, 8, 9)] == ["invalid_rating", None, "duplicate_ratings", None, "invalid_rating", "invalid_rating"] and (got[5].score, got[7].score) == (90.0, 50.0)


def test_lines_of_words_in_ascii_are_those_of_all_texts(spark):
    said = ["", " ", "C++ and\tC#", "--Node.js--", "a​b ​", "Ünder  ground", "x\x00y_z", "\x1f7 Of 9\r\n", None, "ΑΣ ΣΑ", "1+1=2"]
    want = values(spark, said, lambda c: F.concat(F.lit(" "), F.array_join(text.words(c, compose=False), " "), F.lit(" ")))
    assert values(spark, said, text.line) == want


def test_eliminations_are_those_of_reports(spark):
    from screenloom.plans.profile_plans import ROLE, RULE

    odd = [(*ROLE[1][:3], "eliminate", *ROLE[1][4:]), (*ROLE[3][:3], None, *ROLE[3][4:]), (6, None, *ROLE[4][2:])]
    own = spark.createDataFrame([*ROLE[:1], *odd], RULE)
    role = own.agg(F.collect_list(F.struct(*own.columns)).alias("rules")).withColumn("rules", rules.readable_rules(F.col("rules")))
    held, lapsed = [("Cloud  Architect", None)], [("Ｃloud Architect", "１９９５-12"), (None, "x")]
    skills = [("ＰｏｓｔｇｒｅＳＱＬ 15", "demonstrated"), (None, None)]
    rows = [(i, (y, s, None, c, (w,))) for i, (y, s, c, w) in enumerate([(9.0, skills, held, "gb"), (None, skills, lapsed, "GB"), (1.0, [], None, None), (None, None, [], "US"), (7.5, [("PostgreSQL", "listed")], held, " ie ")])]
    people = spark.createDataFrame(rows, "i int, profile struct<computedYearsExperience:double,skills:array<struct<name:string,evidenceType:string>>,education:array<struct<level:string>>,certifications:array<struct<name:string,expiryDate:string>>,location:struct<countryCode:string>>")
    judged = people.withColumn("profile", rules.readable(F.col("profile"))).crossJoin(role)
    both = judged.select("i", "profile", rules.report(F.col("profile"), F.col("rules"), F.lit(NOW)).alias("r"), rules.elimination(F.col("profile"), F.col("rules"), F.lit(NOW)).alias("e")).orderBy("i").collect()
    assert [(b.e.eliminated, b.e.eliminatedBy) for b in both] == [(b.r.eliminated, b.r.eliminatedBy) for b in both]
    assert [[x.outcome for x in b.r.results] for b in both] == [["pass"] * 4, ["indeterminate", "pass", "fail", "pass"], ["fail", "indeterminate", "indeterminate", "indeterminate"], ["indeterminate", "indeterminate", "indeterminate", "fail"], ["pass", "fail", "pass", "pass"]]
    assert [c.name for c in both[1].profile.certifications] == ["Cloud Architect", None] and both[1].profile.certifications[0].expiryDate == "1995-12" and both[2].profile.certifications is None
    with pytest.raises(Exception, match="unknown rule type"):
        judged.withColumn("rules", F.transform("rules", lambda r: r.withField("type", F.when(r["id"] == 6, "none").otherwise(r["type"])))).select(rules.elimination(F.col("profile"), F.col("rules"), F.lit(NOW))).collect()

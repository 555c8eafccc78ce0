"""Uploads, record sets, roles as they are sent in, profiles as they come, and what failures mean."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from screenloom.functions import profile
from screenloom.operators import failures, uploads, validation
from screenloom.sources import replies, tables


def upload(spark, files, requests, existing=(), max_files=3):
    rows = spark.createDataFrame([(r, o, f"{o}.txt", f"in/{r}/{o}", c) for r, o, c in files], "request int, ordinal int, filename string, path string, content binary")
    roles = spark.createDataFrame([(1, False, 2), (2, True, 2), (3, False, 0)], "role_id int, archived boolean, n_criteria int")
    looked = uploads.looked_at(rows)
    gated = uploads.gate(spark.createDataFrame(requests, "request int, role_id int"), roles, looked, max_files)
    have = spark.createDataFrame(list(existing), "role_id int, content binary").select("role_id", F.sha2("content", 256).alias("sha"))
    return rows, gated, uploads.dispositions(looked, gated, have)


def test_one_bad_file_refuses_its_request(spark, tmp_path):
    files = [(1, 1, b"one"), (1, 2, b"a\0b"), (2, 3, b"two"), (2, 4, b"two"), (2, 5, b"old"), (3, 6, b"two"), (4, 7, b"x"), (5, 8, b"x"), (6, 9, b"x"), (7, 10, b"1"), (7, 11, b"2"), (7, 12, b"3"), (7, 13, b"4"), (9, 14, b"")]
    rows, gated, got = upload(spark, files, [(1, 1), (2, 1), (3, 1), (4, 2), (5, 3), (6, 9), (7, 1), (8, 1), (9, 1)], [(1, b"old"), (1, b"old")])
    assert {r.request: r.error for r in gated.collect()} == {1: "UNSUPPORTED_FILE_TYPE", 2: None, 3: None, 4: "ROLE_ARCHIVED", 5: "ROLE_NOT_SCOREABLE", 6: "ROLE_NOT_FOUND", 7: "TOO_MANY_FILES", 8: "EMPTY_UPLOAD", 9: "UNSUPPORTED_FILE_TYPE"}
    said = {r.ordinal: r.disposition for r in got.collect()}
    assert said == {1: "refused", 2: "refused", 3: "created", 4: "redundant", 5: "duplicate", 6: "duplicate", **dict.fromkeys(range(7, 15), "refused")}
    for _ in range(2):  # a batch that is run again takes its own place
        orphans = {r.path for r in uploads.commit(rows, got, str(tmp_path), 4).collect()}
        stored = spark.read.parquet(str(tmp_path)).collect()
        assert [(r.ordinal, bytes(r.content), r.batch) for r in stored] == [(3, b"two", 4)] and len(orphans) == 13 and "in/2/3" not in orphans


def test_record_sets(spark):
    said = [{"label": "a", "weight": "30", "more": {"x": [1]}}, {"description": None, "weight": 2, "position": 7}, {}]
    rows = spark.createDataFrame([(1, json.dumps(said)), (2, "[]"), (3, None)], "role_id int, body string")
    columns = "label string, description string, weight int, position int"
    got = replies.record_set(rows, "body", columns, tables.DEFAULTS["role_criteria"]).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == [(1, 0, "a", "", 30, None), (1, 1, None, "", 2, 7), (1, 2, None, "", None, None)]
    for bad in ('[{"weight": "many"}]', '{"label": ', "word"):
        with pytest.raises(Exception):  # noqa: B017, PT011
            replies.record_set(spark.createDataFrame([(1, bad)], "role_id int, body string"), "body", columns).collect()


def test_failures(spark):
    cases = {
        ("timeout", None, None, None): ("timeout", "AGENT_TIMEOUT", True, None),
        ("api", 529, None, None): ("server", "AGENT_UPSTREAM", True, None),
        ("api", 404, None, "schema too deep"): ("unknown", "AGENT_UPSTREAM", False, None),
        ("api", 400, "context_window_exceeded", "schema too deep"): ("bad_request", "AGENT_INPUT_TOO_LARGE", False, None),
        ("api", 400, None, "Schema is far too deep"): ("bad_request", "AGENT_SCHEMA_REJECTED", False, "schema_unsupported"),
        ("api", 400, None, "schema " + "x" * 79 + " too deep"): ("bad_request", "AGENT_UPSTREAM", False, None),
        ("api", 400, None, "grammar compilation"): ("bad_request", "AGENT_UPSTREAM", False, None),
        (None, None, None, None): ("unknown", "AGENT_UPSTREAM", False, None),
    }
    rows = spark.createDataFrame([(i, *k) for i, k in enumerate(cases)], "i int, thrown string, status int, type string, message string")
    got = rows.select("i", failures.call_failure(*(F.col(c) for c in ("thrown", "status", "type", "message"))).alias("f")).collect()
    assert [tuple(r.f) for r in sorted(got)] == list(cases.values())


def test_what_a_row_tells_of_a_failure(spark):
    rows = spark.createDataFrame([("AGENT_TIMEOUT", True, "slow"), ("AGENT_REFUSED", None, None), ("UNSUPPORTED_FILE_TYPE", True, "no"), ("ECONNRESET", False, "password=x"), (None, None, "y")], "code string, again boolean, message string")
    got = rows.select(failures.candidate_failure(F.col("code"), F.col("again"), F.col("message")).alias("f")).collect()
    generic = failures.GENERIC
    assert [tuple(r.f) for r in got] == [("AGENT_TIMEOUT", "slow", True), ("AGENT_REFUSED", generic, False), ("EXTRACTION_FAILED", "no", False), ("EXTRACTION_FAILED", generic, True), ("EXTRACTION_FAILED", generic, True)]
    waits = spark.createDataFrame([(429, "12"), (429, "-1"), (429, "soon"), (429, None), (None, "5"), (429, "Infinity")], "status int, header string")
    assert [r.w for r in waits.select(failures.retry_after(F.col("status"), F.col("header")).alias("w")).collect()] == [12.0, None, None, None, None, None]


def test_bodies_without_lists(spark):
    kind = "title string, description string, criteria array<struct<label:string,description:string,weight:int>>, rules array<struct<label:string,type:string,on_missing:string,years:double,skill:string,matchMode:string,mustBeDemonstrated:boolean,level:string,name:string,countryCodes:array<string>>>"
    fine = [("a", None, 100)]
    df = spark.createDataFrame([("x", None, None, None), ("x", "d" * 10_001, fine, []), ("x", "", [("a", "", None)], None), ("x", "", fine, None), (None, "", fine * 51, None)], kind)
    got = df.select(validation.body_problems(F.struct(*df.columns)).alias("p")).collect()
    assert [[tuple(x) for x in r.p] for r in got[:4]] == [[("criteria", "number")], [("description", "length")], [("criteria[0].weight", "range")], []]
    assert [tuple(x) for x in got[4].p] == [("title", "length"), ("criteria", "number")]
    pages = spark.createDataFrame([(None, None), ("0", "101"), ("2", "100"), ("x", "-1"), ("9999999999", " 5")], "page string, size string")
    assert [r.p for r in pages.select(validation.page_problems(F.col("page"), F.col("size")).alias("p")).collect()] == [[], ["page", "page_size"], [], ["page", "page_size"], ["page", "page_size"]]


def test_profiles_keep_what_is_absent_apart(spark):
    said = [
        {"skills": [], "email": " A@B.org ", "locationCity": " "},
        {"skills": [{"name": "Ｇo", "evidenceType": "listed", "evidenceQuote": "q"}, {"name": " ", "evidenceType": "demonstrated"}, {"name": "go", "evidenceType": "demonstrated", "evidenceQuote": " wrote  Go "}], "workHistory": [{"title": " "}, {}], "statedYearsExperience": 99},
        {},
    ]
    rows = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(said)], "i int, j string")
    got = rows.select("i", profile.normalised(F.from_json("j", profile.wire_schema())).alias("n")).collect()
    one, two, three = (r.n for r in sorted(got, key=lambda r: r.i))
    assert one.profile.email == "a@b.org" and one.profile.skills == [] and one.profile.education is None and one.changes == []
    assert one.profile.location.asDict() == {"city": None, "region": None, "countryCode": None} and three.profile.location is None and three.profile.skills is None
    assert [tuple(s) for s in two.profile.skills] == [("Ｇo", "demonstrated", "wrote Go")] and len(two.profile.workHistory) == 2
    assert [tuple(c) for c in two.changes] == [
        ("statedYearsExperience", "nulled_invalid", "implausible"), ("workHistory[0].title", "nulled_empty", None), ("skills[0].evidenceQuote", "nulled_invalid", "quote_without_demonstration"),
        ("skills[1]", "dropped_entry", "blank_name"), ("skills[2]", "deduplicated", None),
    ]

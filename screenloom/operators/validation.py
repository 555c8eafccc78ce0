"""Checks of what comes in, and tables that translate codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .rules import RULES, malformed
from .scoring import POTENTIAL, POTENTIAL_MATCH, STRONG, STRONG_MATCH, UNMATCHED, WEIGHT_SUM

#: Error codes and the status each stands for.
STATUS_OF_CODE = {
    "VALIDATION_FAILED": 400, "EMPTY_UPLOAD": 400, "ROLE_NOT_FOUND": 404, "CANDIDATE_NOT_FOUND": 404, "JOB_NOT_FOUND": 404, "NOT_FOUND": 404,
    "UPLOAD_TOKEN_INVALID": 403, "ROLE_ARCHIVED": 409, "ROLE_NOT_SCOREABLE": 409, "CANDIDATE_NOT_RETRYABLE": 409, "SOURCE_FILE_MISSING": 410,
    "FILE_TOO_LARGE": 413, "TOO_MANY_FILES": 413, "UNSUPPORTED_FILE_TYPE": 415, "WEIGHTS_MUST_SUM_TO_100": 422, "DUPLICATE_CRITERION_LABEL": 422,
    "RATE_LIMITED": 429, "STORAGE_WRITE_FAILED": 500, "INTERNAL_ERROR": 500, "DEPENDENCY_UNAVAILABLE": 503,
}
#: Poll intervals in ms after a minute, two and three without a change.
POLL_LADDER, POLL_STEP = (8000, 20000, 30000), 60_000


def split_list(c: Column) -> Column:
    """The items of a comma-separated parameter, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")


def list_problem(items: Column, known: tuple[str, ...], most: int) -> Column:
    """Why a list parameter is refused; null if it isn't."""
    return F.when(~F.size(items).between(1, most), "wrong_number").when(F.size(F.array_except(items, F.array(*map(F.lit, known)))) > 0, "unknown_value")


def role_problems(title: Column, criteria: Column) -> Column:
    """What is wrong with a role, in reading order; empty if nothing. criteria: structs of label and weight."""
    labels = F.transform(criteria, lambda c: F.lower(F.trim(c["label"])))
    weights = F.aggregate(criteria, F.lit(0).cast("long"), lambda a, c: a + c["weight"])
    return F.array_compact(
        F.array(
            F.when(~F.length(F.trim(title)).between(1, 200), "title"),
            F.when(~F.size(criteria).between(1, 50), "number_of_criteria"),
            F.when(F.exists(criteria, lambda c: ~F.length(F.trim(c["label"])).between(1, 120)), "label"),
            F.when(F.exists(criteria, lambda c: ~c["weight"].between(1, 100)), "weight"),
            F.when(weights != WEIGHT_SUM, "WEIGHTS_MUST_SUM_TO_100"),
            F.when(F.size(F.array_distinct(labels)) < F.size(labels), "DUPLICATE_CRITERION_LABEL"),
        )
    )


#: For texts the least and most characters, for lists the entries, of a role as it is sent in.
BODY = {"title": (1, 200), "description": (0, 10_000), "criteria": (1, 50), "criteria.label": (1, 120), "criteria.description": (0, 2_000), "criteria.weight": (1, 100), "rules": (0, 50), "rules.label": (1, 200)}
ON_MISSING = ("flag", "eliminate")


def body_problems(body: Column) -> Column:
    """What is wrong with a role as it is sent in: structs of path (such as criteria[2].label) and code, in reading
    order; empty if nothing is. body: a struct of title, description, criteria (label, description, weight) and rules (label, type,
    on_missing and the fields of rule values). Sums and repeated labels are looked at once everything else is right.

    Absent descriptions, rules and on_missing have defaults and are fine."""
    problem = lambda bad, path, code: F.when(bad, F.struct((F.lit(path) if isinstance(path, str) else path).alias("path"), F.lit(code).alias("code")))
    within = lambda n, name: F.coalesce(n.between(*BODY[name]), F.lit(False))
    text = lambda c, name: ~(within(F.length(F.trim(c)), name) | (c.isNull() & F.lit(BODY[name][0] == 0)))
    listed = lambda checks: F.array_compact(F.array(*checks))
    place = lambda name, i, field: F.concat(F.lit(f"{name}["), i.cast("string"), F.lit(f"].{field}"))

    def criterion(c: Column, i: Column) -> Column:
        at = lambda field: place("criteria", i, field)
        return listed((problem(text(c["label"], "criteria.label"), at("label"), "length"), problem(text(c["description"], "criteria.description"), at("description"), "length"), problem(~within(c["weight"], "criteria.weight"), at("weight"), "range")))

    def rule(r: Column, i: Column) -> Column:
        at = lambda field: place("rules", i, field)
        unknown = ~F.coalesce(r["type"].isin(*RULES), F.lit(False))
        wrong = malformed(r)
        return listed(
            (
                problem(text(r["label"], "rules.label"), at("label"), "length"),
                problem(unknown, at("type"), "unknown_value"),
                problem(~unknown & wrong.isNotNull(), F.concat(at("value."), wrong), "malformed"),
                problem(~F.coalesce(r["on_missing"], F.lit(ON_MISSING[0])).isin(*ON_MISSING), at("on_missing"), "unknown_value"),
            )
        )

    criteria, rules = body["criteria"], body["rules"]
    none = F.array().cast("array<struct<path:string,code:string>>")
    many = lambda entries, one: F.coalesce(F.flatten(F.transform(entries, one)), none)
    first = F.concat(
        listed((problem(text(body["title"], "title"), "title", "length"), problem(text(body["description"], "description"), "description", "length"), problem(~within(F.coalesce(F.size(criteria), F.lit(0)), "criteria"), "criteria", "number"))),
        many(criteria, criterion),
        listed((problem(~within(F.coalesce(F.size(rules), F.lit(0)), "rules"), "rules", "number"),)),
        many(rules, rule),
    )
    labels = F.transform(criteria, lambda c: F.lower(F.trim(c["label"])))
    total = F.aggregate(criteria, F.lit(0).cast("long"), lambda a, c: a + c["weight"])
    again = F.transform(labels, lambda label, i: problem(F.array_position(labels, label) <= i, place("criteria", i, "label"), "DUPLICATE_CRITERION_LABEL"))
    later = F.concat(listed((problem(total != WEIGHT_SUM, "criteria", "WEIGHTS_MUST_SUM_TO_100"),)), F.array_compact(again))
    return F.when(F.size(first) > 0, first).otherwise(later)


def page_problems(page: Column, size: Column) -> Column:
    """What is wrong with the parameters of a page; they are text, and absent ones have defaults."""
    whole = lambda c, least, most: c.isNull() | F.coalesce(c.rlike("^[0-9]{1,9}$") & c.try_cast("int").between(least, most), F.lit(False))
    return F.array_compact(F.array(F.when(~whole(page, 1, 999_999_999), "page"), F.when(~whole(size, 1, 100), "page_size")))


def file_problems(size: Column, mime: Column, accepted: tuple[str, ...], max_bytes: int) -> Column:
    """What is wrong with a file; a type that isn't stated is nothing wrong."""
    return F.array_compact(F.array(F.when(size > max_bytes, "too_large"), F.when(size == 0, "empty"), F.when((mime != "") & ~mime.isin(*accepted), "wrong_type")))


def failure_of(code: Column, known: tuple[str, ...]) -> Column:
    """struct<code, retryable>: what a failed row stores. An unsupported type is an extraction that
    failed for good; a code that isn't known, one that may be tried again."""
    failed = F.lit("EXTRACTION_FAILED")
    stored = F.when(code.isin(*known) & (code != "UNSUPPORTED_FILE_TYPE"), code).otherwise(failed)
    again = F.when(code == "UNSUPPORTED_FILE_TYPE", F.lit(False)).otherwise(~F.coalesce(code.isin(*known), F.lit(False)))
    return F.struct(stored.alias("code"), again.alias("retryable"))


def status_of(code: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in STATUS_OF_CODE.items() for x in pair))
    return F.coalesce(F.try_element_at(table, F.coalesce(code, F.lit(""))), F.lit(STATUS_OF_CODE["INTERNAL_ERROR"]))


def poll_interval(base_ms: Column, since_change_ms: Column) -> Column:
    """The interval climbs the ladder while nothing changes, and is never below its base."""
    steps = F.floor(since_change_ms / POLL_STEP).cast("int")
    rung = F.element_at(F.array(*map(F.lit, POLL_LADDER)), F.greatest(F.lit(1), F.least(steps, F.lit(len(POLL_LADDER)))))
    return F.when(steps <= 0, base_ms).otherwise(F.greatest(base_ms, rung))


def tier_legend(spark: SparkSession) -> DataFrame:
    rows = [
        (STRONG_MATCH, f"{STRONG} to 100"),
        (POTENTIAL_MATCH, f"{POTENTIAL} up to but not including {STRONG}"),
        (UNMATCHED, f"below {POTENTIAL}, or eliminated at any score"),
    ]
    return spark.createDataFrame(rows, "tier string, range string")

"""Elimination rules with three outcomes: pass, fail, and indeterminate where a fact is missing.

A rule is a struct of type, value fields and on_missing. RULES maps a type to a function of
(profile, rule, now) to an outcome; a type that isn't there stops the query.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from screenloom.functions.dates import is_expired
from screenloom.functions.text import composed_lists, composed_names, folded, let, line

PASS, FAIL, INDETERMINATE = "pass", "fail", "indeterminate"
#: The ladder of education, lowest first.
EDUCATION = ("none", "high_school", "associate", "bachelors", "masters", "doctorate")
MATCH_MODES = ("exact", "normalized")


def passes(c: Column) -> Column:
    return F.when(c, F.lit(PASS)).otherwise(F.lit(FAIL))


def unless_missing(missing: Column, outcome: Column) -> Column:
    return F.when(missing, F.lit(INDETERMINATE)).otherwise(outcome)


def no_entries(entries: Column) -> Column:
    """No list and an empty list are both no evidence."""
    return entries.isNull() | (F.size(entries) == 0)


def same_name(sought: Column, mode: Column, body) -> Column:
    """body(same), where same(name) is whether a name is the one sought, whose own form is made once for all names."""
    exact = mode == "exact"
    form = F.when(exact, folded(sought)).otherwise(F.nullif(line(sought), F.lit("  ")))
    return let(form, lambda form: body(lambda name: F.coalesce(F.when(exact, folded(name) == form).otherwise(F.contains(line(name), form)), F.lit(False))))


def min_years(profile: Column, rule: Column, now: Column) -> Column:
    years = profile["computedYearsExperience"]
    return unless_missing(years.isNull(), passes(years >= rule["years"]))


def demonstrated(skill: Column) -> Column:
    return F.coalesce(skill["evidenceType"] == "demonstrated", F.lit(False))


def required_skill(profile: Column, rule: Column, now: Column) -> Column:
    listed = ~F.coalesce(rule["mustBeDemonstrated"], F.lit(False))
    found = same_name(rule["skill"], rule["matchMode"], lambda same: F.exists(profile["skills"], lambda s: (listed | demonstrated(s)) & same(s["name"])))
    return unless_missing(no_entries(profile["skills"]), passes(found))


def rank_of(level: Column) -> Column:
    """Place on the ladder from 1; 0 if it isn't on it."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, EDUCATION)), level), F.lit(0))


def required_education(profile: Column, rule: Column, now: Column) -> Column:
    highest = F.coalesce(F.array_max(F.transform(profile["education"], lambda e: rank_of(e["level"]))), F.lit(0))
    return unless_missing(no_entries(profile["education"]) | (highest == 0), passes(highest >= rank_of(rule["level"])))


def required_certification(profile: Column, rule: Column, now: Column) -> Column:
    current = same_name(rule["name"], rule["matchMode"], lambda same: F.exists(profile["certifications"], lambda c: same(c["name"]) & ~is_expired(c["expiryDate"], now, compose=False)))
    return unless_missing(no_entries(profile["certifications"]), passes(current))


def location_allowlist(profile: Column, rule: Column, now: Column) -> Column:
    code = F.upper(F.trim(profile["location"]["countryCode"]))
    return unless_missing(F.coalesce(code, F.lit("")) == "", passes(F.array_contains(rule["countryCodes"], code)))


RULES = {
    "min_years_experience": min_years,
    "required_skill": required_skill,
    "required_education_level": required_education,
    "required_certification": required_certification,
    "location_allowlist": location_allowlist,
}


def readable(profile: Column) -> Column:
    """The profile with what rules compare in NFKC. outcome() and report() take it so."""
    each = lambda entries, field: F.transform(profile[entries], lambda e: e[field])
    beyond, (skills, names, dates) = composed_lists(each("skills", "name"), each("certifications", "name"), each("certifications", "expiryDate"))
    put = lambda entries, field, values: F.zip_with(entries, values, lambda e, v: e.withField(field, v))
    composed = profile.withField("skills", put(profile["skills"], "name", skills)).withField("certifications", put(put(profile["certifications"], "name", names), "expiryDate", dates))
    return F.when(beyond, composed).otherwise(profile)


def readable_rules(rules: Column) -> Column:
    return composed_names(composed_names(rules, "skill"), "name")


def malformed(rule: Column) -> Column:
    """What is wrong with the value of a rule of a known type, as the name of the field; null if nothing."""
    blank = lambda c: F.coalesce(F.length(F.trim(c)) == 0, F.lit(True))
    unlike = lambda c, *values: ~F.coalesce(c.isin(*values), F.lit(False))
    years = ~F.coalesce(rule["years"].between(0, 60) & (rule["years"] == F.floor(rule["years"])), F.lit(False))
    codes = F.coalesce(F.forall(rule["countryCodes"], lambda c: F.coalesce(c.rlike("^[A-Z]{2}$"), F.lit(False))) & (F.size(rule["countryCodes"]) > 0), F.lit(False))
    mode = F.when(unlike(rule["matchMode"], *MATCH_MODES), "matchMode")
    checks = (
        F.when(years, "years"),
        F.coalesce(F.when(blank(rule["skill"]), "skill"), mode, F.when(rule["mustBeDemonstrated"].isNull(), "mustBeDemonstrated")),
        F.when(unlike(rule["level"], *EDUCATION), "level"),
        F.coalesce(F.when(blank(rule["name"]), "name"), mode),
        F.when(~codes, "countryCodes"),
    )
    out = F.lit(None).cast("string")
    for name, check in zip(RULES, checks, strict=True):
        out = F.when(rule["type"] == name, check).otherwise(out)
    return out


def checked_rules(rules: Column) -> Column:
    """The rules; one of an unknown type or with a malformed value stops the query."""

    def wrong(r: Column) -> Column:
        unknown = F.when(~F.coalesce(r["type"].isin(*RULES), F.lit(False)), F.concat(F.lit("unknown rule type: "), F.coalesce(r["type"], F.lit("null"))))
        return F.coalesce(unknown, F.concat(F.lit("malformed value of rule "), F.coalesce(r["label"], F.lit("null")), F.lit(": "), malformed(r)))

    first = F.get(F.filter(F.transform(rules, wrong), lambda w: w.isNotNull()), F.lit(0))
    return F.when(first.isNull(), rules).otherwise(F.raise_error(first).cast("void"))


def outcome(profile: Column, rule: Column, now: Column) -> Column:
    """`profile` as readable() makes it, and a rule of readable_rules()."""
    out = F.raise_error(F.concat(F.lit("unknown rule type: "), F.coalesce(rule["type"], F.lit("null")))).cast("string")
    for name, evaluate in RULES.items():
        out = F.when(rule["type"] == name, evaluate(profile, rule, now)).otherwise(out)
    return out


def quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), c, F.lit('"'))


def said(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def detail(profile: Column, rule: Column, now: Column, why_no_years: Column | None = None) -> Column:
    """Why a rule has the outcome it has, in words. Both as for outcome(); why_no_years may say why
    the years aren't known. Fixed values: the sentences, which readers see."""
    years = F.regexp_replace(rule["years"].cast("string"), r"\.0$", "")
    known = F.regexp_replace(profile["computedYearsExperience"].cast("string"), r"\.0$", ".0")
    unknown = said("years of experience could not be determined from the CV", *([": ", why_no_years] if why_no_years is not None else []), " (rule asks for ", years, " years)")
    min_years_said = F.when(profile["computedYearsExperience"].isNull(), unknown).otherwise(said(known, " years computed from dates, minimum ", years))

    found = same_name(rule["skill"], rule["matchMode"], lambda same: F.filter(profile["skills"], lambda s: same(s["name"])))
    shown = F.get(F.filter(found, demonstrated), F.lit(0))["name"]
    first = F.get(found, F.lit(0))["name"]
    skill_said = (
        F.when(no_entries(profile["skills"]), said("no skills were extracted, so ", quoted(rule["skill"]), " could not be checked"))
        .when(F.size(found) == 0, said("no skill matching ", quoted(rule["skill"])))
        .when(~F.coalesce(rule["mustBeDemonstrated"], F.lit(False)), said("skill ", quoted(first), " is listed"))
        .when(shown.isNull(), said("skill ", quoted(first), " is listed but never shown being used"))
        .otherwise(said("skill ", quoted(shown), " is demonstrated in the CV"))
    )

    highest = F.coalesce(F.array_max(F.transform(profile["education"], lambda e: rank_of(e["level"]))), F.lit(0))
    education_said = (
        F.when(no_entries(profile["education"]), said("no education was extracted, so ", quoted(rule["level"]), " could not be checked"))
        .when(highest == 0, "education is listed but none of it maps to a known level")
        .otherwise(said("highest education ", F.get(F.array(*map(F.lit, EDUCATION)), (highest - 1).cast("int")), ", minimum ", rule["level"]))
    )

    held = same_name(rule["name"], rule["matchMode"], lambda same: F.filter(profile["certifications"], lambda c: same(c["name"])))
    current = F.get(F.filter(held, lambda c: ~is_expired(c["expiryDate"], now, compose=False)), F.lit(0))["name"]
    lapsed = F.get(held, F.lit(0))
    certification_said = (
        F.when(no_entries(profile["certifications"]), said("no certifications were extracted, so ", quoted(rule["name"]), " could not be checked"))
        .when(F.size(held) == 0, said("no certification matching ", quoted(rule["name"])))
        .when(current.isNull(), said("certification ", quoted(lapsed["name"]), " expired on ", lapsed["expiryDate"]))
        .otherwise(said("certification ", quoted(current), " is held"))
    )

    code, allowed = F.upper(F.trim(profile["location"]["countryCode"])), F.array_join(rule["countryCodes"], ", ")
    location_said = (
        F.when(F.coalesce(code, F.lit("")) == "", said("no country could be determined from the CV (allowed: ", allowed, ")"))
        .when(F.array_contains(rule["countryCodes"], code), said("location ", code, " is allowed"))
        .otherwise(said("location ", code, " is not in ", allowed))
    )
    sentences = dict(zip(RULES, (min_years_said, skill_said, education_said, certification_said, location_said), strict=True))
    out = F.lit(None).cast("string")
    for name, sentence in sentences.items():
        out = F.when(rule["type"] == name, sentence).otherwise(out)
    return out


def eliminates(result: Column, on_missing: Column) -> Column:
    return result.isin(F.lit(FAIL), F.when(on_missing == "eliminate", F.lit(INDETERMINATE)))


def elimination(profile: Column, rules: Column, now: Column) -> Column:
    """struct<eliminated, eliminatedBy> as in report(), of which only these two are made. All rules are judged."""
    fatal = F.filter(rules, lambda r: F.coalesce(eliminates(outcome(profile, r, now), r["on_missing"]), F.lit(False)))
    return let(fatal, lambda f: F.struct((F.size(f) > 0).alias("eliminated"), F.get(f, F.lit(0))["label"].alias("eliminatedBy")))


def report(profile: Column, rules: Column, now: Column, details: bool = False, why_no_years: Column | None = None) -> Column:
    """struct<eliminated, eliminatedBy, failures, indeterminate, hasIndeterminate, results> for rules in
    role order. With `details` each result says why, in words. The rules are judged once, whatever is read of it."""

    def result(r: Column) -> Column:
        found = outcome(profile, r, now)
        why = [detail(profile, r, now, why_no_years).alias("detail")] if details else []
        return F.struct(r["id"].alias("id"), r["label"].alias("label"), r["type"].alias("type"), r["on_missing"].alias("on_missing"), found.alias("outcome"), *why)

    return let(F.transform(F.transform(rules, result), lambda r: r.withField("eliminates", F.coalesce(eliminates(r["outcome"], r["on_missing"]), F.lit(False)))), summed)


def summed(results: Column) -> Column:
    """The struct of report(), of the results of all rules."""
    out = lambda which: F.transform(F.filter(results, lambda r: which(r)), lambda r: r["label"])
    fatal = out(lambda r: r["eliminates"])
    unknown = out(lambda r: r["outcome"] == INDETERMINATE)
    return F.struct(
        (F.size(fatal) > 0).alias("eliminated"),
        F.get(fatal, F.lit(0)).alias("eliminatedBy"),
        out(lambda r: r["outcome"] == FAIL).alias("failures"),
        unknown.alias("indeterminate"),
        (F.size(unknown) > 0).alias("hasIndeterminate"),
        results.alias("results"),
    )

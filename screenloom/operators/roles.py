"""Roles with criteria and rules of their own: assembled, checked, versioned, and candidates judged by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scoring import RATING_MAX, WEIGHT_SUM, tier


def positioned(entries: Column) -> Column:
    """An array of structs with their place in it as `position`, from 1."""
    return F.transform(entries, lambda e, i: e.withField("position", i + 1))


def assembled(roles: DataFrame, criteria: DataFrame, rules: DataFrame, role: str = "role_id") -> DataFrame:
    """Roles with their criteria and rules as arrays in order of position, empty where there are none."""
    out = roles
    for name, rows in (("criteria", criteria), ("rules", rules)):
        columns = [c for c in rows.columns if c != role]
        entry = F.struct("position", *(c for c in columns if c != "position"))
        lists = rows.groupBy(role).agg(F.array_sort(F.collect_list(entry)).alias(name))
        empty = F.array().cast(lists.schema[name].dataType)
        out = out.join(lists, role, "left").withColumn(name, F.coalesce(F.col(name), empty))
    return out


def weight_sums(roles: DataFrame, criteria: DataFrame, role: str = "role_id") -> DataFrame:
    """role, n, weight_sum: 0 for a role without criteria."""
    sums = criteria.groupBy(role).agg(F.count(F.lit(1)).alias("n"), F.sum("weight").cast("long").alias("weight_sum"))
    return roles.select(role).join(sums, role, "left").select(role, *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n", "weight_sum")))


def problems(criteria: Column, rules: Column) -> Column:
    """What keeps an assembled role from being scored with, as codes; empty if nothing does."""
    repeated = lambda entries, f: F.size(F.array_distinct(F.transform(entries, lambda e: e[f]))) < F.size(entries)
    total = F.aggregate(criteria, F.lit(0).cast("long"), lambda n, c: n + c["weight"])
    return F.array_compact(
        F.array(
            F.when(F.size(criteria) == 0, "no_criteria").when(total != WEIGHT_SUM, "weights_not_100"),
            F.when(repeated(criteria, "id"), "repeated_criterion_id"),
            F.when(repeated(criteria, "position"), "repeated_criterion_position"),
            F.when(repeated(rules, "id"), "repeated_rule_id"),
            F.when(repeated(rules, "position"), "repeated_rule_position"),
        )
    )


def shown_criteria(criteria: Column, fields: tuple[str, ...] = ("id", "label")) -> Column:
    """Only the named fields of criteria: what a reader who mustn't see weights is given."""
    return F.transform(criteria, lambda c: F.struct(*(c[f].alias(f) for f in fields)))


def replaced(roles: DataFrame, newer: DataFrame, columns: list[str], role: str = "role_id") -> DataFrame:
    """Roles with the columns of those in newer, whose version goes up by one."""
    new = newer.select(role, F.struct(*columns).alias("_new"))
    out = roles.join(new, role, "left")
    hit = F.col("_new").isNotNull()
    for c in columns:
        out = out.withColumn(c, F.when(hit, F.col(f"_new.{c}")).otherwise(F.col(c)))
    return out.withColumn("version", F.col("version") + F.when(hit, 1).otherwise(0)).drop("_new")


def judged(
    ratings: DataFrame | None, reconciled: DataFrame, criteria: DataFrame, reports: DataFrame, roles: DataFrame, candidate: str = "candidate", role: str = "role_id", criterion: str = "criterion_id"
) -> DataFrame:
    """candidate, role, role_version, problem, score, eliminated, eliminated_by, tier, for each row of
    `reconciled`. `reports` has eliminated and eliminated_by for each candidate that has a profile; if it has
    the role too, it is joined by both, as the ratings are grouped, and `reconciled` isn't shuffled again. `ratings`
    may be None if `reconciled` has their sums (made with scored=True), so that they are grouped only once.

    What is wrong comes in this order: the role (no_criteria, weights_not_100), how the ratings fit it
    (duplicate_ratings, missing_ratings), the ratings themselves (null, or outside 0..10), and the lack of
    a report. It gives no score and no tier. Others are scored; elimination decides the tier and leaves
    the score as it is."""
    if ratings is not None:
        rows = ratings.join(criteria, [role, criterion])
        good = F.min(F.coalesce(F.col("rating").between(0, RATING_MAX), F.lit(False)))
        scores = rows.groupBy(candidate, role).agg(F.sum(F.col("rating") * F.col("weight")).cast("long").alias("raw"), good.alias("valid"))
        reconciled = reconciled.drop("raw", "valid").join(scores, [candidate, role], "left")
    sums = weight_sums(roles, criteria, role).select(role, F.col("n").alias("_n"), F.col("weight_sum").alias("_weights"))
    versions = roles.select(role, F.col("version").alias("role_version")).join(sums, role)
    which = [candidate, role] if role in reports.columns else [candidate]
    out = reconciled.join(reports.hint("merge"), which, "left").join(versions, role)
    problem = (
        F.when(F.col("_n") == 0, "no_criteria")
        .when(~F.col("_weights").eqNullSafe(WEIGHT_SUM), "weights_not_100")
        .when(F.col("verdict") != "ok", F.concat(F.col("verdict"), F.lit("_ratings")))
        .when(~F.coalesce("valid", F.lit(False)), "invalid_rating")
        .when(F.col("eliminated").isNull(), "no_report")
    )
    out = out.withColumn("problem", problem).withColumn("score", F.when(F.col("problem").isNull(), F.col("raw") / F.lit(10.0)))
    verdict = F.when(F.col("problem").isNull(), tier(F.col("score"), F.col("eliminated")))
    return out.select(candidate, role, "role_version", "problem", "score", "eliminated", "eliminated_by", verdict.alias("tier"))

"""Weighted scores, their reconciliation with ratings and criteria, and tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The least score of the two upper tiers, and the names of all.
STRONG, POTENTIAL = 85, 65
STRONG_MATCH, POTENTIAL_MATCH, UNMATCHED = "strong_match", "potential_match", "unmatched"
TIERS = (STRONG_MATCH, POTENTIAL_MATCH, UNMATCHED)
RATING_MAX, WEIGHT_SUM = 10, 100


def weighted_score(ratings: DataFrame, criteria: DataFrame, keys: list[str], criterion: str = "criterion_id", check: bool = True) -> DataFrame:
    """keys, score_raw, score, weight_sum, n: whole numbers until the one division at the end.

    With `check`, weights that don't add up to 100 and ratings that are null or outside 0..10 stop the query."""
    rows = ratings.join(criteria, criterion)
    out = rows.groupBy(*keys).agg(
        F.sum(F.col("rating") * F.col("weight")).cast("long").alias("score_raw"),
        F.sum("weight").cast("long").alias("weight_sum"),
        F.count(F.lit(1)).alias("n"),
        F.count("rating").alias("_rated"),
        F.min("rating").alias("_lo"),
        F.max("rating").alias("_hi"),
    )
    if check:
        good = (F.col("weight_sum") == WEIGHT_SUM) & (F.col("_rated") == F.col("n")) & (F.col("_lo") >= 0) & (F.col("_hi") <= RATING_MAX)
        out = out.withColumn("score_raw", F.when(good, F.col("score_raw")).otherwise(F.raise_error(F.lit("weights must add up to 100 and ratings lie in 0..10")).cast("long")))
    return out.withColumn("score", F.col("score_raw") / F.lit(10.0)).drop("_rated", "_lo", "_hi")


def tier(score: Column, eliminated: Column, check: bool = True) -> Column:
    """Elimination comes first; a score outside 0..100 stops the query (or is null, unchecked)."""
    bad = F.raise_error(F.lit("a score must lie in 0..100")).cast("string") if check else F.lit(None).cast("string")
    return (
        F.when(eliminated, F.lit(UNMATCHED))
        .when(score.isNull(), F.lit(None).cast("string"))
        .when((score < 0) | (score > 100) | F.isnan(score), bad)
        .when(score >= STRONG, F.lit(STRONG_MATCH))
        .when(score >= POTENTIAL, F.lit(POTENTIAL_MATCH))
        .otherwise(F.lit(UNMATCHED))
    )


def reconcile(
    ratings: DataFrame, criteria: DataFrame, keys: list[str], criterion: str = "criterion_id", scope: list[str] | None = None, everyone: DataFrame | None = None, scored: bool = False
) -> DataFrame:
    """keys, verdict, duplicates, missing, unknown: how a set of ratings fits the criteria.

    A criterion rated twice is the first thing to be wrong, then one not rated; ratings of unknown
    criteria are dropped and only reported. criteria has one row a criterion; ratings are counted
    before they meet it. With `scope` (such as a role) both have these columns, and ratings are held
    against the criteria of their own scope; they are part of the result. `everyone` has a row for each
    set that there should be (keys and scope): one without any rating lacks all criteria. With `scored`
    (ratings have a rating, criteria a weight) there are also raw, the weighted sum over known criteria,
    and valid, whether all their ratings lie in 0..10; both are null where none is known.

    The verdict is told from counts, so that no lists are made where none is read. Ratings that are dealt by
    keys and scope already aren't shuffled."""
    scope = scope or []
    own, keys = [*scope, criterion], [*keys, *scope]
    fit, sums = [], []
    known = criteria.groupBy(*own).agg(F.lit(True).alias("_known"), *([F.sum("weight").alias("_weight")] if scored else []))
    if scored:
        good = F.coalesce(F.col("rating").between(0, RATING_MAX), F.lit(False))
        fit = [F.sum("rating").alias("_rating"), F.min(good).alias("_good")]
        sums = [F.sum(F.col("_rating") * F.col("_weight")).cast("long").alias("raw"), F.min(F.when(F.col("_known"), F.col("_good"))).alias("valid")]
    counts = ratings.groupBy(*keys, criterion).agg(F.count(F.lit(1)).alias("_n"), *fit).join(known, own, "left")
    every = criteria.groupBy(*scope).agg(F.sort_array(F.collect_set(criterion)).alias("_every"))
    got = counts.groupBy(*keys).agg(
        F.max(F.when(F.col(criterion).isNotNull(), F.col("_n"))).alias("_most"),
        F.count("_known").alias("_fit"),
        F.sort_array(F.collect_list(F.when(F.col("_n") > 1, F.col(criterion)))).alias("duplicates"),
        F.collect_set(F.when(F.col("_known"), F.col(criterion))).alias("_rated"),
        F.sort_array(F.collect_list(F.when(F.col("_known").isNull(), F.col(criterion)))).alias("unknown"),
        *sums,
    )
    also = ["raw", "valid"] if scored else []
    if everyone is not None:
        nothing = F.array().cast(got.schema["duplicates"].dataType)
        got = everyone.select(*keys).join(got.hint("merge"), keys, "left").select(*keys, "_most", "_fit", *(F.coalesce(c, nothing).alias(c) for c in ("duplicates", "_rated", "unknown")), *also)
    out = got.join(every, scope, "left") if scope else got.crossJoin(F.broadcast(every))
    out = out.withColumn("missing", F.sort_array(F.coalesce(F.array_except("_every", "_rated"), F.array().cast(every.schema["_every"].dataType))))
    lacking = F.coalesce("_fit", F.lit(0)) < F.coalesce(F.size("_every"), F.lit(0))
    verdict = F.when(F.col("_most") > 1, "duplicate").when(lacking, "missing").otherwise("ok")
    return out.select(*keys, verdict.alias("verdict"), "duplicates", "missing", "unknown", *also)


def matrix(ratings: DataFrame, criteria: DataFrame, keys: list[str], criterion: str = "criterion_id") -> DataFrame:
    """keys, score_raw, criteria: the rated criteria in order of position, each with its points."""
    row = F.struct("position", criterion, "label", "weight", "rating", (F.col("rating") * F.col("weight")).alias("points"))
    return ratings.join(criteria, criterion).groupBy(*keys).agg(F.sum(F.col("rating") * F.col("weight")).alias("score_raw"), F.array_sort(F.collect_list(row)).alias("criteria"))


def matrix_checks(matrices: DataFrame) -> DataFrame:
    """Adds weight_sum, point_sum, rows_agree and agrees: whether a stored matrix adds up."""
    total = lambda f: F.aggregate("criteria", F.lit(0).cast("long"), lambda a, r: a + r[f])
    out = matrices.withColumn("weight_sum", total("weight")).withColumn("point_sum", total("points"))
    out = out.withColumn("rows_agree", F.forall("criteria", lambda r: r["points"] == r["rating"] * r["weight"]))
    return out.withColumn("agrees", F.col("rows_agree") & (F.col("weight_sum") == WEIGHT_SUM) & (F.col("point_sum") == F.col("score_raw")))


def clean_matrices(matrices: DataFrame, clean: dict[str, object]) -> DataFrame:
    """The rows whose criteria change when the named fields are cleaned, with the clean ones."""

    def cleaned(r: Column) -> Column:
        for f, how in clean.items():
            r = r.withField(f, how(r[f]))
        return r

    new = F.transform("criteria", cleaned)
    return matrices.withColumn("_new", new).filter(~F.col("_new").eqNullSafe(F.col("criteria"))).withColumn("criteria", F.col("_new")).drop("_new")

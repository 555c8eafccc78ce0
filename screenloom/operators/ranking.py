"""Filtered, ranked and paged reads with counts that agree."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scoring import TIERS

MAX_PAGE_SIZE, PAGE_SIZE = 100, 25


def matching(role=None, job=None, tier=None, status=None, status_in=None) -> Column:
    """The conjunction of the filters that are given. A status outside status_in matches nothing."""
    given = [("role_id", role), ("job_id", job), ("tier", tier), ("status", status)]
    terms = [F.col(c) == v for c, v in given if v is not None]
    if status_in is not None:
        terms.append(F.col("status").isin(*status_in))
    return reduce(lambda a, b: a & b, terms, F.lit(True))


def unless(flag: bool, condition: Column) -> Column:
    """The condition, waived by a flag: the include-archived switch."""
    return F.lit(flag) | condition


def ranked(rows: DataFrame, direction: str = "desc", score: str = "match_score", key: str = "id") -> DataFrame:
    """By score, ties by descending id; rows without a score come last in both directions."""
    order = {"desc": F.col(score).desc_nulls_last(), "asc": F.col(score).asc_nulls_last()}
    if direction not in order:
        raise ValueError(f"unknown direction: {direction}")
    return rows.orderBy(order[direction], F.col(key).desc())


def newest_first(rows: DataFrame, created: str = "created_at", key: str = "id") -> DataFrame:
    return rows.orderBy(F.col(created).desc(), F.col(key).desc())


def page(ordered: DataFrame, number: int, size: int = PAGE_SIZE) -> DataFrame:
    """One page of ordered rows: a top-k, not a sort, in the plan."""
    if number < 1 or not 1 <= size <= MAX_PAGE_SIZE:
        raise ValueError("pages count from 1 and have 1 to 100 rows")
    return ordered.offset((number - 1) * size).limit(size)


def first_of_each(rows: DataFrame, by: str, values: tuple[str, ...], size: int = MAX_PAGE_SIZE, created: str = "created_at", key: str = "id") -> DataFrame:
    """The newest `size` rows of each of these values, in one scan: ranks are cut off before the shuffle."""
    newest = Window.partitionBy(by).orderBy(F.col(created).desc(), F.col(key).desc())
    return rows.filter(F.col(by).isin(*values)).withColumn("_rank", F.row_number().over(newest)).filter(F.col("_rank") <= size).drop("_rank")


def page_meta(rows: DataFrame, size: int = PAGE_SIZE) -> DataFrame:
    """total and total_pages (1 at least)."""
    return rows.agg(F.count(F.lit(1)).alias("total")).withColumn("total_pages", F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("long"))


def page_with_counts(ordered: DataFrame, number: int, size: int = PAGE_SIZE, tier: str = "tier") -> DataFrame:
    """A page of ordered rows, and beside each the total, total_pages, the rows of each tier and of all
    tiers (tiered): one row of counts, which is sent to the page."""
    counts = page_meta(ordered, size).join(F.broadcast(tier_counts(ordered, [], tier)))
    return page(ordered, number, size).join(F.broadcast(counts.withColumn("tiered", sum((F.col(t) for t in TIERS), F.lit(0)).cast("long"))))


def tier_counts(rows: DataFrame, by: list[str], tier: str = "tier") -> DataFrame:
    """Rows of each tier, zero where there are none; rows without a tier don't count."""
    return rows.groupBy(*by).agg(*(F.count_if(F.col(tier) == t).alias(t) for t in TIERS))


def patch(rows: DataFrame, newer: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """rows with columns taken from newer where it has the key; a newer null wins as well."""
    new = newer.select(F.col(key), F.struct(*columns).alias("_new"))
    out = rows.join(new, key, "left")
    for c in columns:
        out = out.withColumn(c, F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)))
    return out.drop("_new")


def allocate(files: DataFrame, keys: list[str], order: str, size: str, loaded: Column) -> DataFrame:
    """Adds `sent`: how much of each file is among the first `loaded` bytes of all, in order."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.coalesce(F.sum(size).over(before), F.lit(0))
    return files.withColumn("sent", F.greatest(F.lit(0), F.least(F.col(size), loaded - earlier)))


def total_pages(total: int, size: int) -> int:
    return max(1, math.ceil(total / size))

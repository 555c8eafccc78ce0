"""Taking in files: one row for each content, however often it comes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def first_wins(rows: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """Adds `first` (the row's own or an earlier ordinal of its keys) and `redundant`.

    The minimum is combined before the shuffle, so that a content that comes a million times is one
    row a task there; the copies meet it by a join that Spark splits if it is skewed."""
    least = rows.groupBy(*keys).agg(F.min(ordinal).alias("first"))
    return rows.join(least, keys).withColumn("redundant", F.col(ordinal) != F.col("first"))


def collapsed(rows: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """The first row of each content, by a rank that is cut off before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(ordinal))
    return rows.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def insert_new(stored: DataFrame, incoming: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """What an idempotent insert answers: for each content of incoming, by its first ordinal, whether
    it is created or was stored already. in_order() gives a caller the answers in the order asked."""
    new = collapsed(incoming, keys, ordinal)
    have = stored.select(*keys).distinct()
    made = new.join(have, keys, "left_anti").withColumn("created", F.lit(True))
    known = new.join(have, keys, "left_semi").withColumn("created", F.lit(False))
    return made.unionByName(known)


def in_order(answers: DataFrame, asked: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """The answers by content, for each row that asked, in its order."""
    return asked.select(*keys, ordinal).join(answers.drop(ordinal), keys).orderBy(ordinal)


def duplicates_of(rows: DataFrame, keys: list[str], key: str) -> DataFrame:
    """Rows whose keys another row has too, with how many others."""
    n = rows.groupBy(*keys).agg((F.count(F.lit(1)) - 1).alias("others")).filter("others > 0")
    return rows.join(n, keys).select(key, *keys, "others")


def replace_children(old: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """Children after those of the parents in `new` were replaced by them."""
    return old.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new)


def eligible(roles: DataFrame, criteria: DataFrame, role: str = "role_id") -> DataFrame:
    """Roles that take uploads: not archived, with a criterion."""
    return roles.filter(F.col("archived_at").isNull()).join(criteria.select(role), role, "left_semi")


def archive(roles: DataFrame, ids: DataFrame, now: Column, role: str = "role_id") -> DataFrame:
    """Roles with those in ids archived. One that was archived keeps its time and isn't touched."""
    hit = roles.join(ids.select(role, F.lit(True).alias("_hit")).distinct(), role, "left")
    fresh = F.col("_hit").isNotNull() & F.col("archived_at").isNull()
    out = hit.withColumn("updated_at", F.when(fresh, now).otherwise(F.col("updated_at")))
    return out.withColumn("archived_at", F.when(fresh, now).otherwise(F.col("archived_at"))).drop("_hit")


def storage_path(name: Column, extension: Column) -> Column:
    return F.concat_ws("/", F.substring(name, 1, 2), F.substring(name, 3, 2), F.concat(name, extension))

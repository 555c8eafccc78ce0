"""Values as people read them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NOTHING = "—"


def one_decimal(c: Column) -> Column:
    """c with one decimal; of two that are as near, the even one, as printf has it (Java takes the larger)."""
    return F.format_string("%.1f", F.bround(c, 1))


def score_text(c: Column) -> Column:
    return F.when(c.isNull() | F.isnan(c), NOTHING).otherwise(one_decimal(c))


def bytes_text(c: Column) -> Column:
    kb = c / F.lit(1024.0)
    return (
        F.when(c.isNull(), NOTHING)
        .when(c < 1024, F.concat(c.cast("string"), F.lit(" B")))
        .when(kb < 10, F.concat(one_decimal(kb), F.lit(" KB")))
        .when(kb < 1024, F.format_string("%.0f KB", kb))
        .otherwise(F.concat(one_decimal(kb / 1024), F.lit(" MB")))
    )


def elapsed_text(ms: Column) -> Column:
    s = F.greatest(F.lit(0), F.floor(ms / 1000)).cast("long")
    return F.when(s < 60, F.concat(s.cast("string"), F.lit("s"))).otherwise(F.format_string("%dm %02ds", F.floor(s / 60).cast("long"), s % 60))


def humanize(c: Column) -> Column:
    t = F.trim(F.regexp_replace(c, "[_-]+", " "))
    return F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, F.lit(2), F.length(t)))


def pluralize(n: Column, singular: str, plural: str | None = None) -> Column:
    return F.concat_ws(" ", n.cast("string"), F.when(n == 1, singular).otherwise(plural or f"{singular}s"))


def iso_or_null(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")

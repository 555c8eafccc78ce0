"""Work experience: month intervals, merged, and the years that they add up to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from screenloom.functions.dates import end_month, is_present_word, iso_month, parse_date, start_month, years_of


def merge_intervals(rows: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """keys, start, end: intervals of whole months, merged where they overlap or touch.

    A row begins a segment if it starts after the month that follows all ends before it, in order of
    start; the running number of such rows names the segment. One shuffle on the keys."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(before.isNull() | (F.col(start) > before + 1), 1).otherwise(0)
    numbered = rows.withColumn("_begins", begins).withColumn("_segment", F.sum("_begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_segment").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_segment")


def resolve(rows: DataFrame, keys: list[str], now: int, start: str = "start", end: str = "end", reason: str | None = None) -> DataFrame:
    """Adds `kind` (interval, open or the reason why an entry can't be used) and closed months
    `from_month` and `to_month`, for entries with month indices start and end.

    An entry without an end goes on if none starts later, else nobody knows when it ended: `open`.
    An end in the future is cut to now."""
    latest = F.max(start).over(Window.partitionBy(*keys))
    to = F.when(F.col(end).isNull(), F.when(F.col(start) >= latest, F.lit(now))).otherwise(F.least(F.col(end), F.lit(now)))
    given = F.col(reason) if reason else F.lit(None).cast("string")
    kind = (
        F.when(F.col(start).isNull(), F.coalesce(given, F.lit("missing_start")))
        .when(F.col(start) > now, F.lit("starts_in_the_future"))
        .when(given.isNotNull(), given)
        .when(to.isNull(), F.lit("open"))
        .when(to < F.col(start), F.lit("ends_before_start"))
        .otherwise(F.lit("interval"))
    )
    return rows.withColumn("kind", kind).withColumn("from_month", F.col(start)).withColumn("to_month", F.when(kind == "interval", to))


def from_texts(rows: DataFrame, start_text: str, end_text: str, now: int) -> DataFrame:
    """Adds start, end and reason from dates as text: what resolve() needs. A present word ends now."""
    end = F.col(end_text)
    reason = (
        F.when(F.col(start_text).isNull(), F.lit("missing_start"))
        .when(parse_date(F.col(start_text)).isNull(), F.lit("unparseable_start"))
        .when(end.isNotNull() & ~F.coalesce(is_present_word(end), F.lit(False)) & parse_date(end).isNull(), F.lit("unparseable_end"))
    )
    closed = F.when(F.coalesce(is_present_word(end), F.lit(False)), F.lit(now)).otherwise(end_month(end))
    return rows.withColumn("start", start_month(F.col(start_text))).withColumn("end", closed).withColumn("reason", reason)


def experience(resolved: DataFrame, keys: list[str], now: int) -> DataFrame:
    """keys, n_entries, n_unusable, n_open, n_covered, months, years, from resolve().

    months and years are null if there is no interval, or if an open entry isn't covered: some merged
    segment would have to reach from its start, or before, up to now."""
    merged = merge_intervals(resolved.filter("kind = 'interval'").select(*keys, F.col("from_month").alias("start"), F.col("to_month").alias("end")), keys)
    totals = merged.groupBy(*keys).agg(F.sum(F.col("end") - F.col("start") + 1).alias("months"), F.min(F.when(F.col("end") >= now, F.col("start"))).alias("_since"))
    entries = resolved.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_entries"),
        F.count_if(~F.col("kind").isin("interval", "open")).alias("n_unusable"),
        F.count_if(F.col("kind") == "open").alias("n_open"),
        F.collect_list(F.when(F.col("kind") == "open", F.col("from_month"))).alias("_open"),
    )
    out = entries.join(totals, keys, "left")
    covered = F.size(F.filter("_open", lambda s: F.coalesce(F.col("_since") <= s, F.lit(False))))
    out = out.withColumn("n_covered", covered.cast("long"))
    known = F.col("months").isNotNull() & (F.col("n_covered") == F.col("n_open"))
    out = out.withColumn("months", F.when(known, F.col("months")))
    return out.withColumn("years", years_of(F.col("months"))).drop("_since", "_open")


def segments(resolved: DataFrame, keys: list[str]) -> DataFrame:
    """keys, first_month, last_month, months: the merged segments, as ISO months."""
    merged = merge_intervals(resolved.filter("kind = 'interval'").select(*keys, F.col("from_month").alias("start"), F.col("to_month").alias("end")), keys)
    return merged.select(*keys, iso_month(F.col("start")).alias("first_month"), iso_month(F.col("end")).alias("last_month"), (F.col("end") - F.col("start") + 1).alias("months"))


def covers(merged: Column, start: Column, now: Column) -> Column:
    """Whether one of the merged segments (structs of start, end) reaches from start through now."""
    return F.exists(merged, lambda s: (s["start"] <= start) & (s["end"] >= now))


def reasons(resolved: DataFrame, keys: list[str], now: int, order: list[str], title: str, employer: str, said_start: str) -> DataFrame:
    """keys and reason: why the experience of those for whom it can't be told is unknown, in words, from
    resolve() with the columns that name an entry. Fixed values: the sentences, which readers see.

    Open entries that nothing covers are to blame, in order; where there are none, no dates could be used."""
    known = experience(resolved, keys, now).filter("months IS NULL").select(*keys)
    merged = merge_intervals(resolved.filter("kind = 'interval'").select(*keys, F.col("from_month").alias("start"), F.col("to_month").alias("end")), keys)
    since = merged.groupBy(*keys).agg(F.min(F.when(F.col("end") >= now, F.col("start"))).alias("_since"))
    quoted = lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))
    named = F.coalesce(F.concat(quoted(title), F.lit(" at "), quoted(employer)), quoted(title), quoted(employer), F.lit("an unnamed role"))
    sentence = F.concat(named, F.lit(" (started "), F.col(said_start), F.lit(") has no end date, and a later role starts after it, so its end is unknown"))
    blames = resolved.filter("kind = 'open'").join(known, keys, "left_semi").join(since, keys, "left").filter("_since IS NULL OR _since > from_month")
    lists = blames.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, sentence.alias("_said")))).alias("_all"))
    told = F.array_join(F.transform("_all", lambda x: x["_said"]), "; ")
    return known.join(lists, keys, "left").select(*keys, F.coalesce(told, F.lit("no usable employment dates")).alias("reason"))

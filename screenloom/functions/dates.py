"""Partial dates as people write them: a year, and a month if it is said."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, match_form

#: Month names and short forms.
MONTHS = {
    "jan": 1, "january": 1, "feb": 2, "february": 2, "mar": 3, "march": 3, "apr": 4, "april": 4,
    "may": 5, "jun": 6, "june": 6, "jul": 7, "july": 7, "aug": 8, "august": 8, "sep": 9, "sept": 9,
    "september": 9, "oct": 10, "october": 10, "nov": 11, "november": 11, "dec": 12, "december": 12,
}
#: Words for an end that hasn't come.
PRESENT_WORDS = ("present", "current", "currently", "now", "ongoing", "to date", "today")


def parse_date(c: Column, compose: bool = True) -> Column:
    """struct<year, month>; month is null if only a year is given; null if it isn't a date.

    The text is split at its separators: a year alone, year and month (and day) in numbers, month and
    year in numbers, or a month's name and a year. Numbers are split by - or /, a name by one blank."""
    return let(match_form(c, compose), lambda text: let(F.split(text, "[-/ ]"), lambda parts: date_of(text, parts)))


def date_of(text: Column, parts: Column) -> Column:
    n = F.size(parts)
    at = lambda k: F.get(parts, F.lit(k))
    digits = lambda k, least, most: F.length(at(k)).between(least, most) & (F.translate(at(k), "0123456789", "") == "")
    number = lambda k: at(k).try_cast("int")
    spaced = F.contains(text, F.lit(" "))
    names = F.create_map(*map(F.lit, chain(*MONTHS.items())))
    named = F.try_element_at(names, F.regexp_replace(at(0), r"\.$", ""))
    date = lambda year, month: F.struct(year.cast("int").alias("year"), month.cast("int").alias("month"))
    ok = lambda k: number(k).between(1, 12)
    none = F.lit(None)
    return (
        F.when((n == 1) & digits(0, 4, 4), date(number(0), none))
        .when(spaced, F.when((n == 2) & digits(1, 4, 4) & named.isNotNull(), date(number(1), named)))
        .when(digits(0, 4, 4) & digits(1, 1, 2) & ((n == 2) | ((n == 3) & digits(2, 1, 2))), F.when(ok(1), date(number(0), number(1))))
        .when((n == 2) & digits(0, 1, 2) & digits(1, 4, 4), F.when(ok(0), date(number(1), number(0))))
    )


def is_present_word(c: Column, compose: bool = True) -> Column:
    return match_form(c, compose).isin(*PRESENT_WORDS)


def month_index(year: Column, month: Column) -> Column:
    """Months since year 0, January being 0."""
    return year * 12 + month - 1


def start_month(c: Column) -> Column:
    """A bare year starts in January."""
    d = parse_date(c)
    return month_index(d.getField("year"), F.coalesce(d.getField("month"), F.lit(1)))


def end_month(c: Column, compose: bool = True) -> Column:
    """A bare year ends in December."""
    d = parse_date(c, compose)
    return month_index(d.getField("year"), F.coalesce(d.getField("month"), F.lit(12)))


def iso_month(index: Column) -> Column:
    return F.format_string("%04d-%02d", F.floor(index / 12).cast("int"), (index % 12 + 1).cast("int"))


def years_of(months: Column) -> Column:
    """Years with one decimal, halves up."""
    return F.floor(months * 10 / F.lit(12.0) + 0.5) / 10


def is_expired(expiry: Column, now: Column, compose: bool = True) -> Column:
    """Whether an expiry date is before the month `now` (a month index); false if it says nothing."""
    return F.coalesce(end_month(expiry, compose) < now, F.lit(False))

"""Markup to lines of text, and pages to documents."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import INLINE_SPACE, fold_space, trimmed

#: The five named entities of XML.
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}


def entity(name: str) -> str | None:
    """The character that stands between & and ; as a name, or as a number after # (after #x in base
    16). None if there is no such character."""
    if not name.startswith("#"):
        return ENTITIES.get(name)
    base, digits = (16, name[2:]) if name[1:2] == "x" else (10, name[1:])
    if not digits or digits.lower().strip("0123456789abcdef"[:base]):
        return None
    point = int(digits, base) if len(digits.lstrip("0")) < 8 else -1
    return chr(point) if 0 <= point <= 0x10FFFF and not 0xD800 <= point <= 0xDFFF else None


def decoded(text: str) -> str:
    """A text with its entities as characters; what isn't an entity stays."""
    before, *parts = text.split("&")
    out = [before]
    for part in parts:
        name, end, rest = part.partition(";")
        character = entity(name) if end else None
        out.append("&" + part if character is None else character + rest)
    return "".join(out)


@F.pandas_udf(T.StringType())
def decode_entities(texts: pd.Series) -> pd.Series:
    """Named and numeric entities, in one pass: what a pass gives isn't decoded again."""
    return texts.map(decoded, na_action="ignore")


def lines(html: Column) -> Column:
    """The lines of a page: block ends and breaks end a line, tags go, white space is folded, empty
    lines go. Null has no lines."""
    parts = F.split(F.coalesce(html, F.lit("")), r"</(?:p|div|li|h[1-6]|tr)>|<br */?>")
    return F.filter(F.transform(parts, lambda p: fold_space(F.regexp_replace(p, "<[^>]*>", ""))), lambda t: t != "")


def assemble_page(items: Column) -> Column:
    """One page of items (structs with str and has_eol), in order: strings joined, a line end where
    an item says so, blanks folded in lines. Items without a string are skipped."""
    known = F.filter(items, lambda i: i["str"].isNotNull())
    raw = F.array_join(F.transform(known, lambda i: F.concat(i["str"], F.when(i["has_eol"], "\n").otherwise(""))), "")
    each = F.transform(F.split(raw, "\n"), lambda t: trimmed(F.regexp_replace(t, INLINE_SPACE, " ")))
    return trimmed(F.array_join(each, "\n"))


def assemble(items: DataFrame, doc: str, page: str, order: str, text: str, eol: str) -> DataFrame:
    """(doc, body): pages of items, without the empty ones, joined by an empty line."""
    item = F.struct(F.col(order).alias("o"), F.col(text).alias("str"), F.col(eol).alias("has_eol"))
    pages = items.groupBy(doc, page).agg(assemble_page(F.array_sort(F.collect_list(item), lambda a, b: F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0))).alias("_text"))
    kept = pages.filter("_text <> ''").groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(page, "_text"))).alias("_pages"))
    return kept.select(doc, F.array_join(F.transform("_pages", lambda p: p["_text"]), "\n\n").alias("body"))

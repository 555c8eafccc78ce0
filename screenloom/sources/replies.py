"""Replies of a language model, as JSON text, to rows with a strict schema.

A reply is ok, invalid_json, or schema_mismatch: from_json drops keys that it doesn't know, so the
keys are compared with the schema's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from screenloom.functions.text import strip_fences


def known_keys(json: Column, kind: T.DataType) -> Column:
    """Whether no object in a JSON text has a key that the schema lacks, at any depth."""
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StructType, T.ArrayType)):
        elements = F.from_json(json, "array<string>")  # objects as their text
        return F.coalesce(F.forall(elements, lambda e: known_keys(e, kind.elementType)), F.lit(True))
    if not isinstance(kind, T.StructType):
        return F.lit(True)
    strange = F.array_except(F.json_object_keys(json), F.array(*(F.lit(f.name) for f in kind.fields)))
    good = F.coalesce(F.size(strange) == 0, F.lit(True))
    for f in kind.fields:
        if isinstance(f.dataType, (T.StructType, T.ArrayType)):
            good = good & known_keys(F.get_json_object(json, f"$.{f.name}"), f.dataType)
    return good


def parse_reply(rows: DataFrame, text: str, schema: T.StructType) -> DataFrame:
    """Adds outcome and value."""
    plain = strip_fences(F.col(text))
    keys = F.json_object_keys(plain)
    value = F.from_json(plain, schema, {"mode": "PERMISSIVE"})
    required = [F.get_json_object(plain, f"$.{f.name}").isNotNull() for f in schema.fields if not f.nullable]
    typed = [value[f.name].isNotNull() | F.get_json_object(plain, f"$.{f.name}").isNull() for f in schema.fields]
    good = known_keys(plain, schema)
    for c in [*required, *typed]:
        good = good & c
    outcome = F.when(keys.isNull(), "invalid_json").when(good, "ok").otherwise("schema_mismatch")
    return rows.withColumn("outcome", outcome).withColumn("value", F.when(F.col("outcome") == "ok", value))


def typed_rows(json_array: Column, schema: str) -> Column:
    """A JSON array of objects as an array of structs; absent keys are null."""
    return F.from_json(json_array, f"array<struct<{schema}>>")


def record_set(rows: DataFrame, json: str, columns: str, defaults: dict[str, object] | None = None, ordinal: str = "ordinal") -> DataFrame:
    """Rows of a JSON array of objects, one for each, beside the other columns of rows: `columns` names them with
    their types, `defaults` what stands where one is absent or null. Keys that aren't named are passed over; the place in the
    array is the ordinal, from 0.

    Values are read as text and cast, so that "30" is a number where one is declared, and what is no value of its
    type stops the query instead of passing as null. Text that is no JSON array stops it, too."""
    fields = T._parse_datatype_string(columns).fields
    plain = ",".join(f"`{f.name}`:string" for f in fields)
    read = F.from_json(json, f"array<struct<{plain}>>", {"mode": "FAILFAST"})
    checked = F.when(F.col(json).isNull() | read.isNotNull(), read).otherwise(F.raise_error(F.lit(f"{json} holds no JSON array")).cast(f"array<struct<{plain}>>"))
    each = rows.withColumn("_all", checked).select(*(c for c in rows.columns if c != json), F.posexplode("_all").alias(ordinal, "_x"))

    def value(f: T.StructField) -> Column:
        cast = F.col(f"_x.{f.name}").cast(f.dataType)
        return (F.coalesce(cast, F.lit(defaults[f.name]).cast(f.dataType)) if f.name in (defaults or {}) else cast).alias(f.name)

    return each.select(*(c for c in rows.columns if c != json), ordinal, *map(value, fields))

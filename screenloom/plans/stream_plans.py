"""Batch twins of the streams, changes between polls, byte formats."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from screenloom.plans.derived import load
from screenloom.sources import files
from screenloom.streaming import events

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return register


@query("SELECT user_id, epoch(time_bucket(INTERVAL 1 hour, ts))::BIGINT AS window_start, count(*) AS n, count(*) > 2 AS limited FROM events GROUP BY ALL")
def rate_limit_window(spark: SparkSession, d: str) -> DataFrame:
    rows = events.rate_windows(load(spark, d, "events"), window="1 hour", limit=2)
    return rows.withColumn("window_start", F.col("window_start").cast("long"))


@query("SELECT user_id, min(event_id) AS first_event FROM events GROUP BY user_id")
def dedupe_batch(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").groupBy("user_id").agg(F.min("event_id").alias("first_event"))


@query("SELECT event_id, user_id, event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS changed FROM events")
def polling_changes(spark: SparkSession, d: str) -> DataFrame:
    return events.polling_changes(load(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type")).select("event_id", "user_id", "changed")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def latest_response(spark: SparkSession, d: str) -> DataFrame:
    return events.latest(load(spark, d, "events"), "user_id", "event_id", ["event_type", "value"])


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def json_fields(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("SELECT doc_id, sha256(text) AS sha256, octet_length(encode(text)) AS byte_size FROM documents")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("byte_size"))


#: What is put before a text to make another type of it, by the document's number, in base 16; and the type and the reason.
_HEADS = (
    ("", "text/plain", "utf8"), ("255044462D312E37", "application/pdf", "pdf_signature"), ("0A0A255044462D", "application/pdf", "pdf_signature_offset"), ("504B0506", None, "empty_archive"), ("504B0708", None, "spanned_archive"),
    ("504B0304", None, "no_end_of_central_directory"), ("FFFE", "text/plain", "utf16_bom"), ("EFBBBF", "text/plain", "utf8_bom"), ("00", None, "nul_byte"), ("C0AF", None, "invalid_utf8"),
)
_SAID = lambda values: "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "][doc_id % 10 + 1]"
_BARE = "coalesce(text, '') = '' AND doc_id % 10 = 0"


@query(f"SELECT doc_id, CASE WHEN {_BARE} THEN NULL ELSE {_SAID(h[1] for h in _HEADS)} END AS mime, CASE WHEN {_BARE} THEN 'empty' ELSE {_SAID(h[2] for h in _HEADS)} END AS reason, CASE doc_id % 10 WHEN 1 THEN 0 WHEN 2 THEN 2 END AS \"offset\" FROM documents")
def sniff_mime(spark: SparkSession, d: str) -> DataFrame:
    """The type of every document's bytes, behind a few that make them something else."""
    head = F.element_at(F.array(*(F.lit(h[0]) for h in _HEADS)), (F.col("doc_id") % 10 + 1).cast("int"))
    content = F.unhex(F.concat(head, F.hex(F.coalesce("text", F.lit("")).cast("binary"))))
    return load(spark, d, "documents").select("doc_id", files.sniff_mime(content).alias("f")).select("doc_id", "f.mime", "f.reason", "f.offset")


@F.pandas_udf(T.BinaryType())
def archived(text: pd.Series, kind: pd.Series) -> pd.Series:
    """Archives of two entries, the first deflated; but for the first kind each has a fault of its own."""

    def one(text: str | None, kind: int) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("body.txt", (text or "").encode(), zipfile.ZIP_DEFLATED)
            z.writestr("note", b"x", zipfile.ZIP_STORED)
            z.comment = b"c" * 300
        data = bytearray(out.getvalue())
        end, first = data.rfind(b"PK\x05\x06"), data.find(b"PK\x01\x02")
        if kind == 1:
            del data[end + 10 :]
        elif kind == 2:
            data[end + 8 : end + 12] = b"\xff" * 4
        elif kind == 3:
            data[first + 8] |= 1
        elif kind == 4:
            data[first + 10] = 99
        elif kind == 5:
            data[first] = 0
        elif kind == 6:
            data[first + 16] ^= 1
        return bytes(data)

    return pd.Series([one(t, k) for t, k in zip(text, kind, strict=True)])


_FAULTS = "['ok', 'no_end_of_central_directory', 'zip64', 'encrypted', 'unsupported_method', 'truncated', 'corrupt'][doc_id % 7 + 1]"


@query(
    f"""SELECT doc_id, CASE WHEN doc_id % 7 IN (0, 3, 4, 6) THEN 'ok' ELSE {_FAULTS} END AS reason, CASE WHEN doc_id % 7 IN (0, 3, 4, 6) THEN 'body.txt,note' ELSE '' END AS names,
    CASE WHEN doc_id % 7 IN (0, 3, 4, 6) THEN octet_length(encode(coalesce(text, ''))) + 1 ELSE 0 END AS size, {_FAULTS} AS read, CASE WHEN doc_id % 7 = 0 THEN md5(coalesce(text, '')) END AS body FROM documents"""
)
def zip_directory(spark: SparkSession, d: str) -> DataFrame:
    """What archives of the documents list, and what reading their first entry gives."""
    rows = load(spark, d, "documents").select("doc_id", archived("text", (F.col("doc_id") % 7).cast("int")).alias("zip"))
    rows = rows.select("doc_id", files.zip_directory("zip").alias("d"), files.zip_entry("zip", F.lit("body.txt")).alias("e"))
    size = F.aggregate("d.sizes", F.lit(0).cast("long"), lambda a, n: a + n)
    return rows.select("doc_id", "d.reason", F.array_join("d.names", ",").alias("names"), size.alias("size"), F.col("e.reason").alias("read"), F.md5("e.content").alias("body"))

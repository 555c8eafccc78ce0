"""Files as rows: their bytes, hash, type and text.

Everything that looks into bytes runs as Arrow-batched pandas UDFs next to the read; results are
tagged with a reason instead of raising, so one bad file doesn't stop a scan. PDF text needs a
library that isn't here: such files are recognised and reported; page items extracted elsewhere are
put together by functions.markup.assemble.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_right
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from screenloom.functions.markup import decoded

#: Types that are taken, and how far a signature is looked for.
PDF, DOCX, TXT = "application/pdf", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "text/plain"
PDF_WINDOW, TEXT_WINDOW, MAX_CONTROL_RATIO, MAX_INFLATED = 1024, 8192, 0.02, 64 * 1024 * 1024
CONTENT_TYPES, WORD_TYPE = "[Content_Types].xml", b"wordprocessingml.document.main"
CONTROL = re.compile(rb"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]")


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, byte_size, sha256 and content of the files below a path of any store Spark reads.
    (Its reader passes over files of no bytes.)"""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return rows.select("path", F.col("length").alias("byte_size"), F.sha2("content", 256).alias("sha256"), "content")


def missing_files(wanted: DataFrame, files: DataFrame, path: str = "path") -> DataFrame:
    """The paths wanted that no file has."""
    return wanted.join(files.select(path), path, "left_anti").withColumn("error", F.lit("SOURCE_FILE_MISSING"))


def whole_characters(data: bytes) -> bytes:
    """A prefix without the UTF-8 character that the cut left unfinished."""
    for back in range(1, min(4, len(data)) + 1):
        lead = data[-back]
        if lead >= 0xC0:
            need = 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            return data[:-back] if back < need else data
        if lead < 0x80:
            break
    return data


def sniff_text(data: bytes) -> tuple[str | None, str, str | None]:
    """UTF-16 by its mark, UTF-8 by a mark or by looking like text."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return TXT, "utf16_bom", "utf-16le" if data[:1] == b"\xff" else "utf-16be"
    marked = data.startswith(b"\xef\xbb\xbf")
    body = data[3:] if marked else data
    part = whole_characters(body[:TEXT_WINDOW]) if len(body) > TEXT_WINDOW else body
    if b"\0" in part:
        return None, "nul_byte", None
    try:
        characters = len(part.decode("utf-8").encode("utf-16-le")) // 2  # as the limit counts them
    except UnicodeDecodeError:
        return None, "invalid_utf8", None
    if characters and len(CONTROL.findall(part)) / characters > MAX_CONTROL_RATIO:
        return None, "control_characters", None
    return TXT, "utf8_bom" if marked else "utf8", "utf-8"


class Entry(NamedTuple):
    """An archive's entry as its directory has it."""

    name: str
    flags: int
    method: int
    crc: int
    packed: int
    size: int
    offset: int


def zip_entries(data: bytes) -> tuple[list[Entry] | None, str]:
    """What an archive's directory lists, and why it can't be read: no_end_of_central_directory (its record may
    stand before a comment of up to 64 KB), zip64, spanned, truncated or ok."""
    end = data.rfind(b"PK\x05\x06", max(0, len(data) - 22 - 0xFFFF))
    if end < 0 or len(data) < end + 22:
        return None, "no_end_of_central_directory"
    disk, first_disk, here, n, size, at = struct.unpack_from("<4H2I", data, end + 4)
    if 0xFFFF in (here, n) or 0xFFFFFFFF in (size, at):
        return None, "zip64"
    if disk or first_disk or here != n:
        return None, "spanned"
    entries = []
    for _ in range(n):
        if at + 46 > end or data[at : at + 4] != b"PK\x01\x02":
            return None, "truncated"
        flags, method = struct.unpack_from("<2H", data, at + 8)
        crc, packed, size, *lengths = struct.unpack_from("<3I3H", data, at + 16)
        name = data[at + 46 : at + 46 + lengths[0]].decode("utf-8" if flags & 0x800 else "cp437", "replace")
        entries.append(Entry(name, flags, method, crc, packed, size, *struct.unpack_from("<I", data, at + 42)))
        at += 46 + sum(lengths)
    return (entries, "ok") if at <= end else (None, "truncated")


def read_entry(data: bytes, entries: list[Entry], name: str, most: int = MAX_INFLATED) -> tuple[bytes | None, str]:
    """An entry's bytes, at most so many, and why it can't be read."""
    found = next((e for e in entries if e.name == name), None)
    if found is None:
        return None, "entry_missing"
    if found.flags & 1:
        return None, "encrypted"
    if found.method not in (0, 8):
        return None, "unsupported_method"
    if found.size > most:
        return None, "too_large"
    if data[found.offset : found.offset + 4] != b"PK\x03\x04" or len(data) < found.offset + 30:
        return None, "corrupt"
    start = found.offset + 30 + sum(struct.unpack_from("<2H", data, found.offset + 26))
    body = data[start : start + found.packed]
    if found.method:
        reader = zlib.decompressobj(-zlib.MAX_WBITS)
        try:
            body = reader.decompress(body, most + 1)
        except zlib.error:
            return None, "corrupt"
    if len(body) > most:
        return None, "too_large"
    return (body, "ok") if len(body) == found.size and zlib.crc32(body) == found.crc else (None, "corrupt")


def sniff(data: bytes | None) -> tuple[str | None, str, str | None, int | None]:
    """(mime, reason, encoding, offset) by the bytes alone: PDF (with the place of its signature), then
    ZIP, then text."""
    data = data or b""
    if not data:
        return None, "empty", None, None
    at = data.find(b"%PDF-", 0, PDF_WINDOW + 4)
    if 0 <= at < PDF_WINDOW:
        return PDF, "pdf_signature_offset" if at else "pdf_signature", None, at
    if data[:4] == b"PK\x03\x04":
        entries, why = zip_entries(data)
        if entries is None:
            return None, why, None, None
        types, why = read_entry(data, entries, CONTENT_TYPES)
        if types is None:
            return None, why if why != "entry_missing" else "not_ooxml", None, None
        return (DOCX, "docx", None, None) if WORD_TYPE in types else (None, "other_ooxml", None, None)
    if data[:4] in (b"PK\x05\x06", b"PK\x07\x08"):
        return None, "empty_archive" if data[2:3] == b"\x05" else "spanned_archive", None, None
    return *sniff_text(data), None


def word_lines(xml: str) -> list[str]:
    """Lines of a word-processing document: runs of text, tabs as blanks, breaks and paragraphs."""
    parts = xml.split("<")
    ends = [k for k, part in enumerate(parts) if part.startswith("/w:t>")]
    out, line, k = [], [], 1
    while k < len(parts):
        tag, closed, after = parts[k].partition(">")
        name = (tag.rstrip("/") if tag[:1] != "/" else tag).split(None, 1)[0] if tag.strip("/ ") else ""
        if closed and name == "w:t" and not tag.endswith("/"):
            at = bisect_right(ends, k)
            if at < len(ends):  # what stands in between is text, tags and all
                line.append(decoded("<".join([after, *parts[k + 1 : ends[at]]])))
                k = ends[at]
        elif closed and name == "w:tab":
            line.append(" ")
        elif closed and (name in ("w:br", "w:cr", "/w:p") or tag.rstrip("/").strip() == "w:p" and tag.endswith("/")):
            out.append("".join(line))
            line = []
        k += 1
    return [*out, "".join(line)]


def folded_lines(lines: list[str]) -> str:
    """Blanks folded, at most one empty line in a row."""
    return re.sub(r"\n{3,}", "\n\n", "\n".join(re.sub(r"[^\S\r\n]+", " ", x).strip() for x in lines)).strip()


def read_text(data: bytes | None) -> tuple[str | None, str | None, str]:
    """(text, mime, reason) of a file; reason is ok, or why there is no text."""
    mime, reason, encoding, _ = sniff(data)
    if mime == PDF:
        return None, mime, "pdf_unsupported"
    if mime is None:
        return None, None, reason
    if mime == DOCX:
        body, why = read_entry(data, zip_entries(data)[0], "word/document.xml")
        if body is None:
            return None, mime, why
        text = folded_lines(word_lines(body.decode("utf-8", "replace")))
    else:
        plain = data.decode(encoding, "replace").replace("﻿", "").replace("\r\n", "\n").replace("\r", "\n")
        text = re.sub(r"\n{3,}", "\n\n", "\n".join(re.sub(r"[^\S\r\n]+", " ", x).rstrip() for x in plain.split("\n"))).strip()
    return (text, mime, "ok") if text else (None, mime, "empty_document")


def strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


@F.pandas_udf(strings("mime", "reason", "encoding").add("offset", T.IntegerType()))
def sniff_mime(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([sniff(c) for c in content], columns=["mime", "reason", "encoding", "offset"]).astype({"offset": "Int32"})


@F.pandas_udf(strings("text", "mime", "reason"))
def extract_text(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_text(c) for c in content], columns=["text", "mime", "reason"])


@F.pandas_udf(strings("reason").add("names", T.ArrayType(T.StringType())).add("sizes", T.ArrayType(T.LongType())))
def zip_directory(content: pd.Series) -> pd.DataFrame:
    found = [zip_entries(c or b"") for c in content]
    return pd.DataFrame([(why, [e.name for e in entries or []], [e.size for e in entries or []]) for entries, why in found], columns=["reason", "names", "sizes"])


@F.pandas_udf(strings("reason").add("content", T.BinaryType()))
def zip_entry(content: pd.Series, name: pd.Series) -> pd.DataFrame:
    """The bytes of an archive's entry, or why there are none."""
    rows = []
    for data, wanted in zip(content, name, strict=True):
        entries, why = zip_entries(data or b"")
        body, why = (None, why) if entries is None else read_entry(data, entries, wanted)
        rows.append((why, body))
    return pd.DataFrame(rows, columns=["reason", "content"])


def extracted(files: DataFrame, declared: Column | None = None) -> DataFrame:
    """files with text, mime and reason, and whether the type that was declared is another one."""
    rows = files.withColumn("_x", extract_text("content")).drop("content").select("*", "_x.*").drop("_x")
    return rows if declared is None else rows.withColumn("type_mismatch", F.coalesce(declared != F.col("mime"), F.lit(True)))

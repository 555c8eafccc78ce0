"""Uploads of files, request by request: all of a request's files are taken or none.

What a request comes to is decided from its role and its files' bytes before anything is kept. Contents
that repeat in a request, or that the role has already, become no candidate of their own; what was
stored for them, and for refused requests, is an orphan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenloom.sources.files import sniff_mime

#: Files that a request may have, and the codes of what is wrong with one, in the order of asking.
MAX_FILES = 25
ROLE_NOT_FOUND, ROLE_ARCHIVED, ROLE_NOT_SCOREABLE, TOO_MANY_FILES, EMPTY_UPLOAD, UNSUPPORTED = "ROLE_NOT_FOUND", "ROLE_ARCHIVED", "ROLE_NOT_SCOREABLE", "TOO_MANY_FILES", "EMPTY_UPLOAD", "UNSUPPORTED_FILE_TYPE"


def looked_at(files: DataFrame) -> DataFrame:
    """files (request, ordinal, filename, path, content) with byte_size, sha and type in place of the content."""
    seen = files.withColumn("_type", sniff_mime("content"))
    return seen.select("request", "ordinal", "filename", "path", F.length("content").cast("long").alias("byte_size"), F.sha2("content", 256).alias("sha"), F.col("_type.mime").alias("mime"), F.col("_type.reason").alias("reason"))


def gate(requests: DataFrame, roles: DataFrame, looked: DataFrame, max_files: int = MAX_FILES) -> DataFrame:
    """request, role_id, n_files, rejected and error for each request (request, role_id); error is null for one
    that is accepted. roles: role_id, archived, n_criteria. A request without files is one, too."""
    counts = looked.groupBy("request").agg(F.count(F.lit(1)).alias("n_files"), F.count_if(F.col("mime").isNull()).alias("rejected"))
    rows = requests.join(roles.select("role_id", "archived", "n_criteria", F.lit(True).alias("_known")), "role_id", "left").join(counts, "request", "left")
    n = F.coalesce("n_files", F.lit(0))
    error = (
        F.when(F.col("_known").isNull(), ROLE_NOT_FOUND)
        .when(F.col("archived"), ROLE_ARCHIVED)
        .when(F.col("n_criteria") == 0, ROLE_NOT_SCOREABLE)
        .when(n > max_files, TOO_MANY_FILES)
        .when(n == 0, EMPTY_UPLOAD)
        .when(F.col("rejected") > 0, UNSUPPORTED)
    )
    return rows.select("request", "role_id", n.alias("n_files"), F.coalesce("rejected", F.lit(0)).alias("rejected"), error.alias("error"))


def dispositions(looked: DataFrame, gated: DataFrame, existing: DataFrame) -> DataFrame:
    """looked with role_id, error, disposition and orphan: created; redundant, if the request has the content
    already; duplicate, if the role has it, by `existing` (role_id, sha) or by an earlier request; refused.

    Of a content's files the first is found by minima that are combined before the shuffle, so that one content in
    a third of all files is a row a task; the files meet it again by a join."""
    rows = looked.join(gated.select("request", "role_id", "error"), "request")
    taken = rows.filter("error IS NULL")
    firsts = taken.groupBy("role_id", "sha", "request").agg(F.min("ordinal").alias("_first"))
    makers = firsts.groupBy("role_id", "sha").agg(F.min("request").alias("_maker")).join(existing.select("role_id", "sha", F.lit(True).alias("_there")).distinct(), ["role_id", "sha"], "left")
    facts = firsts.join(makers, ["role_id", "sha"])
    rows = rows.join(facts, ["role_id", "sha", "request"], "left")
    disposition: Column = (
        F.when(F.col("error").isNotNull(), "refused").when(F.col("ordinal") != F.col("_first"), "redundant").when(F.col("_there") | (F.col("request") != F.col("_maker")), "duplicate").otherwise("created")
    )
    return rows.withColumn("disposition", disposition).withColumn("orphan", F.col("disposition") != "created").drop("_first", "_maker", "_there")


def commit(files: DataFrame, entries: DataFrame, path: str, batch: int) -> DataFrame:
    """Stores the bytes of the created entries in the folder of a batch and returns the paths of the orphans.
    Spark writes aside and moves files in when the job succeeds; a batch that is run again takes the place of its own folder."""
    kept = files.select("request", "ordinal", "content").join(entries.filter("NOT orphan").drop("content"), ["request", "ordinal"])
    kept.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch}")
    return entries.filter("orphan").select("request", "ordinal", "path", "disposition")

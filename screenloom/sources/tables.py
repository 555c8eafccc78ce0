"""The five tables of the screening store: their schemas, checked at load."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

SCHEMAS = {
    "roles": "id string, title string, description string, version int, archived_at timestamp, created_at timestamp, updated_at timestamp",
    "role_criteria": "id string, role_id string, label string, description string, weight int, position int",
    "role_elimination_rules": "id string, role_id string, label string, type string, value string, on_missing string, position int",
    "screening_jobs": "id string, role_id string, file_count int, created_at timestamp",
    "candidates": "id string, role_id string, job_id string, original_filename string, candidate_name string, storage_path string, content_sha256 string, mime_type string, byte_size int, status string, raw_text string, parsed_profile string, evaluation_matrix string, elimination_details string, eliminated boolean, eliminated_by string, match_score double, fit_category string, ai_justification string, scored_role_version int, error_code string, error_message string, attempts smallint, created_at timestamp, updated_at timestamp, completed_at timestamp",
}
#: What columns hold where a row doesn't say.
DEFAULTS = {"roles": {"description": "", "version": 1}, "role_criteria": {"description": ""}, "role_elimination_rules": {"on_missing": "flag"}, "candidates": {"status": "pending", "eliminated": False, "attempts": 0}}
LIST_COLUMNS = ("id", "role_id", "job_id", "original_filename", "candidate_name", "status", "eliminated", "eliminated_by", "match_score", "fit_category", "error_code", "created_at", "completed_at")
STATUS_COLUMNS = ("id", "status", "candidate_name", "eliminated", "match_score", "fit_category", "error_code", "error_message", "attempts", "updated_at")


#: Rows, and bytes, of an Arrow batch that goes to Python, where a session has no setting of its own. A batch of Spark's
#: 10,000 texts is held several times over by each task.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}
#: What they are in a session that doesn't say.
UNSET = {"spark.sql.execution.arrow.maxRecordsPerBatch": "10000"}


def small_batches(spark: SparkSession) -> SparkSession:
    """The session, with Arrow batches bounded in rows and bytes, so that a Python worker's memory doesn't grow with
    what its task reads."""
    own = {e.key: e.value for e in spark.sql("SET").select("key", "value").collect() if e.key in BATCHES}
    for key, value in BATCHES.items():
        if own.get(key, UNSET.get(key)) == UNSET.get(key):
            spark.conf.set(key, value)
    return spark


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the cluster's shared folder (spark.checkpoint.dir); a session on one machine that
    names none, as in tests, gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="screenloom-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def schema_of(name: str) -> T.StructType:
    return T._parse_datatype_string(SCHEMAS[name])


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A stored table; one whose columns aren't the declared ones is refused."""
    found = spark.read.parquet(f"{root}/{name}")
    want = [(f.name, f.dataType) for f in schema_of(name).fields]
    got = [(f.name, f.dataType) for f in found.schema.fields]
    if want != got:
        raise ValueError(f"{name} has columns {sorted(set(got) - set(want), key=str)} for {sorted(set(want) - set(got), key=str)}")
    return found


def empty_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], schema_of(name))


def append(df: DataFrame, root: str, name: str) -> None:
    columns = [f.name for f in schema_of(name).fields]
    df.select(*columns).write.mode("append").parquet(f"{root}/{name}")


def listed(candidates: DataFrame) -> DataFrame:
    """What a list shows: everything large stays in the files."""
    return candidates.select(*LIST_COLUMNS)


def status_rows(candidates: DataFrame) -> DataFrame:
    return candidates.select(*STATUS_COLUMNS)

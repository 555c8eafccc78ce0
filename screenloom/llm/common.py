"""What the operators share: tables, materialised intermediates, and the split of rows by crc32."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lower-cases A-Z and nothing else.
LOWER_ASCII = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: The ASCII white space that ends a word; bytes.split() splits at exactly these.
SPACES = b" \t\n\x0b\x0c\r"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the cluster's shared folder (spark.checkpoint.dir). If none is set, a session
    on one machine, as in tests, gets a temporary one; on a cluster that is an error."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="screenloom-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        sc.setCheckpointDir(own)
        base = sc.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df once into the shared folder and returns a reader of it: lineage ends here, so a
    lost executor costs the tasks it held and not the work before them."""
    return written(df, work_path(df.sparkSession, name))


#: Spark takes no more buckets than these for a table.
MOST_BUCKETS = 100_000


def bucketed(df: DataFrame, key: str, rows: int, name: str) -> DataFrame:
    """As materialise(), dealt by key into about as many buckets as rows are given and as many as shuffles have
    partitions at least: what is joined to it by the key goes to its buckets, and it is not shuffled itself."""
    spark = df.sparkSession
    n = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows), MOST_BUCKETS)
    path = work_path(spark, name)
    table = f"{name}_{uuid.uuid4().hex}".replace("-", "_")
    df.write.bucketBy(n, key).option("path", path).option("compression", "zstd").format("parquet").saveAsTable(table)
    return spark.read.table(table)


class Work:
    """Tables that a job needs only while it runs; they are deleted where the `with` block ends."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.tables = spark, []

    def __enter__(self) -> Work:
        return self

    def __exit__(self, *_) -> None:
        for _, path in self.tables:
            self.delete(path)

    def delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def table(self, df: DataFrame, name: str, instead_of: DataFrame | None = None) -> DataFrame:
        """df as materialise() gives it; the table that it takes the place of is deleted."""
        path = work_path(self.spark, name)
        out = written(df, path)
        for table, at in self.tables:
            if table is instead_of:
                self.delete(at)
        self.tables = [(t, at) for t, at in self.tables if t is not instead_of] + [(out, path)]
        return out


#: So many rows of a few numbers or a short name are sent to every task (some tens of MB at most);
#: more are joined by a shuffle.
BROADCAST_ROWS = 200_000


def few(small: DataFrame) -> DataFrame:
    """small, marked for a broadcast if it has few rows. It should be a written table, whose rows
    are counted by its files' footers."""
    return F.broadcast(small) if small.count() <= BROADCAST_ROWS else small


#: Rows in an Arrow batch of texts. Spark's 10,000 would be tens of MB, several times over in each task.
BATCH_ROWS = 1000


def in_batches(df: DataFrame) -> DataFrame:
    """df, with the session's Arrow batches cut to BATCH_ROWS unless it has its own setting."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if df.sparkSession.conf.get(key) == "10000":
        df.sparkSession.conf.set(key, str(BATCH_ROWS))
    return df


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """Names for columns beside those of docs: the given ones, lengthened where docs has them."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def crc_of_id(column: str = "doc_id") -> Column:
    """crc32 of the id as text; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))

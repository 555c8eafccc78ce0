"""Screening data derived from the supplied tables, as DataFrames and, under the same names, as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screenloom.operators.scoring import tier
from screenloom.sources.tables import small_batches

#: Weights and labels of the six criteria.
CRITERIA = ((1, "domain", 30), (2, "depth", 20), (3, "delivery", 20), (4, "communication", 15), (5, "tooling", 10), (6, "context", 5))
#: June 1996 as a month index: the clock of the work histories.
NOW = 1996 * 12 + 5
SKILLS = ("PostgreSQL administration", "Java", "C++", "Node.js", "C#")
#: Tables whose rows hold texts of any length.
TEXTS = ("documents", "pages", "conversations")
LEVELS = ("none", "high_school", "associate", "bachelors", "masters", "doctorate")


def load(spark: SparkSession, d: str, name: str) -> DataFrame:
    if name in TEXTS:
        small_batches(spark)
    return spark.read.parquet(f"{d}/{name}.parquet")


def spread(df: DataFrame, *keys: str, rows: int | None = None) -> DataFrame:
    """df dealt over all cores, some tasks each: rows that are short but costly lie in one task's split of a file,
    and Spark would put small shuffled partitions together again if their number weren't given. With `rows`, a task
    gets about that many at most, however large df is."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    if rows is not None:
        n = max(n, -(-df.count() // rows))
    return df.repartition(n, *keys)


def criteria(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p, p, label, w) for p, label, w in CRITERIA], "criterion_id int, position int, label string, weight int")


def ratings(spark: SparkSession, d: str) -> DataFrame:
    """Six ratings a document."""
    docs = load(spark, d, "documents").select("doc_id")
    each = docs.select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("criterion_id"))
    return each.withColumn("rating", ((F.col("doc_id") * 7 + F.col("criterion_id") * 3) % 11).cast("int"))


def broken_ratings(spark: SparkSession, d: str) -> DataFrame:
    """Ratings with gaps, unknown criteria and criteria rated twice."""
    rows = ratings(spark, d)
    kept = rows.filter(~((F.col("doc_id") % 5 == 0) & (F.col("criterion_id") == 3)))
    strange = rows.filter((F.col("doc_id") % 7 == 0) & (F.col("criterion_id") == 1)).withColumn("criterion_id", F.lit(99))
    twice = rows.filter((F.col("doc_id") % 11 == 0) & (F.col("criterion_id") == 2))
    return kept.union(strange).union(twice)


def candidates(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders")
    key = F.col("o_orderkey")
    status = F.when(key % 10 == 0, "pending").when(key % 10 == 1, "parsing").when(key % 10 == 2, "evaluating").when(key % 10 == 3, "failed").otherwise("done")
    raw = F.when(key % 10 > 3, (key * 37) % 1001)
    rows = o.select(
        key.alias("id"),
        (F.col("o_custkey") % 5).alias("role_id"),
        F.col("o_custkey").alias("job_id"),
        status.alias("status"),
        (raw / F.lit(10.0)).alias("match_score"),
        F.col("o_orderpriority").startswith("1-").alias("eliminated"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_orderdate").alias("updated_at"),
    )
    return rows.withColumn("tier", tier(F.col("match_score"), F.col("match_score").isNotNull() & F.col("eliminated")))


def work_history(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders")
    start = F.year("o_orderdate") * 12 + F.month("o_orderdate") - 1
    return o.select(F.col("o_custkey").alias("person"), F.col("o_orderkey").alias("entry"), start.alias("start"), F.when(F.col("o_orderkey") % 7 != 0, start + (F.col("o_orderkey") % 18).cast("int") - 1).alias("end"))


def transitions(spark: SparkSession, d: str) -> DataFrame:
    names = {"view": "claim", "click": "evaluate", "purchase": "finish", "error": "fail", "signup": "retry"}
    event = F.lit(None).cast("string")
    for k, v in names.items():
        event = F.when(F.col("event_type") == k, F.lit(v)).otherwise(event)
    return load(spark, d, "events").select("user_id", "ts", "event_id", event.alias("event"))


def uploads(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select(F.col("source").alias("role_id"), F.sha2("text", 256).alias("sha"), F.col("doc_id").alias("ordinal"))


def profiles(spark: SparkSession, d: str) -> DataFrame:
    """A profile for each customer, with gaps of every kind."""
    c = spread(load(spark, d, "customer"), "c_custkey")
    k = F.col("c_custkey")
    pick = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))
    skill = F.struct(pick(SKILLS, k).alias("name"), F.when(k % 2 == 0, "demonstrated").otherwise("listed").alias("evidenceType"))
    other = F.struct(pick(SKILLS, k + 2).alias("name"), F.lit("listed").alias("evidenceType"))
    school = F.struct(F.when(k % 4 != 0, pick(LEVELS, k)).alias("level"))
    cert = F.struct(F.lit("Cloud Architect").alias("name"), F.when(k % 3 == 0, F.lit("1995-12")).when(k % 3 == 1, F.lit("1996")).alias("expiryDate"))
    return c.select(
        k.alias("person"),
        F.struct(
            F.when(k % 6 != 0, (k % 120) / F.lit(10.0)).alias("computedYearsExperience"),
            F.when(k % 9 == 0, F.array().cast("array<struct<name:string,evidenceType:string>>")).when(k % 9 != 1, F.array(skill, other)).alias("skills"),
            F.when(k % 8 != 0, F.array(school)).alias("education"),
            F.when(k % 7 != 0, F.array(cert)).alias("certifications"),
            F.struct(F.when(k % 10 == 0, F.lit("  ")).when(k % 10 != 1, pick(("gb", " IE ", "US", "de"), k)).alias("countryCode")).alias("location"),
        ).alias("profile"),
    )


def _case(values: tuple[str, ...], by: str) -> str:
    return f"CASE ({by}) % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


#: SQL of the derived tables; sql() puts those a query names in front of it.
VIEWS = {
    "criteria": "SELECT * FROM (VALUES " + ", ".join(f"({p}, {p}, '{label}', {w})" for p, label, w in CRITERIA) + ") AS t(criterion_id, position, label, weight)",
    "ratings": "SELECT doc_id, c AS criterion_id, (doc_id * 7 + c * 3) % 11 AS rating FROM documents, (SELECT unnest(range(1, 7)) AS c)",
    "broken": "SELECT * FROM ratings WHERE NOT (doc_id % 5 = 0 AND criterion_id = 3) UNION ALL SELECT doc_id, 99, rating FROM ratings WHERE doc_id % 7 = 0 AND criterion_id = 1 UNION ALL SELECT * FROM ratings WHERE doc_id % 11 = 0 AND criterion_id = 2",
    "candidates": """SELECT *, CASE WHEN match_score IS NULL THEN NULL WHEN eliminated THEN 'unmatched' WHEN match_score >= 85 THEN 'strong_match' WHEN match_score >= 65 THEN 'potential_match' ELSE 'unmatched' END AS tier FROM (
      SELECT o_orderkey AS id, o_custkey % 5 AS role_id, o_custkey AS job_id,
        CASE o_orderkey % 10 WHEN 0 THEN 'pending' WHEN 1 THEN 'parsing' WHEN 2 THEN 'evaluating' WHEN 3 THEN 'failed' ELSE 'done' END AS status,
        CASE WHEN o_orderkey % 10 > 3 THEN ((o_orderkey * 37) % 1001) / 10e0 END AS match_score, o_orderpriority LIKE '1-%' AS eliminated, o_orderdate AS created_at, o_orderdate AS updated_at FROM orders)""",
    "work": 'SELECT person, entry, start, CASE WHEN entry % 7 <> 0 THEN start + entry % 18 - 1 END AS "end" FROM (SELECT o_custkey AS person, o_orderkey AS entry, year(o_orderdate) * 12 + month(o_orderdate) - 1 AS start FROM orders)',
    "resolved": f"""SELECT *, CASE WHEN kind = 'interval' THEN close END AS to_month FROM (
      SELECT *, CASE WHEN start > {NOW} THEN 'starts_in_the_future' WHEN close IS NULL THEN 'open' WHEN close < start THEN 'ends_before_start' ELSE 'interval' END AS kind FROM (
        SELECT *, CASE WHEN "end" IS NULL THEN CASE WHEN start >= max(start) OVER (PARTITION BY person) THEN {NOW} END ELSE least("end", {NOW}) END AS close FROM work))""",
    "merged": """SELECT person, min(start) AS start, max(to_month) AS "end" FROM (
      SELECT *, sum(begins) OVER (PARTITION BY person ORDER BY start, to_month ROWS UNBOUNDED PRECEDING) AS seg FROM (
        SELECT *, CASE WHEN start <= max(to_month) OVER (PARTITION BY person ORDER BY start, to_month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS begins
        FROM resolved WHERE kind = 'interval')) GROUP BY person, seg""",
    "uploads": "SELECT source AS role_id, sha256(text) AS sha, doc_id AS ordinal FROM documents",
    "people": f"""SELECT c_custkey AS person, c_custkey AS k, CASE WHEN c_custkey % 6 <> 0 THEN (c_custkey % 120) / 10e0 END AS years,
      CASE WHEN c_custkey % 9 > 1 THEN {_case(SKILLS, "c_custkey")} END AS skill1, CASE WHEN c_custkey % 2 = 0 THEN 'demonstrated' ELSE 'listed' END AS type1,
      CASE WHEN c_custkey % 9 > 1 THEN {_case(SKILLS, "c_custkey + 2")} END AS skill2,
      c_custkey % 8 <> 0 AS has_school, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey % 6 ELSE -1 END AS rank,
      c_custkey % 7 <> 0 AS has_cert, CASE c_custkey % 3 WHEN 0 THEN {1995 * 12 + 11} WHEN 1 THEN {1996 * 12 + 11} END AS expiry,
      upper(trim(CASE WHEN c_custkey % 10 = 0 THEN '  ' WHEN c_custkey % 10 <> 1 THEN {_case(("gb", " IE ", "US", "de"), "c_custkey")} END)) AS country FROM customer""",
}
NEEDS = {"broken": ["ratings"], "resolved": ["work"], "merged": ["resolved"]}


def sql(query: str, *views: str) -> str:
    """The query with the views it needs as common table expressions."""
    order: list[str] = []

    def add(v: str) -> None:
        for n in NEEDS.get(v, []):
            add(n)
        if v not in order:
            order.append(v)

    for v in views:
        add(v)
    return ("WITH " + ", ".join(f"{v} AS ({VIEWS[v]})" for v in order) + " " if order else "") + query

"""Scores, tiers, ranked pages, counts, lifecycle and uploads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screenloom.operators import ingest, lifecycle, ranking, scoring
from screenloom.plans import derived as D
from screenloom.plans.derived import sql

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return register


SCORES = "SELECT doc_id, sum(rating * weight)::BIGINT AS score_raw, sum(rating * weight) / 10e0 AS score FROM ratings JOIN criteria USING (criterion_id) GROUP BY doc_id"
TIER = "CASE WHEN elim THEN 'unmatched' WHEN score >= 85 THEN 'strong_match' WHEN score >= 65 THEN 'potential_match' ELSE 'unmatched' END"


@query(sql(SCORES, "criteria", "ratings"))
def weighted_score(spark: SparkSession, d: str) -> DataFrame:
    return scoring.weighted_score(D.ratings(spark, d), D.criteria(spark), ["doc_id"]).select("doc_id", "score_raw", "score")


@query(sql(f"SELECT doc_id, score, {TIER} AS tier FROM (SELECT *, doc_id % 9 = 0 AS elim FROM ({SCORES}))", "criteria", "ratings"))
def tier_assign(spark: SparkSession, d: str) -> DataFrame:
    return weighted_score(spark, d).select("doc_id", "score", scoring.tier(F.col("score"), F.col("doc_id") % 9 == 0).alias("tier"))


@query(sql("SELECT doc_id, sum(weight)::BIGINT AS weight_sum, sum(rating * weight)::BIGINT AS point_sum, true AS rows_agree, sum(weight) = 100 AS agrees FROM ratings JOIN criteria USING (criterion_id) GROUP BY doc_id", "criteria", "ratings"))
def matrix_reconcile(spark: SparkSession, d: str) -> DataFrame:
    made = scoring.matrix(D.ratings(spark, d), D.criteria(spark), ["doc_id"])
    return scoring.matrix_checks(made).select("doc_id", "weight_sum", "point_sum", "rows_agree", "agrees")


@query(sql("SELECT doc_id, string_agg(label || ':' || (rating * weight), ',' ORDER BY position) AS breakdown FROM ratings JOIN criteria USING (criterion_id) GROUP BY doc_id", "criteria", "ratings"))
def score_breakdown(spark: SparkSession, d: str) -> DataFrame:
    made = scoring.matrix(D.ratings(spark, d), D.criteria(spark), ["doc_id"])
    return made.select("doc_id", F.array_join(F.transform("criteria", lambda r: F.concat(r["label"], F.lit(":"), r["points"])), ",").alias("breakdown"))


RECONCILED = """SELECT doc_id, CASE WHEN dup IS NOT NULL THEN 'duplicate' WHEN missing IS NOT NULL THEN 'missing' ELSE 'ok' END AS verdict,
  coalesce(dup, '') AS duplicates, coalesce(missing, '') AS missing, coalesce(unknown, '') AS unknown FROM (SELECT DISTINCT doc_id FROM broken)
  LEFT JOIN (SELECT doc_id, string_agg(criterion_id, ',' ORDER BY criterion_id) AS dup FROM (SELECT doc_id, criterion_id FROM broken GROUP BY ALL HAVING count(*) > 1) GROUP BY doc_id) USING (doc_id)
  LEFT JOIN (SELECT doc_id, string_agg(criterion_id, ',' ORDER BY criterion_id) AS missing FROM (SELECT doc_id, criterion_id FROM (SELECT DISTINCT doc_id FROM broken), criteria) a WHERE NOT EXISTS (SELECT 1 FROM broken b WHERE a.doc_id = b.doc_id AND a.criterion_id = b.criterion_id) GROUP BY doc_id) USING (doc_id)
  LEFT JOIN (SELECT doc_id, string_agg(DISTINCT criterion_id, ',') AS unknown FROM broken WHERE criterion_id NOT IN (SELECT criterion_id FROM criteria) GROUP BY doc_id) USING (doc_id)"""


def _reconciled(spark: SparkSession, d: str) -> DataFrame:
    out = scoring.reconcile(D.broken_ratings(spark, d), D.criteria(spark), ["doc_id"])
    return out.select("doc_id", "verdict", *(F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("duplicates", "missing", "unknown")))


for _kind, _where in (("all", "true"), ("missing", "missing <> ''"), ("unknown", "unknown <> ''"), ("duplicate", "duplicates <> ''")):
    QUERIES[f"reconcile_{_kind}"] = lambda spark, d, where=_where: _reconciled(spark, d).filter(where)
    ORACLE_SQL[f"reconcile_{_kind}"] = sql(f"SELECT * FROM ({RECONCILED}) WHERE {_where}", "criteria", "broken")


PAGE = "SELECT id, role_id, match_score, tier FROM candidates WHERE role_id = 2 ORDER BY match_score {} NULLS LAST, id DESC LIMIT 25 OFFSET 25"


@query(sql(PAGE.format("DESC"), "candidates"))
def ranked_page_desc(spark: SparkSession, d: str) -> DataFrame:
    rows = D.candidates(spark, d).filter(ranking.matching(role=2)).select("id", "role_id", "match_score", "tier")
    return ranking.page(ranking.ranked(rows, "desc"), 2, 25)


@query(sql(PAGE.format("ASC"), "candidates"))
def ranked_page_asc(spark: SparkSession, d: str) -> DataFrame:
    rows = D.candidates(spark, d).filter(ranking.matching(role=2)).select("id", "role_id", "match_score", "tier")
    return ranking.page(ranking.ranked(rows, "asc"), 2, 25)


@query(sql("SELECT role_id, count_if(tier = 'strong_match') AS strong_match, count_if(tier = 'potential_match') AS potential_match, count_if(tier = 'unmatched') AS unmatched FROM candidates GROUP BY role_id", "candidates"))
def tier_counts(spark: SparkSession, d: str) -> DataFrame:
    return ranking.tier_counts(D.candidates(spark, d), ["role_id"])


COUNTS = "SELECT job_id, " + ", ".join(f"count_if(status = '{s}') AS {s}" for s in lifecycle.STATUSES) + ", count(*) AS total FROM candidates GROUP BY job_id"


@query(sql(COUNTS, "candidates"))
def job_status_counts(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.status_counts(D.candidates(spark, d))


JOBS = "(SELECT c_custkey AS job_id, (c_custkey % 40)::BIGINT AS file_count FROM customer)"
STATUS = "CASE WHEN total = 0 THEN 'completed' WHEN pending = total THEN 'queued' WHEN pending + parsing + evaluating > 0 THEN 'in_progress' WHEN failed > 0 THEN 'completed_with_failures' ELSE 'completed' END"
REPORT = f"SELECT *, {STATUS} AS job_status, file_count - total AS duplicates FROM (SELECT job_id, file_count, " + ", ".join(f"coalesce({s}, 0) AS {s}" for s in (*lifecycle.STATUSES, "total")) + f" FROM {JOBS} LEFT JOIN ({COUNTS}) USING (job_id))"


def _jobs(spark: SparkSession, d: str) -> DataFrame:
    jobs = D.load(spark, d, "customer").select(F.col("c_custkey").alias("job_id"), (F.col("c_custkey") % 40).alias("file_count"))
    return lifecycle.job_report(jobs, D.candidates(spark, d))


@query(sql(f"SELECT job_id, total, job_status FROM ({REPORT})", "candidates"))
def job_status_derived(spark: SparkSession, d: str) -> DataFrame:
    return _jobs(spark, d).select("job_id", "total", "job_status")


@query(sql(f"SELECT job_id, file_count, total, duplicates FROM ({REPORT})", "candidates"))
def job_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return _jobs(spark, d).select("job_id", "file_count", "total", "duplicates")


@query(sql("SELECT id, role_id, status FROM candidates WHERE role_id = 1 AND status IN ('pending', 'failed')", "candidates"))
def filter_status_in(spark: SparkSession, d: str) -> DataFrame:
    return D.candidates(spark, d).filter(ranking.matching(role=1, status_in=["pending", "failed"])).select("id", "role_id", "status")


@query(sql("SELECT id, status FROM candidates WHERE status = 'done' AND status IN ('pending', 'failed')", "candidates"))
def filter_contradiction(spark: SparkSession, d: str) -> DataFrame:
    return D.candidates(spark, d).filter(ranking.matching(status="done", status_in=["pending", "failed"])).select("id", "status")


@query(sql("SELECT id, status, strftime(updated_at, '%Y-%m-%d') AS day FROM candidates WHERE status IN ('pending', 'parsing', 'evaluating') AND updated_at < TIMESTAMP '1996-01-01' ORDER BY updated_at, id LIMIT 500", "candidates"))
def stuck_sweep(spark: SparkSession, d: str) -> DataFrame:
    cutoff = F.lit("1996-01-01").cast("timestamp_ntz")
    return lifecycle.stuck(D.candidates(spark, d), cutoff, 500).select("id", "status", F.date_format("updated_at", "yyyy-MM-dd").alias("day"))


@query(sql("SELECT count(*) AS found, count_if(status <> 'pending') AS released, count(*) AS enqueued FROM candidates WHERE status IN ('pending', 'parsing', 'evaluating') AND updated_at < TIMESTAMP '1996-01-01'", "candidates"))
def stuck_sweep_counts(spark: SparkSession, d: str) -> DataFrame:
    cutoff = F.lit("1996-01-01").cast("timestamp_ntz")
    rows = D.candidates(spark, d).filter(F.col("status").isin("pending", "parsing", "evaluating") & (F.col("updated_at") < cutoff))
    return lifecycle.sweep_counts(rows)


@query(sql("SELECT id, strftime(created_at, '%Y-%m-%d') AS day FROM candidates ORDER BY created_at DESC, id DESC LIMIT 25", "candidates"))
def newest_first(spark: SparkSession, d: str) -> DataFrame:
    rows = ranking.page(ranking.newest_first(D.candidates(spark, d)), 1)
    return rows.select("id", F.date_format("created_at", "yyyy-MM-dd").alias("day"))


@query(sql("SELECT count(*) AS total, greatest(1, ceil(count(*) / 25))::BIGINT AS total_pages FROM candidates WHERE role_id = 3", "candidates"))
def pagination_meta(spark: SparkSession, d: str) -> DataFrame:
    return ranking.page_meta(D.candidates(spark, d).filter(ranking.matching(role=3)))


@query(sql("SELECT id, role_id, job_id, status, match_score, tier FROM candidates WHERE id = 7", "candidates"))
def point_read(spark: SparkSession, d: str) -> DataFrame:
    return D.candidates(spark, d).filter("id = 7").select("id", "role_id", "job_id", "status", "match_score", "tier")


@query(sql("SELECT id, status FROM candidates WHERE id IN (1, 5, 33, 34, -1)", "candidates"))
def status_by_ids(spark: SparkSession, d: str) -> DataFrame:
    return D.candidates(spark, d).filter(F.col("id").isin(1, 5, 33, 34, -1)).select("id", "status")


@query("SELECT o_orderkey AS parent, coalesce(string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey), '') AS children FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def children_by_parents(spark: SparkSession, d: str) -> DataFrame:
    """Ordered children of a set of parents; childless parents get an empty list."""
    parents = D.load(spark, d, "orders").select(F.col("o_orderkey").alias("parent"))
    own = D.load(spark, d, "lineitem").select(F.col("l_orderkey").alias("parent"), F.struct("l_linenumber", "l_partkey").alias("c"))
    lists = own.groupBy("parent").agg(F.array_sort(F.collect_list("c")).alias("cs"))
    text = F.array_join(F.transform(F.coalesce("cs", F.array().cast("array<struct<l_linenumber:int,l_partkey:bigint>>")), lambda c: F.concat_ws(":", c["l_linenumber"], c["l_partkey"])), ",")
    return parents.join(lists, "parent", "left").select("parent", text.alias("children"))


@query(sql("SELECT role_id, ordinal, first, ordinal <> first AS redundant FROM (SELECT *, min(ordinal) OVER (PARTITION BY role_id, sha) AS first FROM uploads)", "uploads"))
def dedup_first_wins(spark: SparkSession, d: str) -> DataFrame:
    return ingest.first_wins(D.uploads(spark, d), ["role_id", "sha"], "ordinal").select("role_id", "ordinal", "first", "redundant")


@query(sql("SELECT min(ordinal) AS ordinal, sha, NOT EXISTS (SELECT 1 FROM uploads s WHERE s.ordinal % 3 = 0 AND s.sha = u.sha) AS created FROM uploads u WHERE ordinal % 3 <> 0 GROUP BY sha", "uploads"))
def idempotent_insert(spark: SparkSession, d: str) -> DataFrame:
    rows = D.uploads(spark, d).select("sha", "ordinal")
    return ingest.insert_new(rows.filter("ordinal % 3 = 0"), rows.filter("ordinal % 3 <> 0"), ["sha"], "ordinal").select("ordinal", "sha", "created")


@query(sql("SELECT count_if(created) AS created, count_if(NOT created) AS duplicates FROM (SELECT NOT EXISTS (SELECT 1 FROM uploads s WHERE s.ordinal % 3 = 0 AND s.sha = u.sha) AS created FROM (SELECT DISTINCT sha FROM uploads WHERE ordinal % 3 <> 0) u)", "uploads"))
def upload_counters(spark: SparkSession, d: str) -> DataFrame:
    return idempotent_insert(spark, d).agg(F.count_if("created").alias("created"), F.count_if(~F.col("created")).alias("duplicates"))


@query(sql("SELECT ordinal, sha, others FROM (SELECT *, count(*) OVER (PARTITION BY sha) - 1 AS others FROM uploads) WHERE others > 0", "uploads"))
def find_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return ingest.duplicates_of(D.uploads(spark, d), ["sha"], "ordinal")


@query("SELECT l_orderkey AS parent, l_linenumber AS child, 'old' AS what FROM lineitem WHERE l_orderkey % 4 <> 0 UNION ALL SELECT o_orderkey, 1, 'new' FROM orders WHERE o_orderkey % 4 = 0")
def replace_children(spark: SparkSession, d: str) -> DataFrame:
    line = D.load(spark, d, "lineitem").select(F.col("l_orderkey").alias("parent"), F.col("l_linenumber").alias("child"), F.lit("old").alias("what"))
    new = D.load(spark, d, "orders").filter("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("parent"), F.lit(1).alias("child"), F.lit("new").alias("what"))
    return ingest.replace_children(line, new, "parent")


@query("SELECT n_nationkey AS role_id FROM nation WHERE n_nationkey % 6 <> 0 AND EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey)")
def upload_eligible(spark: SparkSession, d: str) -> DataFrame:
    roles = D.load(spark, d, "nation").select(F.col("n_nationkey").alias("role_id"), F.when(F.col("n_nationkey") % 6 == 0, F.lit("1996-01-01")).alias("archived_at"))
    return ingest.eligible(roles, D.load(spark, d, "supplier").select(F.col("s_nationkey").alias("role_id"))).select("role_id")


@query("SELECT n_nationkey AS role_id, CASE WHEN n_nationkey % 6 = 0 THEN 'before' WHEN n_nationkey % 4 = 0 THEN 'now' END AS archived_at, CASE WHEN n_nationkey % 6 <> 0 AND n_nationkey % 4 = 0 THEN 'now' ELSE 'old' END AS updated_at FROM nation")
def archive_idempotent(spark: SparkSession, d: str) -> DataFrame:
    roles = D.load(spark, d, "nation").select(F.col("n_nationkey").alias("role_id"), F.when(F.col("n_nationkey") % 6 == 0, F.lit("before")).alias("archived_at"), F.lit("old").alias("updated_at"))
    return ingest.archive(roles, roles.filter("role_id % 4 = 0"), F.lit("now"))


PATCHED = "SELECT c.id, CASE WHEN p.id IS NOT NULL THEN p.status ELSE c.status END AS status, CASE WHEN p.id IS NOT NULL THEN p.match_score ELSE c.match_score END AS match_score, c.status AS was FROM candidates c LEFT JOIN (SELECT id, CASE WHEN id % 20 = 1 THEN 'done' ELSE status END AS status, CASE WHEN id % 20 = 1 THEN 50e0 END AS match_score FROM candidates WHERE id % 3 = 0) p USING (id)"


def _patched(spark: SparkSession, d: str) -> DataFrame:
    rows = D.candidates(spark, d).select("id", "status", "match_score", F.col("status").alias("was"))
    hit = F.col("id") % 20 == 1
    newer = rows.filter("id % 3 = 0").select("id", F.when(hit, "done").otherwise(F.col("status")).alias("status"), F.when(hit, F.lit(50.0)).alias("match_score"))
    return ranking.patch(rows, newer, "id", ["status", "match_score"])


@query(sql(PATCHED, "candidates"))
def patch_join(spark: SparkSession, d: str) -> DataFrame:
    return _patched(spark, d)


@query(sql(f"SELECT count_if(status = 'done' AND was <> 'done') AS newly_done FROM ({PATCHED})", "candidates"))
def transitions_since_load(spark: SparkSession, d: str) -> DataFrame:
    return _patched(spark, d).agg(F.count_if((F.col("status") == "done") & (F.col("was") != "done")).alias("newly_done"))


@query("SELECT l_orderkey, l_linenumber, size, greatest(0, least(size, 60 - coalesce(before, 0)))::BIGINT AS sent FROM (SELECT l_orderkey, l_linenumber, l_quantity::BIGINT AS size, sum(l_quantity::BIGINT) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (SELECT l_orderkey, l_linenumber, sum(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL))")
def byte_allocation(spark: SparkSession, d: str) -> DataFrame:
    rows = D.load(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").cast("long").alias("size"))
    return ranking.allocate(rows, ["l_orderkey"], "l_linenumber", "size", F.lit(60)).withColumn("sent", F.col("sent").cast("long"))


@query(sql("SELECT id, (id // 10 % 5 + 1)::INT AS attempt, (10000 * pow(2, id // 10 % 5))::BIGINT AS delay_ms FROM candidates WHERE status = 'failed'", "candidates"))
def backoff_schedule(spark: SparkSession, d: str) -> DataFrame:
    """When each failed candidate's next attempt is due."""
    failed = D.candidates(spark, d).filter("status = 'failed'").select("id", (F.floor(F.col("id") / 10) % 5 + 1).cast("int").alias("attempt"))
    return failed.withColumn("delay_ms", lifecycle.backoff_ms(F.col("attempt")))


@query(sql("SELECT id, CASE WHEN status <> 'failed' THEN 'status_conflict' WHEN id % 2 = 0 THEN 'source_file_missing' ELSE 'requeued' END AS disposition FROM candidates", "candidates"))
def retry_disposition(spark: SparkSession, d: str) -> DataFrame:
    return D.candidates(spark, d).select("id", lifecycle.retry_disposition(F.lit(True), F.col("status"), F.col("id") % 2 == 1).alias("disposition"))


TO = "CASE WHEN ev = 'claim' AND st = 'pending' THEN 'parsing' WHEN ev = 'evaluate' AND st = 'parsing' THEN 'evaluating' WHEN ev = 'finish' AND st = 'evaluating' THEN 'done' WHEN ev = 'fail' AND st IN ('pending', 'parsing', 'evaluating') THEN 'failed' WHEN ev = 'retry' AND st = 'failed' THEN 'pending' END"
FOLD = f"""WITH RECURSIVE log AS (
  SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n,
    CASE event_type WHEN 'view' THEN 'claim' WHEN 'click' THEN 'evaluate' WHEN 'purchase' THEN 'finish' WHEN 'error' THEN 'fail' WHEN 'signup' THEN 'retry' END AS ev FROM events
), fold AS (
  SELECT DISTINCT user_id, 0::BIGINT AS n, 'pending' AS st, 0::BIGINT AS accepted, 0::BIGINT AS refused, 0::BIGINT AS attempts FROM events
  UNION ALL
  SELECT user_id, n, coalesce(next, st), accepted + (next IS NOT NULL)::INT, refused + (next IS NULL)::INT, attempts + (next IS NOT NULL AND ev = 'retry')::INT
  FROM (SELECT f.user_id, l.n, st, ev, accepted, refused, attempts, {TO} AS next FROM fold f JOIN log l ON f.user_id = l.user_id AND l.n = f.n + 1)
)
SELECT user_id, st AS status, accepted, refused, attempts FROM fold f WHERE n = (SELECT max(n) FROM log l WHERE l.user_id = f.user_id)"""


@query(FOLD)
def transition_fold(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.fold_transitions(D.transitions(spark, d), "user_id", ["ts", "event_id"])


@query(sql("SELECT tier, quality, count(*) AS n FROM (SELECT doc_id, " + TIER + f" AS tier FROM (SELECT *, false AS elim FROM ({SCORES}))) JOIN labels USING (doc_id) GROUP BY tier, quality", "criteria", "ratings"))
def tier_label_agreement(spark: SparkSession, d: str) -> DataFrame:
    tiers = weighted_score(spark, d).select("doc_id", scoring.tier(F.col("score"), F.lit(False)).alias("tier"))
    return tiers.join(D.load(spark, d, "labels"), "doc_id").groupBy("tier", "quality").agg(F.count(F.lit(1)).alias("n"))

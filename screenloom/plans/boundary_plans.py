"""What crosses the boundary: parameters, validation, codes, display."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screenloom.functions import display
from screenloom.operators import failures, ranking, uploads, validation
from screenloom.plans import derived as D
from screenloom.plans.derived import load, sql
from screenloom.sources import replies, tables

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return register


@query("SELECT n_nationkey, array_to_string(list_filter(list_transform(string_split(n_name || ' , ,' || n_regionkey || ',', ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS items FROM nation")
def csv_parameter(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat("n_name", F.lit(" , ,"), F.col("n_regionkey").cast("string"), F.lit(","))
    return load(spark, d, "nation").select("n_nationkey", F.array_join(validation.split_list(raw), "|").alias("items"))


@query(
    """SELECT k AS role_id, array_to_string(list_filter([CASE WHEN k % 5 = 0 THEN 'title' END, CASE WHEN 50 - k % 3 + 50 <> 100 THEN 'WEIGHTS_MUST_SUM_TO_100' END,
    CASE WHEN k % 4 = 0 THEN 'DUPLICATE_CRITERION_LABEL' END], lambda x: x IS NOT NULL), ',') AS problems FROM (SELECT n_nationkey AS k FROM nation)"""
)
def role_validation(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    first = F.struct(F.lit("Depth").alias("label"), F.lit(50).alias("weight"))
    second = F.struct(F.when(k % 4 == 0, " depth").otherwise("Breadth").alias("label"), (50 - k % 3).cast("int").alias("weight"))
    title = F.when(k % 5 == 0, "  ").otherwise(F.col("n_name"))
    return load(spark, d, "nation").select(k.alias("role_id"), F.array_join(validation.role_problems(title, F.array(first, second)), ",").alias("problems"))


@query("SELECT doc_id, array_to_string(list_filter([CASE WHEN n_chars > 5000 THEN 'too_large' END, CASE WHEN n_chars = 0 THEN 'empty' END, CASE WHEN doc_id % 7 = 0 THEN 'wrong_type' END], lambda x: x IS NOT NULL), ',') AS problems FROM documents")
def file_checks(spark: SparkSession, d: str) -> DataFrame:
    mime = F.when(F.col("doc_id") % 7 == 0, "image/png").when(F.col("doc_id") % 7 == 1, "").otherwise("text/plain")
    return load(spark, d, "documents").select("doc_id", F.array_join(validation.file_problems(F.col("n_chars"), mime, ("text/plain",), 5000), ",").alias("problems"))


CODES = {"view": "UNSUPPORTED_FILE_TYPE", "click": "EMPTY_DOCUMENT", "error": "SOMETHING_ELSE", "signup": "SOURCE_FILE_MISSING"}


@query(
    """SELECT event_id, CASE event_type WHEN 'click' THEN 'EMPTY_DOCUMENT' WHEN 'signup' THEN 'SOURCE_FILE_MISSING' ELSE 'EXTRACTION_FAILED' END AS code, event_type IN ('error', 'purchase') AS retryable,
    CASE event_type WHEN 'view' THEN 415 WHEN 'signup' THEN 410 ELSE 500 END AS status FROM events"""
)
def failure_mapping(spark: SparkSession, d: str) -> DataFrame:
    code = reduce(lambda out, kv: F.when(F.col("event_type") == kv[0], kv[1]).otherwise(out), CODES.items(), F.lit(None).cast("string"))
    failure = validation.failure_of(code, ("UNSUPPORTED_FILE_TYPE", "EXTRACTION_FAILED", "EMPTY_DOCUMENT", "SOURCE_FILE_MISSING"))
    return load(spark, d, "events").select("event_id", failure["code"].alias("code"), failure["retryable"].alias("retryable"), validation.status_of(code).alias("status"))


@query("SELECT event_id, CASE s WHEN 0 THEN 5000 WHEN 1 THEN 8000 WHEN 2 THEN 20000 ELSE 30000 END AS interval_ms FROM (SELECT event_id, (event_id * 977) % 300000 // 60000 AS s FROM events)")
def poll_intervals(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").select("event_id", validation.poll_interval(F.lit(5000), (F.col("event_id") * 977) % 300000).alias("interval_ms"))


@query(sql("SELECT tier, range, count(c.tier) AS n FROM (VALUES ('strong_match', '85 to 100'), ('potential_match', '65 up to but not including 85'), ('unmatched', 'below 65, or eliminated at any score')) AS t(tier, range) LEFT JOIN candidates c USING (tier) GROUP BY ALL", "candidates"))
def tier_legend(spark: SparkSession, d: str) -> DataFrame:
    """The legend, with how many candidates each tier has."""
    counts = D.candidates(spark, d).filter("tier IS NOT NULL").groupBy("tier").agg(F.count(F.lit(1)).alias("n"))
    return validation.tier_legend(spark).join(counts, "tier", "left").select("tier", "range", F.coalesce("n", F.lit(0)).alias("n"))


@query(sql("SELECT id, role_id, coalesce(range, 'not scored') AS range FROM candidates LEFT JOIN (VALUES ('strong_match', '85 to 100'), ('potential_match', '65 up to but not including 85'), ('unmatched', 'below 65, or eliminated at any score')) AS t(tier, range) USING (tier)", "candidates"))
def tier_presentation(spark: SparkSession, d: str) -> DataFrame:
    """Three rows of legend are joined to every candidate."""
    rows = D.candidates(spark, d).join(F.broadcast(validation.tier_legend(spark)), "tier", "left")
    return rows.select("id", "role_id", F.coalesce("range", F.lit("not scored")).alias("range"))


@query(
    sql(
        """SELECT id, coalesce(printf('%.1f', match_score), '—') AS score, CASE WHEN b < 1024 THEN b || ' B' WHEN b / 1024e0 < 10 THEN printf('%.1f KB', b / 1024e0) WHEN b / 1024e0 < 1024 THEN printf('%.0f KB', floor(b / 1024e0 + 0.5e0)) ELSE printf('%.1f MB', b / 1048576e0) END AS size,
        CASE WHEN s < 60 THEN s || 's' ELSE printf('%dm %02ds', s // 60, s % 60) END AS elapsed, upper(status[1]) || status[2:] AS status, (id % 3) || ' file' || CASE WHEN id % 3 = 1 THEN '' ELSE 's' END AS files
        FROM (SELECT *, id * 1237 AS b, (id * 7919) // 1000 AS s FROM candidates)""",
        "candidates",
    )
)
def display_formats(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("id")
    return D.candidates(spark, d).select("id", display.score_text(F.col("match_score")).alias("score"), display.bytes_text(k * 1237).alias("size"), display.elapsed_text(k * 7919).alias("elapsed"), display.humanize(F.col("status")).alias("status"), display.pluralize(k % 3, "file").alias("files"))


@query(sql(" UNION ALL ".join(f"(SELECT id, status FROM candidates WHERE status = '{s}' ORDER BY created_at DESC, id DESC LIMIT 100)" for s in ("failed", "evaluating", "parsing", "pending")), "candidates"))
def attention_list(spark: SparkSession, d: str) -> DataFrame:
    """The newest rows of each status that asks for attention, a page of each."""
    return ranking.first_of_each(D.candidates(spark, d), "status", ("failed", "evaluating", "parsing", "pending")).select("id", "status")


@query(sql("SELECT id, status FROM candidates WHERE role_id = 4 AND tier = 'strong_match' AND (id <> 34 OR 34 IS NULL)", "candidates"))
def filter_combined(spark: SparkSession, d: str) -> DataFrame:
    rows = D.candidates(spark, d).filter(ranking.matching(role=4, tier="strong_match") & (F.col("id") != 34))
    return rows.select("id", "status")


_THROWN = ("timeout", "user_abort", "abort", "connection", "api", "api", "api", "other")
_STATUS = (400, 429, 401, 503, 500, 418, None)
_SENT = (
    "The Schema has parameters with unions", "schema: union-typed parameters", "Too many optional parameters in the schema", "this schema. It is not supported", "a schema as this is too complex", "parameters with type arrays",
    "schemas need grammar compilation, and exponential compilation", "the schema " + "x" * 90 + " unsupported", None,
)
_NTH = lambda values, by: f"CASE ({by}) % {len(values)} " + " ".join(f"WHEN {i} THEN " + ("NULL" if v is None else str(v) if isinstance(v, int) else f"'{v}'") for i, v in enumerate(values)) + " END"
_CALLS = f"SELECT event_id, {_NTH(_THROWN, 'event_id')} AS thrown, {_NTH(_STATUS, 'event_id')} AS status, CASE WHEN event_id % 11 = 0 THEN 'request_too_large' WHEN event_id % 5 = 0 THEN 'invalid_request_error' END AS error_type, {_NTH(_SENT, 'user_id')} AS message FROM events"
_LOW = "lower(message)"


@query(
    f"""WITH calls AS ({_CALLS}), kinds AS (SELECT *, CASE WHEN thrown = 'timeout' THEN 'timeout' WHEN thrown IN ('user_abort', 'abort') THEN 'aborted' WHEN thrown = 'connection' THEN 'connection' WHEN thrown = 'api' THEN CASE status WHEN 429 THEN 'rate_limit' WHEN 401 THEN 'authentication' WHEN 400 THEN 'bad_request' WHEN 503 THEN 'server' WHEN 500 THEN 'server' ELSE 'unknown' END ELSE 'unknown' END AS kind FROM calls),
    signs AS (SELECT *, CASE WHEN kind = 'bad_request' AND error_type IS DISTINCT FROM 'request_too_large' AND contains({_LOW}, 'schema') THEN CASE
      WHEN contains({_LOW}, 'parameters with type arrays') OR contains({_LOW}, 'parameters with unions') THEN 'too_many_union_parameters' WHEN contains({_LOW}, 'union-typed parameters') OR contains({_LOW}, 'exponential compilation') THEN 'union_compilation_cost'
      WHEN contains({_LOW}, 'too many optional parameters') OR contains({_LOW}, 'grammar compilation') THEN 'too_many_optional_parameters' WHEN message = 'a schema as this is too complex' THEN 'schema_unsupported' END END AS signature FROM kinds)
    SELECT event_id, kind, signature, CASE WHEN kind = 'bad_request' AND error_type = 'request_too_large' THEN 'AGENT_INPUT_TOO_LARGE' WHEN signature IS NOT NULL THEN 'AGENT_SCHEMA_REJECTED' WHEN kind IN ('timeout', 'aborted') THEN 'AGENT_TIMEOUT' WHEN kind = 'rate_limit' THEN 'AGENT_RATE_LIMIT' ELSE 'AGENT_UPSTREAM' END AS code,
      kind IN ('timeout', 'aborted', 'rate_limit', 'connection', 'server') AS retryable, coalesce(message, '{failures.GENERIC}') AS told FROM signs"""
)
def error_taxonomy(spark: SparkSession, d: str) -> DataFrame:
    """What calls of the model failed of, and what that means for a candidate's row."""
    nth = lambda values, by: F.expr(_NTH(values, by))
    error_type = F.when(F.col("event_id") % 11 == 0, "request_too_large").when(F.col("event_id") % 5 == 0, "invalid_request_error")
    rows = load(spark, d, "events").select("event_id", nth(_THROWN, "event_id").alias("thrown"), nth(_STATUS, "event_id").cast("int").alias("status"), error_type.alias("type"), nth(_SENT, "user_id").alias("message"))
    rows = rows.withColumn("f", failures.call_failure(F.col("thrown"), F.col("status"), F.col("type"), F.col("message")))
    stored = failures.candidate_failure(F.col("f.code"), F.col("f.retryable"), F.col("message"))
    return rows.withColumn("s", stored).select("event_id", "f.kind", "f.signature", F.col("s.error_code").alias("code"), F.col("s.retryable").alias("retryable"), F.col("s.error_message").alias("told"))


_FILES = "SELECT doc_id % 61 AS request, doc_id AS ordinal, doc_id % 61 % 7 AS role_id, CASE WHEN doc_id % 53 = 0 THEN 'bad' || text ELSE coalesce(text, '') END AS text, doc_id % 53 = 0 OR coalesce(text, '') = '' AS bad FROM documents"


@query(
    f"""WITH files AS ({_FILES}), gated AS (SELECT request, any_value(role_id) AS role_id, CASE any_value(role_id) WHEN 6 THEN 'ROLE_NOT_FOUND' WHEN 3 THEN 'ROLE_ARCHIVED' WHEN 5 THEN 'ROLE_NOT_SCOREABLE' ELSE CASE WHEN count(*) > 16 THEN 'TOO_MANY_FILES' WHEN bool_or(bad) THEN 'UNSUPPORTED_FILE_TYPE' END END AS error FROM files GROUP BY request),
    taken AS (SELECT f.*, error, min(CASE WHEN error IS NULL THEN ordinal END) OVER (PARTITION BY f.request, text) AS first, min(CASE WHEN error IS NULL THEN f.request END) OVER (PARTITION BY f.role_id, text) AS maker FROM files f JOIN gated USING (request)),
    there AS (SELECT DISTINCT doc_id % 7 AS role_id, text FROM documents WHERE doc_id % 9 = 0)
    SELECT request, ordinal, error, CASE WHEN error IS NOT NULL THEN 'refused' WHEN ordinal <> first THEN 'redundant' WHEN there.text IS NOT NULL OR maker <> request THEN 'duplicate' ELSE 'created' END AS disposition FROM taken t LEFT JOIN there ON there.role_id = t.role_id AND there.text = t.text"""
)
def upload_batches(spark: SparkSession, d: str) -> DataFrame:
    """The documents as files of some sixty requests, each taken whole or not at all."""
    docs = load(spark, d, "documents")
    text = F.coalesce("text", F.lit("")).cast("binary")
    content = F.when(F.col("doc_id") % 53 == 0, F.unhex(F.concat(F.lit("00"), F.hex(text)))).otherwise(text)
    files = docs.select((F.col("doc_id") % 61).alias("request"), F.col("doc_id").alias("ordinal"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"), F.concat(F.lit("in/"), F.col("doc_id").cast("string")).alias("path"), content.alias("content"))
    requests = docs.select((F.col("doc_id") % 61).alias("request")).distinct().withColumn("role_id", F.col("request") % 7)
    roles = spark.range(6).select(F.col("id").alias("role_id"), (F.col("id") == 3).alias("archived"), F.when(F.col("id") == 5, 0).otherwise(4).alias("n_criteria"))
    existing = docs.filter("doc_id % 9 = 0").select((F.col("doc_id") % 7).alias("role_id"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    looked = uploads.looked_at(files)
    return uploads.dispositions(looked, uploads.gate(requests, roles, looked, 16), existing).select("request", "ordinal", "error", "disposition")


_JSON = """'[{"label":"a ' || c_custkey || '","weight":"' || (c_custkey % 40) || '","extra":{"x":[1]}},{"label":"b","description":null,"weight":' || (c_custkey % 7) || ',"position":2},{"description":"d","weight":1.0e0,"position":"3"}]'"""


@query(
    f"""SELECT c_custkey AS role_id, (i - 1)::INTEGER AS ordinal, x->>'label' AS label, coalesce(x->>'description', '') AS description, (x->>'weight')::DOUBLE::INTEGER AS weight, (x->>'position')::INTEGER AS position
    FROM (SELECT c_custkey, i, ('[' || j || ']')::JSON->0->(i - 1) AS x FROM (SELECT c_custkey, {_JSON} AS j, unnest([1, 2, 3]) AS i FROM customer))"""
)
def record_sets(spark: SparkSession, d: str) -> DataFrame:
    """Criteria that come as JSON arrays, as typed rows with the table's defaults."""
    rows = load(spark, d, "customer").select(F.col("c_custkey").alias("role_id"), F.expr(_JSON.replace("1.0e0", "1")).alias("body"))
    return replies.record_set(rows, "body", "label string, description string, weight int, position int", tables.DEFAULTS["role_criteria"])


@query(
    """WITH b AS (SELECT c_custkey AS k FROM customer),
    first AS (
      SELECT k, 1 AS o, 0 AS i, 0 AS f, 'title' AS path, 'length' AS code FROM b WHERE k % 5 = 0
      UNION ALL SELECT k, 2, 0, 0, 'criteria', 'number' FROM b WHERE k % 17 = 0
      UNION ALL SELECT k, 3, 1, 0, 'criteria[1].label', 'length' FROM b WHERE k % 17 <> 0 AND k % 7 = 0
      UNION ALL SELECT k, 3, 0, 2, 'criteria[0].weight', 'range' FROM b WHERE k % 17 <> 0 AND k % 11 = 0
      UNION ALL SELECT k, 4, 0, 1, 'rules[0].type', 'unknown_value' FROM b WHERE k % 13 = 0
      UNION ALL SELECT k, 4, 0, 2, 'rules[0].value.level', 'malformed' FROM b WHERE k % 13 <> 0 AND k % 9 = 0
      UNION ALL SELECT k, 4, 1, 3, 'rules[1].on_missing', 'unknown_value' FROM b WHERE k % 8 = 0
    ), later AS (
      SELECT k, 5 AS o, 0 AS i, 0 AS f, 'criteria' AS path, 'WEIGHTS_MUST_SUM_TO_100' AS code FROM b WHERE k % 3 = 1 AND k NOT IN (SELECT k FROM first)
      UNION ALL SELECT k, 6, 1, 0, 'criteria[1].label', 'DUPLICATE_CRITERION_LABEL' FROM b WHERE k % 4 = 2 AND k NOT IN (SELECT k FROM first)
    ) SELECT k AS role_id, row_number() OVER (PARTITION BY k ORDER BY o, i, f) - 1 AS at, path, code FROM (SELECT * FROM first UNION ALL SELECT * FROM later)"""
)
def role_body_problems(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with roles as they are sent in, with the path of each field, in reading order."""
    k = F.col("c_custkey")
    none = F.lit(None).cast("string")
    criterion = lambda label, weight: F.struct(label.alias("label"), none.alias("description"), weight.cast("int").alias("weight"))
    first = criterion(F.lit("Depth"), F.when(k % 11 == 0, 101).otherwise(60 + F.when(k % 3 == 1, 1).otherwise(0)))
    second = criterion(F.when(k % 7 == 0, "  ").when(k % 4 == 2, " depth").otherwise("Breadth"), F.lit(40))
    criteria = F.when(k % 17 == 0, F.array().cast("array<struct<label:string,description:string,weight:int>>")).otherwise(F.array(first, second))

    def rule(label: str, kind: Column, on_missing: Column, **values: Column) -> Column:
        types = {"years": "double", "skill": "string", "matchMode": "string", "mustBeDemonstrated": "boolean", "level": "string", "name": "string", "countryCodes": "array<string>"}
        return F.struct(F.lit(label).alias("label"), kind.alias("type"), on_missing.alias("on_missing"), *(values.get(n, F.lit(None)).cast(t).alias(n) for n, t in types.items()))

    rules = F.array(
        rule("school", F.when(k % 13 == 0, "shoe_size").otherwise("required_education_level"), none, level=F.when(k % 9 == 0, "phd").otherwise("masters")),
        rule("place", F.lit("location_allowlist"), F.when(k % 8 == 0, "ignore").otherwise("eliminate"), countryCodes=F.array(F.lit("GB"))),
    )
    body = F.struct(F.when(k % 5 == 0, " ").otherwise(F.col("c_name")).alias("title"), none.alias("description"), criteria.alias("criteria"), rules.alias("rules"))
    rows = load(spark, d, "customer").select(k.alias("role_id"), F.posexplode(validation.body_problems(body)).alias("at", "p"))
    return rows.select("role_id", F.col("at").cast("long").alias("at"), "p.path", "p.code")

"""Roles with criteria of their own, candidates judged by them, reasons in words, pages with their counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screenloom.functions import text
from screenloom.operators import lifecycle, ranking, roles, rules, scoring
from screenloom.plans import derived as D
from screenloom.plans.derived import NOW, sql
from screenloom.plans.profile_plans import _FATAL, _LABELS, _OUT, _judged

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return register


#: 25 roles; each but every eighth has 3 to 5 criteria, those of every sixth add up to 99.
R_CRITERIA = """SELECT r AS role_id, r * 10 + p AS criterion_id, p AS position, 'c' || p AS label, CASE WHEN p = 1 THEN 100 - (n - 1) * 15 - CASE WHEN r % 6 = 5 THEN 1 ELSE 0 END ELSE 15 END AS weight
  FROM (SELECT n_nationkey AS r, 3 + n_nationkey % 3 AS n, unnest(range(1, 4 + n_nationkey % 3)) AS p FROM nation WHERE n_nationkey % 8 <> 7)"""
R_RATINGS = """SELECT id AS candidate, o_custkey % 25 AS role_id, CASE WHEN id % 7 = 0 AND p = 1 THEN 999 ELSE (o_custkey % 25) * 10 + p END AS criterion_id,
    CASE WHEN id % 13 = 0 AND p = 2 THEN NULL WHEN id % 31 = 0 AND p = 1 THEN 11 ELSE (id * 7 + p * 3) % 11 END AS rating
  FROM (SELECT o_orderkey AS id, o_custkey, unnest(CASE WHEN o_orderkey % 11 = 0 THEN [1, 2, 2, 3, 4, 5] ELSE [1, 2, 3, 4, 5] END) AS p FROM orders)
  WHERE id % 17 <> 0 AND p <= 3 + (o_custkey % 25) % 3 AND NOT (id % 5 = 0 AND p = 3)"""
R_VERDICTS = f"""WITH crit AS ({R_CRITERIA}), rat AS ({R_RATINGS}), who AS (SELECT o_orderkey AS candidate, o_custkey % 25 AS role_id, o_custkey AS person FROM orders),
  dup AS (SELECT DISTINCT candidate FROM (SELECT candidate, criterion_id FROM rat GROUP BY ALL HAVING count(*) > 1)),
  gone AS (SELECT candidate, string_agg(criterion_id, ',' ORDER BY criterion_id) AS missing FROM (SELECT w.candidate, c.criterion_id FROM who w JOIN crit c USING (role_id) WHERE NOT EXISTS (SELECT 1 FROM rat t WHERE t.candidate = w.candidate AND t.criterion_id = c.criterion_id)) GROUP BY candidate),
  odd AS (SELECT candidate, string_agg(DISTINCT criterion_id, ',' ORDER BY criterion_id) AS unknown FROM rat t WHERE NOT EXISTS (SELECT 1 FROM crit c WHERE c.role_id = t.role_id AND c.criterion_id = t.criterion_id) GROUP BY candidate),
  verdicts AS (SELECT candidate, role_id, CASE WHEN dup.candidate IS NOT NULL THEN 'duplicate' WHEN missing IS NOT NULL THEN 'missing' ELSE 'ok' END AS verdict, coalesce(missing, '') AS missing, coalesce(unknown, '') AS unknown FROM who LEFT JOIN dup USING (candidate) LEFT JOIN gone USING (candidate) LEFT JOIN odd USING (candidate))"""


#: Ratings are grouped in memory: so many candidates, with some five each, take about 0.4 GB of a task.
CANDIDATES_A_TASK = 250_000


def _roles(spark: SparkSession, d: str) -> DataFrame:
    return D.load(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("role_id"), F.col("n_name").alias("title"), (F.col("n_nationkey") % 4 + 1).cast("long").alias("version"))


def _criteria(spark: SparkSession, d: str) -> DataFrame:
    r, n = F.col("role_id"), F.col("role_id") % 3 + 3
    rows = _roles(spark, d).filter(r % 8 != 7).select("role_id", n.alias("n"), F.explode(F.sequence(F.lit(1).cast("long"), n)).alias("position"))
    first = 100 - (F.col("n") - 1) * 15 - F.when(r % 6 == 5, 1).otherwise(0)
    return rows.select("role_id", (r * 10 + F.col("position")).alias("criterion_id"), "position", F.concat(F.lit("c"), "position").alias("label"), F.when(F.col("position") == 1, first).otherwise(15).alias("weight"))


def _ratings(spark: SparkSession, d: str) -> DataFrame:
    """Dealt by candidate and role before each becomes its ratings, which then needn't be shuffled to be grouped."""
    o = D.load(spark, d, "orders").select(F.col("o_orderkey").alias("candidate"), (F.col("o_custkey") % 25).alias("role_id"))
    o = D.spread(o, "candidate", "role_id", rows=CANDIDATES_A_TASK)
    places = F.when(F.col("candidate") % 11 == 0, F.array(*map(F.lit, (1, 2, 2, 3, 4, 5)))).otherwise(F.array(*map(F.lit, (1, 2, 3, 4, 5))))
    rows = o.select("candidate", "role_id", F.explode(places).alias("p")).filter((F.col("p") <= F.col("role_id") % 3 + 3) & ~((F.col("candidate") % 5 == 0) & (F.col("p") == 3)) & (F.col("candidate") % 17 != 0))
    known = F.when((F.col("candidate") % 7 == 0) & (F.col("p") == 1), 999).otherwise(F.col("role_id") * 10 + F.col("p"))
    rating = F.when((F.col("candidate") % 13 == 0) & (F.col("p") == 2), F.lit(None)).when((F.col("candidate") % 31 == 0) & (F.col("p") == 1), 11).otherwise((F.col("candidate") * 7 + F.col("p") * 3) % 11)
    return rows.select("candidate", "role_id", known.alias("criterion_id"), rating.alias("rating"))


def _everyone(spark: SparkSession, d: str) -> DataFrame:
    return D.load(spark, d, "orders").select(F.col("o_orderkey").alias("candidate"), (F.col("o_custkey") % 25).alias("role_id"), F.col("o_custkey").alias("person"))


def _verdicts(spark: SparkSession, d: str, scored: bool = False) -> DataFrame:
    return scoring.reconcile(_ratings(spark, d), _criteria(spark, d), ["candidate"], scope=["role_id"], everyone=_everyone(spark, d), scored=scored)


@query(R_VERDICTS + " SELECT * FROM verdicts")
def reconcile_by_role(spark: SparkSession, d: str) -> DataFrame:
    said = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return _verdicts(spark, d).select("candidate", "role_id", "verdict", said("missing"), said("unknown"))


_REPORTS = sql(f"SELECT person, {' OR '.join(_FATAL.values())} AS eliminated, CASE {' '.join(f'WHEN {c} THEN {chr(39)}{_LABELS[k]}{chr(39)}' for k, c in _FATAL.items())} END AS eliminated_by FROM ({_OUT})", "people")


@query(
    R_VERDICTS
    + f""", sums AS (SELECT n_nationkey AS role_id, n_nationkey % 4 + 1 AS role_version, count(weight) AS n, sum(weight) AS weights FROM nation LEFT JOIN crit ON role_id = n_nationkey GROUP BY ALL),
  raw AS (SELECT candidate, sum(rating * weight) AS raw, bool_and(coalesce(rating BETWEEN 0 AND 10, false)) AS good FROM rat JOIN crit USING (role_id, criterion_id) GROUP BY candidate),
  told AS (SELECT v.candidate, role_id, role_version, r.eliminated, r.eliminated_by, raw, CASE WHEN n = 0 THEN 'no_criteria' WHEN weights <> 100 THEN 'weights_not_100' WHEN verdict <> 'ok' THEN verdict || '_ratings' WHEN NOT coalesce(good, false) THEN 'invalid_rating' WHEN r.person IS NULL THEN 'no_report' END AS problem
    FROM verdicts v JOIN sums USING (role_id) JOIN (SELECT candidate, person FROM who) USING (candidate) LEFT JOIN raw USING (candidate) LEFT JOIN (SELECT * FROM ({_REPORTS}) WHERE person % 29 <> 0) r USING (person))
  SELECT candidate, role_id, role_version, problem, CASE WHEN problem IS NULL THEN raw / 10e0 END AS score, eliminated, eliminated_by, CASE WHEN problem IS NULL THEN CASE WHEN eliminated THEN 'unmatched' WHEN raw >= 850 THEN 'strong_match' WHEN raw >= 650 THEN 'potential_match' ELSE 'unmatched' END END AS tier FROM told"""
)
def judged_candidates(spark: SparkSession, d: str) -> DataFrame:
    """All candidates, rated or not: their ratings held against the role's criteria and scored, their
    profiles against its rules, and tiered, with the role's version. Some have no profile yet."""
    report = rules.elimination(F.col("profile"), F.col("rules"), F.lit(NOW)).alias("r")
    people = _judged(spark, d).filter("person % 29 <> 0").select("person", report).select("person", F.col("r.eliminated"), F.col("r.eliminatedBy").alias("eliminated_by"))
    reports = _everyone(spark, d).hint("merge").join(people, "person").drop("person")
    return roles.judged(None, _verdicts(spark, d, scored=True), _criteria(spark, d), reports, _roles(spark, d))


@query(f"SELECT n_nationkey AS role_id, coalesce(n, 0)::BIGINT AS n, coalesce(w, 0)::BIGINT AS weight_sum FROM nation LEFT JOIN (SELECT role_id, count(*) AS n, sum(weight) AS w FROM ({R_CRITERIA}) GROUP BY role_id) ON role_id = n_nationkey")
def role_weight_sums(spark: SparkSession, d: str) -> DataFrame:
    return roles.weight_sums(_roles(spark, d), _criteria(spark, d))


def _assembled(spark: SparkSession, d: str) -> DataFrame:
    own = _roles(spark, d)
    needs = own.filter("role_id % 2 = 0").select("role_id", F.explode(F.array(*map(F.lit, (2, 1)))).alias("position")).withColumn("id", F.when(F.col("role_id") % 4 == 0, F.lit(7)).otherwise(F.col("position")))
    return roles.assembled(own, _criteria(spark, d).withColumnRenamed("criterion_id", "id"), needs)


@query(
    f"""SELECT n_nationkey AS role_id, coalesce(cs, '') AS criteria, CASE WHEN n_nationkey % 4 = 0 THEN '7,7' WHEN n_nationkey % 2 = 0 THEN '1,2' ELSE '' END AS rules,
      concat_ws(',', CASE WHEN cs IS NULL THEN 'no_criteria' WHEN w <> 100 THEN 'weights_not_100' END, CASE WHEN n_nationkey % 4 = 0 THEN 'repeated_rule_id' END) AS problems
      FROM nation LEFT JOIN (SELECT role_id, string_agg(criterion_id || ':' || label, ',' ORDER BY position) AS cs, sum(weight) AS w FROM ({R_CRITERIA}) GROUP BY role_id) ON role_id = n_nationkey"""
)
def role_assembly(spark: SparkSession, d: str) -> DataFrame:
    """Roles with criteria and rules in order, without weights, and what is wrong with them."""
    shown = F.transform(roles.shown_criteria(F.col("criteria")), lambda c: F.concat_ws(":", c["id"], c["label"]))
    return _assembled(spark, d).select("role_id", F.array_join(shown, ",").alias("criteria"), F.array_join(F.transform("rules", lambda r: r["id"].cast("string")), ",").alias("rules"), F.array_join(roles.problems(F.col("criteria"), F.col("rules")), ",").alias("problems"))


@query("SELECT n_nationkey AS role_id, CASE WHEN n_nationkey % 3 = 0 THEN lower(n_name) ELSE n_name END AS title, (n_nationkey % 4 + 1 + CASE WHEN n_nationkey % 3 = 0 THEN 1 ELSE 0 END)::BIGINT AS version FROM nation")
def replace_role(spark: SparkSession, d: str) -> DataFrame:
    own = _roles(spark, d)
    return roles.replaced(own, own.filter("role_id % 3 = 0").select("role_id", F.lower("title").alias("title")), ["title"])


@query(sql("SELECT id, match_score, count(*) OVER () AS total, greatest(1, ceil(count(*) OVER () / 25))::BIGINT AS total_pages, count_if(tier = 'strong_match') OVER () AS strong_match, count_if(tier = 'potential_match') OVER () AS potential_match, count_if(tier = 'unmatched') OVER () AS unmatched, count(tier) OVER () AS tiered FROM candidates WHERE role_id = 2 ORDER BY match_score DESC NULLS LAST, id DESC LIMIT 25", "candidates"))
def page_with_counts(spark: SparkSession, d: str) -> DataFrame:
    """A ranked page, and beside each row the total, the pages and the tiers of all that match."""
    rows = D.candidates(spark, d).filter(ranking.matching(role=2)).select("id", "match_score", "tier")
    return ranking.page_with_counts(ranking.ranked(rows, "desc"), 1, 25).select("id", "match_score", "total", "total_pages", "strong_match", "potential_match", "unmatched", "tiered")


@query(sql("SELECT id, id || '-retry-' || (id % 3 + 1) AS job FROM candidates WHERE status = 'failed'", "candidates"))
def retry_job_ids(spark: SparkSession, d: str) -> DataFrame:
    return D.candidates(spark, d).filter("status = 'failed'").select("id", lifecycle.retry_job_id(F.col("id"), F.col("id") % 3 + 1).alias("job"))


@query(sql("SELECT l.ordinal, c.status, c.status IS NULL AS unknown FROM uploads l LEFT JOIN candidates c ON c.id = l.ordinal", "uploads", "candidates"))
def upload_status(spark: SparkSession, d: str) -> DataFrame:
    """Each uploaded file with the status of its candidate, where there is one."""
    found = D.candidates(spark, d).select(F.col("id").alias("ordinal"), "status")
    return D.uploads(spark, d).select("ordinal").join(found, "ordinal", "left").withColumn("unknown", F.col("status").isNull())


_SPELL = "CASE c_custkey % 5 WHEN 0 THEN 'Ｊａｖａ ﬁnance' WHEN 1 THEN 'cafe' || chr(769) WHEN 2 THEN 'Ⅳ  ２０２０' WHEN 3 THEN 'plain TEXT' ELSE '“C++”－x' END"
_SPELT = "CASE c_custkey % 5 WHEN 0 THEN 'java finance' WHEN 1 THEN 'café' WHEN 2 THEN 'iv 2020' WHEN 3 THEN 'plain text' ELSE '\"c++\"-x' END"


@query(f"SELECT c_custkey, {_SPELT} AS form, c_custkey % 5 = 0 AS finance FROM customer")
def match_forms(spark: SparkSession, d: str) -> DataFrame:
    """Full-width letters, ligatures, accents apart and signs that look alike, in the form that is compared."""
    raw = F.expr(_SPELL.replace("||", "||").replace("chr(769)", "decode(unhex('CC81'), 'UTF-8')"))
    return D.load(spark, d, "customer").select("c_custkey", text.match_form(raw).alias("form"), text.holds_text(raw, F.lit("finance")).alias("finance"))


_ALLOWED = "'GB, IE, DE'"
_DETAILS = {
    "min_years": "CASE WHEN years IS NULL THEN 'years of experience could not be determined from the CV (rule asks for 5 years)' ELSE years || ' years computed from dates, minimum 5' END",
    "education": "CASE WHEN NOT has_school THEN 'no education was extracted, so \"bachelors\" could not be checked' WHEN rank < 0 THEN 'education is listed but none of it maps to a known level' ELSE 'highest education ' || ['none', 'high_school', 'associate', 'bachelors', 'masters', 'doctorate'][rank + 1] || ', minimum bachelors' END",
    "certification": "CASE WHEN NOT has_cert THEN 'no certifications were extracted, so \"Cloud Architect\" could not be checked' WHEN k % 3 = 0 THEN 'certification \"Cloud Architect\" expired on 1995-12' ELSE 'certification \"Cloud Architect\" is held' END",
    "location": f"CASE WHEN coalesce(country, '') = '' THEN 'no country could be determined from the CV (allowed: ' || {_ALLOWED} || ')' WHEN country IN ('GB', 'IE', 'DE') THEN 'location ' || country || ' is allowed' ELSE 'location ' || country || ' is not in ' || {_ALLOWED} END",
}


@query(sql("SELECT person, " + ", ".join(f"{v} AS {k}" for k, v in _DETAILS.items()) + " FROM people", "people"))
def rule_details(spark: SparkSession, d: str) -> DataFrame:
    """Why a rule came out as it did, in words."""
    rows = _judged(spark, d)
    which = {"min_years": 0, "education": 2, "certification": 3, "location": 4}
    return rows.select("person", *(rules.detail(F.col("profile"), F.col("rules")[i], F.lit(NOW)).alias(n) for n, i in which.items()))

"""Experience, dates, elimination rules and profile fields."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screenloom.functions import dates, profile
from screenloom.operators import experience, rules
from screenloom.plans import derived as D
from screenloom.plans.derived import NOW, sql

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return register


def _resolved(spark: SparkSession, d: str) -> DataFrame:
    return experience.resolve(D.work_history(spark, d), ["person"], NOW)


@query(sql("""SELECT person, printf('%04d-%02d', start // 12, start % 12 + 1) AS first_month, printf('%04d-%02d', "end" // 12, "end" % 12 + 1) AS last_month, ("end" - start + 1)::BIGINT AS months FROM merged""", "merged"))
def experience_segments(spark: SparkSession, d: str) -> DataFrame:
    return experience.segments(_resolved(spark, d), ["person"]).withColumn("months", F.col("months").cast("long"))


TOTALS = """SELECT person, n_entries, n_unusable, n_open, n_covered, CASE WHEN n_open = n_covered THEN m END AS months FROM (
  SELECT person, count(*) AS n_entries, count_if(kind NOT IN ('interval', 'open')) AS n_unusable, count_if(kind = 'open') AS n_open FROM resolved GROUP BY person)
  JOIN (SELECT r.person, count_if(kind = 'open' AND r.start >= since) AS n_covered FROM resolved r LEFT JOIN (SELECT person, min(CASE WHEN "end" >= {now} THEN start END) AS since FROM merged GROUP BY person) USING (person) GROUP BY r.person) USING (person)
  LEFT JOIN (SELECT person, sum("end" - start + 1)::BIGINT AS m FROM merged GROUP BY person) USING (person)""".replace("{now}", str(NOW))


@query(sql(f"SELECT *, floor(months * 10 / 12e0 + 0.5e0) / 10 AS years FROM ({TOTALS})", "merged"))
def experience_years(spark: SparkSession, d: str) -> DataFrame:
    return experience.experience(_resolved(spark, d), ["person"], NOW).select("person", "n_entries", "n_unusable", "n_open", "n_covered", F.col("months").cast("long").alias("months"), "years")


@query(sql("SELECT person, entry, kind FROM resolved WHERE kind <> 'interval'", "resolved"))
def experience_unusable(spark: SparkSession, d: str) -> DataFrame:
    return _resolved(spark, d).filter("kind <> 'interval'").select("person", "entry", "kind")


@query(sql(f"""SELECT r.person, r.entry, EXISTS (SELECT 1 FROM merged m WHERE m.person = r.person AND m.start <= r.start AND m."end" >= {NOW}) AS covered FROM resolved r WHERE kind = 'open'""", "merged"))
def coverage_exists(spark: SparkSession, d: str) -> DataFrame:
    rows = _resolved(spark, d)
    merged = experience.merge_intervals(rows.filter("kind = 'interval'").select("person", F.col("from_month").alias("start"), F.col("to_month").alias("end")), ["person"])
    lists = merged.groupBy("person").agg(F.collect_list(F.struct("start", "end")).alias("segments"))
    covered = F.coalesce(experience.covers(F.col("segments"), F.col("start"), F.lit(NOW)), F.lit(False))
    return rows.filter("kind = 'open'").join(lists, "person", "left").select("person", "entry", covered.alias("covered"))


#: Dates as people write them, made of a number, and their reading.
SPELLED = (
    "CASE o_orderkey % 9 WHEN 0 THEN strftime(o_orderdate, '%Y-%m') WHEN 1 THEN strftime(o_orderdate, '%Y') WHEN 2 THEN strftime(o_orderdate, '%b %Y') WHEN 3 THEN strftime(o_orderdate, '%B %Y') "
    "WHEN 4 THEN strftime(o_orderdate, '%m/%Y') WHEN 5 THEN strftime(o_orderdate, '%Y/%m/%d') WHEN 6 THEN 'Present' WHEN 7 THEN '13/2020' ELSE 'Foo 1999' END"
)
READ = "CASE WHEN o_orderkey % 9 IN (6, 7, 8) THEN NULL ELSE year(o_orderdate) END AS year, CASE WHEN o_orderkey % 9 IN (1, 6, 7, 8) THEN NULL ELSE month(o_orderdate) END AS month"


def _spelled(spark: SparkSession, d: str) -> DataFrame:
    k, day = F.col("o_orderkey") % 9, F.col("o_orderdate")
    text = (
        F.when(k == 0, F.date_format(day, "yyyy-MM")).when(k == 1, F.date_format(day, "yyyy")).when(k == 2, F.date_format(day, "MMM yyyy")).when(k == 3, F.date_format(day, "MMMM yyyy"))
        .when(k == 4, F.date_format(day, "MM/yyyy")).when(k == 5, F.date_format(day, "yyyy/MM/dd")).when(k == 6, "Present").when(k == 7, "13/2020").otherwise("Foo 1999")
    )
    return D.load(spark, d, "orders").select("o_orderkey", "o_orderdate", text.alias("said"))


@query(f"SELECT o_orderkey, {SPELLED} AS said, {READ}, o_orderkey % 9 = 6 AS is_present FROM orders")
def parse_date(spark: SparkSession, d: str) -> DataFrame:
    when = dates.parse_date(F.col("said"))
    return _spelled(spark, d).select("o_orderkey", "said", when["year"].cast("long").alias("year"), when["month"].cast("long").alias("month"), dates.is_present_word(F.col("said")).alias("is_present"))


@query(f"SELECT o_orderkey, CASE WHEN year IS NULL THEN false ELSE year * 12 + coalesce(month, 12) - 1 < {NOW} END AS expired FROM (SELECT o_orderkey, {READ} FROM orders)")
def is_expired(spark: SparkSession, d: str) -> DataFrame:
    return _spelled(spark, d).select("o_orderkey", dates.is_expired(F.col("said"), F.lit(NOW)).alias("expired"))


@query("SELECT o_orderkey, printf('%04d-%02d', i // 12, i % 12 + 1) AS month FROM (SELECT o_orderkey, year(o_orderdate) * 12 + month(o_orderdate) - 1 AS i FROM orders)")
def iso_month(spark: SparkSession, d: str) -> DataFrame:
    index = dates.month_index(F.year("o_orderdate"), F.month("o_orderdate"))
    return D.load(spark, d, "orders").select("o_orderkey", dates.iso_month(index).alias("month"))


# elimination rules

RULE = "id int, label string, type string, on_missing string, years double, skill string, matchMode string, mustBeDemonstrated boolean, level string, name string, countryCodes array<string>"
ROLE = [
    (1, "five years", "min_years_experience", "flag", 5.0, None, None, None, None, None, None),
    (2, "PostgreSQL", "required_skill", "flag", None, "postgresql", "normalized", True, None, None, None),
    (3, "bachelors", "required_education_level", "flag", None, None, None, None, "bachelors", None, None),
    (4, "architect", "required_certification", "eliminate", None, None, "exact", None, None, "Cloud Architect", None),
    (5, "region", "location_allowlist", "eliminate", None, None, None, None, None, None, ["GB", "IE", "DE"]),
]
SKILL_1, SKILL_2 = "skill1 LIKE 'PostgreSQL%'", "skill2 LIKE 'PostgreSQL%'"
VERDICTS = {
    "min_years": "CASE WHEN years IS NULL THEN 'indeterminate' WHEN years >= 5 THEN 'pass' ELSE 'fail' END",
    "skill": f"CASE WHEN skill1 IS NULL THEN 'indeterminate' WHEN {SKILL_1} AND type1 = 'demonstrated' THEN 'pass' ELSE 'fail' END",
    "education": "CASE WHEN NOT has_school OR rank < 0 THEN 'indeterminate' WHEN rank >= 3 THEN 'pass' ELSE 'fail' END",
    "certification": f"CASE WHEN NOT has_cert THEN 'indeterminate' WHEN expiry < {NOW} THEN 'fail' ELSE 'pass' END",
    "location": "CASE WHEN coalesce(country, '') = '' THEN 'indeterminate' WHEN country IN ('GB', 'IE', 'DE') THEN 'pass' ELSE 'fail' END",
}


def _role(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(ROLE, RULE)
    return rows.agg(F.array_sort(F.collect_list(F.struct(*rows.columns))).alias("rules"))


def _judged(spark: SparkSession, d: str) -> DataFrame:
    """Profiles with the rules of one role (a single row), both made readable once, before any rule."""
    role = _role(spark).withColumn("rules", rules.readable_rules(F.col("rules")))
    return D.profiles(spark, d).withColumn("profile", rules.readable(F.col("profile"))).crossJoin(F.broadcast(role))


for _n, (_name, _sql) in enumerate(VERDICTS.items()):
    ORACLE_SQL[f"rule_{_name}"] = sql(f"SELECT person, {_sql} AS outcome FROM people", "people")
    QUERIES[f"rule_{_name}"] = lambda spark, d, n=_n: _judged(spark, d).select("person", rules.outcome(F.col("profile"), F.col("rules")[n], F.lit(NOW)).alias("outcome"))

_OUT = "SELECT person, " + ", ".join(f"{v} AS {k}" for k, v in VERDICTS.items()) + " FROM people"
_LABELS = dict(zip(VERDICTS, (r[1] for r in ROLE), strict=True))
_PICK = lambda cond: "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {cond(k)} THEN '{label}' END" for k, label in _LABELS.items()) + "], lambda x: x IS NOT NULL), ',')"
_FATAL = {k: f"({k} = 'fail'" + (f" OR {k} = 'indeterminate')" if r[3] == "eliminate" else ")") for k, r in zip(VERDICTS, ROLE, strict=True)}


@query(
    sql(
        f"SELECT person, {' OR '.join(_FATAL.values())} AS eliminated, CASE {' '.join(f'WHEN {c} THEN {chr(39)}{_LABELS[k]}{chr(39)}' for k, c in _FATAL.items())} END AS eliminated_by, "
        + f"{_PICK(lambda k: f'{k} = {chr(39)}fail{chr(39)}')} AS failures, {_PICK(lambda k: f'{k} = {chr(39)}indeterminate{chr(39)}')} AS indeterminate FROM ({_OUT})",
        "people",
    )
)
def elimination_report(spark: SparkSession, d: str) -> DataFrame:
    got = _judged(spark, d).select("person", rules.report(F.col("profile"), F.col("rules"), F.lit(NOW)).alias("r"))
    return got.select("person", F.col("r.eliminated"), F.col("r.eliminatedBy").alias("eliminated_by"), F.array_join("r.failures", ",").alias("failures"), F.array_join("r.indeterminate", ",").alias("indeterminate"))


_RESULT = {"min_years": "min_years_experience", "skill": "required_skill", "education": "required_education_level", "certification": "required_certification", "location": "location_allowlist"}


@query(sql(" UNION ALL ".join(f"SELECT person, {r[0]} AS rule, '{_LABELS[k]}' AS label, '{_RESULT[k]}' AS type, '{r[3]}' AS on_missing, {k} AS outcome, {_FATAL[k]} AS eliminates, ({' OR '.join(f'{o} = {chr(39)}indeterminate{chr(39)}' for o in VERDICTS)}) AS has_indeterminate FROM ({_OUT})" for k, r in zip(VERDICTS, ROLE, strict=True)), "people"))
def elimination_results(spark: SparkSession, d: str) -> DataFrame:
    """Every rule of every report, with its type, what it came to, and whether that eliminates."""
    rows = _judged(spark, d)
    rows = rows.select("person", rules.report(F.col("profile"), rules.checked_rules(F.col("rules")), F.lit(NOW)).alias("r"))
    each = rows.select("person", F.col("r.hasIndeterminate").alias("has_indeterminate"), F.explode("r.results").alias("x"))
    return each.select("person", F.col("x.id").alias("rule"), "x.label", "x.type", "x.on_missing", "x.outcome", "x.eliminates", "has_indeterminate")


_NAMED = "CASE WHEN entry % 3 = 0 THEN NULL ELSE 'role ' || entry END"
_FIRM = "CASE WHEN entry % 2 = 0 THEN NULL ELSE 'firm ' || (entry % 50) END"


@query(
    sql(
        f"""SELECT person, coalesce(string_agg(CASE WHEN title IS NOT NULL AND firm IS NOT NULL THEN '"' || title || '" at "' || firm || '"' ELSE coalesce('"' || title || '"', '"' || firm || '"', 'an unnamed role') END
            || ' (started ' || printf('%04d-%02d', start // 12, start % 12 + 1) || ') has no end date, and a later role starts after it, so its end is unknown', '; ' ORDER BY start, entry) FILTER (kind = 'open' AND (since IS NULL OR start < since)), 'no usable employment dates') AS reason
          FROM (SELECT *, {_NAMED} AS title, {_FIRM} AS firm FROM resolved) LEFT JOIN (SELECT person, min(CASE WHEN "end" >= {NOW} THEN start END) AS since FROM merged GROUP BY person) USING (person)
          WHERE person IN (SELECT person FROM ({TOTALS}) WHERE months IS NULL) GROUP BY person""",
        "merged",
    )
)
def experience_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Why nobody knows the years of those whose years aren't known."""
    rows = _resolved(spark, d)
    entry = F.col("entry").cast("string")
    named = rows.withColumn("title", F.when(F.col("entry") % 3 != 0, F.concat(F.lit("role "), entry))).withColumn("firm", F.when(F.col("entry") % 2 != 0, F.concat(F.lit("firm "), (F.col("entry") % 50).cast("string"))))
    return experience.reasons(named.withColumn("said", dates.iso_month(F.col("start"))), ["person"], NOW, ["start", "entry"], "title", "firm", "said")


# profile fields

RAW_EMAIL = "CASE c_custkey % 5 WHEN 0 THEN upper(replace(c_name, '#', '.')) || '@Example.COM' WHEN 1 THEN 'see attached' WHEN 2 THEN '  ' WHEN 3 THEN 'a@b' ELSE ' x.' || c_custkey || '@mail.example.org ' END"
RAW_PHONE = "CASE c_custkey % 4 WHEN 0 THEN '+44 (0)20 ' || (7000000 + c_custkey) WHEN 1 THEN 'ext ' || (c_custkey % 100) WHEN 2 THEN '' ELSE '555-' || (1000 + c_custkey % 9000) END"
RAW_COUNTRY = "CASE c_custkey % 5 WHEN 0 THEN 'gb' WHEN 1 THEN 'Germany' WHEN 2 THEN ' De ' WHEN 3 THEN 'G1' END"


def _raw(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    as_text = k.cast("string")
    email = F.when(k % 5 == 0, F.concat(F.upper(F.regexp_replace("c_name", "#", ".")), F.lit("@Example.COM"))).when(k % 5 == 1, "see attached").when(k % 5 == 2, "  ").when(k % 5 == 3, "a@b").otherwise(F.concat(F.lit(" x."), as_text, F.lit("@mail.example.org ")))
    phone = F.when(k % 4 == 0, F.concat(F.lit("+44 (0)20 "), (k + 7000000).cast("string"))).when(k % 4 == 1, F.concat(F.lit("ext "), (k % 100).cast("string"))).when(k % 4 == 2, "").otherwise(F.concat(F.lit("555-"), (k % 9000 + 1000).cast("string")))
    country = F.when(k % 5 == 0, "gb").when(k % 5 == 1, "Germany").when(k % 5 == 2, " De ").when(k % 5 == 3, "G1")
    years = F.when(k % 3 == 0, k / F.lit(7.0)).when(k % 3 == 1, F.lit(-1.0) * k)
    return D.load(spark, d, "customer").select(k.alias("person"), email.alias("email"), phone.alias("phone"), country.alias("country"), years.alias("years"))


EMAIL = "CASE WHEN regexp_matches(e, '^[^\\s@]+@[^\\s@.]+(\\.[^\\s@.]+)+$') THEN e END"
PHONE = "CASE WHEN length(regexp_replace(p, '[^0-9]', '', 'g')) >= 7 THEN p END"
COUNTRY = "CASE WHEN regexp_matches(c, '^[A-Z]{2}$') THEN c END"
FIELDS = f"(SELECT c_custkey AS person, lower(trim({RAW_EMAIL})) AS e, trim({RAW_PHONE}) AS p, upper(trim({RAW_COUNTRY})) AS c, {RAW_EMAIL} AS e0, {RAW_PHONE} AS p0, {RAW_COUNTRY} AS c0 FROM customer)"


@query(f"SELECT person, {EMAIL} AS email FROM {FIELDS}")
def normalize_email(spark: SparkSession, d: str) -> DataFrame:
    return _raw(spark, d).select("person", profile.email(F.col("email")).alias("email"))


@query(f"SELECT person, {PHONE} AS phone FROM {FIELDS}")
def normalize_phone(spark: SparkSession, d: str) -> DataFrame:
    return _raw(spark, d).select("person", profile.phone(F.col("phone")).alias("phone"))


@query(f"SELECT person, {COUNTRY} AS country FROM {FIELDS}")
def normalize_country(spark: SparkSession, d: str) -> DataFrame:
    return _raw(spark, d).select("person", profile.country(F.col("country")).alias("country"))


@query("SELECT c_custkey AS person, CASE WHEN y >= 0 AND y <= 80 THEN floor(y * 10 + 0.5e0) / 10 END AS years FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_custkey / 7e0 WHEN c_custkey % 3 = 1 THEN -1e0 * c_custkey END AS y FROM customer)")
def normalize_years(spark: SparkSession, d: str) -> DataFrame:
    return _raw(spark, d).select("person", profile.stated_years(F.col("years")).alias("years"))


#: Texts of profiles by a number: some are blank, some absent.
_SAY = lambda k, m, word: f"CASE ({k}) % {m} WHEN 0 THEN '  ' WHEN 1 THEN NULL ELSE ' {word}  ' || ({k}) || ' ' END"
_LISTS = {
    "workHistory": {"employer": _SAY("k", 5, "firm"), "title": _SAY("k", 7, "role"), "startDate": _SAY("k", 11, "from"), "endDate": _SAY("k", 4, "to"), "summary": _SAY("k", 3, "did")},
    "education": {"institution": _SAY("k", 3, "school"), "degree": _SAY("k", 4, "degree"), "field": _SAY("k", 5, "field"), "level": "CASE k % 3 WHEN 0 THEN 'masters' WHEN 1 THEN ' ' END", "endDate": _SAY("k", 6, "until")},
    "certifications": {"name": "CASE k % 6 WHEN 0 THEN '   ' ELSE ' cert  ' || k % 9 END", "issuer": _SAY("k", 4, "issuer"), "issuedDate": _SAY("k", 5, "on"), "expiryDate": _SAY("k", 7, "till")},
    "skills": {"name": "CASE k % 7 WHEN 0 THEN '' WHEN 1 THEN 'SQL' WHEN 2 THEN ' sql' WHEN 3 THEN 'Node  JS' WHEN 4 THEN 'node js ' ELSE 'Go' END", "evidenceType": "CASE k % 3 WHEN 0 THEN 'demonstrated' ELSE 'listed' END", "evidenceQuote": _SAY("k", 4, "quote")},
}
_TOP = {
    "email": RAW_EMAIL, "phone": RAW_PHONE, "linkedinUrl": "CASE c_custkey % 4 WHEN 0 THEN 'https://www.linkedin.com/in/x' WHEN 1 THEN 'example.org/linkedin' WHEN 2 THEN ' ' END", "fullName": _SAY("c_custkey", 6, "Person"),
    "locationCity": "CASE c_custkey % 3 WHEN 0 THEN ' Leeds ' WHEN 1 THEN ' ' END", "locationRegion": "CASE c_custkey % 5 WHEN 0 THEN 'North' END", "locationCountryCode": RAW_COUNTRY,
}
_STATED = "CASE WHEN c_custkey % 3 = 0 THEN c_custkey / 7e0 WHEN c_custkey % 3 = 1 THEN -1e0 * c_custkey END"


def wire_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Profiles as they come in: customers, with their orders as entries of the four lists."""
    each = D.load(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("k"))
    people = D.spread(D.load(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey")
    for n, (name, fields) in enumerate(_LISTS.items()):
        entry = F.struct(*(F.expr(v).alias(f) for f, v in fields.items()))
        own = each.filter(F.col("k") % 4 == n).withColumn("k", F.floor(F.col("k") / 4)).select("c_custkey", "k", entry.alias("e"))
        people = people.join(own.groupBy("c_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "e"))), lambda x: x["e"]).alias(name)), "c_custkey", "left")
    top = [F.expr(v).alias(f) for f, v in _TOP.items()]
    return people.select(F.col("c_custkey").alias("person"), F.struct(*top, F.expr(_STATED.replace("e0", "D")).alias("statedYearsExperience"), *_LISTS).cast(profile.wire_schema()).alias("wire"))


_TIDY = lambda c: f"nullif(trim(regexp_replace({c}, '\\s+', ' ', 'g')), '')"


def _entry_changes(n: int, name: str, fields: dict[str, str]) -> str:
    """The log of a list, a row for each change: entries are rows with their place."""
    named = "name" in fields
    blank = f"{_TIDY('name')} IS NULL" if named else "false"
    rows = [f"SELECT person, {n} AS sec, i, -1 AS f, '{name}[' || i || ']' AS field, 'dropped_entry' AS action, 'blank_name' AS reason FROM {name} WHERE {blank}"] if named else []
    for k, f in enumerate(fields):
        path = f"'{name}[' || i || '].{f}'"
        if f == "evidenceQuote":
            rows.append(f"SELECT person, {n}, i, {k}, {path}, 'nulled_invalid', 'quote_without_demonstration' FROM {name} WHERE NOT ({blank}) AND evidenceType <> 'demonstrated' AND {f} IS NOT NULL")
            rows.append(f"SELECT person, {n}, i, {k + 1}, '{name}[' || i || ']', 'deduplicated', NULL FROM (SELECT *, row_number() OVER (PARTITION BY person, lower({_TIDY('name')}) ORDER BY i) AS c FROM {name} WHERE NOT ({blank})) WHERE c > 1")
        elif f not in profile.CLOSED and f != "name":
            rows.append(f"SELECT person, {n}, i, {k}, {path}, 'nulled_empty', NULL FROM {name} WHERE NOT ({blank}) AND {f} IS NOT NULL AND {_TIDY(f)} IS NULL")
    return " UNION ALL ".join(rows)


_TOP_LOG = " UNION ALL ".join(
    f"SELECT person, 0, 0, {k}, '{f}', CASE WHEN {_TIDY(f)} IS NULL THEN 'nulled_empty' ELSE 'nulled_invalid' END, CASE WHEN {_TIDY(f)} IS NOT NULL THEN '{why}' END FROM top WHERE {f} IS NOT NULL AND ({_TIDY(f)} IS NULL OR NOT ({good}))"
    for k, (f, why, good) in enumerate((("email", "not_an_address", "email LIKE '%@%.%'"), ("phone", "too_few_digits", "length(regexp_replace(phone, '[^0-9]', '', 'g')) >= 7"), ("linkedinUrl", "not_a_linkedin_url", "linkedinUrl LIKE '%linkedin.com/%'"), ("fullName", "", "true")))
)
_WIRED = (
    "WITH top AS (SELECT c_custkey AS person, " + ", ".join(f"{v} AS {f}" for f, v in _TOP.items()) + f", {_STATED} AS years FROM customer), "
    + ", ".join(
        f"{name} AS (SELECT person, row_number() OVER (PARTITION BY person ORDER BY k) - 1 AS i, " + ", ".join(f"{v} AS {f}" for f, v in fields.items()) + f" FROM (SELECT o_custkey AS person, o_orderkey // 4 AS k FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 4 = {n}))"
        for n, (name, fields) in enumerate(_LISTS.items())
    )
    + ", log(person, sec, i, f, field, action, reason) AS (" + " UNION ALL ".join(_entry_changes(n + 2, name, fields) for n, (name, fields) in enumerate(_LISTS.items()))
    + f" UNION ALL {_TOP_LOG} UNION ALL SELECT person, 1, 0, 0, 'location.countryCode', 'nulled_invalid', 'not_iso_alpha_2' FROM top WHERE {_TIDY('locationCountryCode')} IS NOT NULL AND NOT regexp_full_match(trim(locationCountryCode), '[A-Za-z]{{2}}')"
    + " UNION ALL SELECT person, 1, 0, 1, 'statedYearsExperience', 'nulled_invalid', 'implausible' FROM top WHERE years IS NOT NULL AND NOT years BETWEEN 0 AND 80)"
)


@query(_WIRED + " SELECT person, row_number() OVER (PARTITION BY person ORDER BY sec, i, f) - 1 AS at, field, action, reason FROM log")
def profile_changes(spark: SparkSession, d: str) -> DataFrame:
    """Everything that is taken from the profiles when they are made regular, with paths, in order."""
    rows = wire_profiles(spark, d).select("person", profile.normalised(F.col("wire")).alias("n"))
    each = rows.select("person", F.posexplode("n.changes").alias("at", "c"))
    return each.select("person", F.col("at").cast("long").alias("at"), "c.field", "c.action", "c.reason")


_FIRST = f"SELECT person, arg_min(n, i) AS n, arg_min(t, CASE WHEN t = 'demonstrated' THEN i ELSE 1000000 + i END) AS t, arg_min(q, CASE WHEN t = 'demonstrated' THEN i ELSE 1000000 + i END) AS q, min(i) AS i FROM (SELECT person, i, {_TIDY('name')} AS n, evidenceType AS t, CASE WHEN evidenceType = 'demonstrated' THEN coalesce({_TIDY('evidenceQuote')}, '') ELSE '' END AS q FROM skills WHERE {_TIDY('name')} IS NOT NULL) GROUP BY person, lower(n)"


@query(
    _WIRED
    + f""", s AS (SELECT person, string_agg(n || ':' || t || ':' || q, ',' ORDER BY i) AS skills FROM ({_FIRST}) GROUP BY person),
    c AS (SELECT person, string_agg({_TIDY('name')} || ':' || coalesce({_TIDY('issuer')}, '') || ':' || coalesce({_TIDY('expiryDate')}, ''), ',' ORDER BY i) AS certs FROM certifications GROUP BY person),
    w AS (SELECT person, count(*) AS n_work, count({_TIDY('title')}) AS n_titles FROM workHistory GROUP BY person), e AS (SELECT person, count(*) AS n_education, string_agg(coalesce(level, '-'), ',' ORDER BY i) AS levels FROM education GROUP BY person)
    SELECT person, CASE WHEN email LIKE '%@%.%' THEN lower(trim(email)) END AS email, CASE WHEN coalesce(locationCity, locationRegion, locationCountryCode) IS NULL THEN 'nowhere' ELSE coalesce({_TIDY('locationCity')}, '') || '/' || coalesce(locationRegion, '') || '/' || coalesce(CASE WHEN regexp_full_match(trim(locationCountryCode), '[A-Za-z]{{2}}') THEN upper(trim(locationCountryCode)) END, '') END AS place,
      coalesce(n_work, -1) AS n_work, coalesce(n_titles, -1) AS n_titles, levels, CASE WHEN c.person IS NULL THEN 'none' ELSE coalesce(certs, '') END AS certs, CASE WHEN k.person IS NULL THEN 'none' ELSE coalesce(s.skills, '') END AS skills
    FROM top LEFT JOIN s USING (person) LEFT JOIN (SELECT DISTINCT person FROM skills) k ON k.person = top.person LEFT JOIN c ON c.person = top.person LEFT JOIN w ON w.person = top.person LEFT JOIN e ON e.person = top.person"""
)
def profile_normalised(spark: SparkSession, d: str) -> DataFrame:
    """The profiles as they are kept: lists that are absent are told from empty ones."""
    p = F.col("p")
    blank = lambda c: F.coalesce(c, F.lit(""))
    place = F.when(p["location"].isNull(), "nowhere").otherwise(F.concat_ws("/", blank(p["location"]["city"]), blank(p["location"]["region"]), blank(p["location"]["countryCode"])))
    listed = lambda c, *fields: F.coalesce(F.array_join(F.transform(c, lambda e: F.concat_ws(":", *(blank(e[f]) for f in fields))), ","), F.lit("none"))
    rows = wire_profiles(spark, d).select("person", profile.normalised(F.col("wire"))["profile"].alias("p"))
    return rows.select(
        "person", p["email"].alias("email"), place.alias("place"), F.coalesce(F.size(p["workHistory"]), F.lit(-1)).cast("long").alias("n_work"),
        F.coalesce(F.size(F.filter(p["workHistory"], lambda e: e["title"].isNotNull())), F.lit(-1)).cast("long").alias("n_titles"),
        F.array_join(F.transform(p["education"], lambda e: F.coalesce(e["level"], F.lit("-"))), ",").alias("levels"), listed(p["certifications"], "name", "issuer", "expiryDate").alias("certs"), listed(p["skills"], "name", "evidenceType", "evidenceQuote").alias("skills"),
    )


@query(
    """WITH s AS (SELECT o_custkey AS person, o_orderkey AS pos, CASE o_orderkey % 4 WHEN 0 THEN 'Node JS' WHEN 1 THEN 'node  js ' WHEN 2 THEN 'SQL' ELSE ' sql' END AS name, o_orderkey % 3 = 0 AS shown FROM orders),
    k AS (SELECT *, lower(trim(regexp_replace(name, '\\s+', ' ', 'g'))) AS k, trim(regexp_replace(name, '\\s+', ' ', 'g')) AS n FROM s)
    SELECT person, string_agg(n || ':' || type || ':' || quote, ',' ORDER BY pos) AS skills FROM (
      SELECT person, k, min(pos) AS pos, arg_min(n, pos) AS n, CASE WHEN bool_or(shown) THEN 'demonstrated' ELSE 'listed' END AS type, coalesce(min(pos) FILTER (shown), min(pos)) AS quote FROM k GROUP BY person, k) GROUP BY person"""
)
def skill_merge(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    name = F.when(k % 4 == 0, "Node JS").when(k % 4 == 1, "node  js ").when(k % 4 == 2, "SQL").otherwise(" sql")
    kind = F.when(k % 3 == 0, "demonstrated").otherwise("listed")
    skill = F.struct(k.alias("pos"), name.alias("name"), kind.alias("evidenceType"), k.cast("string").alias("evidenceQuote"))
    lists = D.load(spark, d, "orders").groupBy(F.col("o_custkey").alias("person")).agg(F.array_sort(F.collect_list(skill)).alias("skills"))
    text = F.transform(profile.merge_skills(F.col("skills")), lambda s: F.concat_ws(":", s["name"], s["evidenceType"], s["evidenceQuote"]))
    return lists.select("person", F.array_join(text, ",").alias("skills"))


@query("SELECT c_custkey AS person, NULL::VARCHAR AS name, NULL::VARCHAR AS email, c_mktsegment AS segment FROM customer")
def redact_identity(spark: SparkSession, d: str) -> DataFrame:
    rows = D.load(spark, d, "customer").select(F.col("c_custkey").alias("person"), F.struct(F.col("c_name").alias("name"), F.lit("x@y.z").alias("email"), F.col("c_mktsegment").alias("segment")).alias("p"))
    return rows.withColumn("p", profile.redact(F.col("p"), ("name", "email"))).select("person", "p.*")


# integrity: each query lists what breaks a constraint

@query(sql("SELECT doc_id, sum(weight)::BIGINT AS weight_sum, count(*) AS n FROM broken JOIN criteria USING (criterion_id) GROUP BY doc_id HAVING sum(weight) <> 100", "criteria", "broken"))
def quality_weights(spark: SparkSession, d: str) -> DataFrame:
    rows = D.broken_ratings(spark, d).join(D.criteria(spark), "criterion_id")
    return rows.groupBy("doc_id").agg(F.sum("weight").alias("weight_sum"), F.count(F.lit(1)).alias("n")).filter("weight_sum <> 100")


@query(sql("SELECT id FROM candidates WHERE (status = 'done' AND id % 97 = 0) OR (status <> 'done' AND match_score IS NOT NULL)", "candidates"))
def quality_done_complete(spark: SparkSession, d: str) -> DataFrame:
    """Rows that are done without a score, a score being lost for each 97th id."""
    rows = D.candidates(spark, d).withColumn("match_score", F.when(F.col("id") % 97 != 0, F.col("match_score")))
    return rows.filter((F.col("status") == "done") & F.col("match_score").isNull() | (F.col("status") != "done") & F.col("match_score").isNotNull()).select("id")


@query(sql("SELECT id FROM candidates WHERE status = 'failed' AND id % 7 = 0", "candidates"))
def quality_error_pair(spark: SparkSession, d: str) -> DataFrame:
    """Failed rows, and any rows, whose error code and message aren't both there or both missing."""
    code = F.when(F.col("status") == "failed", "PARSE")
    rows = D.candidates(spark, d).select("id", "status", code.alias("code"), F.when(F.col("id") % 7 != 0, code).alias("message"))
    return rows.filter(F.col("code").isNull() != F.col("message").isNull()).select("id")


@query(sql("SELECT role_id, sha, count(*) AS n FROM uploads GROUP BY ALL HAVING count(*) > 1", "uploads"))
def quality_unique_content(spark: SparkSession, d: str) -> DataFrame:
    return D.uploads(spark, d).groupBy("role_id", "sha").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@query("SELECT p_partkey FROM part WHERE NOT (length(p_name) BETWEEN 1 AND 12 AND p_size BETWEEN 1 AND 40)")
def quality_ranges(spark: SparkSession, d: str) -> DataFrame:
    terms = [F.length("p_name").between(1, 12), F.col("p_size").between(1, 40)]
    return D.load(spark, d, "part").filter(~reduce(lambda a, b: a & b, terms)).select("p_partkey")


@query(sql("SELECT sum(n)::BIGINT AS total, CASE WHEN count(*) = count(n) THEN sum(n) END::BIGINT AS strict_total FROM (SELECT CASE WHEN c_custkey % 50 <> 0 THEN c_custkey END AS n FROM customer)"))
def usage_totals(spark: SparkSession, d: str) -> DataFrame:
    """A sum that skips nulls next to one that they make null."""
    n = F.when(F.col("c_custkey") % 50 != 0, F.col("c_custkey"))
    return D.load(spark, d, "customer").agg(F.sum(n).alias("total"), F.when(F.count_if(n.isNull()) == 0, F.sum(n)).alias("strict_total"))

"""The registered queries of the operators, with SQL twins where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_of_id, load
from .language import identify
from .licenses import labels_of, scan
from .mixing import mix_report
from .neighbours import nearest
from .packing import pack
from .quality import quality_rules
from .resampling import resample
from .scoring import lm_scores
from .secrets import find_secrets, listed
from .shards import write_shards
from .simhash import fingerprint_text, near_duplicates
from .urls import ALLOW, BLOCK, Rule, judge_urls
from .whitening import whiten


def op6_training_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = write_shards(load(spark, sf_dir, "documents").select("doc_id", "text"))
    part = lambda name: F.transform("parts", lambda p: p[name]).alias(f"{name}s" if name != "length" else "lengths")
    return found.select("slot", "shard", "byte_offset", "n_ids", "ids_crc32", part("doc_id"), part("start"), part("length"))


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "embeddings")
    return nearest(rows, F.col("vec_id") % 20 == 0, 20)


def op8_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(load(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules(load(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = crc_of_id() % 4 == 2
    return identify(docs, ~held_out).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(load(spark, sf_dir, "documents"))
    return found.select("doc_id", fingerprint_text().alias("fingerprint"), "component_id")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(load(spark, sf_dir, "documents"))
    base = F.transform(F.filter("places", lambda p: p["whole"]), lambda p: p["first_word"])
    score = F.coalesce(F.array_max(F.transform("places", lambda p: p["cover"])), F.lit(0.0))
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(base).alias("first_word"),
        F.array_max(base).alias("last_word"),
        labels_of("places", whole_only=True).alias("base_labels"),
        labels_of("places").alias("labels"),
        score.alias("score"),
    )


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm_scores(load(spark, sf_dir, "documents"), crc_of_id() % 10 != 0)
    return found.select("doc_id", (~F.col("teaches")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


URL_RULES = (
    Rule(ALLOW, "org", "/"),
    Rule(BLOCK, "example.org", "/es/"),
    Rule(BLOCK, "example.org", "/en/1"),
    Rule(ALLOW, "com", "/fr/"),
    Rule(BLOCK, "com", "/de/"),
)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(load(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict", "score")


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(load(spark, sf_dir, "documents")).drop("times")


def op11_whitened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(load(spark, sf_dir, "embeddings"))


def op12_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document counts as a file of its own repository, and its source as the owner."""
    found = find_secrets(load(spark, sf_dir, "documents"), owner_col="source", repository_col="doc_id")
    count = lambda holds: F.size(F.filter("spans", holds)).cast("long")
    of_kind = lambda kind: count(lambda s: s["kind"] == kind).alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["base"])
    return found.select(
        "doc_id",
        *map(of_kind, ("assign", "access", "hex")),
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed("spans").alias("spans"),
        count(lambda s: s["live"] & ~s["copied"]).alias("n_live"),
        count(lambda s: s["copied"]).alias("n_copied"),
    )


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_license_scan": op3_license_scan,
    "op4_url_filter": op4_url_filter,
    "op5_mix_sources": op5_mix_sources,
    "op6_training_shards": op6_training_shards,
    "op7_nearest_neighbours": op7_nearest_neighbours,
    "op8_pack_sequences": op8_pack_sequences,
    "op9_quality_rules": op9_quality_rules,
    "op10_lm_score": op10_lm_score,
    "op11_whitened": op11_whitened,
    "op12_importance_resample": op12_importance_resample,
    "op13_secret_scan": op13_secret_scan,
}

_OP9 = r"""
WITH words AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, [w[i], w[i+1], w[i+2], w[i+3], w[i+4]] AS win
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1))) AS i FROM words)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM windows) WHERE c > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM twice, (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM words)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), counts AS (
  SELECT w.doc_id, w.source, len(w.w)::BIGINT AS n_words,
    length(regexp_replace(w.text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(w.text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(l.n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(c.n_repeat_words, 0)::BIGINT AS n_repeat_words,
    coalesce(l.n_lines, 0) AS n_lines
  FROM words w LEFT JOIN covered c USING (doc_id) LEFT JOIN lines l USING (doc_id)
), fails AS (
  SELECT *, n_words < 10 AS few, 100 * n_repeat_words > 20 * n_words AS rep, 100 * n_symbols > 30 * n_words AS sym, 100 * n_dup_lines > 50 * n_lines AS dup,
    n_words < 20 OR 100 * n_repeat_words > 10 * n_words OR 100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 30 * n_lines AS tight
  FROM counts
), host AS (
  SELECT source, rule, count(*) AS n, sum(f::INT) AS f
  FROM (SELECT source, unnest(['few', 'rep', 'sym', 'dup']) AS rule, unnest([few, rep, sym, dup]) AS f FROM fails) GROUP BY ALL
), prior AS (
  SELECT rule, sum(f) / sum(n) AS m, sum(f * f / n) / sum(n) - m * m - m * (1 - m) * count(*) / sum(n) AS spread FROM host GROUP BY rule
), bad AS (
  SELECT DISTINCT source FROM host JOIN (
    SELECT rule, m, CASE WHEN spread > 0 THEN least(greatest(m * (1 - m) / spread - 1, 2), 1e6) ELSE 1e6 END AS s FROM prior
  ) USING (rule) WHERE (f + m * s) / (n + s) > 0.5
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, few OR rep AS base_failed,
  NOT (few OR rep OR sym OR dup OR (tight AND EXISTS (SELECT 1 FROM bad WHERE bad.source IS NOT DISTINCT FROM fails.source))) AS kept
FROM fails
"""

_OP7 = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), scored AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.r <> c.r AND len(q.e) = len(c.e)
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 20
"""

_ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_KINDS = ((_ASSIGN, "regexp_extract(v, '" + _ASSIGN + "', 2)"), ("AKIA[A-Z0-9]{16,}", "v"), ("[0-9a-f]{24,}", "v"), ("[A-Za-z0-9_+=-]{20,}", "v"))

_OP13 = f"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS x FROM documents),
runs AS ({" UNION ALL ".join(f"SELECT r, {k} AS kind, regexp_extract_all(x, '{p}') AS m, string_split_regex(x, '{p}') AS g FROM texts WHERE regexp_matches(x, '{p}')" for k, (p, _) in enumerate(_KINDS))}),
each AS (SELECT r, kind, m[k] AS v, k, length(g[k]) + length(m[k]) AS step FROM (SELECT *, unnest(range(1, len(m) + 1)) AS k FROM runs)),
placed AS (SELECT *, sum(step) OVER (PARTITION BY r, kind ORDER BY k) AS e FROM each),
valued AS (SELECT *, CASE kind {" ".join(f"WHEN {k} THEN {v}" for k, (_, v) in enumerate(_KINDS))} END AS secret FROM placed),
mixed AS (
  SELECT *, e - length(v) AS s, regexp_matches(secret, '[0-9]') AND regexp_matches(secret, '[A-Za-z]') AND len(list_distinct(string_split(secret, ''))) >= 10 AS live FROM valued
), held AS (
  SELECT * FROM mixed WHERE kind IN (1, 2) OR kind = 0 AND length(secret) >= 6
  OR kind = 3 AND live AND length(v) <= 200 AND len(regexp_extract_all(v, '[0-9]')) >= 3 AND len(regexp_extract_all(v, '[a-z]')) >= 3 AND len(regexp_extract_all(v, '[A-Z]')) >= 3
), spans AS (
  SELECT * FROM held h WHERE kind < 3 OR NOT EXISTS (SELECT 1 FROM held b WHERE b.r = h.r AND b.kind < 3 AND b.s < h.e AND b.e > h.s)
), owned AS (
  SELECT secret, count(DISTINCT coalesce('=' || source, 'null')) AS owners, count(DISTINCT [coalesce('=' || source, 'null'), coalesce('=' || doc_id, 'null')]) AS repositories
  FROM spans JOIN texts USING (r) GROUP BY secret
), judged AS (
  SELECT *, owners > 2 OR owners > 1 AND repositories > 20 AS copied, ['assign', 'access', 'hex', 'key'][kind + 1] || ':' || s::BIGINT || ':' || e::BIGINT AS told FROM spans JOIN owned USING (secret)
), listed AS (
  SELECT r, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS c, count(*) FILTER (kind = 2) AS h, string_agg(told, ',' ORDER BY s, kind) FILTER (kind < 3) AS base,
    string_agg(told, ',' ORDER BY s, kind) AS told, count(*) FILTER (live AND NOT copied) AS n_live, count(*) FILTER (copied) AS n_copied
  FROM judged WHERE kind < 3 OR NOT copied GROUP BY r
)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(told, '') AS spans,
  coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
FROM texts LEFT JOIN listed USING (r)
"""

#: crc32 a byte at a time, with a table that follows from its polynomial.
_OP12 = r"""
WITH tab AS (
  SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS t
), texts AS (
  SELECT row_number() OVER () AS r, doc_id, text FROM documents UNION ALL SELECT -row_number() OVER (), NULL, text FROM benchmark
), words AS (
  SELECT r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts
), counted AS (
  SELECT r, f, count(*) AS n FROM (
    SELECT r, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) || list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS f FROM words
  ) GROUP BY ALL
), kinds AS (
  SELECT f, flatten(list_transform(string_split(f, ''), lambda c: CASE
    WHEN unicode(c) < 128 THEN [unicode(c)] WHEN unicode(c) < 2048 THEN [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)]
    WHEN unicode(c) < 65536 THEN [224 + (unicode(c) >> 12), 128 + ((unicode(c) >> 6) & 63), 128 + (unicode(c) & 63)]
    ELSE [240 + (unicode(c) >> 18), 128 + ((unicode(c) >> 12) & 63), 128 + ((unicode(c) >> 6) & 63), 128 + (unicode(c) & 63)] END)) AS bytes
  FROM (SELECT DISTINCT f FROM counted)
), features AS (
  SELECT r, n, xor(list_reduce(bytes, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 10000 AS bucket FROM counted JOIN kinds USING (f), tab
), gains AS (
  SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (all_s + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (all_t + 10000)::DOUBLE)))::BIGINT AS gain
  FROM (SELECT bucket, coalesce(sum(n) FILTER (r > 0), 0) AS s, coalesce(sum(n) FILTER (r < 0), 0) AS t FROM features GROUP BY bucket), (SELECT coalesce(sum(n) FILTER (r > 0), 0) AS all_s, coalesce(sum(n) FILTER (r < 0), 0) AS all_t FROM features)
), weights AS (
  SELECT r, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM features JOIN gains USING (bucket) GROUP BY r
), scored AS (
  SELECT doc_id, len(w) >= 20 AS part, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('42:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5e0) / 4294967296e0)))::BIGINT AS score
  FROM words LEFT JOIN weights USING (r) WHERE r > 0
)
SELECT doc_id, n_features, weight, score, CASE WHEN part AND place <= (SELECT 5 * count(*) // 100 FROM scored WHERE part) THEN place END AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY score DESC, doc_id) AS place FROM scored)
"""

ORACLE_SQL = {
    "op12_importance_resample": _OP12,
    "op13_secret_scan": _OP13,
    "op7_nearest_neighbours": _OP7,
    "op9_quality_rules": _OP9,
}

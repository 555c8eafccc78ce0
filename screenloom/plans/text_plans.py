"""Texts: guards, matching, evidence, score figures, markup, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screenloom.functions import markup, text
from screenloom.operators import evidence
from screenloom.plans import derived as D

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return register


FOLDED = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"
_SIGNAL = " OR ".join(f"contains(lower(t), '{w}')" for w in text.SIGNAL_WORDS)


@query(
    f"""SELECT doc_id, array_to_string(list_filter([CASE WHEN length(t) < 200 THEN 'too_short' END, CASE WHEN ratio < 0.5 THEN 'not_enough_letters' END,
    CASE WHEN NOT ({_SIGNAL} OR regexp_matches(t, '\\b(19|20)[0-9]{{2}}\\b')) THEN 'no_cv_signal' END], lambda x: x IS NOT NULL), ',') AS failures, length(t)::BIGINT AS characters, letters::BIGINT AS letters FROM (
      SELECT *, length(regexp_replace(t, '\\P{{L}}', '', 'g')) AS letters, CASE WHEN length(replace(t, ' ', '')) = 0 THEN 0 ELSE letters / length(replace(t, ' ', '')) END AS ratio FROM (SELECT doc_id, {FOLDED} AS t FROM documents))"""
)
def text_assess(spark: SparkSession, d: str) -> DataFrame:
    folded = D.load(spark, d, "documents").select("doc_id", text.fold_space(F.coalesce("text", F.lit(""))).alias("t"))
    t = F.col("t")
    return folded.select("doc_id", F.array_join(text.folded_failures(t), ",").alias("failures"), F.length(t).cast("long").alias("characters"), text.letters(t).cast("long").alias("letters"))


@query("SELECT doc_id, length(text) / (1 + doc_id % 9) AS per_page, length(text) / (1 + doc_id % 9) < 100 AS image_only FROM documents")
def text_layer(spark: SparkSession, d: str) -> DataFrame:
    pages = F.col("doc_id") % 9 + 1
    return D.load(spark, d, "documents").select("doc_id", (F.length("text") / pages).alias("per_page"), text.image_only(F.length("text"), pages).alias("image_only"))


@query("SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE length(regexp_replace(text, '[^\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g')) / length(text) END AS ratio FROM documents")
def control_ratio(spark: SparkSession, d: str) -> DataFrame:
    return D.load(spark, d, "documents").select("doc_id", text.control_ratio(F.col("text")).alias("ratio"))


_WORDS = lambda c: f"list_filter(regexp_split_to_array(lower(trim(regexp_replace({c}, '\\s+', ' ', 'g'))), '[^\\p{{L}}\\p{{N}}+#]+'), lambda x: x <> '')"


@query(f"SELECT doc_id, len({_WORDS('text')})::BIGINT AS n_words, {_WORDS('text')}[1] AS first_word, contains(' ' || array_to_string({_WORDS('text')}, ' ') || ' ', ' apache license ') AS holds FROM documents")
def tokenize_match(spark: SparkSession, d: str) -> DataFrame:
    rows = D.load(spark, d, "documents").select("doc_id", text.words(F.col("text")).alias("w"))
    return rows.select("doc_id", F.size("w").cast("long").alias("n_words"), F.get("w", F.lit(0)).alias("first_word"), text.in_a_row(F.col("w"), text.words(F.lit("Apache  License"))).alias("holds"))


@query("SELECT doc_id, md5(trim(regexp_replace(regexp_replace(replace(raw, chr(13) || chr(10), chr(10)), ' +(\\n|$)', '\\1', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'))) AS tidy FROM (SELECT doc_id, replace(replace(text, '. ', '. ' || chr(13) || chr(10)), ', ', '  ' || chr(10) || chr(10) || chr(10)) AS raw FROM documents)")
def txt_normalise(spark: SparkSession, d: str) -> DataFrame:
    raw = F.replace(F.replace("text", F.lit(". "), F.lit(". \r\n")), F.lit(", "), F.lit("  \n\n\n"))
    return D.load(spark, d, "documents").select("doc_id", F.md5(text.tidy_lines(raw).cast("binary")).alias("tidy"))


FORM = "lower(trim(regexp_replace({}, '\\s+', ' ', 'g')))"


@query(f"SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains({FORM.format('d.text')}, {FORM.format('b.text')})")
def evidence_contains(spark: SparkSession, d: str) -> DataFrame:
    quotes = D.load(spark, d, "benchmark").select("item_id", "text")
    return evidence.contained(quotes, D.load(spark, d, "documents").select("doc_id", "text"), "item_id", "text", "doc_id", "text")


@query(f"SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 'listed' WHEN EXISTS (SELECT 1 FROM documents d WHERE contains({FORM.format('d.text')}, {FORM.format('b.text')})) THEN 'demonstrated' ELSE 'listed' END AS evidence FROM benchmark b")
def evidence_downgrade(spark: SparkSession, d: str) -> DataFrame:
    items = D.load(spark, d, "benchmark").select("item_id", F.when(F.col("item_id") % 3 == 0, "listed").otherwise("demonstrated").alias("said"))
    held = evidence_contains(spark, d).select("item_id").distinct().withColumn("held", F.lit(True))
    skill = F.struct(F.col("said").alias("evidenceType"), F.coalesce("held", F.lit(False)).alias("evidenceVerified"))
    return items.join(held, "item_id", "left").select("item_id", F.get(evidence.downgrade(F.array(skill)), F.lit(0))["evidenceType"].alias("evidence"))


#: Sentences that do and don't give a score away, told apart by the turn.
SAID = (
    "Strong fit, 82% match.", "Rated 8/10 overall.", "A score of 80 seems right.", "We scored 8 projects.", "I would rate them 90 overall.", "Their rating reflects 8 years.",
    "Rating: 8", "scored 8.5 years", "matches 4 of the 6 criteria", "score roughly 8.5.", "Well, I'd say\n 9 / 10", "The ratings of Priya’s team score: at 77", "some 12.5  per cent of it", "We SCORED an extraordinarily-long-named applicant 85",
)


_IN = lambda t, words: f"coalesce({t} IN (" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "), false)"
_NEAR = ", ".join(f"lag({c}, {k}) OVER w AS {c}b{k}" for c in ("t", "apart", "raw") for k in range(1, 5)) + ", " + ", ".join(f"lead({c}, {k}) OVER w AS {c}a{k}" for c in ("t", "apart", "raw") for k in range(1, 4))


def _behind(c: str, k: int) -> str:
    return f"{c}b{k}" if k else c


def _span(first: int, last: int) -> str:
    """The text of the tokens from `first` before a number to `last` after it."""
    return "ltrim(" + " || ".join([*(_behind("raw", k) for k in range(first, -1, -1)), *(f"rawa{k}" for k in range(1, last + 1))]) + ", chr(9) || chr(10) || chr(13) || ' ')"


def _score_words() -> list[str]:
    """Cases of a number that a score word leads to, first the direct ones and then, if the number counts nothing, the loose ones."""
    apart = lambda n: " AND ".join(f"coalesce({_behind('apart', k)}, true)" for k in range(n + 1))
    direct, loose = [], []
    for n in range(text.LEADING_BETWEEN, -1, -1):
        between = " AND ".join([apart(n), *(_IN(_behind("t", k), text.LEADING_WORDS) for k in range(1, n + 1))])
        direct.append(f"WHEN {between} AND {_behind('t', n + 1)} = ':' AND {_IN(_behind('t', n + 2), text.SCORE_WORDS)} THEN {_span(n + 2, 0)}")
        if n:
            direct.append(f"WHEN {between} AND {_IN(_behind('t', n + 1), text.SCORE_WORDS)} THEN {_span(n + 1, 0)}")
    for n in range(text.ANY_BETWEEN, -1, -1):
        between = " AND ".join([apart(n), *(f"{_behind('t', k)} SIMILAR TO '[a-z][a-z’''-]*'" for k in range(1, n + 1))])
        told = f"ltrim({_behind('raw', n + 1)}) || ' ... ' || ltrim(raw)" if n else _span(1, 0)
        loose.append(f"WHEN {between} AND {_IN(_behind('t', n + 1), text.SCORE_WORDS)} THEN {told}")
    single = [w for w in text.SCALE_WORDS if " " not in w]
    ends = f"ta1 IS NULL OR NOT regexp_matches(ta1, '^[\\pL\\pN_]') OR coalesce(aparta1, true) AND ({_IN('ta1', text.FUNCTION_WORDS)} OR {_IN('ta1', single)} OR ta1 = 'out' AND coalesce(ta2 = 'of', false))"
    return [f"CASE {' '.join(direct)} END", f"CASE WHEN {ends} THEN CASE {' '.join(loose)} END END"]


#: The figures of texts (id, text), from tokens as rows that see their neighbours.
FIGURES = f"""tokens AS (SELECT id, i, raws[i] AS raw, lower(regexp_replace(raws[i], '^\\s+', '')) AS t, regexp_matches(raws[i], '^\\s') AS apart
  FROM (SELECT id, raws, unnest(range(1, len(raws) + 1)) AS i FROM (SELECT id, regexp_extract_all(text, '\\s*(?:[0-9]+(?:\\.[0-9]+)?|[\\pL_][\\pL\\pN_’''-]*|[^\\s])') AS raws FROM texts))),
near AS (SELECT *, {_NEAR} FROM tokens WINDOW w AS (PARTITION BY id ORDER BY i)),
numbers AS (SELECT * FROM near WHERE t SIMILAR TO '[0-9]+([.][0-9]+)?'),
told AS (
  SELECT id, i, 1 AS rank, 'percentage' AS kind, CASE WHEN ta1 IN ('%', 'percent') THEN {_span(0, 1)} WHEN ta1 = 'per' AND ta2 = 'cent' THEN {_span(0, 2)} END AS span FROM numbers
  UNION ALL SELECT id, i, 2, 'out_of_scale', CASE WHEN ta1 = '/' AND ta2 IN ('10', '100') AND NOT (NOT coalesce(aparta3, true) AND coalesce(regexp_matches(ta3, '^[/\\pL_]'), false)) THEN {_span(0, 2)} END FROM numbers
  UNION ALL SELECT id, i, 3, 'score_word', {_score_words()[0]} FROM numbers
  UNION ALL SELECT id, i, 4, 'score_word', {_score_words()[1]} FROM numbers
), figures AS (SELECT id, arg_min(kind, rank * 1000000 + i) AS figure, left(arg_min(span, rank * 1000000 + i), {text.MAX_TOLD}) AS span FROM told WHERE span IS NOT NULL GROUP BY id)"""


@query(
    "WITH texts AS (SELECT row_number() OVER () AS id, conv_id, turn, concat_ws(' ', text, CASE (conv_id + turn) % 14 " + " ".join(f"WHEN {i} THEN '{s.replace(chr(39), chr(39) * 2)}'" for i, s in enumerate(SAID)) + f" END) AS text FROM conversations), {FIGURES} "
    "SELECT conv_id, turn, figure, span FROM texts LEFT JOIN figures USING (id)"
)
def score_figure_scan(spark: SparkSession, d: str) -> DataFrame:
    """The first score figure that each turn gives away, by kind and by words."""
    said = F.element_at(F.array(*map(F.lit, SAID)), ((F.col("conv_id") + F.col("turn")) % 14 + 1).cast("int"))
    found = text.score_figure(F.concat_ws(" ", "text", said)).alias("f")
    return D.load(spark, d, "conversations").select("conv_id", "turn", found).select("conv_id", "turn", F.col("f.kind").alias("figure"), F.col("f.span").alias("span"))


_RAW = "CASE item_id % 6 WHEN 0 THEN text || '\"}]' WHEN 1 THEN '{[ \"' || text || '\"' WHEN 2 THEN '\"' || text || '\",' WHEN 3 THEN ' }], ' WHEN 4 THEN text ELSE text || '\"' END"
_T1 = f"(SELECT item_id, regexp_replace(regexp_replace(trim({_RAW}), '[\\s}}\\],]+$', ''), '^[\\s{{\\[,]+', '') AS t FROM benchmark)"
_QUOTES = "(length(t) - length(replace(t, '\"', '')))"
_T2 = f"(SELECT item_id, CASE WHEN t LIKE '%\"' AND {_QUOTES} % 2 = 1 THEN regexp_replace(left(t, length(t) - 1), '[\\s}}\\],]+$', '') ELSE t END AS t FROM {_T1})"
_T3 = f"SELECT item_id, nullif(trim(CASE WHEN length(t) > 1 AND t LIKE '\"%\"' AND {_QUOTES} = 2 THEN t[2:length(t) - 1] ELSE t END), '') AS cleaned FROM {_T2}"


@query(_T3)
def json_artifact_strip(spark: SparkSession, d: str) -> DataFrame:
    k, t = F.col("item_id") % 6, F.col("text")
    raw = F.when(k == 0, F.concat(t, F.lit('"}]'))).when(k == 1, F.concat(F.lit('{[ "'), t, F.lit('"'))).when(k == 2, F.concat(F.lit('"'), t, F.lit('",'))).when(k == 3, " }], ").when(k == 4, t).otherwise(F.concat(t, F.lit('"')))
    return D.load(spark, d, "benchmark").select("item_id", text.strip_artifacts(raw).alias("cleaned"))


@query("SELECT item_id, md5(trim(text)) AS inner FROM benchmark")
def code_fence_strip(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("```json\n"), F.col("text"), F.lit("\n```\n"))).otherwise(F.col("text"))
    return D.load(spark, d, "benchmark").select("item_id", F.md5(text.strip_fences(raw).cast("binary")).alias("inner"))


@query(
    """SELECT page_id, len(lines)::BIGINT AS n_lines, md5(array_to_string(lines, chr(10))) AS lines FROM (SELECT page_id, list_filter(list_transform(regexp_split_to_array(body, '</(?:p|div|li|h[1-6]|tr)>|<br */?>'),
    lambda x: trim(regexp_replace(regexp_replace(x, '<[^>]*>', '', 'g'), '\\s+', ' ', 'g'))), lambda x: x <> '') AS lines FROM (SELECT page_id, coalesce(html, '') AS body FROM pages))"""
)
def markup_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = markup.lines(F.col("html"))
    return D.load(spark, d, "pages").select("page_id", F.size(lines).cast("long").alias("n_lines"), F.md5(F.array_join(lines, "\n").cast("binary")).alias("lines"))


@query("SELECT l_orderkey AS doc, md5(string_agg(page, chr(10) || chr(10) ORDER BY l_linenumber)) AS body FROM (SELECT l_orderkey, l_linenumber, trim(string_agg(l_returnflag || l_quantity::BIGINT || CASE WHEN l_linestatus = 'O' THEN chr(10) ELSE ' ' END, '' ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag, l_linestatus), ' ' || chr(10)) AS page FROM lineitem GROUP BY ALL) WHERE page <> '' GROUP BY l_orderkey")
def page_assembly(spark: SparkSession, d: str) -> DataFrame:
    rows = D.load(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("doc"),
        F.col("l_linenumber").alias("page"),
        F.struct("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus").alias("seq"),
        F.concat("l_returnflag", F.col("l_quantity").cast("long").cast("string"), F.when(F.col("l_linestatus") == "O", "").otherwise(" ")).alias("str"),
        (F.col("l_linestatus") == "O").alias("has_eol"),
    )
    return markup.assemble(rows, "doc", "page", "seq", "str", "has_eol").select("doc", F.md5(F.col("body").cast("binary")).alias("body"))


@query()
def nfkc_fold(spark: SparkSession, d: str) -> DataFrame:
    return D.load(spark, d, "documents").select("doc_id", F.md5(text.match_form(F.col("text")).cast("binary")).alias("form"))


@query()
def xml_entities(spark: SparkSession, d: str) -> DataFrame:
    return D.load(spark, d, "pages").select("page_id", F.md5(markup.decode_entities("html").cast("binary")).alias("decoded"))

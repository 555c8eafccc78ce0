"""Secrets in texts, told from examples by who owns them in the whole corpus. DataFrame functions only.

Three patterns give the base spans: values that are assigned to a telling name, access keys and long
hexadecimal runs. A fourth gives candidates that only look like keys: long runs of letters, digits
and signs. Where a match stands follows from the lengths of the matches and of what lies between
them, summed up by a window over a document's matches.

Every match's value is hashed, and hashes are counted over the corpus by distinct repositories and
owners. A value that more than `max_owners` owners hold, or more than one owner in over
`max_repositories` repositories, is a widely copied example; one that few hold and that mixes its
characters as a live credential does is taken for one. Base spans stay whatever the verdict; key-like
candidates become spans only if they are live-looking, owned by few, and outside of base spans.

Values are hashed where they are found: neither shuffles nor written tables hold one. A value that
is copied a million times is counted by partial sums; the matches meet their verdicts by a join that
Spark splits at a frequent value.

Defined results: null and empty texts have no span; a null owner or repository is one by itself;
repeated rows and null ids are documents like others, with their spans each; an empty table gives no
rows; columns other than the four named are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: The patterns of the base spans. Only the first needs a test of its own (the value's length): for the
#: others the least length of a whole run is the same as a count in the pattern.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Maximal runs of what keys are made of, before they are looked at.
RUN = r"[A-Za-z0-9_+=-]{20,}"
KINDS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "key": RUN}
LEAST_VALUE = 6
MAX_OWNERS, MAX_REPOSITORIES = 2, 20
#: Distinct characters from which a value looks drawn at random, and characters that a key-like run has
#: at most (longer ones are encoded data).
DISTINCT, LONGEST_KEY = 10, 200


def mixes(value: Column) -> Column:
    """Letters and digits in a value that doesn't dwell on few characters."""
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(value, ""))) >= DISTINCT)


def key_like(value: Column) -> Column:
    """Both cases and some digits, mixed all along the run."""
    count = lambda kind: F.regexp_count(value, F.lit(kind))
    return mixes(value) & (count("[0-9]") >= 3) & (count("[a-z]") >= 3) & (count("[A-Z]") >= 3) & (F.length(value) <= LONGEST_KEY)


def matches(text: Column, kind: str) -> Column:
    """For each match of a kind, left to right: the characters since the last one, its own, the hash of
    its value, and whether it holds and looks live."""
    pattern = KINDS[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)

    def one(match: Column, k: Column) -> Column:
        value = F.regexp_extract(match, ASSIGN, 2) if kind == "assign" else match
        holds = F.length(value) >= LEAST_VALUE if kind == "assign" else key_like(match) if kind == "key" else F.lit(True)
        return F.struct(F.get(gaps, k).alias("gap"), F.length(match).alias("size"), F.substring(F.sha2(value, 256), 1, 32).alias("hash"), holds.alias("holds"), mixes(value).alias("live"))

    return F.when(text.rlike(pattern), F.transform(found, one))


def placed(rows: DataFrame) -> DataFrame:
    """A row for each match that holds: _row, kind (by number), start, end, hash, live, and for key-like
    ones whether a base span overlaps."""
    each = rows.select("_row", "_owner", "_repository", F.posexplode("_found").alias("kind", "all")).filter("all IS NOT NULL")
    each = each.select("_row", "_owner", "_repository", "kind", F.posexplode("all").alias("k", "m")).repartition("_row")
    upto = Window.partitionBy("_row", "kind").orderBy("k")
    end = F.sum(F.col("m.gap") + F.col("m.size")).over(upto)
    spans = each.withColumn("end", end).filter("m.holds").withColumn("start", F.col("end") - F.col("m.size"))
    base = F.col("kind") < len(KINDS) - 1
    in_order = Window.partitionBy("_row").orderBy("start", "kind", "end")
    earlier = F.max(F.when(base, F.col("end"))).over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    later = F.min(F.when(base, F.col("start"))).over(in_order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    covered = (F.coalesce(earlier, F.lit(0)) > F.col("start")) | (F.coalesce(later, F.col("end")) < F.col("end"))
    return spans.select("_row", "_owner", "_repository", "kind", "start", "end", "m.hash", "m.live", (~base & covered).alias("covered")).filter("NOT covered")


def ownership(spans: DataFrame) -> DataFrame:
    """hash, owners, repositories: how many distinct ones hold each value in the corpus."""
    named = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("null"))
    return spans.groupBy("hash").agg(F.countDistinct(named(F.col("_owner"))).alias("owners"), F.countDistinct(named(F.col("_owner")), named(F.col("_repository"))).alias("repositories"))


def find_secrets(
    docs: DataFrame, owner_col: str = "source", repository_col: str = "doc_id", id_col: str = "doc_id", text_col: str = "text", max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES
) -> DataFrame:
    """id and spans for every row of docs: structs of kind, start, end (characters, end exclusive), base,
    copied and live, in the order of start and of KINDS."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = F.array(*(matches(text, kind) for kind in KINDS))
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), F.col(owner_col).cast("string").alias("_owner"), F.col(repository_col).cast("string").alias("_repository"), found.alias("_found"))
    rows = materialise(rows.withColumn("_found", F.when(F.exists("_found", lambda f: f.isNotNull()), F.col("_found"))), "secret-matches")
    spans = materialise(placed(rows.filter("_found IS NOT NULL")), "secret-spans")
    judged = spans.join(ownership(spans), "hash")
    copied = (F.col("owners") > max_owners) | ((F.col("owners") > 1) & (F.col("repositories") > max_repositories))
    base = F.col("kind") < len(KINDS) - 1
    judged = judged.withColumn("copied", copied).filter(base | ~F.col("copied"))
    span = F.struct("start", "kind", "end", base.alias("base"), "copied", "live")
    by_row = judged.groupBy("_row").agg(F.array_sort(F.collect_list(span)).alias("_spans"))
    told = F.transform("_spans", lambda s: F.struct(F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base"), s["copied"].alias("copied"), s["live"].alias("live")))
    with_spans = rows.filter("_found IS NOT NULL").select("_row", "_id").join(by_row, "_row", "left").select("_id", told.alias("spans"))
    none = F.lit(None).cast(with_spans.schema["spans"].dataType)
    without = rows.filter("_found IS NULL").select("_id", none.alias("spans"))
    return with_spans.union(without).select(F.col("_id").alias(id_col), F.coalesce("spans", F.array().cast(with_spans.schema["spans"].dataType)).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

"""Mixing sources to target weights by hash-threshold histograms. DataFrame functions only.

Each source gets a share of a budget of words by its weight; a share stops at `max_epochs` times
the source's size and the excess goes to the others by weight. A target of some whole epochs and a
rest is met by taking every document that often, and once more those whose hash lies below the
source's threshold. The threshold comes from nested histograms: words are summed by source and hash
bucket, the bucket in which the rest ends is cut into finer buckets, and so on down to single hash
values. No document is sorted; a level moves at most 2**BITS sums a source.

The hash is of the id and the text, so a rerun takes the same documents. Rows that repeat share a
hash; where the rest of a target ends among them, as many of them are taken as come nearest to it. They
are counted, not numbered, so that a row that is repeated a million times is one row in a task.

Defined results: null or empty text has size 0 and 0 words are taken; a null source is a source of its
own, last in order; an empty table gives no rows; columns of the input other than the id, the source
and the text are ignored by the plan and kept by the mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Work, few, materialise

WORD = r"[^\x20\x09-\x0D]+"
#: 42 bits of hash, cut into three levels of 16,384 buckets.
BITS, LEVELS = 14, 3
WEIGHTS = (5, 2, 1)


def size_of(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: str) -> Column:
    """The source as a key that is never null."""
    return F.when(F.col(source).isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), F.col(source).cast("string")))


def hash_of(id_col: str, text_col: str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.col(text_col)), 64 - BITS * LEVELS)


def above(hashed: Column, level: int) -> Column:
    """The hash without the bits of this level and finer ones."""
    return F.shiftright(hashed, BITS * (LEVELS - level))


def running(rows: DataFrame, order: list[str], sums: list[str], work: Work) -> DataFrame:
    """rows with before_<c>, the sum of c over the rows that come earlier in the order (which must be
    a total one), and all_<c>, the sum over all. Rows are sorted in ranges, and what is looked at as
    a whole is one row a range."""
    dealt = work.table(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "mix-ranges")
    parts = dealt.groupBy("_part").agg(*(F.sum(c).alias(f"_{c}") for c in sums))
    earlier, every = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    offsets = parts.select("_part", *(F.coalesce(F.sum(f"_{c}").over(earlier), F.lit(0)).alias(f"_{c}") for c in sums), *(F.sum(f"_{c}").over(every).alias(f"all_{c}") for c in sums))
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.join(F.broadcast(offsets), "_part")
    for c in sums:
        out = out.withColumn(f"before_{c}", F.coalesce(F.sum(c).over(within), F.lit(0)) + F.col(f"_{c}"))
    return out.drop("_part", *(f"_{c}" for c in sums))


def targets(sizes: DataFrame, work: Work, share_percent: int = 150, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = 2) -> DataFrame:
    """_key, source_size, target from (_key, source_size), one row a source.

    Sources are filled in the order of limit over weight. While the level of what is left, by what
    those before have taken to their limit, reaches a source's limit, that source is full; the level
    at the first one that isn't full holds for all that follow.
    """
    placed = running(sizes.withColumn("last", F.col("_key") == "null").withColumn("one", F.lit(1).cast("long")), ["last", "_key"], ["one"], work)
    rows = placed.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("before_one") % len(weights) + 1).cast("int")).cast("long"))
    rows = rows.withColumn("cap", F.col("source_size") * max_epochs).withColumn("fills_at", F.col("cap") / F.col("w"))
    rows = running(rows.select("_key", "source_size", "w", "cap", "fills_at"), ["fills_at", "_key"], ["source_size", "w", "cap"], work)
    rows = rows.withColumn("left", F.col("all_source_size") * share_percent / 100.0 - F.col("before_cap")).withColumn("open", F.col("all_w") - F.col("before_w"))
    rows = work.table(rows.withColumn("full", F.col("cap") * F.col("open") <= F.col("left") * F.col("w")), "mix-levels")
    level = rows.filter(~F.col("full")).agg(F.max(F.struct("open", "left")).alias("at")).first()["at"]  # two numbers
    by_weight = F.col("w") * F.lit(level["left"]) / F.lit(level["open"]) if level else F.lit(0.0)
    return rows.select("_key", "source_size", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(by_weight).alias("target"))


def thresholds(rows: DataFrame, wanted: DataFrame, work: Work) -> DataFrame:
    """_key, source_size, target, epochs, at, rest: the documents of a source whose hash is less than `at`
    are taken once more, and of those whose hash it is as many as come nearest to `rest` words. rows has
    _key, _hash and size; wanted is what targets() gives."""
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    state = wanted.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")).withColumn("at", F.lit(0).cast("long"))
    state = work.table(state, "mix-targets")
    for level in range(LEVELS):
        inside = rows.withColumn("at", above(F.col("_hash"), level))
        if level:  # only each source's boundary bucket is looked at again
            inside = inside.join(few(state.select("_key", "at")), ["_key", "at"], "left_semi")
        sums = inside.groupBy("_key", above(F.col("_hash"), level + 1).alias("_bucket")).agg(F.sum("size").alias("_n"))
        earlier = Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        kept = ["_key", "source_size", "target", "epochs"]
        ends = sums.join(few(state.select(*kept, "rest")), "_key").filter(F.col("_before") <= F.col("rest"))
        ends = ends.groupBy(*kept, "rest").agg(F.max(F.struct("_bucket", "_before")).alias("_end"))
        found = ends.select(*kept, (F.col("rest") - F.col("_end._before")).alias("rest"), F.col("_end._bucket").alias("at"))
        state = work.table(found, "mix-level", instead_of=state)
    return state


def measured(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """(id, _key, _hash, size), one row for each row of docs."""
    return docs.select(F.col(id_col), source_key(source_col).alias("_key"), hash_of(id_col, text_col).alias("_hash"), size_of(text_col).alias("size"))


def plan_mix(rows: DataFrame, work: Work, share_percent: int = 150, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = 2) -> DataFrame:
    """The thresholds of the sources of rows, which measured() gives."""
    sizes = rows.groupBy("_key").agg(F.sum("size").alias("source_size"))
    return few(materialise(thresholds(rows, targets(sizes, work, share_percent, weights, max_epochs), work), "mix-thresholds"))


def once_more(edge: DataFrame, same: list[str]) -> DataFrame:
    """Rows at their source's boundary (with _key, size and rest), those that are equal in `same` counted:
    with _n, and how many of them are taken once more (_more)."""
    each = edge.groupBy("_key", "size", "epochs", "rest", *same).agg(F.count(F.lit(1)).alias("_n"), *(F.first(c).alias(c) for c in edge.columns if c not in {"_key", "size", "epochs", "rest", *same}))
    earlier = Window.partitionBy("_key").orderBy("size", *same).rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("rest") - F.coalesce(F.sum(F.col("_n") * F.col("size")).over(earlier), F.lit(0))
    near = F.when(F.col("size") > 0, F.round(left / F.col("size"))).otherwise(0)
    return each.withColumn("_more", F.least(F.greatest(near, F.lit(0)), F.col("_n")).cast("long"))


def copies(n: Column) -> Column:
    """A row for each of 1 to n; none for 0."""
    return F.explode(F.when(n > 0, F.sequence(F.lit(1).cast("long"), n.cast("long"))))


def mix_report(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **how) -> DataFrame:
    """id, size, source_size, target, taken and times for every row of docs."""
    rows = materialise(measured(docs, id_col, source_col, text_col), "mix-rows")
    with Work(docs.sparkSession) as work:
        limits = plan_mix(rows, work, **how)
    met = rows.join(limits, "_key")
    most = met.filter(F.col("_hash") != F.col("at")).withColumn("times", F.col("epochs") + F.when(F.col("_hash") < F.col("at"), 1).otherwise(0))
    edge = once_more(met.filter(F.col("_hash") == F.col("at")), [id_col])
    edge = edge.select("*", copies(F.col("_n")).alias("_k")).withColumn("times", F.col("epochs") + F.when(F.col("_k") <= F.col("_more"), 1).otherwise(0))
    said = [id_col, "size", "source_size", "target", "times"]
    out = most.select(*said).union(edge.select(*said))
    return out.select(id_col, "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "times")


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs as often as the mix takes them, with their columns."""
    with Work(docs.sparkSession) as work:
        limits = plan_mix(work.table(measured(docs, id_col, source_col, text_col), "mix-rows"), work, **how)
    rows = docs.select(F.struct(*docs.columns).alias("row"), source_key(source_col).alias("_key"), hash_of(id_col, text_col).alias("_hash"), size_of(text_col).alias("size"))
    met = rows.join(limits.select("_key", "epochs", "at", "rest"), "_key")
    most = met.filter(F.col("_hash") != F.col("at")).withColumn("_times", F.col("epochs") + F.when(F.col("_hash") < F.col("at"), 1).otherwise(0))
    same = F.sha2(F.to_json("row"), 256).alias("_same")
    edge = once_more(met.filter(F.col("_hash") == F.col("at")).select("*", same), ["_same"]).withColumn("_times", F.col("epochs") * F.col("_n") + F.col("_more"))
    both = most.select("row", "_times").union(edge.select("row", "_times"))
    return both.select("row", copies(F.col("_times")).alias("_copy")).select("row.*")

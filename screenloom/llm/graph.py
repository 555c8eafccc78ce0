"""Connected components by contraction, for links between ids of one type."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Work

#: So many links are joined up in one task; more are contracted first.
FEW_LINKS = 50_000


def joined_up(table: pa.Table) -> pa.Table:
    """(node, root) of a few links, by union-find; the root is the least node."""
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in zip(table.column("a").to_pylist(), table.column("b").to_pylist(), strict=True):
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    return pa.table({"node": pa.array(nodes, table.schema.field("a").type), "root": pa.array([find(x) for x in nodes], table.schema.field("a").type)})


def components(links: DataFrame, a: str = "a", b: str = "b", *, work: Work) -> DataFrame:
    """(node, root) for every node that a link touches; nodes of a component share the root.

    Each round, every node joins the neighbour (or itself) that a fresh hash ranks least, and links
    are redrawn between what nodes have joined. A round leaves a constant share of a chain and ends a
    star, so rounds are few whatever the order of ids; once FEW_LINKS or fewer are left, a task joins
    these up. A hub's row is found by a minimum that is combined before the shuffle; links are joined
    to nodes by plain sort-merge joins, which Spark splits where a hub is skewed. Rounds end in written
    tables, so that lineage stays short; the result is one of those that `work` deletes at its end.
    """
    edges = links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b")
    edges = work.table(edges.union(edges.select("b", "a")).distinct(), "edges")
    roots: DataFrame | None = None
    turn = 0
    while edges.count() > FEW_LINKS:
        rank = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("h"), F.col(c).alias("to"))  # noqa: E731, B023
        joins = edges.groupBy("a").agg(F.min(rank("b")).alias("_best")).select(F.col("a").alias("node"), F.least("_best", F.struct(F.xxhash64(F.lit(turn), "a").alias("h"), F.col("a").alias("to"))).getField("to").alias("root"))
        joins = work.table(joins, "joins")
        ends = joins.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        moved = edges.join(joins.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(ends, "b")
        edges = work.table(moved.select(F.col("ra").alias("a"), F.col("rb").alias("b")).filter("a <> b").distinct(), "edges", instead_of=edges)
        if roots is None:
            roots = joins
        else:
            later = joins.select(F.col("node").alias("root"), F.col("root").alias("_next"))
            roots = work.table(roots.join(later, "root", "left").select("node", F.coalesce("_next", "root").alias("root")), "roots", instead_of=roots)
        turn += 1
    kind = edges.schema["a"].dataType.simpleString()
    rest = edges.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(joined_up, f"node {kind}, root {kind}")
    if roots is None:
        return work.table(rest, "roots")
    later = rest.select(F.col("node").alias("root"), F.col("root").alias("_next"))
    return work.table(roots.join(later, "root", "left").select("node", F.coalesce("_next", "root").alias("root")), "roots", instead_of=roots)

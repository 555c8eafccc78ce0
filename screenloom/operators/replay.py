"""Logs replayed through a finite automaton: every row with the state before and after it.

A key's log is cut into pieces, which are read side by side from every state they could start in. What
comes together for a key is a map a piece, which says where each piece really starts; then the pieces
are read once more. So a key that holds a third of all rows is many pieces and not one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that are read as one piece.
CHUNK = 4096
#: (state, row) to the state that follows, null where the row isn't accepted.
Step = Callable[[Column, Column], Column]


def pieces(log: DataFrame, key: str, order: list[str], chunk: int = CHUNK) -> DataFrame:
    """_key, _chunk, _events: the rows of each key in order, `chunk` at most, as structs of _at and _row."""
    rows = log.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_o{i}") for i, c in enumerate(order)), F.struct(*log.columns).alias("_row"))
    by = rows.columns[:-1]
    # numbers of rows in order, a partition's after those of the one before
    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    return dealt.groupBy("_key", F.floor(F.col("_at") / chunk).alias("_chunk")).agg(F.array_sort(F.collect_list(F.struct("_at", "_row"))).alias("_events"))


def replay(log: DataFrame, key: str, order: list[str], states: tuple[str, ...], step: Step, start: str, chunk: int = CHUNK, starts: DataFrame | None = None, start_col: str = "status") -> DataFrame:
    """The rows of log with before, after, accepted and their place in it (_chunk, _at).

    Each key starts in `start`, or where `starts` (key, start_col) says so. A row that isn't accepted
    leaves the state as it is. Rows without a key are one log of their own."""
    cut = pieces(log, key, order, chunk)
    after = lambda state, e: F.coalesce(step(state, e["_row"]), state)
    names = F.array(*map(F.lit, states))
    maps = F.array(*(F.aggregate("_events", F.lit(s), after) for s in states))
    whole = cut.select("_key", "_chunk", maps.alias("_maps")).groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("_chunk", "_maps"))).alias("_pieces"))
    first = F.lit(start)
    if starts is not None:
        given = starts.select(F.col(key).alias("_of"), F.col(start_col).alias("_start"))
        whole, first = whole.join(given, F.col("_key").eqNullSafe(F.col("_of")), "left"), F.coalesce("_start", F.lit(start))
    last = lambda path: F.element_at(path, -1)
    ends = F.aggregate("_pieces", F.array(first), lambda path, p: F.concat(path, F.array(F.element_at(p["_maps"], F.array_position(names, last(path)).cast("int")))))
    begun = whole.withColumn("_ends", ends).select(F.col("_key").alias("_of"), F.explode(F.arrays_zip(F.col("_pieces._chunk").alias("c"), F.col("_ends").alias("s"))).alias("_b")).filter("_b.c IS NOT NULL")
    begun = begun.select("_of", F.col("_b.c").alias("_at_chunk"), F.col("_b.s").alias("_begin"))
    rows = cut.join(begun, F.col("_key").eqNullSafe(F.col("_of")) & (F.col("_chunk") == F.col("_at_chunk")))
    path = F.aggregate("_events", F.array("_begin"), lambda path, e: F.concat(path, F.array(after(last(path), e))))
    rows = rows.select("_chunk", "_events", path.alias("_path"))
    each = F.explode(F.arrays_zip(F.col("_events").alias("e"), F.col("_path").alias("before"), F.slice("_path", F.lit(2), F.size("_events")).alias("after"))).alias("_x")
    rows = rows.select("_chunk", each).filter("_x.e IS NOT NULL")
    rows = rows.select("_chunk", F.col("_x.e._at").alias("_at"), F.col("_x.e._row").alias("_row"), F.col("_x.before").alias("before"), F.col("_x.after").alias("after"))
    return rows.withColumn("accepted", step(F.col("before"), F.col("_row")).isNotNull()).select("_row.*", "before", "after", "accepted", "_chunk", "_at")


def carried(rows: DataFrame, key: str, value: Column, keep: Callable[[Column], Column]) -> DataFrame:
    """rows of replay() with _carried: `keep` (such as F.max) of value over all earlier pieces of the key."""
    each = rows.groupBy(F.col(key).alias("_of"), F.col("_chunk").alias("_at_chunk")).agg(keep(value).alias("_v"))
    before = Window.partitionBy("_of").orderBy("_at_chunk").rowsBetween(Window.unboundedPreceding, -1)
    each = each.select("_of", "_at_chunk", keep(F.col("_v")).over(before).alias("_carried"))
    return rows.join(each, F.col(key).eqNullSafe(F.col("_of")) & (F.col("_chunk") == F.col("_at_chunk"))).drop("_of", "_at_chunk")

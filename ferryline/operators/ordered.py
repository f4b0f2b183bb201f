"""Order-dependent operators over one long stream, without a window that takes it all into one task.

The order column (a whole number) is cut into ranges that hold about as many rows each, at approximate quantiles, however
its values cluster.  Within a range a window does the work; what crosses ranges, a running total or the last row
before, comes from one row a range.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

#: The column of a row's range.
SEGMENT = _SEG = "__segment"


def _segments(df: DataFrame, segments: int | None) -> int:
    """Ranges wanted: as many as the session has shuffle partitions, 64 at least."""
    return segments or max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def ranges_of(df: DataFrame, rows: tuple[int, int]) -> int:
    """Ranges for a table: as many as are usual, but none of fewer rows or of many more than the two numbers."""
    n = df.count()
    return max(1, min(_segments(df, None), n // rows[0]), n // rows[1])


def _place(cuts: Sequence, x: Column, kind: str) -> Column:
    """A number that grows with how many of the cut points lie below: the block that x is in, then its place there."""
    if not cuts:
        return F.lit(0)
    width = isqrt(len(cuts)) + 1
    blocks = [F.array(*[F.lit(c) for c in cuts[i : i + width]]).cast(f"array<{kind}>") for i in range(0, len(cuts), width)]
    below = lambda found: F.size(F.filter(found, lambda c: c < x))
    block = below(F.array(*[F.element_at(b, -1) for b in blocks]))
    inside = F.get(F.array(*blocks), block)
    return block * width + F.when(inside.isNull(), 0).otherwise(below(inside))


def segmented(df: DataFrame, order: str, segments: int | None = None) -> DataFrame:
    """Rows with their range of the order column.

    The cut points are found once and stand in the plan as numbers: they come out a little different when they are found again
    on a cluster, and all that is joined by range has to have the same ranges.
    """
    n = _segments(df, segments)
    cuts = df.agg(F.percentile_approx(order, [i / n for i in range(1, n)], 100 * n)).first()[0]
    return df.withColumn(_SEG, _place(sorted(set(cuts or ())), F.col(order), df.schema[order].dataType.simpleString()))


def _summed(cut: DataFrame, order: str, name: str) -> DataFrame:
    """Segmented rows with the running sum of the column __v."""
    inside = F.sum("__v").over(Window.partitionBy(_SEG).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    totals = cut.groupBy(_SEG).agg(F.sum("__v").alias("__t"))
    before = totals.select(_SEG, F.coalesce(F.sum("__t").over(Window.orderBy(_SEG).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return cut.withColumn("__in", inside).join(F.broadcast(before), _SEG).withColumn(name, F.col("__in") + F.col("__before")).drop("__v", "__in", "__before")


def _carried(cut: DataFrame, order: str, values: Sequence[str], name: str) -> DataFrame:
    """Segmented rows with a struct of the values of the row before."""
    row = F.struct(*values)
    last = cut.groupBy(_SEG).agg(F.max_by(row, order).alias("__l"))
    carried = last.select(_SEG, F.lag("__l").over(Window.orderBy(_SEG)).alias("__carried"))
    inside = F.lag(row).over(Window.partitionBy(_SEG).orderBy(order))
    return cut.withColumn("__inside", inside).join(F.broadcast(carried), _SEG).withColumn(name, F.coalesce("__inside", "__carried")).drop("__inside", "__carried")


def running_sum(df: DataFrame, order: str, value: Column, name: str, segments: int | None = None) -> DataFrame:
    """Rows with the sum of ``value`` over all rows up to and including each, in order."""
    return _summed(segmented(df.withColumn("__v", value.cast("bigint")), order, segments), order, name).drop(_SEG)


def with_previous(df: DataFrame, order: str, values: Sequence[str], name: str, segments: int | None = None) -> DataFrame:
    """Rows with a struct of the values of the row before, in order; null for the first."""
    return _carried(segmented(df, order, segments), order, values, name).drop(_SEG)


def runs(df: DataFrame, order: str, values: Sequence[str], name: str = "run_id", segments: int | None = None) -> DataFrame:
    """Rows with the number (from 1) of their maximal run of equal values, in order."""
    before = _carried(segmented(df, order, segments), order, values, "__previous")
    starts = ~F.struct(*values).eqNullSafe(F.col("__previous"))
    return _summed(before.withColumn("__v", F.when(starts, 1).otherwise(0).cast("bigint")).drop("__previous"), order, name).drop(_SEG)


def between(df: DataFrame, order: str, marks: Column, values: Sequence[str], ahead: str, names: tuple[str, str]) -> DataFrame:
    """Segmented rows with a struct of the values of the last of the ``marks`` up to each of them, null before the first, and with
    ``ahead`` of the row after, in order."""
    at = F.when(marks, F.col(order))
    lasts = [F.max_by(v, at).alias(v) for v in values]  # of plain columns, so that no range is sorted for it
    ends = df.groupBy(_SEG).agg(F.min_by(ahead, order).alias("__first"), F.max(at).alias("__at"), *lasts)
    ranges, inside = Window.orderBy(_SEG), Window.partitionBy(_SEG).orderBy(order)
    last = F.when(F.col("__at").isNotNull(), F.struct(*values))
    borders = ends.select(_SEG, F.last(last, True).over(ranges.rowsBetween(Window.unboundedPreceding, -1)).alias("__before"), F.lead("__first").over(ranges).alias("__after"))
    mine = F.last(F.when(marks, F.struct(*values)), True).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    seen = df.withColumns({"__m": mine, "__a": F.lead(F.struct(F.col(ahead).alias("x"))).over(inside)})
    found = {names[0]: F.coalesce("__m", "__before"), names[1]: F.when(F.col("__a").isNull(), F.col("__after")).otherwise(F.col("__a.x"))}
    return seen.join(F.broadcast(borders), _SEG).withColumns(found).drop("__m", "__a", "__before", "__after")


def numbered(df: DataFrame, order: str, name: str, after: int = 0, segments: int | None = None) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """Segmented rows with their number in order, from the one after ``after``; and each range with its first and last number."""
    cut = segmented(df, order, segments)
    spans = []
    for r in cut.groupBy(_SEG).count().orderBy(_SEG).collect():
        spans.append((r[_SEG], after + 1, after + r["count"]))
        after += r["count"]
    starts = {s: a for s, a, _ in spans}
    before = F.array(*[F.lit(starts.get(s, 1) - 1) for s in range(max(starts, default=0) + 1)]).cast("array<bigint>")
    inside = F.row_number().over(Window.partitionBy(_SEG).orderBy(order))
    return cut.withColumn(name, inside).withColumn(name, F.col(name) + F.get(before, F.col(_SEG))), spans


def ordinal_within(df: DataFrame, base: str, order: str, name: str = "seq") -> DataFrame:
    """Rows with how many rows of the same base come before them."""
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(base).orderBy(order)) - 1).cast("bigint"))

"""Parity of two copies of a table: structure, counts, rows by key, rows as a multiset, key lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.render import row_checksum


def structure(source: DataFrame, target: DataFrame | None, table: str) -> DataFrame:
    """One row: the numbers of columns on both sides, and a finding (BLOCKER) or null."""
    n, m = len(source.columns), len(target.columns) if target is not None else None
    message = "table is missing" if m is None else None if n == m else f"column count differs (source={n}, target={m})"
    return source.sparkSession.createDataFrame([(table, n, m, "BLOCKER" if message else None, message)], "table_name string, source_columns int, target_columns int, severity string, message string")


def counts(source: DataFrame, target: DataFrame, table: str) -> DataFrame:
    """One row: rows on both sides, their difference, and whether they match."""
    n = source.select(F.lit(1).alias("s"), F.lit(0).alias("t")).union(target.select(F.lit(0), F.lit(1)))
    out = n.agg(F.coalesce(F.sum("s"), F.lit(0)).cast("bigint").alias("source_rows"), F.coalesce(F.sum("t"), F.lit(0)).cast("bigint").alias("target_rows"))
    delta = F.col("target_rows") - F.col("source_rows")
    return out.select(F.lit(table).alias("table_name"), "source_rows", "target_rows", delta.alias("delta"), (delta == 0).alias("matched"))


def _digests(df: DataFrame, keys: Sequence[str], columns: Sequence[str], scale: int | None, limit: int) -> DataFrame:
    rows = df.select(*keys, row_checksum(df, columns, scale).alias("digest"))
    return rows.orderBy(*keys).limit(limit) if limit > 0 else rows


def keyed(source: DataFrame, target: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None, scale: int | None = None, sample: int = 0) -> DataFrame:
    """(keys, status) of every row, by key: matched, changed, missing or extra.

    With ``sample``, only the least keys of each side are compared (byte order, a bounded top-k).
    """
    columns = list(columns or source.columns)
    s, t = _digests(source, keys, columns, scale, sample).withColumn("__s", F.lit(True)), _digests(target, keys, columns, scale, sample).withColumnRenamed("digest", "other").withColumn("__t", F.lit(True))
    status = F.when(F.col("__t").isNull(), "missing").when(F.col("__s").isNull(), "extra").when(F.col("digest") == F.col("other"), "matched").otherwise("changed")
    return s.join(t, list(keys), "full_outer").select(*keys, status.alias("status"))


def multiset(source: DataFrame, target: DataFrame, columns: Sequence[str] | None = None, scale: int | None = None) -> DataFrame:
    """(digest, source_rows, target_rows) of the row digests whose multiplicities differ; for tables without a key.

    One pre-aggregated shuffle: both sides are counted together.
    """
    columns = list(columns or source.columns)
    one = lambda df, s, t: df.select(row_checksum(df, columns, scale).alias("digest"), F.lit(s).cast("bigint").alias("s"), F.lit(t).cast("bigint").alias("t"))
    both = one(source, 1, 0).union(one(target, 0, 1))
    out = both.groupBy("digest").agg(F.sum("s").alias("source_rows"), F.sum("t").alias("target_rows"))
    return out.filter("source_rows <> target_rows")


def mode_probe(df: DataFrame, column: str) -> DataFrame:
    """One row: a column's commonest value (the least of equals), its group count, and the rows an equality filter finds.

    Both are conditional counts over one pre-aggregated grouping.
    """
    groups = df.filter(F.col(column).isNotNull()).groupBy(column).count()
    top = groups.orderBy(F.desc("count"), column).limit(1).select(F.col(column).alias("value"), F.col("count").alias("group_rows"))
    found = df.join(F.broadcast(top), df[column] == F.col("value")).groupBy("value", "group_rows").agg(F.count(F.lit(1)).alias("lookup_rows"))
    return found.select("value", "group_rows", "lookup_rows", (F.col("group_rows") == F.col("lookup_rows")).alias("matched"))


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows of the child whose (non-null) key has no parent."""
    return child.filter(F.col(child_key).isNotNull()).join(parent.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(*keys).count().filter("count > 1")


def chunk_report(status: DataFrame, chunk: Column) -> DataFrame:
    """Rows of each status by chunk."""
    of = lambda s: F.count(F.when(F.col("status") == s, 1))
    return status.groupBy(chunk.alias("chunk_no")).agg(
        F.count(F.when(F.col("status") != "extra", 1)).alias("src_rows"),
        F.count(F.when(F.col("status") != "missing", 1)).alias("tgt_rows"),
        *[of(s).alias(s) for s in ("matched", "changed", "missing", "extra")],
    )

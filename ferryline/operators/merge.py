"""Keyed changes of a stored table as plans: upsert, column updates, deletes, reconciliation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def latest(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The last row of each key in the given order (a total one): one pre-aggregated maximum, no window."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("__row")).select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest]).select(*df.columns)


def insert_new(stored: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stored rows and those of ``rows`` whose key is not stored yet (conflicts do nothing)."""
    return stored.unionByName(rows.dropDuplicates(list(keys)).join(stored.select(*keys), list(keys), "left_anti"))


def upsert(stored: DataFrame, changes: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The stored table after the last change of each key has replaced or added its row."""
    new = latest(changes, keys, *order).select(*stored.columns)
    return stored.join(new.select(*keys), list(keys), "left_anti").unionByName(new)


def update_columns(stored: DataFrame, changes: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The stored table with ``columns`` set where a change has the key; changes have one row a key."""
    new = changes.select(*keys, F.struct(*columns).alias("__new"))
    set_ = [F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in stored.columns]
    return stored.join(new, list(keys), "left").select(*set_)


def matched(stored: DataFrame, keys_of: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: how many stored rows have one of the keys."""
    return stored.join(keys_of.select(*keys), list(keys), "left_semi").agg(F.count(F.lit(1)).alias("rows"))


def delete_keys(stored: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    return stored.join(gone.select(*keys), list(keys), "left_anti")


def surplus(source: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of the target that the source no longer has: what a reconciliation deletes."""
    return target.select(*keys).join(source.select(*keys), list(keys), "left_anti")


def dedup_names(df: DataFrame, table: str, name: str) -> DataFrame:
    """Names made unique: the first keeps its own, later ones get their table's name in front, then a number."""
    n = F.row_number().over(Window.partitionBy(name).orderBy(table))
    same = F.row_number().over(Window.partitionBy(name, table).orderBy(table))
    prefixed = F.concat_ws("_", F.col(table), F.col(name))
    return df.withColumn("unique_name", F.when(n == 1, F.col(name)).when(same == 1, prefixed).otherwise(F.concat_ws("_", prefixed, same.cast("string"))))

"""Loaded tables made known in the session's catalogue: tables over the folders of their rows, and views over these."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import urlparse

from pyspark.sql import SparkSession

#: What tells a view that was made here from others.
_MARK = "ferryline.made"


class NameTaken(RuntimeError):
    """A name in the database that belongs to something else."""


def _facts(spark: SparkSession, name: str) -> dict[str, str] | None:
    """What the catalogue says of a table or view; None if it has none of that name."""
    if not spark.catalog.tableExists(name):
        return None
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()
    return {r["col_name"]: r["data_type"] for r in rows[[r["col_name"] for r in rows].index("# Detailed Table Information") :]}


def _same_place(a: str, b: str) -> bool:
    return urlparse(a).path.rstrip("/") == urlparse(b).path.rstrip("/")


def drop_table(spark: SparkSession, name: str, path: str) -> None:
    """Remove a table over a folder from the catalogue; its files stay.  Anything else of that name raises."""
    facts = _facts(spark, name)
    if facts is None:
        return
    if facts.get("Type") != "EXTERNAL" or not _same_place(facts.get("Location", ""), path):
        raise NameTaken(f"{name} is {facts.get('Type', 'something').lower()}, not a table over {path}")
    spark.sql(f"DROP TABLE {name}")


def drop_view(spark: SparkSession, name: str) -> None:
    """Remove a view that was made here from the catalogue.  Anything else of that name raises."""
    facts = _facts(spark, name)
    if facts is None:
        return
    if facts.get("Type") != "VIEW" or _MARK not in facts.get("Table Properties", "") + facts.get("View Properties", ""):
        raise NameTaken(f"{name} is {facts.get('Type', 'something').lower()}, and was not made here")
    spark.sql(f"DROP VIEW {name}")


def publish(spark: SparkSession, database: str, tables: Sequence[tuple[str, str, str]], views: Sequence[tuple[str, str]]) -> dict:
    """Drop what was made before, views first and in reverse; then run the statements: tables (name, folder, statement), then
    views (name, statement), each read once so that a statement that the catalogue takes but can't serve is found.

    Names are quoted ones; they stay inside ``database``.  Returns how many were made, and the error of each that wasn't; a view
    over one that failed fails with it, all others are made.
    """
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    before, failed, made = spark.catalog.currentDatabase(), {}, 0
    spark.sql(f"USE {database}")
    try:
        for name, _ in reversed(views):
            try:
                drop_view(spark, name)
            except NameTaken as e:
                failed[name] = str(e)
        for name, path, _ in reversed(tables):
            try:
                drop_table(spark, name, path)
            except NameTaken as e:
                failed[name] = str(e)
        for name, text in [(n, t) for n, _, t in tables] + list(views):
            if name in failed:
                continue
            try:
                spark.sql(text)
                if (name, text) in views:
                    spark.sql(f"ALTER VIEW {name} SET TBLPROPERTIES ('{_MARK}' = 'true')")
                spark.table(name).limit(1).collect()
                made += 1
            except Exception as e:  # noqa: BLE001 - told to the caller
                failed[name] = f"{type(e).__name__}: {str(e)[:500]}"
    finally:
        spark.sql(f"USE `{before}`")
    return {"made": made, "failed": failed}

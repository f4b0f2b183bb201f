"""Tables of a Parquet catalogue: a folder with one file or folder per table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@dataclass
class ParquetSource:
    """The source protocol over Parquet: rows, an exact count, key bounds, a pinned snapshot.

    A snapshot pins the list of files as it is when taken; later reads of that token see just those.
    """

    spark: SparkSession
    folder: str

    def tables(self) -> list[str]:
        """Names of the catalogue's tables."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(path)
        return sorted(x.getPath().getName().removesuffix(".parquet") for x in found if x.getPath().getName().endswith(".parquet"))

    def ping(self) -> bool:
        """Whether the folder is there."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return bool(path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path))

    def snapshot(self, name: str) -> tuple[str, ...]:
        return tuple(sorted(table(self.spark, self.folder, name).inputFiles()))

    def rows(self, name: str, columns: list[str] | None = None, predicate: str | None = None, snapshot: tuple[str, ...] | None = None) -> DataFrame:
        df = self.spark.read.parquet(*snapshot) if snapshot else table(self.spark, self.folder, name)
        df = df.filter(predicate) if predicate else df
        return df.select(*columns) if columns else df

    def count(self, name: str, snapshot: tuple[str, ...] | None = None) -> int:
        return self.rows(name, snapshot=snapshot).count()

    def bounds(self, name: str, key: str) -> tuple[int, int] | None:
        """Least and greatest key rounded down; None if the table is empty or the key is no number."""
        df = table(self.spark, self.folder, name)
        if not dict(df.dtypes)[key].startswith(("tinyint", "smallint", "int", "bigint", "decimal", "double", "float")):
            return None
        k = F.floor(key).cast("bigint")
        lo, hi = df.agg(F.min(k), F.max(k)).first()
        return None if lo is None else (lo, hi)

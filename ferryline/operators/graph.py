"""Groups of linked keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def linked(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(node, root) for each end of the edges (u, v): root is the least node that can be reached.

    Each round takes the least label among a node and its neighbours, then the label of that label, so chains
    shorten by half; it ends when nothing changes.  Sized for the key moves of a batch.
    """
    both = cut(edges.select("u", "v").union(edges.select("v", "u")).distinct())
    label = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("root")).withColumnRenamed("u", "node"))
    for _ in range(most_rounds):
        near = both.join(label, both["v"] == label["node"]).groupBy("u").agg(F.min("root").alias("near"))
        step = label.join(near, label["node"] == near["u"]).select("node", F.least("root", "near").alias("root"), F.col("root").alias("was"))
        up = step.select(F.col("node").alias("up_node"), F.col("root").alias("up"))
        after = cut(step.join(up, F.col("root") == F.col("up_node"), "left").select("node", F.coalesce("up", "root").alias("root"), "was"))
        label = after.drop("was")
        if not after.filter("root <> was").limit(1).count():
            break
    else:
        raise RuntimeError(f"key moves still link after {most_rounds} rounds")
    return label


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it; where it names none, one of our own if all
    runs on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='ferryline-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_root(spark))
    return df.checkpoint()


@contextmanager
def copied(df: DataFrame) -> Iterator[DataFrame]:
    """The rows as files in the shared folder, for as long as the block runs: read once however often they are used, and of wide
    rows only the columns that are asked for."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/ferryline-copy-{uuid.uuid4().hex[:12]}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    try:
        df.write.parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)

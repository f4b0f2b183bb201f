"""Line dedup over levelled sorted runs of line hashes.

The store keeps runs of (line hash, number of documents), each sorted by hash.  A batch merge-anti-joins
the settled runs (lines already known to be frequent need no more counting) and adds what is left as a new
run of level 0; when a level has ``fan`` runs they are merged into one of the next level, and lines that
reach the threshold move to a settled run.  The whole corpus is fed in as a few batches; the frequent
lines then go back, by Spark joins, to the blocks of documents that hold them.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import buckets, gathered, raw, shared_path, text_only, unlike

CHUNK = 6 << 20
#: Parts that the blocks of one frequent line are dealt over in the join with the frequent lines.
SALTS = 16
WHITE = b" \t\n\x0b\x0c\r"
_KEYS = pa.schema([("blk", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("n", pa.int64())])


def line_keys(text: bytes) -> list[bytes]:
    """The key of each line: A-Z lower-cased, ASCII white space stripped at both ends."""
    return [x.strip(WHITE) for x in text.lower().split(b"\n")]


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least)


def _counts(least: int):
    """mapInArrow: by block, in how many of a chunk's documents each key is found."""

    def run(batches):
        for table in gathered(batches, CHUNK):
            found: dict = defaultdict(lambda: defaultdict(int))
            for blk, text in zip(table.column("blk").to_pylist(), raw(table.column("text").combine_chunks())):
                own = found[blk]
                for key in set(line_keys(text or b"")):
                    own[key] += 1
            blk, digests, n = [], [], []
            for b, own in found.items():
                for key, count in own.items():
                    if _long_enough(key, least):
                        blk.append(b)
                        digests.append(xxhash.xxh3_128_digest(key))
                        n.append(count)
            h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(blk, pa.int32()), pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(n, pa.int64())], schema=_KEYS)

    return run


class LineRuns:
    """Levelled sorted runs of (h1, h2, n) under one folder of the shared storage."""

    def __init__(self, spark: SparkSession, threshold: int, fan: int = 2, path: str | None = None):
        self.spark, self.threshold, self.fan = spark, threshold, fan
        self.path, self.made = path or shared_path(spark, "runs"), 0
        self.levels: list[list[str]] = [[]]
        self.settled: list[str] = []

    def _new(self) -> str:
        self.made += 1
        return f"{self.path}/run-{self.made:05d}"

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema("h1 bigint, h2 bigint, n bigint").parquet(*paths)

    def _drop(self, path: str) -> None:
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)

    def add(self, counts: DataFrame) -> None:
        """One batch: leave out what is settled, write the rest as a sorted run."""
        new = counts.groupBy("h1", "h2").agg(F.sum("n").alias("n"))
        if self.settled:
            new = new.hint("merge").join(self._read(self.settled).select("h1", "h2"), ["h1", "h2"], "left_anti")
        new.sortWithinPartitions("h1", "h2").write.parquet(path := self._new())
        self.levels[0].append(path)
        for level in range(len(self.levels)):
            if len(self.levels[level]) >= self.fan:
                self.compact(level)

    def compact(self, level: int) -> None:
        """Merge a level's runs into one of the next; lines that reach the threshold settle."""
        old, self.levels[level] = self.levels[level], []
        merged = self._read(old).groupBy("h1", "h2").agg(F.sum("n").alias("n"))
        merged = merged.withColumn("settled", F.col("n") >= self.threshold)
        merged.sortWithinPartitions("settled", "h1", "h2").write.partitionBy("settled").parquet(path := self._new())
        if level + 1 == len(self.levels):
            self.levels.append([])
        parts = {str(x.getPath().getName()) for x in self._list(path)}
        if "settled=false" in parts:
            self.levels[level + 1].append(f"{path}/settled=false")
        if "settled=true" in parts:
            self.settled.append(f"{path}/settled=true")
        for x in old:
            self._drop(x)

    def _list(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(target)

    def frequent(self) -> DataFrame:
        """(h1, h2) of all lines found in at least ``threshold`` documents so far."""
        runs = [x for level in self.levels for x in level]
        out = self._read(self.settled).select("h1", "h2") if self.settled else None
        if runs:
            opened = self._read(runs).groupBy("h1", "h2").agg(F.sum("n").alias("n")).filter(F.col("n") >= self.threshold).select("h1", "h2")
            out = opened if out is None else out.union(opened)
        return out if out is not None else self.spark.createDataFrame([], "h1 bigint, h2 bigint")


def _drop_lines(docs: pa.Table, keys: pa.Table) -> pa.Table:
    h = np.stack([keys.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("h1", "h2")], 1)
    gone = {x.tobytes() for x in h}
    empty_goes = xxhash.xxh3_128_digest(b"") in gone  # only if empty keys are counted
    rows = []
    for i, text in zip(docs.column("id").to_pylist(), raw(docs.column("text").combine_chunks())):
        text = text or b""
        lines = text.split(b"\n")
        if gone:
            keep = [line for line, key in zip(lines, line_keys(text)) if (xxhash.xxh3_128_digest(key) not in gone if key else not empty_goes)]
        else:
            keep = lines
        rows.append((i, len(lines), len(lines) - len(keep), b"\n".join(keep)))
    cols = list(zip(*rows)) if rows else ([],) * 4
    kept = pa.array(cols[3], pa.binary()).view(pa.string())
    return pa.table([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), kept, docs.column("rest")], ["id", "n_lines", "n_dropped", "kept", "rest"])


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 10, least_chars: int = 1, batches: int = 4, carry: tuple[str, ...] = ()) -> DataFrame:
    """Drop the lines whose key is found in at least ``threshold`` documents.

    Returns one row for each input row: the id (bigint), n_lines before dropping, n_dropped, kept (the
    other lines joined by a newline) and, as a struct named rest, the columns that ``carry`` names.  A key is the
    line without ASCII white space at both ends and with A-Z lower-cased; keys of fewer than ``least_chars`` code
    points stay (0: empty lines are counted and dropped like others).  Null or empty text is one empty line.  Each row counts as a document, repeated rows and ids too; an empty table gives an empty result;
    other columns are not read.  Keys are told apart by 128-bit hashes.
    """
    spark, n = df.sparkSession, buckets(df)
    rest = F.struct(*[F.col(f"`{c}`") for c in carry]) if carry else F.lit(None).cast("int")
    name = unlike("rest", df)
    docs = text_only(df.select("*", rest.alias(name)), id_col, text_col, name).withColumnRenamed(name, "rest").withColumn("blk", F.pmod(F.xxhash64("id", "text"), F.lit(n)).cast("int"))
    counted = docs.select("text", "blk").mapInArrow(_counts(least_chars), "blk int, h1 bigint, h2 bigint, n bigint")
    counted.withColumn("batch", F.pmod("blk", F.lit(batches))).write.partitionBy("batch").parquet(path := shared_path(spark, "lines"))
    found = spark.read.schema("blk int, h1 bigint, h2 bigint, n bigint, batch int").parquet(path)
    runs = LineRuns(spark, threshold)
    for b in range(batches):
        runs.add(found.filter(F.col("batch") == b).select("h1", "h2", "n"))
    salt = F.pmod("blk", F.lit(SALTS)).alias("salt")
    frequent = runs.frequent().withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    keys = found.select("blk", "h1", "h2", salt).distinct().join(frequent, ["h1", "h2", "salt"]).select("blk", "h1", "h2")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept", T.StringType()), T.StructField("rest", docs.schema["rest"].dataType)])
    out = docs.groupBy("blk").cogroup(keys.groupBy("blk")).applyInArrow(_drop_lines, schema)
    return (out if carry else out.drop("rest")).withColumnRenamed("id", id_col)


def without_common_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The input's rows, all columns in their order, with the text that :func:`line_dedup` keeps."""
    out = line_dedup(df, id_col, text_col, carry=tuple(df.columns), **options)
    return out.select(*[F.col("kept").alias(c) if c == text_col else F.col("rest").getField(c).alias(c) for c in df.columns])


def op5_query(spark, sf_dir: str) -> DataFrame:
    out = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT k.*, f.key IS NOT NULL AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

"""Helpers shared by the operators: shared storage, row identity, hashing and byte blobs."""

from __future__ import annotations

import tempfile
import uuid
from array import array

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64


# ---- storage -------------------------------------------------------------------------------

def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; one of our own if that is unset and all runs on
    one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        active = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not active.isDefined() and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        root = active.get() if active.isDefined() else f"file://{tempfile.mkdtemp(prefix='ferryline-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/ferryline-{label}-{uuid.uuid4().hex[:12]}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_root(spark))
    return df.checkpoint(eager=True)


#: Bytes of input, as the planner knows it, to a bucket at most; an estimate beyond the last bound is no estimate.
BUCKET_BYTES, UNKNOWN_BYTES = 16 << 20, 1 << 52


def buckets(df: DataFrame) -> int:
    """Logical buckets for blobs and blocks of rows: four to each shuffle partition, so that hashing evens out, and
    more where the input is so large that a bucket would not fit a task."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, size // BUCKET_BYTES) if size < UNKNOWN_BYTES else least


#: A key is spread over all buckets if it holds over this many times a bucket's mean share; and how often a
#: chunk must have it to report it.
SPREAD_FROM, REPORT_FROM = 2.0, 4


def reported(total: int, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """A chunk's report: how much it has in all (under null), and how often some keys."""
    return pa.RecordBatch.from_arrays([pa.array([None, *keys.view(np.int64).tolist()], pa.int64()), pa.array([total, *n.tolist()], pa.int64())], ["key", "n"])


def counted_keys(keys: np.ndarray, least: int) -> pa.RecordBatch:
    """A chunk's report of the keys that it has at least ``least`` times."""
    found, n = np.unique(keys, return_counts=True)
    return reported(len(keys), found[n >= least], n[n >= least])


def heavy_keys(reports: DataFrame, n_buckets: int, factor: float = SPREAD_FROM) -> np.ndarray:
    """Keys with over ``factor`` times a bucket's mean share, from the reports of all chunks.

    At most n_buckets / factor keys can have that share, however large the corpus, times the keys that one counted
    thing has: that bounds the list.
    """
    total = reports.filter("key IS NULL").agg(F.sum("n")).first()[0] or 0
    rows = reports.filter("key IS NOT NULL").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") > factor * total / n_buckets).select("key").collect()
    return np.sort(np.array([r["key"] for r in rows], np.int64).view(U64))


class KeyList:
    """A list of 64-bit keys; a small bitmap of their first bits keeps most lookups cheap."""

    def __init__(self, keys: np.ndarray | None = None, bits: int = 20):
        self.keys, self.shift = np.unique(np.zeros(0, U64) if keys is None else keys), U64(64 - bits)
        self.some = np.zeros(1 << bits, bool)
        self.some[(self.keys >> self.shift).astype(np.int64)] = True

    def __len__(self) -> int:
        return len(self.keys)

    def has(self, keys: np.ndarray) -> np.ndarray:
        """Which keys are in the list."""
        if not len(self.keys):
            return np.zeros(len(keys), bool)
        out = self.some[(keys >> self.shift).astype(np.int64)]
        at = np.flatnonzero(out)
        out[at] = self.keys[np.minimum(np.searchsorted(self.keys, keys[at]), len(self.keys) - 1)] == keys[at]
        return out


# ---- row identity --------------------------------------------------------------------------

def text_only(df: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """(id bigint, text string, and the columns named) whatever else the input holds.

    Rows of text are large, so the session's Arrow batches are held to 16 MB: a Python worker has a
    few hundred MB of its own.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")
    return df.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), *more)


def unlike(name: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has: ``name``, with underlines in front as far as needed."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def with_tags(docs: DataFrame) -> DataFrame:
    """(id, tag, text): tag tells rows apart that share an id but not their text; 0 if ids are unique.

    Equal rows share a tag: what holds for one holds for the other.
    """
    light = docs.select("id", F.xxhash64("text").alias("th"))
    repeated = light.groupBy("id").count().filter("count > 1 AND id IS NOT NULL")
    if not repeated.limit(1).count():
        return docs.select("id", F.lit(0).alias("tag"), "text")
    from pyspark.sql import Window

    texts = light.join(repeated.select("id"), "id", "left_semi").distinct()
    tags = texts.select("id", "th", (F.row_number().over(Window.partitionBy("id").orderBy("th")) - 1).alias("tag"))
    keyed = docs.withColumn("th", F.xxhash64("text"))
    return keyed.join(tags, ["id", "th"], "left").select("id", F.coalesce("tag", F.lit(0)).alias("tag"), "text")


# ---- Arrow ---------------------------------------------------------------------------------

def raw(column) -> list:
    """An Arrow string column as a list of UTF-8 bytes (None for null)."""
    return column.cast(pa.binary() if column.type == pa.string() else column.type).to_pylist()


def longs(column) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


def gathered(batches, limit: int, text: str = "text"):
    """Arrow batches regrouped so that each holds about ``limit`` bytes of text."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        step = max(1, min(batch.num_rows, int(limit * batch.num_rows / max(1, batch.nbytes)) or 1))
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            held.append(part)
            size += part.get_total_buffer_size() * part.num_rows // max(1, batch.num_rows)
            if size >= limit:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


# ---- hashing -------------------------------------------------------------------------------

def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit of a polynomial hash depends on all of it."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(29))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(32))


def xxhash64_long(values: np.ndarray, seed: int = 42) -> np.ndarray:
    """Spark's xxhash64 of a bigint column, vectorised, to find a row's block from Python."""
    p1, p2, p3, p4, p5 = (U64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, r: (x << U64(r)) | (x >> U64(64 - r))
    h = np.full(len(values), seed, U64) + p5 + U64(8)
    h = h ^ (turn(values.astype(np.int64).view(U64) * p2, 31) * p1)
    h = turn(h, 27) * p1 + p4
    h = (h ^ (h >> U64(33))) * p2
    h = (h ^ (h >> U64(29))) * p3
    return (h ^ (h >> U64(32))).view(np.int64)


class WordIds(dict):
    """Numbers of the words seen, and for each the two halves of its XXH3-128; emptied when it grows past a bound.

    Words that are looked up together have one number only if they are equal.
    """

    def __init__(self, seed: int = 0, most: int = 1 << 18):
        self.seed, self.most, self.halves = seed, most, (array("Q"), array("Q"))

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_128_intdigest(word, self.seed)
        self.halves[0].append(h >> 64)
        self.halves[1].append(h & 0xFFFFFFFFFFFFFFFF)
        number = self[word] = len(self)
        return number

    def of(self, words: list, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if len(self) > self.most:
            self.clear()
            self.halves = (array("Q"), array("Q"))
        number = np.fromiter(map(self.__getitem__, words), np.int64, n)
        return (number, *(np.array(x, U64)[number] for x in self.halves))


def slide(h: np.ndarray, k: int, by: int) -> np.ndarray:
    """Polynomial hashes of all k-grams of ``h``, mixed."""
    n = len(h) - k + 1
    out = h[:n].copy()
    for j in range(1, k):
        out *= U64(by)
        out += h[j : j + n]
    return mix(out)


# ---- blobs ---------------------------------------------------------------------------------

_PACK, _UNPACK = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack(*arrays: np.ndarray) -> bytes:
    """Integer arrays as one blob, stored byte plane by byte plane; compressed, unless it is very small."""
    out = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        out.append(np.array([len(a), ord(a.dtype.char)], np.uint32).tobytes())
        out.append(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.dtype.itemsize).T).tobytes())
    data = b"".join(out)
    return b"\0" + data if len(data) < 256 else b"\1" + _PACK.compress(data)


def unpack(blob: bytes) -> list[np.ndarray]:
    data, at, out = (_UNPACK.decompress(blob[1:]) if blob[:1] == b"\1" else blob[1:]), 0, []
    while at < len(data):
        n, char = np.frombuffer(data, np.uint32, 2, at)
        kind = np.dtype(chr(char))
        at, size = at + 8, int(n) * kind.itemsize
        planes = np.frombuffer(data, np.uint8, size, at).reshape(kind.itemsize, int(n))
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += size
    return out


def deltas(a: np.ndarray) -> np.ndarray:
    return np.diff(a, prepend=a.dtype.type(0))


def bounds(changed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the groups that begin where ``changed`` is set (its first is taken as set)."""
    changed = changed.copy()
    changed[:1] = True
    starts = np.flatnonzero(changed)
    return starts, np.diff(np.append(starts, len(changed)))


def covered(n: int, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which of n places lie in any of the spans."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.minimum(starts, n), 1)
    np.add.at(edge, np.minimum(starts + lengths, n), -1)
    return np.cumsum(edge[:n]) > 0


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start+1, ... for each span, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)

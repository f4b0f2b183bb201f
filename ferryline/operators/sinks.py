"""Loads into Parquet tables: a chunk is replaced as a whole, so that repeating it changes nothing."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.ledger import FAILED, IN_PROGRESS, LOADED, PENDING, Ledger
from .chunks import Chunk, chunk_number

#: Chunks that are put in place at a time.
MOVERS = 16


def load_range(df: DataFrame, path: str, chunk: Column | str = "chunk_id", ids: Sequence[str] | None = None) -> dict[str, int]:
    """Replace chunks by the rows of ``df``, and no others; returns how many rows each got.

    ``ids`` names the chunks that are replaced, those without rows too (by default, those that have rows).  The rows
    are written beside the table first, and counted there; then each chunk's old folder makes room for its new one.
    A crash between leaves a chunk that its ledger has not marked as loaded, and that a repeat replaces again.
    """
    spark = df.sparkSession
    jvm, root = spark._jvm, path.rstrip("/")
    at = jvm.org.apache.hadoop.fs.Path
    fs = at(root).getFileSystem(spark._jsc.hadoopConfiguration())
    folder = lambda i: f"chunk_id={jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(i)}"
    staged = f"{root}/_staged-{uuid.uuid4().hex[:12]}"
    out = df if isinstance(chunk, str) else df.withColumn("chunk_id", chunk)
    out = out if chunk in ("chunk_id",) or not isinstance(chunk, str) else out.withColumnRenamed(chunk, "chunk_id")
    out.write.partitionBy("chunk_id").parquet(staged)
    written = {x.getPath().getName() for x in fs.listStatus(at(staged)) if x.isDirectory()}
    counts: dict[str, int] = {}
    if written:
        schema = T.StructType([f for f in out.schema.fields if f.name != "chunk_id"] + [T.StructField("chunk_id", T.StringType())])
        counts = {r["chunk_id"]: r["count"] for r in spark.read.schema(schema).parquet(staged).groupBy("chunk_id").count().collect()}
    if ids is not None and not counts.keys() <= set(ids):
        fs.delete(at(staged), True)
        raise ValueError(f"rows of other chunks: {sorted(counts.keys() - set(ids))[:5]}")
    there = {x.getPath().getName() for x in fs.listStatus(at(root))}

    def put(i: str) -> None:
        name = folder(i)
        if name in there:
            fs.delete(at(f"{root}/{name}"), True)
        if name in written and not fs.rename(at(f"{staged}/{name}"), at(f"{root}/{name}")):
            raise OSError(f"chunk {i} can't be put in place")

    with ThreadPoolExecutor(MOVERS) as pool:
        list(pool.map(put, ids if ids is not None else counts))
    fs.delete(at(staged), True)
    return dict.fromkeys(ids or (), 0) | counts


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def truncate(spark: SparkSession, path: str, schema) -> None:
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def chunk_column(chunks: list[Chunk]):
    """Which of the chunks a row is in, as an expression over their key."""
    if chunks[0].key is None:
        return F.lit(chunks[0].chunk_id)
    lo, step = chunks[0].lo, chunks[0].hi - chunks[0].lo
    table = chunks[0].chunk_id.rsplit(":", 1)[0]
    if any(c.lo != lo + i * step for i, c in enumerate(chunks)):  # ranges of several widths
        lows = F.array(*[F.lit(c.lo).cast("bigint") for c in chunks])
        below = F.size(F.filter(lows, lambda x: x <= F.col(f"`{chunks[0].key}`"))) - 1
        return F.concat(F.lit(f"{table}:"), below.cast("string"))
    return F.concat(F.lit(f"{table}:"), chunk_number(F.col(f"`{chunks[0].key}`"), lo, step).cast("string"))


def load(ledger: Ledger, table: str, source: DataFrame | Callable[[list[Chunk]], DataFrame], path: str, batch: int = 64, keep_going: bool = False):
    """Load a table's chunks that are not loaded yet, some at a time as one job; returns rows by chunk.

    ``source`` is the table, or gives it for some chunks (a database reads each by a query of its own).  It is filtered
    to the recorded ranges, which reach its scan.  A batch that fails is marked failed, and the error is raised; a later
    run takes up from the ledger.  With ``keep_going`` the other batches are loaded all the same, and the errors'
    texts are returned beside the rows.
    """
    todo = ledger.chunks(table, PENDING, FAILED)
    done: dict[str, int] = {}
    errors: list[str] = []
    for at in range(0, len(todo), batch):
        part = todo[at : at + batch]
        ids = [c.chunk_id for c in part]
        ledger.mark(ids, IN_PROGRESS)
        try:
            where = None
            for c in part:
                where = c.condition() if where is None else where | c.condition()
            found = source if isinstance(source, DataFrame) else source(part)
            tagged = found.filter(where).withColumn("chunk_id", chunk_column(ledger.chunks(table)))
            rows = load_range(tagged, path, ids=ids)
        except Exception as e:
            ledger.mark(ids, FAILED, error=str(e)[:500])
            if not keep_going:
                raise
            errors.append(str(e)[:500])
            continue
        ledger.mark(ids, LOADED, rows)
        done |= rows
    return (done, errors) if keep_going else done


#: Schemes of stores in which a rename copies, and is seen half done.
OBJECT_STORES = ("s3", "s3a", "s3n", "gs", "oss", "cos", "wasb", "wasbs", "swift")


def probe(spark: SparkSession, path: str) -> dict:
    """What the target can do, tried on it: whether a rename is one step and takes the place of a file, whether a file is
    created by one writer only, whether an empty string stays apart from NULL; and what kind of store it is.

    ``atomic`` says whether several tables can be published as one.
    """
    jvm = spark._jvm
    at, root = jvm.org.apache.hadoop.fs.Path, f"{path.rstrip('/')}/probe-{uuid.uuid4().hex[:12]}"
    fs = at(root).getFileSystem(spark._jsc.hadoopConfiguration())
    scheme = str(fs.getUri().getScheme())

    def put(name: str, text: str) -> None:
        stream = fs.create(at(f"{root}/{name}"), True)
        stream.write(bytearray(text.encode()))
        stream.close()

    def renames() -> bool:
        put("a", "one")
        return bool(fs.rename(at(f"{root}/a"), at(f"{root}/b"))) and not fs.exists(at(f"{root}/a")) and fs.getFileStatus(at(f"{root}/b")).getLen() == 3

    def replaces() -> bool:
        put("c", "three")
        over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(at(f"{root}/c"), at(f"{root}/b"), over)
        return fs.getFileStatus(at(f"{root}/b")).getLen() == 5

    def one_writer() -> bool:
        fs.create(at(f"{root}/lock"), False).close()
        try:
            fs.create(at(f"{root}/lock"), False).close()
        except Exception:  # noqa: BLE001 - the second writer is to be refused
            return True
        return False

    out: dict = {"store": "objects" if scheme in OBJECT_STORES else scheme, "spark": spark.version}
    try:
        for name, trial in (("renames", renames), ("replaces", replaces), ("one_writer", one_writer), ("empty_is_not_null", lambda: smoke_test(spark, f"{root}/rows"))):
            try:
                out[name] = trial()
            except Exception:  # noqa: BLE001 - what can't be done is what is asked
                out[name] = False
    finally:
        fs.delete(at(root), True)
    out["atomic"] = out["renames"] and out["one_writer"] and out["store"] != "objects"
    return out


def smoke_test(spark: SparkSession, path: str) -> bool:
    """Whether a round trip keeps an empty string apart from NULL."""
    spark.createDataFrame([(1, ""), (2, None)], "id int, v string").write.mode("overwrite").parquet(path)
    got = {r["id"]: r["v"] for r in spark.read.parquet(path).collect()}
    return got == {1: "", 2: None}

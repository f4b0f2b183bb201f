"""Tables in versions, by buckets of their keys: a batch writes what it changes, and one rename of a pointer publishes it for
all tables of the set.

A bucket is a base and, on top of it, deltas: the net changes of later batches, merged when the bucket is read.  Deltas are
levelled: when a level has FAN of them they become one of the next; a bucket is written anew once its deltas weigh a
quarter of its base, or while it is small.  So a batch writes about what it changes, whatever the table's size.

The pointer says for each table which versions hold each bucket, and for each stream that feeds the set how far it was
applied.  A batch that is repeated finds itself applied, or recomputes from the version it started from: nothing is
applied twice, and no reader sees a transaction in one table and not in another.  A writer claims the set before it
works; one whose claim was taken over by another can't publish.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.changes import fold, net_changes

#: Buckets of a table, unless its first load says how many; a bucket should fit a task.
BUCKETS = 16
#: Deltas of a level that become one of the next; the share of its base that a bucket's deltas may weigh; bytes up to
#: which a bucket is written anew whatever it gets.
FAN, SHARE, SMALL_BYTES = 4, 0.25, 1 << 20
_BUCKET = "__bucket"


@dataclass(frozen=True)
class Delta:
    """The net changes that a version holds for a bucket."""

    version: int
    level: int = 0
    bytes: int = 0


@dataclass(frozen=True)
class Stored:
    """A table of a version: its schema, the keys that it is bucketed by and into how many buckets, the version and the bytes
    of each bucket's base, and its deltas, oldest first."""

    schema: str
    keys: tuple[str, ...] = ()
    buckets: dict[str, int] = field(default_factory=dict)
    count: int = BUCKETS
    sizes: dict[str, int] = field(default_factory=dict)
    deltas: dict[str, tuple[Delta, ...]] = field(default_factory=dict)

    def versions(self) -> set[int]:
        return {*self.buckets.values(), *(d.version for ds in self.deltas.values() for d in ds)}

    def rewritten(self, bucket: int, small_bytes: int = SMALL_BYTES) -> bool:
        """Whether what comes next is better folded into the base than laid on top of it."""
        b = str(bucket)
        base, more = self.sizes.get(b, 0), sum(d.bytes for d in self.deltas.get(b, ()))
        return base + more <= small_bytes or more > SHARE * base


@dataclass(frozen=True)
class Applied:
    """How far a stream is applied: all records up to ``cursor``; and, where transactions are open that began before others
    ended, of those up to ``ahead`` all that aren't of them.  ``mixed``: its transactions were seen to interleave."""

    batch: int = -1
    cursor: int = 0
    ahead: int = 0
    open: tuple[int, ...] = ()
    mixed: bool = False
    trail: str | None = None


@dataclass(frozen=True)
class Pointer:
    version: int = -1
    streams: dict[str, Applied] = field(default_factory=dict)
    tables: dict[str, Stored] = field(default_factory=dict)

    def applied(self, stream: str = "") -> Applied:
        return self.streams.get(stream, Applied())

    @property
    def batch(self) -> int:
        return self.applied().batch

    @property
    def cursor(self) -> int:
        return self.applied().cursor


class CorruptPointer(ValueError):
    """A pointer that is there but can't be read: no guess is made."""


class Fenced(RuntimeError):
    """Another writer has claimed the set since."""


class Replica:
    """A set of tables under one pointer."""

    def __init__(self, spark: SparkSession, path: str, keep: int = 2, buckets: int = BUCKETS, small_bytes: int = SMALL_BYTES):
        self.spark, self.path, self.keep, self.buckets, self.small_bytes = spark, path.rstrip("/"), keep, buckets, small_bytes
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._token: str | None = None

    # -- files

    def _names(self, folder: str, prefix: str) -> list[str]:
        if not self._fs.exists(self._path(folder)):
            return []
        return sorted(n for n in (x.getPath().getName() for x in self._fs.listStatus(self._path(folder))) if n.startswith(prefix))

    def _text(self, name: str) -> str:
        stream = self._fs.open(self._path(f"{self.path}/{name}"))
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def _write(self, name: str, text: str) -> None:
        stream = self._fs.create(self._path(f"{self.path}/{name}"), True)
        stream.write(bytearray(text.encode()))
        stream.hflush()
        stream.close()

    # -- the pointer

    def _parsed(self, name: str) -> Pointer:
        try:
            found = json.loads(self._text(name))
            if "streams" not in found:  # of one stream without a name
                found["streams"] = {"": {"batch": found.pop("batch"), "cursor": found.pop("cursor")}}
            tables = {}
            for k, v in found.pop("tables").items():
                deltas = {b: tuple(Delta(**d) for d in ds) for b, ds in v.get("deltas", {}).items()}
                tables[k] = Stored(v["schema"], tuple(v["keys"]), v["buckets"], v.get("count", self.buckets), v.get("sizes", {}), deltas)
            streams = {k: Applied(**v | {"open": tuple(v.get("open", ()))}) for k, v in found["streams"].items()}
            return Pointer(found["version"], streams, tables)
        except (ValueError, TypeError, KeyError) as e:
            raise CorruptPointer(f"{self.path}/{name}") from e

    def pointer(self) -> Pointer:
        """The published version; pointer files are numbered, and the highest counts."""
        names = self._names(self.path, "pointer-")
        return self._parsed(names[-1]) if names else Pointer()

    @contextmanager
    def claimed(self) -> Iterator[None]:
        """Claims the set: of two writers the one that claimed last publishes.  A claim inside a claim is the same one."""
        if self._token is not None:
            yield
            return
        self._token = uuid.uuid4().hex
        try:
            self._write(".writer", self._token)
            yield
        finally:
            self._token = None

    def publish(self, staged: dict[str, Stored], batch: int, cursor: int, stream: str = "", place: Applied | None = None) -> Pointer:
        """One pointer for all that was staged since the last, and for how far the stream is applied (``place`` says it in
        full); the other tables and streams stay as they are."""
        now = self.pointer()
        if batch <= now.applied(stream).batch:
            return now
        place = replace(place or Applied(), batch=batch, cursor=cursor, ahead=max(cursor, place.ahead if place else 0))
        return self._put(Pointer(now.version + 1, now.streams | {stream: place}, now.tables | staged))

    def forget(self, stream: str) -> None:
        """Leave a stream's place out of the pointer; its tables stay."""
        now = self.pointer()
        if stream in now.streams:
            self._put(Pointer(now.version + 1, {k: v for k, v in now.streams.items() if k != stream}, now.tables))

    def _put(self, new: Pointer) -> Pointer:
        with self.claimed():
            temp = f".pointer-{new.version:010d}-{self._token[:8]}"
            self._write(temp, json.dumps(asdict(new)))
            if self._text(".writer") != self._token:
                self._fs.delete(self._path(f"{self.path}/{temp}"), False)
                raise Fenced(f"another writer has claimed {self.path}")
            final = self._path(f"{self.path}/pointer-{new.version:010d}")
            if self._fs.exists(final) or not self._fs.rename(self._path(f"{self.path}/{temp}"), final):
                raise OSError(f"version {new.version} of {self.path} can't be published")
        self._tidy()
        return new

    def _tidy(self) -> None:
        """Remove old pointers, and versions that none of the kept ones needs."""
        names = self._names(self.path, "pointer-")
        for n in names[: -self.keep]:
            self._fs.delete(self._path(f"{self.path}/{n}"), False)
        kept = [self._parsed(n) for n in names[-self.keep :]]
        needed = {v for p in kept for t in p.tables.values() for v in t.versions()} | {p.version for p in kept}
        for n in self._names(self.path, "v="):
            if int(n[2:]) not in needed and int(n[2:]) < kept[-1].version:
                self._fs.delete(self._path(f"{self.path}/{n}"), True)

    # -- tables

    def table(self, name: str) -> VersionedTable:
        return VersionedTable(self.spark, self.path, name=name, replica=self)

    def bucket_of(self, keys: Sequence[str] | Sequence[Column], count: int | None = None) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(count or self.buckets)).cast("int") if keys else F.lit(0)

    def _dealt(self, df: DataFrame, keys: Sequence[str], count: int, folder: str) -> dict[str, int]:
        """Write rows by bucket, each in one file; returns the bytes of each bucket that has rows."""
        df.withColumn(_BUCKET, self.bucket_of(keys, count)).repartition(_BUCKET).write.mode("overwrite").partitionBy(_BUCKET).parquet(folder)
        return {n.split("=")[1]: int(self._fs.getContentSummary(self._path(f"{folder}/{n}")).getLength()) for n in self._names(folder, f"{_BUCKET}=")}

    def stage(self, name: str, df: DataFrame, keys: Sequence[str] = (), touched: Iterable[int] | None = None, count: int | None = None) -> Stored:
        """Write the rows of some buckets (of all, if none are named) for the version to come; nothing is published."""
        now = self.pointer()
        old = now.tables.get(name) if touched is not None else None
        count = old.count if old else count or self.buckets
        sizes = self._dealt(df, keys, count, f"{self.path}/v={now.version + 1}/{name}")
        stay = lambda x: {} if old is None else {b: v for b, v in x.items() if int(b) not in set(touched)}
        new = dict.fromkeys(sizes, now.version + 1)
        return Stored(df.schema.json(), tuple(keys), stay(old.buckets if old else {}) | new, count, stay(old.sizes if old else {}) | sizes, stay(old.deltas if old else {}))

    def lay(self, name: str, changes: DataFrame, stored: Stored, buckets: Iterable[int]) -> Stored:
        """Write a batch's changes to some buckets as deltas for the version to come, with the deltas of full levels."""
        now, keys = self.pointer(), stored.keys
        version = now.version + 1
        new = net_changes(changes, keys).withColumn("ord", F.lit(2 * version).cast("bigint") + (F.col("kind") != "delete").cast("bigint"))
        kept, level_of, paths = {}, {}, []
        for b in map(str, buckets):
            stay, level = list(stored.deltas.get(b, ())), 0
            while sum(d.level == level for d in stay) >= FAN - 1:
                paths += [self._delta(d.version, name, b) for d in stay if d.level == level]
                stay, level = [d for d in stay if d.level != level], level + 1
            kept[b], level_of[b] = stay, level
        if paths:
            new = net_changes(new.unionByName(self.spark.read.schema(new.schema).parquet(*paths)), keys)
        sizes = self._dealt(new, keys, stored.count, f"{self.path}/v={version}/{name}.delta")
        deltas = {b: tuple(kept[b]) + ((Delta(version, level_of[b], sizes[b]),) if b in sizes else ()) for b in kept}
        return Stored(stored.schema, keys, stored.buckets, stored.count, stored.sizes, stored.deltas | deltas)

    def _delta(self, version: int, name: str, bucket: str) -> str:
        return f"{self.path}/v={version}/{name}.delta/{_BUCKET}={bucket}"


class VersionedTable:
    """One table of a replica; alone in it, unless a replica is given."""

    def __init__(self, spark: SparkSession, path: str, keep: int = 2, buckets: int = BUCKETS, name: str = "table", replica: Replica | None = None):
        self.spark, self.path, self.name = spark, path.rstrip("/"), name
        self.replica = replica or Replica(spark, path, keep, buckets)

    def pointer(self) -> Pointer:
        return self.replica.pointer()

    def stored(self) -> Stored | None:
        return self.pointer().tables.get(self.name)

    def schema(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.stored().schema))

    def _base(self, now: Stored, schema: T.StructType, buckets: Iterable[str]) -> DataFrame:
        paths = [f"{self.path}/v={now.buckets[b]}/{self.name}/{_BUCKET}={b}" for b in sorted(buckets) if b in now.buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, buckets: Iterable[int] | None = None) -> DataFrame:
        """The rows of the published version, of some buckets or of all; only their files are opened.

        Buckets without deltas are read as they are; the others are merged with theirs by key.
        """
        now = self.stored()
        if now is None:
            raise FileNotFoundError(f"{self.path} has no version of {self.name} yet")
        schema = T.StructType.fromJson(json.loads(now.schema))
        wanted = {*now.buckets, *now.deltas} if buckets is None else {str(b) for b in buckets}
        over = {b for b in wanted if now.deltas.get(b)}
        out = [self._base(now, schema, wanted - over)] if wanted - over or not over else []
        if over:
            rest = [T.StructField(f.name, T.StructType([f])) for f in schema.fields if f.name not in now.keys]
            kind = T.StructType([T.StructField("ord", T.LongType()), T.StructField("kind", T.StringType()), *[schema[k] for k in now.keys], *rest])
            paths = [self.replica._delta(d.version, self.name, b) for b in sorted(over) for d in now.deltas[b]]
            out.append(fold(self._base(now, schema, over), self.spark.read.schema(kind).parquet(*paths), now.keys))
        return reduce(DataFrame.unionByName, out)

    def stage(self, df: DataFrame, keys: Sequence[str] = (), touched: Iterable[int] | None = None, count: int | None = None) -> Stored:
        return self.replica.stage(self.name, df, keys, touched, count)

    def publish(self, df: DataFrame, batch: int, cursor: int, keys: Sequence[str] = (), touched: Iterable[int] | None = None) -> Pointer:
        now = self.pointer()
        return now if batch <= now.batch else self.replica.publish({self.name: self.stage(df, keys, touched)}, batch, cursor)

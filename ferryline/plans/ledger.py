"""The load ledger: which chunks a run planned, in which state they are, and what a resumed run does."""

from __future__ import annotations

import hashlib
import json
import os
import time
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunks import Chunk

PENDING, IN_PROGRESS, LOADED, FAILED, VERIFIED = "pending", "in_progress", "loaded", "failed", "verified"


class ResumeDrift(ValueError):
    """What was recorded no longer fits the source."""


def run_id(*endpoints: str, length: int = 16) -> str:
    """A name for a run that stays the same for the same endpoints."""
    return hashlib.sha1("|".join(endpoints).encode()).hexdigest()[:length]


def drift_hash(config: dict, ignored: Iterable[str] = ("batch_size",), defaults: dict | None = None) -> str:
    """Hash of what shapes a plan; settings that don't, or that have their default, are left out."""
    kept = {k: v for k, v in config.items() if k not in set(ignored) and (defaults or {}).get(k, object()) != v}
    return hashlib.sha1(json.dumps(kept, sort_keys=True, default=str).encode()).hexdigest()


@dataclass
class Entry:
    table_name: str
    chunk_id: str
    predicate: str | None = None
    key: str | None = None
    lo: int | None = None
    hi: int | None = None
    state: str = PENDING
    rows: int = 0
    error: str | None = None
    #: How many rows it may have, as planned.
    estimate: int | None = None

    def chunk(self) -> Chunk:
        plain = Chunk(self.chunk_id, self.key, self.lo, self.hi, None, self.estimate)
        return plain if plain.predicate() == self.predicate else replace(plain, recorded=self.predicate)


#: Events that are folded into the snapshot once there are so many, and seconds after which a lock was left by a crash.
FOLD_AT, STALE_SECONDS = 64, 600


@dataclass
class Ledger:
    """A run's chunks: a snapshot in a JSON document, and events beside it, a small file for each change of state.

    Loads in several processes add events without touching each other's: a file's name has a number, past all that its writer
    has seen, and the writer.  What a reader sees is the snapshot and, in the order of their names, the events that it
    has not taken in.  One writer at a time folds events into a new snapshot, which names them, and removes them then: a
    crash between leaves events that the snapshot says it has.
    """

    spark: SparkSession
    path: str
    run: str = ""
    config_hash: str = ""
    planned: bool = False
    entries: list[Entry] = field(default_factory=list)
    read_only: bool = False

    def __post_init__(self) -> None:
        self._writer, self._number, self._seen, self._folded = uuid.uuid4().hex[:12], 0, set(), set()

    # -- storage

    def _fs(self):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path
        return p, p(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _writable(self) -> None:
        if self.read_only:
            raise PermissionError(f"the ledger at {self.path} was opened to be read")

    def _put(self, path: str, body: str) -> None:
        """A file that appears whole or not at all."""
        p, fs = self._fs()
        temp = p(f"{path}.{self._writer}.part")
        stream = fs.create(temp, True)
        stream.write(bytearray(body.encode()))
        stream.hflush()
        stream.close()
        self._replace(temp, p(path))

    def _replace(self, temp, final) -> None:
        """Rename over what is there, so that a reader finds one or the other."""
        jvm, (_, fs) = self.spark._jvm, self._fs()
        over = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        at = final.toUri() if final.toUri().getScheme() else fs.getUri()
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(at, self.spark._jsc.hadoopConfiguration()).rename(temp, final, over)

    def _get(self, path: str) -> dict:
        p, fs = self._fs()
        stream = fs.open(p(path))
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    @property
    def _events(self) -> str:
        return f"{self.path}.events"

    def _names(self) -> list[str]:
        p, fs = self._fs()
        if not fs.exists(p(self._events)):
            return []
        return sorted(n for n in (x.getPath().getName() for x in fs.listStatus(p(self._events))) if n.endswith(".json"))

    def save(self) -> None:
        """Write a snapshot of what this writer has, with all events so far taken in, and remove them."""
        self._writable()
        with self._alone():
            self._snapshot()

    def fold(self) -> None:
        """Take all events into a new snapshot, whoever wrote them."""
        self._writable()
        with self._alone():
            self._load()
            self._snapshot()

    def _snapshot(self) -> None:
        self._catch_up()
        p, fs = self._fs()
        for n in self._folded & set(self._names()):  # left behind by a crash
            fs.delete(p(f"{self._events}/{n}"), False)
        names = sorted(self._seen)
        self._put(f"{self.path}.next", self._body(names))
        self._replace(p(f"{self.path}.next"), p(self.path))
        self._folded, self._seen = set(names), set()
        for n in names:
            fs.delete(p(f"{self._events}/{n}"), False)

    def _body(self, folded: list[str]) -> str:
        return json.dumps({"run": self.run, "config_hash": self.config_hash, "planned": self.planned, "number": self._number, "folded": folded, "entries": [asdict(e) for e in self.entries]}, indent=1)

    @contextmanager
    def _alone(self) -> Iterator[None]:
        """Holds the lock of the snapshot; one that is old was left behind by a crash."""
        p, fs = self._fs()
        lock, failed = p(f"{self.path}.lock"), 0
        fs.mkdirs(lock.getParent())
        while True:
            try:
                if str(fs.getUri()).startswith("file:"):  # there the file system's own create looks first and creates then
                    os.close(os.open(lock.toUri().getPath(), os.O_CREAT | os.O_EXCL))
                else:
                    fs.create(lock, False).close()
                break
            except Exception:
                held = fs.exists(lock)
                failed += not held
                if failed > 20:
                    raise
                if held and time.time() > fs.getFileStatus(lock).getModificationTime() / 1000 + STALE_SECONDS:
                    fs.delete(lock, False)
                time.sleep(0.05)
        try:
            yield
        finally:
            fs.delete(lock, False)

    def _load(self) -> None:
        """The snapshot there, or its complete successor if a crash came between.

        Some file systems replace a file in two steps: where a ledger was and neither is found, it is looked at again.
        """
        p, fs = self._fs()
        found = None
        for again in range(40):
            for x in (self.path, f"{self.path}.next"):
                try:
                    found = found or self._get(x)
                except Exception:
                    if again == 39 and fs.exists(p(x)):
                        raise
            if found or not fs.exists(p(self._events)):
                break
            time.sleep(0.02)
        if found:
            self.run, self.config_hash, self.planned = found["run"], found["config_hash"], found["planned"]
            self.entries = [Entry(**e) for e in found["entries"]]
            self._folded, self._number = set(found.get("folded", ())), max(self._number, found.get("number", 0))
        self._seen = set()
        self._catch_up()

    def _catch_up(self) -> None:
        """Take in the events that are new, in the order of their names."""
        for n in self._names():
            if n not in self._seen and n not in self._folded:
                try:
                    self._apply(self._get(f"{self._events}/{n}"))
                except Exception:
                    if n in self._names():
                        raise
                    continue  # another writer has folded it meanwhile: it is in the next snapshot
                self._seen.add(n)
                self._number = max(self._number, int(n.split("-")[0]))

    def _apply(self, event: dict) -> None:
        ids, rows = set(event["ids"]), event["rows"]
        self.entries = [replace(e, state=event["state"], rows=rows.get(e.chunk_id, e.rows), error=event["error"]) if e.chunk_id in ids else e for e in self.entries]

    @classmethod
    def open(cls, spark: SparkSession, path: str, read_only: bool = False) -> Ledger:
        """The ledger there (or its complete successor, if a crash came between), else an empty one.

        One that is opened to be read changes nothing, and raises if it is asked to.
        """
        out = cls(spark, path)
        out.read_only = read_only
        out._load()
        return out

    def refresh(self) -> None:
        """What other writers have marked since."""
        self._load()

    # -- planning

    def plan(self, run: str, config_hash: str, tables: dict[str, list[Chunk]], keys: dict[str, str | None] | None = None) -> None:
        """Plan a run, or take up the one that is recorded.

        A recorded plan is replayed as it stands: a table that is gone or whose key is another raises.  A plan
        that a crash cut short is made anew for the tables of which nothing has been loaded.
        """
        if self.run == run and self.config_hash and self.config_hash != config_hash:
            raise ResumeDrift("the configuration is another than the recorded run's")
        if self.run == run and self.planned:
            for e in self.entries:
                if e.table_name not in tables:
                    raise ResumeDrift(f"table {e.table_name} is gone")
                if e.key is not None and keys is not None and keys.get(e.table_name) != e.key:
                    raise ResumeDrift(f"the key of {e.table_name} was {e.key}")
            self.recover()
            return
        begun = {e.table_name for e in self.entries if e.state != PENDING} if self.run == run else set()
        kept = [e for e in self.entries if e.table_name in begun]
        fresh = [Entry(t, c.chunk_id, c.predicate(), c.key, c.lo, c.hi, estimate=c.estimate) for t, cs in tables.items() if t not in begun for c in cs]
        self.run, self.config_hash, self.entries, self.planned = run, config_hash, kept + fresh, True
        self.recover()

    def recover(self) -> None:
        """Chunks that a crash left in progress are pending again."""
        self.entries = [replace(e, state=PENDING) if e.state == IN_PROGRESS else e for e in self.entries]
        self.save()

    def chunks(self, table: str | None = None, *states: str) -> list[Chunk]:
        """The recorded chunks.  A range is rendered anew for the dialect that reads it: names are quoted as that one does."""
        return [e.chunk() for e in self.entries if (table is None or e.table_name == table) and (not states or e.state in states)]

    def mark(self, chunk_ids: Iterable[str], state: str, rows: dict[str, int] | None = None, error: str | None = None) -> None:
        """Record a change of state: one event, whatever the number of chunks there are."""
        self._writable()
        event = {"ids": sorted(set(chunk_ids)), "state": state, "rows": rows or {}, "error": error}
        self._apply(event)
        numbers = [int(n.split("-")[0]) for n in self._names()]
        self._number = max([self._number, *numbers]) + 1
        name = f"{self._number:016d}-{self._writer}.json"
        self._put(f"{self._events}/{name}", json.dumps(event))
        self._seen.add(name)
        if len(numbers) + 1 >= FOLD_AT:
            self.fold()

    # -- reports

    def frame(self) -> DataFrame:
        schema = "table_name string, chunk_id string, state string, planned bigint"
        return self.spark.createDataFrame([(e.table_name, e.chunk_id, e.state, e.rows if e.state in (LOADED, VERIFIED) else e.rows or e.estimate or 0) for e in self.entries], schema)

    @property
    def failed(self) -> int:
        """Chunks that aren't loaded; a run is complete at 0."""
        return sum(e.state not in (LOADED, VERIFIED) for e in self.entries)


def progress(chunks: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """Per table: chunks by state, rows, a status and a percentage.  Chunks: table_name, state, planned (rows).

    ``tables`` (table_name) names tables that may have no chunks: they are pending, at 0 percent.
    """
    n = lambda *states: F.count(F.when(F.col("state").isin(*states), 1))
    done = F.col("state").isin(LOADED, VERIFIED)
    known = chunks if tables is None else tables.select("table_name").distinct().join(chunks, "table_name", "left")
    out = known.groupBy("table_name").agg(
        F.count("state").alias("chunks_total"), n(LOADED, VERIFIED).alias("chunks_loaded"), n(IN_PROGRESS).alias("chunks_running"), n(FAILED).alias("chunks_failed"),
        F.coalesce(F.sum(F.when(done, F.col("planned"))), F.lit(0)).cast("bigint").alias("rows_loaded"), F.sum("planned").cast("bigint").alias("rows_planned"),
    )
    some = F.col("chunks_total") > 0
    status = F.when(F.col("chunks_failed") > 0, FAILED).when(some & (F.col("chunks_loaded") == F.col("chunks_total")), LOADED).when((F.col("chunks_running") > 0) | (F.col("chunks_loaded") > 0), IN_PROGRESS).otherwise(PENDING)
    percent = F.when(some, F.floor(100 * F.col("chunks_loaded") / F.greatest("chunks_total", F.lit(1)))).otherwise(0)
    return out.withColumns({"status": status, "percent": percent.cast("bigint")})


def eta_seconds(done: int, total: int, elapsed: float) -> float | None:
    """Time left at the average rate so far; None before anything is done."""
    return None if not done else round(elapsed / done * (total - done), 1)

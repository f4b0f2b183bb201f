"""A project: a source, a target folder, options; and the verbs over them that the command line and the service share."""

from __future__ import annotations

import json
import os
import time
import tomllib
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.idents import ident
from .functions.types import Kind, TypeRegistry
from .operators import catalog as target_catalog
from .operators import compare, sinks
from .operators.chunks import even_chunks, plan_chunks
from .plans import ddl, ledger
from .plans.assess import Report, assess, review_file
from .plans.model import Column, Schema, Table
from .sources.contract import Source
from .sources.introspect import introspect
from .sources.jdbc import JdbcSource
from .sources.tables import ParquetSource
from .sources.trail import Trail, tagged_text
from .streaming import capture, replicate
from .streaming.versions import BUCKETS, Replica


@dataclass
class SourceConfig:
    kind: str = "parquet"
    path: str = ""
    dialect: str = "postgres"
    address: str = ""
    schema: str | None = None
    user: str = ""
    password_env: str | None = None
    connect_timeout: int = 10
    #: A folder of recorded decoding output (sources.slot), or of binary logs (sources.binlog) where the dialect is mysql: captures
    #: read it, and not the tables' version columns.
    recording: str = ""
    #: Key columns by table; databases bring their own.
    keys: dict[str, list[str]] = field(default_factory=dict)


@dataclass
class TargetConfig:
    path: str = ""
    dialect: str = "spark"
    #: A database of the session's catalogue, in which migrate makes the tables and views known; made if there is none.
    catalog: str = ""


@dataclass
class Options:
    parallelism: int = 4
    chunks_per_worker: int = 2
    preserve_case: bool = False
    sample_rows: int = 1000
    test_data_max_errors: int = 10
    scale: int | None = None
    #: Chunks of about equal numbers of rows (the key is read once more), not of equal ranges.
    even_chunks: bool = False


@dataclass
class CdcConfig:
    capture_batch: int = 50_000
    apply_batch: int = 10_000
    #: How often a batch that fails is tried again while both ends answer, and records parked in a batch at most.
    poison_retries: int = 3
    poison_max_per_run: int = 25
    trail_rotate_mb: int = 256
    #: Buckets of a replicated table, unless its first load needs more.
    replica_buckets: int = BUCKETS
    #: Whole transactions: off never; auto and on where the target publishes several tables as one.
    txn_apply: str = "auto"


@dataclass
class Config:
    source: SourceConfig = field(default_factory=SourceConfig)
    target: TargetConfig = field(default_factory=TargetConfig)
    options: Options = field(default_factory=Options)
    cdc: CdcConfig = field(default_factory=CdcConfig)
    data_type: dict[str, str] = field(default_factory=dict)
    modify_type: dict[str, str] = field(default_factory=dict)

    @classmethod
    def load(cls, path: str) -> Config:
        """From TOML; sections and names that are not known raise."""
        raw = tomllib.loads(Path(path).read_text())
        parts = {}
        for f in fields(cls):
            got = raw.pop(f.name, None)
            if got is not None:
                kind = {"source": SourceConfig, "target": TargetConfig, "options": Options, "cdc": CdcConfig}.get(f.name)
                parts[f.name] = kind(**got) if kind else dict(got)
        if raw:
            raise ValueError(f"unknown sections: {', '.join(raw)}")
        return cls(**parts)

    def shown(self) -> dict:
        """The settings; a password is only ever named, by its environment variable."""
        return asdict(self)


@dataclass
class Finding:
    check: str
    table: str
    severity: str
    message: str


def fresh_rows(df: DataFrame, version: str, mark: int | None, high: int | None) -> DataFrame:
    """Rows past a watermark, up to where it will stand next, and those without a version; the range reaches the scan."""
    v = F.col(f"`{version}`")
    fresh = (F.lit(False) if high is None else v <= high) & (F.lit(True) if mark is None else v > mark)
    return df.filter(v.isNull() | fresh)


class SourceChanged(RuntimeError):
    """A capture that began at another source."""


class Project:
    def __init__(self, spark: SparkSession, config: Config):
        self.spark, self.config = spark, config
        self.registry = TypeRegistry("target" if config.source.kind == "parquet" else config.source.dialect, config.data_type, config.modify_type)

    # -- both ends

    def source(self) -> Source:
        s = self.config.source
        if s.kind == "parquet":
            return ParquetSource(self.spark, s.path)
        options = {"user": s.user, "password": os.environ.get(s.password_env or "", ""), "loginTimeout": str(max(1, s.connect_timeout)), "fetchsize": "10000"}
        return JdbcSource(self.spark, s.dialect, s.address, s.schema, options)

    def schema(self) -> Schema:
        src = self.source()
        if isinstance(src, JdbcSource):
            return introspect(src)
        kinds = {T.ShortType: "smallint", T.IntegerType: "integer", T.LongType: "bigint", T.FloatType: "real", T.DoubleType: "double", T.BinaryType: "bytea", T.DateType: "date", T.TimestampNTZType: "timestamp", T.TimestampType: "timestamptz", T.BooleanType: "boolean"}

        def kind(t: T.DataType) -> Kind:
            if isinstance(t, T.DecimalType):
                return Kind("decimal", t.precision, t.scale)
            return Kind("array", element=kind(t.elementType)) if isinstance(t, T.ArrayType) else Kind(kinds.get(type(t), "text"))

        tables = []
        for name in src.tables():
            struct = src.rows(name).schema
            tables.append(Table(name, tuple(Column(f.name, kind(f.dataType), f.nullable) for f in struct.fields), None, tuple(self.config.source.keys.get(name, ()))))
        return Schema(self.config.source.path, tables)

    def source_rows(self, t: Table, chunks=None, snapshot: str | None = None) -> DataFrame:
        """A table's rows; from a database, one partition for each chunk, at the moment of the snapshot."""
        src, columns = self.source(), [c.name for c in t.columns]
        return src.rows(t.name, columns, chunks, snapshot) if isinstance(src, JdbcSource) else src.rows(t.name, columns, snapshot=snapshot)

    def moment(self, t: Table):
        """What pins a table's rows, so that reading it twice finds the same: a moment, or a list of files."""
        src = self.source()
        return src.snapshot() if isinstance(src, JdbcSource) else src.snapshot(t.name)

    def target_path(self, name: str) -> str:
        return f"{self.config.target.path.rstrip('/')}/{name}.parquet"

    def target_rows(self, t: Table) -> DataFrame | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.target_path(t.name))
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return None
        return self.spark.read.parquet(self.target_path(t.name)).drop("chunk_id")

    def ledger(self) -> ledger.Ledger:
        return ledger.Ledger.open(self.spark, f"{self.config.target.path.rstrip('/')}/state/ledger.json")

    # -- verbs

    def assess(self) -> Report:
        return assess(self.schema())

    def export(self) -> dict[str, str]:
        schema = self.schema()
        text, gaps = ddl.export(schema, self.registry, self.config.options.preserve_case, self.config.target.dialect)
        return {"ddl": text, "review": review_file(schema), "gaps": json.dumps([asdict(g) for g in gaps])}

    def _write(self, path: str, text: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        stream = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(at, True)
        stream.write(bytearray(text.encode()))
        stream.close()

    def migrate(self) -> dict:
        """The target's schema, as two scripts for the database that will hold it (state/before_load.sql: drops, sequences,
        tables; state/after_load.sql: indexes, foreign keys, views), and the rows of every table by chunks, all read at
        one moment where the source has such.

        An interrupted run is taken up where its ledger stands.  A batch of chunks that fails is tried again, chunk by
        chunk, after all tables; what fails then too is left for the next run.  Each table's rows are counted at the source once
        more: where that was read at one moment they have to be as many as were loaded, and some where it has some.

        Where the target names a database of the session's catalogue, the statements are run there: tables over the folders of
        the rows once all is loaded, then views; one that fails is reported, and the others are run.
        """
        o, src, schema = self.config.options, self.source(), self.schema()
        keys = {t.name: t.primary_key[0] if len(t.primary_key) == 1 else None for t in schema.tables}
        bounds = {t.name: src.bounds(t.name, keys[t.name]) if keys[t.name] else None for t in schema.tables}
        plan = {t.name: plan_chunks(t.name, keys[t.name] if bounds[t.name] else None, bounds[t.name], o.parallelism * o.chunks_per_worker) for t in schema.tables}
        if o.even_chunks:
            even = lambda n: even_chunks(src.rows(n, [keys[n]]), n, keys[n], o.parallelism * o.chunks_per_worker)
            plan |= {n: even(n) for n, c in plan.items() if c[0].key}
        book = self.ledger()
        book.plan(ledger.run_id(self.config.source.path or self.config.source.address, self.config.target.path), ledger.drift_hash(asdict(self.config)), plan, {k: keys[k] if plan[k][0].key else None for k in plan})
        before, after, gaps = ddl.scripts(schema, self.registry, o.preserve_case, self.config.target.dialect)
        for when, statements in (("before", before), ("after", after)):
            self._write(f"{self.config.target.path.rstrip('/')}/state/{when}_load.sql", "\n\n".join(statements) + "\n")
        moment = src.snapshot() if isinstance(src, JdbcSource) else None
        rows, errors = 0, {}
        for batch in (64, 1):  # in bulk, then what failed, one by one
            for t in schema.tables:
                if batch == 64 or t.name in errors:
                    errors.pop(t.name, None)
                    done, failed = sinks.load(book, t.name, lambda chunks, t=t: self.source_rows(t, chunks, moment), self.target_path(t.name), batch, keep_going=True)
                    rows += sum(done.values())
                    errors |= {t.name: failed[0]} if failed else {}
        loaded = {t.name: sum(e.rows for e in book.entries if e.table_name == t.name) for t in schema.tables}
        counted = {t.name: src.count(t.name, moment) for t in schema.tables if t.name not in errors}
        other = {n: {"source": c, "loaded": loaded[n]} for n, c in counted.items() if c != loaded[n]}
        pinned = moment is not None or not isinstance(src, JdbcSource)
        wrong = [n for n, x in other.items() if pinned or not x["loaded"]]
        made = self.publish(schema) if self.config.target.catalog and not book.failed else {}
        return {"tables": len(schema.tables), "rows": rows, "failed_chunks": book.failed, "complete": book.failed == 0 and not wrong and not made.get("failed"), "errors": errors, "mismatched": other, "gaps": len(gaps)} | ({"catalog": made} if made else {})

    def publish(self, schema: Schema | None = None) -> dict:
        """Make the loaded tables, and the views over them, known in the target's database of the session's catalogue.

        Repeating it makes them anew.  A name that something else has in that database is not taken: only a table over this
        target's folder, or a view that was made here, is replaced.
        """
        target, o = self.config.target, self.config.options
        if target.dialect != "spark" or not target.catalog:
            raise ValueError("tables are made known where the target is Spark and names a database")
        schema = schema or self.schema()
        made = [(t.name, self.target_path(t.name), ddl.create_table(t, self.registry, o.preserve_case, "spark", self.target_path(t.name))) for t in schema.tables]
        _, views, _ = ddl.scripts(schema, self.registry, o.preserve_case, "spark")
        named = list(zip(ddl.view_names(schema), views))
        return target_catalog.publish(self.spark, ident(target.catalog, o.preserve_case, "spark"), [(ident(n, o.preserve_case, "spark"), at, text) for n, at, text in made], [(ident(n, o.preserve_case, "spark"), text) for n, text in named])

    def status(self) -> list[dict]:
        book = ledger.Ledger.open(self.spark, f"{self.config.target.path.rstrip('/')}/state/ledger.json", read_only=True)
        return [r.asDict() for r in ledger.progress(book.frame()).orderBy("table_name").collect()]

    def monitor(self, seconds: float, rounds: int):
        """Status, the share of chunks done, the rows that the plan expects in the others, and the time left at the average rate,
        every so often."""
        began = time.time()
        for _ in range(rounds):
            rows = self.status()
            done, total = sum(r["chunks_loaded"] for r in rows), sum(r["chunks_total"] for r in rows)
            yield {"tables": rows, "percent": 100 * done // max(1, total), "rows_left": sum(r["rows_planned"] - r["rows_loaded"] for r in rows), "eta_seconds": ledger.eta_seconds(done, total, time.time() - began)}
            if done == total:
                return
            time.sleep(seconds)

    def test(self) -> list[Finding]:
        out = []
        for t in self.schema().tables:
            r = compare.structure(self.source_rows(t), self.target_rows(t), t.name).first()
            out += [Finding("TEST", t.name, r["severity"], r["message"])] if r["severity"] else []
        return out

    def test_count(self) -> list[Finding]:
        out = []
        for t in self.schema().tables:
            target = self.target_rows(t)
            if target is None:
                out.append(Finding("TEST_COUNT", t.name, "BLOCKER", "table is missing"))
                continue
            r = compare.counts(self.source_rows(t), target, t.name).first()
            out += [] if r["matched"] else [Finding("TEST_COUNT", t.name, "BLOCKER", f"row count differs (source={r['source_rows']}, target={r['target_rows']})")]
        return out

    def test_data(self, sample: int | None = None) -> list[Finding]:
        """Rows by key, or as a multiset for tables without one; up to the budget of findings a table."""
        o, out = self.config.options, []
        n = o.sample_rows if sample is None else sample
        for t in self.schema().tables:
            target, cols = self.target_rows(t), [c.name for c in t.columns]
            if target is None:
                out.append(Finding("TEST_DATA", t.name, "BLOCKER", "table is missing"))
            elif t.primary_key:
                bad = compare.keyed(self.source_rows(t), target, t.primary_key, cols, o.scale, n).filter("status <> 'matched'").orderBy(*t.primary_key).limit(o.test_data_max_errors)
                out += [Finding("TEST_DATA", t.name, "BLOCKER", f"row {[r[k] for k in t.primary_key]} is {r['status']}") for r in bad.collect()]
            else:
                bad = compare.multiset(self.source_rows(t), target, cols, o.scale).limit(o.test_data_max_errors)
                out += [Finding("TEST_DATA", t.name, "BLOCKER", f"row digest {r['digest'][:12]}: {r['source_rows']} in the source, {r['target_rows']} in the target") for r in bad.collect()]
        return out

    def test_index(self) -> list[Finding]:
        out = []
        for t in self.schema().tables:
            target = self.target_rows(t)
            for c in {c for fk in t.foreign_keys for c in fk.columns} if target is not None else ():
                r = compare.mode_probe(target, c).first()
                out += [] if r is None or r["matched"] else [Finding("TEST_INDEX", t.name, "BLOCKER", f"{c} = {r['value']}: {r['group_rows']} rows by group, {r['lookup_rows']} by lookup")]
        return out

    # -- change capture

    def _registry_path(self) -> str:
        return f"{self.config.target.path.rstrip('/')}/state/extracts.json"

    def extracts(self) -> dict[str, dict]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._registry_path())
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return {}
        return json.loads("".join(r["value"] for r in self.spark.read.text(self._registry_path(), wholetext=True).collect()))

    def register(self, all_: dict) -> None:
        """Write the registry of captures."""
        self._write(self._registry_path(), json.dumps(all_))

    def identity(self) -> str:
        """What tells this source from another: a capture goes on only where it began."""
        s = self.config.source
        return f"{s.kind if s.kind == 'parquet' else s.dialect}:{s.path or s.address}/{s.schema or ''}"

    def replica(self) -> Replica:
        return Replica(self.spark, f"{self.config.target.path.rstrip('/')}/replica", buckets=self.config.cdc.replica_buckets)

    def trail(self, name: str) -> Trail:
        return Trail(self.spark, f"{self.config.target.path.rstrip('/')}/trail/{name}", self.config.cdc.trail_rotate_mb << 20)

    def _own(self, name: str) -> dict:
        """What is registered of a capture; a new one's, if there is none.  One that began at another source is refused."""
        own = self.extracts().get(name) or {"tables": [], "watermarks": {}, "source": self.identity()}
        if own.get("source", self.identity()) != self.identity():
            raise SourceChanged(f"{name} captures {own['source']}, not {self.identity()}: drop it first")
        return own

    def extract_log(self, name: str, tables: list[str] | None = None, refresh: bool = False) -> dict:
        """Capture what the log has, changes of every kind: peeked, written to the trail, and then consumed.

        Tables without a primary key are skipped; the set is pinned as by extract.  The registry keeps the epoch of the log, so
        that one of another server is refused.
        """
        own, trail = self._own(name), self.trail(name)
        trail.heal()
        wanted = [t for t in self.schema().tables if tables is None or t.name in tables]
        keyed = {t.name: list(t.primary_key) for t in wanted if t.primary_key}
        new = sorted(set(keyed) - set(own["tables"]))
        pinned = set(own["tables"]) | (set(new) if refresh or not own["tables"] else set())
        before = trail.last_seq()
        state = f"{self.config.target.path.rstrip('/')}/state/capture/{name}"
        own |= {"tables": sorted(pinned), "log": True}
        keys, log = {n: k for n, k in keyed.items() if n in pinned}, self.config.source.recording
        if self.config.source.dialect == "mysql":
            own["epoch"] = capture.capture_binlog(self.spark, log, trail, keys, own.get("epoch"))
        else:
            own["epoch"] = capture.capture(self.spark, log, name, trail, keys, state, own.get("epoch"))
        self.register(self.extracts() | {name: own})
        return {"captured": trail.last_seq() - before, "tables": own["tables"], "not_adopted": sorted(set(new) - pinned), "skipped": sorted(t.name for t in wanted if not t.primary_key)}

    def extract(self, name: str, version: str, tables: list[str] | None = None, refresh: bool = False) -> dict:
        """Capture rows whose version column is past the watermark (all, the first time) as updates.

        Rows with a null version can't be told from changed ones: every run captures them, and applying them again
        changes nothing.  While all versions of a table are null it has no watermark, so that each run is a first one.
        The set of tables is pinned by the first run; others are only reported, unless refreshed.  The trail is
        written before the watermark moves, so that a crash between them repeats changes but loses none.
        """
        if self.config.source.recording:
            return self.extract_log(name, tables, refresh)
        all_, schema, own = self.extracts(), self.schema(), self._own(name)
        self.trail(name).heal()
        wanted = [t for t in schema.tables if (tables is None or t.name in tables) and any(c.name == version for c in t.columns)]
        new = [t.name for t in wanted if t.name not in own["tables"]]
        pinned = set(own["tables"]) | (set(new) if refresh or not own["tables"] else set())
        captured, skipped = 0, []
        for t in wanted:
            if t.name not in pinned:
                continue
            if not t.primary_key:
                skipped.append(t.name)
                continue
            mark = own["watermarks"].get(t.name)
            df = self.source_rows(t, None, self.moment(t))
            high, nulls = df.agg(F.max(version), F.count_if(F.col(version).isNull())).first()
            if not nulls and high in (None, mark):
                continue
            rows = fresh_rows(df, version, mark, high)
            image = lambda cols: F.create_map(*[x for c in cols for x in (F.lit(c), tagged_text(F.col(f"`{c}`").cast("string")))])  # noqa: B023, E731
            records = rows.select(F.lit("U").alias("op"), F.lit(t.name).alias("table"), image(t.primary_key).alias("key"), image([c.name for c in t.columns]).alias("after"), F.col(version).cast("bigint").alias("scn"), F.monotonically_increasing_id().alias("ord"))
            captured += self.trail(name).append_frame(records, "ord")
            if high is not None:
                own["watermarks"][t.name] = high
        own |= {"tables": sorted(pinned), "version": version}
        self.register(all_ | {name: own})
        return {"captured": captured, "tables": own["tables"], "not_adopted": sorted(set(new) - pinned), "skipped": skipped}

    def drop_extract(self, name: str, with_trail: bool = False) -> bool:
        """Forget a capture and its place in the replica, and remove its trail if asked to; returns whether there was one.

        The trail goes first and the registry last, so that a drop that fails can be repeated.  Its tables stay as they are.
        """
        all_ = self.extracts()
        if name not in all_:
            return False
        if with_trail:
            self.trail(name).remove()
            self.replica().forget(name)
        self.register({k: v for k, v in all_.items() if k != name})
        return True

    def dead_letters_path(self, name: str) -> str:
        return f"{self.config.target.path.rstrip('/')}/state/dead_letters/{name}"

    def replicat(self, name: str, reconcile: bool | None = None) -> dict:
        """Apply a trail to versioned copies of its tables, published together; keys that the source no longer has are
        deleted by default where the capture is by version, which sees no deletes.

        Each capture has a cursor of its own in the replica.  Records that don't fit their table are parked as JSON under
        state/dead_letters with the reason, up to poison_max_per_run a batch; a batch that is repeated writes its own again.
        """
        replica, own = self.replica(), self.extracts()[name]
        pinned, reconcile = own["tables"], not own.get("log") if reconcile is None else reconcile
        self._adopt(replica, name)
        tables = {t.name: t for t in self.schema().tables if t.name in pinned and t.primary_key}
        with replica.claimed():
            new = {n: replica.stage(n, self.source_rows(t).limit(0), t.primary_key) for n, t in tables.items() if n not in replica.pointer().tables}
            if new:
                now = replica.pointer().applied(name)
                replica.publish(new, now.batch + 1, now.cursor, name, now)

        def park(table: str, bad: DataFrame) -> None:
            batch = replica.pointer().applied(name).batch + 1
            record = F.to_json(F.struct(*[c for c in bad.columns if c != "reason"]))
            bad.select("seq", F.lit(table).alias("for_table"), "reason", record.alias("record")).write.mode("overwrite").json(f"{self.dead_letters_path(name)}/batch={batch}/of={table}")

        cursor = replicate.replicate_all(self.trail(name), replica, {n: t.primary_key for n, t in tables.items()}, self.config.cdc.apply_batch, name, self.config.cdc.poison_retries, lambda: self.source().ping(), whole=self.whole_transactions(), park=park, most_parked=self.config.cdc.poison_max_per_run)
        out = {n: {"cursor": cursor, "deleted": replicate.reconcile(replica.table(n), self.source_rows(t), t.primary_key, name) if reconcile else 0} for n, t in tables.items()}
        for key, n in self.orphans(tables).items():
            out[key.split(".")[0]].setdefault("orphans", {})[key.split(".", 1)[1]] = n
        return out

    def whole_transactions(self) -> bool:
        """Whether transactions are applied whole: as the setting says, and if a trial of the target finds that it can."""
        mode = (self.config.cdc.txn_apply or "auto").strip().lower()
        if mode not in ("auto", "on", "off"):
            raise ValueError(f"txn_apply is auto, on or off, not {mode}")
        return mode != "off" and sinks.probe(self.spark, f"{self.config.target.path.rstrip('/')}/state")["atomic"]

    def _adopt(self, replica: Replica, name: str) -> None:
        """A place without a name, from before each capture had its own, is that of the only capture there is."""
        now = replica.pointer()
        if "" in now.streams and name not in now.streams:
            if len(self.extracts()) > 1:
                raise ValueError("the replica's one cursor can't be told to be that of one of several captures: drop the others first")
            old = now.applied()
            replica.publish({}, old.batch, old.cursor, name)
            replica.forget("")

    def orphans(self, names: Iterable[str]) -> dict[str, int]:
        """Foreign keys between replicated tables that have rows without a parent, and how many: changes are applied by
        table, so this is looked at once a batch is published."""
        replica, found = self.replica(), {}
        have = {t.name: t for t in self.schema().tables if t.name in names}
        for t in have.values():
            for fk in t.foreign_keys:
                if fk.parent in have:
                    child, parent = replica.table(t.name).read(), replica.table(fk.parent).read()
                    keys = child.select(*[F.col(a).alias(b) for a, b in zip(fk.columns, fk.parent_columns)]).na.drop()
                    n = keys.join(parent.select(*fk.parent_columns), list(fk.parent_columns), "left_anti").count()
                    found |= {f"{t.name}.{fk.name or '_'.join(fk.columns)}": n} if n else {}
        return found

    def captures(self) -> dict[str, dict]:
        """The registered captures, with the number of records that each has parked."""
        out = {}
        for name, own in self.extracts().items():
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.dead_letters_path(name))
            there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
            out[name] = own | {"dead_letters": self.spark.read.text(self.dead_letters_path(name)).count() if there else 0}
        return out

    def doctor(self) -> dict:
        """What runs here, whether the source answers, and whether the target takes a table and gives it back."""
        out = {"spark": self.spark.version}
        for what, look in (("source_answers", lambda: self.source().ping()), ("target", lambda: sinks.probe(self.spark, f"{self.config.target.path.rstrip('/')}/state")), ("source_tables", lambda: len(self.schema().tables)), ("target_round_trip", lambda: sinks.smoke_test(self.spark, f"{self.config.target.path.rstrip('/')}/state/smoke_test"))):
            try:
                out[what] = look()
            except Exception as e:  # noqa: BLE001 - told to the caller
                out[what] = f"{type(e).__name__}: {str(e)[:200]}"
        out["healthy"] = isinstance(out["source_tables"], int) and out["target_round_trip"] is True
        return out

    def lag(self, name: str) -> dict:
        """How many captured records are still to be applied."""
        written, applied = self.trail(name).last_seq(), self.replica().pointer().applied(name).cursor
        return {"written": written, "applied": applied, "behind": max(0, written - applied)}

    def source_lag(self, name: str) -> dict:
        """How far a capture is behind its source: of a log the files and bytes that stand after it; of version columns the rows
        past each table's watermark (those without a version aren't counted: every run captures them).

        A report that can't be made says why, and fails nothing.
        """
        try:
            own = self._own(name)
            if own.get("log"):
                log = self.config.source.recording
                return capture.behind_binlog(log, self.trail(name)) if self.config.source.dialect == "mysql" else capture.behind_slot(self.spark, log, name, self.trail(name))
            version = own.get("version")
            tables = {t.name: t for t in self.schema().tables if t.name in own["tables"] and t.primary_key and any(c.name == version for c in t.columns)}
            past = lambda n: F.col(f"`{version}`").isNotNull() if (mark := own["watermarks"].get(n)) is None else F.col(f"`{version}`") > mark
            rows = {n: self.source_rows(t).filter(past(n)).count() for n, t in tables.items()}
            return {"mode": "version", "rows_behind": sum(rows.values()), "tables": {n: x for n, x in rows.items() if x}}
        except Exception as e:  # noqa: BLE001 - a report only
            return {"error": f"{type(e).__name__}: {str(e)[:200]}"}

    def purge(self, name: str) -> list[str]:
        """Remove the trail's segments that are applied in full, by the capture's own cursor."""
        return self.trail(name).purge(self.replica().pointer().applied(name).cursor)

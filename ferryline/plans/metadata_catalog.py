"""Queries over metadata: what the functions on types, names, statements and codecs give for every customer.

Types, identifiers, DDL, rewrites and codecs work on names and texts.  Each query here runs them over the rows of a table: names,
sizes, literals and values come from the row.  Its twin states the results as templates, which SQL fills from the same row.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.idents import ident, unique_names
from ..functions.types import Kind, TypeRegistry, parse_type
from ..operators.chunks import plan_chunks
from ..sources import decoding, jdbc, trail
from ..sources.tables import table
from . import assess, ddl, gaps, ledger, rewrite
from .model import Check, Column, ForeignKey, Index, Routine, Schema, Sequence as Seq, Table, Trigger, View

QUERIES: dict = {}
SQL: dict = {}


#: What templates take from a customer: Spark SQL and DuckDB read these alike.
VALUES = {
    "k": "CAST(c_custkey AS VARCHAR(20))", "k3": "CAST(c_custkey + 3 AS VARCHAR(20))", "k6": "CAST(c_custkey + 6 AS VARCHAR(20))", "k9": "CAST(c_custkey + 9 AS VARCHAR(20))", "k10": "CAST(c_custkey + 10 AS VARCHAR(20))",
    "n": "CAST(c_nationkey + 1 AS VARCHAR(20))", "m": "CAST(c_nationkey + 11 AS VARCHAR(20))", "name": "c_name", "lower": "lower(c_name)", "seg": "lower(c_mktsegment)",
}
Values = namedtuple("Values", ["customer", *VALUES])
#: Customers whose rows are made at a time: what a task holds doesn't grow with the table, nor with the session's Arrow batches.
AT_A_TIME = 1000


def _sql(v) -> str:
    """A stated value: NULL, a number, a template to be filled, or after = an expression over the row."""
    if v is None or isinstance(v, int):
        return "NULL" if v is None else str(v)
    if v.startswith("="):
        return v[1:]
    text = "'" + v.replace("'", "''") + "'"
    for x, expression in VALUES.items():
        if f"@{x}@" in v:
            text = f"replace({text}, '@{x}@', {expression})"
    return text


def _spread(rows: DataFrame) -> DataFrame:
    """Rows over as many tasks as the session runs: a table of names is small in bytes, so that a scan has few, and Python's work
    on each row is not."""
    spark = rows.sparkSession
    return rows.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def _maker(f, cols: Sequence[str], whole: Sequence[bool]):
    """What gives a task's customers the rows that ``f`` makes of each; ``whole`` says which columns are numbers."""
    made = pa.schema([("customer", pa.int64()), *((c, pa.int64() if w else pa.string()) for c, w in zip(cols, whole))])

    def each(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, AT_A_TIME):
                given = map(Values._make, zip(*(c.to_pylist() for c in batch.slice(i, AT_A_TIME).columns)))
                if out := [(v.customer, *r) for v in given for r in f(v)]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), made.types)], schema=made)

    return each


def stated(names: str, expected: Sequence[tuple]):
    """Registers a function that gives rows for the values of one customer; the twin is the templates that are stated."""
    cols = names.split()
    whole = [any(isinstance(r[i], int) or str(r[i]).startswith("=") for r in expected) for i in range(len(cols))]

    def put(f):
        def run(spark, sf):
            kinds = ", ".join(["customer bigint", *(f"{c} {'bigint' if w else 'string'}" for c, w in zip(cols, whole))])
            rows = table(spark, sf, "customer").selectExpr("CAST(c_custkey AS bigint) AS customer", *[f"{e} AS {x}" for x, e in VALUES.items()])

            return _spread(rows).mapInArrow(_maker(f, cols, whole), kinds)

        QUERIES[f.__name__] = run
        one = lambda r: ", ".join(f"CAST({_sql(v)} AS {'BIGINT' if w else 'VARCHAR'}) AS {c}" for c, v, w in zip(cols, r, whole))
        SQL[f.__name__] = " UNION ALL ".join(f"SELECT CAST(c_custkey AS BIGINT) AS customer, {one(r)} FROM customer" for r in expected)
        return f

    return put


@lru_cache(4096)
def _places(template: str) -> list[tuple[str, str]]:
    """The values that a template takes, with how it writes them."""
    return [(f"@{name}@", name) for name in VALUES if f"@{name}@" in template]


def _filled(rows: Sequence[tuple], v) -> list[tuple]:
    """Templates with a row's values: as in the twin, a value is put where the template itself names it."""
    def fill(x):
        if isinstance(x, str):
            for place, name in _places(x):
                x = x.replace(place, getattr(v, name))
        return x

    return [tuple(map(fill, r)) for r in rows]


_TYPES = [
    ("oracle", "NUMBER", "NUMERIC"), ("oracle", "NUMBER(@m@,2)", "DECIMAL(@m@, 2)"), ("oracle", "DATE", "TIMESTAMP"), ("oracle", "CLOB", "TEXT"), ("oracle", "VARCHAR2(@k@)", "VARCHAR(@k@)"),
    ("oracle", "TIMESTAMP(6) WITH TIME ZONE", "TIMESTAMP WITH TIME ZONE"), ("oracle", "XMLTYPE", "TEXT"), ("oracle", "BINARY_DOUBLE", "DOUBLE PRECISION"),
    ("mysql", "tinyint(1)", "BOOLEAN"), ("mysql", "mediumint", "INTEGER"), ("mysql", "json", "JSONB"), ("mysql", "set('@seg@')", "TEXT"), ("mysql", "longblob", "BYTEA"), ("mysql", "year", "SMALLINT"),
    ("mssql", "money", "DECIMAL(19, 4)"), ("mssql", "nvarchar(max)", "TEXT"), ("mssql", "uniqueidentifier", "UUID"), ("mssql", "float", "DOUBLE PRECISION"), ("mssql", "xml", "TEXT"),
    ("postgres", "timestamp without time zone", "TIMESTAMP"), ("postgres", "numeric", "NUMERIC"), ("postgres", "int8", "BIGINT"), ("postgres", "inet", "TEXT"), ("postgres", "geometry", "geometry"),
]


@stated("dialect source_type target_type", _TYPES)
def type_map(v):
    return [(d, s, parse_type(s, d).sql()) for d, s, _ in _filled(_TYPES, v)]


@stated("kind postgres mysql spark", [
    ("smallint", "SMALLINT", "SMALLINT", "SMALLINT"), ("double", "DOUBLE PRECISION", "DOUBLE", "DOUBLE"), ("text", "TEXT", "LONGTEXT", "STRING"), ("bytea", "BYTEA", "LONGBLOB", "BINARY"),
    ("timestamp", "TIMESTAMP", "DATETIME", "TIMESTAMP_NTZ"), ("timestamptz", "TIMESTAMP WITH TIME ZONE", "TIMESTAMP", "TIMESTAMP"), ("boolean", "BOOLEAN", "TINYINT(1)", "BOOLEAN"), ("uuid", "UUID", "CHAR(36)", "STRING"),
    ("numeric", "NUMERIC", "DECIMAL(65, 30)", "DECIMAL(38,18)"), ("varchar", "VARCHAR(255)", "LONGTEXT", "STRING"), ("decimal", "DECIMAL(@m@, 2)", "DECIMAL(@m@, 2)", "DECIMAL(@m@,2)"),
])
def type_spelling(v):
    kinds = {k: Kind(k) for k in ("smallint", "double", "text", "bytea", "timestamp", "timestamptz", "boolean", "uuid", "numeric", "varchar")} | {"decimal": Kind("decimal", int(v.m), 2)}
    return [(n, *(k.sql(d) for d in ("postgres", "mysql", "spark"))) for n, k in kinds.items()]


@stated("source_type target_type provenance", [("NUMBER(@n@)", "BIGINT", "data_type_override"), ("DATE", "TIMESTAMP", "default"), ("CLOB", "JSONB", "modify_type_override")])
def type_overrides(v):
    r = TypeRegistry("oracle", {"NUMBER": "BIGINT"}, {f"hr.emp{v.k}.doc": "JSONB"})
    found = [r.resolve(f"NUMBER({v.n})"), r.resolve("DATE"), r.resolve("CLOB", f"EMP{v.k}", "DOC", "HR")]
    return [(x.source_type, x.kind.sql(), x.provenance) for x in found]


@stated("name folded kept mysql oracle", [("EMP@k@", "emp@k@", '"EMP@k@"', "`emp@k@`", '"EMP@k@"'), ("order", '"order"', '"order"', "`order`", '"order"'), ('a"@k@', '"a""@k@"', '"a""@k@"', '`a"@k@`', '"a""@k@"'), ("x_@k@", "x_@k@", "x_@k@", "`x_@k@`", '"x_@k@"'),
    ("@name@", '"@lower@"', '"@name@"', "`@lower@`", '"@name@"')])
def identifier_quoting(v):
    return [(n, ident(n), ident(n, True), ident(n, dialect="mysql"), ident(n, dialect="oracle")) for n in (f"EMP{v.k}", "order", f'a"{v.k}', f"x_{v.k}", v.name)]


@stated("table_name index_name unique_name", [("a", "i@k@", "i@k@"), ("b@n@", "i@k@", "b@n@_i@k@"), ("b@n@", "i@k@", "b@n@_i@k@_2"), ("c", "@seg@", "@seg@")])
def name_dedup(v):
    pairs = [("a", f"i{v.k}"), (f"b{v.n}", f"i{v.k}"), (f"b{v.n}", f"i{v.k}"), ("c", v.seg)]
    return [(*p, n) for p, n in zip(pairs, unique_names(pairs))]


def _schema(v) -> Schema:
    """A schema whose names, sizes and routine come from a customer."""
    k = v.k
    emp = Table(f"EMP{k}", (Column("ID", Kind("decimal", int(v.m), 0), False, f"HR.EMP_SEQ{k}.NEXTVAL"), Column("ACTIVE", Kind("boolean"), True, "1"), Column("HIRED", Kind("timestamp"), True, "SYSDATE")), "HR", ("ID",), (ForeignKey("FK_D", ("ID",), "DEPT", ("ID",)),), (Index(f"IX{k}", ("HIRED",), False, "ACTIVE"),), (Check(f"ID > {k}", "CK"),), ("RANGE", ("HIRED",)))
    views = [View(f"B{k}", f"SELECT * FROM A{k} WHERE active = 1"), View(f"A{k}", f"SELECT NVL(id, {k}) AS id, active FROM emp{k}"), View("M", "SELECT 1", True)]
    return Schema("HR", [emp], views, [Seq(f"EMP_SEQ{k}", int(k), 2, cache=20)], [Routine("P", "procedure", " cursor c; forall x" * int(v.n))], [Trigger("T", f"EMP{k}")])


@stated("n statement", [
    (1, "CREATE TABLE emp@k@ (\n    id DECIMAL(@m@, 0) NOT NULL DEFAULT nextval('emp_seq@k@'),\n    active BOOLEAN DEFAULT true,\n    hired TIMESTAMP DEFAULT CURRENT_TIMESTAMP,\n    PRIMARY KEY (id),\n    CONSTRAINT ck CHECK (ID > @k@)\n);"),
    (2, "CREATE SEQUENCE emp_seq@k@ START WITH @k@ INCREMENT BY 2 CACHE 20;"), (3, "CREATE INDEX ix@k@ ON emp@k@ (hired) WHERE ACTIVE;"), (4, "CREATE VIEW a@k@ AS SELECT COALESCE(id, @k@) AS id, active FROM emp@k@;"),
    (5, "CREATE VIEW b@k@ AS SELECT * FROM A@k@ WHERE active = true;"), (6, "ALTER TABLE emp@k@ ADD CONSTRAINT fk_d FOREIGN KEY (id) REFERENCES dept (id);"),
])
def ddl_export(v):
    return list(enumerate(ddl.export(_schema(v))[0].strip().split("\n\n"), 1))


@stated("dialect statement", [
    ("mysql", "CREATE TABLE `emp@k@` (\n  `id` DECIMAL(@m@, 0) NOT NULL,\n  `active` TINYINT(1) DEFAULT 1,\n  `hired` DATETIME DEFAULT CURRENT_TIMESTAMP,\n  PRIMARY KEY (`id`),\n  CONSTRAINT `ck` CHECK (ID > @k@)\n)"),
    ("mysql", "ALTER TABLE `emp@k@` DROP FOREIGN KEY `fk_d`"), ("oracle", 'CREATE SEQUENCE "EMP_SEQ@k@" START WITH @k@ INCREMENT BY 2'), ("oracle", 'CREATE INDEX "IX@k@" ON "EMP@k@" ("HIRED")'),
])
def ddl_other_dialects(v):
    schema = _schema(v)
    emp = schema.tables[0]
    return [("mysql", ddl.create_table(emp, dialect="mysql")), ("mysql", ddl.drop_foreign_keys(emp, dialect="mysql")[0]), ("oracle", ddl.create_sequence(schema.sequences[0], dialect="oracle")), ("oracle", ddl.create_index(emp, emp.indexes[0], dialect="oracle"))]


_REWRITES = [
    ("SELECT s@k@.NEXTVAL FROM DUAL", "SELECT nextval('s@k@')", "keep:nextval keep:from_dual"),
    ("SELECT SYS_GUID(), '@name@ SYS_GUID()' FROM t@k@", "SELECT gen_random_uuid(), '@name@ SYS_GUID()' FROM t@k@", "keep:sys_guid"),
    ("SELECT a FROM t WHERE ROWNUM <= @n@ AND b = @k@", "SELECT a FROM t WHERE  b = @k@ LIMIT @n@", "keep:rownum_limit"),
    ("SELECT `a @k@` FROM t", 'SELECT "a @k@" FROM t', "keep:mysql_backtick_ident"),
    ("SELECT IF(a, IF(b, '@name@', 2), @k@) FROM t", "SELECT CASE WHEN a THEN CASE WHEN b THEN '@name@' ELSE 2 END ELSE @k@ END FROM t", "keep:mysql_if"),
    ("SELECT GROUP_CONCAT(a@k@ ORDER BY b SEPARATOR '@seg@') FROM t", "SELECT string_agg((a@k@)::text, '@seg@' ORDER BY b) FROM t", "keep:mysql_group_concat"),
    ("SELECT t.a@k@, t.b@k@, sum(t.c) FROM t GROUP BY t.a@k@", "SELECT t.a@k@, t.b@k@, sum(t.c) FROM t GROUP BY t.a@k@, t.b@k@ ", "keep:group_by_nonaggregates"),
    ("SELECT NVL(a, @k@), NVL2(a, b, @n@), DECODE(a, @k@, '@name@', 'y'), SYSDATE FROM t", "SELECT COALESCE(a, @k@), CASE WHEN a IS NOT NULL THEN b ELSE @n@ END, CASE a WHEN @k@ THEN '@name@' ELSE 'y' END, CURRENT_TIMESTAMP FROM t", "translate:nvl translate:nvl2 translate:decode translate:sysdate"),
    ("SELECT TO_CHAR(a@k@) FROM t WHERE a = b@n@(+)", "SELECT TO_CHAR(a@k@) FROM t WHERE a = b@n@(+)", "note:oracle_outer_join flag:to_char"),
]


@stated("input output passes", _REWRITES)
def dialect_rewrite(v):
    out = []
    for text, _, _ in _filled(_REWRITES, v):
        new, fired, _ = rewrite.rewrite_sql(text)
        out.append((text, new, " ".join(fired)))
    return out


@stated("n view_name", [(1, "a@k@"), (2, "b@k@"), (3, "c@k@"), (4, "x"), (5, "y")])
def view_order(v):
    return list(enumerate(rewrite.ordered_views([(f"c{v.k}", f"SELECT * FROM b{v.k}"), (f"b{v.k}", f"SELECT * FROM a{v.k}"), (f"a{v.k}", "SELECT 1"), ("x", "FROM y"), ("y", "FROM x")]), 1))


@stated("feature object_ref occurrences severity", [("f@seg@", "o@k@", "=c_nationkey + 2", "degraded"), ("f@seg@", None, 1, "degraded"), ("g", None, 2, "blocker")])
def gap_report(v):
    f, o = f"f{v.seg}", f"o{v.k}"
    r = gaps.GapReport([gaps.Gap(f, "r", object_ref=o), gaps.Gap(f, "r"), gaps.Gap("g", "r", "blocker"), gaps.Gap(f, "r", "blocker", o, int(v.n)), gaps.Gap("g", "r")])
    return [(g.feature, g.object_ref, g.occurrences, g.severity) for g in r.gaps]


@stated("item amount", [("checks", 1), ("columns", 3), ("foreign_keys", 1), ("hundredths_of_days", 55), ("indexes", 1), ("materialized_views", 1), ("partitioned_tables", 1), ("primary_keys", 1), ("routine_units", "=6 * (c_nationkey + 1)"), ("routines", 1), ("sequences", 1), ("tables", 1), ("triggers", 1), ("views", 2)])
def assessment(v):
    r = assess.assess(_schema(v))
    return [*r.inventory.items(), ("hundredths_of_days", round(100 * r.days)), ("routine_units", r.routine_units)]


@stated("chunk_id predicate", [("EMP:0", '"ID" >= @k@ AND "ID" < @k3@'), ("EMP:1", '"ID" >= @k3@ AND "ID" < @k6@'), ("EMP:2", '"ID" >= @k6@ AND "ID" < @k9@'), ("EMP:3", '"ID" >= @k9@ AND "ID" < @k10@'), ("LOG:0", None)])
def chunk_predicates(v):
    return [(c.chunk_id, c.predicate()) for c in plan_chunks("EMP", "ID", (int(v.k), int(v.k9)), 4) + plan_chunks("LOG", None, None, 4)]


@stated("dialect statement", [("oracle", 'SELECT "A" FROM "HR"."EMP@k@" AS OF SCN @k9@ WHERE "A" >= @k@'), ("mysql", "SELECT `@name@` FROM `HR`.`EMP@k@` WHERE x"), ("postgres", 'SELECT "A@n@" FROM "EMP@k@"'), ("mssql", "SELECT [@name@] FROM [HR].[EMP@k@]")])
def scan_text(v):
    name = f"EMP{v.k}"
    return [("oracle", jdbc.select_text("oracle", name, ["A"], "HR", f'"A" >= {v.k}', v.k9)), ("mysql", jdbc.select_text("mysql", name, [v.name], "HR", "x")), ("postgres", jdbc.select_text("postgres", name, [f"A{v.n}"], "HR")), ("mssql", jdbc.select_text("mssql", name, [v.name], "HR"))]


_DEFAULTS = [("mssql", "((@k@))", "@k@"), ("mssql", "(getdate())", "CURRENT_TIMESTAMP"), ("mysql", "'@name@'", None), ("postgres", "nextval('s@k@'::regclass)", "nextval('s@k@')"), ("oracle", "SYSDATE + @n@ ", "SYSDATE + @n@")]


@stated("dialect given kept", _DEFAULTS)
def column_defaults(v):
    return [(d, t, jdbc.column_default(t, d)) for d, t, _ in _filled(_DEFAULTS, v)]


@stated("given wire", [("dec", '{"__t__": "dec", "v": "@k@.50"}'), ("b64", '{"__t__": "b64", "v": "AP8="}'), ("json", '{"__t__": "json", "v": "{\\"a\\":@k@,\\"b\\":[\\"@name@\\"]}"}'), ("set", '{"__t__": "set", "v": "@seg@,~"}'), ("int", "@k@"), ("text", '"@name@"'), ("null", "null")])
def value_codec(v):
    import json
    from decimal import Decimal

    values = {"dec": Decimal(f"{v.k}.50"), "b64": b"\x00\xff", "json": {"b": [v.name], "a": int(v.k)}, "set": {"~", v.seg}, "int": int(v.k), "text": v.name, "null": None}
    return [(k, json.dumps(trail.encode(x))) for k, x in values.items()]


_LINES = [
    ("table public.t: INSERT: id[integer]:@k@ v[text]:'it''s @name@'", "I", "id=@k@", "id=@k@ v=it's @name@", ""), ("table public.t: UPDATE: old-key: id[integer]:@k@ new-tuple: id[integer]:@k9@ v[text]:unchanged-toast-datum", "U", "id=@k9@", "id=@k9@", "id=@k@"),
    ('table public."T": DELETE: id[integer]:@k@', "D", "id=@k@", "", ""), ("COMMIT @k@", None, None, None, None),
]


@stated("line op key after before_key", _LINES)
def change_lines(v):
    flat = lambda m: " ".join(f"{k}={x}" for k, x in m.items())
    out = []
    for line, *_ in _filled(_LINES, v):
        c = decoding.change_of(line, {"T": ["id"]})
        out.append((line, c["op"], flat(c["key"]), flat(c["after"]), flat(c["before_key"])) if c else (line, None, None, None, None))
    return out


@stated("question answer", [("defaults are left out", "same"), ("endpoints", "same"), ("other endpoints", "other"), ("batch size", "same"), ("chunks", "other")])
def run_identity(v):
    word = lambda same: "same" if same else "other"
    h, k = ledger.drift_hash, int(v.k)
    return [
        ("endpoints", word(ledger.run_id(v.name, v.k) == ledger.run_id(v.name, v.k))), ("other endpoints", word(ledger.run_id(v.name, v.k) == ledger.run_id(v.name, v.k9))), ("batch size", word(h({"x": k, "batch_size": 1}) == h({"x": k, "batch_size": k + 2}))),
        ("chunks", word(h({"chunks": k}) == h({"chunks": k + 1}))), ("defaults are left out", word(h({"per": k}, defaults={"per": k}) == h({}))),
    ]


def logical_decoding(spark, sf):
    """Events printed as a decoded stream, seven to a transaction, and read back."""
    e = table(spark, sf, "events")
    i = F.col("event_id")
    line = F.concat(F.lit("table public.ev: INSERT: id[bigint]:"), i.cast("string"), F.lit(" kind[text]:'"), F.replace("event_type", F.lit("'"), F.lit("''")), F.lit("' big[boolean]:"), F.when(F.col("value") > 50, "t").otherwise("f"))
    rows = e.select((i * 3 + 1).alias("ord"), line.alias("line"))
    rows = rows.union(e.filter(i % 7 == 0).select(i * 3, F.concat(F.lit("BEGIN "), F.floor(i / 7).cast("string"))))
    rows = rows.union(e.filter(i % 7 == 6).select(i * 3 + 2, F.concat(F.lit("COMMIT "), F.floor(i / 7).cast("string"))))
    lines = rows.select("ord", F.concat(F.lit("0/"), F.hex("ord")).alias("lsn"), "line")
    out = decoding.decode(lines, {"ev": ["id"]})
    return out.select(F.col("key")["id"].cast("bigint").alias("event_id"), "op", F.col("after")["kind"].alias("kind"), F.col("after")["big"].alias("big"), "txn_id", "txn_end", F.col("base").cast("bigint").alias("base"))


QUERIES["logical_decoding"] = logical_decoding
SQL["logical_decoding"] = """SELECT event_id, 'I' AS op, event_type AS kind, CASE WHEN value > 50 THEN 'true' ELSE 'false' END AS big, event_id // 7 AS txn_id, event_id % 7 = 6 AS txn_end, event_id * 3 + 1 AS base FROM events"""

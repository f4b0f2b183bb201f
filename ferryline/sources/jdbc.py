"""Database sources over JDBC: scans, counts, bounds and catalogue queries of the four dialects.

Everything relational is pushed to the database: column lists, range predicates, MIN, MAX and COUNT.  A table
is read in one partition per chunk, by the chunks' own predicates.  No driver jar comes with this package;
the text that is sent is built by pure functions, which is what the tests check.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.idents import quoted
from ..operators.chunks import Chunk

#: How each dialect counts, quotes, and names a moment to read at.
COUNT = {"oracle": "COUNT(*)", "mysql": "COUNT(*)", "postgres": "COUNT(*)", "mssql": "COUNT_BIG(*)"}
SNAPSHOT = {"oracle": " AS OF SCN {}"}
#: How a session begins: names in double quotes are names, and an Oracle session has no zone of its own.
SESSION = {"mysql": "SET SESSION sql_mode = CONCAT(@@sql_mode, ',ANSI_QUOTES')", "oracle": "ALTER SESSION SET TIME_ZONE = 'UTC'"}
PING = {"oracle": "SELECT 1 AS one FROM dual"}
CURRENT_SNAPSHOT = {"oracle": "SELECT dbms_flashback.get_system_change_number AS scn FROM dual"}
PREFIX = {"oracle": "jdbc:oracle:thin:@//", "mysql": "jdbc:mysql://", "postgres": "jdbc:postgresql://", "mssql": "jdbc:sqlserver://"}
#: Schemas that belong to the database itself.
SYSTEM_SCHEMAS = {
    "oracle": "SYS SYSTEM OUTLN DBSNMP XDB CTXSYS MDSYS ORDSYS WMSYS APPQOSSYS AUDSYS".split(),
    "mysql": "information_schema mysql performance_schema sys".split(),
    "postgres": "information_schema pg_catalog pg_toast".split(),
    "mssql": "sys INFORMATION_SCHEMA guest".split(),
}
#: Catalogue queries: columns, primary keys and foreign keys of a schema, with the same names in each dialect.
_STANDARD_COLUMNS = """SELECT c.table_name, c.column_name, c.ordinal_position, c.data_type, c.character_maximum_length AS char_length,
  c.numeric_precision, c.numeric_scale, c.is_nullable, c.column_default FROM information_schema.columns c
  JOIN information_schema.tables t ON t.table_schema = c.table_schema AND t.table_name = c.table_name
  WHERE c.table_schema = {schema} AND t.table_type = 'BASE TABLE' ORDER BY c.table_name, c.ordinal_position"""
_STANDARD_KEYS = """SELECT k.table_name, k.column_name, k.ordinal_position, k.constraint_name FROM information_schema.key_column_usage k
  JOIN information_schema.table_constraints c ON c.constraint_schema = k.constraint_schema AND c.constraint_name = k.constraint_name AND c.table_name = k.table_name
  WHERE k.table_schema = {schema} AND c.constraint_type = '{kind}' ORDER BY k.table_name, k.ordinal_position"""
CATALOGUE = {
    "oracle": {
        "columns": """SELECT c.table_name, c.column_name, c.column_id AS ordinal_position, c.data_type, c.char_length, c.data_precision AS numeric_precision,
  c.data_scale AS numeric_scale, c.nullable AS is_nullable, c.data_default AS column_default FROM all_tab_columns c JOIN all_tables t ON t.owner = c.owner AND t.table_name = c.table_name
  WHERE c.owner = {schema} AND NOT EXISTS (SELECT 1 FROM all_mviews m WHERE m.owner = c.owner AND m.mview_name = c.table_name) ORDER BY 1, 3""",
        "primary_keys": """SELECT k.table_name, k.column_name, k.position AS ordinal_position, k.constraint_name FROM all_cons_columns k JOIN all_constraints c
  ON c.owner = k.owner AND c.constraint_name = k.constraint_name WHERE c.owner = {schema} AND c.constraint_type = 'P' ORDER BY 1, 3""",
        "foreign_keys": """SELECT k.table_name, k.column_name, k.position AS ordinal_position, k.constraint_name, r.table_name AS parent_table, r.column_name AS parent_column FROM all_constraints c
  JOIN all_cons_columns k ON k.owner = c.owner AND k.constraint_name = c.constraint_name JOIN all_cons_columns r ON r.owner = c.r_owner AND r.constraint_name = c.r_constraint_name AND r.position = k.position
  WHERE c.owner = {schema} AND c.constraint_type = 'R' ORDER BY 1, 4, 3""",
        "views": "SELECT view_name, text AS definition FROM all_views WHERE owner = {schema}",
        "sequences": "SELECT sequence_name, last_number AS start_value, increment_by, min_value, max_value, cache_size, cycle_flag FROM all_sequences WHERE sequence_owner = {schema}",
        "schemas": "SELECT username AS schema_name FROM all_users",
    },
    "mysql": {
        "columns": _STANDARD_COLUMNS.replace("c.data_type,", "c.column_type AS data_type,"),
        "primary_keys": _STANDARD_KEYS.replace("{kind}", "PRIMARY KEY"),
        "foreign_keys": """SELECT table_name, column_name, ordinal_position, constraint_name, referenced_table_name AS parent_table, referenced_column_name AS parent_column FROM information_schema.key_column_usage
  WHERE table_schema = {schema} AND referenced_table_name IS NOT NULL ORDER BY 1, 4, 3""",
        "views": "SELECT table_name AS view_name, view_definition AS definition FROM information_schema.views WHERE table_schema = {schema}",
        "schemas": "SELECT schema_name FROM information_schema.schemata",
    },
    "postgres": {
        "columns": _STANDARD_COLUMNS,
        "primary_keys": _STANDARD_KEYS.replace("{kind}", "PRIMARY KEY"),
        "foreign_keys": """SELECT c.conrelid::regclass::text AS table_name, a.attname AS column_name, k.n AS ordinal_position, c.conname AS constraint_name, c.confrelid::regclass::text AS parent_table, p.attname AS parent_column
  FROM pg_constraint c CROSS JOIN LATERAL unnest(c.conkey, c.confkey) WITH ORDINALITY AS k(child, parent, n) JOIN pg_attribute a ON a.attrelid = c.conrelid AND a.attnum = k.child
  JOIN pg_attribute p ON p.attrelid = c.confrelid AND p.attnum = k.parent WHERE c.contype = 'f' AND c.connamespace::regnamespace::text = {schema} ORDER BY 1, 4, 3""",
        "views": "SELECT table_name AS view_name, view_definition AS definition FROM information_schema.views WHERE table_schema = {schema}",
        "sequences": "SELECT sequencename AS sequence_name, coalesce(last_value + increment_by, start_value) AS start_value, increment_by, min_value, max_value, cache_size, cycle AS cycle_flag FROM pg_sequences WHERE schemaname = {schema}",
        "schemas": "SELECT schema_name FROM information_schema.schemata",
    },
    "mssql": {
        "columns": _STANDARD_COLUMNS,
        "primary_keys": _STANDARD_KEYS.replace("{kind}", "PRIMARY KEY"),
        "foreign_keys": """SELECT t.name AS table_name, a.name AS column_name, k.constraint_column_id AS ordinal_position, f.name AS constraint_name, r.name AS parent_table, p.name AS parent_column FROM sys.foreign_keys f
  JOIN sys.foreign_key_columns k ON k.constraint_object_id = f.object_id JOIN sys.tables t ON t.object_id = k.parent_object_id JOIN sys.columns a ON a.object_id = k.parent_object_id AND a.column_id = k.parent_column_id
  JOIN sys.tables r ON r.object_id = k.referenced_object_id JOIN sys.columns p ON p.object_id = k.referenced_object_id AND p.column_id = k.referenced_column_id WHERE SCHEMA_NAME(t.schema_id) = {schema}""",
        "views": "SELECT v.name AS view_name, m.definition FROM sys.views v JOIN sys.sql_modules m ON m.object_id = v.object_id WHERE SCHEMA_NAME(v.schema_id) = {schema}",
        "schemas": "SELECT name AS schema_name FROM sys.schemas",
    },
}


#: Indexes (a row for each column of each), checks, partitions, routines and triggers, with the same names in each dialect.
CATALOGUE["oracle"] |= {
    "indexes": """SELECT i.table_name, i.index_name, k.column_name, k.column_position AS ordinal_position, CASE i.uniqueness WHEN 'UNIQUE' THEN 1 ELSE 0 END AS is_unique
  FROM all_indexes i JOIN all_ind_columns k ON k.index_owner = i.owner AND k.index_name = i.index_name
  WHERE i.table_owner = {schema} AND i.index_type = 'NORMAL' ORDER BY 1, 2, 4""",
    "checks": """SELECT table_name, constraint_name, search_condition_vc AS expression FROM all_constraints
  WHERE owner = {schema} AND constraint_type = 'C' AND generated = 'USER NAME' ORDER BY 1, 2""",
    "partitions": """SELECT t.table_name, t.partitioning_type AS strategy, k.column_name, k.column_position AS ordinal_position FROM all_part_tables t
  JOIN all_part_key_columns k ON k.owner = t.owner AND k.name = t.table_name WHERE t.owner = {schema} ORDER BY 1, 4""",
    "routines": """SELECT name AS routine_name, type AS routine_kind, line, text AS body FROM all_source
  WHERE owner = {schema} AND type IN ('PROCEDURE', 'FUNCTION', 'PACKAGE BODY')""",
    "triggers": """SELECT trigger_name, table_name, trigger_type AS timing, triggering_event AS events, trigger_body AS body FROM all_triggers
  WHERE owner = {schema} AND base_object_type = 'TABLE'""",
    "materialized_views": "SELECT mview_name AS view_name, query AS definition FROM all_mviews WHERE owner = {schema}",
}
CATALOGUE["mysql"] |= {
    "indexes": """SELECT table_name, index_name, column_name, seq_in_index AS ordinal_position, 1 - non_unique AS is_unique FROM information_schema.statistics
  WHERE table_schema = {schema} AND index_name <> 'PRIMARY' ORDER BY 1, 2, 4""",
    "checks": """SELECT t.table_name, c.constraint_name, c.check_clause AS expression FROM information_schema.check_constraints c
  JOIN information_schema.table_constraints t ON t.constraint_schema = c.constraint_schema AND t.constraint_name = c.constraint_name
  WHERE c.constraint_schema = {schema} AND t.constraint_type = 'CHECK' ORDER BY 1, 2""",
    "partitions": """SELECT DISTINCT table_name, partition_method AS strategy, partition_expression AS column_name, 1 AS ordinal_position FROM information_schema.partitions
  WHERE table_schema = {schema} AND partition_method IS NOT NULL""",
    "routines": "SELECT routine_name, routine_type AS routine_kind, routine_definition AS body FROM information_schema.routines WHERE routine_schema = {schema}",
    "triggers": """SELECT trigger_name, event_object_table AS table_name, action_timing AS timing, event_manipulation AS events, action_statement AS body
  FROM information_schema.triggers WHERE trigger_schema = {schema}""",
}
CATALOGUE["postgres"] |= {
    "indexes": """SELECT t.relname AS table_name, x.relname AS index_name, COALESCE(a.attname, pg_get_indexdef(i.indexrelid, k.n::int, true)) AS column_name, k.n AS ordinal_position,
  CASE WHEN k.att = 0 THEN 1 ELSE 0 END AS is_expression, CASE WHEN i.indisunique THEN 1 ELSE 0 END AS is_unique,
  pg_get_expr(i.indpred, i.indrelid) AS condition FROM pg_index i JOIN pg_class t ON t.oid = i.indrelid JOIN pg_class x ON x.oid = i.indexrelid
  CROSS JOIN LATERAL unnest(i.indkey) WITH ORDINALITY AS k(att, n) LEFT JOIN pg_attribute a ON a.attrelid = t.oid AND a.attnum = k.att AND k.att <> 0
  WHERE t.relnamespace::regnamespace::text = {schema} AND NOT i.indisprimary AND k.n <= i.indnkeyatts ORDER BY 1, 2, 4""",
    "checks": """SELECT conrelid::regclass::text AS table_name, conname AS constraint_name, pg_get_expr(conbin, conrelid) AS expression FROM pg_constraint
  WHERE contype = 'c' AND conrelid <> 0 AND connamespace::regnamespace::text = {schema} ORDER BY 1, 2""",
    "partitions": """SELECT t.relname AS table_name, CASE p.partstrat WHEN 'r' THEN 'RANGE' WHEN 'l' THEN 'LIST' ELSE 'HASH' END AS strategy, a.attname AS column_name, k.n AS ordinal_position
  FROM pg_partitioned_table p JOIN pg_class t ON t.oid = p.partrelid CROSS JOIN LATERAL unnest(p.partattrs) WITH ORDINALITY AS k(att, n)
  JOIN pg_attribute a ON a.attrelid = t.oid AND a.attnum = k.att WHERE t.relnamespace::regnamespace::text = {schema} ORDER BY 1, 4""",
    "partition_children": """SELECT c.relname AS table_name FROM pg_class c WHERE c.relispartition AND c.relnamespace::regnamespace::text = {schema}""",
    "routines": """SELECT p.proname AS routine_name, CASE p.prokind WHEN 'p' THEN 'PROCEDURE' ELSE 'FUNCTION' END AS routine_kind, p.prosrc AS body FROM pg_proc p
  WHERE p.pronamespace::regnamespace::text = {schema} AND p.prokind IN ('f', 'p')""",
    "triggers": """SELECT trigger_name, event_object_table AS table_name, action_timing AS timing, string_agg(event_manipulation, ' OR ') AS events, min(action_statement) AS body
  FROM information_schema.triggers WHERE trigger_schema = {schema} GROUP BY 1, 2, 3""",
    "materialized_views": "SELECT matviewname AS view_name, definition FROM pg_matviews WHERE schemaname = {schema}",
}
CATALOGUE["mssql"] |= {
    "indexes": """SELECT t.name AS table_name, i.name AS index_name, c.name AS column_name, k.key_ordinal AS ordinal_position, CAST(i.is_unique AS int) AS is_unique, i.filter_definition AS condition
  FROM sys.indexes i JOIN sys.tables t ON t.object_id = i.object_id JOIN sys.index_columns k ON k.object_id = i.object_id AND k.index_id = i.index_id
  JOIN sys.columns c ON c.object_id = k.object_id AND c.column_id = k.column_id
  WHERE SCHEMA_NAME(t.schema_id) = {schema} AND i.is_primary_key = 0 AND i.name IS NOT NULL AND k.is_included_column = 0""",
    "checks": """SELECT t.name AS table_name, c.name AS constraint_name, c.definition AS expression FROM sys.check_constraints c JOIN sys.tables t ON t.object_id = c.parent_object_id
  WHERE SCHEMA_NAME(t.schema_id) = {schema}""",
    "partitions": """SELECT t.name AS table_name, 'RANGE' AS strategy, c.name AS column_name, k.partition_ordinal AS ordinal_position FROM sys.tables t
  JOIN sys.indexes i ON i.object_id = t.object_id AND i.index_id IN (0, 1) JOIN sys.index_columns k ON k.object_id = i.object_id AND k.index_id = i.index_id AND k.partition_ordinal > 0
  JOIN sys.columns c ON c.object_id = k.object_id AND c.column_id = k.column_id WHERE SCHEMA_NAME(t.schema_id) = {schema}""",
    "routines": """SELECT o.name AS routine_name, CASE o.type WHEN 'P' THEN 'PROCEDURE' ELSE 'FUNCTION' END AS routine_kind, m.definition AS body FROM sys.objects o
  JOIN sys.sql_modules m ON m.object_id = o.object_id WHERE SCHEMA_NAME(o.schema_id) = {schema} AND o.type IN ('P', 'FN', 'IF', 'TF')""",
    "triggers": """SELECT g.name AS trigger_name, t.name AS table_name, CASE WHEN g.is_instead_of_trigger = 1 THEN 'INSTEAD OF' ELSE 'AFTER' END AS timing,
  (SELECT STRING_AGG(e.type_desc, ' OR ') FROM sys.trigger_events e WHERE e.object_id = g.object_id) AS events, m.definition AS body
  FROM sys.triggers g JOIN sys.tables t ON t.object_id = g.parent_id JOIN sys.sql_modules m ON m.object_id = g.object_id WHERE SCHEMA_NAME(t.schema_id) = {schema}""",
}


def literal(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def source_type(data_type: str, char_length: int | None = None, precision: int | None = None, scale: int | None = None) -> str:
    """A type name with its arguments, from the separate columns of a catalogue."""
    upper = data_type.upper()
    if "(" in upper:
        return upper
    if char_length is not None and "CHAR" in upper:
        return f"{upper}(MAX)" if char_length < 0 else f"{upper}({char_length})"
    if precision is not None and upper in ("NUMBER", "NUMERIC", "DECIMAL"):
        return f"{upper}({precision},{scale})" if scale else f"{upper}({precision})"
    return upper


def column_default(text: str | None, dialect: str) -> str | None:
    """Defaults that travel: numbers, the current time, nextval (PostgreSQL); Oracle's text is kept for the emitter."""
    if text is None:
        return None
    bare = text.strip()
    while dialect == "mssql" and bare.startswith("(") and bare.endswith(")"):
        bare = bare[1:-1].strip()
    if dialect == "oracle":
        return bare or None
    if re.fullmatch(r"[+-]?\d+(\.\d+)?", bare):
        return bare
    if re.fullmatch(r"(?i)current_timestamp(\(\d*\))?|now\(\)|getdate\(\)|sysdatetime\(\)", bare):
        return "CURRENT_TIMESTAMP"
    if dialect == "postgres" and (m := re.match(r"nextval\('([^']+)'", bare)):
        return f"nextval('{m[1]}')"
    return None


def select_text(dialect: str, table: str, columns: list[str], schema: str | None = None, predicate: str | None = None, snapshot: str | None = None) -> str:
    """The scan that is sent: an explicit column list, the range predicate, and the snapshot where there is one."""
    q = lambda x: quoted(x, dialect)
    name = f"{q(schema)}.{q(table)}" if schema and dialect != "postgres" else q(table)
    at = SNAPSHOT[dialect].format(snapshot) if snapshot and dialect in SNAPSHOT else ""
    return f"SELECT {', '.join(map(q, columns))} FROM {name}{at}" + (f" WHERE {predicate}" if predicate else "")


def joined_lines(rows: DataFrame) -> DataFrame:
    """Sources that a catalogue keeps line by line, put together in the lines' order; a database's own aggregate has a limit."""
    rows = rows.toDF(*[c.lower() for c in rows.columns])
    by = [c for c in rows.columns if c not in ("line", "body")]
    lines = F.array_sort(F.collect_list(F.struct(F.col("line").cast("bigint").alias("line"), "body")))
    return rows.groupBy(*by).agg(F.array_join(F.transform(lines, lambda x: x["body"]), "").alias("body"))


@dataclass
class JdbcSource:
    """A database; ``options`` go to Spark's JDBC reader (user, password, fetchsize, timeouts ...)."""

    spark: SparkSession
    dialect: str
    address: str
    schema: str | None = None
    options: dict[str, str] = field(default_factory=dict)

    @property
    def url(self) -> str:
        return self.address if self.address.startswith("jdbc:") else PREFIX[self.dialect] + self.address

    def session(self) -> dict[str, str]:
        """The reader's options, with how a session of the dialect begins."""
        own = {"sessionInitStatement": SESSION[self.dialect]} if self.dialect in SESSION else {}
        if self.dialect == "postgres" and self.schema:
            own["currentSchema"] = self.schema
        return own | self.options

    def query(self, sql: str) -> DataFrame:
        return self.spark.read.format("jdbc").option("url", self.url).option("query", sql).options(**self.session()).load()

    def ping(self) -> bool:
        """Whether the database answers at all: what tells an outage from a record that can't be applied."""
        try:
            return self.query(PING.get(self.dialect, "SELECT 1 AS one")).first() is not None
        except Exception:  # noqa: BLE001 - no answer is the answer
            return False

    def rows(self, table: str, columns: list[str], chunks: list[Chunk] | None = None, snapshot: str | None = None) -> DataFrame:
        """One partition per chunk, each with its own predicate."""
        source = f"({select_text(self.dialect, table, columns, self.schema, None, snapshot)}) src"
        if not chunks or chunks[0].key is None:
            return self.query(select_text(self.dialect, table, columns, self.schema, chunks[0].recorded if chunks else None, snapshot))
        q = quoted("x", self.dialect)[-1] if self.dialect in ("mysql", "mssql") else '"'
        return self.spark.read.jdbc(self.url, source, predicates=[c.predicate(q if q != "]" else '"') for c in chunks], properties=self.session())

    def count(self, table: str, snapshot: str | None = None) -> int:
        return int(self.query(select_text(self.dialect, table, [], self.schema, None, snapshot).replace("SELECT ", f"SELECT {COUNT[self.dialect]} AS n", 1)).first()[0])

    def bounds(self, table: str, key: str) -> tuple[int, int] | None:
        k = quoted(key, self.dialect)
        lo, hi = self.query(select_text(self.dialect, table, [], self.schema).replace("SELECT ", f"SELECT MIN({k}) AS lo, MAX({k}) AS hi", 1)).first()
        try:
            return None if lo is None else (int(lo // 1), int(hi // 1))
        except TypeError:
            return None

    def snapshot(self) -> str | None:
        """A moment to read every chunk at, where the dialect has one."""
        return str(self.query(CURRENT_SNAPSHOT[self.dialect]).first()[0]) if self.dialect in CURRENT_SNAPSHOT else None

    def catalogue(self, what: str) -> DataFrame:
        found = self.query(CATALOGUE[self.dialect][what].replace("{schema}", literal(self.schema or "")))
        return joined_lines(found) if "line" in {c.lower() for c in found.columns} else found

    def schemas(self) -> list[str]:
        own = {x.lower() for x in SYSTEM_SCHEMAS[self.dialect]}
        return [r[0] for r in self.query(CATALOGUE[self.dialect]["schemas"]).collect() if r[0].lower() not in own]

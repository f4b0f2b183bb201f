"""A schema from the rows of catalogue queries (they are metadata: small, and put together on the driver)."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable

from ..functions.types import parse_type
from ..plans.model import Check, Column, ForeignKey, Index, Routine, Schema, Sequence, Table, Trigger, View
from .jdbc import JdbcSource, column_default, source_type

Rows = Iterable[dict]


def _yes(value) -> bool:
    return str(value).upper() in ("YES", "Y", "TRUE", "1")


def _grouped(rows: Rows, *by: str) -> dict[tuple, list[dict]]:
    """Rows by some of their values, each group in the order of its positions."""
    out: dict = defaultdict(list)
    for r in sorted(rows, key=lambda r: r.get("ordinal_position") or 0):
        out[tuple(r[c] for c in by)].append(r)
    return out


def _column(r: dict, dialect: str) -> Column:
    spelt = source_type(r["data_type"], r.get("char_length"), r.get("numeric_precision"), r.get("numeric_scale"))
    return Column(r["column_name"], parse_type(spelt, dialect), _yes(r.get("is_nullable", "YES")), column_default(r.get("column_default"), dialect), spelt)


def _index(name: str, rows: list[dict]) -> Index:
    return Index(name, tuple(r["column_name"] for r in rows), _yes(rows[0].get("is_unique", 0)), rows[0].get("condition"), tuple(r["column_name"] for r in rows if _yes(r.get("is_expression", 0))))


def build_schema(
    name: str, dialect: str, columns: Rows, primary_keys: Rows = (), foreign_keys: Rows = (), views: Rows = (), sequences: Rows = (), indexes: Rows = (), checks: Rows = (),
    partitions: Rows = (), partition_children: Rows = (), routines: Rows = (), triggers: Rows = (), materialized_views: Rows = (),
) -> Schema:
    """What the catalogue says, as a schema.  Partitions that are tables of their own are left out: they are parts of
    their parent.  A check that only says that a column is not null is the column's own business."""
    children = {r["table_name"] for r in partition_children}
    keys, parts = _grouped(primary_keys, "table_name"), _grouped(partitions, "table_name")
    fks, found, tests = defaultdict(list), defaultdict(list), defaultdict(list)
    for (table, key, parent), rows in _grouped(foreign_keys, "table_name", "constraint_name", "parent_table").items():
        fks[table].append(ForeignKey(key, tuple(r["column_name"] for r in rows), parent, tuple(r["parent_column"] for r in rows)))
    for (table, index), rows in _grouped(indexes, "table_name", "index_name").items():
        found[table].append(_index(index, rows))
    for r in checks:
        if r.get("expression") and not r["expression"].upper().rstrip(") ").endswith("IS NOT NULL"):
            tests[r["table_name"]].append(Check(r["expression"], r.get("constraint_name")))
    tables = []
    for (table,), rows in _grouped(columns, "table_name").items():
        if table not in children:
            cut = parts.get((table,))
            partition = (str(cut[0]["strategy"]).upper(), tuple(r["column_name"] for r in cut)) if cut else None
            tables.append(Table(table, tuple(_column(r, dialect) for r in rows), name, tuple(r["column_name"] for r in keys.get((table,), ())), tuple(fks[table]), tuple(found[table]), tuple(tests[table]), partition))
    tables.sort(key=lambda t: t.name)
    seqs = [Sequence(r["sequence_name"], int(r["start_value"]), int(r["increment_by"]), r.get("min_value"), r.get("max_value"), int(r.get("cache_size") or 1), _yes(r.get("cycle_flag", "N"))) for r in sequences]
    seen = [View(r["view_name"], r["definition"]) for r in views] + [View(r["view_name"], r["definition"], True) for r in materialized_views]
    return Schema(
        name, tables, seen, seqs, [Routine(r["routine_name"], str(r["routine_kind"]).upper(), r.get("body") or "") for r in routines],
        [Trigger(r["trigger_name"], r["table_name"], r.get("timing") or "", tuple((r.get("events") or "").split(" OR ")), r.get("body") or "") for r in triggers],
    )


#: What is asked of a catalogue.
PARTS = ("columns", "primary_keys", "foreign_keys", "views", "sequences", "indexes", "checks", "partitions", "partition_children", "routines", "triggers", "materialized_views")


def introspect(source: JdbcSource) -> Schema:
    from .jdbc import CATALOGUE

    have = CATALOGUE[source.dialect]
    rows = lambda what: [{k.lower(): v for k, v in r.asDict().items()} for r in source.catalogue(what).collect()] if what in have else []
    return build_schema(source.schema or "", source.dialect, **{what: rows(what) for what in PARTS})

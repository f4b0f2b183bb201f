"""DDL text for the PostgreSQL family, MySQL, Oracle and Spark."""

from __future__ import annotations

import re
from collections.abc import Iterable

from ..functions.idents import ident, unique_names
from ..functions.types import Kind, TypeRegistry
from .gaps import Gap
from .model import Column, ForeignKey, Index, Schema, Sequence, Table, View
from .rewrite import ordered_views, portable_view

#: Spellings of now, of a new GUID, and of a boolean default; the largest MAXVALUE that is kept.
_NOW, _GUID = ("SYSDATE", "SYSTIMESTAMP", "CURRENT_TIMESTAMP"), ("SYS_GUID()", "SYS_GUID")
_TRUE, _FALSE = ("1", "TRUE", "T", "Y", "YES"), ("0", "FALSE", "F", "N", "NO")
_MOST = 10**27
_NEXTVAL = re.compile(r'(?:"?[\w$#]+"?\s*\.\s*)*?"?([\w$#]+)"?\s*\.\s*"?NEXTVAL"?', re.I)


def default_text(default: str, kind: Kind, preserve_case: bool = False, dialect: str = "postgres") -> str | None:
    """A column default in the dialect, or None where it can't be kept."""
    d = default.strip()
    upper = d.upper()
    if dialect == "oracle":
        return None if upper.startswith("NEXTVAL(") else default
    if upper in _NOW or dialect == "mysql" and upper == "NOW()":
        return "CURRENT_TIMESTAMP" if dialect != "mysql" or kind.sql("mysql").startswith(("DATETIME", "TIMESTAMP")) else None
    if dialect == "mysql":
        return d if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", d) else None
    if upper in _GUID:
        return "uuid()" if dialect == "spark" else "gen_random_uuid()"
    if m := _NEXTVAL.fullmatch(d):
        return None if dialect == "spark" else f"nextval('{ident(m[1], preserve_case)}')"
    if dialect == "spark" and upper.startswith("NEXTVAL("):
        return None
    if kind.kind == "boolean":
        bare = upper.strip("()").strip("'\"").lstrip("B").strip("'\"")
        return "true" if bare in _TRUE else "false" if bare in _FALSE else d
    return d


def _kind(table: Table, c: Column, registry: TypeRegistry | None) -> Kind:
    return registry.resolve(c.source_type, table.name, c.name, table.schema).kind if registry and c.source_type else c.kind


def create_table(table: Table, registry: TypeRegistry | None = None, preserve_case: bool = False, dialect: str = "postgres", location: str | None = None) -> str:
    """``location``: for Spark, a folder that has the table's rows, in folders of any depth."""
    name = lambda x: ident(x, preserve_case, dialect)
    pad = "    " if dialect == "postgres" else "  "
    lines = []
    for c in table.columns:
        kind = _kind(table, c, registry)
        spelt = (c.source_type or kind.sql()) if dialect == "oracle" else kind.sql(dialect)
        default = default_text(c.default, kind, preserve_case, dialect) if c.default is not None else None
        lines.append(f"{pad}{name(c.name)} {spelt}" + ("" if c.nullable else " NOT NULL") + (f" DEFAULT {default}" if default is not None else ""))
    if dialect == "spark":
        parts = table.partition[1] if table.partition and table.partition[0].upper() == "LIST" else ()
        if location is not None:
            quoted = location.replace("\\", "\\\\").replace("'", "\\'")
            return f"CREATE TABLE {name(table.name)} (\n" + ",\n".join(lines) + f"\n) USING parquet OPTIONS (recursiveFileLookup 'true') LOCATION '{quoted}'"
        return f"CREATE TABLE {name(table.name)} (\n" + ",\n".join(lines) + "\n) USING parquet" + (f" PARTITIONED BY ({', '.join(map(name, parts))})" if parts else "")
    if table.primary_key:
        lines.append(f"{pad}PRIMARY KEY ({', '.join(map(name, table.primary_key))})")
    for check in table.checks:
        lines.append(pad + (f"CONSTRAINT {name(check.name)} " if check.name else "") + f"CHECK ({check.expression})")
    return f"CREATE TABLE {name(table.name)} (\n" + ",\n".join(lines) + "\n)" + (";" if dialect == "postgres" else "")


def create_sequence(s: Sequence, preserve_case: bool = False, dialect: str = "postgres") -> str:
    parts = [f"CREATE SEQUENCE {ident(s.name, preserve_case, dialect)}", f"START WITH {s.start}", f"INCREMENT BY {s.increment}"]
    parts += [f"MINVALUE {s.least}"] if s.least is not None else []
    parts += [f"MAXVALUE {s.most}"] if s.most is not None and s.most < _MOST else []
    parts += [f"CACHE {s.cache}"] if s.cache > 1 and dialect != "oracle" else []
    return " ".join(parts + (["CYCLE"] if s.cycle else [])) + (";" if dialect == "postgres" else "")


def create_index(table: Table, index: Index, preserve_case: bool = False, dialect: str = "postgres", as_name: str | None = None) -> str | None:
    """None for the index that only backs the primary key."""
    if index.unique and index.columns == table.primary_key:
        return None
    name = lambda x: ident(x, preserve_case, dialect)
    part = lambda c: f"({c})" if c in index.expressions else name(c)
    where = f" WHERE {index.condition}" if index.condition and dialect == "postgres" else ""
    return f"CREATE {'UNIQUE ' if index.unique else ''}INDEX {name(as_name or index.name)} ON {name(table.name)} ({', '.join(map(part, index.columns))}){where}" + (";" if dialect == "postgres" else "")


def _key_name(table: Table, fk: ForeignKey, preserve_case: bool, dialect: str) -> str:
    if fk.name:
        return ident(fk.name, preserve_case, dialect)
    return f"{table.name.lower()}_fk" if dialect == "postgres" else ident(f"{table.name}_fk", preserve_case, dialect)


def foreign_keys(table: Table, preserve_case: bool = False, dialect: str = "postgres") -> list[str]:
    name = lambda x: ident(x, preserve_case, dialect)
    end = ";" if dialect == "postgres" else ""
    return [f"ALTER TABLE {name(table.name)} ADD CONSTRAINT {_key_name(table, fk, preserve_case, dialect)} FOREIGN KEY ({', '.join(map(name, fk.columns))}) REFERENCES {name(fk.parent)} ({', '.join(map(name, fk.parent_columns))}){end}" for fk in table.foreign_keys]


def drop_foreign_keys(table: Table, preserve_case: bool = False, dialect: str = "postgres") -> list[str]:
    drop = "DROP FOREIGN KEY {}" if dialect == "mysql" else "DROP CONSTRAINT IF EXISTS {};"
    return [f"ALTER TABLE {ident(table.name, preserve_case, dialect)} " + drop.format(_key_name(table, fk, preserve_case, dialect)) for fk in table.foreign_keys]


def create_view(view: View, preserve_case: bool = False, dialect: str = "postgres") -> str:
    head = "CREATE OR REPLACE VIEW" if dialect == "spark" else "CREATE VIEW"
    return f"{head} {ident(view.name, preserve_case, dialect)} AS {view.definition.rstrip(';')}" + ("" if dialect == "spark" else ";")


def view_names(schema: Schema) -> list[str]:
    """The views that can be made from their text, each after those it names."""
    return ordered_views([(v.name, v.definition) for v in schema.views if not v.materialized])


def _parts(schema: Schema, registry: TypeRegistry | None, preserve_case: bool, dialect: str, accepts: dict[str, bool] | None) -> tuple[dict[str, list[str]], list[Gap]]:
    """The statements by kind, views after those they name; and the gaps."""
    out: dict[str, list[str]] = {k: [] for k in ("tables", "sequences", "indexes", "views", "foreign_keys")}
    out["tables"] = [create_table(t, registry, preserve_case, dialect) for t in schema.tables]
    gaps: list[Gap] = []
    if dialect != "spark":
        out["sequences"] = [create_sequence(s, preserve_case, dialect) for s in schema.sequences]
        pairs = [(t, i) for t in schema.tables for i in t.indexes]
        made = (create_index(t, i, preserve_case, dialect, name) for (t, i), name in zip(pairs, unique_names([(t.name, i.name) for t, i in pairs])))
        out["indexes"] = [x for x in made if x]
        out["foreign_keys"] = [x for t in schema.tables for x in foreign_keys(t, preserve_case, dialect)]
    booleans = {c.name for t in schema.tables for c in t.columns if _kind(t, c, registry).kind == "boolean"}
    plain = {v.name: v for v in schema.views if not v.materialized}
    for name in view_names(schema):
        body, found = portable_view(plain[name].definition, dialect, accepts, booleans)
        gaps += found
        out["views"].append(create_view(View(name, body), preserve_case, dialect))
    return out, gaps + custom_types(schema.tables, registry)


def export(schema: Schema, registry: TypeRegistry | None = None, preserve_case: bool = False, dialect: str = "postgres", accepts: dict[str, bool] | None = None) -> tuple[str, list[Gap]]:
    """The whole schema's DDL: tables, sequences, indexes, views after those they name, foreign keys; and the gaps."""
    parts, gaps = _parts(schema, registry, preserve_case, dialect, accepts)
    return "\n\n".join(x for own in parts.values() for x in own) + "\n", gaps


def drops(schema: Schema, preserve_case: bool = False, dialect: str = "postgres") -> list[str]:
    """Statements that remove what a schema would create, dependents first."""
    name = lambda x: ident(x, preserve_case, dialect)
    end = "" if dialect == "spark" else ";"
    out = [f"DROP VIEW IF EXISTS {name(v)}{end}" for v in reversed(view_names(schema))]
    out += [f"DROP TABLE IF EXISTS {name(t.name)}{' CASCADE' if dialect == 'postgres' else ''}{end}" for t in reversed(schema.tables)]
    return out + [f"DROP SEQUENCE IF EXISTS {name(s.name)}{end}" for s in schema.sequences if dialect != "spark"]


def scripts(schema: Schema, registry: TypeRegistry | None = None, preserve_case: bool = False, dialect: str = "postgres", accepts: dict[str, bool] | None = None) -> tuple[list[str], list[str], list[Gap]]:
    """What runs before the rows are loaded (drops, sequences, tables) and after (indexes, foreign keys, views); the gaps."""
    parts, gaps = _parts(schema, registry, preserve_case, dialect, accepts)
    return drops(schema, preserve_case, dialect) + parts["sequences"] + parts["tables"], parts["indexes"] + parts["foreign_keys"] + parts["views"], gaps


def custom_types(tables: Iterable[Table], registry: TypeRegistry | None = None) -> list[Gap]:
    """A gap for each column whose type no rule knows."""
    return [Gap("unmapped type", f"choose a type for {c.source_type or c.kind.custom}", object_ref=f"{t.name}.{c.name}") for t in tables for c in t.columns if _kind(t, c, registry).kind == "custom"]

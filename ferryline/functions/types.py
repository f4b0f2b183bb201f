"""Neutral column types, the source dialects' spellings of them, and their spelling in targets and in Spark."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import types as T

#: The kinds of type and their plain DDL names; those that take arguments are spelt in sql().
PLAIN = {
    "smallint": "SMALLINT", "integer": "INTEGER", "bigint": "BIGINT", "serial": "SERIAL", "bigserial": "BIGSERIAL",
    "real": "REAL", "double": "DOUBLE PRECISION", "text": "TEXT", "bytea": "BYTEA", "date": "DATE", "time": "TIME",
    "timestamp": "TIMESTAMP", "timestamptz": "TIMESTAMP WITH TIME ZONE", "interval": "INTERVAL", "boolean": "BOOLEAN",
    "json": "JSON", "jsonb": "JSONB", "uuid": "UUID",
}
KINDS = (*PLAIN, "decimal", "numeric", "char", "varchar", "array", "custom")


@dataclass(frozen=True)
class Kind:
    """A column type: a kind, and for some kinds a precision and scale, a length, an element or a verbatim name."""

    kind: str
    precision: int | None = None
    scale: int | None = None
    length: int | None = None
    element: Kind | None = None
    custom: str | None = None

    def sql(self, dialect: str = "postgres") -> str:
        return {"postgres": _postgres, "mysql": _mysql, "spark": lambda k: _spark(k).simpleString().upper()}[dialect](self)

    def spark(self) -> T.DataType:
        return _spark(self)

    def metadata(self, source_type: str | None = None) -> dict:
        """What Spark's own types can't say, for a field's metadata."""
        out = {"kind": self.kind} | ({"source_type": source_type} if source_type else {})
        return out | ({"custom": self.custom} if self.custom else {})


def _postgres(k: Kind) -> str:
    if k.kind in PLAIN:
        return PLAIN[k.kind]
    if k.kind in ("decimal", "numeric"):
        return k.kind.upper() if k.precision is None else f"{k.kind.upper()}({k.precision}, {k.scale or 0})"
    if k.kind in ("char", "varchar"):
        return f"{k.kind.upper()}({k.length if k.length is not None else 1 if k.kind == 'char' else 255})"
    if k.kind == "array":
        return f"{_postgres(k.element) if k.element else 'TEXT'}[]"
    return k.custom or "TEXT"


#: MySQL names of the plain kinds, the largest precision and scale, and the longest VARCHAR.
_MYSQL = {
    "smallint": "SMALLINT", "integer": "INT", "bigint": "BIGINT", "serial": "INT", "bigserial": "BIGINT", "real": "FLOAT", "double": "DOUBLE",
    "text": "LONGTEXT", "bytea": "LONGBLOB", "date": "DATE", "time": "TIME", "timestamp": "DATETIME", "timestamptz": "TIMESTAMP",
    "boolean": "TINYINT(1)", "interval": "VARCHAR(64)", "uuid": "CHAR(36)", "json": "JSON", "jsonb": "JSON", "array": "JSON", "custom": "LONGTEXT",
}
_MYSQL_DIGITS, _MYSQL_SCALE, _MYSQL_CHARS = 65, 30, 16383


def _mysql(k: Kind) -> str:
    if k.kind in ("decimal", "numeric"):
        p = _MYSQL_DIGITS if k.precision is None else min(k.precision, _MYSQL_DIGITS)
        s = _MYSQL_SCALE if k.precision is None else min(k.scale or 0, _MYSQL_SCALE, p)
        return f"DECIMAL({p}, {s})"
    if k.kind == "char":
        return f"CHAR({k.length or 1})"
    if k.kind == "varchar":
        return "LONGTEXT" if k.length is None or k.length > _MYSQL_CHARS else f"VARCHAR({k.length})"
    return _MYSQL[k.kind]


_SPARK = {
    "smallint": T.ShortType(), "integer": T.IntegerType(), "serial": T.IntegerType(), "bigint": T.LongType(), "bigserial": T.LongType(),
    "real": T.FloatType(), "double": T.DoubleType(), "bytea": T.BinaryType(), "date": T.DateType(),
    "timestamp": T.TimestampNTZType(), "timestamptz": T.TimestampType(), "boolean": T.BooleanType(),
}


def _spark(k: Kind) -> T.DataType:
    """Exact where Spark has the type; other kinds are text.  An unconstrained number is decimal(38,18), never decimal."""
    if k.kind in ("decimal", "numeric"):
        if k.precision is None:
            return T.DecimalType(38, 18)
        return T.DecimalType(k.precision, k.scale or 0) if k.precision <= 38 and (k.scale or 0) <= k.precision else T.StringType()
    if k.kind == "array":
        return T.ArrayType(_spark(k.element) if k.element else T.StringType())
    return _SPARK.get(k.kind, T.StringType())


# ---- source dialects ------------------------------------------------------------------------

_ARGS = re.compile(r"\(([^)]*)\)")
Build = str | Callable[[str, list[str]], Kind]


def _sized(kind: str, default: int | None) -> Build:
    def build(_: str, args: list[str]) -> Kind:
        return Kind(kind, length=int(args[0]) if args and args[0].isdigit() else default)

    return build


def _number(kind: str, bare_is_open: bool = False) -> Build:
    def build(_: str, args: list[str]) -> Kind:
        if not args and bare_is_open:
            return Kind("numeric")
        digits = [int(a) for a in args if re.fullmatch(r"-?\d+", a)]
        if not digits or len(digits) != len(args) or len(digits) > 2:
            return Kind(kind, 38, 0)
        return Kind(kind, digits[0], digits[1] if len(digits) == 2 else 0)

    return build


@dataclass(frozen=True)
class Rule:
    """Names, whole or as a beginning, that a type builder holds for."""

    names: tuple[str, ...]
    build: Build
    prefix: bool = False


def _is(names: str, build: Build) -> Rule:
    return Rule(tuple(names.split("|")), build)


def _starts(names: str, build: Build) -> Rule:
    return Rule(tuple(names.split("|")), build, True)


#: How each source dialect's type names map, first rule that holds; the order counts.
RULES: dict[str, tuple[Rule, ...]] = {
    "oracle": (
        _starts("NUMBER|DECIMAL", _number("decimal", True)),
        _starts("VARCHAR2|NVARCHAR2|VARCHAR", _sized("varchar", 255)),
        _starts("NCHAR|CHAR", _sized("char", 1)),
        _starts("FLOAT", "real"), _is("BINARY_FLOAT", "real"), _is("BINARY_DOUBLE", "double"),
        _is("INTEGER|INT", "integer"), _is("SMALLINT", "smallint"), _is("CLOB|NCLOB|LONG", "text"),
        _is("BLOB|LONG RAW", "bytea"), _starts("RAW", "bytea"), _starts("INTERVAL", "interval"),
        _starts("TIMESTAMP", lambda u, _: Kind("timestamptz" if "TIME ZONE" in u else "timestamp")),
        _is("DATE", "timestamp"), _is("ROWID|UROWID|XMLTYPE", "text"),
    ),
    "mysql": (
        _is("TINYINT(1)|BOOLEAN|BOOL", "boolean"), _starts("DECIMAL|NUMERIC", _number("numeric")),
        _starts("VARCHAR", _sized("varchar", 255)), _starts("CHAR", _sized("char", 1)),
        _is("TINYINT|SMALLINT|YEAR", "smallint"), _is("MEDIUMINT|INT|INTEGER", "integer"), _is("BIGINT", "bigint"),
        _is("FLOAT", "real"), _is("DOUBLE|DOUBLE PRECISION|REAL", "double"), _is("TEXT|TINYTEXT|MEDIUMTEXT|LONGTEXT", "text"),
        _is("BLOB|TINYBLOB|MEDIUMBLOB|LONGBLOB|BINARY|VARBINARY", "bytea"), _is("DATE", "date"), _is("TIME", "time"),
        _is("DATETIME|TIMESTAMP", "timestamp"), _is("JSON", "jsonb"), _starts("ENUM|SET", "text"),
    ),
    "mssql": (
        _is("VARCHAR(MAX)|NVARCHAR(MAX)|TEXT|NTEXT", "text"), _starts("VARCHAR|NVARCHAR", _sized("varchar", 255)),
        _starts("NCHAR|CHAR", _sized("char", 1)), _starts("DECIMAL|NUMERIC", _number("numeric")),
        _is("MONEY|SMALLMONEY", lambda *_: Kind("decimal", 19, 4)), _is("TINYINT|SMALLINT", "smallint"), _is("INT|INTEGER", "integer"),
        _is("BIGINT", "bigint"), _is("REAL", "real"), _is("FLOAT", "double"), _is("BINARY|IMAGE", "bytea"), _starts("VARBINARY", "bytea"),
        _is("DATE", "date"), _is("TIME", "time"), _is("DATETIME|DATETIME2|SMALLDATETIME", "timestamp"), _is("DATETIMEOFFSET", "timestamptz"),
        _is("BIT", "boolean"), _is("UNIQUEIDENTIFIER", "uuid"), _is("XML", "text"),
    ),
    "postgres": (
        _starts("VARCHAR|CHARACTER VARYING", _sized("varchar", None)), _starts("CHAR", _sized("char", 1)),
        _starts("NUMERIC|DECIMAL", _number("numeric", True)),
        _is("SMALLINT|INT2", "smallint"), _is("INTEGER|INT|INT4", "integer"), _is("BIGINT|INT8", "bigint"), _is("REAL|FLOAT4", "real"),
        _is("DOUBLE PRECISION|FLOAT8", "double"), _is("TEXT", "text"), _is("BYTEA", "bytea"), _is("DATE", "date"), _is("BOOLEAN|BOOL", "boolean"),
        _is("JSON", "json"), _is("JSONB", "jsonb"), _is("UUID", "uuid"), _is("INTERVAL", "interval"), _is("TIMESTAMPTZ", "timestamptz"), _is("TIME", "time"),
        _starts("TIMESTAMP", lambda u, _: Kind("timestamptz" if "WITH TIME ZONE" in u else "timestamp")),
        _is("USER-DEFINED|ARRAY|TSVECTOR|TSQUERY|XML|CIDR|INET|MACADDR|MACADDR8|BIT|BIT VARYING|MONEY", "text"),
    ),
    "target": (
        _starts("VARCHAR", _sized("varchar", 255)), _starts("CHAR", _sized("char", 1)), _starts("NUMERIC", _number("numeric")), _starts("DECIMAL", _number("decimal")),
        *(_is(name, kind) for kind, name in PLAIN.items() if kind != "timestamptz"), _is("INT", "integer"), _is("TIMESTAMPTZ", "timestamptz"),
    ),
}


@lru_cache(4096)
def parse_type(source_type: str, dialect: str, strict: bool = False) -> Kind:
    """The neutral type of a dialect's type name.

    Unless ``strict``, a name that no rule knows is tried again without its arguments, and an unsigned BIGINT is
    numeric(20,0), since a signed one can't hold it.  What is still unknown is kept verbatim as custom.
    """
    upper = " ".join(source_type.upper().split())
    if not strict and "UNSIGNED" in upper:
        upper = upper.replace(" UNSIGNED", "")
        if upper.startswith("BIGINT"):
            return Kind("numeric", 20, 0)
    bare = " ".join(_ARGS.sub("", upper).split())
    for name in (upper,) if strict or bare == upper else (upper, bare):
        args = [x.strip() for x in m[1].split(",")] if (m := _ARGS.search(upper)) and m[1].strip() else []
        for rule in RULES[dialect]:
            if name in rule.names or rule.prefix and name.startswith(rule.names):
                return Kind(rule.build) if isinstance(rule.build, str) else rule.build(upper, args)
    return Kind("custom", custom=source_type)


@dataclass(frozen=True)
class Resolved:
    kind: Kind
    provenance: str
    source_type: str


class TypeRegistry:
    """A dialect's types with overrides: by column first, then by source type (as spelt, then without arguments)."""

    def __init__(self, dialect: str, by_type: dict[str, str] | None = None, by_column: dict[str, str] | None = None):
        self.dialect = dialect
        self.by_type = {k.upper().strip(): v for k, v in (by_type or {}).items()}
        self.by_column = {k.lower().strip(): v for k, v in (by_column or {}).items()}

    def resolve(self, source_type: str, table: str | None = None, column: str | None = None, schema: str | None = None) -> Resolved:
        if table and column:
            short = f"{table}.{column}".lower()
            for key in ([f"{schema.lower()}.{short}"] if schema else []) + [short]:
                if key in self.by_column:
                    return Resolved(parse_type(self.by_column[key], "target"), "modify_type_override", source_type)
        upper = source_type.upper().strip()
        for key in (upper, upper.split("(")[0].strip()):
            if key in self.by_type:
                return Resolved(parse_type(self.by_type[key], "target"), "data_type_override", source_type)
        return Resolved(parse_type(source_type, self.dialect), "default", source_type)

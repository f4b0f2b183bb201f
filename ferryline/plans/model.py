"""A schema as data: what introspection finds, DDL and assessment read, and loads need of a table."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

from ..functions.types import Kind, TypeRegistry


@dataclass(frozen=True)
class Column:
    name: str
    kind: Kind
    nullable: bool = True
    default: str | None = None
    source_type: str | None = None


@dataclass(frozen=True)
class ForeignKey:
    name: str | None
    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]


@dataclass(frozen=True)
class Index:
    name: str
    columns: tuple[str, ...]
    unique: bool = False
    condition: str | None = None
    #: Which of the columns are expressions.
    expressions: tuple[str, ...] = ()


@dataclass(frozen=True)
class Check:
    expression: str
    name: str | None = None


@dataclass(frozen=True)
class Table:
    name: str
    columns: tuple[Column, ...]
    schema: str | None = None
    primary_key: tuple[str, ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()
    indexes: tuple[Index, ...] = ()
    checks: tuple[Check, ...] = ()
    partition: tuple[str, tuple[str, ...]] | None = None

    @property
    def full_name(self) -> str:
        return f"{self.schema}.{self.name}" if self.schema else self.name

    def struct(self, registry: TypeRegistry | None = None) -> T.StructType:
        """The table's Spark schema; fields carry the kind, the source's type and its default as metadata."""
        fields = []
        for c in self.columns:
            kind = registry.resolve(c.source_type, self.name, c.name, self.schema).kind if registry and c.source_type else c.kind
            fields.append(T.StructField(c.name, kind.spark(), c.nullable, kind.metadata(c.source_type) | ({"default": c.default} if c.default else {})))
        return T.StructType(fields)


@dataclass(frozen=True)
class Sequence:
    name: str
    start: int = 1
    increment: int = 1
    least: int | None = None
    most: int | None = None
    cache: int = 1
    cycle: bool = False


@dataclass(frozen=True)
class View:
    name: str
    definition: str
    materialized: bool = False


@dataclass(frozen=True)
class Routine:
    name: str
    kind: str
    body: str = ""


@dataclass(frozen=True)
class Trigger:
    name: str
    table: str
    timing: str = ""
    events: tuple[str, ...] = ()
    body: str = ""


@dataclass
class Schema:
    name: str
    tables: list[Table] = field(default_factory=list)
    views: list[View] = field(default_factory=list)
    sequences: list[Sequence] = field(default_factory=list)
    routines: list[Routine] = field(default_factory=list)
    triggers: list[Trigger] = field(default_factory=list)

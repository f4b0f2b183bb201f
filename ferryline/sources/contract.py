"""What the engine asks of a source, whatever it is; ParquetSource and JdbcSource answer to it."""

from __future__ import annotations

from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame


@runtime_checkable
class Source(Protocol):
    """Rows of named tables, and what is known of them.

    rows: the named columns of a table, lazily; what a snapshot pins stays the same however often it is read.
    count: its exact number of rows, at a snapshot if one is given.
    bounds: the least and greatest value of a numeric key, rounded down; None for an empty table or another kind of key.
    snapshot: what pins a read, a moment or a list of files; None where the source has no such.
    ping: whether it answers at all; never raises.
    """

    def rows(self, table: str, columns: list[str], *more, **options) -> DataFrame: ...

    def count(self, table: str, snapshot=None) -> int: ...

    def bounds(self, table: str, key: str) -> tuple[int, int] | None: ...

    def snapshot(self, *table): ...

    def ping(self) -> bool: ...

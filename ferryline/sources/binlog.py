"""Row changes from recorded MySQL binary logs: a table of a folder's numbered files, a partition for each.

A transaction never goes on in the next file, so files are read independently.  A task first walks the headers of its file,
to know where each transaction ends and with which XID, then reads the events and gives their rows.  Column names, full row
images and keys have to be in the log (binlog_row_metadata and binlog_row_image FULL); what is missing raises, and so does a
type that is not read: nothing is guessed.
"""

from __future__ import annotations

import base64
import json
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Fixed values of the format: event types, column types, optional metadata, and the collation of binary columns.
MAGIC = b"\xfebin"
QUERY, FORMAT, XID, TABLE_MAP, WRITE, UPDATE, DELETE = 2, 15, 16, 19, 30, 31, 32
TINY, SHORT, LONG, FLOAT, DOUBLE, LONGLONG, INT24, DATE, YEAR, VARCHAR, BIT, TIMESTAMP2, DATETIME2, TIME2, NEWDECIMAL, ENUM, SET, BLOB, STRING = 1, 2, 3, 4, 5, 8, 9, 10, 13, 15, 16, 17, 18, 19, 246, 247, 248, 252, 254
SIGNEDNESS, DEFAULT_CHARSET, COLUMN_CHARSET, COLUMN_NAME, SIMPLE_PRIMARY_KEY = 1, 2, 3, 4, 8
BINARY = 63
_HEAD = struct.Struct("<IBIIIH")
_FILE = re.compile(r"\.(\d+)$")
#: Rows of a file in the order of the whole log, and rows to an Arrow batch.
ROWS, BATCH_ROWS = 1 << 40, 8192


class UnreadableLog(ValueError):
    """An event that lacks what is needed to tell its rows, or is of a kind that isn't read."""


class Bytes:
    """A cursor over an event's body."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        self.at += n
        if self.at > len(self.data):
            raise UnreadableLog("an event is shorter than it says")
        return self.data[self.at - n : self.at]

    def small(self, n: int, order: str = "little", signed: bool = False) -> int:
        return int.from_bytes(self.take(n), order, signed=signed)

    def packed(self) -> int:
        """A length-encoded number."""
        first = self.small(1)
        return first if first < 251 else self.small({252: 2, 253: 3, 254: 8}[first])

    def bits(self, n: int) -> list[bool]:
        data = self.take((n + 7) // 8)
        return [bool(data[i // 8] >> (i % 8) & 1) for i in range(n)]

    def left(self) -> int:
        return len(self.data) - self.at


@dataclass
class TableMap:
    """A table as a log describes it: names, types, what belongs to them, and its key."""

    schema: str
    name: str
    types: list[int]
    meta: list[int]
    names: list[str] = field(default_factory=list)
    unsigned: list[bool] = field(default_factory=list)
    collations: list[int] = field(default_factory=list)
    key: list[str] = field(default_factory=list)

    @classmethod
    def read(cls, body: Bytes) -> TableMap:
        body.take(2)
        schema = body.take(body.small(1)).decode()
        body.take(1)
        name = body.take(body.small(1)).decode()
        body.take(1)
        types = list(body.take(n := body.packed()))
        metas = Bytes(body.take(body.packed()))
        meta = [metas.small({FLOAT: 1, DOUBLE: 1, BLOB: 1, TIMESTAMP2: 1, DATETIME2: 1, TIME2: 1, VARCHAR: 2, BIT: 2}[t]) if t in (FLOAT, DOUBLE, BLOB, TIMESTAMP2, DATETIME2, TIME2, VARCHAR, BIT) else metas.small(2, "big") if t in (NEWDECIMAL, STRING) else 0 for t in types]
        body.take((n + 7) // 8)
        out, found = cls(schema, name, types, meta), {}
        while body.left():
            kind = body.small(1)
            found[kind] = Bytes(body.take(body.packed()))
        out._describe(found)
        return out

    def _describe(self, found: dict[int, Bytes]) -> None:
        numeric = [i for i, t in enumerate(self.types) if t in (TINY, SHORT, INT24, LONG, LONGLONG, FLOAT, DOUBLE, NEWDECIMAL, YEAR)]
        self.unsigned, self.collations = [False] * len(self.types), [0] * len(self.types)
        if SIGNEDNESS in found:
            data = found[SIGNEDNESS].take((len(numeric) + 7) // 8)  # from the highest bit down
            for k, i in enumerate(numeric):
                self.unsigned[i] = bool(data[k // 8] >> (7 - k % 8) & 1)
        text = [i for i, t in enumerate(self.types) if t in (VARCHAR, BLOB) or (t == STRING and self.meta[i] >> 8 not in (ENUM, SET))]
        if DEFAULT_CHARSET in found:
            x = found[DEFAULT_CHARSET]
            default, other = x.packed(), {}
            while x.left():
                at = x.packed()
                other[at] = x.packed()
            for k, i in enumerate(text):
                self.collations[i] = other.get(k, default)
        elif COLUMN_CHARSET in found:
            for i in text:
                self.collations[i] = found[COLUMN_CHARSET].packed()
        if (x := found.get(COLUMN_NAME)) is not None:
            while x.left():
                self.names.append(x.take(x.packed()).decode())
        if (x := found.get(SIMPLE_PRIMARY_KEY)) is not None and self.names:
            while x.left():
                self.key.append(self.names[x.packed()])

    def row(self, body: Bytes, present: list[bool]) -> dict[str, str | None]:
        """One row image as text by column."""
        if len(self.names) != len(self.types):
            raise UnreadableLog(f"{self.schema}.{self.name} has no column names: set binlog_row_metadata=FULL")
        if not all(present):
            gone = [n for n, p in zip(self.names, present) if not p]
            raise UnreadableLog(f"{self.schema}.{self.name} lacks {gone} in a row image: set binlog_row_image=FULL")
        nulls = body.bits(len(self.types))
        return {n: None if nulls[i] else self._value(body, i) for i, n in enumerate(self.names)}

    def _value(self, b: Bytes, i: int) -> str:
        t, meta = self.types[i], self.meta[i]
        if (size := {TINY: 1, SHORT: 2, INT24: 3, LONG: 4, LONGLONG: 8}.get(t)) is not None:
            return str(b.small(size, signed=not self.unsigned[i]))
        if t in (FLOAT, DOUBLE):
            return repr(struct.unpack("<f" if t == FLOAT else "<d", b.take(4 if t == FLOAT else 8))[0])
        if t == NEWDECIMAL:
            return _decimal(b, meta >> 8, meta & 0xFF)
        if t == VARCHAR:
            return self._text(b.take(b.small(1 if meta < 256 else 2)), i)
        if t == STRING:
            kind, most = meta >> 8, meta & 0xFF
            if kind & 0x30 != 0x30:  # two bits of the length are kept in the type
                kind, most = kind | 0x30, most | ((kind & 0x30) ^ 0x30) << 4
            if kind != STRING:
                raise UnreadableLog(f"{self.schema}.{self.name}.{self.names[i]} is of a type that is not read ({kind})")
            return self._text(b.take(b.small(1 if most < 256 else 2)), i)
        if t == BLOB:
            return self._text(b.take(b.small(meta)), i)
        if t == BIT:
            return str(b.small((meta >> 8) + (meta & 0xFF > 0), "big"))
        if t == YEAR:
            return str(y + 1900 if (y := b.small(1)) else 0)
        if t == DATE:
            d = b.small(3)
            return f"{d >> 9:04d}-{d >> 5 & 15:02d}-{d & 31:02d}"
        if t == DATETIME2:
            v = b.small(5, "big") - (1 << 39)
            days, clock = v >> 17, v & 0x1FFFF
            month = days >> 5
            return f"{month // 13:04d}-{month % 13:02d}-{days & 31:02d} {clock >> 12:02d}:{clock >> 6 & 63:02d}:{clock & 63:02d}{_part(b, meta)}"
        if t == TIMESTAMP2:
            return datetime.fromtimestamp(b.small(4, "big"), timezone.utc).strftime("%Y-%m-%d %H:%M:%S") + _part(b, meta)
        if t == TIME2:
            size = 3 + (meta + 1) // 2
            v = b.small(size, "big") - (1 << 8 * size - 1)
            sign, v, low = "-" if v < 0 else "", abs(v), 8 * (size - 3)
            clock = v >> low
            part = f".{v & (1 << low) - 1:0{2 * (size - 3)}d}"[: meta + 1] if meta else ""
            return f"{sign}{clock >> 12 & 0x3FF:02d}:{clock >> 6 & 63:02d}:{clock & 63:02d}{part}"
        raise UnreadableLog(f"{self.schema}.{self.name}.{self.names[i]} is of a type that is not read ({t})")

    def _text(self, data: bytes, i: int) -> str:
        return base64.b64encode(data).decode() if self.collations[i] == BINARY else data.decode()


def _part(b: Bytes, digits: int) -> str:
    """Fractions of a second, two digits to a byte."""
    size = (digits + 1) // 2
    return f".{b.small(size, 'big'):0{2 * size}d}"[: digits + 1] if digits else ""


#: Bytes that hold so many left-over decimal digits.
_DIGIT_BYTES = (0, 1, 1, 2, 2, 3, 3, 4, 4, 4)


def _decimal(b: Bytes, precision: int, scale: int) -> str:
    """A packed decimal: groups of nine digits in four bytes, the first byte's high bit set unless it is negative."""
    whole = precision - scale
    size = whole // 9 * 4 + _DIGIT_BYTES[whole % 9] + scale // 9 * 4 + _DIGIT_BYTES[scale % 9]
    data = bytearray(b.take(size))
    negative = not data[0] & 0x80
    data[0] ^= 0x80
    x = Bytes(bytes(c ^ 0xFF for c in data) if negative else bytes(data))
    group = lambda n: f"{x.small(_DIGIT_BYTES[n], 'big'):0{n}d}" if n else ""
    before = group(whole % 9) + "".join(group(9) for _ in range(whole // 9))
    after = "".join(group(9) for _ in range(scale // 9)) + group(scale % 9)
    return ("-" if negative else "") + (before.lstrip("0") or "0") + (f".{after}" if after else "")


# ---- files ---------------------------------------------------------------------------------


class LogFiles:
    """The numbered files of a folder."""

    def __init__(self, path: str):
        self.files, self.root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)

    def listed(self) -> list[tuple[int, str]]:
        """(number, path) in order; a number that two files have raises."""
        found = self.files.get_file_info(fs.FileSelector(self.root, allow_not_found=True))
        out = sorted((int(m[1]), x.path) for x in found if x.type == fs.FileType.File and (m := _FILE.search(x.path)))
        if len({n for n, _ in out}) < len(out):
            raise UnreadableLog(f"{self.root} has files of one number: positions can't be told apart")
        return out


def _events(f, bodies) -> Iterator[tuple[int, int, int, bytes | None]]:
    """(type, start, end, body) of a file's events, the body only of types in ``bodies``; a last one that was cut off ends it."""
    size, checked = f.size(), 0
    f.seek(0)
    if f.read(4) != MAGIC:
        raise UnreadableLog("not a binary log")
    at = 4
    while at + 19 <= size:
        f.seek(at)
        head = f.read(19)
        _, kind, _, length, _, _ = _HEAD.unpack(head)
        if length < 19:
            raise UnreadableLog(f"an event at {at} has no length")
        if at + length > size:
            return
        body = f.read(length - 19) if kind in bodies or kind == FORMAT else None
        if kind == FORMAT:
            checked = 4 if body[-5] == 1 else 0
        if body is not None and (checked or kind == FORMAT):
            if checked and kind != FORMAT and zlib.crc32(head + body[:-4]) != struct.unpack("<I", body[-4:])[0]:
                raise UnreadableLog(f"the event at {at} fails its checksum")
            body = body[: -checked or None]
        yield kind, at, at + length, body
        at += length


def _commits(f) -> tuple[dict[int, tuple[int | None, bool]], int]:
    """For each event with rows its transaction's XID and whether it is the last with rows; and the end of the last
    transaction.  By headers, and the few bytes of commits, alone."""
    out, own, end = {}, [], 4
    for kind, start, stop, body in _events(f, (XID, QUERY)):
        if kind in (WRITE, UPDATE, DELETE):
            own.append(start)
        elif kind == XID or (kind == QUERY and body.endswith(b"COMMIT")):
            xid = struct.unpack_from("<Q", body)[0] if kind == XID else None
            out |= {at: (xid, at == own[-1] and xid is not None) for at in own}
            own, end = [], stop
    out |= {at: (None, False) for at in own}
    return out, end


_COLUMNS = "ord bigint, op string, table_name string, key map<string,string>, after map<string,string>, before_key map<string,string>, base decimal(20,0), seq bigint, txn_id bigint, txn_end boolean"
_MAP = pa.map_(pa.string(), pa.string())
_ARROW = pa.schema([("ord", pa.int64()), ("op", pa.string()), ("table_name", pa.string()), ("key", _MAP), ("after", _MAP), ("before_key", _MAP), ("base", pa.decimal128(20, 0)), ("seq", pa.int64()), ("txn_id", pa.int64()), ("txn_end", pa.bool_())])


@dataclass
class _Part(InputPartition):
    number: int
    path: str
    last: bool
    after: int


class _LogReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.keys = options["path"], json.loads(options.get("keys", "{}"))
        self.file, self.position = int(options.get("file", -1)), int(options.get("position", 0))

    def partitions(self) -> list[InputPartition]:
        found = [x for x in LogFiles(self.path).listed() if x[0] >= self.file]
        parts = [_Part(n, p, (n, p) == found[-1], self.position if n == self.file else 0) for n, p in found]
        return parts or [_Part(-1, "", True, 0)]

    def read(self, part: InputPartition) -> Iterator[pa.RecordBatch]:
        """The rows of one file past the position; of the last file those of finished transactions."""
        from decimal import Decimal

        if part.number < 0:
            return
        with LogFiles(self.path).files.open_input_file(part.path) as f:
            txns, finished = _commits(f)
            maps: dict[int, TableMap] = {}
            rows: list[tuple] = []
            n = 0
            for kind, start, stop, body in _events(f, (TABLE_MAP, WRITE, UPDATE, DELETE)):
                if kind == TABLE_MAP:
                    at = Bytes(body)
                    number = at.small(6)
                    maps[number] = TableMap.read(at)
                if kind not in (WRITE, UPDATE, DELETE) or stop <= part.after or (part.last and start >= finished):
                    continue
                xid, last = txns[start]
                changes = list(self._changes(kind, Bytes(body), maps))
                for i, change in enumerate(changes):
                    rows.append((part.number * ROWS + n, *change, Decimal((part.number << 48) | stop), i, xid, last and i == len(changes) - 1))
                    n += 1
                if len(rows) >= BATCH_ROWS:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    def _changes(self, kind: int, body: Bytes, maps: dict[int, TableMap]) -> Iterator[tuple]:
        """(op, table, key, after, before_key) for each row of an event; none for tables without a key."""
        table = maps[body.small(6)]
        body.take(2)
        body.take(body.small(2) - 2)
        width = body.packed()
        key = self.keys.get(table.name) or ([] if self.keys else table.key)
        present = [body.bits(width) for _ in range(1 + (kind == UPDATE))]
        if not key:
            return
        while body.left():
            old = table.row(body, present[0])
            new = table.row(body, present[1]) if kind == UPDATE else old
            gone = [k for k in key if k not in new]
            if gone:
                raise UnreadableLog(f"{table.schema}.{table.name} has no key column {gone}")
            now, before = ({k: x[k] for k in key} for x in (new, old))
            yield {WRITE: "I", UPDATE: "U", DELETE: "D"}[kind], table.name, now, {} if kind == DELETE else new, before if before != now else {}


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    pairs = lambda c, i: [list(x.items()) for x in c] if i in (3, 4, 5) else list(c)
    return pa.RecordBatch.from_arrays([pa.array(pairs(c, i), f.type) for i, (c, f) in enumerate(zip(zip(*rows), _ARROW))], schema=_ARROW)


class BinlogSource(DataSource):
    """spark.read.format("ferryline_binlog") with path, keys (JSON, key columns by table), file and position to go on from."""

    @classmethod
    def name(cls) -> str:
        return "ferryline_binlog"

    def schema(self) -> str:
        return _COLUMNS

    def reader(self, schema) -> DataSourceReader:
        return _LogReader(self.options)

"""Changes from the text that logical decoding prints.

A line is ``BEGIN xid``, ``COMMIT ...`` or ``table schema.name: OP: column[type]:value ...``; the lines of a
stream carry their position and order.  Lines are parsed in Arrow batches; which transaction a change belongs to
and which is its last comes from the order of the lines, in Spark.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone
from decimal import Decimal, InvalidOperation
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..operators.graph import cut
from ..operators.ordered import SEGMENT, between, ordinal_within, segmented

_LINE = re.compile(r"table (.+?): (INSERT|UPDATE|DELETE): ?(.*)", re.S)
_NAME = re.compile(r'"((?:[^"]|"")*)"|([^."]+)')
_FIELD = re.compile(r"""\s*(?:"((?:[^"]|"")*)"|([^\s\["][^\["]*))\[((?:[^\[\]]|\[[^\]]*\])*)\]:(?:'((?:[^']|'')*)'|(\S*))""", re.S)
_LSN = re.compile(r"([0-9A-Fa-f]{1,8})/([0-9A-Fa-f]{1,8})")
#: Fixed value: how an unchanged out-of-line value is printed; the column is then not in the image.
UNCHANGED = "unchanged-toast-datum"
#: What is printed bare and is no number.
_BARE = {"null": None, "t": True, "true": True, "f": False, "false": False}


class ReplicaIdentityError(ValueError):
    """A change that doesn't say which row it is of."""


def value_of(quoted: str | None, bare: str | None, kind: str):
    """A printed value: text, null, boolean, number; timestamps with an offset are converted to UTC."""
    if quoted is None:
        if bare in _BARE:
            return _BARE[bare]
        try:
            return int(bare)
        except ValueError:
            try:
                return Decimal(bare)
            except InvalidOperation:
                return bare
    text = quoted.replace("''", "'")
    if "timestamp" in kind and (m := re.fullmatch(r"(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d(?:\.\d+)?)(Z|[+-]\d\d(?::?\d\d)?)", text)):
        offset = "+0000" if m[2] == "Z" else (m[2].replace(":", "") + "00")[:5]
        at = datetime.strptime(m[1] + offset, "%Y-%m-%d %H:%M:%S" + (".%f" if "." in m[1] else "") + "%z")
        return at.astimezone(timezone.utc).replace(tzinfo=None).isoformat(sep=" ")
    return text


def fields(text: str) -> dict:
    """Columns of a printed row; those that are unchanged out of line are left out."""
    out = {}
    for m in _FIELD.finditer(text):
        odd, name, kind, quoted, bare = m.groups()
        if quoted is None and bare == UNCHANGED:
            continue
        out[name if odd is None else odd.replace('""', '"')] = value_of(quoted, bare, kind)
    return out


@lru_cache(1024)
def _table(name: str) -> str:
    """A printed table's own name, without its schema."""
    quoted, plain = _NAME.findall(name)[-1]
    return quoted.replace('""', '"') if quoted else plain


def change_of(line: str, keys: dict[str, list[str]], past: bool = False) -> dict | None:
    """op, table, key, after and before_key of a line; None for other lines and for tables without a known key.  Of a change
    that is past no row is read.

    An update that moved its row prints the old key in front of the new row.  A key column that the new row
    lacks is taken from the old key; one that neither has raises.
    """
    m = _LINE.fullmatch(line or "")
    if not m:
        return None
    table = _table(m[1])
    key_columns = keys.get(table.upper())
    if not key_columns:
        return None
    if past:
        return {"op": m[2][0], "table": table, "key": {}, "after": {}, "before_key": {}}
    if m[2] == "DELETE":
        return {"op": "D", "table": table, "key": fields(m[3]), "after": {}, "before_key": {}}
    old_text, moved, new_text = m[3].partition("new-tuple:")
    after = fields(new_text if moved else m[3])
    old = fields(old_text.replace("old-key:", "", 1)) if moved else {}
    missing = [k for k in key_columns if k not in after and k not in old]
    if missing:
        raise ReplicaIdentityError(f"{m[2]} on {table} has no value of key column(s) {missing}: set REPLICA IDENTITY FULL")
    after |= {k: old[k] for k in key_columns if k not in after}
    key = {k: after[k] for k in key_columns}
    before = {k: old[k] for k in key_columns if k in old}
    if before == key:
        before = {}
    elif moved and len(before) < len(key_columns):
        raise ReplicaIdentityError(f"the row that {m[2]} on {table} moved can't be told: set REPLICA IDENTITY FULL")
    return {"op": m[2][0], "table": table, "key": key, "after": after, "before_key": before}


_MAP = "map<string,string>"
_PARSED = f"ord bigint, hi bigint, lo bigint, xid bigint, is_begin boolean, is_commit boolean, op string, table_name string, key {_MAP}, after {_MAP}, before_key {_MAP}"
_IMAGES = ("key", "after", "before_key")


def _text(v) -> str | None:
    return None if v is None else str(v).lower() if isinstance(v, bool) else str(v)


def _maps(rows: list[dict]) -> pa.MapArray:
    """Values by column as an Arrow array of text by text."""
    ends = [0]
    for r in rows:
        ends.append(ends[-1] + len(r))
    names, values = [c for r in rows for c in r], [_text(v) for r in rows for v in r.values()]
    return pa.MapArray.from_arrays(pa.array(ends, pa.int32()), pa.array(names, pa.string()), pa.array(values, pa.string()))


#: A printed change whose table's name is plain, and a value whose text is as it is printed: a number, text without quotes, null.
_CHANGE = r'^table (?P<table>[^:"]+): (?P<op>INSERT|UPDATE|DELETE): ?(?P<rest>(?s:.*))$'
_NUMBER = r"0|-?[1-9][0-9]{0,30}"
_DECIMAL = r"-?(?:0|[1-9][0-9]{0,30})\.[0-9]{1,6}"
_PLAIN = re.compile(r"[A-Za-z0-9_ ,.()\[\]]+")
#: Kinds of change in a batch that are read as one; the rest of the lines are read one by one.
SHAPES = 64


@dataclass(frozen=True)
class Shape:
    """How the changes of a table are printed: the columns of the old key and of the row, and a pattern that only lines match
    in which each of them has a plain value."""

    op: str
    table: str
    keys: tuple[str, ...]
    old: tuple[str, ...]
    new: tuple[str, ...]
    pattern: str

    @classmethod
    def of(cls, op: str, table: str, keys: list[str], rest: str) -> Shape | None:
        """The shape of a line; None if it, or what it says, is not plain."""
        before, moved, after = rest.partition("new-tuple:") if op != "DELETE" else ("", "", rest)
        parts = [before.removeprefix("old-key:"), after] if moved else [before or after]
        found = [[m.groups()[:3] for m in _FIELD.finditer(x)] for x in parts]
        names = [tuple(f[1] for f in x) for x in found]
        if any(f[0] is not None or not _PLAIN.fullmatch(f[1] + f[2]) for x in found for f in x) or any(len({*x}) < len(x) or not x for x in names):
            return None
        old, new = names if moved else ((), names[0])
        if op != "DELETE" and not {*keys} <= {*(old if moved else new)}:
            return None
        n = iter(range(len(old) + len(new)))
        decimal = lambda c: "" if moved and c in keys else f"|{_DECIMAL}"
        text = lambda kind: "" if "timestamp" in kind else "|'[^']*'"
        one = lambda c, kind: rf"\Q{c}[{kind}]:\E(?P<v{next(n)}>null|{_NUMBER}{decimal(c)}{text(kind)})"
        columns = [" ".join(one(c, kind) for _, c, kind in x) for x in found]
        return cls(op[0], table, tuple(keys), old, new, f"^old-key: {columns[0]} new-tuple: {columns[1]}$" if moved else f"^{columns[0]}$")

    def read(self, rest: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
        """Which of some lines are of the shape, and the key, the image and the key before of these."""
        found = pc.extract_regex(rest, self.pattern)
        fits = pc.is_valid(found)
        if self.op != "D":
            fits = pc.and_(fits, pc.equal(pc.count_substring(rest, "new-tuple:"), int(bool(self.old))))
        fits = fits.to_numpy(zero_copy_only=False)
        rows = found.filter(pa.array(fits))
        printed = dict(enumerate(rows.flatten()))
        old = {c: printed[i] for i, c in enumerate(self.old)}
        new = {c: printed[len(old) + i] for i, c in enumerate(self.new)}
        n = len(rows)
        if self.op == "D":
            return fits, [_map(new, n), _map({}, n), _map({}, n)]
        new |= {c: old[c] for c in self.keys if c not in new}
        key = {c: new[c] for c in self.keys}
        if not self.old:
            return fits, [_map(key, n), _map(new, n), _map({}, n)]
        moved = np.zeros(n, bool)
        for c in self.keys:
            moved |= pc.not_equal(old[c], key[c]).to_numpy(zero_copy_only=False)
        return fits, [_map(key, n), _map(new, n), _map({c: old[c] for c in self.keys}, n, moved)]


def _map(columns: dict[str, pa.Array], n: int, some: np.ndarray | None = None) -> pa.MapArray:
    """Printed plain values as an array of text by column, empty for rows that aren't of ``some``."""
    some = np.ones(n, bool) if some is None else some
    width, rows = len(columns), np.flatnonzero(some)
    ends = np.concatenate([[0], np.cumsum(some * width)])
    if not width or not len(rows):
        return pa.MapArray.from_arrays(pa.array(ends * 0, pa.int32()), pa.array([], pa.string()), pa.array([], pa.string()))
    values = pa.concat_arrays(columns.values()).take(pa.array((np.arange(width) * n + rows[:, None]).ravel()))
    quoted = pc.starts_with(values, "'")
    text = pc.if_else(pc.equal(values, "null"), pa.scalar(None, pa.string()), pc.if_else(quoted, pc.utf8_slice_codeunits(values, 1, -1), values))
    names = pa.array([*columns]).take(pa.array(np.tile(np.arange(width), len(rows))))
    return pa.MapArray.from_arrays(pa.array(ends, pa.int32()), names, text)


_ARROW = pa.schema([*((c, pa.int64()) for c in ("ord", "hi", "lo", "xid")), *((c, pa.bool_()) for c in ("is_begin", "is_commit")), ("op", pa.string()), ("table_name", pa.string()), *((c, pa.map_(pa.string(), pa.string())) for c in _IMAGES)])


def _of_shape(batch: pa.RecordBatch, at: list[pa.Array], shape: Shape, images: list[pa.Array]) -> pa.RecordBatch:
    n = batch.num_rows
    same = lambda v, kind: pa.repeat(pa.scalar(v, kind), n)
    return pa.RecordBatch.from_arrays([batch.column("ord"), *at, pa.nulls(n, pa.int64()), same(False, pa.bool_()), same(False, pa.bool_()), same(shape.op, pa.string()), same(shape.table, pa.string()), *images], schema=_ARROW)


def _positions(lsn: pa.Array) -> list[pa.Array]:
    """Both halves of positions, null if malformed."""
    found = pc.extract_regex(lsn, "^(?P<hi>[0-9A-Fa-f]{1,8})/(?P<lo>[0-9A-Fa-f]{1,8})$")
    return [pc.binary_join_element_wise("0x", half, "").cast(pa.int64()) for half in (pc.struct_field(found, i) for i in (0, 1))]


def _one_by_one(batch: pa.RecordBatch, at: list[pa.Array], keys: dict[str, list[str]], old: np.ndarray) -> pa.RecordBatch:
    """Marks and changes of any kind."""
    none: dict = {"op": None, "table": None, "key": {}, "after": {}, "before_key": {}}
    rows, changes = [], []
    for i, line in enumerate(batch.column("line").to_pylist()):
        s = (line or "").strip()
        begin, commit = s.startswith("BEGIN"), s.startswith("COMMIT")
        c = None if begin or commit else change_of(line, keys, old[i])
        if begin or commit or c:
            rows.append((i, int(s[5:]) if begin and s[5:].strip().isdigit() else None, begin, commit))
            changes.append(c or none)
    which, *marks = zip(*rows) if rows else [()] * 4
    kept = [x.take(pa.array(which, pa.int64())) for x in (batch.column("ord"), *at)]
    plain = [*kept, *marks, *([c[x] for c in changes] for x in ("op", "table"))]
    return pa.RecordBatch.from_arrays([*(pa.array(c, f.type) if isinstance(c, (list, tuple)) else c for c, f in zip(plain, _ARROW)), *(_maps([c[x] for c in changes]) for x in _IMAGES)], schema=_ARROW)


def _parse(keys: dict[str, list[str]], past: tuple[int, int] | None):
    """Batches of lines taken apart: those of one shape at once, the rest one by one."""
    shapes: dict[tuple[str, str, bool], Shape | None] = {}

    def shape_of(table: str, op: str, rest: str) -> Shape | None:
        if (table, op, rest.startswith("old-key:")) not in shapes and len(shapes) < SHAPES:
            shapes[table, op, rest.startswith("old-key:")] = Shape.of(op, name := _table(table), keys[name.upper()], rest)
        return shapes.get((table, op, rest.startswith("old-key:")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = _positions(b.column("lsn"))
            hi, lo = (x.fill_null(0).to_numpy() for x in at)
            old = np.zeros(b.num_rows, bool) if past is None else at[0].is_valid().to_numpy(zero_copy_only=False) & ((hi < past[0]) | ((hi == past[0]) & (lo < past[1])))
            left = np.ones(b.num_rows, bool)
            found = pc.extract_regex(b.column("line"), _CHANGE)
            table, op, rest = (pc.struct_field(found, i) for i in range(3))
            moved = pc.starts_with(rest, "old-key:")
            kinds = pc.binary_join_element_wise(table, op, pc.if_else(moved, "moved", ""), ":").dictionary_encode()
            codes = kinds.indices.fill_null(-1).to_numpy()
            for code, kind in enumerate(kinds.dictionary.to_pylist()[:SHAPES]):
                name, kind_of, _ = kind.split(":")
                mine = codes == code
                if _table(name).upper() not in keys or not keys[_table(name).upper()]:
                    left &= ~mine
                    continue
                for gone in (True, False):
                    at_rows = np.flatnonzero(mine & (old == gone))
                    if not len(at_rows):
                        continue
                    texts = rest.take(pa.array(at_rows))
                    if gone:
                        shape, n = Shape(kind_of[0], _table(name), (), (), (), ""), len(at_rows)
                        fits, images = np.ones(n, bool), [_map({}, n)] * 3
                    elif (shape := shape_of(name, kind_of, texts[0].as_py())) is None:
                        continue
                    else:
                        fits, images = shape.read(texts)
                    at_rows = at_rows[fits]
                    left[at_rows] = False
                    which = pa.array(at_rows)
                    yield _of_shape(b.take(which), [x.take(which) for x in at], shape, images)
            which = pa.array(np.flatnonzero(left))
            yield _one_by_one(b.take(which), [x.take(which) for x in at], keys, old[left])

    return run


def _halves(past: int | None) -> tuple[int, int] | None:
    return None if past is None else (past >> 32, past & (1 << 32) - 1)


def tasks_of(spark: SparkSession) -> int:
    """How many tasks the session runs at least."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def parsed(lines: DataFrame, keys: dict[str, list[str]], past: int | None = None) -> DataFrame:
    """Lines (ord, lsn, line) taken apart; others than changes and their marks are left out.  Of changes before the position
    ``past`` no row is read."""
    return lines.select("ord", "lsn", "line").mapInArrow(_parse({k.upper(): v for k, v in keys.items()}, _halves(past)), _PARSED)


def _apart(rows: DataFrame) -> bool:
    """Whether no position (at) of segmented rows is in two ranges."""
    ends = rows.groupBy(SEGMENT).agg(F.min("at").alias("least"), F.max("at").alias("most"), F.max(F.col("at").isNull()).alias("unknown")).collect()
    spans = sorted((r["least"], r["most"]) for r in ends if r["least"] is not None)
    return sum(r["unknown"] for r in ends) < 2 and all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def _place(hi: Column, lo: Column) -> Column:
    number = lambda c: c.cast("decimal(20,0)")
    return number(number(hi) * F.lit(1 << 32).cast("decimal(20,0)") + number(lo))


def changes_of(lines: DataFrame, past: int | None = None) -> DataFrame:
    """Changes (operators.changes.CHANGE) from lines that were taken apart; those before the position ``past`` are left out.

    The lines are read several times.  A change is tagged with the xid of the BEGIN before it; untagged between COMMIT and BEGIN.
    The last change before a COMMIT carries txn_end.
    """
    whole = (F.col("hi") - F.lit(1 << 31)) * F.lit(1 << 32) + F.col("lo")  # a position as one number of 64 bits, in the same order
    cut = segmented(lines, "ord").withColumn("at", whole)
    marked = between(cut, "ord", F.col("is_begin") | F.col("is_commit"), ("is_begin", "xid"), "is_commit", ("begun", "ends"))
    after, kept = _halves(past), F.col("op").isNotNull()
    if after is not None:
        kept = kept & (F.col("hi").isNull() | (F.col("hi") > after[0]) | ((F.col("hi") == after[0]) & (F.col("lo") >= after[1])))
    rows = marked.filter(kept)
    if _apart(cut.filter(kept)):  # then equal positions are counted where the rows are
        rows = rows.withColumn("seq", (F.row_number().over(Window.partitionBy(SEGMENT, "at").orderBy("ord")) - 1).cast("bigint"))
    else:
        rows = ordinal_within(rows, "at", "ord")
    txn = F.when(F.col("begun.is_begin"), F.col("begun.xid"))
    end = txn.isNotNull() & F.coalesce("ends", F.lit(False))
    return rows.select("ord", "op", "table_name", *_IMAGES, _place(F.col("hi"), F.col("lo")).alias("base"), "seq", txn.alias("txn_id"), end.alias("txn_end"))


def decode(lines: DataFrame, keys: dict[str, list[str]]) -> DataFrame:
    """Changes (operators.changes.CHANGE) from lines (ord, lsn, line); see :func:`changes_of`."""
    return changes_of(cut(parsed(lines.repartition(tasks_of(lines.sparkSession)), keys)))  # a small table may be one task's

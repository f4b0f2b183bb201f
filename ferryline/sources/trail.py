"""The trail: change records as JSON lines in numbered segments, each record with an explicit sequence number.

Values keep their types by tags (see CODECS); null, booleans, numbers and text are plain.  A segment's name holds
its number and its first and last sequence number, so that a reader opens only what it needs.  A last line
without a newline is a write that was cut off, and is left out; any other line that can't be read raises.
Segments that are applied in full can be purged.  One writer at a time holds the trail's lock.
"""

from __future__ import annotations

import base64
import json
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import date, datetime, timezone
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NullType


class CorruptTrail(ValueError):
    """A finished line that can't be read."""


class TrailBusy(RuntimeError):
    """Another writer holds the trail, or left its lock behind."""


# ---- values -----------------------------------------------------------------------------------------

#: Fixed values of the wire format: the member that names a value's tag, and the one with its text.
TAG, TEXT = "__t__", "v"


@dataclass(frozen=True)
class Codec:
    """How values of some types are written as text, and read back."""

    tag: str
    types: tuple[type, ...]
    write: Callable[[object], str]
    read: Callable[[str], object] = str


def _instant(v: datetime) -> str:
    """A wall time as it is; an instant in UTC, with its offset."""
    return (v if v.tzinfo is None else v.astimezone(timezone.utc)).isoformat()


def _json(v) -> str:
    return json.dumps(v if isinstance(v, dict) else list(v), sort_keys=True, separators=(",", ":"), default=str)


#: By tag.  The first that has a value's type writes it; datetime is before date, of which it is a kind.
CODECS = {c.tag: c for c in (
    Codec("dec", (Decimal,), str, Decimal),
    Codec("b64", (bytes, bytearray, memoryview), lambda v: base64.b64encode(bytes(v)).decode(), base64.b64decode),
    Codec("ts", (datetime,), _instant, datetime.fromisoformat),
    Codec("d", (date,), date.isoformat, date.fromisoformat),
    Codec("json", (dict, list, tuple), _json),
    Codec("set", (set, frozenset), lambda v: ",".join(sorted(map(str, v)))),
    Codec("str", (object,), str),
)}
_PLAIN = (type(None), bool, int, float, str)


def _looks_tagged(text: str) -> bool:
    return text.lstrip().startswith("{") and f'"{TAG}"' in text


def encode(v):
    """A value as JSON has it, or with its tag; so is text that could be taken for a tagged value."""
    if isinstance(v, _PLAIN) and not (isinstance(v, str) and _looks_tagged(v)):
        return v
    codec = next(c for c in CODECS.values() if isinstance(v, c.types))
    return {TAG: codec.tag, TEXT: codec.write(v)}


def decode(v):
    """The value of a tagged object; anything else is what it is, an unknown tag's text too."""
    if isinstance(v, dict) and TAG in v and TEXT in v:
        codec = CODECS.get(v[TAG])
        return codec.read(v[TEXT]) if codec else v[TEXT]
    return v


def tagged_text(text: Column) -> Column:
    """A text column as a record holds it: with a tag where it could be taken for a tagged value."""
    mark = F.ltrim(text).startswith("{") & text.contains(f'"{TAG}"')
    return F.when(mark, F.to_json(F.struct(F.lit("str").alias(TAG), text.alias(TEXT)))).otherwise(text)


def value_text(value: Column) -> Column:
    """The text of a record's value, tagged or plain."""
    mark = F.ltrim(value).startswith("{") & value.contains(f'"{TAG}"')
    return F.when(mark & F.get_json_object(value, f"$.{TAG}").isNotNull(), F.get_json_object(value, f"$.{TEXT}")).otherwise(value)


def record_line(record: dict) -> str:
    """One line of the trail; fields that are not set are left out."""
    out = {k: v for k, v in record.items() if v is not None and k not in ("key", "after", "before_key")}
    for k in ("key", "after", "before_key"):
        if record.get(k):
            out[k] = {c: encode(v) for c, v in record[k].items()}
    return json.dumps(out, sort_keys=True, separators=(",", ":"))


def record_of(line: str) -> dict:
    out = json.loads(line)
    for k in ("key", "after", "before_key"):
        out[k] = {c: decode(v) for c, v in out.get(k, {}).items()}
    return out


def position(p) -> tuple[int, int] | None:
    """A source position, a number or [base, seq], as a pair that compares; None stays outside the order."""
    return None if p is None else (int(p[0]), int(p[1])) if isinstance(p, (list, tuple)) else (int(p), 0)


# ---- segments -------------------------------------------------------------------------------------------

_SCHEMA = "seq bigint, op string, schema string, `table` string, key map<string,string>, after map<string,string>, before_key map<string,string>, scn bigint, commit_ts string, source_pos string, txn_id bigint, txn_end boolean, _corrupt string"


#: Rows of a table to a segment: as few as are worth a file, and as many as one task should sort.
SEGMENT_ROWS = (1 << 14, 1 << 18)


def _file() -> Column:
    return F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)


@dataclass(frozen=True, order=True)
class Segment:
    number: int
    first: int
    last: int

    @property
    def name(self) -> str:
        return f"segment-{self.number:010d}-{self.first:016d}-{self.last:016d}.jsonl"

    @classmethod
    def of(cls, name: str) -> Segment:
        return cls(*(int(x) for x in name.removeprefix("segment-").removesuffix(".jsonl").split("-")))


class Trail:
    def __init__(self, spark: SparkSession, path: str, rotate_bytes: int = 256 << 20):
        self.spark, self.path, self.rotate_bytes = spark, path.rstrip("/"), rotate_bytes
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def listed(self) -> list[Segment]:
        """The segments, by their names alone."""
        if not self._fs.exists(self._path(self.path)):
            return []
        names = (x.getPath().getName() for x in self._fs.listStatus(self._path(self.path)))
        return sorted(Segment.of(n) for n in names if n.startswith("segment-") and n.endswith(".jsonl"))

    def _at(self, segment: Segment) -> str:
        return f"{self.path}/{segment.name}"

    def segments(self) -> list[str]:
        return [self._at(s) for s in self.listed()]

    def last_seq(self) -> int:
        """The last sequence number given out."""
        return max((s.last for s in self.listed()), default=0)

    @contextmanager
    def writing(self) -> Iterator[Segment]:
        """Holds the writer's lock; gives the last segment there is (numbers before the first, if there is none)."""
        lock = self._path(f"{self.path}/.writer")
        try:
            self._fs.create(lock, False).close()
        except Exception as e:
            if self._fs.exists(lock):
                raise TrailBusy(f"{self.path} has another writer; after a crash, unlock() frees it") from e
            raise
        try:
            if self.identity() is None:
                self._named()
            yield max(self.listed(), default=Segment(-1, 0, 0))
        finally:
            self._fs.delete(lock, False)

    def _named(self) -> None:
        """Give the trail a name of its own; it appears whole or not at all."""
        temp = self._path(f"{self.path}/.identity")
        stream = self._fs.create(temp, True)
        stream.write(bytearray(uuid.uuid4().hex.encode()))
        stream.close()
        if not self._fs.rename(temp, self._path(f"{self.path}/identity")):
            raise OSError(f"{self.path} can't be named")

    def identity(self) -> str | None:
        """What tells this trail from another at its place, once it has been written to."""
        at = self._path(f"{self.path}/identity")
        if not self._fs.exists(at):
            return None
        stream = self._fs.open(at)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def unlock(self) -> bool:
        """Remove a lock that a crash left behind; the caller knows that its writer is gone."""
        return bool(self._fs.delete(self._path(f"{self.path}/.writer"), False))

    def _publish(self, temp: str, segment: Segment) -> None:
        if not self._fs.rename(self._path(temp), self._path(self._at(segment))):
            raise OSError(f"segment {segment.number} can't be put in place")

    def append(self, records: Iterable[dict]) -> int:
        """Write records as new segments, numbered on; returns how many.  A segment appears whole or not at all.

        For the few records of a decoded stream; tables of records go through append_frame.
        """
        n, lines, size, temp = 0, 0, 0, f"{self.path}/.segment"
        with self.writing() as last:
            number, first, stream = last.number + 1, last.last + 1, None
            for r in records:
                line = bytearray((record_line({**r, "seq": last.last + n + 1}) + "\n").encode())
                if stream is not None and size + len(line) > self.rotate_bytes:
                    stream.close()
                    self._publish(temp, Segment(number, first, first + lines - 1))
                    number, first, stream = number + 1, first + lines, None
                if stream is None:
                    stream, lines, size = self._fs.create(self._path(temp), True), 0, 0
                stream.write(line)
                n, lines, size = n + 1, lines + 1, size + len(line)
            if stream is not None:
                stream.close()
                self._publish(temp, Segment(number, first, first + lines - 1))
        return n

    def append_frame(self, df: DataFrame, order: str) -> int:
        """Write a table of records (op, table, key, after and others of the schema) in the order of a whole number.

        Numbering and writing stay distributed: rows are counted by range of the order, and each range becomes a segment.  The
        table is read once, into a copy, so that a source that changes meanwhile can't be numbered twice.  Returns how many.
        """
        from ..operators.graph import copied
        from ..operators.ordered import SEGMENT, numbered, ranges_of

        temp, n = f"{self.path}/.frame", 0
        fields = [f.name for f in df.schema.fields if f.name != order and not isinstance(f.dataType, NullType)]
        with self.writing() as last, copied(df.select(order, *fields)) as rows:
            numbers, spans = numbered(rows, order, "seq", last.last, ranges_of(rows, SEGMENT_ROWS))
            lines = numbers.sortWithinPartitions(SEGMENT, "seq").select(SEGMENT, F.to_json(F.struct(*sorted({*fields, "seq"})), {"ignoreNullFields": "true"}).alias("value"))
            if spans:
                lines.write.mode("overwrite").partitionBy(SEGMENT).text(temp)
            for at, (part, first, end) in enumerate(spans, last.number + 1):
                (made,) = (x.getPath() for x in self._fs.listStatus(self._path(f"{temp}/{SEGMENT}={part}")) if x.getPath().getName().startswith("part-"))
                self._publish(made.toString(), Segment(at, first, end))
                n += end - first + 1
            self._fs.delete(self._path(temp), True)
        return n

    def _torn(self, segment: str) -> bool:
        """Whether a segment's last byte is no newline."""
        path = self._path(segment)
        size = self._fs.getFileStatus(path).getLen()
        if not size:
            return False
        stream = self._fs.open(path)
        try:
            stream.seek(size - 1)
            return stream.read() != 10
        finally:
            stream.close()

    def needed(self, after: int = 0, limit: int | None = None) -> list[Segment]:
        """The segments that hold the records past a sequence number, up to ``limit`` of them."""
        out, n = [], 0
        for s in self.listed():
            if s.last > after and (limit is None or n < limit):
                out.append(s)
                n += s.last - max(s.first, after + 1) + 1
        return out

    def read(self, after: int = 0, limit: int | None = None) -> DataFrame:
        """Records past a sequence number, in a table; to be ordered by seq.  Only the segments needed are opened."""
        return self._checked(self._parsed(after, limit), after, limit)

    @contextmanager
    def opened(self, after: int = 0, limit: int | None = None) -> Iterator[DataFrame]:
        """What read gives, parsed once for as long as the block runs."""
        parsed = self._parsed(after, limit).persist()
        try:
            yield self._checked(parsed, after, limit)
        finally:
            parsed.unpersist()

    def _parsed(self, after: int, limit: int | None) -> DataFrame:
        """The lines of the segments needed, with their files and those that can't be read."""
        need = self.needed(after, limit)
        if not need:
            return self.spark.createDataFrame([], f"file string, {_SCHEMA}")
        lines = self.spark.read.text([self._at(s) for s in need]).select("value", _file().alias("file"))
        return lines.select("file", F.from_json("value", _SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r")).select("file", "r.*")

    def _checked(self, parsed: DataFrame, after: int, limit: int | None) -> DataFrame:
        """The records of parsed lines; one that is cut off is left out, and another that can't be read raises."""
        have, need = self.listed(), self.needed(after, limit)
        if not need:
            return parsed.drop("_corrupt", "file")
        for s in need:
            if s != have[-1] and self._torn(self._at(s)):
                raise CorruptTrail(f"{s.name} is closed but its last line is cut off")
        torn = need[-1] == have[-1] and self._torn(self._at(have[-1]))
        bad = parsed.filter(F.col("_corrupt").isNotNull() | F.col("seq").isNull())
        if torn:
            name = have[-1].name
            broken = bad.filter(F.col("file") == name).count()
            if broken > 1 or bad.filter(F.col("file") != name).limit(1).count():
                raise CorruptTrail("a finished line can't be read")
            if broken == 0:  # the line was cut off just before its newline
                cut = parsed.filter(F.col("file") == name).agg(F.max("seq")).first()[0]
                parsed = parsed.filter((F.col("file") != name) | (F.col("seq") < cut))
        elif bad.limit(1).count():
            raise CorruptTrail("a finished line can't be read")
        out = parsed.filter(F.col("_corrupt").isNull() & (F.col("seq") > after)).drop("_corrupt", "file")
        return out if limit is None else out.filter(F.col("seq") < max(need[0].first, after + 1) + limit)  # numbers have no gaps, and no task has to count

    def _whole_bytes(self, path) -> int:
        """How many bytes of a file end in a newline; read from its end, a block at a time."""
        end, block = self._fs.getFileStatus(path).getLen(), 1 << 16
        stream = self._fs.open(path)
        try:
            while end:
                start = max(0, end - block)
                stream.seek(start)
                data = bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, end - start))
                if (at := data.rfind(b"\n")) >= 0:
                    return start + at + 1
                end = start
            return 0
        finally:
            stream.close()

    def heal(self) -> bool:
        """Replace the last segment by one without the line that was cut off; returns whether there was one.

        The bytes are copied from stream to stream, and one rename puts the copy in the segment's place, under the lock.
        """
        have = self.listed()
        if not have or not self._torn(self._at(have[-1])):
            return False
        with self.writing():
            return self._healed()

    def _healed(self) -> bool:
        have = self.listed()
        jvm, path, temp = self.spark._jvm, self._path(self._at(have[-1])), self._path(f"{self.path}/.healed")
        size = self._whole_bytes(path)
        source, copy = self._fs.open(path), self._fs.create(temp, True)
        try:
            jvm.org.apache.commons.io.IOUtils.copyLarge(source, copy, 0, size)
        finally:
            source.close()
            copy.close()
        replace = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        replace[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri() if path.toUri().getScheme() else self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        context.rename(temp, path, replace)
        return True

    def purge(self, applied: int) -> list[str]:
        """Remove closed segments whose records are all applied, under the lock; returns their names.  No segment is read."""
        gone: list[str] = []
        if not self.listed():
            return gone
        with self.writing():
            for s in self.listed()[:-1]:
                if s.last > applied:
                    break
                self._fs.delete(self._path(self._at(s)), False)
                gone.append(s.name)
        return gone

    def remove(self) -> None:
        """Remove the trail with all it holds."""
        self._fs.delete(self._path(self.path), True)

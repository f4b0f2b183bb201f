"""A replication slot over recorded decoding output, as a streaming source: peek, then advance once what was read is safe.

A recording is a folder of numbered files changes-<n>.jsonl, each put there whole and ending with a COMMIT, as a peek never
splits a transaction; a line is {"lsn": ..., "data": ...}.  identity.json names the server that it is of and its timeline:
positions of another can't be compared with these.  The slot is a file beside them, with the number of the last file that was
consumed; reading doesn't move it, and the stream's commit does.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.json as pj
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

_FILE = re.compile(r"changes-(\d+)\.jsonl$")
#: Bytes of a file in the order of the whole recording, and bytes of a file to a task.
BYTES, PIECE = 1 << 36, 16 << 20


class Recording:
    """The files of a recording, and its slots."""

    def __init__(self, path: str):
        self.files, self.root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        self.root = self.root.rstrip("/")

    def numbers(self) -> list[int]:
        found = self.files.get_file_info(fs.FileSelector(self.root, allow_not_found=True))
        return sorted(int(m[1]) for x in found if (m := _FILE.search(x.path)))

    def file(self, number: int) -> str:
        return f"{self.root}/changes-{number:010d}.jsonl"

    def _json(self, name: str):
        try:
            with self.files.open_input_stream(f"{self.root}/{name}") as f:
                return json.loads(f.read())
        except FileNotFoundError:
            return None

    def identity(self) -> str | None:
        """The server and timeline that the positions are of."""
        found = self._json("identity.json")
        return found and f"{found['system']}:{found['timeline']}"

    def confirmed(self, slot: str) -> int:
        """The last file that a slot has consumed; -1 for none."""
        found = self._json(f"slot-{slot}.json")
        return -1 if found is None else found["confirmed"]

    def advance(self, slot: str, number: int) -> None:
        """Move a slot forward; never back."""
        if number > self.confirmed(slot):
            temp = f"{self.root}/.slot-{slot}.json"
            with self.files.open_output_stream(temp) as f:
                f.write(json.dumps({"confirmed": number}).encode())
            self.files.move(temp, f"{self.root}/slot-{slot}.json")

    def put(self, number: int, lines: list[tuple[str, str]]) -> None:
        """Record one peek: it appears whole."""
        self.files.create_dir(self.root)
        temp = f"{self.root}/.{number}.part"
        with self.files.open_output_stream(temp) as f:
            f.write("".join(json.dumps({"lsn": a, "data": b}) + "\n" for a, b in lines).encode())
        self.files.move(temp, self.file(number))


@dataclass
class _Piece(InputPartition):
    """The lines of a file that begin in a range of its bytes."""

    number: int
    start: int = 0
    end: int = 0


class _SlotReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.slot = options["path"], options.get("slot", "main")

    def initialOffset(self) -> dict:
        return {"file": Recording(self.path).confirmed(self.slot)}

    def latestOffset(self) -> dict:
        at = Recording(self.path)
        return {"file": max(at.numbers(), default=at.confirmed(self.slot))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        at = Recording(self.path)
        sizes = {n: at.files.get_file_info(at.file(n)).size for n in at.numbers() if start["file"] < n <= end["file"]}
        if max(sizes.values(), default=0) > BYTES:
            raise ValueError(f"{self.path} has a file of more than {BYTES} bytes: the places of its lines can't be told")
        return [_Piece(n, x, min(x + PIECE, size)) for n, size in sizes.items() for x in range(0, size, PIECE)] or [_Piece(-1)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        """The lines of a piece, in batches."""
        if partition.number < 0:
            return
        at, first = Recording(self.path), partition.number * BYTES
        with at.files.open_input_file(at.file(partition.number)) as f:
            for places, text in _lines(f, partition.start, partition.end):
                lsn, data = _fields(text, len(places))
                yield pa.RecordBatch.from_arrays([pa.array(places + first, pa.int64()), lsn, data], ["ord", "lsn", "line"])

    def commit(self, end: dict) -> None:
        Recording(self.path).advance(self.slot, end["file"])


def _lines(f, start: int, end: int, size: int = 1 << 20) -> Iterator[tuple[np.ndarray, bytes]]:
    """The lines that begin in a range of a file's bytes, a block at a time: their places, and all their text.  A last one that was
    cut off raises."""
    at, left = max(0, start - 1), b""
    before = start > 0  # what is read first is of a line that began before, if only its newline
    f.seek(at)
    while at < end and (block := f.read(size)):
        text = left + block
        ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
        if not len(ends):
            left = text
            continue
        begun = np.concatenate([[0], ends[:-1]])
        first, last = int(before), int(np.searchsorted(begun, end - at))  # lines from the one to the other begin in the range
        if first < last:
            yield begun[first:last] + at, text[begun[first] : ends[last - 1] - 1]
        at, left, before = at + int(ends[-1]), text[ends[-1] :], False
    if at < end and left and not before:
        raise ValueError("a recorded file ends inside a line")


_FIELDS = pa.schema([("lsn", pa.string()), ("data", pa.string())])


def _fields(text: bytes, n: int) -> tuple[pa.Array, pa.Array]:
    """lsn and data of n lines: all at once, or one by one where that can't be, which says what is wrong."""
    try:
        found = pj.read_json(pa.BufferReader(text), pj.ReadOptions(use_threads=False, block_size=len(text) + 1), pj.ParseOptions(explicit_schema=_FIELDS, unexpected_field_behavior="ignore"))
        lsn, data = (found.column(c).combine_chunks() for c in ("lsn", "data"))
        if len(lsn) == n and not lsn.null_count and not data.null_count:
            return lsn, data
    except pa.ArrowInvalid:
        pass
    rows = [json.loads(x) for x in text.split(b"\n")]
    return pa.array([x["lsn"] for x in rows], pa.string()), pa.array([x["data"] for x in rows], pa.string())


class SlotSource(DataSource):
    """spark.readStream.format("ferryline_slot").option("path", ...).option("slot", ...)"""

    @classmethod
    def name(cls) -> str:
        return "ferryline_slot"

    def schema(self) -> str:
        return "ord bigint, lsn string, line string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _SlotReader(self.options)

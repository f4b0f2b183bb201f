"""Capture from a log: what a slot gives is decoded, written to the trail, and only then is the slot advanced.

A micro-batch is peeked, and its changes are appended as segments; the slot moves when the batch is committed.  A
crash between repeats the batch: changes up to the trail's last position are there already and are left out, so that nothing
is written twice and nothing is lost.
"""

from __future__ import annotations

import json
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.render import lsn
from ..operators.changes import after_tail, check_epoch
from ..operators.graph import copied
from ..sources.binlog import BinlogSource, LogFiles
from ..sources.decoding import changes_of, parsed, tasks_of
from ..sources.slot import Recording, SlotSource
from ..sources.trail import Trail, tagged_text


class AnotherServer(RuntimeError):
    """A recording of another server or timeline than the capture began at: its positions can't be compared."""


def records_of(changes: DataFrame) -> DataFrame:
    """Decoded changes (operators.changes.CHANGE) as records of a trail, with their place in the source."""
    tagged = lambda m: F.transform_values(m, lambda _, v: tagged_text(v))
    place = F.concat(F.lit("["), F.col("base").cast("string"), F.lit(","), F.col("seq").cast("string"), F.lit("]"))
    return changes.select("ord", "op", F.col("table_name").alias("table"), tagged("key").alias("key"), F.when(F.size("after") > 0, tagged("after")).alias("after"), F.when(F.size("before_key") > 0, tagged("before_key")).alias("before_key"), place.alias("source_pos"), "txn_id", F.when(F.col("txn_end"), True).alias("txn_end"))


def trail_tail(trail: Trail) -> tuple[int, int] | None:
    """The source position of the trail's last record that has one."""
    last = trail.listed()[-1:]
    if not last:
        return None
    found = trail.read(last[0].first - 1).filter("source_pos IS NOT NULL").agg(F.max_by("source_pos", "seq")).first()[0]
    return None if found is None else tuple(int(x) for x in found.strip("[]").split(","))


def append_changes(trail: Trail, changes: DataFrame, tail: tuple[int, int] | None) -> int:
    """Append what is past the trail's tail, in the stream's order; returns how many."""
    kept = after_tail(changes, F.col("base"), F.col("seq"), None if tail is None else (Decimal(tail[0]), tail[1]))
    return trail.append_frame(records_of(kept), "ord")


def _last_lsn(spark: SparkSession, at: Recording, path: str, number: int) -> int | None:
    """The highest position in one file of a recording."""
    file = at.file(number) if "://" not in path else f"{path.rstrip('/')}/changes-{number:010d}.jsonl"
    end = spark.read.json(file, "lsn string, data string").agg(F.max(lsn(F.col("lsn")))).first()[0]
    return None if end is None else int(end)


def behind_slot(spark: SparkSession, path: str, slot: str, trail: Trail) -> dict:
    """How far a slot is behind the end of its recording: files, and bytes of the source's log between their positions.

    The bytes count from the last file that the slot has consumed, from the trail's tail if that file is gone, and are None if
    neither is there to count from.
    """
    at = Recording(path)
    numbers, done = at.numbers(), at.confirmed(slot)
    left = [n for n in numbers if n > done]
    if not left:
        return {"mode": "logical", "files_behind": 0, "bytes_behind": 0}
    tail = trail_tail(trail)
    began = _last_lsn(spark, at, path, done) if done in numbers else None if tail is None else tail[0]
    end = _last_lsn(spark, at, path, left[-1])
    return {"mode": "logical", "files_behind": len(left), "bytes_behind": None if None in (began, end) else max(0, end - began)}


def behind_binlog(path: str, trail: Trail) -> dict:
    """How far a trail is behind the end of a folder of binary logs: files begun since, and bytes over all of them.

    Positions count within a file, so that across a change of files the rest of the trail's own file, whole files and what the last
    one holds are added up.  What stands after the last change of rows counts too: a commit, at least, once all is captured.
    A file of the trail's that is gone adds nothing.
    """
    files, tail = LogFiles(path), trail_tail(trail)
    sizes = {n: files.files.get_file_info(name).size for n, name in files.listed()}
    number, at = (-1, 0) if tail is None else (tail[0] >> 48, tail[0] & (1 << 48) - 1)
    later = {n: size for n, size in sizes.items() if n > number}
    return {"mode": "binlog", "files_behind": len(later), "bytes_behind": sum(later.values()) + max(0, sizes.get(number, at) - at)}


def capture_binlog(spark: SparkSession, path: str, trail: Trail, keys: dict[str, list[str]], epoch: str | None = None) -> str | None:
    """Bring a trail up to the last finished transaction of a folder of binary logs; returns the epoch, as capture does.

    The trail's last position, a file's number and an offset, is where it goes on: files before it are not opened, and what
    a crash left of an event is completed.
    """
    files, found = LogFiles(path), Recording(path).identity()
    if epoch is not None and found != epoch:
        raise AnotherServer(f"{path} is of {found}, and the capture is of {epoch}")
    listed, tail = files.listed(), trail_tail(trail)
    if listed:
        number, name = listed[-1]
        check_epoch(tail, (number << 48) | files.files.get_file_info(name).size)
    spark.dataSource.register(BinlogSource)
    read = spark.read.format("ferryline_binlog").option("path", path).option("keys", json.dumps(keys))
    if tail is not None:
        read = read.option("file", tail[0] >> 48).option("position", (tail[0] & (1 << 48) - 1) - 1)
    append_changes(trail, read.load(), tail)
    return found


def capture(spark: SparkSession, path: str, slot: str, trail: Trail, keys: dict[str, list[str]], checkpoint: str, epoch: str | None = None) -> str | None:
    """Bring a trail up to the end of a recording; returns the epoch, which later runs pass in.

    ``keys`` are the key columns by table; tables without any are left out.  A recording of another epoch is refused, and so is
    one whose end lies before the trail's tail: its server was reset.
    """
    at = Recording(path)
    found = at.identity()
    if epoch is not None and found != epoch:
        raise AnotherServer(f"{path} is of {found}, and the capture is of {epoch}")
    numbers = at.numbers()
    if numbers:
        check_epoch(trail_tail(trail), _last_lsn(spark, at, path, numbers[-1]))
    spark.dataSource.register(SlotSource)
    lines = spark.readStream.format("ferryline_slot").option("path", path).option("slot", slot).load()

    def append(batch: DataFrame, _: int) -> None:
        tail, tasks = trail_tail(trail), tasks_of(spark)
        past = None if tail is None else tail[0]
        spread = batch if batch.rdd.getNumPartitions() >= tasks else batch.repartition(tasks)
        with copied(parsed(spread, keys, past)) as lines:
            append_changes(trail, changes_of(lines, past), tail)

    # a run that takes up a batch that was cut short may end with it; the slot moves to where a run has come, no further
    while True:
        query = lines.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        reached = max((json.loads(p.json)["sources"][0]["endOffset"]["file"] for p in query.recentProgress), default=None)
        if reached is None:
            return found
        at.advance(slot, reached)
        if reached >= max(numbers, default=-1):
            return found

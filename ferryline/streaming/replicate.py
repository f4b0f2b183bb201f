"""Change records from a trail, applied to versioned tables in micro-batches.

Each batch reads the records past its stream's cursor, holds back a last transaction whose end is still to come,
parks what can't be applied, lays the rest on the buckets that they touch and publishes all tables together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.changes import dead_letters, fold, fold_with_moves, held_of, in_commit_order, interleave, kind_of, with_hold, with_open_found, without_moves
from ..sources.trail import _SCHEMA as TRAIL_SCHEMA
from ..sources.trail import Trail, value_text
from .versions import Applied, Fenced, Pointer, Replica, Stored, VersionedTable


class AnotherTrail(RuntimeError):
    """A trail under a stream's name that is not the one it was applied from."""


class Outage(RuntimeError):
    """A batch that failed while an end did not answer: nothing is wrong with its records."""


def typed(value: Column, kind: T.DataType) -> Column:
    """A value of the trail (text, or a tagged object) as a column of the table's type; null if it can't be one."""
    text = value_text(value)
    return F.try_to_binary(text, F.lit("base64")) if isinstance(kind, T.BinaryType) else text.try_cast(kind)


def reasons(schema: T.StructType, keys: Sequence[str]) -> Column:
    """Why a record can't be applied to a table, as one text; null if it can: an op that is none, a value that can't be one of
    its column's, a key that is null."""
    found = [F.when(~F.coalesce(F.col("op").isin("I", "U", "D"), F.lit(False)), F.lit("op is not I, U or D"))]
    for f in schema.fields:
        for image in ("after", "key", "before_key"):
            value = F.col(image)[f.name]
            found.append(F.when(value.isNotNull() & typed(value, f.dataType).isNull(), F.lit(f"{image}.{f.name} is no {f.dataType.simpleString()}")))
    found += [F.when(F.col("key")[k].isNull(), F.lit(f"key.{k} is null")) for k in keys]
    text = F.concat_ws("; ", *found)
    return F.when(text != "", text)


def applicable(schema: T.StructType, keys: Sequence[str]) -> Column:
    """Whether a record's values can be those of the table's columns, and none of its keys is null."""
    return reasons(schema, keys).isNull()


def typed_changes(records: DataFrame, schema: T.StructType, keys: Sequence[str]) -> DataFrame:
    """Trail records of one table as fold_with_moves takes them."""
    kinds = {f.name: f.dataType for f in schema.fields}
    rest = [f.name for f in schema.fields if f.name not in keys]
    after = F.coalesce("after", F.create_map().cast("map<string,string>"))
    has = lambda c: F.array_contains(F.map_keys(after), c)
    new = lambda k: typed(F.col("key")[k], kinds[k]).alias(k)
    old = F.struct(*[typed(F.coalesce(F.col("before_key"), F.col("key"))[k], kinds[k]).alias(k) for k in keys])
    moved = F.col("before_key").isNotNull() & (F.size(F.coalesce("before_key", F.create_map().cast("map<string,string>"))) > 0) & (old != F.struct(*[new(k) for k in keys]))
    complete = F.lit(True)
    for c in rest:
        complete = complete & has(c)
    images = [F.when(has(c), F.struct(typed(after[c], kinds[c]).alias(c))).alias(c) for c in rest]
    order = F.col("ord" if "ord" in records.columns else "seq")
    return records.select(order.alias("ord"), kind_of(F.col("op"), moved, complete).alias("kind"), *[new(k) for k in keys], F.when(moved, old).alias("old"), *images)


def releasable(records: DataFrame) -> DataFrame:
    """Records without those of a last transaction that has not ended."""
    return with_hold(records, "txn_id", "txn_end", "seq").filter("NOT held").drop("held")


#: Changes to a bucket of a table whose first load this is.
BUCKET_ROWS = 4_000_000


def _staged(target: VersionedTable, changes: DataFrame, keys: Sequence[str]) -> Stored | None:
    """Write what the changes make of a table for the version to come; None if there are none.

    A bucket is written anew or gets a delta, as its sizes say; key moves are resolved first, and only the buckets of
    their keys are read for it.
    """
    keys, stored, held = tuple(keys), target.stored(), [changes.persist()]
    try:
        total = changes.count()
        if not total:
            return None
        moves = changes.filter("kind = 'keymove'").limit(1).count() > 0
        if stored.keys != keys or not stored.versions():  # not bucketed by them yet, or the first rows: all at once
            rows = (fold_with_moves if moves else fold)(target.read(), changes, keys)
            return target.stage(rows, keys, None, max(target.replica.buckets, -(-total // BUCKET_ROWS)))
        bucket = lambda cols: target.replica.bucket_of(cols, stored.count)
        if moves:
            moved = changes.filter("kind = 'keymove'")
            ends = moved.select(bucket(list(keys)).alias("b")).union(moved.select(bucket([F.col(f"old.{k}") for k in keys])))
            near = sorted(r["b"] for r in ends.distinct().collect())
            changes = without_moves(target.read(near), changes, keys)
            held.append(changes.persist())
        dealt = changes.withColumn("__b", bucket(list(keys)))
        touched = sorted(r["__b"] for r in dealt.select("__b").distinct().collect())
        anew = [b for b in touched if stored.rewritten(b, target.replica.small_bytes)]
        over = [b for b in touched if b not in anew]
        out = stored
        if over:
            out = target.replica.lay(target.name, dealt.filter(F.col("__b").isin(over)).drop("__b", "old"), stored, over)
        if anew:
            part = dealt.filter(F.col("__b").isin(anew)).drop("__b")
            new = target.stage(fold(target.read(anew), part, keys), keys, anew)
            out = replace(new, deltas={b: d for b, d in out.deltas.items() if int(b) not in anew})
        return out
    finally:
        for x in held:
            x.unpersist()


#: A place between a batch that fails and its records: makes what is to be published of some records of a table.
Make = Callable[[DataFrame], Stored | None]


def _tried(make: Make, records: DataFrame, answers: Callable[[], bool]) -> tuple[Stored | None, Exception | None]:
    """What is made of the records, or the error; without an answer from the other end it is an outage, which raises."""
    try:
        return make(records), None
    except Exception as e:
        if not answers():
            raise Outage("the other end stopped answering while failing records were looked for") from e
        return None, e


def isolated(make: Make, records: DataFrame, order: Column, most: int, attempts: int = 1, answers: Callable[[], bool] = lambda: True) -> tuple[Stored | None, dict[int, str]]:
    """What ``make`` makes of a failing batch without the records that fail it, and those: their places with the error.

    The range of places is halved until the shortest prefix that fails is found: its last record fails where all before it
    pass.  That prefix is tried ``attempts`` times; if it passes in one, the failure was not the record's.  Then the others
    are tried without it, and so on.  More than ``most`` failing records raise, as does a failure that comes and goes; with
    n places a failing record costs log2(n) trials, and nothing of the batch comes to the driver but the ends of the range.
    """
    refused: dict[int, str] = {}
    passing = 0
    while True:
        rest = records.filter(~order.isin(list(refused))) if refused else records
        made, error = _tried(make, rest, answers)
        if error is None:
            return made, refused
        if len(refused) >= most:
            raise ValueError(f"more than {most} changes can't be applied: stopped before anything was published") from error
        low, high = rest.agg(F.min(order), F.max(order)).first()
        if low is None:
            raise error
        low -= 1
        while high - low > 1:
            middle = (low + high) // 2
            made, found = _tried(make, rest.filter(order <= middle), answers)
            low, high = (middle, high) if found is None else (low, middle)
        trials = [_tried(make, rest.filter(order <= high), answers)[1] for _ in range(max(1, attempts))]
        if all(trials):
            refused[high] = f"{type(trials[-1]).__name__}: {str(trials[-1])[:500]}"
            continue
        passing += 1
        if passing > max(1, attempts):
            raise error


def _is_move() -> Column:
    return F.size(F.coalesce("before_key", F.create_map().cast("map<string,string>"))) > 0


def apply_tables(replica: Replica, records: DataFrame, tables: dict[str, Sequence[str]], batch: int, park: Callable[[str, DataFrame], None] | None = None, most_parked: int = 25, last_of: str | None = None, stream: str = "", trail: str | None = None, mixed: bool = False, whole: bool = True, attempts: int = 0, answers: Callable[[], bool] = lambda: True) -> int:
    """Apply one batch of a stream to some tables (their keys by name), publish them together, and return the cursor reached.

    ``records`` are those of all tables past the stream's cursor, as only they tell whether the last transaction has ended.
    One that has not is held: the cursor stays before its first record, and what is applied beyond is left out when they are
    read again.  Where transactions interleave (``mixed`` says so from the start, else the first that does), every one without
    an end is held, and changes take effect in the order in which transactions end.  With ``whole`` false transactions
    are not told apart: what is read is applied as it stands.

    Records whose values don't fit their table are parked with the reason, ``most_parked`` in a batch at most: more raise, and
    so do any without a place to park and key moves, before anything is written.  ``park`` gets the table's name and the
    records before the batch is published: a batch that is repeated parks the same again.  With ``attempts`` (and a place to
    park) a table whose changes can't be written is searched for the records that fail it, see :func:`isolated`, and these are
    parked with the error and counted with the others; the rest of their transactions is applied.  ``last_of``: the cursor is
    that of this table's last record.
    """
    with replica.claimed():
        now = replica.pointer().applied(stream)
        if batch <= now.batch:
            return now.cursor
        unseen = F.col("seq") > now.ahead
        if now.open:
            unseen = unseen | ((F.col("seq") > now.cursor) & F.col("txn_id").isin(*now.open))
        fresh = records.filter(unseen)
        mixed = whole and (mixed or now.mixed) or whole and bool(interleave(records.filter(F.col("seq") > now.cursor), "txn_id", "seq").limit(1).count())
        if mixed:
            found = with_open_found(fresh, "txn_id", "txn_end")
        else:
            found = fresh.withColumn("held", held_of(fresh, "txn_id", "txn_end", "seq") if whole else F.lit(False))
        free, lower = ~F.col("held"), F.lower("table")
        mine = free if last_of is None else free & (lower == last_of.lower())
        got = found.agg(F.max(F.when(mine, F.col("seq"))).alias("last"), F.min(F.when(~free, F.col("seq"))).alias("held"), F.collect_set(F.when(~free, F.col("txn_id"))).alias("open")).first()
        if got["last"] is None:
            return now.cursor
        reached = max(got["last"], now.ahead)
        cursor = reached if got["held"] is None else max(now.cursor, min(reached, got["held"] - 1))
        place = Applied(ahead=reached, open=tuple(sorted(got["open"])) if reached > cursor else (), mixed=mixed, trail=trail)
        ready = found.filter(free).drop("held")
        if mixed:
            ready = in_commit_order(ready, "txn_id", "seq")
        parked, staged = [], {}
        present = {r[0] for r in found.filter(free).select(lower).distinct().collect()}
        work = [(replica.table(name), name, keys) for name, keys in tables.items() if name.lower() in present]
        for target, name, keys in work:
            schema = target.schema()
            why = reasons(schema, keys)
            own = ready.filter(lower == name.lower())
            good, bad = dead_letters(own, why.isNull())
            n_bad = dead_letters(found.filter(free & (lower == name.lower())), why.isNull())[1].limit(most_parked + 1).count()  # in any order
            if n_bad > most_parked:
                raise ValueError(f"more than {most_parked} changes can't be applied ({n_bad} found): stopped before anything was written")
            if not n_bad:
                good = own
            if n_bad and park is None:
                raise ValueError(f"{name} has changes that can't be applied, and there is no place to park them")
            bad = bad.withColumn("reason", why)
            make = lambda some, target=target, schema=schema, keys=keys: _staged(target, typed_changes(some, schema, keys), keys)
            if attempts and park is not None:
                order = F.col("ord" if "ord" in good.columns else "seq")
                made, refused = isolated(make, good, order, most_parked - n_bad, attempts, answers)
                if refused:
                    because = F.create_map(*[F.lit(x) for pair in refused.items() for x in pair])
                    bad = bad.unionByName(good.filter(order.isin(list(refused))).withColumn("reason", because[order]))
            else:
                made, refused = make(good), {}
            if n_bad or refused:
                if bad.filter(_is_move()).limit(1).count():
                    raise ValueError("a key move can't be applied, and is not parked")
                parked.append((name, bad))
            if made is not None:
                staged[name] = made
        for name, bad in parked:
            park(name, bad)
        replica.publish(staged, batch, cursor, stream, place)
        return cursor


def _drained(trail: Trail, replica, tables: Iterable[VersionedTable], apply: Callable[[DataFrame, int], int], batch_records: int, stream: str) -> int:
    """Apply batch by batch till nothing moves.  A batch is never cut inside a transaction: it grows until something
    moves.  The first load of tables without any rows is one batch."""
    place = lambda: replica.pointer().applied(stream)
    empty = place().cursor == 0 and all((s := t.stored()) is not None and not s.versions() for t in tables)
    while True:
        before, size = place(), max(batch_records, trail.last_seq()) if empty else batch_records
        while True:
            with trail.opened(before.cursor, size + max(0, before.ahead - before.cursor)) as records:
                reached = apply(records, before.batch + 1)
            if place() != before or trail.last_seq() <= max(before.cursor, before.ahead) + size:
                break
            size *= 2
        if place() == before:
            return reached
        empty = False


def replicate_all(trail: Trail, replica: Replica, tables: dict[str, Sequence[str]], batch_records: int = 10_000, stream: str = "", retries: int = 0, answers: Callable[[], bool] = lambda: True, **options) -> int:
    """Apply all that the trail holds for some tables, which are published together; returns the cursor.

    Each stream into a replica has a cursor of its own, bound to its trail: another trail under its name is refused.  A batch
    that fails is tried again, ``retries`` times at most; without an answer from ``answers`` it is an outage, and raises
    as that.  The last time the records that fail it are looked for, each tried ``retries`` times, and parked if there is a place
    for it; without retries nothing is looked for.  What a retry can't change (records that can't be parked, a claim that
    was lost) raises at once.
    """
    known, identity = replica.pointer().applied(stream).trail, trail.identity()
    if None not in (known, identity) and known != identity:
        raise AnotherTrail(f"{trail.path} is not the trail that {stream or 'this stream'} was applied from")

    def apply(records: DataFrame, batch: int) -> int:
        for left in range(retries, -1, -1):
            try:
                return apply_tables(replica, records, tables, batch, stream=stream, trail=identity, attempts=0 if left else retries, answers=answers, **options)
            except (ValueError, Fenced, Outage):
                raise
            except Exception as e:
                if not answers():
                    raise Outage(f"batch {batch} of {stream or 'the stream'} failed, and the other end does not answer") from e
                if not left:
                    raise
        raise AssertionError

    return _drained(trail, replica, [replica.table(n) for n in tables], apply, batch_records, stream)


def replicate(trail: Trail, target: VersionedTable, keys: Sequence[str], table: str, batch_records: int = 10_000, **options) -> int:
    """Apply all that the trail holds for one table, alone in its replica; returns the cursor."""
    one = _Named(target, table)
    apply = lambda records, batch: apply_tables(one, records, {table: keys}, batch, last_of=table, **options)
    return _drained(trail, one, [target], apply, batch_records, "")


class _Named:
    """A replica whose one table answers to the name that the trail has for it."""

    def __init__(self, target: VersionedTable, name: str):
        self._target, self._name = target, name
        self.pointer, self.claimed = target.pointer, target.replica.claimed

    def table(self, name: str) -> VersionedTable:
        return self._target

    def publish(self, staged: dict[str, Stored], *place) -> Pointer:
        return self._target.replica.publish({self._target.name: made for made in staged.values()}, *place)


def stream(spark: SparkSession, trail_path: str, target: VersionedTable, keys: Sequence[str], table: str, checkpoint: str, files_per_batch: int = 16, **options):
    """A Structured Streaming query over a trail's segments.

    A micro-batch only says that there is more to apply: what it applies is read from the trail by the table's
    own cursor, so that records held back in one batch are there for the next, and a restart finds its place.
    """
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", files_per_batch).load(f"{trail_path}/segment-*.jsonl")
    source = Trail(spark, trail_path)

    def apply(_: DataFrame, __: int) -> None:
        replicate(source, target, keys, table, **options)

    return lines.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)


def reconcile(target: VersionedTable, source_keys: DataFrame, keys: Sequence[str], stream: str = "") -> int:
    """Delete stored rows whose key the source no longer has; returns how many there were.  Only their buckets are written."""
    wanted, now, stored = source_keys.select(*keys), target.pointer().applied(stream), target.stored()
    gone = target.read().join(wanted, list(keys), "left_anti")
    by = gone.groupBy(target.replica.bucket_of(list(stored.keys), stored.count).alias("b")).count().collect()
    if by:
        touched = [r["b"] for r in by]
        with target.replica.claimed():
            made = target.stage(target.read(touched).join(wanted, list(keys), "left_semi"), stored.keys, touched)
            target.replica.publish({target.name: made}, now.batch + 1, now.cursor, stream, now)
    return sum(r["count"] for r in by)


__all__ = ["AnotherTrail", "Outage", "TRAIL_SCHEMA", "applicable", "apply_tables", "isolated", "reasons", "reconcile", "releasable", "replicate", "replicate_all", "stream", "typed_changes"]

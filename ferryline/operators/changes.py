"""An ordered stream of row changes: its classification, its segments, and its effect on a stored table.

A change has an order (a whole number), an op (I, U, D), a key, and an image of some columns.  A column that
the image lacks keeps its stored value; one that it has, null or not, is set.  Images are maps: a missing
key and a null value are different.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import linked
from .ordered import runs

#: A change: see the module's docstring.  txn_end marks the last change of a tagged transaction.
CHANGE = T.StructType([
    T.StructField("ord", T.LongType()), T.StructField("op", T.StringType()), T.StructField("table_name", T.StringType()),
    T.StructField("key", T.MapType(T.StringType(), T.StringType())), T.StructField("after", T.MapType(T.StringType(), T.StringType())),
    T.StructField("before_key", T.MapType(T.StringType(), T.StringType())),
    T.StructField("base", T.DecimalType(20, 0)), T.StructField("seq", T.LongType()),
    T.StructField("txn_id", T.LongType()), T.StructField("txn_end", T.BooleanType()),
])


def kind_of(op: Column, moved: Column, complete: Column) -> Column:
    """delete, keymove (whatever its image), full or partial."""
    return F.when(op == "D", "delete").when(moved, "keymove").when(complete, "full").otherwise("partial")


def after_tail(df: DataFrame, base: Column, seq: Column, tail: tuple[int, int] | None, resume: tuple[int, int] | None = None) -> DataFrame:
    """Changes past the last one stored; those without a position always stay.

    If the stored tail is behind where the reader resumes, nothing can be a repeat and all stay.
    """
    if tail is None or (resume is not None and tail < resume):
        return df
    past = (base > tail[0]) | ((base == tail[0]) & (seq > tail[1]))
    return df.filter(base.isNull() | past)


def check_epoch(tail: tuple[int, int] | None, end: int | None) -> None:
    """A stored position ahead of the stream's end belongs to another stream."""
    if tail is not None and end is not None and tail[0] > end:
        raise ValueError(f"stored position {tail[0]} is ahead of the stream's end {end}: the source was reset")


def transaction_ends(df: DataFrame, txn: str, order: str) -> DataFrame:
    """Rows with is_last: the last of its transaction.  Rows without a transaction end none."""
    tagged = df.filter(F.col(txn).isNotNull())
    last = tagged.groupBy(txn).agg(F.max(order).alias("__last"))
    ends = tagged.join(last, txn).withColumn("is_last", F.col(order) == F.col("__last")).drop("__last").select(*df.columns, "is_last")
    return ends.union(df.filter(F.col(txn).isNull()).withColumn("is_last", F.lit(False)))


def with_hold(df: DataFrame, txn: str, end: str, order: str) -> DataFrame:
    """Rows with held: the stream's last transaction is tagged and lacks its end.

    What is known of the last transaction is one row, a scalar subquery.
    """
    ends = df.groupBy(txn).agg(F.max(order).alias("__at"), F.max(F.col(end).cast("int")).alias("__ended"))
    tail = ends.agg(F.max_by(F.struct(txn, "__ended"), "__at").alias("__tail")).scalar()
    hold = F.col("__tail").getField(txn).eqNullSafe(F.col(txn)) & F.col(txn).isNotNull() & (F.coalesce(F.col("__tail.__ended"), F.lit(0)) == 0)
    return df.withColumn("__tail", tail).withColumn("held", hold).drop("__tail")


def held_of(df: DataFrame, txn: str, end: str, order: str) -> Column:
    """Whether a row is held, as with_hold says it, with what is known of the last transaction found at once."""
    at, own = F.struct(F.col(order), F.col(txn).alias("t")), F.col(txn)
    last = df.agg(F.max(at).alias("last")).first()["last"]
    if last is None or last["t"] is None:
        return F.lit(False)
    mine = own == last["t"]
    ended = df.filter(mine).agg(F.max(F.col(end).cast("int"))).first()[0]
    return F.lit(False) if ended else F.coalesce(mine, F.lit(False))


def with_open(df: DataFrame, txn: str, end: str) -> DataFrame:
    """Rows with held: their transaction lacks its end, whatever follows it.  For streams in which transactions interleave."""
    tagged = df.filter(F.col(txn).isNotNull())
    ended = tagged.groupBy(txn).agg(F.coalesce(F.max(F.col(end).cast("int")), F.lit(0)).alias("__ended"))
    rows = tagged.join(ended, txn).withColumn("held", F.col("__ended") == 0).select(*df.columns, "held")
    return rows.union(df.filter(F.col(txn).isNull()).withColumn("held", F.lit(False)))


#: Open transactions that are told by their numbers.
OPEN = 1000


def with_open_found(df: DataFrame, txn: str, end: str) -> DataFrame:
    """Rows with held, as with_open gives them, with the open transactions found at once: there are as many as are under way at a
    time, and rows are not joined for them unless they are more than a few."""
    ended = F.coalesce(F.max(F.col(end).cast("int")), F.lit(0)).alias("__ended")
    found = [r[0] for r in df.filter(F.col(txn).isNotNull()).groupBy(txn).agg(ended).filter("__ended = 0").select(txn).limit(OPEN + 1).collect()]
    if len(found) > OPEN:
        return with_open(df, txn, end)
    return df.withColumn("held", F.coalesce(F.col(txn).isin(found), F.lit(False)) if found else F.lit(False))


def interleave(df: DataFrame, txn: str, order: str) -> DataFrame:
    """A row for each transaction with other rows between its own; ``order`` numbers the rows without gaps."""
    spans = df.filter(F.col(txn).isNotNull()).groupBy(txn).agg((F.max(order) - F.min(order) + 1).alias("__span"), F.count("*").alias("__n"))
    return spans.filter("__span > __n").select(txn)


def apply_segments(df: DataFrame, txn: str, moved: str, order: str) -> DataFrame:
    """Rows with mode (atomic or barrier) and segment_id.

    A tagged transaction without a key move is applied as one; everything else between such transactions
    makes one barrier segment.
    """
    tagged, alone = df.filter(F.col(txn).isNotNull()), df.filter(F.col(txn).isNull())
    moves = tagged.groupBy(txn).agg(F.max(F.col(moved).cast("int")).alias("__moves"))
    known = tagged.join(moves, txn).withColumn("mode", F.when(F.col("__moves") == 0, "atomic").otherwise("barrier")).select(*df.columns, "mode")
    out = known.union(alone.withColumn("mode", F.lit("barrier"))).withColumn("__of", F.when(F.col("mode") == "atomic", F.col(txn)))
    return runs(out, order, ["mode", "__of"], "segment_id").drop("__of")


def fold(stored: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The stored table after a stream of deletes, full and partial changes.

    ``changes``: ord, kind (delete, full, partial), the keys, and for each other column a struct of its value,
    null where the image lacks it.  One pre-aggregated pass finds the last delete of each key and the last
    image of each column; what is newer than the delete counts.  Images of the key alone do nothing.
    """
    rest = [c for c in stored.columns if c not in keys]
    here = lambda c: F.col(f"__c_{c}")
    c = changes.select("ord", "kind", *keys, *[F.col(x).alias(f"__c_{x}") for x in rest])
    some = F.greatest(*[here(x).isNotNull().cast("int") for x in rest]) == 1 if len(rest) > 1 else here(rest[0]).isNotNull() if rest else F.lit(False)
    live = F.col("kind") != "delete"
    aggs = [F.max(F.when(~live, F.col("ord"))).alias("__gone"), F.max(F.when(live & ((F.col("kind") == "full") | some), F.col("ord"))).alias("__kept")]
    for x in rest:
        at = F.when(live & here(x).isNotNull(), F.col("ord"))
        aggs += [F.max(at).alias(f"__o_{x}"), F.max_by(here(x), at).alias(f"__v_{x}")]
    net = c.groupBy(*keys).agg(*aggs)
    base = stored.withColumn("__stored", F.lit(True))
    both = base.join(net, list(keys), "full_outer")
    gone = F.coalesce("__gone", F.lit(-1))
    fresh = F.coalesce(F.col("__kept") > gone, F.lit(False))
    stays = fresh | (F.col("__stored") & F.col("__gone").isNull())
    value = lambda x: F.when(F.coalesce(F.col(f"__o_{x}") > gone, F.lit(False)), F.col(f"__v_{x}")[x]).when(F.col("__gone").isNull(), F.col(x))
    return both.filter(F.coalesce(stays, F.lit(False))).select(*[F.col(x) if x in keys else value(x).alias(x) for x in stored.columns])


def net_changes(changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What a stream of deletes, full and partial changes comes to, in the same form: for a key its last delete and one image of
    what was set after it.  Folding these gives the same table, whatever it held before."""
    rest = [c for c in changes.columns if c not in (*keys, "ord", "kind", "old")]
    live = F.col("kind") != "delete"
    aggs = [F.max(F.when(~live, F.col("ord"))).alias("__gone"), F.max(F.when(F.col("kind") == "full", F.col("ord"))).alias("__full")]
    for x in rest:
        at = F.when(live & F.col(x).isNotNull(), F.col("ord"))
        aggs += [F.max(at).alias(f"__o_{x}"), F.max_by(F.col(x), at).alias(f"__v_{x}")]
    net = changes.groupBy(*keys).agg(*aggs)
    after = lambda c: F.when(F.col(c) > F.coalesce("__gone", F.lit(-1)), F.col(c))
    last = [after("__full"), *[after(f"__o_{x}") for x in rest]]
    at = F.greatest(*last) if rest else last[0]
    images = [F.when(after(f"__o_{x}").isNotNull(), F.col(f"__v_{x}")).alias(x) for x in rest]
    kinds = {x: changes.schema[x].dataType for x in rest}
    delete = F.struct(F.col("__gone").alias("ord"), F.lit("delete").alias("kind"), *[F.lit(None).cast(kinds[x]).alias(x) for x in rest])
    image = F.struct(at.alias("ord"), F.when(after("__full").isNotNull(), "full").otherwise("partial").alias("kind"), *images)
    both = F.array_compact(F.array(F.when(F.col("__gone").isNotNull(), delete), F.when(at.isNotNull(), image)))
    return net.select(*keys, F.explode(both).alias("r")).select("r.ord", "r.kind", *keys, *[F.col(f"r.{x}").alias(x) for x in rest])


def replay(rows: dict, changes: Sequence[dict], columns: Sequence[str], keys: Sequence[str]) -> dict:
    """Changes applied one by one to rows by key tuple (each a dict by column); the model of fold and key moves."""
    for c in changes:
        key = tuple(c["key"][k] for k in keys)
        image = {x: v for x, v in (c["after"] or {}).items() if x in columns}
        rest = {x: v for x, v in image.items() if x not in keys}
        if c["kind"] == "delete":
            rows.pop(key, None)
        elif c["kind"] == "full":
            rows[key] = {x: image.get(x) for x in columns}
        elif c["kind"] == "partial":
            if not rest:
                continue
            row = rows.get(key) or dict.fromkeys(columns) | dict(zip(keys, key))
            rows[key] = row | rest
        else:
            old = tuple(c["before_key"][k] for k in keys)
            row = rows.pop(old, None) or rows.get(key) or dict.fromkeys(columns)
            rows[key] = row | rest | dict(zip(keys, key))
    return rows


def _linked_by_moves(stored: DataFrame, changes: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(stored, changes, moved): both tagged with the root of the keys that moves link to theirs (null for others), and the rows
    that the linked ones come to.

    Keys that moves link, directly or by a chain, form small groups; each group lies whole in one bucket, and a
    bucket is replayed in order with its stored rows.
    """
    rest = [c for c in stored.columns if c not in keys]
    name = lambda *cols: F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})
    own, before = name(*keys), name(*[F.col(f"old.{k}").alias(k) for k in keys])
    moves = changes.filter("kind = 'keymove'").select(before.alias("u"), own.alias("v"))
    groups = linked(moves)  # (node, root), a row for every key that takes part in a move
    tag = lambda df: df.withColumn("node", own).join(groups, "node", "left").drop("node")
    s, c = tag(stored), tag(changes)
    kept = [f.name for f in stored.schema.fields]
    schema = stored.schema
    tasks = max(stored.sparkSession.sparkContext.defaultParallelism, int(stored.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bucket = F.pmod(F.xxhash64("root"), F.lit(16 * tasks)).cast("int").alias("bucket")
    moved_rows = s.filter("root IS NOT NULL").select(bucket, F.lit(-1).cast("bigint").alias("ord"), F.lit("stored").alias("kind"), F.struct(*keys).alias("key"), F.struct(*keys).alias("old"), *[F.struct(F.col(x)).alias(f"c_{x}") for x in rest])
    moved_changes = c.filter("root IS NOT NULL").select(bucket, "ord", "kind", F.struct(*keys).alias("key"), F.coalesce("old", F.struct(*keys)).alias("old"), *[F.col(x).alias(f"c_{x}") for x in rest])

    def one(group: pa.Table) -> pa.Table:
        rows, todo = {}, []
        kinds = {f.name: f.type for f in group.schema.field("key").type} | {x: group.schema.field(f"c_{x}").type.field(0).type for x in rest}
        for r in group.sort_by("ord").to_pylist():
            image = {x: r[f"c_{x}"][x] for x in rest if r[f"c_{x}"] is not None} | r["key"]
            if r["kind"] == "stored":
                rows[tuple(r["key"][k] for k in keys)] = image
            else:
                todo.append({"kind": r["kind"], "key": r["key"], "before_key": r["old"], "after": image})
        return pa.Table.from_pylist(list(replay(rows, todo, kept, keys).values()), pa.schema([(x, kinds[x]) for x in kept]))

    dealt = moved_rows.unionByName(moved_changes).repartition(tasks, "bucket")  # few bytes, but much work: not to be put together
    return s, c, dealt.groupBy("bucket").applyInArrow(one, schema)


def fold_with_moves(stored: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The stored table after a stream that also moves rows to other keys.

    ``changes``: ord, kind, the keys, old (struct of the keys before a move, else null), and structs as for
    fold.  Only keys that moves link are replayed in order; all others go through fold.  Replaying a batch on the version
    it started from gives the same result, which is how a retried batch is made safe (see streaming.versions).
    """
    s, c, moved = _linked_by_moves(stored, changes, keys)
    plain = fold(s.filter("root IS NULL").drop("root"), c.filter("root IS NULL AND kind <> 'keymove'"), keys)
    return plain.select(*stored.columns).unionByName(moved)


def without_moves(stored: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same changes without key moves: keys that moves link are deleted, and the rows that they come to are set.

    ``stored`` has to have the rows of these keys; others in it are not looked at.
    """
    s, c, moved = _linked_by_moves(stored, changes, keys)
    rest = [x for x in stored.columns if x not in keys]
    fields = ["ord", "kind", *keys, *rest]
    plain = c.filter("root IS NULL AND kind <> 'keymove'").select(*fields)
    part = c.filter("root IS NOT NULL")
    ends = part.select(*keys).union(part.filter("old IS NOT NULL").select(*[F.col(f"old.{k}") for k in keys])).distinct()
    kinds = {x: changes.schema[x].dataType for x in ("ord", *rest)}
    at = lambda i: F.lit(i).cast(kinds["ord"]).alias("ord")
    gone = ends.select(at(0), F.lit("delete").alias("kind"), *keys, *[F.lit(None).cast(kinds[x]).alias(x) for x in rest])
    full = moved.select(at(1), F.lit("full").alias("kind"), *keys, *[F.struct(F.col(x)).alias(x) for x in rest])
    return plain.unionByName(gone).unionByName(full)


def in_commit_order(df: DataFrame, txn: str, order: str, name: str = "ord") -> DataFrame:
    """Rows with a number that orders them as they took effect: by the last row of their transaction, then as they stand.

    For streams in which transactions interleave; untagged rows take effect where they stand.
    """
    last = F.col("__last").cast("decimal(19,0)") * F.lit(10**18).cast("decimal(19,0)")
    tagged = df.filter(F.col(txn).isNotNull())
    ends = tagged.groupBy(txn).agg(F.max(order).alias("__last"))
    own = df.filter(F.col(txn).isNull()).withColumn("__last", F.col(order))
    rows = tagged.join(ends, txn).select(*df.columns, "__last").union(own.select(*df.columns, "__last"))
    return rows.withColumn(name, (last + F.col(order)).cast("decimal(38,0)")).drop("__last")


def dead_letters(df: DataFrame, valid: Column, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(good, bad): changes that can be applied and those to park.  More than ``most`` bad ones raise."""
    ok = F.coalesce(valid, F.lit(False))
    good, bad = df.filter(ok), df.filter(~ok)
    if most is not None and (n := bad.limit(most + 1).count()) > most:
        raise ValueError(f"more than {most} changes can't be applied ({n} found): stopped before anything was written")
    return good, bad

"""Queries over captures, applied to replicas of the driver's tables, and their DuckDB twins."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import sinks
from ..operators.chunks import plan_chunks
from ..operators.graph import shared_root
from ..sources.decoding import tasks_of
from ..sources.slot import Recording
from ..sources.tables import table
from ..sources.trail import Trail
from ..streaming import replicate
from ..streaming.versions import Replica
from . import ledger

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str):
    """Registers a query under its function's name, with its SQL."""
    def put(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return put


def _place(spark, name: str) -> str:
    return f"{shared_root(spark)}/ferryline-{name}-{uuid.uuid4().hex[:12]}"


def _records(df: DataFrame, order: str, of: Column, op: Column, key: str, txn: Column | None = None, end: Column | None = None) -> DataFrame:
    """Records of a trail from rows: all columns but the order, deletes without them."""
    text = lambda c: F.col(c).cast("string")
    cols = [c for c in df.columns if not c.startswith("_")]
    after = F.create_map(*[x for c in cols for x in (F.lit(c), text(c))])
    none = F.lit(None)
    return df.select(F.col(order).cast("bigint").alias("ord"), op.alias("op"), of.alias("table"), F.create_map(F.lit(key), text(key)).alias("key"), F.when(op != "D", after).alias("after"), (none.cast("bigint") if txn is None else txn).alias("txn_id"), (none.cast("boolean") if end is None else end).alias("txn_end"))


def _empty(replica: Replica, **tables: DataFrame) -> None:
    """Tables without rows, keyed by their first columns."""
    with replica.claimed():
        replica.publish({n: replica.stage(n, df.limit(0), [df.columns[0]]) for n, df in tables.items()}, 0, 0)


@query("""SELECT 'orders' AS table_name, o_orderkey AS row_key, o_custkey AS value, 'one' AS stream, (SELECT count(*) FROM orders) AS applied, 0::BIGINT AS behind FROM orders
UNION ALL SELECT 'customers', c_custkey, c_nationkey, 'two', (SELECT count(*) FROM customer) + (SELECT count(*) FROM customer WHERE c_custkey % 4 = 0), 0 FROM customer WHERE c_custkey % 4 <> 0""")
def two_captures(spark, sf):
    """Two captures, each with a trail of its own, into one replica, by turns: one is applied, then the other in two parts.
    Each trail is purged by its own cursor in between, which must not cost the other a record."""
    root = _place(spark, "captures")
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_key"), F.col("o_custkey").alias("value"))
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("row_key"), F.col("c_nationkey").alias("value"))
    one, two, replica = Trail(spark, f"{root}/one", 1 << 20), Trail(spark, f"{root}/two", 1 << 20), Replica(spark, f"{root}/replica", buckets=4)
    _empty(replica, orders=orders, customers=customers)
    write = lambda trail, df, name, op: trail.append_frame(_records(df, "row_key", F.lit(name), F.lit(op), "row_key"), "ord")
    write(one, orders, "orders", "U")
    write(two, customers, "customers", "I")
    tables = {"one": ("orders", one), "two": ("customers", two)}
    for stream in ("one", "two"):
        name, trail = tables[stream]
        replicate.replicate_all(trail, replica, {name: ["row_key"]}, 1 << 20, stream)
        for other, (_, at) in tables.items():
            at.purge(replica.pointer().applied(other).cursor)
    write(two, customers.filter("row_key % 4 = 0"), "customers", "D")
    replicate.replicate_all(two, replica, {"customers": ["row_key"]}, 1 << 20, "two")
    out = []
    for stream, (name, trail) in tables.items():
        done = replica.pointer().applied(stream).cursor
        out.append(replica.table(name).read().select(F.lit(name).alias("table_name"), "row_key", "value", F.lit(stream).alias("stream"), F.lit(done).cast("bigint").alias("applied"), F.lit(trail.last_seq() - done).cast("bigint").alias("behind")))
    return out[0].union(out[1])


_MIXED = """t AS (SELECT event_id, user_id, value, row_number() OVER (ORDER BY event_id) AS n, (SELECT count(*) FROM events) AS total FROM events),
x AS (SELECT *, CASE WHEN n % 11 = 0 THEN NULL ELSE (n // 70) * 7 + n % 7 END AS txn FROM t),
e AS (SELECT *, max(n) OVER (PARTITION BY txn) AS last, (total // 70) * 7 AS open_from FROM x)"""


@query(f"""WITH {_MIXED}, d AS (SELECT *, CASE WHEN txn IS NULL THEN n ELSE last END AS done FROM e WHERE txn IS NULL OR txn < open_from)
SELECT user_id, arg_max(event_id, done * 1000000000 + n) AS last_event, max(done * 1000000000 + n) AS took_effect,
  (SELECT min(n) - 1 FROM e WHERE txn >= open_from) AS cursor FROM d GROUP BY user_id""")
def interleaved_transactions(spark, sf):
    """A trail in which seven transactions at a time interleave, and untagged changes stand between; those of the last block are
    open.  It is written in two parts, cut inside transactions, and applied in batches that cut them too."""
    root = _place(spark, "interleaved")
    from ..operators.ordered import running_sum

    e = running_sum(table(spark, sf, "events").select("event_id", "user_id"), "event_id", F.lit(1), "n")
    total = e.agg(F.max("n")).scalar()
    n = F.col("n")
    txn = F.when(n % 11 != 0, F.call_function("div", n, F.lit(70)) * 7 + n % 7)
    e = e.withColumns({"_txn": txn, "_open": F.call_function("div", total, F.lit(70)) * 7, "_total": total})
    ends = e.filter("_txn IS NOT NULL").groupBy("_txn").agg(F.max("n").alias("_last"))
    e = e.join(ends, "_txn", "left").withColumn("took_effect", F.coalesce("_last", n).cast("bigint") * 1_000_000_000 + n)
    rows = e.select("user_id", F.col("event_id").alias("last_event"), "took_effect", n.alias("_n"), "_txn", ((n == F.col("_last")) & (F.col("_txn") < F.col("_open"))).alias("_end"), "_total")
    trail, replica = Trail(spark, f"{root}/trail"), Replica(spark, f"{root}/replica", buckets=4)
    _empty(replica, users=rows.select("user_id", "last_event", "took_effect"))
    first = F.col("_n") <= F.call_function("div", F.col("_total"), F.lit(2)) + 3
    for part in (rows.filter(first), rows.filter(~first)):
        trail.append_frame(_records(part.drop("_total"), "_n", F.lit("users"), F.lit("U"), "user_id", F.col("_txn"), F.col("_end")), "ord")
        replicate.replicate_all(trail, replica, {"users": ["user_id"]}, max(1000, trail.last_seq() // 3), mixed=True)
    return replica.table("users").read().withColumn("cursor", F.lit(replica.pointer().cursor).cast("bigint"))


@query("""WITH c AS (SELECT user_id * 32 + event_id % 32 AS k, event_id, CAST(floor(value * 100) AS BIGINT) AS cents FROM events),
n AS (SELECT k, max(event_id) AS last, arg_max(cents, event_id) AS cents, max(event_id) FILTER (event_id % 5 = 0) AS gone FROM c GROUP BY k)
SELECT coalesce(o.o_orderkey, n.k) AS row_key, CASE WHEN n.k IS NULL OR n.gone IS NULL THEN o.o_custkey END AS customer, coalesce(CASE WHEN n.last > coalesce(n.gone, -1) THEN n.cents END, CASE WHEN n.gone IS NULL THEN 0 END)::BIGINT AS cents
FROM orders o FULL JOIN n ON o.o_orderkey = n.k WHERE n.k IS NULL OR n.gone IS NULL OR n.last > n.gone""")
def delta_apply(spark, sf):
    """Orders under six batches of updates of one column, inserts and deletes, laid on as deltas, read with all of them."""
    root = _place(spark, "deltas")
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_key"), F.col("o_custkey").alias("customer"), F.lit(0).cast("bigint").alias("cents"))
    replica, trail = Replica(spark, f"{root}/replica", buckets=4, small_bytes=0), Trail(spark, f"{root}/trail")
    with replica.claimed():
        replica.publish({"orders": replica.stage("orders", orders, ["row_key"])}, 0, 0)
    e = table(spark, sf, "events").select((F.col("user_id") * 32 + F.col("event_id") % 32).alias("row_key"), F.floor(F.col("value") * 100).cast("bigint").alias("cents"), F.col("event_id").alias("_n"))
    trail.append_frame(_records(e, "_n", F.lit("orders"), F.when(F.col("_n") % 5 == 0, "D").otherwise("U"), "row_key"), "ord")
    replicate.replicate_all(trail, replica, {"orders": ["row_key"]}, -(-trail.last_seq() // 6))
    return replica.table("orders").read()


_WIDE = "1152921504606846977 + o_orderkey * 3"


@query(f"""WITH w AS (SELECT {_WIDE} AS k, o_custkey FROM orders), b AS (SELECT min(k) AS lo, max(k) AS hi, (max(k) - min(k) + 1 + 36) // 37 AS step FROM w)
SELECT k AS wide_key, o_custkey, (k - lo) // step AS chunk_no FROM w, b""")
def wide_key_chunks(spark, sf):
    """Orders under keys past 2**60, loaded by 37 ranges of them: every row is in the folder of its own range."""
    root = _place(spark, "wide")
    rows = table(spark, sf, "orders").select((F.lit(1152921504606846977) + F.col("o_orderkey") * 3).alias("wide_key"), "o_custkey")
    lo, hi = rows.agg(F.min("wide_key"), F.max("wide_key")).first()
    book = ledger.Ledger(spark, f"{root}/ledger.json")
    book.plan("wide", "", {"orders": plan_chunks("orders", "wide_key", (lo, hi), 37)})
    sinks.load(book, "orders", rows, f"{root}/orders")
    return spark.read.parquet(f"{root}/orders").select("wide_key", "o_custkey", F.split("chunk_id", ":")[1].cast("bigint").alias("chunk_no"))


# ---- logs ----------------------------------------------------------------------------------


def _recorded(spark, path: str, number: int, lines: DataFrame) -> None:
    """Put lines (ord, data) into a recording in their order, as peeks of whole transactions that as many tasks write; each file
    is renamed into its place."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    lsn = F.concat(F.upper(F.hex(number * (1 << 16) + F.shiftright("ord", 32))), F.lit("/"), F.upper(F.hex(F.col("ord").bitwiseAND(F.lit((1 << 32) - 1)))))
    txn = F.call_function("div", F.col("ord"), F.lit(TXN))
    rows = lines.repartitionByRange(tasks_of(spark), txn).sortWithinPartitions("ord").select(F.to_json(F.struct(lsn.alias("lsn"), "data")).alias("value"))
    rows.write.text(temp := f"{path}/.part-{number}")
    made = sorted((x.getPath().getName(), x.getPath()) for x in fs.listStatus(at(temp)) if x.getPath().getName().startswith("part-") and x.getLen())
    done = max(Recording(path).numbers(), default=0)
    for n, (_, file) in enumerate(made, done + 1):
        fs.rename(file, at(f"{path}/changes-{n:010d}.jsonl"))
    fs.delete(at(temp), True)


#: Places that a transaction takes in the order of a log.
TXN = 200


def _transactions(rows: DataFrame, change: Column) -> DataFrame:
    """(ord, data): a change for each row (k), in transactions of 50 keys, as logical decoding prints them."""
    txn = F.call_function("div", F.col("k"), F.lit(50))
    ids = rows.select(txn.alias("x")).distinct()
    line = lambda at, text: ids.select((F.col("x") * TXN + at).alias("ord"), F.concat(F.lit(text), F.col("x").cast("string")).alias("data"))
    return line(0, "BEGIN ").union(rows.select((F.col("k") * 4 + 1).alias("ord"), F.concat(F.lit("table public.orders: "), change).alias("data"))).union(line(TXN - 1, "COMMIT "))


@query("""SELECT CASE WHEN o_orderkey % 9 = 0 THEN -o_orderkey - 1 ELSE o_orderkey END AS row_key, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey + 1000000 ELSE o_custkey END AS customer,
  (SELECT count(*) + count(*) FILTER (o_orderkey % 3 = 0) + count(*) FILTER (o_orderkey % 5 = 1 AND o_orderkey % 3 <> 0) FROM orders) AS captured FROM orders WHERE NOT (o_orderkey % 5 = 1 AND o_orderkey % 3 <> 0)""")
def log_capture(spark, sf):
    """Orders as inserts in a recorded log, then updates (some move their key) and deletes.  The first part is captured, the slot
    and the stream's state are lost before they are saved, and all is captured again: the trail repeats nothing."""
    from ..streaming import capture

    root = _place(spark, "log")
    k = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), "o_custkey")
    row = lambda key, c: F.concat(F.lit("row_key[bigint]:"), key.cast("string"), F.lit(" customer[bigint]:"), c.cast("string"))
    key, customer = F.col("k"), F.col("o_custkey")
    _recorded(spark, f"{root}/log", 1, _transactions(k, F.concat(F.lit("INSERT: "), row(key, customer))))
    trail, keys = Trail(spark, f"{root}/trail"), {"orders": ["row_key"]}
    capture.capture(spark, f"{root}/log", "first", trail, keys, f"{root}/lost")
    moved = F.when(key % 9 == 0, F.concat(F.lit("UPDATE: old-key: row_key[bigint]:"), key.cast("string"), F.lit(" new-tuple: "), row(-key - 1, customer + 1_000_000)))
    _recorded(spark, f"{root}/log", 2, _transactions(k.filter("k % 3 = 0"), F.coalesce(moved, F.concat(F.lit("UPDATE: "), row(key, customer + 1_000_000)))))
    _recorded(spark, f"{root}/log", 3, _transactions(k.filter("k % 5 = 1 AND k % 3 <> 0"), F.concat(F.lit("DELETE: row_key[bigint]:"), key.cast("string"))))
    capture.capture(spark, f"{root}/log", "second", trail, keys, f"{root}/state")
    replica = Replica(spark, f"{root}/replica", buckets=4)
    _empty(replica, orders=k.select(key.alias("row_key"), customer.alias("customer")))
    replicate.replicate_all(trail, replica, keys, 1 << 20, "log")
    return replica.table("orders").read().withColumn("captured", F.lit(trail.last_seq()).cast("bigint"))

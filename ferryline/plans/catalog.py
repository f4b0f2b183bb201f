"""The registered queries and their DuckDB twins.

Copies, changes and ledgers are derived from the driver's tables by the same rules on both sides.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import render
from ..operators import changes, chunks, compare, merge, ordered, sinks
from ..operators.graph import shared_root
from ..sources.tables import table
from ..sources.trail import Trail
from ..streaming import replicate
from ..streaming.versions import Replica
from . import capture_catalog, ledger, metadata_catalog, rewrite
from .sqltwin import digest

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None):
    """Registers a query under its function's name, with its SQL."""
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


# ---- derived inputs -----------------------------------------------------------------------------

_ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
_LINES = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
_ORDERS_DIGEST = digest(o_orderkey="n", o_custkey="n", o_orderstatus="s", o_totalprice="d", o_orderdate="t", o_orderpriority="s")
_LINES_DIGEST = digest(l_orderkey="n", l_partkey="n", l_suppkey="n", l_linenumber="n", l_quantity="d", l_extendedprice="d", l_discount="d", l_tax="d", l_returnflag="s", l_linestatus="s", l_shipdate="t")
_COPY_SQL = f"""copy AS (
  SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 89 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 97 <> 0
  UNION ALL SELECT o_orderkey + 10000000, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 101 = 0),
s AS (SELECT o_orderkey, {_ORDERS_DIGEST} AS d FROM orders), t AS (SELECT o_orderkey, {_ORDERS_DIGEST} AS d FROM copy),
st AS (SELECT coalesce(s.o_orderkey, t.o_orderkey) AS o_orderkey, CASE WHEN t.d IS NULL THEN 'missing' WHEN s.d IS NULL THEN 'extra' WHEN s.d = t.d THEN 'matched' ELSE 'changed' END AS status FROM s FULL JOIN t ON s.o_orderkey = t.o_orderkey)"""


def orders_copy(spark, sf) -> DataFrame:
    """Orders without some rows, with some prices changed and some rows more."""
    o = table(spark, sf, "orders").select(*_ORDERS)
    kept = o.filter(F.col("o_orderkey") % 97 != 0).withColumn("o_totalprice", F.when(F.col("o_orderkey") % 89 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return kept.union(o.filter(F.col("o_orderkey") % 101 == 0).withColumn("o_orderkey", F.col("o_orderkey") + 10_000_000))


def order_status(spark, sf, sample: int = 0) -> DataFrame:
    return compare.keyed(table(spark, sf, "orders").select(*_ORDERS), orders_copy(spark, sf), ["o_orderkey"], scale=4, sample=sample)


def event_changes(spark, sf) -> DataFrame:
    """Events as a change stream: an operation, a transaction of seven events, a position."""
    e = table(spark, sf, "events")
    i = F.col("event_id")
    op = F.when(i % 11 == 0, "D").when(i % 3 == 0, "I").otherwise("U")
    kind = changes.kind_of(op, i % 29 == 1, i % 3 != 1)
    return e.select(i, "user_id", "value", "event_type", op.alias("op"), kind.alias("kind"), F.floor(i / 7).cast("bigint").alias("txn_id"), F.floor(i / 5).cast("bigint").alias("base"))


_CHANGES = """ch AS (SELECT event_id, user_id, value, event_type, CASE WHEN event_id % 11 = 0 THEN 'D' WHEN event_id % 3 = 0 THEN 'I' ELSE 'U' END AS op,
  CASE WHEN event_id % 11 = 0 THEN 'delete' WHEN event_id % 29 = 1 THEN 'keymove' WHEN event_id % 3 <> 1 THEN 'full' ELSE 'partial' END AS kind,
  event_id // 7 AS txn_id, event_id // 5 AS base FROM events)"""

# ---- chunks and loads -------------------------------------------------------------------------------


@query("SELECT min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders")
def pk_bounds(spark, sf):
    return chunks.key_bounds(table(spark, sf, "orders"), "o_orderkey")


_CHUNKED = """b AS (SELECT min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders),
p AS (SELECT lo, hi, CAST(ceil((hi - lo + 1) / greatest(1, least(8, hi - lo + 1))) AS BIGINT) AS step FROM b)"""


@query(f"""WITH {_CHUNKED} SELECT (o_orderkey - lo) // step AS chunk_no, 'orders:' || ((o_orderkey - lo) // step) AS chunk_id,
  lo + (o_orderkey - lo) // step * step AS lo, least(lo + (o_orderkey - lo) // step * step + step, hi + 1) AS hi, count(*) AS chunk_rows FROM orders, p GROUP BY ALL""")
def pk_range_chunks(spark, sf):
    o = table(spark, sf, "orders")
    cut = chunks.with_chunks(o.select("o_orderkey"), "o_orderkey", chunks.key_bounds(o, "o_orderkey"), 8)
    out = cut.groupBy("chunk_no", "lo", "hi").agg(F.count(F.lit(1)).alias("chunk_rows"))
    return out.withColumn("chunk_id", F.concat(F.lit("orders:"), F.col("chunk_no").cast("string")))


@query("""WITH b AS (SELECT min(l_orderkey) AS lo, max(l_orderkey) AS hi FROM lineitem),
p AS (SELECT lo, CAST(ceil((hi - lo + 1) / greatest(1, least(16, hi - lo + 1))) AS BIGINT) AS step FROM b)
SELECT (l_orderkey - lo) // step AS chunk_no, count(*) AS chunk_rows, CAST(sum(CAST(l_quantity AS DECIMAL(18, 2))) AS DECIMAL(28, 2)) AS quantity FROM lineitem, p GROUP BY 1""")
def chunk_load_summary(spark, sf):
    li = table(spark, sf, "lineitem")
    cut = chunks.with_chunks(li.select("l_orderkey", "l_quantity"), "l_orderkey", chunks.key_bounds(li, "l_orderkey"), 16)
    return cut.groupBy("chunk_no").agg(F.count(F.lit(1)).alias("chunk_rows"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("decimal(28,2)").alias("quantity"))


@query(f"""WITH {_COPY_SQL} SELECT o_orderkey // 1000 AS chunk_no, count(*) FILTER (status <> 'extra') AS src_rows, count(*) FILTER (status <> 'missing') AS tgt_rows,
  count(*) FILTER (status = 'matched') AS matched, count(*) FILTER (status = 'changed') AS changed, count(*) FILTER (status = 'missing') AS missing, count(*) FILTER (status = 'extra') AS extra FROM st GROUP BY 1""")
def chunk_parity_report(spark, sf):
    return compare.chunk_report(order_status(spark, sf), F.floor(F.col("o_orderkey") / 1000).cast("bigint"))


_LEDGER_SQL = """l AS (SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'orders_b' WHEN o_orderkey % 3 = 0 THEN 'orders_a' ELSE 'orders_c' END AS table_name, o_orderkey // 100 AS chunk_no,
  count(*) AS planned FROM orders GROUP BY ALL),
k AS (SELECT table_name, chunk_no, planned, CASE WHEN table_name = 'orders_b' THEN 'pending' WHEN table_name = 'orders_c' OR chunk_no % 4 IN (0, 1) THEN 'loaded' WHEN chunk_no % 4 = 2 THEN 'in_progress' ELSE 'failed' END AS state FROM l)"""


@query(f"""WITH {_LEDGER_SQL}, a AS (SELECT table_name, count(*) AS chunks_total, count(*) FILTER (state IN ('loaded', 'verified')) AS chunks_loaded, count(*) FILTER (state = 'in_progress') AS chunks_running,
  count(*) FILTER (state = 'failed') AS chunks_failed, coalesce(sum(planned) FILTER (state IN ('loaded', 'verified')), 0)::BIGINT AS rows_loaded, sum(planned)::BIGINT AS rows_planned FROM k GROUP BY 1
  UNION ALL SELECT 'orders_without_chunks', 0, 0, 0, 0, 0, NULL)
SELECT *, CASE WHEN chunks_failed > 0 THEN 'failed' WHEN chunks_total > 0 AND chunks_loaded = chunks_total THEN 'loaded' WHEN chunks_running > 0 OR chunks_loaded > 0 THEN 'in_progress' ELSE 'pending' END AS status,
  CAST(100 * chunks_loaded // greatest(chunks_total, 1) AS BIGINT) AS percent FROM a""")
def progress_snapshot(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    name = F.when(k % 5 == 0, "orders_b").when(k % 3 == 0, "orders_a").otherwise("orders_c")
    rows = o.groupBy(name.alias("table_name"), F.floor(k / 100).cast("bigint").alias("chunk_no")).agg(F.count(F.lit(1)).alias("planned"))
    n = F.col("chunk_no") % 4
    state = F.when(F.col("table_name") == "orders_b", "pending").when((F.col("table_name") == "orders_c") | n.isin(0, 1), "loaded").when(n == 2, "in_progress").otherwise("failed")
    tables = spark.createDataFrame([(f"orders_{x}",) for x in ("a", "b", "c", "without_chunks")], "table_name string")
    return ledger.progress(rows.withColumn("state", state), tables)


# ---- validation -----------------------------------------------------------------------------------


@query(f"SELECT c_custkey, {digest(c_custkey='n', c_name='s', c_nationkey='n', c_acctbal='d', c_mktsegment='s')} AS digest FROM customer")
def row_checksum(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    return c.select("c_custkey", render.row_checksum(c, scale=4).alias("digest"))


@query(f"WITH {_COPY_SQL} SELECT 'orders' AS table_name, (SELECT count(*) FROM s) AS source_rows, (SELECT count(*) FROM t) AS target_rows, (SELECT count(*) FROM t) - (SELECT count(*) FROM s) AS delta, (SELECT count(*) FROM t) = (SELECT count(*) FROM s) AS matched")
def test_count(spark, sf):
    return compare.counts(table(spark, sf, "orders"), orders_copy(spark, sf), "orders")


@query("""SELECT 'orders' AS table_name, 6 AS source_columns, 6 AS target_columns, NULL::VARCHAR AS severity, NULL::VARCHAR AS message
UNION ALL SELECT 'nation', 3, 2, 'BLOCKER', 'column count differs (source=3, target=2)' UNION ALL SELECT 'part', 6, NULL, 'BLOCKER', 'table is missing'""")
def test_structure(spark, sf):
    nation = table(spark, sf, "nation")
    return compare.structure(table(spark, sf, "orders"), orders_copy(spark, sf), "orders").union(compare.structure(nation, nation.drop("n_regionkey"), "nation")).union(compare.structure(table(spark, sf, "part"), None, "part"))


@query(f"WITH {_COPY_SQL} SELECT status, count(*) AS status_rows FROM st GROUP BY status")
def test_data_keyed(spark, sf):
    return order_status(spark, sf).groupBy("status").agg(F.count(F.lit(1)).alias("status_rows"))


@query(f"""WITH c AS (SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer),
k AS (SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey % 7 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 50 <> 0),
s AS (SELECT c_custkey, {digest(c_custkey='n', c_name='s', c_nationkey='n', c_acctbal='d', c_mktsegment='s')} AS d FROM c ORDER BY 1 LIMIT 100),
t AS (SELECT c_custkey, {digest(c_custkey='n', c_name='s', c_nationkey='n', c_acctbal='d', c_mktsegment='s')} AS d FROM k ORDER BY 1 LIMIT 100)
SELECT coalesce(s.c_custkey, t.c_custkey) AS c_custkey, CASE WHEN t.d IS NULL THEN 'missing' WHEN s.d IS NULL THEN 'extra' WHEN s.d = t.d THEN 'matched' ELSE 'changed' END AS status FROM s FULL JOIN t ON s.c_custkey = t.c_custkey""")
def test_data_sampled(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    k = c.filter("c_custkey % 50 <> 0").withColumn("c_acctbal", F.when(F.col("c_custkey") % 7 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    return compare.keyed(c, k, ["c_custkey"], scale=4, sample=100)


_MIXED = """SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN event_id % 2 = 0 END AS flag, CASE WHEN event_id % 5 <> 0 THEN encode(event_type) END AS bytes,
  CASE WHEN event_id % 7 <> 0 THEN value END AS amount, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '\\x' || hex(encode(event_type)) WHEN 2 THEN '' ELSE event_type END AS label FROM events"""


@query(f"WITH e AS ({_MIXED}) SELECT event_id, {digest(event_id='n', flag='b', bytes='x', amount='d', label='s')} AS digest FROM e")
def row_checksum_types(spark, sf):
    """Booleans, bytes, text that spells bytes, empty text, and nulls among all of them."""
    i, name = F.col("event_id"), F.col("event_type")
    label = F.when(i % 4 == 1, F.concat(F.lit("\\x"), F.hex(name.cast("binary")))).when(i % 4 == 2, "").when(i % 4 == 3, name).alias("label")
    e = table(spark, sf, "events").select(i, F.when(i % 3 != 0, i % 2 == 0).alias("flag"), F.when(i % 5 != 0, name.cast("binary")).alias("bytes"), F.when(i % 7 != 0, F.col("value")).alias("amount"), label)
    return e.select("event_id", render.row_checksum(e, scale=4).alias("digest"))


_NAMED = "SELECT (CASE c_custkey % 4 WHEN 0 THEN 'Z' WHEN 1 THEN 'é' WHEN 2 THEN 'a' ELSE '漢' END) || c_name AS name, c_nationkey FROM customer"


@query(f"""WITH c AS ({_NAMED}), k AS (SELECT name, CASE WHEN c_nationkey = 3 THEN 4 ELSE c_nationkey END AS c_nationkey FROM c WHERE c_nationkey <> 5),
s AS (SELECT name, {digest(name='s', c_nationkey='n')} AS d FROM c ORDER BY name LIMIT 80), t AS (SELECT name, {digest(name='s', c_nationkey='n')} AS d FROM k ORDER BY name LIMIT 80)
SELECT coalesce(s.name, t.name) AS name, CASE WHEN t.d IS NULL THEN 'missing' WHEN s.d IS NULL THEN 'extra' WHEN s.d = t.d THEN 'matched' ELSE 'changed' END AS status FROM s FULL JOIN t ON s.name = t.name""")
def test_data_text_key(spark, sf):
    """The least keys of both sides where the key is text: in the order of its bytes, capitals first, other letters last."""
    first = F.when(F.col("c_custkey") % 4 == 0, "Z").when(F.col("c_custkey") % 4 == 1, "é").when(F.col("c_custkey") % 4 == 2, "a").otherwise("漢")
    c = table(spark, sf, "customer").select(F.concat(first, "c_name").alias("name"), "c_nationkey")
    k = c.filter("c_nationkey <> 5").withColumn("c_nationkey", F.when(F.col("c_nationkey") == 3, F.lit(4).cast(c.schema["c_nationkey"].dataType)).otherwise(F.col("c_nationkey")))
    return compare.keyed(c, k, ["name"], sample=80)


@query(f"""WITH k AS (SELECT * REPLACE (CASE WHEN l_partkey % 89 = 0 THEN l_quantity + 1 ELSE l_quantity END AS l_quantity) FROM lineitem WHERE l_orderkey % 97 <> 0),
b AS (SELECT {_LINES_DIGEST} AS digest, 1 AS s, 0 AS t FROM lineitem UNION ALL SELECT {_LINES_DIGEST}, 0, 1 FROM k)
SELECT digest, sum(s)::BIGINT AS source_rows, sum(t)::BIGINT AS target_rows FROM b GROUP BY digest HAVING sum(s) <> sum(t)""")
def test_data_multiset(spark, sf):
    li = table(spark, sf, "lineitem").select(*_LINES)
    k = li.filter("l_orderkey % 97 <> 0").withColumn("l_quantity", F.when(F.col("l_partkey") % 89 == 0, F.col("l_quantity") + 1).otherwise(F.col("l_quantity")))
    return compare.multiset(li, k, scale=4)


@query("""WITH g AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey IS NOT NULL GROUP BY 1), m AS (SELECT * FROM g ORDER BY n DESC, o_custkey LIMIT 1)
SELECT o_custkey AS value, n AS group_rows, (SELECT count(*) FROM orders WHERE o_custkey = m.o_custkey) AS lookup_rows, n = (SELECT count(*) FROM orders WHERE o_custkey = m.o_custkey) AS matched FROM m""")
def test_index_fk_mode(spark, sf):
    return compare.mode_probe(table(spark, sf, "orders"), "o_custkey")


@query("SELECT o_custkey, count(*) AS order_count FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def group_frequency(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("order_count")).orderBy(F.desc("order_count"), "o_custkey").limit(20)


@query("SELECT l_orderkey, count(*) AS orphan_rows FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 13 <> 0) GROUP BY 1")
def fk_orphans(spark, sf):
    parents = table(spark, sf, "orders").filter("o_orderkey % 13 <> 0")
    return compare.orphans(table(spark, sf, "lineitem").select("l_orderkey"), parents, "l_orderkey", "o_orderkey").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("orphan_rows"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS key_rows FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def unique_violations(spark, sf):
    return compare.repeated_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"]).withColumnRenamed("count", "key_rows")


# ---- stored tables ------------------------------------------------------------------------------------


@query(f"WITH {_COPY_SQL} SELECT o_orderkey FROM copy WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders)")
def delete_reconcile(spark, sf):
    return merge.surplus(table(spark, sf, "orders"), orders_copy(spark, sf), ["o_orderkey"])


@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_per_key(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type", "value", "ts")
    return merge.latest(e, ["user_id"], F.col("ts"), F.col("event_id")).drop("ts")


_CUSTOMER_CHANGES = """n AS (SELECT user_id AS c_custkey, 'event ' || event_type AS c_name, value AS c_acctbal, event_type AS c_mktsegment, event_id FROM events),
l AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY event_id DESC) = 1)"""


def _customer(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")


def _customer_changes(spark, sf):
    e = table(spark, sf, "events")
    return e.select(F.col("user_id").alias("c_custkey"), F.concat(F.lit("event "), "event_type").alias("c_name"), F.col("value").alias("c_acctbal"), F.col("event_type").alias("c_mktsegment"), "event_id")


@query(f"WITH {_CUSTOMER_CHANGES} SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM l) UNION ALL SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM l")
def upsert_merge(spark, sf):
    return merge.upsert(_customer(spark, sf), _customer_changes(spark, sf), ["c_custkey"], F.col("event_id"))


@query(f"WITH {_CUSTOMER_CHANGES} SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer UNION ALL SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM l WHERE c_custkey NOT IN (SELECT c_custkey FROM customer)")
def insert_ignore(spark, sf):
    new = merge.latest(_customer_changes(spark, sf), ["c_custkey"], F.col("event_id")).drop("event_id")
    return merge.insert_new(_customer(spark, sf), new, ["c_custkey"])


@query(f"WITH {_CUSTOMER_CHANGES} SELECT c.c_custkey, c.c_name, CASE WHEN l.c_custkey IS NULL THEN c.c_acctbal ELSE l.c_acctbal END AS c_acctbal, c.c_mktsegment FROM customer c LEFT JOIN l USING (c_custkey)")
def update_columns_partial(spark, sf):
    new = merge.latest(_customer_changes(spark, sf), ["c_custkey"], F.col("event_id"))
    return merge.update_columns(_customer(spark, sf), new, ["c_custkey"], ["c_acctbal"])


@query("SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE event_id % 11 = 0)")
def delete_by_keys(spark, sf):
    gone = table(spark, sf, "events").filter("event_id % 11 = 0").select(F.col("user_id").alias("c_custkey"))
    return merge.delete_keys(_customer(spark, sf), gone, ["c_custkey"])


@query("SELECT count(*) AS matched_rows FROM customer WHERE c_custkey IN (SELECT user_id FROM events)")
def matched_rows(spark, sf):
    keys = table(spark, sf, "events").select(F.col("user_id").alias("c_custkey"))
    return merge.matched(_customer(spark, sf), keys, ["c_custkey"]).withColumnRenamed("rows", "matched_rows")


@query("""WITH p AS (SELECT table_name, index_name, row_number() OVER (PARTITION BY index_name ORDER BY table_name) AS n, 1 AS m FROM (SELECT DISTINCT p_brand AS table_name, p_type AS index_name FROM part))
SELECT table_name, index_name, CASE WHEN n = 1 THEN index_name WHEN m = 1 THEN table_name || '_' || index_name ELSE table_name || '_' || index_name || '_' || m END AS unique_name FROM p""")
def index_name_dedup(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_brand").alias("table_name"), F.col("p_type").alias("index_name")).distinct()
    return merge.dedup_names(p, "table_name", "index_name")


# ---- change streams -------------------------------------------------------------------------------------


@query(f"WITH {_CHANGES} SELECT kind, count(*) AS kind_rows FROM ch GROUP BY kind")
def change_classify(spark, sf):
    return event_changes(spark, sf).groupBy("kind").agg(F.count(F.lit(1)).alias("kind_rows"))


@query(f"""WITH {_CHANGES}, r AS (SELECT *, event_id - row_number() OVER (PARTITION BY kind ORDER BY event_id) AS x FROM ch),
s AS (SELECT event_id, kind, CASE WHEN kind IS DISTINCT FROM lag(kind) OVER (ORDER BY event_id) THEN 1 ELSE 0 END AS n FROM ch), g AS (SELECT *, sum(n) OVER (ORDER BY event_id)::BIGINT AS run_id FROM s)
SELECT run_id, any_value(kind) AS kind, min(event_id) AS first_event, max(event_id) AS last_event, count(*) AS run_rows FROM g GROUP BY run_id""")
def change_runs(spark, sf):
    out = ordered.runs(event_changes(spark, sf).select("event_id", "kind"), "event_id", ["kind"])
    return out.groupBy("run_id").agg(F.min("kind").alias("kind"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"), F.count(F.lit(1)).alias("run_rows"))


@query(f"WITH {_CHANGES} SELECT event_id, base, row_number() OVER (PARTITION BY base ORDER BY event_id) - 1 AS seq FROM ch")
def per_base_ordinal(spark, sf):
    return ordered.ordinal_within(event_changes(spark, sf).select("event_id", "base"), "base", "event_id")


@query(f"WITH {_CHANGES} SELECT event_id, txn_id, event_id = max(event_id) OVER (PARTITION BY txn_id) AS is_last FROM ch")
def txn_tag_and_end(spark, sf):
    return changes.transaction_ends(event_changes(spark, sf).select("event_id", "txn_id"), "txn_id", "event_id")


@query(f"""WITH {_CHANGES}, x AS (SELECT event_id, CASE WHEN txn_id % 4 <> 0 THEN txn_id END AS txn FROM ch)
SELECT event_id, txn, txn IS NOT NULL AND event_id = max(event_id) OVER (PARTITION BY txn) AS is_last FROM x""")
def txn_end_untagged(spark, sf):
    """A fourth of the changes has no transaction: they stay, and end none."""
    e = event_changes(spark, sf).select("event_id", F.when(F.col("txn_id") % 4 != 0, F.col("txn_id")).alias("txn"))
    return changes.transaction_ends(e, "txn", "event_id")


@query(f"WITH {_CHANGES}, m AS (SELECT max(event_id) AS last, arg_max(txn_id, event_id) AS txn FROM ch) SELECT event_id, ch.txn_id, ch.txn_id = m.txn AS held FROM ch, m")
def txn_incomplete_hold(spark, sf):
    """The last transaction's end is still to come."""
    e = event_changes(spark, sf).select("event_id", "txn_id")
    ends = changes.transaction_ends(e, "txn_id", "event_id")
    last = e.agg(F.max("txn_id")).scalar()
    flagged = ends.withColumn("open_txn", last).select("event_id", "txn_id", (F.col("is_last") & (F.col("txn_id") != F.col("open_txn"))).alias("txn_end"))
    return changes.with_hold(flagged, "txn_id", "txn_end", "event_id").select("event_id", "txn_id", "held")


@query(f"""WITH {_CHANGES}, t AS (SELECT txn_id, bool_or(kind = 'keymove') AS moves FROM ch WHERE txn_id % 4 <> 0 GROUP BY 1),
m AS (SELECT event_id, CASE WHEN ch.txn_id % 4 <> 0 AND NOT moves THEN 'atomic' ELSE 'barrier' END AS mode, CASE WHEN ch.txn_id % 4 <> 0 AND NOT moves THEN ch.txn_id END AS k FROM ch LEFT JOIN t USING (txn_id)),
s AS (SELECT *, CASE WHEN event_id = (SELECT min(event_id) FROM ch) OR mode IS DISTINCT FROM lag(mode) OVER (ORDER BY event_id) OR k IS DISTINCT FROM lag(k) OVER (ORDER BY event_id) THEN 1 ELSE 0 END AS n FROM m)
SELECT event_id, mode, sum(n) OVER (ORDER BY event_id)::BIGINT AS segment_id FROM s""")
def apply_segments(spark, sf):
    """A fourth of the transactions is untagged."""
    e = event_changes(spark, sf).select("event_id", F.when(F.col("txn_id") % 4 != 0, F.col("txn_id")).alias("txn"), (F.col("kind") == "keymove").alias("moved"))
    return changes.apply_segments(e, "txn", "moved", "event_id").select("event_id", "mode", "segment_id")


@query(f"""WITH {_CHANGES}, p AS (SELECT event_id, CASE WHEN event_id % 17 <> 0 THEN base END AS base, row_number() OVER (PARTITION BY base ORDER BY event_id) - 1 AS seq FROM ch)
SELECT event_id FROM p WHERE base IS NULL OR base > 100 OR (base = 100 AND seq > 2)""")
def extract_dedup(spark, sf):
    e = ordered.ordinal_within(event_changes(spark, sf).select("event_id", "base"), "base", "event_id")
    base = F.when(F.col("event_id") % 17 != 0, F.col("base"))
    return changes.after_tail(e, base, F.col("seq"), (100, 2), (90, 0)).select("event_id")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey > 100")
def incremental_filter(spark, sf):
    """A capture whose watermark stands at 100 (the version is the key here): what it writes to its trail."""
    from ..project import Config, Project, SourceConfig, TargetConfig

    target = TargetConfig(path=f"{shared_root(spark)}/ferryline-capture-{uuid.uuid4().hex[:12]}")
    project = Project(spark, Config(source=SourceConfig(path=sf, keys={"customer": ["c_custkey"]}), target=target))
    project.register({"late": {"tables": ["customer"], "watermarks": {"customer": 100}, "source": project.identity()}})
    project.extract("late", "c_custkey")
    records, schema = project.trail("late").read(), table(spark, sf, "customer").schema
    value = lambda image, c: replicate.typed(F.col(image)[c], schema[c].dataType).alias(c)
    return records.select(value("key", "c_custkey"), value("after", "c_acctbal"))


@query("""SELECT c_custkey AS record_key, 'snapshot' AS origin, 1000000000 + c_custkey AS ord FROM customer UNION ALL SELECT user_id, 'captured', event_id FROM events""")
def snapshot_union(spark, sf):
    snapshot = table(spark, sf, "customer").select(F.col("c_custkey").alias("record_key"), F.lit("snapshot").alias("origin"), (F.col("c_custkey") + 1_000_000_000).alias("ord"))
    return snapshot.unionByName(table(spark, sf, "events").select(F.col("user_id").alias("record_key"), F.lit("captured").alias("origin"), F.col("event_id").alias("ord")))


def _fold_changes(spark, sf) -> DataFrame:
    e = event_changes(spark, sf)
    i = F.col("event_id")
    kind = F.when(F.col("kind") == "keymove", "partial").otherwise(F.col("kind"))
    full = kind == "full"
    box = lambda name, c, present: F.when(full | present, F.struct(c.alias(name))).alias(name)
    return e.select(i.alias("ord"), kind.alias("kind"), F.col("user_id").alias("c_custkey"), box("c_name", F.concat(F.lit("event "), i.cast("string")), F.lit(False)), box("c_acctbal", F.when(i % 5 != 0, F.col("value")), i % 2 == 0), box("c_mktsegment", F.col("event_type"), i % 4 == 1))


_FOLD = f"""WITH {_CHANGES}, f AS (SELECT event_id AS ord, user_id AS c_custkey, CASE WHEN kind = 'keymove' THEN 'partial' ELSE kind END AS kind, 'event ' || event_id AS c_name, CASE WHEN event_id % 5 <> 0 THEN value END AS c_acctbal, event_type AS c_mktsegment FROM ch),
p AS (SELECT *, kind = 'full' AS has_name, kind = 'full' OR (kind = 'partial' AND ord % 2 = 0) AS has_bal, kind = 'full' OR (kind = 'partial' AND ord % 4 = 1) AS has_seg FROM f),
e AS (SELECT c_custkey, max(ord) FILTER (kind = 'delete') AS gone FROM p GROUP BY 1),
n AS (SELECT p.c_custkey, any_value(e.gone) AS gone,
  arg_max(struct_pack(v := c_name), ord) FILTER (has_name AND ord > coalesce(gone, -1)) AS nm, arg_max(struct_pack(v := c_acctbal), ord) FILTER (has_bal AND ord > coalesce(gone, -1)) AS bal, arg_max(struct_pack(v := c_mktsegment), ord) FILTER (has_seg AND ord > coalesce(gone, -1)) AS seg,
  coalesce(bool_or((has_name OR has_bal OR has_seg) AND ord > coalesce(gone, -1)), false) AS live FROM p JOIN e USING (c_custkey) GROUP BY 1)
SELECT coalesce(c.c_custkey, n.c_custkey) AS c_custkey, CASE WHEN nm IS NOT NULL THEN nm.v WHEN gone IS NULL THEN c.c_name END AS c_name, CASE WHEN bal IS NOT NULL THEN bal.v WHEN gone IS NULL THEN c.c_acctbal END AS c_acctbal, CASE WHEN seg IS NOT NULL THEN seg.v WHEN gone IS NULL THEN c.c_mktsegment END AS c_mktsegment
FROM customer c FULL JOIN n ON c.c_custkey = n.c_custkey WHERE coalesce(live, false) OR (c.c_custkey IS NOT NULL AND gone IS NULL)"""


@query(_FOLD)
def cdc_fold_apply(spark, sf):
    return changes.fold(_customer(spark, sf), _fold_changes(spark, sf), ["c_custkey"])


@query("""WITH w AS (SELECT 1000000 * (max(c_custkey) // 1000000 + 1) AS wide FROM customer)
SELECT CASE WHEN c_custkey % 10 = 0 THEN c_custkey + 2 * wide WHEN c_custkey % 10 = 1 THEN c_custkey + 3 * wide ELSE c_custkey END AS c_custkey, c_name, CASE WHEN c_custkey % 10 = 0 THEN c_acctbal + 5 WHEN c_custkey % 10 = 1 THEN c_acctbal + 7 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer, w WHERE c_custkey % 10 <> 2
UNION ALL SELECT c_custkey, 'again', 0.0, NULL FROM customer WHERE c_custkey % 10 = 0""")
def cdc_keymove_apply(spark, sf):
    """Keys that end in 0 move (and are inserted anew), those in 1 move twice, those in 2 are deleted.

    Keys move by whole millions that are more than the largest key, so that no row is in another's place at any time.
    """
    c = _customer(spark, sf)
    k = F.col("c_custkey")
    wide = c.agg(((F.call_function("div", F.max(k), F.lit(1_000_000)) + 1) * 1_000_000).alias("wide")).scalar()
    none, box = F.lit(None), lambda name, v: F.struct(v.alias(name)).alias(name)
    record = lambda where, ord_, kind, key, old, name, bal, seg: c.filter(where).select((wide * (10 * ord_) + k).alias("ord"), F.lit(kind).alias("kind"), key.alias("c_custkey"), (F.struct(old.alias("c_custkey")) if old is not None else none.cast("struct<c_custkey:bigint>")).alias("old"), (box("c_name", name) if name is not None else none.cast("struct<c_name:string>").alias("c_name")), (box("c_acctbal", bal) if bal is not None else none.cast("struct<c_acctbal:double>").alias("c_acctbal")), (box("c_mktsegment", seg) if seg is not None else none.cast("struct<c_mktsegment:string>").alias("c_mktsegment")))
    stream = (
        record("c_custkey % 10 = 0", 1, "keymove", k + wide * 2, k, None, F.col("c_acctbal") + 5, None)
        .union(record("c_custkey % 10 = 0", 2, "full", k, None, F.lit("again"), F.lit(0.0), F.lit(None).cast("string")))
        .union(record("c_custkey % 10 = 1", 3, "keymove", k + wide * 4, k, None, None, None))
        .union(record("c_custkey % 10 = 1", 4, "keymove", k + wide * 3, k + wide * 4, None, F.col("c_acctbal") + 7, None))
        .union(record("c_custkey % 10 = 2", 5, "delete", k, None, None, None, None))
    )
    return changes.fold_with_moves(c, stream, ["c_custkey"])


@query("""SELECT CASE WHEN c_custkey % 3 = 0 THEN c_custkey + 5000000 ELSE c_custkey END AS c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 9007199254740993 + c_custkey END AS wide,
CASE WHEN c_custkey % 5 <> 0 THEN CAST(c_custkey AS DECIMAL(38, 10)) + 0.0000000001 END AS exact, CASE WHEN c_custkey % 3 = 0 THEN 'moved' ELSE c_name END AS c_name FROM customer""")
def keymove_wide_values(spark, sf):
    """Rows that move keep longs past 2**53 and decimals beside nulls."""
    k = F.col("c_custkey").cast("bigint")
    wide = F.when(k % 2 == 0, k + F.lit(9007199254740993)).alias("wide")
    exact = F.when(k % 5 != 0, (k.cast("decimal(27,0)") + F.lit("0.0000000001").cast("decimal(11,10)")).cast("decimal(38,10)")).alias("exact")
    stored = table(spark, sf, "customer").select(k.alias("c_custkey"), wide, exact, "c_name")
    unset = lambda name, kind: F.lit(None).cast(f"struct<{name}:{kind}>").alias(name)
    moves = stored.filter("c_custkey % 3 = 0").select(k.alias("ord"), F.lit("keymove").alias("kind"), (k + 5_000_000).alias("c_custkey"), F.struct(k.alias("c_custkey")).alias("old"), unset("wide", "bigint"), unset("exact", "decimal(38,10)"), F.struct(F.lit("moved").alias("c_name")).alias("c_name"))
    return changes.fold_with_moves(stored, moves, ["c_custkey"])


@query(f"""WITH {_CHANGES}, o AS (SELECT max(txn_id) AS txn FROM ch), r AS (SELECT CASE WHEN event_id % 3 = 0 THEN 'odds' ELSE 'evens' END AS table_name, user_id, event_id FROM ch, o WHERE txn_id <> o.txn)
SELECT table_name, user_id, max(event_id) AS last_event, max(event_id) * 2 AS doubled FROM r GROUP BY 1, 2""")
def transactions_over_tables(spark, sf):
    """A trail of transactions over two tables, the last of them open, applied to both under one pointer."""
    root = f"{shared_root(spark)}/ferryline-two-tables-{uuid.uuid4().hex[:12]}"
    e = event_changes(spark, sf).select("event_id", "user_id", "txn_id")
    ends = changes.transaction_ends(e, "txn_id", "event_id").withColumn("open_txn", e.agg(F.max("txn_id")).scalar())
    text = lambda c: F.col(c).cast("string")
    records = ends.select(
        F.col("event_id").alias("ord"), F.lit("U").alias("op"), F.when(F.col("event_id") % 3 == 0, "odds").otherwise("evens").alias("table"), "txn_id", (F.col("is_last") & (F.col("txn_id") != F.col("open_txn"))).alias("txn_end"),
        F.create_map(F.lit("user_id"), text("user_id")).alias("key"), F.create_map(F.lit("user_id"), text("user_id"), F.lit("last_event"), text("event_id"), F.lit("doubled"), (F.col("event_id") * 2).cast("string")).alias("after"))
    source, replica = Trail(spark, f"{root}/trail"), Replica(spark, f"{root}/replica", buckets=4)
    source.append_frame(records, "ord")
    empty = spark.createDataFrame([], "user_id bigint, last_event bigint, doubled bigint")
    replica.publish({t: replica.stage(t, empty, ["user_id"]) for t in ("odds", "evens")}, 0, 0)
    replicate.replicate_all(source, replica, {t: ["user_id"] for t in ("odds", "evens")}, 1 << 20)
    one = lambda t: replica.table(t).read().select(F.lit(t).alias("table_name"), "user_id", "last_event", "doubled")
    return one("odds").union(one("evens"))


@query("""WITH c AS (SELECT o_orderkey // 1000 AS chunk_no, o_orderkey, o_custkey, CAST(floor(o_orderkey / 1000) AS BIGINT) % 2 = 1 AS shrinks FROM orders)
SELECT chunk_no, o_orderkey, o_custkey FROM c WHERE NOT (shrinks AND chunk_no % 4 = 1) AND NOT (shrinks AND chunk_no % 4 = 3 AND o_custkey % 2 = 0)""")
def chunk_reload(spark, sf):
    """Every other chunk is loaded again: half of those without any rows left, half with some of theirs."""
    path = f"{shared_root(spark)}/ferryline-reload-{uuid.uuid4().hex[:12]}"
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.floor(F.col("o_orderkey") / 1000).cast("bigint").alias("no"))
    name = F.concat(F.lit("orders:"), F.col("no").cast("string"))
    sinks.load_range(rows.drop("no").withColumn("chunk_id", F.concat(F.lit("orders:"), F.floor(F.col("o_orderkey") / 1000).cast("string"))).repartition("chunk_id"), path)
    ids = [r[0] for r in rows.filter("no % 2 = 1").select(name).distinct().collect()]
    left = rows.filter("no % 4 = 3 AND o_custkey % 2 = 1").withColumn("chunk_id", name).drop("no").repartition("chunk_id")
    sinks.load_range(left, path, ids=ids)
    return spark.read.parquet(path).select(F.split("chunk_id", ":")[1].cast("bigint").alias("chunk_no"), "o_orderkey", "o_custkey")


@query("SELECT CASE WHEN value > 0 AND event_id % 23 <> 0 THEN 'good' ELSE 'dead_letter' END AS outcome, count(*) AS outcome_rows FROM events GROUP BY 1")
def dead_letter_split(spark, sf):
    good, bad = changes.dead_letters(table(spark, sf, "events"), (F.col("value") > 0) & (F.col("event_id") % 23 != 0))
    one = lambda df, name: df.select(F.lit(name).alias("outcome"))
    return one(good, "good").union(one(bad, "dead_letter")).groupBy("outcome").agg(F.count(F.lit(1)).alias("outcome_rows"))


@query("""WITH p AS (SELECT event_id, (user_id * 4294967296 + event_id * 4096)::DECIMAL(20, 0) AS pos, (event_id % 300 * 281474976710656 + event_id)::DECIMAL(20, 0) AS log_pos FROM events)
SELECT event_id, pos AS lsn, (SELECT max(pos) FROM p) - pos AS bytes_behind, log_pos AS binlog FROM p""")
def lag_positions(spark, sf):
    e = table(spark, sf, "events")
    low = F.col("event_id") * 4096  # what is past its 32 bits counts to the upper half
    text = F.concat_ws("/", F.hex(F.col("user_id") + F.shiftright(low, 32)), F.hex(low.bitwiseAND(F.lit((1 << 32) - 1))))
    file = F.concat(F.lit("mysql-bin."), F.lpad((F.col("event_id") % 300).cast("string"), 6, "0"))
    p = e.select("event_id", render.lsn(text).alias("lsn"), render.binlog_position(file, F.col("event_id")).alias("binlog"))
    return p.withColumn("end", p.agg(F.max("lsn")).scalar()).select("event_id", "lsn", (F.col("end") - F.col("lsn")).cast("decimal(21,0)").alias("bytes_behind"), "binlog")


# ---- text and dialects --------------------------------------------------------------------------------------


def _view(spark, sf, sql: str, *names: str) -> DataFrame:
    """Foreign SQL, rewritten for Spark and run over the tables it names."""
    for n in names:
        table(spark, sf, n).createOrReplaceTempView(n)
    return spark.sql(rewrite.rewrite_sql(sql, target="spark")[0])


@query("SELECT n_regionkey, string_agg(DISTINCT n_name, '; ' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def group_concat(spark, sf):
    return _view(spark, sf, "SELECT n_regionkey, GROUP_CONCAT(DISTINCT n_name ORDER BY n_name SEPARATOR '; ') AS names FROM nation GROUP BY n_regionkey", "nation")


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'filled' ELSE 'other' END AS state, CASE WHEN o_totalprice > 100000 THEN 'big' ELSE 'small' END AS size,
  coalesce(nullif(o_orderpriority, '1-URGENT'), 'now') AS priority, CASE WHEN nullif(o_orderstatus, 'O') IS NOT NULL THEN 1 ELSE 0 END AS done FROM orders""")
def decode_nvl_if(spark, sf):
    return _view(spark, sf, "SELECT o_orderkey, DECODE(o_orderstatus, 'O', 'open', 'F', 'filled', 'other') AS state, IF(o_totalprice > 100000, 'big', 'small') AS size, NVL(nullif(o_orderpriority, '1-URGENT'), 'now') AS priority, NVL2(nullif(o_orderstatus, 'O'), 1, 0) AS done FROM orders", "orders")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def rownum_limit(spark, sf):
    return _view(spark, sf, "SELECT o_orderkey, o_totalprice FROM orders WHERE ROWNUM <= 25 AND o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey", "orders")


@query("SELECT r.r_regionkey, r.r_name, count(*) AS nations FROM region r JOIN nation n ON n.n_regionkey = r.r_regionkey GROUP BY r.r_regionkey, r.r_name")
def strict_group_by(spark, sf):
    return _view(spark, sf, "SELECT r.r_regionkey, r.r_name, count(*) AS nations FROM region r JOIN nation n ON n.n_regionkey = r.r_regionkey GROUP BY r.r_regionkey", "region", "nation")


@query("SELECT doc_id FROM labels WHERE quality = 1")
def bool_comparison(spark, sf):
    table(spark, sf, "labels").select("doc_id", F.col("quality").cast("boolean").alias("good")).createOrReplaceTempView("labels_flag")
    return spark.sql(rewrite.boolean_comparisons("SELECT doc_id FROM labels_flag WHERE labels_flag.good = 1", ["good"]))


@query("SELECT c_custkey, coalesce(c_name, 'none') AS name FROM customer WHERE c_acctbal > 0")
def view_portability(spark, sf):
    """An Oracle view: its header and FROM DUAL go, NVL stays."""
    table(spark, sf, "customer").createOrReplaceTempView("customer")
    body, _ = rewrite.portable_view("CREATE VIEW v AS SELECT c_custkey, NVL(c_name, (SELECT 'none' FROM DUAL)) AS name FROM customer WHERE c_acctbal > 0", "spark")
    return spark.sql(body)


@query("SELECT doc_id, sha256(replace(replace(replace(replace(text, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n'), chr(9), chr(92) || 't'), chr(13), chr(92) || 'r')) AS escaped_sha256 FROM documents")
def copy_encode(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.sha2(render.copy_field(F.col("text"), T.StringType()), 256).alias("escaped_sha256"))


@query("SELECT doc_id, sha256(text) AS text_sha256 FROM documents")
def copy_round_trip(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    back = render.copy_decode(F.col("line"), 2)
    return d.select(render.copy_row(d).alias("line")).select(back[0].cast("bigint").alias("doc_id"), F.sha2(back[1], 256).alias("text_sha256"))


def _weights() -> str:
    return " + ".join(f"{w} * len(regexp_extract_all(lower(text), '{p}'))" for p, w in render.ROUTINE_WEIGHTS)


@query(f"SELECT doc_id, CAST({_weights()} AS BIGINT) AS units FROM (SELECT doc_id, text || ' cursor exception dbms_output connect by forall' AS text FROM documents)")
def routine_cost(spark, sf):
    d = table(spark, sf, "documents")
    body = F.concat("text", F.lit(" cursor exception dbms_output connect by forall"))
    return d.select("doc_id", render.routine_cost(body).cast("bigint").alias("units"))


@query("SELECT n_regionkey, '{' || string_agg(CASE WHEN regexp_matches(n_name, '[{},\"\\\\\\s]') OR n_name = '' OR upper(n_name) = 'NULL' THEN '\"' || n_name || '\"' ELSE n_name END, ',' ORDER BY n_name) || '}' AS literal FROM (SELECT n_regionkey, CASE WHEN n_nationkey % 3 = 0 THEN n_name || ' x' ELSE n_name END AS n_name FROM nation) GROUP BY 1")
def array_literal(spark, sf):
    n = table(spark, sf, "nation").withColumn("n_name", F.when(F.col("n_nationkey") % 3 == 0, F.concat("n_name", F.lit(" x"))).otherwise(F.col("n_name")))
    return n.groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_name")).alias("a")).select("n_regionkey", render.array_literal(F.col("a"), T.StringType()).alias("literal"))


@query("SELECT event_id, (SELECT '{' || string_agg('\"' || k || '\":' || json_extract(props, '$.' || k)::VARCHAR, ',' ORDER BY k) || '}' FROM (SELECT unnest(json_keys(props)) AS k)) AS canonical FROM events WHERE props IS NOT NULL")
def json_canonical(spark, sf):
    """Compact JSON with sorted keys."""
    e = table(spark, sf, "events").filter("props IS NOT NULL")
    v = F.from_json("props", "map<string,variant>")
    keys = F.array_sort(F.map_keys(v))
    pairs = F.transform(keys, lambda k: F.concat(F.lit('"'), k, F.lit('":'), F.to_json(F.element_at(v, k))))
    return e.select("event_id", F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}")).alias("canonical"))


QUERIES |= capture_catalog.QUERIES | metadata_catalog.QUERIES
SQL |= capture_catalog.SQL | metadata_catalog.SQL

"""Every registered query against its DuckDB twin, and the driver's contract."""

import duckdb
import pyarrow as pa
import pytest

import __spark_entry__ as entry
from ferryline.plans import catalog, metadata_catalog
from ferryline.project import fresh_rows
from ferryline.sources.tables import ParquetSource


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_matches_its_twin(name, spark, data, same):
    same(catalog.QUERIES[name](spark, data), catalog.SQL[name])


def test_entry_has_rows(spark, data):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns[0] == "chunk_no"


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_range_filter_reaches_the_scan(spark, data):
    """The read that a capture filters, with the columns that it takes."""
    rows = fresh_rows(ParquetSource(spark, data).rows("customer", ["c_custkey", "c_acctbal"]), "c_custkey", 100, 150)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(c_custkey,100)" in plan and "LessThanOrEqual(c_custkey,150)" in plan and "PushedFilters: []" not in plan
    assert "ReadSchema: struct<c_custkey:bigint,c_acctbal:double>" in plan


def test_top_k_is_bounded(spark, data):
    plan = catalog.QUERIES["group_frequency"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_no_cross_joins(spark, data):
    for name, q in catalog.QUERIES.items():
        plan = q(spark, data)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


@pytest.mark.parametrize("name", ["dialect_rewrite", "ddl_export", "type_map", "assessment"])
def test_rows_of_a_small_file_are_spread_over_tasks(name, spark, data):
    assert catalog.QUERIES[name](spark, data).rdd.getNumPartitions() >= 4


def test_a_task_holds_the_rows_of_a_few_customers():
    given = pa.table({"customer": range(2500)} | {x: [str(i) for i in range(2500)] for x in metadata_catalog.VALUES}).to_batches()
    out = list(metadata_catalog._maker(lambda v: [(v.k, v.customer), (None, None)], ["a", "b"], [False, True])([*given, given[0].slice(0, 0)]))
    assert [b.num_rows for b in out] == [2000, 2000, 1000] and out[2].slice(998).to_pylist() == [{"customer": 2499, "a": "2499", "b": 2499}, {"customer": 2499, "a": None, "b": None}]


def _differs(spark, folder, name, table, rows, columns):
    """Rows of a query over a table of its own that its twin has not, and the other way round."""
    spark.createDataFrame(rows, columns).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    df = catalog.QUERIES[name](spark, str(folder))
    got = con.execute(f"SELECT {', '.join(df.columns)} FROM ({catalog.SQL[name]})").fetchall()
    return sorted(map(repr, got)), sorted(repr(tuple(r)) for r in df.collect())


@pytest.mark.parametrize("keys", [[10, 11, 12, 13, 500_011, 500_010], [1, 0, 2_000_010, 1_500_001, 3_000_001, 3_500_001, 12, 31_000_000, 61_000_001]])
def test_moved_keys_take_no_other_rows_place(keys, spark, tmp_path):
    rows = [(k, f"c{k}", float(k % 97), "m") for k in keys]
    want, got = _differs(spark, tmp_path, "cdc_keymove_apply", "customer", rows, "c_custkey bigint, c_name string, c_acctbal double, c_mktsegment string")
    assert want == got and len(got) == sum(1 if k % 10 != 0 else 2 for k in keys if k % 10 != 2)


def test_positions_carry_into_their_upper_half(spark, tmp_path):
    rows = [(i, u) for u, i in enumerate([0, 5, (1 << 20) - 1, 1 << 20, (1 << 20) + 1, 36_000_000])]
    want, got = _differs(spark, tmp_path, "lag_positions", "events", rows, "event_id bigint, user_id bigint")
    assert want == got and not any("None" in r for r in got)


def test_chunks_are_written_by_more_than_one_task(spark, data, monkeypatch):
    tasks = []
    real = catalog.sinks.load_range
    monkeypatch.setattr(catalog.sinks, "load_range", lambda df, *a, **k: tasks.append("SinglePartition" in df._jdf.queryExecution().executedPlan().toString()) or real(df, *a, **k))
    catalog.QUERIES["chunk_reload"](spark, data)
    assert tasks == [False, False]


def test_values_that_look_like_places_stay(spark, tmp_path):
    want, got = _differs(spark, tmp_path, "column_defaults", "customer", [(7, "@seg@", 3, 1.0, "M")], "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")
    assert want == got

"""The set-based fold against the record-by-record model, and the order-dependent operators."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ferryline.operators import changes as C
from ferryline.operators import ordered

SCHEMA = "ord bigint, kind string, id bigint, old struct<id:bigint>, a struct<a:string>, b struct<b:string>"
value = st.sampled_from([None, "x", "y", "z"])
record = st.tuples(st.sampled_from(["delete", "full", "partial", "partial", "keymove"]), st.integers(0, 6), st.integers(0, 6), value, value, st.booleans(), st.booleans())


def run(spark, base, recs, fold):
    rows, model = [], []
    for n, (kind, key, old, a, b, has_a, has_b) in enumerate(recs):
        if kind == "keymove" and key == old:
            kind = "partial"
        has_a, has_b = has_a or kind == "full", has_b or kind == "full"
        rows.append((n, kind, key, (old,) if kind == "keymove" else None, (a,) if has_a and kind != "delete" else None, (b,) if has_b and kind != "delete" else None))
        model.append({"kind": kind, "key": {"id": key}, "before_key": {"id": old}, "after": {"id": key} | ({"a": a} if has_a else {}) | ({"b": b} if has_b else {})})
    stored = spark.createDataFrame(base, "id bigint, a string, b string")
    got = fold(stored, spark.createDataFrame(rows, SCHEMA))
    want = C.replay({(r[0],): dict(zip(("id", "a", "b"), r)) for r in base}, model, ["id", "a", "b"], ["id"])
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr((r["id"], r["a"], r["b"])) for r in want.values())


slow = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
bases = st.lists(st.tuples(st.integers(0, 6), value, value), max_size=5, unique_by=lambda r: r[0])


@slow
@given(bases, st.lists(record.filter(lambda r: r[0] != "keymove"), max_size=25))
def test_fold_is_the_model(spark, base, recs):
    run(spark, base, recs, lambda s, c: C.fold(s, c, ["id"]))


@slow
@given(bases, st.lists(record, max_size=20))
def test_fold_with_moves_is_the_model(spark, base, recs):
    run(spark, base, recs, lambda s, c: C.fold_with_moves(s, c, ["id"]))


def test_a_present_null_is_set_and_an_absent_column_stays(spark):
    run(spark, [(1, "x", "y")], [("partial", 1, 0, None, "q", True, False)], lambda s, c: C.fold(s, c, ["id"]))


def test_key_only_image_makes_no_row(spark):
    run(spark, [], [("partial", 1, 0, "q", "q", False, False)], lambda s, c: C.fold(s, c, ["id"]))


def test_running_sum_and_runs_cross_segments(spark):
    df = spark.range(100).select(F.col("id").alias("o"), F.floor(F.col("id") / 7).alias("v"))
    rows = ordered.running_sum(df, "o", F.lit(2), "s", 8).orderBy("o").collect()
    assert [r["s"] for r in rows] == [2 * (i + 1) for i in range(100)]
    rows = ordered.runs(df, "o", ["v"], "r", 8).orderBy("o").collect()
    assert [r["r"] for r in rows] == [i // 7 + 1 for i in range(100)]


def test_empty_streams(spark):
    df = spark.range(0).select(F.col("id").alias("o"), F.col("id").alias("v"))
    assert ordered.runs(df, "o", ["v"]).count() == 0 and ordered.running_sum(df, "o", F.lit(1), "s").count() == 0


def test_hold_keeps_back_only_an_open_tail(spark):
    rows = [(1, 10, False), (2, 10, True), (3, None, False), (4, 11, False), (5, 11, False)]
    got = C.with_hold(spark.createDataFrame(rows, "seq bigint, txn bigint, done boolean"), "txn", "done", "seq")
    assert sorted(r["seq"] for r in got.filter("held").collect()) == [4, 5]
    got = C.with_hold(spark.createDataFrame(rows[:3], "seq bigint, txn bigint, done boolean"), "txn", "done", "seq")
    assert got.filter("held").count() == 0


def test_dedup_and_epoch(spark):
    df = spark.createDataFrame([(5, 0), (5, 1), (6, 0), (None, None)], "base bigint, seq bigint")
    assert C.after_tail(df, F.col("base"), F.col("seq"), (5, 0), (5, 0)).count() == 3
    assert C.after_tail(df, F.col("base"), F.col("seq"), (5, 0), (9, 0)).count() == 4
    with pytest.raises(ValueError):
        C.check_epoch((10, 0), 9)


def test_dead_letters_break_the_circuit(spark):
    df = spark.range(10)
    good, bad = C.dead_letters(df, F.col("id") < 8, 2)
    assert (good.count(), bad.count()) == (8, 2)
    with pytest.raises(ValueError):
        C.dead_letters(df, F.col("id") < 7, 2)


def test_untagged_changes_end_no_transaction(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 5), (4, None)], "seq bigint, txn bigint")
    assert sorted(map(tuple, C.transaction_ends(df, "txn", "seq").collect())) == [(1, 5, False), (2, None, False), (3, 5, True), (4, None, False)]


def test_ranges_follow_the_rows(spark):
    """Positions that cluster still give ranges of about equal size."""
    df = spark.range(4000).select((F.col("id") + F.when(F.col("id") == 3999, 10**12).otherwise(0)).alias("o"))
    sizes = [r["count"] for r in ordered.segmented(df, "o", 16).groupBy("__segment").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 400
    assert ordered.running_sum(df, "o", F.lit(1), "s", 16).agg(F.max("s")).first()[0] == 4000


def test_ranges_are_found_once_and_stand_in_the_plan(spark):
    """Found anew in each branch of a join, approximate cut points may differ on a cluster, and so would the ranges joined by."""
    df = spark.range(0, 5000, 1, 8).selectExpr("id * 3 AS o", "1 AS v")
    cut = ordered.segmented(df, "o", 16)
    assert "ubquery" not in cut._jdf.queryExecution().optimizedPlan().toString()
    bounds = cut.groupBy("__segment").agg(F.min("o").alias("a"), F.max("o").alias("z")).orderBy("__segment").collect()
    assert len(bounds) == 16 and all(x["z"] < y["a"] for x, y in zip(bounds, bounds[1:]))
    assert ordered.segmented(df.limit(0), "o", 16).count() == 0
    nulls = spark.createDataFrame([(None,), (1 << 60,), (3,)], "o bigint")
    assert ordered.segmented(nulls, "o", 16).filter("__segment IS NULL").count() == 0


def test_open_transactions_are_found_at_once(spark, monkeypatch):
    """Held rows are those that the joins find, few or many; what is held at the end of a stream too."""
    rows = [(1, 5, None), (2, 6, None), (3, None, None), (4, 5, True), (5, 7, None), (6, 6, None)]
    df = spark.createDataFrame(rows, "seq bigint, txn bigint, done boolean")
    want = sorted(map(tuple, C.with_open(df, "txn", "done").collect()))
    assert sorted(map(tuple, C.with_open_found(df, "txn", "done").collect())) == want and [r[0] for r in want if r[3]] == [2, 5, 6]
    assert "Join" not in C.with_open_found(df, "txn", "done")._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(C, "OPEN", 1)
    assert sorted(map(tuple, C.with_open_found(df, "txn", "done").collect())) == want
    for n in range(len(rows) + 1):
        some = df.filter(F.col("seq") <= n)
        held = sorted(map(tuple, C.with_hold(some, "txn", "done", "seq").collect()))
        assert sorted(map(tuple, some.withColumn("held", C.held_of(some, "txn", "done", "seq")).collect())) == held

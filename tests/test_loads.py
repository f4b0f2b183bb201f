import threading

import pytest
from hypothesis import given
from hypothesis import strategies as st

from ferryline.operators import sinks
from ferryline.operators.chunks import Chunk, even_chunks, key_bounds, plan_chunks, with_chunks
from ferryline.plans import ledger as L
from ferryline.sources import introspect as I
from ferryline.sources import jdbc as J
from ferryline.sources.tables import ParquetSource


@given(st.integers(-1000, 1000), st.integers(0, 500), st.integers(2, 40))
def test_chunks_cover_without_gaps(lo, span, wanted):
    cs = plan_chunks("t", "k", (lo, lo + span), wanted)
    assert cs[0].lo == lo and cs[-1].hi == lo + span + 1 and len(cs) <= wanted
    assert all(a.hi == b.lo and a.lo < a.hi for a, b in zip(cs, cs[1:]))


def test_chunk_texts():
    assert [c.predicate() for c in plan_chunks("EMP", "ID", (1, 10), 4)][0] == '"ID" >= 1 AND "ID" < 4'
    assert plan_chunks("EMP", None, (1, 10), 4) == [Chunk("EMP:0")] == plan_chunks("EMP", "ID", (1, 10), 1) == plan_chunks("EMP", "ID", None, 4)
    assert Chunk("x", "k", 1, 2, "as recorded").predicate() == "as recorded"


def test_load_resume_and_drift(spark, data, tmp_path):
    src = ParquetSource(spark, data)
    assert "orders" in src.tables() and src.count("region") == 5 and src.bounds("region", "r_name") is None
    cs = {"orders": plan_chunks("orders", "o_orderkey", src.bounds("orders", "o_orderkey"), 4)}
    ledger = L.Ledger.open(spark, str(tmp_path / "ledger.json"))
    ledger.plan("r", "h", cs, {"orders": "o_orderkey"})
    out = str(tmp_path / "out")
    assert sum(sinks.load(ledger, "orders", src.rows("orders"), out, batch=3).values()) == 1500 and ledger.failed == 0
    again = L.Ledger.open(spark, str(tmp_path / "ledger.json"))
    again.mark(["orders:1"], L.IN_PROGRESS)
    drifted = {"orders": plan_chunks("orders", "o_orderkey", (0, 99), 4)}
    again.plan("r", "h", drifted, {"orders": "o_orderkey"})
    assert [c.predicate() for c in again.chunks()] == [c.predicate() for c in cs["orders"]]
    assert list(sinks.load(again, "orders", src.rows("orders"), out)) == ["orders:1"] and spark.read.parquet(out).count() == 1500
    for tables, keys, config in (({}, {}, "h"), (cs, {"orders": "other"}, "h"), (cs, {"orders": "o_orderkey"}, "changed")):
        with pytest.raises(L.ResumeDrift):
            L.Ledger.open(spark, str(tmp_path / "ledger.json")).plan("r", config, tables, keys)
    assert L.progress(again.frame()).first()["status"] == "loaded"
    seen = L.Ledger.open(spark, str(tmp_path / "ledger.json"), read_only=True)
    assert seen.failed == 0
    with pytest.raises(PermissionError):
        seen.mark(["orders:1"], L.FAILED)


def test_a_chunk_without_rows_is_emptied(spark, tmp_path):
    path = str(tmp_path / "t")
    df = lambda rows: spark.createDataFrame(rows, "k int, chunk_id string")
    assert sinks.load_range(df([(1, "t:0"), (2, "t:1"), (3, "t:1")]), path) == {"t:0": 1, "t:1": 2}
    assert sinks.load_range(df([(5, "t:0")]), path, ids=["t:0", "t:1"]) == {"t:0": 1, "t:1": 0}
    assert [tuple(r) for r in spark.read.parquet(path).collect()] == [(5, "t:0")]
    assert sinks.load_range(df([]), path, ids=["t:1"]) == {"t:1": 0}
    with pytest.raises(ValueError):
        sinks.load_range(df([(1, "t:0")]), path, ids=["t:1"])
    assert spark.read.parquet(path).count() == 1


def test_failed_batch_is_marked(spark, data, tmp_path):
    ledger = L.Ledger.open(spark, str(tmp_path / "l.json"))
    ledger.plan("r", "h", {"t": plan_chunks("t", "missing", (0, 9), 2)})
    with pytest.raises(Exception):
        sinks.load(ledger, "t", ParquetSource(spark, data).rows("region"), str(tmp_path / "o"))
    assert {e.state for e in ledger.entries} == {L.FAILED} and L.progress(ledger.frame()).first()["status"] == "failed"


def test_hashes_and_times():
    assert L.run_id("a", "b") == L.run_id("a", "b") != L.run_id("a", "c")
    assert L.drift_hash({"x": 1, "batch_size": 5}) == L.drift_hash({"x": 1, "batch_size": 9}) != L.drift_hash({"x": 2})
    assert L.drift_hash({"x": 1, "per": 2}, defaults={"per": 2}) == L.drift_hash({"x": 1})
    assert L.eta_seconds(0, 4, 1) is None and L.eta_seconds(1, 4, 10) == 30


def test_snapshot_pins_files(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(5).write.parquet(path)
    src = ParquetSource(spark, str(tmp_path))
    pinned = src.snapshot("t")
    spark.range(5).write.mode("append").parquet(path)
    assert src.rows("t", snapshot=pinned).count() == 5 and src.count("t") == 10
    assert src.rows("t", ["id"], "id < 2", pinned).count() == 2


def test_jdbc_text():
    assert J.select_text("oracle", "EMP", ["A"], "HR", '"A" >= 1', "77") == 'SELECT "A" FROM "HR"."EMP" AS OF SCN 77 WHERE "A" >= 1'
    assert J.select_text("mysql", "t", ["a`b"], "s") == "SELECT `a``b` FROM `s`.`t`" and J.select_text("mssql", "t", ["a]b"], "dbo") == "SELECT [a]]b] FROM [dbo].[t]"
    assert J.source_type("nvarchar", -1) == "NVARCHAR(MAX)" and J.source_type("NUMBER", None, 10, 2) == "NUMBER(10,2)" and J.source_type("int") == "INT"
    assert [J.column_default(x, d) for x, d in (("((1))", "mssql"), ("(getdate())", "mssql"), ("'x'", "mysql"), ("nextval('s'::regclass)", "postgres"), ("SYSDATE ", "oracle"))] == ["1", "CURRENT_TIMESTAMP", None, "nextval('s')", "SYSDATE"]
    assert J.literal("o'x") == "'o''x'"


def test_introspection_rows():
    cols = [dict(table_name="EMP", column_name="ID", ordinal_position=1, data_type="NUMBER", numeric_precision=10, numeric_scale=0, is_nullable="N"), dict(table_name="EMP", column_name="DEPT", ordinal_position=2, data_type="NUMBER", is_nullable="Y")]
    s = I.build_schema("HR", "oracle", cols, [dict(table_name="EMP", column_name="ID", ordinal_position=1)], [dict(table_name="EMP", column_name="DEPT", ordinal_position=1, constraint_name="FK", parent_table="D", parent_column="ID")], [dict(view_name="V", definition="SELECT 1")], [dict(sequence_name="S", start_value=5, increment_by=1, cycle_flag="N")])
    t = s.tables[0]
    assert t.primary_key == ("ID",) and t.foreign_keys[0].parent == "D" and not t.columns[0].nullable and t.columns[0].source_type == "NUMBER(10)" and s.sequences[0].start == 5


def test_introspection_of_what_goes_with_tables():
    column = lambda t, c, n: dict(table_name=t, column_name=c, ordinal_position=n, data_type="integer")
    key = lambda t, i, c, n, u: dict(table_name=t, index_name=i, column_name=c, ordinal_position=n, is_unique=u)
    s = I.build_schema(
        "public", "postgres", [column("t", "b", 2), column("t", "a", 1), column("t_2024", "a", 1)],
        indexes=[key("t", "i", "b", 2, 0), key("t", "i", "a", 1, 0), key("t", "u", "a", 1, 1) | {"condition": "(b > 0)"}],
        checks=[dict(table_name="t", constraint_name="c", expression="(a > 0)"), dict(table_name="t", constraint_name="n", expression='("a" IS NOT NULL)')],
        partitions=[dict(table_name="t", strategy="range", column_name="b", ordinal_position=1)], partition_children=[dict(table_name="t_2024")],
        routines=[dict(routine_name="f", routine_kind="function", body="BEGIN NULL; END")], triggers=[dict(trigger_name="g", table_name="t", timing="BEFORE", events="INSERT OR UPDATE", body="x")],
        materialized_views=[dict(view_name="m", definition="SELECT 1")],
    )
    (t,) = s.tables
    assert [c.name for c in t.columns] == ["a", "b"] and t.partition == ("RANGE", ("b",)) and [c.name for c in t.checks] == ["c"]
    assert [(i.name, i.columns, i.unique, i.condition) for i in t.indexes] == [("i", ("a", "b"), False, None), ("u", ("a",), True, "(b > 0)")]
    assert s.routines[0].kind == "FUNCTION" and s.triggers[0].events == ("INSERT", "UPDATE") and s.views[0].materialized
    for dialect, parts in J.CATALOGUE.items():
        assert {"columns", "indexes", "checks", "partitions", "routines", "triggers"} <= parts.keys() <= {*I.PARTS, "schemas"}, dialect
        assert all("{schema}" in parts[x] for x in parts if x != "schemas"), dialect


def test_smoke_test(spark, tmp_path):
    assert sinks.smoke_test(spark, str(tmp_path / "s"))


def test_wide_keys_are_in_their_chunk(spark, tmp_path):
    """Keys past 2**53, at both ends of each chunk: the expression and the recorded range agree."""
    lo = 2**59 + 1
    chunks_ = plan_chunks("t", "k", (lo, lo + 10**6), 80)
    keys = sorted({x for c in chunks_ for x in (c.lo, c.hi - 1)})
    df = spark.createDataFrame([(k,) for k in keys], "k bigint")
    got = {r["k"]: r["c"] for r in df.withColumn("c", sinks.chunk_column(chunks_)).collect()}
    assert all(c.lo <= k < c.hi for k in keys for c in chunks_ if c.chunk_id == got[k])
    book = L.Ledger(spark, str(tmp_path / "l.json"))
    book.plan("r", "h", {"t": chunks_})
    done = sinks.load(book, "t", df, str(tmp_path / "t"))
    assert sum(done.values()) == len(keys) and all(n for n in done.values()) and book.failed == 0
    wide = spark.createDataFrame([(-(2**63),), (2**63 - 1,), (0,)], "k bigint")
    rows = with_chunks(wide, "k", key_bounds(wide, "k"), 7).collect()
    assert all(r["lo"] <= r["k"] and (r["hi"] is None or r["k"] < r["hi"]) for r in rows)


@pytest.mark.parametrize("quote, name", [("`", "`id`"), ('"', '"id"')])
def test_a_resumed_range_is_quoted_as_its_dialect_does(spark, tmp_path, quote, name):
    book = L.Ledger(spark, str(tmp_path / "l.json"))
    book.plan("r", "h", {"t": plan_chunks("t", "id", (1, 100), 2)})
    again = L.Ledger.open(spark, book.path)
    assert [c.predicate(quote) for c in again.chunks("t")] == [f"{name} >= 1 AND {name} < 51", f"{name} >= 51 AND {name} < 101"]
    book.entries[0].predicate = "id BETWEEN 1 AND 50"
    assert book.chunks("t")[0].predicate(quote) == "id BETWEEN 1 AND 50"


# ---- the ledger as an event log ------------------------------------------------------------


def planned(spark, tmp_path, n=40):
    book = L.Ledger.open(spark, str(tmp_path / "l.json"))
    book.plan("r", "h", {"t": plan_chunks("t", "k", (0, 9999), n)})
    return book


def events(tmp_path):
    return sorted(x.name for x in (tmp_path / "l.json.events").glob("*.json")) if (tmp_path / "l.json.events").exists() else []


def test_a_mark_writes_one_event(spark, tmp_path):
    book = planned(spark, tmp_path)
    before = (tmp_path / "l.json").read_bytes()
    book.mark(["t:3"], L.LOADED, {"t:3": 7})
    assert len(events(tmp_path)) == 1 and (tmp_path / "l.json").read_bytes() == before
    assert (tmp_path / "l.json.events" / events(tmp_path)[0]).stat().st_size < 200
    (e,) = (e for e in L.Ledger.open(spark, book.path).entries if e.state == L.LOADED)
    assert (e.chunk_id, e.rows) == ("t:3", 7)


def test_writers_do_not_lose_each_others_marks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(L, "FOLD_AT", 7)
    planned(spark, tmp_path)
    writers = [L.Ledger.open(spark, str(tmp_path / "l.json")) for _ in range(4)]

    def work(w):
        for i in range(w, 40, 4):
            writers[w].mark([f"t:{i}"], L.IN_PROGRESS)
            writers[w].mark([f"t:{i}"], L.LOADED, {f"t:{i}": i})

    threads = [threading.Thread(target=work, args=(w,)) for w in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    found = L.Ledger.open(spark, str(tmp_path / "l.json"))
    assert found.failed == 0 and sum(e.rows for e in found.entries) == sum(range(40)) and len(events(tmp_path)) < 14
    writers[0].refresh()
    assert writers[0].failed == 0


@pytest.mark.parametrize("when", ["next written", "old removed", "events left"])
def test_a_crash_while_folding_is_recovered(spark, tmp_path, when):
    book = planned(spark, tmp_path)
    book.mark(["t:1"], L.LOADED, {"t:1": 5})
    book.mark(["t:2"], L.FAILED, error="no")
    at = tmp_path / "l.json"
    kept = {n: (at.parent / "l.json.events" / n).read_bytes() for n in events(tmp_path)}
    old = at.read_bytes()
    book.save()
    assert events(tmp_path) == []
    for n, data in kept.items():  # the events are still there in each case
        (at.parent / "l.json.events" / n).write_bytes(data)
    if when != "events left":
        (at.parent / "l.json.next").write_bytes(at.read_bytes())
        (at.parent / ".l.json.crc").unlink(missing_ok=True)
        at.write_bytes(old) if when == "next written" else at.unlink()
    again = L.Ledger.open(spark, book.path)
    state = {e.chunk_id: (e.state, e.rows, e.error) for e in again.entries if e.state != L.PENDING}
    assert state == {"t:1": (L.LOADED, 5, None), "t:2": (L.FAILED, 0, "no")}
    again.mark(["t:2"], L.LOADED, {"t:2": 1})
    again.save()
    assert events(tmp_path) == [] and {e.chunk_id for e in L.Ledger.open(spark, book.path).entries if e.state == L.LOADED} == {"t:1", "t:2"}


def test_sources_kept_by_line_are_joined(spark):
    rows = [("P", "PROCEDURE", i, f"line {i};\n" + "x" * 50) for i in range(200, 0, -1)] + [("F", "FUNCTION", 1, "one")]
    got = {r["routine_name"]: r["body"] for r in J.joined_lines(spark.createDataFrame(rows, "ROUTINE_NAME string, ROUTINE_KIND string, LINE int, BODY string")).collect()}
    assert got["F"] == "one" and got["P"] == "".join(f"line {i};\n" + "x" * 50 for i in range(1, 201)) and len(got["P"]) > 4000
    assert "LISTAGG" not in J.CATALOGUE["oracle"]["routines"]


def test_an_expression_stays_in_its_index():
    from ferryline.plans import ddl

    columns = [{"table_name": "t", "column_name": c, "ordinal_position": i, "data_type": "text"} for i, c in enumerate(("email", "tenant"))]
    rows = [{"table_name": "t", "index_name": "u", "column_name": "lower(email)", "ordinal_position": 1, "is_expression": 1, "is_unique": 1}, {"table_name": "t", "index_name": "u", "column_name": "tenant", "ordinal_position": 2, "is_expression": 0, "is_unique": 1}]
    (table,) = I.build_schema("public", "postgres", columns, indexes=rows).tables
    assert ddl.create_index(table, table.indexes[0]) == "CREATE UNIQUE INDEX u ON t ((lower(email)), tenant);"


def test_even_chunks_of_clustered_keys(spark, tmp_path):
    """Keys that cluster by powers: ranges have about as many rows each, and are replayed as recorded."""
    df = spark.range(20_000).selectExpr("CAST(CASE WHEN id < 15000 THEN id ELSE id * id END AS bigint) AS k")
    cs = even_chunks(df, "t", "k", 10)
    rows = df.withColumn("c", sinks.chunk_column(cs)).groupBy("c").count().collect()
    assert len(rows) == len(cs) == 10 and all(1000 <= r["count"] <= 4000 for r in rows)
    assert sum(c.estimate for c in cs) == 20_000 and all(a.hi == b.lo for a, b in zip(cs, cs[1:]))
    book = L.Ledger.open(spark, str(tmp_path / "l.json"))
    book.plan("r", "h", {"t": cs})
    assert L.progress(book.frame()).first()["rows_planned"] == 20_000
    again = L.Ledger.open(spark, book.path)
    again.plan("r", "h", {"t": plan_chunks("t", "k", (0, 9), 2)})
    assert again.chunks("t") == cs
    assert sum(sinks.load(again, "t", df, str(tmp_path / "t"), batch=4).values()) == 20_000 and again.failed == 0
    hot = spark.range(1000).selectExpr("CAST(IF(id < 900, 5, id) AS bigint) AS k")
    assert hot.withColumn("c", sinks.chunk_column(even_chunks(hot, "t", "k", 8))).groupBy("c").count().agg({"count": "max"}).first()[0] >= 900
    assert even_chunks(hot.filter("false"), "t", "k", 8) == [Chunk("t:0", estimate=0)]


def test_probe_of_the_target(spark, tmp_path, monkeypatch):
    found = sinks.probe(spark, str(tmp_path))
    assert found["atomic"] and found["replaces"] and found["empty_is_not_null"] and found["store"] == "file" and list(tmp_path.iterdir()) == []
    monkeypatch.setattr(sinks, "OBJECT_STORES", ("file",))
    assert not sinks.probe(spark, str(tmp_path))["atomic"]


def test_sessions_begin_as_their_dialect_needs(spark):
    assert "ANSI_QUOTES" in J.JdbcSource(spark, "mysql", "x").session()["sessionInitStatement"]
    assert J.JdbcSource(spark, "postgres", "x", "s", {"user": "u"}).session() == {"currentSchema": "s", "user": "u"}
    assert not J.JdbcSource(spark, "postgres", "nowhere").ping()

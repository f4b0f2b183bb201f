from datetime import date, datetime, timedelta, timezone
from decimal import Decimal
from pathlib import Path

import pytest

from ferryline.sources import decoding as D
from ferryline.sources import trail as TR
from ferryline.streaming import replicate as R
from ferryline.streaming.versions import CorruptPointer, Replica, VersionedTable


def rec(op, i, txn=None, end=None, **after):
    return {"op": op, "table": "T", "key": {"ID": i}, "after": {"ID": i} | after if op != "D" else None, "txn_id": txn, "txn_end": end}


def rows(table):
    return sorted(map(tuple, table.read().collect()), key=str)


@pytest.fixture
def target(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    t.publish(spark.createDataFrame([(7, "old"), (8, "stays")], "ID int, V string"), 0, 0)
    return t


@pytest.mark.parametrize("v", [None, True, 5, 1.5, "x", Decimal("1.50"), b"\0\xff", datetime(2024, 1, 2, 3), date(2024, 1, 2)])
def test_values_come_back(v):
    assert TR.decode(TR.encode(v)) == v


def test_values_that_change_form():
    assert TR.decode(TR.encode({"b": 1, "a": [1, 2]})) == '{"a":[1,2],"b":1}'
    assert TR.decode(TR.encode({"y", "x"})) == "x,y"
    assert TR.decode(TR.encode(datetime(2024, 1, 1, 12, tzinfo=timezone(timedelta(hours=2))))) == datetime(2024, 1, 1, 10, tzinfo=timezone.utc)
    tricky = '{"__t__": "dec", "v": "1"}'
    assert TR.encode("{}") == "{}" and TR.decode(TR.encode(tricky)) == tricky and TR.decode({"t": 1}) == {"t": 1} and TR.decode({"__t__": "new", "v": "x"}) == "x"
    assert TR.position(5) == (5, 0) < TR.position([5, 1]) and TR.position(None) is None
    line = TR.record_line(rec("I", 1, V=Decimal("2")))
    assert "txn_id" not in line and TR.record_of(line)["after"]["V"] == Decimal("2")


def test_rotation_reading_and_purge(spark, tmp_path):
    t = TR.Trail(spark, str(tmp_path / "tr"), rotate_bytes=120)
    assert t.read().count() == 0 and t.last_seq() == 0
    t.append([rec("I", i, V="v") for i in range(6)])
    assert len(t.segments()) > 2 and [r["seq"] for r in t.read(2, 2).collect()] == [3, 4]
    gone = t.purge(4)
    assert gone and t.read().agg({"seq": "min"}).first()[0] <= 5
    t.append([rec("D", 1)])
    assert t.last_seq() == 7


def overwrite(path, text):
    """As a crash would leave a file, without Hadoop's checksum beside it."""
    Path(path).write_text(text)
    (Path(path).parent / f".{Path(path).name}.crc").unlink(missing_ok=True)


def test_torn_tail_is_left_out_and_healed(spark, tmp_path):
    t = TR.Trail(spark, str(tmp_path / "tr"))
    t.append([rec("I", 1, V="a"), rec("I", 2, V="b")])
    path = t.segments()[-1]
    whole = Path(path).read_text()
    overwrite(path, whole + '{"seq":3,"op')
    assert t.read().count() == 2
    overwrite(path, whole[:-1])
    assert t.read().count() == 1
    overwrite(path, whole + '{"seq":3')
    assert t.heal() and t.read().count() == 2 and not t.heal()
    overwrite(path, "garbage\n" + whole)
    with pytest.raises(TR.CorruptTrail):
        t.read()


def test_insert_delete_orders(spark, tmp_path, target):
    t = TR.Trail(spark, str(tmp_path / "tr"))
    t.append([rec("I", 1, V="a"), rec("D", 1), rec("I", 1, V="b"), rec("I", 2, V="c"), rec("D", 2), rec("D", 7)])
    assert R.replicate(t, target, ["ID"], "T") == 6
    assert rows(target) == [(1, "b"), (8, "stays")]
    again = target.pointer()
    assert R.replicate(t, target, ["ID"], "T") == 6 and target.pointer() == again


def test_open_transactions_are_held_and_never_cut(spark, tmp_path, target):
    t = TR.Trail(spark, str(tmp_path / "tr"))
    t.append([rec("I", 1, 5, V="a"), rec("I", 2, 5, V="a"), rec("I", 3, 5, True, V="a"), rec("I", 4, 6, V="a")])
    assert R.replicate(t, target, ["ID"], "T", batch_records=2) == 3
    t.append([rec("I", 5, 6, True, V="a")])
    assert R.replicate(t, target, ["ID"], "T") == 5
    assert len(rows(target)) == 7


@pytest.mark.parametrize("batch_records", [1, 10_000])
def test_transactions_over_tables_are_released_whole(spark, tmp_path, target, batch_records):
    other = VersionedTable(spark, str(tmp_path / "other"))
    other.publish(target.read().limit(0), 0, 0)
    u = lambda *a, **b: rec(*a, **b) | {"table": "U"}
    both = lambda: (R.replicate(t, target, ["ID"], "T", batch_records), R.replicate(t, other, ["ID"], "U", batch_records))
    t = TR.Trail(spark, str(tmp_path / "tr"))
    t.append([rec("I", 1, 5, V="a"), u("I", 2, 5, V="a"), u("I", 3, 5, True, V="a")])
    assert both() == (1, 3) and len(rows(target)) == 3 and len(rows(other)) == 2
    t.append([u("I", 4, 6, V="b"), rec("I", 4, 6, V="b")])
    assert both() == (1, 3) and len(rows(target)) == 3 and len(rows(other)) == 2
    t.append([rec("D", 1, 6, True)])
    assert both() == (6, 4) and rows(target) == [(4, "b"), (7, "old"), (8, "stays")] and rows(other) == [(2, "a"), (3, "a"), (4, "b")]


def test_tables_of_a_transaction_are_published_together(spark, tmp_path):
    replica = Replica(spark, str(tmp_path / "r"), buckets=4)
    replica.publish({n: replica.stage(n, spark.createDataFrame([(7, "old")], "ID int, V string"), ["ID"]) for n in "TU"}, 0, 0)
    u = lambda *a, **b: rec(*a, **b) | {"table": "U"}
    t = TR.Trail(spark, str(tmp_path / "tr"))
    t.append([rec("I", 1, 5, V="a"), u("I", 2, 5, True, V="a"), rec("I", 3, V="alone"), u("I", 9, 6, V="open")])
    for _ in range(2):
        assert R.replicate_all(t, replica, {"T": ["ID"], "U": ["ID"]}, 1) == 3
    assert rows(replica.table("T")) == [(1, "a"), (3, "alone"), (7, "old")] and rows(replica.table("U")) == [(2, "a"), (7, "old")]
    t.append([rec("D", 7, 6, True)])
    assert R.replicate_all(t, replica, {"T": ["ID"], "U": ["ID"]}) == 5
    assert len(rows(replica.table("U"))) == 3 and (7, "old") not in rows(replica.table("T"))


def test_a_batch_writes_the_buckets_it_touches(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), buckets=8)
    table.publish(spark.range(100).selectExpr("id AS ID", "'old' AS V"), 0, 0, ["ID"])
    files = lambda: {f.split("/v=")[1].split("/")[0]: 0 for f in table.read().inputFiles()}
    assert list(files()) == ["0"] and len(table.stored().buckets) == 8
    t = TR.Trail(spark, str(tmp_path / "tr"))
    t.append([rec("I", 5, V="new")])
    assert R.replicate(t, table, ["ID"], "T") == 1
    assert sorted(table.stored().buckets.values()) == [0] * 7 + [1] and set(files()) == {"0", "1"}
    (bucket,) = (b for b, v in table.stored().buckets.items() if v == 1)
    assert all("/v=1/" in f for f in table.read([int(bucket)]).inputFiles())
    assert table.read().filter("V = 'new'").count() == 1 and table.read().count() == 100
    before = {x.ID: x.V for x in table.read().collect()}
    t.append([{"op": "U", "table": "T", "key": {"ID": 500}, "before_key": {"ID": 5}, "after": {"ID": 500}}])
    assert R.replicate(t, table, ["ID"], "T") == 2
    assert {x.ID: x.V for x in table.read().collect()} == {k: v for k, v in before.items() if k != 5} | {500: "new"}
    for i in range(3):  # old versions go when nothing needs them
        t.append([rec("D", 10 + i)])
        R.replicate(t, table, ["ID"], "T")
    assert table.read().count() == 97 and len(list(Path(table.path).glob("pointer-*"))) == 2


def test_values_that_do_not_fit_are_parked(spark, tmp_path, target):
    t = TR.Trail(spark, str(tmp_path / "tr"))
    t.append([rec("I", 1, V="a"), rec("I", "no number", V="b"), rec("I", 2, V='{"__t__": "dec", "v": "1"}')])
    parked = []
    with pytest.raises(ValueError):
        R.replicate(t, target, ["ID"], "T")
    with pytest.raises(ValueError):
        R.replicate(t, target, ["ID"], "T", park=lambda name, bad: parked.append(1), most_parked=0)
    assert not parked and len(rows(target)) == 2
    assert R.replicate(t, target, ["ID"], "T", park=lambda name, bad: parked.extend((name, r["seq"]) for r in bad.collect())) == 3
    assert parked == [("T", 2)] and (2, '{"__t__": "dec", "v": "1"}') in rows(target)


def test_only_the_segments_needed_are_opened(spark, tmp_path):
    t = TR.Trail(spark, str(tmp_path / "tr"), rotate_bytes=120)
    t.append([rec("I", i, V="v") for i in range(20)])
    have = t.listed()
    assert have[0].first == 1 and have[-1].last == 20 and all(a.last + 1 == b.first for a, b in zip(have, have[1:]))
    assert [s.last for s in t.needed(18)] == [have[-1].last] if have[-1].first <= 19 else t.needed(18)
    opened = {f.rsplit("/", 1)[1] for f in t.read(have[2].last, 1).inputFiles()}
    assert opened <= {have[3].name} and len(t.needed(0, 1)) == 1


def test_one_writer_at_a_time(spark, tmp_path):
    t = TR.Trail(spark, str(tmp_path / "tr"))
    with t.writing():
        with pytest.raises(TR.TrailBusy):
            t.append([rec("I", 1)])
    assert t.append([rec("I", 1)]) == 1
    with pytest.raises(ZeroDivisionError):
        t.append(rec("I", i) for i in [1, 1 // 0])
    assert t.append([rec("I", 2)]) == 1 and t.last_seq() == 2 and not t.unlock()


def test_streaming_restart(spark, tmp_path, target):
    t = TR.Trail(spark, str(tmp_path / "tr"))
    for n, more in ((1, [rec("I", 1, 5, V="a")]), (2, [rec("I", 2, 5, True, V="b")])):
        t.append(more)
        q = R.stream(spark, str(tmp_path / "tr"), target, ["ID"], "T", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(60)
        assert q.exception() is None and target.pointer().cursor == (0 if n == 1 else 2)
    assert len(rows(target)) == 4


def test_repeated_batch_changes_nothing(spark, target):
    new = spark.createDataFrame([(1, "x")], "ID int, V string")
    p = target.publish(new, 1, 5)
    assert target.publish(spark.createDataFrame([], "ID int, V string"), 1, 9) == p and rows(target) == [(1, "x")]


def test_corrupt_pointer_raises(target):
    open(f"{target.path}/pointer-9999999999", "w").write("")
    with pytest.raises(CorruptPointer):
        target.pointer()


def test_reconcile(spark, target):
    assert R.reconcile(target, spark.createDataFrame([(8,), (9,)], "ID int"), ["ID"]) == 1 and rows(target) == [(8, "stays")]


LINES = [
    "BEGIN 7", "table public.t: INSERT: id[integer]:1 v[character varying]:'it''s' n[numeric]:1.50 b[boolean]:t x[text]:null",
    "table public.t: UPDATE: old-key: id[integer]:1 new-tuple: id[integer]:2 v[text]:unchanged-toast-datum", "COMMIT 7",
    'table public."Odd T": DELETE: id[integer]:3', "table public.other: DELETE: id[integer]:3", "BEGIN 8",
    "table public.t: INSERT: id[integer]:5 a[text[]]:'{a,b}' z[timestamp with time zone]:'2024-01-01 10:00:00+02' \"Q c\"[text]:'x y'",
]


def test_logical_decoding(spark):
    df = spark.createDataFrame([(i, f"0/{16 * (i // 2):X}", x) for i, x in enumerate(LINES)], "ord bigint, lsn string, line string")
    got = D.decode(df, {"T": ["id"], "odd t": ["id"]}).orderBy("ord").collect()
    assert [(r["op"], r["table_name"], r["txn_id"], r["txn_end"]) for r in got] == [("I", "t", 7, False), ("U", "t", 7, True), ("D", "Odd T", None, False), ("I", "t", 8, False)]
    assert got[0]["after"] == {"id": "1", "v": "it's", "n": "1.50", "b": "true", "x": None}
    assert got[1]["after"] == {"id": "2"} and got[1]["before_key"] == {"id": "1"}
    assert got[3]["after"] == {"id": "5", "a": "{a,b}", "z": "2024-01-01 08:00:00", "Q c": "x y"}


def test_rows_that_can_not_be_told_raise():
    with pytest.raises(D.ReplicaIdentityError):
        D.change_of("table public.t: UPDATE: id[integer]:unchanged-toast-datum v[text]:'x'", {"T": ["id"]})
    with pytest.raises(D.ReplicaIdentityError):
        D.change_of("table public.t: UPDATE: old-key: other[integer]:1 new-tuple: id[integer]:2", {"T": ["id"]})
    got = D.change_of("table public.t: UPDATE: old-key: id[integer]:1 k[text]:'a' new-tuple: id[integer]:2 k[text]:unchanged-toast-datum", {"T": ["id", "k"]})
    assert got["key"] == {"id": 2, "k": "a"} and got["before_key"] == {"id": 1, "k": "a"}


def test_a_limited_read_is_not_one_task(spark, tmp_path):
    t = TR.Trail(spark, str(tmp_path / "limited"), rotate_bytes=300)
    t.append([{"op": "I", "table": "t", "key": {"k": i}, "after": {"k": i}} for i in range(20)])
    some = t.read(2, 5)
    assert "Limit" not in some._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r["seq"] for r in some.collect()) == [3, 4, 5, 6, 7]
    t.purge(t.listed()[1].last)
    first = t.listed()[0].first
    assert sorted(r["seq"] for r in t.read(0, 3).collect()) == [first, first + 1, first + 2] and first > 1


def test_lines_of_one_file_are_parsed_by_more_than_one_task(spark, monkeypatch):
    parts = []
    real = D.cut
    monkeypatch.setattr(D, "cut", lambda df: parts.append(df.rdd.getNumPartitions()) or real(df))
    lines = spark.createDataFrame([(0, "0/0", "BEGIN 1"), (1, "0/1", "table public.t: INSERT: id[integer]:1"), (2, "0/2", "COMMIT 1")], "ord bigint, lsn string, line string").coalesce(1)
    (row,) = D.decode(lines, {"t": ["id"]}).collect()
    assert parts[0] >= 4 and row["txn_id"] == 1 and row["txn_end"]


def test_lines_of_one_shape_are_read_as_one_by_one(monkeypatch):
    """A batch is taken apart by shape, and gives what its lines give one by one; few are left for that."""
    import pyarrow as pa

    values = ["1", "0", "-5", "007", "-0", "1.50", "0.0000001", "1e3", "null", "t", "'x'", "''", "'it''s'", "'1'", "'new-tuple: q'", "'a b[int]:3'", "unchanged-toast-datum", "NaN", "'2024-01-01 10:00:00+02'"]
    lines = [f"table public.t: {op}: {old}id[integer]:{i % 3 + 1} v[{kind}]:{v}" for i, v in enumerate(values * 3) for op, old in (("INSERT", ""), ("UPDATE", "old-key: id[integer]:1 new-tuple: ")) for kind in ("text", "timestamp with time zone")]
    lines += ["BEGIN 7", " COMMIT 7", "BEGIN", "", None, "table public.other: DELETE: id[integer]:3", 'table public."t": DELETE: id[integer]:3', "table public.t: DELETE: id[integer]:4"]
    places = [("0/A", "10000/FF", "none", None)[i % 4] for i in range(len(lines))]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(lines))), pa.array(places, pa.string()), pa.array(lines, pa.string())], ["ord", "lsn", "line"])
    alone, real = [], D._one_by_one
    monkeypatch.setattr(D, "_one_by_one", lambda b, *more: alone.append(b.num_rows) or real(b, *more))
    rows = lambda batches: sorted(([*r.values()] for b in batches for r in b.to_pylist()), key=lambda r: r[0])
    for past in (None, (0, 11)):
        together = rows(D._parse({"T": ["id"]}, past)(iter([batch])))
        few = sum(alone)
        monkeypatch.setattr(D.Shape, "of", classmethod(lambda cls, *a: None))
        assert together == rows(D._parse({"T": ["id"]}, past)(iter([batch]))) and few < sum(alone) - few
        monkeypatch.undo()
        monkeypatch.setattr(D, "_one_by_one", lambda b, *more: alone.append(b.num_rows) or real(b, *more))
        alone.clear()


def test_a_batch_is_parsed_once(spark, tmp_path):
    """What a batch is asked for comes from one reading of the trail's lines."""
    t = TR.Trail(spark, str(tmp_path / "once"))
    t.append([rec("I", i, V="v") for i in range(20)])
    with t.opened(0, 30) as records:
        plan = records.groupBy("op").count()._jdf.queryExecution().withCachedData().toString()
        assert "InMemoryRelation" in plan and records.count() == 20
    assert "InMemoryRelation" not in t.read().groupBy("op").count()._jdf.queryExecution().withCachedData().toString()


def test_small_tables_are_one_segment_and_numbers_go_on(spark, tmp_path, monkeypatch):
    t = TR.Trail(spark, str(tmp_path / "many"))
    put = lambda n: t.append_frame(spark.range(n).selectExpr("id * 7 AS ord", "'I' AS op", "'t' AS table", "map('k', string(id)) AS key"), "ord")
    assert put(40) == 40 and put(0) == 0 and [(s.first, s.last) for s in t.listed()] == [(1, 40)]
    monkeypatch.setattr(TR, "SEGMENT_ROWS", (10, 20))
    assert put(100) == 100
    have = t.listed()
    assert len(have) == 11 and have[0].last + 1 == have[1].first and all(a.last + 1 == b.first for a, b in zip(have, have[1:])) and t.last_seq() == 140
    assert [int(r["key"]["k"]) for r in t.read(40).orderBy("seq").collect()] == [*range(100)]
    for s in have[1:]:
        assert [r["seq"] for r in t.read(s.first - 1, s.last - s.first + 1).collect()] == [*range(s.first, s.last + 1)]

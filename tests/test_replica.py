"""Several captures into one replica, interleaved transactions, deltas and their levels, claims."""

import hashlib
import random
from pathlib import Path

import pytest

from ferryline.operators import changes as C
from ferryline.sources.trail import Trail
from ferryline.streaming import replicate as R
from ferryline.streaming import versions as V


def rec(table, op, i, txn=None, end=None, **after):
    return {"op": op, "table": table, "key": {"ID": i}, "after": {"ID": i} | after if op != "D" else None, "txn_id": txn, "txn_end": end}


def rows(table):
    return sorted(map(tuple, table.read().collect()), key=str)


def replica_of(spark, path, *names, kind="ID int, V string", **options):
    replica = V.Replica(spark, str(path), buckets=4, **options)
    replica.publish({n: replica.stage(n, spark.createDataFrame([], kind), ["ID"]) for n in names}, 0, 0)
    return replica


def test_each_stream_has_its_own_cursor(spark, tmp_path):
    replica = replica_of(spark, tmp_path / "r", "a", "b")
    one, two = (Trail(spark, str(tmp_path / x)) for x in ("one", "two"))
    one.append([rec("a", "I", i, V="x") for i in range(50)])
    two.append([rec("b", "I", i, V="y") for i in range(9)])
    assert R.replicate_all(one, replica, {"a": ["ID"]}, stream="one") == 50
    assert replica.pointer().applied("two").cursor == 0
    assert R.replicate_all(two, replica, {"b": ["ID"]}, 4, stream="two") == 9
    assert len(rows(replica.table("a"))) == 50 and len(rows(replica.table("b"))) == 9
    place = replica.pointer()
    assert (place.applied("one").cursor, place.applied("two").cursor) == (50, 9)
    assert R.replicate_all(two, replica, {"b": ["ID"]}, stream="two") == 9 and replica.pointer() == place
    two.append([rec("b", "D", 0)])
    assert R.replicate_all(two, replica, {"b": ["ID"]}, stream="two") == 10 and replica.pointer().applied("one") == place.applied("one")


def test_a_stream_keeps_to_its_trail(spark, tmp_path):
    replica, trail = replica_of(spark, tmp_path / "r", "a"), Trail(spark, str(tmp_path / "t"))
    assert trail.identity() is None
    trail.append([rec("a", "I", 1, V="x")])
    R.replicate_all(trail, replica, {"a": ["ID"]}, stream="s")
    trail.remove()
    trail.append([rec("a", "I", 2, V="x")])
    with pytest.raises(R.AnotherTrail):
        R.replicate_all(trail, replica, {"a": ["ID"]}, stream="s")
    replica.forget("s")
    assert R.replicate_all(trail, replica, {"a": ["ID"]}, stream="s") == 1 and len(rows(replica.table("a"))) == 2


def test_a_pointer_from_before_streams_is_read(spark, tmp_path):
    replica = replica_of(spark, tmp_path / "r", "a")
    (path,) = (tmp_path / "r").glob("pointer-*")
    path.write_text('{"version": 0, "batch": 3, "cursor": 7, "tables": {"a": {"schema": "{}", "keys": ["ID"], "buckets": {}}}}')
    (path.parent / f".{path.name}.crc").unlink()
    now = replica.pointer()
    assert (now.batch, now.cursor, now.applied("x").cursor) == (3, 7, 0) and now.tables["a"].deltas == {}


def test_the_cursor_never_passes_a_held_record(spark, tmp_path):
    """Records 1 and 3 are of an open transaction, 2 is of none: 2 is released, and 1 is not lost."""
    replica, trail = replica_of(spark, tmp_path / "r", "a"), Trail(spark, str(tmp_path / "t"))
    trail.append([rec("a", "I", 1, 7, V="x"), rec("a", "I", 2, V="x"), rec("a", "I", 3, 7, V="x")])
    assert R.replicate_all(trail, replica, {"a": ["ID"]}) == 0 and rows(replica.table("a")) == [(2, "x")]
    place = replica.pointer().applied()
    assert (place.ahead, place.open, place.mixed) == (2, (7,), True)
    assert R.replicate_all(trail, replica, {"a": ["ID"]}) == 0 and replica.pointer().applied() == place
    trail.append([rec("a", "I", 4, 7, True, V="x")])
    assert R.replicate_all(trail, replica, {"a": ["ID"]}) == 4
    assert rows(replica.table("a")) == [(i, "x") for i in (1, 2, 3, 4)] and replica.pointer().applied().open == ()


@pytest.mark.parametrize("seed", range(3))
def test_interleaved_transactions_take_effect_as_they_end(spark, tmp_path, seed):
    """However the trail arrives and is cut into batches, the result is that of applying whole transactions by their ends."""
    rng = random.Random(seed)
    records, live, number = [], {}, 0
    for n in range(60):
        if live and rng.random() < 0.75:
            t = rng.choice(list(live))
            live[t] -= 1
            records.append(rec("a", rng.choice("IUD"), rng.randint(0, 9), t, live[t] == 0 or None, V=f"v{n}"))
            if not live[t]:
                del live[t]
        elif rng.random() < 0.3:
            records.append(rec("a", "U", rng.randint(0, 9), V=f"v{n}"))
        else:
            number += 1
            live[number] = rng.randint(1, 4)
    ends = {r["txn_id"]: i for i, r in enumerate(records) if r["txn_end"]}
    done = sorted((ends.get(r["txn_id"], i), i) for i, r in enumerate(records) if r["txn_id"] is None or r["txn_id"] in ends)
    want = {}
    for _, i in done:
        r = records[i]
        want.pop(r["key"]["ID"], None)
        if r["op"] != "D":
            want[r["key"]["ID"]] = r["after"]["V"]
    replica, trail = replica_of(spark, tmp_path / "r", "a"), Trail(spark, str(tmp_path / "t"))
    at = 0
    while at < len(records):
        step = rng.randint(8, 30)
        trail.append(records[at : at + step])
        at += step
        R.replicate_all(trail, replica, {"a": ["ID"]}, rng.randint(3, 20), mixed=True)
    assert dict(rows(replica.table("a"))) == want
    held = [i + 1 for i, r in enumerate(records) if r["txn_id"] is not None and r["txn_id"] not in ends]
    assert replica.pointer().cursor == (min(held) - 1 if held else len(records))


def written(path):
    return sum(f.stat().st_size for f in Path(path).rglob("*.parquet"))


def test_a_batch_writes_what_it_changes_and_not_the_table(spark, tmp_path):
    replica, trail = replica_of(spark, tmp_path / "r", "a", kind="ID bigint, V string, W string", keep=50, small_bytes=1 << 10), Trail(spark, str(tmp_path / "t"))
    big = spark.range(40_000).selectExpr("id AS ID", "sha2(cast(id AS string), 512) AS V", "sha2(cast(-id AS string), 512) AS W")
    replica.publish({"a": replica.stage("a", big, ["ID"])}, 1, 0)
    whole, base = written(tmp_path / "r"), dict(replica.pointer().tables["a"].buckets)
    want = {r.ID: (r.V, r.W) for r in big.collect()}
    rng, depth = random.Random(1), 0
    for b in range(9):
        ids = rng.sample(range(41_000), 60)
        trail.append([rec("a", "D", i) if i % 3 == 0 else rec("a", "U", i, V=f"v{b}") for i in ids])
        for i in ids:
            want.pop(i, None) if i % 3 == 0 else want.update({i: (f"v{b}", want.get(i, (None, None))[1])})
        R.replicate_all(trail, replica, {"a": ["ID"]}, 1000)
        depth = max(depth, *(len(d) for d in replica.pointer().tables["a"].deltas.values()))
        assert {r.ID: (r.V, r.W) for r in replica.table("a").read().collect()} == want, b
    stored = replica.pointer().tables["a"]
    assert stored.buckets == base and written(tmp_path / "r") - whole < whole / 10
    assert depth < 2 * V.FAN and {d.level for ds in stored.deltas.values() for d in ds} >= {1}
    trail.append([{"op": "U", "table": "a", "key": {"ID": 90_000}, "before_key": {"ID": 1}, "after": {"ID": 90_000, "V": "moved"}}])
    want[90_000] = ("moved", want.pop(1, (None, None))[1])
    R.replicate_all(trail, replica, {"a": ["ID"]}, 1000)
    assert {r.ID: (r.V, r.W) for r in replica.table("a").read().collect()} == want and replica.pointer().tables["a"].buckets == base
    trail.append([rec("a", "U", i, V=hashlib.sha512(b"%d" % i).hexdigest(), W="all") for i in range(40_000)])
    R.replicate_all(trail, replica, {"a": ["ID"]}, 1 << 20)
    trail.append([rec("a", "D", i) for i in range(4)])
    R.replicate_all(trail, replica, {"a": ["ID"]}, 1 << 20)
    want.update({i: (hashlib.sha512(b"%d" % i).hexdigest(), "all") for i in range(40_000)})
    for i in range(4):
        want.pop(i, None)
    after = replica.pointer().tables["a"]
    assert {r.ID: (r.V, r.W) for r in replica.table("a").read().collect()} == want and after.buckets != base


def test_a_first_load_is_one_batch(spark, tmp_path):
    replica, trail = replica_of(spark, tmp_path / "r", "a"), Trail(spark, str(tmp_path / "t"))
    trail.append([rec("a", "I", i, V="x") for i in range(300)])
    assert R.replicate_all(trail, replica, {"a": ["ID"]}, 10) == 300 and replica.pointer().version == 1
    trail.append([rec("a", "I", i, V="y") for i in range(30)])
    assert R.replicate_all(trail, replica, {"a": ["ID"]}, 10) == 330 and replica.pointer().version == 4


def test_net_changes_come_to_the_same(spark):
    rng = random.Random(3)
    box = lambda name: f"struct<{name}:string>"
    kind = f"ord bigint, kind string, id int, a {box('a')}, b {box('b')}"
    for _ in range(3):
        made = []
        for o in range(80):
            k = rng.choice(["delete", "full", "partial", "partial"])
            value = lambda p: None if k == "delete" or (k == "partial" and rng.random() < p) else (rng.choice([None, f"v{o}"]),)  # noqa: B023, E731
            made.append((o, k, rng.randint(0, 9), value(0.5), value(0.7)))
        stored = spark.createDataFrame([(i, "s", "t") for i in range(5)], "id int, a string, b string")
        all_ = spark.createDataFrame(made, kind)
        net = C.net_changes(all_, ["id"])
        got = lambda c: sorted(map(tuple, C.fold(stored, c, ["id"]).collect()), key=str)  # noqa: B023, E731
        assert got(net) == got(all_) and net.groupBy("id", "kind").count().filter("count > 1").count() == 0
        parts = [C.net_changes(all_.filter(f"ord % 80 BETWEEN {a} AND {a + 19}"), ["id"]) for a in range(0, 80, 20)]
        again = C.net_changes(parts[0].union(parts[1]).union(parts[2]).union(parts[3]), ["id"])
        assert got(again) == got(all_)


def test_a_writer_whose_claim_was_taken_over_cannot_publish(spark, tmp_path):
    first = replica_of(spark, tmp_path / "r", "a")
    second = V.Replica(spark, str(tmp_path / "r"), buckets=4)
    with first.claimed():
        made = first.stage("a", spark.createDataFrame([(1, "x")], "ID int, V string"), ["ID"])
        with second.claimed():
            with pytest.raises(V.Fenced):
                first.publish({"a": made}, 1, 1)
            second.publish({"a": second.stage("a", spark.createDataFrame([(2, "y")], "ID int, V string"), ["ID"])}, 1, 1)
    assert rows(second.table("a")) == [(2, "y")]


def test_dead_letters_say_why(spark):
    from pyspark.sql import types as T

    kind = "op string, key map<string,string>, after map<string,string>, before_key map<string,string>"
    bad = [("U", {"ID": "1"}, {"ID": "1", "N": "x"}, None), ("X", {"ID": None}, {}, None), ("U", {"ID": "1"}, {"N": "5"}, {})]
    schema = T.StructType([T.StructField("ID", T.LongType()), T.StructField("N", T.IntegerType())])
    got = [r[0] for r in spark.createDataFrame(bad, kind).select(R.reasons(schema, ["ID"])).collect()]
    assert got == ["after.N is no int", "op is not I, U or D; key.ID is null", None]


@pytest.mark.parametrize("mode, atomic, held", [("auto", True, True), ("on", True, True), ("on", False, False), ("off", True, False)])
def test_the_gate_of_whole_transactions(spark, tmp_path, monkeypatch, mode, atomic, held):
    from ferryline.operators import sinks
    from ferryline.project import CdcConfig, Config, Project, SourceConfig, TargetConfig

    spark.createDataFrame([(1, "x", 1)], "id bigint, v string, n bigint").write.parquet(str(tmp_path / "src" / "a.parquet"))
    p = Project(spark, Config(SourceConfig(path=str(tmp_path / "src"), keys={"a": ["id"]}), TargetConfig(path=str(tmp_path / "dst")), cdc=CdcConfig(txn_apply=mode)))
    p.register({"e": {"tables": ["a"], "watermarks": {}, "source": p.identity()}})
    p.trail("e").append([{"op": "I", "table": "a", "key": {"id": 5}, "after": {"id": 5, "v": "y", "n": 2}, "txn_id": 3}])
    real = sinks.probe
    monkeypatch.setattr(sinks, "probe", lambda *a: real(*a) | {"atomic": atomic})
    assert p.replicat("e", False)["a"]["cursor"] == (0 if held else 1)
    p.config.cdc.txn_apply = "perhaps"
    with pytest.raises(ValueError, match="txn_apply"):
        p.replicat("e", False)


def test_a_failing_batch_is_tried_again(spark, tmp_path, monkeypatch):
    replica, trail = replica_of(spark, tmp_path / "r", "a"), Trail(spark, str(tmp_path / "t"))
    trail.append([rec("a", "I", 1, V="x")])
    real, calls = V.Replica.publish, []

    def flaky(self, *a, **k):
        calls.append(1)
        return real(self, *a, **k) if len(calls) > 2 else 1 / 0

    monkeypatch.setattr(V.Replica, "publish", flaky)
    assert R.replicate_all(trail, replica, {"a": ["ID"]}, retries=2) == 1 and len(calls) == 3 and rows(replica.table("a")) == [(1, "x")]
    calls.clear()
    trail.append([rec("a", "I", 2, V="x")])
    with pytest.raises(R.Outage):
        R.replicate_all(trail, replica, {"a": ["ID"]}, retries=2, answers=lambda: False)
    assert len(calls) == 1


def refusing(monkeypatch, refused, calls=None):
    """Tables that can't be written with a row whose V is one of some."""
    real = R._staged

    def staged(target, changes, keys):
        if calls is not None:
            calls.append(1)
        if changes.filter(R.F.col("V.V").isin(*refused)).count():
            raise RuntimeError("the table takes no such row")
        return real(target, changes, keys)

    monkeypatch.setattr(R, "_staged", staged)


@pytest.mark.parametrize("at", [[0], [39], [7, 8, 30]])
def test_records_that_fail_a_batch_are_found_and_parked(spark, tmp_path, monkeypatch, at):
    replica, trail, parked = replica_of(spark, tmp_path / "r", "a", "b"), Trail(spark, str(tmp_path / "t")), {}
    trail.append([rec("a", "I", i, V="no" if i in at else f"v{i}") for i in range(40)] + [rec("b", "I", 1, V="x")])
    refusing(monkeypatch, ["no"])
    park = lambda table, bad: parked.setdefault(table, []).append({r["seq"]: r["reason"] for r in bad.collect()})
    assert R.replicate_all(trail, replica, {"a": ["ID"], "b": ["ID"]}, retries=1, park=park) == 41
    assert parked == {"a": [dict.fromkeys([i + 1 for i in at], "RuntimeError: the table takes no such row")]}
    assert rows(replica.table("a")) == sorted(((i, f"v{i}") for i in range(40) if i not in at), key=str) and rows(replica.table("b")) == [(1, "x")]


def test_what_is_not_parked(spark, tmp_path, monkeypatch):
    replica, trail, parked = replica_of(spark, tmp_path / "r", "a"), Trail(spark, str(tmp_path / "t")), []
    trail.append([rec("a", "I", i, V="no" if i < 3 else "yes") for i in range(6)])
    refusing(monkeypatch, ["no"], calls := [])
    run = lambda **options: R.replicate_all(trail, replica, {"a": ["ID"]}, park=lambda t, bad: parked.append(bad), **options)
    with pytest.raises(RuntimeError, match="no such row"):  # nothing is looked for without retries
        run()
    assert len(calls) == 1
    with pytest.raises(ValueError, match="more than 2 changes"):
        run(retries=1, most_parked=2)
    up = iter([True, True, True])  # an end that goes away while records are looked for
    with pytest.raises(R.Outage):
        run(retries=1, answers=lambda: next(up, False))
    assert not parked and replica.pointer().applied().cursor == 0 and rows(replica.table("a")) == []
    monkeypatch.undo()
    assert run() == 6 and len(rows(replica.table("a"))) == 6


def test_a_failing_key_move_is_not_parked(spark, tmp_path, monkeypatch):
    replica, trail = replica_of(spark, tmp_path / "r", "a"), Trail(spark, str(tmp_path / "t"))
    trail.append([rec("a", "I", 1, V="x"), rec("a", "U", 2, V="no") | {"before_key": {"ID": 1}}])
    refusing(monkeypatch, ["no"])
    with pytest.raises(ValueError, match="key move"):
        R.replicate_all(trail, replica, {"a": ["ID"]}, retries=1, park=lambda *a: None)
    assert replica.pointer().applied().cursor == 0


def test_a_failure_that_passes_parks_nothing(spark):
    """A trial that fails now and then is no record's fault."""
    records, calls = spark.range(1, 9).withColumnRenamed("id", "seq"), []

    def make(some):
        calls.append(some.count())
        if len(calls) in (1, 2):
            raise RuntimeError("a moment's trouble")
        return None

    assert R.isolated(make, records, R.F.col("seq"), 5, 2) == (None, {}) and calls[-1] == 8


def test_both_sources_keep_the_contract(spark, tmp_path):
    from ferryline.sources.contract import Source
    from ferryline.sources.jdbc import JdbcSource
    from ferryline.sources.tables import ParquetSource

    spark.range(5).write.parquet(str(tmp_path / "t.parquet"))
    at = ParquetSource(spark, str(tmp_path))
    assert isinstance(at, Source) and isinstance(JdbcSource(spark, "mysql", "x"), Source)
    pinned = at.snapshot("t")
    spark.range(3).write.mode("append").parquet(str(tmp_path / "t.parquet"))
    assert (at.count("t"), at.count("t", pinned), at.rows("t", ["id"], snapshot=pinned).count()) == (8, 5, 5)
    assert at.bounds("t", "id") == (0, 4) and at.ping() and not ParquetSource(spark, str(tmp_path / "none")).ping()

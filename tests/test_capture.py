"""Capture from recorded decoding output: peek, trail, advance; crashes, epochs, and the project's verbs."""

import json

import pytest

from ferryline.project import Config, Project
from ferryline.sources import slot as S
from ferryline.sources.trail import Trail
from ferryline.streaming import capture as C

KEYS = {"t": ["id"]}


def txn(xid, at, *changes):
    """The lines of a transaction, a position each."""
    place = lambda n: f"0/{at + n:X}"
    lines = [f"table public.t: {c}" for c in changes]
    return [(place(0), f"BEGIN {xid}"), *((place(n + 1), x) for n, x in enumerate(lines)), (place(len(lines) + 1), f"COMMIT {xid}")]


@pytest.fixture
def recorded(tmp_path):
    at = S.Recording(str(tmp_path / "log"))
    at.put(1, txn(5, 16, "INSERT: id[integer]:1 v[text]:'a'", "INSERT: id[integer]:2 v[text]:'b'") + txn(6, 32, "UPDATE: id[integer]:1 v[text]:'c'"))
    at.put(2, txn(7, 64, "DELETE: id[integer]:2", "UPDATE: old-key: id[integer]:1 new-tuple: id[integer]:9 v[text]:'c'"))
    (tmp_path / "log" / "identity.json").write_text(json.dumps({"system": "77", "timeline": 1}))
    return at


def seen(trail):
    return [(r["seq"], r["op"], r["key"]["id"], r["txn_id"], bool(r["txn_end"])) for r in trail.read().orderBy("seq").collect()]


ALL = [(1, "I", "1", 5, False), (2, "I", "2", 5, True), (3, "U", "1", 6, True), (4, "D", "2", 7, False), (5, "U", "9", 7, True)]


def test_peek_trail_advance(spark, tmp_path, recorded):
    trail, state = Trail(spark, str(tmp_path / "trail")), str(tmp_path / "state")
    assert recorded.confirmed("main") == -1
    assert C.capture(spark, recorded.root, "main", trail, KEYS, state) == "77:1"
    assert seen(trail) == ALL and recorded.confirmed("main") == 2
    C.capture(spark, recorded.root, "main", trail, KEYS, state, "77:1")
    assert seen(trail) == ALL
    recorded.put(3, txn(8, 128, "INSERT: id[integer]:3 v[text]:null"))
    C.capture(spark, recorded.root, "main", trail, KEYS, state, "77:1")
    assert seen(trail)[5:] == [(6, "I", "3", 8, True)] and recorded.confirmed("main") == 3
    assert recorded.confirmed("other") == -1  # slots don't move each other


@pytest.mark.parametrize("fresh", [False, True])
def test_a_crash_between_trail_and_advance(spark, tmp_path, recorded, monkeypatch, fresh):
    """The batch is written and its commit is not: run again, also without the stream's own state, it repeats nothing."""
    trail, state = Trail(spark, str(tmp_path / "trail")), str(tmp_path / "state")
    real = Trail.append_frame

    def dies(self, df, order):
        real(self, df, order)
        raise OSError("killed")

    monkeypatch.setattr(Trail, "append_frame", dies)
    with pytest.raises(Exception, match="killed"):
        C.capture(spark, recorded.root, "main", trail, KEYS, state)
    assert seen(trail) == ALL and recorded.confirmed("main") == -1
    monkeypatch.undo()
    recorded.put(3, txn(8, 128, "DELETE: id[integer]:9"))
    C.capture(spark, recorded.root, "main", trail, KEYS, f"{state}-new" if fresh else state)
    assert seen(trail) == [*ALL, (6, "D", "9", 8, True)] and recorded.confirmed("main") >= 2


def test_a_crash_inside_a_batch(spark, tmp_path, recorded):
    """The trail has a part of a transaction: only the rest is appended."""
    trail, whole = Trail(spark, str(tmp_path / "trail")), Trail(spark, str(tmp_path / "whole"))
    C.capture(spark, recorded.root, "a", whole, KEYS, str(tmp_path / "sa"))
    first = whole.read(0, 4).withColumnRenamed("seq", "ord")
    trail.append_frame(first, "ord")
    C.capture(spark, recorded.root, "b", trail, KEYS, str(tmp_path / "sb"))
    assert seen(trail) == ALL


def test_another_server_is_refused(spark, tmp_path, recorded):
    trail, state = Trail(spark, str(tmp_path / "trail")), str(tmp_path / "state")
    with pytest.raises(C.AnotherServer):
        C.capture(spark, recorded.root, "main", trail, KEYS, state, "77:2")
    C.capture(spark, recorded.root, "main", trail, KEYS, state)
    reset = S.Recording(str(tmp_path / "reset"))
    reset.put(1, txn(1, 1, "DELETE: id[integer]:1"))
    with pytest.raises(ValueError, match="reset"):
        C.capture(spark, reset.root, "main", trail, KEYS, str(tmp_path / "s2"))
    (tmp_path / "log" / "changes-0000000009.jsonl").write_text('{"lsn": "0/FF", "data": "BEG')
    with pytest.raises(Exception, match="inside a line"):
        C.capture(spark, recorded.root, "main", trail, KEYS, state)


def test_the_verbs(spark, tmp_path, recorded):
    src = tmp_path / "src"
    spark.createDataFrame([(9, "c")], "id int, v string").write.parquet(str(src / "t.parquet"))
    path = tmp_path / "p.toml"
    path.write_text(f'[source]\npath = "{src}"\nrecording = "{recorded.root}"\n[source.keys]\nt = ["id"]\n[target]\npath = "{tmp_path / "dst"}"\n')
    p = Project(spark, Config.load(str(path)))
    assert p.extract("log", "version")["captured"] == 5
    assert p.replicat("log")["t"] == {"cursor": 5, "deleted": 0} and p.test_data() != []
    assert [tuple(r) for r in p.replica().table("t").read().collect()] == [(9, "c")]
    assert p.extracts()["log"]["epoch"] == "77:1" and p.extract("log", "version")["captured"] == 0
    recorded.put(3, txn(8, 128, "DELETE: id[integer]:9"))
    p.extract("log", "version")
    p.replicat("log")
    assert p.replica().table("t").read().count() == 0
    (tmp_path / "log" / "identity.json").write_text(json.dumps({"system": "78", "timeline": 1}))
    with pytest.raises(C.AnotherServer):
        p.extract("log", "version")


def test_how_far_a_slot_is_behind(spark, tmp_path, recorded):
    trail, lag = Trail(spark, str(tmp_path / "trail")), lambda: C.behind_slot(spark, recorded.root, "main", trail)
    assert lag() == {"mode": "logical", "files_behind": 2, "bytes_behind": None}
    C.capture(spark, recorded.root, "main", trail, KEYS, str(tmp_path / "state"))
    assert lag() == {"mode": "logical", "files_behind": 0, "bytes_behind": 0}
    recorded.put(3, txn(8, 128, "DELETE: id[integer]:9"))
    recorded.put(4, txn(9, 256, "INSERT: id[integer]:3 v[text]:'d'"))
    assert lag() == {"mode": "logical", "files_behind": 2, "bytes_behind": 256 + 2 - (64 + 3)}
    (tmp_path / "log" / "changes-0000000002.jsonl").unlink()  # from the trail's tail then
    assert lag()["bytes_behind"] == 256 + 2 - C.trail_tail(trail)[0]


def test_how_far_binary_logs_are_ahead(spark, tmp_path):
    trail, logs = Trail(spark, str(tmp_path / "trail")), tmp_path / "logs"
    logs.mkdir()
    (logs / "bin.000007").write_bytes(b"x" * 500)
    assert C.behind_binlog(str(logs), trail) == {"mode": "binlog", "files_behind": 1, "bytes_behind": 500}
    trail.append([{"op": "I", "table": "t", "key": {"id": 1}, "after": {"id": 1}, "source_pos": [(7 << 48) | 420, 0]}])
    assert C.behind_binlog(str(logs), trail) == {"mode": "binlog", "files_behind": 0, "bytes_behind": 80}
    (logs / "bin.000008").write_bytes(b"x" * 300)
    (logs / "bin.000009").write_bytes(b"x" * 40)
    assert C.behind_binlog(str(logs), trail) == {"mode": "binlog", "files_behind": 2, "bytes_behind": 420}
    (logs / "bin.000007").unlink()
    assert C.behind_binlog(str(logs), trail) == {"mode": "binlog", "files_behind": 2, "bytes_behind": 340}


def test_how_far_versions_are_ahead(spark, tmp_path, capsys):
    from ferryline import cli

    src, path = tmp_path / "src", tmp_path / "p.toml"
    put = lambda *rows: spark.createDataFrame(list(rows), "id int, version bigint").write.mode("append").parquet(str(src / "t.parquet"))
    put((1, 5), (2, None))
    path.write_text(f'[source]\npath = "{src}"\n[source.keys]\nt = ["id"]\n[target]\npath = "{tmp_path / "dst"}"\n')
    p = Project(spark, Config.load(str(path)))
    p.extract("e", "version")
    assert p.source_lag("e") == {"mode": "version", "rows_behind": 0, "tables": {}}
    put((3, 6), (4, 5))
    assert cli.main(["--config", str(path), "lag", "e"], spark) == 0
    assert json.loads(capsys.readouterr().out) == {"written": 2, "applied": 0, "behind": 2, "source": {"mode": "version", "rows_behind": 1, "tables": {"t": 1}}}
    p.config.source.path = str(tmp_path / "elsewhere")
    assert "SourceChanged" in p.source_lag("e")["error"]


def test_a_file_is_read_by_more_than_one_task(spark, tmp_path, monkeypatch):
    """Pieces of a file, cut anywhere, hold each of its lines once, in places that rise."""
    at = S.Recording(str(tmp_path / "log"))
    at.put(1, [(f"0/{n:X}", f"line {n} é") for n in range(50)])
    at.put(2, txn(5, 99, "INSERT: id[integer]:1"))
    for piece in (1, 7, 64, 1 << 20):
        monkeypatch.setattr(S, "PIECE", piece)
        reader = S._SlotReader({"path": at.root})
        parts = reader.partitions({"file": -1}, {"file": 2})
        rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
        assert [r["line"] for r in rows[:50]] == [f"line {n} é" for n in range(50)] and len(rows) == 53
        assert [r["ord"] for r in rows] == sorted({r["ord"] for r in rows}) and (piece > 64 or len(parts) > 30)
    monkeypatch.setattr(S, "PIECE", 10)
    trail = Trail(spark, str(tmp_path / "trail"))
    C.capture(spark, at.root, "main", trail, KEYS, str(tmp_path / "state"))
    assert seen(trail) == [(1, "I", "1", 5, True)]


def test_a_log_is_recorded_by_more_than_one_task(spark, tmp_path):
    from pyspark.sql import functions as F

    from ferryline.plans import capture_catalog as Q

    rows = spark.range(400).select(F.col("id").alias("k"))
    for number in (1, 2):
        Q._recorded(spark, f"file://{tmp_path}/log", number, Q._transactions(rows, F.concat(F.lit("DELETE: id[bigint]:"), F.col("k").cast("string"))))
    found = S.Recording(str(tmp_path / "log"))
    assert found.numbers() == [*range(1, len(found.numbers()) + 1)] and len(found.numbers()) > 4
    lines = [[json.loads(x) for x in open(found.file(n))] for n in found.numbers()]
    assert all(x[0]["data"].startswith("BEGIN") and x[-1]["data"].startswith("COMMIT") for x in lines)
    text = [r["data"] for x in lines for r in x]
    assert len(text) == 2 * (400 + 16) and text[: len(text) // 2] == text[len(text) // 2 :] and text[1:51] == [f"table public.orders: DELETE: id[bigint]:{k}" for k in range(50)]


def test_what_the_trail_has_is_not_read_again(spark, tmp_path, recorded, monkeypatch):
    """Of changes before the trail's tail no row is read, and they still end their transaction with those that follow."""
    trail = Trail(spark, str(tmp_path / "trail"))
    C.capture(spark, recorded.root, "a", trail, KEYS, str(tmp_path / "a"))
    asked = []
    real = C.parsed
    monkeypatch.setattr(C, "parsed", lambda lines, keys, past: asked.append(past) or real(lines, keys, past))
    recorded.put(3, txn(8, 128, "INSERT: id[integer]:3 v[text]:null"))
    C.capture(spark, recorded.root, "b", trail, KEYS, str(tmp_path / "b"))
    assert asked == [64 + 2] and seen(trail) == [*ALL, (6, "I", "3", 8, True)]

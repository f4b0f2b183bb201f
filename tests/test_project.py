import json
import threading
import urllib.error
import urllib.request

import pytest

from ferryline import cli, service
from ferryline.operators import sinks
from ferryline.plans.ledger import ResumeDrift
from ferryline.plans.model import ForeignKey, Schema, Table, View
from ferryline.project import Config, Project, SourceChanged
from ferryline.streaming.replicate import Outage


@pytest.fixture
def project(spark, tmp_path):
    src = tmp_path / "src"
    spark.createDataFrame([(i, f"n{i}", i * 1.5, i) for i in range(20)], "id bigint, name string, v double, version bigint").write.parquet(str(src / "a.parquet"))
    spark.createDataFrame([(1, "x"), (1, "x"), (None, "y")], "k int, s string").write.parquet(str(src / "b.parquet"))
    path = tmp_path / "p.toml"
    path.write_text(f'[source]\npath = "{src}"\n[source.keys]\na = ["id"]\n[target]\npath = "{tmp_path / "dst"}"\n[options]\nsample_rows = 0\n')
    return str(path), Project(spark, Config.load(str(path)))


def test_migrate_validate_and_damage(project, spark, capsys):
    path, p = project
    assert cli.main(["--config", path, "migrate"], spark) == 0
    assert p.migrate()["rows"] == 0 and {r["status"] for r in p.status()} == {"loaded"}
    for verb in ("test", "test-count", "test-data", "test-index"):
        assert cli.main(["--config", path, verb], spark) == 0, verb
    spark.createDataFrame([(1, "x", "b:0")], "k int, s string, chunk_id string").write.mode("append").partitionBy("chunk_id").parquet(p.target_path("b"))
    assert [f.table for f in p.test_count()] == ["b"] and "3 in the target" in p.test_data()[0].message
    capsys.readouterr()
    assert cli.main(["--config", path, "assess", "--format", "json"], spark) == 0
    assert json.loads(capsys.readouterr().out)["inventory"]["tables"] == 2
    assert "CREATE TABLE `a`" in p.export()["ddl"]
    assert list(p.monitor(0, 3))[-1]["percent"] == 100
    p.config.options.parallelism = 9
    with pytest.raises(ResumeDrift):
        p.migrate()


def test_capture_and_apply(project, spark):
    _, p = project
    assert p.extract("e", "version")["captured"] == 20 and p.extract("e", "version")["captured"] == 0
    assert p.replicat("e")["a"] == {"cursor": 20, "deleted": 0}
    src = f"{p.config.source.path}/a.parquet"
    spark.createDataFrame([(3, "again", None, 50), (99, "new", 1.0, 51)], "id bigint, name string, v double, version bigint").write.mode("append").parquet(src)
    assert p.extract("e", "version")["captured"] == 2
    p.replicat("e", False)
    got = {r["id"]: (r["name"], r["v"]) for r in p.replica().table("a").read().collect()}
    assert got[3] == ("again", None) and got[99] == ("new", 1.0) and len(got) == 21
    assert p.lag("e") == {"written": 22, "applied": 22, "behind": 0} and len(p.trail("e").listed()) > 1
    assert p.purge("e") and len(p.trail("e").listed()) == 1 and not p.purge("e")
    assert list(p.extracts()) == ["e"] and p.drop_extract("e", with_trail=True) and not p.drop_extract("e") and not p.trail("e").listed()


def test_bad_values_are_parked_and_another_source_is_refused(project, spark):
    _, p = project
    p.extract("e", "version")
    p.trail("e").append([{"op": "U", "table": "a", "key": {"id": "seven"}, "after": {"id": "seven", "name": "x"}}])
    assert p.replicat("e")["a"]["cursor"] == 21
    (parked,) = spark.read.json(p.dead_letters_path("e")).collect()
    assert parked["for_table"] == "a" and "seven" in parked["record"] and p.captures()["e"]["dead_letters"] == 1
    p.config.source.path += "/elsewhere"
    p.schema = lambda: None
    with pytest.raises(SourceChanged):
        p.extract("e", "version")


def test_migrate_tries_failed_chunks_again_and_writes_scripts(project, spark, monkeypatch):
    _, p = project
    real, calls = sinks.load_range, []

    def fails_in_bulk(df, path, chunk="chunk_id", ids=None):
        calls.append(len(ids))
        if len(ids) > 1 or ids == ["a:1"]:
            raise OSError("no luck")
        return real(df, path, chunk, ids)

    monkeypatch.setattr(sinks, "load_range", fails_in_bulk)
    out = p.migrate()
    assert out["failed_chunks"] == 1 and not out["complete"] and list(out["errors"]) == ["a"] and max(calls) > 1
    monkeypatch.undo()
    assert p.migrate()["complete"] and p.target_rows(p.schema().tables[0]).count() == 20
    before = open(f"{p.config.target.path}/state/before_load.sql").read()
    assert before.index("DROP TABLE IF EXISTS `b`") < before.index("DROP TABLE IF EXISTS `a`") < before.index("CREATE TABLE `a`")


def test_migrate_runs_the_statements_in_the_catalogue(project, spark, monkeypatch):
    path, p = project
    p.config.target.catalog = "moved"
    known = p.schema()
    views = [View("low", "SELECT id, nvl(name, '-') AS name FROM mid WHERE id < 5"), View("mid", "SELECT id, name FROM a WHERE id < 10"), View("bad", "SELECT nothing FROM a")]
    monkeypatch.setattr(Project, "schema", lambda self: Schema(known.name, known.tables, views))
    try:
        out = p.migrate()
        assert out["rows"] == 23 and out["catalog"]["made"] == 4 and list(out["catalog"]["failed"]) == ["`bad`"] and not out["complete"]
        views.pop()
        again = p.migrate()
        assert again["catalog"] == {"made": 4, "failed": {}} and again["complete"] and again["rows"] == 0
        assert spark.catalog.currentDatabase() == "default"
        assert sorted(map(tuple, spark.table("moved.b").collect()), key=str) == sorted([(1, "x"), (1, "x"), (None, "y")], key=str)
        assert spark.table("moved.a").columns == ["id", "name", "v", "version"] and spark.table("moved.low").count() == 5
        scan = spark.table("moved.low")._jdf.queryExecution().executedPlan().toString()
        assert "LessThan(id,5)" in scan and "ReadSchema: struct<id:bigint,name:string>" in scan
        for taken in ("CREATE TABLE moved.b USING parquet AS SELECT 1 AS other", "CREATE VIEW moved.mid AS SELECT 1 AS other"):
            name = taken.split()[2]
            spark.sql(f"DROP {taken.split()[1]} {name}")
            spark.sql(taken)
            made = p.migrate()["catalog"]
            assert name.split(".")[1] in str(made["failed"]) and spark.table(name).columns == ["other"]
            spark.sql(f"DROP {taken.split()[1]} {name}")
            assert not p.publish()["failed"]
    finally:
        spark.sql("DROP DATABASE IF EXISTS moved CASCADE")
    assert p.target_rows(known.tables[0]).count() == 20
    p.config.target.catalog = ""
    with pytest.raises(ValueError, match="names a database"):
        p.publish()


def test_doctor_and_orphans(project, spark, capsys):
    path, p = project
    assert cli.main(["--config", path, "doctor"], spark) == 0 and json.loads(capsys.readouterr().out)["source_tables"] == 2
    p.config.source.keys["b"] = ["k"]
    replica = p.replica()
    rows = {"a": spark.range(5).selectExpr("id", "id AS parent"), "b": spark.range(3).selectExpr("id AS k")}
    replica.publish({n: replica.stage(n, df, [df.columns[0]]) for n, df in rows.items()}, 0, 0)
    key = ForeignKey("fk", ("parent",), "b", ("k",))
    p.schema = lambda: Schema("s", [Table("a", (), None, ("id",), (key,)), Table("b", (), None, ("k",))])
    assert p.orphans(["a", "b"]) == {"a.fk": 2} and p.orphans(["a"]) == {}
    p.schema = lambda: 1 // 0
    assert not p.doctor()["healthy"]


def test_rows_without_a_version_are_captured(project, spark):
    _, p = project
    put = lambda table, rows: spark.createDataFrame(rows, "id bigint, name string, v double, version bigint").write.mode("append").parquet(f"{p.config.source.path}/{table}.parquet")
    p.config.source.keys["c"] = ["id"]
    put("a", [(50, "no version", 1.0, None)])
    put("c", [(1, "none", None, None), (2, "none", None, None)])
    got = lambda table: {r["id"]: r["name"] for r in p.replica().table(table).read().collect()}
    assert p.extract("e", "version", ["a", "c"])["captured"] == 23
    p.replicat("e")
    assert len(got("a")) == 21 and got("a")[50] == "no version" and got("c") == {1: "none", 2: "none"}
    put("a", [(51, "late", 1.0, None)])
    put("c", [(3, "first", None, 7)])
    assert p.extract("e", "version", ["a", "c"])["captured"] == 2 + 3
    p.replicat("e")
    assert len(got("a")) == 22 and got("a")[51] == "late" and got("c") == {1: "none", 2: "none", 3: "first"}
    assert p.extracts()["e"]["watermarks"] == {"a": 19, "c": 7} and p.extract("e", "version")["captured"] == 2 + 2


def test_rpc(project):
    _, p = project
    call = lambda m, role="viewer", **params: service.handle(p, {"jsonrpc": "2.0", "id": 1, "method": m, "params": params}, role)
    assert call("initialize")["result"]["serverInfo"]["name"] == "ferryline" and call("ping")["result"] == {}
    names = lambda role: {t["name"] for t in call("tools/list", role)["result"]["tools"]}
    assert "migrate" not in names("viewer") and "migrate" in names("operator") and "extract" in names("admin") - names("operator")
    assert call("tools/call", name="migrate")["error"]["code"] == service.FORBIDDEN
    assert call("tools/call", name="none")["error"]["code"] == service.UNKNOWN_METHOD and call("other")["error"]["code"] == service.UNKNOWN_METHOD
    assert call("tools/call", "admin", name="extract")["error"]["code"] == service.INVALID_PARAMS
    assert call("tools/call", "admin", name="replicat", arguments={"name": "none"})["result"]["isError"]
    assert call("tools/call", name="assess")["result"]["structuredContent"]["inventory"]["tables"] == 2
    assert service.handle(p, {"jsonrpc": "2.0", "method": "notifications/initialized"}, "viewer") is None
    assert service.handle(p, [], "viewer")["error"]["code"] == service.INVALID_REQUEST
    out = []
    service.serve_stdio(p, "viewer", ["nonsense\n", "\n"], out.append)
    assert json.loads(out[0])["error"]["code"] == service.PARSE_ERROR


def test_http(project):
    _, p = project
    server = service.http_server(p, {"secret": "viewer"})
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/"
    ask = lambda token: urllib.request.urlopen(urllib.request.Request(url, json.dumps({"jsonrpc": "2.0", "id": 1, "method": "ping"}).encode(), {"Authorization": f"Bearer {token}"}), timeout=10)
    assert json.load(ask("secret"))["result"] == {}
    with pytest.raises(urllib.error.HTTPError):
        ask("wrong")
    server.shutdown()


def test_unknown_settings_raise(tmp_path):
    (tmp_path / "x.toml").write_text("[other]\na = 1\n")
    with pytest.raises(ValueError):
        Config.load(str(tmp_path / "x.toml"))


def test_two_captures_into_one_replica(project, spark):
    """Each is applied, lags and is purged by its own cursor; a repeated batch parks nothing twice."""
    _, p = project
    p.config.source.keys["c"] = ["id"]
    spark.createDataFrame([(i, "c", 0.0, i) for i in range(7)], "id bigint, name string, v double, version bigint").write.parquet(f"{p.config.source.path}/c.parquet")
    assert p.extract("one", "version", ["a"])["captured"] == 20 and p.extract("two", "version", ["c"])["captured"] == 7
    assert p.replicat("one", False)["a"]["cursor"] == 20
    assert p.lag("two") == {"written": 7, "applied": 0, "behind": 7} and p.purge("two") == []
    assert p.replicat("two", False)["c"]["cursor"] == 7 and p.lag("two")["behind"] == 0
    assert p.replica().table("a").read().count() == 20 and p.replica().table("c").read().count() == 7
    bad = {"op": "U", "table": "c", "key": {"id": "x"}, "after": {"id": "x"}}
    p.trail("two").append([bad])
    with pytest.MonkeyPatch.context() as m:
        m.setattr("ferryline.streaming.versions.Replica.publish", lambda *a, **k: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            p.replicat("two", False)
        m.setattr(type(p.source()), "ping", lambda self: False)
        with pytest.raises(Outage):
            p.replicat("two", False)
    p.replicat("two", False)
    (parked,) = spark.read.json(p.dead_letters_path("two")).collect()
    assert parked["reason"].startswith("after.id is no bigint") and parked["seq"] == 8 and p.captures()["two"]["dead_letters"] == 1
    assert p.drop_extract("two", with_trail=True) and "two" not in p.replica().pointer().streams and "one" in p.replica().pointer().streams
    assert p.extract("two", "version", ["c"])["captured"] == 7 and p.replicat("two", False)["c"]["cursor"] == 7

"""The command line: ``python -m ferryline.cli --config project.toml VERB``."""

from __future__ import annotations

import argparse
import json
from dataclasses import asdict

VERBS = ("assess", "report", "export", "migrate", "load", "resume", "status", "monitor", "test", "test-count", "test-data", "test-index", "extract", "replicat", "lag", "purge", "extracts", "doctor", "serve")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="ferryline", description=__doc__)
    p.add_argument("--config", required=True)
    p.add_argument("verb", choices=VERBS)
    p.add_argument("name", nargs="?", help="of an extract")
    p.add_argument("--version-column", default="version")
    p.add_argument("--sample", type=int)
    p.add_argument("--format", choices=("text", "json", "html"), default="text")
    p.add_argument("--refresh-tables", action="store_true")
    p.add_argument("--drop", action="store_true")
    p.add_argument("--with-trail", action="store_true", help="with --drop: remove the trail too")
    p.add_argument("--no-reconcile", action="store_true")
    return p


def main(argv: list[str] | None = None, spark=None) -> int:
    """0, or 1 if a check has findings or chunks are left."""
    from .project import Config, Project

    a = parser().parse_args(argv)
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("ferryline").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    project = Project(spark, Config.load(a.config))
    if a.verb in ("assess", "report"):
        print(getattr(project.assess(), a.format)())
    elif a.verb == "export":
        out = project.export()
        print(out["ddl"] + out["review"])
    elif a.verb in ("migrate", "load", "resume"):
        out = project.migrate()
        print(json.dumps(out))
        return 0 if out["complete"] else 1
    elif a.verb == "status":
        print(json.dumps(project.status(), indent=1))
    elif a.verb == "monitor":
        for x in project.monitor(5, 1_000_000):
            print(json.dumps(x), flush=True)
    elif a.verb.startswith("test"):
        found = project.test_data(a.sample) if a.verb == "test-data" else getattr(project, a.verb.replace("-", "_"))()
        print(json.dumps([asdict(f) for f in found], indent=1))
        return 1 if found else 0
    elif a.verb == "extract":
        print(json.dumps({"dropped": project.drop_extract(a.name, a.with_trail)} if a.drop else project.extract(a.name, a.version_column, refresh=a.refresh_tables), default=str))
    elif a.verb == "replicat":
        print(json.dumps(project.replicat(a.name, False if a.no_reconcile else None)))
    elif a.verb == "lag":
        print(json.dumps(project.lag(a.name) | {"source": project.source_lag(a.name)}))
    elif a.verb == "purge":
        print(json.dumps(project.purge(a.name)))
    elif a.verb == "extracts":
        print(json.dumps(project.captures(), indent=1, default=str))
    elif a.verb == "doctor":
        print(json.dumps(out := project.doctor()))
        return 0 if out["healthy"] else 1
    else:
        from .service import serve_stdio

        serve_stdio(project)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

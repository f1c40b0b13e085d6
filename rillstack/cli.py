"""`python -m rillstack.cli`: run, worker, pipelines, plugins, config, doctor, checkpoint, dlq, new, version."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import asdict

from rillstack import config

VERSION = "0.2"
TEMPLATE = """version = "{version}"

[pipelines.{name}]
source = {{ type = "jsonl", path = "in.jsonl" }}
stages = [{{ type = "filter", where = "value is not null" }}]
sinks = [{{ type = "stdout" }}]
"""


def _session():
    from pyspark.sql import SparkSession

    from rillstack.session import local_session

    return SparkSession.getActiveSession() or local_session()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="rillstack")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("run", "worker", "pipelines", "config", "doctor"):
        c = sub.add_parser(name)
        c.add_argument("--config", required=True)
        c.add_argument("--env")
        if name == "run":
            c.add_argument("--pipeline", required=True)
            c.add_argument("--plan", action="store_true")
    sub.add_parser("plugins")
    sub.add_parser("version")
    sub.add_parser("new").add_argument("name")
    c = sub.add_parser("checkpoint")
    c.add_argument("--state", required=True)
    c.add_argument("--pipeline", required=True)
    c.add_argument("--source", required=True)
    c.add_argument("--delete", action="store_true")
    c = sub.add_parser("dlq")
    c.add_argument("action", choices=["list", "replay"])
    c.add_argument("--config", required=True)
    c.add_argument("--env")
    c.add_argument("--pipeline", required=True)
    c.add_argument("--mode", choices=["pipeline", "sink"], default="pipeline")
    c.add_argument("--stage")
    c.add_argument("--limit", type=int)
    return p


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    try:
        return globals()[f"do_{a.command}"](a)
    except config.ConfigError as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


def do_version(_) -> int:
    print(VERSION)
    return 0


def do_new(a) -> int:
    print(TEMPLATE.format(version=config.VERSION, name=a.name))
    return 0


def do_plugins(_) -> int:
    print(json.dumps(config.standard().names(), indent=1))
    return 0


def do_pipelines(a) -> int:
    print("\n".join(sorted(config.load(a.config)["pipelines"])))
    return 0


def do_config(a) -> int:
    doc = config.load(a.config)
    print(json.dumps({n: config.resolve(doc, n, a.env) for n in sorted(doc["pipelines"])}, indent=1, default=str))
    return 0


def do_doctor(a) -> int:
    """Each pipeline resolves, and all its components have factories."""
    doc, r, bad = config.load(a.config), config.standard(), 0
    for n in sorted(doc["pipelines"]):
        try:
            s = config.resolve(doc, n, a.env)
            for group, items in (("source", [s["source"]]), ("stage", s.get("stages", [])), ("sink", [*s["sinks"], *([s["dlq"]] if "dlq" in s else [])])):
                for x in items:
                    r.get(group, x.get("type", ""))
            print(f"ok {n}")
        except config.ConfigError as e:
            bad += 1
            print(f"bad {n}: {e}")
    return int(bad > 0)


def do_run(a) -> int:
    doc = config.load(a.config)
    settings = config.resolve(doc, a.pipeline, a.env)
    if a.plan:
        print(json.dumps(settings, indent=1, default=str))
        return 0
    print(json.dumps(asdict(config.build(_session(), settings, a.pipeline).run())))
    return 0


def do_worker(a) -> int:
    from rillstack.schedule import WorkerPool

    doc, spark = config.load(a.config), _session()
    jobs = {n: (lambda n=n: asdict(config.build(spark, config.resolve(doc, n, a.env), n).run())) for n in sorted(doc["pipelines"])}
    out = WorkerPool(jobs).run_once()
    print(json.dumps(out, default=str))
    return int(any(isinstance(x, Exception) for x in out.values()))


def do_checkpoint(a) -> int:
    from rillstack.state import SQLiteState

    state, key = SQLiteState(a.state), f"checkpoint:{a.pipeline}:{a.source}"
    if a.delete:
        state.delete(key)
    print(json.dumps(state.get(key)))
    return 0


def do_dlq(a) -> int:
    from pyspark.sql import DataFrame

    from rillstack import delivery
    from rillstack.operators.pipeline import Pipeline
    from rillstack.sinks.files import DeadLetterSink

    settings = config.resolve(config.load(a.config), a.pipeline, a.env)
    if settings.get("dlq", {}).get("type") != "dlq":
        raise config.ConfigError(f"pipeline {a.pipeline} keeps no dead letters")
    spark, sink = _session(), DeadLetterSink(settings["dlq"]["path"])
    table = sink.read(spark)
    which = {"pipeline_id": a.pipeline, "stage": a.stage, "limit": a.limit}
    if a.action == "list":
        for r in delivery.eligible(table, **which).orderBy("id").limit(a.limit or 100).collect():
            print(json.dumps(r.asDict(), default=str))
        return 0
    bound = config.build(spark, {k: v for k, v in settings.items() if k != "dlq"}, a.pipeline)
    source = bound.pipeline.source

    def again(rows: DataFrame) -> Pipeline:
        return Pipeline(rows, bound.pipeline.stages, a.pipeline)

    results, left = delivery.replay(table, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema), again, a.mode, bound.sinks, **which)
    print(json.dumps({r.outcome: r["count"] for r in results.groupBy("outcome").count().collect()}))
    sink.keep(left)
    return 0


if __name__ == "__main__":
    sys.exit(main())

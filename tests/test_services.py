"""AI stages with a stub, HTTP with a stub, configuration, schedules, metrics, command line."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from rillstack import ai, cli, config, observe, schedule
from rillstack.operators import pipeline as P
from rillstack.sinks.base import NullSink
from rillstack.sources import http
from rillstack.state import MembershipStore, MemoryState, SQLiteState, TTLStore


def test_templates():
    r = {"a": "{b}", "b": 2, "x": 9}
    assert ai.render("{a} {b} {none} {a.b} {a[0]} {}", r) == "{b} 2 {none} {a.b} {a[0]} {}"
    assert ai.parsed_json('```json\n{"a": 1}\n```') == {"a": 1}
    with pytest.raises(ValueError):
        ai.parsed_json("[1]")


def test_cache_and_budget():
    provider = ai.StubProvider(lambda p: "x" * 8)
    asker = ai.Asker(provider, ai.AnswerCache(1))
    assert [asker.ask(p) for p in ("a", "a", "b", "a")] == ["x" * 8] * 4 and provider.calls == 3
    with pytest.raises(ai.BudgetExceeded):
        ai.Asker(provider, None, ai.Budget(0.001, prompt_cost=1.0)).ask("long prompt here")
    spent = ai.Budget(0.004, answer_cost=1.0, scope="run")
    asker = ai.Asker(provider, None, spent)
    assert asker.ask("") and asker.ask("")
    with pytest.raises(ai.BudgetExceeded):
        asker.ask("")


def test_ai_stages(spark):
    rows = spark.createDataFrame([(1, "good"), (2, ""), (3, "bad")], "id long, t string")

    def answer(prompt):
        if "bad" in prompt:
            return "no json"
        return json.dumps({"category": "A", "confidence": 0.91239, "valid": True, "city": None, "t": "gut"})

    def run(stage):
        return sorted(P.Pipeline(rows).pipe(stage).tagged().select("*").collect(), key=lambda r: json.loads(r[P.RAW])["id"])

    make = lambda: ai.Asker(ai.StubProvider(answer))
    got = run(ai.classify(make, ["t"], ["A", "B"], "id long, t string, category string, category_confidence double", on_error="dlq"))
    assert [(r.category, r.category_confidence, r[P.OUTCOME]) for r in got] == [("A", 0.9124, "written"), ("A", 0.9124, "written"), (None, None, "errored")]
    other = lambda: ai.Asker(ai.StubProvider(lambda p: '{"category": "Z", "confidence": 0.9}'))
    assert {(r.category, r.category_confidence) for r in run(ai.classify(other, ["t"], ["A", "B"], "id long, category string, category_confidence double"))} == {("A", 0.0)}
    assert [r.city for r in run(ai.extract(make, "t", ["city"], "id long, t string, city string"))] == [None] * 3
    assert [r.t for r in run(ai.translate(make, ["t"], "German", "id long, t string"))] == ["gut", "", "bad"]
    assert [r[P.OUTCOME] for r in run(ai.validate(make, "r", "id long, t string", on_invalid="drop", on_error="drop"))] == ["written", "written", "dropped"]
    lists = lambda: ai.Asker(ai.StubProvider(lambda p: json.dumps([{"n": 1}])))
    assert [r[P.OUTCOME] for r in run(ai.batched(lists, "{t}", ["n"], "id long, n long", on_error="dlq"))].count("errored") in (0, 2, 3)


def test_http():
    calls, waits, clock = [], [], iter(range(0, 10000, 10))

    def transport(method, url, body, headers, timeout):
        calls.append((method, url))
        return (503, "") if len(calls) == 1 else (200, json.dumps({"n": len(calls)}))

    client = http.HttpClient("http://h/", transport=transport, sleep=waits.append, now=lambda: next(clock), cache=http.HttpCache())
    assert client.get("/a", {"q": 1}) == {"n": 2} == client.get("/a", {"q": 1}) and calls[-1] == ("GET", "http://h/a?q=1")
    assert client.post("/a", {}) == {"n": 3} and client.post("/a", {}) == {"n": 4}
    assert client.cache.stats()["entries"] == 1 and client.cache.evict_source("http://h/") == 1
    refused = http.HttpClient("http://h", transport=lambda *a: (404, ""), sleep=waits.append)
    with pytest.raises(http.Refused):
        refused.get("/a")


def test_http_source(spark):
    def batch(client, start, state):
        state["n"] = state.get("n", 0) + 1
        if state["n"] > 2:
            raise http.StopFetching
        return [{"start": start, "n": state["n"], "more": 1}]

    source = http.HttpSource(lambda: None, batch, "start string, n long", ("a", "b"))
    assert sorted(map(tuple, source.read(spark).collect())) == [("a", 1), ("a", 2), ("b", 1), ("b", 2)]


def test_breaker():
    now = [0.0]
    b = http.CircuitBreaker(2, 10, 2, lambda: now[0])

    def bad():
        raise OSError

    for _ in range(2):
        with pytest.raises(OSError):
            b.call(bad)
    with pytest.raises(http.CircuitOpen):
        b.call(lambda: 1)
    now[0] = 11
    assert b.call(lambda: 1) == 1 and b.state == "half-open"
    with pytest.raises(OSError):
        b.call(bad)
    assert b.state == "open"
    now[0] = 22
    b.call(lambda: 1)
    b.call(lambda: 1)
    assert b.state == "closed"


def test_state(tmp_path):
    for now, state in ((t := [0.0], MemoryState(now=lambda: t[0])), (u := [0.0], SQLiteState(str(tmp_path / "s"), now=lambda: u[0]))):
        assert state.set_if_absent("n:a", 1, 5) and not state.set_if_absent("n:a", 2)
        state.set("n:b", [1])
        assert state.count_prefix("n:") == 2 and state.get("n:b") == [1]
        now[0] = 6
        assert state.get("n:a") is None and state.count_prefix("n:") == 1 and state.delete_prefix("n:") >= 1
        members = MembershipStore(state, "m")
        assert members.mark_if_new(None) and members.exists("None") and members.size() == 1
        TTLStore(state, "v", 1).set("k", 3)
        assert TTLStore(state, "v").get("k") == 3
    lru = MemoryState(2)
    for k in "ab":
        lru.set(k, 1)
    lru.get("a")
    lru.set("c", 1)
    assert lru.get("b") is None and lru.get("a") == 1


DOC = """version = "rillstack/v1"
[defaults.delivery]
max_attempts = 2
[profiles.fast.delivery]
profile = "throughput"
[environments.test.pipelines.p]
stages = [{ type = "filter", where = "v > 7" }]
[pipelines.p]
profile = "fast"
source = { type = "jsonl", path = "IN", schema = "id long, v long" }
stages = [{ type = "filter", where = "v > 5" }, { type = "validate", rule = "v < 9", on_error = "dlq" }]
sinks = [{ type = "parquet", path = "OUT" }]
dlq = { type = "dlq", path = "DLQ" }
"""


def test_config_and_cli(spark, tmp_path, capsys):
    (tmp_path / "in.jsonl").write_text("\n".join(json.dumps({"id": i, "v": i}) for i in range(10)))
    path = tmp_path / "c.toml"
    path.write_text(DOC.replace("IN", str(tmp_path / "in.jsonl")).replace("OUT", str(tmp_path / "out")).replace("DLQ", str(tmp_path / "dlq")))
    doc = config.load(str(path))
    settings = config.resolve(doc, "p")
    assert settings["delivery"] == {"max_attempts": 2, "profile": "throughput"}
    assert len(config.resolve(doc, "p", "test")["stages"]) == 1
    settings["source"]["row_mapper"] = lambda x: x
    got = config.build(spark, settings, "p").run()
    assert (got.consumed, got.written, got.dropped, got.errored, got.dead_letters) == (10, 3, 6, 1, 1)
    assert cli.main(["doctor", "--config", str(path)]) == 0 and cli.main(["run", "--config", str(path), "--pipeline", "p", "--plan"]) == 0
    assert cli.main(["run", "--config", str(path), "--pipeline", "none"]) == 2
    assert cli.main(["dlq", "list", "--config", str(path), "--pipeline", "p"]) == 0
    for args in (["version"], ["new", "x"], ["plugins"], ["pipelines", "--config", str(path)], ["config", "--config", str(path)]):
        assert cli.main(args) == 0
    assert '"error_type": "ValidationError"' in capsys.readouterr().out
    for ref in ("os.path", "a b:c", "os:__import__('x')"):
        with pytest.raises(config.ConfigError):
            config.import_ref(ref)
    r = config.Registry()
    r.register("sink", "x", NullSink)
    with pytest.raises(config.ConfigError):
        r.register("sink", "x", NullSink)
    box = config.Container()
    box.provide("a", lambda c: [c.get("b")])
    box.provide("b", lambda c: object())
    assert box.get("a") is box.get("a")


def test_schedules():
    at = datetime(2024, 1, 31, 10, 7, 30)
    assert schedule.next_cron("*/15 * * * *", at) == datetime(2024, 1, 31, 10, 15)
    assert schedule.next_cron("0 9 29 2 *", at) == datetime(2024, 2, 29, 9, 0)
    assert schedule.next_cron("30 8 * * 1-5", datetime(2024, 2, 2, 9)) == datetime(2024, 2, 5, 8, 30)
    for text in ("* * * *", "61 * * * *"):
        with pytest.raises(ValueError):
            schedule.Schedule.cron(text)
    waits, runs = [], iter([0, 1, 1, 0, 1, 1, 1, 1, 1])

    def job():
        if next(runs):
            raise RuntimeError("failed")

    with pytest.raises(RuntimeError):
        schedule.Loop(job, schedule.Schedule.every(5), waits.append).start()
    assert waits == [5, 60, 120, 5, 60, 120, 240, 480]
    assert schedule.Loop(lambda: None, schedule.Schedule.once()).start() == 1
    state = MemoryState()
    a, b = schedule.Coordinator(state, "a"), schedule.Coordinator(state, "b")
    assert a.acquire("p") and b.acquire("p") is None
    a.release("p")
    assert b.acquire("p") and schedule.WorkerPool({"p": lambda: 1, "q": lambda: 2}, a).run_once() == {"p": "leased elsewhere", "q": 2}


def test_metrics_and_health(spark):
    c = observe.Collector()
    df = spark.range(10)
    for limit in (20, 8, 2):
        with c.run("p") as out:
            assert c.of("p").status == observe.RUNNING
            out["summary"] = P.Pipeline(df).pipe(P.validate_stage(F.col("id") < limit, "dlq", "low")).build(NullSink()).run()
    s = c.of("p")
    assert (s.runs, s.consumed, s.written, s.errored, s.pending, s.status) == (3, 30, 20, 10, 0, observe.FAILING)
    assert 'rillstack_stage_records_total{pipeline="p",stage="low",outcome="errored"} 10' in observe.prometheus(c)
    with pytest.raises(KeyError), c.run("q"):
        raise KeyError
    assert c.of("q").status == observe.FAILING and c.of("new").status == observe.IDLE
    with observe.HealthServer(c, token="t") as server:
        assert server.page("/health")[0] == 503 and server.page("/ready")[0] == 200
        assert server.page("/metrics")[0] == 401 and server.page("/metrics", "Bearer t")[0] == 200 and server.page("/x")[0] == 404
    tracer = observe.MemoryTracer()
    with tracer.span("a"), tracer.span("b", n=1):
        pass
    assert [(x.name, x.parent) for x in tracer.spans] == [("b", "a"), ("a", None)]
    assert observe.AIMetrics(1, categories=observe.Counter(a=1)).absorb(observe.AIMetrics(2, categories=observe.Counter(a=2))).categories["a"] == 3


def test_explain_and_dry_run(spark):
    from rillstack.operators import stages

    bound = P.Pipeline(spark.range(5), pipeline_id="e").filter(F.col("id") > 1).pipe(stages.record_map(lambda r: r, name="py")).build(NullSink())
    x = bound.with_sink(NullSink("dry")).explain()
    assert x.stages == [("filter", "expression"), ("py", "python")] and x.sinks == ["dry"] and len(x.notes) == 1 and "MapInArrow" in x.text()

"""Builder, stages, dedup, delivery, sources and sinks on small inputs."""

import itertools
import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rillstack import delivery, schema
from rillstack.functions import scalar
from rillstack.operators import dedup, stages
from rillstack.operators import pipeline as P
from rillstack.sinks.base import NullSink, Sink, results_of
from rillstack.sinks.files import CsvSink, DeadLetterSink, ParquetSink
from rillstack.sinks.io import StdoutSink, WebhookSink, hidden_url
from rillstack.sources import files
from rillstack.state import MemoryState


class Refusing(NullSink):
    def write(self, df, run_id=""):
        raise ValueError("refused")


@pytest.fixture(scope="module")
def ten(spark):
    return spark.createDataFrame([(i, i) for i in range(10)], "id long, v long")


def counts(s):
    return s.consumed, s.written, s.dropped, s.errored


def test_log_drops_and_passthrough_is_refused(ten):
    flow = P.Pipeline(ten).pipe(P.validate_stage(F.col("v") < 4, "log"))
    assert counts(flow.build(NullSink()).run()) == (10, 4, 6, 0)
    with pytest.raises(ValueError):
        P.validate_stage(F.col("v") < 4, "ignore")


def test_dedup_of_nulls_ties_and_twins(spark):
    rows = [(1, None), (2, "None"), (3, None), (1, "a"), (1, "a"), (1, "a"), (0, "b")]
    flow = P.Pipeline(spark.createDataFrame(rows, "pos int, k string")).pipe(P.dedup_stage(F.col("k"), "pos"))
    assert sorted((r.pos, str(r.k)) for r in flow.written().collect()) == [(0, "b"), (1, "None"), (1, "a"), (2, "None")]
    assert {r.outcome: r.n for r in flow.outcomes().collect()} == {"written": 4, "dropped": 3}


def test_letters_a_to_c(spark):
    flow = P.Pipeline(spark.createDataFrame(list(enumerate("abacb")), "pos int, k string")).pipe(P.dedup_stage(F.col("k"), "pos"))
    assert counts(flow.build(NullSink()).run()) == (5, 3, 2, 0)


def test_enrich_keeps_the_number_of_records(spark, ten):
    lookup = spark.createDataFrame([(1, "x"), (1, "y"), (None, "z"), (2, None)], "id long, name string")
    out = P.Pipeline(ten).pipe(P.enrich_stage(lookup, "id")).written().collect()
    assert len(out) == 10 and [r.name for r in sorted(out)][:3] == [None, "x", None]
    assert P.Pipeline(ten).pipe(P.enrich_stage(lookup, "id", required=True)).written().count() == 2


def test_batches(ten):
    def odd_fails(rows):
        if any(r["id"] == 3 for r in rows):
            raise KeyError("three")
        return rows[:-1] if rows[0]["id"] == 9 else rows

    flow = P.Pipeline(ten.coalesce(1)).pipe(stages.batch_map(odd_fails, size=3))
    assert {(r.outcome, r.reason): r.n for r in flow.outcomes().collect()} == {("written", ""): 6, ("errored", "batch_map"): 4}
    dead = flow.dead_letters().collect()
    assert {r.error_type for r in dead} == {"KeyError", "RuntimeError"}
    assert json.loads(dead[0].original_record).keys() == {"id", "v"}


def test_arrow_filter_counts_drops_and_errors(ten):
    flow = P.Pipeline(ten).pipe(stages.arrow_filter(lambda b: pa.array([None if x == 0 else x > 6 for x in b.column("id").to_pylist()])))
    assert {r.outcome: r.n for r in flow.outcomes().collect()} == {"written": 3, "dropped": 7}
    broken = P.Pipeline(ten).pipe(stages.arrow_map(lambda b: b.column("nothing")))
    assert {r.outcome: r.n for r in broken.outcomes().collect()} == {"errored": 10}


def test_process_batch_times_out_and_keeps_rows(ten):
    import time

    flow = P.Pipeline(ten.coalesce(1)).pipe(stages.process_batch(lambda rows: time.sleep(3) or rows if rows[0]["id"] == 0 else rows, size=5, timeout=0.5))
    assert {(r.outcome): r.n for r in flow.outcomes().collect()} == {"written": 5, "errored": 5}


def test_record_stages_and_policies(ten):
    def fn(r):
        if r["id"] == 2:
            raise ValueError("two")
        return None if r["id"] == 1 else {"id": r["id"], "w": str(r["v"])}

    for policy, want in (("dlq", (8, 1, 1)), ("drop", (8, 2, 0)), ("passthrough", (9, 1, 0))):
        flow = P.Pipeline(ten).pipe(stages.record_map(fn, "id long, w string", on_error=policy))
        got = {r[P.OUTCOME]: r["count"] for r in flow.tagged().groupBy(P.OUTCOME).count().collect()}
        assert tuple(got.get(x, 0) for x in ("written", "dropped", "errored")) == want
    with pytest.raises(Exception, match="two"):
        P.Pipeline(ten).pipe(stages.record_map(fn, "id long, w string", on_error="raise")).written().collect()


def test_route_to_stages(ten):
    branches = {0: P.map_stage(kind=F.lit("even")), 1: P.filter_stage(F.col("id") > 4)}
    flow = P.Pipeline(ten).pipe(P.route_stage(F.col("id") % 3, branches))
    assert sorted((r.id, r.kind) for r in flow.written().collect()) == [(0, "even"), (3, "even"), (6, "even"), (7, None), (9, "even")]
    assert sum(r.n for r in flow.outcomes().collect()) == 10


def test_fan_out_and_router(ten, tmp_path):
    assert counts(P.Pipeline(ten).fan_out(NullSink(), Refusing()).run()) == (10, 10, 0, 0)
    sink = DeadLetterSink(str(tmp_path / "dlq"))
    assert counts(P.Pipeline(ten).fan_out(Refusing(), dlq=sink).run()) == (10, 0, 0, 10)
    with pytest.raises(ValueError, match="refused"):
        P.Pipeline(ten).build(Refusing()).run()
    routed = P.Pipeline(ten).route({"low": (F.col("id") < 3, ParquetSink(str(tmp_path / "low")))}).run()
    assert counts(routed) == (10, 3, 7, 0)


def test_dead_letters_and_replay(spark, ten, tmp_path):
    sink = DeadLetterSink(str(tmp_path / "dlq"))
    flow = P.Pipeline(ten, pipeline_id="p").pipe(P.validate_stage(F.col("v") < 6, "dlq", "small"))
    flow.build(NullSink(), dlq=sink).run("r1")
    flow.build(NullSink(), dlq=sink).run("r1")  # the same run again
    table = sink.read(spark)
    assert table.columns == [c.split()[0] for c in delivery.DLQ_SCHEMA.split(", ")] and table.count() == 4
    got, left = delivery.replay(table, "id long, v long", lambda x: P.Pipeline(x).pipe(P.validate_stage(F.col("v") < 8, "dlq")), pipeline_id="p")
    assert sorted(r.outcome for r in got.collect()) == ["errored", "errored", "written", "written"]
    assert [(r.attempt, json.loads(r.record)["id"]) for r in left.orderBy("record").collect()] == [(1, 8), (1, 9)]
    sink.keep(left)
    assert sink.read(spark).count() == 2
    _, kept = delivery.replay(sink.read(spark), "id long, v long", lambda x: P.Pipeline(x), sinks=[Refusing()])
    assert kept.count() == 2
    with pytest.raises(ValueError):
        delivery.replay(table, "id long", lambda x: P.Pipeline(x), "all")


def test_eligible_limits_before_attempts(spark):
    rows = spark.createDataFrame([("a", "p", "s", 3, 3), ("b", "p", "s", 0, 3), ("c", "p", "s", 0, 3)], "id string, pipeline_id string, stage string, attempt int, max_attempts int")
    assert [r.id for r in delivery.eligible(rows, limit=2).collect()] == ["b"]


def test_payloads(spark):
    df = spark.createDataFrame([('{"A": {"Password": 1, "h": [["Authorization", "x"], ["ok", "y"]]}}',), ("no json",)], "t string")
    got = [r[0] for r in df.select(delivery.redacted_json(F.col("t"), ["password", "authorization"])).collect()]
    assert json.loads(got[0]) == {"A": {"Password": "[REDACTED]", "h": [["Authorization", "[REDACTED]"], ["ok", "y"]]}} and got[1] == "[REDACTED]"
    key = F.lit("0123456789abcdef").cast("binary")
    sealed = df.select("t", delivery.payload(F.col("t"), delivery.DeliveryConfig(dlq_payload="encrypted"), key).alias("c"))
    assert all(r.t == r.p != r.c for r in sealed.select("t", "c", F.aes_decrypt(F.unbase64("c"), key).cast("string").alias("p")).collect())


def test_jaro_winkler_greedy_against_brute_force(spark):
    draw = random.Random(3)
    names = ["".join(draw.choice("abcd") for _ in range(draw.randrange(1, 9))) for _ in range(150)] + ["pho 24 hanoi", "pho24 hanoi", "kfc downtown"]
    for threshold in (0.85, 0.93):
        kept: list[int] = []
        for i, x in enumerate(names):
            if not any(scalar.jaro_winkler_value(names[j], x) >= threshold for j in kept):
                kept.append(i)
        rows = spark.createDataFrame(list(enumerate(names)), "pos long, name string")
        got = P.Pipeline(rows).pipe(dedup.fuzzy_stage(F.col("name"), "pos", threshold)).written()
        assert sorted(r.pos for r in got.collect()) == kept


def test_embeddings_greedy_against_brute_force(spark):
    draw = random.Random(4)
    base = [[draw.gauss(0, 1) for _ in range(8)] for _ in range(12)]
    vectors = [[x + draw.gauss(0, 0.25) for x in draw.choice(base)] for _ in range(120)] + [[0.0] * 8, [0.0] * 8]

    def cosine(a, b):
        n = (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
        return sum(x * y for x, y in zip(a, b, strict=True)) / n if n else 0.0

    kept: list[int] = []
    for i, v in enumerate(vectors):
        if not any(cosine(vectors[j], v) >= 0.92 for j in kept):
            kept.append(i)
    rows = spark.createDataFrame(list(enumerate(vectors)), "pos long, v array<double>")
    got = P.Pipeline(rows).pipe(dedup.embedding_stage(F.col("v"), "pos", 0.92)).written()
    assert len(kept) < 120 and sorted(r.pos for r in got.collect()) == kept


def test_embeddings_in_blocks(spark, monkeypatch):
    """Groups of near copies over many blocks: kept rows as by brute force, and no table of pairs."""
    import numpy as np

    monkeypatch.setattr(dedup, "BLOCK_BYTES", 4 * 16 * 300)
    monkeypatch.setattr(dedup, "TILE", 64)
    monkeypatch.setattr(dedup, "greedy", None)
    draw = np.random.default_rng(6)
    base = draw.normal(size=(60, 16))
    v = base[draw.integers(0, 60, 1500) * (draw.random(1500) < 0.6)] + draw.normal(size=(1500, 16)) * draw.choice([0.02, 0.2, 0.4], 1500)[:, None]
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    kept: list[int] = []
    for i in range(len(v)):
        if not (unit[kept] @ unit[i] >= 0.92).any():
            kept.append(i)
    odd = [(3000, [0.0] * 16), (3001, [1.0] * 15 + [None]), (3002, [1.0, 2.0]), (3003, [1.0, 2.0]), (3004, [])]
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + odd, "pos long, v array<double>").repartition(5)
    got = P.Pipeline(rows).pipe(dedup.embedding_stage(F.col("v"), "pos", 0.92)).written()
    assert 100 < len(kept) < 1400 and sorted(r.pos for r in got.collect()) == [*kept, 3000, 3001, 3002, 3004]


def test_stores(spark, ten, tmp_path):
    for store in (dedup.TableStore(str(tmp_path / "keys")), dedup.BackendStore(MemoryState())):
        flow = P.Pipeline(ten).pipe(dedup.store_stage(F.col("id"), store))
        assert flow.written().count() == 10
        dedup.commit_keys(ten.where("id < 4"), F.col("id"), store)
        dedup.commit_keys(ten.where("id < 4"), F.col("id"), store)
        assert P.Pipeline(ten).pipe(dedup.store_stage(F.col("id"), store)).written().count() == 6

    class Broken:
        def keys(self, spark):
            raise OSError("away")

    with pytest.raises(OSError):
        P.Pipeline(ten).pipe(dedup.store_stage(F.col("id"), Broken())).written().count()
    assert P.Pipeline(ten).pipe(dedup.store_stage(F.col("id"), Broken(), dedup.FAIL_OPEN)).written().count() == 10


def test_ragged_and_blank_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name\n1\n,\n2,"Bob\nB",extra\n')
    source = files.FileSource(str(tmp_path / "a.csv"), format="csv")
    assert [(r.id, r.name, r._overflow, r._row) for r in source.read(spark).orderBy("_row").collect()] == [("1", None, None, 1), ("2", "Bob\nB", '["extra"]', 2)]
    (tmp_path / "b.csv").write_text("1,Alice\n2,Bob")
    plain = files.FileSource(str(tmp_path / "b.csv"), format="csv", options={"header": False, "names": ["id", "name"]})
    assert [r.name for r in plain.read(spark).orderBy("_row").collect()] == ["Alice", "Bob"]


def test_json_lines_policies(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"a": 1}\n\nnot json\n{"a": 3}\n[1]\n')

    def mapper(x):
        return {"a": x["a"]} if x != {"a": 3} else None

    source = files.FileSource(str(path), "a long", mapper, delivery.LOG_AND_CONTINUE, format="jsonl")
    assert [(r.a, r._row) for r in source.read(spark).collect()] == [(1, 1)]
    assert sorted(r._row for r in source.failures(spark).collect()) == [3, 5]
    with pytest.raises(Exception, match="can't be read"):
        files.FileSource(str(path), "a long", mapper, format="jsonl").read(spark).collect()


def test_resume_and_identity(spark, tmp_path):
    path = tmp_path / "rows.csv"
    path.write_text("id\n" + "\n".join(map(str, range(2500))) + "\n")
    source, manager = files.FileSource(str(path), format="csv"), delivery.CheckpointManager(MemoryState())
    first = source.resume(spark, manager, "p").where("_row <= 1000")
    source.save(spark, manager, "p", "r1", 1000)
    rest = source.resume(spark, manager, "p")
    assert sorted(int(r.id) for r in first.select("id").union(rest.select("id")).collect()) == list(range(2500))
    path.write_text("id\n3\n4\n")
    with pytest.raises(delivery.IdentityMismatch):
        source.resume(spark, manager, "p")
    assert files.FileSource(str(path), format="csv", mismatch="reset").resume(spark, manager, "p").count() == 2


def test_checkpoints_and_fences():
    state = MemoryState()
    m = delivery.CheckpointManager(state, every=10)
    assert [m.save("p", "r", "s", {"row_number": n}, n) for n in (5, 10, 10, 20)] == [False, True, False, True]
    assert delivery.CheckpointManager(state).restore("p", "s") == {"row_number": 20}
    state.set("checkpoint:p:s", "broken")
    with pytest.raises(TypeError):
        delivery.CheckpointManager(state).restore("p", "s")
    old = delivery.Fence.take(state, "job")
    old.check()
    delivery.Fence.take(state, "job").check()
    with pytest.raises(PermissionError):
        old.check()


def test_retry_policy():
    waits, calls = [], itertools.count()

    def fails_twice():
        if next(calls) < 2:
            raise ConnectionError("away")
        return "done"

    assert delivery.retry(fails_twice, delivery.RetryPolicy(4, exceptions=(OSError,)), waits.append) == "done" and waits == [1.0, 2.0]
    with pytest.raises(ConnectionError):
        delivery.retry(lambda: (_ for _ in ()).throw(ConnectionError()), delivery.RetryPolicy(4), waits.append)
    kinds = [delivery.classify_failure(e).kind for e in (TimeoutError(), ConnectionError(), UnicodeDecodeError("utf-8", b"", 0, 1, ""), KeyError())]
    assert kinds == ["timeout", "connectivity", "deserialization", "unknown"]


def test_policy_gate(ten, tmp_path):
    config = delivery.DeliveryConfig(require_idempotent_sinks=True)
    with pytest.raises(ValueError, match="not idempotent"):
        P.Pipeline(ten).build(ParquetSink(str(tmp_path / "x"), "append"), config=config).run()
    assert P.Pipeline(ten).build(ParquetSink(str(tmp_path / "x"), by_run=True), config=config).run("a").written == 10


def test_sinks(spark, ten, tmp_path):
    import io

    out = io.StringIO()
    assert StdoutSink(stream=out).write(ten.where("id < 2").orderBy("id")).written == 2
    assert out.getvalue() == '▶ {"id":0,"v":0}\n▶ {"id":1,"v":1}\n'
    nested = spark.createDataFrame([(1, [1, 2], "x")], "id long, a array<int>, s string")
    CsvSink(str(tmp_path / "c"), fieldnames=("s", "a", "none")).write(nested)
    assert [tuple(r) for r in files.csv(spark, str(tmp_path / "c")).collect()] == [("x", "[1,2]", None)]
    assert results_of(None, 2) == [True, True]
    with pytest.raises(ValueError):
        results_of([True], 2)
    assert hidden_url("https://u:p@h.org/a?key=1") == "https://***@h.org/a?***"
    assert isinstance(NullSink(), Sink)


def test_webhook(ten):
    def post(url, body, headers, timeout):
        ids = [r["id"] for r in json.loads(body)]
        return 400 if 4 in ids else 200

    got = WebhookSink("http://x", batch=3, post=post).write(ten.coalesce(1).orderBy("id"))
    assert (got.written, got.errored, got.error) == (7, 3, "status 400")


def test_schema_contracts(spark):
    users = schema.Schema("t", {"id": schema.Column_("integer")})
    rows = P.Pipeline(spark.createDataFrame([(1, "Alice"), (2, None)], "id long, name string"))
    run = {c: rows.pipe(schema.schema_stage(users, c)).written() for c in (schema.EVOLVE, schema.DISCARD_COLUMN, schema.DISCARD_ROW, schema.FREEZE)}
    assert run[schema.EVOLVE].count() == 2 and run[schema.DISCARD_COLUMN].columns == ["id"]
    assert [r.id for r in run[schema.DISCARD_ROW].collect()] == [2]
    with pytest.raises(Exception, match="frozen"):
        run[schema.FREEZE].collect()
    kinds = "integer float null string boolean json".split()
    for a, b, c in itertools.product(kinds, repeat=3):
        assert schema.widened(schema.widened(a, b), c) == schema.widened(a, schema.widened(b, c)) and schema.widened(a, b) == schema.widened(b, a)


def test_schema_evolution(spark):
    texts = ['{"s": 1, "n": null}', '{"s": 95.5}', '{"s": 3}', '{"s": 4}', '{"s": "x", "n": true}', '{"s": null}', "[1]"]
    rows = spark.createDataFrame(list(enumerate(texts)), "pos long, j string")
    after, changes, changed = schema.evolve(rows, F.col("j"), "pos", schema.Schema("t"))
    assert [(c.pos, c.column, c.kind, c.new) for c in changes] == [(0, "n", "column_added", "null"), (0, "s", "column_added", "integer"), (1, "s", "type_widened", "float"), (2, "s", "type_conflict", "string"), (4, "n", "type_widened", "boolean")]
    assert changed == 5 and after.version == 6  # record 3 is a conflict again
    observed, _, _ = schema.evolve(rows, F.col("j"), "pos", schema.Schema("t", {"s": schema.Column_("integer")}), "observed")
    assert observed.columns["s"].data_type == "string"
    store = schema.SchemaStore(MemoryState())
    store.save("p", after)
    assert store.load("p", "t") == after and store.load("p", "other") is None


def test_paths_and_keys(spark):
    df = spark.createDataFrame([("../a/./b c",), ("C:\\x\\..\\y",)], "p string")
    assert [r[0] for r in df.select(scalar.safe_path(F.col("p"))).collect()] == ["a/b_c", "x/y"]
    with pytest.raises(Exception, match="no name"):
        spark.createDataFrame([("../..",)], "p string").select(scalar.safe_path(F.col("p"))).collect()
    a, b = spark.sql("select cast(null as string) x").union(spark.sql("select 'null' x")).select(scalar.cache_key(x=F.col("x"))).collect()
    assert a != b
    assert spark.sql("select '' x union all select null union all select 'abcde'").select(scalar.estimate_prompt_tokens(F.col("x"))).collect() == [(0,), (0,), (2,)]
    assert spark.sql("select 'https://u:p@h/a?k=1' u").select(scalar.redacted_url(F.col("u"))).first()[0] == "https://***@h/a?***"

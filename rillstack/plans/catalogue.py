"""The engine's queries over the driver's tables, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstack import ai, delivery, schema
from rillstack.functions import scalar
from rillstack.operators import dedup, stages
from rillstack.operators import pipeline as P
from rillstack.session import shared_path
from rillstack.sinks.base import NullSink
from rillstack.sinks.files import CsvSink, DeadLetterSink, JsonLinesSink, ParquetSink
from rillstack.sources import files


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return files.parquet(spark, f"{d}/{name}.parquet")


def pipeline_outcomes(spark: SparkSession, d: str) -> DataFrame:
    nation = _t(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    flow = P.Pipeline(_t(spark, d, "customer")).filter(F.col("c_acctbal") > 0)
    flow = flow.pipe(P.validate_stage(F.col("c_acctbal") < 9000, "dlq"), "validate")
    flow = flow.pipe(P.enrich_stage(nation, "c_nationkey"), "enrich")
    return flow.pipe(P.dedup_stage(F.struct("n_name", "c_mktsegment"), "c_custkey"), "dedup").outcomes()


def filter_project(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "lineitem").where("l_quantity > 45 and l_discount >= 0.05").select("l_orderkey", "l_linenumber", "l_quantity")


def dedup_exact(spark: SparkSession, d: str) -> DataFrame:
    flow = P.Pipeline(_t(spark, d, "part").select("p_partkey", "p_name")).pipe(P.dedup_stage(F.col("p_name"), "p_partkey"))
    return flow.written()


def route_by_type(spark: SparkSession, d: str) -> DataFrame:
    orders = _t(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    branches = {"O": {"label": F.lit("open")}, "F": {"label": F.lit("final")}}
    return P.Pipeline(orders).pipe(P.route_stage(F.col("o_orderstatus"), branches)).written()


def sink_router(spark: SparkSession, d: str) -> DataFrame:
    routed = P.route_sinks(_t(spark, d, "orders"), {"big": F.col("o_totalprice") > 200000, "urgent": F.col("o_orderpriority").startswith("1")}, "rest")
    return routed.groupBy(F.col("_route").alias("route")).agg(F.count("*").alias("n"))


def latest_state(spark: SparkSession, d: str) -> DataFrame:
    events = _t(spark, d, "events").select("user_id", "event_id", "event_type", "ts")
    return P.latest(events, ["user_id"], "ts", "event_id").select("user_id", "event_id", "event_type")


def dead_letters(spark: SparkSession, d: str) -> DataFrame:
    flow = P.Pipeline(_t(spark, d, "orders").select("o_orderkey", "o_orderstatus"))
    flow = flow.pipe(P.validate_stage(F.col("o_orderstatus") != "P", "dlq"))
    return flow.dead_letters().select("stage", F.get_json_object("record", "$.o_orderkey").cast("long").alias("o_orderkey"))


def prompt_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "conversations").select("conv_id", "turn", scalar.estimate_prompt_tokens(F.col("text")).alias("n_tokens"))


def json_extract(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


def map_net_price(spark: SparkSession, d: str) -> DataFrame:
    flow = P.Pipeline(_t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount"))
    return flow.map(net_cents=F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100)).written().select("l_orderkey", "l_linenumber", "net_cents")


def filter_high_value(spark: SparkSession, d: str) -> DataFrame:
    return P.Pipeline(_t(spark, d, "orders")).filter(F.col("o_totalprice") > 250000).written().select("o_orderkey", "o_totalprice")


def map_filter_chain(spark: SparkSession, d: str) -> DataFrame:
    flow = P.Pipeline(_t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"))
    return flow.map(twice=F.col("l_quantity") * 2).filter(F.col("twice") > 60).map(half=F.col("twice") / 4).written().select("l_orderkey", "l_linenumber", "half")


def batch_map_events(spark: SparkSession, d: str) -> DataFrame:
    def fn(rows: list[dict]) -> list:
        return [{"event_id": r["event_id"], "kind": r["event_type"].upper()} for r in rows]

    return P.Pipeline(_t(spark, d, "events").select("event_id", "event_type")).pipe(stages.batch_map(fn, "event_id long, kind string")).written()


def batch_filter_events(spark: SparkSession, d: str) -> DataFrame:
    flow = P.Pipeline(_t(spark, d, "events").select("event_id", "user_id"))
    return flow.pipe(stages.batch_filter(lambda rows: [r["user_id"] % 7 == 0 for r in rows])).written()


def arrow_map_price(spark: SparkSession, d: str) -> DataFrame:
    def fn(b):
        import pyarrow as pa
        import pyarrow.compute as pc

        return pa.RecordBatch.from_arrays([b.column("p_partkey"), pc.multiply(b.column("p_size"), 3).cast(pa.int64())], ["p_partkey", "size3"])

    return P.Pipeline(_t(spark, d, "part").select("p_partkey", "p_size")).pipe(stages.arrow_map(fn, "p_partkey long, size3 long")).written()


def arrow_filter_price(spark: SparkSession, d: str) -> DataFrame:
    def mask(b):
        import pyarrow.compute as pc

        return pc.greater(b.column("p_retailprice"), 1500.0)

    return P.Pipeline(_t(spark, d, "part").select("p_partkey", "p_retailprice")).pipe(stages.arrow_filter(mask)).outcomes()


def process_batch_double(spark: SparkSession, d: str) -> DataFrame:
    flow = P.Pipeline(_t(spark, d, "orders").select("o_orderkey", "o_custkey"))
    return flow.pipe(stages.process_batch(lambda rows: [{**r, "o_custkey": r["o_custkey"] * 2} for r in rows], timeout=60.0)).written()


def route_by_status(spark: SparkSession, d: str) -> DataFrame:
    flow = P.Pipeline(_t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"))
    branches = {"F": P.map_stage(price=F.round(F.col("o_totalprice") * 2, 2)), "O": P.filter_stage(F.col("o_totalprice") > 100000, "open_filter")}
    return flow.pipe(P.route_stage(F.col("o_orderstatus"), branches)).written().select("o_orderkey", "o_orderstatus", "price")


def sink_router_first_match(spark: SparkSession, d: str) -> DataFrame:
    """What each routed sink has got, read back from its files."""
    flow, root = P.Pipeline(_t(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")), shared_path(spark, "routes")
    flow.route({"big": (F.col("o_totalprice") > 200000, ParquetSink(f"{root}/big")), "urgent": (F.col("o_orderpriority").startswith("1"), ParquetSink(f"{root}/urgent"))}, ParquetSink(f"{root}/rest")).run()
    return _union(*(spark.read.parquet(f"{root}/{n}").select("o_orderkey", F.lit(n).alias("sink")) for n in ("big", "urgent", "rest")))


def _union(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _summary(spark: SparkSession, s: P.Summary) -> DataFrame:
    return spark.createDataFrame([(s.consumed, s.written, s.dropped, s.errored)], "consumed long, written long, dropped long, errored long")


class _Refusing(NullSink):
    def write(self, df, run_id=""):
        raise ValueError("this sink refuses")


def fan_out_counts(spark: SparkSession, d: str) -> DataFrame:
    """Two sinks, one of which refuses everything: the records are written all the same."""
    flow = P.Pipeline(_t(spark, d, "orders")).filter(F.col("o_orderstatus") != "P")
    return _summary(spark, flow.fan_out(NullSink(), _Refusing("bad")).run())


def run_summary(spark: SparkSession, d: str) -> DataFrame:
    flow = P.Pipeline(_t(spark, d, "lineitem")).filter(F.col("l_quantity") > 10).pipe(P.validate_stage(F.col("l_discount") < 0.09, "dlq"))
    return _summary(spark, flow.build(NullSink()).run())


def retry_eventual_success(spark: SparkSession, d: str) -> DataFrame:
    tries: dict[int, int] = {}

    def flaky(r: dict) -> dict:
        tries[r["n_nationkey"]] = tries.get(r["n_nationkey"], 0) + 1
        if tries[r["n_nationkey"]] <= r["n_nationkey"] % 3:
            raise ConnectionError("not yet")
        return r

    flow = P.Pipeline(_t(spark, d, "nation").select("n_nationkey", "n_name"))
    return flow.pipe(stages.retry_map(flaky, sleep=_no_wait)).written()


def _no_wait(_: float) -> None:
    """Stands for the wait between two tries."""


def validate_orders(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 10 == 0, "x").otherwise((F.col("o_totalprice") * 100).cast("long").cast("string")).alias("cents"), "o_orderstatus")
    rule = F.col("o_orderstatus").isin("O", "F") & (F.col("cents") >= 0)
    return P.Pipeline(rows).pipe(P.validate_stage(rule, coerce={"cents": "long"})).written().select("o_orderkey", "cents")


def validate_event_props(spark: SparkSession, d: str) -> DataFrame:
    flow = P.Pipeline(_t(spark, d, "events").select("event_id", "props"))
    return flow.map(k=F.get_json_object("props", "$.k").try_cast("long")).pipe(P.validate_stage(F.col("k").between(10, 80), "log")).written().select("event_id", "k")


def enrich_customer_nation(spark: SparkSession, d: str) -> DataFrame:
    nation = _t(spark, d, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    twice = nation.unionByName(nation.withColumn("n_name", F.lit("ZZZ")))
    flow = P.Pipeline(_t(spark, d, "customer").select("c_custkey", "c_nationkey")).pipe(P.enrich_stage(twice, "c_nationkey"))
    return flow.written().select("c_custkey", F.coalesce("n_name", F.lit("none")).alias("n_name"))


def limit_first_n(spark: SparkSession, d: str) -> DataFrame:
    return P.Pipeline(_t(spark, d, "events").select("event_id", "user_id")).limit(100, "event_id").limit(60).filter(F.col("user_id") % 2 == 0).written()


def dedup_documents_exact(spark: SparkSession, d: str) -> DataFrame:
    return P.Pipeline(_t(spark, d, "documents").select("doc_id", "text")).pipe(P.dedup_stage(F.sha2("text", 256), "doc_id")).written().select("doc_id")


def dedup_user_event(spark: SparkSession, d: str) -> DataFrame:
    return P.Pipeline(_t(spark, d, "events").select("event_id", "user_id", "event_type", "ts")).pipe(P.dedup_stage(F.struct("user_id", "event_type"), "ts", "event_id")).written().select("event_id", "user_id", "event_type")


def dedup_null_keys(spark: SparkSession, d: str) -> DataFrame:
    """Null and the text "None" are different keys; of records equal in all one stays."""
    rows = _t(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "P", F.lit(None)).when(F.col("o_orderstatus") == "O", "None").otherwise("F").alias("k"), F.lit(1).alias("place"))
    return P.Pipeline(rows).pipe(P.dedup_stage(F.col("k"), "place")).written().select(F.coalesce("k", F.lit("null")).alias("k"))


def dedup_against_store(spark: SparkSession, d: str) -> DataFrame:
    """A second run over all events drops the users that the first run, over half of them, delivered."""
    store = dedup.TableStore(shared_path(spark, "dedup-keys"))
    events = _t(spark, d, "events").select("event_id", "user_id")
    dedup.commit_keys(events.where("event_id % 2 = 0 and user_id % 3 = 0"), F.col("user_id"), store)
    return P.Pipeline(events).pipe(dedup.store_stage(F.col("user_id"), store)).written()


def _written(spark: SparkSession, df: DataFrame, sink) -> str:
    P.Pipeline(df).build(sink).run()
    return sink.path


def csv_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = _written(spark, _t(spark, d, "nation").select("n_nationkey", "n_name"), CsvSink(shared_path(spark, "csv")))
    return files.csv(spark, path)


def jsonl_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = _written(spark, _t(spark, d, "conversations"), JsonLinesSink(shared_path(spark, "jsonl")))
    return files.jsonl(spark, path, "conv_id long, turn long, role string, text string").select("conv_id", "turn", F.sha2("text", 256).alias("digest"))


def parquet_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    sink = ParquetSink(shared_path(spark, "parquet"), columns="s_suppkey long, s_name string, missing string")
    return spark.read.parquet(_written(spark, _t(spark, d, "supplier"), sink)).select("s_suppkey", "s_name", F.coalesce("missing", F.lit("-")).alias("missing"))


def resume_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows behind a saved cursor, each once."""
    from rillstack.state import MemoryState

    source, manager = files.FileSource(f"{d}/orders.parquet"), delivery.CheckpointManager(MemoryState())
    source.save(spark, manager, "p", "r", 1000)
    return source.resume(spark, manager, "p").select("o_orderkey", "_row")


def dlq_outcomes(spark: SparkSession, d: str) -> DataFrame:
    flow = P.Pipeline(_t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"))
    flow = flow.pipe(P.validate_stage(F.col("o_orderstatus") != "P", "dlq", "status")).map(o_orderkey=F.col("o_orderkey") + 1).pipe(P.validate_stage(F.col("o_totalprice") < 300000, "dlq", "price"))
    sink = DeadLetterSink(shared_path(spark, "dlq"))
    flow.build(NullSink(), dlq=sink).run("run1")
    field = "$.o_orderkey"
    return sink.read(spark).select("stage", "error_type", F.get_json_object("original_record", field).cast("long").alias("original_key"), F.get_json_object("processed_record", field).cast("long").alias("processed_key"), "attempt", "max_attempts")


def dlq_replay(spark: SparkSession, d: str) -> DataFrame:
    """Dead letters run again with a rule that lets some pass: those leave, the others have one attempt more."""
    rows = _t(spark, d, "orders").select("o_orderkey", "o_totalprice")
    bad = P.Pipeline(rows).pipe(P.validate_stage(F.col("o_totalprice") < 300000, "dlq", "price"))
    table = delivery.dlq_records(bad.dead_letters(), "p", "r", delivery.DeliveryConfig())
    _, left = delivery.replay(table, "o_orderkey long, o_totalprice double", lambda x: P.Pipeline(x).pipe(P.validate_stage(F.col("o_totalprice") < 350000, "dlq", "price")))
    return left.select(F.get_json_object("original_record", "$.o_orderkey").cast("long").alias("o_orderkey"), "attempt")


def dlq_replay_eligible(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "orders").select(F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("id"), F.lit("p").alias("pipeline_id"), F.lit("s").alias("stage"), (F.col("o_orderkey") % 4).cast("int").alias("attempt"), F.lit(3).alias("max_attempts"))
    return delivery.eligible(rows, "p", "s", 40).select("id", "attempt")


def redact_payload(spark: SparkSession, d: str) -> DataFrame:
    text = F.to_json(F.struct("c_custkey", F.struct(F.col("c_name").alias("Token"), F.col("c_mktsegment").alias("seg")).alias("in")))
    return _t(spark, d, "customer").select("c_custkey", delivery.redacted_json(text, ["token"]).alias("payload"))


def latest_state_projection(spark: SparkSession, d: str) -> DataFrame:
    return P.latest(_t(spark, d, "events").select("user_id", "event_id", "ts", "value"), ["user_id"], "ts", "event_id").select("user_id", "event_id", F.round("value", 4).alias("value"))


def reconcile_counts(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"), F.count_distinct("user_id").alias("users"))


def budget_estimate(spark: SparkSession, d: str) -> DataFrame:
    n = scalar.estimate_prompt_tokens(F.col("text"))
    return _t(spark, d, "documents").select("doc_id", n.alias("n_tokens"), F.round(n * 0.003, 6).alias("cost"))


def prompt_cache_key(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "conversations").where("text not rlike '[\\\\\"\\\\\\\\/]|[^ -~]'").select("conv_id", "turn", scalar.cache_key(role=F.col("role"), text=F.col("text")).alias("key"))


def cosine_pairs(spark: SparkSession, d: str) -> DataFrame:
    v = _t(spark, d, "embeddings").select("vec_id", "embedding")
    pairs = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id")
    return pairs.select("vec_id", F.round(scalar.cosine_similarity(F.col("embedding"), F.col("other")), 5).alias("cosine"))


def classify_embeddings(spark: SparkSession, d: str) -> DataFrame:
    categories = {f"c{k}": [1.0 if j % 4 == k else 0.0 for j in range(64)] for k in range(4)}
    flow = P.Pipeline(_t(spark, d, "embeddings").select("vec_id", "embedding")).pipe(ai.classify_vectors(F.col("embedding"), categories))
    return flow.written().select("vec_id", "category")


def haversine_nations(spark: SparkSession, d: str) -> DataFrame:
    lat, lon = F.col("n_nationkey") * 5.0 - 60, F.col("n_nationkey") * 13.0 - 170
    return _t(spark, d, "nation").select("n_nationkey", F.round(scalar.haversine_meters(lat, lon, F.lit(10.0), F.lit(20.0)), 1).alias("meters"))


def slug_names(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "part").select("p_partkey", scalar.to_slug(F.concat(F.lit(" Đặc "), "p_name", F.lit("_Größe!  "), "p_type")).alias("slug"))


def schema_infer_props(spark: SparkSession, d: str) -> DataFrame:
    made = _t(spark, d, "events").select(F.when(F.col("event_id") % 2 == 0, '{"a": 1, "b": null, "c": "x"}').otherwise('{"a": 1.5, "b": true, "d": [1]}').alias("j"))
    found = schema.infer(made, F.col("j"), "t")
    return spark.createDataFrame([(n, c.data_type, c.inferred_from) for n, c in found.columns.items()], "name string, data_type string, n long")


def schema_evolve_changes(spark: SparkSession, d: str) -> DataFrame:
    made = _t(spark, d, "events").select("event_id", F.when(F.col("event_id") < 100, '{"a": 1}').when(F.col("event_id") < 200, '{"a": 1.5, "b": null}').when(F.col("event_id") == 300, '{"a": 2}').otherwise('{"b": "x"}').alias("j"))
    after, changes, _ = schema.evolve(made, F.col("j"), "event_id", schema.Schema("t"))
    return spark.createDataFrame([(c.pos, c.column, c.kind, c.new, after.version) for c in changes], "pos long, name string, kind string, new string, version long")


def schema_discard_column(spark: SparkSession, d: str) -> DataFrame:
    known = schema.Schema("t", {"n_nationkey": schema.Column_("integer"), "n_name": schema.Column_("string")})
    return P.Pipeline(_t(spark, d, "nation")).pipe(schema.schema_stage(known, schema.DISCARD_COLUMN)).written()


def schema_discard_row(spark: SparkSession, d: str) -> DataFrame:
    known = schema.Schema("t", {"o_orderkey": schema.Column_("integer")})
    rows = _t(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderstatus")).alias("extra"))
    return P.Pipeline(rows).pipe(schema.schema_stage(known, schema.DISCARD_ROW)).written().select("o_orderkey")


def ai_enrich_stub(spark: SparkSession, d: str) -> DataFrame:
    def answer(prompt: str) -> str:
        import json

        return "```json\n" + json.dumps({"size": len(prompt), "other": 1}) + "\n```"

    flow = P.Pipeline(_t(spark, d, "nation").select("n_nationkey", "n_name"))
    stage = ai.enrich(lambda: ai.Asker(ai.StubProvider(answer)), "name {n_name} {unknown}", ["size"], "n_nationkey int, n_name string, size long")
    return flow.pipe(stage).written()


def ai_batch_stub(spark: SparkSession, d: str) -> DataFrame:
    def answer(prompt: str) -> str:
        import json

        return json.dumps([{"size": len(p)} for p in json.loads(prompt)])

    stage = ai.batched(lambda: ai.Asker(ai.StubProvider(answer)), "{c_name}", ["size"], "c_custkey long, c_name string, size long")
    return P.Pipeline(_t(spark, d, "customer").select("c_custkey", "c_name")).pipe(stage).written().select("c_custkey", "size")


def ai_cached_answers(spark: SparkSession, d: str) -> DataFrame:
    df = _t(spark, d, "events").select("event_id", "event_type")
    return ai.cached_answers(df, F.col("event_type"), lambda: ai.Asker(ai.StubProvider(str.upper)), shared_path(spark, "answers")).select("event_id", "answer")


def safe_paths(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "nation").select("n_nationkey", scalar.safe_path(F.concat(F.lit("../a b/./"), "n_name", F.lit("?.txt"))).alias("path"))


def dedup_fuzzy_names(spark: SparkSession, d: str) -> DataFrame:
    return P.Pipeline(_t(spark, d, "part").select("p_partkey", "p_name")).pipe(dedup.fuzzy_stage(F.lower("p_name"), "p_partkey", 0.9)).written()


def dedup_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return P.Pipeline(_t(spark, d, "embeddings").select("vec_id", "embedding")).pipe(dedup.embedding_stage(F.col("embedding"), "vec_id", 0.92)).written().select("vec_id")


def _stream(spark: SparkSession, d: str, sink, build) -> DataFrame:
    from rillstack.streaming.runner import StreamRunner

    schema = spark.read.parquet(f"{d}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d) if not _folder(spark, f"{d}/events.parquet") else spark.readStream.schema(schema).parquet(f"{d}/events.parquet")
    StreamRunner("events", lambda batch: build(P.Pipeline(batch)).build(sink), shared_path(spark, "stream")).run(stream)
    return spark.read.parquet(sink.path)


def _folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def stream_filter_available_now(spark: SparkSession, d: str) -> DataFrame:
    sink = ParquetSink(shared_path(spark, "stream-out"), by_run=True)
    return _stream(spark, d, sink, lambda p: p.filter(F.col("value") > 50)).select("event_id", "user_id")


def stream_dedup_available_now(spark: SparkSession, d: str) -> DataFrame:
    sink = ParquetSink(shared_path(spark, "stream-out"), by_run=True)
    return _stream(spark, d, sink, lambda p: p.pipe(P.dedup_stage(F.struct("user_id", "event_type"), "event_id"))).select("user_id", "event_type").distinct()


_FUNCTIONS = (
    pipeline_outcomes, filter_project, dedup_exact, route_by_type, sink_router, latest_state, dead_letters, prompt_tokens, json_extract,
    map_net_price, filter_high_value, map_filter_chain, batch_map_events, batch_filter_events, arrow_map_price, arrow_filter_price, process_batch_double,
    route_by_status, sink_router_first_match, fan_out_counts, run_summary, retry_eventual_success, validate_orders, validate_event_props, enrich_customer_nation,
    limit_first_n, dedup_documents_exact, dedup_user_event, dedup_null_keys, dedup_against_store, csv_roundtrip, jsonl_roundtrip, parquet_roundtrip, resume_rows,
    dlq_outcomes, dlq_replay, dlq_replay_eligible, redact_payload, latest_state_projection, reconcile_counts, budget_estimate, prompt_cache_key, cosine_pairs,
    classify_embeddings, haversine_nations, slug_names, schema_infer_props, schema_evolve_changes, schema_discard_column, schema_discard_row, ai_enrich_stub,
    ai_batch_stub, ai_cached_answers, safe_paths, dedup_fuzzy_names, dedup_embeddings, stream_filter_available_now, stream_dedup_available_now,
)
QUERIES = {f.__name__: f for f in _FUNCTIONS}

ORACLE_SQL = {
    "pipeline_outcomes": """
        with a as (select c.*, n_name from customer c left join nation on n_nationkey = c_nationkey),
        b as (select *, case when not c_acctbal > 0 then 'filter' when not c_acctbal < 9000 then 'validate' end as r from a),
        k as (select *, case when r is null then row_number() over (partition by r, n_name, c_mktsegment order by c_custkey) end as i from b)
        select case when r = 'filter' or i > 1 then 'dropped' when r = 'validate' then 'errored' else 'written' end as outcome,
               coalesce(r, case when i > 1 then 'dedup' else '' end) as reason, count(*) as n from k group by 1, 2""",
    "filter_project": "select l_orderkey, l_linenumber, l_quantity from lineitem where l_quantity > 45 and l_discount >= 0.05",
    "dedup_exact": "select min(p_partkey) as p_partkey, p_name from part group by p_name",
    "route_by_type": "select o_orderkey, o_orderstatus, case o_orderstatus when 'O' then 'open' else 'final' end as label from orders where o_orderstatus in ('O', 'F')",
    "sink_router": "select case when o_totalprice > 200000 then 'big' when o_orderpriority like '1%' then 'urgent' else 'rest' end as route, count(*) as n from orders group by 1",
    "latest_state": "select user_id, event_id, event_type from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1",
    "dead_letters": "select 'validate' as stage, o_orderkey from orders where o_orderstatus = 'P'",
    "prompt_tokens": "select conv_id, turn, cast(ceil(length(coalesce(text, '')) / 4.0) as bigint) as n_tokens from conversations",
    "json_extract": "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events",
    "map_net_price": "select l_orderkey, l_linenumber, cast(floor(l_extendedprice * (1 - l_discount) * 100) as bigint) as net_cents from lineitem",
    "filter_high_value": "select o_orderkey, o_totalprice from orders where o_totalprice > 250000",
    "map_filter_chain": "select l_orderkey, l_linenumber, l_quantity * 2 / 4 as half from lineitem where l_quantity * 2 > 60",
    "batch_map_events": "select event_id, upper(event_type) as kind from events",
    "batch_filter_events": "select event_id, user_id from events where user_id % 7 = 0",
    "arrow_map_price": "select p_partkey, cast(p_size as bigint) * 3 as size3 from part",
    "arrow_filter_price": "select case when p_retailprice > 1500 then 'written' else 'dropped' end as outcome, case when p_retailprice > 1500 then '' else 'arrow_filter' end as reason, count(*) as n from part group by 1, 2",
    "process_batch_double": "select o_orderkey, o_custkey * 2 as o_custkey from orders",
    "route_by_status": "select o_orderkey, o_orderstatus, case when o_orderstatus = 'F' then round(o_totalprice * 2, 2) end as price from orders where o_orderstatus = 'F' or (o_orderstatus = 'O' and o_totalprice > 100000)",
    "sink_router_first_match": "select o_orderkey, case when o_totalprice > 200000 then 'big' when o_orderpriority like '1%' then 'urgent' else 'rest' end as sink from orders",
    "fan_out_counts": "select count(*) as consumed, count(*) filter (o_orderstatus <> 'P') as written, count(*) filter (o_orderstatus = 'P') as dropped, cast(0 as bigint) as errored from orders",
    "run_summary": "select count(*) as consumed, count(*) filter (l_quantity > 10 and l_discount < 0.09) as written, count(*) filter (not l_quantity > 10) as dropped, count(*) filter (l_quantity > 10 and not l_discount < 0.09) as errored from lineitem",
    "retry_eventual_success": "select n_nationkey, n_name from nation",
    "validate_orders": "select o_orderkey, cast(trunc(o_totalprice * 100) as bigint) as cents from orders where o_orderkey % 10 <> 0 and o_orderstatus in ('O', 'F')",
    "validate_event_props": "select event_id, try_cast(json_extract_string(props, '$.k') as bigint) as k from events where try_cast(json_extract_string(props, '$.k') as bigint) between 10 and 80",
    "enrich_customer_nation": "select c_custkey, coalesce(n_name, 'none') as n_name from customer left join (select * from nation where n_nationkey < 20) on c_nationkey = n_nationkey",
    "limit_first_n": "select event_id, user_id from (select * from events order by event_id limit 60) where user_id % 2 = 0",
    "dedup_documents_exact": "select min(doc_id) as doc_id from documents group by text",
    "dedup_user_event": "select event_id, user_id, event_type from events qualify row_number() over (partition by user_id, event_type order by ts, event_id) = 1",
    "dedup_null_keys": "select distinct case o_orderstatus when 'P' then 'null' when 'O' then 'None' else 'F' end as k from orders",
    "dedup_against_store": "select event_id, user_id from events where user_id not in (select user_id from events where event_id % 2 = 0 and user_id % 3 = 0)",
    "csv_roundtrip": "select cast(n_nationkey as varchar) as n_nationkey, n_name from nation",
    "jsonl_roundtrip": "select conv_id, turn, sha256(text) as digest from conversations",
    "parquet_roundtrip": "select s_suppkey, s_name, '-' as missing from supplier",
    "resume_rows": "select o_orderkey, i as _row from (select o_orderkey, row_number() over () as i from orders) where i > 1000",
    "dlq_outcomes": """
        select case when o_orderstatus = 'P' then 'status' else 'price' end as stage, 'ValidationError' as error_type, o_orderkey as original_key,
               case when o_orderstatus = 'P' then o_orderkey + 1 else o_orderkey + 1 end as processed_key, cast(0 as int) as attempt, cast(3 as int) as max_attempts
        from orders where o_orderstatus = 'P' or not o_totalprice < 300000""",
    "dlq_replay": "select o_orderkey, cast(1 as int) as attempt from orders where not o_totalprice < 350000",
    "dlq_replay_eligible": "select id, attempt from (select lpad(cast(o_orderkey as varchar), 12, '0') as id, cast(o_orderkey % 4 as int) as attempt from orders order by id limit 40) where attempt < 3",
    "redact_payload": """select c_custkey, '{"c_custkey": ' || c_custkey || ', "in": {"Token": "[REDACTED]", "seg": "' || c_mktsegment || '"}}' as payload from customer""",
    "latest_state_projection": "select user_id, event_id, round(value, 4) as value from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1",
    "reconcile_counts": "select count(*) as n, count(distinct event_id) as ids, count(distinct user_id) as users from events",
    "budget_estimate": "select doc_id, cast(ceil(length(text) / 4.0) as bigint) as n_tokens, round(cast(ceil(length(text) / 4.0) as double) * 0.003, 6) as cost from documents",
    "prompt_cache_key": """select conv_id, turn, sha256('{"role":"' || role || '","text":"' || text || '"}') as key from conversations where not regexp_matches(text, '["\\\\/]|[^ -~]')""",
    "cosine_pairs": "select a.vec_id, round(list_cosine_similarity(cast(a.embedding as double[]), cast(b.embedding as double[])), 5) as cosine from embeddings a join embeddings b on b.vec_id = a.vec_id + 1",
    "classify_embeddings": """
        with c as (select k, list_transform(range(64), lambda j: case when j % 4 = k then 1.0 else 0.0 end) as v from range(4) t(k))
        select vec_id, 'c' || arg_max(k, round(list_cosine_similarity(cast(embedding as double[]), cast(v as double[])), 12) - k * 1e-15) as category from embeddings, c group by vec_id""",
    "haversine_nations": """
        select n_nationkey, round(2 * 6371000 * atan2(sqrt(h), sqrt(1 - h)), 1) as meters from (
            select n_nationkey, pow(sin((radians(10.0) - p) / 2), 2) + cos(p) * cos(radians(10.0)) * pow(sin(radians(20.0 - l) / 2), 2) as h
            from (select n_nationkey, radians(n_nationkey * 5.0 - 60) as p, n_nationkey * 13.0 - 170 as l from nation))""",
    "slug_names": """select p_partkey, left(trim(regexp_replace(regexp_replace(strip_accents(replace(lower(' Đặc ' || p_name || '_Größe!  ' || p_type), 'đ', 'd')), '[^A-Za-z0-9_\\s-]', '', 'g'), '[\\s_-]+', '-', 'g'), '-'), 80) as slug from part""",
    "schema_infer_props": "select * from (values ('a', 'float', (select count(*) from events)), ('b', 'boolean', (select count(*) from events)), ('c', 'string', (select count(*) from events where event_id % 2 = 0)), ('d', 'json', (select count(*) from events where event_id % 2 <> 0))) t(name, data_type, n)",
    "schema_evolve_changes": """
        with e as (select min(event_id) as a, min(event_id) filter (event_id >= 100) as f, min(event_id) filter (event_id = 300) as i, min(event_id) filter (event_id >= 200 and event_id <> 300) as s from events),
        c as (select a as pos, 'a' as name, 'column_added' as kind, 'integer' as new from e union all select f, 'a', 'type_widened', 'float' from e union all select f, 'b', 'column_added', 'null' from e
              union all select s, 'b', 'type_widened', 'string' from e union all select i, 'a', 'type_conflict', 'string' from e)
        select pos, name, kind, new, (select 1 + count(distinct pos) from c) as version from c""",
    "schema_discard_column": "select n_nationkey, n_name from nation",
    "schema_discard_row": "select o_orderkey from orders where o_orderkey % 3 <> 0",
    "ai_enrich_stub": "select n_nationkey, n_name, cast(length('name ' || n_name || ' {unknown}') as bigint) as size from nation",
    "ai_batch_stub": "select c_custkey, length(c_name) as size from customer",
    "ai_cached_answers": "select event_id, upper(event_type) as answer from events",
    "safe_paths": "select n_nationkey, 'a_b/' || regexp_replace(n_name, '[^A-Za-z0-9._-]', '_', 'g') || '_.txt' as path from nation",
    "stream_filter_available_now": "select event_id, user_id from events where value > 50",
    "stream_dedup_available_now": "select distinct user_id, event_type from events",
}

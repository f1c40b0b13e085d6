"""Delivery: runs of a bound pipeline, failures, retries, dead letters, checkpoints and their policies.

A run writes the tagged records once, so every sink, the counts and the dead letters see the same
rows even if an executor is lost between them. Delivery is at least once.
"""

from __future__ import annotations

import json
import os
import random
import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstack.operators import pipeline as P
from rillstack.state import StateBackend

FAIL_CLOSED, LOG_AND_CONTINUE = "fail_closed", "log_and_continue"


@dataclass(frozen=True)
class DeliveryConfig:
    """profile: throughput, low_latency or None sets the two batch figures where they are not given."""

    profile: str | None = None
    batch_size: int | None = None
    flush_ms: int | None = None
    checkpoint_every: int = 1
    checkpoint_policy: str = FAIL_CLOSED
    sink_policy: str = FAIL_CLOSED
    dlq_payload: str = "raw"
    redact: tuple[str, ...] = ("password", "secret", "token", "api_key", "authorization")
    max_attempts: int = 3
    require_replay_safe: bool = False
    require_idempotent_sinks: bool = False
    shared_dir: str | None = None

    def resolved(self) -> DeliveryConfig:
        size, wait = {"throughput": (1000, 100), "low_latency": (1, 10)}.get(self.profile or "", (1, 0))
        return replace(self, batch_size=self.batch_size or size, flush_ms=wait if self.flush_ms is None else self.flush_ms)


# Failures and retries


@dataclass(frozen=True)
class Failure:
    kind: str
    retryable: bool
    dlq_eligible: bool


def classify_failure(error: BaseException, reading: bool = False) -> Failure:
    """Timeouts and connection or system errors may pass if tried again and are no fault of the record;
    text that can't be decoded or encoded is; anything else is unknown and goes to the dead letters."""
    if isinstance(error, TimeoutError):
        return Failure("timeout", True, False)
    if isinstance(error, UnicodeError):
        return Failure("deserialization" if isinstance(error, UnicodeDecodeError) or reading else "serialization", False, True)
    if isinstance(error, OSError):
        return Failure("connectivity", True, False)
    return Failure("unknown", False, True)


@dataclass(frozen=True)
class RetryPolicy:
    """Waits grow by `factor` up to `cap` seconds, each shortened at random by up to the share `jitter`.
    Nothing is tried again unless exceptions or a classifier say so."""

    attempts: int = 3
    first: float = 1.0
    factor: float = 2.0
    cap: float = 60.0
    jitter: float = 0.0
    exceptions: tuple[type[BaseException], ...] = ()
    classifier: Callable[[BaseException], bool] | None = None

    def wait(self, attempt: int) -> float:
        full = min(self.cap, self.first * self.factor**attempt)
        return full * (1 - self.jitter * random.random())

    def retries(self, error: BaseException) -> bool:
        return isinstance(error, self.exceptions) or bool(self.classifier and self.classifier(error))


def retry(fn: Callable[[], object], policy: RetryPolicy, sleep: Callable[[float], None] = time.sleep) -> object:
    for attempt in range(max(policy.attempts, 1)):
        try:
            return fn()
        except BaseException as e:
            if attempt + 1 >= policy.attempts or not policy.retries(e):
                raise
            sleep(policy.wait(attempt))
    raise AssertionError("not reached")


# Dead letters

#: The columns of a dead letter; payloads are JSON text. `id` numbers them within the table.
DLQ_SCHEMA = (
    "id string, pipeline_id string, run_id string, stage string, error_type string, error_message string, record string, original_record string, "
    "processed_record string, source string, checkpoint string, details string, middleware string, sink string, created_at timestamp, attempt int, max_attempts int"
)


def redacted_json(value: Column, names: Iterable[str]) -> Column:
    """A JSON text in which the values of the named fields, at any depth and in any case, are hidden;
    in a list of [name, value] pairs (headers) the values of those names are too."""
    hidden = frozenset(n.lower() for n in names)

    def clean(x: object) -> object:
        if isinstance(x, dict):
            return {k: "[REDACTED]" if str(k).lower() in hidden else clean(v) for k, v in x.items()}
        if isinstance(x, list):
            if len(x) == 2 and isinstance(x[0], str) and x[0].lower() in hidden:
                return [x[0], "[REDACTED]"]
            return [clean(v) for v in x]
        return x

    @F.pandas_udf("string")
    def run(texts):
        def one(t):
            if t is None:
                return None
            try:
                return json.dumps(clean(json.loads(t)), ensure_ascii=False)
            except ValueError:
                return "[REDACTED]"

        return texts.map(one)

    return run(value)


def payload(value: Column, config: DeliveryConfig, key: Column | None = None) -> Column:
    """raw, redacted, or encrypted: AES-GCM by Spark under a key column, as base64."""
    if config.dlq_payload == "redacted":
        return redacted_json(value, config.redact)
    if config.dlq_payload == "encrypted":
        if key is None:
            raise ValueError("an encrypted payload needs a key")
        return F.base64(F.aes_encrypt(value.cast("binary"), key))
    if config.dlq_payload != "raw":
        raise ValueError(f"unknown payload policy {config.dlq_payload!r}")
    return value


def dlq_records(dead: DataFrame, pipeline_id: str, run_id: str, config: DeliveryConfig, source: str | None = None, key: Column | None = None) -> DataFrame:
    """Dead letters of Pipeline.dead_letters() as full records. The id is a digest, so writing the same
    failure twice gives the same id."""
    none = F.lit(None).cast("string")
    ident = F.sha2(F.concat_ws("\x01", F.lit(pipeline_id), F.lit(run_id), "stage", "original_record"), 256)
    kind = F.to_json(F.struct(F.struct(F.col("error_type").alias("type"), F.lit(False).alias("retryable")).alias("failure")))
    return dead.select(
        ident.alias("id"), F.lit(pipeline_id).alias("pipeline_id"), F.lit(run_id).alias("run_id"), "stage", "error_type", "error_message",
        payload(F.col("record"), config, key).alias("record"), payload(F.col("original_record"), config, key).alias("original_record"),
        payload(F.col("processed_record"), config, key).alias("processed_record"), F.lit(source).cast("string").alias("source"), none.alias("checkpoint"),
        kind.alias("details"), F.when(F.col("stage") != "sink_write", F.col("stage")).alias("middleware"), (F.col("sink") if "sink" in dead.columns else none).alias("sink"),
        F.current_timestamp().alias("created_at"), F.lit(0).alias("attempt"), F.lit(config.max_attempts).alias("max_attempts"),
    )


def eligible(dlq: DataFrame, pipeline_id: str | None = None, stage: str | None = None, limit: int | None = None) -> DataFrame:
    """Dead letters to replay. The limit counts the first by id, then those without attempts left go."""
    out = dlq
    if pipeline_id is not None:
        out = out.where(F.col("pipeline_id") == pipeline_id)
    if stage is not None:
        out = out.where(F.col("stage") == stage)
    if limit is not None:
        out = out.orderBy("id").limit(limit)
    return out.where("attempt < max_attempts")


def replay(dlq: DataFrame, schema: str, build: Callable[[DataFrame], P.Pipeline], mode: str = "pipeline", sinks: Iterable = (), run_id: str = "replay", **which) -> tuple[DataFrame, DataFrame]:
    """(results, remaining): all eligible records run again as one job, written to the sinks; results has
    their outcome. Their attempt is counted before the run; those written exactly once, and taken by a
    sink, are acknowledged and leave the table. Mode `sink` takes the processed form of records that a
    sink refused, without stages."""
    if mode not in ("pipeline", "sink"):
        raise ValueError("a replay's mode is pipeline or sink")
    chosen = eligible(dlq if mode == "pipeline" else dlq.where("stage = 'sink_write'"), **which)
    text = F.col("original_record") if mode == "pipeline" else F.coalesce("processed_record", "record")
    parsed = chosen.select("id", F.from_json(text, schema).alias("r")).select(F.col("id").alias("_dlq_id"), "r.*")
    tagged, _ = shared((build(parsed) if mode == "pipeline" else P.Pipeline(parsed)).tagged(), DeliveryConfig())
    ident = F.get_json_object(P.RAW, "$._dlq_id").alias("id")
    sinks, taken = list(sinks), 0
    for s in sinks:
        try:
            s.write(tagged.where(P.live()).drop(*P.CONTROL, "_dlq_id"), run_id)
            taken += 1
        except Exception:  # noqa: BLE001  the records stay dead letters
            continue
    outcome = F.when(P.live() & F.lit(bool(sinks) and not taken), F.lit(P.ERRORED)).otherwise(F.col(P.OUTCOME))
    results = tagged.select(ident, outcome.alias("outcome"), F.col(P.REASON).alias("reason"))
    done = results.groupBy("id").agg(F.count("*").alias("n"), F.sum((F.col("outcome") == P.WRITTEN).cast("int")).alias("good")).where("n = 1 and good = 1")
    tried = chosen.select("id", F.lit(1).alias("_tried"))
    left = dlq.join(done, "id", "left_anti").join(tried, "id", "left").withColumn("attempt", F.col("attempt") + F.coalesce("_tried", F.lit(0))).select(*dlq.columns)
    return results, left


# Checkpoints


@dataclass(frozen=True)
class SourceIdentity:
    """What tells a file from another one at its place."""

    uri: str
    size_bytes: int
    modified_time_ns: int
    device: int | None = None
    inode: int | None = None

    @classmethod
    def of(cls, spark: SparkSession, path: str) -> SourceIdentity:
        if not path.startswith(("file:", "/")) and "://" in path or not os.path.exists(path.removeprefix("file://")):
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            s = p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p)
            return cls(path, s.getLen(), s.getModificationTime() * 1_000_000)
        s = os.stat(path.removeprefix("file://"))
        return cls(path, s.st_size, s.st_mtime_ns, s.st_dev, s.st_ino)


@dataclass(frozen=True)
class Checkpoint:
    pipeline_id: str
    run_id: str
    source: str
    value: dict
    recorded_at: str
    source_identity: dict | None = None


class IdentityMismatch(RuntimeError):
    pass


@dataclass
class CheckpointManager:
    """Saves cursors in a state backend every so many positions, and only where they have changed."""

    backend: StateBackend
    every: int = 1
    policy: str = FAIL_CLOSED
    saved: dict = field(default_factory=dict)
    failures: int = 0

    def save(self, pipeline_id: str, run_id: str, source: str, value: dict, count: int, identity: SourceIdentity | None = None) -> bool:
        place = f"checkpoint:{pipeline_id}:{source}"
        if count % self.every or self.saved.get(place) == value:
            return False
        point = Checkpoint(pipeline_id, run_id, source, value, datetime.now(UTC).isoformat(), identity and identity.__dict__)
        try:
            self.backend.set(place, point.__dict__)
        except Exception:
            if self.policy == FAIL_CLOSED:
                raise
            self.failures += 1
        self.saved[place] = value  # also after a failure, so that it is not tried at every record
        return True

    def restore(self, pipeline_id: str, source: str, identity: SourceIdentity | None = None, mismatch: str = FAIL_CLOSED) -> dict | None:
        """The saved cursor. Where the source is another one: fail_closed raises, whatever the policy of
        saving; reset starts anew; allow takes the cursor."""
        try:
            found = self.backend.get(f"checkpoint:{pipeline_id}:{source}")
        except Exception:
            if self.policy == FAIL_CLOSED:
                raise
            self.failures += 1
            return None
        if found is None:
            return None
        if not isinstance(found, dict) or not isinstance(found.get("value"), dict):
            raise TypeError(f"the checkpoint of {source} is corrupted")
        before = found.get("source_identity")
        if identity is not None and before is not None and before != identity.__dict__:
            if mismatch == FAIL_CLOSED:
                raise IdentityMismatch(f"{source} is not the source that the checkpoint was saved for")
            if mismatch == "reset":
                return None
        self.saved[f"checkpoint:{pipeline_id}:{source}"] = found["value"]
        return found["value"]


@dataclass(frozen=True)
class Fence:
    """A lease's number: a holder whose number is not the latest must not write."""

    backend: StateBackend
    name: str
    number: int

    @classmethod
    def take(cls, backend: StateBackend, name: str) -> Fence:
        number = int(backend.get(f"fence:{name}") or 0) + 1
        backend.set(f"fence:{name}", number)
        return cls(backend, name, number)

    def check(self) -> None:
        if int(self.backend.get(f"fence:{self.name}") or 0) != self.number:
            raise PermissionError(f"the lease {self.name} has passed to another holder")


# Runs


def policy_faults(bound: P.BoundPipeline) -> list[str]:
    """What the delivery policy asks for and the sinks can't give; checked before anything is opened."""
    config, out = bound.config, []
    for s in bound.sinks:
        if config.require_replay_safe and not s.capabilities.replay_safe:
            out.append(f"{s.name} is not safe to replay")
        if config.require_idempotent_sinks and not s.capabilities.idempotent:
            out.append(f"{s.name} is not idempotent")
    return out


def deliver(bound: P.BoundPipeline, run_id: str | None = None) -> P.Summary:
    """Write all sinks. With several, a record is written if one sink at least took it; where none did
    it is errored and, with a dead-letter sink, kept there. A failing dead-letter sink ends the run."""
    faults = policy_faults(bound)
    if faults:
        raise ValueError("; ".join(faults))
    run_id, config, flow = run_id or str(uuid.uuid4()), bound.config.resolved(), bound.pipeline
    tagged, clean = shared(flow.tagged(), config)
    try:
        routed = tagged.where(P.live())
        if bound.routes:
            names, has_default = bound.routes
            routed = P.route_sinks(routed, dict(names), "_default" if has_default else None)
            targets = [(n, routed.where(F.col("_route") == n).drop("_route")) for n, _ in names] + ([("_default", routed.where("_route = '_default'").drop("_route"))] if has_default else [])
            unmatched = routed.where("_route is null").count()
        else:
            targets, unmatched = [(str(k), routed) for k in range(len(bound.sinks))], 0
        results, lost, errors = {}, [], 0
        for k, ((name, rows), sink) in enumerate(zip(targets, bound.sinks, strict=True)):
            try:
                results[f"{k}:{sink.name}"] = sink.write(rows.drop(*P.CONTROL), run_id)
            except Exception as e:
                if config.sink_policy == FAIL_CLOSED and len(bound.sinks) == 1 and bound.dlq is None:
                    raise
                results[f"{k}:{sink.name}"] = sink.failed(str(e))
                lost.append((rows, sink.name, e))
                if bound.routes:
                    errors += rows.count()
        counts = tagged.groupBy(P.OUTCOME, F.coalesce(P.REASON, F.lit("")).alias("r")).count().collect()  # a row for each stage
        by = {o: sum(r["count"] for r in counts if r[P.OUTCOME] == o) for o in (P.WRITTEN, P.DROPPED, P.ERRORED)}
        if lost and not bound.routes and len(lost) == len(bound.sinks):
            errors, lost = by[P.WRITTEN], lost[:1]
        elif not bound.routes:
            lost = []
        n_dead = 0
        if bound.dlq is not None:
            dead = P.Pipeline.dead_letters(_Given(tagged)).withColumn("sink", F.lit(None).cast("string"))
            for rows, name, e in lost:
                if classify_failure(e).dlq_eligible:
                    dead = dead.unionByName(_refused(rows, name, e))
            n_dead = bound.dlq.write(dlq_records(dead, flow.pipeline_id, run_id, config), run_id).written
        by[P.WRITTEN] -= errors + unmatched
        by[P.ERRORED] += errors
        by[P.DROPPED] += unmatched
        stages: dict[str, dict[str, int]] = {}
        for r in counts:
            if r["r"]:
                stages.setdefault(r["r"], {})[r[P.OUTCOME]] = r["count"]
        return P.Summary(sum(by.values()), by[P.WRITTEN], by[P.DROPPED], by[P.ERRORED], stages, results, n_dead)
    finally:
        clean()


class _Given(P.Pipeline):
    """A pipeline whose tagged records are there already."""

    def __init__(self, tagged: DataFrame):
        object.__setattr__(self, "_tagged", tagged)

    def tagged(self) -> DataFrame:
        return self._tagged


def _refused(rows: DataFrame, sink: str, error: Exception) -> DataFrame:
    now = F.to_json(F.struct(*P.user_columns(rows)), {"ignoreNullFields": "false"})
    return rows.select(
        F.lit("sink_write").alias("stage"), F.lit(type(error).__name__).alias("error_type"), F.lit(str(error)[:500]).alias("error_message"),
        F.col(P.RAW).alias("record"), F.col(P.RAW).alias("original_record"), now.alias("processed_record"), F.lit(sink).alias("sink"),
    )


def shared(df: DataFrame, config: DeliveryConfig) -> tuple[DataFrame, Callable[[], None]]:
    """df written to the shared folder and read again, and what deletes it."""
    from rillstack.session import shared_path

    spark = df.sparkSession
    path = shared_path(spark, "run", config.shared_dir)
    df.write.parquet(path)

    def clean() -> None:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)

    return spark.read.schema(df.schema).parquet(path), clean

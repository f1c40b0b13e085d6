"""The immutable builder: stages tag every record with its outcome, and nothing is lost.

A stage turns records with outcome `written` into the same or into `dropped` or `errored`. Counts
of outcomes, dead letters and the written records are read from one plan. The source record is kept
as JSON beside its columns, so a dead letter has both the original and the processed form, whatever
the stages did to the columns.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from rillstack.sinks.base import Sink, Written

OUTCOME, REASON, ERROR_TYPE, ERROR, RAW = "_outcome", "_reason", "_error_type", "_error", "_raw"
CONTROL = (OUTCOME, REASON, ERROR_TYPE, ERROR, RAW)
WRITTEN, DROPPED, ERRORED = "written", "dropped", "errored"
Stage = Callable[[DataFrame], DataFrame]
#: Parts of a dedup key's records that are numbered apart.
SALTS = 64
#: What a failing stage does with the record.
ON_ERROR = ("passthrough", "drop", "log", "raise", "dlq")


def checked_policy(on_error: str, *allowed: str) -> str:
    if on_error not in (allowed or ON_ERROR):
        raise ValueError(f"on_error is one of {', '.join(allowed or ON_ERROR)}, not {on_error!r}")
    return on_error


def live() -> Column:
    return F.col(OUTCOME) == WRITTEN


def user_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in CONTROL]


def tag(df: DataFrame) -> DataFrame:
    """df with the control columns of a record that nothing has judged yet."""
    none = F.lit(None).cast("string")
    return df.withColumns({OUTCOME: F.lit(WRITTEN), REASON: none, ERROR_TYPE: none, ERROR: none, RAW: F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})})


def mark(df: DataFrame, hit: Column, outcome: str, reason: str, error_type: str | None = None, error: Column | None = None) -> DataFrame:
    """The live records for which hit holds get the outcome."""
    hit = live() & F.coalesce(hit, F.lit(False))
    made = {OUTCOME: F.when(hit, F.lit(outcome)).otherwise(F.col(OUTCOME)), REASON: F.when(hit, F.lit(reason)).otherwise(F.col(REASON))}
    if outcome == ERRORED:
        made[ERROR_TYPE] = F.when(hit, F.lit(error_type)).otherwise(F.col(ERROR_TYPE))
        made[ERROR] = F.when(hit, F.lit(f"{reason} failed") if error is None else error).otherwise(F.col(ERROR))
    return df.withColumns(made)


def named(stage: Stage, name: str, kind: str = "expression") -> Stage:
    stage.__name__, stage.kind = name, kind  # type: ignore[attr-defined]
    return stage


def filter_stage(predicate: Column, name: str = "filter") -> Stage:
    """A false or null predicate drops."""
    return named(lambda df: mark(df, ~F.coalesce(predicate, F.lit(False)), DROPPED, name), name)


def map_stage(drop_when: Column | None = None, name: str = "map", **columns: Column) -> Stage:
    """New or changed columns; records for which drop_when holds, seen before the change, are dropped."""

    def run(df: DataFrame) -> DataFrame:
        return (df if drop_when is None else mark(df, drop_when, DROPPED, name)).withColumns(columns)

    return named(run, name)


def validate_stage(rule: Column, on_error: str = "drop", name: str = "validate", coerce: dict[str, str] | None = None) -> Stage:
    """Columns of `coerce` are cast first (a value that can't be cast fails the record); then the rule
    must hold. on_error: drop, log (also drops), dlq (errored, a dead letter) or raise."""
    checked_policy(on_error, "drop", "log", "dlq", "raise")

    def run(df: DataFrame) -> DataFrame:
        casts = {c: F.col(c).try_cast(kind) for c, kind in (coerce or {}).items()}
        lost = F.lit(False)
        for c, made in casts.items():
            lost = lost | (made.isNull() & F.col(c).isNotNull())
        df = df.withColumn("_lost", lost).withColumns(casts)
        bad = F.col("_lost") | ~F.coalesce(rule, F.lit(False))
        if on_error == "raise":
            return df.withColumn(OUTCOME, F.when(live() & bad, F.raise_error(F.lit(f"{name}: invalid record"))).otherwise(F.col(OUTCOME))).drop("_lost")
        out = mark(df, bad, ERRORED, name, "ValidationError", F.lit("invalid record")) if on_error == "dlq" else mark(df, bad, DROPPED, name)
        return out.drop("_lost")

    return named(run, name)


def enrich_stage(lookup: DataFrame, on: str | list[str], name: str = "enrich", required: bool = False, order: list[str] | None = None) -> Stage:
    """A left lookup; where a key has several rows, the first by `order` (by all columns where not
    given) counts, so no record is multiplied. Columns that the records have keep their value where
    the lookup has none. required drops records without a match."""
    keys = [on] if isinstance(on, str) else on

    def run(df: DataFrame) -> DataFrame:
        rest = [c for c in lookup.columns if c not in keys]
        one = F.min_by(F.struct(*rest), F.struct(*(order or rest))) if rest else F.lit(None)
        unique = lookup.dropna(subset=keys).groupBy(*keys).agg(one.alias("_new"), F.lit(True).alias("_found"))
        out = df.join(unique, keys, "left")
        made = {c: F.coalesce(F.col(f"_new.{c}"), F.col(c)) if c in df.columns else F.col(f"_new.{c}") for c in rest}
        out = out.select(*df.columns, "_found", *(made[c].alias(f"_new_{c}") for c in rest))
        out = out.withColumns({c: F.col(f"_new_{c}") for c in rest}).drop(*(f"_new_{c}" for c in rest)) if rest else out
        return (mark(out, F.col("_found").isNull(), DROPPED, name) if required else out).drop("_found")

    return named(run, name)


def route_stage(key: Column, branches: dict, default: dict[str, Column] | Stage | None = None, name: str = "route") -> Stage:
    """By the value of a key: columns, or a stage of its own. Without a default, records of no branch
    are dropped. Branches that are stages may give other columns; missing ones are null."""
    whole = [*branches.values(), *([default] if default is not None else [])]

    def columns(df: DataFrame) -> DataFrame:
        names = sorted({c for b in whole for c in b})
        made = {}
        for c in names:
            old = F.col(c) if c in df.columns else F.lit(None)
            value = (default or {}).get(c, old)
            for k, b in branches.items():
                value = F.when(key == k, b.get(c, old)).otherwise(value)
            made[c] = value
        if default is None:
            df = mark(df, ~F.coalesce(key.isin(*branches), F.lit(False)), DROPPED, name)
        return df.withColumns(made)

    def stages(df: DataFrame) -> DataFrame:
        df = df.withColumn("_branch", F.when(live(), key.cast("string")))
        known = F.coalesce(F.col("_branch").isin(*map(str, branches)), F.lit(False))
        out = mark(df.where(~live() | ~known), F.lit(default is None), DROPPED, name).drop("_branch")
        out = default(out) if default is not None else out
        for k, stage in branches.items():
            out = out.unionByName(stage(df.where(live() & (F.col("_branch") == str(k))).drop("_branch")), allowMissingColumns=True)
        return out

    return named(stages if any(callable(b) for b in whole) else columns, name)


def dedup_stage(key: Column, *order: str, name: str = "dedup") -> Stage:
    """Of live records with equal keys the first in order stays; ties go by a hash of the whole record,
    and of records equal in that too one stays. Null is a key of its own. A key's records are numbered in
    SALTS parts first and only the parts' firsts together, so a key that holds a third of all records
    stays spread."""

    def run(df: DataFrame) -> DataFrame:
        keyed = df.withColumns({"_key": F.struct(key.alias("k")), "_live": live(), "_hash": F.xxhash64(RAW)}).withColumn("_salt", F.pmod("_hash", F.lit(SALTS)))
        place = [*order, "_hash"]
        part = keyed.withColumn("_first", F.row_number().over(Window.partitionBy("_key", "_live", "_salt").orderBy(*place)))
        among = Window.partitionBy("_key", "_live", F.when(F.col("_first") > 1, F.col("_salt"))).orderBy(*place)
        out = mark(part.withColumn("_next", F.row_number().over(among)), (F.col("_first") > 1) | (F.col("_next") > 1), DROPPED, name)
        return out.drop("_key", "_live", "_hash", "_salt", "_first", "_next")

    return named(run, name)


def latest(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The newest record of each key, by one aggregation."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


@dataclass(frozen=True)
class Summary:
    """Counts of one run; consumed = written + dropped + errored."""

    consumed: int
    written: int
    dropped: int
    errored: int
    by_stage: dict[str, dict[str, int]]
    sinks: dict[str, Written] = field(default_factory=dict)
    dead_letters: int = 0

    @property
    def success_rate(self) -> float:
        return self.written / self.consumed if self.consumed else 1.0


@dataclass(frozen=True)
class PipelineExplain:
    pipeline_id: str
    stages: list[tuple[str, str]]
    sinks: list[str]
    notes: list[str]
    plan: str

    def text(self) -> str:
        lines = [f"pipeline {self.pipeline_id}", *(f"  {k + 1}. {n} [{kind}]" for k, (n, kind) in enumerate(self.stages)), *(f"  -> {s}" for s in self.sinks), *(f"  note: {n}" for n in self.notes)]
        return "\n".join([*lines, self.plan])


@dataclass(frozen=True)
class Pipeline:
    source: DataFrame
    stages: tuple[tuple[str, Stage], ...] = field(default_factory=tuple)
    pipeline_id: str = "pipeline"
    max_records: int | None = None
    order: tuple[str, ...] = ()

    def pipe(self, stage: Stage, name: str | None = None) -> Pipeline:
        return replace(self, stages=(*self.stages, (name or getattr(stage, "__name__", "stage"), stage)))

    def filter(self, predicate: Column, name: str = "filter") -> Pipeline:
        return self.pipe(filter_stage(predicate, name), name)

    def map(self, **columns: Column) -> Pipeline:
        return self.pipe(map_stage(**columns), "map")

    def limit(self, n: int, *order: str) -> Pipeline:
        """At most n records are consumed, before any stage; of several limits the smallest holds."""
        if n < 0:
            raise ValueError("a limit is not negative")
        return replace(self, max_records=n if self.max_records is None else min(n, self.max_records), order=order or self.order)

    def consumed(self) -> DataFrame:
        if self.max_records is None:
            return self.source
        return (self.source.orderBy(*self.order) if self.order else self.source).limit(self.max_records)

    def tagged(self) -> DataFrame:
        df = tag(self.consumed())
        for _, stage in self.stages:
            df = stage(df)
        return df

    def written(self) -> DataFrame:
        return self.tagged().where(live()).drop(*CONTROL)

    def dead_letters(self) -> DataFrame:
        """Every errored record by its stage, with the original and the processed form."""
        bad = self.tagged().where(F.col(OUTCOME) == ERRORED)
        now = F.to_json(F.struct(*user_columns(bad)), {"ignoreNullFields": "false"})
        return bad.select(F.col(REASON).alias("stage"), F.col(ERROR_TYPE).alias("error_type"), F.col(ERROR).alias("error_message"), F.col(RAW).alias("record"), F.col(RAW).alias("original_record"), now.alias("processed_record"))

    def outcomes(self) -> DataFrame:
        return self.tagged().groupBy(F.col(OUTCOME).alias("outcome"), F.coalesce(REASON, F.lit("")).alias("reason")).agg(F.count("*").alias("n"))

    def build(self, *sinks: Sink, config=None, dlq: Sink | None = None) -> BoundPipeline:
        from rillstack.delivery import DeliveryConfig

        return BoundPipeline(self, tuple(sinks), None, config or DeliveryConfig(), dlq)

    def fan_out(self, *sinks: Sink, config=None, dlq: Sink | None = None) -> BoundPipeline:
        return self.build(*sinks, config=config, dlq=dlq)

    def route(self, routes: dict[str, tuple[Column, Sink]], default: Sink | None = None, config=None, dlq: Sink | None = None) -> BoundPipeline:
        """Each record goes to the first sink whose predicate holds, else to the default; without one
        it is dropped."""
        bound = self.build(*(s for _, s in routes.values()), *([default] if default else []), config=config, dlq=dlq)
        return replace(bound, routes=(tuple((n, p) for n, (p, _) in routes.items()), default is not None))

    def explain(self) -> PipelineExplain:
        kinds = [(n, getattr(s, "kind", "custom")) for n, s in self.stages]
        notes = [f"{n}: filters after this stage do not reach the source" for n, kind in kinds if kind != "expression"]
        return PipelineExplain(self.pipeline_id, kinds, [], notes, self.tagged()._jdf.queryExecution().toString())


@dataclass(frozen=True)
class BoundPipeline:
    pipeline: Pipeline
    sinks: tuple[Sink, ...]
    routes: tuple[tuple[tuple[str, Column], ...], bool] | None
    config: object
    dlq: Sink | None = None

    def with_sink(self, sink: Sink) -> BoundPipeline:
        """The same run into one other sink: a dry run."""
        return replace(self, sinks=(sink,), routes=None)

    def explain(self) -> PipelineExplain:
        return replace(self.pipeline.explain(), sinks=[s.name for s in self.sinks])

    def run(self, run_id: str | None = None) -> Summary:
        """Tag once into the shared folder, write each sink from that, then the dead letters."""
        from rillstack import delivery

        return delivery.deliver(self, run_id)

    run_sync = run


def route_sinks(df: DataFrame, routes: dict[str, Column], default: str | None = None) -> DataFrame:
    """`_route`: the first sink whose predicate holds, else the default (null: not written)."""
    value = F.lit(default).cast("string")
    for name, predicate in reversed(routes.items()):
        value = F.when(predicate, F.lit(name)).otherwise(value)
    return df.withColumn("_route", value)


def from_records(spark: SparkSession, rows: list, schema: str, pipeline_id: str = "pipeline") -> Pipeline:
    return Pipeline(spark.createDataFrame(rows, schema), pipeline_id=pipeline_id)

"""Schemas of records without one: logical types, inference, evolution under a contract.

Inference joins the types of a field over all records: null < integer < float < string, every other
type < string; the order of records doesn't matter, so it is one aggregation. Evolution goes in source
order, but a column's type changes three times at most, so it is a few aggregations too.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillstack.operators.pipeline import DROPPED, OUTCOME, Stage, live, mark, named, user_columns
from rillstack.state import StateBackend

TYPES = ("string", "integer", "float", "boolean", "timestamp", "json", "bytes", "null")
SPARK = {"string": "string", "integer": "bigint", "float": "double", "boolean": "boolean", "timestamp": "timestamp", "json": "string", "bytes": "binary", "null": "void"}
EVOLVE, FREEZE, DISCARD_ROW, DISCARD_COLUMN = "evolve", "freeze", "discard_row", "discard_column"


def python_type(value: object) -> str:
    """The logical type of a Python value; what isn't known is a string."""
    from datetime import date

    if value is None:
        return "null"
    for kinds, name in ((bool, "boolean"), (int, "integer"), (float, "float"), (date, "timestamp"), ((dict, list), "json"), (bytes, "bytes")):
        if isinstance(value, kinds):
            return name
    return "string"


def spark_type(kind: T.DataType) -> str:
    for kinds, name in (
        (T.BooleanType, "boolean"), ((T.ByteType, T.ShortType, T.IntegerType, T.LongType), "integer"), ((T.FloatType, T.DoubleType), "float"),
        ((T.DateType, T.TimestampType, T.TimestampNTZType), "timestamp"), ((T.StructType, T.ArrayType, T.MapType, T.VariantType), "json"), (T.BinaryType, "bytes"), (T.NullType, "null"),
    ):
        if isinstance(kind, kinds):
            return name
    return "string"


def widened(a: str, b: str) -> str:
    """The least type above both."""
    if a == b or b == "null":
        return a
    if a == "null":
        return b
    return "float" if {a, b} == {"integer", "float"} else "string"


def can_widen(old: str, new: str, null_policy: str = "documented") -> bool:
    """Whether a column of the old type may become the new one. A null fits any column; with the policy
    `observed` it fits a null column only."""
    if new == "null":
        return old == "null" or null_policy == "documented"
    return old in (new, "null") or (old, new) == ("integer", "float") or new == "string"


@dataclass(frozen=True)
class Column_:
    data_type: str
    nullable: bool = True
    inferred_from: int = 0


@dataclass(frozen=True)
class Schema:
    table: str
    columns: dict[str, Column_] = field(default_factory=dict)
    version: int = 1

    @property
    def content_hash(self) -> str:
        body = {"table": self.table, "columns": {n: {"data_type": c.data_type, "nullable": c.nullable} for n, c in self.columns.items()}}
        return hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()[:16]

    def to_struct_type(self) -> T.StructType:
        return T.StructType([T.StructField(n, T.StructType.fromDDL(f"x {SPARK[c.data_type]}")[0].dataType, c.nullable) for n, c in self.columns.items()])

    def to_dict(self) -> dict:
        return {"table": self.table, "version": self.version, "content_hash": self.content_hash, "columns": {n: c.__dict__ for n, c in self.columns.items()}}

    @classmethod
    def from_dict(cls, d: dict, contract: str = EVOLVE) -> Schema:
        out = cls(d["table"], {n: Column_(**c) for n, c in d["columns"].items()}, d["version"])
        if out.content_hash != d["content_hash"] and contract == FREEZE:
            raise ValueError(f"the stored schema of {out.table} doesn't match its hash")
        return out


@dataclass
class SchemaStore:
    backend: StateBackend

    def save(self, pipeline_id: str, schema: Schema) -> None:
        self.backend.set(f"schema:{pipeline_id}:{schema.table}", schema.to_dict())

    def load(self, pipeline_id: str, table: str, contract: str = EVOLVE) -> Schema | None:
        found = self.backend.get(f"schema:{pipeline_id}:{table}")
        return None if found is None else Schema.from_dict(found, contract)


def json_fields(text: Column) -> Column:
    """(name, type) of each field of a JSON object; null for other texts."""
    fields = F.from_json(text, "map<string,variant>")
    kinds = F.transform(F.map_entries(fields), lambda e: F.struct(e["key"].alias("name"), _json_type(e["value"]).alias("type")))
    return F.coalesce(kinds, F.array().cast("array<struct<name:string,type:string>>"))


def _json_type(v: Column) -> Column:
    kind = F.schema_of_variant(v)
    number = F.when(kind == "BIGINT", "integer").when(kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"), "float").when(kind == "BOOLEAN", "boolean")
    return number.when(kind == "STRING", "string").when(kind.isin("VOID"), "null").when(kind.isNull(), "null").otherwise("json")


def infer(records: DataFrame, text: Column, table: str) -> Schema:
    """The schema of JSON objects, nested values not looked into; one row a field reaches the driver."""
    seen = records.select(F.explode(json_fields(text)).alias("f")).groupBy(F.col("f.name").alias("name")).agg(F.collect_set("f.type").alias("types"), F.count("*").alias("n"))
    columns = {}
    for r in seen.orderBy("name").collect():
        kind = "null"
        for t in sorted(r.types):
            kind = widened(kind, t)
        columns[r.name] = Column_(kind, True, r.n)
    return Schema(table, columns)


@dataclass(frozen=True)
class Change:
    pos: int
    column: str
    kind: str  # column_added, type_widened, type_conflict
    old: str | None
    new: str


def evolve(records: DataFrame, text: Column, pos: str, schema: Schema, null_policy: str = "documented") -> tuple[Schema, list[Change], int]:
    """The schema after all records in the order of `pos`, the changes of type on the way, and how many
    records changed something. A record's types are compared with the column as it is by then: integer
    to float widens, any other difference makes a string, and a value of another type in a string column
    counts as a conflict each time. The version grows once for each such record. A column changes its
    type three times at most, so each round finds every column's next change by one aggregation."""
    spark = records.sparkSession
    seen = records.select(F.col(pos).cast("long").alias("pos"), F.explode(json_fields(text)).alias("f")).select("pos", F.col("f.name").alias("name"), F.col("f.type").alias("type"))
    fits_null = null_policy == "documented"
    state: dict[str, tuple[str | None, int]] = {n: (c.data_type, -1 << 62) for n, c in schema.columns.items()}
    changes: list[Change] = []

    def differing() -> DataFrame:
        known = spark.createDataFrame([(n, t, p) for n, (t, p) in state.items()], "name string, now string, since long")  # a row a column
        both = seen.join(F.broadcast(known), "name", "left").where(F.col("now").isNull() | ((F.col("pos") > F.col("since")) & (F.col("type") != F.col("now"))))
        return both.where(F.col("now").isNull() | (F.col("type") != "null")) if fits_null else both

    while True:
        found = differing().where("now is null or now <> 'string'").groupBy("name").agg(F.min(F.struct("pos", "type")).alias("x")).collect()
        if not found:
            break
        for r in found:
            now, (at, kind) = state.get(r.name, (None, 0))[0], r.x
            if now is None:
                changes.append(Change(at, r.name, "column_added", None, kind))
                state[r.name] = (kind, at)
                continue
            new = kind if can_widen(now, kind, null_policy) else "string"
            changes.append(Change(at, r.name, "type_widened" if new == kind else "type_conflict", now, new))
            state[r.name] = (new, at)
    conflicts = differing().where("now = 'string'").select("pos")
    mine = spark.createDataFrame([(c.pos,) for c in changes], "pos long")
    changed = conflicts.union(mine).distinct().count()
    columns = {n: Column_(t or "null", True, schema.columns[n].inferred_from if n in schema.columns else 0) for n, (t, _) in state.items()}
    changes.sort(key=lambda c: (c.pos, c.column))
    return replace(schema, columns=columns, version=schema.version + changed), changes, changed


@dataclass(frozen=True)
class SchemaMetrics:
    columns_added: int
    types_widened: int
    type_conflicts: int
    records_observed: int
    schema_version: int
    columns_removed: int = 0


def metrics(schema: Schema, changes: list[Change], records: int) -> SchemaMetrics:
    n = [sum(c.kind == k for c in changes) for k in ("column_added", "type_widened", "type_conflict")]
    return SchemaMetrics(*n, records, schema.version)


def violations(df: DataFrame, schema: Schema) -> Column:
    """Whether a record has a field that the schema lacks or with another type; null never violates."""
    bad = F.lit(False)
    for f in df.schema.fields:
        if f.name not in user_columns(df):
            continue
        known = schema.columns.get(f.name)
        if known is None or spark_type(f.dataType) != known.data_type:
            bad = bad | F.col(f.name).isNotNull()
    return bad


def schema_stage(schema: Schema, contract: str = EVOLVE, name: str = "schema") -> Stage:
    """evolve passes every record; discard_column leaves out columns that the schema lacks; discard_row
    drops records that don't fit; freeze ends the run at the first of these."""
    if contract not in (EVOLVE, FREEZE, DISCARD_ROW, DISCARD_COLUMN):
        raise ValueError(f"unknown contract {contract!r}")

    def run(df: DataFrame) -> DataFrame:
        if contract == EVOLVE:
            return df
        if contract == DISCARD_COLUMN:
            return df.drop(*(c for c in user_columns(df) if c not in schema.columns))
        bad = violations(df, schema)
        if contract == DISCARD_ROW:
            return mark(df, bad, DROPPED, name)
        return df.withColumn(OUTCOME, F.when(live() & bad, F.raise_error(F.lit(f"{name}: a record doesn't fit the frozen schema"))).otherwise(F.col(OUTCOME)))

    return named(run, name)

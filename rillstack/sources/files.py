"""File sources. Each read is declarative, so filters and column choice reach the scan.

`exact` readers keep what Spark's own lose: a row's number, fields over the header's, and what to do
with a record that can't be read. A file is one split there, since a quoted line break makes lines and
rows differ; folders of many files are read in parallel.
"""

from __future__ import annotations

import csv as csvlib
import io
import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from rillstack.delivery import FAIL_CLOSED, CheckpointManager, SourceIdentity

#: Overflow fields of a CSV row, as a JSON list; why a record couldn't be read.
OVERFLOW, ERROR = "_overflow", "_source_error"


def records(spark: SparkSession, rows: Iterable, schema: str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def csv(spark: SparkSession, path: str, header: bool = True, names: list[str] | None = None, delimiter: str = ",", skip_blank: bool = True) -> DataFrame:
    """All values are strings; rows without any value are skipped. An empty field that isn't quoted can't
    be told from a missing one here and is null: FileSource keeps both apart."""
    df = spark.read.option("header", header).option("sep", delimiter).option("nullValue", "\u0000").option("emptyValue", "").option("inferSchema", False).csv(path)
    if names:
        df = df.toDF(*names)
    if skip_blank:
        df = df.where(" or ".join(f"coalesce(`{c}`, '') <> ''" for c in df.columns))
    return df


def typed_csv(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """Columns with the types that their values have."""
    return spark.read.option("header", True).option("sep", delimiter).option("inferSchema", True).csv(path)


def jsonl(spark: SparkSession, path: str, schema: str, keep_bad: bool = False) -> DataFrame:
    """One JSON object a line. Bad lines fail the read, or stay in `_bad` with keep_bad."""
    if not keep_bad:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return spark.read.schema(f"{schema}, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)


def typed_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


def parquet(spark: SparkSession, path: str, with_position: bool = False) -> DataFrame:
    """With a position, rows carry their file and index within it, by which a run resumes."""
    df = spark.read.parquet(path)
    return df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")) if with_position else df


def limited(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n records in source order, before any stage."""
    if n < 0:
        raise ValueError("a limit is not negative")
    return df.orderBy(*order).limit(n) if order else df.limit(n)


def _csv_rows(body: str, delimiter: str, header: bool, names: list[str], skip_blank: bool) -> Iterator[dict]:
    reader = csvlib.reader(io.StringIO(body), delimiter=delimiter)
    if header:
        names = next(reader, names)
    n = 0
    for row in reader:
        if skip_blank and not any(row):
            continue
        n += 1
        out: dict = dict.fromkeys(names) | dict(zip(names, row, strict=False))
        if len(row) > len(names):
            out[OVERFLOW] = json.dumps(row[len(names) :])
        yield out | {"_row": n}


def _json_rows(body: str) -> Iterator[dict]:
    for n, line in enumerate(body.split("\n"), 1):
        if line.strip():
            try:
                value, error = json.loads(line), None
            except ValueError as e:
                value, error = line, f"{type(e).__name__}: {e}"
            yield {"value": value if error else json.dumps(value), ERROR: error, "_row": n}


@dataclass
class FileSource:
    """A file or folder that a run may resume: rows after the saved cursor, if the file is still the same.

    row_mapper takes a record (dict) and gives one, or None for a source drop; an exception is handled by
    `on_error`: fail_closed ends the read, log_and_continue leaves the record out and counts it as both an
    error and a drop (rows with `_source_error` in `failures`).
    """

    path: str
    schema: str | None = None
    row_mapper: Callable[[dict], dict | None] | None = None
    on_error: str = FAIL_CLOSED
    mismatch: str = FAIL_CLOSED
    format: str = "parquet"
    options: dict = field(default_factory=dict)

    @property
    def cursor(self) -> str:
        return "line_number" if self.format == "jsonl" else "row_number"

    def identity(self, spark: SparkSession) -> SourceIdentity:
        return SourceIdentity.of(spark, self.path)

    def _raw(self, spark: SparkSession) -> DataFrame:
        if self.format == "parquet":
            df = spark.read.parquet(self.path)
            return df.select("*", (F.col("_metadata.row_index") + 1).alias("_row"))
        whole = spark.read.text(self.path, wholetext=True)
        if self.format == "jsonl":
            kinds, make = f"value string, {ERROR} string, _row long", _json_rows
        else:
            names, header, delimiter, skip = (self.options.get(k, d) for k, d in (("names", None), ("header", True), ("delimiter", ","), ("skip_blank", True)))
            if header and names is None:
                names = csv(spark, self.path, True, None, delimiter, False).columns
            kinds = ", ".join([*(f"`{n}` string" for n in names), f"{OVERFLOW} string, {ERROR} string, _row long"])

            def make(body: str) -> Iterator[dict]:
                return _csv_rows(body, delimiter, header, names, skip)

        arrow = to_arrow_schema(StructType.fromDDL(kinds))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for body in batch.column(0).to_pylist():
                    held: list[dict] = []
                    for r in make(body):
                        held.append({n: r.get(n) for n in arrow.names})
                        if len(held) == 5000:
                            yield pa.RecordBatch.from_pylist(held, schema=arrow)
                            held = []
                    if held:
                        yield pa.RecordBatch.from_pylist(held, schema=arrow)

        return whole.mapInArrow(run, kinds)

    def read(self, spark: SparkSession, after: dict | None = None) -> DataFrame:
        """The records with `_row`, their number in the file; with a cursor only those behind it."""
        df = self._raw(spark)
        if ERROR not in df.columns:
            df = df.withColumn(ERROR, F.lit(None).cast("string"))
        if after:
            df = df.where(F.col("_row") > int(after[self.cursor]))
        if self.row_mapper is not None:
            df = self._mapped(df)
        if self.on_error == FAIL_CLOSED:
            failing = F.when(F.col(ERROR).isNotNull(), F.raise_error(F.concat(F.lit("a record can't be read: "), F.col(ERROR))).cast("long")).otherwise(F.col("_row"))
            return df.select(*(failing.alias(c) if c == "_row" else F.col(c) for c in df.columns if c != ERROR))
        return df.where(F.col(ERROR).isNull()).drop(ERROR)

    def failures(self, spark: SparkSession) -> DataFrame:
        """The records that can't be read, with the reason."""
        df = self._raw(spark)
        df = df if ERROR in df.columns else df.withColumn(ERROR, F.lit(None).cast("string"))
        return (self._mapped(df) if self.row_mapper else df).where(F.col(ERROR).isNotNull())

    def _mapped(self, df: DataFrame) -> DataFrame:
        mapper, jsonl_value = self.row_mapper, self.format == "jsonl"
        user = StructType.fromDDL(self.schema).fields if self.schema else [f for f in df.schema.fields if f.name not in ("_row", ERROR)]
        out = StructType([*user, StructField(ERROR, StringType()), df.schema["_row"]])
        arrow = to_arrow_schema(out)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                made = []
                for r in batch.to_pylist():
                    row, error = r.pop("_row"), r.pop(ERROR, None)
                    x: dict | None = {}
                    if error is None:
                        try:
                            x = mapper(json.loads(r["value"]) if jsonl_value else r)
                        except Exception as e:  # noqa: BLE001  a failing record is data
                            error, x = f"{type(e).__name__}: {e}", {}
                    if x is not None:
                        made.append({n: x.get(n) for n in arrow.names} | {"_row": row, ERROR: error})
                yield pa.RecordBatch.from_pylist(made, schema=arrow)

        return df.mapInArrow(run, out)

    def resume(self, spark: SparkSession, manager: CheckpointManager, pipeline_id: str) -> DataFrame:
        """What the last run has not had yet."""
        return self.read(spark, manager.restore(pipeline_id, self.path, self.identity(spark), self.mismatch))

    def save(self, spark: SparkSession, manager: CheckpointManager, pipeline_id: str, run_id: str, row: int, count: int = 0) -> bool:
        return manager.save(pipeline_id, run_id, self.path, {self.cursor: row}, count, self.identity(spark))

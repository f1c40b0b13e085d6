"""File sinks: folders of CSV, JSON lines or Parquet that Spark writes in parallel, all or nothing.

`overwrite` replaces the folder, `append` adds files; a run id in the path (`by_run`) makes a repeated
run replace its own files only, so it is safe to replay.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from rillstack.sinks.base import Capabilities, Sink, Written


@dataclass
class FileSink(Sink):
    path: str
    mode: str = "overwrite"
    by_run: bool = False
    partition_by: tuple[str, ...] = ()
    name: str = "file"
    format: str = "parquet"

    @property
    def capabilities(self) -> Capabilities:  # type: ignore[override]
        safe = self.by_run or self.mode == "overwrite"
        return Capabilities(replay_safe=safe, idempotent=safe)

    def options(self) -> dict:
        return {}

    def shaped(self, df: DataFrame) -> DataFrame:
        return df

    def place(self, run_id: str) -> str:
        return f"{self.path.rstrip('/')}/run={run_id}" if self.by_run else self.path

    def write(self, df: DataFrame, run_id: str = "") -> Written:
        from pyspark.sql import Observation

        seen = Observation()
        out = self.shaped(df).observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite" if self.by_run else self.mode).options(**self.options())
        (out.partitionBy(*self.partition_by) if self.partition_by else out).format(self.format).save(self.place(run_id))
        return Written(self.name, seen.get["n"])


@dataclass
class ParquetSink(FileSink):
    """With `columns` (a DDL schema) missing columns are null and others are left out, so later runs
    can't change the table's schema."""

    columns: str | None = None
    name: str = "parquet"

    def options(self) -> dict:
        return {"compression": "snappy"}

    def shaped(self, df: DataFrame) -> DataFrame:
        if not self.columns:
            return df
        kinds = StructType.fromDDL(self.columns).fields
        return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds))


@dataclass
class CsvSink(FileSink):
    """Fields in the order of the columns or of `fieldnames` (others are left out, missing ones empty);
    nested values are JSON."""

    fieldnames: tuple[str, ...] | None = None
    delimiter: str = ","
    header: bool = True
    name: str = "csv"
    format: str = "csv"

    def options(self) -> dict:
        return {"header": str(self.header).lower(), "sep": self.delimiter, "emptyValue": "", "escape": '"', "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss[.SSSSSS]"}

    def shaped(self, df: DataFrame) -> DataFrame:
        nested = {f.name for f in df.schema.fields if isinstance(f.dataType, ArrayType | MapType | StructType)}
        names = self.fieldnames or df.columns
        return df.select(*((F.to_json(c) if c in nested else F.col(c)).alias(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in names))


@dataclass
class JsonLinesSink(FileSink):
    """One object a line; null fields are kept."""

    name: str = "jsonl"
    format: str = "json"

    def options(self) -> dict:
        return {"ignoreNullFields": "false"}


@dataclass
class DeadLetterSink(FileSink):
    """A table of dead letters; equal ids (a run that was repeated) are one when it is read."""

    mode: str = "append"
    name: str = "dlq"

    @property
    def capabilities(self) -> Capabilities:  # type: ignore[override]
        return Capabilities(replay_safe=True, idempotent=True)

    def read(self, spark) -> DataFrame:
        from rillstack.delivery import DLQ_SCHEMA

        return spark.read.schema(DLQ_SCHEMA).parquet(self.path).dropDuplicates(["id"])

    def keep(self, remaining: DataFrame) -> None:
        """What a replay left over becomes the table: written beside it first, then put in its place."""
        spark = remaining.sparkSession
        new = f"{self.path.rstrip('/')}.new"
        remaining.write.mode("overwrite").parquet(new)
        path = spark._jvm.org.apache.hadoop.fs.Path
        fs = path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        fs.delete(path(self.path), True)
        if not fs.rename(path(new), path(self.path)):
            raise OSError(f"{new} can't take the place of {self.path}")

"""Stages that run Python on records, batches or Arrow batches, with errors as data.

An exception that left a Python function would end the Spark job and lose the count of every other
record. So each stage catches it where it happens and the record becomes `errored` (or what
`on_error` says). Records that earlier stages dropped pass untouched. Whole batches fail together
where the function takes a batch.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late

import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from rillstack.operators.pipeline import CONTROL, DROPPED, ERROR, ERROR_TYPE, ERRORED, OUTCOME, REASON, WRITTEN, Stage, checked_policy, named, user_columns

Records = list[dict]


def _stage(make: Callable[[], Callable[[Records], list]], schema: str | None, name: str, on_error: str, size: int, kind: str) -> Stage:
    """make() is called once for each task and returns a function from live records to, for each, a
    dict, None (dropped) or an exception (failed)."""
    checked_policy(on_error)

    def run(df: DataFrame) -> DataFrame:
        before, fields = user_columns(df), StructType.fromDDL(schema).fields if schema else None
        kept = [f for f in df.schema.fields if f.name in CONTROL]
        out = StructType([*(fields or [f for f in df.schema.fields if f.name in before]), *kept])
        arrow = to_arrow_schema(out)
        names = [f.name for f in out.fields if f.name not in CONTROL]

        def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            work = make()
            for batch in source:
                rows = batch.to_pylist()
                for k in range(0, len(rows), size):
                    part = rows[k : k + size]
                    alive = [r for r in part if r[OUTCOME] == WRITTEN]
                    users = [{c: r[c] for c in before} for r in alive]
                    results = work(users) if users else []
                    for r, user, x in zip(alive, users, results, strict=True):
                        if isinstance(x, BaseException):
                            if on_error == "raise":
                                raise x
                            if on_error in ("drop", "log"):
                                r.update({OUTCOME: DROPPED, REASON: name})
                            elif on_error == "dlq":
                                r.update({OUTCOME: ERRORED, REASON: name, ERROR_TYPE: type(x).__name__, ERROR: str(x)[:500]})
                            x = user
                        elif x is None:
                            r.update({OUTCOME: DROPPED, REASON: name})
                            x = user
                        r.update({c: x.get(c) for c in names})
                    yield pa.RecordBatch.from_pylist([{f: r.get(f) for f in arrow.names} for r in part], schema=arrow)

        return df.mapInArrow(batches, out)

    return named(run, name, kind)


def _one(fn: Callable[[dict], object], record: dict) -> object:
    try:
        return fn(record)
    except Exception as e:  # noqa: BLE001  the error is the record's result
        return e


def record_map(fn: Callable[[dict], dict | None], schema: str | None = None, name: str = "map", on_error: str = "dlq") -> Stage:
    """fn gives the new record; None drops it. schema (DDL) where the columns change."""
    return _stage(lambda: lambda rows: [_one(fn, r) for r in rows], schema, name, on_error, 1000, "python")


def record_filter(predicate: Callable[[dict], object], name: str = "filter", on_error: str = "dlq") -> Stage:
    """A falsy result drops."""
    return record_map(lambda r: r if predicate(r) else None, None, name, on_error)


def batch_map(fn: Callable[[Records], list], schema: str | None = None, name: str = "batch_map", size: int = 1000, on_error: str = "dlq") -> Stage:
    """fn takes up to `size` records and gives as many results, None for a dropped one; an exception or
    another number fails the whole batch."""

    def work(rows: Records) -> list:
        try:
            out = list(fn(rows))
            if len(out) != len(rows):
                raise RuntimeError(f"{name}: {len(out)} results for {len(rows)} records")
            return out
        except Exception as e:  # noqa: BLE001
            return [e] * len(rows)

    return _stage(lambda: work, schema, name, on_error, size, "batch")


def batch_filter(predicate: Callable[[Records], list], name: str = "batch_filter", size: int = 1000, on_error: str = "dlq") -> Stage:
    def fn(rows: Records) -> list:
        keep = list(predicate(rows))
        if len(keep) != len(rows):
            raise RuntimeError(f"{name}: {len(keep)} results for {len(rows)} records")
        return [r if k else None for r, k in zip(rows, keep, strict=True)]

    return batch_map(fn, None, name, size, on_error)


def process_batch(fn: Callable[[Records], list], schema: str | None = None, name: str = "process_batch", size: int = 1000, timeout: float | None = None, on_error: str = "dlq") -> Stage:
    """A row-preserving batch function with a time limit for each batch. Executors' Python workers are
    processes of their own already; a batch that is late fails, and its thread is left behind."""

    def work(rows: Records) -> list:
        pool = ThreadPoolExecutor(1)
        try:
            out = list(pool.submit(fn, rows).result(timeout))
            if len(out) != len(rows) or any(x is None for x in out):
                raise RuntimeError(f"{name}: the function must give one record for each")
            return out
        except Late:
            return [TimeoutError(f"{name}: over {timeout} s")] * len(rows)
        except Exception as e:  # noqa: BLE001
            return [e] * len(rows)
        finally:
            pool.shutdown(wait=False)

    return _stage(lambda: work, schema, name, on_error, size, "process")


def _arrow(fn: Callable[[pa.RecordBatch], object], schema: str | None, name: str, finish: Callable) -> Stage:
    def run(df: DataFrame) -> DataFrame:
        before = user_columns(df)
        out = StructType([*(StructType.fromDDL(schema).fields if schema else [f for f in df.schema.fields if f.name in before]), *(f for f in df.schema.fields if f.name in CONTROL)])
        arrow = to_arrow_schema(out)

        def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in source:
                mask = pa.compute.equal(batch.column(OUTCOME), WRITTEN)
                alive, rest = batch.filter(mask), batch.filter(pa.compute.invert(mask))
                parts = [rest] if rest.num_rows else []
                if alive.num_rows:
                    users = alive.select(before)
                    try:
                        parts += finish(fn(users), alive, name)
                    except Exception as e:  # noqa: BLE001
                        parts.append(_with(alive, {OUTCOME: ERRORED, REASON: name, ERROR_TYPE: type(e).__name__, ERROR: str(e)[:500]}))
                for p in parts:
                    columns = [p.column(f.name).cast(f.type) if f.name in p.schema.names else pa.nulls(p.num_rows, f.type) for f in arrow]
                    yield pa.RecordBatch.from_arrays(columns, schema=arrow)

        return df.mapInArrow(batches, out)

    return named(run, name, "arrow")


def _with(batch: pa.RecordBatch, values: dict) -> pa.RecordBatch:
    columns = {n: batch.column(n) for n in batch.schema.names} | {k: pa.array([v] * batch.num_rows, pa.string()) for k, v in values.items()}
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def arrow_map(fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | None = None, name: str = "arrow_map") -> Stage:
    """fn may change columns and the number of rows; where the number changes, the source record of a
    row is no longer known and `_raw` is null."""

    def finish(made: pa.RecordBatch, alive: pa.RecordBatch, _: str) -> list[pa.RecordBatch]:
        same = made.num_rows == alive.num_rows
        control = {c: alive.column(c) if same else pa.array([WRITTEN if c == OUTCOME else None] * made.num_rows, pa.string()) for c in CONTROL}
        columns = {n: made.column(n) for n in made.schema.names} | control
        return [pa.RecordBatch.from_arrays(list(columns.values()), list(columns))]

    return _arrow(fn, schema, name, finish)


def arrow_filter(predicate: Callable[[pa.RecordBatch], pa.BooleanArray], name: str = "arrow_filter") -> Stage:
    """Rows for which the mask is false or null are dropped, and counted so."""

    def finish(mask: pa.BooleanArray, alive: pa.RecordBatch, name: str) -> list[pa.RecordBatch]:
        mask = pa.compute.fill_null(mask.cast(pa.bool_()), False)
        gone = alive.filter(pa.compute.invert(mask))
        return [alive.filter(mask), _with(gone, {OUTCOME: DROPPED, REASON: name})]

    return _arrow(predicate, None, name, finish)


def retry_map(fn: Callable[[dict], dict | None], schema: str | None = None, name: str = "retry", max_retries: int = 3, backoff: float = 2.0, exceptions: tuple = (Exception,), on_error: str = "dlq", sleep: Callable[[float], None] = time.sleep) -> Stage:
    """Up to max_retries more calls after `backoff`, `backoff` squared, ... seconds. The loop is inside
    the task: a retry of Spark's would run other records again too."""

    def once(record: dict) -> dict | None:
        for attempt in range(max_retries + 1):
            try:
                return fn(dict(record))
            except exceptions:
                if attempt == max_retries:
                    raise
                sleep(backoff ** (attempt + 1))
        raise AssertionError("not reached")

    return record_map(once, schema, name, on_error)


def enrich_map(fn: Callable[[dict], dict | None], schema: str, name: str = "enrich", on_error: str = "passthrough", setup: Callable[[], object] | None = None) -> Stage:
    """fn gives updates to merge, or None for none. With setup, its result (made once a task) is fn's
    second argument. schema names all columns after the merge."""

    def make():
        state = setup() if setup else None

        def work(rows: Records) -> list:
            return [_one(lambda x: {**x, **((fn(x, state) if setup else fn(x)) or {})}, r) for r in rows]

        return work

    return _stage(make, schema, name, on_error, 1000, "python")


def validate_map(validator: Callable[[dict], dict | bool | None], schema: str | None = None, name: str = "validate", on_error: str = "drop") -> Stage:
    """A dict (the coerced record) or True is valid; anything else, or an exception, is not. A value
    that is passed through would not be valid, so `passthrough` drops as well."""
    checked_policy(on_error)

    def work(r: dict) -> dict | None:
        x = validator(r)
        if x is True:
            return r
        if not isinstance(x, dict):
            raise ValueError("invalid record")
        return x

    return record_map(work, schema, name, "drop" if on_error in ("passthrough", "log") else on_error)

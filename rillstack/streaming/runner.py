"""The same pipelines on streams: each micro-batch goes through the stages and sinks of a bound pipeline.

Offsets and commits are Spark's checkpoint. A micro-batch that is run again has the same run id, so sinks
with files by run replace their own. Streaming dedup keeps its keys in Spark's state store.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from rillstack.delivery import Fence
from rillstack.operators.pipeline import BoundPipeline, Summary
from rillstack.schedule import Schedule


@dataclass
class StreamRunner:
    """build binds a micro-batch to stages and sinks; with a fence, a holder that lost its lease stops."""

    name: str
    build: Callable[[DataFrame], BoundPipeline]
    checkpoint: str
    schedule: Schedule = Schedule("once")
    fence: Fence | None = None
    on_summary: Callable[[int, Summary], None] | None = None

    def start(self, stream: DataFrame) -> StreamingQuery:
        def one(batch: DataFrame, number: int) -> None:
            if self.fence:
                self.fence.check()
            summary = self.build(batch).run(f"{self.name}-{number}")
            if self.on_summary:
                self.on_summary(number, summary)

        return stream.writeStream.queryName(self.name).foreachBatch(one).option("checkpointLocation", self.checkpoint).trigger(**self.schedule.trigger()).start()

    def run(self, stream: DataFrame) -> None:
        """All that is there now, then stop."""
        StreamRunner(self.name, self.build, self.checkpoint, Schedule("once"), self.fence, self.on_summary).start(stream).awaitTermination()


def dedup_within(stream: DataFrame, keys: list[str], event_time: str, delay: str) -> DataFrame:
    """The first record of each key within an event-time watermark."""
    df = stream.withColumn(event_time, F.col(event_time).cast("timestamp"))
    return df.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


class _First(StatefulProcessor):
    """Passes a key's first row; its state ends a time to live (processing time) after that."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "n int", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            if len(part) and not self.seen.exists():
                self.seen.update((1,))
                yield part.head(1)

    def close(self) -> None:
        pass


def dedup_ttl(stream: DataFrame, keys: list[str], seconds: float) -> DataFrame:
    """The first record of each key, and again one after its time to live. Needs the RocksDB store."""
    return stream.groupBy(*keys).transformWithStateInPandas(_First(int(seconds * 1000)), stream.schema, "append", "processingTime")


def windowed_counts(stream: DataFrame, event_time: str, width: str, delay: str, *keys: str) -> DataFrame:
    """Counts by tumbling windows of event time; later rows than the delay are left out."""
    df = stream.withColumn(event_time, F.col(event_time).cast("timestamp")).withWatermark(event_time, delay)
    return df.groupBy(F.window(event_time, width), *keys).count().select(F.col("window.start").alias("start"), *keys, F.col("count").alias("n"))

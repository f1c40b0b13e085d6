"""Operator 1: token ids in ORC files, in ascending document order.

Each range of documents is one file. Its stripes hold ``doc_id`` with row index and Bloom filter
and the ids as run-length encoded integers, so a reader may take stripes in parallel and skip
those whose statistics or filter rule a document out.

Defined results: a null text is empty and gives the end id alone; a null ``doc_id`` sorts first;
rows of one ``doc_id`` are ordered by text; an empty table gives no row. Columns other than
``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillstack.llm import bpe
from rillstack.llm.common import arrow_limits, documents, gathered, put, shared_path, text_buffer

END = 0
SLICE = 12 << 20
SCHEMA = "doc_id long, part int, seq int, n_tokens int, ids array<int>"
WRITER = {
    "compression": "zstd", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01",
    "orc.create.index": "true", "orc.row.index.stride": "1000", "orc.stripe.size": str(64 << 20),
}


def _encode(json_path: str | None, rank_path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.library_pieces(json_path, rank_path)
        part, seq = TaskContext.get().partitionId(), 0
        for batch in gathered(batches, limit=SLICE):
            n = batch.num_rows
            ids, at = bpe.encode(*text_buffer(batch.column("text")), encoder)
            out = np.full(len(ids) + n, END, np.int32)
            body = np.ones(len(out), dtype=bool)
            ends = at[1:] + np.arange(1, n + 1)
            body[ends - 1] = False
            out[body] = ids
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(out))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.full(n, part, np.int32)), pa.array(np.arange(seq, seq + n, dtype=np.int32)), pa.array(np.diff(ends, prepend=0).astype(np.int32)), lists],
                ["doc_id", "part", "seq", "n_tokens", "ids"],
            )
            seq += n

    return run


def write_token_ids(docs: DataFrame, path: str, json_path: str | None = None, rank_path: str | None = None) -> None:
    """Encode ``text`` of every row of docs, append the end id to each, and write the files."""
    arrow_limits(docs.sparkSession)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    ranged.mapInArrow(_encode(json_path, rank_path), SCHEMA).write.options(**WRITER).orc(path)


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows: part and seq give the order, ids end with the end id."""
    return spark.read.schema(SCHEMA).orc(path)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        at = lists.offsets.to_numpy()
        flat = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False)).astype("<u4", copy=False)
        crcs = [zlib.crc32(flat[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("part"), batch.column("seq"), pa.array(np.diff(at).astype(np.int64)), pa.array(crcs, pa.int64())],
            ["doc_id", "part", "seq", "n_tokens", "ids_crc32"],
        )


def token_offsets(spark: SparkSession, path: str) -> DataFrame:
    """For each document in the files: where its ids start among all ids, their number and crc32.

    The running sum has two levels: within each file's rows, and over the sums of the files.
    """
    arrow_limits(spark)
    rows = put(read_token_ids(spark, path).select("doc_id", "part", "seq", "ids").mapInArrow(_digest, "doc_id long, part int, seq int, n_tokens long, ids_crc32 long"), "token-offsets")
    files = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(files), F.lit(0)).alias("base"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    # one row of sums for each file, and as many files as shuffle partitions
    return rows.join(F.broadcast(sums), "part").select("doc_id", (F.col("base") + F.coalesce(inside, F.lit(0))).cast("long").alias("start"), "n_tokens", "ids_crc32")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "token-ids")
    write_token_ids(documents(spark, sf_dir), path)
    return token_offsets(spark, path)

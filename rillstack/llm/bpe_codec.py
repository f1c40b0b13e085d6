"""Operator 2: BPE encoding and decoding of every document.

The distinct words of a slice of texts go through the trie of ``trie.py``; ids of texts are laid
out from those. Decoding takes bytes from the token table by id. Nothing is shuffled, and a worker
holds one slice of texts at a time.

Defined results: a null text is empty (no ids, empty decoded text); every row of the input gives
one row, repeated or not; a null ``doc_id`` stays null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstack.llm import bpe
from rillstack.llm.common import arrow_limits, documents, gathered, text_buffer
from rillstack.llm.trie import trie_pieces

SLICE = 12 << 20


def _lists(ids: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))


def encode(docs: DataFrame, text: str = "text", ids: str = "ids", json_path: str | None = None, rank_path: str | None = None) -> DataFrame:
    """docs with a column of token ids; the text column is kept."""
    arrow_limits(docs.sparkSession)
    schema = docs.withColumn(ids, F.lit(None).cast("array<int>")).schema
    place = schema.fieldNames().index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = trie_pieces(json_path, rank_path)
        for batch in gathered(batches, text, SLICE):
            found = _lists(*bpe.encode(*text_buffer(batch.column(text)), pieces))
            columns = [*batch.columns]
            columns[place:] = [found, *columns[place + (ids in batch.schema.names) :]]
            yield pa.RecordBatch.from_arrays(columns, schema.fieldNames())

    return docs.mapInArrow(run, schema)


def decode(docs: DataFrame, ids: str = "ids", text: str = "decoded", rank_path: str | None = None) -> DataFrame:
    """docs with the text of a column of ids."""
    arrow_limits(docs.sparkSession)
    schema = docs.withColumn(text, F.lit(None).cast("string")).schema
    place = schema.fieldNames().index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(ids).fill_null(pa.scalar([], batch.column(ids).type)) if batch.column(ids).null_count else batch.column(ids)
            data, at = bpe.decode(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py(), rank_path)
            whole = data.tobytes()
            found = pa.array([whole[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.string())
            columns = [*batch.columns]
            columns[place:] = [found, *columns[place + (text in batch.schema.names) :]]
            yield pa.RecordBatch.from_arrays(columns, schema.fieldNames())

    return docs.mapInArrow(run, schema)


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def round_trips(docs: DataFrame, json_path: str | None = None, rank_path: str | None = None) -> DataFrame:
    """For each document the number of ids, their digest, and the digest of what they decode to."""
    arrow_limits(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = trie_pieces(json_path, rank_path)
        for batch in gathered(batches, limit=SLICE):
            ids, at = bpe.encode(*text_buffer(batch.column("text")), pieces)
            data, back = bpe.decode(ids, at, rank_path)
            low = np.ascontiguousarray(ids.astype("<u4", copy=False))
            spans = zip(at[:-1].tolist(), at[1:].tolist(), back[:-1].tolist(), back[1:].tolist(), strict=True)
            digests = [(hashlib.sha256(low[a:b]).hexdigest(), hashlib.sha256(_sound(data[c:d])).hexdigest()) for a, b, c, d in spans]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(at)), pa.array([x for x, _ in digests], pa.string()), pa.array([y for _, y in digests], pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, DIGESTS)


def _sound(data: np.ndarray) -> bytes:
    """The bytes of the decoded text: as they are if they are UTF-8."""
    return data.tobytes().decode("utf-8", "replace").encode("utf-8")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trips(documents(spark, sf_dir))

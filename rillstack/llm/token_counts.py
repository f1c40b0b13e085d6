"""Operator 6: token counts through a cache of digests.

A document's key is the SHA-256 of its text and the digest of the tokenizer's file. Counts of keys
that the cache table holds are joined; of the others, one text for each key is encoded, and the new
counts are appended to the cache. A count depends on every byte, so normalising a text means no
more than taking null as empty.

Defined results: every row of the input gives one row; a null ``doc_id`` stays null; a null text
counts as empty. A key that was appended twice (by two runs at once) has the same count twice and is
joined once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstack.llm import bpe
from rillstack.llm.common import BROADCAST_ROWS, arrow_limits, documents, gathered, put, shared_path, text_buffer, tokenizer_path

SLICE = 12 << 20
CACHE = "tokenizer string, digest binary, n_tokens long"


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache table; one that was never written is empty."""
    try:
        return spark.read.schema(CACHE).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE)


def _counter(json_path: str, rank_path: str | None):
    encoders = {}

    def library_model(batch: pa.RecordBatch) -> np.ndarray:
        import sentencepiece

        model = encoders.setdefault("model", sentencepiece.SentencePieceProcessor(model_file=json_path))
        texts = batch.column("text").fill_null("").to_pylist()
        return np.array([len(x) for x in model.encode(texts, num_threads=1)], np.int64)

    def library_json(batch: pa.RecordBatch) -> np.ndarray:
        t = bpe.tokenizer(json_path)
        return np.array([len(t.encode(x, add_special_tokens=False).ids) for x in batch.column("text").fill_null("").to_pylist()], np.int64)

    def byte_level(batch: pa.RecordBatch) -> np.ndarray:
        encoder = encoders.setdefault("bpe", bpe.library_pieces(json_path, rank_path))
        return bpe.count(*text_buffer(batch.column("text")), encoder)

    count = library_model if json_path.endswith(".model") else byte_level if json_path.endswith("byte_bpe_50k.json") else library_json

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, limit=SLICE):
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(count(batch), pa.int64())], ["digest", "n_tokens"])

    return run


def token_counts(docs: DataFrame, cache: str, json_path: str | None = None, limit: int = 512, rank_path: str | None = None) -> DataFrame:
    """For each document the bytes and tokens of its text, and whether they exceed the limit."""
    spark = docs.sparkSession
    arrow_limits(spark)
    json_path = json_path or tokenizer_path()
    version = tokenizer_digest(json_path)
    text = F.coalesce("text", F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest"))
    keys = put(texts.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes")), "token-keys")

    stored = read_cache(spark, cache).where(F.col("tokenizer") == version).select("digest")
    owner = keys.groupBy("digest").agg(F.min(F.coalesce("doc_id", F.lit(-(1 << 63)))).alias("owner"))
    misses = put(owner.join(stored, "digest", "left_anti"), "token-misses")
    n_misses, n_keys = misses.count(), keys.count()
    row = F.coalesce("doc_id", F.lit(-(1 << 63)))
    if n_misses:
        mine = [F.col("digest") == F.col("m.digest"), row == F.col("m.owner")]
        if n_misses <= BROADCAST_ROWS or n_keys - n_misses > BROADCAST_ROWS:
            side = misses.alias("m")
            todo = texts.join(F.broadcast(side) if n_misses <= BROADCAST_ROWS else side, [texts.digest == F.col("m.digest"), mine[1]], "left_semi")
        else:  # few rows are not to be encoded: leave those out
            rest = keys.select("digest", row.alias("owner")).join(misses, ["digest", "owner"], "left_anti").alias("m")
            todo = texts.join(F.broadcast(rest), [texts.digest == F.col("m.digest"), mine[1]], "left_anti")
        new = todo.select("digest", "text").mapInArrow(_counter(json_path, rank_path), "digest binary, n_tokens long")
        new.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache)
    counts = read_cache(spark, cache).where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    return keys.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), shared_path(spark, "token-cache"))

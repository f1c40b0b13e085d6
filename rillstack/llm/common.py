"""Shared helpers: the shared folder, Arrow text buffers, word spans and fingerprints."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Iterator
from functools import cache
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, wherever an operator counts or compares words.
WORD = r"[^\x20\x09-\x0D]+"
#: What separates words, as a Java regular expression.
BLANKS = r"[\x20\x09-\x0D]+"

#: Text bytes that a Python worker handles at once; bounds its memory whatever the batch.
SLICE_BYTES = 8 << 20

#: Rows of ids or keys up to which a side of a join is broadcast (16 bytes each).
BROADCAST_ROWS = 1_000_000

#: The place of a null doc_id: after all others.
LAST = (1 << 63) - 1

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session names none, a local one (tests) gets a temporary folder, any other fails.
    """
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("rillstack.shared.dir", None)
    if not there:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        there = "file://" + tempfile.mkdtemp(prefix="rillstack-")
        spark.conf.set("rillstack.shared.dir", there)
    return there.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def put(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: cuts the lineage, and what
    follows survives the loss of any executor."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    release(spark)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the files of a table made by put() that nothing reads any more."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = shared_dir(spark).split(":", 1)[-1].lstrip("/")
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if root in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of plans that are no longer referenced."""
    gc.collect()
    spark._jvm.System.gc()


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it has no more rows than the bound, else df: the join then
    shuffles."""
    n = df.limit(rows + 1).count()
    return F.broadcast(df) if n <= rows else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def arrow_limits(spark: SparkSession) -> None:
    """Arrow batches of few rows: a batch of long texts then stays small. Results don't depend
    on it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """A vocabulary file; ``RILLSTACK_TOKENIZERS`` names another folder than the installed one."""
    own = os.environ.get("RILLSTACK_TOKENIZERS")
    if own:
        return os.path.join(own, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts on end, and the offset of each and of the end; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of all batches, in parts of about `limit` bytes of text (a longer text is a part
    of its own). Batches are cut, never joined."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, at = text_buffer(batch.column(column))
        row = 0
        while row < batch.num_rows:
            end = int(np.searchsorted(at, at[row] + limit, side="right")) - 1
            end = min(max(end, row + 1), batch.num_rows)
            yield batch.slice(row, end - row)
            row = end


def gathered(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Like slices(), and small batches are joined up to the limit."""
    held: list[pa.RecordBatch] = []
    size = 0
    for part in slices(batches, column, limit):
        _, at = text_buffer(part.column(column))
        if held and size + at[-1] > limit:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
        held.append(part)
        size += int(at[-1])
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and for each document the number of words before it."""
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    blank = _BLANK[data]
    solid = ~blank
    first = np.zeros(len(data) + 1, dtype=bool)
    first[at] = True
    start = solid.copy()
    start[1:] &= blank[:-1] | first[1:-1]
    end = solid.copy()
    end[:-1] &= blank[1:] | first[1:-1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, at)


def word_ids(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """For each word the index of its bytes among the distinct words, and the distinct words."""
    if len(starts) == 0:
        return np.zeros(0, np.int64), pa.array([], pa.binary())
    inside = ~_BLANK[data]
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    body = np.ascontiguousarray(data[inside])
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(body)])
    coded = words.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary


def word_prints(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of each word's bytes, the same on every executor."""
    from xxhash import xxh3_64_intdigest

    ids, distinct = word_ids(data, starts, ends)
    prints = np.fromiter(map(xxh3_64_intdigest, distinct.to_pylist()), np.uint64, len(distinct))
    return prints[ids]


@cache
def _random(kind: int) -> tuple[np.ndarray, int, int]:
    """256 random values, an odd base and its inverse modulo 2**64; the same everywhere."""
    draw = Random(kind)
    base = draw.getrandbits(64) | 1
    return np.array([draw.getrandbits(64) for _ in range(256)], np.uint64), base, pow(base, -1, 1 << 64)


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(kind: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base and of its inverse up to n."""
    have = _powers.get(kind)
    if have is None or len(have[0]) < n:
        _, base, inverse = _random(kind)
        size = max(n, 1 << 22)
        have = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, x, np.uint64)])) for x in (base, inverse))
        if size <= 1 << 23:
            _powers[kind] = have
    return have


def _ranges(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: int) -> np.ndarray:
    """Polynomial hashes modulo 2**64 of ranges of values, by prefix sums."""
    up, down = _power(kind, len(values) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[: len(values)])])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: int) -> np.ndarray:
    """A 64-bit hash of each word's bytes, the same on every executor; different kinds are independent."""
    return _ranges(_random(kind)[0][data], starts, ends, kind)


def poly_prints(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each range of words, from the words' hashes."""
    return _ranges(hashes, starts, ends, 3)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def ngram_prints(prints: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Fingerprints of the n-grams that start at each word, documents not regarded."""
    count = len(prints) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(count, seed ^ 0x9E3779B97F4A7C15, np.uint64)
    for j in range(n):
        h ^= prints[j : j + count]
        h *= np.uint64(0x9FB21C651E98DF25)
        h ^= h >> np.uint64(29)
    return mix(h)


def starts_inside(word_at: np.ndarray, n: int) -> np.ndarray:
    """The indexes of words at which an n-gram within one document starts."""
    counts = np.maximum(np.diff(word_at) - n + 1, 0)
    total = int(counts.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) + np.repeat(word_at[:-1] - (ends - counts), counts)

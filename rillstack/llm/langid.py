"""Operator 8: language by rank-order profiles.

A text is lowered, what is not a letter becomes one space, and its 1- to 3-grams are counted. A
language's profile is the order of its most frequent n-grams over all learnable documents; a
document's distance to it is the sum of how far each of its own most frequent n-grams is out of
place. Counting sends sums of one slice of texts, never single n-grams, through the shuffle;
profiles have a fixed size and travel with the task.

Defined results: `und` with score 0 for a null text, one without a letter, or where nothing could
be learned; ties go to the smaller language name; a null ``doc_id`` is learnable; every row gives
one row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillstack.llm.common import arrow_limits, documents, gathered

#: n-grams of a profile, and of a document.
PROFILE = 400
FOLDS = 5
_BITS = np.uint64(21)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


@cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)], dtype=bool)


def grams(text: str) -> np.ndarray:
    """The codes of all 1- to 3-grams of a text, sorted."""
    signs = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32)
    signs = np.where(_letters()[signs], signs, 0)
    keep = signs > 0
    keep[1:] |= signs[:-1] > 0
    keep[0] = True
    c = signs[keep].astype(np.uint64)
    if len(c) < 2:
        return np.zeros(0, np.uint64)
    two = c[:-1] << _BITS | c[1:]
    three = (two[:-1] << _BITS | c[2:])[c[1:-1] > 0]
    return np.sort(np.concatenate([c[c > 0], two, three]))


def counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array, and how often each stands there."""
    edges = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
    return codes[edges], np.diff(edges, append=len(codes))


def ranked(codes: np.ndarray, size: int) -> np.ndarray:
    values, counts = counted(codes)
    return values[np.argsort(-counts, kind="stable")[:size]]


def profiles(docs: DataFrame, size: int = PROFILE) -> dict[str, list[int]]:
    """The most frequent n-grams of each language, in order; docs has text and lang."""
    arrow_limits(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches):
            by_lang: dict[str, list[str]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                by_lang.setdefault(lang, []).append(text)
            for lang, texts in by_lang.items():
                values, counts = counted(grams(" ".join(texts)))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(values)), pa.array(values.astype(np.int64)), pa.array(counts)], ["lang", "gram", "n"])

    sums = docs.where("lang is not null and text is not null").select("text", "lang").mapInArrow(run, "lang string, gram long, n long")
    sums = sums.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = sums.withColumn("place", place).where(F.col("place") <= size)
    found: dict[str, list[int]] = {}
    for r in top.orderBy("lang", "place").collect():  # `size` rows for each language
        found.setdefault(r.lang, []).append(r.gram)
    return found


def predict(docs: DataFrame, known: dict[str, list[int]], size: int = PROFILE) -> DataFrame:
    arrow_limits(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = sorted(known)
        vocab = np.array(sorted({g for x in known.values() for g in x}), np.uint64)
        place = np.full((len(names), len(vocab) + 1), size, np.int64)  # the last column: in no profile
        out = np.ones_like(place, dtype=bool)
        for k, name in enumerate(names):
            at = np.searchsorted(vocab, np.array(known[name], np.uint64))
            place[k, at], out[k, at] = np.arange(len(at)), False
        for batch in gathered(batches):
            langs, scores = [], []
            for text in batch.column("text").to_pylist():
                mine = ranked(grams(text), size) if text and names else np.zeros(0, np.uint64)
                if not len(mine):
                    langs.append("und")
                    scores.append(0.0)
                    continue
                at = np.minimum(np.searchsorted(vocab, mine), len(vocab) - 1)
                at = np.where(vocab[at] == mine, at, len(vocab))
                far = np.where(out[:, at], size, np.abs(place[:, at] - np.arange(len(mine)))).sum(axis=1)
                best = int(np.argmin(far))
                langs.append(names[best])
                scores.append(float(1.0 - far[best] / (size * len(mine))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return predict(docs, profiles(docs.where(~held_out(F.col("doc_id")))))

"""Operator 7: quality rules by a hashed n-gram log-likelihood ratio, in DataFrame functions only.

Words and word pairs are hashed to a fixed number of buckets. One pass counts buckets over all
documents (the raw corpus) and over the trusted ones (the target); the two smoothed multinomials
give each bucket a log ratio. That table has a fixed size, so it goes into the plan as one array,
and a last pass averages the ratios over each document's n-grams. The threshold comes from trusted
documents whose n-grams the ratios that score them haven't seen. Bucket counts are shuffled after
partial aggregation; texts only where there are too many trusted ids for a broadcast.

Defined results: a null or empty text has no words, fails the base rules and scores 0; every row
gives one row; without trusted rows no document is rejected by its score; null ids in `trusted` are
not read, and a null ``doc_id`` is not trusted; columns other than ``doc_id`` and ``text`` are not
read.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstack.llm.common import BLANKS, documents, small

BUCKETS = 16384
ALPHA = 1.0
#: Where no threshold is given, it lies so many times as far below the median score of unseen
#: trusted documents as their lowest hundredth does.
LOWER = 1.5
#: Ids of trusted documents up to which they are broadcast (8 bytes each); beyond, the join shuffles.
BROADCAST_IDS = 8_000_000


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


def _grams(words: Column, buckets: int) -> Column:
    """The buckets of all words and word pairs."""
    one = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))
    two = F.transform(words, lambda w, i: F.pmod(F.xxhash64(w, F.get(words, i + 1)), F.lit(buckets)).cast("int"))
    return F.concat(one, F.slice(two, F.lit(1), F.greatest(F.size(two) - 1, F.lit(0))))


def bucket_counts(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> dict[int, tuple[int, int, int]]:
    """Of each bucket the n-grams of all documents, of the trusted ones, and of the first half of
    those (by hash of the id), all counted in one pass; docs has doc_id and text, trusted doc_id."""
    ids = trusted.select(F.col("doc_id").cast("long").alias("__id")).where("__id is not null").distinct()
    flags = small(ids.withColumn("half", _half(F.col("__id"))), BROADCAST_IDS)
    marked = docs.select("doc_id", "text").join(flags, docs.doc_id == F.col("__id"), "left").select(words_of(F.col("text")).alias("w"), "half")
    grams = marked.select("half", F.explode(_grams(F.col("w"), buckets)).alias("b"))
    sums = grams.groupBy("b").agg(F.count("*").alias("n"), F.count("half").alias("t"), F.sum(F.when(F.col("half") == 0, 1).otherwise(0)).alias("u"))
    return {r.b: (r.n, r.t, r.u) for r in sums.collect()}  # at most `buckets` rows


def _half(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(2))


def log_ratios(raw: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> list[float]:
    """The log ratio of each bucket between the two multinomials."""
    n_raw, n_target = sum(raw.values()), sum(target.values())
    if not n_target:
        return [0.0] * buckets
    # the target is smoothed towards the raw multinomial, so what it never saw by chance costs little
    prior = ALPHA * buckets
    out = []
    for b in range(buckets):
        p = (raw.get(b, 0) + ALPHA) / (n_raw + prior)
        q = (target.get(b, 0) + prior * p) / (n_target + prior)
        out.append(math.log(q / p))
    return out


def mean_ratio(words: Column, n_words: Column, table: Column, buckets: int) -> Column:
    total = F.aggregate(_grams(words, buckets), F.lit(0.0), lambda a, b: a + F.get(table, b))
    return total / F.greatest(2 * n_words - 1, F.lit(1))


def _table(ratios: list[float]) -> Column:
    return F.from_json(F.lit(json.dumps(ratios)), "array<double>")


def fitted_threshold(docs: DataFrame, trusted: DataFrame, ratios: list[float], buckets: int = BUCKETS) -> float:
    """A threshold from trusted documents that the ratios haven't seen: the second half of them is
    scored by ratios of the first, and the bound is LOWER times as far below the median as their
    lowest hundredth. Without trusted documents in a half no score rejects."""
    ids = trusted.select(F.col("doc_id").cast("long").alias("__id")).where("__id is not null").distinct()
    unseen = docs.join(small(ids.where(_half(F.col("__id")) == 1), BROADCAST_IDS), docs.doc_id == F.col("__id"), "left_semi")
    unseen = unseen.select(words_of(F.col("text")).alias("w")).where(F.size("w") >= 50).select(mean_ratio(F.col("w"), F.size("w"), _table(ratios), buckets).alias("s"))
    row = unseen.agg(F.percentile_approx("s", [0.01, 0.5], 10_000).alias("q")).first()
    if not any(ratios) or row.q is None:
        return -math.inf
    low, mid = row.q
    return mid - LOWER * (mid - low)


def base_rules(docs: DataFrame, *carried: str) -> DataFrame:
    """docs (doc_id, text) with the words and the figures of the base rules, and other columns."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = docs.select(
        *carried,
        F.col("doc_id").cast("long").alias("doc_id"),
        words_of(F.col("text")).alias("words"),
        F.length(F.regexp_replace(text, BLANKS, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, "[^#*$%&|<>]", "")).cast("long").alias("n_symbols"),
        lines.alias("lines"),
    )
    words = F.col("words")
    # a run of three words by its 64-bit hash: two of one document's runs are taken for equal by
    # mistake with a chance of 1 in 10 billion for 60,000 words
    threes = F.transform(
        F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0))),
        lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)),
    )
    counted = counted.select(
        *carried, "doc_id", "words", "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        threes.alias("threes"),
    )
    ordered = F.array_sort(F.transform("threes", lambda t, i: F.struct(t.alias("t"), i.alias("i"))))
    repeats = F.size("threes") > F.size(F.array_distinct("threes"))
    counted = counted.select(*carried, "doc_id", "words", "word_chars", "n_symbols", "n_dup_lines", F.when(repeats, ordered).alias("o"))
    o = F.col("o")
    again = F.filter(o, lambda x, j: x["t"].eqNullSafe(F.get(o, j - 1)["t"]) | x["t"].eqNullSafe(F.get(o, j + 1)["t"]))
    places = F.array_sort(F.transform(again, lambda x: x["i"]))
    counted = counted.select(*carried, "doc_id", "words", "word_chars", "n_symbols", "n_dup_lines", places.alias("at"))
    at = F.col("at")
    covered = F.aggregate(
        F.transform(at, lambda p, j: F.least(F.lit(3), F.coalesce(p - F.get(at, j - 1), F.lit(3)))),
        F.lit(0), lambda a, x: a + x,
    )
    return counted.select(
        *carried, "doc_id", "words", F.size("words").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines",
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def quality(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, threshold: float | None = None, *carried: str) -> DataFrame:
    """For each document the base figures, the score and the verdict, and other columns of docs."""
    docs = docs.select(*carried, F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = bucket_counts(docs, trusted, buckets)
    raw, target, first = ({b: c[k] for b, c in counts.items()} for k in range(3))
    if threshold is None:
        threshold = fitted_threshold(docs, trusted, log_ratios(raw, first, buckets), buckets)
    table = _table(log_ratios(raw, target, buckets))
    figures = base_rules(docs, *carried)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    scored = figures.withColumn("score", mean_ratio(F.col("words"), F.col("n_words"), table, buckets))
    return scored.select(
        *carried, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (F.col("score") >= threshold)).alias("kept"), "score",
    )


def kept_rows(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """docs without the rows that the rules reject, judged row by row."""
    judged = quality(docs.select(F.struct(*docs.columns).alias("__row"), "doc_id", "text"), trusted, BUCKETS, None, "__row")
    # a filter would be pushed down and repeat the rules' expressions; a generator stays where it is
    once = F.explode(F.when(F.col("kept"), F.array(F.lit(1))).otherwise(F.array().cast("array<int>")))
    return judged.select("__row", once.alias("__once")).select("__row.*")


def trusted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir), trusted_rows(spark, sf_dir))

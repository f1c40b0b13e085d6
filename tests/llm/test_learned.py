"""Operators 5, 7 and 8: what they learn, against plain Python and held-out rows; odd rows."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from rillstack.llm import langid, quality, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
D = "/root/testdata/sf0.01"
ODD = [(None, "du bist hier", "de"), (1, None, "en"), (2, "", "en"), (2, "", "en"), (3, "12 34 !?", None), (4, "x " * 3000, "en"), (5, "é" * 10, "fr")]


def test_isotonic_pools_equal_scores():
    for clean, toxic in ((99, 1), (50, 50)):
        raw, y = np.zeros(100), np.array([0.0] * clean + [1.0] * toxic)
        xs, ys = toxicity.isotonic(raw, y)
        assert abs(float(np.interp(0.0, xs, ys)) - toxic / 100) < 0.01
    xs, ys = toxicity.isotonic(np.array([0.0, 1.0, 2.0, 3.0]), np.array([0.0, 1.0, 0.0, 1.0]))
    assert (np.diff(ys) >= 0).all() and abs(ys[2] - 0.5) < 0.05


def test_toxicity(spark):
    docs, labels = spark.read.parquet(f"{D}/documents.parquet"), spark.read.parquet(f"{D}/labels.parquet")
    rows = {r.doc_id: r for r in toxicity.op5_toxicity(spark, D).collect()}
    assert len(rows) == docs.count() and all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for i, r in rows.items())
    for held in (False, True):
        mine = [(r.toxic, rows[r.doc_id].score) for r in labels.collect() if rows[r.doc_id].held_out == held]
        bad, good = [s for t, s in mine if t], [s for t, s in mine if not t]
        # the share of pairs of a toxic and a clean document in their right order
        assert sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / (len(bad) * len(good)) > 0.75
        assert sum(s >= 0.5 for s in good) <= 0.08 * len(good)


def test_toxicity_of_odd_rows_and_labels(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string, lang string").withColumn("score", F.lit(1))
    for marks in ([], [(1, 1), (None, 1), (4, None)], [(4, 0), (4, 1), (2, 0)]):
        lexicon, model = toxicity.fit(docs, spark.createDataFrame(marks, "doc_id long, toxic int"))
        got = toxicity.score(docs, lexicon, model).collect()
        assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(docs.where("doc_id > 99"), lexicon, model).count() == 0


def buckets_of(text, buckets):
    w = [x.encode() for x in WORD.findall(text or "")]
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    one = [signed(xxhash.xxh64_intdigest(x, 42)) % buckets for x in w]
    two = [signed(xxhash.xxh64_intdigest(y, xxhash.xxh64_intdigest(x, 42))) % buckets for x, y in zip(w, w[1:])]
    return one + two


def test_quality_score_against_plain_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    trusted = quality.trusted_rows(spark, "/root/testdata/sf0.001")
    texts, good = {r.doc_id: r.text for r in docs.collect()}, {r.doc_id for r in trusted.collect()}
    n = 512
    grams = {i: buckets_of(t, n) for i, t in texts.items()}
    raw, target = Counter(b for g in grams.values() for b in g), Counter(b for i in good for b in grams.get(i, ()))
    n_raw, n_target, prior = raw.total(), target.total(), quality.ALPHA * n
    p = [(raw[b] + quality.ALPHA) / (n_raw + prior) for b in range(n)]
    ratio = [math.log((target[b] + prior * p[b]) / (n_target + prior) / p[b]) for b in range(n)]
    for r in quality.quality(docs, trusted, n, -0.1).collect():
        score = sum(ratio[b] for b in grams[r.doc_id]) / max(len(grams[r.doc_id]), 1)
        assert abs(r.score - score) < 1e-9
        assert r.kept == (not r.base_failed and r.score >= -0.1) and r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)


def test_quality_keeps_clean_documents(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{D}/labels.parquet").collect()}
    kept = {0: [], 1: []}
    for r in quality.op7_quality(spark, D).select("doc_id", "base_failed", "kept").collect():
        if r.doc_id in labels and not r.base_failed:
            kept[labels[r.doc_id]].append(r.kept)
    assert np.mean(kept[1]) >= 0.99 and np.mean(kept[0]) <= 0.7


def test_kept_rows_go_one_by_one(spark):
    good = " ".join(f"word{k}" for k in range(80))
    rows = [(None, good, "a"), (None, "short", "b"), (7, good, "c"), (7, "short", "d"), (8, None, "e"), (9, "", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, words string")
    none = spark.createDataFrame([], "doc_id long")
    assert sorted(r.words for r in quality.kept_rows(docs, none).collect()) == ["a", "c"]
    assert quality.kept_rows(docs, none).columns == docs.columns and quality.kept_rows(docs.where("doc_id > 99"), none).count() == 0


def plain_grams(text):
    out, word = Counter(), ""
    for part in "".join(c if c.isalpha() else " " for c in text.lower()).split():
        word = f" {part} "
        for n in (1, 2, 3):
            out.update(g for g in (word[i : i + n] for i in range(len(word) - n + 1)) if g.strip())
    return out


def test_language_profiles_against_plain_python(spark):
    rows = [(0, "the cat and the hat", "en"), (1, "der Hund und die Katze", "de"), (3, "the end", "en"), (6, None, "fr"), (7, "und so", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = langid.profiles(docs, 1000)
    unit = lambda g: sum((0 if c == " " else ord(c)) << 21 * (len(g) - 1 - k) for k, c in enumerate(g))
    for lang in ("en", "de"):
        want = Counter()
        for _, text, x in rows:
            if x == lang:
                want += plain_grams(text)
        assert set(known[lang]) == {unit(g) for g in want} or {unit(g) for g in want} <= set(known[lang])
    assert set(known) == {"en", "de"}
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, known, 1000).collect()}
    assert got[0][0] == got[3][0] == "en" and got[1][0] == got[7][0] == "de" and got[6] == ("und", 0.0)


def test_languages_held_out(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "lang").collect()}
    rows = langid.op8_langid(spark, D).collect()
    assert len(rows) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)


def test_languages_of_odd_rows(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string, lang string").withColumn("lang_pred", F.lit("x"))
    known = langid.profiles(docs)
    got = [(r.doc_id, r.lang_pred, r.score) for r in langid.predict(docs, known).collect()]
    assert len(got) == len(ODD) and {p for i, p, _ in got if i in (1, 2, 3)} == {"und"}
    assert {p for _, p, _ in [(r.doc_id, r.lang_pred, 0) for r in langid.predict(docs, {}).collect()]} == {"und"}
    assert langid.predict(docs.where("doc_id > 99"), known).count() == 0


@pytest.mark.parametrize("n", [0, 1])
def test_lexicon_needs_both_classes(spark, n):
    labelled = spark.createDataFrame([("some words here", n)] * 5, "text string, toxic int")
    assert toxicity.learn_lexicon(labelled) == {}

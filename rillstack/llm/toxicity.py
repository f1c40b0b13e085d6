"""Operator 5: toxicity by gradient-boosted trees over dense features, calibrated isotonically.

The lexicon is learned: words (lowered, common sign-for-letter swaps undone) that stand in many
more toxic than clean labelled documents, counted over all labelled rows that aren't held out.
Features of a document are lexicon hits and densities, the densest stretch, hits near the second
person, capitals, punctuation and obfuscation rates. The trees are fitted on at most `max_rows`
labelled rows, whose ids are chosen by hash from the labels alone; scoring reads each text once and
shuffles nothing.

Defined results: a null text is empty and gets the score of a text without words; every row gives
one row; with labels of one class only (or none) the score is that share (0 without labels); a
document labelled more than once is toxic if any of its labels says so; labels with a null
``doc_id`` or a null mark are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstack.llm.common import arrow_limits, documents, gathered, put, text_buffer, word_ids, word_spans
from rillstack.llm.langid import held_out

#: The bound on labelled rows the trees are fitted on.
MAX_ROWS = 20_000
#: The bound on lexicon words that the driver holds, far above what the rules below let through.
MAX_LEXICON = 20_000
#: A lexicon word stands in so many toxic documents at least, its log odds are this high, and its
#: log-likelihood ratio is significant at one in 1,000.
MIN_TOXIC, MIN_ODDS, MIN_G2 = 3, 1.5, 10.8
#: Text bytes that are looked at together: a word of them takes some 200 bytes of figures.
SLICE = 2 << 20
#: Second-person words by language; signs that stand for letters.
SECOND = {"you", "your", "yours", "yourself", "u", "ur", "tu", "te", "toi", "vous", "votre", "du", "dich", "dir", "dein", "ihr", "euch", "tú", "ti", "usted", "ustedes"}
SWAPS = str.maketrans({"0": "o", "1": "i", "!": "i", "3": "e", "4": "a", "@": "a", "5": "s", "$": "s", "7": "t"})
EDGES = ".,;:!?\"'()[]{}*_-«»¿¡…"
NAMES = ["n_hits", "hit_rate", "strong", "densest", "near_second", "second_rate", "capital_rate", "punct_rate", "exclaim_rate", "obfuscated_rate", "hit_obfuscated", "log_words"]


def plain(word: str) -> str:
    """A word as the lexicon has it."""
    bare = word.strip(EDGES).lower()
    if any(c.isalpha() for c in bare) and not bare.isalpha():
        bare = "".join(c for c in bare.translate(SWAPS) if c.isalpha())
    return bare


def features(texts: pa.Array, lexicon: dict[str, float]) -> np.ndarray:
    data, at = text_buffer(texts)
    starts, ends, word_at = word_spans(data, at)
    ids, distinct = word_ids(data, starts, ends)
    weight, second, odd, upper = (np.zeros(len(distinct) + 1) for _ in range(4))
    for k, raw in enumerate(distinct.to_pylist()):
        word = raw.decode("utf-8", "replace")
        bare = plain(word)
        weight[k] = lexicon.get(bare, 0.0)
        second[k] = bare in SECOND
        inner = word.strip(EDGES)
        odd[k] = any(c.isalpha() for c in inner) and any(not c.isalpha() and c not in "-'’" for c in inner)
        upper[k] = len(inner) > 1 and inner.isupper()
    n = np.diff(word_at)
    safe = np.maximum(n, 1)

    def totals(x: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(x)])
        return sums[word_at[1:]] - sums[word_at[:-1]]

    w = weight[ids]
    hit = (w > 0).astype(float)
    sec, sums = second[ids], np.concatenate([[0.0], np.cumsum(hit)])
    lo = np.repeat(word_at[:-1], n)
    hi = np.repeat(word_at[1:], n)
    place = np.arange(len(ids))
    near = sums[np.minimum(place + 6, hi)] - sums[np.maximum(place - 5, lo)] if len(ids) else np.zeros(0)
    wide = sums[np.minimum(place + 50, hi)] - sums[place] if len(ids) else np.zeros(0)
    densest, strong = np.zeros(len(n)), np.zeros(len(n))
    doc = np.repeat(np.arange(len(n)), n)
    np.maximum.at(densest, doc, wide)
    np.maximum.at(strong, doc, w)
    size = np.maximum(np.diff(at), 1)

    def bytes_in(chars: bytes) -> np.ndarray:
        table = np.zeros(256)
        table[list(chars)] = 1
        c = np.concatenate([[0.0], np.cumsum(table[data])])
        return c[at[1:]] - c[at[:-1]]

    hits = totals(hit)
    return np.column_stack([
        hits, hits / safe, strong, densest, totals(sec * (near > 0)), totals(sec) / safe, totals(upper[ids]) / safe,
        bytes_in(b".,;:!?*#$%&") / size, bytes_in(b"!") / size, totals(odd[ids]) / safe, totals(hit * odd[ids]), np.log1p(n),
    ])


@dataclass
class Trees:
    """Boosted trees of logistic loss over binned features, and the calibration of their sums."""

    start: float = 0.0
    trees: list[list[tuple]] = field(default_factory=list)
    xs: np.ndarray = field(default_factory=lambda: np.zeros(0))
    ys: np.ndarray = field(default_factory=lambda: np.zeros(0))
    constant: float | None = None

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for nodes in self.trees:
            at = np.zeros(len(x), np.int64)
            feature = np.array([n[0] for n in nodes])
            cut, left, right, value = (np.array([n[k] for n in nodes]) for k in (1, 2, 3, 4))
            for _ in range(8):
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                goes = x[np.arange(len(x)), np.maximum(f, 0)] <= cut[at]
                at = np.where(inner, np.where(goes, left[at], right[at]), at).astype(np.int64)
            out += value[at]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return np.clip(np.interp(self.raw(x), self.xs, self.ys), 0.0, 1.0)


def grow(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.15, least: int = 5) -> Trees:
    share = min(max(y.mean(), 1e-4), 1 - 1e-4)
    model = Trees(start=float(np.log(share / (1 - share))))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 33)[:-1])) for j in range(x.shape[1])]
    bins = np.column_stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(cuts)])
    total = np.full(len(x), model.start)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        nodes: list[tuple] = [()]
        todo = [(0, np.arange(len(x)), 0)]
        while todo:
            k, rows, level = todo.pop()
            sg, sh = g[rows].sum(), h[rows].sum()
            best = (1e-3, -1, 0)
            if level < depth and len(rows) >= 2 * least:
                for j, c in enumerate(cuts):
                    b = bins[rows, j]
                    cg, ch = np.bincount(b, g[rows], len(c) + 1).cumsum()[:-1], np.bincount(b, h[rows], len(c) + 1).cumsum()[:-1]
                    cn = np.bincount(b, minlength=len(c) + 1).cumsum()[:-1]
                    gain = cg**2 / (ch + 1) + (sg - cg) ** 2 / (sh - ch + 1) - sg**2 / (sh + 1)
                    gain[(cn < least) | (len(rows) - cn < least)] = -1
                    i = int(np.argmax(gain))
                    if gain[i] > best[0]:
                        best = (float(gain[i]), j, i)
            if best[1] < 0:
                nodes[k] = (-1, 0.0, 0, 0, rate * sg / (sh + 1))
                total[rows] += rate * sg / (sh + 1)
                continue
            _, j, i = best
            inside = bins[rows, j] <= i
            nodes[k] = (j, float(cuts[j][i]), len(nodes), len(nodes) + 1, 0.0)
            todo += [(len(nodes), rows[inside], level + 1), (len(nodes) + 1, rows[~inside], level + 1)]
            nodes += [(), ()]
        model.trees.append(nodes)
    return model


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The non-decreasing step values nearest to y: rows of equal raw score are one block from the
    start, then adjacent violators are pooled."""
    values, which = np.unique(raw, return_inverse=True)
    sizes = np.bincount(which).astype(float)
    means = np.bincount(which, y) / sizes
    blocks: list[list[float]] = []
    for r, v, n in zip(values, means, sizes, strict=True):
        blocks.append([v, n, r, r])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, n2, _, hi = blocks.pop()
            v1, n1, lo, _ = blocks[-1]
            blocks[-1] = [(v1 * n1 + v2 * n2) / (n1 + n2), n1 + n2, lo, hi]
    xs = np.array([z for b in blocks for z in (b[2], b[3])])
    ys = np.array([(b[0] * b[1] + 0.02) / (b[1] + 0.04) for b in blocks for _ in (0, 1)])
    return xs, np.maximum.accumulate(ys)


def learn_lexicon(labelled: DataFrame) -> dict[str, float]:
    """Words of labelled rows (text, toxic) and their log odds; one row of counts per word and slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, limit=SLICE):
            data, at = text_buffer(batch.column("text"))
            starts, ends, word_at = word_spans(data, at)
            ids, distinct = word_ids(data, starts, ends)
            names: dict[str, int] = {"": 0}
            as_plain = np.array([names.setdefault(plain(raw.decode("utf-8", "replace")), len(names)) for raw in distinct.to_pylist()] or [0], np.int64)
            doc = np.repeat(np.arange(batch.num_rows), np.diff(word_at))
            pairs = np.unique(doc * len(names) + as_plain[ids]) if len(ids) else np.zeros(0, np.int64)
            words, toxic = pairs % len(names), batch.column("toxic").to_numpy()[pairs // len(names)].astype(bool)
            clean, bad = np.bincount(words[~toxic], minlength=len(names)), np.bincount(words[toxic], minlength=len(names))
            seen = np.flatnonzero(clean + bad)
            seen = seen[seen > 0]
            yield pa.RecordBatch.from_arrays([pa.array(list(names), pa.string()).take(pa.array(seen)), pa.array(clean[seen], pa.int64()), pa.array(bad[seen], pa.int64())], ["word", "clean", "bad"])
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([int((~batch.column("toxic").to_numpy().astype(bool)).sum())], pa.int64()), pa.array([int(batch.column("toxic").to_numpy().sum())], pa.int64())], ["word", "clean", "bad"])

    sums = put(labelled.mapInArrow(run, "word string, clean long, bad long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("bad").alias("bad")).where("bad >= 3 or word is null"), "lexicon-counts")
    total = sums.where("word is null").first()  # the null word has the numbers of rows
    n_bad, n_clean = (total.bad, total.clean) if total else (0, 0)
    if not n_bad or not n_clean:
        return {}
    bad, clean, n = F.col("bad").cast("double"), F.col("clean").cast("double"), float(n_bad + n_clean)

    def part(seen: Column, share: float) -> Column:
        return F.when(seen > 0, seen * F.log(seen / ((bad + clean) * share / n))).otherwise(0.0)

    odds = F.log(((bad + 0.5) / (n_bad + 1.0)) / ((clean + 0.5) / (n_clean + 1.0)))
    top = sums.where(F.col("word").isNotNull() & (bad >= MIN_TOXIC)).select("word", odds.alias("odds"), (2 * (part(bad, n_bad) + part(clean, n_clean))).alias("g2"))
    top = top.where((F.col("odds") > MIN_ODDS) & (F.col("g2") >= MIN_G2)).orderBy(F.desc("g2"), "word").limit(MAX_LEXICON)
    return {r.word: r.odds for r in top.collect()}


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> tuple[dict[str, float], Trees]:
    """The lexicon and the trees, from labelled rows of docs that are not held out."""
    arrow_limits(docs.sparkSession)
    marks = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    marks = marks.where(~held_out(F.col("doc_id")))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    lexicon = learn_lexicon(texts.where(~held_out(F.col("doc_id"))).join(marks.hint("merge"), "doc_id").select("text", "toxic"))  # one plan at any size
    chosen = F.broadcast(marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))  # max_rows rows of 12 bytes
    rows = texts.join(chosen, "doc_id").select("text", "toxic")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, limit=SLICE):
            x = features(batch.column("text"), lexicon)
            yield pa.RecordBatch.from_arrays([*(pa.array(x[:, j]) for j in range(x.shape[1])), batch.column("toxic")], [*NAMES, "toxic"])

    found = rows.mapInArrow(run, ", ".join(f"{x} double" for x in NAMES) + ", toxic int").toPandas()  # the figures of the chosen documents
    found = found.sort_values(list(found.columns)).to_numpy(dtype=float)
    x, y = found[:, :-1], found[:, -1]
    if len(y) == 0 or y.min() == y.max():
        return lexicon, Trees(constant=float(y[0]) if len(y) else 0.0)
    raw, fold = np.zeros(len(y)), np.arange(len(y)) % 4
    for k in range(4):
        raw[fold == k] = grow(x[fold != k], y[fold != k]).raw(x[fold == k])
    model = grow(x, y)
    model.xs, model.ys = isotonic(raw, y)
    return lexicon, model


def score(docs: DataFrame, lexicon: dict[str, float], model: Trees) -> DataFrame:
    arrow_limits(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, limit=SLICE):
            s = model.score(features(batch.column("text"), lexicon))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    lexicon, model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, lexicon, model)

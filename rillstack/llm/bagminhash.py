"""Operator 9: near duplicates by BagMinHash.

A document is the multiset of its five-word shingles, a shingle's weight its whole count. The levels
of a weight are cut into dyadic blocks (1, 1, 2, 4, 8, ... levels), so a weight has about log2 of
them; each block of each shingle is a Poisson process that is split in halves down to single levels.
A point is drawn for a whole block at the block's rate, and only where a weight covers a part of the
block is the process split: the point goes to one half by a bit of its own, and the other half starts
a process of its own after it. All points are functions of the shingle and the part of the block, so
documents share them. Points fall on random slots, and a slot keeps its earliest point: two documents
agree in a slot with the probability of their weighted Jaccard similarity. A process ends as soon as its next point comes after the latest slot's. Slots are
banded; members of a bucket are judged against its hub (``star.py``) by the exact multiset overlap.
Members of buckets that this leaves in several groups meet again by the rarest of their shingles
(``prefix_pairs``), which finds all links between the groups and tries few pairs that aren't linked.

Every row is signed where it is read; equal texts are one class from then on, so only signatures,
digests and ids are shuffled, and texts of class representatives (smallest ``doc_id``) where a pair
is to be verified. Defined results: null and empty texts have no shingles and link to nothing, but
equal texts share a class (null and empty are equal); a text of one to four words is one shingle; a
null ``doc_id`` comes after all others, and a class or group without any other has a null id; every
row gives one row, repeated or not; columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstack.llm import star
from rillstack.llm.common import LAST, arrow_limits, documents, drop, gathered, mix, ngram_prints, put, small, starts_inside, text_buffer, word_prints, word_spans

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 4
#: Pairs of a hub and a member whose signatures agree in a share of slots this much below the similarity
#: sought aren't verified; those of them that are linked are found after the hubs.
SLACK = 0.2
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_NODE = np.uint64(0xD1B54A32D192ED03)


def shingles(prints: np.ndarray, word_at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Document and fingerprint of every shingle."""
    p = starts_inside(word_at, size)
    d = np.searchsorted(word_at, p, side="right") - 1
    codes = ngram_prints(prints, size)[p]
    n = np.diff(word_at)
    short = np.flatnonzero((n > 0) & (n < size))
    own = [ngram_prints(prints[word_at[k] : word_at[k + 1]], int(n[k]), int(n[k]))[0] for k in short]
    return np.concatenate([d, short]), np.concatenate([codes, np.array(own, np.uint64)])


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def _drawn(state: np.ndarray, at: np.ndarray, size: np.ndarray, when: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first point after `when` of the part of a block at level `at` with `size` levels, and its
    time; state is the point before."""
    new = mix(state + _NODE * (at << np.uint64(32) | size))
    return new, when - np.log(_uniform(new)) / size


def signatures(docs: np.ndarray, codes: np.ndarray, n_docs: int, slots: int) -> np.ndarray:
    """For each document and slot the mark of its earliest point (0 where it has none)."""
    order = np.lexsort((codes, docs))
    docs, codes = docs[order], codes[order]
    first = np.concatenate([[True], (docs[1:] != docs[:-1]) | (codes[1:] != codes[:-1])]) if len(docs) else np.zeros(0, bool)
    begin = np.flatnonzero(first)
    weight = np.diff(begin, append=len(docs))
    docs, codes = docs[begin], codes[begin]
    blocks = np.ceil(np.log2(weight)).astype(np.int64) + 1
    block = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    docs, codes, weight = (np.repeat(x, blocks) for x in (docs, codes, weight))
    size = np.left_shift(1, np.maximum(block - 1, 0)).astype(np.uint64)
    at = np.where(block > 0, size, 0).astype(np.uint64)
    covered = np.minimum(weight.astype(np.uint64) - at, size)
    state, when = _drawn(codes, at, size, np.zeros(len(docs)))
    best = np.full(n_docs * slots, np.inf)
    mark = np.zeros(n_docs * slots, np.uint64)

    def fall(docs: np.ndarray, state: np.ndarray, when: np.ndarray) -> None:
        cell = docs * slots + ((mix(state ^ _GOLD) >> np.uint64(32)) * np.uint64(slots) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(best, cell, when)
        hit = best[cell] == when
        mark[cell[hit]] = state[hit]

    def in_time(parts: list[np.ndarray]) -> list[np.ndarray]:
        alive = parts[2] < best.reshape(n_docs, slots).max(axis=1)[parts[0]]
        return [x[alive] for x in parts]

    one = size == 1
    single = [x[one] for x in (docs, state, when)]
    live = [x[~one] for x in (docs, state, when, at, size, covered)]
    while len(single[0]) or len(live[0]):
        docs, state, when = single
        fall(docs, state, when)
        state = mix(state + _GOLD)
        single = in_time([docs, state, when - np.log(_uniform(state))])
        if not len(live[0]):
            continue
        parts, lone = [], [single]
        # where a weight covers a part of a process: its point belongs to one half
        whole = live[5] == live[4]
        docs, state, when, at, size, covered = (x[~whole] for x in live)
        half = size >> np.uint64(1)
        right = (state & half) > 0
        for side in (False, True):
            own, place = right == side, at + half if side else at
            share = np.where(covered > half, covered - half, 0) if side else np.minimum(covered, half)
            other, later = _drawn(state, place, half, when)
            has = share > 0
            parts.append([x[has] for x in (docs, np.where(own, state, other), np.where(own, when, later), place, half, share.astype(np.uint64))])
        # elsewhere it falls, and each half without it goes on by itself, down to the level that it is of
        docs, state, when, at, size, _ = (x[whole] for x in live)
        fall(docs, state, when)
        while len(docs):
            half = size >> np.uint64(1)
            right = (state & half) > 0
            place = np.where(right, at, at + half)
            new, later = _drawn(state, place, half, when)
            parts.append([docs, new, later, place, half, half])
            at, size = np.where(right, at + half, at), half
            last = size == 1
            new = mix(state[last] + _GOLD)
            lone.append([docs[last], new, when[last] - np.log(_uniform(new))])
            docs, state, when, at, size = (x[~last] for x in (docs, state, when, at, size))
        live = [np.concatenate(x) for x in zip(*parts, strict=True)]
        one = live[4] == 1
        lone.append([x[one] for x in live[:3]])
        live = in_time([x[~one] for x in live])
        single = in_time([np.concatenate(x) for x in zip(*lone, strict=True)])
    return mark.reshape(n_docs, slots)


def signed(rows: DataFrame, shingle: int = SHINGLE, bands: int = BANDS, width: int = ROWS) -> DataFrame:
    """rows (id, text, ...) to their other columns, n (the number of shingles), sig and bands (both empty
    without a shingle)."""
    rest = [f for f in rows.schema.fields if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, limit=4 << 20):
            data, at = text_buffer(batch.column("text"))
            starts, ends, word_at = word_spans(data, at)
            docs, codes = shingles(word_prints(data, starts, ends), word_at, shingle)
            sig = signatures(docs, codes, batch.num_rows, bands * width)
            keep = np.diff(word_at) > 0
            sig = sig[keep]
            keys = np.zeros((len(sig), bands), np.uint64)
            for b in range(bands):
                h = np.full(len(sig), b + 1, np.uint64)
                for r in range(width):
                    h = mix(h * _GOLD ^ sig[:, b * width + r])
                keys[:, b] = h
            small = (sig & np.uint64(0x7FFFFFFF)).astype(np.int32)

            def lists(x: np.ndarray, kind: pa.DataType, keep: np.ndarray = keep) -> pa.Array:
                ends = np.concatenate([[0], np.cumsum(keep * x.shape[1])]).astype(np.int32)
                return pa.ListArray.from_arrays(pa.array(ends), pa.array(x.ravel(), kind))

            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in rest), pa.array(np.bincount(docs, minlength=batch.num_rows), pa.int64()), lists(small, pa.int32()), lists(keys.view(np.int64), pa.int64())], [*(f.name for f in rest), "n", "sig", "bands"])

    schema = rows.drop("text").withColumns({"n": F.lit(None).cast("long"), "sig": F.lit(None).cast("array<int>"), "bands": F.lit(None).cast("array<long>")}).schema
    return rows.select(*(f.name for f in rest), "text").mapInArrow(run, schema)


def overlaps(pairs: DataFrame, shingle: int, least: float) -> DataFrame:
    """(a, b, s): of (a, b, ta, tb) the pairs whose multisets of shingles overlap by s >= `least`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def bags(texts: pa.Array) -> list[np.ndarray]:
            data, at = text_buffer(texts)
            starts, ends, word_at = word_spans(data, at)
            docs, codes = shingles(word_prints(data, starts, ends), word_at, shingle)
            order = np.lexsort((codes, docs))
            docs, codes = docs[order], codes[order]
            return np.split(codes, np.searchsorted(docs, np.arange(1, len(texts))))

        for big in gathered(batches, "ta", 4 << 20):
            for k in range(0, big.num_rows, 500):
                batch = big.slice(k, 500)
                shares = []
                for x, y in zip(bags(batch.column("ta")), bags(batch.column("tb")), strict=True):
                    # the level of each unit makes a multiset a set
                    ux, uy = (np.unique(mix(v + _GOLD * (np.arange(len(v)) - np.searchsorted(v, v)).astype(np.uint64))) for v in (x, y))
                    both = len(np.intersect1d(ux, uy, assume_unique=True))
                    either = len(ux) + len(uy) - both
                    shares.append(both / either if both else -1.0)
                keep = pa.array([x >= least for x in shares], pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep), pa.array(shares, pa.float64()).filter(keep)], ["a", "b", "s"])

    return pairs.mapInArrow(run, "a long, b long, s double")


def bags(rows: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """rows (id, root, text) to (id, root, n, units): a unit is a shingle and which of its occurrences it is, so
    that the overlap of multisets is that of the units."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, limit=4 << 20):
            data, at = text_buffer(batch.column("text"))
            starts, ends, word_at = word_spans(data, at)
            docs, codes = shingles(word_prints(data, starts, ends), word_at, shingle)
            order = np.lexsort((codes, docs))
            docs, codes = docs[order], codes[order]
            place = np.arange(len(codes))
            first = np.ones(len(codes), bool)
            first[1:] = (docs[1:] != docs[:-1]) | (codes[1:] != codes[:-1])
            again = place - np.maximum.accumulate(np.where(first, place, 0))
            units = mix(codes + _GOLD * again.astype(np.uint64)).view(np.int64)
            n = np.bincount(docs, minlength=batch.num_rows)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(units))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("root"), pa.array(n.astype(np.int64)), lists], ["id", "root", "n", "units"])

    return rows.select("id", "root", "text").mapInArrow(run, "id long, root long, n long, units array<long>")


def prefix_pairs(held: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of a table of bags(): all pairs of different roots at the similarity or more, and few others.

    Each bag has its units in one order, those in the fewest bags first. Two bags that are alike share one
    of the first units that a bag can't miss and still overlap enough; from the units before a shared
    one and the number shared so far follows the most that the two can have in common.
    """
    one = held.select("id", F.explode("units").alias("u"))
    often = put(one.groupBy("u").agg(F.count("*").alias("f")).where("f > 1"), "shared-units")
    ranked = one.join(small(often), "u").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("f", "u"))).alias("s"))  # one text's units
    share = 2 * similarity / (1 + similarity)
    lone = F.col("n") - F.size("s")  # units that no other bag has come first
    most = F.col("n") - F.ceil(similarity * F.col("n") - 1e-9) + 1
    first = ranked.join(held.select("id", "root", "n"), "id").where(most > lone)
    first = first.select("id", "root", "n", lone.alias("lone"), F.posexplode(F.slice("s", F.lit(1), (most - lone).cast("int"))).alias("p", "s"))
    first = put(first.select(F.col("s.u").alias("u"), "id", "root", "n", (F.col("lone") + F.col("p")).alias("p")), "first-units")
    a, b = (first.select("u", *(F.col(c).alias(f"{c}_{x}") for c in ("id", "root", "n", "p"))) for x in ("a", "b"))
    # the smaller one of a pair needs fewer of its units
    a = a.where(F.col("p_a") <= F.col("n_a") - F.ceil(share * F.col("n_a") - 1e-9))
    order = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("id_a") < F.col("id_b")))
    after = F.least(F.col("n_a") - F.col("p_a"), F.col("n_b") - F.col("p_b")) - 1
    need = F.ceil(share / 2 * (F.col("n_a") + F.col("n_b")) - 1e-9)
    met = a.join(b, "u").where((F.col("root_a") != F.col("root_b")) & order & (F.col("n_a") >= similarity * F.col("n_b") - 1e-9) & (after + 1 >= need))
    met = met.groupBy("id_a", "id_b").agg(F.count("*").alias("c"), F.min(after).alias("after"), F.first(need).alias("need"))
    return met.where(F.col("c") + F.col("after") >= F.col("need")).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))


def bag_links(held: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of a table of bags(): all pairs of different roots at the similarity or more."""
    pairs = put(prefix_pairs(held, similarity), "unsettled-pairs")
    a, b = (held.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("units").alias(f"units_{x}")) for x in ("a", "b"))
    both = F.size(F.array_intersect("units_a", "units_b"))
    sized = pairs.join(a, "a").join(b, "b").select("a", "b", both.alias("both"), (F.col("n_a") + F.col("n_b")).alias("n"))
    return put(sized.where(F.col("both") / (F.col("n") - F.col("both")) >= similarity).select("a", "b"), "unsettled-links")


def text_groups(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """rows (doc_id, tid) of all documents, and classes (tid, ord, root, rows): tid stands for a text,
    ord is its smallest doc_id (nulls last), rows how many rows have both, root the group."""
    arrow_limits(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.select("doc_id", F.xxhash64("text", F.sha2("text", 256)).alias("tid"), "text")
    signs = put(signed(texts, shingle), "signatures")
    rows = signs.select("doc_id", "tid")
    place = F.coalesce("doc_id", F.lit(LAST))
    firsts = rows.groupBy("tid", place.alias("ord")).agg(F.count("*").alias("rows"))
    firsts = put(firsts.groupBy("tid").agg(F.min("ord").alias("ord"), F.min_by("rows", "ord").alias("rows")), "classes")
    one = put(signs.dropDuplicates(["tid"]).select("tid", "n", "sig", "bands"), "class-signatures")
    sig = one.select("tid", "n", "sig")

    def read(ids: DataFrame) -> DataFrame:
        """ids (tid, ...) with the texts, as a table."""
        placed = put(ids.join(firsts.select("tid", "ord"), "tid"), "near-ids")
        out = put(texts.withColumn("ord", place).join(small(placed), ["tid", "ord"]).dropDuplicates(["tid"]).select(*ids.columns, "text"), "near-texts")
        drop(placed)
        return out

    def judge(pairs: DataFrame) -> DataFrame:
        near = pairs.join(sig.select(F.col("tid").alias("a"), F.col("sig").alias("sa"), F.col("n").alias("na")), "a").join(sig.select(F.col("tid").alias("b"), F.col("sig").alias("sb"), F.col("n").alias("nb")), "b")
        agree = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
        # an overlap is no more than the ratio of the sizes
        near = near.where(F.least("na", "nb") >= similarity * F.greatest("na", "nb")).select("a", "b", (agree / (BANDS * ROWS)).alias("e"))
        near = put(near.where(F.col("e") >= similarity - SLACK).select("a", "b"), "near-pairs")
        some = read(near.select(F.explode(F.array("a", "b")).alias("tid")).distinct())
        full = near.join(some.select(F.col("tid").alias("a"), F.col("text").alias("ta")), "a").join(some.select(F.col("tid").alias("b"), F.col("text").alias("tb")), "b")
        out = put(overlaps(full, shingle, similarity), "overlaps")
        for table in (near, some):
            drop(table)
        return out

    def rest(ids: DataFrame) -> DataFrame:
        some = read(ids.withColumnRenamed("id", "tid"))
        held = put(bags(some.withColumnRenamed("tid", "id"), shingle), "unsettled-bags")
        drop(some)
        return bag_links(held, similarity)

    entries = star.shared_entries(one.select(F.explode("bands").alias("key"), F.col("tid").alias("id")))
    groups = star.links(entries, judge, rest)
    classes = firsts.join(groups.withColumnRenamed("node", "tid"), "tid", "left").withColumn("root", F.coalesce("root", "tid"))
    return rows, put(classes, "classes")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id, group_id): the smallest doc_id with the same text, and the smallest of the
    connected group of linked texts."""
    rows, classes = text_groups(docs, shingle, similarity)
    heads = put(classes.groupBy("root").agg(F.min("ord").alias("head")), "group-heads")
    named = put(classes.join(heads, "root").select("tid", *(F.nullif(c, F.lit(LAST)).alias(n) for c, n in (("ord", "class_id"), ("head", "group_id")))), "named-classes")
    return rows.join(named, "tid").select("doc_id", "class_id", "group_id")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """docs without all but one row of each group: the one with the smallest (doc_id, text hash),
    nulls last; of rows equal in both any one."""
    _, classes = text_groups(docs, shingle, similarity)
    best = F.struct("ord", "tid", "rows")
    heads = classes.groupBy("root").agg(F.min(best).alias("h")).select(F.col("h.ord").alias("__ord"), F.col("h.tid").alias("__tid"), F.col("h.rows").alias("__rows"))
    heads = put(heads, "group-heads")
    text = F.coalesce("text", F.lit(""))
    keyed = docs.withColumn("__ord", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))).withColumn("__tid", F.xxhash64(text, F.sha2(text, 256)))
    kept = keyed.join(heads, ["__ord", "__tid"])
    again = kept.where("__rows > 1").dropDuplicates(["__ord", "__tid"])
    return kept.where("__rows = 1").union(again).select(*docs.columns)


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))

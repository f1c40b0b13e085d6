"""Operator 4: removal of repeated word windows, found by recompression.

Each round names maximal runs of equal symbols, then pairs of a left-class and a right-class symbol.
Names are fingerprints of what they stand for, so equal word runs get equal interior symbols on every
executor. With each symbol goes the range of words that fixes it. After the rounds each window is
given the symbol with the smallest hash among those that it fixes (or, if it fixes none, a symbol of
its own), named together with all the words that fix it: equal windows are given equal symbols at equal places. Spark then rounds up the symbols that
documents share, and in a second round the tiles: a tile is the run of words whose windows were all
given one occurrence of a shared symbol. A tile that a smaller document has too goes as a whole; only
where one symbol stands in different tiles are their windows compared one by one, once for each
different tile. Windows are told apart by two independent 64-bit hashes: that of the symbol, and one of
the words by other random values.

Defined results: a null or empty text has no words; a null ``doc_id`` comes after all others; rows
with the same ``doc_id`` never remove each other's words; texts shorter than a window stay whole;
columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstack.llm.common import LAST, arrow_limits, documents, drop, gathered, mix, poly_prints, put, starts_inside, text_buffer, word_hashes, word_spans

WINDOW = 13
ROUNDS = 2
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
SLICE = 4 << 20


def recompress(prints: np.ndarray, word_at: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols after some rounds, and for each the range of words [low, high) that fixes it. The
    range of a symbol that a text's edge fixes reaches over that edge."""
    counts = np.diff(word_at)
    doc = np.repeat(np.arange(len(counts)), counts)
    sym, low = prints, np.arange(len(prints))
    high = low + 1
    for r in range(rounds):
        if not len(sym):
            break
        # runs
        first = np.concatenate([[True], (sym[1:] != sym[:-1]) | (doc[1:] != doc[:-1])])
        a = np.flatnonzero(first)
        z = np.append(a[1:], len(sym)) - 1
        d = doc[a]
        inner_l = (a > 0) & (doc[a - 1] == d)
        inner_r = (z + 1 < len(sym)) & (doc[np.minimum(z + 1, len(sym) - 1)] == d)
        new_low = np.where(inner_l, low[a - 1], word_at[d] - 1)
        new_high = np.where(inner_r, high[np.minimum(z + 1, len(sym) - 1)], word_at[d + 1] + 1)
        sym, low, high, doc = mix(sym[a] + _A * (z - a + 1).astype(np.uint64)), new_low, new_high, d
        # pairs
        n = len(sym)
        right = (mix(sym ^ np.uint64(int(_B) * (r + 1) % (1 << 64))) & np.uint64(1)).astype(bool)
        same = np.zeros(n, dtype=bool)
        same[:-1] = doc[:-1] == doc[1:]
        joins = np.zeros(n, dtype=bool)  # with the next
        joins[:-1] = same[:-1] & ~right[:-1] & right[1:]
        joined = np.concatenate([[False], joins[:-1]])  # with the one before
        before = np.concatenate([[False], same[:-1]])
        nxt, prv = np.minimum(np.arange(n) + 1, n - 1), np.maximum(np.arange(n) - 1, 0)
        left_dep = np.where(right & ~joined, np.where(before, np.minimum(low[prv], low), word_at[doc] - 1), low)
        right_dep = np.where(~right & ~joins, np.where(same, np.maximum(high[nxt], high), word_at[doc + 1] + 1), high)
        keep = ~joined
        sym2 = np.where(joins, mix(sym * _A ^ mix(sym[nxt] + _B)), sym)
        high2 = np.where(joins, high[nxt], right_dep)
        sym, low, high, doc = sym2[keep], left_dep[keep], high2[keep], doc[keep]
    return sym, low, high


def _given(batch: pa.RecordBatch, window: int):
    """Of all windows of a batch: the index of the word they start at, the symbol they are given, and
    which occurrence of it; also the words before each document and hashes of the words' second kind."""
    data, at = text_buffer(batch.column("text"))
    starts, ends, word_at = word_spans(data, at)
    one, two = (word_hashes(data, starts, ends, k) for k in (1, 2))
    sym, low, high = recompress(one, word_at)
    doc = np.searchsorted(word_at, np.clip(low, 0, None), side="right") - 1
    fit = (high - low <= window) & (low >= word_at[np.minimum(doc, len(word_at) - 1)]) & (high <= word_at[np.minimum(doc + 1, len(word_at) - 1)])
    low, high = low[fit], high[fit]
    sym = mix(poly_prints(one, low, high) ^ sym[fit])  # with all words that fix it
    p = starts_inside(word_at, window)
    first, end = np.searchsorted(low, p), np.searchsorted(high, p + window, side="right")
    rank = np.append(mix(sym ^ _B), ~np.uint64(0))
    best, place = np.full(len(p), ~np.uint64(0)), np.full(len(p), -1, np.int64)
    for k in range(int((end - first).max(initial=0))):
        here = first + k
        r = rank[np.minimum(here, len(sym))]
        better = (here < end) & ((r < best) | (place < 0))
        best, place = np.where(better, r, best), np.where(better, here, place)
    own = place < 0
    given = np.where(own, poly_prints(one, p, p + window), np.append(sym, np.uint64(0))[place])
    place = np.where(own, -1 - p, place)  # an occurrence of its own
    return p, given, place, word_at, two


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and what identifies a row: the order of its document and its text's digest."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text",
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("ord"), F.xxhash64("text").alias("th"),
    )


def removed_ranges(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """(ord, th, at, n): n windows from the word at `at` on that a smaller document has too."""

    def symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, limit=SLICE):
            p, given, _, word_at, _ = _given(batch, window)
            doc = np.searchsorted(word_at, p, side="right") - 1
            order = np.lexsort((given, doc))
            d, s = doc[order], given[order]
            new = np.concatenate([[True], (d[1:] != d[:-1]) | (s[1:] != s[:-1])]) if len(d) else np.zeros(0, bool)
            d, s = d[new], s[new].view(np.int64)
            ords, ths = batch.column("ord").to_numpy(), batch.column("th").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(ords[d]), pa.array(ths[d])], ["sym", "ord", "th"])

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, limit=SLICE):
            p, given, place, word_at, two = _given(batch, window)
            lists = batch.column("shared")
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            doc = np.searchsorted(word_at, p, side="right") - 1
            salt = mix(np.arange(batch.num_rows, dtype=np.uint64) + _A)  # a symbol is shared for its own document only
            keep = np.isin(given ^ salt[doc], flat ^ salt[owner])
            p, given, place, doc = p[keep], given[keep], place[keep], doc[keep]
            new = np.concatenate([[True], (place[1:] != place[:-1]) | (p[1:] != p[:-1] + 1)]) if len(p) else np.zeros(0, bool)
            first = np.flatnonzero(new)
            n = np.diff(first, append=len(p))
            ords, ths = batch.column("ord").to_numpy(), batch.column("th").to_numpy()
            whole = poly_prints(two, p[first], p[first] + n + window - 1)
            d = doc[first]
            yield pa.RecordBatch.from_arrays(
                [pa.array(given[first].view(np.int64)), pa.array(whole.view(np.int64)), pa.array(ords[d]), pa.array(ths[d]), pa.array((p[first] - word_at[d]).astype(np.int32)), pa.array(n.astype(np.int32))],
                ["sym", "tile", "ord", "th", "at", "n"],
            )

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, limit=SLICE):
            data, at = text_buffer(batch.column("text"))
            starts, ends, word_at = word_spans(data, at)
            two = word_hashes(data, starts, ends, 2)
            lists = batch.column("tiles")
            syms, first, n = (lists.flatten().field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
            doc = np.repeat(np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy())), n)
            place = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            p = word_at[doc] + place
            ords, ths = batch.column("ord").to_numpy(), batch.column("th").to_numpy()
            h = poly_prints(two, p, p + window)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(syms, n)), pa.array(h.view(np.int64)), pa.array(ords[doc]), pa.array(ths[doc]), pa.array(place.astype(np.int32))], ["sym", "h", "ord", "th", "at"])

    rows = rows.select("ord", "th", "text")
    names = put(rows.mapInArrow(symbols, "sym long, ord long, th long"), "symbols")
    shared = names.groupBy("sym").agg(F.min("ord").alias("lo"), F.max("ord").alias("hi")).where("lo < hi").select("sym")
    shared = put(shared, "shared-symbols")
    lists = put(names.join(shared, "sym").groupBy("ord", "th").agg(F.collect_set("sym").alias("shared")), "shared-lists")  # one document's symbols
    drop(names)
    drop(shared)
    found = put(rows.join(lists, ["ord", "th"]).mapInArrow(tiles, "sym long, tile long, ord long, th long, at int, n int"), "tiles")
    drop(lists)
    owners = put(found.groupBy("sym", "tile").agg(F.min("ord").alias("lo"), F.max("ord").alias("hi")), "tile-owners")
    repeated = owners.where("lo < hi").select("sym", "tile", "lo")
    later = put(found.join(repeated, ["sym", "tile"]).where("lo < ord").select("ord", "th", "at", "n"), "repeated-tiles")
    # symbols with several tiles: the windows of each tile's owner
    several = owners.groupBy("sym").agg(F.count("*").alias("tiles")).where("tiles > 1").select("sym")
    mine = put(owners.join(several, "sym").select("sym", "tile", F.col("lo").alias("ord")), "lone-tiles")
    drop(owners)
    some = found.join(mine, ["sym", "tile", "ord"]).groupBy("ord", "th").agg(F.collect_list(F.struct("sym", "at", "n")).alias("tiles"))  # one document's tiles
    some = put(some, "tile-lists")
    drop(found)
    drop(mine)
    each = put(rows.join(some, ["ord", "th"]).mapInArrow(single, "sym long, h long, ord long, th long, at int"), "single-windows")
    drop(some)
    first = put(each.groupBy("sym", "h").agg(F.min("ord").alias("lo"), F.max("ord").alias("hi")).where("lo < hi").select("sym", "h", "lo"), "window-owners")
    inner = put(each.join(first, ["sym", "h"]).where("lo < ord").select("ord", "th", "at", F.lit(1).alias("n")), "repeated-windows")
    drop(each)
    drop(first)
    return later.union(inner)


def dedup_substrings(docs: DataFrame, window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """For each document the words, the removed ones and a digest of the kept (and their text)."""
    arrow_limits(docs.sparkSession)
    rows = keyed(docs)
    gone = removed_ranges(rows, window).groupBy("ord", "th").agg(F.collect_set(F.struct("at", "n")).alias("gone"))  # one document's ranges
    gone = put(gone.select("ord", "th", F.col("gone.at").alias("at"), F.col("gone.n").alias("n")), "removed-ranges")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if with_text else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, limit=SLICE):
            data, at = text_buffer(batch.column("text"))
            starts, ends, word_at = word_spans(data, at)
            lists = [batch.column(c).fill_null(pa.scalar([], batch.column(c).type)) if batch.column(c).null_count else batch.column(c) for c in ("at", "n")]
            first, n = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in lists)
            begin = first + np.repeat(word_at[:-1], np.diff(lists[0].offsets.to_numpy()))
            change = np.zeros(len(starts) + 1, np.int64)
            np.add.at(change, begin, 1)
            np.add.at(change, begin + n + window - 1, -1)
            keep = np.cumsum(change)[:-1] == 0
            kept = np.flatnonzero(keep)
            # the bytes of the kept words, and one blank behind each but a document's last
            mark = np.zeros(len(data) + 2, np.int32)
            np.add.at(mark, starts[kept], 1)
            np.add.at(mark, ends[kept], -1)
            solid = np.cumsum(mark)[: len(data) + 1] > 0
            doc = np.searchsorted(word_at, kept, side="right") - 1
            blank = ends[kept[:-1]][doc[:-1] == doc[1:]]
            body = np.append(data, np.uint8(32))
            body[blank] = 32
            solid[blank] = True
            upto = np.concatenate([[0], np.cumsum(solid)])[at]
            body = body[solid].tobytes()
            sums = np.concatenate([[0], np.cumsum(keep)])[word_at]
            counts = np.diff(word_at)
            texts = [body[x:y] for x, y in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]
            columns = [batch.column("doc_id"), pa.array(counts), pa.array(counts - np.diff(sums)), pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                columns, names = [*columns, pa.array([x.decode() for x in texts], pa.string())], [*names, "kept"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.join(gone, ["ord", "th"], "left").select("doc_id", "text", "at", "n").mapInArrow(run, schema)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(documents(spark, sf_dir))

"""Operator 9's groups and operator 10's kept lines against brute force; odd rows."""

import re
from collections import Counter
from random import Random

import numpy as np

from rillstack.llm import bagminhash, line_dedup
from rillstack.llm.common import LAST

WORD = re.compile(r"[^\x20\x09-\x0D]+")
D = "/root/testdata/sf0.001"


def chain(n: int, changes: int = 1) -> list[str]:
    """Texts of which each differs from the one before in some more words."""
    words = [f"w{i}" for i in range(240)]
    out = []
    for k in range(n):
        for c in range(changes):
            words[(k * changes + c) * 7 % 240] = f"x{k}y{c}"
        out.append(" ".join(words))
    return out


def roots(texts: list[str], alike) -> list[int]:
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and alike(i, j):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return root


def test_near_duplicate_groups(spark):
    odd = [None, "", "one two", "one two", "a b c d e", "a b c d e", "z " * 400, "z " * 401, *chain(14, 2), *chain(10, 4)]
    rows = [(900000 + i, t) for i, t in enumerate(odd)] + [(None, "one two")]
    docs = spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    given = sorted(((LAST if r.doc_id is None else r.doc_id), r.text or "") for r in docs.collect())
    bags = []
    for _, t in given:
        w = WORD.findall(t)
        bags.append(Counter(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1 if w else 0))))

    def alike(i: int, j: int) -> bool:
        if given[i][1] == given[j][1]:
            return True
        both = (bags[i] & bags[j]).total()
        return both > 0 and both >= 0.8 * (bags[i] | bags[j]).total()

    expected = sorted((given[i][0], given[r][0]) for i, r in enumerate(roots([t for _, t in given], alike)))
    got = sorted(((LAST if r.doc_id is None else r.doc_id), LAST if r.group_id is None else r.group_id) for r in bagminhash.near_duplicates(docs).collect())
    assert got == expected


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(5)
    for most in (1, 6, 300):
        a = {int(k): int(rng.integers(1, most + 1)) for k in rng.integers(1, 1 << 62, 50)}
        b = {k: v if rng.random() < 0.7 else int(rng.integers(1, most + 1)) for k, v in a.items() if rng.random() < 0.95}
        true = sum(min(v, b.get(k, 0)) for k, v in a.items()) / sum(max(v, b.get(k, 0)) for k, v in a.items())
        shares = []
        for turn in range(40):
            bags = [np.repeat(np.array([(k * 2654435761 + turn * 977) % (1 << 63) for k in x], np.uint64), list(x.values())) for x in (a, b)]
            sig = bagminhash.signatures(np.repeat([0, 1], [len(x) for x in bags]), np.concatenate(bags), 2, 80)
            shares.append((sig[0] == sig[1]).mean())
        assert abs(np.mean(shares) - true) < 0.04, (most, true, np.mean(shares))


def test_one_of_each(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(5, text, 1), (3, text + " more", 2), (3, text + " more", 3), (None, text, 4), (None, "alone here", 5), (None, None, 6), (9, "", 7), (-1, "other words", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, root int")
    got = sorted((-9 if r.doc_id is None else r.doc_id, r.text) for r in bagminhash.one_of_each(docs).collect())
    assert got == [(-9, "alone here"), (-1, "other words"), (3, text + " more"), (9, "")]
    assert bagminhash.one_of_each(docs).columns == docs.columns


def test_lines(spark):
    line = "the committee will meet again on the second tuesday of next month in the large hall of the old library building"
    rows = [
        (1, f"{line}\nshort\nonly here is this line with its own words about ships and harbours"),
        (2, f"{line.upper()}!\nshort\nan entirely different sentence about gardens, rain and the price of bread"),
        (3, line.replace("large", "largee")),
        (4, None), (5, ""), (None, line), (6, f"{line}\n{line}"), (6, f"{line}\n{line}"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id or 0), r.text, r.n_removed_lines) for r in line_dedup.dedup_lines(docs).collect() if r.text is not None)
    kept = {i: t for i, t, _ in got}
    assert kept[1] == rows[0][1]
    assert kept[2] == "short\nan entirely different sentence about gardens, rain and the price of bread"
    assert kept[0] == "" and kept[5] == "" and kept[6] == ""
    assert [n for i, _, n in got if i == 6] == [2, 2]
    assert kept[3] == ""  # alike but for a letter
    assert line_dedup.dedup_lines(docs.where("doc_id < 0")).count() == 0
    assert bagminhash.near_duplicates(docs.where("doc_id < 0")).count() == 0


def test_unlike_members_of_a_bucket_are_not_tried_in_pairs(spark, monkeypatch):
    """Copies of one text that are close to it and not to each other, and some that are linked: the groups of
    brute force, from few pairs."""
    draw = Random(11)
    base = [f"w{k}" for k in range(300)]
    texts = []
    for k in range(160):
        words = list(base)
        for at in draw.sample(range(300), 7):
            words[at] = f"x{k}at{at}"
        texts.append(" ".join(words))
    texts += [f"{t} more" for t in texts[::20]]
    bags = []
    for t in texts:
        w = t.split()
        bags.append(Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)))
    expected = roots(texts, lambda i, j: 1.8 * (bags[i] & bags[j]).total() >= 0.8 * (bags[i].total() + bags[j].total()))
    tried = []
    verify, search = bagminhash.overlaps, getattr(bagminhash, "prefix_pairs", None)
    monkeypatch.setattr(bagminhash, "overlaps", lambda pairs, *rest: [tried.append(pairs.count()), verify(pairs, *rest)][1])
    if search:
        monkeypatch.setattr(bagminhash, "prefix_pairs", lambda *given: [found := search(*given), tried.append(found.count())][0])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.group_id for r in bagminhash.near_duplicates(docs).collect()}
    assert got == dict(enumerate(expected))
    assert sum(tried) < 20 * len(texts), tried  # of 14,028 pairs

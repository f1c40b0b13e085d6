"""Operators 4 and 7 against brute force on whole sf0.001 and odd rows; the language fold."""

import hashlib
import re
from collections import Counter

import pytest

from rillstack.llm import quality, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    odd = spark.createDataFrame([(900001, None), (900002, ""), (900003, "x " * 60), (900004, "x " * 60), (900005, "a b c\n\na b c\n")], "doc_id long, text string")
    return spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text").union(odd)


def test_substring_dedup(docs):
    owner, expected = {}, {}
    for r in docs.orderBy("doc_id").collect():
        w, gone = WORD.findall(r.text or ""), set()
        for i in range(len(w) - 12):
            if owner.setdefault(tuple(w[i : i + 13]), r.doc_id) < r.doc_id:
                gone |= set(range(i, i + 13))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        expected[r.doc_id] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.dedup_substrings(docs).collect()}
    assert got == expected


def test_base_rules(docs):
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in quality.base_rules(docs).drop("words").collect():
        text = texts[r.doc_id]
        w = WORD.findall(text)
        threes = Counter(zip(w, w[1:], w[2:]))
        covered = {j for i in range(len(w) - 2) if threes[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        expected = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected, r.doc_id

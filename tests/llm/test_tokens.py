"""Operators 1, 2 and 6 against the tokenizers library."""

import hashlib
import struct
import zlib

import pytest
from tokenizers import Tokenizer

from rillstack.llm import bpe_codec, token_counts, token_files
from rillstack.llm.common import shared_path, tokenizer_path

TEXTS = [
    None, "", " ", "Hello world, it's 12 o'clock", "a" * 3000, "日本語 text nbsp", "<|endoftext|> twice <|endoftext|>",
    "tabs\t\tand\r\n lines  \n", "Élan naïve œuvre", "emoji 🙂🙂 done", "Hello world, it's 12 o'clock",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", i) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int").repartition(3)


@pytest.fixture(scope="module")
def expected():
    t = Tokenizer.from_file(tokenizer_path())
    return [t.encode(x or "", add_special_tokens=False).ids for x in TEXTS], t


def packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def test_files_hold_all_ids(spark, docs, expected):
    path = shared_path(spark, "ids")
    token_files.write_token_ids(docs, path)
    got = {r.doc_id: r for r in token_files.token_offsets(spark, path).collect()}
    start = 0
    for i, ids in enumerate(expected[0]):
        whole = [*ids, 0]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(whole), zlib.crc32(packed(whole)))
        start += len(whole)


def test_round_trip(docs, expected):
    ids, t = expected
    for r in bpe_codec.round_trips(docs).collect():
        assert r.ids_sha256 == hashlib.sha256(packed(ids[r.doc_id])).hexdigest(), TEXTS[r.doc_id]
        text = t.decode(ids[r.doc_id], skip_special_tokens=False)
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_counts_and_cache(spark, docs, expected):
    cache = shared_path(spark, "cache")
    for _ in range(2):
        rows = token_counts.token_counts(docs, cache).collect()
        assert sorted((r.doc_id, r.n_tokens) for r in rows) == [(i, len(x)) for i, x in enumerate(expected[0])]
    assert spark.read.parquet(cache).count() == len(set(TEXTS) - {None})


def test_empty_table(spark, docs):
    none = docs.where("false")
    assert bpe_codec.round_trips(none).count() == 0
    assert token_counts.token_counts(none, shared_path(spark, "none")).count() == 0

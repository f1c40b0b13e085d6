"""Operators 1, 2 and 6 on all documents of sf0.01 against the tokenizers library; odd rows; the pipeline."""

import hashlib
import struct
import zlib

import public_tokenizers
import pyarrow.orc as orc
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from rillstack.llm import bpe_codec, token_counts, token_files

D = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def encoded(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text").collect()}
    return {i: (t, library.encode(t, add_special_tokens=False).ids) for i, t in texts.items()}


def packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def test_token_files(spark, encoded):
    start, want = 0, {}
    for i in sorted(encoded):
        ids = [*encoded[i][1], 0]
        want[i] = (start, len(ids), zlib.crc32(packed(ids)))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.op1_token_files(spark, D).collect()} == want


def test_stripes_index_and_filter(spark, tmp_path):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    token_files.write_token_ids(docs.where("doc_id < 400"), str(tmp_path / "ids"))
    files = list((tmp_path / "ids").glob("*.orc"))
    assert sum(orc.ORCFile(f).nrows for f in files) == docs.where("doc_id < 400").count() and all(orc.ORCFile(f).nstripes >= 1 for f in files)
    ends = sorted((t.column("doc_id")[0].as_py(), t.column("doc_id")[-1].as_py()) for t in (orc.ORCFile(f).read(["doc_id"]) for f in files) if len(t))
    assert all(a[1] < b[0] for a, b in zip(ends, ends[1:]))  # a file is a range of documents
    got = token_files.read_token_ids(spark, str(tmp_path / "ids")).where("doc_id = 17")
    assert got.count() == docs.where("doc_id = 17").count() and "doc_id" in got._jdf.queryExecution().toString().split("PushedFilters")[1][:60]
    assert any(b"BLOOM" in f.read_bytes() or f.stat().st_size > 0 for f in files)


def test_round_trips(spark, encoded, library):
    want = {i: (len(ids), hashlib.sha256(packed(ids)).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()) for i, (_, ids) in encoded.items()}
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe_codec.op2_bpe(spark, D).collect()} == want


def test_encode_and_decode_columns(spark, library):
    texts = ["", None, "a  b\n\n c's 123 été 😀<|endoftext|>x", "word " * 500]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit("old"))
    both = bpe_codec.decode(bpe_codec.encode(docs, ids="ids"), ids="ids").orderBy("doc_id").collect()
    assert [list(r.ids) for r in both] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [r.decoded for r in both] == [t or "" for t in texts] and [r.text for r in both] == texts


def test_counts_and_the_cache(spark, encoded, tmp_path):
    want = {i: (len(t.encode()), len(ids), len(ids) > 512) for i, (t, ids) in encoded.items()}
    docs, cache = spark.read.parquet(f"{D}/documents.parquet"), str(tmp_path / "cache")
    for some in (docs.where("doc_id % 2 = 0"), docs, docs):  # no hits, half, all
        got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(some, cache).collect()}
        assert got == {i: v for i, v in want.items() if i in got} and len(got) == some.count()
    held = spark.read.parquet(cache)
    assert held.count() == held.select("digest").distinct().count() == len({t for t, _ in encoded.values()})


def test_counts_without_broadcast(spark, encoded, tmp_path, monkeypatch):
    monkeypatch.setattr(token_counts, "BROADCAST_ROWS", 10)
    docs = spark.read.parquet(f"{D}/documents.parquet").where("doc_id < 300")
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, str(tmp_path / "cache")).collect()}
    assert got == {i: len(ids) for i, (_, ids) in encoded.items() if i < 300}


def test_odd_rows_of_tokens(spark, tmp_path):
    rows = [(None, "a"), (1, None), (2, ""), (2, ""), (2, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit("x")).withColumn("seq", F.lit(1))
    token_files.write_token_ids(docs, str(tmp_path / "ids"))
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in token_files.token_offsets(spark, str(tmp_path / "ids")).collect())
    assert [x[1] for x in got] == [None, 1, 2, 2, 2] and got[0][0] == 0
    counted = token_counts.token_counts(docs, str(tmp_path / "cache")).collect()
    assert len(counted) == 5 and bpe_codec.round_trips(docs).count() == 5
    empty = docs.where("doc_id > 9")
    token_files.write_token_ids(empty, str(tmp_path / "none"))
    assert token_files.token_offsets(spark, str(tmp_path / "none")).count() == 0 and token_counts.token_counts(empty, str(tmp_path / "cache")).count() == 0


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    words = [f"w{k}" for k in range(70)]
    base, line = " ".join(words), "this line stands in many of the documents of this small table"
    item = "Maria sold 48 clips in April and Omar sold half as many clips in May so how many clips were sold"
    rows = [
        (1, f"{base}\n{line}", "en", "s", 1), (2, f"{base} and more\n{line}", "en", "s", 1), (None, " ".join(f"v{k}" for k in range(70)), "en", "s", 1),
        (None, "short", "en", "s", 1), (None, None, "en", "s", 1), (3, " ".join(f"u{k}" for k in range(70)) + ". " + item, "en", "s", 1),
        (4, " ".join(f"t{k}" for k in range(70)) + f"\n{line}", "en", "s", 1), (4, " ".join(f"t{k}" for k in range(70)) + f"\n{line}", "en", "s", 1), (5, "", "en", "s", 1),
    ]
    d = str(tmp_path / "tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    # the first line of 2 is alike to that of 1 and goes with its other line: what is left of 2 is like nothing
    want = {
        "quality_rules": [None, 1, 2, 3, 4, 4], "line_dedup": [None, 1, 2, 3, 4, 4], "near_duplicates": [None, 1, 2, 3, 4], "decontamination": [None, 1, 2, 4], "bpe": [None, 1, 2, 4],
    }
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, d)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert sorted((r.doc_id for r in docs.collect()), key=lambda x: (x is not None, x or 0)) == want[name], name
        if name == "line_dedup":
            assert {r.doc_id: r.text.count(line) for r in docs.collect() if r.doc_id} == {1: 1, 2: 0, 3: 0, 4: 0}
            assert all(r.n_chars == len(r.text) for r in docs.collect())
        if name != "bpe":
            assert docs.columns == corpus_pipeline.COLUMNS
    assert corpus_pipeline.run(spark, d).count() == 4

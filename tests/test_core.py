"""The engine's queries against DuckDB, and its functions on small inputs."""

import duckdb
import pytest
from pyspark.sql import functions as F

from rillstack.functions import scalar
from rillstack.operators import pipeline as P
from rillstack.plans import catalogue
from rillstack.sources import files

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("customer", "nation", "lineitem", "part", "orders", "events", "conversations", "supplier", "documents", "embeddings"):
        con.sql(f"create view {t} as from '{D}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_as_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, D)
    sql = duck.sql(catalogue.ORACLE_SQL[name])
    at = [sql.columns.index(c) for c in got.columns]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(tuple(r[i] for i in at)) for r in sql.fetchall())


def test_jaro_winkler():
    assert scalar.jaro_winkler_value("", "") == 1.0
    assert scalar.jaro_winkler_value("abc", "") == 0.0
    assert scalar.jaro_winkler_value("pho 24", "phở 24") > 0.8


def test_dedup_keeps_the_first(spark):
    df = spark.createDataFrame(list(enumerate("abacb")), "pos int, k string")
    flow = P.Pipeline(df).pipe(P.dedup_stage(F.col("k"), "pos"))
    assert sorted(r.pos for r in flow.written().collect()) == [0, 1, 3]


def test_csv_skips_blank_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name\n1,Alice\n,\n2,Bob\n")
    assert [tuple(r) for r in files.csv(spark, str(tmp_path)).collect()] == [("1", "Alice"), ("2", "Bob")]


def test_cosine_and_slug(spark):
    row = spark.sql("select array(1.0, 0.0) a, array(0.0, 0.0) z, 'Phở Đặc  Biệt!' s").select(
        scalar.cosine_similarity(F.col("a"), F.col("a")).alias("one"), scalar.cosine_similarity(F.col("a"), F.col("z")).alias("zero"), scalar.to_slug(F.col("s")).alias("slug")
    ).first()
    assert (row.one, row.zero, row.slug) == (1.0, 0.0, "pho-dac-biet")

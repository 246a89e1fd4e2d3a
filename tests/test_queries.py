"""Every query of the engine against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from webloom.plans import catalogue
from webloom.streaming import jobs

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, (list, tuple)):
        return [plain(y) for y in x]
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    return x.replace(tzinfo=None) if hasattr(x, "tzinfo") else x


def compared(df, sql):
    rel = connect().sql(sql)
    names = sorted(df.columns)
    assert names == sorted(rel.columns)
    at = [rel.columns.index(n) for n in names]
    mine = sorted(repr([plain(r[n]) for n in names]) for r in df.collect())
    theirs = sorted(repr([plain(r[i]) for i in at]) for r in rel.fetchall())
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, name):
    df = catalogue.queries()[name](spark, SF)
    sql = catalogue.oracle_sql().get(name)
    if sql:
        compared(df, sql)
    else:
        assert df.count() > 0


@pytest.mark.parametrize(("name", "table"), [("stream_dedup", "pages"), ("stream_lives", "events")])
def test_streams_of_folders(spark, tmp_path, name, table):
    """A table may be a folder of files, as larger ones are."""
    spark.read.parquet(f"{SF}/{table}.parquet").repartition(3).write.parquet(str(tmp_path / f"{table}.parquet"))
    spark.range(1).write.parquet(str(tmp_path / "other.parquet"))
    compared(catalogue.queries()[name](spark, str(tmp_path)), catalogue.oracle_sql()[name])


def test_stream_without_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("url string").parquet(str(tmp_path / "in"))
    found = jobs.replayed(spark, stream, str(tmp_path / "out"))
    assert found.columns == ["url"] and found.count() == 0

import os

import pytest
from pyspark.sql import functions as F

from webloom import session


def test_scratch_and_discard(spark):
    """Tables of a block go with it, but those that are kept."""
    there = lambda df: [f for f in df.inputFiles() if os.path.exists(f.removeprefix("file://"))]
    outer = session.cut(spark.range(3).toDF("a"))
    with session.scratch() as keep:
        lost = session.cut(outer.selectExpr("a + 1 as a"))
        kept = keep(session.cut(lost.selectExpr("a * 2 as a")))
    assert sorted(r.a for r in kept.collect()) == [2, 4, 6] and there(outer) and there(kept) and not there(lost)
    session.discard(kept)
    assert not there(kept) and there(outer)


def test_sizes(spark, tmp_path):
    spark.range(50_000).select(F.sha1(F.col("id").cast("string")).alias("x")).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    assert session.input_bytes(df) > 500_000
    assert session.partitions_for(df) == 4 and session.partitions_for(df, 100_000) > 10
    assert session.input_bytes(spark.createDataFrame([(1,)], "a int").rdd.toDF()) == 0


def test_unused_names(spark):
    df = spark.createDataFrame([(1, 2)], "a int, _A int")
    assert session.unused(df, "a", "b", "a") == ["__a", "b", "___a"]


def test_broadcast_only_what_is_small(spark):
    df = spark.range(100)
    assert session.small_enough(df, 8, 800) and not session.small_enough(df, 8, 792)


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://somewhere"

        class getConf:  # noqa: N801
            get = staticmethod(lambda _: None)

    class Session:
        sparkContext = Context()  # noqa: N815

    with pytest.raises(RuntimeError, match="checkpoint"):
        session.shared_dir(Session())

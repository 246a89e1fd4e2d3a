"""The queries of the subpackage against SQL, and the pipeline against a brute-force version."""

import os
import re
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import corpus_pipeline  # noqa: E402
from test_queries import SF, compared  # noqa: E402

import __spark_entry__  # noqa: E402
from webloom.llm import mixing, quality, queries, sharding, textvec  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, name):
    df = queries.queries()[name](spark, SF)
    sql = queries.oracle_sql().get(name)
    if sql:
        compared(df, sql)
    else:
        assert df.count() > 0


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))


def grams(text, n):
    seps = re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: f"\\u{int(m[1], 16):04x}", textvec.SEPARATORS)
    w = [x for x in re.split(f"[{seps}]+", text.lower()) if x]
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights", "sharding"]
    # 1: quality, by its own keys sorted
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = {r.doc_id for r in quality.resample(docs, labels).collect()}
    text = {r.doc_id: r.text for r in docs.collect() if r.doc_id in good}
    # 2: all pairs
    own = {i: grams(t, 3) for i, t in sorted(text.items())}
    group = {i: i for i in own}
    links = [(i, j) for i in own for j in own if i < j and (b := len(own[i] & own[j])) and b / (len(own[i]) + len(own[j]) - b) >= 0.55]
    for _ in own:
        for i, j in links:
            group[i] = group[j] = min(group[i], group[j])
    text = {i: t for i, t in text.items() if group[i] == i}
    # 3: all items
    items = [grams(r.text, 5) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    text = {i: t for i, t in text.items() if not any(x and len(x & s) / len(x) >= 0.6 for s in [grams(t, 5)] for x in items)}
    # 4 and 5: on exactly these documents
    left = docs.where(F.col("doc_id").isin(list(text)))
    want = sharding.with_shards(mixing.mixed(left))
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == [*docs.columns, "region", "rack", "shard"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 0


def test_stages_keep_the_columns_and_stand_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, "no id", "en", "s", 5), (10**9, None, None, None, None), (10**9 + 1, "", "en", "s", 0)], docs.schema)
    for name, stage in corpus_pipeline.STAGES:
        for df in (docs.limit(0), docs.unionByName(odd)):
            out = stage(spark, df, SF)
            assert out.columns[:5] == docs.columns and out.count() <= df.count()
            if name != "sharding":
                assert out.columns == docs.columns


def test_stages_keep_clashing_columns(spark):
    """Columns with the names that stages use inside are kept as they are."""
    names = ["log_weight", "key", "src", "len", "cut", "gone", "row", "s", "h", "class_id", "set_id", "label", "id"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(80).withColumns({n: F.concat(F.lit(n), F.col("doc_id")) for n in names})
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.columns[: len(docs.columns)] == docs.columns and 0 < out.count() <= 80
        assert out.where(" or ".join(f"{n} is distinct from concat('{n}', doc_id)" for n in names)).isEmpty(), name


def test_stages_take_very_long_texts_ties_and_repeated_rows(spark):
    """A text of a million words, two rows of one id, equal texts: each has its defined fate."""
    long = " ".join(f"w{i % 5000}x{i % 7}" for i in range(1_000_000))
    same = " ".join(f"s{i}" for i in range(50))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    schema = docs.schema
    rows = [(1, long, "en", "a", 1), (2, same, "en", "a", 1), (3, same, "en", "b", 1), (4, "only this", "en", "b", 1), (4, "only this", "en", "b", 1), (5, same + " t", "en", "a", 1)]
    small = spark.createDataFrame(rows, schema)
    stages = dict(corpus_pipeline.STAGES)
    left = sorted(r.doc_id for r in stages["n-gram Jaccard join"](spark, small, SF).collect())
    assert left == [1, 2, 4, 4]
    assert sorted(r.doc_id for r in stages["benchmark decontamination"](spark, small, SF).collect()) == [1, 2, 3, 4, 4, 5]
    drawn = [r.doc_id for r in stages["mixing sources to target weights"](spark, small, SF).collect()]
    assert drawn.count(4) in (0, 2) and set(drawn) <= {1, 2, 3, 4, 5}
    shards = stages["sharding"](spark, small, SF).where("doc_id = 4").select("shard").distinct().count()
    assert shards == 1 and len(stages["quality classifier"](spark, docs.union(small), SF).where("doc_id = 4 and text = 'only this'").collect()) in (0, 2)

"""The corpus pipeline: quality, near duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as
Parquet in the shared folder and reads again as the next stage's documents. All but the
last return the columns of documents; the last adds region, rack and shard.

Defined cases, by stage, each on the rows that its predecessor kept:

1. Quality: a null, empty or blank text is rejected; a null doc_id is judged by its text.
   Rows that repeat a doc_id and text share their fate, ties at the last place all stay.
   Without labels of both kinds every text with a token stays.
2. Near duplicates: of each connected group the rows of the smallest doc_id stay. Rows with
   a null doc_id or no words have no partner and stay. Rows that repeat a doc_id share the
   fate of that id, which its row with the most grams decides.
3. Decontamination: rows are judged one by one; a null text or no words holds nothing and
   stays, and without items all rows stay.
4. Mixing: rows with a null doc_id or no words can't be drawn and go; a null source is a
   source of its own. Rows of an id, source and length are drawn together or not at all.
5. Sharding: every row gets a place, a null doc_id that of "null"; columns named region,
   rack or shard are replaced.

Texts of any length are used whole. Columns beyond those of documents are kept whatever
their names, and an empty table gives an empty table of the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from webloom.llm import decontaminate, jaccard_join, mixing, quality, sharding
from webloom.session import cut, discard, maybe_broadcast, scratch, table, unused


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampling keeps."""
    return quality.kept(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near duplicates."""
    drop = cut(jaccard_join.jaccard_join(docs).where("doc_id != class_id").select("doc_id"), "pipeline-copies")
    (gone,) = unused(docs, "gone")
    drop = drop.withColumnRenamed("doc_id", gone)
    return docs.join(maybe_broadcast(drop, 32), docs["doc_id"].cast("long") == drop[gone], "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that sources have their target weights."""
    return mixing.mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with region, rack and shard."""
    return sharding.with_shards(docs)


STAGES = [
    ("quality classifier", quality_filter),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mix),
    ("sharding", shard),
]

#: The quality classifier, the mixing programme and the hashes of both can't be had in SQL; tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        with scratch() as kept:
            docs = kept(cut(stage(spark, docs, sf_dir), f"stage-{i}"))
        if before is not None:
            discard(before)
        before = docs
    return docs

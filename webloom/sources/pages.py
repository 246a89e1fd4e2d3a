"""Sources and sinks: provided pages, files of seeds, folders of documents, saved bodies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions import urls


def provided(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    """Pages given as (url, html)."""
    return spark.createDataFrame(rows, "url string, html string")


def seeds(spark: SparkSession, path: str) -> DataFrame:
    """Seed URLs, one a line; blank lines and ``#`` comments are left out."""
    lines = spark.read.text(path).select(F.trim("value").alias("line")).where("line != '' and not startswith(line, '#')")
    return lines.select(urls.normalized(urls.guess_scheme(F.col("line"))).alias("url")).where("url is not null")


def files(spark: SparkSession, path: str) -> DataFrame:
    """Every file below a folder as (url, body, length)."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.select(F.col("path").alias("url"), F.col("content").alias("body"), "length")


def fetched(targets: DataFrame, pages: DataFrame) -> DataFrame:
    """The fetch of an offline engine: targets (url) that the stored pages have."""
    key = urls.dedup_key(urls.normalized(F.col("url")))
    stored = pages.withColumn("_key", key).drop("url")
    return targets.withColumn("_key", key).join(stored, "_key").drop("_key")


def save(df: DataFrame, path: str, **options: str) -> None:
    """Write targets as Parquet."""
    df.write.options(**options).parquet(path)

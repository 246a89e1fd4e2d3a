"""The queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm import ann, decontaminate, html_diff, jaccard_join, language, line_dedup, mixing, quality, sharding, toxicity
from webloom.session import table

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_mix_sources": lambda s, d: mixing.mix_sources(table(s, d, "documents")),
        "op2_language": lambda s, d: language.identify(table(s, d, "documents")),
        "op3_toxicity": lambda s, d: toxicity.toxicity(table(s, d, "documents"), table(s, d, "labels")),
        "op4_decontaminate": lambda s, d: decontaminate.contained(table(s, d, "documents"), table(s, d, "benchmark")),
        "op5_neighbors": lambda s, d: ann.neighbors(table(s, d, "embeddings"), F.col("vec_id") % 50 == 0),
        "op6_jaccard_join": lambda s, d: jaccard_join.jaccard_join(table(s, d, "documents")),
        "op7_sharding": lambda s, d: sharding.shards(table(s, d, "documents")),
        "op8_quality": lambda s, d: quality.resample(table(s, d, "documents"), table(s, d, "labels")),
        "op9_html_diff": lambda s, d: html_diff.extract(table(s, d, "pages")),
        "op10_line_dedup": lambda s, d: line_dedup.line_dedup(table(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_language": language.ORACLE,
        "op4_decontaminate": decontaminate.ORACLE,
        "op6_jaccard_join": jaccard_join.ORACLE,
        "op7_sharding": sharding.oracle(),
        "op10_line_dedup": line_dedup.ORACLE,
    }

"""Breadth-first expansion of links with a visited set.

Every level is one join and one anti-join on the key, written to the shared folder, so a
lost executor costs no more than the level. The visited set is a union of the levels, and
written anew every eighth level. A page has its least depth, whatever the order of links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.session import cut


def first_seen(df: DataFrame, key: str, *order: str) -> DataFrame:
    """One row per key, the first in order; rows with a null key go.

    Added up before the shuffle, so a key that most rows have is no burden to one task.
    """
    rest = [c for c in df.columns if c not in (key, *order)]
    best = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*order)).alias("o") if not rest else F.min_by(F.struct(*order, *rest), F.struct(*order)).alias("o"))
    return best.select(*[F.col(key) if c == key else F.col(f"o.{c}") for c in df.columns])


def expand(seeds: DataFrame, links: DataFrame, depth_limit: int = 1) -> DataFrame:
    """(page, depth) of pages reached from ``seeds`` (page) by ``links`` (src, dst).

    N levels are depths 0 to N - 1; 0 is no limit.
    """
    level = cut(seeds.select("page").where("page is not null").distinct().withColumn("depth", F.lit(0)), "frontier")
    seen, depth = level, 0
    while True:
        depth += 1
        if depth == depth_limit:
            return seen
        found = links.join(level, links["src"] == level["page"]).select(F.col("dst").alias("page")).where("page is not null").distinct()
        level = cut(found.join(seen, "page", "left_anti").withColumn("depth", F.lit(depth)), "frontier")
        if level.isEmpty():
            return seen
        seen = seen.unionByName(level)
        if depth % 8 == 0:
            seen = cut(seen, "seen")


def follow_redirects(urls: DataFrame, redirects: DataFrame, most: int = 20) -> DataFrame:
    """(url, final) after at most ``most`` steps of ``redirects`` (src, dst); loops end in null."""
    hop = cut(redirects.groupBy("src").agg(F.min("dst").alias("dst")), "redirects")
    now = cut(urls.select("url", F.col("url").alias("final")), "redirected")
    for _ in range(most):
        moved = now.join(hop, now["final"] == hop["src"], "left")
        if moved.where("src is not null").isEmpty():
            return now
        now = cut(moved.select("url", F.coalesce("dst", "final").alias("final")), "redirected")
    return now.join(hop, now["final"] == hop["src"], "left").select("url", F.when(F.col("src").isNull(), F.col("final")).alias("final"))

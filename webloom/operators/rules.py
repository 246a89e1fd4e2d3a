"""Robots rules, the jail and the limits of a crawl, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webloom.functions import urls


def robots_rules(body: Column, agent: str) -> Column:
    """array<struct<allow, prefix>> of the lines that are about ``agent``.

    Rules hold before any User-agent line and after one whose value is ``*`` or a part of
    the agent's name; the last User-agent line counts. Keywords are matched without case,
    an empty Disallow allows all, and ``#`` begins a comment. A null body has no rules.
    """
    kinds = "array<struct<allow:boolean,prefix:string>>"
    lines = F.transform(F.split(body, r"\r\n|\r|\n"), lambda x: F.trim(F.regexp_replace(x, r"#.*$", "")))
    key = lambda x: F.lower(F.trim(F.substring_index(x, ":", 1)))
    value = lambda x: F.trim(F.regexp_extract(x, r"^[^:]*:(.*)$", 1))
    start = F.struct(F.lit(True).alias("on"), F.array().cast(kinds).alias("rules"))

    def step(acc, x):
        about = (value(x) == "*") | ((value(x) != "") & F.contains(F.lit(agent.lower()), F.lower(value(x))))
        rule = F.struct((key(x) == "allow").alias("allow"), value(x).alias("prefix"))
        add = acc["on"] & key(x).isin("allow", "disallow") & (value(x) != "")
        on = F.when(key(x) == "user-agent", about).otherwise(acc["on"])
        return F.struct(on.alias("on"), F.when(add, F.concat(acc["rules"], F.array(rule).cast(kinds))).otherwise(acc["rules"]).alias("rules"))

    return F.coalesce(F.aggregate(lines, start, step, lambda acc: acc["rules"]), F.array().cast(kinds))


def allowed(path: Column, rules: Column) -> Column:
    """Allow rules come first: a path is free if one of them fits or no deny rule does."""
    hit = lambda allow: F.exists(rules, lambda r: (r["allow"] == F.lit(allow)) & path.startswith(r["prefix"]))
    return hit(True) | ~hit(False)


def in_jail(url: Column, seed: Column) -> Column:
    """Whether a URL is on the seed's host and in or below its directory, without case."""
    return (urls.host_key(urls.host(url)) == urls.host_key(urls.host(seed))) & F.lower(urls.path(url)).startswith(F.lower(urls.directory(seed)))

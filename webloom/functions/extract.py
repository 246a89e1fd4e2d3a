"""Extraction from documents as Column expressions; each returns an array or a rewritten text."""

from __future__ import annotations

import json
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_RAW = r"(?is)<(script|style|textarea)\b[^>]*>.*?</\1\s*>"
# the first href or src of a tag; a "<" inside a tag starts it anew
_LINK = r"""(?is)<[a-z][^<>]*?\s(?:href|src)\s*=\s*("[^"<>]*"|'[^'<>]*'|[^\s"'<>]+)"""


def html_links(html: Column) -> Column:
    """Links of all tags; bodies of raw-text elements hold no tags, and ``#`` anchors are left out.

    Null HTML gives null. Links are not entity-decoded.
    """
    bare = F.regexp_replace(html, _RAW, "<raw>")
    found = F.regexp_extract_all(bare, F.lit(_LINK), 1)
    return F.filter(F.transform(found, lambda x: F.regexp_replace(x, r"""^["']|["']$""", "")), lambda x: (x != "") & ~x.startswith("#"))


def css_links(css: Column) -> Column:
    """Every ``url(...)``, quoted or not, and bare ``url x;``."""
    found = F.regexp_extract_all(css, F.lit(r"""url(?:\(\s*|\s+)["']?([^"'();\s]+)"""), 1)
    return F.filter(found, lambda x: x != "")


def style_links(html: Column) -> Column:
    """Links in the style elements of a page."""
    return F.flatten(F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<style\b[^>]*>(.*?)</style"), 1), css_links))


def text_links(text: Column) -> Column:
    """http and ftp URLs in plain text."""
    return F.regexp_extract_all(text, F.lit(r"((?:http|ftp)://[A-Za-z0-9%?=&/.]+)"), 1)


def prefixed_links(html: Column, links: Column) -> Column:
    """``[p:rest]`` links with the prefixes that the root declares as ``xmlns:p``."""
    names = F.regexp_extract_all(html, F.lit(r"""(?is)\sxmlns:([a-z0-9]+)\s*=\s*["'][^"']*["']"""), 1)
    values = F.regexp_extract_all(html, F.lit(r"""(?is)\sxmlns:[a-z0-9]+\s*=\s*["']([^"']*)["']"""), 1)
    table = F.map_from_entries(F.array_distinct(F.arrays_zip(names.alias("k"), values.alias("v"))))
    name = lambda x: F.regexp_extract(x, r"^\[([A-Za-z0-9]+):.*\]$", 1)
    known = lambda x: F.when(name(x) == "", F.lit(None)).otherwise(F.try_element_at(table, name(x)))
    return F.transform(links, lambda x: F.when(known(x).isNull(), x).otherwise(F.concat(known(x), F.regexp_extract(x, r"^\[[A-Za-z0-9]+:(.*)\]$", 1))))


def charset(content_type: Column, head: Column) -> Column:
    """Lower-cased charset of the header, else of the first meta, else utf-8."""
    pattern = r"""(?i)charset\s*=\s*["']?([a-z0-9_.:-]+)"""
    meta = F.regexp_extract(head, r"""(?is)<meta[^>]*\bcharset\s*=\s*["']?([a-z0-9_.:-]+)""", 1)
    first = F.regexp_extract(F.coalesce(content_type, F.lit("")), pattern, 1)
    return F.lower(F.when(first != "", first).when(meta != "", meta).otherwise(F.lit("utf-8")))


@F.pandas_udf(StringType())
def _convert(body, name):
    """Charsets that the JVM function doesn't take, or where it fails on malformed bytes; an unknown one is read as UTF-8."""
    import pandas as pd

    def one(b, n):
        if b is None:
            return None
        try:
            return bytes(b).decode(n or "utf-8", "replace")
        except LookupError:
            return bytes(b).decode("utf-8", "replace")

    return pd.Series([one(b, n) for b, n in zip(body, name)])


def to_utf8(body: Column, name: Column) -> Column:
    """Bytes of a charset as text, natively where every byte is a character or the bytes are valid already."""
    plain = name.isin("utf-8", "us-ascii") & F.is_valid_utf8(body.cast("string"))
    return F.when(name == "iso-8859-1", F.decode(body, "iso-8859-1")).when(plain, body.cast("string")).otherwise(_convert(body, name))


#: Named entities with their characters; lt and gt stay, as decoding them would make tags.
ENTITIES = {k: chr(v) for k, v in name2codepoint.items() if k not in ("lt", "gt")}


def decode_entities(text: Column) -> Column:
    """Named entities as characters; unknown and numeric ones stay."""
    runs = F.regexp_extract_all(text, F.lit(r"(&[A-Za-z0-9]+;|[^&]+|&)"), 1)
    # one folded literal; a map of hundreds of expressions would be too large for generated code
    table = F.from_json(F.lit(json.dumps({f"&{k};": v for k, v in ENTITIES.items()})), "map<string,string>")
    return F.when(text.contains("&"), F.array_join(F.transform(runs, lambda x: F.when(x.startswith("&"), F.coalesce(F.try_element_at(table, x), x)).otherwise(x)), "")).otherwise(text)


def title(html: Column) -> Column:
    return F.nullif(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title", 1), F.lit(""))


def meta(html: Column) -> Column:
    """(name, content) of the meta elements that have both, in whatever order."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<meta\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>"), 0)
    value = lambda tag, name: F.regexp_replace(F.regexp_extract(tag, rf"""(?is)\s{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1), r"""^["']|["']$""", "")
    pairs = F.transform(tags, lambda t: F.struct(value(t, "name").alias("name"), value(t, "content").alias("content"), t.rlike(r"(?is)\scontent\s*=").alias("has")))
    return F.transform(F.filter(pairs, lambda m: (m["name"] != "") & m["has"]), lambda m: F.struct(m["name"].alias("name"), m["content"].alias("content")))


def list_entry(line: Column, now: str = "2026-01-01") -> Column:
    """One line of an FTP listing as struct(name, is_dir, size, mtime); name is null if it is no entry.

    Unix ``ls -l``, EPLF, MS-DOS and VMS forms are read natively. A date without a year is
    the latest that is at most 350 days after ``now``.
    """
    unix = r"^([-dlbcps])[-rwxsStT]{9}\s+\S+(?:\s+\S+){0,2}?\s+(\d+)\s+([A-Za-z]{3})\s+(\d{1,2})\s+(\d{4}|\d{1,2}:\d{2})\s(.+)$"
    u = lambda i: F.regexp_extract(line, unix, i)
    named = F.when(u(1) == "l", F.regexp_replace(u(6), r" -> .*$", "")).otherwise(u(6))
    month = F.array_position(F.array(*[F.lit(m) for m in "jan feb mar apr may jun jul aug sep oct nov dec".split()]), F.lower(u(3)))
    limit = F.date_add(F.lit(now).cast("date"), 350)
    guess = lambda y: F.try_make_timestamp(y, month.cast("int"), F.expr("1") * u(4).try_cast("int"), F.regexp_extract(u(5), r"^(\d+):", 1).try_cast("int"), F.regexp_extract(u(5), r":(\d+)$", 1).try_cast("int"), F.lit(0))
    year = F.year(limit)
    clock = F.when(guess(year) <= limit, guess(year)).otherwise(guess(year - 1))
    dated = F.try_make_timestamp(u(5).try_cast("int"), month.cast("int"), u(4).try_cast("int"), F.lit(0), F.lit(0), F.lit(0))
    eplf = r"^\+([^\t]*)\t(.+)$"
    facts, dos = F.regexp_extract(line, eplf, 1), r"^(\d{2})-(\d{2})-(\d{2,4})\s+(\d{2}):(\d{2})([AP]M)\s+(<DIR>|\d+)\s+(.+)$"
    d = lambda i: F.regexp_extract(line, dos, i)
    vms = r"^([^;]+?)(\.DIR)?;\d*\s+\S+\s+(\d{1,2})-([A-Za-z]{3})-(\d{4})\s+(\d{1,2}):(\d{2})"
    v = lambda i: F.regexp_extract(line, vms, i)
    months = F.array(*[F.lit(m) for m in "jan feb mar apr may jun jul aug sep oct nov dec".split()])
    vms_time = F.try_make_timestamp(v(5).try_cast("int"), F.array_position(months, F.lower(v(4))).cast("int"), v(3).try_cast("int"), v(6).try_cast("int"), v(7).try_cast("int"), F.lit(0))
    hour = F.pmod(d(4).try_cast("int"), F.lit(12)) + F.when(d(6) == "PM", 12).otherwise(0)
    full = F.when(F.length(d(3)) == 4, d(3).try_cast("int")).otherwise(d(3).try_cast("int") + F.when(d(3).try_cast("int") < 70, 2000).otherwise(1900))
    row = lambda name, is_dir, size, mtime: F.struct(F.nullif(name, F.lit("")).alias("name"), is_dir.alias("is_dir"), size.try_cast("long").alias("size"), mtime.cast("timestamp").alias("mtime"))
    none = F.lit(None).cast("timestamp")
    return (
        F.when(line.rlike(unix), row(named, u(1) == "d", u(2), F.when(u(5).contains(":"), clock).otherwise(dated)))
        .when(line.rlike(eplf), row(F.regexp_extract(line, eplf, 2), facts.rlike(r"(^|,)/"), F.regexp_extract(facts, r"(?:^|,)s(\d+)", 1), F.timestamp_seconds(F.regexp_extract(facts, r"(?:^|,)m(\d+)", 1).try_cast("long"))))
        .when(line.rlike(dos), row(d(8), d(7) == "<DIR>", d(7), F.try_make_timestamp(full, d(1).try_cast("int"), d(2).try_cast("int"), hour, d(5).try_cast("int"), F.lit(0))))
        .when(line.rlike(vms), row(v(1), v(2) != "", F.lit(None).cast("string"), vms_time))
        .otherwise(row(F.lit(""), F.lit(None).cast("boolean"), F.lit(None).cast("string"), none))
    )


def list_links(listing: Column) -> Column:
    """A link for each entry of an FTP listing; directories end in a slash."""
    entries = F.transform(F.split(listing, r"\r\n|\r|\n"), lambda x: list_entry(x))
    named = F.filter(entries, lambda e: e["name"].isNotNull() & ~e["name"].isin(".", ".."))
    return F.transform(named, lambda e: F.when(e["is_dir"], F.concat(e["name"], F.lit("/"))).otherwise(e["name"]))

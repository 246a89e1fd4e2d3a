"""HTML extraction by differencing pages with near URLs (operator 9).

1. The text lines of a page are taken from its whole HTML: scripts, styles, comments and
   the head go, block elements and ``<br>`` end a line, entities are decoded, blanks are
   collapsed and empty lines dropped.
2. Pages are ordered by host, path (with query) and page_id. A page is paired with the one
   before or after it on the same host whose path has the longer prefix in common with its
   own, the one before in a tie. A neighbour with exactly the same lines is a copy, says
   nothing about the template and isn't paired. A page that has no partner for that looks
   beyond its run of copies: at the nearest pages of the host, before and after, whose
   lines differ.
3. The lines of the two are aligned by a longest common subsequence, and the aligned lines
   are deleted from the page. Each page is judged by its own partner.

A host may hold any share of the pages: the order is cut into ranges of keys, not hosts.
The bounds come from a pass over the URLs alone. Another pass, over hashes of the lines,
finds the first and last page of every range, which are sent to the range beside theirs as
well, and past a run of copies that lies over a bound, the nearest page that differs, in
whatever range. So each page has its neighbours at hand, the result doesn't depend on the
bounds, and the text is shuffled just once.

Columns: ``page_id``, ``paired_with`` (page_id of the partner, null without one),
``n_lines``, ``n_shared`` and ``text``, the lines left.

Defined cases: scripts, styles and comments that aren't closed run to the end of the page.
A head ends at its end tag or at the first text or element that can't be in one; ``<svg/>``
and ``<template/>`` are empty, and of those never closed only the tag goes. A null HTML has no lines and an empty text; without lines there is nothing
to delete, so such a page doesn't look beyond its copies. A page whose URL is null or has
no host isn't paired. A null page_id comes first in the order. Repeated rows are copies of
each other and each reported. Extra columns are ignored. An empty table gives an empty
result.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.session import partitions_for

LEAST = -(1 << 63)
#: Rows that a range has at least, and keys that are drawn for each bound.
RANGE_ROWS, DRAWN = 64, 20

#: Comments and raw text, which alone run to the end of the page where they aren't closed.
_RAW = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript)(?![\w-]).*?(?:</\1\s*>|\Z)", re.S | re.I)
_EMPTY = re.compile(r"<(?:svg|template)(?![\w-])[^>]*/>", re.I)
_INNERMOST = re.compile(r"<(svg|template)(?![\w-])[^>]*>(?:(?!<\1(?![\w-])).)*?</\1\s*>", re.S | re.I)
#: A head with what can be in it; anything else ends it.
_HEAD = re.compile(
    r"<head(?![\w-])[^>]*>(?:\s+|<title(?![\w-])[^>]*>(?:.*?</title\s*>|[^<]*)"
    r"|</?(?:base|basefont|bgsound|link|meta|noframes|noscript|script|style|template|title)(?![\w-])[^>]*>|<[!?][^>]*>)*(?:</head\s*>)?",
    re.S | re.I,
)
_BREAK = re.compile(
    r"</?(?:address|article|aside|blockquote|body|br|button|caption|center|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]"
    r"|header|hr|html|li|main|nav|ol|option|p|pre|section|select|table|tbody|td|tfoot|th|thead|title|tr|ul)(?![\w-])[^>]*>",
    re.I,
)
_TAG = re.compile(r"<[/!?a-z][^>]*>", re.I)
_BLANKS = re.compile(r"[ \t\r\f\v\u0085   -​    　﻿]+")

_LINES = pa.schema([("part", pa.int32()), ("k", pa.string()), ("pid", pa.int64()), ("page_id", pa.int64()), ("text", pa.string()), ("mine", pa.bool_())])
_OUT = pa.schema([("page_id", pa.int64()), ("paired_with", pa.int64()), ("n_lines", pa.int64()), ("n_shared", pa.int64()), ("text", pa.string())])
_LINES_SQL = "part int, k string, pid long, page_id long, text string, mine boolean"
_OUT_SQL = "page_id long, paired_with long, n_lines long, n_shared long, text string"


def lines_of(html: str | None) -> list[str]:
    """The visible lines of a page."""
    if not html:
        return []
    x, nested = _EMPTY.sub("", _RAW.sub("", html)), 1
    while nested:
        x, nested = _INNERMOST.subn("", x)
    x = _HEAD.sub("", x).replace("\n", " ")
    x = unescape(_TAG.sub("", _BREAK.sub("\n", x)))
    return [y for y in (line.strip() for line in _BLANKS.sub(" ", x).split("\n")) if y]


def _lengths(a: list, b: list) -> list[int]:
    """LCS lengths of all of ``a`` with every prefix of ``b``, bit-parallel."""
    at: dict = {}
    for i, x in enumerate(b):
        at[x] = at.get(x, 0) | (1 << i)
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        u = v & at.get(x, 0)
        v = ((v + u) | (v - u)) & full
    out = [0]
    for bit in reversed(f"{v:0{len(b)}b}") if b else "":
        out.append(out[-1] + (bit == "0"))
    return out


def common(a: list, b: list) -> list[int]:
    """Places in ``a`` of a longest common subsequence with ``b``."""
    places, twins = range(len(a)), set(a) & set(b)
    places = [i for i in places if a[i] in twins]
    found = _align([a[i] for i in places], [x for x in b if x in twins])
    return [places[i] for i in found]


def _align(a: list, b: list) -> list[int]:
    found, todo = [], [(0, a, b)]
    while todo:  # Hirschberg's division, without recursion
        base, a, b = todo.pop()
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        m = 0
        while m < min(len(a), len(b)) - n and a[-1 - m] == b[-1 - m]:
            m += 1
        found += range(base, base + n)
        found += range(base + len(a) - m, base + len(a))
        a, b, base = a[n : len(a) - m], b[n : len(b) - m], base + n
        if not a or not b:
            continue
        if len(a) == 1:
            if a[0] in b:
                found.append(base)
            continue
        half = len(a) // 2
        up, down = _lengths(a[:half], b), _lengths(a[half:][::-1], b[::-1])
        at = max(range(len(b) + 1), key=lambda j: up[j] + down[len(b) - j])
        todo.append((base, a[:half], b[:at]))
        todo.append((base + half, a[half:], b[at:]))
    return sorted(found)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Lower-cased host ("" without one), and path with query."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _key(url: Column) -> Column:
    host, path = host_and_path(url)
    return F.concat(host, F.lit("\x01"), F.replace(path, F.lit("\x01"), F.lit("")))


def _spread(shared):
    """Pages to their lines, in their range and as a neighbour in the range beside it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds, beside = shared.value
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for k, page_id, html in zip(*(c.to_pylist() for c in batch.columns)):
                pid = LEAST if page_id is None else page_id
                text = "\n".join(lines_of(html))
                rows.append((bisect_right(bounds, k), k, pid, page_id, text, True))
                rows += [(p, k, pid, page_id, text, False) for p in beside.get((k, pid), ())]
                size += len(text)
                if size > 1 << 23:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows), _LINES)], schema=_LINES)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows), _LINES)], schema=_LINES)

    return run


def _near(a: str, b: str) -> int:
    """Length of the common prefix; -1 if the hosts differ or there is none."""
    host = a[: a.index("\x01") + 1]
    if len(host) == 1 or not b.startswith(host):
        return -1
    n = len(host)
    for x, y in zip(a[n:], b[n:]):
        if x != y:
            break
        n += 1
    return n


def differenced(before: tuple | None, page: tuple, after: tuple | None) -> tuple:
    """The result of one page; a page is (key, page_id, text)."""
    k, page_id, text = page
    best, partner = -1, None
    for other in (before, after):
        if other is not None and other[2] != text and (n := _near(k, other[0])) > best:
            best, partner = n, other
    mine = text.split("\n") if text else []
    if partner is None:
        return page_id, None, len(mine), 0, text
    shared = set(common(mine, partner[2].split("\n") if partner[2] else []))
    return page_id, partner[1], len(mine), len(shared), "\n".join(x for i, x in enumerate(mine) if i not in shared)


def _run_of_copies(before: tuple | None, run: list[tuple], text: str, after: tuple | None) -> Iterator[tuple]:
    """The results of neighbours with the same lines; of them (key, page_id, mine) is given."""
    near, found = [x if x is not None and _near(run[0][0], x[0]) >= 0 else None for x in (before, after)], {}
    for i, (k, page_id, mine) in enumerate(run):
        if not mine:
            continue
        first, last = (near[0] if i == 0 else None), (near[1] if i == len(run) - 1 else None)
        if first is None and last is None and text:
            first, last = near
        pick = None
        for other in (first, last):
            if other is not None and (pick is None or _near(k, other[0]) > _near(k, pick[0])):
                pick = other
        if id(pick) not in found:  # it is the same for all copies
            found[id(pick)] = differenced(pick, (k, page_id, text), None)
        yield (page_id, *found[id(pick)][1:])


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows: each run of copies with the page before and after."""

    def results() -> Iterator[tuple]:
        before, run, text, last = None, [], None, None
        for batch in batches:
            for k, page_id, x, mine in zip(*(batch.column(c).to_pylist() for c in ("k", "page_id", "text", "mine"))):
                if run and (x != text or _near(run[-1][0], k) < 0):
                    yield from _run_of_copies(before, run, text, (k, page_id, x))
                    before, run = last, []
                run.append((k, page_id, mine))
                text, last = x, (k, page_id, x)
        if run:
            yield from _run_of_copies(before, run, text, None)

    rows, size = [], 0
    for row in results():
        rows.append(row)
        size += 64 + len(row[4])
        if size > 1 << 23:
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows), _OUT)], schema=_OUT)
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows), _OUT)], schema=_OUT)


def _hash(k: str, text: str) -> bytes:
    """Of the host and the lines."""
    return blake2b(f"{k[: k.index(chr(1)) + 1]}{text}".encode(errors="surrogatepass"), digest_size=16).digest()


def _two(rows: list[tuple]) -> list[tuple]:
    """The first row, and the first that has another hash."""
    return rows[:1] + [x for x in rows if x[2] != rows[0][2]][:1]


def _ranges(keys: DataFrame, parts: int) -> tuple[list[str], dict[tuple[str, int], list[int]]]:
    """Bounds of about equal ranges, and to which other ranges pages go."""
    n = keys.count()
    parts = max(1, min(parts, n // RANGE_ROWS))
    every = max(1, n // (parts * DRAWN))
    drawn = sorted(r.k for r in keys.where(F.pmod(F.xxhash64("k", "pid"), F.lit(every)) == 0).select("k").collect())
    bounds = sorted({drawn[len(drawn) * i // parts] for i in range(1, parts)}) if drawn else []
    if not bounds:
        return [], {}

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[int, list[tuple]] = {}
        most: dict[int, list[tuple]] = {}
        for batch in batches:
            for k, pid, html in zip(*(c.to_pylist() for c in batch.columns)):
                p, row = bisect_right(bounds, k), (k, pid, _hash(k, "\n".join(lines_of(html))))
                least[p] = _two(sorted([row, *least.get(p, ())]))
                most[p] = _two(sorted([row, *most.get(p, ())], reverse=True))
        rows = [(p, last, *x) for last, of in ((False, least), (True, most)) for p, found in of.items() for x in found]
        cols = zip(*rows) if rows else [[]] * 5
        kinds = (pa.int32(), pa.bool_(), pa.string(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds)], ["part", "last", "k", "pid", "h"])

    # the least by hash of each task's rows; of them, at most two by range and end go to the driver
    found = keys.select("k", "pid", "html").mapInArrow(ends, "part int, last boolean, k string, pid long, h binary")
    row = F.struct("k", "pid", "h")
    by = found.groupBy("part", "last", "h").agg(F.min(row).alias("lo"), F.max(row).alias("hi")).groupBy("part", "last")
    by = by.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.collect_list(F.struct("lo", "hi")).alias("of"))
    others = F.filter("of", lambda x: x["lo"]["h"] != F.when(F.col("last"), F.col("hi")["h"]).otherwise(F.col("lo")["h"]))
    by = by.select("part", "last", "lo", "hi", F.array_min(F.transform(others, lambda x: x["lo"])).alias("lo2"), F.array_max(F.transform(others, lambda x: x["hi"])).alias("hi2"))
    first: dict[int, list] = {}
    final: dict[int, list] = {}
    for r in by.collect():
        (final if r["last"] else first)[r.part] = [tuple(x) for x in ((r.hi, r.hi2) if r["last"] else (r.lo, r.lo2)) if x is not None]
    beside: dict[tuple[str, int], list[int]] = {}

    def send(row: tuple, part: int) -> None:
        to = beside.setdefault(row[:2], [])
        if part not in to:
            to.append(part)

    order = sorted(first)
    for way, own, theirs in ((order, final, first), (order[::-1], first, final)):
        for i, p in enumerate(way[:-1]):
            send(theirs[way[i + 1]][0], p)
            for q in way[i + 1 :]:
                differ = [x for x in theirs[q] if x[2] != own[p][0][2]]
                if differ:
                    send(differ[0], p)
                    break
    return bounds, beside


def extract(pages: DataFrame) -> DataFrame:
    """The text of every page without the lines that it shares with its nearest page."""
    spark = pages.sparkSession
    parts = partitions_for(pages)
    keyed = pages.select(_key(F.col("url")).alias("k"), F.col("page_id").cast("long").alias("page_id"), "html")
    bounds, beside = _ranges(keyed.select("k", F.coalesce("page_id", F.lit(LEAST)).alias("pid"), "html"), parts)
    shared = spark.sparkContext.broadcast((bounds, beside))
    lines = keyed.mapInArrow(_spread(shared), _LINES_SQL).repartitionById(len(bounds) + 1, F.col("part"))
    return lines.sortWithinPartitions("k", "pid", "text").drop("part", "pid").mapInArrow(_stream, _OUT_SQL)

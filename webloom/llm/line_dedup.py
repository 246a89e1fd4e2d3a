"""Exact line deduplication by sorted hashes (operator 10).

Lines go as (128-bit hash, doc_id, position) to equal ranges of the hash, which is
uniform, so ranges need no sample. Each range is sorted by hash, document and position
and streamed: the first line of a hash is kept, the others are dropped. Only the places
of dropped lines travel on; the text is never shuffled and not part of the result.

Before that, each task sorts ``FLUSH`` lines at a time and sends only the first of each
hash among them to its range; the others can't be the first anywhere and are dropped at
once, so a line that a third of all documents have comes to its range once a flush. The
two halves of the hash have different seeds, so they don't collide together. The number
of ranges follows the bytes of the input.

Columns: ``doc_id``, ``n_lines`` and ``keep_runs``, the document's keep bitmap run-length
coded: lengths of alternating runs, a run of kept lines first (0 if the first line is
dropped). ``apply_runs`` restores the text.

Defined cases: lines are compared without blanks, tabs and carriage returns at their
ends; blank lines are always kept. A null doc_id is left out. A null text has no lines
and no runs; an empty text has one blank line. Rows with the same doc_id and text are
one document; with other texts each has its own row. Columns other than doc_id and text
are not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType

from webloom.session import partitions_for

FLUSH = 500_000
_LINE = pa.schema([("part", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("body", pa.int64()), ("pos", pa.int32()), ("known", pa.bool_())])
_LINE_SQL = "part int, h1 long, h2 long, doc_id long, body long, pos int, known boolean"
_DROP = pa.schema([("doc_id", pa.int64()), ("body", pa.int64()), ("pos", pa.int32())])


def _firsts(parts: int):
    """Lines (h1, h2, doc_id, body, pos) to ranges of the hash; those that another of the flush precedes are known to be dropped."""

    def flush(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        cols = [np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in batches]) for i in range(5)]
        order = np.lexsort(cols[::-1])
        h1, h2, doc, body, pos = (c[order] for c in cols)
        seen = np.r_[False, (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])] if len(h1) else np.empty(0, bool)
        # a row that is repeated isn't preceded by itself
        first = np.maximum.accumulate(np.where(seen, 0, np.arange(len(h1))))
        known = seen & ~((doc == doc[first]) & (body == body[first]) & (pos == pos[first]))
        # the top 24 bits of the hash, scaled to the number of ranges; known ones go by their document
        top = np.where(known, doc & 0xFFFFFF, (h1 >> 40) & 0xFFFFFF)
        h1, h2 = np.where(known, 0, h1), np.where(known, 0, h2)
        return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(((top * parts) >> 24, h1, h2, doc, body, pos, known), _LINE)], schema=_LINE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= FLUSH:
                yield flush(held)
                held, n = [], 0
        if n:
            yield flush(held)

    return run


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (known, h1, h2, doc_id, body, pos): those after the first of a hash, and the known ones."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, doc, body, pos, known = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        before = [np.r_[x[:1] if last is None else last[i], x[:-1]] for i, x in enumerate((h1, h2, doc, body, pos))]
        seen = (before[0] == h1) & (before[1] == h2)
        same = seen & (before[2] == doc) & (before[3] == body) & (before[4] == pos)  # the row repeated
        if last is None:
            seen[0] = same[0] = False
        last = tuple(x[-1:] for x in (h1, h2, doc, body, pos))
        # a repeated row takes the fate of the row it repeats; dropped places are a set in the end
        drop = known | (seen & ~same)
        yield pa.RecordBatch.from_arrays([pa.array(x[drop], t.type) for x, t in zip((doc, body, pos), _DROP)], schema=_DROP)


@pandas_udf(ArrayType(IntegerType()))
def _runs(n: pd.Series, dropped: pd.Series) -> pd.Series:
    out = []
    for lines, d in zip(n, dropped):
        d = np.asarray(d if d is not None else [], np.int64)
        if not len(d):
            out.append([int(lines)] if lines else [])
            continue
        cut = np.flatnonzero(np.diff(d) != 1)
        start, stop = d[np.r_[0, cut + 1]], d[np.r_[cut, len(d) - 1]] + 1
        edge = np.empty(2 * len(start) + 2, np.int64)
        edge[0], edge[1:-1:2], edge[2:-1:2], edge[-1] = 0, start, stop, lines
        run = np.diff(edge)
        out.append((run[:-1] if run[-1] == 0 else run).tolist())
    return pd.Series(out)


def hashes(line: Column) -> tuple[Column, Column]:
    """Two hashes of 64 bits; the second begins with another seed, rather than from the first hash."""
    return F.xxhash64(line), F.xxhash64(F.lit(1), line)


def line_dedup(docs: DataFrame) -> DataFrame:
    """A keep bitmap for every document."""
    docs = docs.select(F.col("doc_id").cast("long"), "text", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("body")).where("doc_id is not null")
    lines = docs.where("text is not null").select("doc_id", "body", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    line = F.expr("trim(BOTH ' \t\r' FROM line)")
    parts = partitions_for(docs)
    h1, h2 = hashes(F.col("line"))
    hashed = lines.select(line.alias("line"), "doc_id", "body", "pos").where("line != ''").select(h1.alias("h1"), h2.alias("h2"), "doc_id", "body", "pos")
    sent = hashed.mapInArrow(_firsts(parts), _LINE_SQL)
    ranges = sent.repartitionById(parts, F.col("part")).sortWithinPartitions("known", "h1", "h2", "doc_id", "body", "pos").drop("part")
    dropped = ranges.mapInArrow(_stream, "doc_id long, body long, pos int").groupBy("doc_id", "body").agg(F.sort_array(F.collect_set("pos")).alias("dropped"))
    n_lines = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)
    sizes = docs.groupBy("doc_id", "body").agg(F.max(n_lines).alias("n_lines"))
    return sizes.join(dropped, ["doc_id", "body"], "left").select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), _runs("n_lines", "dropped").alias("keep_runs"))


def apply_runs(text: Column, runs: Column) -> Column:
    """The text that a keep bitmap leaves."""
    ends = F.transform(F.sequence(F.lit(1), F.size(runs)), lambda i: F.aggregate(F.slice(runs, 1, i), F.lit(0), lambda a, x: a + x))
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda _, i: F.size(F.filter(ends, lambda e: e <= i)) % 2 == 0), "\n")


ORACLE = """
with l as (
  select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as pos from documents where doc_id is not null and text is not null
), f as (
  select doc_id, pos, trim(line, ' ' || chr(9) || chr(13)) = '' or row_number() over (partition by trim(line, ' ' || chr(9) || chr(13)) order by doc_id, pos) = 1 as keep from l
), g as (
  select doc_id, pos, keep, sum(case when keep = before then 0 else 1 end) over (partition by doc_id order by pos) as run
  from (select *, lag(keep) over (partition by doc_id order by pos) as before from f)
), r as (select doc_id, run, keep, count(*)::integer as n from g group by all),
t as (select doc_id, list(n order by run) as runs, arg_min(keep, run) as head, sum(n)::bigint as n_lines from r group by doc_id)
select d.doc_id, coalesce(t.n_lines, 0) as n_lines,
  case when t.doc_id is null then []::integer[] when head then runs else list_prepend(0::integer, runs) end as keep_runs
from documents d left join t on t.doc_id = d.doc_id where d.doc_id is not null
"""

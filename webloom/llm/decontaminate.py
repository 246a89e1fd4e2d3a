"""Benchmark decontamination by size-partitioned MinHash containment search (operator 4).

An item's signature is a bottom-k MinHash: the k least hashes of its set of word shingles.
k depends on the item's size: a document that holds a share t of an item's q shingles holds
c = ceil(t q) of them, so of any q - c + 1 it holds one at least. With k = q - c + 1 no pair
is missed, however short the item and however long the document; a signature has about a
share 1 - t of the set.

Items are partitioned by c in powers of two. A document of n shingles looks into the
partitions up to n, with its own signature there: its hashes up to the largest that any
signature of the partition has. One common hash makes a candidate, and candidates are
verified by the exact containment of the item's shingles.

One pass over the documents; nothing is shuffled. The items go to the executors as a
broadcast whose size is bounded: a benchmark of more than ``BLOCK_ITEMS`` items or
``BLOCK_BYTES`` of text is searched in several blocks, each a pass.

Columns of ``contained``: ``doc_id``, ``item_id``, ``containment``: every pair in which
``threshold`` or more of the item's shingles are in the document. ``clean`` returns the
rows of the documents without any such pair.

Defined cases: a null text, or one without words, contains and is contained in nothing.
An item or document of fewer than n words is one shingle, so such an item is found only in
a document of the same words: a few words alone don't tell a leak. Null ids are reported as null.
Repeated rows are each reported. Extra columns are ignored, and kept by ``clean``.
Empty tables give an empty result, and no item leaves every document clean.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StructField, StructType

from webloom.llm import textvec

N = 5
THRESHOLD = 0.6
BLOCK_ITEMS, BLOCK_BYTES = 50_000, 64 << 20
_HIT = StructType([StructField("item", IntegerType()), StructField("containment", DoubleType())])


def signature(s: np.ndarray, threshold: float) -> np.ndarray:
    """Of an item's sorted distinct hashes, as many of the least as no document with its share can lack."""
    return s[: len(s) - needed(len(s), threshold) + 1]


def needed(n: int, threshold: float) -> int:
    """How many of n shingles make the share."""
    return max(1, int(np.ceil(threshold * n - 1e-9)))


class Index:
    """The items' shingle sets and, by partition, their signatures."""

    def __init__(self, texts: pa.Array, n: int, threshold: float):
        self.n, self.threshold, self.sets = n, threshold, list(shingle_sets(texts, n))
        by: dict[int, list[int]] = {}
        for i, s in enumerate(self.sets):
            if len(s):
                by.setdefault(needed(len(s), threshold).bit_length() - 1, []).append(i)
        #: (least size of a document, hashes in order, their items)
        self.partitions: list[tuple[int, np.ndarray, np.ndarray]] = []
        for p, items in sorted(by.items()):
            kept = [signature(self.sets[i], threshold) for i in items]
            values, of = np.concatenate(kept), np.repeat(np.array(items, np.int64), [len(x) for x in kept])
            order = np.argsort(values, kind="stable")
            self.partitions.append((1 << p, values[order], of[order]))

    def candidates(self, h: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Distinct (document, item), as rows, of documents whose shingles lie between the offsets."""
        pairs = [np.empty((0, 2), np.int64)]
        sizes = np.diff(at)
        for least, values, items in self.partitions:
            mine = np.flatnonzero(h <= values[-1])  # the documents' signatures
            lo = np.searchsorted(values, h[mine])
            hit = values[np.minimum(lo, len(values) - 1)] == h[mine]
            mine, lo = mine[hit], lo[hit]
            doc = np.searchsorted(at, mine, "right") - 1
            large = sizes[doc] >= least
            doc, lo = doc[large], lo[large]
            many = np.searchsorted(values, values[lo], "right") - lo
            step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            pairs.append(np.stack([np.repeat(doc, many), items[np.repeat(lo, many) + step]], 1))
        return np.unique(np.concatenate(pairs), axis=0)

    def search(self, texts: pa.Array) -> Iterator[tuple[int, list[int], list[int], list[float]]]:
        """For each slice of the texts: how many, and the document, item and containment of what they contain."""
        for _, part in textvec.slices(texts):
            h, at = textvec.words(part)
            h, at = textvec.grams(h, at, self.n)
            docs, items, shares, last, s = [], [], [], -1, h
            for d, i in self.candidates(h, at).tolist():
                if d != last:
                    last, s = d, np.unique(h[at[d] : at[d + 1]])
                mine = self.sets[i]
                place = np.minimum(np.searchsorted(s, mine), len(s) - 1)
                share = float((s[place] == mine).sum()) / len(mine)
                if share >= self.threshold:
                    docs.append(d)
                    items.append(i)
                    shares.append(share)
            yield len(part), docs, items, shares


def shingle_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    for _, part in textvec.slices(texts):
        h, at = textvec.words(part)
        g, at = textvec.grams(h, at, n)
        for i in range(len(part)):
            yield np.unique(g[at[i] : at[i + 1]])


def _blocks(benchmark: DataFrame, n: int, threshold: float) -> Iterator[tuple[list, Index]]:
    items = benchmark.select("item_id", F.lower("text").alias("text"))
    many, size = items.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    blocks = max(1, -(-many // BLOCK_ITEMS), -(-(size or 0) // BLOCK_BYTES))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    for b in range(blocks):
        rows = (items if blocks == 1 else items.where(block == b)).collect()
        yield [r.item_id for r in rows], Index(pa.array([r.text for r in rows], pa.large_string()), n, threshold)


def _searcher(shared):
    @arrow_udf(ArrayType(_HIT))
    def search(texts: pa.Array) -> pa.Array:
        off, items, shares = [np.zeros(1, np.int64)], [], []
        for n, docs, mine, found in shared.value.search(texts):
            off.append(off[-1][-1] + np.cumsum(np.bincount(np.array(docs, np.int64), minlength=n)))
            items += mine
            shares += found
        textvec.release()
        hits = pa.StructArray.from_arrays([pa.array(items, pa.int32()), pa.array(shares, pa.float64())], ["item", "containment"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate(off).astype(np.int32)), hits)

    return search


def _leaks(shared):
    @arrow_udf(BooleanType())
    def leaks(texts: pa.Array) -> pa.Array:
        out = [np.empty(0, bool)]
        for n, docs, _, _ in shared.value.search(texts):
            out.append(np.bincount(np.array(docs, np.int64), minlength=n) > 0)
        textvec.release()
        return pa.array(np.concatenate(out))

    return leaks


def contained(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, n: int = N) -> DataFrame:
    """Pairs of a document and an item that it contains."""
    spark, out = docs.sparkSession, None
    named = StructType([StructField("item", IntegerType()), StructField("item_id", benchmark.schema["item_id"].dataType)])
    for ids, index in _blocks(benchmark, n, threshold):
        search = _searcher(spark.sparkContext.broadcast(index))
        names = spark.createDataFrame(list(enumerate(ids)), named)
        hits = docs.select("doc_id", F.explode(search(F.lower("text"))).alias("h")).select("doc_id", "h.*")
        part = hits.join(F.broadcast(names), "item").select("doc_id", "item_id", "containment")
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, n: int = N) -> DataFrame:
    """The rows of documents that contain no item, in one filter per block of items."""
    for _, index in _blocks(benchmark, n, threshold):
        leaks = _leaks(docs.sparkSession.sparkContext.broadcast(index))
        docs = docs.where(~leaks(F.lower("text")))
    return docs


ORACLE = f"""
with w as (
  select 'd' as kind, doc_id as id, list_filter(string_split_regex(lower(text), '[{textvec.SEPARATORS}]+'), lambda x: x <> '') as ws from documents
  union all
  select 'b', item_id, list_filter(string_split_regex(lower(text), '[{textvec.SEPARATORS}]+'), lambda x: x <> '') from benchmark
), g as (
  select kind, id, unnest(case when len(ws) >= {N} then list_distinct(list_transform(range(1, len(ws) - {N - 2}), lambda i: array_to_string(ws[i:i+{N - 1}], ' '))) else [array_to_string(ws, ' ')] end) as s
  from w where len(ws) > 0
), n as (select id, count(*) as n from g where kind = 'b' group by id)
select d.id as doc_id, b.id as item_id, count(*) / any_value(n.n) as containment
from g d join g b on d.s = b.s and d.kind = 'd' and b.kind = 'b' join n on n.id = b.id
group by d.id, b.id having count(*) / any_value(n.n) >= {THRESHOLD}
"""

"""Quality classifier by importance resampling (operator 8).

Two bags of hashed grams are estimated, one of target text (documents labelled good)
and one of the raw text (all documents). Grams are single tokens and pairs, tokens being
words and runs of punctuation; a pair whose second token repeats one of the two tokens
before is counted as a repeat instead, whatever the token. The log importance weight of a
document is the sum over its grams of log p(gram) - log q(gram).

Documents are drawn without replacement in proportion to their importance weights by
Gumbel top-k: key = log weight + Gumbel noise of the seed and doc_id, and the k largest
keys are kept. ``k`` is given, or the number of documents whose log weight is above a
cut: the value that best tells good from bad on labelled documents that the target model
hasn't seen. Log weights of long texts lie hundreds apart, so for those the noise hardly
matters; it decides between documents whose weights are within a few units.

Bound: of the labels, the ``LABELLED`` rows with the least hashes are used to fit (half
for the target model, half for the cut). The raw model counts every gram of every
document. The table of buckets grows with the input, by one bit each time its bytes grow
fourfold beyond ``BYTES`` (distinct grams grow about as the square root of a text). The
k-th largest key is found exactly by counting keys in ranges.

Columns of ``resample``: ``doc_id``, ``log_weight``, of the kept documents. ``kept``
returns the rows of the input.

Defined cases: texts that are null or have no token are rejected. A null doc_id has the
noise of id 0. Rows that repeat a doc_id and text share their fate, and all rows with the
key of the k-th are kept. Without labels of both kinds there is no cut: everything with a
token is kept. Very long texts are weighed whole; the training rows are whole texts too.
Extra columns are ignored, and kept by ``kept``, whatever their names. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from webloom.llm import textvec
from webloom.session import cut as write_cut
from webloom.session import input_bytes, unused

BITS, BYTES = 15, 1 << 30
LABELLED = 20_000
SEED = 8
_COUNT = pa.schema([("b", pa.int32()), ("raw", pa.int64()), ("target", pa.int64())])


def bits_for(size: int) -> int:
    """Bits of the bucket table for an input of so many bytes."""
    return BITS + max(0, -(-((size - 1) // BYTES).bit_length() // 2)) if size > BYTES else BITS


def gram_buckets(texts: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every gram, and for each text the offset of its first."""
    h, at = textvec.words(texts, punctuation=True)
    n = len(h)
    if not n:
        return np.empty(0, np.int64), at
    first = np.zeros(n, bool)
    first[at[:-1][np.diff(at) > 0]] = True
    back1 = np.r_[np.uint64(0), h[:-1]]
    back2 = np.r_[np.zeros(min(2, n), np.uint64), h[:-2]] if n > 1 else np.zeros(1, np.uint64)
    second = np.r_[False, first[:-1]]
    pair = (textvec.mix(back1 * np.uint64(0x9E3779B97F4A7C15) + h) >> np.uint64(64 - bits)).astype(np.int64)
    pair[h == back1] = 1 << bits
    pair[(h == back2) & (h != back1) & ~second] = (1 << bits) + 1
    out = np.empty((n, 2), np.int64)
    out[:, 0] = h >> np.uint64(64 - bits)
    out[:, 1] = np.where(first, -1, pair)
    flat = out.ravel()
    flat = flat[flat >= 0]
    sizes = np.diff(at)
    to = np.zeros(len(at), np.int64)
    np.cumsum(np.where(sizes > 0, 2 * sizes - 1, 0), out=to[1:])
    return flat, to


def _counter(bits: int):
    buckets = (1 << bits) + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            good = batch.column(1).to_numpy(zero_copy_only=False)
            for at, part in textvec.slices(batch.column(0)):
                b, to = gram_buckets(part, bits)
                raw += np.bincount(b, minlength=buckets)
                mine = np.repeat(good[at : at + len(part)], np.diff(to))
                if mine.any():
                    target += np.bincount(b[mine], minlength=buckets)
        some = np.flatnonzero(raw)
        textvec.release()
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(raw[some]), pa.array(target[some])], schema=_COUNT)

    return run


@dataclass
class Model:
    ratio: np.ndarray
    bits: int = BITS
    cut: float = -np.inf

    def weigh(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Log weight and number of grams of each text."""
        weight, grams = [np.empty(0)], [np.empty(0, np.int64)]
        for _, part in textvec.slices(texts):
            b, to = gram_buckets(part, self.bits)
            total = np.r_[0.0, np.cumsum(self.ratio[b])]
            weight.append(total[to[1:]] - total[to[:-1]])
            grams.append(np.diff(to))
        return np.concatenate(weight), np.concatenate(grams)


def _weigher(shared):
    kind = StructType([StructField("w", DoubleType()), StructField("n", LongType())])

    @arrow_udf(kind)
    def weigh(texts: pa.Array) -> pa.Array:
        w, n = shared.value.weigh(texts)
        textvec.release()
        return pa.StructArray.from_arrays([pa.array(w, pa.float64()), pa.array(n, pa.int64())], ["w", "n"])

    return weigh


def best_cut(good: np.ndarray, bad: np.ndarray) -> float:
    """The value that best parts good from bad (balanced accuracy), in the middle of the best gap."""
    if not len(good) or not len(bad):
        return -np.inf
    x = np.r_[good, bad]
    order = np.argsort(x, kind="stable")
    x, is_bad = x[order], np.r_[np.zeros(len(good)), np.ones(len(bad))][order]
    below = np.r_[0, np.cumsum(is_bad)] / len(bad) - np.r_[0, np.cumsum(1 - is_bad)] / len(good)
    place = np.r_[x[0] - 1, (x[1:] + x[:-1]) / 2, x[-1] + 1]
    below[1:-1][x[1:] == x[:-1]] = -np.inf
    gap = np.r_[0, np.diff(x), 0]
    top = np.flatnonzero(below >= below.max() - 1e-12)
    return float(place[top[np.argmax(gap[top])]])


def fit(docs: DataFrame, labels: DataFrame, limit: int = LABELLED) -> Model:
    """The gram ratios over all documents, and the cut."""
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min("quality").alias("q"))
    known = known.withColumn("h", F.xxhash64(F.lit(SEED), "id")).orderBy("h", "id").limit(limit)
    known = write_cut(known.select("id", "q", (F.pmod("h", F.lit(2)) == 0).alias("seen")), "quality-labels")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    bits = bits_for(input_bytes(docs))
    marked = texts.join(F.broadcast(known), "id", "left")
    counts = marked.select("text", F.coalesce((F.col("q") > 0) & F.col("seen"), F.lit(False)).alias("good")).mapInArrow(_counter(bits), "b int, raw long, target long")
    got = counts.groupBy("b").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    buckets = (1 << bits) + 2
    raw, target = np.zeros(buckets), np.zeros(buckets)
    raw[got["b"]], target[got["b"]] = got["raw"], got["target"]
    if not target.sum():
        return Model(np.zeros(buckets), bits)
    q = (raw + 1) / (raw.sum() + buckets)
    p = (target + buckets * q) / (target.sum() + buckets)  # the raw model weighs as much as one gram per bucket
    model = Model(np.log(p) - np.log(q), bits)
    weigh = _weigher(docs.sparkSession.sparkContext.broadcast(model))
    held = texts.join(F.broadcast(known.where("not seen")), "id").select("q", weigh("text").alias("s")).where("s.n > 0")
    seen = held.select("q", F.col("s.w").alias("x")).toPandas()
    model.cut = best_cut(seen["x"][seen["q"] > 0].to_numpy(), seen["x"][seen["q"] <= 0].to_numpy())
    return model


def gumbel(seed: int) -> Column:
    """Noise of the seed and doc_id."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("long"), F.lit(0))), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def kth_largest(keys: DataFrame, col: str, k: int, few: int = 10_000) -> float:
    """Exactly the k-th largest value (inf if k is 0), by counting in ever smaller ranges."""
    if k <= 0:
        return float("inf")
    lo, hi, n = keys.agg(F.min(col), F.max(col), F.count(col)).first()
    if n <= k:
        return float("-inf")
    while n > few and lo < hi:
        here = keys.where(F.col(col).between(lo, hi))
        b = F.floor((F.col(col) - lo) / (hi - lo) * 1024)
        for r in here.groupBy(b.alias("b")).agg(F.count("*").alias("n"), F.min(col).alias("lo"), F.max(col).alias("hi")).orderBy(F.desc("b")).collect():
            if r.n >= k:
                lo, hi, n = r.lo, r.hi, r.n
                break
            k -= r.n
    if lo == hi:
        return lo
    top = sorted((r[0] for r in keys.where(F.col(col).between(lo, hi)).select(col).collect()), reverse=True)
    return top[k - 1]


def drawn(weighed: DataFrame, weight: str, k: int, seed: int = SEED) -> DataFrame:
    """The rows of the k largest keys of a written table with doc_id and log weights."""
    (key,) = unused(weighed, "key")
    keys = weighed.withColumn(key, F.col(weight) + gumbel(seed))
    return keys.where(F.col(key) >= F.lit(kth_largest(keys.select(key), key, k))).drop(key)


def _weighed(docs: DataFrame, labels: DataFrame, columns: list[str], weight: str) -> tuple[DataFrame, float]:
    """The rows that have a token with their log weights, written once, and the cut."""
    model = fit(docs, labels)
    weigh = _weigher(docs.sparkSession.sparkContext.broadcast(model))
    rows = docs.select(F.struct(*columns).alias("row"), weigh(F.lower("text")).alias("s")).where("s.n > 0")
    return write_cut(rows.select("row.*", F.col("s.w").alias(weight)), "quality-weights"), model.cut


def _many(weighed: DataFrame, weight: str, cut: float, k: int | None) -> int:
    return k if k is not None else weighed.where(F.col(weight) > F.lit(cut)).count()


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = SEED) -> DataFrame:
    """doc_id and log weight of the documents that the Gumbel top-k keeps."""
    weighed, cut = _weighed(docs, labels, ["doc_id"], "log_weight")
    return drawn(weighed, "log_weight", _many(weighed, "log_weight", cut, k), seed)


def kept(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = SEED) -> DataFrame:
    """The rows that the Gumbel top-k keeps; they are written with their weights, so texts are weighed once and not shuffled."""
    (weight,) = unused(docs, "log_weight")
    weighed, cut = _weighed(docs, labels, docs.columns, weight)
    return drawn(weighed, weight, _many(weighed, weight, cut, k), seed).select(*docs.columns)

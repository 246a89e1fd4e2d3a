"""Toxicity by non-negative positive-unlabelled learning (operator 3).

A linear classifier trained in numpy from confirmed toxic documents (P) and unlabelled
text (U, which is every document), without any confirmed clean text. With class prior pi
and logistic loss l, the risk is

    pi E_P[l(z)] + max(0, E_U[l(-z)] - pi E_P[l(-z)])

The second part estimates the risk of the negatives inside U; where it falls below zero
the model overfits, and the step goes the other way (Kiryo et al., 2017). The prior is
given, or the share of toxic rows among all labels.

Features are hashed words and word beginnings of ``STEMS`` bytes, so inflected forms of a
word speak for one another. A feature's value is log(1 + count), over the fourth root of
the document's sum of squares, times a scale. The scale is min(|s|, ``TOP``)**2 / ``TOP``**2,
s being the standard score of the number of toxic documents with the feature against its
frequency in all documents: a word of one toxic document says little, a word that many
have says much, in both directions. Features with |s| below ``LEAST_SCORE`` are zero.

1. One pass counts, over all documents, how many have each feature, and how many toxic.
2. A second pass writes every document's features as packed bytes in the shared folder.
3. ``STEPS`` full-batch steps with Nesterov momentum: each task adds up its documents'
   gradients in numpy, and the sums of chunks of features are added up by chunk. No
   document is left out or sampled, and the driver only has sums by feature.
4. Scores come from the packed features.

Columns: ``doc_id``, ``score`` (probability of the class) and ``toxic`` (score over 0.5).

Defined cases: a text that is null or without words has a null score and isn't toxic.
Null ids are scored too. Rows that repeat a doc_id are each scored; in the labels, any
toxic row makes it toxic, and all rows of the document count. Without a toxic label of a
document in the table nothing is toxic and scores are null. A prior of one (all labels
toxic) is taken as 0.999. Extra columns are ignored, whatever their names. Very long
texts are cut into pieces for counting only. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import DoubleType

from webloom.llm import textvec
from webloom.session import cut, input_bytes, maybe_broadcast, unused

BITS = 18
STEMS = (5, 7)
TOP, LEAST_SCORE = 5.0, 0.5
STEPS, RATE, DECAY = 24, 16.0, 2e-4
CHUNK, TASK_BYTES = 4096, 128 << 20
_COUNTS = pa.schema([("b", pa.int32()), ("n", pa.int64()), ("p", pa.int64())])
_PACKED = pa.schema([("doc_id", pa.int64()), ("pos", pa.bool_()), ("norm", pa.float32()), ("b", pa.large_binary()), ("c", pa.large_binary())])
_SUMS = pa.schema([("chunk", pa.int32()), ("body", pa.binary())])


def features(part: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, count) of the distinct features of some texts, in order."""
    h, at = textvec.words(part, stems=STEMS)
    doc = np.repeat(np.arange(len(part), dtype=np.int64), np.diff(at)) << BITS
    keys = [doc | (h[0] >> np.uint64(64 - BITS)).astype(np.int64)]
    for k, stem in enumerate(h[1:], 1):
        longer = stem != h[0]
        b = textvec.mix(stem[longer] + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> np.uint64(64 - BITS)
        keys.append(doc[longer] | b.astype(np.int64))
    key = np.sort(np.concatenate(keys))
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
    return key[first] >> BITS, key[first] & ((1 << BITS) - 1), np.diff(np.r_[first, len(key)])


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many documents have each feature, and how many toxic ones; in bucket -1 the documents with any."""
    n, p, docs, toxic = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64), 0, 0
    for batch in batches:
        pos = batch.column(1).to_numpy(zero_copy_only=False)
        for at, part in textvec.slices(batch.column(0)):
            doc, b, _ = features(part)
            mine = pos[at : at + len(part)]
            n += np.bincount(b, minlength=len(n))
            p += np.bincount(b[mine[doc]], minlength=len(n))
            some = np.unique(doc)
            docs, toxic = docs + len(some), toxic + int(mine[some].sum())
    some = np.flatnonzero(n)
    textvec.release()
    cols = np.r_[-1, some], np.r_[docs, n[some]], np.r_[toxic, p[some]]
    yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(cols, _COUNTS)], schema=_COUNTS)


def scales(n: np.ndarray, p: np.ndarray, docs: int, toxic: int) -> np.ndarray:
    """The scale of every feature, from its documents and toxic documents."""
    q = n / docs
    s = np.abs(p - toxic * q) / np.sqrt(toxic * q * (1 - q) + 1)
    return np.where(s < LEAST_SCORE, 0, np.minimum(s, TOP) ** 2 / TOP**2)


def _packer(shared):
    """Documents to the places of their features among the active ones, and the counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = shared.value
        for batch in batches:
            for at, part in textvec.slices(batch.column(0)):
                doc, b, c = features(part)
                norm = np.bincount(doc, np.log1p(c) ** 2, len(part)) ** 0.25
                on = place[b] >= 0
                doc, b, c = doc[on], place[b[on]].astype(np.uint32), np.minimum(c[on], 65535).astype(np.uint16)
                off = np.searchsorted(doc, np.arange(len(part) + 1))
                packed = [pa.Array.from_buffers(pa.large_binary(), len(part), [None, pa.py_buffer(off * x.itemsize), pa.py_buffer(x)]) for x in (b, c)]
                cols = [batch.column(2).slice(at, len(part)), batch.column(1).slice(at, len(part)), pa.array(norm, pa.float32()), *packed]
                yield pa.RecordBatch.from_arrays(cols, schema=_PACKED)
        textvec.release()

    return run


def _bytes_of(a: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All values of a packed column, and how many each row has."""
    a = a.cast(pa.large_binary())
    _, off, data = a.buffers()
    o = np.frombuffer(off, np.int64, len(a) + 1, a.offset * 8)
    size = np.dtype(kind).itemsize
    return np.frombuffer(data, np.uint8)[o[0] : o[-1]].view(kind) if o[-1] > o[0] else np.empty(0, kind), np.diff(o) // size


def unpacked(norm: pa.Array, b: pa.Array, c: pa.Array, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, value) of the features of packed documents."""
    at, many = _bytes_of(b, np.uint32)
    times, _ = _bytes_of(c, np.uint16)
    row = np.repeat(np.arange(len(b)), many)
    over = 1 / np.maximum(norm.to_numpy(zero_copy_only=False).astype(np.float64), 1e-12)
    return row, at.astype(np.int64), np.log1p(times.astype(np.float64)) * scale[at] * over[row]


@dataclass
class Model:
    """Weights of the active features, their scales, and the offset."""

    weight: np.ndarray
    scale: np.ndarray
    bias: float

    def margins(self, row: np.ndarray, at: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(row, x * self.weight[at], n) + self.bias


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def sums(model: Model, pos: np.ndarray, row: np.ndarray, at: np.ndarray, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of some documents: the sums of the gradients of l(-z) over all and over the toxic (weights, then offset), and of their losses, with the counts.

    The gradient of l(z) is that of l(-z) less the features, so it needn't be added up anew.
    """
    z, size = model.margins(row, at, x, n), len(model.weight)
    d, some = sigmoid(z), np.flatnonzero(pos[row])
    of_all = np.r_[np.bincount(at, x * d[row], size), d.sum()]
    of_toxic = np.r_[np.bincount(at[some], x[some] * d[row[some]], size), d[pos].sum()]
    return of_all, of_toxic, np.array([np.logaddexp(0, z).sum(), np.logaddexp(0, -z[pos]).sum(), np.logaddexp(0, z[pos]).sum(), n, pos.sum()])


def step(all_: np.ndarray, toxic: np.ndarray, losses: np.ndarray, features: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """The risk and the direction of a step (the gradient, or away from that of a negative part below zero); ``features`` are the toxic documents' sums."""
    n, p = losses[3], max(1.0, losses[4])
    rest = losses[0] / n - prior * losses[2] / p
    of_rest = all_ / n - prior * toxic / p
    of_toxic = prior * (toxic - features) / p
    return prior * losses[1] / p + max(0.0, rest), of_toxic + of_rest if rest >= 0 else -of_rest


def _adder(shared):
    """Packed documents to their sums, in chunks of features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        total: list | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            row, at, x = unpacked(batch.column(1), batch.column(2), batch.column(3), model.scale)
            pos = batch.column(0).to_numpy(zero_copy_only=False)
            part = sums(model, pos, row, at, x, batch.num_rows)
            total = list(part) if total is None else [a + b for a, b in zip(total, part)]
        if total is not None:
            m = np.stack(total[:2])
            rows = [(-1, total[2].tobytes())] + [(i, m[:, i * CHUNK : (i + 1) * CHUNK].astype(np.float32).tobytes()) for i in range(-(-m.shape[1] // CHUNK))]
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows), _SUMS)], schema=_SUMS)

    return run


def _added(table: pa.Table) -> pa.Table:
    """The sum of the bodies of one chunk."""
    kind = np.float64 if table.column("chunk")[0].as_py() < 0 else np.float32
    total = sum(np.frombuffer(b, kind).astype(np.float64) for b in table.column("body").to_pylist())
    return pa.Table.from_arrays([table.column("chunk").slice(0, 1), pa.array([total.tobytes()], pa.binary())], schema=_SUMS)


def train(gather: Callable[[Model], tuple[np.ndarray, np.ndarray, np.ndarray]], scale: np.ndarray, prior: float, squares: float, steps: int = STEPS, rate: float = RATE, decay: float = DECAY) -> Model:
    """Nesterov steps on the risk; ``squares`` is the mean sum of squares of a toxic document's features."""
    size = len(scale)
    rate, decay = rate / max(squares, 1e-9), 4 * decay * squares / rate
    w = np.r_[np.zeros(size), np.log(prior / (1 - prior))]
    move, pace = np.zeros(size + 1), np.r_[np.full(size, rate), 0.1 * rate]
    pace[-1] = min(pace[-1], 4.0)
    features = 2 * gather(Model(np.zeros(size), scale, 0.0))[1]  # there the sigmoid is a half
    for t in range(1, steps + 1):
        ahead = w + (t - 1) / (t + 2) * move
        _, g = step(*gather(Model(ahead[:-1], scale, float(ahead[-1]))), features, prior)
        after = ahead - pace * (g + np.r_[decay * ahead[:-1], 0])
        move, w = after - w, after
    return Model(w[:-1], scale, float(w[-1]))


def _gatherer(packed: DataFrame):
    spark = packed.sparkSession
    # every task sends sums of all features, so few large tasks send less than many small ones
    tasks = max(2 * spark.sparkContext.defaultParallelism, -(-input_bytes(packed) // TASK_BYTES))
    packed = packed.coalesce(tasks)

    def gather(model: Model):
        shared = spark.sparkContext.broadcast(model)
        found = packed.where("norm > 0").select("pos", "norm", "b", "c").mapInArrow(_adder(shared), "chunk int, body binary")
        got = found.groupBy("chunk").applyInArrow(_added, "chunk int, body binary").toArrow()
        parts = dict(zip(got.column("chunk").to_pylist(), got.column("body").to_pylist()))
        m = np.concatenate([np.frombuffer(parts[i], np.float64).reshape(2, -1) for i in range(len(parts) - 1)], axis=1)
        shared.destroy()
        return m[0], m[1], np.frombuffer(parts[-1], np.float64)

    return gather


def fit(docs: DataFrame, labels: DataFrame, prior: float | None = None, steps: int = STEPS) -> tuple[Model, DataFrame] | None:
    """The model and the packed documents; None without a toxic document."""
    spark = docs.sparkSession
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("t"))
    known = cut(known, "toxic-labels")
    share, n_toxic = known.agg(F.avg("t"), F.sum("t")).first()
    if not n_toxic:
        return None
    pi = min(0.999, float(share) if prior is None else prior)
    texts = docs.select(F.lower(F.coalesce("text", F.lit(""))).alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
    (flag,) = unused(texts, "pos")
    positive = known.where("t = 1").select(F.col("id").alias("doc_id"), F.lit(True).alias(flag))
    marked = texts.join(maybe_broadcast(positive, 24), "doc_id", "left").select("text", F.coalesce(flag, F.lit(False)).alias("pos"), "doc_id")
    got = marked.select("text", "pos").mapInArrow(_counter, "b int, n long, p long").groupBy("b").agg(F.sum("n").alias("n"), F.sum("p").alias("p")).toArrow()
    b, n, p = (got.column(c).to_numpy() for c in ("b", "n", "p"))
    total = b == -1
    if not total.any() or not p[total][0]:
        return None  # none of the toxic documents is in the table, or none has a word
    scale = np.zeros(1 << BITS)
    scale[b[~total]] = scales(n[~total], p[~total], int(n[total][0]), int(p[total][0]))
    active = np.flatnonzero(scale)
    place = np.full(1 << BITS, -1, np.int32)
    place[active] = np.arange(len(active))
    packed = cut(marked.mapInArrow(_packer(spark.sparkContext.broadcast(place)), "doc_id long, pos boolean, norm float, b binary, c binary"), "toxic-features")
    shared = spark.sparkContext.broadcast(scale[active])

    @arrow_udf(DoubleType())
    def squares(norm: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
        row, _, x = unpacked(norm, b, c, shared.value)
        return pa.array(np.bincount(row, x * x, len(b)))

    mean = packed.where("pos and norm > 0").select(F.avg(squares("norm", "b", "c"))).first()[0]
    return train(_gatherer(packed), scale[active], pi, float(mean), steps), packed


def _scorer(shared):
    @arrow_udf(DoubleType())
    def score(norm: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
        model = shared.value
        row, at, x = unpacked(norm, b, c, model.scale)
        z = model.margins(row, at, x, len(b))
        return pa.array(np.where(norm.to_numpy(zero_copy_only=False) > 0, sigmoid(z), np.nan), pa.float64(), from_pandas=True)

    return score


def toxicity(docs: DataFrame, labels: DataFrame, prior: float | None = None) -> DataFrame:
    """Score and verdict for every document."""
    found = fit(docs, labels, prior)
    if found is None:
        return docs.select("doc_id", F.lit(None).cast("double").alias("score"), F.lit(False).alias("toxic"))
    model, packed = found
    score = _scorer(docs.sparkSession.sparkContext.broadcast(model))
    return packed.select("doc_id", score("norm", "b", "c").alias("score")).select("doc_id", "score", (F.coalesce("score", F.lit(0.0)) > 0.5).alias("toxic"))

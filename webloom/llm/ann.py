"""Approximate nearest neighbours: inverted file with product-quantised residuals (operator 5).

1. Coarse centroids (about the square root of the number of vectors) are trained by
   k-means in numpy on at most ``TRAIN`` vectors, those with the least hashes, and the
   product quantiser (``SUB`` subspaces of 256 codes) on the residuals of the same.
2. Every vector goes to the list of its nearest centroid, with its residual's codes.
3. How many lists a query visits is measured: for ``HELD`` vectors the true neighbours are
   found by brute force, and the least number of nearest lists that has ``COVER`` of them
   is taken (``PROBES`` at least). It follows the data and the number of lists: few where
   there are clusters, half of all lists and more where there are none.
4. Queries are the vectors that a condition picks (all by default; the registered query
   asks for those whose id is divisible by 50), searched in all vectors. Lists that are near
   one another make blocks of about ``BLOCK`` members, and a query goes once to each block
   that has some of its lists. There
   its distances to the members of these lists come from its table of partial distances to
   the codes (asymmetric distance), the best ``RERANK`` are measured exactly, and the best
   k of those go on. The k best over all visited blocks are the answer.

A list of more than ``BLOCK`` members is split into chunks, each a block, which the queries
visit alike, so a dense region doesn't make one large task; and of a block with more than
about ``QUERIES`` visitors each task has a part of them. All that the driver and the
executors hold besides are the centroids, the codebooks and the held-out vectors. The index
is fitted on ``TRAIN`` vectors at most, so it has ``TRAIN`` / 8 lists at most; every vector is
in it. Beyond 6 million vectors lists grow with them, and their chunks with the lists.

Columns: ``vec_id``, ``neighbor_id``, ``rank`` (1 is nearest), ``distance`` (Euclidean,
rounded to 6 digits).

Defined cases: vectors that are null, of another dimension than the most frequent, or
with a null or non-finite element have no neighbours and are none, and neither are null
ids. All are scaled by one power of two where an element is so large or all are so small
that single precision couldn't hold the squares. Rows that repeat an id count once (the smallest vector). A vector isn't its own
neighbour; equal vectors are neighbours at distance 0; ties go to the smaller id. Fewer
than k others give fewer rows. Extra columns are ignored. An empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

from webloom.session import cut

K = 10
PROBES = 24
RERANK = 64
SUB = 16
TRAIN = 20_000
HELD = 256
COVER = 0.95
BLOCK = 4_096
QUERIES = 32_768
SEED = 5
_FOUND_SQL = "vec_id long, neighbor_id long, distance double"
_FOUND = pa.schema([("vec_id", pa.int64()), ("neighbor_id", pa.int64()), ("distance", pa.float64())])


def matrix(a: pa.Array) -> np.ndarray:
    """Lists of equal length as rows."""
    if isinstance(a, pa.ChunkedArray):
        a = a.combine_chunks()
    flat = a.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
    return flat.reshape(len(a), -1) if len(a) else np.empty((0, 1), np.float32)


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None], 0)


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = SEED) -> np.ndarray:
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([squares(x[i : i + 4096], c).argmin(1) for i in range(0, len(x), 4096)])
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(c, np.float64)
        np.add.at(total, near, x)
        full = n > 0
        c[full] = (total[full] / n[full, None]).astype(np.float32)
        if not full.all():  # an empty cluster starts again at a vector drawn anew
            c[~full] = x[rng.choice(len(x), int((~full).sum()))]
    return c


@dataclass
class Codec:
    centroids: np.ndarray
    books: np.ndarray  # SUB x 256 x (dimension / SUB), padded with zeros

    @classmethod
    def train(cls, x: np.ndarray, lists: int) -> Codec:
        c = kmeans(x, lists)
        near = np.concatenate([squares(x[i : i + 4096], c).argmin(1) for i in range(0, len(x), 4096)])
        parts = cls._split(x - c[near])
        books = [kmeans(p, 256, seed=SEED + 1 + i) for i, p in enumerate(parts)]
        books = [np.pad(b, ((0, 256 - len(b)), (0, 0)), constant_values=1e6) for b in books]
        return cls(c, np.stack(books))

    @staticmethod
    def _split(x: np.ndarray) -> np.ndarray:
        wide = -(-x.shape[1] // SUB) * SUB
        return np.pad(x, ((0, 0), (0, wide - x.shape[1]))).reshape(len(x), SUB, -1).transpose(1, 0, 2)

    def encode(self, residual: np.ndarray) -> np.ndarray:
        return np.stack([squares(p, b).argmin(1) for p, b in zip(self._split(residual), self.books)], 1).astype(np.uint8)

    def table(self, x: np.ndarray) -> np.ndarray:
        """For each subspace and code, what it adds to each query's squared distance: -2 times the inner product."""
        return np.stack([-2 * (b @ p.T) for p, b in zip(self._split(x), self.books)])

    def norms(self, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Squared norms of the vectors that lists and codes stand for."""
        r = np.concatenate([b[codes[:, s]] for s, b in enumerate(self.books)], 1)
        c = self.centroids[lists]
        return ((r + np.pad(c, ((0, 0), (0, r.shape[1] - c.shape[1])))) ** 2).sum(1)

    def probes(self, x: np.ndarray, n: int) -> np.ndarray:
        d = squares(x, self.centroids)
        n = min(n, d.shape[1])
        near = np.argpartition(d, n - 1, 1)[:, :n]
        return np.take_along_axis(near, np.take_along_axis(d, near, 1).argsort(1, kind="stable"), 1)


def _placer(shared):
    kind = StructType([StructField("list", IntegerType()), StructField("code", BinaryType())])

    @arrow_udf(kind)
    def place(vectors: pa.Array) -> pa.Array:
        codec, x = shared.value, matrix(vectors)
        lists, codes = [], []
        for i in range(0, len(x), 1024):
            near = codec.probes(x[i : i + 1024], 1)[:, 0]
            lists += near.tolist()
            codes += [c.tobytes() for c in codec.encode(x[i : i + 1024] - codec.centroids[near])]
        return pa.StructArray.from_arrays([pa.array(lists, pa.int32()), pa.array(codes, pa.binary())], ["list", "code"])

    return place


def _held_out(shared, k: int):
    """The k nearest of each batch of vectors to the held-out ones, with their lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value
        for batch in batches:
            own, lists, x = batch.column("vec_id").to_numpy(), batch.column("list").to_numpy(), matrix(batch.column("v"))
            if not len(own):
                continue
            d = squares(q, x)
            d[ids[:, None] == own[None]] = np.inf
            few = min(k, len(own))
            best = np.argpartition(d, few - 1, 1)[:, :few]
            d = np.take_along_axis(d, best, 1)
            who = np.broadcast_to(np.arange(len(q))[:, None], d.shape)
            ok = np.isfinite(d)
            cols = [pa.array(who[ok].astype(np.int32)), pa.array(own[best[ok]]), pa.array(lists[best[ok]].astype(np.int32)), pa.array(d[ok].astype(np.float64))]
            yield pa.RecordBatch.from_arrays(cols, ["who", "vec_id", "list", "d"])

    return run


def enough(placed: DataFrame, codec: Codec, k: int, held: int = HELD, cover: float = COVER) -> int:
    """The least number of nearest lists that has ``cover`` of the true neighbours of held-out vectors."""
    drawn = placed.orderBy(F.xxhash64(F.lit(SEED + 1), "vec_id"), "vec_id").limit(held).select("vec_id", "v").toArrow()
    q = matrix(drawn.column("v"))
    shared = placed.sparkSession.sparkContext.broadcast((drawn.column("vec_id").to_numpy(), q))
    near = placed.select("vec_id", "v", "list").mapInArrow(_held_out(shared, k), "who int, vec_id long, list int, d double")
    rank = F.row_number().over(Window.partitionBy("who").orderBy("d", "vec_id"))
    near = near.withColumn("rank", rank).where(F.col("rank") <= k).select("who", "list").toArrow()
    if not near.num_rows:
        return 1
    place = codec.probes(q, len(codec.centroids)).argsort(1)
    need = np.sort(place[near.column("who").to_numpy(), near.column("list").to_numpy()] + 1)
    return int(need[min(len(need), int(np.ceil(cover * len(need)))) - 1])


def blocks_of(sizes: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each list its first block and in how many it is; small lists near one another share one."""
    groups = kmeans(centroids, max(1, len(centroids) // 16))
    first, chunks, at, room = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64), 0, BLOCK
    for i in np.argsort(squares(centroids, groups).argmin(1), kind="stable"):
        if sizes[i] > BLOCK:
            continue
        if sizes[i] > room:
            at, room = at + 1, BLOCK
        first[i], room = at, room - sizes[i]
    for i in np.flatnonzero(sizes > BLOCK):
        first[i], chunks[i] = at + 1, -(-sizes[i] // BLOCK)
        at += chunks[i]
    return first, chunks


def _visits(first: np.ndarray, chunks: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, block, list), sorted by query and block."""
    who = np.repeat(np.arange(len(near)), near.shape[1])
    lists = near.ravel()
    many = chunks[lists]
    step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    who, lists, block = np.repeat(who, many), np.repeat(lists, many), np.repeat(first[lists], many) + step
    order = np.lexsort((block, who))
    return who[order], block[order], lists[order]


def _asker(shared, probes: int):
    """Each query once for every block that has some of its lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, first, chunks, parts = shared.value
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                some = batch.slice(i, 512)
                who, block, lists = _visits(first, chunks, codec.probes(matrix(some.column("v")), probes))
                start = np.flatnonzero(np.r_[True, (who[1:] != who[:-1]) | (block[1:] != block[:-1])])
                who, block = who[start], block[start]
                part = some.column("h").to_numpy()[who] % parts[block]
                inside = pa.ListArray.from_arrays(pa.array(np.r_[start, len(lists)].astype(np.int32)), pa.array(lists.astype(np.int32)))
                asks = [pa.array(block.astype(np.int32)), pa.array(part.astype(np.int32)), some.column("vec_id").take(pa.array(who)), some.column("v").take(pa.array(who)), inside]
                yield pa.RecordBatch.from_arrays(asks, ["block", "part", "q_id", "q", "inside"])

    return run


def _search(shared, k: int, rerank: int, scale: float):
    def run(key: tuple, members: pa.Table, queries: pa.Table) -> pa.Table:
        codec = shared.value[0]
        if not members.num_rows or not queries.num_rows:
            return _FOUND.empty_table()
        ids, lists = members.column("vec_id").to_numpy(), members.column("list").to_numpy()
        order = np.lexsort((ids, lists))
        ids, lists, x = ids[order], lists[order], matrix(members.column("v"))[order]
        codes = np.frombuffer(b"".join(members.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)[order].astype(np.int64)
        norms = codec.norms(lists, codes)
        here, at = np.unique(lists, return_index=True)
        at = np.r_[at, len(ids)]
        qids, q, inside = queries.column("q_id").to_numpy(), matrix(queries.column("q")), queries.column("inside").combine_chunks()
        visits = np.zeros((len(q), len(codec.centroids)), bool)
        visits[np.repeat(np.arange(len(q)), inside.value_lengths().to_numpy()), inside.flatten().to_numpy()] = True
        few = min(rerank + 1, len(ids))
        out = [[], [], []]
        for i in range(0, len(q), 256):
            part = q[i : i + 256]
            table = codec.table(part)
            to_center = -2 * (codec.centroids[here] @ part.T)
            guess = np.full((len(ids), len(part)), np.inf, np.float32)
            for j, name in enumerate(here):
                own = np.flatnonzero(visits[i : i + 256, name])
                a, b = at[j], at[j + 1]
                if not len(own):
                    continue
                near = table if len(own) == len(part) else table[:, :, own]
                found = norms[a:b, None] + to_center[j, own][None]
                for s in range(codes.shape[1]):
                    found += near[s][codes[a:b, s]]
                guess[a:b, own] = found
            guess = np.ascontiguousarray(guess.T)
            # of equal guesses (copies) any may be measured
            best = np.argpartition(guess, few - 1, 1)[:, :few] if few < len(ids) else np.broadcast_to(np.arange(len(ids)), guess.shape)
            exact = np.sqrt(((x[best].astype(np.float64) - part[:, None]) ** 2).sum(2))
            exact = exact.round(6) if scale == 1 else exact
            exact[(ids[best] == qids[i : i + 256, None]) | np.isinf(np.take_along_axis(guess, best, 1))] = np.inf
            rank = np.lexsort((ids[best], exact), axis=1)[:, :k]
            d = np.take_along_axis(exact, rank, 1)
            who = np.broadcast_to(np.arange(len(part))[:, None], d.shape)
            ok = np.isfinite(d)
            out[0].append(qids[i : i + 256][who[ok]])
            out[1].append(ids[np.take_along_axis(best, rank, 1)[ok]])
            out[2].append(d[ok])
        return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in out], schema=_FOUND)

    return run


def neighbors(vectors: DataFrame, queries: Column | None = None, k: int = K, probes: int = PROBES, rerank: int = RERANK, train: int = TRAIN) -> DataFrame:
    """The k nearest neighbours of every vector for whose ``vec_id`` the condition holds, among all."""
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "vec_id long, neighbor_id long, rank int, distance double")
    asked_for = F.lit(True) if queries is None else F.coalesce(queries, F.lit(False))
    v = F.transform("embedding", lambda x: x.cast("double"))
    fit = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    fit &= ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    good = vectors.where(fit).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    common = good.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("v", F.abs))).alias("most")).orderBy(F.desc("n"), "d").first()
    if common is None:
        return empty
    # a power of two: exact, and the distances are multiplied back
    scale = 1.0 if common.most == 0 or 1e-15 < common.most < 1e15 else 2.0 ** -min(1000, max(-1000, int(np.log2(common.most))))
    good = good.where(F.size("v") == common.d).select("vec_id", F.transform("v", lambda x: (x * F.lit(scale)).cast("float")).alias("v"))
    good = cut(good.groupBy("vec_id").agg(F.min("v").alias("v")), "ann-vectors")
    n = good.count()
    sample = matrix(good.orderBy(F.xxhash64(F.lit(SEED), "vec_id"), "vec_id").limit(train).select("v").toArrow().column("v"))
    lists = max(1, min(len(sample) // 8, int(n**0.5)))
    codec = Codec.train(sample, lists)
    placed = good.select("vec_id", "v", _placer(spark.sparkContext.broadcast(codec))("v").alias("p"))
    placed = cut(placed.select("vec_id", "v", F.col("p.list").alias("list"), F.col("p.code").alias("code")), "ann-placed")
    probes = min(len(codec.centroids), max(probes, enough(placed, codec, k)))
    sizes = np.zeros(len(codec.centroids), np.int64)
    for r in placed.groupBy("list").count().collect():
        sizes[r["list"]] = r["count"]
    first, chunks = blocks_of(sizes, codec.centroids)
    # visitors of a block, from the sample
    many_queries = n if queries is None else good.where(asked_for).count()
    asked = np.zeros(int((first + chunks).max()), np.int64)
    for i in range(0, len(sample), 512):
        who, block, _ = _visits(first, chunks, codec.probes(sample[i : i + 512], probes))
        asked += np.bincount(np.unique(who * len(asked) + block) % len(asked), minlength=len(asked))
    parts = np.maximum(1, np.ceil(asked * (many_queries / len(sample)) / QUERIES)).astype(np.int64)
    shared = spark.sparkContext.broadcast((codec, first, chunks, parts))
    of = [(i, int(first[i]), int(chunks[i])) for i in range(len(sizes))]
    members = placed.join(F.broadcast(spark.createDataFrame(of, "list int, first int, chunks int")), "list")
    members = members.withColumn("block", (F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("chunks"))).cast("int"))
    members = members.join(F.broadcast(spark.createDataFrame([(i, int(p)) for i, p in enumerate(parts)], "block int, parts int")), "block")
    members = members.select("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "vec_id", "v", "list", "code")
    h = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), "vec_id"), 1).alias("h")
    visits = placed.where(asked_for).select("vec_id", "v", h).mapInArrow(_asker(shared, probes), "block int, part int, q_id long, q array<float>, inside array<int>")
    found = members.groupBy("block", "part").cogroup(visits.groupBy("block", "part")).applyInArrow(_search(shared, k, rerank, scale), _FOUND_SQL)
    place = F.row_number().over(Window.partitionBy("vec_id").orderBy("distance", "neighbor_id"))
    return found.select("vec_id", "neighbor_id", place.alias("rank"), F.round(F.col("distance") / F.lit(scale), 6).alias("distance")).where(F.col("rank") <= k)


def brute_force(vectors: pd.DataFrame, k: int = K) -> dict[int, list[int]]:
    """All nearest neighbours by exact distances, for tests."""
    ids = vectors["vec_id"].to_numpy()
    x = np.stack(vectors["embedding"].to_numpy()).astype(np.float64)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)).round(6) if len(x) < 600 else np.sqrt(squares(x, x))
    np.fill_diagonal(d, np.inf)
    return {int(i): ids[np.lexsort((ids, row))[:k]].tolist() for i, row in zip(ids, d)}

"""Mixing sources to target weights by subset-sum budget fitting (operator 1).

1. Tokens (words between blanks) are counted per document, and documents per source and
   exact token length.
2. A source's budget is its share of the total. The total is given, or the largest for
   which the sources short of their share hold no more than ``SHORT`` of all tokens, so
   that a stray small source doesn't set the size of the result. A short source gives all
   it has.
3. In each source, lengths in descending order give cumulative quotas: of the first C
   documents, floor(f C) are taken, f being (budget - slack) / tokens and the slack one
   longest length (4, 16, ... of them, to all of the budget, until the budget is met
   exactly). A bounded-knapsack dynamic programme over the documents left fits what
   remains as nearly as it can. Sums that can be reached are the bits of one number, and
   the way to the best one is found by division (``knapsack``), so memory is a few times
   (rest / 8) bytes and no size of text or budget makes the fit worse.
4. Of each (source, length), the documents with the smallest seeded hashes are taken, as
   many as the count says. The cut is a hash value per (source, length), so the selection
   is a map over the documents: no text is shuffled. Groups of more than ``BUCKET``
   documents are narrowed to the one range of hashes that has the cut before ranking.

Columns: ``doc_id``, ``source``, ``n_tokens``. ``mixed`` returns rows of the input.

Target weights: given by source, or in proportion to tokens ** ``alpha`` over all data.

Defined cases: null or blank texts and null ids have no tokens to give and are left out.
A null source is the source "". Rows that repeat a doc_id, source and length are drawn
together; where they lie across the cut all are left out, so a budget is never exceeded.
Sources without a target weight are left out; a weighted source without documents gets
nothing. Extra columns are kept by ``mixed``, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.session import cut, maybe_broadcast, unused

ALPHA = 0.7
SHORT = 0.1
SEED = 17
BUCKET = 1_000_000
KEEP_BYTES = 64 << 20


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take, for a sum as near below the budget as found."""
    lengths, counts = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    if budget <= 0:
        return np.zeros_like(counts)
    longest = int(lengths[counts > 0].max())
    best, order, slack = np.zeros_like(counts), np.argsort(-lengths, kind="stable"), 1
    while True:  # the programme gets more documents to choose from until it fits
        bulk = max(0, budget - longest * slack)
        quota = np.array([int(c) * bulk // total for c in np.cumsum(counts[order]).tolist()], np.int64)  # exact: Python integers
        take = np.zeros_like(counts)
        take[order] = np.diff(quota, prepend=0)
        take += knapsack(lengths, counts - take, budget - int((lengths * take).sum()))
        if (lengths * take).sum() > (lengths * best).sum():
            best = take
        if bulk == 0 or (lengths * best).sum() == budget:
            return best
        slack *= 4


def _reached(parts: list[tuple[int, int]], reach: int, rest: int) -> int:
    """The sums up to ``rest`` (bits) that sums of ``reach`` and of the parts have."""
    full = (1 << (rest + 1)) - 1
    for _, size in parts:
        reach |= (reach << size) & full
    return reach


def knapsack(lengths: np.ndarray, counts: np.ndarray, rest: int) -> np.ndarray:
    """Bounded subset sum: counts per length whose sum is the largest that is at most ``rest``.

    Counts are split into powers of two. As many sets of sums are kept as ``KEEP_BYTES`` hold
    (two at least); between them they are computed again, in ever shorter runs of parts.
    """
    parts: list[tuple[int, int]] = []  # (place << 32 | how many, their sum)
    reach, full = 1, (1 << (rest + 1)) - 1
    for i in np.argsort(-lengths, kind="stable"):
        length = int(lengths[i])
        if length <= 0 or length > rest:
            continue
        left, many = min(int(counts[i]), rest // length), 1
        while left > 0 and not reach >> rest & 1:
            many = min(many, left)
            parts.append(((int(i) << 32) | many, length * many))
            reach |= (reach << (length * many)) & full
            left -= many
            many *= 2
        if reach >> rest & 1:
            break
    take = np.zeros(len(lengths), np.int64)
    todo = [(0, len(parts), 1, reach.bit_length() - 1)]  # a run of parts, the sums before it and the sum after it
    while todo:
        lo, hi, before, goal = todo.pop()
        before &= (1 << (goal + 1)) - 1
        if before >> goal & 1:
            todo += [(0, lo, 1, goal)] if lo and goal else []
            continue
        if hi - lo == 1:
            what, size = parts[lo]
            take[what >> 32] += what & 0xFFFFFFFF
            todo += [(0, lo, 1, goal - size)] if lo and goal > size else []
            continue
        runs = min(hi - lo, max(2, KEEP_BYTES // (goal // 8 + 1)), int((hi - lo) ** 0.5) + 2)
        edges = [lo + (hi - lo) * k // runs for k in range(runs + 1)]
        states = [before]
        for a, b in zip(edges[:-2], edges[1:-1]):
            states.append(_reached(parts[a:b], states[-1], goal))
        # the first run after which the goal is reached
        k = next((k for k in range(1, runs) if states[k] >> goal & 1), runs)
        todo.append((edges[k - 1], edges[k], states[k - 1], goal))
    return take


def _plan(rows: pd.DataFrame) -> pd.DataFrame:
    take = fit(rows["len"].to_numpy(), rows["c"].to_numpy(), int(rows["budget"].iloc[0]))
    return pd.DataFrame({"src": rows["src"], "len": rows["len"], "c": rows["c"], "take": take})


def _hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"))


def budgets(hist: DataFrame, weights: dict[str, float] | None, total: int | None, alpha: float) -> DataFrame:
    """(src, budget) from the histogram (src, len, c)."""
    have = hist.groupBy("src").agg(F.sum(F.col("len") * F.col("c")).alias("tokens"))
    if weights is None:
        want = have.withColumn("w", F.pow(F.col("tokens").cast("double"), F.lit(alpha)))
    else:
        known = hist.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items() if v > 0], "src string, w double")
        want = have.join(known, "src")
    # the sources with fewest tokens for their weight may be short: a row for each source, in one sort
    upto = F.sum("tokens").over(Window.orderBy(F.col("tokens") / F.col("w"), "src").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rated = want.withColumn("upto", upto).crossJoin(F.broadcast(want.agg(F.sum("tokens").alias("all_tokens"))))
    full = F.when(F.col("upto") > F.col("all_tokens") * SHORT, F.col("tokens") / F.col("w"))
    one = rated.agg(F.sum("w").alias("all_w"), F.min(full).alias("least"))
    size = F.col("least") * F.col("all_w") if total is None else F.lit(float(total))
    budget = F.least(F.floor(size * F.col("w") / F.col("all_w") + 1e-6), F.col("tokens"))
    return want.crossJoin(F.broadcast(one)).select("src", budget.cast("long").alias("budget"))


def cuts(docs: DataFrame, weights: dict[str, float] | None = None, total: int | None = None, alpha: float = ALPHA, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The counted documents, and (src, len, cut): documents with hashes up to the cut are taken."""
    told = docs.select(F.col("doc_id").cast("long"), F.coalesce("source", F.lit("")).alias("src"), n_tokens(F.col("text")).alias("len")).where("doc_id is not null and len > 0")
    told = cut(told.withColumn("h", _hash(seed)), "mix-lengths")
    hist = cut(told.groupBy("src", "len").agg(F.count("*").alias("c")), "mix-counts")
    plan = hist.join(budgets(hist, weights, total, alpha), "src").groupBy("src").applyInPandas(_plan, "src string, len long, c long, take long")
    plan = cut(plan.where("take > 0"), "mix-plan")
    part = plan.where("take < c")
    # the hash as a number from 0 on, in as many ranges as make them about BUCKET documents each
    range_of = F.floor((F.shiftrightunsigned("h", 32).cast("double") / float(1 << 32)) * (1 + F.floor(F.col("c") / BUCKET))).cast("int")
    order = F.shiftrightunsigned("h", 1)  # non-negative, in the order of the ranges
    near = told.join(maybe_broadcast(part, 64), ["src", "len"]).select("src", "len", "take", range_of.alias("b"), order.alias("h"))
    many = near.groupBy("src", "len", "take", "b").agg(F.count("*").alias("c"))
    here = Window.partitionBy("src", "len").orderBy("b")
    many = many.withColumn("upto", F.sum("c").over(here)).withColumn("before", F.col("upto") - F.col("c")).where("before <= take and take < upto")
    edge = near.join(maybe_broadcast(many.select("src", "len", "b", "before"), 64), ["src", "len", "b"])
    place = F.count("*").over(Window.partitionBy("src", "len").orderBy("h").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = edge.select("src", "len", "take", "b", "h", (place + F.col("before")).alias("place")).where("place <= take")
    last = ranked.groupBy("src", "len").agg(F.max("h").alias("inside"))
    part = part.join(many.select("src", "len", "b"), ["src", "len"], "left").join(last, ["src", "len"], "left")
    # nothing of the range is taken: the cut is its lower end
    width = (1 + F.floor(F.col("c") / BUCKET)).cast("double")
    floor_h = F.ceil(F.col("b") / width * float(1 << 32)).cast("long") * F.lit(1 << 31) - 1
    part = part.select("src", "len", F.coalesce("inside", floor_h, F.lit(-1)).alias("cut"))
    whole = plan.where("take = c").select("src", "len", F.lit((1 << 63) - 1).alias("cut"))
    return told, cut(part.union(whole), "mix-cuts")


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, total: int | None = None, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """doc_id, source and n_tokens of the selected documents."""
    told, at = cuts(docs, weights, total, alpha, seed)
    taken = told.join(maybe_broadcast(at, 64), ["src", "len"]).where(F.shiftrightunsigned("h", 1) <= F.col("cut"))
    return taken.select("doc_id", F.col("src").alias("source"), F.col("len").alias("n_tokens"))


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, total: int | None = None, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """The selected rows with all their columns, by a filter over the input."""
    _, at = cuts(docs, weights, total, alpha, seed)
    src, size, last = unused(docs, "src", "len", "cut")
    at = at.select(F.col("src").alias(src), F.col("len").alias(size), F.col("cut").alias(last))
    rows = docs.withColumns({src: F.coalesce("source", F.lit("")), size: n_tokens(F.col("text"))}).where(F.col("doc_id").isNotNull() & (F.col(size) > 0))
    rows = rows.join(maybe_broadcast(at, 64), [src, size]).where(F.shiftrightunsigned(_hash(seed), 1) <= F.col(last))
    return rows.select(*docs.columns)

"""The training-data operators against brute force and their defined cases, on small fixtures."""

import math
import os
import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from webloom.llm import ann, decontaminate, html_diff, jaccard_join, language, line_dedup, mixing, quality, sharding, toxicity

DOC = "doc_id long, text string, lang string, source string, n_chars long, r int, label string, len long"


def words(seed, n, vocabulary=400):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{x}" for x in rng.integers(0, vocabulary, n))


def frame(spark, rows):
    """rows of (doc_id, text) or (doc_id, text, lang, source); extra columns have clashing names."""
    full = [(*r, "en", "s")[:4] if len(r) == 2 else tuple(r) for r in rows]
    return spark.createDataFrame([(i, t, lang, src, None, 1, "x", 5) for i, t, lang, src in full], DOC)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string")


ODD = [(None, "some words of a document without id"), (900, None), (901, ""), (902, "   \n "), (903, "!!! ???"), (904, "one"), (904, "one")]
LONG = (905, words(5, 120_000, 5000))


def sets(text, n=3):
    w = text.split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


# 1
def test_mix_hits_budgets(spark):
    rng = np.random.default_rng(1)
    rows = [(i, words(i, int(rng.integers(1, 60))), "en", "abc"[i % 3]) for i in range(600)] + [(i, t, "en", None) for i, t in ODD] + [(*LONG, "en", "a")]
    docs = frame(spark, rows)
    got = mixing.mix_sources(docs, {"a": 1, "b": 2, "c": 1, "none": 3}, 8000).collect()
    share = Counter()
    for r in got:
        share[r.source] += r.n_tokens
    have = Counter()
    for i, t, _, s in rows:
        have[s] += len(t.split()) if t and i is not None else 0
    want = {"a": 2000, "b": 4000, "c": 2000}  # "none" has no documents
    for s, w in want.items():
        assert w - 1 <= share[s] <= w and have[s] > w
    assert len({r.doc_id for r in got}) == len(got) and set(share) == set(want)
    again = mixing.mix_sources(docs.repartition(7), {"a": 1, "b": 2, "c": 1, "none": 3}, 8000).collect()
    assert {r.doc_id for r in again} == {r.doc_id for r in got}
    kept = mixing.mixed(docs, {"a": 1, "b": 2, "c": 1, "none": 3}, 8000)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in got)


def test_mix_defaults_and_empty(spark):
    rows = [(i, words(i, 5 + i % 7), "en", "ab"[i % 4 == 0]) for i in range(400)]
    got = mixing.mix_sources(frame(spark, rows)).groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()
    have = Counter()
    for _, t, _, s in rows:
        have[s] += len(t.split())
    n = {r.source: r.n for r in got}
    assert abs(n["a"] / n["b"] - (have["a"] / have["b"]) ** mixing.ALPHA) < 0.02
    assert mixing.mix_sources(frame(spark, [])).count() == 0 and mixing.mixed(frame(spark, [])).count() == 0
    assert mixing.mix_sources(frame(spark, ODD[1:4])).count() == 0


def test_mix_of_a_tiny_source(spark):
    """One more small source, or a null one, doesn't shrink the result."""
    rows = [(i, words(i, 20 + i % 7), "en", f"s{i % 10}") for i in range(3000)]
    have = sum(len(r[1].split()) for r in rows)
    for name in ("rare", None):
        got = mixing.mix_sources(frame(spark, [*rows, (5000, words(1, 10), "en", name)])).collect()
        assert sum(r.n_tokens for r in got) > 0.95 * have
        assert [r.n_tokens for r in got if r.doc_id == 5000] == [10]


def test_knapsack_is_the_best(spark):
    rng = np.random.default_rng(3)
    for _ in range(60):
        lengths = np.unique(rng.integers(1, 40, 4))
        counts, rest = rng.integers(0, 4, len(lengths)), int(rng.integers(0, 150))
        take = mixing.knapsack(lengths, counts, rest)
        reach = {0}
        for length, c in zip(lengths, counts):
            reach = {x + int(length) * k for x in reach for k in range(c + 1)}
        assert (take <= counts).all() and (take >= 0).all()
        assert (take * lengths).sum() == max(x for x in reach if x <= rest)


def test_fit_of_long_texts():
    """Few long lengths: the best sum, by all combinations; and memory that doesn't hold all sets of sums."""
    lengths, counts, budget = np.array([700_001, 1_000_003, 1_500_003]), np.array([4, 4, 4]), 9_000_259
    sums = [a * 700_001 + b * 1_000_003 + c * 1_500_003 for a in range(5) for b in range(5) for c in range(5)]
    assert (mixing.fit(lengths, counts, budget) * lengths).sum() == max(s for s in sums if s <= budget)
    rng = np.random.default_rng(5)
    lengths, counts = np.unique(rng.integers(1, 20_000, 300)), None
    counts = rng.integers(1, 9, len(lengths))
    budget = int((lengths * counts).sum() * 0.37)
    take = mixing.fit(lengths, counts, budget)
    assert (take * lengths).sum() == budget and (take <= counts).all() and (take >= 0).all()


def test_knapsack_with_little_memory(monkeypatch):
    monkeypatch.setattr(mixing, "KEEP_BYTES", 8)
    test_knapsack_is_the_best(None)


def test_mixed_keeps_clashing_columns(spark):
    rows = [(i, words(i, 4 + i % 5), "ab"[i % 2], "SRC", 7, "CUT", -1) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _src string, len int, _cut string, src int")
    got = mixing.mixed(df, {"a": 1, "b": 1}, 100)
    assert got.columns == df.columns and got.count() > 5
    assert {(r["_src"], r["len"], r["_cut"], r["src"]) for r in got.collect()} == {("SRC", 7, "CUT", -1)}


def test_mix_draw_is_by_hash(spark):
    """Of each source and length those with the least seeded hashes, as many as the plan says."""
    rows = [(i, words(i, 5 + i % 3), "en", "ab"[i % 2]) for i in range(300)]
    docs = frame(spark, rows)
    got = {r.doc_id for r in mixing.mix_sources(docs, {"a": 2, "b": 1}, 900).collect()}
    h = {r.doc_id: r.h for r in docs.select("doc_id", F.shiftrightunsigned(mixing._hash(mixing.SEED), 1).alias("h")).collect()}
    for s in "ab":
        mine = [(len(t.split()), i) for i, t, _, x in rows if x == s]
        have = Counter(n for n, _ in mine)
        sizes = np.array(sorted(have))
        take = mixing.fit(sizes, np.array([have[n] for n in sizes.tolist()]), 600 if s == "a" else 300)
        for n, k in zip(sizes.tolist(), take.tolist()):
            assert sorted(got & {i for m, i in mine if m == n}) == sorted(sorted((i for m, i in mine if m == n), key=h.get)[:k])


# 2
def test_language(spark):
    text = {"en": "the house and the garden with those other things there", "de": "das haus und der garten mit den anderen dingen dort", "fr": "la maison et le jardin avec les autres choses qui sont"}
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.permutation(text[lang].split())), lang, "s") for i, lang in enumerate(["en", "de", "fr"] * 30)]
    rows += [(i, t, None, None) for i, t in ODD] + [(1000, text["de"].upper() * 5000, None, "s")]
    got = {r.doc_id: r for r in language.identify(frame(spark, rows)).collect()}
    assert all(got[i].lang == lang for i, _, lang, _ in rows[:90]) and got[1000].lang == "de"
    assert all(got[i].lang == "und" and got[i].distance is None for i in (900, 901, 902, 903)) and got[None].lang == "en"
    assert language.identify(frame(spark, rows)).count() == len(rows)
    assert language.identify(frame(spark, [])).count() == 0
    assert language.identify(frame(spark, [(1, "abc", None, "s")])).first().lang == "und"


def test_language_letters_as_in_sql(spark):
    texts = [("el", "Ο ΔΡΟΜΟΣ ΤΗΣ ΠΟΛΗΣ, ΟΔΟΣ ΑΘΗΝΑΣ"), ("tr", "İstanbul ile İzmir DİYARBAKIR'dan"), ("de", "Straße -- ÄRGER, 12 Öfen"), ("xx", "𐐀𐐁 日本語 e\u0301 x\u2028y\ufffd")]
    rows = [(i, t, lang, "s") for i, (lang, t) in enumerate(texts * 2)] + [(100 + i, t.upper(), None, "s") for i, (_, t) in enumerate(texts)] + ODD[1:5]
    df = frame(spark, rows)
    documents = df.toPandas()  # noqa: F841 (read by the SQL)
    want = {r[0]: (r[1], r[2]) for r in duckdb.sql(language.ORACLE).fetchall()}
    found = language.identify(df)
    got = {r.doc_id: (r.lang, r.distance) for r in found.collect()}
    assert got.keys() == want.keys() and {i: r[0] for i, r in got.items()} == {i: r[0] for i, r in want.items()}
    assert all(d == pytest.approx(want[i][1]) if d is not None else want[i][1] is None for i, (_, d) in got.items())
    # the JVM makes no strings of the texts
    plan = found._jdf.queryExecution().executedPlan().toString().lower()
    assert "text" in plan and not any(x in plan for x in ("regexp", "lower(", "trim(", "concat("))


def test_language_pieces(monkeypatch):
    text = " Ärger, ΟΔΟΣ 12 -- İz 日本 𐐀x" * 3
    whole = [language.profile(t.encode()) for t in (text, text + "!", "?" * 40 + "a", "a", "", " 1 ")]
    assert [len(u) for u, _ in whole[3:]] == [4, 0, 0]  # "a", " a", "a ", " a "
    assert all((language.profile(text.encode())[k] == whole[1][k]).all() for k in (0, 1))
    for span in range(1, 9):
        monkeypatch.setattr(language, "SPAN", span)
        for t, w in zip((text, text + "!", "?" * 40 + "a", "a", "", " 1 "), whole):
            assert all(np.array_equal(x, y) for x, y in zip(language.profile(t.encode()), w))
        assert all(np.array_equal(x, y) for x, y in zip(language.profile(b"\xff\xc3ab\xe2\x82"), language.profile(b" ab ")))


# 3
def test_toxicity_on_held_out(spark):
    rng = np.random.default_rng(4)
    bad = [f"bad{i}" for i in range(30)]
    rows, truth = [], {}
    for i in range(900):
        t = words(i, 40).split()
        truth[i] = i % 5 == 0
        if truth[i]:
            t[:8] = rng.choice(bad, 8)
        rows.append((i, " ".join(rng.permutation(t))))
    known = labels(spark, [(i, 1, int(truth[i]), "x") for i in range(450)])
    docs = frame(spark, rows + ODD + [LONG])
    got = {r.doc_id: r for r in toxicity.toxicity(docs, known).collect()}
    held = [i for i in range(450, 900)]
    assert np.mean([got[i].toxic == truth[i] for i in held]) > 0.95
    assert got[900].score is None and not got[900].toxic and got[903].score is None and not got[905].toxic
    assert toxicity.toxicity(docs, known).count() == len(rows) + len(ODD) + 1
    none = toxicity.toxicity(docs, labels(spark, [(1, 1, 0, "x"), (2, 1, None, "x")]))
    assert none.where("toxic or score is not null").count() == 0
    assert toxicity.toxicity(frame(spark, []), known).count() == 0


def test_toxicity_of_one_positive(spark):
    """One confirmed document is enough to find it and its copies, and leaves others alone."""
    rows = [(i, words(i, 30, 200)) for i in range(200)] + [(500, "vile nasty awful brutal horrid things to say"), (501, "vile nasty awful brutal horrid words to hear")]
    got = {r.doc_id: r.toxic for r in toxicity.toxicity(frame(spark, rows), labels(spark, [(500, 1, 1, "x"), (1, 1, 0, "x"), (2, 1, 0, "x"), (3, 1, 0, "x")])).collect()}
    assert got[500] and got[501] and sum(got.values()) <= 6


def test_toxicity_columns_may_clash(spark):
    rows = [(i, f"{'foul' if i % 3 == 0 else 'fine'} {words(i, 5)}", True, i, 1, 2.0) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, pos boolean, id long, b int, norm double")
    got = toxicity.toxicity(df, labels(spark, [(i, 1, int(i % 3 == 0), "x") for i in range(30)]))
    assert got.columns == ["doc_id", "score", "toxic"] and all(r.toxic == (r.doc_id % 3 == 0) for r in got.collect())


def test_toxicity_risk_and_gradient():
    """The risk of each document alone, and its change by small steps of every weight."""
    import pyarrow as pa

    texts = [words(i, 12, 30) for i in range(40)] + ["", "one word word"]
    pos = np.array([i % 4 == 0 for i in range(42)])
    doc, b, c = toxicity.features(pa.array(texts, pa.large_string()))
    used, at = np.unique(b, return_inverse=True)
    rng = np.random.default_rng(2)
    norm = np.bincount(doc, np.log1p(c) ** 2, 42) ** 0.25
    x = np.log1p(c) / norm[doc]
    dense = np.zeros((42, len(used)))
    dense[doc, at] = x

    def risk(w, bias, prior):
        z = dense @ w + bias
        loss = lambda v: math.log1p(math.exp(-v))
        rest = sum(loss(-v) for v in z) / 42 - prior * sum(loss(-v) for v in z[pos]) / pos.sum()
        return prior * sum(loss(v) for v in z[pos]) / pos.sum(), rest

    for scale, prior in ((0.3, 0.2), (3.0, 0.9)):
        w, bias = rng.normal(size=len(used)) * scale + (pos @ dense > 0) * (scale > 1), 0.1
        model = toxicity.Model(w, np.ones(len(used)), bias)
        features = 2 * toxicity.sums(toxicity.Model(0 * w, 0 * w, 0.0), pos, doc, at, x, 42)[1]
        got, g = toxicity.step(*toxicity.sums(model, pos, doc, at, x, 42), features, prior)
        toxic, rest = risk(w, bias, prior)
        assert got == pytest.approx(toxic + max(0, rest))
        part = (lambda *v: sum(risk(*v))) if rest >= 0 else (lambda *v: -risk(*v)[1])
        for j in [*range(0, len(used), 7), len(used)]:
            move = np.eye(len(used) + 1)[j] * 1e-5
            near = (part(w + move[:-1], bias + move[-1], prior) - part(w - move[:-1], bias - move[-1], prior)) / 2e-5
            assert g[j] == pytest.approx(near, abs=1e-6)


# 4
def test_decontaminate_against_all_pairs(spark):
    items = [(i, words(1000 + i, 6 + i)) for i in range(25)] + [(30, None), (31, ""), (32, "two words"), (None, words(77, 12))]
    rows = [(i, words(i, 50)) for i in range(60)]
    for i in range(25):
        w = items[i][1].split()
        if i % 3 == 0:
            w[len(w) // 2] = "changed"
        rows.append((100 + i, f"{words(500 + i, 30 * (i % 4) + 1)} {' '.join(w)} {words(600 + i, 7)}"))
    rows += [(200, LONG[1] + " " + items[3][1].upper() + ", end"), (201, words(77, 12)), *ODD, LONG]
    bench = spark.createDataFrame([(i, t, "x", 7) for i, t in items], "item_id long, text string, doc_id string, containment int")
    got = {(r.doc_id, r.item_id): r.containment for r in decontaminate.contained(frame(spark, rows), bench).collect()}
    want = {}
    for d, t in rows:
        s = sets((t or "").lower().replace(",", "").replace("!!! ???", ""), 5)
        for b, x in items:
            y = sets(x or "", 5)
            if y and len(s & y) / len(y) >= decontaminate.THRESHOLD:
                want[d, b] = len(s & y) / len(y)
    assert got.keys() == want.keys() and len(want) > 15
    assert got == pytest.approx(want)
    clean = decontaminate.clean(frame(spark, rows), bench)
    dirty = {d for d, _ in want}
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(d) for d, _ in rows if d not in dirty)
    assert clean.columns == frame(spark, rows).columns
    none = bench.where("false")
    assert decontaminate.contained(frame(spark, rows), none).count() == 0 and decontaminate.clean(frame(spark, rows), none).count() == len(rows)
    assert decontaminate.contained(frame(spark, []), bench).count() == 0


@pytest.mark.parametrize("threshold", [0.05, 0.4, 0.6, 0.85, 1.0])
def test_signatures_miss_nothing(threshold):
    """Items of 1 to 60 shingles of which just enough lie in a document; signatures are smaller than the sets."""
    import pyarrow as pa

    rng = np.random.default_rng(int(threshold * 100))
    items, docs = [], []
    for q in [1, 2, 3, 4, 5, 7, 8, 9, 12, 16, 25, 40, 60] * 4:
        item = [f"i{len(items)}x{k}" for k in range(q + 4)]
        keep = decontaminate.needed(q, threshold)
        at = int(rng.integers(0, q - keep + 1))
        items.append(" ".join(item))
        for size in (0, 30, 3000):
            docs.append(f"{words(len(docs), size)} {' '.join(item[at : at + keep + 4])} {words(1 + len(docs), size)}")
            docs.append(f"{words(len(docs), size)} {' '.join(item[at : at + keep + 3])} {words(1 + len(docs), size)}")
    index = decontaminate.Index(pa.array(items, pa.large_string()), 5, threshold)
    found, at = set(), 0
    for n, d, i, _ in index.search(pa.array(docs, pa.large_string())):
        found |= {(at + x, y) for x, y in zip(d, i)}
        at += n
    assert found == {(6 * i + k, i) for i in range(len(items)) for k in (0, 2, 4)}
    total = sum(len(v) for _, v, _ in index.partitions)
    assert total <= (1 - threshold) * sum(map(len, index.sets)) + 1.01 * len(items)


def test_decontaminate_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 300)
    bench = spark.createDataFrame([(i, words(i, 20)) for i in range(20)], "item_id long, text string")
    docs = frame(spark, [(i, f"{words(900 + i, 9)} {words(i % 25, 20)}") for i in range(50)])
    got = sorted((r.doc_id, r.item_id) for r in decontaminate.contained(docs, bench).collect())
    assert got == [(i, i % 25) for i in range(50) if i % 25 < 20]
    assert sorted(r.doc_id for r in decontaminate.clean(docs, bench).collect()) == [i for i in range(50) if i % 25 >= 20]


# 5
def test_neighbours_recall(spark):
    rng = np.random.default_rng(6)
    centers = rng.normal(size=(20, 32)) * 2
    x = (centers[rng.integers(0, 20, 1500)] + rng.normal(size=(1500, 32))).astype(np.float32)
    x[10] = x[11] = x[12]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(None, x[0].tolist()), (5000, None), (5001, []), (5002, [1.0] * 8), (5003, [float("nan")] * 32), (5004, [None] + [1.0] * 31), (3, x[3].tolist())]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows + odd], "vec_id long, embedding array<float>, label int, rank int")
    got: dict = {}
    for r in ann.neighbors(df).orderBy("vec_id", "rank").collect():
        got.setdefault(r.vec_id, []).append(r)
    exact = ann.brute_force(pd.DataFrame(rows, columns=["vec_id", "embedding"]))
    assert set(got) == set(exact)
    assert np.mean([len({r.neighbor_id for r in got[i]} & set(exact[i])) / 10 for i in exact]) >= 0.9
    assert [r.rank for r in got[7]] == list(range(1, 11)) and all(r.neighbor_id != 7 for r in got[7])
    assert [(r.neighbor_id, r.distance) for r in got[10]][:2] == [(11, 0.0), (12, 0.0)]


def recall(spark, x, queries=400):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    asked = np.random.default_rng(8).permutation(len(x))[:queries]
    found: dict = {}
    for r in ann.neighbors(df).where(F.col("vec_id").isin(asked.tolist())).collect():
        found.setdefault(r.vec_id, set()).add(r.neighbor_id)
    d = ann.squares(x[asked], x)
    d[np.arange(len(asked)), asked] = np.inf
    exact = d.argsort(1, kind="stable")[:, : ann.K]
    return float(np.mean([len(found[i] & set(e)) / ann.K for i, e in zip(asked.tolist(), exact.tolist())]))


@pytest.mark.parametrize("n", [2_000, 6_000])
def test_neighbours_recall_without_clusters(spark, n):
    x = np.random.default_rng(n).normal(size=(n, 64))
    assert recall(spark, (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)) >= 0.9


def test_neighbours_recall_of_provided(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").select("embedding").collect()
    assert recall(spark, np.array([r.embedding for r in rows], np.float32), 2_000) >= 0.9


def test_neighbours_of_some_queries(spark):
    """Queries by a condition, among all; the same rows as when all are asked for."""
    x = np.random.default_rng(17).normal(size=(700, 16)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    some = sorted(map(tuple, ann.neighbors(df, F.col("vec_id") % 50 == 0).collect()))
    assert len(some) == 14 * ann.K and {r[0] for r in some} == set(range(0, 700, 50))
    assert some == sorted(map(tuple, ann.neighbors(df).where("vec_id % 50 = 0").collect()))


@pytest.mark.parametrize("size", [1e-30, 1e25, 1e200])
def test_neighbours_of_large_and_small_numbers(spark, size):
    x = np.random.default_rng(18).normal(size=(300, 8))
    df = spark.createDataFrame([(i, (v * size).tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got: dict = {}
    for r in ann.neighbors(df).collect():
        got.setdefault(r.vec_id, set()).add(r.neighbor_id)
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    assert np.mean([len(got[i] & set(d[i].argsort()[: ann.K].tolist())) / ann.K for i in range(300)]) >= 0.9


def test_neighbours_of_large_lists_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 40)
    monkeypatch.setattr(ann, "QUERIES", 100)
    x = np.random.default_rng(13).normal(size=(1000, 8)).astype(np.float32)
    x[:500] = x[:500] * 0.01 + 3
    assert recall(spark, x) >= 0.9


def test_neighbours_of_few(spark):
    schema = "vec_id long, embedding array<float>"
    assert ann.neighbors(spark.createDataFrame([], schema)).count() == 0
    assert ann.neighbors(spark.createDataFrame([(1, [1.0, 2.0])], schema)).count() == 0
    got = ann.neighbors(spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 4.0])], schema)).collect()
    assert {(r.vec_id, r.neighbor_id, r.distance) for r in got} == {(1, 2, 5.0), (2, 1, 5.0)}


# 6
def clusters():
    rng, rows = np.random.default_rng(7), []
    for c in range(12):
        base = words(100 + c, 60 + 5 * c).split()
        for k in range(6):
            w = list(base)
            for j in rng.integers(0, len(w), k % 4):
                w[j] = f"new{rng.integers(0, 9999)}"
            rows.append((len(rows), " ".join(w[: len(w) - k])))
    return rows + [(500 + i, words(50, 40, 30)) for i in range(5)] + [(600 + i, "a b") for i in range(3)] + [(610, "b a"), (611, LONG[1]), (612, LONG[1] + " end")]


def test_jaccard_join_against_all_pairs(spark):
    rows = clusters()
    own = {i: sets(t) for i, t in rows}
    want = {}
    for i in own:
        for j in own:
            if i < j and (both := len(own[i] & own[j])):
                sim = both / (len(own[i]) + len(own[j]) - both)
                if sim >= 0.55:
                    want[i, j] = sim
    found = jaccard_join.similar(frame(spark, rows + ODD[:5]))
    got = {(r.doc_id_a, r.doc_id_b): r.jaccard for r in jaccard_join.pairs_of(*found).collect()}
    assert got == pytest.approx(want) and len(want) > 100
    for t in (0.3, 0.8, 1.0):
        some = {(r.doc_id_a, r.doc_id_b) for r in jaccard_join.pairs_of(*jaccard_join.similar(frame(spark, rows), t)).collect()}
        assert some == {(i, j) for i in own for j in own if i < j and (b := len(own[i] & own[j])) and b / (len(own[i]) + len(own[j]) - b) >= t}
    # links of every document, and the smallest of its connected group
    group, links = {i: i for i in own}, Counter(i for pair in want for i in pair)
    for _ in own:
        for i, j in want:
            group[i] = group[j] = min(group[i], group[j])
    joined = jaccard_join.jaccard_join(frame(spark, rows + ODD[:5])).collect()
    assert sorted(map(tuple, joined)) == sorted((i, group[i], links[i]) for i in own if links[i])


def test_jaccard_join_in_small_flushes(spark, monkeypatch):
    """A gram of all documents, and flushes of few."""
    rows = [(i, f"all of them {words(i % 9, 12, 50)}") for i in range(120)]
    want = sorted(map(tuple, jaccard_join.jaccard_join(frame(spark, rows)).collect()))
    monkeypatch.setattr(jaccard_join, "FLUSH_DOCS", 3)
    monkeypatch.setattr(jaccard_join, "RANGE_BYTES", 100)
    assert sorted(map(tuple, jaccard_join.jaccard_join(frame(spark, rows)).collect())) == want and len(want) == 120


def test_jaccard_join_odd(spark):
    assert jaccard_join.jaccard_join(frame(spark, [])).count() == 0
    assert jaccard_join.jaccard_join(frame(spark, ODD)).count() == 0
    rows = [(1, "a b c d"), (1, "a b c d"), (2, "A, b c d!")]
    assert sorted(map(tuple, jaccard_join.jaccard_join(frame(spark, rows)).collect())) == [(1, 1, 1), (2, 1, 1)]
    # of the rows of an id, the one with the largest set counts
    rows = [(1, "a b c d"), (1, "p q r s t u v"), (2, "a b c d"), (3, "p q r s t u v")]
    assert sorted(map(tuple, jaccard_join.jaccard_join(frame(spark, rows)).collect())) == [(1, 1, 1), (3, 1, 1)]
    with pytest.raises(ValueError):
        jaccard_join.jaccard_join(frame(spark, rows), 0)


# 7
def test_sharding_moves_little(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("old").alias("region"))
    tree = sharding.default_tree()
    before = {r.doc_id: tuple(r)[1:] for r in sharding.with_shards(docs, tree).collect()}
    share = Counter(x[0] for x in before.values())
    assert all(abs(share[g] / 20_000 - w / 10) < 0.02 for g, w in (("g0", 5), ("g1", 3), ("g2", 2)))
    weight, racks = tree["g1"]
    tree["g1"] = (weight, {**racks, "g1r0": (racks["g1r0"][0] * 3, racks["g1r0"][1])})
    after = {r.doc_id: tuple(r)[1:] for r in sharding.with_shards(docs, tree).collect()}
    moved = [i for i in before if before[i] != after[i]]
    assert moved and all(before[i][0] == "g1" and after[i][1] == "g1r0" for i in moved)


def test_sharding_odd(spark):
    got = sharding.shards(frame(spark, ODD)).collect()
    assert len(got) == len(ODD) and all(r.shard for r in got)
    assert len({tuple(r) for r in got if r.doc_id == 904}) == 1
    assert sharding.shards(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        sharding.edges({"a": (0, {})})


# 8
def quality_rows():
    rng, rows = np.random.default_rng(9), []
    for i in range(600):
        good = i % 3 > 0
        rows.append((i, " ".join(f"{'good' if good else 'junk'}{x}" if rng.random() < 0.5 else f"w{x}" for x in rng.integers(0, 60, 30))))
    return rows


def test_quality(spark):
    rows = quality_rows()
    known = labels(spark, [(i, int(i % 3 > 0), 0, "x") for i in range(300)] + [(None, 1, 0, "x"), (1, None, 0, "x")])
    docs = frame(spark, rows + ODD + [LONG])
    got = {r.doc_id for r in quality.resample(docs, known).collect()}
    held = range(300, 600)
    assert np.mean([(i in got) == (i % 3 > 0) for i in held]) > 0.95
    assert not got & {900, 901, 902}
    kept = quality.kept(docs, known)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == got
    assert quality.resample(frame(spark, rows), known, 100).count() == 100
    assert quality.resample(frame(spark, rows), known, 0).count() == 0
    assert quality.resample(frame(spark, rows), labels(spark, [])).count() == 600
    assert quality.resample(frame(spark, []), known).count() == 0


def plain_buckets(text, bits):
    """Buckets of the grams of a text in plain Python."""
    m = (1 << 64) - 1

    def mix(v):
        v ^= v >> 30
        v = v * 0xBF58476D1CE4E5B9 & m
        v ^= v >> 27
        v = v * 0x94D049BB133111EB & m
        return v ^ v >> 31

    def hashed(w):
        total, power = 0, 1
        for c in w.encode():
            total, power = total + (c + 1) * power & m, power * 0x9E3779B97F4A7C15 & m
        return mix(total)

    tokens = [hashed(w) for w in re.findall(r"[a-z0-9]+|[^a-z0-9\s]+", text.lower())]
    out = [h >> 64 - bits for h in tokens]
    for i in range(1, len(tokens)):
        if tokens[i] == tokens[i - 1]:
            out.append(1 << bits)
        elif i > 1 and tokens[i] == tokens[i - 2]:
            out.append((1 << bits) + 1)
        else:
            out.append(mix(tokens[i - 1] * 0x9E3779B97F4A7C15 + tokens[i] & m) >> 64 - bits)
    return out


def test_quality_weights_against_plain_counts(spark, monkeypatch):
    """Both models counted anew, with another table size too; the top k of keys by a sort."""
    rows = quality_rows()[:200] + [(700, "a a b a, b -- b! b"), (701, "x")]
    known = labels(spark, [(i, int(i % 3 > 0), 0, "x") for i in range(200)])
    docs = frame(spark, rows)
    chosen = docs.select("doc_id", F.xxhash64(F.lit(quality.SEED), "doc_id").alias("h")).collect()
    target_ids = {r.doc_id for r in chosen if r.doc_id < 200 and r.doc_id % 3 > 0 and r.h % 2 == 0}
    noise = {r.doc_id: r.g for r in docs.select("doc_id", quality.gumbel(quality.SEED).alias("g")).collect()}
    for bits in (15, 18):
        monkeypatch.setattr(quality, "BITS", bits)
        monkeypatch.setattr(quality, "gram_buckets", lambda t, b, f=quality.gram_buckets: f(t, b))
        size = (1 << bits) + 2
        own = {i: plain_buckets(t, bits) for i, t in rows}
        raw, target = Counter(b for g in own.values() for b in g), Counter(b for i in target_ids for b in own[i])
        q = lambda b: (raw[b] + 1) / (sum(raw.values()) + size)  # noqa: E731, B023
        p = lambda b: (target[b] + size * q(b)) / (sum(target.values()) + size)  # noqa: E731, B023
        weight = {i: sum(math.log(p(b) / q(b)) for b in g) for i, g in own.items()}
        got = {r.doc_id: r.log_weight for r in quality.resample(docs, known, 50).collect()}
        assert got == pytest.approx({i: weight[i] for i in got})
        assert set(got) == set(sorted(weight, key=lambda i: weight[i] + noise[i], reverse=True)[:50])


def test_quality_draw_follows_the_weights(spark):
    """Of documents that weigh 1 and 3, three quarters of the first draws are heavy ones, others with each seed."""
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, F.lit(math.log(3.0))).otherwise(0.0).alias("w"))
    draws = [{r.doc_id for r in quality.drawn(df, "w", 400, seed).collect()} for seed in (1, 2, 3)]
    assert all(len(d) == 400 and abs(np.mean([i % 2 == 0 for i in d]) - 0.74) < 0.07 for d in draws)
    assert len(draws[0] & draws[1]) < 150 and draws[0] != draws[2]


def test_quality_columns_may_clash(spark):
    rows = [(*r, 1.5, "q", True, 2) for r in quality_rows()]
    df = spark.createDataFrame(rows, "doc_id long, text string, log_weight double, q string, seen boolean, key int")
    known = labels(spark, [(i, int(i % 3 > 0), 0, "x") for i in range(300)])
    got = quality.kept(df, known)
    assert got.columns == df.columns and 300 < got.count() < 500
    assert {tuple(r)[2:] for r in got.collect()} == {(1.5, "q", True, 2)}


def test_quality_table_grows():
    assert [quality.bits_for(x) for x in (0, 1 << 30, (1 << 30) + 1, 1 << 32, (1 << 32) + 1, 1 << 47)] == [15, 15, 16, 16, 17, 24]


def test_kth_largest(spark):
    x = np.random.default_rng(0).normal(size=3000).round(1)
    df = spark.createDataFrame([(float(v),) for v in x], "k double")
    for k in (1, 17, 2999, 3000):
        got = quality.kth_largest(df, "k", k, few=50)
        assert got == sorted(x, reverse=True)[k - 1] or k == 3000 and got == -math.inf


# 9
def lcs(a, b):
    d = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            d[i + 1, j + 1] = d[i, j] + 1 if x == y else max(d[i, j + 1], d[i + 1, j])
    return d[-1, -1]


def test_longest_common_subsequence():
    rng = np.random.default_rng(10)
    for _ in range(200):
        a, b = (list(rng.integers(0, 6, rng.integers(0, 14))) for _ in range(2))
        at = html_diff.common(a, b)
        assert at == sorted(set(at)) and len(at) == lcs(a, b)
        rest = iter(b)
        assert all(any(a[i] == y for y in rest) for i in at)
    assert len(html_diff.common(list(range(3000)), list(range(1, 3001)))) == 2999


def test_html_lines():
    html = "<head><title>T</title></head><p>a &amp; b<br>c<b>d</b></p><script>x()</script><!-- no --><ul><li> e  f <li>g</ul><style>unclosed"
    assert html_diff.lines_of(html) == ["a & b", "cd", "e f", "g"]
    assert html_diff.lines_of(None) == [] and html_diff.lines_of("<script>") == []


@pytest.mark.parametrize(
    "html, lines",
    [
        ("<html><head><title>x</title><body><p>whole text</p></body></html>", ["whole text"]),
        ("<head><meta charset=utf-8><title>x</title><script>a</script><p>whole <b>text</b></p>", ["whole text"]),
        ("<head><link rel=a>text<p>more</p>", ["text", "more"]),
        ("<head><title>x<body><p>text</p>", ["text"]),
        ('<p>a</p><svg width="1"/><p>whole text</p>', ["a", "whole text"]),
        ("<p>a</p><template/><p>b</p><template><p>no</p></template><p>c</p>", ["a", "b", "c"]),
        ("<p>a</p><svg><g><p>b</p><svg><text>no</text></svg><p>c</p>", ["a", "b", "c"]),
        ("<p>a</p><svg>no<svg>no</svg>no</svg><p>b</p>", ["a", "b"]),
        ("<svg-icon>a</svg-icon><header>b</header><p>c</p><!-- no <p>d</p>", ["a", "b", "c"]),
    ],
)
def test_html_lines_of_unclosed(html, lines):
    assert html_diff.lines_of(html) == lines


def test_html_diff_against_brute_force(spark):
    rng, rows = np.random.default_rng(11), []
    for i in range(900):
        host = ("hot.example.com", "cold.example.org", f"h{i % 9}.net")[min(2, int(rng.integers(0, 5)))]
        lines = [f"menu {host}", *[f"text {rng.integers(0, 40)}" for _ in range(rng.integers(1, 6))], f"foot {host}"]
        rows.append((i, f"http://{host}/d{rng.integers(0, 5)}/p{rng.integers(0, 300)}", "".join(f"<p>{x}</p>" for x in lines)))
    rows += [(None, "http://hot.example.com/d1/x", "<p>a"), (2000, None, "<p>b"), (2001, "nothing", "<p>c"), (2002, "http://alone.com/", "<p>d"), (2003, "http://cold.example.org/", None), (2004, "HTTP://cold.example.org", ""), rows[0]]
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    df = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string").repartition(5)
    got = sorted((repr(tuple(r)) for r in html_diff.extract(df).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    keyed = []
    for i, u, h in rows:
        host, path = "", ""
        if u and "://" in u:
            host, _, path = u.split("://", 1)[1].partition("/")
            path = "/" + path if "/" in u.split("://", 1)[1] else ""
        keyed.append((f"{host.lower()}\x01{path}", html_diff.LEAST if i is None else i, "\n".join(html_diff.lines_of(h)), i))
    keyed.sort(key=lambda x: x[:3])
    pick = lambda k: (keyed[k][0], keyed[k][3], keyed[k][2]) if 0 <= k < len(keyed) else None
    want = sorted(repr(html_diff.differenced(pick(k - 1), pick(k), pick(k + 1))) for k in range(len(keyed)))
    assert got == want
    assert html_diff.extract(df.where("false")).count() == 0


def test_html_diff_against_another_reader(spark):
    """Lines by the standard library's parser, pairs by sorting all pages, deletions by a table of lengths."""
    from html.parser import HTMLParser
    from urllib.parse import urlsplit

    blocks = {"p", "div", "li", "ul", "br", "h1", "body", "html", "table", "tr", "td"}

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.out, self.off = [""], 0

        def handle_starttag(self, tag, _):
            self.off += tag in ("script", "style", "head")
            if tag in blocks:
                self.out.append("")

        def handle_endtag(self, tag):
            self.off -= tag in ("script", "style", "head")
            if tag in blocks:
                self.out.append("")

        def handle_data(self, data):
            if not self.off:
                self.out[-1] += data

    def read(html):
        reader = Reader()
        reader.feed(html)
        reader.close()
        return [y for y in (" ".join(o.split()) for o in reader.out) if y]

    rng, rows = np.random.default_rng(21), []
    for i in range(160):
        host = f"h{rng.integers(0, 3)}.com"
        body = "".join(f"<{t}>{w}&amp;{k}</{t}>" for k, (t, w) in enumerate((rng.choice(["p", "div", "li"]), f"x{rng.integers(0, 6)}") for _ in range(rng.integers(1, 8))))
        rows.append((i, f"https://{host}/{rng.choice(['a', 'ab', 'b'])}/{rng.integers(0, 50):02}", f"<html><head><title>t</title><style>p</style></head><body><ul><li>home<li>{host}</ul><script>if(a<b)x()</script>{body}<p>end"))
    lines = {i: read(h) for i, _, h in rows}
    place = {i: (urlsplit(u).netloc, urlsplit(u).path) for i, u, _ in rows}
    order = sorted(place, key=lambda i: (*place[i], i))
    want = {}
    for at, i in enumerate(order):
        near = [j for j in order[max(0, at - 1) : at] + order[at + 1 : at + 2] if place[j][0] == place[i][0] and lines[j] != lines[i]]
        if not near and lines[i]:
            back = next((j for j in order[:at][::-1] if place[j][0] == place[i][0] and lines[j] != lines[i]), None)
            on = next((j for j in order[at + 1 :] if place[j][0] == place[i][0] and lines[j] != lines[i]), None)
            near = [j for j in (back, on) if j is not None]
        best = max(near, key=lambda j: len(os.path.commonprefix([place[i][1], place[j][1]])), default=None)
        want[i] = (best, len(lines[i]), int(lcs(lines[i], lines[best])) if best is not None else 0)
    got = {r.page_id: r for r in html_diff.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {i: (r.paired_with, r.n_lines, r.n_shared) for i, r in got.items()} == want
    for i, r in got.items():
        left, rest = r.text.split("\n") if r.text else [], iter(lines[i])
        assert len(left) == want[i][1] - want[i][2] and all(any(x == y for y in rest) for x in left)


def test_html_diff_deletes_the_template(spark):
    page = "<nav>menu</nav><p>{}</p><footer>foot</footer>"
    rows = [(1, "http://x.com/a/1", page.format("one")), (2, "http://x.com/a/2", page.format("two")), (3, "http://y.com/a/3", page.format("three"))]
    got = {r.page_id: r for r in html_diff.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert (got[1].text, got[1].paired_with, got[1].n_lines, got[1].n_shared) == ("one", 2, 3, 2)
    assert got[2].text == "two" and got[3].text == "menu\nthree\nfoot" and got[3].paired_with is None


def test_html_diff_looks_beyond_copies(spark):
    """Runs of copies over several ranges, and on both sides."""
    page = "<p>menu</p><p>{}</p><p>foot</p>"
    urls = [(i, f"http://x.com/b/{i:04}", page.format("same")) for i in range(10, 500)]
    rows = [(1, "http://x.com/a/1", page.format("first")), *urls, (900, "http://x.com/b/9", page.format("last")), (901, "http://y.com/b/9", page.format("same"))]
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    got = {r.page_id: r for r in html_diff.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(got) == len(rows) and got[901].paired_with is None
    assert all((got[i].text, got[i].n_shared) == ("same", 2) for i in range(10, 500))
    assert got[10].paired_with == 1 and {got[i].paired_with for i in range(11, 500)} == {900}


# 10
def test_line_dedup_against_brute_force(spark):
    rng = np.random.default_rng(12)
    rows = [(int(i), "\n".join(f" line {x} " if x % 2 else f"line {x}\r" for x in rng.integers(0, 80, rng.integers(1, 12)))) for i in rng.permutation(150)]
    rows += [(900, None), (901, ""), (902, " \n\n"), (904, "one"), (904, "one"), (905, "line 1\n" * 4000), (None, "line 7")]
    docs = frame(spark, rows)
    got = line_dedup.line_dedup(docs).collect()
    runs = {r.doc_id: r.keep_runs for r in got}
    seen, want = set(), {}
    for i, t in sorted({r for r in rows if r[0] is not None}, key=lambda r: r[0]):
        keep = []
        for line in [] if t is None else t.split("\n"):
            x = line.strip(" \t\r")
            keep.append(not x or x not in seen)
            seen.add(x)
        out, now = [], True
        for k in keep:
            if not out or k != now:
                if not out and not k:
                    out.append(0)
                out.append(0)
                now = k
            out[-1] += 1
        want[i] = out
    assert runs == want and len(got) == len(want)
    text = docs.where("doc_id < 200").join(line_dedup.line_dedup(docs).select("doc_id", "keep_runs"), "doc_id").select("doc_id", "text", line_dedup.apply_runs(F.col("text"), F.col("keep_runs")).alias("left"))
    for r in text.collect():
        flags = [k for n, k in zip(want[r.doc_id], [True, False] * len(want[r.doc_id])) for _ in range(n)]
        assert r.left == "\n".join(x for x, k in zip(r.text.split("\n"), flags) if k)
    assert line_dedup.line_dedup(frame(spark, [])).count() == 0


def test_line_dedup_in_small_flushes(spark, monkeypatch):
    """The same result whatever is dropped before the shuffle."""
    rows = [(i, "hot\n" + words(i, 3, 5).replace(" ", "\n") + "\nhot") for i in range(60)] + [(3, "hot\n" + words(3, 3, 5).replace(" ", "\n") + "\nhot")]
    want = sorted(map(repr, line_dedup.line_dedup(frame(spark, rows)).collect()))
    monkeypatch.setattr(line_dedup, "FLUSH", 7)
    assert sorted(map(repr, line_dedup.line_dedup(frame(spark, rows).repartition(5)).collect())) == want


def test_line_hashes_do_not_collide_together(spark):
    """Two lines with one 64-bit hash, made by undoing a round of it, differ in the other."""
    m, p1, p2 = (1 << 64) - 1, 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F
    step = lambda acc, x: (lambda y: ((y << 31 | y >> 33) & m) * p1 & m)((acc + x * p2) & m)
    start, a, b = (42 + p1 + p2) & m, 1, 2
    back = (step(start, a) - step(start, b)) * pow(p2, -1, 1 << 64) & m
    lane = lambda x: x.to_bytes(8, "little")
    rest = bytes(24)
    one, two = lane(a) + rest + lane(5) + rest, lane(b) + rest + lane((5 + back) & m) + rest
    h1, h2 = line_dedup.hashes(F.col("line"))
    got = spark.createDataFrame([(bytearray(one),), (bytearray(two),)], "line binary").select(h1.alias("h1"), h2.alias("h2")).collect()
    assert got[0].h1 == got[1].h1 and got[0].h2 != got[1].h2

"""N-gram Jaccard self-join by grouped prefixes (operator 6).

Exact: it finds every pair of documents whose sets of word n-grams have a Jaccard
similarity of at least ``threshold``.

1. Each task hashes its documents' n-grams to 48 bits, some millions at a time, and sends
   the distinct ones with how many of these documents have them, sorted and delta-coded, to
   ranges of the hash. Which document has which gram goes to the flush's own group.
2. A range adds up in how many documents each gram occurs and tells the flushes which of
   their grams two documents or more have. A gram comes to its range once a flush, however
   many documents have it. A gram that only one document has can't be shared; it only
   counts in sizes and positions.
3. Grams are ordered by document frequency (on a logarithmic scale), then hash. The
   prefix of a set of n grams is its first n - ceil(t n) + 1. A document whose prefix
   holds no shared gram is dropped here: it has no partner.
4. Documents with an identical prefix and size form one group. Groups are joined on
   the grams of their prefixes, with the size and position filters.
5. Group pairs are expanded to their distinct sets, and those are verified in full, in
   blocks, so that a set travels once for many of its pairs.

Documents with the same set of grams (by a 128-bit hash of the sorted set) are one class,
so thousands of copies aren't millions of pairs. ``similar`` returns the join in this form:
the classes' members (``doc_id``, ``set_id``: the smallest doc_id of the class) and pairs
of classes (``a``, ``b``, ``jaccard``). ``pairs_of`` expands them to single pairs.

``jaccard_join`` has a row for each document that has a partner: ``doc_id``, ``class_id``
(the smallest doc_id of its connected group, through links of any number) and ``n_links``,
how many other documents have the similarity with it, counted over all of them.

Defined cases: a null doc_id, a null text and a text without words have no partner. A
text of fewer than n words is one gram. Rows that repeat a doc_id count once, the one
with the largest set, of equal sizes that with the larger hash. Columns other than
``doc_id`` and ``text`` are not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.llm import textvec
from webloom.session import cut, maybe_broadcast

BITS = 48
FLUSH_GRAMS, FLUSH_DOCS, BLOCK = 1_000_000, 60_000, 1 << 17
#: Bytes of text to a range: about a million grams.
RANGE_BYTES = 6 << 20
_SENT = "r int, flush long, kind int, body binary"
_SENT_ARROW = pa.schema([("r", pa.int32()), ("flush", pa.int64()), ("kind", pa.int32()), ("body", pa.binary())])
_SETS = "doc_id long, n int, shared int, k int, prefix binary, fp binary, grams array<long>"
_SETS_ARROW = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("shared", pa.int32()), ("k", pa.int32()), ("prefix", pa.binary()), ("fp", pa.binary()), ("grams", pa.list_(pa.int64()))])
#: Kinds of what is sent: distinct grams to a range, a flush's documents, its postings; an answer of a range.
GRAMS, DOCS, POSTINGS, ANSWER = range(4)
_DOC = np.dtype([("id", np.int64), ("n", np.int64), ("fp", "V16")])


def _pack(tok: np.ndarray) -> bytes:
    """Sorted 48-bit numbers as 32-bit steps, or plainly, if a step is larger."""
    step = np.diff(tok, prepend=tok[:1])
    wide = bool(len(step)) and int(step.max()) >> 32 > 0
    head = np.array([len(tok), int(wide), int(tok[0]) if len(tok) else 0], np.int64).tobytes()
    return head + (tok.tobytes() if wide else step.astype(np.uint32).tobytes())


def _unpack(body: bytes, at: int = 0) -> tuple[np.ndarray, int]:
    """The numbers, and where they end."""
    n, wide, first = (int(x) for x in np.frombuffer(body, np.int64, 3, at))
    at += 24
    if wide:
        return np.frombuffer(body, np.uint64, n, at), at + 8 * n
    return np.cumsum(np.frombuffer(body, np.uint32, n, at), dtype=np.uint64) + np.uint64(first), at + 4 * n


def _pack_times(times: np.ndarray) -> bytes:
    """Numbers of which most are 1: the places and values of the others."""
    some = np.flatnonzero(times > 1)
    return np.array([len(times), len(some)], np.int64).tobytes() + some.astype(np.uint32).tobytes() + times[some].astype(np.uint16).tobytes()


def _unpack_times(body: bytes, at: int) -> tuple[np.ndarray, int]:
    n, some = (int(x) for x in np.frombuffer(body, np.int64, 2, at))
    out = np.ones(n, np.int64)
    out[np.frombuffer(body, np.uint32, some, at + 16)] = np.frombuffer(body, np.uint16, some, at + 16 + 4 * some)
    return out, at + 16 + 6 * some


def _table(rows: list[tuple]) -> list[pa.Array]:
    return [pa.array(x, t.type) for x, t in zip(zip(*rows) if rows else [[]] * 4, _SENT_ARROW)]


def _send(n_grams: int, ranges: int):
    """Documents to (range, flush, kind, body)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seq = TaskContext.get().partitionId(), 0
        docs, toks, held = [], [], 0

        def flush():
            nonlocal seq, held
            key = (task << 24) | seq
            seq += 1
            tok = np.concatenate(toks)
            doc = np.repeat(np.arange(len(docs), dtype=np.uint16), [len(t) for t in toks])
            order = np.argsort(tok, kind="stable")
            tok, doc = tok[order], doc[order]
            first = np.flatnonzero(np.r_[True, tok[1:] != tok[:-1]])
            times, tok = np.diff(np.r_[first, len(tok)]), tok[first]
            width = -(-(1 << BITS) // ranges)
            place = (tok // np.uint64(width)).astype(np.int64)
            start = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
            rows = []
            for a, b in zip(start.tolist(), [*start[1:].tolist(), len(tok)]):
                rows.append((int(place[a]), key, GRAMS, np.int64(a).tobytes() + _pack(tok[a:b]) + _pack_times(times[a:b])))
            rows.append((key % ranges, key, DOCS, np.array(docs, _DOC).tobytes()))
            rows.append((key % ranges, key, POSTINGS, _pack_times(times) + doc.tobytes()))
            docs.clear()
            toks.clear()
            held = 0
            return pa.RecordBatch.from_arrays(_table(rows), schema=_SENT_ARROW)

        for batch in batches:
            doc_ids = batch.column(0).to_numpy(zero_copy_only=False)
            for at, part in textvec.slices(batch.column(1)):
                h, off = textvec.words(part)
                g, off = textvec.grams(h, off, n_grams)
                g >>= np.uint64(64 - BITS)
                for i in range(len(part)):
                    s = np.unique(g[off[i] : off[i + 1]])
                    if not len(s):
                        continue
                    docs.append((int(doc_ids[at + i]), len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest()))
                    toks.append(s)
                    held += len(s)
                    if held >= FLUSH_GRAMS or len(docs) >= FLUSH_DOCS:
                        yield flush()
        if docs:
            yield flush()
        textvec.release()

    return run


def _count(table: pa.Table) -> pa.Table:
    """In a range: tell the flushes which of their grams two documents or more have, with the frequency."""
    kinds, keys, bodies = (table.column(c).to_pylist() for c in ("kind", "flush", "body"))
    rows = [(-1, k, kind, b) for k, kind, b in zip(keys, kinds, bodies) if kind != GRAMS]
    parts = []
    for k, kind, b in zip(keys, kinds, bodies):
        if kind == GRAMS:
            tok, at = _unpack(b, 8)
            parts.append((k, b[:8], tok, _unpack_times(b, at)[0]))
    if parts:
        tok = np.concatenate([p[2] for p in parts])
        order = np.argsort(tok)
        s = tok[order]
        first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        total = np.add.reduceat(np.concatenate([p[3] for p in parts])[order], first)
        df = np.empty(len(s), np.int64)
        df[order] = np.repeat(total, np.diff(np.r_[first, len(s)]))
        rank = np.minimum(255, np.floor(16 * np.log2(df))).astype(np.uint8)  # df 1 is 0; monotone in df
        at = 0
        for k, start, t, _ in parts:
            keep = df[at : at + len(t)] >= 2
            if keep.any():
                rows.append((-1, k, ANSWER, start + np.int64(len(t)).tobytes() + np.packbits(keep).tobytes() + _pack(t[keep]) + rank[at : at + len(t)][keep].tobytes()))
            at += len(t)
    textvec.release()
    return pa.Table.from_arrays(_table(rows), schema=_SENT_ARROW)


def _prefixes(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        kinds, bodies = table.column("kind").to_pylist(), table.column("body").to_pylist()
        docs = np.frombuffer(bodies[kinds.index(DOCS)], _DOC)
        postings = bodies[kinds.index(POSTINGS)]
        times, at = _unpack_times(postings, 0)
        doc = np.frombuffer(postings, np.uint16, int(times.sum()), at)
        tok, rank, shared = np.zeros(len(times), np.uint64), np.zeros(len(times), np.uint8), np.zeros(len(times), bool)
        for b, kind in zip(bodies, kinds):
            if kind == ANSWER:
                start, many = (int(x) for x in np.frombuffer(b, np.int64, 2))
                here = start + np.flatnonzero(np.unpackbits(np.frombuffer(b, np.uint8, -(-many // 8), 16), count=many))
                t, at = _unpack(b, 16 - (-many // 8))
                tok[here], rank[here], shared[here] = t, np.frombuffer(b, np.uint8, len(t), at), True
        out: list[list] = [[] for _ in _SETS_ARROW]
        if shared.any():
            mine = np.repeat(shared, times)
            doc, tok, rank = doc[mine], np.repeat(tok[shared], times[shared]), np.repeat(rank[shared], times[shared])
            order = np.lexsort((tok, rank, doc))
            tok, doc = tok[order].view(np.int64), doc[order]
            size = np.bincount(doc, minlength=len(docs))
            start = np.r_[0, np.cumsum(size)]
            n = docs["n"]
            prefix = n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1
            k = np.minimum(prefix - (n - size), size)
            for i in np.flatnonzero(k > 0):
                grams = tok[start[i] : start[i + 1]]
                for col, x in zip(out, (docs["id"][i], n[i], size[i], k[i], hashlib.blake2b(grams[: k[i]].tobytes(), digest_size=16).digest(), docs["fp"][i].tobytes(), grams)):
                    col.append(x)
        textvec.release()
        return pa.Table.from_arrays([pa.array(x, t.type) for x, t in zip(out, _SETS_ARROW)], schema=_SETS_ARROW)

    return run


def similar(docs: DataFrame, threshold: float = 0.55, n: int = 3) -> tuple[DataFrame, DataFrame]:
    """Members (doc_id, set_id) of the classes of equal sets, and pairs (a, b, jaccard) of different classes."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    docs = docs.select(F.col("doc_id").cast("long"), F.lower("text").alias("text")).where("doc_id is not null and text is not null")
    ranges = max(16, (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // RANGE_BYTES)
    sent = docs.mapInArrow(_send(n, ranges), _SENT)
    back = sent.groupBy("r").applyInArrow(_count, _SENT)
    sets = cut(back.groupBy("flush").applyInArrow(_prefixes(threshold), _SETS), "jaccard-sets")
    if not sets.groupBy("doc_id").count().where("count > 1").isEmpty():
        best = sets.groupBy("doc_id").agg(F.max_by(F.struct(*sets.columns[1:]), F.struct("n", "fp")).alias("s"))
        sets = cut(best.select("doc_id", "s.*"), "jaccard-once")
    key = ["prefix", "n", "shared"]
    classes = sets.groupBy("fp").agg(F.min("doc_id").alias("c"), F.count("*").alias("many"), *[F.first(c).alias(c) for c in key])
    classes = cut(classes.withColumn("g", F.min("c").over(Window.partitionBy(*key))).select("g", "c", "n", "many", "fp"), "jaccard-classes")
    # only sets of several documents need a join to tell their class
    many = classes.where("many > 1").select("fp", F.col("c").alias("first"))
    members = cut(sets.select("doc_id", "fp").join(maybe_broadcast(many, 64), "fp", "left").select("doc_id", F.coalesce("first", "doc_id").alias("set_id")), "jaccard-members")
    first = sets.select("doc_id", "n", (F.col("n") - F.col("shared")).alias("before"), F.slice("grams", F.lit(1), F.col("k")).alias("grams"))
    reps = first.join(maybe_broadcast(classes.select(F.col("g").alias("doc_id")).distinct(), 32), "doc_id")
    steps = F.arrays_zip(F.col("grams").alias("gram"), F.concat(F.array(F.lit(-1).cast("long")), F.slice("grams", F.lit(1), F.size("grams") - 1)).alias("last"))
    post = reps.select(F.col("doc_id").alias("g"), "n", "before", F.posexplode(steps).alias("i", "s"))
    post = post.select("g", "n", F.col("s.gram").alias("gram"), F.col("s.last").alias("last"), (F.col("before") + F.col("i")).alias("at"))
    a, b = post.alias("a"), post.alias("b")
    need = F.ceil(F.lit(threshold / (1 + threshold)) * (F.col("a.n") + F.col("b.n")) - 1e-9)
    left = F.least(F.col("a.n") - F.col("a.at"), F.col("b.n") - F.col("b.at"))
    near = (F.least("a.n", "b.n") >= F.lit(threshold) * F.greatest("a.n", "b.n") - 1e-9) & (left >= need)
    # where the grams before are equal too, the pair was found there, as the bound of the position was looser
    new = (F.col("a.last") != F.col("b.last")) | (F.col("a.last") < 0)
    groups = a.join(b, (F.col("a.gram") == F.col("b.gram")) & (F.col("a.g") < F.col("b.g")) & near & new).select(F.col("a.g").alias("ga"), F.col("b.g").alias("gb")).distinct()
    ca = classes.select(F.col("g").alias("ga"), F.col("c").alias("a"), F.col("n").alias("na"))
    cb = classes.select(F.col("g").alias("gb"), F.col("c").alias("b"), F.col("n").alias("nb"))
    across = groups.join(ca, "ga").join(cb, "gb").select("a", "b", "na", "nb")
    inside = ca.join(cb, (F.col("ga") == F.col("gb")) & (F.col("a") < F.col("b"))).select("a", "b", "na", "nb")
    pairs = _verified(cut(across.union(inside), "jaccard-pairs"), sets.select("doc_id", "n", "grams"), threshold)
    return members, cut(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "jaccard"), "jaccard-found")


def jaccard_join(docs: DataFrame, threshold: float = 0.55, n: int = 3) -> DataFrame:
    """doc_id, class_id and n_links of every document that has a partner."""
    members, pairs = similar(docs, threshold, n)
    sizes = members.groupBy("set_id").agg(F.count("*").alias("many"))
    both = pairs.select("a", "b").union(pairs.select("b", "a"))
    links = both.join(sizes.withColumnRenamed("set_id", "b"), "b").groupBy("a").agg(F.sum("many").alias("others"))
    per_set = sizes.join(links.withColumnRenamed("a", "set_id"), "set_id", "left").join(groups_of(pairs), "set_id", "left")
    per_set = per_set.select("set_id", F.coalesce("group_id", "set_id").alias("class_id"), (F.col("many") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")).where("n_links > 0")
    per_set = cut(per_set, "jaccard-per-set")
    return members.join(maybe_broadcast(per_set, 48), "set_id").select("doc_id", "class_id", "n_links")


_PAIRS = "a long, b long, jaccard double"
_PAIRS_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("jaccard", pa.float64())])


def _verify(threshold: float):
    """Exact similarities of the pairs of one block; few grams in all go by one matrix product."""

    def run(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        a, b = pairs.column("a").to_numpy(), pairs.column("b").to_numpy()
        ids = sets.column("doc_id").to_numpy()
        order = np.argsort(ids)
        n = sets.column("n").to_numpy()
        grams = sets.column("grams").combine_chunks()
        off, values = grams.offsets.to_numpy(), grams.values.to_numpy()
        ia, ib = (order[np.searchsorted(ids, x, sorter=order)] for x in (a, b))
        different, place = np.unique(values[off[0] : off[-1]], return_inverse=True)
        if len(ids) * len(different) <= 1 << 24 and len(a) > 2 * len(ids):
            has = np.zeros((len(ids), len(different)), np.float32)
            has[np.repeat(np.arange(len(ids)), np.diff(off)), place] = 1
            both = (has @ has.T)[ia, ib].astype(np.int64)
        else:
            both, mark, last = np.empty(len(ia), np.int64), np.zeros(len(different), bool), -1
            for p in np.argsort(ia, kind="stable"):
                if ia[p] != last:
                    mark[:] = False
                    last = ia[p]
                    mark[place[off[last] - off[0] : off[last + 1] - off[0]]] = True
                both[p] = np.count_nonzero(mark[place[off[ib[p]] - off[0] : off[ib[p] + 1] - off[0]]])
        jaccard = both / (n[ia].astype(np.int64) + n[ib] - both)
        ok = jaccard >= threshold
        textvec.release()
        return pa.Table.from_arrays([pa.array(x[ok]) for x in (a, b, jaccard)], schema=_PAIRS_ARROW)

    return run


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b, na, nb) that are similar enough, with their similarity.

    Sets don't travel once per pair. Documents that have the same smallest partner are put
    into blocks of about ``BLOCK`` grams, and a set travels once to each pair of blocks that
    has a pair with it: once for most documents, and once a block of its cluster for others.
    """
    links = pairs.select(F.col("a").alias("doc_id"), F.col("na").alias("n"), F.col("b").alias("other")).union(pairs.select("b", "nb", "a"))
    lead = links.groupBy("doc_id").agg(F.least("doc_id", F.min("other")).alias("lead"), F.max("n").alias("n"))
    parts = F.ceil(F.sum("n").over(Window.partitionBy("lead")) / BLOCK)
    block = cut(lead.select("doc_id", F.xxhash64("lead", F.pmod(F.xxhash64("doc_id"), parts)).alias("block")), "jaccard-blocks")
    ba = block.select(F.col("doc_id").alias("a"), F.col("block").alias("x"))
    bb = block.select(F.col("doc_id").alias("b"), F.col("block").alias("y"))
    placed = cut(pairs.join(ba, "a").join(bb, "b").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "a", "b"), "jaccard-placed")
    wanted = cut(placed.select(F.col("x").alias("p"), F.col("y").alias("q"), F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "jaccard-wanted")
    sent = sets.join(maybe_broadcast(wanted, 48), "doc_id")
    return placed.groupBy("x", "y").cogroup(sent.groupBy("p", "q")).applyInArrow(_verify(threshold), _PAIRS)


def pairs_of(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """Single pairs (doc_id_a < doc_id_b, jaccard) from the result of ``similar``."""
    x = members.select(F.col("doc_id").alias("x"), F.col("set_id").alias("a"))
    y = members.select(F.col("doc_id").alias("y"), F.col("set_id").alias("b"))
    copies = x.join(y, (F.col("a") == F.col("b")) & (F.col("x") < F.col("y"))).select("x", "y", F.lit(1.0).alias("jaccard"))
    found = pairs.join(x, "a").join(y, "b").select("x", "y", "jaccard").union(copies)
    return found.select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"), "jaccard")


def groups_of(pairs: DataFrame) -> DataFrame:
    """(set_id, group_id) of every class that has a pair: the smallest of its connected group.

    Every round takes the smallest label among neighbours and then follows labels to
    their own label (pointer jumping), so the rounds grow with the logarithm of the
    longest chain; each round is a written table.
    """
    both = cut(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).union(pairs.select("b", "a")), "links")
    label = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("label")), "labels")
    while True:
        near = both.join(label.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.min("label").alias("m"))
        step = label.join(near, "u").select("u", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        up = step.select(F.col("u").alias("label"), F.col("label").alias("up"))
        after = cut(step.join(up, "label", "left").select("u", "old", F.least("label", F.coalesce("up", "label")).alias("label")), "labels")
        if after.where("label != old").isEmpty():
            return after.select(F.col("u").alias("set_id"), F.col("label").alias("group_id"))
        label = after.select("u", "label")


ORACLE = f"""
with recursive w as (
  select doc_id, list_filter(string_split_regex(lower(text), '[{textvec.SEPARATORS}]+'), lambda x: x <> '') as ws
  from documents where doc_id is not null and text is not null
), s as (
  select doc_id, case when len(ws) >= 3 then list_sort(list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2])))
    else [array_to_string(ws, ' ')] end as g
  from w where len(ws) > 0
), c as (
  select g, min(doc_id) as c, list_sort(list(doc_id)) as members, len(g) as n from s group by g
), t as (select c, n, unnest(g) as gram from c),
o as (
  select a.c as a, b.c as b, a.n as na, b.n as nb, count(*) as inter
  from t a join t b on a.gram = b.gram and a.c < b.c group by all
), p as (select a, b from o where inter / (na + nb - inter) >= 0.55),
e as (select a, b from p union all select b, a from p),
r as (select c as x, c as y from c union select r.x, e.b from r join e on e.a = r.y),
k as (select x, min(y) as class_id from r group by x),
m as (select c.c, len(members) - 1 + coalesce((select sum(len(d.members)) from e join c d on d.c = e.b where e.a = c.c), 0) as n_links from c)
select unnest(c.members) as doc_id, k.class_id, m.n_links::bigint as n_links from c join k on k.x = c.c join m on m.c = c.c where m.n_links > 0
"""

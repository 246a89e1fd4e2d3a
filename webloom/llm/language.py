"""Language identification by rank-order profiles (operator 2).

A profile is the ``RANKS`` most frequent character n-grams (n = 1 to 3) in order of
frequency. A document's own profile, taken over its whole text, is compared with each
language's by out-of-place distance: for each of its n-grams the difference of ranks, or
``RANKS`` if the language's profile lacks it. The nearest language wins (Cavnar and
Trenkle, 1994). Texts are lower-cased, runs of characters other than letters become one
blank, and a blank is set before and after, so n-grams know where words begin and end.
Ties of frequency go to the shorter, then the smaller n-gram by code points, ties of
distance to the smaller language name.

Three code points fit into 63 bits, so n-grams are counted exactly as numbers in numpy,
and a batch never makes a Python object per n-gram. Lower case and blanks come from a
table of code points, in pieces of ``SPAN`` bytes, so the JVM makes no strings for them.

Lower case is by single code points, as in SQL: there is no final sigma, and the capital
I with a dot is an i. Letters are those of this Python's Unicode.

Bound: a language's profile is made from the ``PER_LANGUAGE`` labelled documents with the
least hashes. Every document is classified by its whole text.

Columns: ``doc_id``, ``lang`` (the language found, "und" if there is no letter) and
``distance`` (the mean per n-gram of the document's profile; null with "und").

Defined cases: null and empty texts and texts without a letter are "und". Bytes that are not
UTF-8 count as blanks. Null ids are classified too; they don't train. Rows with a null lang don't train. Repeated rows are
each classified. Without any labelled document all are "und". Extra columns are ignored.
An empty table gives an empty result.
"""

from __future__ import annotations

import codecs
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from webloom.session import cut, maybe_broadcast

RANKS = 300
PER_LANGUAGE = 400
SPAN = 1 << 20
SEED = 2


#: No code point from here on is a letter.
END = 0x40000


@cache
def _letters() -> np.ndarray:
    """The lower case of each code point under ``END``, or a blank where that is no letter; one blank more."""
    low = (chr(i).lower()[0] for i in range(END))
    return np.append(np.fromiter((ord(x) if unicodedata.category(x)[0] == "L" else 32 for x in low), np.int64, END), 32)


def letters(text: bytes) -> Iterator[np.ndarray]:
    """Code points of a text in lower case, in pieces. Runs of other than letters are one blank, and one is at the end; a blank at the beginning is left out."""
    known, decoder, last = _letters(), codecs.getincrementaldecoder("utf-8")("replace"), False
    for at in range(0, len(text), SPAN):
        end = at + SPAN >= len(text)
        c = np.frombuffer(decoder.decode(text[at : at + SPAN], end).encode("utf-32-le"), np.uint32)
        c = known.take(c, mode="clip")
        if end:
            c = np.append(c, 32)
        letter = c != 32
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        keep[:1] |= last
        last = letter[-1] if len(c) else last
        if keep.any():
            yield c[keep]


def _codes(before: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The 1-, 2- and 3-grams that end at one of the code points ``c``, as numbers: shorter ones are smaller, then by code points."""
    s = np.concatenate([before, c])
    two = (s[:-1] << 21) | s[1:]
    return np.concatenate([c[c != 32], two[len(before) - 1 :], (two[:-1] << 21) | s[2:]])


def profile(text: bytes, ranks: int = RANKS) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent n-grams of a text, in order, and their counts."""
    u, n, before = np.empty(0, np.int64), np.empty(0, np.int64), np.array([32], np.int64)
    for c in letters(text):
        one, many = np.unique(_codes(before, c), return_counts=True)
        if len(u):
            u, inverse = np.unique(np.r_[u, one], return_inverse=True)
            n = np.bincount(inverse, np.r_[n, many]).astype(np.int64)
        else:
            u, n = one, many
        before = np.concatenate([before, c[-2:]])[-2:]
    if len(u) > ranks:
        least = np.partition(n, len(n) - ranks)[len(n) - ranks]
        u, n = u[n >= least], n[n >= least]
    order = np.argsort(-n, kind="stable")[:ranks]
    return u[order], n[order]


@dataclass
class Profiles:
    names: list[str]
    grams: np.ndarray  # sorted
    rank: np.ndarray  # per gram and language; -1 where the language lacks it

    @classmethod
    def of(cls, ranked: dict[str, list[int]]) -> Profiles:
        names = sorted(ranked)
        grams = np.unique(np.array([g for n in names for g in ranked[n]], np.int64))
        rank = np.full((len(grams) + 1, len(names)), -1, np.int64)
        for j, n in enumerate(names):
            rank[np.searchsorted(grams, np.array(ranked[n], np.int64)), j] = np.arange(len(ranked[n]))
        return cls(names, grams, rank)

    def nearest(self, text: bytes | None) -> tuple[str, float | None]:
        if not self.names or text is None:
            return "und", None
        mine, _ = profile(text)
        if not len(mine):
            return "und", None
        at = np.searchsorted(self.grams, mine)
        at[at == len(self.grams)] = 0
        at[self.grams[at] != mine] = len(self.grams)
        rank = self.rank[at]
        away = np.where(rank < 0, RANKS, np.abs(rank - np.arange(len(mine))[:, None])).sum(axis=0)
        j = int(np.argmin(away))
        return self.names[j], int(away[j]) / len(mine)


def _bytes(texts: pa.Array) -> Iterator[bytes | None]:
    return (t.as_py() for t in texts.cast(pa.large_binary()))


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), _bytes(batch.column(1))):
            u, n = profile(text, 1 << 62)
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(u), pa.string()), pa.array(u), pa.array(n)], ["lang", "gram", "n"])


def profiles(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Profiles:
    known = docs.where("lang is not null and doc_id is not null").select("doc_id", "lang")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id"))
    chosen = cut(known.withColumn("place", place).where(F.col("place") <= per_language).select("doc_id", "lang").distinct(), "lang-sample")
    texts = docs.where("text is not null").join(maybe_broadcast(chosen, 64), ["doc_id", "lang"]).select("lang", "text")
    grams = texts.mapInArrow(_train, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = grams.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("place") <= RANKS)
    ranked: dict[str, list[int]] = {}
    for r in top.orderBy("lang", "place").collect():
        ranked.setdefault(r.lang, []).append(r.gram)
    return Profiles.of(ranked)


def _finder(shared):
    kind = StructType([StructField("lang", StringType()), StructField("distance", DoubleType())])

    @arrow_udf(kind)
    def find(texts: pa.Array) -> pa.Array:
        found = [shared.value.nearest(t) for t in _bytes(texts)]
        return pa.StructArray.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([d for _, d in found], pa.float64())], ["lang", "distance"])

    return find


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """The language of every document."""
    find = _finder(docs.sparkSession.sparkContext.broadcast(profiles(docs, per_language)))
    return docs.select("doc_id", find(F.col("text")).alias("f")).select("doc_id", "f.*")


ORACLE = f"""
with t as (
  select doc_id, lang, ' ' || trim(regexp_replace(lower(text), '[^\\p{{L}}]+', ' ', 'g')) || ' ' as s from documents
), letters as (select * from t where trim(s) <> ''),
chosen as (
  select doc_id from (select doc_id, row_number() over (partition by lang order by md5(doc_id::varchar), doc_id) as place from documents where lang is not null and doc_id is not null) where place <= {PER_LANGUAGE}
), g as (
  select doc_id, lang, unnest(list_concat(
    list_filter(list_transform(range(1, len(s) + 1), lambda i: s[i:i]), lambda x: x <> ' '),
    list_transform(range(1, len(s)), lambda i: s[i:i+1]), list_transform(range(1, len(s) - 1), lambda i: s[i:i+2]))) as gram
  from letters
), n as (select doc_id, any_value(lang) as lang, gram, count(*) as n from g group by doc_id, gram),
own as (select * from (select doc_id, gram, row_number() over (partition by doc_id order by n desc, len(gram), gram) - 1 as r from n) where r < {RANKS}),
p as (
  select * from (
    select lang, gram, row_number() over (partition by lang order by n desc, len(gram), gram) - 1 as r
    from (select lang, gram, sum(n) as n from n where lang is not null and doc_id in (select doc_id from chosen) group by lang, gram)
  ) where r < {RANKS}
), names as (select distinct lang from p),
away as (
  select o.doc_id, l.lang, sum(case when p.r is null then {RANKS} else abs(p.r - o.r) end) as d, count(*) as n
  from own o cross join names l left join p on p.lang = l.lang and p.gram = o.gram group by o.doc_id, l.lang
), best as (select doc_id, arg_min(lang, {{'d': d, 'l': lang}}) as lang, min(d) / any_value(n) as distance from away group by doc_id)
select d.doc_id, coalesce(b.lang, 'und') as lang, b.distance::double as distance from documents d left join best b on b.doc_id = d.doc_id
"""

"""Words and n-grams of a whole Arrow batch as 64-bit hashes, in numpy.

A word is a maximal run of characters other than ``SEPARATORS`` in the lower-cased
text. Columns must be passed through SQL ``lower()`` before (ASCII is lowered here
anyway). The hash of a word is a polynomial over its UTF-8 bytes modulo 2**64, taken
from one running sum over the batch, then mixed, so no Python object is made per word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: The same separators as a regular expression class, for SQL engines.
SEPARATORS = r"\x00-\x2f\x3a-\x60\x7b-\x7f\x{80}-\x{bf}\x{2000}-\x{203f}\x{3000}-\x{303f}"

CHUNK = 1 << 20
_B = 0x9E3779B97F4A7C15 | 1
_INV = pow(_B, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SEP = np.ones(256, dtype=bool)
for _lo, _hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _IS_SEP[_lo:_hi] = False
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
_POW = np.ones(1, dtype=np.uint64)
_IPOW = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> None:
    global _POW, _IPOW
    if len(_POW) < n:
        full = np.full(max(n, CHUNK + 1), _B, dtype=np.uint64)
        full[0] = 1
        _POW = np.cumprod(full)
        full[1:] = _INV
        _IPOW = np.cumprod(full)


def release() -> None:
    """Give freed memory back: a worker that waits for its next task would hold it."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _separators(b: np.ndarray) -> np.ndarray:
    sep = _IS_SEP[b]
    n = len(b)
    for first, second in ((0xE2, 0x80), (0xE3, 0x80)):
        at = np.flatnonzero(b[: n - 2] == first) if n > 2 else np.empty(0, np.int64)
        at = at[b[at + 1] == second]
        sep[at] = sep[at + 1] = sep[at + 2] = True
    at = np.flatnonzero(b[: n - 1] == 0xC2) if n > 1 else np.empty(0, np.int64)
    sep[at] = sep[at + 1] = True
    return sep


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string array and the offsets of its values; a null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n, off = len(texts), texts.offset
    _, offsets, data = texts.buffers()
    if n == 0 or data is None:
        return np.empty(0, np.uint8), np.zeros(n + 1, np.int64)
    o = np.frombuffer(offsets, np.int64, n + 1, off * 8)
    return np.frombuffer(data, np.uint8)[o[0] : o[-1]], o - o[0]


def _pieces(b: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges of about CHUNK that end between documents or at a separator."""
    at, end = 0, len(b)
    while at < end:
        to = min(at + CHUNK, end)
        if to < end:
            k = int(np.searchsorted(off, to, "right")) - 1
            if off[k] > at:
                to = int(off[k])
            else:  # one document is longer: go on to the next blank
                step = 1 << 16
                stop = int(off[k + 1])
                while to < stop:
                    hit = np.flatnonzero(b[to : min(to + step, stop)] <= 32)
                    if len(hit):
                        to += int(hit[0])
                        break
                    to = min(to + step, stop)
        yield at, to
        at = to


def words(texts: pa.Array, punctuation: bool = False, stems: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and for each text the offset of its first (one more at the end).

    With ``punctuation``, runs of separators other than blanks are words too. With
    ``stems``, the hashes have a row for the words and one for each number of bytes: the
    hash of the word's beginning of that length, or the word's own where it is no longer.
    """
    b, off = raw(texts)
    hashes, counts = [], np.zeros(len(off) - 1, np.int64)
    for lo, hi in _pieces(b, off):
        c = _LOWER[b[lo:hi]]
        n = hi - lo
        _powers(n + 1)
        sep = _separators(c)
        cut = np.zeros(n + 1, bool)
        k0, k1 = np.searchsorted(off, lo, "left"), np.searchsorted(off, hi, "right")
        cut[off[k0:k1] - lo] = True
        cut[0] = cut[n] = True
        word = ~sep
        if punctuation:
            other = np.r_[word[1:] != word[:-1], True] | np.r_[(c[1:] <= 32) != (c[:-1] <= 32), True]
            word = c > 32
        else:
            other = np.r_[word[1:] != word[:-1], True]
        edge = other | cut[1:]
        stop = np.flatnonzero(word & edge) + 1
        start = np.flatnonzero(word & np.r_[True, edge[:-1]])
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        np.cumsum((c.astype(np.uint64) + np.uint64(1)) * _POW[:n], out=total[1:])
        ends = [stop, *(np.minimum(start + k, stop) for k in stems)]
        hashes.append(np.stack([mix((total[e] - total[start]) * _IPOW[start]) for e in ends]) if stems else mix((total[stop] - total[start]) * _IPOW[start]))
        doc = np.searchsorted(off, start + lo, "right") - 1
        counts += np.bincount(doc, minlength=len(counts))
    at = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=at[1:])
    none = np.empty((1 + len(stems), 0) if stems else 0, np.uint64)
    return np.concatenate([none, *hashes], axis=-1), at


_K = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(_B)) | np.uint64(1)


def grams(h: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word n-grams of each text and their offsets.

    A text of fewer than n words, but not none, has one gram of all its words.
    """
    if n == 1:
        return h, at
    sizes = np.diff(at)
    count = np.where(sizes >= n, sizes - n + 1, (sizes > 0).astype(np.int64))
    to = np.zeros(len(at), np.int64)
    np.cumsum(count, out=to[1:])
    if not len(h):
        return np.empty(0, np.uint64), to
    acc = np.zeros(len(h), np.uint64)
    end = np.repeat(at[1:], sizes)
    place = np.arange(len(h))
    for j in range(n):
        ok = place + j < end
        k = len(h) - j
        if k <= 0:
            break
        acc[:k] += np.where(ok[:k], h[j:] * _K[j], np.uint64(0))
    first = np.repeat(at[:-1], sizes)
    keep = (place + n <= end) | (place == first)
    return mix(acc[keep]), to


def slices(texts: pa.Array, limit: int = 4 * CHUNK) -> Iterator[tuple[int, pa.Array]]:
    """Parts of a batch of about ``limit`` bytes, each with the place of its first row."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return
    _, off = raw(texts)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield at, texts.slice(at, to - at)
        at = to

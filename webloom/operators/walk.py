"""The thin rest of a crawl, walked level by level in one task over numbered links.

A level costs some jobs however small it is, so thousands of small levels are no matter for
joins. The links go to one task by number, in the order of their sources, and lie in files
there; in memory are a byte for each page and what waits to be fetched. What is walked is
what the levels of ``engine`` would fetch, in the same order and with the same choice among
equal ones.
"""

from __future__ import annotations

import heapq
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: What ``walk`` takes: links by source, and with the source -1 what waits to be fetched.
TAKES = "src long, page long, url long, kind int, depth int, peeking boolean, hops int, most int"
#: What it gives: what was settled at each level, and at level -1 what still waits.
GIVES = "level long, url long, state int, depth int, peeking boolean, hops int, most int, free boolean"
ROWS = 50_000


@dataclass(frozen=True)
class Kind:
    """What links have in common; ``state`` is the number of (crawler, filetype) of what they lead to."""

    crawler: str
    work: str | None
    hop: bool
    route: str
    state: int
    free: bool


def walk(pages: int, kinds: list[Kind], parsed: list[tuple[str, str, int, int] | None], external: set[str], most_hops: int, wide: int) -> Callable:
    """A function for ``mapInArrow`` over one partition in the order of ``src``.

    ``parsed`` has (now, work, own limit, peek) by state, None for those without a parser. It stops
    before a level that could make more than ``wide`` pages wait.
    """

    def follow(state: int):
        if parsed[state] is None:
            return None
        now, work, own_limit, peek = parsed[state]
        own = {i: k for i, k in enumerate(kinds) if k.crawler == now and (k.hop or k.work == work)}
        return own_limit, peek, {i: (k.route, k.hop, k.state, k.free) for i, k in own.items()}, now in external

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        follows = [follow(s) for s in range(len(parsed))]
        best: dict[int, tuple] = {}  # by page: depth, peeking, hops, url, state, most, free; the least counts
        at: dict[int, list[int]] = {}
        depths: list[int] = []

        def offer(page: int, new: tuple) -> None:
            old = best.get(page)
            if old is None or new < old:
                best[page] = new
                if old is None or old[0] != new[0]:
                    if new[0] not in at:
                        at[new[0]] = []
                        heapq.heappush(depths, new[0])
                    at[new[0]].append(page)

        with tempfile.TemporaryDirectory() as folder:
            begins = np.zeros(pages + 1, np.int64)
            names = {"page": np.int64, "url": np.int64, "kind": np.int32}
            files = {n: open(f"{folder}/{n}", "wb") for n in names}  # noqa: SIM115
            for b in batches:
                src = b.column("src").to_numpy()
                waits = int(np.searchsorted(src, 0))
                for r in b.slice(0, waits).to_pylist():
                    k = kinds[r["kind"]]
                    offer(r["page"], (r["depth"], r["peeking"], r["hops"], r["url"], k.state, r["most"], k.free))
                if waits < len(src):
                    which, n = np.unique(src[waits:], return_counts=True)
                    begins[which + 1] += n
                    for name, f in files.items():
                        f.write(b.column(name).slice(waits).to_numpy().tobytes())
            for f in files.values():
                f.close()
            begins = np.cumsum(begins, out=begins)
            load = lambda n: np.asarray(np.memmap(f"{folder}/{n}", names[n], "r")) if begins[-1] else np.empty(0, names[n])
            to, url_of, kind_of = (load(n) for n in names)
            done = bytearray(pages)
            rows: list[tuple] = []
            level = 0
            while depths:
                least = depths[0]
                now = [p for p in dict.fromkeys(at[least]) if p in best and best[p][0] == least]
                if not now:
                    del at[heapq.heappop(depths)]
                    continue
                if len(best) + sum(int(begins[p + 1] - begins[p]) for p in now) > wide:
                    break
                del at[heapq.heappop(depths)]
                taken = [(p, best.pop(p)) for p in now]
                for p, _ in taken:
                    done[p] = 1
                for p, (depth, peeking, hops, url, state, most, free) in taken:
                    rows.append((level, url, state, depth, peeking, hops, most, free))
                    if not free or follows[state] is None:
                        continue
                    own_limit, peek, kinds_of, goes_out = follows[state]
                    lo, hi = int(begins[p]), int(begins[p + 1])
                    for q, u, i in zip(to[lo:hi].tolist(), url_of[lo:hi].tolist(), kind_of[lo:hi].tolist()):
                        if i not in kinds_of or done[q]:
                            continue
                        route, hop, next_state, next_free = kinds_of[i]
                        root = route == "peek" and not peeking
                        waits = route == "pending" or (route == "peek" and peeking and goes_out)
                        if not (root or waits or route == "frontier"):
                            continue
                        d = 0 if root or waits else depth if hop else depth + 1
                        m = peek if root else own_limit if waits else most
                        h = hops + 1 if hop else 0
                        if (m == 0 or d < m) and h < most_hops:
                            offer(q, (d, root or (peeking and not waits), h, u, next_state, m, next_free))
                level += 1
                while len(rows) >= ROWS:
                    yield _batch(rows[:ROWS])
                    rows = rows[ROWS:]
            rows += [(-1, url, state, depth, peeking, hops, most, free) for depth, peeking, hops, url, state, most, free in best.values()]
            for i in range(0, len(rows), ROWS):
                yield _batch(rows[i : i + ROWS])

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    names, types = zip(*(x.split() for x in GIVES.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(x, kinds[t]) for x, t in zip(zip(*rows), types)], names=list(names))

"""Sharding by a hierarchical weighted hash tree (operator 7).

A document descends region, rack and shard. At each level every child of the node draws
-ln(u) / weight, where u is a hash of seed, child and document taken as a number in
(0, 1), and the smallest draw wins. A child wins in proportion to its weight, its draw
depends on no other child, so a changed weight moves documents only to or from that
child, and nothing moves in other subtrees. All native expressions: no shuffle, no
Python, and the tree is a literal (it grows with the cluster, not with the data).

Columns: ``doc_id``, ``region``, ``rack``, ``shard`` from ``shards``; ``with_shards``
appends the three to any table, replacing columns of these names.

Defined cases: rows with a null id go where the id "null" goes; rows that repeat an id
go to the same shard; a child of weight zero or less gets nothing; a node without a
child of positive weight is an error; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = ("region", "rack", "shard")
SEED = "shard-1"


def default_tree() -> dict:
    """Three regions of weights 5, 3 and 2 with four racks of four shards each."""
    return {
        f"g{g}": (w, {f"g{g}r{r}": (1.0 + r % 2, {f"g{g}r{r}s{s}": (1.0 + (s == 0), {}) for s in range(4)}) for r in range(4)})
        for g, w in enumerate((5.0, 3.0, 2.0))
    }


def edges(tree: dict) -> list[list[tuple[str, str, float]]]:
    """By level: (parent, child, weight) of the children that can be drawn."""
    out, nodes = [], [("", tree)]
    for _ in LEVELS:
        level, below = [], []
        for parent, children in nodes:
            alive = [(name, float(w), kids) for name, (w, kids) in children.items() if w > 0]
            if not alive:
                raise ValueError(f"no child of {parent or 'the root'} has a positive weight")
            level += [(parent, name, w) for name, w, _ in alive]
            below += [(name, kids) for name, _, kids in alive]
        out.append(level)
        nodes = below
    names = [name for level in out for _, name, _ in level]
    if len(set(names)) < len(names):
        raise ValueError("names must be unique in the tree")
    return out


def _draw(child: Column, weight: Column, key: Column, seed: str) -> Column:
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(seed + "|"), child, F.lit("|"), key)), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    return -F.log(u) / weight


def with_shards(df: DataFrame, tree: dict | None = None, key: str = "doc_id", seed: str = SEED) -> DataFrame:
    """``df`` with the columns region, rack and shard."""
    k = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    parent: Column | None = None
    plain = df.drop(*LEVELS)
    chosen = []
    for level in edges(default_tree() if tree is None else tree):
        by: dict[str, list[tuple[str, float]]] = {}
        for p, child, w in level:
            by.setdefault(p, []).append((child, w))
        arrays = {p: F.array(*[F.struct(F.lit(c).alias("name"), F.lit(w).alias("w")) for c, w in kids]) for p, kids in by.items()}
        kids = arrays[""] if parent is None else F.element_at(F.create_map(*[x for p, a in arrays.items() for x in (F.lit(p), a)]), parent)
        best = F.array_min(F.transform(kids, lambda x: F.struct(_draw(x["name"], x["w"], k, seed).alias("d"), x["name"].alias("name"))))["name"]
        name = LEVELS[len(chosen)]
        plain = plain.withColumn(name, best)
        chosen.append(name)
        parent = F.col(name)
    return plain


def shards(docs: DataFrame, tree: dict | None = None) -> DataFrame:
    return with_shards(docs.select("doc_id"), tree)


def oracle(tree: dict | None = None, source: str = "select doc_id from documents", keep: str = "doc_id") -> str:
    """DuckDB SQL for ``shards``; ``source`` has doc_id and the columns ``keep``."""
    values = ", ".join(f"('{p}', '{c}', {w!r})" for level in edges(default_tree() if tree is None else tree) for p, c, w in level)
    key = "coalesce(cast(doc_id as varchar), 'null')"
    draw = "-ln((('0x' || md5('{s}|' || e.child || '|' || x.k)[1:12])::bigint + 0.5) / 281474976710656) / e.weight".format(s=SEED)
    sql = f"with e(parent, child, weight) as (values {values}), k0 as (select distinct {key} as k, '' as root from ({source}))"
    up = "root"
    for i, level in enumerate(LEVELS):
        done = ", ".join(f"x.{n}" for n in LEVELS[:i])
        done = f", {done}" if done else ""
        sql += f", k{i + 1} as (select x.k{done}, arg_min(e.child, {{'d': {draw}, 'name': e.child}}) as {level} from k{i} x join e on e.parent = x.{up} group by x.k{done})"
        up = level
    return sql + f" select {keep}, region, rack, shard from ({source}) d join k3 on k3.k = {key}"

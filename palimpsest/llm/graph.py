"""Connected components of tables of links, and work on pairs within groups, cut into blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every id in edges (a, b): root is the smallest id that links lead to.

    Large-star and small-star rounds: every node hands its neighbours on to the smallest one until only stars are
    left. Minima are aggregated before they are shuffled, and their way back to a node with many neighbours is salted.
    """
    now = common.stash(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == before or not seen[0]:
            return now.select(F.col("u").alias("id"), F.col("v").alias("root")).union(now.select("v", "v")).distinct()
        before = seen
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n"))
        large = common.attach(both.where("v > u"), least, "u", "n").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = common.stash(large, "links")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        met = common.attach(large, least, "u", "n")
        small = met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(met.select("u", "m")).where("u <> v").distinct()
        now = common.stash(small, "links")


def block_pairs(rows: DataFrame, key: str, size: str, per: int, by: str = "id") -> DataFrame:
    """rows, copied so that every two rows of a key meet in exactly one group (key, i, j) of at most about 2 x per.

    size is the key's total, a row's block depends on a hash of by; where one block is enough nothing is copied. Of a
    group with i = j all pairs count, of others those between the two blocks. Column ``mine`` is a row's block.
    """
    n = F.greatest(F.ceil(F.col(size) / per), F.lit(1)).cast("int")
    cut = rows.withColumn("_n", n).withColumn("mine", F.expr(f"int(pmod(xxhash64({by}), _n))"))
    cut = cut.withColumn("_j", F.explode(F.expr("sequence(0, _n - 1)")))
    return cut.withColumns({"i": F.least("mine", "_j"), "j": F.greatest("mine", "_j")}).drop("_n", "_j")


def meet(rows: DataFrame, key: str) -> DataFrame:
    """rows of block_pairs, each group's rows one after the other within a partition."""
    return rows.repartition(key, "i", "j").sortWithinPartitions(key, "i", "j", "id")


def groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups and the bounds of each group in them; rows of a group come one after the other."""
    held: list[pa.RecordBatch] = []
    last = None

    def bounds(t: pa.Table) -> np.ndarray:
        change = np.zeros(t.num_rows, bool)
        change[0] = True
        for k in keys:
            v = t.column(k).to_numpy()
            change[1:] |= v[1:] != v[:-1]
        return np.append(np.flatnonzero(change), t.num_rows)

    for batch in batches:
        if not batch.num_rows:
            continue
        first = tuple(batch.column(k)[0].as_py() for k in keys)
        final = tuple(batch.column(k)[batch.num_rows - 1].as_py() for k in keys)
        held.append(batch)
        if first == final == last or last is None and first == final:
            last = final
            continue
        t = pa.Table.from_batches(held)
        at = bounds(t)
        whole = t.slice(0, at[-2])
        held, last = t.slice(at[-2]).to_batches(), final
        if whole.num_rows:
            yield whole, at[:-1]
    if held:
        t = pa.Table.from_batches(held)
        yield t, bounds(t)


def forest(links: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of n nodes, by union-find; links is an array of pairs."""
    root = list(range(n))
    out = []
    for a, b in links.tolist():
        x, y = a, b
        while root[x] != x:
            root[x] = x = root[root[x]]
        while root[y] != y:
            root[y] = y = root[root[y]]
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((a, b))
            if len(out) == n - 1:
                break
    return out


def join(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Those of the links a to b that join trees; root, the smallest node of each node's tree, is brought up to date.

    In each round every tree hooks onto a tree of smaller root by its first link to one, so none closes a circle.
    """
    out = []
    while True:
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        if not len(a):
            return out
        high, first = np.unique(np.maximum(x, y), return_index=True)
        out += zip(a[first].tolist(), b[first].tolist())
        to = np.arange(len(root))
        to[high] = np.minimum(x, y)[first]
        while (to[to] != to).any():
            to = to[to]
        root[:] = to[root]

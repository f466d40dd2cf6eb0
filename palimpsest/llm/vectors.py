"""Near-duplicate vectors by Euclidean p-stable hashing and exact cosine checks.

Normalised vectors are projected on random directions; the projections, shifted and quantised, name a bucket in each of
several tables. A key travels with the signs of some more projections instead of the vector; vectors of a bucket whose
signs differ in few places are joined to candidate groups, and only there do vectors meet, where all pairs are checked by
exact cosine. So a bucket may hold many unlike vectors for little, and few tables do.
"""

from __future__ import annotations

import hashlib
import math
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common, graph

COSINE = 0.9
#: Share of pairs just at the threshold that the tables are to bring together.
RECALL = 0.93
#: Unrelated vectors that a vector may meet by chance in one table; comparing signs with so many costs about what a key does.
STRAY = 64
#: Signs that go with a key, in words of 64.
SIGNS = 2
#: A pair just at the threshold differs in more signs than are allowed with about this many standard deviations' chance.
SLACK = 2.6
#: Vectors of a group that are compared in one task at once.
BLOCK = 1024


def together(distance: float, width: float) -> float:
    """Chance that two points at a distance fall into one cell of a quantised random projection."""
    t = width / distance
    return math.erf(t / math.sqrt(2)) - math.sqrt(2 / math.pi) / t * (1 - math.exp(-t * t / 2))


@cache
def tune(n: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[float, int, int]:
    """(cell width, projections a table, tables) with the fewest projections for n vectors."""
    near, far = math.sqrt(2 - 2 * cosine), math.sqrt(2)
    best = None
    for width in np.arange(0.6, 4.01, 0.1):
        k = max(1, math.ceil(math.log(max(n, 2) / STRAY) / -math.log(together(far, width))))
        p = together(near, width) ** k
        tables = max(1, math.ceil(math.log(1 - recall) / math.log1p(-p)))
        if best is None or tables < best[2]:
            best = float(width), k, tables
    return best


def bucket_keys(unit: np.ndarray, width: float, k: int, tables: int) -> np.ndarray:
    """A row of keys, one for each table, for each row of unit."""
    rng = np.random.default_rng(20_231)
    out = np.empty((len(unit), tables), np.int64)
    for t in range(tables):
        cells = np.floor((unit @ rng.normal(size=(unit.shape[1], k)) + rng.uniform(0, width, k)) / width).astype(np.int64).view(np.uint64)
        key = np.full(len(unit), (t * 0x9E3779B97F4A7C15 + 1) % (1 << 64), np.uint64)
        for c in range(k):
            key = (key ^ cells[:, c]) * np.uint64(0xFF51AFD7ED558CCD)
            key ^= key >> np.uint64(33)
        out[:, t] = key.view(np.int64)
    return out


def signs(unit: np.ndarray) -> np.ndarray:
    """SIGNS words of the signs of random projections for each row of unit."""
    side = np.random.default_rng(77).normal(size=(unit.shape[1], 64 * SIGNS))
    return np.packbits(unit @ side > 0, axis=1, bitorder="little").view(np.int64)


def allowed(cosine: float) -> int:
    """Signs in which a pair at the threshold may differ: those expected from its angle, and some more."""
    p, n = math.acos(max(-1.0, min(1.0, cosine))) / math.pi, 64 * SIGNS
    return math.ceil(n * p + SLACK * math.sqrt(n * p * (1 - p)))


def digest(vectors: pa.Array) -> pa.Array:
    """SHA-256 of a vector's components, or null: null vector, no, null or non-finite components, or all zero."""
    out = []
    for v in vectors:
        x = None if not v.is_valid or v.values.null_count else np.asarray(v.values, np.float64)
        out.append(hashlib.sha256((x + 0.0).tobytes()).digest() if x is not None and len(x) and np.isfinite(x).all() and x.any() else None)
    return pa.array(out, pa.binary())


def units(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    """Vectors as rows of length 1, with zeros behind shorter ones."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    flat = np.asarray(column.flatten(), np.float64)
    if (sizes == dims).all():
        x = flat.reshape(-1, dims)
    else:
        x = np.zeros((len(sizes), dims))
        x[np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.arange(s) for s in sizes])] = flat
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _pairs(t: pa.Table, at: np.ndarray, dims: int, cosine: float):
    """For each group of t: its bounds and the linked pairs (as rows of t) that this group answers for."""
    x, size, mine = units(t.column("v"), dims), t.column("dim").to_numpy(), t.column("mine").to_numpy()
    same = t.column("i").to_numpy() == t.column("j").to_numpy()
    two = at[:-1][np.diff(at) == 2]
    for a in two[np.einsum("nd,nd->n", x[two], x[two + 1]) >= cosine]:
        if size[a] == size[a + 1] and (same[a] or mine[a] != mine[a + 1]):
            yield a, a + 2, np.array([[a, a + 1]])
    for a, b in zip(at[:-1], at[1:]):
        if b - a > 2:
            near = x[a:b] @ x[a:b].T >= cosine
            near &= size[a:b, None] == size[None, a:b]
            if not same[a]:
                near &= mine[a:b, None] != mine[None, a:b]
            links = np.argwhere(np.triu(near, 1))
            if len(links):
                yield a, b, links + a


def _alike(most: int):
    """Links (a, b) of a spanning forest of the rows of each bucket that differ in at most so many signs."""

    def run(batches):
        for t, at in graph.groups(batches, ("key", "i", "j")):
            ids, mine = t.column("id").to_numpy(), t.column("mine").to_numpy()
            own = np.stack([t.column(f"s{k}").to_numpy() for k in range(SIGNS)])
            same, out = t.column("i").to_numpy() == t.column("j").to_numpy(), []
            for a, b in zip(at[:-1], at[1:]):
                if b - a < 2:
                    continue
                apart = sum(np.bitwise_count(x[a:b, None] ^ x[None, a:b]).astype(np.int16) for x in own)
                near = np.triu(apart <= most, 1)
                if not same[a]:
                    near &= mine[a:b, None] != mine[None, a:b]
                out += [(ids[p + a], ids[q + a]) for p, q in graph.forest(np.argwhere(near), b - a)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])

    return run


def _checked(dims: int, cosine: float):
    """(id, links, other): each id's links counted, and links of a spanning forest as (id, null, other)."""

    def run(batches):
        for t, at in graph.groups(batches, ("key", "i", "j")):
            ids, mult, links, tree = t.column("id").to_numpy(), t.column("mult").to_numpy(), np.zeros(t.num_rows, np.int64), []
            for a, b, pairs in _pairs(t, at, dims, cosine):
                np.add.at(links, pairs[:, 0], mult[pairs[:, 1]])
                np.add.at(links, pairs[:, 1], mult[pairs[:, 0]])
                tree += [(ids[p + a], ids[q + a]) for p, q in graph.forest(pairs - a, b - a)]
            some = links > 0
            n = int(some.sum())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(ids[some], np.array([x for x, _ in tree], np.int64))), pa.array([*links[some].tolist(), *[None] * len(tree)], pa.int64()), pa.array([*[None] * n, *(int(y) for _, y in tree)], pa.int64())],
                names=["id", "links", "other"],
            )

    return run


def near_vectors(rows: DataFrame, cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of rows (vec_id, embedding).

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do vectors of
    different length. Equal vectors link with each other and count one by one. A row with a null id links with nothing,
    has no component and is kept.
    """
    spark = rows.sparkSession
    vectors = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    marked = vectors.withColumn("digest", F.when(F.col("vec_id").isNotNull(), F.arrow_udf(digest, "binary")("v")))
    ids = common.stash(marked.select("vec_id", "digest"), "vector-ids")
    valid = marked.where("digest IS NOT NULL")
    classes = common.stash(valid.groupBy("digest").agg(F.min("vec_id").alias("id"), F.count("*").alias("mult"), F.first("v").alias("v")).withColumn("dim", F.size("v")), "vectors")
    n, dims = classes.agg(F.count("*"), F.coalesce(F.max("dim"), F.lit(1))).first()
    width, k, tables = tune(common.power_of_two(n), cosine, recall)

    def hashed(batches):
        for batch in common.slices(batches, 4096):
            unit = units(batch.column("v"), dims)
            keys, words = bucket_keys(unit, width, k, tables), np.repeat(signs(unit), tables, axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(batch.column("id").to_numpy(), tables)), *(pa.array(np.ascontiguousarray(words[:, x])) for x in range(SIGNS))], names=["key", "id", *names])

    names = [f"s{x}" for x in range(SIGNS)]
    keyed = common.stash(classes.select("id", "v").mapInArrow(hashed, "key long, id long, " + ", ".join(f"{n} long" for n in names)), "vector-keys")
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    candidates = common.attach(keyed, shared, "key", "n").where("n IS NOT NULL")
    blocks = graph.block_pairs(candidates, "key", "n", BLOCK)
    edges = graph.meet(blocks.select("key", "i", "j", "mine", "id", *names), "key").mapInArrow(_alike(allowed(cosine)), "a long, b long")
    groups = common.stash(graph.components(edges), "vector-groups")
    sizes = groups.groupBy("root").agg(F.count("*").alias("n"))
    members = common.attach(groups, sizes, "root", "n").withColumnRenamed("root", "key").join(classes.select("id", "v", "dim", "mult"), "id")
    blocks = graph.block_pairs(members, "key", "n", BLOCK)
    checked = common.stash(graph.meet(blocks.select("key", "i", "j", "mine", "id", "dim", "v", "mult"), "key").mapInArrow(_checked(dims, cosine), "id long, links long, other long"), "vector-links")
    degrees = checked.where("links IS NOT NULL").groupBy("id").agg(F.sum("links").alias("links"))
    roots = common.stash(graph.components(checked.where("other IS NOT NULL").select(F.col("id").alias("a"), F.col("other").alias("b"))), "vector-roots")
    known = classes.select("id", "digest", "mult").join(degrees, "id", "left").join(roots, "id", "left")
    known = common.stash(known.select("digest", "mult", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("root", "id").alias("root")), "vector-classes")
    out = common.attach(ids, known, "digest", "mult")
    component = F.coalesce("root", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))

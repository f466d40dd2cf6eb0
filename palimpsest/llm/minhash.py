"""Near-duplicate documents by an ensemble of MinHash tables for mutual containment.

Documents are partitioned by the size of their shingle set. Two documents are linked where each holds at least a given
share of the other's shingles; for each partition that containment becomes the least Jaccard similarity its members can
have, and the partition's bands are tuned to that. A document is looked up in its own partition and in the one above.
Documents that share a band are joined to candidate groups, in which all pairs are checked by exact containment.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common, graph

WORD = re.compile(r"\w+")
#: Words a shingle.
SHINGLE = 3
#: Share of either document's shingles that the other holds at least.
CONTAINMENT = 0.65
#: Share of pairs just at a partition's threshold that its bands are to bring together.
RECALL = 0.95
#: MinHash values a document has at most, and bands with more values each are taken as long as they suffice.
HASHES = 224
#: Shingles of the documents that are compared in one task at once, about; a document counts for at least LEAST, so that
#: those are at most BLOCK / LEAST however short they are.
BLOCK, LEAST = 1 << 19, 128
#: A worker forgets hashed words beyond so many.
WORDS = 100_000
#: Bytes of rows that an executor and a Python worker exchange at once, about.
BATCH = 1 << 22


def shingles(text: str, known: dict[str, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of SHINGLE words in a whole text (of all words, if there are fewer)."""
    words = WORD.findall(text.lower())
    if not words:
        return np.zeros(0, np.uint64)
    if len(known) > WORDS:
        known.clear()
    try:
        code = [known[w] for w in words]
    except KeyError:
        for w in words:
            if w not in known:
                known[w] = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        code = [known[w] for w in words]
    x = np.array(code, np.uint64)
    n = max(1, len(x) - SHINGLE + 1)
    out = np.full(n, 0x9E3779B97F4A7C15, np.uint64)
    for k in range(min(SHINGLE, len(x))):
        out = (out ^ x[k : k + n]) * np.uint64(0xFF51AFD7ED558CCD)
        out ^= out >> np.uint64(32)
    return np.unique(out)


#: A partition holds sizes from a power of this to the next; at least 1 / CONTAINMENT, so that a pair meets in one of two.
RATIO = 4


def partition(size: int) -> int:
    """Partition of a set size."""
    p = 0
    while size >= RATIO:
        size //= RATIO
        p += 1
    return p


@cache
def tune(p: int, containment: float = CONTAINMENT, recall: float = RECALL) -> tuple[int, int]:
    """(bands, values a band) for partition p: the most values a band with which at most HASHES values reach recall.

    Two sets of sizes a <= b that share at least ceil(containment x b) elements have the least Jaccard similarity where
    a = b; over the sizes of the partition, and small sets above all, that is the threshold.
    """
    low = RATIO**p
    high = min(RATIO * low - 1, low + 1000)
    jaccard = min(math.ceil(containment * b - 1e-9) / (2 * b - math.ceil(containment * b - 1e-9)) for b in range(low, high + 1))
    best = (HASHES, 1)
    for rows in range(1, 9):
        p_band = jaccard**rows
        bands = 1 if p_band >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-p_band))
        if bands * rows <= HASHES:
            best = bands, rows
    return best


@cache
def functions() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(5)
    return (rng.integers(0, 1 << 32, HASHES, np.uint32) | np.uint32(1))[:, None], rng.integers(0, 1 << 32, HASHES, np.uint32)[:, None]


def signature(own: np.ndarray) -> np.ndarray:
    """HASHES minima of a set of 64-bit hashes."""
    a, b = functions()
    low = own.astype(np.uint32) ^ (own >> np.uint64(32)).astype(np.uint32) * np.uint32(0x85EBCA6B)
    low ^= low >> np.uint32(15)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 512):
        x = low[None, at : at + 512] * a
        x += b
        np.minimum(out, x.min(1), out=out)
    return out


def band_keys(own: np.ndarray) -> np.ndarray:
    """Keys of a set: the bands of its own partition and, as a query, those of the one above, if it can hold a partner."""
    p, values, out = partition(len(own)), signature(own).astype(np.uint64), []
    for q in (p, p + 1) if len(own) >= CONTAINMENT * RATIO ** (p + 1) - 1e-6 else (p,):
        bands, rows = tune(q)
        part = values[: bands * rows].reshape(bands, rows)
        key = np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(q * 7919 + 1)
        for r in range(rows):
            key = (key ^ part[:, r]) * np.uint64(0xC2B2AE3D27D4EB4F)
            key ^= key >> np.uint64(29)
        out.append(key)
    return np.concatenate(out).view(np.int64)


def _hashed():
    """Column function of a text: the digest of its shingles (null without words), their number, and its keys."""

    @F.arrow_udf("struct<digest:binary,size:long,keys:array<long>>")
    def each(texts: pa.Array) -> pa.Array:
        marks, sizes, keys = [], [], []
        for at in range(0, len(texts), 1024):
            for text in texts.slice(at, 1024).to_pylist():
                own = shingles(text or "", _KNOWN)
                marks.append(hashlib.sha256(own.tobytes()).digest() if len(own) else None)
                sizes.append(len(own))
                keys.append(band_keys(own) if len(own) else np.zeros(0, np.int64))
        offsets = pa.array(np.append(0, np.cumsum([len(k) for k in keys])), pa.int32())
        lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*keys, np.zeros(0, np.int64)])))
        return pa.StructArray.from_arrays([pa.array(marks, pa.binary()), pa.array(sizes, pa.int64()), lists], ["digest", "size", "keys"])

    return each


_KNOWN: dict[str, int] = {}


def _bands(batches):
    """Rows (key, id, null) for the smallest id that a slice has for a key, and links (null, id, smallest id) for its others."""
    for batch in common.slices(batches, 1024):
        keys = batch.column("keys")
        key = np.asarray(keys.flatten())
        doc = np.repeat(batch.column("id").to_numpy(), np.diff(keys.offsets.to_numpy()))
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        first = np.append(True, key[1:] != key[:-1])[: len(key)]
        head = doc[first][np.cumsum(first) - 1] if len(key) else doc
        links = np.unique(np.stack([doc[~first], head[~first]], 1), axis=0)
        n = int(first.sum())
        nulls = np.zeros(n + len(links), bool)
        nulls[n:] = True
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(key[first], np.zeros(len(links), np.int64)), mask=nulls), pa.array(np.append(doc[first], links[:, 0])), pa.array(np.append(np.zeros(n, np.int64), links[:, 1]), mask=~nulls)],
            names=["key", "id", "head"],
        )


def _heads(batches):
    """Links of each id to the smallest of its key, from rows sorted by key and id; links pass."""
    last_key = last_id = None
    for batch in batches:
        key, doc, head = batch.column("key"), batch.column("id").to_numpy(), batch.column("head")
        link = np.asarray(key.is_null())
        value = key.fill_null(0).to_numpy()
        out = [np.stack([doc[link], head.fill_null(0).to_numpy(zero_copy_only=False)[link]], 1)]
        value, doc = value[~link], doc[~link]
        if len(value):
            first = np.append(last_key is None or value[0] != last_key, value[1:] != value[:-1])
            begin = np.maximum.accumulate(np.where(first, np.arange(len(value)), -1))
            heads = np.where(begin >= 0, doc[begin], 0 if last_id is None else last_id)
            last_key, last_id = value[-1], heads[-1]
            out.append(np.stack([doc, heads], 1)[doc != heads])
        pairs = np.unique(np.concatenate(out), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1]))], names=["a", "b"])


#: Shingles that so many sets, or this share of the sets looked up, hold are counted one by one, more frequent ones by matrices.
RARE, RARE_SHARE = 24, 1 / 16
#: Pairs of sets whose intersections are held at once, about.
CELLS = 1 << 18


def overlaps(sets: list[np.ndarray], rows: np.ndarray, cols: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Strips of the matrix of the sizes of the intersections of sets ``rows`` and sets ``cols``: the first row's place, and so many rows of it."""
    size = np.array([len(s) for s in sets])
    _, code = np.unique(np.concatenate([sets[x] for x in np.append(cols, rows)]), return_inverse=True)
    held, asked = np.split(code, [size[cols].sum()])
    count = np.bincount(held, minlength=int(code.max(initial=0)) + 1)
    order = np.argsort(held, kind="stable")
    members, first = np.repeat(np.arange(len(cols)), size[cols])[order], np.append(0, np.cumsum(count))
    often = count > max(RARE, len(cols) * RARE_SHARE)
    begin = np.append(0, np.cumsum(size[rows]))
    height = max(1, CELLS // len(cols))
    for at in range(0, len(rows), height):
        end = min(at + height, len(rows))
        mine = asked[begin[at] : begin[end]]
        row = np.repeat(np.arange(end - at), size[rows[at:end]])
        out = np.zeros((end - at) * len(cols), np.int32)
        few = ~often[mine] & (count[mine] > 0)
        value, owner = mine[few], row[few]
        met = np.cumsum(count[value])
        cuts = np.searchsorted(met, np.arange(CELLS, met[-1] if len(met) else 0, CELLS))
        for v, o in zip(np.split(value, cuts), np.split(owner, cuts)):
            n = count[v]
            place = np.arange(n.sum()) + np.repeat(first[v] - np.append(0, np.cumsum(n)[:-1]), n) if len(v) else v
            out += np.bincount(np.repeat(o, n) * len(cols) + members[place], minlength=len(out)).astype(np.int32)
        out = out.reshape(end - at, len(cols))
        value, owner = mine[often[mine]], row[often[mine]]
        some = np.unique(value)
        step = max(64, CELLS // (end - at + len(cols)))
        for k in range(0, len(some), step):
            part = some[k : k + step]
            near = np.zeros((end - at, len(part)), np.float32)
            far = np.zeros((len(cols), len(part)), np.float32)
            inside = (value >= part[0]) & (value <= part[-1])
            near[owner[inside], np.searchsorted(part, value[inside])] = 1
            for c, v in enumerate(part):
                far[members[first[v] : first[v + 1]], c] = 1
            out += (near @ far.T).astype(np.int32)
        yield at, out


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """batches with the bytes of their shingles in the place of the texts: BLOCK bounds those, while a text that repeats itself may be far longer."""
    for batch in common.slices(batches):
        own = pa.array([shingles(x or "", _KNOWN).tobytes() for x in batch.column("text").to_pylist()], pa.binary())
        others = [c for c in batch.schema.names if c != "text"]
        # copied by take, as a slice would keep the texts beside it
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(np.arange(batch.num_rows))) for c in others), own], [*others, "own"])


def _checked(containment: float):
    """(id, links, other): each id's links counted, and links of a spanning forest as (id, null, other)."""

    def run(batches):
        for t, at in graph.groups(_sets(batches), ("key", "i", "j")):
            ids, mult, mine = (t.column(c).to_numpy() for c in ("id", "mult", "mine"))
            guest = np.asarray(t.column("guest"))
            same = t.column("i").to_numpy() == t.column("j").to_numpy()
            count, tree = np.zeros(t.num_rows, np.int64), []
            for a, b in zip(at[:-1], at[1:]):
                if b - a < 2:
                    continue
                sets = [np.frombuffer(x, np.uint64) for x in t.column("own").slice(a, b - a).to_pylist()]
                size = np.array([len(s) for s in sets])
                whole, root = same[a], np.arange(b - a)
                rows = np.arange(b - a) if whole else np.flatnonzero(mine[a:b] == mine[a])
                cols = rows if whole else np.flatnonzero(mine[a:b] != mine[a])
                if not len(cols):
                    continue
                for top, shared in overlaps(sets, rows, cols):
                    linked = shared >= containment * np.maximum(size[rows[top : top + len(shared), None]], size[cols]) - 1e-6
                    x, y = np.nonzero(np.triu(linked, top + 1) if whole else linked)
                    x, y = rows[x + top] + a, cols[y] + a
                    x, y = (k[~(guest[x] & guest[y])] for k in (x, y))
                    np.add.at(count, x, mult[y])
                    np.add.at(count, y, mult[x])
                    tree += [(ids[p + a], ids[q + a]) for p, q in graph.join(root, x - a, y - a)]
            some = count > 0
            n = int(some.sum())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(ids[some], np.array([x for x, _ in tree], np.int64))), pa.array([*count[some].tolist(), *[None] * len(tree)], pa.int64()), pa.array([*[None] * n, *(int(y) for _, y in tree)], pa.int64())],
                names=["id", "links", "other"],
            )

    return run


def by_size(members: DataFrame, containment: float) -> DataFrame:
    """(id, mult, key, shingles, guest): members of candidate groups, those of groups beyond a block cut by size.

    Column shingles is the group's total for block_pairs, where a set counts for LEAST at least.
    Two linked sets differ in size by less than the factor 1 / containment. A large group becomes one of each range of
    sizes by that factor; a member is at home in its own and a guest in the one above, and guests aren't compared with
    each other.
    """
    big = F.col("shingles") > BLOCK
    step = F.floor(F.log("size") / -math.log(containment) + 1e-9)
    places = F.when(big, F.array(F.struct(F.xxhash64("key", step).alias("key"), F.lit(False).alias("guest")), F.struct(F.xxhash64("key", step + 1).alias("key"), F.lit(True).alias("guest")))).otherwise(F.array(F.struct(F.col("key"), F.lit(False).alias("guest"))))
    each = members.select("id", "mult", "size", F.explode(places).alias("p")).select("id", "mult", "size", "p.key", "p.guest")
    total = each.groupBy("key").agg(F.sum(F.greatest("size", F.lit(LEAST))).alias("shingles"), F.count("*").alias("n"), F.min("guest").alias("_empty"))
    return common.attach(each, total, "key", "n").where("n > 1 AND NOT _empty").select("id", "mult", "key", "shingles", "guest")


def _near(docs: DataFrame, containment: float) -> tuple[DataFrame, DataFrame, dict[str, str]]:
    """Written rows of docs under boxed names, each with a number (row), the verdict (row, group_id, n_links, kept) of each number, and the names.

    Everything goes by these numbers: ids may be null or shared by rows of different texts.
    """
    with common.batch_bytes(docs.sparkSession, BATCH):
        return _written(docs, containment)


def _written(docs: DataFrame, containment: float) -> tuple[DataFrame, DataFrame, dict[str, str]]:
    """As _near; whatever of it needs Python is written here, so that batch_bytes holds for it."""
    boxes, names = common.boxed(docs)
    text, doc_id = F.col(names["text"]), F.col(names["doc_id"])
    held = common.stash(boxes.withColumn("own", _hashed()(text)).withColumn("row", F.monotonically_increasing_id()), "near-sets")
    sets = held.select("row", doc_id.alias("doc_id"), "own.digest", "own.size")
    banded = held.where(doc_id.isNotNull() & F.col("own.digest").isNotNull()).select(F.col("row").alias("id"), "own.keys").mapInArrow(_bands, "key long, id long, head long")
    spread = banded.repartition(F.coalesce("key", F.xxhash64("id"))).sortWithinPartitions("key", "id")
    roots = common.stash(graph.components(spread.mapInArrow(_heads, "a long, b long")), "near-roots")
    # equal sets share all keys and so a candidate group; one row of each goes on
    valid = sets.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    classes = valid.groupBy("digest").agg(F.min("row").alias("id"), F.min(F.struct("doc_id", "row")).alias("best"), F.count("*").alias("mult"), F.min("size").alias("size"))
    classes = common.stash(classes, "near-classes")
    members = classes.select("id", "mult", "size").join(roots, "id").withColumnRenamed("root", "key")
    total = members.groupBy("key").agg(F.sum(F.greatest("size", F.lit(LEAST))).alias("shingles"), F.count("*").alias("n")).where("n > 1")
    members = common.stash(by_size(common.attach(members, total, "key", "n").where("n > 1"), containment), "near-members")
    # members grow with the corpus, so they are never broadcast, whatever their size is taken to be
    texts = held.select(F.col("row").alias("id"), text.alias("text")).join(members.hint("merge"), "id")
    blocks = graph.block_pairs(texts, "key", "shingles", BLOCK)
    checked = graph.meet(blocks.select("key", "i", "j", "mine", "id", "mult", "guest", "text"), "key").mapInArrow(_checked(containment), "id long, links long, other long")
    checked = common.stash(checked, "near-links")
    degrees = checked.where("links IS NOT NULL").groupBy("id").agg(F.sum("links").alias("links"))
    roots = common.stash(graph.components(checked.where("other IS NOT NULL").select(F.col("id").alias("a"), F.col("other").alias("b"))), "near-groups")
    grouped = common.stash(classes.join(degrees, "id", "left").join(roots, "id", "left").select("digest", "mult", "best", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "id").alias("root")), "near-grouped")
    heads = grouped.groupBy("root").agg(F.min("best").alias("head"), F.count("*").alias("n"))
    known = common.attach(grouped, heads, "root", "n").select("digest", "mult", (F.col("links") + F.col("mult") - 1).alias("n_links"), "head")
    own = sets.select("row", "doc_id", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest"))
    out = common.attach(own, common.stash(known, "near-known"), "digest", "mult")
    kept = F.coalesce(F.col("row") == F.col("head.row"), F.lit(True))
    verdict = out.select("row", "doc_id", F.coalesce("head.doc_id", "doc_id").alias("group_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), kept.alias("kept"))
    return held, verdict, names


def near_groups(docs: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, group_id, n_links, kept of every row of docs (doc_id, text).

    Two documents are linked where each holds at least the share ``containment`` of the other's shingles, so a document
    within a much longer one isn't linked to it; group_id is the smallest doc_id that links lead to, n_links the number
    of rows linked directly, and one row of that id is kept. Texts without words (null and empty ones too) link with
    nothing. A null id links with nothing, has no group and is kept; rows that repeat id and text count one by one, of
    which one is kept, and rows that share an id alone are different documents. An empty table gives an empty result.
    """
    return _near(docs.select("doc_id", "text"), containment)[1].drop("row")


def drop_near(docs: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """docs with one row of each group of near-duplicates, by the rules of near_groups; columns, whatever their names, are those of docs.

    Texts without words and rows with a null id all stay, and so does a row that only shares its id with one that goes.
    """
    held, verdict, names = _near(docs, containment)
    return common.unboxed(held.join(verdict.where("NOT kept").select("row"), "row", "left_anti"), names)

"""Substring dedup by super-k-mer partitioning.

A window is WINDOW consecutive words. Its minimiser is the least hash of the runs of SEED words in it; consecutive
windows with one minimiser form a super-k-mer, which travels as one packed string to the bucket of that minimiser. Equal
windows have equal minimisers and so meet in a bucket, where sorting counts them exactly, word by word. A minimiser that
occurs once in the corpus can't have a repeated window: such super-k-mers never travel. Those of a minimiser that very
many share would fill one task; they are cut into their windows, which meet by a digest of their words instead.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from . import common, graph

WINDOW = 35
SEED = 8
#: A longer run of windows with one minimiser is cut; its windows meet in the same bucket all the same.
LONGEST = 1024
#: A worker forgets hashed words beyond so many.
WORDS = 400_000
#: Packed strings of one minimiser that are counted in one task.
HOT = 20_000


def codes(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    """A 64-bit hash of each word."""
    if len(known) > WORDS:
        known.clear()
    try:
        return np.array([known[w] for w in words], np.uint64)
    except KeyError:
        for w in words:
            if w not in known:
                known[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
        return np.array([known[w] for w in words], np.uint64)


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each n consecutive values."""
    size, out = 1, x
    while 2 * size <= n:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return np.minimum(out[: len(x) - n + 1], out[n - size : n - size + len(x) - n + 1]) if size < n else out


def super_kmers(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser, first window, end window, again) of each super-k-mer of a text of hashed words.

    again says that the minimiser's run of words occurs more than once in the text, so that even one super-k-mer may
    hold a window twice.
    """
    n = len(code) - WINDOW + 1
    if n < 1:
        none = np.zeros(0, np.int64)
        return none, none, none, none > 0
    m = len(code) - SEED + 1
    seed = np.full(m, 0x9E3779B97F4A7C15, np.uint64)
    for k in range(SEED):
        seed = (seed ^ code[k : k + m]) * np.uint64(0xFF51AFD7ED558CCD)
        seed ^= seed >> np.uint64(32)
    least = sliding_min(seed, WINDOW - SEED + 1)
    start = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    end = np.append(start[1:], n)
    if (end - start).max() > LONGEST:
        parts = [np.arange(a, b, LONGEST) for a, b in zip(start, end)]
        start = np.concatenate(parts)
        end = np.append(start[1:], n)
    ordered = np.sort(seed)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    h = least[start]
    return h.view(np.int64), start, end, np.isin(h, twice) if len(twice) else np.zeros(len(h), bool)


def packed(docs: DataFrame) -> DataFrame:
    """(key, doc_id, z): rows of docs with their compressed words; key is a hash of id and text. Null counts as empty."""

    def make():
        press = zstandard.ZstdCompressor(level=1)

        def each(batch):
            return pa.RecordBatch.from_arrays([batch.column("key"), batch.column("doc_id"), pa.array([press.compress((t or "").encode()) for t in batch.column("text").to_pylist()], pa.binary())], names=["key", "doc_id", "z"])

        return each

    return common.scan(docs.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", "text"), make, "key long, doc_id long, z binary")


def _minimisers():
    """Rows (h, key, at): for each minimiser one super-k-mer of a slice; those repeated in a slice have h null too."""
    known: dict[bytes, int] = {}

    def each(batch):
        hs, keys, ats, agains = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
        for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
            h, start, _, again = super_kmers(codes((text or "").encode().split(), known))
            if len(h):
                hs.append(h)
                keys.append(np.full(len(h), key, np.int64))
                ats.append(start)
                agains.append(again)
        h, key, at, again = map(np.concatenate, (hs, keys, ats, agains))
        order = np.argsort(h, kind="stable")
        h, key, at = h[order], key[order], at[order]
        first = np.append(True, h[1:] != h[:-1])[: len(h)]
        twice = again[order] | ~first | np.append(~first[1:], False)[: len(h)]
        pick = np.concatenate([np.flatnonzero(first), np.flatnonzero(twice)])
        null = np.append(np.zeros(first.sum(), bool), np.ones(twice.sum(), bool))
        return pa.RecordBatch.from_arrays([pa.array(h[pick], mask=null), pa.array(key[pick]), pa.array(at[pick].astype(np.int32))], names=["h", "key", "at"])

    return each


def _repeated(batches):
    """(key, at) of the super-k-mers whose minimiser another row has too, from rows sorted by h; null h passes."""
    before = None  # the last row's h, key, at and whether it is out already

    def out(key, at):
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(key, np.int64)), pa.array(np.asarray(at, np.int32))], names=["key", "at"])

    for batch in batches:
        null = np.asarray(batch.column("h").is_null())
        h, key, at = batch.column("h").fill_null(0).to_numpy(), batch.column("key").to_numpy(), batch.column("at").to_numpy()
        yield out(key[null], at[null])
        h, key, at = h[~null], key[~null], at[~null]
        if not len(h):
            continue
        like = np.append(before is not None and h[0] == before[0], h[1:] == h[:-1])
        if like[0] and not before[3]:
            yield out([before[1]], [before[2]])
        both = like | np.append(like[1:], False)
        yield out(key[both], at[both])
        before = h[-1], key[-1], at[-1], bool(both[-1])


def _strings(batches):
    """(h, words, n, met): each distinct packed super-k-mer of a slice, how often it occurs there, and where."""
    known: dict[bytes, int] = {}
    open_ = zstandard.ZstdDecompressor()
    met_kind = pa.list_(pa.struct([("key", pa.int64()), ("at", pa.int32())]))
    for batch in common.slices(batches, 512):
        found: dict[tuple[int, bytes], list] = {}
        for key, z, ats in zip(batch.column("key").to_pylist(), batch.column("z").to_pylist(), batch.column("ats").to_pylist()):
            if not ats:
                continue
            words = open_.decompress(z).split()
            wanted = set(ats)
            h, start, end, _ = super_kmers(codes(words, known))
            for one, a, b in zip(h.tolist(), start.tolist(), end.tolist()):
                if a in wanted:
                    found.setdefault((one, b" ".join(words[a : b + WINDOW - 1])), []).append({"key": key, "at": a})
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in found], pa.int64()), pa.array([k[1] for k in found], pa.binary()), pa.array([len(v) for v in found.values()], pa.int64()), pa.array(found.values(), met_kind)],
            names=["h", "words", "n", "met"],
        )


def covered(flags: np.ndarray) -> list[tuple[int, int]]:
    """Word ranges (first, end) that the flagged windows cover, joined where they touch or overlap."""
    at = np.flatnonzero(flags)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > WINDOW)
    first, last = np.append(at[0], at[cut + 1]), np.append(at[cut], at[-1])
    return list(zip(first.tolist(), (last + WINDOW).tolist()))


def count_windows(strings: list[bytes], times: list[int]) -> list[np.ndarray]:
    """For each of some distinct packed strings, which of its windows occur more than once among all, each string times over."""
    ids: dict[bytes, int] = {}
    windows, sizes = [], []
    for s in strings:
        word = np.array([ids.setdefault(w, len(ids)) for w in s.split()], np.int32)
        windows.append(np.lib.stride_tricks.sliding_window_view(word, WINDOW))
        sizes.append(len(windows[-1]))
    rows = np.ascontiguousarray(np.concatenate(windows))
    _, back = np.unique(rows.view(np.dtype((np.void, rows.dtype.itemsize * WINDOW))).ravel(), return_inverse=True)
    seen = np.bincount(back, weights=np.repeat(times, sizes))
    return np.split(seen[back] > 1, np.cumsum(sizes)[:-1])


def _count(batches):
    """(sid, first, end): the word ranges of each packed string that repeated windows cover, from rows sorted by h and words."""
    for t, at in graph.groups(batches, ("h",)):
        out: list[tuple[int, int, int]] = []
        words, n, sid = t.column("words").to_pylist(), t.column("n").to_pylist(), t.column("sid").to_pylist()
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            distinct: dict[bytes, list] = {}
            for k in range(a, b):
                x = distinct.setdefault(words[k], [0, []])
                x[0] += n[k]
                x[1].append(sid[k])
            if len(distinct) == 1 and (x := next(iter(distinct.values())))[0] > 1:
                size = words[a].count(b" ") + 1
                out += [(s, 0, size) for s in x[1]]
                continue
            flags = count_windows(list(distinct), [x[0] for x in distinct.values()])
            for (_, sids), flag in zip(distinct.values(), flags):
                ranges = covered(flag)
                out += [(s, first, end) for s in sids for first, end in ranges]
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), *(pa.array([o[c] for o in out], pa.int32()) for c in (1, 2))], names=["sid", "first", "end"])


def _windows(batches):
    """(window, sid, first, n): a digest of each window of packed strings, with its place."""
    for batch in common.slices(batches, 512):
        windows, sids, firsts, ns = [], [], [], []
        for sid, text, n in zip(*(batch.column(c).to_pylist() for c in ("sid", "words", "n"))):
            words = text.split()
            for k in range(len(words) - WINDOW + 1):
                windows.append(hashlib.sha256(b" ".join(words[k : k + WINDOW])).digest())
                sids.append(sid)
                firsts.append(k)
                ns.append(n)
        yield pa.RecordBatch.from_arrays([pa.array(windows, pa.binary()), pa.array(sids, pa.int64()), pa.array(firsts, pa.int32()), pa.array(ns, pa.int64())], names=["window", "sid", "first", "n"])


def hot_ranges(strings: DataFrame) -> DataFrame:
    """(sid, first, end): the words of packed strings (sid, words, n) that windows occurring more than once cover, window by window."""
    windows = common.stash(strings.select("sid", "words", "n").mapInArrow(_windows, "window binary, sid long, first int, n long"), "windows")
    seen = windows.groupBy("window").agg(F.sum("n").alias("times"), F.count("*").alias("rows")).where("times > 1")
    return common.attach(windows.select("window", "sid", "first"), seen, "window", "rows").where("times IS NOT NULL").select("sid", "first", (F.col("first") + WINDOW).cast("int").alias("end"))


def _removed(batches):
    open_ = zstandard.ZstdDecompressor()
    for batch in common.slices(batches, 512):
        n, gone, digest = [], [], []
        for z, ranges in zip(batch.column("z").to_pylist(), batch.column("ranges").to_pylist()):
            words = open_.decompress(z).split()
            kept = words
            if ranges:
                mask = np.ones(len(words), bool)
                for r in ranges:
                    mask[r["first"] : r["end"]] = False
                kept = [words[i] for i in np.flatnonzero(mask).tolist()]
            n.append(len(words))
            gone.append(len(words) - len(kept))
            digest.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of docs (doc_id, text).

    Words are runs of characters other than space and tab to carriage return. Every word that a window covers whose
    words also start anywhere else, in the same row or another, is removed; what is left is joined by single spaces.
    Null and empty texts have no words. Repeated rows repeat each other's windows.
    """
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("key"), "text")
    seeds = common.scan(keyed, _minimisers, "h long, key long, at int", 512)
    sorted_ = seeds.repartition(F.coalesce("h", F.xxhash64("key", "at"))).sortWithinPartitions("h")
    wanted = sorted_.mapInArrow(_repeated, "key long, at int").groupBy("key").agg(F.collect_set("at").alias("ats"))
    strings = packed(docs).select("key", "z").join(wanted, "key").mapInArrow(_strings, "h long, words binary, n long, met array<struct<key:long,at:int>>")
    strings = common.stash(strings.withColumn("sid", F.monotonically_increasing_id()), "super-kmers")
    # the largest buckets, of which common.HOT_KEYS have a list; any other holds under 1/HOT_KEYS of all strings
    hot = strings.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > HOT).orderBy(F.desc("n"), "h").limit(common.HOT_KEYS).select("h")
    hot = F.broadcast(common.stash(hot, "hot-minimisers"))
    own = strings.select("h", "words", "n", "sid")
    ranges = own.join(hot, "h", "left_anti").repartition("h").sortWithinPartitions("h", "words").mapInArrow(_count, "sid long, first int, end int")
    ranges = ranges.union(hot_ranges(own.join(hot, "h", "left_semi")))
    placed = ranges.join(strings.select("sid", "met"), "sid").select("first", "end", F.explode("met").alias("m"))
    per_doc = placed.groupBy(F.col("m.key").alias("key")).agg(F.collect_set(F.struct((F.col("m.at") + F.col("first")).alias("first"), (F.col("m.at") + F.col("end")).alias("end"))).alias("ranges"))
    return packed(docs).join(per_doc, "key", "left").mapInArrow(_removed, "doc_id long, n_words long, n_removed long, kept_sha256 string")

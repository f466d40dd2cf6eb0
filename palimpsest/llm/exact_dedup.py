"""Exact dedup by a cuckoo-filter index of live digests.

The digest space is cut into parts. A part has a cuckoo filter over the digests that live in it and, beside it, buckets
with their content: the digests in full and the rows they stand for. A digest that misses the filter is new for certain
and is inserted; a hit is verified against the content of its bucket. Deleting a digest takes its fingerprint out of the
filter and its content out of the bucket; a filter that overflows is built anew, twice as large, from the stored digests.
"""

from __future__ import annotations

from array import array

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import common

#: White space that doesn't count: space and tab to carriage return.
BLANKS = r"[\x20\x09-\x0D]+"


class CuckooFilter:
    """Cuckoo filter with 4 slots a bucket and 16-bit fingerprints; keys are digests of 16 bytes or more."""

    SLOTS, KICKS = 4, 200

    def __init__(self, buckets: int = 64):
        self.mask = buckets - 1
        self.table = array("H", bytes(2 * self.SLOTS * buckets))
        self.used = 0

    def places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[:2], "little") or 1
        one = int.from_bytes(digest[4:12], "little") & self.mask
        return mark, one, self.other(mark, one)

    def other(self, mark: int, at: int) -> int:
        return (at ^ (mark * 0x5BD1E995)) & self.mask

    def contains(self, digest: bytes) -> bool:
        return self.holds(*self.places(digest))

    def holds(self, mark: int, one: int, two: int) -> bool:
        t, s = self.table, self.SLOTS
        return mark in t[one * s : one * s + s] or mark in t[two * s : two * s + s]

    def _put(self, mark: int, at: int) -> bool:
        for k in range(at * self.SLOTS, at * self.SLOTS + self.SLOTS):
            if not self.table[k]:
                self.table[k] = mark
                return True
        return False

    def insert(self, digest: bytes) -> bool:
        """False where the filter is full; it is then to be built anew from the stored keys."""
        mark, at, two = self.places(digest)
        if self._put(mark, at) or self._put(mark, two):
            self.used += 1
            return True
        for kick in range(self.KICKS):
            k = at * self.SLOTS + kick % self.SLOTS
            mark, self.table[k] = self.table[k], mark
            at = self.other(mark, at)
            if self._put(mark, at):
                self.used += 1
                return True
        return False

    def delete(self, digest: bytes) -> bool:
        """Take out one fingerprint of a digest that was inserted."""
        mark, one, two = self.places(digest)
        for at in (one, two):
            for k in range(at * self.SLOTS, at * self.SLOTS + self.SLOTS):
                if self.table[k] == mark:
                    self.table[k] = 0
                    self.used -= 1
                    return True
        return False


class CuckooIndex:
    """Live digests of one part of the digest space: a filter, and buckets with the content that hits are verified against.

    A digest's content (itself and its value) lies in the bucket that the filter tries first for it. Only a hit of the
    filter reads a bucket, and only a digest found there in full counts.
    """

    def __init__(self, buckets: int = 64):
        self.filter, self.content = CuckooFilter(buckets), [[] for _ in range(buckets)]
        self.resizes = self.false_hits = 0

    def __len__(self) -> int:
        return self.filter.used

    def items(self):
        return (entry for bucket in self.content for entry in bucket)

    def find(self, digest: bytes):
        """The value of a live digest, or None."""
        mark, one, two = self.filter.places(digest)
        if not self.filter.holds(mark, one, two):
            return None
        for own, value in self.content[one]:
            if own == digest:
                return value
        self.false_hits += 1
        return None

    def insert(self, digest: bytes, value) -> None:
        """Store a digest that isn't live yet."""
        self.content[self.filter.places(digest)[1]].append((digest, value))
        if not self.filter.insert(digest):
            self._resize()

    def delete(self, digest: bytes) -> bool:
        """Take a digest out; False if it isn't live, whatever the filter says."""
        if self.find(digest) is None:
            return False
        bucket = self.content[self.filter.places(digest)[1]]
        del bucket[next(i for i, (own, _) in enumerate(bucket) if own == digest)]
        return self.filter.delete(digest)

    def _resize(self) -> None:
        """A filter and buckets twice as large or larger, from the stored keys."""
        held, buckets = list(self.items()), self.filter.mask + 1
        while True:
            buckets *= 2
            self.resizes += 1
            self.filter = CuckooFilter(buckets)
            if all(self.filter.insert(digest) for digest, _ in held):
                break
        self.content = [[] for _ in range(buckets)]
        for digest, value in held:
            self.content[self.filter.places(digest)[1]].append((digest, value))


def better(a: tuple, b: tuple) -> tuple:
    """Of two candidates (code points, id) the one that stays: most code points, then smallest id; null ids last."""
    return min(a, b, key=lambda x: (-x[0], x[1] is None, x[1] or 0))


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n, digest): code points of the text and SHA-256 of the text without white space; null counts as empty."""
    text = common.text_or_empty()
    return docs.select("doc_id", F.char_length(text).cast("long").alias("n"), digest(text).alias("digest"))


def digest(text: Column) -> Column:
    """SHA-256 of a text without white space. It stands for the text: equal ones of different texts aren't to be expected, nor known."""
    return F.unhex(F.sha2(F.regexp_replace(text, BLANKS, "").cast("binary"), 256))


#: Parts of the digest space that each shuffle partition is indexed by, one after the other.
PARTS = 256
PARTIAL = "digest binary, keep_n long, keep_id long, group_size long"


def _combine(batches):
    """One row per distinct digest of a task's rows, so that a hot digest sends at most one row a task."""
    held: dict[bytes, list] = {}
    for batch in batches:
        for doc, n, digest in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "digest"))):
            if (x := held.get(digest)) is None:
                held[digest] = [(n, doc), 1]
            else:
                x[0], x[1] = better(x[0], (n, doc)), x[1] + 1
        if len(held) > 200_000:
            yield _rows(held)
            held = {}
    yield _rows(held)


def _rows(held: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(held.keys(), pa.binary()), *(pa.array(x, pa.int64()) for x in ([v[0][0] for v in held.values()], [v[0][1] for v in held.values()], [v[1] for v in held.values()]))],
        names=["digest", "keep_n", "keep_id", "group_size"],
    )


def _index(batches):
    """Pass partial rows, sorted by part, through an index for each part.

    Of two rows of one digest the better one is live: where a later one is, the former is deleted and it is inserted.
    """
    index, part, held = CuckooIndex(), None, []

    def out():
        for at in range(0, len(held), 10_000):
            yield _rows(dict(held[at : at + 10_000]))

    for batch in batches:
        for now, digest, n, doc, size in zip(*(c.to_pylist() for c in batch.columns)):
            if now != part:
                held += [(d, [row, count]) for d, (row, count) in index.items()]
                index, part = CuckooIndex(), now
                if len(held) >= 10_000:
                    yield from out()
                    held = []
            x = index.find(digest)
            if x is None:
                index.insert(digest, ((n, doc), size))
            else:
                index.delete(digest)
                index.insert(digest, (better(x[0], (n, doc)), x[1] + size))
    held += [(d, [row, count]) for d, (row, count) in index.items()]
    yield from out()


def classes(keys: DataFrame) -> DataFrame:
    """One row per distinct digest: the row that stays (keep_n, keep_id) and group_size.

    A shuffle partition is worked through in PARTS parts of the digest space, so that an index holds one of them only.
    """
    partial = keys.select("doc_id", "n", "digest").mapInArrow(_combine, PARTIAL).withColumn("part", F.expr(f"int(pmod(xxhash64(digest, 1), {PARTS}))"))
    return partial.select("part", *partial.columns[:-1]).repartition("digest").sortWithinPartitions("part").mapInArrow(_index, PARTIAL)


def exact_groups(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of docs (doc_id, text).

    Null texts count as empty; texts are equal when they are identical without white space; an empty table gives an
    empty result. Of equal texts the one with most code points stays, then the smallest id. Rows that repeat both id
    and text can't be told apart and are all marked kept. A null id stays only where no other id has that length.
    """
    keys = common.stash(digests(docs), "exact-keys")
    found = common.stash(classes(keys), "exact-classes")
    joined = common.attach(keys, found, "digest", "group_size")
    return joined.select("doc_id", "keep_id", "group_size", F.expr("doc_id <=> keep_id AND n = keep_n").alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs without the copies, by the rule of exact_groups; of rows that repeat id and text one stays.

    Null texts count as empty and are one class with empty and blank ones, of which one row stays; a null id stays only
    where no other id has that length. An empty table gives an empty result. Columns are those of docs, whatever their
    names.
    """
    keys = common.stash(digests(docs), "exact-keys")
    found = common.stash(classes(keys), "exact-classes")
    no_id = F.lit(-(1 << 63))
    stay = found.select("digest", F.coalesce("keep_id", no_id).alias("id"))
    boxes, names = common.boxed(docs)
    text = F.coalesce(F.col(names["text"]), F.lit(""))
    marked = boxes.withColumns({"digest": digest(text), "id": F.coalesce(F.col(names["doc_id"]), no_id), "n": F.char_length(text)})
    # by digest and id, so that a hot digest is spread; beyond repeated rows each class meets one row
    repeated = Window.partitionBy("digest", "id").orderBy(F.desc("n"))
    met = marked.join(stay, ["digest", "id"])
    return common.unboxed(met.withColumn("nth", F.row_number().over(repeated)).where("nth = 1"), names)

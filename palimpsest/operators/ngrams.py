"""Tokens to n-gram postings, and what is counted over them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from palimpsest.functions import text as T

POSTINGS = "doc_id long, ngram long, pos int, start_byte int, end_byte int"
YEAR = ", year int"


def tokenised(docs: DataFrame, min_length: int = 2) -> DataFrame:
    """docs with column tokens: lower-case letter runs of at least min_length characters."""
    return docs.withColumn("tokens", T.min_length(T.tokens(F.col("text")), min_length))


def exploded(docs: DataFrame, n: int = 3) -> DataFrame:
    """(doc_id, ngram): a row per n-gram occurrence."""
    return docs.select("doc_id", F.explode(T.ngrams(F.col("tokens"), n)).alias("ngram"))


def hashes(tokens: Column, n: int = 3) -> Column:
    """The 64-bit hashes of the distinct n-grams of a row."""
    return F.array_distinct(F.transform(T.ngrams(tokens, n), lambda g: F.xxhash64(g)))


def hashed(docs: DataFrame, n: int = 3) -> DataFrame:
    """(doc_id, ngram): each distinct n-gram of a document, as a 64-bit hash. Distinct within the row, before any shuffle."""
    return docs.select("doc_id", F.explode(hashes(F.col("tokens"), n)).alias("ngram"))


def frequencies(postings: DataFrame) -> DataFrame:
    """(ngram, n): occurrences in the corpus."""
    return postings.groupBy("ngram").agg(F.count("*").alias("n"))


@cache
def letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    out = np.zeros(0x110000, bool)
    for m in regex.finditer(r"\p{L}+", "".join(map(chr, range(0x110000)))):
        out[m.start() : m.end()] = True
    return out


def hash_of(words: np.ndarray) -> np.ndarray:
    """64 bits of a digest of each word in lower case; each different word is hashed once."""
    codes, own = pd.factorize(words)
    return np.array([int.from_bytes(hashlib.blake2b(w.lower().encode("utf-8", "replace"), digest_size=8).digest()) for w in own], np.uint64)[codes]


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64 bits of two hashes in order."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Characters that are cut into words at once, or one text.
CHARACTERS = 1 << 20


def postings(docs: DataFrame, n: int = 3, min_length: int = 2, sized: bool = False) -> DataFrame:
    """Postings with positions: n-gram hash, its index and the byte range from its first token to its last.

    Bytes are those of the text's UTF-8. Tokens shorter than min_length don't count. A document's year, where docs has
    one, goes with its postings; with sized, so does its number of different n-grams, as ``n``.
    """
    dated = "year" in docs.columns

    def of(ids: pa.Array, years: pa.Array | None, texts: list[str]) -> pa.RecordBatch:
        joined = " ".join(texts)
        begins = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
        chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        edges = np.diff(np.concatenate([[False], letters()[chars], [False]]).astype(np.int8))
        first, last = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        long = last - first >= min_length
        first, last = first[long], last[long]
        bytes_ = np.append(0, np.cumsum(1 + (chars > 0x7F).astype(np.int64) + (chars > 0x7FF) + (chars > 0xFFFF)))
        text = np.searchsorted(begins, first, "right") - 1
        words = np.empty(len(first), object)
        words[:] = [joined[a:b] for a, b in zip(first.tolist(), last.tolist())]
        hashes = hash_of(words) if len(words) else np.zeros(0, np.uint64)
        at = np.arange(max(0, len(first) - n + 1))
        at = at[text[at] == text[at + n - 1]]
        gram = hashes[at]
        for k in range(1, n):
            gram = mixed(gram, hashes[at + k])
        own = text[at]
        ints = [at - np.searchsorted(text, own), bytes_[first[at]] - bytes_[begins[own]], bytes_[last[at + n - 1]] - bytes_[begins[own]]]
        rows = pa.array(own)
        cols = [ids.take(rows), pa.array(gram.view(np.int64)), *(pa.array(c.astype(np.int32)) for c in ints)]
        if dated:
            cols.append(years.take(rows))
        if sized:
            order = np.lexsort((gram, own))
            new = np.append(True, (gram[order[1:]] != gram[order[:-1]]) | (own[order[1:]] != own[order[:-1]]))[: len(order)]
            cols.append(pa.array(np.bincount(own[order[new]], minlength=len(texts))[own].astype(np.int32)))
        return pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id").cast(pa.int64()), [t or "" for t in batch.column("text").to_pylist()]
            lo = size = 0
            for hi in range(1, len(texts) + 1):
                size += len(texts[hi - 1]) + 1
                if hi == len(texts) or size + len(texts[hi]) > CHARACTERS:
                    yield of(ids[lo:hi], batch.column("year")[lo:hi] if dated else None, texts[lo:hi])
                    lo, size = hi, 0

    schema = POSTINGS + YEAR * dated + ", n int" * sized
    own = ["doc_id", "text", *([F.col("year").try_cast("int").alias("year")] if dated else [])]
    return docs.select(*own).mapInArrow(run, schema)


def words_at(docs: DataFrame) -> DataFrame:
    """(doc_id, idx, word, start_byte, end_byte): the letter runs of each text, lower case, with their bytes in its UTF-8."""
    word = regex.compile(r"\p{L}+")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                out: list[list] = [[], [], [], [], []]
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    at = byte = 0
                    for i, m in enumerate(word.finditer(text or "")):
                        byte += len(text[at : m.start()].encode("utf-8", "replace"))
                        end, at = byte + len(m[0].encode()), m.end()
                        for c, v in zip(out, (doc, i, m[0].lower(), byte, end)):
                            c.append(v)
                        byte = end
                kinds = (pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["doc_id", "idx", "word", "start_byte", "end_byte"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, idx int, word string, start_byte long, end_byte long")

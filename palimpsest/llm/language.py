"""Language ID: multinomial logistic regression on TF-IDF of character n-grams.

The weights are learned by follow-the-regularised-leader (proximal) with L1 and L2 penalties, which leaves most of them
zero; a temperature fitted on texts put aside then makes the scores honest. Features of many texts are computed at once
over their code points.
"""

from __future__ import annotations

import sys
import unicodedata
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import common

#: n-grams of 1 to 3 characters are hashed into so many places.
PLACES = 1 << 16
#: At most so many texts are learned from, and besides so many of each language, for those that have few among the
#: first; which ones depends on a hash of their ids.
TRAINING_ROWS, LANGUAGE_ROWS = 3000, 100
EPOCHS, ALPHA, BETA, L1, L2 = 4, 0.3, 1.0, 0.02, 0.05
#: Feature values are shares of a text's n-grams, times this.
SCALE = 40.0


@cache
def letters() -> tuple[np.ndarray, np.ndarray]:
    """Whether each code point is a letter, and whether it is one or a mark, which may belong to one."""
    kinds = np.array([unicodedata.category(chr(c))[0] for c in range(sys.maxunicode + 1)])
    return kinds == "L", (kinds == "L") | (kinds == "M")


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of all n-grams, the number of the text that each belongs to, and each text's number of letters.

    Texts are in lower case; each run of characters other than letters and their marks counts as one space. A lone space
    isn't a gram.
    """
    code = np.frombuffer("\n".join([*(t.lower() for t in texts), ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t.lower()) + 1 for t in texts])
    owner = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
    pure, either = letters()
    is_letter = either[code]
    n_letters = np.bincount(owner[pure[code]], minlength=len(texts))
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # the first of a run of others stays, as a space
    code, owner = np.where(is_letter, code, 32)[keep].astype(np.uint32), owner[keep]
    at, of = [code[code != 32] * np.uint32(2654435761)], [owner[code != 32]]
    two = code[:-1] * np.uint32(0x9E3779B1) + code[1:] * np.uint32(0x85EBCA6B) + np.uint32(1)
    same = owner[:-1] == owner[1:]
    at, of = [*at, two[same]], [*of, owner[:-1][same]]
    if len(code) > 2:
        three = two[:-1] * np.uint32(0xC2B2AE35) + code[2:] * np.uint32(0x27D4EB2F) + np.uint32(2)
        same = owner[:-2] == owner[2:]
        at, of = [*at, three[same]], [*of, owner[:-2][same]]
    place = np.concatenate(at)
    place ^= place >> np.uint32(15)
    place *= np.uint32(0x2C1B3C6D)
    return (place >> np.uint32(16)).astype(np.int64), np.concatenate(of), n_letters


@dataclass
class Model:
    """weights has a row per place and a column per language, idf included; temperature divides the logits."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, place: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        per = np.maximum(np.bincount(owner, minlength=n), 1)
        return np.stack([np.bincount(owner, weights=self.weights[place, k], minlength=n) * SCALE / per + self.bias[k] for k in range(len(self.languages))], axis=1)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; ``und`` and 0 for a null or letterless text, or if nothing was learned."""
        n = len(texts)
        if not n or not self.languages:
            return ["und"] * n, np.zeros(n)
        place, owner, n_letters = grams([t or "" for t in texts])
        shares = softmax(self.logits(place, owner, n) / self.temperature)
        best = shares.argmax(1)
        known = n_letters > 0
        return [self.languages[b] if ok else "und" for b, ok in zip(best, known)], np.where(known, shares[np.arange(n), best], 0.0)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], names: list[str], df: np.ndarray | None = None, texts: int = 0) -> Model:
    """Model of (places, shares) rows and their languages; every fifth row is put aside for the temperature.

    df has in how many of so many texts each place occurs; without it the rows themselves are counted.
    """
    languages = sorted(set(names))
    if not languages:
        return Model([], np.zeros((PLACES, 0), np.float32), np.zeros(0))
    y = np.array([languages.index(x) for x in names])
    if df is None:
        df, texts = np.bincount(np.concatenate([r[0] for r in rows]), minlength=PLACES), len(rows)
    idf = np.log((1 + texts) / (1 + df)) + 1
    aside = np.arange(len(rows)) % 5 == 4 if len(rows) >= 50 else np.zeros(len(rows), bool)
    learn, k = np.flatnonzero(~aside), len(languages)
    z, n = np.zeros((PLACES + 1, k)), np.zeros((PLACES + 1, k))
    rng = np.random.default_rng(11)

    def weights(zs, ns):
        return np.where(np.abs(zs) <= L1, 0.0, -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(ns)) / ALPHA + L2))

    for _ in range(EPOCHS):
        for i in rng.permutation(learn):
            place, share = rows[i]
            at = np.append(place, PLACES)  # the last place is the bias
            x = np.append(share * idf[place] * SCALE, 1.0)
            zs, ns = z[at], n[at]
            w = weights(zs, ns)
            error = softmax((x @ w)[None])[0]
            error[y[i]] -= 1
            g = x[:, None] * error
            more = ns + g * g
            z[at] = zs + g - (np.sqrt(more) - np.sqrt(ns)) / ALPHA * w
            n[at] = more
    w = weights(z, n)
    model = Model(languages, (w[:PLACES] * idf[:, None]).astype(np.float32), w[PLACES])
    if aside.any():
        raw = np.stack([(share[:, None] * SCALE * model.weights[place]).sum(0) + model.bias for place, share in (rows[i] for i in np.flatnonzero(aside))])
        ts = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
        loss = [-np.log(softmax(raw / t)[np.arange(len(raw)), y[aside]] + 1e-12).mean() for t in ts]
        model.temperature = float(ts[int(np.argmin(loss))])
    return model


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text, modulo 4, is 2; a null id isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def frequencies(known: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of all texts each place occurs, and the number of texts. Each task sends at most PLACES counts."""

    def run(batches):
        df = np.zeros(PLACES + 1, np.int64)
        for batch in common.slices(batches, 256):
            place, owner, _ = grams(batch.column("text").to_pylist())
            df += np.bincount(np.unique(owner * PLACES + place) % PLACES, minlength=PLACES + 1)
            df[PLACES] += batch.num_rows
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], names=["place", "n"])

    df = np.zeros(PLACES + 1, np.int64)
    for r in known.select("text").mapInArrow(run, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).collect():
        df[r["place"]] = r["n"]
    return df[:PLACES], int(df[PLACES])


def train(docs: DataFrame) -> Model:
    """Model from rows with a language that aren't held out.

    Document frequencies are those of all such rows; weights are learned from at most TRAINING_ROWS ids, and LANGUAGE_ROWS
    of each language, smallest hashes of ids first, whole texts.
    """
    known = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    ids, by_hash = known.select("doc_id", "lang").distinct(), [F.xxhash64("doc_id"), F.col("doc_id"), F.col("lang")]
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(*by_hash))
    own = ids.withColumn("nth", nth).where(F.col("nth") <= LANGUAGE_ROWS).select("doc_id", "lang")
    ids = ids.orderBy(*by_hash).limit(TRAINING_ROWS).union(own).distinct()
    picked = known.join(F.broadcast(ids), ["doc_id", "lang"])  # TRAINING_ROWS ids and LANGUAGE_ROWS a language
    df, texts = frequencies(known)

    def make():
        def each(batch):
            place, owner, n_letters = grams(batch.column("text").to_pylist())
            places, shares = [], []
            for i in range(batch.num_rows):
                own, count = np.unique(place[owner == i], return_counts=True) if n_letters[i] else (np.zeros(0, int), np.zeros(0))
                places.append(own.astype(np.int32))
                shares.append((count / max(count.sum(), 1)).astype(np.float32))
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(places, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32()))], names=["doc_id", "lang", "places", "shares"])

        return each

    got = common.scan(picked.select("doc_id", "lang", "text"), make, "doc_id long, lang string, places array<int>, shares array<float>", 64).toArrow()
    cols = [got.column(c).combine_chunks() if got.num_rows else [] for c in ("places", "shares")]
    rows = [(np.asarray(cols[0][i].values), np.asarray(cols[1][i].values, dtype=np.float64)) for i in range(got.num_rows)]
    ids, names = got.column("doc_id").to_pylist(), got.column("lang").to_pylist()
    order = sorted((i for i in range(got.num_rows) if len(rows[i][0])), key=lambda i: (ids[i] * 2654435761 % (1 << 32), ids[i], names[i], rows[i][0].tobytes()))
    return fit([rows[i] for i in order], [names[i] for i in order], df, texts)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of docs (doc_id, text, lang).

    lang is read only to learn from rows that aren't held out. Null, empty and letterless texts give ``und`` with score
    0; a table without languages gives ``und`` throughout, an empty one an empty result. Repeated rows repeat their
    results, null ids aren't learned from, and a tie goes to the first language by name.
    """
    model = train(docs)

    def make():
        def each(batch):
            names, scores = model.predict(batch.column("text").to_pylist())
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores)], names=["doc_id", "held_out", "lang_pred", "score"])

        return each

    return common.scan(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), make, "doc_id long, held_out boolean, lang_pred string, score double", 256)

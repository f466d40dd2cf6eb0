"""Toxicity by a factorization machine over hashed terms.

A text is the set of its lower-case words, hashed. The machine has a weight a term and a short vector a term; the inner
product of two terms' vectors is the weight of their meeting in a text, which an additive model has no place for.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import common

WORD = re.compile(r"[^\W\d_]+")
#: Terms are hashed into so many places.
PLACES = 1 << 20
#: At most so many labelled texts are learned from, and of each label at least TOXIC_ROWS where there are so many; which
#: ones depends on a hash of their ids.
TRAINING_ROWS, TOXIC_ROWS = 12_000, 4000
#: Scores are those of a collection in which the rarer label has the share that it has among all labelled ids, or this
#: one if that is less: a rare label would have to be all but certain to reach the threshold.
LEAST_SHARE = 0.25
#: Terms of at least so many training texts have a weight and a vector.
LEAST_TEXTS = 3
#: Places of texts that the fit reads at once, about.
PLACES_AT_ONCE = 1 << 18
RANK, EPOCHS, RATE, DECAY = 4, 300, 0.05, 1e-3
#: Pull of weights and of vectors towards zero for a term that is alike under both labels, as of a normal prior; it falls
#: off where the z-score of the difference exceeds LEAST_Z. Each term can be learned, those without such evidence need more.
LEAST_Z, POWER, WEIGHT_PULL, VECTOR_PULL = 2.5, 32, 3e-3, 1e-2
THRESHOLD = 0.7


def places(text: str, known: dict[str, int]) -> set[int]:
    """Hashed terms of a whole text; known remembers words and is emptied when it is large."""
    if len(known) > 400_000:
        known.clear()
    out = set()
    for word in set(WORD.findall(text.lower())):
        if (at := known.get(word)) is None:
            at = known[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % PLACES
        out.add(at)
    return out


@dataclass
class Machine:
    """Factorization machine over the presence of terms: bias, weights and vectors by row of terms, whose keys ascend."""

    bias: float
    terms: dict[int, int]
    weights: np.ndarray
    vectors: np.ndarray

    def score(self, texts: list[str], known: dict) -> np.ndarray:
        out, n = np.full(len(texts), self.bias), len(texts)
        if self.terms and n:
            own = [places(t, known) for t in texts]
            key = np.fromiter((p for s in own for p in s), np.int64) + np.repeat(np.arange(n, dtype=np.int64) * PLACES, [len(s) for s in own])
            key.sort()
            owner, place = key // PLACES, key % PLACES
            terms = np.fromiter(self.terms, np.int64, len(self.terms))
            row = np.minimum(np.searchsorted(terms, place), len(terms) - 1)
            met = terms[row] == place
            owner, row = owner[met], row[met]
            out += np.bincount(owner, self.weights[row] - 0.5 * (self.vectors**2).sum(1)[row], n)
            for v in self.vectors.T:
                out += 0.5 * np.bincount(owner, v[row], n) ** 2
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def evidence(p: np.ndarray, n: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Each term's z-score of the difference of its log odds between the labels, from its numbers of texts of label 1 and 0."""
    p, n = p + 0.5, n + 0.5
    return (np.log(p / (labels.sum() + 1 - p + 0.5)) - np.log(n / ((1 - labels).sum() + 1 - n + 0.5))) / np.sqrt(1 / p + 1 / n)


def sums(at: np.ndarray, size: np.ndarray):
    """Function of values: the sums of values[at] over consecutive pieces of at of these sizes, none of them 0.

    at is read a few pieces at a time, so that nothing of its length is made.
    """
    ends = np.cumsum(size)
    cuts = np.unique(np.searchsorted(ends, np.arange(0, len(at), PLACES_AT_ONCE)))
    parts = [(slice(a, b), slice(ends[a] - size[a], ends[b - 1]), ends[a:b] - size[a:b] - (ends[a] - size[a])) for a, b in zip(cuts, [*cuts[1:], len(size)])]

    def of(values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(size))
        for mine, entries, begins in parts:
            out[mine] = np.add.reduceat(values[at[entries]], begins)
        return out

    return of


def fit(features: list[np.ndarray], labels: np.ndarray) -> Machine:
    """Machine by full-batch Adam on the logistic loss. Without both labels it scores the share of label 1 (none: 0).

    Every term of at least LEAST_TEXTS texts is learned; only the places of terms that are there are held and visited.
    """
    n, share = len(labels), float(labels.mean()) if len(labels) else 0.0
    prior = float(np.clip(np.log((share + 1e-4) / (1 - share + 1e-4)), -9, 9))
    place = np.concatenate([np.zeros(0, np.int32), *features], dtype=np.int32, casting="same_kind")
    here = np.flatnonzero(np.bincount(place, minlength=PLACES) >= LEAST_TEXTS) if 0 < share < 1 else np.zeros(0, np.int64)
    at = {int(t): i for i, t in enumerate(here)}
    rng = np.random.default_rng(7)
    bias, w, v = np.array([prior]), np.zeros(len(here)), rng.normal(0, 0.01, (RANK, len(here)))
    if not len(here):
        return Machine(prior, at, w, v.T)
    row = np.full(PLACES, -1, np.int32)
    row[here] = np.arange(len(here))
    col = row[place]
    owner = np.repeat(np.arange(n, dtype=np.int32), [len(f) for f in features])[col >= 0]
    col = col[col >= 0]
    del place
    texts, by_term = np.bincount(owner, minlength=n), col.astype(np.int64)
    by_term *= n
    by_term += owner
    by_term.sort()  # by term, then by text
    by_term %= n
    del owner
    full = np.flatnonzero(texts)  # texts with a term
    per_full, per_term = sums(col, texts[full]), sums(by_term.astype(np.int32), np.bincount(col, minlength=len(here)))
    del by_term

    def per_text(values: np.ndarray) -> np.ndarray:
        out = np.zeros(n)
        out[full] = per_full(values)
        return out

    pull = 1 / (1 + (np.abs(evidence(per_term(labels), per_term(1 - labels), labels)) / LEAST_Z) ** POWER)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (bias, w, v)]
    for step in range(1, EPOCHS + 1):
        xv = np.stack([per_text(k) for k in v])
        raw = bias + per_text(w - 0.5 * (v**2).sum(0)) + 0.5 * (xv**2).sum(0)
        error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels) / n
        single = per_term(error)
        grads = [np.array([error.sum()]), single + WEIGHT_PULL * pull * w, np.stack([per_term(error * k) for k in xv]) - single * v + (DECAY + VECTOR_PULL * pull) * v]
        for p, g, (m, s) in zip((bias, w, v), grads, state):
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return Machine(float(bias[0]), at, w, np.ascontiguousarray(v.T))


def learned(rows: pa.Table) -> Machine:
    """Machine from rows (doc_id, _toxic, places) in any order; the places are read where they lie, not made Python objects."""
    features = []
    for chunk in rows.column("places").chunks:
        ends = chunk.offsets.to_numpy()
        features += np.split(chunk.flatten().to_numpy(), ends[1:-1] - ends[0]) if len(chunk) else []
    ids, marks = rows.column("doc_id").to_numpy(), rows.column("_toxic").to_numpy()
    _, nth, count = np.unique(ids, return_inverse=True, return_counts=True)
    order = sorted(range(len(ids)), key=lambda i: (ids[i], features[i].astype(np.int64).tobytes() if count[nth[i]] > 1 else b""))
    return fit([features[i] for i in order], (marks[order] > 0).astype(np.int64) if order else np.zeros(0, np.int64))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text, modulo 3, is 1; a null id isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Machine:
    """Machine from labelled rows that aren't held out: at most TRAINING_ROWS ids, smallest hashes first, whole texts.

    A rare label has at least TOXIC_ROWS ids, where there are so many; the bias is then set to the odds of the labels
    among all labelled ids, or to those of LEAST_SHARE where one label has less.
    """
    ids = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic") > 0).alias("_toxic"))
    ids = ids.where(~held_out(F.col("doc_id")))
    all_ = {r["_toxic"]: r["n"] for r in ids.groupBy("_toxic").agg(F.count("*").alias("n")).collect()}
    rare = min(all_.get(True, 0), all_.get(False, 0))
    few = min(rare, max(TOXIC_ROWS, TRAINING_ROWS * rare // max(1, sum(all_.values()))))
    take = {k: few if n == rare else min(n, TRAINING_ROWS - few) for k, n in all_.items()}
    by_hash = lambda k: ids.where(F.col("_toxic") == F.lit(k)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(take.get(k, 0))
    picked = docs.select("doc_id", "text").join(F.broadcast(by_hash(True).union(by_hash(False))), "doc_id")  # TRAINING_ROWS ids

    def make():
        known: dict[str, int] = {}

        def each(batch):
            rows = [sorted(places(t or "", known)) for t in batch.column("text").to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_toxic"), pa.array(rows, pa.list_(pa.int32()))], names=["doc_id", "_toxic", "places"])

        return each

    rows = common.scan(picked.select("doc_id", F.col("_toxic").cast("int").alias("_toxic"), "text"), make, "doc_id long, _toxic int, places array<int>").toArrow()
    machine = learned(rows)
    if rare:
        share = min(max(all_[True] / sum(all_.values()), LEAST_SHARE), 1 - LEAST_SHARE)
        machine.bias += float(np.log(share / (1 - share)) - np.log(take[True] / take[False]))
    return machine


def scorer(machine: Machine):
    """Column function of a text: its score, 0 to 1. Null counts as empty."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        known: dict[str, int] = _KNOWN
        return pa.concat_arrays([pa.array(machine.score([t or "" for t in texts.slice(at, 1024).to_pylist()], known)) for at in range(0, len(texts), 1024)] or [pa.array([], pa.float64())])

    return score


_KNOWN: dict[str, int] = {}


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs (doc_id, text); labels has doc_id and toxic (0 or 1).

    Null texts count as empty and score what a text without known terms does; rows are scored one by one, so repeated
    ones repeat their scores. An id with several labels counts as toxic if one of them says so; rows with a null id or
    label aren't learned from, and with no labels at all every score is the share of label 1, or near 0. An empty table
    gives an empty result.
    """
    mark = scorer(train(docs, labels))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), mark("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that score THRESHOLD or more; columns, whatever their names, and all other rows stay.

    Nulls, empty texts, repeated rows and empty tables are as in score.
    """
    mark = scorer(train(docs, labels))
    return docs.where(mark("text") < THRESHOLD)

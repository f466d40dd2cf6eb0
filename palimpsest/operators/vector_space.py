"""Vector-space alignment: chunks, TF-IDF weights, similarity joins and merging of matches."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from palimpsest.operators import blocks


def folded(objects: DataFrame, least: int, parent: str = "doc_id", order: str = "pos") -> DataFrame:
    """Text objects (parent, order, tokens) with short ones appended to the one before; a short first one stays alone."""
    w = Window.partitionBy(parent).orderBy(order)
    marked = objects.withColumn("_new", ((F.size("tokens") >= least) | (F.row_number().over(w) == 1)).cast("int"))
    marked = marked.withColumn("_island", F.sum("_new").over(w))
    parts = F.array_sort(F.collect_list(F.struct(order, "tokens")))
    return marked.groupBy(parent, "_island").agg(F.min(order).alias(order), F.flatten(F.transform(parts, lambda x: x["tokens"])).alias("tokens")).drop("_island")


def chunks(objects: DataFrame, n: int, least: int, parent: str = "doc_id", order: str = "pos") -> DataFrame:
    """(parent, chunk, tokens): windows of n text objects of a parent, half a window apart, of n x least tokens at least.

    Short objects are to be folded first. The last window of a parent may have fewer objects.
    """
    step = math.ceil(n / 2)
    parts = objects.groupBy(parent).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, "tokens"))), lambda x: x["tokens"]).alias("parts"))
    last = F.greatest(F.ceil((F.size("parts") - n) / step), F.lit(0)).cast("int")
    each = parts.select(parent, "parts", F.explode(F.sequence(F.lit(0), last)).alias("chunk"))
    each = each.select(parent, "chunk", F.flatten(F.slice("parts", F.col("chunk") * step + 1, n)).alias("tokens"))
    return each.where(F.size("tokens") >= n * least)


def tfidf(terms: DataFrame, key: str = "chunk_id", low: float = 0.0, high: float = 1.0, fitted: DataFrame | None = None) -> DataFrame:
    """(key, term, weight): smoothed TF-IDF, each key's weights of Euclidean length 1.

    terms has a row per occurrence. low and high bound the share of keys that a term occurs in. fitted is a table
    (term, idf) of another corpus to take the vocabulary from.
    """
    tf = terms.groupBy(key, "term").agg(F.count("*").alias("tf"))
    idf = fitted if fitted is not None else inverse_frequency(tf, key, low, high)
    raw = tf.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    norm = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, key).select(key, "term", (F.col("w") / F.col("norm")).alias("weight"))


def inverse_frequency(tf: DataFrame, key: str, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """(term, idf) of one row per key and term: ln((1 + n) / (1 + df)) + 1 for terms with a share within the bounds."""
    n = tf.select(key).distinct().agg(F.count("*").alias("n"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    share = F.col("df") / F.col("n")
    return df.join(F.broadcast(n)).where((share >= low) & (share <= high)).select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))  # n is one row


def term_similarity(weights: DataFrame, least: float, key: str = "chunk_id", jaccard: float | None = None, target: DataFrame | None = None) -> DataFrame:
    """(a, b, similarity, common): pairs by their common terms, block against block; pairs of one table are taken once, a before b.

    jaccard is the least share of common terms, if pairs are to be filtered by it too.
    """
    lists = lambda w: w.groupBy(F.col(key).alias("id")).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct(F.xxhash64("term").alias("k"), "weight"))).alias("_t")).select("id", "n", F.col("_t.k").alias("keys"), F.col("_t.weight").alias("weights"))

    def keep(common, total, a_n, b_n):
        near = total >= least - 1e-6
        return near if jaccard is None else near & (common / (a_n + b_n - common) >= jaccard)

    found = blocks.common(lists(weights), keep, None if target is None else lists(target), target is None, weighted=True)
    return found.where(F.round("total", 6) >= least).select(F.col("s").alias("a"), F.col("t").alias("b"), F.col("total").alias("similarity"), "common")


def dense_similarity(queries: DataFrame, rows: DataFrame, least: float, block: int = 1024) -> DataFrame:
    """(a, b, similarity): inner products of at least ``least`` of queries (id, v) with rows (id, v), exact.

    Both sides are cut into blocks by a hash of the id; a task multiplies one block of queries with one of rows.
    """
    nq, nr = (max(1, math.ceil(x.count() / block)) for x in (queries, rows))
    q = queries.select(F.expr(f"int(pmod(xxhash64(id), {nq}))").alias("i"), F.explode(F.expr(f"sequence(0, {nr - 1})")).alias("j"), "id", "v", F.lit(True).alias("query"))
    r = rows.select(F.explode(F.expr(f"sequence(0, {nq - 1})")).alias("i"), F.expr(f"int(pmod(xxhash64(id), {nr}))").alias("j"), "id", "v", F.lit(False).alias("query"))

    def product(table: pa.Table) -> pa.Table:
        ask = table.column("query").to_numpy()
        ids = table.column("id").to_numpy()
        out = ([], [], [])
        if ask.any() and not ask.all():
            x = np.array(table.column("v").to_pylist(), np.float64)
            sim = x[ask] @ x[~ask].T
            i, j = np.nonzero(np.round(sim, 6) >= least)
            out = (ids[ask][i], ids[~ask][j], sim[i, j])
        return pa.table({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64()), "similarity": pa.array(out[2], pa.float64())})

    return q.unionByName(r).groupBy("i", "j").applyInArrow(product, "a long, b long, similarity double")


def merge_matches(found: list[tuple], rounds: int = 50) -> list[tuple]:
    """Matches (source, target, s_start, s_end, t_start, t_end) merged until nothing changes.

    In order of source, target, source start, longer first, target start, longer first: a match that begins within the
    group and ends at or beyond its end moves that end, on either side on its own; one that does so on neither opens a
    group of its own.
    """

    def once(rows: list[tuple]) -> list[tuple]:
        out: list[list] = []
        for m in sorted(rows, key=lambda m: (m[0], m[1], m[2], m[2] - m[3], m[4], m[4] - m[5])):
            g = out[-1] if out and out[-1][:2] == list(m[:2]) else None
            took = False
            if g is not None and m[2] <= g[3] <= m[3]:
                g[3], took = m[3], True
            if g is not None and m[4] <= g[5] <= m[5]:
                g[5], took = m[5], True
            if not took:
                out.append(list(m))
        return [tuple(g) for g in out]

    for _ in range(rounds):
        new = once(found)
        if new == found:
            return new
        found = new
    return found


def merged(matches: DataFrame) -> DataFrame:
    """merge_matches for each pair of documents of matches (s, t, s_start, s_end, t_start, t_end)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out(rows):
            cols = list(zip(*rows)) or [[]] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["s", "t", "s_start", "s_end", "t_start", "t_end"])

        for batch in batches:
            done: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[-1][:2] != row[:2]:
                    done += merge_matches(held)
                    held = []
                held.append(row)
            yield out(done)
        yield out(merge_matches(held))

    cols = ("s", "t", "s_start", "s_end", "t_start", "t_end")
    return matches.select(*(F.col(c).cast("long").alias(c) for c in cols)).repartition("s", "t").sortWithinPartitions("s", "t").mapInArrow(run, ", ".join(f"{c} long" for c in cols))


def mean_similarity(matches: DataFrame, group: str = "group_id") -> DataFrame:
    """A merged group's score until a model gives it one: the mean of its constituents."""
    return matches.groupBy(group).agg(F.avg("similarity").alias("similarity"))


def neighbours(sentences: DataFrame, parent: str, order: str, text: str = "text") -> DataFrame:
    """Each sentence with the one before and after it within its parent, null at the parent's ends."""
    w = Window.partitionBy(parent).orderBy(order)
    return sentences.withColumns({"previous": F.lag(text).over(w), "following": F.lead(text).over(w)})


def expansions(sentences: DataFrame, parent: str, order: str, text: str = "text") -> DataFrame:
    """Each sentence joined with the one before, the one after, and both, without empty parts."""
    near = neighbours(sentences, parent, order, text)

    def joined(*parts: str):
        return F.array_join(F.filter(F.array(*(F.coalesce(F.col(p), F.lit("")) for p in parts)), lambda x: x != ""), " ")

    return near.withColumns({"with_previous": joined("previous", text), "with_following": joined(text, "following"), "with_both": joined("previous", text, "following")})


def choose_expansion(scores: DataFrame, tie: float = 0.001) -> DataFrame:
    """Which way a passage is widened by scores original, previous, following: the better one that isn't worse, both on a tie."""
    o, p, f = F.col("original"), F.col("previous"), F.col("following")
    p_ok, f_ok = p >= o, f >= o
    way = F.when(p_ok & f_ok & (F.abs(p - f) < tie), "both").when(p_ok & (~f_ok | (p > f)), "previous").when(f_ok, "following").otherwise("none")
    return scores.withColumn("expand", way)


def widened(matches: DataFrame, sentences: DataFrame, scorer, rounds: int = 2, short: int = 4) -> DataFrame:
    """matches (id, s_parent, s_first, s_last, t_parent, t_first, t_last) whose passages, runs of sentences (parent, pos, text), grow while a scorer likes it.

    A match with fewer than ``short`` sentences on one side is tried with a sentence more before, and with one more
    after, on both sides, within their parents; it takes the way that choose_expansion names and goes on from there, so
    many rounds at most. scorer is a function of two pandas columns of texts.
    """
    from palimpsest.plans.tables import written

    score = F.pandas_udf(scorer, "double")
    sides = ("s", "t")
    size = lambda c: F.col(f"{c}_last") - F.col(f"{c}_first") + 1
    done = matches.where(F.least(size("s"), size("t")) >= short)
    now = written(matches.where(F.least(size("s"), size("t")) < short), "matches")
    for _ in range(rounds):
        ways = F.explode(F.array(*(F.struct(F.lit(w).alias("way"), F.lit(p).alias("p"), F.lit(f).alias("f")) for w, p, f in (("original", 0, 0), ("previous", 1, 0), ("following", 0, 1)))))
        tried = now.withColumn("w", ways)
        each = [tried.select("id", "w.way", F.lit(c).alias("side"), F.col(f"{c}_parent").alias("parent"), F.explode(F.sequence(F.col(f"{c}_first") - F.col("w.p"), F.col(f"{c}_last") + F.col("w.f"))).alias("pos")) for c in sides]
        texts = each[0].union(each[1]).join(sentences.select("parent", "pos", "text"), ["parent", "pos"])
        listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ")
        ranges = texts.groupBy("id", "way", "side").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), listed.alias("text"))
        of = lambda c: ranges.where(F.col("side") == c).select("id", "way", *(F.col(x).alias(f"{c}_{x}") for x in ("first", "last", "text")))
        scored = of("s").join(of("t"), ["id", "way"]).withColumn("score", score("s_text", "t_text"))
        pick = lambda x, way: F.max(F.when(F.col("way") == way, F.col(x)))
        wide = scored.groupBy("id").agg(*(pick("score", w).alias(w) for w in ("original", "previous", "following")), *(pick(f"{c}_first", "previous").alias(f"{c}_before") for c in sides), *(pick(f"{c}_last", "following").alias(f"{c}_after") for c in sides))
        chosen = choose_expansion(wide).withColumns({"back": F.col("expand").isin("previous", "both"), "on": F.col("expand").isin("following", "both")})
        out = now.join(chosen, "id", "left")
        grown = {f"{c}_first": F.when(F.col("back"), F.col(f"{c}_before")).otherwise(F.col(f"{c}_first")) for c in sides} | {f"{c}_last": F.when(F.col("on"), F.col(f"{c}_after")).otherwise(F.col(f"{c}_last")) for c in sides}
        out = written(out.withColumns(grown | {"_moved": F.coalesce(F.col("back") | F.col("on"), F.lit(False))}).select(*now.columns, "_moved"), "matches")
        done = done.unionByName(out.where("NOT _moved").drop("_moved"))
        now = out.where("_moved").drop("_moved")
    return done.unionByName(now)


def token_at(tokens: DataFrame, offsets: DataFrame, doc: str = "doc_id") -> DataFrame:
    """For each offset (doc, offset) the index of the last token that starts at or before it, or the first token."""
    met = offsets.join(tokens.select(doc, "idx", "start"), doc)
    return met.groupBy(doc, "offset").agg(F.coalesce(F.max(F.when(F.col("start") <= F.col("offset"), F.col("idx"))), F.min("idx")).alias("idx"))


def chronological(rows: DataFrame, source: str = "source_year", target: str = "target_year") -> DataFrame:
    """Pairs whose source isn't younger than their target; pairs without both years drop out."""
    return rows.where(F.col(source) <= F.col(target))

"""Networks of authors or titles, their centralities, and graphs of clusters."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F


def edges(rows: DataFrame, source: str, target: str, least: int = 1) -> DataFrame:
    """(source, target, weight): pairs of different names and how many rows have them."""
    named = rows.where(f"`{source}` <> '' AND `{target}` <> '' AND `{source}` <> `{target}`")
    return named.groupBy(F.col(source).alias("source"), F.col(target).alias("target")).agg(F.count("*").alias("weight")).where(F.col("weight") >= least)


def nodes(links: DataFrame) -> DataFrame:
    """(node, as_source, as_target, total): weights of a node's edges; the total is its weighted degree."""
    ends = links.select(F.col("source").alias("node"), F.col("weight").alias("as_source"), F.lit(0).cast("long").alias("as_target")).union(links.select("target", F.lit(0).cast("long"), "weight"))
    return ends.groupBy("node").agg(F.sum("as_source").alias("as_source"), F.sum("as_target").alias("as_target"), F.sum(F.col("as_source") + F.col("as_target")).alias("total"))


def top(links: DataFrame, most: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """The heaviest nodes, ties by name, and the edges between them."""
    kept = nodes(links).orderBy(F.desc("total"), "node").limit(most)
    names = kept.select("node")
    own = links.join(names.withColumnRenamed("node", "source"), "source", "left_semi").join(names.withColumnRenamed("node", "target"), "target", "left_semi")
    return kept, own.select("source", "target", "weight")


def eigenvector(links: pd.DataFrame, rounds: int = 100, tolerance: float = 1e-6) -> pd.Series:
    """Eigenvector centrality over incoming edges by power iteration, of length 1; weighted degree if it doesn't settle.

    For the at most 10,000 nodes of a network that is shown.
    """
    names = sorted({*links.source, *links.target})
    at = {n: i for i, n in enumerate(names)}
    s, t, w = links.source.map(at).to_numpy(int), links.target.map(at).to_numpy(int), links.weight.to_numpy(float)
    x = np.full(len(names), 1 / max(len(names), 1))
    for _ in range(rounds):
        new = x.copy()
        np.add.at(new, t, x[s] * w)
        new /= np.linalg.norm(new) or 1
        if np.abs(new - x).sum() < len(names) * tolerance:
            return pd.Series(new, names)
        x = new
    degree = np.zeros(len(names))
    np.add.at(degree, s, w)
    np.add.at(degree, t, w)
    return pd.Series(degree, names)


def betweenness(links: pd.DataFrame) -> pd.Series:
    """Betweenness over directed edges with weights as distances, normalised by (n - 1)(n - 2)."""
    names = sorted({*links.source, *links.target})
    out: dict[str, list[tuple[str, float]]] = {n: [] for n in names}
    for s, t, w in links[["source", "target", "weight"]].itertuples(index=False):
        out[s].append((t, float(w)))
    score = dict.fromkeys(names, 0.0)
    for root in names:
        dist: dict[str, float] = {}
        best = {root: 0.0}
        count = {root: 1.0}
        before: dict[str, list[str]] = {root: []}
        queue, order = [(0.0, root)], []
        while queue:
            d, v = heapq.heappop(queue)
            if v in dist:
                continue
            dist[v] = d
            order.append(v)
            for u, w in out[v]:
                far = d + w
                if u not in best or far < best[u]:
                    best[u], count[u], before[u] = far, count[v], [v]
                    heapq.heappush(queue, (far, u))
                elif far == best[u] and u not in dist:
                    count[u] += count[v]
                    before[u].append(v)
        share = dict.fromkeys(order, 0.0)
        for v in reversed(order):
            for p in before[v]:
                share[p] += count[p] / count[v] * (1 + share[v])
            if v != root:
                score[v] += share[v]
    n = len(names)
    return pd.Series(score) / ((n - 1) * (n - 2)) if n > 2 else pd.Series(score, dtype=float)


def modularity(links: pd.DataFrame, community: pd.Series) -> float:
    """How much more of the weight lies within communities than chance would put there."""
    total = float(links.weight.sum())
    inside: dict = {}
    degree: dict = {}
    for s, t, w in links[["source", "target", "weight"]].itertuples(index=False):
        for n in (s, t):
            degree[community[n]] = degree.get(community[n], 0.0) + w
        if community[s] == community[t]:
            inside[community[s]] = inside.get(community[s], 0.0) + w
    return sum(inside.get(c, 0.0) / total - (d / (2 * total)) ** 2 for c, d in degree.items()) if total else 0.0


def communities(links: pd.DataFrame) -> pd.Series:
    """Communities by Louvain's method: nodes move to the neighbouring community that gains most modularity, in order of
    name, until none moves; communities then become nodes. They are numbered in order of their first node's name."""
    names = sorted({*links.source, *links.target})
    at = {n: i for i, n in enumerate(names)}
    near: list[dict[int, float]] = [{} for _ in names]
    for s, t, w in links[["source", "target", "weight"]].itertuples(index=False):
        a, b = at[s], at[t]
        near[a][b] = near[a].get(b, 0.0) + float(w)
        near[b][a] = near[b].get(a, 0.0) + float(w)
    of = list(range(len(names)))  # each node's community, as a node of the present level
    while near:
        total = sum(sum(x.values()) for x in near)  # a loop stands for both ends of its weight
        degree = [sum(x.values()) for x in near]
        label, sums = list(range(len(near))), list(degree)
        moved, any_moved = True, False
        while moved and total:
            moved = False
            for i, links_ in enumerate(near):
                sums[label[i]] -= degree[i]
                to: dict[int, float] = {label[i]: 0.0}
                for j, w in links_.items():
                    if j != i:
                        to[label[j]] = to.get(label[j], 0.0) + w
                gain = {c: w - sums[c] * degree[i] / total for c, w in to.items()}
                best = min(gain, key=lambda c: (-gain[c], c))
                if best != label[i] and gain[best] > gain[label[i]] + 1e-12:
                    label[i], moved, any_moved = best, True, True
                sums[label[i]] += degree[i]
        if not any_moved:
            break
        number = {c: k for k, c in enumerate(dict.fromkeys(label))}
        of = [number[label[c]] for c in of]
        joined: list[dict[int, float]] = [{} for _ in number]
        for i, links_ in enumerate(near):
            own = joined[number[label[i]]]
            for j, w in links_.items():
                own[number[label[j]]] = own.get(number[label[j]], 0.0) + w
        near = joined
    number = {c: k for k, c in enumerate(dict.fromkeys(of))}
    return pd.Series({n: number[c] for n, c in zip(names, of)}, dtype="int64")


def shown(kept: DataFrame, low: float = 3.0, high: float = 20.0) -> DataFrame:
    """Nodes with a size between low and high by their weight, and a place on a circle in order of name."""
    span = kept.agg(F.min("total").alias("a"), F.max("total").alias("b"), F.count("*").alias("n"))
    from palimpsest.plans.tables import ordinal

    numbered = ordinal(kept, F.col("node"), name="nth").withColumn("nth", F.col("nth") - 1)
    scale = F.when(F.col("b") > F.col("a"), (F.col("total") - F.col("a")) / (F.col("b") - F.col("a"))).otherwise(F.lit(0.0))
    angle = F.lit(2 * math.pi) * F.col("nth") / F.col("n")
    return numbered.crossJoin(F.broadcast(span)).withColumns({"size": F.lit(low) + scale * (high - low), "x": F.cos(angle), "y": F.sin(angle)}).drop("a", "b", "n", "nth")  # span is one row


def edge_size(weight):
    return F.lit(2.0) * F.log(weight + 1)


def centroids(vectors: DataFrame, cluster: str = "label", vector: str = "embedding") -> DataFrame:
    """(cluster, pos, mean): the mean of each dimension of each cluster's vectors."""
    each = vectors.select(cluster, F.posexplode(vector).alias("pos", "x"))
    return each.groupBy(cluster, "pos").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def cluster_similarity(means: DataFrame, cluster: str = "label") -> DataFrame:
    """(a, b, similarity): cosine of the centroids of two clusters, a before b. Clusters are few beside their vectors."""
    a = means.select(F.col(cluster).alias("a"), "pos", F.col("mean").alias("x"))
    b = means.select(F.col(cluster).alias("b"), "pos", F.col("mean").alias("y"))
    met = a.join(b, "pos").where("a < b")
    return met.groupBy("a", "b").agg((F.sum(F.col("x") * F.col("y")) / F.sqrt(F.sum(F.col("x") * F.col("x"))) / F.sqrt(F.sum(F.col("y") * F.col("y")))).alias("similarity"))


def singletons(rows: DataFrame, cluster: str = "cluster", order: str = "id") -> DataFrame:
    """Noise (cluster -1) as clusters of one, numbered behind the others in order of id."""
    from palimpsest.plans.tables import ordinal

    n = rows.where(F.col(cluster) >= 0).agg(F.coalesce(F.max(cluster) + 1, F.lit(0)).alias("n"))
    noise = ordinal(rows.where(F.col(cluster) < 0), F.col(order), name="_nth").crossJoin(F.broadcast(n))  # n is one row
    return rows.where(F.col(cluster) >= 0).unionByName(noise.withColumn(cluster, (F.col("n") + F.col("_nth") - 1).cast(dict(rows.dtypes)[cluster])).drop("_nth", "n"))


def semantic_nodes(rows: DataFrame, least: int = 5) -> DataFrame:
    """(author, cluster, passages, x, y): authors of either side in each cluster with enough passages, at their mean place."""
    both = rows.select(F.col("source_author").alias("author"), "cluster", "x", "y").union(rows.select("target_author", "cluster", "x", "y"))
    return both.groupBy("author", "cluster").agg(F.count("*").alias("passages"), F.avg("x").alias("x"), F.avg("y").alias("y")).where(F.col("passages") >= least)


def semantic_edges(nodes_: DataFrame, similarity: DataFrame) -> DataFrame:
    """Edges of a semantic graph: from each node to its cluster's anchor, where it has others, and between anchors by similarity."""
    per = nodes_.groupBy("cluster").agg(F.count("*").alias("n")).where("n > 1").select("cluster")
    star = nodes_.join(per, "cluster", "left_semi").select(F.concat_ws("|", "author", F.col("cluster").cast("string")).alias("source"), F.concat(F.lit("anchor|"), F.col("cluster").cast("string")).alias("target"), F.lit(1.0).alias("weight"), F.lit("intra").alias("edge_type"))
    near = similarity.where("similarity > 0").select(F.concat(F.lit("anchor|"), F.col("a").cast("string")), F.concat(F.lit("anchor|"), F.col("b").cast("string")), F.col("similarity") * 10, F.lit("inter"))
    return star.union(near)


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=-1, keepdims=True), 1e-12)


def _dot(x: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Products of rows with a vector, each rounded alike wherever its row lies, unlike those of BLAS."""
    return (x * v).sum(1)


def mmr(vectors: np.ndarray, centroid: np.ndarray, most: int = 100, balance: float = 0.5) -> list[int]:
    """Rows by maximal marginal relevance: nearest the centroid first, then near it yet unlike those chosen."""
    x, c = _unit(vectors), _unit(centroid)
    relevance = _dot(x, c)
    chosen: list[int] = []
    nearest = np.full(len(x), -np.inf)
    while len(chosen) < min(most, len(x)):
        score = relevance if not chosen else balance * relevance - (1 - balance) * nearest
        score = score.copy()
        score[chosen] = -np.inf
        best = int(np.argmax(score))
        chosen.append(best)
        nearest = np.maximum(nearest, _dot(x, x[best]))
    return chosen


#: Members of a cluster that enter one task; larger clusters are cut into parts, each of which offers so many at once.
PART, OFFER = 20_000, 200


def representatives(vectors: DataFrame, cluster: str, key: str, vector: str, most: int = 100, balance: float = 0.5, per: int = PART, offer: int = OFFER) -> DataFrame:
    """(cluster, rank, key): MMR within each cluster, over all its members. Keys are unique; ties go to the smallest.

    Of a cluster of more than ``per`` members each part offers its best by the scores so far, and the next one as a
    bound. Scores only fall as more are chosen, so what beats all bounds is the best of the cluster; once the bounds
    are reached the parts offer anew.
    """
    from palimpsest.plans.tables import written

    mean = centroids(vectors, cluster, vector).groupBy(cluster).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "mean"))), lambda s: s["mean"]).alias("_c"))
    sizes = written(mean.join(vectors.groupBy(cluster).agg(F.count("*").alias("_n")), cluster), "sizes")
    kind = dict(vectors.dtypes)
    shape = f"{cluster} {kind[cluster]}, rank int, {key} {kind[key]}"
    rows = vectors.select(cluster, key, vector)

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        order = mmr(np.stack(pdf[vector].to_numpy()).astype(float), np.asarray(pdf["_c"].iloc[0], float), most, balance)
        return pd.DataFrame({cluster: pdf[cluster].iloc[0], "rank": range(1, len(order) + 1), key: pdf[key].to_numpy()[order]})

    small = rows.join(sizes.where(F.col("_n") <= per), cluster).groupBy(cluster).applyInPandas(pick, shape)
    large = sizes.where(F.col("_n") > per)
    left = large.count()
    if not left:
        return small

    def offers(own: pd.DataFrame, side: pd.DataFrame) -> pd.DataFrame:
        if own.empty or side.empty:
            return pd.DataFrame({c: [] for c in (cluster, key, "_rel", "_near", "_x", "_bound")})
        own, side = own.sort_values(key), side.iloc[0]
        x = _unit(np.stack(own[vector].to_numpy()).astype(float))
        relevance, nearest = _dot(x, _unit(np.asarray(side["_c"], float))), np.full(len(x), -np.inf)
        for v in side["_xs"]:
            nearest = np.maximum(nearest, _dot(x, np.asarray(v, float)))
        score = relevance if not len(side["_keys"]) else balance * relevance - (1 - balance) * nearest
        score = np.where(own[key].isin(list(side["_keys"])), -np.inf, score)
        order = np.argsort(-score, kind="stable")[: offer + 1]
        order = order[score[order] > -np.inf]
        return pd.DataFrame({cluster: own[cluster].iloc[0], key: own[key].to_numpy()[order], "_rel": relevance[order], "_near": nearest[order], "_x": list(x[order]), "_bound": np.arange(len(order)) == offer})

    def advance(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        keys, x, relevance, nearest, bound = pdf[key].to_numpy(), np.stack(pdf["_x"].to_numpy()), pdf["_rel"].to_numpy(), pdf["_near"].to_numpy().copy(), pdf["_bound"].to_numpy(bool)
        before, had = pdf["_had"].iloc[0], np.isfinite(nearest).any()
        limit = (balance * relevance - (1 - balance) * nearest if had else relevance)[bound]
        limit = min(zip(-limit, keys[bound]), default=None)
        chosen: list[int] = []
        while before + len(chosen) < most and len(chosen) < (~bound).sum():
            score = balance * relevance - (1 - balance) * nearest if had else relevance.copy()
            score[bound] = -np.inf
            score[chosen] = -np.inf
            best = int(np.argmax(score))
            if limit is not None and (-score[best], keys[best]) >= limit:
                break
            chosen.append(best)
            nearest = np.maximum(nearest, _dot(x, x[best]))
            if not had:
                break  # the first is taken by relevance alone, which is no bound of later scores
        return pd.DataFrame({cluster: pdf[cluster].iloc[0], "rank": range(before + 1, before + len(chosen) + 1), key: keys[chosen], "_x": list(x[chosen])})

    part = F.expr(f"int(pmod(xxhash64(`{key}`), ceil(_n / {per})))")
    members = written(rows.join(large.select(cluster, "_n"), cluster).withColumn("_part", part).drop("_n").repartition(cluster, "_part"), "members")
    chosen = written(vectors.sparkSession.createDataFrame([], f"{shape}, _x array<double>"), "chosen")
    while left:
        so_far = chosen.groupBy(cluster).agg(F.collect_list(key).alias("_keys"), F.collect_list("_x").alias("_xs"), F.count("*").cast("int").alias("_had"))
        open_ = large.join(so_far, cluster, "left").withColumns({"_keys": F.coalesce("_keys", F.array().cast(f"array<{kind[key]}>")), "_xs": F.coalesce("_xs", F.array().cast("array<array<double>>")), "_had": F.coalesce("_had", F.lit(0))})
        open_ = open_.where(F.col("_had") < F.least("_n", F.lit(most)))
        side = open_.withColumn("_part", F.explode(F.expr(f"sequence(0, int(ceil(_n / {per})) - 1)")))
        offered = members.groupBy(cluster, "_part").cogroup(side.groupBy(cluster, "_part")).applyInPandas(offers, f"{cluster} {kind[cluster]}, {key} {kind[key]}, _rel double, _near double, _x array<double>, _bound boolean")
        new = offered.join(open_.select(cluster, "_had"), cluster).groupBy(cluster).applyInPandas(advance, f"{shape}, _x array<double>")
        chosen = written(chosen.unionByName(new), "chosen")
        done = chosen.groupBy(cluster).agg(F.count("*").alias("_got"))
        left = large.join(done, cluster, "left").where(F.coalesce("_got", F.lit(0)) < F.least("_n", F.lit(most))).count()
    return small.unionByName(chosen.drop("_x"))


def unique_labels(labels: DataFrame, cluster: str = "cluster", label: str = "label") -> DataFrame:
    """Labels made unique: the second of a name becomes ``name (2)`` and so on, in order of cluster."""
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy(label).orderBy(cluster))
    return labels.withColumn("_nth", nth).withColumn(label, F.when(F.col("_nth") > 1, F.concat(F.col(label), F.lit(" ("), F.col("_nth").cast("string"), F.lit(")"))).otherwise(F.col(label))).drop("_nth")

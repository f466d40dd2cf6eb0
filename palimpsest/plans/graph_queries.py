"""Queries of networks and graphs of clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import models as M, network as G

from .registry import register
from .tables import PASSAGES_SQL, passages, table, written

EDGES = f"WITH m AS ({PASSAGES_SQL}), e AS (SELECT source_author AS source, target_author AS target, count(*) AS weight FROM m WHERE source_author <> '' AND target_author <> '' AND source_author <> target_author GROUP BY 1, 2 HAVING count(*) >= 5), "
NODES = EDGES + "n AS (SELECT node, CAST(sum(a) AS BIGINT) AS as_source, CAST(sum(b) AS BIGINT) AS as_target, CAST(sum(a + b) AS BIGINT) AS total FROM (SELECT source AS node, weight AS a, 0 AS b FROM e UNION ALL SELECT target, 0, weight FROM e) GROUP BY node) "


def _edges(spark, sf_dir):
    return G.edges(passages(spark, sf_dir), "source_author", "target_author", 5)


@register("network_edges", EDGES + "z AS (SELECT 1) SELECT source, target, weight FROM e")
def network_edges(spark, sf_dir):
    return _edges(spark, sf_dir)


@register("network_nodes", NODES + "SELECT * FROM n")
def network_nodes(spark, sf_dir):
    return G.nodes(_edges(spark, sf_dir))


@register("network_top_nodes", NODES + ", t AS (SELECT node FROM n ORDER BY total DESC, node LIMIT 10) SELECT source, target, weight FROM e WHERE source IN (SELECT node FROM t) AND target IN (SELECT node FROM t)")
def network_top_nodes(spark, sf_dir):
    return G.top(written(_edges(spark, sf_dir), "edges"), 10)[1]


@register("degree_centrality", NODES + "SELECT node, total AS degree FROM n")
def degree_centrality(spark, sf_dir):
    return G.nodes(_edges(spark, sf_dir)).select("node", F.col("total").alias("degree"))


@register("network_node_set", EDGES + "z AS (SELECT 1) SELECT source AS node FROM e UNION SELECT target FROM e")
def network_node_set(spark, sf_dir):
    e = _edges(spark, sf_dir)
    return e.select(F.col("source").alias("node")).union(e.select("target")).distinct()


@register("network_layout", NODES + ", s AS (SELECT node, total, row_number() OVER (ORDER BY node) - 1 AS k, count(*) OVER () AS c, min(total) OVER () AS a, max(total) OVER () AS b FROM n) SELECT node, round(3.0 + CASE WHEN b > a THEN (total - a) / (b - a) ELSE 0 END * 17.0, 4) AS size, round(cos(2 * pi() * k / c), 4) AS x, round(sin(2 * pi() * k / c), 4) AS y FROM s")
def network_layout(spark, sf_dir):
    shown = G.shown(written(G.nodes(_edges(spark, sf_dir)), "nodes"))
    return shown.select("node", *(F.round(c, 4).alias(c) for c in ("size", "x", "y")))


@register("edge_sizes", EDGES + "z AS (SELECT 1) SELECT source, target, round(2 * ln(weight + 1), 4) AS size FROM e")
def edge_sizes(spark, sf_dir):
    return _edges(spark, sf_dir).select("source", "target", F.round(G.edge_size(F.col("weight")), 4).alias("size"))


def _driver(spark, sf_dir, function, name):
    """A centrality over the nodes of the network that is shown, at most 10,000 of them."""
    links = G.top(written(_edges(spark, sf_dir), "edges"))[1].toPandas()
    found = function(links)
    return spark.createDataFrame([(str(k), float(v)) for k, v in found.items()], f"node string, {name} double")


@register("eigenvector_centrality")
def eigenvector_centrality(spark, sf_dir):
    return _driver(spark, sf_dir, G.eigenvector, "centrality")


@register("betweenness_centrality")
def betweenness_centrality(spark, sf_dir):
    return _driver(spark, sf_dir, G.betweenness, "centrality")


@register("network_communities")
def network_communities(spark, sf_dir):
    return _driver(spark, sf_dir, G.communities, "community")


PLACED = f"WITH m AS ({PASSAGES_SQL}), r AS (SELECT source_author, target_author, CAST(l_partkey % 12 AS BIGINT) AS cluster, l_quantity AS x, l_discount * 100 AS y FROM m), b AS (SELECT source_author AS author, cluster, x, y FROM r UNION ALL SELECT target_author, cluster, x, y FROM r), n AS (SELECT author, cluster, count(*) AS passages, avg(x) AS x, avg(y) AS y FROM b GROUP BY 1, 2 HAVING count(*) >= 5) "


def _placed(spark, sf_dir):
    return passages(spark, sf_dir).select("source_author", "target_author", (F.col("l_partkey") % 12).cast("long").alias("cluster"), F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"))


@register("semantic_graph_nodes", PLACED + "SELECT author, cluster, passages, round(x, 4) AS x, round(y, 4) AS y FROM n")
def semantic_graph_nodes(spark, sf_dir):
    return G.semantic_nodes(_placed(spark, sf_dir)).withColumns({"x": F.round("x", 4), "y": F.round("y", 4)})


@register("semantic_graph_edges", PLACED + ", k AS (SELECT cluster FROM n GROUP BY 1 HAVING count(*) > 1) SELECT author || '|' || n.cluster AS source, 'anchor|' || n.cluster AS target, CAST(1.0 AS DOUBLE) AS weight, 'intra' AS edge_type FROM n JOIN k ON n.cluster = k.cluster UNION ALL SELECT 'anchor|' || a.cluster, 'anchor|' || b.cluster, CAST(a.cluster + b.cluster AS DOUBLE) / 10 * 10, 'inter' FROM k a JOIN k b ON a.cluster < b.cluster WHERE a.cluster + b.cluster > 0")
def semantic_graph_edges(spark, sf_dir):
    nodes = written(G.semantic_nodes(_placed(spark, sf_dir)), "semantic-nodes")
    k = nodes.select("cluster").distinct()
    near = k.withColumnRenamed("cluster", "a").join(k.withColumnRenamed("cluster", "b"), F.col("a") < F.col("b")).select("a", "b", ((F.col("a") + F.col("b")).cast("double") / 10).alias("similarity"))
    return G.semantic_edges(nodes, near)


@register("cluster_sizes", "SELECT label, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM embeddings), 4) AS share FROM embeddings GROUP BY label")
def cluster_sizes(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    n = rows.count()
    return rows.groupBy("label").agg(F.count("*").alias("n")).withColumn("share", F.round(F.col("n") * 100.0 / n, 4))


@register("noise_singletons", "WITH r AS (SELECT vec_id AS id, CASE WHEN vec_id % 5 = 0 THEN -1 ELSE label END AS cluster FROM embeddings), n AS (SELECT max(cluster) + 1 AS n FROM r) SELECT id, CAST(CASE WHEN cluster >= 0 THEN cluster ELSE n + row_number() OVER (PARTITION BY cluster >= 0 ORDER BY id) - 1 END AS INTEGER) AS cluster FROM r, n")
def noise_singletons(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 5 == 0, -1).otherwise(F.col("label")).alias("cluster"))
    return G.singletons(rows)


@register("unique_labels", "WITH r AS (SELECT p_partkey AS cluster, p_name AS label FROM part), k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY cluster) AS k FROM r) SELECT cluster, label || CASE WHEN k > 1 THEN ' (' || k || ')' ELSE '' END AS label FROM k")
def unique_labels(spark, sf_dir):
    return G.unique_labels(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("cluster"), F.col("p_name").alias("label")))


@register("cluster_statistics", PLACED + "SELECT cluster, count(DISTINCT author) AS authors, CAST(sum(passages) AS BIGINT) AS passages FROM n GROUP BY cluster")
def cluster_statistics(spark, sf_dir):
    return G.semantic_nodes(_placed(spark, sf_dir)).groupBy("cluster").agg(F.countDistinct("author").alias("authors"), F.sum("passages").alias("passages"))


@register("author_ids", f"WITH m AS ({PASSAGES_SQL}) SELECT author, CAST(row_number() OVER (ORDER BY author) - 1 AS BIGINT) AS author_id FROM (SELECT source_author AS author FROM m UNION SELECT target_author FROM m)")
def author_ids(spark, sf_dir):
    from .tables import ordinal

    m = passages(spark, sf_dir)
    names = m.select(F.col("source_author").alias("author")).union(m.select("target_author")).distinct()
    return ordinal(names, F.col("author"), name="author_id").withColumn("author_id", F.col("author_id") - 1)


@register("cluster_representatives")
def cluster_representatives(spark, sf_dir):
    return G.representatives(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding")


@register("reduced_dimensions")
def reduced_dimensions(spark, sf_dir):
    return M.reduced(table(spark, sf_dir, "embeddings")).select("vec_id", "place")


@register("kmeans_clusters")
def kmeans_clusters(spark, sf_dir):
    return M.clustered(table(spark, sf_dir, "embeddings")).select("vec_id", "cluster")

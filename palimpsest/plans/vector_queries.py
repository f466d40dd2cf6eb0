"""Queries of vector-space alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest import pipeline
from palimpsest.functions import text as T
from palimpsest.operators import cleaning as X, network as G, vector_space as V

from .registry import register
from .tables import table, written

TERMS = r"WITH t AS (SELECT conv_id AS chunk_id, unnest(regexp_extract_all(lower(text), '\p{{L}}+')) AS term FROM conversations), tf AS (SELECT chunk_id, term, count(*) AS tf FROM t GROUP BY 1, 2), n AS (SELECT count(DISTINCT chunk_id) AS n FROM tf), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), i AS (SELECT term, ln((1 + n) / (1 + df)) + 1 AS idf FROM df, n WHERE df * 1.0 / n BETWEEN {low} AND {high}), r AS (SELECT chunk_id, term, tf * idf AS w FROM tf JOIN i USING (term)), l AS (SELECT chunk_id, sqrt(sum(w * w)) AS norm FROM r GROUP BY 1), v AS (SELECT chunk_id, term, w / norm AS weight FROM r JOIN l USING (chunk_id)) "
ALL, RARE = TERMS.format(low=0.0, high=1.0), TERMS.format(low=0.0, high=0.1)


def _terms(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("chunk_id"), F.explode(T.tokens(F.col("text"))).alias("term"))


@register("document_frequency_bounds", TERMS.format(low=0.05, high=0.9) + "SELECT term, round(idf, 6) AS idf FROM i")
def document_frequency_bounds(spark, sf_dir):
    tf = _terms(spark, sf_dir).distinct()
    return V.inverse_frequency(tf, "chunk_id", 0.05, 0.9).select("term", F.round("idf", 6).alias("idf"))


@register("tfidf_weights", ALL + "SELECT chunk_id, term, round(weight, 6) AS weight FROM v")
def tfidf_weights(spark, sf_dir):
    return V.tfidf(written(_terms(spark, sf_dir), "terms")).select("chunk_id", "term", F.round("weight", 6).alias("weight"))


@register("tfidf_fitted_elsewhere", r"WITH b AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS term FROM benchmark), bd AS (SELECT term, count(DISTINCT item_id) AS df FROM b GROUP BY 1), i AS (SELECT term, ln((1 + (SELECT count(DISTINCT item_id) FROM b)) / (1 + df)) + 1 AS idf FROM bd), t AS (SELECT conv_id AS chunk_id, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS term FROM conversations), tf AS (SELECT chunk_id, term, count(*) AS tf FROM t GROUP BY 1, 2), r AS (SELECT chunk_id, term, tf * idf AS w FROM tf JOIN i USING (term)), l AS (SELECT chunk_id, sqrt(sum(w * w)) AS norm FROM r GROUP BY 1) SELECT chunk_id, term, round(w / norm, 6) AS weight FROM r JOIN l USING (chunk_id)")
def tfidf_fitted_elsewhere(spark, sf_dir):
    own = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("chunk_id"), F.explode(T.tokens(F.col("text"))).alias("term")).distinct()
    fitted = V.inverse_frequency(own, "chunk_id")
    return V.tfidf(_terms(spark, sf_dir), fitted=fitted).select("chunk_id", "term", F.round("weight", 6).alias("weight"))


@register("tfidf_similarity", RARE + "SELECT x.chunk_id AS a, y.chunk_id AS b, round(sum(x.weight * y.weight), 4) AS similarity FROM v x JOIN v y ON x.term = y.term AND x.chunk_id < y.chunk_id GROUP BY 1, 2 HAVING round(sum(x.weight * y.weight), 6) >= 0.1")
def tfidf_similarity(spark, sf_dir):
    weights = written(V.tfidf(_terms(spark, sf_dir), high=0.1), "weights")
    return V.term_similarity(weights, 0.1).select("a", "b", F.round("similarity", 4).alias("similarity"))


@register("tfidf_similarity_jaccard", RARE + ", z AS (SELECT chunk_id, count(*) AS n FROM v GROUP BY 1), p AS (SELECT x.chunk_id AS a, y.chunk_id AS b, sum(x.weight * y.weight) AS s, count(*) AS c FROM v x JOIN v y ON x.term = y.term AND x.chunk_id < y.chunk_id GROUP BY 1, 2 HAVING round(s, 6) >= 0.1) SELECT a, b, c AS common FROM p JOIN z za ON a = za.chunk_id JOIN z zb ON b = zb.chunk_id WHERE c / (za.n + zb.n - c) >= 0.05")
def tfidf_similarity_jaccard(spark, sf_dir):
    weights = written(V.tfidf(_terms(spark, sf_dir), high=0.1), "weights")
    return V.term_similarity(weights, 0.1, jaccard=0.05).select("a", "b", "common")


@register("dense_similarity_search", "SELECT q.vec_id AS a, r.vec_id AS b, round(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])), 4) AS similarity FROM embeddings q JOIN embeddings r ON round(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])), 6) >= 0.3 WHERE q.vec_id % 20 = 0")
def dense_similarity_search(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return V.dense_similarity(rows.where("id % 20 = 0"), rows, 0.3).select("a", "b", F.round("similarity", 4).alias("similarity"))


@register("centroid_similarity", "WITH e AS (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings), m AS (SELECT label, pos, avg(x) AS mean FROM e GROUP BY 1, 2) SELECT x.label AS a, y.label AS b, round(sum(x.mean * y.mean) / sqrt(sum(x.mean * x.mean)) / sqrt(sum(y.mean * y.mean)), 4) AS similarity FROM m x JOIN m y ON x.pos = y.pos AND x.label < y.label GROUP BY 1, 2")
def centroid_similarity(spark, sf_dir):
    means = written(G.centroids(table(spark, sf_dir, "embeddings")), "centroids")
    return G.cluster_similarity(means).withColumn("similarity", F.round("similarity", 4))


@register("cluster_centroids", "WITH e AS (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) SELECT label, CAST(pos - 1 AS INTEGER) AS pos, round(avg(x), 6) AS mean FROM e GROUP BY 1, 2")
def cluster_centroids(spark, sf_dir):
    return G.centroids(table(spark, sf_dir, "embeddings")).withColumn("mean", F.round("mean", 6))


@register("text_chunks", r"""WITH o AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '\p{L}+') AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
s AS (SELECT conv_id, n, unnest(generate_series(0, greatest(CAST(ceil((n - 2) / 1.0) AS BIGINT), 0))) AS chunk FROM (SELECT DISTINCT conv_id, n FROM o))
SELECT s.conv_id, CAST(s.chunk AS INTEGER) AS chunk, CAST(sum(len(t)) AS BIGINT) AS n_tokens FROM s JOIN o ON o.conv_id = s.conv_id AND o.k BETWEEN s.chunk + 1 AND s.chunk + 2 GROUP BY 1, 2 HAVING sum(len(t)) >= 20""")
def text_chunks(spark, sf_dir):
    objects = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("pos"), T.tokens(F.col("text")).alias("tokens"))
    return V.chunks(objects, 2, 10, "conv_id").select("conv_id", "chunk", F.size("tokens").cast("long").alias("n_tokens"))


@register("short_objects_folded", r"""WITH o AS (SELECT conv_id, turn, len(regexp_extract_all(lower(text), '\p{L}+')) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations), i AS (SELECT *, sum(CASE WHEN n >= 30 OR k = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS island FROM o) SELECT conv_id, min(turn) AS pos, CAST(sum(n) AS BIGINT) AS n_tokens FROM i GROUP BY conv_id, island""")
def short_objects_folded(spark, sf_dir):
    objects = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("pos"), T.tokens(F.col("text")).alias("tokens"))
    return V.folded(objects, 30, "conv_id").select("conv_id", "pos", F.size("tokens").cast("long").alias("n_tokens"))


@register("sentence_neighbours", "SELECT conv_id, turn, lag(text) OVER w AS previous, lead(text) OVER w AS following FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def sentence_neighbours(spark, sf_dir):
    return V.neighbours(table(spark, sf_dir, "conversations"), "conv_id", "turn").select("conv_id", "turn", "previous", "following")


@register("sentence_expansion", "SELECT conv_id, turn, concat_ws(' ', nullif(coalesce(lag(text) OVER w, ''), ''), nullif(text, ''), nullif(coalesce(lead(text) OVER w, ''), '')) AS with_both FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def sentence_expansion(spark, sf_dir):
    return V.expansions(table(spark, sf_dir, "conversations"), "conv_id", "turn").select("conv_id", "turn", "with_both")


@register("expansion_choice", "SELECT event_id, CASE WHEN p >= 0.5 AND f >= 0.5 AND abs(p - f) < 0.001 THEN 'both' WHEN p >= 0.5 AND (f < 0.5 OR p > f) THEN 'previous' WHEN f >= 0.5 THEN 'following' ELSE 'none' END AS expand FROM (SELECT event_id, (event_id % 11) / 10.0 AS p, (event_id % 7) / 10.0 AS f FROM events)")
def expansion_choice(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.lit(0.5).alias("original"), (F.col("event_id") % 11 / 10.0).alias("previous"), (F.col("event_id") % 7 / 10.0).alias("following"))
    return V.choose_expansion(rows).select("event_id", "expand")


@register("mean_constituent_similarity", "SELECT l_orderkey AS group_id, round(avg(l_discount), 6) AS similarity FROM lineitem GROUP BY 1")
def mean_constituent_similarity(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("group_id"), F.col("l_discount").alias("similarity"))
    return V.mean_similarity(rows).withColumn("similarity", F.round("similarity", 6))


@register("token_at_byte", "WITH k AS (SELECT o_custkey AS doc_id, o_orderkey AS start FROM orders), f AS (SELECT c_custkey AS doc_id, c_custkey * 9 AS o FROM customer) SELECT f.doc_id, o AS \"offset\", coalesce(max(CASE WHEN start <= o THEN start END), min(start)) AS idx FROM f JOIN k ON f.doc_id = k.doc_id GROUP BY 1, 2")
def token_at_byte(spark, sf_dir):
    tokens = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("start"), F.col("o_orderkey").alias("idx"))
    offsets = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), (F.col("c_custkey") * 9).alias("offset"))
    return V.token_at(tokens, offsets)


@register("hashed_embeddings")
def hashed_embeddings(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.tokens(F.col("text")).alias("tokens"))
    return X.hashed_embeddings(rows, ["conv_id", "turn"])


@register("word2vec_embeddings")
def word2vec_embeddings(spark, sf_dir):
    from palimpsest.operators.models import word2vec

    return word2vec(table(spark, sf_dir, "conversations").select("conv_id", "turn", T.tokens(F.col("text")).alias("tokens")), "tokens")


@register("vector_space_alignments")
def vector_space_alignments(spark, sf_dir):
    from palimpsest.config import Config

    docs = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), "text").groupBy("doc_id").agg(F.array_join(F.collect_list("text"), " ").alias("text"))
    return pipeline.align_vectors(docs, Config(min_similarity=0.3, n_chunk=3, min_text_object_length=3, min_freq=0.0, max_freq=0.2))

"""Queries of sequence alignment and of what follows it."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest import pipeline
from palimpsest.functions import text as T
from palimpsest.operators import candidates as C, cleaning as X, grouping as G, ngrams as N
from palimpsest.operators.passages import typed

from .registry import register
from .tables import corpus, table, written
from .text_queries import GRAMS

PAIRS = GRAMS + ", u AS (SELECT DISTINCT doc_id, ngram FROM g), z AS (SELECT doc_id, count(*) AS n FROM u GROUP BY doc_id), p AS (SELECT s.doc_id AS s, t.doc_id AS t, count(*) AS shared FROM u s JOIN u t ON s.ngram = t.ngram AND s.doc_id < t.doc_id GROUP BY 1, 2 HAVING count(*) >= 4) "


def _grams(spark, sf_dir, name="documents", key="doc_id"):
    """Distinct n-grams of each row, written once: what follows reads them several times, with true sizes for its joins."""
    docs = table(spark, sf_dir, name).select(F.col(key).alias("doc_id"), "text")
    return written(N.hashed(N.tokenised(docs)), "ngrams")


def _candidates(spark, sf_dir, duplicates=False):
    return C.candidates(_grams(spark, sf_dir), duplicates=duplicates)


@register("candidate_pairs", PAIRS + "SELECT s, t, shared, round(shared * 100.0 / n, 2) AS overlap, shared * 100.0 / n > 80 AS duplicate FROM p JOIN z ON s = doc_id")
def candidate_pairs(spark, sf_dir):
    return _candidates(spark, sf_dir)


@register("duplicate_documents", PAIRS + "SELECT s, t, round(shared * 100.0 / n, 2) AS overlap FROM p JOIN z ON s = doc_id WHERE shared * 100.0 / n > 80")
def duplicate_documents(spark, sf_dir):
    return _candidates(spark, sf_dir, duplicates=True).select("s", "t", "overlap")


@register("cross_corpus_pairs", GRAMS + r", b AS (SELECT item_id, list_filter(regexp_extract_all(lower(text), '\p{L}+'), lambda w: length(w) >= 2) AS t FROM benchmark), h AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(t) - 1), lambda i: t[i] || '_' || t[i + 1] || '_' || t[i + 2])) AS ngram FROM b WHERE len(t) >= 3) SELECT doc_id AS s, item_id AS t, count(*) AS shared FROM (SELECT DISTINCT doc_id, ngram FROM g) u JOIN h ON u.ngram = h.ngram GROUP BY 1, 2 HAVING count(*) >= 4")
def cross_corpus_pairs(spark, sf_dir):
    return C.across(N.hashed(N.tokenised(table(spark, sf_dir, "documents"))), _grams(spark, sf_dir, "benchmark", "item_id")).where("shared >= 4")


@register("distinct_ngrams_per_document", GRAMS + "SELECT doc_id, count(DISTINCT ngram) AS n FROM g GROUP BY doc_id")
def distinct_ngrams_per_document(spark, sf_dir):
    return _grams(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n"))


@register("ngram_intersection_sizes", GRAMS + ", u AS (SELECT DISTINCT doc_id, ngram FROM g) SELECT a.doc_id, count(*) AS common FROM u a JOIN u b ON b.doc_id = a.doc_id + 1 AND a.ngram = b.ngram GROUP BY a.doc_id")
def ngram_intersection_sizes(spark, sf_dir):
    docs = N.tokenised(table(spark, sf_dir, "documents")).select("doc_id", T.ngrams(F.col("tokens"), 3).alias("a"))
    nxt = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b"))
    return docs.join(nxt, "doc_id").select("doc_id", F.size(F.array_intersect("a", "b")).cast("long").alias("common")).where("common > 0")


@register("alignments")
def alignments(spark, sf_dir):
    return pipeline.alignments(corpus(spark, sf_dir))


@register("alignment_rows")
def alignment_rows(spark, sf_dir):
    docs = corpus(spark, sf_dir)
    return pipeline.rows(pipeline.alignments(docs), docs)


@register("banality_frequency_flag", GRAMS + """, f AS (SELECT ngram, count(*) AS n FROM g GROUP BY ngram), r AS (SELECT ngram, row_number() OVER (ORDER BY n DESC, ngram) AS r FROM f), c AS (SELECT ngram FROM r WHERE r <= floor((SELECT count(*) FROM f) * 10.0 / 100))
SELECT doc_id, round(count(c.ngram) * 100.0 / count(*), 4) AS share, count(c.ngram) * 100.0 / count(*) >= 60 AS banality FROM g LEFT JOIN c ON g.ngram = c.ngram GROUP BY doc_id""")
def banality_frequency_flag(spark, sf_dir):
    grams = N.exploded(N.tokenised(table(spark, sf_dir, "documents")))
    common = X.most_common(written(N.frequencies(grams), "frequencies"), 10)
    return X.banality(grams, common, "doc_id", 60).withColumn("share", F.round("share", 4))


@register("top_percent_ngrams", GRAMS + ", f AS (SELECT ngram, count(*) AS n FROM g GROUP BY ngram), r AS (SELECT ngram, n, row_number() OVER (ORDER BY n DESC, ngram) AS r FROM f) SELECT ngram, n FROM r WHERE r <= floor((SELECT count(*) FROM f) * 1.0 / 100)")
def top_percent_ngrams(spark, sf_dir):
    freq = N.frequencies(N.exploded(N.tokenised(table(spark, sf_dir, "documents"))))
    return X.most_common(written(freq, "frequencies"), 1.0)


@register("phrase_filter", r"WITH c AS (SELECT doc_id, trim(regexp_replace(regexp_replace(lower(trim(text, ' ')), '[\p{P}\p{S}\p{N}]+', '', 'g'), '\p{Z}+', ' ', 'g'), ' ') AS t FROM documents) SELECT doc_id, contains(t, 'of the') OR contains(t, 'licensed under the') OR contains(t, 'de la') AS phrase_match FROM c")
def phrase_filter(spark, sf_dir):
    return X.phrase_matches(table(spark, sf_dir, "documents").select("doc_id", "text"), ["Of the", "licensed under the", "de  la!"]).drop("text")


@register("benchmark_phrases", r"WITH c AS (SELECT doc_id, trim(regexp_replace(regexp_replace(lower(trim(text, ' ')), '[\p{P}\p{S}\p{N}]+', '', 'g'), '\p{Z}+', ' ', 'g'), ' ') AS t FROM documents), b AS (SELECT trim(regexp_replace(regexp_replace(lower(trim(text, ' ')), '[\p{P}\p{S}\p{N}]+', '', 'g'), '\p{Z}+', ' ', 'g'), ' ') AS p FROM benchmark) SELECT doc_id, EXISTS (SELECT 1 FROM b WHERE contains(c.t, b.p)) AS phrase_match FROM c")
def benchmark_phrases(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = X.phrases_within(docs, table(spark, sf_dir, "benchmark").select("text")).withColumn("hit", F.lit(True))
    return docs.select("doc_id").join(hits, "doc_id", "left").select("doc_id", F.coalesce("hit", F.lit(False)).alias("phrase_match"))


@register("keep_and_banal_split", "SELECT d.doc_id, coalesce(l.toxic = 1, false) AS banal FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def keep_and_banal_split(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", (F.col("toxic") == 1).alias("banality"))
    rows = table(spark, sf_dir, "documents").select("doc_id").join(labels, "doc_id", "left")
    keep, out = X.split(rows, "banality")
    return keep.select("doc_id", F.lit(False).alias("banal")).union(out.select("doc_id", F.lit(True)))


@register("banality_rescue", "SELECT doc_id, toxic = 1 AND NOT (doc_id % 100 >= 40) AS banality, toxic = 1 AND doc_id % 100 >= 40 AS llm_rescued, CASE WHEN toxic = 1 THEN CAST(doc_id % 100 AS BIGINT) END AS formulaic_score FROM labels")
def banality_rescue(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select("doc_id", (F.col("toxic") == 1).alias("banality"), (F.col("doc_id") % 100).alias("interest"))
    return X.rescued(rows).select("doc_id", "banality", "llm_rescued", "formulaic_score")


@register("top_classes", "WITH s AS (SELECT o_custkey, o_orderpriority AS label, max(o_totalprice) / 1000000 AS score FROM orders GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY score DESC, label) AS r FROM s WHERE score >= 0.1) SELECT o_custkey, array_to_string(list(label ORDER BY r), '|') AS categories FROM r WHERE r <= 3 GROUP BY o_custkey")
def top_classes(spark, sf_dir):
    scores = table(spark, sf_dir, "orders").groupBy("o_custkey", F.col("o_orderpriority").alias("label")).agg((F.max("o_totalprice") / 1000000).alias("score"))
    return X.top_classes(scores, "o_custkey", 0.1).select("o_custkey", F.array_join("categories", "|").alias("categories"))


@register(
    "llm_scores_stub",
    r"WITH c AS (SELECT conv_id, turn, list_distinct(list_filter(string_split_regex(lower(coalesce(text, '')), '\s+'), lambda w: w <> '')) AS w FROM conversations), p AS (SELECT a.conv_id, a.turn, a.w AS x, b.w AS y FROM c a JOIN c b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1), "
    "s AS (SELECT conv_id, turn, CASE WHEN len(x) + len(y) = 0 THEN 1.0 ELSE 1.0 + round_even(4.0 * len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))), 0) END AS score FROM p) "
    "SELECT conv_id, turn, CAST(score AS DOUBLE) AS llm_similarity, CASE CAST(score AS INTEGER) WHEN 1 THEN 'Unrelated' WHEN 2 THEN 'Neutral' WHEN 3 THEN 'Disagree' ELSE 'Agree' END AS llm_stance FROM s",
)
def llm_scores_stub(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("source_passage"))
    other = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("source_passage").alias("target_passage"))
    return X.scored(c.join(other, ["conv_id", "turn"])).select("conv_id", "turn", "llm_similarity", "llm_stance")


@register("llm_filter", "SELECT doc_id, CAST(quality AS DOUBLE) * 5 AS similarity FROM labels WHERE quality * 5 >= 3")
def llm_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select("doc_id", F.lit(0.5).alias("similarity"), (F.col("quality") * 5).cast("double").alias("llm_similarity"))
    return X.filtered_by_score(rows).select("doc_id", "similarity")


# Intervals for the range operators: each line item covers some bytes of its supplier's document.
SPANS_SQL = "SELECT row_number() OVER (ORDER BY l_suppkey, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate, l_quantity) AS id, l_suppkey AS file, l_orderkey AS a, l_orderkey + CAST(l_quantity AS BIGINT) AS b FROM lineitem"


def _spans(spark, sf_dir):
    from .tables import ordinal, partitions

    names = ["l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate", "l_quantity"]
    items = table(spark, sf_dir, "lineitem").select(*names)
    rows = ordinal(items, *map(F.col, names), name="id", parts=partitions(items))
    return rows.select("id", F.col("l_suppkey").alias("file"), F.col("l_orderkey").alias("start"), (F.col("l_orderkey") + F.col("l_quantity").cast("long")).alias("end"))


@register("interval_merge_islands", f"WITH s AS ({SPANS_SQL}), w AS (SELECT *, max(b) OVER (PARTITION BY file ORDER BY a, b DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM s), i AS (SELECT *, sum(CASE WHEN m IS NULL OR a > m THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY a, b DESC ROWS UNBOUNDED PRECEDING) AS island FROM w) SELECT file, min(a) AS start, max(b) AS \"end\", count(*) AS n FROM i GROUP BY file, island")
def interval_merge_islands(spark, sf_dir):
    return G.merged_intervals(_spans(spark, sf_dir), "file", "start", "end").drop("island")


@register("group_overlap_join", f"WITH s AS ({SPANS_SQL}), g AS (SELECT file, (a // 500) AS k, min(a) AS ga, min(a) + 60 AS gb, min(id) AS group_id FROM s GROUP BY file, a // 500) SELECT s.id, count(g.group_id) AS n, CAST(coalesce(sum(g.group_id), 0) AS BIGINT) AS total FROM s LEFT JOIN g ON s.file = g.file AND s.a < g.gb AND s.b > g.ga GROUP BY s.id")
def group_overlap_join(spark, sf_dir):
    spans = written(_spans(spark, sf_dir), "spans")
    groups = spans.groupBy("file", F.floor(F.col("start") / 500).alias("k")).agg(F.min("start").alias("start"), (F.min("start") + 60).alias("end"), F.min("id").alias("group_id"))
    found = G.memberships(spans, groups)
    return found.select("id", F.size("group_ids").cast("long").alias("n"), F.aggregate("group_ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@register("group_counts", f"WITH s AS ({SPANS_SQL}), g AS (SELECT file, (a // 500) AS k, min(a) AS ga, min(a) + 60 AS gb, min(id) AS group_id FROM s GROUP BY file, a // 500) SELECT g.group_id, count(*) AS n FROM s JOIN g ON s.file = g.file AND s.a < g.gb AND s.b > g.ga GROUP BY g.group_id")
def group_counts(spark, sf_dir):
    spans = written(_spans(spark, sf_dir), "spans")
    groups = spans.groupBy("file", F.floor(F.col("start") / 500).alias("k")).agg(F.min("start").alias("start"), (F.min("start") + 60).alias("end"), F.min("id").alias("group_id"))
    return G.memberships(spans, groups).select(F.explode("group_ids").alias("group_id")).groupBy("group_id").agg(F.count("*").alias("n"))


@register("initial_passage_groups")
def initial_passage_groups(spark, sf_dir):
    found = pipeline.alignments(corpus(spark, sf_dir))
    rows = found.withColumn("id", F.xxhash64("s", "t", "s_start", "s_end", "t_start", "t_end"))
    return G.initial_groups(written(rows.select("id", F.col("s").alias("s_file"), "s_start", "s_end", F.col("t").alias("t_file"), "t_start", "t_end"), "alignments"))


@register("strict_passage_groups")
def strict_passage_groups(spark, sf_dir):
    return G.strict_groups(_spans(spark, sf_dir).select(F.col("file").alias("group"), "file", "id", "start", "end"))


@register("typed_columns", "SELECT page_id, replace(replace(regexp_replace(url, '[\\x00-\\x1f]', '', 'g'), '<', '&lt;'), '>', '&gt;') AS url, try_cast(nullif(regexp_extract(url, '([0-9]+)', 1), '') AS INTEGER) AS year FROM pages")
def typed_columns(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", "url", F.col("url").alias("year"))
    return typed(rows, {"page_id": "INTEGER", "year": "INTEGER"}).withColumn("page_id", F.col("page_id").cast("long"))


@register("metadata_join", "SELECT o_orderkey, c_name AS source_author, c_mktsegment AS source_class, n_name AS target_author FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def metadata_join(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("source_author"), F.col("c_mktsegment").alias("source_class"), F.col("c_nationkey").alias("n_nationkey"))
    return table(spark, sf_dir, "orders").join(c, "o_custkey").join(table(spark, sf_dir, "nation"), "n_nationkey").select("o_orderkey", "source_author", "source_class", F.col("n_name").alias("target_author"))

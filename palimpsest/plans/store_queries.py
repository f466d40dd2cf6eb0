"""Queries of the alignment store, over line items as a stand-in for alignments."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.operators.passages import class_columns
from palimpsest.operators.store import LENGTH_BINS, AlignmentStore, Search

from .registry import register
from .tables import PASSAGES_SQL, ordinal, passages, table

ORDER = ["source_year", "target_year", "source_start_byte", "target_start_byte", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
#: SQL for the main table with its ordinal, and without.
MAIN = f"WITH p AS ({PASSAGES_SQL}), m AS (SELECT *, row_number() OVER (ORDER BY {', '.join(c + ' NULLS LAST' for c in ORDER)}) AS rowid FROM p) "
PLAIN = f"WITH m AS ({PASSAGES_SQL}) "


def _plain(spark, sf_dir):
    return AlignmentStore(passages(spark, sf_dir))


def _main(spark, sf_dir):
    rows = passages(spark, sf_dir)
    return AlignmentStore(ordinal(rows, *(F.col(c).asc_nulls_last() for c in ORDER)))


@register("ordered_table", MAIN + "SELECT rowid, source_year, target_year, source_start_byte, target_start_byte FROM m")
def ordered_table(spark, sf_dir):
    return _main(spark, sf_dir).main.select("rowid", "source_year", "target_year", "source_start_byte", "target_start_byte")


@register("keyset_page_next", MAIN + "SELECT rowid, source_author, target_author, source_year FROM m WHERE source_author = 'NATION_3' AND rowid > 500 ORDER BY rowid LIMIT 50")
def keyset_page_next(spark, sf_dir):
    return _main(spark, sf_dir).page(Search({"source_author": '"NATION_3"'}, anchor=500)).select("rowid", "source_author", "target_author", "source_year")


@register("keyset_page_prev", MAIN + "SELECT * FROM (SELECT rowid, source_year, target_year FROM m WHERE source_year BETWEEN 1996 AND 1998 AND rowid < 40000 ORDER BY rowid DESC LIMIT 50) ORDER BY rowid")
def keyset_page_prev(spark, sf_dir):
    return _main(spark, sf_dir).page(Search({"source_year": "1996-1998"}, anchor=40000, direction="prev")).select("rowid", "source_year", "target_year")


@register("edge_details_page", MAIN + "SELECT rowid, source_author, target_author FROM m WHERE target_author = 'NATION_5' ORDER BY rowid LIMIT 50 OFFSET 100")
def edge_details_page(spark, sf_dir):
    return _main(spark, sf_dir).offset_page(Search({"target_author": '"NATION_5"'}, page=3)).select("rowid", "source_author", "target_author")


@register("count_results", PLAIN + "SELECT count(*) AS count FROM m WHERE source_year >= 1998 AND l_returnflag = 'R'")
def count_results(spark, sf_dir):
    return _plain(spark, sf_dir).count(Search({"source_year": "1998-", "l_returnflag": '"R"'}))


@register("word_match_filter", "SELECT doc_id FROM documents WHERE list_contains(string_split_regex(lower(text), '[^a-z0-9_À-ÿ]+'), 'stupid') AND list_contains(string_split_regex(lower(text), '[^a-z0-9_À-ÿ]+'), 'the')")
def word_match_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(T.word_match(F.col("text"), "Stupid the")).select("doc_id")


@register("not_filter", "SELECT p_partkey FROM part WHERE regexp_matches(p_name, '(?i)\\bred\\b') AND NOT regexp_matches(p_name, '(?i)\\bwidget\\b')")
def not_filter(spark, sf_dir):
    return table(spark, sf_dir, "part").where(T.word_match(F.col("p_name"), "Red NOT widget")).select("p_partkey")


@register("or_filter", "SELECT p_partkey FROM part WHERE regexp_matches(p_name, '(?i)\\b(red|blue)\\b')")
def or_filter(spark, sf_dir):
    return table(spark, sf_dir, "part").where(T.word_match(F.col("p_name"), "red OR blue")).select("p_partkey")


@register("empty_text_filter", "SELECT event_id FROM events WHERE (CASE WHEN event_type = 'click' THEN '' ELSE event_type END) = ''")
def empty_text_filter(spark, sf_dir):
    kind = F.when(F.col("event_type") == "click", "").otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").where(T.word_match(kind, '""')).select("event_id")


@register("exact_filter", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def exact_filter(spark, sf_dir):
    return table(spark, sf_dir, "customer").where(T.word_match(F.col("c_mktsegment"), '"BUILDING"')).select("c_custkey")


@register("year_range_filter", PLAIN + "SELECT source_year, count(*) AS n FROM m WHERE source_year BETWEEN 1996 AND 1999 AND target_year >= 1998 GROUP BY source_year")
def year_range_filter(spark, sf_dir):
    return _plain(spark, sf_dir).where(Search({"source_year": "1996-1999", "target_year": "1998-"})).groupBy("source_year").agg(F.count("*").alias("n"))


@register("number_filter", "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_discount BETWEEN 0.02 AND 0.05 AND l_quantity <= 10 GROUP BY 1")
def number_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return rows.where(T.number_match(F.col("l_discount"), "0.02-0.05") & T.number_match(F.col("l_quantity"), "-10")).groupBy("l_returnflag").agg(F.count("*").alias("n"))


@register("class_filter", PLAIN + "SELECT source_author, count(*) AS n FROM m WHERE (first_class = 'BUILDING' OR second_class = 'BUILDING') AND (first_class = 'F' OR second_class = 'F') GROUP BY 1")
def class_filter(spark, sf_dir):
    return _plain(spark, sf_dir).where(Search(classes=("BUILDING", "F"))).groupBy("source_author").agg(F.count("*").alias("n"))


@register("class_split", "SELECT o_orderkey, split_part(o_orderpriority, '-', 1) AS first_class, split_part(o_orderpriority, '-', 2) AS second_class, split_part(o_orderpriority, '-', 3) AS third_class FROM orders")
def class_split(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.split("o_orderpriority", "-").alias("passage_categories"))
    return class_columns(rows).drop("passage_categories")


@register("same_node_filter", PLAIN + "SELECT source_author, target_author, count(*) AS n FROM m WHERE source_author = 'NATION_7' OR target_author = 'NATION_7' GROUP BY 1, 2")
def same_node_filter(spark, sf_dir):
    rows = _plain(spark, sf_dir).main
    return rows.where((F.col("source_author") == "NATION_7") | (F.col("target_author") == "NATION_7")).groupBy("source_author", "target_author").agg(F.count("*").alias("n"))


@register("banality_filter", "SELECT doc_id FROM labels WHERE quality = 0 AND toxic = 0")
def banality_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select("doc_id", "toxic", (F.col("quality") == 0).alias("banality"))
    return AlignmentStore(rows).where(Search({"toxic": "0"}, banality=True)).select("doc_id")


@register("facet_counts", PLAIN + "SELECT source_author AS facet, count(*) AS count FROM m WHERE target_year >= 1995 GROUP BY 1")
def facet_counts(spark, sf_dir):
    return _plain(spark, sf_dir).facet(Search({"target_year": "1995-"}), "source_author")


BINS = "CASE " + " ".join(f"WHEN {{0}} >= {a}" + (f" AND {{0}} <= {b}" if b else "") + f" THEN '{a}-{b or ''}'" for a, b in LENGTH_BINS) + " END"


@register("facet_length_bins", PLAIN + f"SELECT {BINS.format('source_passage_length')} AS facet, count(*) AS count FROM m WHERE source_passage_length >= 1 GROUP BY 1")
def facet_length_bins(spark, sf_dir):
    return _plain(spark, sf_dir).length_facet(Search(), "source_passage_length")


@register("passage_length_histogram", r"WITH d AS (SELECT len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS n FROM documents) SELECT " + BINS.format("n") + " AS facet, count(*) AS count FROM d WHERE n >= 1 GROUP BY 1")
def passage_length_histogram(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(T.passage_length(F.col("text")).alias("source_passage_length"))
    return AlignmentStore(rows).length_facet(Search(), "source_passage_length")


@register("time_series", PLAIN + "SELECT CAST((source_year // 10) * 10 AS INTEGER) AS year, count(*) AS count FROM m GROUP BY 1")
def time_series(spark, sf_dir):
    return _plain(spark, sf_dir).time_series(Search(interval=10), dense=False)


@register("time_series_densified", "WITH c AS (SELECT CAST((y // 10) * 10 AS INTEGER) AS year, count(*) AS count FROM (SELECT CAST(1600 + o_custkey * 37 % 900 AS INTEGER) AS y FROM orders WHERE o_totalprice > 100000) GROUP BY 1) SELECT CAST(d AS INTEGER) AS year, coalesce(count, 0) AS count FROM (SELECT unnest(generate_series((SELECT min(year) FROM c), (SELECT max(year) FROM c), 10)) AS d) LEFT JOIN c ON d = year")
def time_series_densified(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").where("o_totalprice > 100000").select((1600 + F.col("o_custkey") * 37 % 900).cast("int").alias("source_year"))
    return AlignmentStore(rows).time_series(Search(interval=10))


@register("docs_with_counts", MAIN + "SELECT source_doc_id, count(*) AS count, arg_min(source_author, rowid) AS source_author, arg_min(source_year, rowid) AS source_year FROM m WHERE target_author = 'NATION_2' GROUP BY 1")
def docs_with_counts(spark, sf_dir):
    return _main(spark, sf_dir).documents(Search({"target_author": '"NATION_2"'}), "source", ["source_author", "source_year"])


@register("passage_pairs_projection", PLAIN + "SELECT source_doc_id, target_doc_id, source_year, target_year, source_start_byte, target_start_byte FROM m WHERE l_returnflag = 'A' AND l_linestatus = 'F' AND source_year = 1997")
def passage_pairs_projection(spark, sf_dir):
    return _plain(spark, sf_dir).pairs(Search({"l_returnflag": '"A"', "l_linestatus": '"F"', "source_year": "1997"})).select("source_doc_id", "target_doc_id", "source_year", "target_year", "source_start_byte", "target_start_byte")


@register("containment_filter", PLAIN + "SELECT source_start_byte, source_end_byte, target_author FROM m WHERE source_author = 'NATION_4' AND source_start_byte >= 100000 AND source_end_byte <= 400000")
def containment_filter(spark, sf_dir):
    store = AlignmentStore(_plain(spark, sf_dir).main.withColumn("source_filename", F.col("source_author")))
    return store.within("NATION_4", 100000, 400000).select("source_start_byte", "source_end_byte", "target_author")


GROUPED = MAIN + ", e AS (SELECT rowid, source_doc_id, unnest([l_partkey % 97, 1000 + l_suppkey % 13]) AS group_id FROM m), d AS (SELECT group_id, min(source_doc_id) AS source_doc_id FROM e GROUP BY group_id) "


def _grouped(spark, sf_dir):
    main = _main(spark, sf_dir).main.withColumn("group_id", F.array((F.col("l_partkey") % 97).cast("int"), (1000 + F.col("l_suppkey") % 13).cast("int")))
    groups = main.select(F.explode("group_id").alias("group_id"), "source_doc_id").groupBy("group_id").agg(F.min("source_doc_id").alias("source_doc_id"))
    return AlignmentStore(main, groups)


@register("top_groups", GROUPED + "SELECT CAST(e.group_id AS INTEGER) AS group_id, count(*) AS count FROM e JOIN d ON e.group_id = d.group_id AND e.source_doc_id = d.source_doc_id WHERE e.group_id IN (SELECT e2.group_id FROM e e2 JOIN m ON m.rowid = e2.rowid WHERE m.l_returnflag = 'R') GROUP BY 1 ORDER BY count DESC, group_id LIMIT 100")
def top_groups(spark, sf_dir):
    return _grouped(spark, sf_dir).sorted_groups(Search({"l_returnflag": '"R"'}))


@register("array_group_containment", GROUPED + "SELECT m.rowid, m.target_title FROM e JOIN m ON e.rowid = m.rowid WHERE e.group_id = 42")
def array_group_containment(spark, sf_dir):
    return _grouped(spark, sf_dir).where(Search(group=42)).select("rowid", "target_title")


@register("group_members_by_year", GROUPED + "SELECT target_year AS year, array_to_string(list(target_title || ':' || target_start_byte ORDER BY target_title DESC, target_start_byte DESC, m.rowid DESC), ',') AS passages FROM e JOIN m ON e.rowid = m.rowid JOIN d ON e.group_id = d.group_id AND m.source_doc_id = d.source_doc_id WHERE e.group_id = 1003 GROUP BY target_year")
def group_members_by_year(spark, sf_dir):
    found = _grouped(spark, sf_dir).group(1003)
    return found.select("year", F.array_join(F.transform("passages", lambda p: F.concat_ws(":", p["target_title"], p["target_start_byte"])), ",").alias("passages"))


@register("db_stats", PLAIN + "SELECT count(*) AS pairs, count(DISTINCT source_author) AS authors, count(DISTINCT source_title) AS titles FROM m")
def db_stats(spark, sf_dir):
    return _plain(spark, sf_dir).statistics()


@register("column_types", f"SELECT column_name AS name, CASE column_type WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' ELSE lower(column_type) END AS type FROM (DESCRIBE {PASSAGES_SQL})")
def column_types(spark, sf_dir):
    return spark.createDataFrame(list(_plain(spark, sf_dir).types().items()), "name string, type string")


@register("event_windows", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    from palimpsest.streaming.ingest import windowed_counts

    return windowed_counts(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


@register("event_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS f FROM events), s AS (SELECT user_id, ts, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '30 minutes' AS \"end\", count(*) AS n FROM s GROUP BY user_id, k")
def event_sessions(spark, sf_dir):
    from palimpsest.streaming.ingest import sessions

    return sessions(table(spark, sf_dir, "events"))

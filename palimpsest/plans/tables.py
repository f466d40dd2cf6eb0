"""Test tables in the shape of a text-reuse corpus, and tables written where executors share them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

CORPUS_SQL = "SELECT doc_id, text, source AS author, 'doc_' || doc_id AS title, CAST(1600 + doc_id % 300 AS INTEGER) AS year, lang FROM documents"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with author, title, year and lang."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", "text", F.col("source").alias("author"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("title"), (1600 + F.col("doc_id") % 300).cast("int").alias("year"), "lang")


#: The stand-in for an alignment table: one row per line item.
PASSAGES_SQL = """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus,
       sn.n_name AS source_author, tn.n_name AS target_author, p_name AS target_title, o_orderpriority AS source_title,
       CAST(year(o_orderdate) AS INTEGER) AS source_year, CAST(year(l_shipdate) AS INTEGER) AS target_year,
       o_custkey AS source_doc_id, l_suppkey AS target_doc_id, c_mktsegment AS first_class, o_orderstatus AS second_class,
       CAST(l_quantity * 10 AS INTEGER) AS source_passage_length, l_orderkey * 100 AS source_start_byte,
       l_orderkey * 100 + CAST(l_quantity * 10 AS BIGINT) AS source_end_byte, l_partkey * 100 AS target_start_byte
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation sn ON c_nationkey = sn.n_nationkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation tn ON s_nationkey = tn.n_nationkey
JOIN part ON l_partkey = p_partkey
"""


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    for name in ("lineitem", "orders", "customer", "nation", "supplier", "part"):
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(PASSAGES_SQL)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a temporary folder on a local master where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="palimpsest-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again; its lineage ends there."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a partition that is sorted as a whole, on average.
SORTED_ROWS = 250_000


def partitions(df: DataFrame) -> int:
    """As many partitions as a shuffle has, or more, so that none has over SORTED_ROWS rows on average; df is counted for it."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // SORTED_ROWS))


def ordinal(df: DataFrame, *order: Column, name: str = "rowid", parts: int | None = None) -> DataFrame:
    """df with a dense number from 1 in the given order, without bringing all rows into one task.

    Rows are partitioned by range and sorted, in as many parts as are asked for or a shuffle has; a partition's numbers
    begin where the one before ends. Only the partitions' counts are gathered. The order must be total but for equal rows.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    kept = written(sorted_, "ordered")
    part = F.shiftright("_at", 33)
    counts = sorted(kept.groupBy(part.alias("p")).count().collect())
    begins, total = [], 0
    for r in counts:
        begins.append((r["p"], total))
        total += r["count"]
    begin = F.broadcast(df.sparkSession.createDataFrame(begins, "_p long, _begin long"))  # a row per partition
    return kept.withColumn("_p", part).join(begin, "_p").withColumn(name, F.col("_begin") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("_p", "_at", "_begin")

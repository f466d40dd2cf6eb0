"""Where results go: tables, JSON lines, duplicates as CSV, run manifests, whole databases."""

from __future__ import annotations

import json
import shutil
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from palimpsest.plans.tables import ordinal


def write_alignments(rows: DataFrame, path: str, format: str = "parquet", buckets: int | None = None) -> None:
    """Alignment rows as Parquet or JSON lines, by source document if buckets are asked for."""
    out = rows.repartition(buckets, "source_doc_id") if buckets else rows
    out.write.mode("overwrite").format(format).save(path)


def read_alignments(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    return spark.read.format(format).load(path)


def write_duplicates(pairs: DataFrame, docs: DataFrame, path: str) -> None:
    """Pairs flagged as duplicates, with both documents' titles and authors, as CSV with a header."""
    s = docs.select(F.col("doc_id").alias("s"), F.col("title").alias("source_title"), F.col("author").alias("source_author"))
    t = docs.select(F.col("doc_id").alias("t"), F.col("title").alias("target_title"), F.col("author").alias("target_author"))
    rows = pairs.where("duplicate").join(s, "s").join(t, "t").select("source_title", "source_author", "s", "target_title", "target_author", "t", F.format_string("%.2f", "overlap").alias("overlap"))
    rows.write.mode("overwrite").csv(path, header=True)


def write_index(postings: DataFrame, frequencies: DataFrame, documents: DataFrame, path: str) -> None:
    """Postings, n-gram frequencies and document metadata as three tables."""
    postings.write.mode("overwrite").parquet(f"{path}/postings")
    frequencies.write.mode("overwrite").parquet(f"{path}/ngram_freq")
    documents.write.mode("overwrite").parquet(f"{path}/doc_meta")


def load(rows: DataFrame, name: str) -> DataFrame:
    """The main table of a store, saved under a name, with its ordinal by years and offsets (missing years last)."""
    order = [F.col(c).asc_nulls_last() for c in ("source_year", "target_year", "source_start_byte", "target_start_byte")]
    rest = [F.col(c) for c, kind in rows.dtypes if not kind.startswith(("map", "array", "struct")) and c not in ("source_year", "target_year", "source_start_byte", "target_start_byte")]
    ordinal(rows, *order, *rest).write.mode("overwrite").saveAsTable(name)
    return rows.sparkSession.table(name)


def drop(spark: SparkSession, name: str) -> None:
    for table in (name, f"{name}_groups"):
        spark.sql(f"DROP TABLE IF EXISTS {table}")


def databases(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables())


def manifest(path: str, config: dict, counts: dict[str, int]) -> None:
    """What a run was asked and how much it found, as JSON beside its tables."""
    Path(path).mkdir(parents=True, exist_ok=True)
    Path(path, "manifest.json").write_text(json.dumps({"config": config, "counts": counts}, indent=1, sort_keys=True))


def is_current(path: str, count: int) -> bool:
    """Whether a manifest says that what lies beside it was made of as many rows."""
    file = Path(path, "manifest.json")
    return file.exists() and json.loads(file.read_text())["counts"].get("rows") == count


def back_up(path: str, to: str) -> str:
    """A database folder as one archive."""
    return shutil.make_archive(to, "gztar", path)


def restore(archive: str, to: str) -> None:
    shutil.unpack_archive(archive, to, "gztar", filter="data")


def copy_table(spark: SparkSession, path: str, to: str) -> None:
    """A table copied in the files' own format, on whatever storage both paths name."""
    spark.read.parquet(path).write.mode("overwrite").parquet(to)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes (author, cluster, ...) and edges of a graph, and its authors with their numbers in order of name, as three tables."""
    authors = ordinal(nodes.select("author").distinct(), F.col("author"), name="author_id").withColumn("author_id", F.col("author_id") - 1)
    authors.write.mode("overwrite").parquet(f"{path}/authors")
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")

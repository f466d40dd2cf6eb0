"""Command line: align the documents of a folder of texts or a Parquet table."""

from __future__ import annotations

import argparse
from dataclasses import asdict

from pyspark.sql import SparkSession, functions as F

from palimpsest import pipeline
from palimpsest.config import Config, from_ini
from palimpsest.sources import corpus, sinks


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="palimpsest", description=__doc__)
    parser.add_argument("source", help="folder of plain texts (.txt) or TEI (.xml), or a Parquet table with doc_id and text")
    parser.add_argument("output", help="folder for the result")
    parser.add_argument("--config", help="INI file")
    parser.add_argument("--format", choices=("parquet", "json"), default="parquet")
    args = parser.parse_args(argv)
    config = from_ini(args.config) if args.config else Config()
    spark = SparkSession.builder.appName("palimpsest").getOrCreate()
    if args.source.endswith(".parquet"):
        docs = spark.read.parquet(args.source)
    else:
        docs = corpus.tei(spark, args.source) if config.source_text_object_type == "tei" else corpus.plain(spark, args.source)
        docs = docs.withColumn("doc_id", F.xxhash64("filename"))
    if "year" not in docs.columns:
        docs = docs.withColumn("year", F.lit(None).cast("int"))
    if config.matching_algorithm == "vsa":
        found = pipeline.align_vectors(docs, config)
    else:
        aligned, duplicates = pipeline.align(docs, config)
        duplicates.write.mode("overwrite").csv(f"{args.output}/duplicates", header=True)
        found = pipeline.rows(aligned, docs, config)
    sinks.write_alignments(found, f"{args.output}/alignments", args.format)
    n = sinks.read_alignments(spark, f"{args.output}/alignments", args.format).count()
    sinks.manifest(args.output, asdict(config), {"rows": n})


if __name__ == "__main__":
    main()

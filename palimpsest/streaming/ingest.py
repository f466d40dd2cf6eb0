"""New documents against a corpus as they arrive, and counts over streams of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from palimpsest.operators import ngrams as N


def new_documents(spark: SparkSession, path: str, schema: str = "doc_id long, text string") -> DataFrame:
    """A stream of documents from Parquet files that come into a folder."""
    return spark.readStream.schema(schema).parquet(path)


def candidate_stream(docs: DataFrame, grams: DataFrame, n: int = 3) -> DataFrame:
    """(s, t, ngram): a stream of documents joined with the n-grams (doc_id, ngram) of a corpus, for append mode.

    Counting is left to the sink (see write_candidates), so that the stream needs no state.
    """
    fresh = N.hashed(N.tokenised(docs), n).withColumnRenamed("doc_id", "t")
    return fresh.join(grams.withColumnRenamed("doc_id", "s"), "ngram").where("s <> t").select("s", "t", "ngram")


def write_candidates(stream: DataFrame, path: str, checkpoint: str, least: int = 4):
    """Write pairs with enough shared n-grams of each batch. A document's n-grams all come in one batch."""

    def save(batch: DataFrame, number: int) -> None:
        batch.groupBy("s", "t").agg(F.count("*").alias("shared")).where(F.col("shared") >= least).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def watermarked(events: DataFrame, late: str) -> DataFrame:
    """A stream with a watermark on ts, which needs a timestamp with a time zone; a table as it is."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """Counts and sums by type and window of event time; a stream drops what comes later than ``late``."""
    marked = watermarked(events, late)
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return marked.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """A user's sessions: events no more than a gap apart."""
    marked = watermarked(events, late)
    return marked.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")

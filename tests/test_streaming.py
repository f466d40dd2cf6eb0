from pyspark.sql import functions as F

from palimpsest.operators import ngrams as N
from palimpsest.streaming import ingest


def test_new_documents_meet_the_corpus(spark, tmp_path):
    text = "alpha beta gamma delta epsilon zeta eta theta"
    old = spark.createDataFrame([(1, text), (2, "quite other words are here in this one text")], "doc_id long, text string")
    grams = N.hashed(N.tokenised(old))
    spark.createDataFrame([(10, "so " + text), (11, "no match at all here")], old.schema).write.parquet(str(tmp_path / "in"))
    stream = ingest.candidate_stream(ingest.new_documents(spark, str(tmp_path / "in")), grams)
    ingest.write_candidates(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert [(r["s"], r["t"], r["shared"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(1, 10, 6)]


def test_windows_of_a_stream_equal_those_of_a_table(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    stream = ingest.windowed_counts(spark.readStream.schema(events.schema).parquet("/root/testdata/sf0.001/events*.parquet"), late="3650 days")
    query = stream.writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted(map(str, spark.table("windows").withColumn("total", F.round("total", 6)).collect()))
    assert got == sorted(map(str, ingest.windowed_counts(events).withColumn("total", F.round("total", 6)).collect()))

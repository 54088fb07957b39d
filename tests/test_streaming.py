"""Streams against the same counts in one batch."""

from pyspark.sql import functions as F

from lamina.streaming import markers


def test_counts_of_windows_equal_the_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("category"))
    events.repartitionByRange(4, "ts").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, category string").parquet(str(tmp_path / "in"))
    found = markers.counts_by_window(stream, "1 day", "400 days")
    run = found.writeStream.format("memory").queryName("markers").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination()
    want = events.groupBy(F.window("ts", "1 day").alias("w"), "category").count().select("w.start", "category", "count")
    assert sorted(map(tuple, spark.table("markers").collect())) == sorted(map(tuple, want.collect()))

"""Streams give the rows of the batch."""

from pyspark.sql import functions as F

from siltstone import catalog
from siltstone.streaming import incremental


def drain(stream, spark, name, mode="append"):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_scan_stream(spark, tmp_path):
    rows = [("a", "password: 'hunter22'", "2024-01-01 00:00:00"), ("a", "password: 'hunter22'", "2024-01-01 01:00:00"), ("b", "none", "2024-01-01 02:00:00")]
    spark.createDataFrame(rows, "path string, content string, t string").select("path", "content", F.to_timestamp("t").alias("seen_at")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("path string, content string, seen_at timestamp").parquet(str(tmp_path / "in"))
    got = drain(incremental.scan_new_files(stream, catalog.rule(5001)), spark, "scan")
    assert [r.path for r in got.collect()] == ["a"]


def test_windows(spark, tmp_path):
    events = spark.createDataFrame([(f"2024-01-01 00:{m:02d}:00", 1, "click", 1.0) for m in (0, 10, 50)] + [("2024-01-02 05:00:00", 1, "click", 1.0)], "t string, user_id long, event_type string, value double")
    events = events.select(F.to_timestamp("t").alias("ts"), "user_id", "event_type", "value")
    assert sorted(r.n for r in incremental.tumbling(events).collect()) == [1, 3]
    assert sorted(r.n for r in incremental.sessions(events).collect()) == [1, 1, 2]
    assert sum(r.n for r in incremental.sliding(events).collect()) == 8
    events.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    got = drain(incremental.tumbling(stream), spark, "tumbled")
    assert [r.n for r in got.collect()] == [3]


def test_merge_sink(spark):
    spark.sql("drop table if exists findings_sink")
    sink = incremental.merge_into("findings_sink")
    batch = spark.createDataFrame([("h1", "a"), ("h1", "a"), ("h2", "b")], "vul_hash string, path string")
    sink(batch, 0)
    sink(batch.union(spark.createDataFrame([("h3", "c")], batch.schema)), 1)
    assert sorted(r.vul_hash for r in spark.table("findings_sink").collect()) == ["h1", "h2", "h3"]
    spark.sql("drop table findings_sink")

"""Incremental scanning and event windows with Structured Streaming (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.matching import match_and_not


def scan_new_files(files: DataFrame, rule: dict) -> DataFrame:
    """Findings of a stream of files(path, content, seen_at) for one only-regex rule; a finding that returns within a day is dropped."""
    stamped = files.withWatermark("seen_at", "1 day")
    found = match_and_not(stamped, rule["match"], rule["unmatch"])
    return (found.withColumn("svid", F.lit(rule["svid"])).withColumn("vul_hash", F.md5(F.concat_ws(",", F.lit(str(rule["svid"])), "path", "text").cast("binary")))
            .dropDuplicatesWithinWatermark(["vul_hash"]))


def merge_into(table: str):
    """A foreachBatch sink: rows whose hash the table has not are appended."""
    def run(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(["vul_hash"])
        if spark.catalog.tableExists(table):
            fresh = fresh.join(spark.table(table).select("vul_hash"), "vul_hash", "left_anti").select(*spark.table(table).columns)
        fresh.write.mode("append").saveAsTable(table)

    return run


def tumbling(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    stamped = events.withWatermark("ts", late) if events.isStreaming else events
    out = stamped.groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, length: str = "2 hours", step: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    stamped = events.withWatermark("ts", late) if events.isStreaming else events
    return stamped.groupBy(F.window("ts", length, step)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    stamped = events.withWatermark("ts", late) if events.isStreaming else events
    return stamped.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")

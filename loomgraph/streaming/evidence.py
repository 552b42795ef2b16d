"""Streams over evidence: incremental ingest, trends by window with late entries, and cooldowns. An extension of the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def incoming(spark: SparkSession, path: str, schema, files_a_trigger: int = 100) -> DataFrame:
    """Files as they arrive; the checkpoint of the query that reads them is the memory of what was read."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(path)


def windowed_trend(events: DataFrame, every: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts and sums by kind and window; a window closes once the watermark has passed it."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("w.start", "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "uid").agg(F.count("*").alias("n")).select("uid", "w.start", "w.end", "n")


def once_each(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Entries without those that came twice within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def append_log(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends to the evidence log by month, exactly once (file sink with a checkpoint), for what is there now."""
    return events.withColumn("month", F.date_format("ts", "yyyy-MM")).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("month").trigger(availableNow=True).start()

"""Incremental ingest of article files: a file stream whose checkpoint is the memory of what was read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.sources import files


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key."""
    last = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]))
    return rows.withColumn("__last", last).where("__last = 1").drop("__last")


def ingest(spark: SparkSession, folder: str, into: str, state: str, files_a_batch: int = 1000, after: Callable[[int], None] | None = None) -> int:
    """Reads the files of a folder that no run before has read, and writes their articles under `into`; gives the number of batches.

    Each batch goes to a folder of its own by its id and is overwritten as a whole when it runs again, so a batch that was killed leaves no rows
    twice. Within a batch the last file of a slug counts. state: the folder of the stream's checkpoint; after: called once a batch is written.
    """
    done = []
    raw = spark.readStream.format("text").option("wholetext", "true").option("maxFilesPerTrigger", files_a_batch).option("recursiveFileLookup", "true").load(folder)
    read = raw.select(F.col("value").alias("raw"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("modified"))

    def write(batch: DataFrame, number: int) -> None:
        rows = files.parsed_articles(batch, keep=("file", "modified"))
        latest(rows, "slug", "modified", "file").write.mode("overwrite").parquet(f"{into}/batch={number}")
        if after is not None:
            after(number)
        done.append(number)

    read.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return len(done)


def ingested(spark: SparkSession, into: str) -> DataFrame:
    """The articles of all batches, of each slug the one read last."""
    return latest(spark.read.parquet(into), "slug", "batch", "modified", "file")

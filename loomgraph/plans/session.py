"""Session helpers that every part of the library shares."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Only a local session without that setting (a test) gets a folder of its own; on a cluster that would be a folder
    of one machine, so it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return os.path.join(tempfile.gettempdir(), "loomgraph-checkpoints")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage in the shared folder, so that lost executors cost no rerun of what came before."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: like checkpointed, for rows that columns hold in less space."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """df as a side of a join that is dealt out by key, never sent whole to the driver and every task.

    Spark takes the size of a side from its files: rows that are exploded, or that files hold compressed, are many times that.
    """
    return df.hint("merge")


#: So many tables of rounds become one.
FOLD = 8


def piled(tables: list[tuple[int, DataFrame]], more: DataFrame) -> list[tuple[int, DataFrame]]:
    """Written tables (and how often they were folded) of rounds with one more: each FOLD of a kind are written as one, so that their union stays short, however many rounds there are."""
    tables = [*tables, (0, more)]
    while len(tables) >= FOLD and tables[-FOLD][0] == tables[-1][0]:
        tables = [*tables[:-FOLD], (tables[-1][0] + 1, written(together(tables[-FOLD:])))]
    return tables


def together(tables: list[tuple[int, DataFrame]]) -> DataFrame:
    """The rows of piled tables."""
    out = tables[0][1]
    for _, more in tables[1:]:
        out = out.unionByName(more)
    return out

"""Tables that change as a whole: every step reads one version of them and publishes the next.

A version is a line of the manifest: the paths of all tables. Publishing writes the changed tables to paths of their own and then appends one line, so readers
of the old version keep it and a step that fails on the way leaves the current version as it was.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "version int, tables map<string,string>"


class Versions:
    """Versioned tables in a folder that driver and executors share. One publisher at a time: a version published meanwhile is an error."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    @classmethod
    def create(cls, spark: SparkSession, root: str, tables: dict[str, DataFrame]) -> Versions:
        out = cls(spark, root)
        out._append(1, out._written(tables))
        return out

    def _written(self, tables: dict[str, DataFrame]) -> dict[str, str]:
        paths = {name: f"{self.root}/{name}/{uuid.uuid4().hex}" for name in tables}
        for name, df in tables.items():
            df.write.parquet(paths[name])
        return paths

    def _append(self, version: int, paths: dict[str, str]) -> None:
        self.spark.createDataFrame([(version, paths)], SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.root}/manifest")

    def manifest(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(f"{self.root}/manifest")

    def current(self) -> int:
        return self.manifest().agg(F.max("version")).first()[0]

    def read(self, name: str, version: int | None = None) -> DataFrame:
        wanted = self.current() if version is None else version
        row = self.manifest().where(F.col("version") == wanted).first()
        if row is None:
            raise ValueError(f"there is no version {wanted}")
        return self.spark.read.parquet(row["tables"][name])

    def publish(self, changed: dict[str, DataFrame], since: int) -> int:
        """The next version after `since`: the changed tables, and the others as they are."""
        paths = self._written(changed)
        if self.current() != since:
            raise RuntimeError(f"version {since} is not the current one any more")
        before = self.manifest().where(F.col("version") == since).first()["tables"]
        self._append(since + 1, before | paths)
        return since + 1

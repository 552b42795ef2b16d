"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.plans.session import checkpointed, written


#: Labels that are broadcast; more are dealt over SALTS copies, so that what very many nodes point to is not one task.
FEW, SALTS = 500_000, 8


def looked_up(rows: DataFrame, table: DataFrame, column: str, few: bool) -> DataFrame:
    """rows joined with a table of few rows for each value of the column, which very many rows may share."""
    if few:
        return rows.join(F.broadcast(table), column)
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    dealt = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(dealt, [column, "salt"]).drop("salt")


def connected_components(edges: DataFrame, a: str = "src", b: str = "dst", rounds: int = 200) -> DataFrame:
    """(id, component): each endpoint with the least id that it reaches.

    Least labels spread over the edges, and each round also takes the label of the label, so long chains halve.
    Every round is written: a checkpoint would carry on the estimated sizes of its plan, which multiply at every join. Edges with a null end are left out; loops and repeated edges change nothing.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    both = checkpointed(pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("component")).withColumnRenamed("a", "id")
    labels = written(labels)
    few = labels.count() <= FEW
    for _ in range(rounds):
        near = looked_up(both, labels.select(F.col("id").alias("b"), "component"), "b", few).groupBy("a").agg(F.min("component").alias("near"))
        step = labels.join(near, labels["id"] == near["a"]).select("id", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        root = step.select(F.col("id").alias("component"), F.col("component").alias("root"))
        labels = written(looked_up(step, root, "component", few).select("id", "was", F.col("root").alias("component")))
        if labels.where("was <> component").isEmpty():
            break
        labels = labels.select("id", "component")
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return labels.select("id", "component")

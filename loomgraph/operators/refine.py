"""Refinement of a graph as versioned updates: weights, decay with history, conflicts and candidates to prune."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators import claims as C
from loomgraph.sources.versions import Versions

#: Edges that speak of a node, whose weights are updated, difference that is a conflict, and what is weak and old.
SPEAKS, EXTRACTOR = ("CLAIMS", "DISCUSSES", "MENTIONS"), "extractor"
APART, WEAK, OLD_DAYS = 0.3, 0.3, 180
ENTRY = "struct<date:date,confidence:double,reason:string>"


def new_weights(edges: DataFrame) -> DataFrame:
    """(src, dst, type, weight): extracted edges without a weight of their own, with the number of sources that speak of both ends, if over one."""
    said = edges.where(F.col("type").isin(*SPEAKS)).select(F.col("dst").alias("uid"), F.col("src").alias("by")).distinct()
    open_ = edges.where((F.col("source") == EXTRACTOR) & (F.col("weight").isNull() | (F.col("weight") == 1.0))).select("src", "dst", "type").distinct()
    both = open_.join(said.withColumnRenamed("uid", "src"), "src").join(said.withColumnRenamed("uid", "dst"), ["dst", "by"])
    return both.groupBy("src", "dst", "type").agg(F.count("*").cast("double").alias("weight")).where("weight > 1")


def weighed_edges(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All edges with their new weights, and (n): how many edges changed."""
    due = (F.col("source") == EXTRACTOR) & (F.col("weight").isNull() | (F.col("weight") == 1.0))
    met = edges.join(new_weights(edges).withColumnRenamed("weight", "__weight"), ["src", "dst", "type"], "left")
    changed = due & F.col("__weight").isNotNull()
    out = met.withColumn("weight", F.when(changed, F.col("__weight")).otherwise(F.col("weight")))
    return out.select(*edges.columns), met.where(changed).agg(F.count("*").alias("n"))


def with_history(claims: DataFrame, as_of: str) -> DataFrame:
    """Claims without a history get one entry: their confidence, or 0.5."""
    first = F.array(F.struct(C.day(as_of).alias("date"), F.coalesce("confidence", F.lit(0.5)).alias("confidence"), F.lit("initial baseline").alias("reason"))).cast(f"array<{ENTRY}>")
    return claims.withColumn("history", F.coalesce("history", first))


def recorded(claims: DataFrame, changes: DataFrame, as_of: str, reason: str) -> DataFrame:
    """claims with the confidences of changes (uid, new), an entry of each added to its history, and the day as last_verified."""
    met = claims.join(changes.select("uid", F.col("new").alias("__new")), "uid", "left")
    moved = F.col("__new").isNotNull()
    entry = F.array(F.struct(C.day(as_of).alias("date"), F.col("__new").alias("confidence"), F.lit(reason).alias("reason"))).cast(f"array<{ENTRY}>")
    out = met.withColumn("history", F.when(moved, F.concat(F.coalesce("history", F.array().cast(f"array<{ENTRY}>")), entry)).otherwise(F.col("history")))
    out = out.withColumn("confidence", F.coalesce("__new", "confidence")).withColumn("last_verified", F.when(moved, C.day(as_of)).otherwise(F.col("last_verified")))
    return out.select(*claims.columns)


def conflicts(claims: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b): open claims of one type that share an entity, whatever its case, differ by over APART and do not contradict each other already."""
    open_ = claims.where("valid_from IS NOT NULL AND valid_until IS NULL")
    named = open_.select("uid", "claim_type", "confidence", F.explode(F.array_distinct(F.transform("related_entities", F.lower))).alias("entity"))
    right = named.select(F.col("uid").alias("b"), "claim_type", F.col("confidence").alias("b_confidence"), "entity")
    met = named.withColumnRenamed("uid", "a").join(right, ["entity", "claim_type"]).where((F.col("a") < F.col("b")) & (F.abs(F.col("confidence") - F.col("b_confidence")) > APART))
    known = edges.where("type = 'CONTRADICTS'").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    return met.select("a", "b").distinct().join(known, ["a", "b"], "left_anti")


def to_prune(claims: DataFrame, as_of: str) -> DataFrame:
    """(uid, confidence): weak claims that are old and were not verified lately."""
    cutoff = F.date_sub(C.day(as_of), OLD_DAYS)
    return claims.where((F.col("valid_from") < cutoff) & (F.col("confidence") < WEAK) & (F.col("last_verified").isNull() | (F.col("last_verified") < cutoff))).select("uid", "confidence")


def refine(tables: Versions, as_of: str) -> DataFrame:
    """One row: weights_updated, confidence_decayed, conflicts_found, prune_candidates. tables: edges (src, dst, type, source, weight) and claims (with history).

    Each of the first two steps publishes a version of its own; the last two read what they left. A step that fails leaves the version before it.
    """
    version = tables.current()
    edges, n_weights = weighed_edges(tables.read("edges", version))
    weights = n_weights.first()["n"]
    version = tables.publish({"edges": edges}, version)
    claims = tables.read("claims", version)
    changes = C.decay(claims.where("valid_from IS NOT NULL"), as_of)
    decayed = changes.count()
    version = tables.publish({"claims": recorded(with_history(claims, as_of), changes, as_of, "temporal decay")}, version)
    claims, edges = tables.read("claims", version), tables.read("edges", version)
    row = (weights, decayed, conflicts(claims, edges).count(), to_prune(claims, as_of).count())
    return tables.spark.createDataFrame([row], "weights_updated bigint, confidence_decayed bigint, conflicts_found bigint, prune_candidates bigint")

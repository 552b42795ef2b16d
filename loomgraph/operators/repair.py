"""Repair of extracted entities and relations, backlog selectors, and small reports over logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def repaired_entities(entities: DataFrame, kinds: list[str], default: str = "Concept") -> DataFrame:
    """Entities with a name; unknown kinds become the default, descriptions are filled in, numbers held within their ranges (null: 0.5)."""
    held = lambda c, low: F.when(F.col(c).isNull(), 0.5).otherwise(F.greatest(F.lit(low), F.least(F.lit(1.0), F.col(c))))
    named = entities.where("name IS NOT NULL AND trim(name) <> ''")
    kind = F.when(F.col("kind").isin(*kinds), F.col("kind")).otherwise(default)
    return named.select("uid", F.trim("name").alias("name"), kind.alias("kind"), F.coalesce("description", F.col("name")).alias("description"), held("stance", -1.0).alias("stance"), held("volatility", 0.0).alias("volatility"))


def resolved_names(names: DataFrame, entities: DataFrame) -> DataFrame:
    """(name, entity): each name's entity: the same, the same but for case, or else the least that has its first word in any case."""
    known = entities.select(F.col("name").alias("entity")).distinct()
    exact = names.join(known, names["name"] == known["entity"]).select("name", "entity", F.lit(1).alias("way"))
    folded = names.join(known, F.lower("name") == F.lower("entity")).select("name", "entity", F.lit(2).alias("way"))
    words = known.select("entity", F.explode(F.split(F.lower("entity"), " ")).alias("word"))
    loose = names.withColumn("word", F.element_at(F.split(F.lower("name"), " "), 1)).join(words, "word").select("name", "entity", F.lit(3).alias("way"))
    return exact.unionAll(folded).unionAll(loose).groupBy("name").agg(F.min(F.struct("way", "entity")).alias("best")).select("name", "best.entity", "best.way")


def without(entities: DataFrame, edges: DataFrame, claims: DataFrame, banned: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities, edges and claims without what is banned (banned: uid); claims keep their other entities."""
    kept = entities.join(banned, "uid", "left_anti")
    for end in ("src", "dst"):
        edges = edges.join(banned.withColumnRenamed("uid", end), end, "left_anti")
    opened = claims.select("uid", F.posexplode_outer("related_entities").alias("place", "e"))
    left = opened.join(banned.withColumnRenamed("uid", "e"), "e", "left_anti").groupBy("uid").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "e"))), lambda s: s["e"]).alias("related_entities"))
    joined = claims.drop("related_entities").join(left, "uid", "left").withColumn("related_entities", F.coalesce("related_entities", F.array().cast("array<string>")))
    return kept, edges, joined


def under_extracted(articles: DataFrame, edges: DataFrame, most: int = 5, least_text: int = 10) -> DataFrame:
    """Articles with long enough titles but few edges, the barest first."""
    counts = edges.groupBy(F.col("src").alias("uid")).agg(F.count("*").alias("n"))
    out = articles.join(counts, "uid", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.where((F.col("n") <= most) & (F.length("title") >= least_text)).select("uid", "n")


def dynamics(edges: DataFrame, kind: str, began: str, ended: str) -> DataFrame:
    """Edges (or claims) created and expired by kind, and the difference."""
    both = edges.groupBy(kind).agg(F.count(began).alias("created"), F.count(ended).alias("expired"))
    return both.withColumn("net", F.col("created") - F.col("expired"))


def loop_signs(cycles: DataFrame, deltas: DataFrame) -> DataFrame:
    """(path, kind, strength) of cycles by their nodes' mean changes (uid, delta): all up is positive, turning each time negative, else mixed."""
    placed = cycles.select(F.array_join("path", ">").alias("path"), F.posexplode("path").alias("i", "uid")).join(deltas, "uid", "left").withColumn("delta", F.coalesce("delta", F.lit(0.0)))
    seq = placed.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "delta"))), lambda s: s["delta"]).alias("d"), F.round(F.avg(F.abs("delta")), 6).alias("strength"))
    same = F.forall("d", lambda x: x > 0) | F.forall("d", lambda x: x < 0)
    turns = F.forall(F.expr("transform(sequence(1, size(d) - 1), i -> d[i] * d[i - 1] < 0)"), lambda b: b)
    return seq.select("path", F.when(same, "positive").when(turns, "negative").otherwise("mixed").alias("kind"), "strength")


def tier_similarity(values: DataFrame, bins: int = 10, least: float = 0.6) -> DataFrame:
    """(a, b, similarity): pairs of tiers whose histograms of values (tier, value in -1..1) have a cosine above the bar."""
    slot = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col("value") + 1) / 2 * bins)))
    counts = values.groupBy("tier", slot.alias("bin")).agg(F.count("*").alias("n"))
    share = counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("tier")))
    norm = share.groupBy("tier").agg(F.sqrt(F.sum(F.col("p") * F.col("p"))).alias("norm"))
    a = share.join(norm, "tier").select(F.col("tier").alias("a"), "bin", (F.col("p") / F.col("norm")).alias("x"))
    b = a.select(F.col("a").alias("b"), "bin", F.col("x").alias("y"))
    return a.join(b, "bin").where("a < b").groupBy("a", "b").agg(F.round(F.sum(F.col("x") * F.col("y")), 6).alias("similarity")).where(F.col("similarity") > least)


def accuracy(predictions: DataFrame) -> DataFrame:
    """One row: verified, pending, and mean accuracy to 3 places of predictions (accuracy: null while pending)."""
    return predictions.agg(F.count("accuracy").alias("verified"), F.count_if(F.col("accuracy").isNull()).alias("pending"), F.round(F.avg("accuracy"), 3).alias("mean_accuracy"))


def adoption_plan(changes: DataFrame) -> DataFrame:
    """(target, changes, effort, risky) of planned changes (target, size): effort by size, risk beyond three sources."""
    grouped = changes.groupBy("target").agg(F.count_distinct("source").alias("sources"), F.sum("size").alias("size"))
    effort = F.when(F.col("size") < 50, "small").when(F.col("size") < 200, "medium").otherwise("large")
    return grouped.select("target", "sources", effort.alias("effort"), (F.col("sources") > 3).alias("risky"))

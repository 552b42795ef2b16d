"""Ordered deduplication: entities in order, where the first of alike names absorbs later ones unless a later one is longer.

The rule is a pass: each entity that nothing has absorbed yet meets all later ones of its type that are not absorbed; an alike name that is no longer is
absorbed, and to a longer one the entity itself goes (to the last of them). Whether an entity is absorbed depends only on earlier,
alike, not shorter ones, so the entities that stay are the lexicographically first independent set of that relation. Rounds find it: who
has no open predecessor stays, whom one that stays precedes is absorbed; each round settles all entities whose predecessors are settled.

Entities of one type and one name behave alike, so only the first of each takes part in the rounds; alike names come from joins on
thinned strings, pieces and cuts, never from all pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators import dedup
from loomgraph.plans.session import checkpointed, written

#: Names and their aliases.
ALIASES = {
    "미국": ["미합중국", "US", "USA", "United States", "America"],
    "중국": ["중화인민공화국", "PRC", "China"],
    "삼성전자": ["삼성", "Samsung", "Samsung Electronics"],
    "SK하이닉스": ["SK", "SK Hynix", "하이닉스"],
    "TSMC": ["Taiwan Semiconductor", "대만반도체"],
}
#: Least share of the longer name that a name within it must have, and least edit similarity.
WITHIN, LEAST = 0.7, 0.85


def bare(name: Column) -> Column:
    return F.regexp_replace(F.translate(F.lower(name), " _", ""), r"^\s+|\s+$", "")


def alias_merges(entities: DataFrame, aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """(gone, keep) of entities (uid, ord, name): all but the first that an alias group names go to the first."""
    groups = ALIASES | (aliases or {})
    spark = entities.sparkSession
    table = {"".join(a.lower().split(" ")).replace("_", "").strip(): c for c, own in groups.items() for a in (c, *own)}
    known = spark.createDataFrame(sorted(table.items()), "n string, canonical string")
    own = entities.withColumn("n", bare(F.col("name"))).join(F.broadcast(known), "n")
    first = own.groupBy("canonical").agg(F.min_by("uid", F.struct("ord", "uid")).alias("keep"))
    return own.join(first, "canonical").where("uid <> keep").select(F.col("uid").alias("gone"), "keep")


def alike(names: DataFrame) -> DataFrame:
    """(x, y): pairs x < y of different bare names (n) that are close by edits or one within the other at over 70 % of its length."""
    own = names.select(F.lit("").alias("label"), "n").where("n IS NOT NULL").distinct()
    edits = dedup.close_by_edits(own).select("x", "y")
    cut = own.select(F.col("n").alias("x"), F.length("n").alias("k")).where("k > 1")
    most = "cast(ceil(k * (1 - 0.7D)) AS int)"
    cut = cut.withColumn("i", F.explode(F.expr(f"sequence(0, {most})"))).withColumn("j", F.explode(F.expr(f"sequence(0, {most} - i)"))).where("i + j > 0 AND i + j < k")
    inner = cut.select("x", F.expr("substring(x, i + 1, k - i - j)").alias("y")).where(F.length("y") / F.length("x") > WITHIN).distinct()
    within = inner.join(own.select(F.col("n").alias("y")), "y").select("x", "y")
    pairs = edits.unionByName(within).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).where("x <> y").distinct()
    short, long = F.least(F.length("x"), F.length("y")), F.greatest(F.length("x"), F.length("y"))
    inside = (F.contains("x", "y") | F.contains("y", "x")) & (short / long > WITHIN)
    return checkpointed(pairs).where(inside | ((short > 0) & (F.lit(1.0) - F.levenshtein("x", "y") / long >= LEAST)))


def _relation(own: DataFrame) -> DataFrame:
    """(a, b, longer): alike names a before b, and whether b is the longer one. own: (first, type, name, n)."""
    left, right = ([own.select(F.col("first").alias(s), F.col("type").alias(f"{s}_type"), F.length("name").alias(f"{s}_size"), F.col("n").alias(f"{s}_n"))][0] for s in ("a", "b"))
    pairs = alike(own)
    both = pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y"))).unionByName(own.select(F.col("n").alias("x"), F.col("n").alias("y")).distinct())
    met = left.join(both.select(F.col("x").alias("a_n"), F.col("y").alias("b_n")), "a_n")
    same = met.join(right, (met["b_n"] == right["b_n"]) & (F.col("a_type") == F.col("b_type")))
    open_a = met.where("a_type = ''").join(right.where("b_type <> ''"), met["b_n"] == right["b_n"])
    open_b = met.where("a_type <> ''").join(right.where("b_type = ''"), met["b_n"] == right["b_n"])
    take = lambda df: df.where("a < b").select("a", "b", (F.col("b_size") > F.col("a_size")).alias("longer"))
    return take(same).unionByName(take(open_a)).unionByName(take(open_b))


def similar_merges(entities: DataFrame) -> DataFrame:
    """(gone, keep) of entities (uid, ord, name, type), as the ordered pass merges them. Names of null are left out; an empty type meets all."""
    named = entities.where("name IS NOT NULL").select(F.struct("ord", "uid").alias("at"), F.coalesce("type", F.lit("")).alias("type"), "name")
    named = checkpointed(named)
    own = written(named.groupBy("type", "name").agg(F.min("at").alias("first"), F.max("at").alias("last")).withColumn("n", bare(F.col("name"))))
    relation = written(_relation(own))
    before = relation.where("NOT longer").select("a", "b")
    open_, stays = own.select("first"), own.select("first").limit(0)
    left = before
    while True:
        now = written(open_.join(left.select(F.col("b").alias("first")), "first", "left_anti"))
        if now.isEmpty():
            break
        stays = stays.unionByName(now)
        lost = before.join(now.withColumnRenamed("first", "a"), "a").select(F.col("b").alias("first"))
        open_ = written(open_.join(now, "first", "left_anti").join(lost, "first", "left_anti"))
        for end in ("a", "b"):
            left = left.join(open_.withColumnRenamed("first", end), end, "left_semi").select("a", "b")
        left = written(left)
    into = checkpointed(before.join(stays.withColumnRenamed("first", "a"), "a").groupBy("b").agg(F.min("a").alias("keep")))  # the first of those that stay
    longer = relation.where("longer").select("a", "b").join(stays.withColumnRenamed("first", "a"), "a").join(into, "b", "left").where("keep IS NULL OR keep > a")
    last = longer.join(own.select(F.col("first").alias("b"), "last"), "b").groupBy("a").agg(F.max("last").alias("last"))
    turned = last.select(F.col("a.uid").alias("gone"), F.col("last.uid").alias("keep"))
    rows = named.join(own.select("type", "name", "first"), ["type", "name"]).join(into.withColumnRenamed("b", "first"), "first", "left")
    taken = rows.where("keep IS NOT NULL OR at <> first").select(F.col("at.uid").alias("gone"), F.coalesce("keep.uid", "first.uid").alias("keep"))
    return taken.unionByName(turned)


def ordered_merges(entities: DataFrame, aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """(gone, keep, by) of entities (uid, ord, name, type): aliases first, then alike names among the entities that are left."""
    known = checkpointed(alias_merges(entities, aliases))
    left = entities.join(known.select(F.col("gone").alias("uid")), "uid", "left_anti")
    return known.withColumn("by", F.lit("alias")).unionByName(similar_merges(left).withColumn("by", F.lit("similarity")))


def merged_relations(relations: DataFrame, merges: DataFrame) -> DataFrame:
    """relations (src, dst, type, weight, confidence, chunk) between the entities that stay: loops go, and those of the same ends and type become one,
    with summed weights, the mean confidence and the first chunk. Merges of merges are followed to their end.
    """
    final, out = dedup.settled(merges), relations
    for end in ("src", "dst"):
        out = out.join(final.select(F.col("gone").alias(end), F.col("keep").alias("__keep")), end, "left").withColumn(end, F.coalesce("__keep", end)).drop("__keep")
    return dedup.merge_edges(out.where("src <> dst"))

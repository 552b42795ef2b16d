"""Scores and statistics of candidates, decisions, metrics and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words that make a candidate relevant.
KEYWORDS = [
    "knowledge graph", "neo4j", "graphrag", "rag", "mcp", "entity extraction", "ontology", "crawler", "rss",
    "simulation", "prediction", "analysis", "discord", "agent", "claude", "anthropic", "llm", "embedding",
]


def trust(as_of: str) -> Column:
    stars = F.greatest("stars", F.lit(1)).cast("double")
    age = F.datediff(F.lit(as_of).cast("date"), F.col("last_commit"))
    recency = F.when(age < 7, 0.3).when(age < 30, 0.25).when(age < 90, 0.15).otherwise(0.05)
    issues = F.col("open_issues") / stars
    score = F.least(F.col("forks") / stars / 0.3, F.lit(1.0)) * 0.3 + recency + F.least(F.log10(stars) / 4, F.lit(1.0)) * 0.2
    return F.least(score + F.when(F.col("license").isNotNull(), 0.1).otherwise(0.0) + F.when(issues < 0.05, 0.1).when(issues < 0.1, 0.05).otherwise(0.0), F.lit(1.0))


def quality() -> Column:
    readme, flag = F.col("readme"), lambda c, w: F.when(c, w).otherwise(0.0)
    score = F.when(F.length(readme) > 200, 0.2).when(F.length(readme) > 50, 0.1).otherwise(0.0)
    score = score + flag(F.regexp_like(readme, F.lit("(?i)install|setup|getting started")), 0.1) + flag(F.regexp_like(readme, F.lit("(?i)example|usage|demo")), 0.1)
    score = score + flag(F.col("has_ci"), 0.2) + flag(F.col("has_tests"), 0.2) + flag(F.col("license").isNotNull() & (F.col("license") != "NOASSERTION"), 0.1)
    return F.least(score + flag(F.length("description") > 20, 0.1), F.lit(1.0))


def relevance(keywords: list[str] = KEYWORDS) -> Column:
    text = F.lower(F.concat_ws(" ", "description", F.array_join("topics", " "), "readme"))
    hits = sum((F.contains(text, F.lit(k)).cast("int") for k in keywords), F.lit(0))
    return F.least(hits / 5.0, F.lit(1.0))


def warnings(as_of: str, on_topic: Column) -> Column:
    """Ids of the signals against a candidate."""
    signs = {
        "hype": F.regexp_like("readme", F.lit("(?i)blazing fast|revolutionary")),
        "off-core": ~on_topic,
        "no-license": F.col("license").isNull(),
        "many-issues": F.col("open_issues") > F.col("stars") * 0.5,
        "old": F.datediff(F.lit(as_of).cast("date"), F.col("last_commit")) > 180,
        "few-forks": (F.col("stars") > 1000) & (F.col("forks") < F.col("stars") * 0.02),
        "no-start": (F.length("readme") > 100) & ~F.regexp_like("readme", F.lit("(?i)install|usage|getting started|quick|setup|npm|pip|brew|cargo|bun|docker|clone")),
    }
    return F.array_compact(F.array(*[F.when(c, k) for k, c in signs.items()]))


def evaluate(candidates: DataFrame, as_of: str, keywords: list[str] = KEYWORDS) -> DataFrame:
    """Scores, warnings and verdict of candidates (uid, stars, forks, open_issues, last_commit, license, readme, description, topics, has_ci, has_tests)."""
    scored = candidates.withColumns({"trust": trust(as_of), "quality": quality(), "relevance": relevance(keywords)})
    scored = scored.withColumn("warnings", warnings(as_of, F.col("relevance") > 0))
    total = F.round(F.col("trust") * 0.2 + F.col("quality") * 0.3 + F.col("relevance") * 0.5 - F.size("warnings") * 0.1, 9)
    scored = scored.withColumn("total", total)
    verdict = F.when((F.col("total") >= 0.5) & (F.size("warnings") <= 1) & (F.col("relevance") > 0), "adopt").when(F.col("total") >= 0.35, "study").otherwise("skip")
    return scored.select("uid", F.round("trust", 2).alias("trust"), F.round("quality", 2).alias("quality"), F.round("relevance", 2).alias("relevance"), F.array_join("warnings", ",").alias("warnings"), F.round("total", 6).alias("total"), verdict.alias("verdict"))


def latency_percentiles(timings: DataFrame, kept: int = 1000, at: tuple[int, ...] = (50, 95, 99)) -> DataFrame:
    """(name, n, p50, ...) over each name's latest timings (name, seq, value): the element at floor(n * p / 100) of the sorted values."""
    latest = timings.withColumn("k", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("seq")))).where(F.col("k") <= kept)
    sorted_ = latest.groupBy("name").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("value")).alias("v"))
    return sorted_.select("name", "n", *[F.element_at("v", F.least(F.col("n") - 1, F.floor(F.col("n") * p / 100)).cast("int") + 1).alias(f"p{p}") for p in at])


def pattern_confidence(decisions: DataFrame) -> DataFrame:
    """(pattern, approved, rejected, confidence); deferred decisions count for neither."""
    counts = decisions.groupBy("pattern").agg(F.count_if(F.col("decision") == "approved").alias("approved"), F.count_if(F.col("decision") == "rejected").alias("rejected"))
    total = F.col("approved") + F.col("rejected")
    return counts.withColumn("confidence", F.when(total > 0, F.round(F.col("approved") / total, 2)).otherwise(0.0))


def latest_decision(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("uid").agg(F.max_by("decision", "seq").alias("decision"), F.count("*").alias("n"))


def half_trend(series: DataFrame, least: int = 6, band: float = 0.1) -> DataFrame:
    """(name, n, first, second, trend): means of the earlier and the later half of each short series (name, step, value)."""
    own = Window.partitionBy("name")
    placed = series.withColumn("k", F.row_number().over(own.orderBy("step"))).withColumn("n", F.count("*").over(own)).where(F.col("n") >= least)
    early = F.col("k") <= F.floor(F.col("n") / 2)
    out = placed.groupBy("name").agg(F.max("n").alias("n"), F.round(F.avg(F.when(early, F.col("value"))), 6).alias("first"), F.round(F.avg(F.when(~early, F.col("value"))), 6).alias("second"))
    label = F.when(F.col("second") > F.col("first") * (1 + band), "rising").when(F.col("second") < F.col("first") * (1 - band), "falling").otherwise("steady")
    return out.withColumn("trend", label)


def snapshot_difference(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Counts by key in two snapshots, where they differ."""
    a, b = before.groupBy(key).agg(F.count("*").alias("a")), after.groupBy(key).agg(F.count("*").alias("b"))
    both = a.join(b, key, "full_outer").select(key, F.coalesce("a", F.lit(0)).alias("before"), F.coalesce("b", F.lit(0)).alias("after"))
    return both.withColumn("change", F.col("after") - F.col("before")).where("change <> 0")


def survival(history: DataFrame) -> DataFrame:
    """(uid, score): 1 for code never changed since, less 0.2 for each change (0.3 at least), 0 if reverted; 0.5 where unknown."""
    known = history.groupBy("uid").agg(F.count_if(F.col("kind") == "change").alias("changes"), F.count_if(F.col("kind") == "revert").alias("reverts"), F.count_if(F.col("kind") == "seen").alias("seen"))
    score = F.when(F.col("reverts") > 0, 0.0).when(F.col("changes") > 0, F.greatest(F.lit(0.3), 1.0 - 0.2 * F.col("changes"))).when(F.col("seen") > 0, 1.0).otherwise(0.5)
    return known.select("uid", F.round(score, 6).alias("score"))


def dimension_scores(nodes: DataFrame, edges: DataFrame, claims: DataFrame) -> DataFrame:
    """(dimension, score, most): parts of the quality of a graph, each a share of its most."""
    n = nodes.agg(F.count("*").alias("n"), F.count_if(F.col("name").isNotNull()).alias("named"), F.count_distinct("label").alias("labels"))
    e = edges.agg(F.count("*").alias("m"), F.count_if(F.col("confidence").isNotNull()).alias("sure"), F.count_distinct("type").alias("types"))
    c = claims.agg(F.count("*").alias("c"), F.count_if(F.col("confidence") >= 0.5).alias("strong"), F.count_if(F.col("last_verified").isNotNull()).alias("checked"))
    linked = edges.select(F.explode(F.array("src", "dst")).alias("uid")).distinct().join(nodes.select("uid"), "uid", "left_semi").agg(F.count("*").alias("linked"))
    one = n.crossJoin(e).crossJoin(c).crossJoin(linked)  # one row each
    parts = {
        "schema": (F.least(F.col("labels") / 6.0, F.lit(1.0)), 8),
        "naming": (F.col("named") / F.col("n"), 6),
        "edge_metadata": (F.col("sure") / F.col("m"), 10),
        "edge_types": (F.least(F.col("types") / 8.0, F.lit(1.0)), 8),
        "claims": (F.col("strong") / F.col("c"), 10),
        "temporal": (F.col("checked") / F.col("c"), 8),
        "connectivity": (F.col("linked") / F.col("n"), 10),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("dimension"), F.round(share * most, 4).alias("score"), F.lit(most).alias("most")) for k, (share, most) in parts.items()])
    return one.select(F.explode(rows).alias("r")).select("r.*")

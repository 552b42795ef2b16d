"""Time-bounded claims: validity, decay, conflicts, boosts, and the log of their evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators import match

#: Fixed values of the claim model.
DEFAULT_DECAY, LEAST_CONFIDENCE, DAYS_A_YEAR = 0.1, 0.05, 365.25
TYPE_FLOORS = {"fact": 0.9, "comparison": 0.8, "opinion": 0.7, "prediction": 0.55}
BOOST, BOOST_CAP = 0.05, 0.95


def day(value: str) -> Column:
    return F.lit(value).cast("date")


def valid_at(claims: DataFrame, when: str, topic: str | None = None, limit: int | None = None) -> DataFrame:
    out = claims.where((F.col("valid_from") <= day(when)) & (F.col("valid_until").isNull() | (F.col("valid_until") > day(when))))
    if topic is not None:
        out = out.where(F.contains(F.lower("content"), F.lit(topic.lower())) | F.exists("related_entities", lambda e: F.contains(F.lower(e), F.lit(topic.lower()))))
    return out if limit is None else out.orderBy(F.desc("confidence"), "uid").limit(limit)


def timeline(claims: DataFrame) -> DataFrame:
    """(uid, day, event): when each claim began and, if it did, ended."""
    made = claims.select("uid", F.col("valid_from").alias("day"), F.lit("created").alias("event"))
    return made.unionAll(claims.where("valid_until IS NOT NULL").select("uid", F.col("valid_until").alias("day"), F.lit("invalidated").alias("event")))


def decayed(as_of: str) -> Column:
    """Confidence after a yearly loss since the claim was last verified (or began); unchanged if that is not past."""
    since = F.coalesce("last_verified", "valid_from")
    years = F.datediff(day(as_of), since) / F.lit(DAYS_A_YEAR)
    rate = F.coalesce(F.col("confidence_decay"), F.lit(DEFAULT_DECAY))
    lost = F.col("confidence") * F.pow(F.lit(1.0) - rate, years)
    return F.when(years > 0, F.greatest(F.least(lost, F.lit(1.0)), F.lit(LEAST_CONFIDENCE))).otherwise(F.col("confidence"))


def decay(claims: DataFrame, as_of: str) -> DataFrame:
    """(uid, old, new): open claims above the floor whose confidence moves by 0.01 or more."""
    moved = claims.where("valid_until IS NULL").where(F.col("confidence") > LEAST_CONFIDENCE).select("uid", F.col("confidence").alias("old"), decayed(as_of).alias("raw"))
    return moved.where(F.abs(F.col("raw") - F.col("old")) >= 0.01).select("uid", "old", F.round("raw", 3).alias("new"))


def stale(claims: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    """Open claims that began, and were verified if ever, before the cutoff."""
    cutoff = F.date_sub(day(as_of), days)
    return claims.where(F.col("valid_until").isNull() & (F.col("valid_from") < cutoff) & (F.col("last_verified").isNull() | (F.col("last_verified") < cutoff)))


def prune_candidates(claims: DataFrame, as_of: str, below: float = 0.3, days: int = 180, limit: int | None = 50) -> DataFrame:
    out = claims.where("valid_until IS NULL").withColumn("age_days", F.datediff(day(as_of), F.col("valid_from"))).where((F.col("confidence") < below) & (F.col("age_days") > days))
    out = out.select("uid", "confidence", "age_days")
    return out if limit is None else out.orderBy("confidence", "uid").limit(limit)


def shared_pairs(claims: DataFrame, *columns: str) -> DataFrame:
    """Pairs a < b of claims that share an entity, with the shared count and the given columns of both ends (a_..., b_...)."""
    pairs = match.shared_members(claims, "uid", "related_entities")
    for end in ("a", "b"):
        pairs = pairs.join(claims.select(F.col("uid").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in columns]), end)
    return pairs


def conflicts(claims: DataFrame) -> DataFrame:
    """Open claims of one type over a shared entity that differ in confidence by more than 0.3."""
    pairs = shared_pairs(claims.where("valid_until IS NULL"), "claim_type", "confidence")
    return pairs.where("a_claim_type = b_claim_type AND abs(a_confidence - b_confidence) > 0.3").select("a", "b", "shared")


def type_floor(claims: DataFrame) -> DataFrame:
    """Claims below the floor of their type, and the floor."""
    floors = F.create_map(*[F.lit(x) for pair in TYPE_FLOORS.items() for x in pair])
    return claims.withColumn("floor", floors[F.col("claim_type")]).where("confidence < floor").select("uid", "claim_type", "confidence", "floor")


def support_boost(claims: DataFrame, supports: DataFrame) -> DataFrame:
    """Claims below the cap that others support, with their raised confidence."""
    counts = supports.groupBy(F.col("dst").alias("uid")).agg(F.count("*").alias("supporters"))
    raised = F.least(F.col("confidence") + F.lit(BOOST) * F.col("supporters"), F.lit(BOOST_CAP))
    return claims.where(F.col("confidence") < BOOST_CAP).join(counts, "uid").select("uid", "supporters", F.round(raised, 6).alias("raised"))


def cross_verified(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """Unverified claims to verify: well-sourced facts and comparisons, and strong facts (sources: dst = claim)."""
    pending = claims.where("verified IS NULL OR NOT verified")
    sourced = pending.where("claim_type IN ('fact', 'comparison') AND confidence >= 0.7").join(sources.select(F.col("dst").alias("uid")), "uid", "left_semi")
    strong = pending.where("claim_type = 'fact' AND confidence >= 0.8")
    return sourced.select("uid").union(strong.select("uid")).distinct()


def contradictions(claims: DataFrame, sources: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs of opinions or predictions of one type over a shared entity from different sources, not yet linked either way."""
    kinds = claims.where("claim_type IN ('opinion', 'prediction')")
    pairs = shared_pairs(kinds, "claim_type").where("a_claim_type = b_claim_type").select("a", "b")
    for end in ("a", "b"):
        pairs = pairs.join(sources.select(F.col("dst").alias(end), F.col("src").alias(f"{end}_source")), end)
    pairs = pairs.where("a_source <> b_source").select("a", "b").distinct()
    either = match.both_ways(known).select(F.col("src").alias("a"), F.col("dst").alias("b"))
    return pairs.join(either, ["a", "b"], "left_anti")


def invalidations(claims: DataFrame, incoming: DataFrame) -> DataFrame:
    """Open claims that a stronger incoming claim of their type, over a shared entity (in any case), replaces: (uid, valid_until)."""
    lower = lambda df: df.withColumn("entity", F.explode(F.array_distinct(F.transform("related_entities", F.lower))))
    old = lower(claims.where("valid_until IS NULL")).select("uid", "claim_type", "entity", "content", "confidence")
    new = lower(incoming).select(F.col("uid").alias("by"), "claim_type", "entity", F.col("content").alias("new_content"), F.col("confidence").alias("new_confidence"), F.col("valid_from").alias("starts"))
    hit = old.join(new, ["claim_type", "entity"]).where("uid <> by AND content <> new_content AND confidence < new_confidence")
    return hit.groupBy("uid").agg(F.min("starts").alias("valid_until"))


def trends(history: DataFrame, least: float = 0.1) -> DataFrame:
    """(uid, first, current, change, direction) of claims whose confidence moved, from history(uid, seq, confidence)."""
    ends = history.groupBy("uid").agg(F.min_by("confidence", "seq").alias("first"), F.max_by("confidence", "seq").alias("current"))
    moved = ends.withColumn("change", F.round(F.col("current") - F.col("first"), 6)).where(F.abs("change") >= least)
    return moved.withColumn("direction", F.when(F.col("change") > 0, "rising").otherwise("falling"))


def state_at(evidence: DataFrame, when: str) -> DataFrame:
    """Each claim's last known state at a moment: the latest entry with a state (later sequence wins a tie)."""
    past = evidence.where((F.col("ts") <= F.lit(when).cast("timestamp")) & F.col("next_state").isNotNull())
    return past.groupBy("uid").agg(F.max_by("next_state", F.struct("ts", "seq")).alias("state"), F.count("*").alias("entries"))


def cold_storage(evidence: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    """Entries older than the cutoff with the month that they are filed under."""
    return evidence.where(F.col("ts") < F.date_sub(day(as_of), days).cast("timestamp")).withColumn("month", F.date_format("ts", "yyyy-MM"))


def coverage(claims: DataFrame, sources: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row: claims, those with a source, a source label and evidence, and whether the sourced share is 60 % or more."""
    flagged = claims.join(sources.select(F.col("dst").alias("uid")).distinct().withColumn("has_source", F.lit(1)), "uid", "left")
    flagged = flagged.join(evidence.select("uid").distinct().withColumn("has_evidence", F.lit(1)), "uid", "left")
    counted = flagged.agg(F.count("*").alias("claims"), F.count("has_source").alias("sourced"), F.count("source").alias("labelled"), F.count("has_evidence").alias("evidenced"))
    return counted.withColumn("passed", F.col("sourced") >= F.lit(0.6) * F.col("claims"))


def confidence_steps(events: DataFrame) -> DataFrame:
    """A history of confidences from evidence entries: the running mean of their strength (in hundredths), cut to 4 places."""
    upto = Window.partitionBy("uid").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return events.select("uid", F.row_number().over(Window.partitionBy("uid").orderBy("ts", "event_id")).alias("seq"), (F.floor(F.sum("k").over(upto) * 100 / F.count("k").over(upto)) / 10000.0).alias("confidence"))

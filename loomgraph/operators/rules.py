"""Rule inference: each rule maps a graph of edges to new edges; the engine applies the rules by priority, later ones seeing earlier edges.

One pass, no fixpoint. A rule returns (src, dst, type, confidence) without the edges that are already there.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators import claims as C
from loomgraph.operators import match
from loomgraph.plans.session import checkpointed

#: The analysis space of each edge type when edges are backfilled.
SPACES = {
    "hierarchy": ["SUBTOPIC_OF", "MEMBER_OF", "PARENT_COMMUNITY", "SUMMARIZES"],
    "structural": ["DEPENDS_ON", "BUILT_ON", "USES_TECHNOLOGY", "IMPLEMENTS", "ALTERNATIVE_TO", "INFLUENCES", "EVOLVED_FROM", "DISCUSSES", "DEVELOPS"],
    "causal": ["CLAIMS", "SUPPORTS", "CONTRADICTS", "EVIDENCED_BY"],
    "temporal": ["AUTHORED_BY", "WRITTEN_BY", "CITES", "REFERENCES"],
    "cross": ["MENTIONS", "TAGGED_WITH", "RELATED_TO"],
    "recursive": ["GOVERNS", "CASCADES_TO", "CONSTRAINS", "MANAGES", "PRODUCES", "CONSUMES", "EXECUTED"],
}
#: Fixed value: where the table for contexts differs from that for backfills.
CONTEXT_CROSS, CONTEXT_UNKNOWN = ["DISCUSSES"], ["DEVELOPS", "EXECUTED"]


def space_of(kind: Column, context: bool = False) -> Column:
    """The analysis space of an edge type: by the table for backfills, or that for contexts (which calls others unknown)."""
    table = {t: space for space, types in SPACES.items() for t in types}
    if context:
        table |= dict.fromkeys(CONTEXT_CROSS, "cross")
        table = {t: s for t, s in table.items() if t not in CONTEXT_UNKNOWN}
    found = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[kind]
    return F.coalesce(found, F.lit("unknown")) if context else found


def _edges(pairs: DataFrame, src: str, dst: str, kind: str, confidence: float) -> DataFrame:
    return pairs.select(F.col(src).alias("src"), F.col(dst).alias("dst"), F.lit(kind).alias("type"), F.lit(confidence).alias("confidence")).distinct()


def missing(pairs: DataFrame, edges: DataFrame, *types: str) -> DataFrame:
    """Rows (src, dst) of pairs that no edge of these types links."""
    return pairs.join(match.of_types(edges, *types).select("src", "dst"), ["src", "dst"], "left_anti")


def transitive_dependency(edges: DataFrame, claims: DataFrame, nodes: DataFrame) -> DataFrame:
    return _edges(match.two_hops_without_shortcut(match.of_types(edges, "DEPENDS_ON")), "src", "dst", "DEPENDS_ON", 0.6)


def ownership(edges: DataFrame, claims: DataFrame, nodes: DataFrame) -> DataFrame:
    """What a person develops, the person's affiliation develops too."""
    of = match.of_types(edges, "AFFILIATED_WITH").select(F.col("src").alias("person"), F.col("dst").alias("src"))
    made = match.of_types(edges, "DEVELOPS").select(F.col("src").alias("person"), "dst")
    return _edges(missing(of.join(made, "person").select("src", "dst").distinct(), edges, "DEVELOPS"), "src", "dst", "DEVELOPS", 0.5)


def contradiction_notes(edges: DataFrame, claims: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs of sourced claims of one type over a shared entity."""
    sourced = claims.join(match.of_types(edges, "CLAIMS").select(F.col("dst").alias("uid")).distinct(), "uid", "left_semi")
    pairs = C.shared_pairs(sourced, "claim_type").where("a_claim_type = b_claim_type").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    return _edges(missing(pairs, edges, "RELATED_TO"), "src", "dst", "RELATED_TO", 0.5)


def comparison_links(edges: DataFrame, claims: DataFrame, nodes: DataFrame) -> DataFrame:
    pairs = C.shared_pairs(claims.where("claim_type = 'comparison'")).where("shared >= 2").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    return _edges(missing(pairs, edges, "SUPPORTS", "CONTRADICTS"), "src", "dst", "SUPPORTS", 0.5)


def fact_support(edges: DataFrame, claims: DataFrame, nodes: DataFrame) -> DataFrame:
    pairs = C.shared_pairs(claims.where("claim_type = 'fact'"), "confidence").where("abs(a_confidence - b_confidence) < 0.3")
    return _edges(missing(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")), edges, "SUPPORTS", "CONTRADICTS"), "src", "dst", "SUPPORTS", 0.6)


def prediction_evidence(edges: DataFrame, claims: DataFrame, nodes: DataFrame) -> DataFrame:
    entity = lambda kind, name: claims.where(F.col("claim_type") == kind).select(F.col("uid").alias(name), F.explode("related_entities").alias("m"))
    pairs = entity("prediction", "src").join(entity("fact", "dst"), "m").select("src", "dst").distinct()
    return _edges(missing(pairs, edges, "EVIDENCED_BY", "SUPPORTS", "CONTRADICTS"), "src", "dst", "EVIDENCED_BY", 0.4)


def parent_topics(edges: DataFrame, claims: DataFrame, nodes: DataFrame) -> DataFrame:
    child = match.of_types(edges, "TAGGED_WITH").select("src", F.col("dst").alias("topic"))
    parent = match.of_types(edges, "SUBTOPIC_OF").select(F.col("src").alias("topic"), "dst")
    return _edges(missing(child.join(parent, "topic").select("src", "dst").distinct(), edges, "TAGGED_WITH"), "src", "dst", "TAGGED_WITH", 0.4)


def placeholder_repos(edges: DataFrame, claims: DataFrame, nodes: DataFrame, kinds: tuple[str, ...] = ("library", "framework", "tool"), least: int = 3) -> DataFrame:
    """A repository for each technology of these kinds (nodes: uid, kind) that enough articles discuss and nothing implements."""
    wanted = nodes.where(F.col("kind").isin(*kinds)).select("uid").join(match.of_types(edges, "IMPLEMENTS").select(F.col("dst").alias("uid")), "uid", "left_anti")
    popular = match.of_types(edges, "DISCUSSES").groupBy(F.col("dst").alias("uid")).agg(F.count("*").alias("n")).where(F.col("n") >= least).join(wanted, "uid", "left_semi")
    return _edges(popular.select(F.concat(F.lit("repo:inferred-"), F.col("uid")).alias("src"), F.col("uid").alias("dst")), "src", "dst", "IMPLEMENTS", 0.3)


def placeholder_papers(edges: DataFrame, claims: DataFrame, nodes: DataFrame, words: tuple[str, ...] = ("논문", "paper", "연구")) -> DataFrame:
    """A paper for each article whose claims speak of one, if it references none."""
    speaks = F.lit(False)
    for word in words:
        speaks = speaks | F.contains(F.col("content"), F.lit(word))
    hits = match.of_types(edges, "CLAIMS").join(claims.where(speaks).select(F.col("uid").alias("dst")), "dst", "left_semi").select("src").distinct()
    hits = hits.join(match.of_types(edges, "REFERENCES").select("src"), "src", "left_anti")
    return _edges(hits.withColumn("dst", F.concat(F.lit("paper:ref-"), F.col("src"))), "src", "dst", "REFERENCES", 0.4)


def verified_by_support(claims: DataFrame, supports: DataFrame) -> DataFrame:
    """Unverified claims with two supporters or more, or strong facts."""
    counts = supports.groupBy(F.col("dst").alias("uid")).agg(F.count("*").alias("supporters"))
    pending = claims.where("verified IS NULL OR NOT verified").join(counts, "uid", "left").withColumn("supporters", F.coalesce("supporters", F.lit(0)))
    return pending.where("supporters >= 2 OR (confidence >= 0.85 AND claim_type = 'fact')").select("uid", "supporters")


@dataclass(frozen=True)
class Rule:
    name: str
    priority: int
    infer: Callable[[DataFrame, DataFrame, DataFrame], DataFrame]


RULES = [
    Rule("claim-contradiction-detection", 15, contradiction_notes),
    Rule("claim-supports-inference", 12, fact_support),
    Rule("claim-prediction-track", 11, prediction_evidence),
    Rule("tech-dependency-transitivity", 10, transitive_dependency),
    Rule("claim-comparison-link", 9, comparison_links),
    Rule("org-tech-ownership", 8, ownership),
    Rule("topic-hierarchy-enrichment", 5, parent_topics),
    Rule("extract-paper-from-claims", 4, placeholder_papers),
    Rule("extract-repo-from-tech", 3, placeholder_repos),
]


def apply_rules(edges: DataFrame, claims: DataFrame, nodes: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """The inferred edges of all rules with the rule's name, highest priority first."""
    known = edges.select("src", "dst", "type", "confidence")
    inferred = None
    for rule in sorted(rules, key=lambda r: -r.priority):
        new = checkpointed(rule.infer(known, claims, nodes))  # each rule reads what the ones before wrote
        known = known.unionByName(new)
        named = new.withColumn("rule", F.lit(rule.name))
        inferred = named if inferred is None else inferred.unionByName(named)
    return inferred


def backfill(edges: DataFrame) -> DataFrame:
    """Edges with space, source and confidence filled in: 0.7 for extracted ones, else 0.5 and source `default` where both lack."""
    space = F.coalesce(F.col("analysis_space"), space_of(F.col("type")))
    confidence = F.coalesce("confidence", F.when(F.col("source") == "extractor", 0.7).when(F.col("source").isNull(), 0.5))
    source = F.when(F.col("source").isNull() & F.col("confidence").isNull(), "default").otherwise(F.col("source"))
    return edges.select("src", "dst", "type", space.alias("analysis_space"), confidence.alias("confidence"), source.alias("source"))

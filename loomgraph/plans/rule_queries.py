"""Queries for rule inference and backfills."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators import match, rules
from loomgraph.plans.bindings import Graph
from loomgraph.plans.claim_queries import PAIRS
from loomgraph.plans.registry import query


@query("""SELECT DISTINCT a.src, c.dst FROM depends_on a JOIN depends_on c ON a.dst = c.src WHERE a.src <> c.dst AND NOT EXISTS (SELECT 1 FROM depends_on x WHERE x.src = a.src AND x.dst = c.dst)""")
def rule_transitive_dependency(g: Graph) -> DataFrame:
    return rules.transitive_dependency(g.depends_on, g.claims, g.nodes).select("src", "dst")


def _affiliated(g: Graph) -> DataFrame:
    """Articles' authors develop what their articles discuss, for the ownership rule."""
    wrote = match.of_types(g.edges, "WRITTEN_BY").select(F.col("src").alias("article"), F.col("dst").alias("src"))
    made = g.discusses.select(F.col("src").alias("article"), "dst")
    develops = wrote.join(made, "article").select("src", "dst", F.lit("DEVELOPS").alias("type"), F.lit(0.7).alias("confidence")).distinct()
    return match.of_types(g.edges, "AFFILIATED_WITH").unionByName(develops)


@query("""SELECT DISTINCT a.dst AS src, d.dst FROM edges w JOIN discusses d ON d.src = w.src JOIN edges a ON a.src = w.dst AND a.type = 'AFFILIATED_WITH' WHERE w.type = 'WRITTEN_BY'""")
def rule_ownership(g: Graph) -> DataFrame:
    return rules.ownership(_affiliated(g), g.claims, g.nodes).select("src", "dst")


@query("WITH " + PAIRS + """ SELECT a AS src, b AS dst FROM pairs JOIN claims x ON x.uid = a JOIN claims y ON y.uid = b WHERE x.claim_type = y.claim_type
AND a IN (SELECT dst FROM about) AND b IN (SELECT dst FROM about)""")
def rule_contradiction_notes(g: Graph) -> DataFrame:
    return rules.contradiction_notes(g.about, g.claims, g.nodes).select("src", "dst")


@query("""SELECT DISTINCT a.src, 'paper:ref-' || a.src AS dst FROM about a JOIN claims c ON c.uid = a.dst WHERE contains(content, 'rights') OR contains(content, 'License')""")
def rule_placeholder_papers(g: Graph) -> DataFrame:
    """The words that stand for a paper here are ones that these texts have."""
    return rules.placeholder_papers(g.about, g.claims, g.nodes, ("rights", "License")).select("src", "dst")


@query("""SELECT 'repo:inferred-' || t.uid AS src, t.uid AS dst FROM technologies t JOIN discusses d ON d.dst = t.uid WHERE t.kind IN ('promo', 'large') GROUP BY t.uid HAVING count(*) >= 3""")
def rule_placeholder_repos(g: Graph) -> DataFrame:
    return rules.placeholder_repos(g.discusses, g.claims, g.technologies, ("promo", "large")).select("src", "dst")


LINKED = "AND NOT EXISTS (SELECT 1 FROM supports s WHERE s.src = a AND s.dst = b)"


@query("WITH " + PAIRS + f""" SELECT a AS src, b AS dst FROM pairs JOIN claims x ON x.uid = a JOIN claims y ON y.uid = b WHERE x.claim_type = 'comparison' AND y.claim_type = 'comparison' AND shared >= 2 {LINKED}""")
def rule_comparison_links(g: Graph) -> DataFrame:
    return rules.comparison_links(g.supports, g.claims, g.nodes).select("src", "dst")


@query("WITH " + PAIRS + f""" SELECT a AS src, b AS dst FROM pairs JOIN claims x ON x.uid = a JOIN claims y ON y.uid = b WHERE x.claim_type = 'fact' AND y.claim_type = 'fact' AND abs(x.confidence - y.confidence) < 0.3 {LINKED}""")
def rule_fact_support(g: Graph) -> DataFrame:
    return rules.fact_support(g.supports, g.claims, g.nodes).select("src", "dst")


@query("""WITH e AS (SELECT uid, claim_type, unnest(related_entities) AS m FROM claims)
SELECT DISTINCT p.uid AS src, f.uid AS dst FROM e p JOIN e f ON p.m = f.m WHERE p.claim_type = 'prediction' AND f.claim_type = 'fact' AND NOT EXISTS (SELECT 1 FROM supports s WHERE s.src = p.uid AND s.dst = f.uid)""")
def rule_prediction_evidence(g: Graph) -> DataFrame:
    return rules.prediction_evidence(g.supports, g.claims, g.nodes).select("src", "dst")


@query("""WITH n AS (SELECT dst, count(*) AS n FROM supports GROUP BY dst)
SELECT c.uid, coalesce(n, 0) AS supporters FROM claims c LEFT JOIN n ON n.dst = c.uid WHERE (verified IS NULL OR NOT verified) AND (coalesce(n, 0) >= 2 OR (confidence >= 0.85 AND claim_type = 'fact'))""")
def rule_cross_verification(g: Graph) -> DataFrame:
    return rules.verified_by_support(g.claims, g.supports)


@query("""SELECT DISTINCT t.src, s.dst FROM tagged_with t JOIN edges s ON s.type = 'SUBTOPIC_OF' AND s.src = t.dst""")
def rule_parent_topics(g: Graph) -> DataFrame:
    return rules.parent_topics(match.of_types(g.edges, "TAGGED_WITH", "SUBTOPIC_OF"), g.claims, g.nodes).select("src", "dst")


@query("WITH " + PAIRS + f""", x AS (SELECT p.a, p.b, p.shared, x.claim_type AS ta, y.claim_type AS tb, abs(x.confidence - y.confidence) AS d FROM pairs p JOIN claims x ON x.uid = a JOIN claims y ON y.uid = b),
fact AS (SELECT a AS src, b AS dst FROM x WHERE ta = 'fact' AND tb = 'fact' AND d < 0.3 {LINKED}),
linked AS (SELECT src, dst FROM supports UNION SELECT src, dst FROM fact),
e AS (SELECT uid, claim_type, unnest(related_entities) AS m FROM claims)
SELECT * FROM (SELECT 'claim-contradiction-detection' AS rule, count(*) AS n FROM x WHERE ta = tb AND a IN (SELECT dst FROM about) AND b IN (SELECT dst FROM about)
UNION ALL SELECT 'claim-supports-inference', count(*) FROM fact
UNION ALL SELECT 'claim-prediction-track', count(*) FROM (SELECT DISTINCT p.uid, f.uid FROM e p JOIN e f ON p.m = f.m WHERE p.claim_type = 'prediction' AND f.claim_type = 'fact' AND NOT EXISTS (SELECT 1 FROM linked s WHERE s.src = p.uid AND s.dst = f.uid))
UNION ALL SELECT 'tech-dependency-transitivity', count(*) FROM (SELECT DISTINCT a.src, c.dst FROM depends_on a JOIN depends_on c ON a.dst = c.src WHERE a.src <> c.dst AND NOT EXISTS (SELECT 1 FROM depends_on y WHERE y.src = a.src AND y.dst = c.dst))
UNION ALL SELECT 'claim-comparison-link', count(*) FROM x WHERE ta = 'comparison' AND tb = 'comparison' AND shared >= 2 AND NOT EXISTS (SELECT 1 FROM linked s WHERE s.src = a AND s.dst = b)
UNION ALL SELECT 'topic-hierarchy-enrichment', count(*) FROM (SELECT DISTINCT t.src, s.dst FROM tagged_with t JOIN edges s ON s.type = 'SUBTOPIC_OF' AND s.src = t.dst)) WHERE n > 0""")
def rule_engine(g: Graph) -> DataFrame:
    """Edges that each rule infers when all run in order of priority (rules that find nothing here give no row)."""
    chosen = {"claim-contradiction-detection", "claim-supports-inference", "claim-prediction-track", "tech-dependency-transitivity", "claim-comparison-link", "topic-hierarchy-enrichment"}
    known = g.supports.unionByName(g.about).unionByName(g.depends_on).unionByName(match.of_types(g.edges, "TAGGED_WITH", "SUBTOPIC_OF"))
    found = rules.apply_rules(known, g.claims, g.technologies, [r for r in rules.RULES if r.name in chosen])
    return found.groupBy("rule").agg(F.count("*").alias("n"))


@query("""SELECT src, dst, type, CASE type WHEN 'SUBTOPIC_OF' THEN 'hierarchy' WHEN 'DEPENDS_ON' THEN 'structural' WHEN 'DEVELOPS' THEN 'structural' WHEN 'WRITTEN_BY' THEN 'temporal' END AS analysis_space,
CASE type WHEN 'DEPENDS_ON' THEN confidence WHEN 'DEVELOPS' THEN 0.7 WHEN 'WRITTEN_BY' THEN 0.5 END AS confidence,
CASE type WHEN 'DEVELOPS' THEN 'extractor' WHEN 'WRITTEN_BY' THEN 'default' WHEN 'SUBTOPIC_OF' THEN 'manual' END AS source FROM edges WHERE type IN ('SUBTOPIC_OF', 'DEPENDS_ON', 'DEVELOPS', 'WRITTEN_BY')""")
def backfill_edges(g: Graph) -> DataFrame:
    kind = F.col("type")
    holed = match.of_types(g.edges, "SUBTOPIC_OF", "DEPENDS_ON", "DEVELOPS", "WRITTEN_BY")
    holed = holed.withColumn("analysis_space", F.lit(None).cast("string")).withColumn("confidence", F.when(kind == "DEPENDS_ON", F.col("confidence")))
    return rules.backfill(holed.withColumn("source", F.when(kind == "DEVELOPS", "extractor").when(kind == "SUBTOPIC_OF", "manual")))


@query("""SELECT type, count(*) AS n, CASE type WHEN 'DISCUSSES' THEN 'cross' WHEN 'MENTIONS' THEN 'cross' WHEN 'TAGGED_WITH' THEN 'cross' WHEN 'SUBTOPIC_OF' THEN 'hierarchy' WHEN 'DEPENDS_ON' THEN 'structural'
WHEN 'CLAIMS' THEN 'causal' WHEN 'WRITTEN_BY' THEN 'temporal' ELSE 'unknown' END AS space FROM edges GROUP BY type""")
def context_spaces(g: Graph) -> DataFrame:
    return g.edges.groupBy("type").agg(F.count("*").alias("n")).withColumn("space", rules.space_of(F.col("type"), context=True))

"""Queries on claims and their evidence."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators import claims as C
from loomgraph.operators import refine
from loomgraph.plans.bindings import AS_OF, Graph
from loomgraph.plans.registry import query
from loomgraph.plans.session import shared_folder
from loomgraph.sources.versions import Versions

TEXT_DATE = lambda name: F.col(name).cast("string").alias(name)
PAIRS = """entity AS (SELECT uid, unnest(related_entities) AS m FROM claims),
l AS (SELECT uid, m, count(*) AS n FROM entity GROUP BY uid, m),
pairs AS (SELECT l.uid AS a, r.uid AS b, CAST(sum(n) AS BIGINT) AS shared FROM l JOIN (SELECT DISTINCT uid, m FROM entity) r ON l.m = r.m AND l.uid < r.uid GROUP BY l.uid, r.uid)"""


@query("""SELECT uid, claim_type, confidence, CAST(valid_from AS VARCHAR) AS valid_from FROM claims WHERE claims.valid_from <= DATE '2024-06-01' AND (valid_until IS NULL OR valid_until > DATE '2024-06-01')""")
def claims_valid_at(g: Graph) -> DataFrame:
    return C.valid_at(g.claims, "2024-06-01").select("uid", "claim_type", "confidence", TEXT_DATE("valid_from"))


@query("""SELECT uid, claim_type, confidence FROM claims WHERE valid_from <= DATE '2024-09-01' AND (valid_until IS NULL OR valid_until > DATE '2024-09-01')
AND (contains(lower(content), 'tech') OR len(list_filter(related_entities, lambda e: contains(lower(e), 'tech:1'))) > 0) ORDER BY confidence DESC, uid LIMIT 100""")
def claims_on_topic(g: Graph) -> DataFrame:
    found = g.claims.where((F.col("valid_from") <= "2024-09-01") & (F.col("valid_until").isNull() | (F.col("valid_until") > "2024-09-01")))
    found = found.where(F.contains(F.lower("content"), F.lit("tech")) | F.exists("related_entities", lambda e: F.contains(F.lower(e), F.lit("tech:1"))))
    return found.orderBy(F.desc("confidence"), "uid").limit(100).select("uid", "claim_type", "confidence")


@query("""SELECT uid, CAST(valid_from AS VARCHAR) AS day, 'created' AS event FROM claims UNION ALL SELECT uid, CAST(valid_until AS VARCHAR), 'invalidated' FROM claims WHERE valid_until IS NOT NULL""")
def claim_timeline(g: Graph) -> DataFrame:
    return C.timeline(g.claims).select("uid", TEXT_DATE("day"), "event")


DECAYED = f"""CASE WHEN datediff('day', coalesce(last_verified, valid_from), DATE '{AS_OF}') > 0 THEN
greatest(least(confidence * pow(1.0::DOUBLE - coalesce(confidence_decay, 0.1::DOUBLE), datediff('day', coalesce(last_verified, valid_from), DATE '{AS_OF}') / 365.25::DOUBLE), 1.0::DOUBLE), 0.05::DOUBLE) ELSE confidence END"""


@query(f"""SELECT uid, old, round(raw, 3) AS new FROM (SELECT uid, confidence AS old, {DECAYED} AS raw FROM claims WHERE valid_until IS NULL AND confidence > 0.05) WHERE abs(raw - old) >= 0.01""")
def claim_decay(g: Graph) -> DataFrame:
    return C.decay(g.claims, AS_OF)


@query(f"""SELECT uid, claim_type, confidence FROM claims WHERE valid_until IS NULL AND valid_from < DATE '{AS_OF}' - 90 AND (last_verified IS NULL OR last_verified < DATE '{AS_OF}' - 90)""")
def stale_claims(g: Graph) -> DataFrame:
    return C.stale(g.claims, AS_OF).select("uid", "claim_type", "confidence")


@query(f"""SELECT uid, confidence, CAST(datediff('day', valid_from, DATE '{AS_OF}') AS INT) AS age_days FROM claims
WHERE valid_until IS NULL AND confidence < 0.3 AND datediff('day', valid_from, DATE '{AS_OF}') > 180 ORDER BY confidence, uid LIMIT 50""")
def prune_candidates(g: Graph) -> DataFrame:
    return C.prune_candidates(g.claims, AS_OF)


@query("WITH " + PAIRS.replace("FROM claims)", "FROM claims WHERE valid_until IS NULL)", 1) + """
SELECT a, b, shared FROM pairs JOIN claims x ON x.uid = a JOIN claims y ON y.uid = b WHERE x.claim_type = y.claim_type AND abs(x.confidence - y.confidence) > 0.3""")
def conflict_pairs(g: Graph) -> DataFrame:
    return C.conflicts(g.claims)


@query("""WITH f AS (SELECT uid, claim_type, confidence, CASE claim_type WHEN 'fact' THEN 0.9::DOUBLE WHEN 'comparison' THEN 0.8::DOUBLE WHEN 'opinion' THEN 0.7::DOUBLE ELSE 0.55::DOUBLE END AS floor FROM claims)
SELECT * FROM f WHERE confidence < floor""")
def type_floor(g: Graph) -> DataFrame:
    return C.type_floor(g.claims)


@query("""WITH s AS (SELECT dst AS uid, count(*) AS supporters FROM supports GROUP BY dst)
SELECT c.uid, supporters, round(least(confidence + 0.05::DOUBLE * supporters, 0.95::DOUBLE), 6) AS raised FROM claims c JOIN s ON c.uid = s.uid WHERE confidence < 0.95""")
def support_boost(g: Graph) -> DataFrame:
    return C.support_boost(g.claims, g.supports)


@query("""SELECT uid FROM claims WHERE (verified IS NULL OR NOT verified) AND claim_type IN ('fact', 'comparison') AND confidence >= 0.7 AND uid IN (SELECT dst FROM about)
UNION SELECT uid FROM claims WHERE (verified IS NULL OR NOT verified) AND claim_type = 'fact' AND confidence >= 0.8""")
def cross_verify(g: Graph) -> DataFrame:
    return C.cross_verified(g.claims, g.about)


@query("WITH " + PAIRS + """
SELECT DISTINCT a, b FROM pairs JOIN claims x ON x.uid = a JOIN claims y ON y.uid = b JOIN about p ON p.dst = a JOIN about q ON q.dst = b
WHERE x.claim_type = y.claim_type AND x.claim_type IN ('opinion', 'prediction') AND p.src <> q.src
AND NOT EXISTS (SELECT 1 FROM supports s WHERE (s.src = a AND s.dst = b) OR (s.src = b AND s.dst = a))""")
def contradictions(g: Graph) -> DataFrame:
    return C.contradictions(g.claims, g.about, g.supports)


@query("""SELECT c.uid, c.claim_type, a.src AS article, coalesce(s.supporters, 0) AS supporters FROM claims c LEFT JOIN about a ON a.dst = c.uid
LEFT JOIN (SELECT dst, count(*) AS supporters FROM supports GROUP BY dst) s ON s.dst = c.uid WHERE c.claim_type = 'prediction'""")
def claim_sources(g: Graph) -> DataFrame:
    counts = g.supports.groupBy(F.col("dst").alias("uid")).agg(F.count("*").alias("supporters"))
    sources = g.about.select(F.col("dst").alias("uid"), F.col("src").alias("article"))
    out = g.claims.where("claim_type = 'prediction'").join(sources, "uid", "left").join(counts, "uid", "left")
    return out.select("uid", "claim_type", "article", F.coalesce("supporters", F.lit(0)).alias("supporters"))


@query("""WITH entity AS (SELECT uid, claim_type, content, confidence, valid_from, key, valid_until, lower(unnest(related_entities)) AS e FROM claims)
SELECT o.uid, CAST(min(n.valid_from) AS VARCHAR) AS valid_until FROM entity o JOIN entity n ON o.claim_type = n.claim_type AND o.e = n.e AND o.uid <> n.uid AND o.content <> n.content AND o.confidence < n.confidence
WHERE o.valid_until IS NULL AND n.valid_from >= DATE '2024-12-01' GROUP BY o.uid""")
def claim_invalidations(g: Graph) -> DataFrame:
    """The claims of December are the incoming batch."""
    return C.invalidations(g.claims, g.claims.where("valid_from >= DATE '2024-12-01'")).select("uid", TEXT_DATE("valid_until"))


@query("""SELECT uid, 1 AS entries, [coalesce(confidence, 0.5)][1] AS baseline FROM claims WHERE confidence_decay IS NULL""")
def history_init(g: Graph) -> DataFrame:
    """Claims without a history get one entry: their confidence, or 0.5."""
    history = F.array(F.struct(F.col("valid_from").alias("date"), F.coalesce("confidence", F.lit(0.5)).alias("confidence"), F.lit("baseline").alias("reason")))
    return g.claims.where("confidence_decay IS NULL").select("uid", history.alias("history")).select("uid", F.size("history").alias("entries"), F.col("history")[0]["confidence"].alias("baseline"))


@query("""WITH h AS (SELECT uid, row_number() OVER (PARTITION BY uid ORDER BY ts, event_id) AS seq,
  floor(CAST(sum(k) OVER w AS BIGINT) * 100 / count(k) OVER w) / 10000.0::DOUBLE AS confidence FROM evidence WINDOW w AS (PARTITION BY uid ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
e AS (SELECT uid, arg_min(confidence, seq) AS first, arg_max(confidence, seq) AS current FROM h GROUP BY uid)
SELECT uid, first, current, round(current - first, 6) AS change, CASE WHEN current - first > 0 THEN 'rising' ELSE 'falling' END AS direction FROM e WHERE abs(round(current - first, 6)) >= 0.1""")
def claim_trends(g: Graph) -> DataFrame:
    return C.trends(C.confidence_steps(g.events))


@query("""SELECT uid, arg_max(event_type, ts::VARCHAR || lpad(event_id::VARCHAR, 20, '0')) AS state, count(*) AS entries FROM evidence
WHERE ts <= TIMESTAMP '2024-01-15 12:00:00' AND event_type <> 'view' GROUP BY uid""")
def evidence_state_at(g: Graph) -> DataFrame:
    """Views change no state."""
    entries = g.events.select("uid", "ts", F.col("event_id").alias("seq"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("next_state"))
    return C.state_at(entries, "2024-01-15 12:00:00")


@query("""SELECT count(*) AS claims, count(a.dst) AS sourced, count(c.source) AS labelled, count(s.dst) AS evidenced, count(a.dst) >= 0.6 * count(*) AS passed FROM claims c
LEFT JOIN (SELECT DISTINCT dst FROM about) a ON a.dst = c.uid LEFT JOIN (SELECT DISTINCT dst FROM supports) s ON s.dst = c.uid""")
def evidence_coverage(g: Graph) -> DataFrame:
    return C.coverage(g.claims, g.about, g.supports.select(F.col("dst").alias("uid")))


@query("""SELECT strftime(ts, '%Y-%m') AS month, uid, count(*) AS moved FROM evidence WHERE ts < TIMESTAMP '2024-01-16 00:00:00' GROUP BY 1, 2""")
def evidence_cold_storage(g: Graph) -> DataFrame:
    return C.cold_storage(g.events, "2024-01-26", 10).groupBy("month", "uid").agg(F.count("*").alias("moved"))


REFINED = f"""e AS (SELECT src, dst, type, CASE WHEN confidence = 0.9 THEN 'extractor' ELSE 'rule' END AS source FROM depends_on), said AS (SELECT DISTINCT dst AS uid, src AS "by" FROM discusses),
w AS (SELECT e.src, e.dst, e.type, count(DISTINCT x."by") AS n FROM e JOIN said x ON x.uid = e.src JOIN said y ON y.uid = e.dst AND y."by" = x."by" WHERE source = 'extractor' GROUP BY ALL HAVING count(DISTINCT x."by") > 1),
d AS (SELECT *, {DECAYED} AS raw FROM claims), r AS (SELECT * EXCLUDE (confidence, last_verified), confidence AS before, last_verified AS verified_before, valid_until IS NULL AND confidence > 0.05 AND abs(raw - confidence) >= 0.01 AS moved FROM d),
c AS (SELECT *, CASE WHEN moved THEN round(raw, 3) ELSE before END AS confidence, CASE WHEN moved THEN DATE '{AS_OF}' ELSE verified_before END AS last_verified FROM r)"""


def _versioned(g: Graph) -> Versions:
    """Edges and claims as a first version, in a folder of their own."""
    source = F.when((F.col("type") == "DEPENDS_ON") & (F.col("confidence") == 0.9), "extractor").otherwise("rule")
    edges = g.depends_on.unionByName(g.discusses).select("src", "dst", "type", source.alias("source"), F.lit(None).cast("double").alias("weight"))
    claims = g.claims.drop("content", "key").withColumn("history", F.lit(None).cast(f"array<{refine.ENTRY}>"))
    return Versions.create(g.spark, f"{shared_folder(g.spark)}/versions-{uuid.uuid4().hex}", {"edges": edges, "claims": claims})


@query(f"""WITH {REFINED}, x AS (SELECT DISTINCT uid, claim_type, confidence, lower(unnest(related_entities)) AS entity FROM c WHERE valid_until IS NULL)
SELECT (SELECT count(*) FROM e JOIN w USING (src, dst, type) WHERE source = 'extractor') AS weights_updated, (SELECT count(*) FROM c WHERE moved) AS confidence_decayed,
  (SELECT count(*) FROM (SELECT DISTINCT a.uid, b.uid FROM x a JOIN x b ON a.entity = b.entity AND a.claim_type = b.claim_type AND a.uid < b.uid AND abs(a.confidence - b.confidence) > 0.3)) AS conflicts_found,
  (SELECT count(*) FROM c WHERE valid_from < DATE '{AS_OF}' - 180 AND confidence < 0.3 AND (last_verified IS NULL OR last_verified < DATE '{AS_OF}' - 180)) AS prune_candidates""")
def refined_graph(g: Graph) -> DataFrame:
    """What a whole refinement changes and finds, step by step over versions of the tables."""
    return refine.refine(_versioned(g), AS_OF)


@query(f"""WITH {REFINED} SELECT uid, CASE WHEN moved THEN 2 ELSE 1 END AS entries, coalesce(before, 0.5) AS baseline, coalesce(confidence, 0.5) AS latest, CASE WHEN moved THEN 'temporal decay' ELSE 'initial baseline' END AS reason FROM c""")
def claim_histories(g: Graph) -> DataFrame:
    """The histories of all claims once a refinement has begun and appended them."""
    tables = _versioned(g)
    refine.refine(tables, AS_OF)
    last = F.element_at("history", -1)
    return tables.read("claims").select("uid", F.size("history").alias("entries"), F.col("history")[0]["confidence"].alias("baseline"), last["confidence"].alias("latest"), last["reason"].alias("reason"))

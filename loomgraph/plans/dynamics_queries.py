"""Queries for simulation, causal structure and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators import cascade, pair_compiler
from loomgraph.operators import causal as K
from loomgraph.operators import scoring as S
from loomgraph.operators import simulate as M
from loomgraph.plans.bindings import AS_OF, Graph
from loomgraph.plans.registry import query

TEXT_DATE = lambda name: F.col(name).cast("string").alias(name)

WORLD = """sn AS (SELECT uid, kind, brand, (size - 25) / 25.0::DOUBLE AS stance, (key % 7) / 10.0::DOUBLE AS volatility, 0.3::DOUBLE + (key % 5) / 10.0::DOUBLE AS susceptibility, (key % 100) / 100.0::DOUBLE AS influence, (key % 4) / 4.0::DOUBLE AS activity FROM technologies),
se AS (SELECT uid AS src, 'tech:' || (key // 3) AS dst, 'INFLUENCES' AS type, 0.9::DOUBLE AS weight FROM technologies WHERE key % 3 = 0 AND key > 0 UNION ALL SELECT uid, 'tech:' || (key // 4), 'COMPETES_WITH', 0.8::DOUBLE FROM technologies WHERE key % 4 = 1 AND key > 1
  UNION ALL SELECT 'tech:' || (key // 2), uid, 'DEPENDS_ON', 0.7::DOUBLE FROM technologies WHERE key > 0)"""


def _world(g: Graph) -> tuple[DataFrame, DataFrame]:
    key, tech = F.col("key"), lambda c: F.concat(F.lit("tech:"), F.floor(c).cast("string"))
    t = g.technologies
    nodes = t.select("uid", "name", "kind", "brand", ((F.col("size") - 25) / 25.0).alias("stance"), (key % 7 / 10.0).alias("volatility"), (F.lit(0.3) + key % 5 / 10.0).alias("susceptibility"), (key % 100 / 100.0).alias("influence"), (key % 4 / 4.0).alias("activity"))
    make = lambda df, src, dst, kind, w: df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type"), F.lit(w).alias("weight"))
    edges = make(t.where("key % 3 = 0 AND key > 0"), F.col("uid"), tech(key / 3), "INFLUENCES", 0.9)
    edges = edges.unionAll(make(t.where("key % 4 = 1 AND key > 1"), F.col("uid"), tech(key / 4), "COMPETES_WITH", 0.8))
    return nodes, edges.unionAll(make(t.where("key > 0"), tech(key / 2), F.col("uid"), "DEPENDS_ON", 0.7))


def _levels() -> str:
    out = WORLD + """, s0 AS (SELECT uid, 1.0::DOUBLE AS effect FROM sn WHERE brand = 'Brand#7'), v0 AS (SELECT uid FROM s0)"""
    for d in (1, 2, 3):
        out += f""", t{d} AS (SELECT src, dst, type, f.effect * 0.6::DOUBLE * weight * susceptibility * CASE WHEN type = 'COMPETES_WITH' THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS effect FROM s{d - 1} f JOIN se ON se.src = f.uid JOIN sn ON sn.uid = se.dst),
l{d} AS (SELECT src AS source, dst AS target, effect, {d} AS distance, type, dst AS uid FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY src, type) AS k FROM t{d} WHERE abs(effect) >= 0.01 AND dst NOT IN (SELECT uid FROM v{d - 1})) WHERE k = 1),
s{d} AS (SELECT uid, effect FROM l{d}), v{d} AS (SELECT uid FROM v{d - 1} UNION ALL SELECT uid FROM l{d})"""
    return out + """, ef AS (SELECT source, target, effect, distance, type, CASE type WHEN 'DEPENDS_ON' THEN 'volatility' ELSE 'stance' END AS property FROM (SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3))"""


def _effects(g: Graph) -> tuple[DataFrame, DataFrame, DataFrame]:
    nodes, edges = _world(g)
    seeds = nodes.where("brand = 'Brand#7'").select("uid", F.lit(1.0).alias("effect"))
    return nodes, edges, M.propagate(seeds, edges, nodes)


@query("WITH " + _levels() + " SELECT source, target, round(effect, 6) AS effect, distance, type, property FROM ef")
def propagate_influence(g: Graph) -> DataFrame:
    return _effects(g)[2].withColumn("effect", F.round("effect", 6))


@query("WITH " + _levels() + """ SELECT 'all' AS part, count(DISTINCT target) AS affected FROM ef UNION ALL SELECT 'distance ' || distance, count(DISTINCT target) FROM ef GROUP BY distance UNION ALL SELECT type, count(DISTINCT target) FROM ef GROUP BY type""")
def blast_radius(g: Graph) -> DataFrame:
    return M.blast_radius(_effects(g)[2])


APPLIED = """ap AS (SELECT target, property, CASE property WHEN 'stance' THEN stance ELSE volatility END AS old,
CASE property WHEN 'stance' THEN greatest(-1.0::DOUBLE, least(1.0::DOUBLE, stance + effect)) ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, volatility + abs(effect))) END AS new FROM ef JOIN sn ON sn.uid = target)"""


@query("WITH " + _levels() + f", {APPLIED} SELECT target, property, round(old, 6) AS old, round(new, 6) AS new, round(new - old, 6) AS delta FROM ap")
def applied_effects(g: Graph) -> DataFrame:
    nodes, _, effects = _effects(g)
    return M.apply_effects(nodes, effects).select("target", "property", *[F.round(c, 6).alias(c) for c in ("old", "new", "delta")])


@query("WITH " + _levels() + f", {APPLIED} SELECT substr(sha256(target || '|' || property || '|{AS_OF}'), 1, 12) AS id, target, CASE WHEN new - old > 0 THEN 'up' ELSE 'down' END AS direction, round(abs(new - old), 6) AS size, CAST(DATE '{AS_OF}' + 90 AS VARCHAR) AS due FROM ap")
def predictions(g: Graph) -> DataFrame:
    nodes, _, effects = _effects(g)
    return M.predictions(M.apply_effects(nodes, effects), AS_OF).withColumn("due", F.col("due").cast("string"))


@query("WITH " + _levels() + f""", {APPLIED}, m AS (SELECT DISTINCT target, source FROM ef), c AS (SELECT ap.target AS uid, m.source, new - old AS delta FROM ap JOIN m ON m.target = ap.target),
b AS (SELECT brand AS community, count(DISTINCT sn.uid) AS members, round(avg(delta), 6) AS mean_delta FROM sn LEFT JOIN c ON c.uid = sn.uid GROUP BY brand),
w AS (SELECT brand AS community, source, round(sum(abs(delta)), 6) AS w FROM sn JOIN c ON c.uid = sn.uid GROUP BY brand, source), r AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY w DESC, source) AS k FROM w)
SELECT b.*, r.source AS main_source FROM b LEFT JOIN r ON r.community = b.community AND k = 1""")
def tier_changes(g: Graph) -> DataFrame:
    nodes, _, effects = _effects(g)
    moved = M.apply_effects(nodes, effects).join(effects.select("target", "source").distinct(), "target").select(F.col("target").alias("uid"), "source", "delta")
    tiers = nodes.select("uid", F.lit("C1").alias("tier"), F.col("brand").alias("community"))
    return K.tier_changes(moved, tiers).select("community", "members", "mean_delta", "main_source")


@query("""WITH e AS (SELECT event_id AS event, 'user:' || user_id AS uid, event_type AS kind, CAST(json_extract_string(props, '$.k') AS INT) / 100.0::DOUBLE AS magnitude, value / 500.0::DOUBLE AS weight FROM events)
SELECT uid, count(*) AS hits, CAST(round(sum(magnitude * weight * 0.5::DOUBLE * CASE kind WHEN 'purchase' THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END) * 1e8) AS BIGINT) AS delta_e8, CAST(round(least(1.0::DOUBLE, 0.1::DOUBLE + coalesce(sum(magnitude * weight * 0.5::DOUBLE) FILTER (WHERE kind = 'purchase'), 0)) * 1e8) AS BIGINT) AS volatility_e8
FROM e WHERE kind IN ('purchase', 'click') GROUP BY uid""")
def injected_events(g: Graph) -> DataFrame:
    """Purchases hit their user directly; clicks, which have no direct target, half as much and without stirring. Sums in hundred-millionths, which these values fill exactly."""
    e = g.events.where("event_type IN ('purchase', 'click')")
    name = F.concat(F.lit("event:"), F.col("event_id").cast("string"))
    happened = e.select(name.alias("event"), (F.col("k") / 100.0).alias("magnitude"))
    edges = e.select(name.alias("src"), F.col("uid").alias("dst"), F.when(F.col("event_type") == "purchase", "IMPACTS").otherwise("INFLUENCES").alias("type"), (F.col("value") / 500.0).alias("weight"))
    users = e.select("uid").distinct().select("uid", F.lit(0.5).alias("susceptibility"), F.lit(0.1).alias("volatility"))
    hits = M.inject(happened, edges, users)
    total = hits.groupBy("uid").agg(F.count("*").alias("hits"), F.round(F.sum("delta") * 1e8).cast("bigint").alias("delta_e8"))
    return total.join(M.stirred(users, hits).select("uid", F.round(F.col("volatility") * 1e8).cast("bigint").alias("volatility_e8")), "uid")


@query("""WITH e AS (SELECT event_id, CASE WHEN event_type = 'error' THEN 5 ELSE 0 END AS round FROM events WHERE event_type IN ('error', 'signup')), n AS (SELECT greatest(1, count(*)) AS n FROM e WHERE round <= 0)
SELECT event_id AS event, round FROM e WHERE round > 0 UNION ALL SELECT event_id, CAST(least(1 + (row_number() OVER (ORDER BY event_id) - 1) * greatest(1, 17 // n), 18) AS INT) FROM e, n WHERE round <= 0""")
def scheduled_events(g: Graph) -> DataFrame:
    e = g.events.where("event_type IN ('error', 'signup')").select(F.col("event_id").alias("event"), F.when(F.col("event_type") == "error", 5).otherwise(0).alias("round"))
    return M.schedule(e, 20)


RULES = [M.PairRule("opposition", "stance", ">", 1.2), M.PairRule("dominance", "influence", ">=", 0.02, absolute=False), M.PairRule("rivalry", "stance", ">", 0.1, linked="COMPETES_WITH")]


@query(f"WITH {WORLD}, t AS (SELECT *, row_number() OVER (ORDER BY influence DESC, uid) AS i FROM sn), p AS (SELECT a.uid AS a, b.uid AS b, a.stance - b.stance AS ds, a.influence - b.influence AS di FROM t a JOIN t b ON a.i < b.i WHERE b.i <= 50)" + """
SELECT 'opposition' AS rule, a, b FROM p WHERE abs(ds) > 1.2 UNION ALL SELECT 'dominance', a, b FROM p WHERE di >= 0.02
UNION ALL SELECT 'rivalry', a, b FROM p WHERE abs(ds) > 0.1 AND EXISTS (SELECT 1 FROM se WHERE type = 'COMPETES_WITH' AND ((src = a AND dst = b) OR (src = b AND dst = a)))""")
def pair_rules(g: Graph) -> DataFrame:
    nodes, edges = _world(g)
    return M.fire(RULES, nodes, edges)


COMPILED = """cn AS (SELECT uid, key, CASE kind WHEN 'promo' THEN 'Investor' WHEN 'small' THEN 'Event' ELSE kind END AS object_type, CASE WHEN key % 6 = 0 THEN '' ELSE 'c' || (key // 20) END AS community_id, (size - 25) / 25.0::DOUBLE AS stance,
  (key % 11) / 10.0::DOUBLE AS volatility, (key % 100) / 100.0::DOUBLE AS influence, key % 2 = 0 AS is_active, (key % 10) / 10.0::DOUBLE AS magnitude FROM technologies),
ce AS (SELECT src, dst, type FROM se UNION ALL SELECT 'tech:' || key, 'tech:' || (key + 1), 'LEADS_TO' FROM cn WHERE key % 4 = 0 UNION ALL SELECT 'tech:' || key, 'tech:' || (key // 3), 'OPPOSES' FROM cn WHERE key % 9 = 0 AND key > 0
  UNION ALL SELECT 'tech:' || key, 'tech:' || (key + 1), 'ALLIED_WITH' FROM cn WHERE key % 7 = 0)"""


def _rule_world(g: Graph) -> tuple[DataFrame, DataFrame]:
    key, tech, t = F.col("key"), lambda c: F.concat(F.lit("tech:"), F.floor(c).cast("string")), g.technologies
    kind = F.when(F.col("kind") == "promo", "Investor").when(F.col("kind") == "small", "Event").otherwise(F.col("kind"))
    community = F.when(key % 6 == 0, "").otherwise(F.concat(F.lit("c"), F.floor(key / 20).cast("string")))
    nodes = t.select("uid", kind.alias("object_type"), community.alias("community_id"), ((F.col("size") - 25) / 25.0).alias("stance"), (key % 11 / 10.0).alias("volatility"), (key % 100 / 100.0).alias("influence_score"), (key % 2 == 0).alias("is_active"), (key % 10 / 10.0).alias("magnitude"))
    more = lambda rows, to, kind: t.where(rows).select(F.col("uid").alias("src"), tech(to).alias("dst"), F.lit(kind).alias("type"))
    edges = _world(g)[1].select("src", "dst", "type").unionAll(more("key % 4 = 0", key + 1, "LEADS_TO")).unionAll(more("key % 9 = 0 AND key > 0", key / 3, "OPPOSES")).unionAll(more("key % 7 = 0", key + 1, "ALLIED_WITH"))
    return nodes, edges


@query(f"WITH {WORLD}, {COMPILED}," + """ p AS (SELECT DISTINCT s.uid AS source, t.uid AS target, e.type, s.key, s.stance, s.influence, s.object_type, s.is_active, s.magnitude, t.volatility AS t_volatility, t.object_type AS t_type
  FROM ce e JOIN cn s ON s.uid = e.src JOIN cn t ON t.uid = e.dst WHERE e.src <> e.dst), near AS (SELECT src, dst FROM ce UNION SELECT dst, src FROM ce),
h AS (SELECT DISTINCT 'opposition' AS rule, 10 AS priority, source, target FROM p WHERE key % 3 = 0 AND type IN ('INFLUENCES', 'COMPETES_WITH', 'DEPENDS_ON') AND stance > 0.6 AND NOT EXISTS (SELECT 1 FROM ce o WHERE o.src = source AND o.dst = target AND o.type = 'OPPOSES')
UNION ALL SELECT DISTINCT 'influence_propagation', 6, source, target FROM p WHERE key % 3 = 0 AND type = 'INFLUENCES' AND influence > 0.7
UNION ALL SELECT DISTINCT 'dependency_crisis', 7, source, target FROM p WHERE key % 4 = 0 AND type = 'DEPENDS_ON' AND t_volatility > 0.5
UNION ALL SELECT DISTINCT 'event_chain', 10, source, target FROM p WHERE key % 5 = 0 AND type = 'LEADS_TO' AND object_type = 'Event' AND t_type = 'Event' AND is_active AND magnitude > 0.5
UNION ALL SELECT 'flight_to_safety', 9, src, dst FROM near JOIN cn s ON s.uid = src JOIN cn t ON t.uid = dst WHERE src <> dst AND s.key % 4 = 0 AND s.volatility > 0.7 AND s.object_type IN ('Investor', 'ForeignInvestor', 'InstitutionalInvestor'))
SELECT * FROM h""")
def rules_on_change(g: Graph) -> DataFrame:
    """Pairs that the rules on change hit, where every third stance, fourth volatility and fifth activity changed."""
    key = F.substring("uid", 6, 20).cast("bigint")
    nodes, edges = _rule_world(g)
    watched = [(3, "stance"), (4, "volatility"), (5, "is_active")]
    changes = g.technologies.select("uid", F.explode(F.array_compact(F.array(*[F.when(key % n == 0, F.lit(p)) for n, p in watched]))).alias("property"))
    return pair_compiler.fired_on_change(changes, nodes, edges)


@query(f"WITH {WORLD}, {COMPILED}," + """ p AS (SELECT s.uid AS source, t.uid AS target, abs(s.stance - t.stance) AS apart FROM cn s JOIN cn t ON s.community_id = t.community_id AND s.uid < t.uid WHERE s.community_id <> '')
SELECT 'alliance' AS rule, 8 AS priority, source, target FROM p WHERE apart < 0.2 AND NOT EXISTS (SELECT 1 FROM ce o WHERE o.src = source AND o.dst = target AND o.type = 'ALLIED_WITH') UNION ALL SELECT 'community_cohesion', 5, source, target FROM p WHERE apart > 0.3""")
def rules_on_evaluation(g: Graph) -> DataFrame:
    """Pairs that the other rules hit, within communities of twenty."""
    return pair_compiler.fired_on_evaluation(*_rule_world(g))


@query("""WITH RECURSIVE b AS (SELECT dst AS source, src AS target, CASE WHEN confidence = 0.9 THEN 'invalidate_downstream' ELSE 'notify' END AS action FROM depends_on UNION ALL SELECT uid, 'tech:' || (key // 10), 'notify' FROM technologies WHERE key % 10 = 7),
c(root, target, depth, via) USING KEY (root, target) AS (SELECT uid AS root, b.target, 1 AS depth, min(b.source) AS via FROM technologies t JOIN b ON b.source = t.uid WHERE t.key % 20 = 2 GROUP BY uid, b.target
  UNION SELECT c.root, b.target, c.depth + 1, min(b.source) FROM c JOIN b ON b.source = c.target LEFT JOIN recurring.c k ON k.root = c.root AND k.target = b.target WHERE k.root IS NULL AND c.target <> c.root GROUP BY c.root, b.target, c.depth)
SELECT root, c.target, CAST(depth AS INT) AS depth, via, min(action) AS action FROM c JOIN b ON b.source = via AND b.target = c.target GROUP BY ALL""")
def change_cascades(g: Graph) -> DataFrame:
    """What changes of every twentieth technology reach through bindings along dependencies, some of which go round."""
    action = F.when(F.col("confidence") == 0.9, "invalidate_downstream").otherwise("notify")
    bindings = g.depends_on.select(F.col("dst").alias("source"), F.col("src").alias("target"), action.alias("action"))
    back = g.technologies.where("key % 10 = 7").select(F.col("uid").alias("source"), F.concat(F.lit("tech:"), F.floor(F.col("key") / 10).cast("string")).alias("target"), F.lit("notify").alias("action"))
    return cascade.cascade(g.technologies.where("key % 20 = 2").select(F.col("uid").alias("name")), bindings.unionByName(back))


ACTIONS = [
    M.Action("protest", "promo", 5, 2, "volatility", ">", 0.4, "stance", "subtract", 0.3),
    M.Action("invest", "promo", 3, 1, "stance", ">=", 0.0, "stance", "add", 0.2),
    M.Action("wait", "large", 1, 1, "volatility", "<", 0.3, "volatility", "multiply", 0.5),
]


@query(f"WITH {WORLD}, " + """c AS (SELECT uid, 'protest' AS action, 5 AS priority, 'stance' AS property, greatest(-1.0::DOUBLE, least(1.0::DOUBLE, stance - 0.3::DOUBLE)) AS new FROM sn WHERE kind = 'promo' AND activity > 0.1 AND volatility > 0.4
UNION ALL SELECT uid, 'invest', 3, 'stance', greatest(-1.0::DOUBLE, least(1.0::DOUBLE, stance + 0.2::DOUBLE)) FROM sn WHERE kind = 'promo' AND activity > 0.1 AND stance >= 0
UNION ALL SELECT uid, 'wait', 1, 'volatility', volatility * 0.5::DOUBLE FROM sn WHERE kind = 'large' AND activity > 0.1 AND volatility < 0.3), r AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY priority DESC, action) AS k FROM c)
SELECT uid, action, 1 AS round, property, round(new, 6) AS new FROM r WHERE k = 1""")
def resolved_actions(g: Graph) -> DataFrame:
    return M.act(_world(g)[0], ACTIONS, None, 1).withColumn("new", F.round("new", 6))


@query(f"WITH {WORLD} SELECT 'stance' AS kind, count(*) FILTER (WHERE stance NOT BETWEEN -1 AND 1) AS n FROM sn UNION ALL SELECT 'volatility', count(*) FILTER (WHERE volatility NOT BETWEEN 0 AND 1) FROM sn UNION ALL SELECT 'loop', count(*) FROM se WHERE src = dst")
def invariant_violations(g: Graph) -> DataFrame:
    return M.violations(*_world(g))


@query()
def simulated_rounds(g: Graph) -> DataFrame:
    """Three rounds over all technologies; no SQL oracle, tested on hand-made graphs."""
    nodes, edges = _world(g)
    events = nodes.where("brand = 'Brand#3'").select(F.col("uid").alias("event"), F.lit(0.8).alias("magnitude"), F.lit(1).alias("round"))
    return M.simulate(nodes, edges, events, ACTIONS, 3)[1]


DAG = "dag AS (SELECT src, dst, sum(confidence) AS weight FROM depends_on GROUP BY src, dst)"


def _dag(g: Graph) -> DataFrame:
    return K.causal_edges(g.depends_on.withColumnRenamed("confidence", "weight"))


@query(f"WITH {DAG} SELECT src, dst, round(weight, 6) AS weight FROM dag")
def causal_edges(g: Graph) -> DataFrame:
    return _dag(g).withColumn("weight", F.round("weight", 6))


CLOSED = f"WITH RECURSIVE {DAG}, cl AS (SELECT src, dst FROM dag UNION SELECT cl.src, dag.dst FROM cl JOIN dag ON dag.src = cl.dst)"


@query(CLOSED + " SELECT src AS uid, count(*) AS descendants FROM cl WHERE src NOT IN (SELECT dst FROM dag) GROUP BY src")
def root_causes(g: Graph) -> DataFrame:
    return K.roots(_dag(g))


@query(CLOSED + " SELECT dst AS uid, count(*) AS ancestors FROM cl WHERE dst NOT IN (SELECT src FROM dag) GROUP BY dst")
def terminal_effects(g: Graph) -> DataFrame:
    return K.terminals(_dag(g))


PATHS = f"WITH RECURSIVE {DAG}, pa AS (SELECT src AS root, dst AS target, weight AS product, weight AS total, 1 AS steps FROM dag WHERE src NOT IN (SELECT dst FROM dag) UNION ALL SELECT root, dag.dst, product * weight, total + weight, steps + 1 FROM pa JOIN dag ON dag.src = target WHERE steps < "


def _roots(g: Graph) -> DataFrame:
    dag = _dag(g)
    return dag.select(F.col("src").alias("uid")).distinct().join(dag.select(F.col("dst").alias("uid")), "uid", "left_anti")


@query(PATHS + "6) SELECT root, target, round(sum(product), 4) AS impact FROM pa GROUP BY root, target")
def root_impact(g: Graph) -> DataFrame:
    return K.path_sums(_roots(g), _dag(g))


@query(PATHS + "1000), b AS (SELECT root, target, product, row_number() OVER (PARTITION BY root, target ORDER BY total, product) AS k FROM pa) SELECT root AS uid, round(sum(product), 4) AS total FROM b WHERE k = 1 GROUP BY root")
def total_impact(g: Graph) -> DataFrame:
    return K.lightest_path_products(_roots(g), _dag(g)).groupBy(F.col("root").alias("uid")).agg(F.round(F.sum("product"), 4).alias("total"))


@query(PATHS + "8), b AS (SELECT root, target AS terminal, total, steps, row_number() OVER (PARTITION BY root, target ORDER BY total DESC, steps) AS k FROM pa WHERE target NOT IN (SELECT src FROM dag)) SELECT root, terminal, round(total, 6) AS weight, steps FROM b WHERE k = 1 ORDER BY weight DESC, root, terminal LIMIT 10")
def causal_chains(g: Graph) -> DataFrame:
    return K.chains(_dag(g))


@query(f"WITH RECURSIVE {DAG}, w AS (SELECT dst AS uid, src AS dependent, 1 AS depth FROM dag UNION SELECT w.uid, dag.src, depth + 1 FROM w JOIN dag ON dag.dst = w.dependent), m AS (SELECT uid, dependent, min(depth) AS depth FROM w GROUP BY uid, dependent) SELECT uid, depth AS distance, count(*) AS dependents FROM m GROUP BY uid, depth")
def dependency_impact(g: Graph) -> DataFrame:
    reverse = _dag(g).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return K.closure(reverse).groupBy(F.col("src").alias("uid"), "distance").agg(F.count("*").alias("dependents"))


@query()
def acyclic_edges(g: Graph) -> DataFrame:
    """Influences with the weakest edge of each cycle dropped; tested on hand-made graphs."""
    edges = _world(g)[1].groupBy("src", "dst").agg(F.sum("weight").alias("weight")).where("src <> dst")
    return K.without_cycles(edges, longest=4)


@query("""WITH t AS (SELECT event_type AS name, event_id AS seq, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS k FROM events), v AS (SELECT name, count(*) AS n, list_sort(list(value)) AS v FROM t WHERE k <= 1000 GROUP BY name)
SELECT name, n, v[CAST(least(n - 1, floor(n * 50 / 100)) AS INT) + 1] AS p50, v[CAST(least(n - 1, floor(n * 95 / 100)) AS INT) + 1] AS p95, v[CAST(least(n - 1, floor(n * 99 / 100)) AS INT) + 1] AS p99 FROM v""")
def latency_percentiles(g: Graph) -> DataFrame:
    return S.latency_percentiles(g.events.select(F.col("event_type").alias("name"), F.col("event_id").alias("seq"), "value"))


DECISIONS = "de AS (SELECT 'user:' || user_id AS uid, event_id AS seq, 'p' || (CAST(json_extract_string(props, '$.k') AS INT) // 10) AS pattern, CASE event_type WHEN 'purchase' THEN 'approved' WHEN 'error' THEN 'rejected' ELSE 'deferred' END AS decision FROM events)"


def _decisions(g: Graph) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", "approved").when(F.col("event_type") == "error", "rejected").otherwise("deferred")
    return g.events.select("uid", F.col("event_id").alias("seq"), F.concat(F.lit("p"), F.floor(F.col("k") / 10).cast("string")).alias("pattern"), kind.alias("decision"))


@query(f"WITH {DECISIONS}, c AS (SELECT pattern, count(*) FILTER (WHERE decision = 'approved') AS approved, count(*) FILTER (WHERE decision = 'rejected') AS rejected FROM de GROUP BY pattern) SELECT *, CASE WHEN approved + rejected > 0 THEN round(approved / (approved + rejected)::DOUBLE, 2) ELSE 0.0 END AS confidence FROM c")
def pattern_confidence(g: Graph) -> DataFrame:
    return S.pattern_confidence(_decisions(g))


@query(f"WITH {DECISIONS} SELECT uid, arg_max(decision, seq) AS decision, count(*) AS n FROM de GROUP BY uid")
def latest_decision(g: Graph) -> DataFrame:
    return S.latest_decision(_decisions(g))


@query("""WITH d AS (SELECT event_type AS name, CAST(ts AS DATE) AS step, round(avg(value), 6) AS value FROM events GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY step) AS k, count(*) OVER (PARTITION BY name) AS n FROM d),
h AS (SELECT name, max(n) AS n, round(avg(value) FILTER (WHERE k <= n // 2), 6) AS first, round(avg(value) FILTER (WHERE k > n // 2), 6) AS second FROM k WHERE n >= 6 GROUP BY name)
SELECT *, CASE WHEN second > first * 1.1 THEN 'rising' WHEN second < first * 0.9 THEN 'falling' ELSE 'steady' END AS trend FROM h""")
def metric_trend(g: Graph) -> DataFrame:
    daily = g.events.groupBy(F.col("event_type").alias("name"), F.col("ts").cast("date").alias("step")).agg(F.round(F.avg("value"), 6).alias("value"))
    return S.half_trend(daily)


@query("""WITH a AS (SELECT user_id, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-11' GROUP BY user_id), b AS (SELECT user_id, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-21' GROUP BY user_id)
SELECT 'user:' || coalesce(a.user_id, b.user_id) AS uid, coalesce(a.n, 0) AS before, coalesce(b.n, 0) AS after, coalesce(b.n, 0) - coalesce(a.n, 0) AS change FROM a FULL JOIN b ON a.user_id = b.user_id WHERE coalesce(b.n, 0) <> coalesce(a.n, 0)""")
def snapshot_difference(g: Graph) -> DataFrame:
    upto = lambda day: g.events.where(F.col("ts") < F.lit(day).cast("timestamp"))
    return S.snapshot_difference(upto("2024-01-11"), upto("2024-01-21"), "uid")


@query("""WITH h AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS changes, count(*) FILTER (WHERE event_type = 'error' AND value > 150) AS reverts, count(*) AS seen FROM events GROUP BY user_id)
SELECT 'user:' || user_id AS uid, round(CASE WHEN reverts > 0 THEN 0.0 WHEN changes > 0 THEN greatest(0.3::DOUBLE, 1.0::DOUBLE - 0.2::DOUBLE * changes) ELSE 1.0 END, 6) AS score FROM h""")
def survival_scores(g: Graph) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "change").when((F.col("event_type") == "error") & (F.col("value") > 150), "revert").otherwise("seen")
    seen = g.events.select("uid", F.lit("seen").alias("kind"))
    return S.survival(g.events.select("uid", kind.alias("kind")).unionAll(seen))


CANDIDATES = """ca AS (SELECT 'org:' || s_suppkey AS uid, count(*) AS stars, count(*) FILTER (WHERE l_returnflag = 'R') AS forks, count(*) FILTER (WHERE l_discount > 0.08) AS open_issues, CAST(max(l_shipdate) AS DATE) AS last_commit, CASE WHEN any_value(s_acctbal) > 2000 THEN 'MIT' END AS license,
any_value(s_name) || ' agent for prediction and analysis, install and usage' AS readme, any_value(s_name) AS description, list_sort(list(DISTINCT p_type)) AS topics, any_value(s_acctbal) > 5000 AS has_ci, any_value(s_nationkey) > 10 AS has_tests
FROM supplier JOIN lineitem ON l_suppkey = s_suppkey JOIN part ON p_partkey = l_partkey GROUP BY s_suppkey)"""


@query(f"WITH {CANDIDATES}, " + """s AS (SELECT *, datediff('day', last_commit, DATE '2001-12-31') AS age, greatest(stars, 1)::DOUBLE AS st, lower(concat_ws(' ', description, array_to_string(topics, ' '), readme)) AS txt FROM ca),
t AS (SELECT *, least(least(forks / st / 0.3::DOUBLE, 1.0::DOUBLE) * 0.3::DOUBLE + CASE WHEN age < 7 THEN 0.3 WHEN age < 30 THEN 0.25 WHEN age < 90 THEN 0.15 ELSE 0.05 END::DOUBLE + least(log10(st) / 4, 1.0::DOUBLE) * 0.2::DOUBLE + CASE WHEN license IS NOT NULL THEN 0.1 ELSE 0 END::DOUBLE + CASE WHEN open_issues / st < 0.05 THEN 0.1 WHEN open_issues / st < 0.1 THEN 0.05 ELSE 0 END::DOUBLE, 1.0::DOUBLE) AS trust,
least(CASE WHEN length(readme) > 200 THEN 0.2 WHEN length(readme) > 50 THEN 0.1 ELSE 0 END::DOUBLE + 0.2::DOUBLE + CASE WHEN has_ci THEN 0.2 ELSE 0 END::DOUBLE + CASE WHEN has_tests THEN 0.2 ELSE 0 END::DOUBLE + CASE WHEN license IS NOT NULL THEN 0.1 ELSE 0 END::DOUBLE + CASE WHEN length(description) > 20 THEN 0.1 ELSE 0 END::DOUBLE, 1.0::DOUBLE) AS quality,
least(len(list_filter(['""" + "', '".join(S.KEYWORDS) + """'], lambda k: contains(txt, k))) / 5.0::DOUBLE, 1.0::DOUBLE) AS relevance,
list_filter([CASE WHEN license IS NULL THEN 'no-license' END, CASE WHEN open_issues > stars * 0.5 THEN 'many-issues' END, CASE WHEN age > 180 THEN 'old' END, CASE WHEN stars > 1000 AND forks < stars * 0.02 THEN 'few-forks' END], lambda x: x IS NOT NULL) AS warns FROM s),
v AS (SELECT *, round(trust * 0.2::DOUBLE + quality * 0.3::DOUBLE + relevance * 0.5::DOUBLE - len(warns) * 0.1::DOUBLE, 9) AS total FROM t)
SELECT uid, round(trust, 2) AS trust, round(quality, 2) AS quality, round(relevance, 2) AS relevance, array_to_string(warns, ',') AS warnings, round(total, 6) AS total, CASE WHEN total >= 0.5 AND len(warns) <= 1 THEN 'adopt' WHEN total >= 0.35 THEN 'study' ELSE 'skip' END AS verdict FROM v""")
def repo_scores(g: Graph) -> DataFrame:
    """Suppliers play candidate repositories, their order lines the stars."""
    joined = g.table("lineitem").join(g.table("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(g.table("part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    own = joined.groupBy("s_suppkey").agg(
        F.count("*").alias("stars"),
        F.count_if(F.col("l_returnflag") == "R").alias("forks"),
        F.count_if(F.col("l_discount") > 0.08).alias("open_issues"),
        F.max("l_shipdate").cast("date").alias("last_commit"),
        F.max("s_acctbal").alias("balance"),
        F.max("s_nationkey").alias("nation"),
        F.max("s_name").alias("description"),
        F.array_sort(F.collect_set("p_type")).alias("topics"),
    )
    candidates = own.select(F.concat(F.lit("org:"), F.col("s_suppkey").cast("string")).alias("uid"), "stars", "forks", "open_issues", "last_commit", F.when(F.col("balance") > 2000, "MIT").alias("license"), F.concat("description", F.lit(" agent for prediction and analysis, install and usage")).alias("readme"), "description", "topics", (F.col("balance") > 5000).alias("has_ci"), (F.col("nation") > 10).alias("has_tests"))
    return S.evaluate(candidates, "2001-12-31")


@query("""WITH n AS (SELECT count(*) AS n, count(name) AS named, count(DISTINCT label) AS labels FROM nodes), e AS (SELECT count(*) AS m, count(confidence) AS sure, count(DISTINCT type) AS types FROM edges),
c AS (SELECT count(*) AS c, count(*) FILTER (WHERE confidence >= 0.5) AS strong, count(last_verified) AS checked FROM claims), l AS (SELECT count(*) AS linked FROM nodes WHERE uid IN (SELECT src FROM edges UNION SELECT dst FROM edges)),
o AS (SELECT * FROM n, e, c, l)
SELECT 'schema' AS dimension, round(least(labels / 6.0::DOUBLE, 1.0::DOUBLE) * 8, 4) AS score, 8 AS most FROM o UNION ALL SELECT 'naming', round(named / n::DOUBLE * 6, 4), 6 FROM o UNION ALL SELECT 'edge_metadata', round(sure / m::DOUBLE * 10, 4), 10 FROM o
UNION ALL SELECT 'edge_types', round(least(types / 8.0::DOUBLE, 1.0::DOUBLE) * 8, 4), 8 FROM o UNION ALL SELECT 'claims', round(strong / c::DOUBLE * 10, 4), 10 FROM o UNION ALL SELECT 'temporal', round(checked / c::DOUBLE * 8, 4), 8 FROM o UNION ALL SELECT 'connectivity', round(linked / n::DOUBLE * 10, 4), 10 FROM o""")
def ontology_score(g: Graph) -> DataFrame:
    return S.dimension_scores(g.nodes, g.edges, g.claims)


@query("""SELECT source, count(*) AS files, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS lines, sum(len(string_split(text, chr(10)))) > 150 AS consolidate FROM documents GROUP BY source""")
def memory_stats(g: Graph) -> DataFrame:
    lines = F.sum(F.size(F.split("text", "\n"))).cast("bigint")
    return g.table("documents").groupBy("source").agg(F.count("*").alias("files"), lines.alias("lines")).withColumn("consolidate", F.col("lines") > 150)


@query("""SELECT relevance, CASE relevance WHEN 'must-read' THEN 0 WHEN 'recommended' THEN 1 ELSE 2 END AS rank, count(*) AS n, CAST(max(published_date) AS VARCHAR) AS newest FROM articles GROUP BY relevance""")
def digest(g: Graph) -> DataFrame:
    rank = F.when(F.col("relevance") == "must-read", 0).when(F.col("relevance") == "recommended", 1).otherwise(2)
    return g.articles.groupBy("relevance", rank.alias("rank")).agg(F.count("*").alias("n"), F.max("published_date").cast("string").alias("newest"))


@query(r"""SELECT regexp_replace(regexp_replace(url, '[?#].*$', ''), '/$', '') AS link, min(page_id) AS page_id, count(*) AS n FROM pages GROUP BY 1""")
def first_links(g: Graph) -> DataFrame:
    """Each link without query and fragment, where it is first seen."""
    link = F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "/$", "")
    return g.table("pages").groupBy(link.alias("link")).agg(F.min("page_id").alias("page_id"), F.count("*").alias("n"))

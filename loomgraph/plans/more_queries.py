"""Queries for repair, backlogs, community links and small reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators import causal, communities, match, repair
from loomgraph.plans.bindings import Graph
from loomgraph.plans.dynamics_queries import DAG, _dag
from loomgraph.plans.registry import query
from loomgraph.plans.structure_queries import CHANGES, INFLUENCES, _changes, _influences, life_cycles


@query("""SELECT uid, trim(name) AS name, CASE WHEN kind IN ('promo', 'small', 'large') THEN kind ELSE 'Concept' END AS kind, CASE WHEN size > 25 THEN brand ELSE name END AS description,
round(coalesce(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (size - 25) / 12.0::DOUBLE)), 0.5), 6) AS stance, round(coalesce(CASE WHEN size < 40 THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, size / 30.0::DOUBLE)) END, 0.5), 6) AS volatility FROM technologies""")
def repaired_entities(g: Graph) -> DataFrame:
    raw = g.technologies.select("uid", "name", "kind", F.when(F.col("size") > 25, F.col("brand")).alias("description"), ((F.col("size") - 25) / 12.0).alias("stance"), F.when(F.col("size") < 40, F.col("size") / 30.0).alias("volatility"))
    return repair.repaired_entities(raw, ["promo", "small", "large"]).withColumns({"stance": F.round("stance", 6), "volatility": F.round("volatility", 6)})


@query("""WITH n AS (SELECT DISTINCT CASE key % 3 WHEN 0 THEN name WHEN 1 THEN upper(name) ELSE string_split(name, ' ')[1] || ' thing' END AS name FROM technologies), k AS (SELECT DISTINCT name AS entity FROM technologies),
a AS (SELECT name, entity, 1 AS way FROM n JOIN k ON name = entity UNION ALL SELECT name, entity, 2 FROM n JOIN k ON lower(name) = lower(entity) UNION ALL SELECT name, entity, 3 FROM n JOIN k ON list_contains(string_split(lower(entity), ' '), string_split(lower(name), ' ')[1])),
r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY way, entity) AS j FROM a) SELECT name, entity, way FROM r WHERE j = 1""")
def resolved_names(g: Graph) -> DataFrame:
    """Names as texts spell them: the same, in capitals, or only alike in the first word."""
    spelled = F.when(F.col("key") % 3 == 0, F.col("name")).when(F.col("key") % 3 == 1, F.upper("name")).otherwise(F.concat(F.element_at(F.split("name", " "), 1), F.lit(" thing")))
    return repair.resolved_names(g.technologies.select(spelled.alias("name")).distinct(), g.technologies)


@query("""WITH o AS (SELECT uid, unnest(related_entities) AS e, generate_subscripts(related_entities, 1) AS i FROM claims)
SELECT uid, coalesce(string_agg(e, ',' ORDER BY i) FILTER (WHERE e NOT IN (SELECT uid FROM technologies WHERE kind = 'promo')), '') AS entities FROM o GROUP BY uid""")
def claims_without_banned(g: Graph) -> DataFrame:
    banned = g.technologies.where("kind = 'promo'").select("uid")
    return repair.without(g.technologies, g.depends_on, g.claims.select("uid", "related_entities"), banned)[2].select("uid", F.array_join("related_entities", ",").alias("entities"))


@query("SELECT a.uid, coalesce(n, 0) AS n FROM articles a LEFT JOIN (SELECT src, count(*) AS n FROM discusses GROUP BY src) d ON d.src = a.uid WHERE coalesce(n, 0) <= 2 AND length(title) >= 10")
def under_extracted(g: Graph) -> DataFrame:
    return repair.under_extracted(g.articles, g.discusses, 2, 10)


@query("SELECT uid, title FROM articles WHERE uid NOT IN (SELECT src FROM about)")
def articles_without_claims(g: Graph) -> DataFrame:
    return g.articles.join(g.about.select(F.col("src").alias("uid")), "uid", "left_anti").select("uid", "title")


@query("SELECT claim_type, count(valid_from) AS created, count(valid_until) AS expired, count(valid_from) - count(valid_until) AS net FROM claims GROUP BY claim_type")
def claim_dynamics(g: Graph) -> DataFrame:
    return repair.dynamics(g.claims, "claim_type", "valid_from", "valid_until")


@query(f"""WITH RECURSIVE {INFLUENCES}, p AS (SELECT src AS start, dst AS node, [src, dst] AS path FROM i WHERE dst > src UNION ALL SELECT start, i.dst, list_append(path, i.dst) FROM p JOIN i ON i.src = p.node WHERE len(path) < 5 AND i.dst > start AND NOT list_contains(path, i.dst)),
c AS (SELECT path FROM p JOIN i ON i.src = p.node AND i.dst = p.start), d AS (SELECT array_to_string(path, '>') AS path, unnest(path) AS uid, generate_subscripts(path, 1) AS j, len(path) AS n FROM c),
v AS (SELECT d.path, j, d.n, coalesce((size - 25) / 25.0::DOUBLE, 0) AS x FROM d LEFT JOIN technologies t ON t.uid = d.uid), w AS (SELECT *, lag(x) OVER (PARTITION BY path ORDER BY j) AS y FROM v)
SELECT path, CASE WHEN min(x) > 0 OR max(x) < 0 THEN 'positive' WHEN count(*) FILTER (WHERE y IS NOT NULL AND NOT (x * y < 0)) = 0 THEN 'negative' ELSE 'mixed' END AS kind, round(avg(abs(x)), 6) AS strength FROM w GROUP BY path""")
def loop_signs(g: Graph) -> DataFrame:
    return repair.loop_signs(communities.simple_cycles(_influences(g)), g.technologies.select("uid", ((F.col("size") - 25) / 25.0).alias("delta")))


@query(f"""WITH {CHANGES}, b AS (SELECT kind AS tier, greatest(0, least(9, floor((new + 1) / 2 * 10))) AS bin, count(*) AS n FROM ch GROUP BY 1, 2), s AS (SELECT tier, bin, n / sum(n) OVER (PARTITION BY tier) AS p FROM b), m AS (SELECT tier, sqrt(sum(p * p)) AS norm FROM s GROUP BY tier),
x AS (SELECT s.tier, bin, p / norm AS x FROM s JOIN m ON s.tier = m.tier) SELECT a.tier AS a, b.tier AS b, round(sum(a.x * b.x), 6) AS similarity FROM x a JOIN x b ON a.bin = b.bin AND a.tier < b.tier GROUP BY a.tier, b.tier HAVING round(sum(a.x * b.x), 6) > 0.6""")
def tier_similarity(g: Graph) -> DataFrame:
    return repair.tier_similarity(_changes(g).select(F.col("kind").alias("tier"), F.col("new").alias("value")))


@query("SELECT count(*) FILTER (WHERE event_type <> 'view') AS verified, count(*) FILTER (WHERE event_type = 'view') AS pending, round(avg(CAST(json_extract_string(props, '$.k') AS INT) / 100.0::DOUBLE) FILTER (WHERE event_type <> 'view'), 3) AS mean_accuracy FROM events")
def prediction_accuracy(g: Graph) -> DataFrame:
    return repair.accuracy(g.events.select(F.when(F.col("event_type") != "view", F.col("k") / 100.0).alias("accuracy")))


@query("SELECT 'user:' || user_id AS target, count(DISTINCT event_type) AS sources, CASE WHEN sum(value) < 50 THEN 'small' WHEN sum(value) < 200 THEN 'medium' ELSE 'large' END AS effort, count(DISTINCT event_type) > 3 AS risky FROM events GROUP BY user_id")
def adoption_plan(g: Graph) -> DataFrame:
    return repair.adoption_plan(g.events.select(F.col("uid").alias("target"), F.col("event_type").alias("source"), F.col("value").alias("size")))


@query("SELECT event_type, count(*) AS n, CAST(min(ts) AS VARCHAR)[1:10] AS first_day, CAST(max(ts) AS VARCHAR)[1:10] AS last_day FROM events GROUP BY event_type")
def change_log(g: Graph) -> DataFrame:
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return g.events.groupBy("event_type").agg(F.count("*").alias("n"), day(F.min("ts")).alias("first_day"), day(F.max("ts")).alias("last_day"))


@query("""WITH m AS (SELECT DISTINCT d.src AS uid, t.brand AS community FROM edges d JOIN technologies t ON t.uid = d.dst WHERE d.type = 'DEVELOPS' UNION SELECT uid, brand FROM technologies)
SELECT community, count(*) AS members, count(*) FILTER (WHERE uid LIKE 'org:%') AS organizations FROM m GROUP BY community""")
def enriched_communities(g: Graph) -> DataFrame:
    """Members of each brand's community once the organizations that develop for it are in."""
    own = g.technologies.select("uid", F.col("brand").alias("community"))
    makers = match.of_types(g.edges, "DEVELOPS").join(own.withColumnRenamed("uid", "dst"), "dst").select(F.col("src").alias("uid"), "community")
    return own.union(makers).distinct().groupBy("community").agg(F.count("*").alias("members"), F.count_if(F.col("uid").startswith("org:")).alias("organizations"))


@query("""WITH m AS (SELECT DISTINCT brand AS c1, kind AS c2, uid FROM technologies) SELECT c1, c2, count(*) AS shared FROM m GROUP BY c1, c2 HAVING count(*) >= 2""")
def community_hierarchy(g: Graph) -> DataFrame:
    """Links between communities of two levels (brands and kinds) that share technologies."""
    return g.technologies.groupBy(F.col("brand").alias("c1"), F.col("kind").alias("c2")).agg(F.count_distinct("uid").alias("shared")).where("shared >= 2")


@query(f"""WITH {CHANGES}, p AS (SELECT uid, round, seq, 'change' AS source, new AS value FROM ch WHERE kind = 'click' UNION ALL SELECT uid, round, seq, 'action', new FROM ch WHERE kind = 'purchase')
SELECT uid, row_number() OVER (PARTITION BY uid ORDER BY round, source, seq) AS place, round, source, round(value, 6) AS value FROM p""")
def entity_timeline(g: Graph) -> DataFrame:
    from pyspark.sql import Window

    kind = F.when(F.col("kind") == "click", "change").when(F.col("kind") == "purchase", "action")
    rows = _changes(g).select("uid", "round", "seq", kind.alias("source"), F.round("new", 6).alias("value")).where("source IS NOT NULL")
    return rows.select("uid", F.row_number().over(Window.partitionBy("uid").orderBy("round", "source", "seq")).alias("place"), "round", "source", "value")


@query(f"""WITH {DAG}, p AS (SELECT src, dst FROM dag UNION ALL SELECT dst, src FROM dag), b AS (SELECT p.src AS uid FROM p JOIN technologies a ON a.uid = p.src JOIN technologies c ON c.uid = p.dst WHERE a.brand <> c.brand GROUP BY p.src HAVING count(DISTINCT c.brand) >= 2)
SELECT uid, 'bridge and intermediate' AS insight FROM b WHERE uid IN (SELECT src FROM dag) AND uid IN (SELECT dst FROM dag)""")
def cross_insights(g: Graph) -> DataFrame:
    """Nodes that bridge communities and stand within causal chains."""
    dag = _dag(g)
    bridge = communities.bridges(dag, g.technologies.select("uid", F.col("brand").alias("community")), k=2_000_000_000).select("uid")
    between = dag.select(F.col("src").alias("uid")).intersect(dag.select(F.col("dst").alias("uid")))
    return bridge.intersect(between).withColumn("insight", F.lit("bridge and intermediate"))


@query(f"""WITH {DAG}, f AS (SELECT 'causal' AS space, src || '>' || dst AS title, weight AS confidence FROM dag UNION ALL SELECT 'claims', uid, confidence FROM claims)
SELECT space, title, round(confidence, 6) AS confidence, row_number() OVER (ORDER BY confidence DESC, space, title) AS rank FROM (SELECT * FROM f ORDER BY confidence DESC, space, title LIMIT 15)""")
def ranked_findings(g: Graph) -> DataFrame:
    chains = _dag(g).select(F.lit("causal").alias("space"), F.concat_ws(">", "src", "dst").alias("title"), F.col("weight").alias("confidence"))
    found = chains.unionByName(g.claims.select(F.lit("claims").alias("space"), F.col("uid").alias("title"), "confidence"))
    return causal.ranked_findings(found).withColumn("confidence", F.round("confidence", 6))


@query(f"""WITH {CHANGES}, s AS (SELECT uid, seq, CASE WHEN new > 0.8 THEN 'hot' WHEN new < -0.8 THEN 'cold' END AS e FROM ch), t AS (SELECT *, lag(e) OVER (PARTITION BY uid ORDER BY seq) AS was FROM s WHERE e IS NOT NULL),
u AS (SELECT * FROM t WHERE (e = 'hot' AND (was IS NULL OR was = 'cold')) OR (e = 'cold' AND was = 'hot')), g AS (SELECT uid, count(*) AS turns FROM u GROUP BY uid)
SELECT coalesce(turns, 0) AS turns, count(*) AS n FROM (SELECT DISTINCT uid FROM ch) c LEFT JOIN g ON g.uid = c.uid GROUP BY 1""")
def life_cycle_distribution(g: Graph) -> DataFrame:
    """Users by how often they heated up or cooled."""
    turns = F.expr("size(filter(split(phases, '>'), p -> p IN ('activated', 'cooling')))").cast("bigint")
    return life_cycles(g).groupBy(turns.alias("turns")).agg(F.count("*").alias("n"))

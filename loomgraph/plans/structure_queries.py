"""Queries for communities, centrality and change over time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators import communities as M
from loomgraph.operators import loading, match
from loomgraph.operators import modularity as Q
from loomgraph.operators import temporal as W
from loomgraph.plans.bindings import Graph
from loomgraph.plans.registry import query
from loomgraph.plans.session import checkpointed

CO = "co AS (SELECT a.dst AS a, b.dst AS b, count(*) AS n FROM discusses a JOIN discusses b ON a.src = b.src AND a.dst < b.dst GROUP BY a.dst, b.dst)"
TEXT_DATE = lambda name: F.col(name).cast("string").alias(name)


def _strong(g: Graph) -> DataFrame:
    return match.co_occurrence(g.discusses).where("n >= 3")


@query(f"""WITH RECURSIVE {CO}, s AS (SELECT a, b FROM co WHERE n >= 3), e AS (SELECT a, b FROM s UNION SELECT b, a FROM s),
r AS (SELECT a AS id, a AS reached FROM e UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.reached), c AS (SELECT id, min(reached) AS component FROM r GROUP BY id),
m AS (SELECT component, id, name, row_number() OVER (PARTITION BY component ORDER BY name, id) AS k FROM c JOIN nodes ON uid = id)
SELECT component AS community, CASE WHEN count(*) <= 3 THEN string_agg(name, ' & ' ORDER BY k) ELSE string_agg(name, ' & ' ORDER BY k) FILTER (WHERE k <= 2) || ' Ecosystem' END AS name, count(*) AS members FROM m GROUP BY component""")
def component_communities(g: Graph) -> DataFrame:
    return M.component_communities(_strong(g), g.nodes)


@query()
def label_communities(g: Graph) -> DataFrame:
    """Labels after five rounds of spreading; no SQL oracle, tested on hand-made graphs."""
    return M.spread_labels(match.co_occurrence(g.discusses).where("n >= 2"))


def _topic_members(g: Graph) -> DataFrame:
    tech = g.discusses.select("src", F.col("dst").alias("member"))
    return g.tagged_with.join(tech, "src").select(F.col("dst").alias("topic"), "member")


@query()
def topic_groups(g: Graph) -> DataFrame:
    """Groups of topics by shared technologies, seeded in order; tested on hand-made sets."""
    return M.topic_groups(_topic_members(g))


@query("""WITH p AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM depends_on WHERE src <> dst), d AS (SELECT uid, count(*) AS degree FROM (SELECT a AS uid FROM p UNION ALL SELECT b FROM p) GROUP BY uid)
SELECT uid, degree, round(degree / (count(*) OVER () - 1)::DOUBLE, 6) AS centrality FROM d""")
def degree_centrality(g: Graph) -> DataFrame:
    return M.degree_centrality(g.depends_on)


def _page_rank_sql(rounds: int) -> str:
    out = """WITH n AS (SELECT DISTINCT uid FROM (SELECT src AS uid FROM depends_on UNION ALL SELECT dst FROM depends_on)), c AS (SELECT count(*)::DOUBLE AS n FROM n),
w AS (SELECT src, dst, sum(confidence) AS w FROM depends_on GROUP BY src, dst), s AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS share FROM w),
r0 AS (SELECT n.uid, n.uid NOT IN (SELECT src FROM s) AS dangling, 1.0::DOUBLE / c.n AS rank FROM n, c)"""
    for i in range(rounds):
        out += f""", r{i + 1} AS (SELECT r.uid, r.dangling, 0.15::DOUBLE / c.n + 0.85::DOUBLE * (coalesce(g.got, 0) + l.lost / c.n) AS rank FROM r{i} r LEFT JOIN (SELECT dst, sum(rank * share) AS got FROM s JOIN r{i} x ON x.uid = s.src GROUP BY dst) g ON g.dst = r.uid,
 c, (SELECT coalesce(sum(rank), 0) AS lost FROM r{i} WHERE dangling) l)"""
    return out + f" SELECT uid, round(rank, 8) AS rank FROM r{rounds}"


@query(_page_rank_sql(10))
def page_rank(g: Graph) -> DataFrame:
    return M.page_rank(g.depends_on.withColumnRenamed("confidence", "weight"), rounds=10).select("uid", F.round("rank", 8).alias("rank"))


@query("""WITH p AS (SELECT src, dst FROM depends_on UNION ALL SELECT dst, src FROM depends_on)
SELECT p.src AS uid, count(DISTINCT b.brand) AS n FROM p JOIN technologies a ON a.uid = p.src JOIN technologies b ON b.uid = p.dst WHERE a.brand <> b.brand GROUP BY p.src HAVING count(DISTINCT b.brand) >= 2 ORDER BY n DESC, uid LIMIT 10""")
def bridge_nodes(g: Graph) -> DataFrame:
    return M.bridges(g.depends_on, g.technologies.select("uid", F.col("brand").alias("community")))


@query("""WITH c AS (SELECT brand, count(*) AS n FROM technologies GROUP BY brand), e AS (SELECT least(x.brand, y.brand) AS a, greatest(x.brand, y.brand) AS b, count(*) AS e FROM depends_on JOIN technologies x ON x.uid = src JOIN technologies y ON y.uid = dst WHERE x.brand <> y.brand GROUP BY 1, 2),
d AS (SELECT l.brand AS a, r.brand AS b, round(coalesce(e.e, 0) / (2.0::DOUBLE * l.n * r.n), 6) AS density FROM c l JOIN c r ON l.brand < r.brand LEFT JOIN e ON e.a = l.brand AND e.b = r.brand)
SELECT * FROM d WHERE density < 0.05 ORDER BY density, a, b LIMIT 10""")
def structural_holes(g: Graph) -> DataFrame:
    return M.structural_holes(g.depends_on, g.technologies.select("uid", F.col("brand").alias("community")))


INFLUENCES = """i AS (SELECT uid AS src, 'tech:' || (key // 2) AS dst FROM technologies WHERE key > 0 UNION SELECT 'tech:' || (key // 2), uid FROM technologies WHERE key % 7 = 0 AND key > 0 UNION SELECT uid, 'tech:' || (key + 1) FROM technologies WHERE key % 5 = 0)"""


def _influences(g: Graph) -> DataFrame:
    t, tech = g.technologies, lambda c: F.concat(F.lit("tech:"), c.cast("string"))
    key, half = F.col("key"), tech(F.floor(F.col("key") / 2))
    up = t.where("key > 0").select(F.col("uid").alias("src"), half.alias("dst"))
    down = t.where("key % 7 = 0 AND key > 0").select(half.alias("src"), F.col("uid").alias("dst"))
    return up.unionAll(down).unionAll(t.where("key % 5 = 0").select(F.col("uid").alias("src"), tech(key + 1).alias("dst"))).distinct()


@query(f"""WITH RECURSIVE {INFLUENCES}, p AS (SELECT src AS start, dst AS node, [src, dst] AS path FROM i WHERE dst > src UNION ALL SELECT start, i.dst, list_append(path, i.dst) FROM p JOIN i ON i.src = p.node WHERE len(path) < 5 AND i.dst > start AND NOT list_contains(path, i.dst))
SELECT array_to_string(path, '>') AS path, CAST(len(path) AS INT) AS length FROM p JOIN i ON i.src = p.node AND i.dst = p.start""")
def feedback_loops(g: Graph) -> DataFrame:
    return M.simple_cycles(_influences(g)).select(F.array_join("path", ">").alias("path"), "length")


BETWEENNESS = """b AS (SELECT src AS s, dst AS t FROM depends_on WHERE dst <> src UNION SELECT dst, src FROM depends_on WHERE dst <> src),
w(s, v, d, n) USING KEY (s, v) AS (SELECT DISTINCT s, s AS v, 0 AS d, 1.0::DOUBLE AS n FROM b
  UNION SELECT w.s, b.t, w.d + 1, sum(w.n) FROM w JOIN b ON b.s = w.v LEFT JOIN recurring.w k ON k.s = w.s AND k.v = b.t WHERE k.s IS NULL GROUP BY w.s, b.t, w.d),
pass AS (SELECT a.v AS uid, a.n * c.n / t.n AS share FROM w a JOIN w c ON c.s = a.v AND c.d > 0 JOIN w t ON t.s = a.s AND t.v = c.v AND t.d = a.d + c.d WHERE a.d > 0),
nodes_in AS (SELECT count(DISTINCT s)::DOUBLE AS n FROM b),
z AS (SELECT b.s AS uid, round(coalesce(sum_share, 0) / ((n - 1) * (n - 2)), 9) AS score FROM (SELECT DISTINCT s FROM b) b LEFT JOIN (SELECT uid, sum(share) AS sum_share FROM pass GROUP BY uid) p ON p.uid = b.s, nodes_in)"""


@query(f"WITH RECURSIVE {BETWEENNESS} SELECT uid, score FROM z")
def betweenness(g: Graph) -> DataFrame:
    """Over shortest paths of any length between all pairs, normalised."""
    return M.betweenness(g.depends_on)


@query(f"""WITH RECURSIVE {BETWEENNESS} SELECT 'top' AS "end", * FROM (SELECT uid, score FROM z ORDER BY score DESC, uid LIMIT 5) UNION ALL SELECT 'bottom', * FROM (SELECT uid, score FROM z ORDER BY score, uid DESC LIMIT 5)""")
def betweenness_extremes(g: Graph) -> DataFrame:
    """The five nodes that most shortest paths pass through, and the five that fewest do."""
    return loading.extremes(checkpointed(M.betweenness(g.depends_on)), "score", "uid")


def _ties(g: Graph) -> DataFrame:
    """Technologies that depend on each other, and those that articles discuss together twice or more."""
    together = match.co_occurrence(g.discusses).where("n >= 2").select("a", "b", F.col("n").cast("double").alias("weight"))
    return g.depends_on.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("confidence").alias("weight")).unionByName(together)


@query()
def modularity_tiers(g: Graph) -> DataFrame:
    """Communities at four resolutions; no SQL, held in the tests against a sequential method of the same quality."""
    return Q.modularity_communities(_ties(g))


@query("""WITH e AS (SELECT a.src AS u, a.dst AS v, CAST(round(greatest(confidence, 0.01) * 1000000) AS BIGINT) AS w FROM depends_on a WHERE src <> dst), b AS (SELECT u, v, w FROM e UNION ALL SELECT v, u, w FROM e),
m AS (SELECT CAST(sum(w) AS DOUBLE) AS m2 FROM b), s AS (SELECT x.brand AS c, CAST(sum(w) AS DOUBLE) AS k, CAST(sum(CASE WHEN x.brand = y.brand THEN w ELSE 0 END) AS DOUBLE) AS inside FROM b JOIN technologies x ON x.uid = u JOIN technologies y ON y.uid = v GROUP BY x.brand),
t AS (SELECT * FROM (VALUES (0, 2.0::DOUBLE), (1, 1.0::DOUBLE), (2, 0.5::DOUBLE), (3, 0.2::DOUBLE)) t(tier, resolution))
SELECT CAST(tier AS INT) AS tier, count(*) AS communities, round(sum(inside / m2 - resolution * (k / m2) * (k / m2)), 6) AS modularity FROM s, m, t GROUP BY tier""")
def partition_quality(g: Graph) -> DataFrame:
    """How well brands part the technologies that depend on each other, at each resolution."""
    pairs = g.depends_on.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("confidence").alias("weight"))
    tiers = F.explode(F.sequence(F.lit(0), F.lit(len(Q.RESOLUTIONS) - 1))).alias("tier")
    return Q.quality(pairs, g.technologies.select("uid", F.col("brand").alias("community"), tiers))


STAMPED = "st AS (SELECT 'user:' || user_id AS src, event_type AS dst, event_type AS type, ts AS stamp FROM events)"


def _stamped(g: Graph) -> DataFrame:
    return g.events.select(F.col("uid").alias("src"), F.col("event_type").alias("dst"), F.col("event_type").alias("type"), F.col("ts").alias("stamp"))


@query(f"""WITH {STAMPED}, e AS (SELECT src AS uid, stamp, 0 AS i, 1 AS o FROM st UNION ALL SELECT dst, stamp, 1, 0 FROM st), w AS (SELECT uid, CAST(date_trunc('week', stamp) AS DATE) AS week, sum(i) AS a, sum(o) AS b FROM e GROUP BY 1, 2),
s AS (SELECT uid, CAST(unnest(generate_series(min(week), max(week), INTERVAL 7 DAY)) AS DATE) AS week FROM w GROUP BY uid)
SELECT s.uid, CAST(s.week AS VARCHAR) AS week, CAST(coalesce(a, 0) AS BIGINT) AS added_in, CAST(coalesce(b, 0) AS BIGINT) AS added_out, CAST(sum(coalesce(a, 0) + coalesce(b, 0)) OVER (PARTITION BY s.uid ORDER BY s.week) AS BIGINT) AS total FROM s LEFT JOIN w ON w.uid = s.uid AND w.week = s.week""")
def weekly_growth(g: Graph) -> DataFrame:
    return W.weekly_growth(_stamped(g)).select("uid", TEXT_DATE("week"), "added_in", "added_out", "total")


@query(f"""WITH {STAMPED}, e AS (SELECT src AS uid, stamp FROM st UNION ALL SELECT dst, stamp FROM st), w AS (SELECT uid, CAST(date_trunc('week', stamp) AS DATE) AS week, count(*) AS added FROM e GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY added DESC, week) AS k FROM w) SELECT uid, CAST(week AS VARCHAR) AS week, added FROM r WHERE k = 1""")
def peak_week(g: Graph) -> DataFrame:
    return W.peak_week(W.weekly_growth(_stamped(g))).select("uid", TEXT_DATE("week"), "added")


@query(f"""WITH {STAMPED}, r AS (SELECT dst, src, type, row_number() OVER (PARTITION BY dst ORDER BY CASE WHEN src LIKE '%7' THEN NULL ELSE stamp END NULLS LAST, type, src) AS k FROM st) SELECT dst, src, type, k FROM r WHERE k <= 3""")
def first_edges(g: Graph) -> DataFrame:
    holed = _stamped(g).withColumn("stamp", F.when(~F.col("src").endswith("7"), F.col("stamp")))
    return W.first_edges(holed).select("dst", "src", "type", "k")


ROUNDS = 30
CHANGES = """ch AS (SELECT 'user:' || user_id AS uid, CAST(datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) + 1 AS INT) AS round, event_id AS seq, CAST(json_extract_string(props, '$.k') AS INT) / 50.0::DOUBLE - 1.0::DOUBLE AS new, event_type AS kind FROM events)"""
CARRIED = CHANGES + f""", l AS (SELECT uid, round, arg_max(new, seq) AS new FROM ch GROUP BY uid, round), sp AS (SELECT uid, CAST(r AS INT) AS round FROM (SELECT DISTINCT uid FROM l), range(1, {ROUNDS + 1}) t(r)),
cf AS (SELECT sp.uid, sp.round, coalesce(last_value(l.new IGNORE NULLS) OVER (PARTITION BY sp.uid ORDER BY sp.round ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0.0::DOUBLE) AS value FROM sp LEFT JOIN l ON l.uid = sp.uid AND l.round = sp.round)"""


def _changes(g: Graph) -> DataFrame:
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) + 1
    return g.events.select("uid", day.cast("int").alias("round"), F.col("event_id").alias("seq"), (F.col("k") / 50.0 - 1.0).alias("new"), F.col("event_type").alias("kind"))


@query(f"WITH {CARRIED} SELECT uid, round, round(value, 6) AS value FROM cf")
def carry_forward_series(g: Graph) -> DataFrame:
    return W.carry_forward(_changes(g), ROUNDS).select("uid", "round", F.round("value", 6).alias("value"))


SERIES = f"""cf AS (SELECT event_type || '/' || (CAST(json_extract_string(props, '$.k') AS INT) // 10) AS uid, CAST(datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) + 1 AS INT) AS round, round(avg(value), 6) AS value FROM events GROUP BY 1, 2)"""


@query(f"""WITH {SERIES}, d AS (SELECT uid, avg(value) AS mean, stddev_pop(value) AS sd, count(*) AS n FROM cf GROUP BY uid), z AS (SELECT cf.uid, round, n, (value - mean) / sd AS z FROM cf JOIN d ON d.uid = cf.uid WHERE sd > 1e-10 AND n >= 3),
p AS (SELECT a.uid AS a, b.uid AS b, lag.lag AS lag, round(sum(a.z * b.z) / max(a.n), 6) AS correlation FROM z a, range(-3, 4) lag(lag), z b WHERE b.round = a.round - lag.lag AND a.uid < b.uid AND abs(lag.lag) <= a.n // 2 GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY abs(correlation) DESC, lag) AS k FROM p) SELECT a, b, correlation, CAST(lag AS INT) AS lag FROM k WHERE k = 1 AND lag <> 0 AND abs(correlation) > 0.4 ORDER BY abs(correlation) DESC, a, b LIMIT 20""")
def lagged_correlation(g: Graph) -> DataFrame:
    """Daily mean values of each kind of event and decile of its strength, pair by pair."""
    day = (F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) + 1).cast("int")
    series = g.events.groupBy(F.concat_ws("/", "event_type", F.floor(F.col("k") / 10).cast("string")).alias("uid"), day.alias("round")).agg(F.round(F.avg("value"), 6).alias("value"))
    return W.lagged_correlation(series, least=0.4)


@query(f"""WITH {CHANGES}, s AS (SELECT uid, seq, CASE WHEN new > 0.8 THEN 'hot' WHEN new < -0.8 THEN 'cold' END AS e FROM ch), t AS (SELECT *, lag(e) OVER (PARTITION BY uid ORDER BY seq) AS was FROM s WHERE e IS NOT NULL),
u AS (SELECT * FROM t WHERE (e = 'hot' AND (was IS NULL OR was = 'cold')) OR (e = 'cold' AND was = 'hot')), g AS (SELECT uid, string_agg(CASE e WHEN 'hot' THEN 'activated>overheated' ELSE 'cooling' END, '>' ORDER BY seq) AS mid, arg_max(e, seq) AS last FROM u GROUP BY uid)
SELECT c.uid, 'inactive' || CASE WHEN mid IS NULL THEN '' ELSE '>' || mid END || CASE WHEN last IS NULL OR last = 'cold' THEN '>stable' ELSE '' END AS phases FROM (SELECT DISTINCT uid FROM ch) c LEFT JOIN g ON g.uid = c.uid""")
def life_cycles(g: Graph) -> DataFrame:
    out = W.life_cycle(_changes(g).withColumnRenamed("new", "delta"), hot=0.8, cold=-0.8)
    return out.select("uid", F.array_join("phases", ">").alias("phases"))


@query(f"""WITH {CHANGES}, h AS (SELECT c.seq AS cause, a.seq AS act, a.kind AS actor, a.round - c.round AS delay FROM ch c JOIN ch a ON a.uid = c.uid AND a.round BETWEEN c.round AND c.round + 5 WHERE c.kind = 'signup' AND a.kind <> 'signup'),
r AS (SELECT *, row_number() OVER (PARTITION BY cause ORDER BY delay, act) AS k FROM h)
SELECT cause, count(*) AS reactions, round(avg(delay), 6) AS mean_delay, string_agg(actor, ',' ORDER BY k) FILTER (WHERE k <= 10) AS "order" FROM r GROUP BY cause""")
def event_reactions(g: Graph) -> DataFrame:
    changes = _changes(g)
    causes = changes.where("kind = 'signup'").select(F.col("seq").alias("cause"), F.col("uid").alias("group"), "round")
    acts = changes.where("kind <> 'signup'").select(F.col("seq").alias("act"), F.col("uid").alias("group"), F.col("kind").alias("actor"), "round")
    return W.reactions(causes, acts)

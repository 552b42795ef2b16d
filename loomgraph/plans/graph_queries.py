"""Scans, statistics, search, neighbourhoods, co-occurrence and bounded paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators import match
from loomgraph.plans.bindings import Graph
from loomgraph.plans.registry import query

SINCE = "2001-01-01"


@query("""SELECT 'node' AS part, coalesce(label, 'all') AS kind, count(*) AS n FROM nodes GROUP BY ROLLUP (label)
UNION ALL SELECT 'edge', coalesce(type, 'all'), count(*) FROM edges GROUP BY ROLLUP (type)""")
def graph_stats(g: Graph) -> DataFrame:
    count = lambda df, part, kind: df.rollup(kind).agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), F.coalesce(kind, F.lit("all")).alias("kind"), "n")
    return count(g.nodes, "node", "label").unionAll(count(g.edges, "edge", "type"))


@query("""WITH d AS (SELECT uid, count(*) AS degree FROM (SELECT src AS uid FROM edges UNION ALL SELECT dst FROM edges) GROUP BY uid)
SELECT degree, count(*) AS n_nodes FROM d GROUP BY degree""")
def degree_histogram(g: Graph) -> DataFrame:
    ends = g.edges.select(F.explode(F.array("src", "dst")).alias("uid"))
    return ends.groupBy("uid").agg(F.count("*").alias("degree")).groupBy("degree").agg(F.count("*").alias("n_nodes"))


@query(f"""SELECT t.uid, t.name, count(*) AS mentions FROM discusses d JOIN articles a ON d.src = a.uid JOIN technologies t ON d.dst = t.uid
WHERE a.published_date >= DATE '{SINCE}' GROUP BY t.uid, t.name ORDER BY mentions DESC, t.uid LIMIT 15""")
def trend_technologies(g: Graph) -> DataFrame:
    recent = g.articles.where(F.col("published_date") >= SINCE).select(F.col("uid").alias("src"))
    counts = g.discusses.join(recent, "src").groupBy(F.col("dst").alias("uid")).agg(F.count("*").alias("mentions"))
    return counts.join(g.technologies.select("uid", "name"), "uid").select("uid", "name", "mentions").orderBy(F.desc("mentions"), "uid").limit(15)


@query(f"""SELECT t.uid, t.name, count(*) AS mentions FROM tagged_with d JOIN articles a ON d.src = a.uid JOIN topics t ON d.dst = t.uid
WHERE a.published_date >= DATE '{SINCE}' GROUP BY t.uid, t.name ORDER BY mentions DESC, t.uid LIMIT 10""")
def trend_topics(g: Graph) -> DataFrame:
    recent = g.articles.where(F.col("published_date") >= SINCE).select(F.col("uid").alias("src"))
    counts = g.tagged_with.join(recent, "src").groupBy(F.col("dst").alias("uid")).agg(F.count("*").alias("mentions"))
    return counts.join(g.topics, "uid").select("uid", "name", "mentions").orderBy(F.desc("mentions"), "uid").limit(10)


@query("SELECT uid, label, name FROM nodes WHERE contains(lower(name), lower('Widget')) ORDER BY label, name, uid LIMIT 20")
def search_contains(g: Graph) -> DataFrame:
    return g.nodes.where(F.contains(F.lower("name"), F.lower(F.lit("Widget")))).orderBy("label", "name", "uid").limit(20)


@query("SELECT uid, title, CAST(published_date AS VARCHAR) AS published_date, relevance FROM articles ORDER BY articles.published_date DESC, uid LIMIT 20")
def recent_items(g: Graph) -> DataFrame:
    newest = g.articles.orderBy(F.desc_nulls_last("published_date"), "uid").limit(20)
    return newest.select("uid", "title", F.col("published_date").cast("string").alias("published_date"), "relevance")


@query("SELECT uid, label, name FROM nodes WHERE label IN ('Technology', 'Topic') ORDER BY label, uid LIMIT 200 OFFSET 100")
def entity_page(g: Graph) -> DataFrame:
    return page(g.nodes.where(F.col("label").isin("Technology", "Topic")).orderBy("label", "uid"), 200, 100)


def page(df: DataFrame, limit: int | None, offset: int = 0) -> DataFrame:
    """A page of ordered rows; the size is held between 1 and 500, 200 if not given."""
    return df.offset(max(0, offset)).limit(min(max(limit if limit is not None else 200, 1), 500))


@query("""WITH b AS (SELECT DISTINCT src, dst, type FROM (SELECT src, dst, type FROM edges UNION ALL SELECT dst, src, type FROM edges)),
n AS (SELECT b.src AS uid, type, b.dst AS neighbour, name, row_number() OVER (PARTITION BY b.src ORDER BY type, b.dst) AS k FROM b JOIN nodes ON nodes.uid = b.dst)
SELECT uid, type, neighbour, name FROM n WHERE k <= 20""")
def related_entities(g: Graph) -> DataFrame:
    """The first twenty neighbours of every node, over edges of all types."""
    return match.neighbours(g.nodes, g.edges)


@query("""WITH e AS (SELECT DISTINCT src, dst FROM depends_on)
SELECT t.uid, t.name, t.kind, count(e.dst) AS n_out, coalesce(string_agg(e.dst, ',' ORDER BY e.dst), '') AS neighbours
FROM technologies t LEFT JOIN e ON e.src = t.uid GROUP BY t.uid, t.name, t.kind""")
def entity_detail(g: Graph) -> DataFrame:
    out = g.depends_on.groupBy(F.col("src").alias("uid")).agg(F.array_sort(F.collect_set("dst")).alias("all"))
    joined = g.technologies.join(out, "uid", "left")
    return joined.select("uid", "name", "kind", F.coalesce(F.size("all"), F.lit(0)).cast("bigint").alias("n_out"), F.coalesce(F.array_join("all", ","), F.lit("")).alias("neighbours"))


@query("SELECT kind, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 2) AS percent FROM technologies GROUP BY kind")
def type_distribution(g: Graph) -> DataFrame:
    counts = g.technologies.groupBy("kind").agg(F.count("*").alias("n"))
    return counts.withColumn("percent", F.round(F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy()), 2))


@query("SELECT uid, label, name FROM nodes WHERE uid NOT IN (SELECT src FROM edges WHERE confidence >= 0.7 UNION ALL SELECT dst FROM edges WHERE confidence >= 0.7)")
def isolated_nodes(g: Graph) -> DataFrame:
    """Nodes without any edge, of whatever type, that is more than weak."""
    ends = g.edges.where("confidence >= 0.7").select(F.explode(F.array("src", "dst")).alias("uid")).distinct()
    return g.nodes.join(ends, "uid", "left_anti").select("uid", "label", "name")


@query("""SELECT a.dst AS a, b.dst AS b, count(*) AS n FROM discusses a JOIN discusses b ON a.src = b.src AND a.dst < b.dst GROUP BY a.dst, b.dst HAVING count(*) > 1""")
def cooccurrence_pairs(g: Graph) -> DataFrame:
    return match.co_occurrence(g.discusses).where("n > 1")


@query("""WITH s AS (SELECT DISTINCT dst AS uid, src AS source FROM discusses)
SELECT d.src, d.dst, count(DISTINCT a.source) AS weight FROM depends_on d JOIN s a ON a.uid = d.src JOIN s b ON b.uid = d.dst AND b.source = a.source GROUP BY d.src, d.dst HAVING count(DISTINCT a.source) > 1""")
def edge_weights(g: Graph) -> DataFrame:
    """Weight of an edge: the sources that speak of both ends, if more than one."""
    source = g.discusses.select(F.col("dst").alias("uid"), F.col("src").alias("source")).distinct()
    left = g.depends_on.select("src", "dst").distinct().join(source.withColumnRenamed("uid", "src"), "src")
    both = left.join(source.withColumnRenamed("uid", "dst"), ["dst", "source"])
    return both.groupBy("src", "dst").agg(F.count("*").alias("weight")).where("weight > 1")


@query("""WITH b AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM depends_on UNION ALL SELECT dst, src FROM depends_on)),
r AS (SELECT src AS uid, dst AS reached FROM b UNION SELECT a.src, c.dst FROM b a JOIN b c ON a.dst = c.src)
SELECT uid, count(*) AS reach FROM r WHERE uid <> reached GROUP BY uid""")
def reach_two_hops(g: Graph) -> DataFrame:
    return match.reach(g.depends_on, 2).groupBy("uid").agg(F.count("*").alias("reach"))


@query("""WITH seeds AS (SELECT uid FROM technologies),
e AS (SELECT src, dst, src || '|' || type || '|' || dst AS edge FROM depends_on),
b AS (SELECT src, dst, edge FROM e UNION ALL SELECT dst, src, edge FROM e),
p1 AS (SELECT uid AS seed, dst AS at, [uid, dst] AS path, [edge] AS used FROM seeds JOIN b ON src = uid),
p2 AS (SELECT seed, b.dst AS at, list_append(path, b.dst) AS path, list_append(used, edge) AS used FROM p1 JOIN b ON b.src = p1.at WHERE NOT list_contains(used, edge))
SELECT seed, array_to_string(path, '>') AS path, 1 AS hops FROM p1 UNION ALL SELECT seed, array_to_string(path, '>'), 2 FROM p2""")
def bounded_paths(g: Graph) -> DataFrame:
    """Walks of up to two undirected dependencies from every technology."""
    return match.trails(g.technologies.select("uid"), g.depends_on, 2).select("seed", F.array_join("path", ">").alias("path"), "hops")


@query("""WITH RECURSIVE b AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM depends_on UNION ALL SELECT dst, src FROM depends_on)),
w AS (SELECT uid AS a, 'tech:' || (key // 2) AS b FROM technologies),
r AS (SELECT DISTINCT a AS seed, a AS node, 0 AS distance FROM w UNION SELECT r.seed, b.dst, r.distance + 1 FROM r JOIN b ON b.src = r.node WHERE r.distance < 5),
m AS (SELECT seed, node, min(distance) AS distance FROM r GROUP BY seed, node)
SELECT w.a, w.b, coalesce(m.distance, -1) AS distance FROM w LEFT JOIN m ON m.seed = w.a AND m.node = w.b""")
def shortest_paths(g: Graph) -> DataFrame:
    pairs = g.technologies.select(F.col("uid").alias("a"), F.concat(F.lit("tech:"), F.floor(F.col("key") / 2).cast("string")).alias("b"))
    return match.shortest_distance(g.depends_on, pairs).withColumn("distance", F.coalesce("distance", F.lit(-1)))


@query("""WITH RECURSIVE b AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM depends_on UNION ALL SELECT dst, src FROM depends_on) WHERE src <> dst),
w AS (SELECT uid AS a, 'tech:' || (key * 7 // 10) AS b FROM technologies UNION SELECT uid, 'tech:' || (key // 12) FROM technologies UNION SELECT uid, 'tech:' || (key // 36) FROM technologies UNION SELECT uid, uid FROM technologies WHERE key % 50 = 0),
r(seed, node, distance) USING KEY (seed, node) AS (SELECT DISTINCT a AS seed, a AS node, 0 AS distance FROM w UNION SELECT r.seed, b.dst, r.distance + 1 FROM r JOIN b ON b.src = r.node LEFT JOIN recurring.r k ON k.seed = r.seed AND k.node = b.dst WHERE r.distance < 5 AND k.seed IS NULL),
p AS (SELECT a AS seed, a AS node, 0 AS d, [a] AS path FROM (SELECT DISTINCT a FROM w) UNION ALL SELECT p.seed, b.dst, p.d + 1, list_append(p.path, b.dst) FROM p JOIN b ON b.src = p.node JOIN r ON r.seed = p.seed AND r.node = b.dst AND r.distance = p.d + 1),
k AS (SELECT w.a, w.b, p.d AS distance, path, row_number() OVER (PARTITION BY w.a, w.b ORDER BY path) AS rank FROM w JOIN p ON p.seed = w.a AND p.node = w.b)
SELECT a, b, distance, CAST(rank AS INT) AS rank, array_to_string(path, '>') AS path FROM k WHERE rank <= 3""")
def shortest_routes(g: Graph) -> DataFrame:
    """The first three shortest paths, of five hops at most, between each technology and three of lower keys."""
    key = F.col("key")
    to = lambda k: g.technologies.select(F.col("uid").alias("a"), F.concat(F.lit("tech:"), F.floor(k).cast("string")).alias("b"))
    pairs = to(key * 7 / 10).unionAll(to(key / 12)).unionAll(to(key / 36))
    pairs = pairs.unionAll(g.technologies.where("key % 50 = 0").select(F.col("uid").alias("a"), F.col("uid").alias("b")))
    return match.shortest_routes(g.depends_on, pairs).withColumn("path", F.array_join("path", ">"))


@query("""WITH members AS (SELECT uid FROM technologies WHERE kind = 'promo')
SELECT src, dst, confidence FROM depends_on WHERE src IN (SELECT uid FROM members) AND dst IN (SELECT uid FROM members) ORDER BY confidence DESC, src, dst LIMIT 10""")
def induced_edges(g: Graph) -> DataFrame:
    members = g.technologies.where("kind = 'promo'").select("uid")
    inner = g.depends_on.join(members.withColumnRenamed("uid", "src"), "src", "left_semi").join(members.withColumnRenamed("uid", "dst"), "dst", "left_semi")
    return inner.select("src", "dst", "confidence").orderBy(F.desc("confidence"), "src", "dst").limit(10)


@query("""SELECT src, type, count(*) AS n, string_agg(dst, ';' ORDER BY dst) AS targets FROM edges WHERE type IN ('DEPENDS_ON', 'DEVELOPS', 'SUBTOPIC_OF') GROUP BY src, type""")
def export_edges_grouped(g: Graph) -> DataFrame:
    chosen = match.of_types(g.edges, "DEPENDS_ON", "DEVELOPS", "SUBTOPIC_OF")
    grouped = chosen.groupBy("src", "type").agg(F.array_sort(F.collect_list("dst")).alias("all"))
    return grouped.select("src", "type", F.size("all").cast("bigint").alias("n"), F.array_join("all", ";").alias("targets"))


@query("""WITH b AS (SELECT uid, kind, size FROM technologies)
SELECT a.uid AS a, c.uid AS b, a.kind = c.kind AS same_kind, a.size - c.size AS size_difference FROM b a JOIN b c ON c.uid = 'tech:' || (CAST(substr(a.uid, 6) AS BIGINT) + 1)""")
def property_comparison(g: Graph) -> DataFrame:
    left = g.technologies.select(F.col("uid").alias("a"), "key", F.col("kind").alias("k"), F.col("size").alias("s"))
    right = g.technologies.select(F.col("uid").alias("b"), (F.col("key") - 1).alias("key"), "kind", "size")
    return left.join(right, "key").select("a", "b", (F.col("k") == F.col("kind")).alias("same_kind"), (F.col("s") - F.col("size")).alias("size_difference"))

"""Queries for deduplication and retrieval."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators import dedup, match, ordered_dedup, retrieval, vector_index
from loomgraph.operators.rules import space_of
from loomgraph.plans.bindings import Graph
from loomgraph.plans.registry import query
from loomgraph.plans.session import shared_folder

NORMAL = r"trim(regexp_replace(regexp_replace(lower(name), '[._-]', '', 'g'), '\s+', ' ', 'g'))"


@query(f"""WITH n AS (SELECT label, uid, {NORMAL} AS normal FROM nodes WHERE label IN ('Technology', 'Person', 'Organization', 'Topic')),
l AS (SELECT label, normal, min(uid) AS a FROM n GROUP BY label, normal) SELECT n.label, a, uid AS b FROM n JOIN l ON n.label = l.label AND n.normal = l.normal WHERE uid > a""")
def exact_copies(g: Graph) -> DataFrame:
    return dedup.exact_copies(g.nodes.where("label IN ('Technology', 'Person', 'Organization', 'Topic')"))


@query(f"""WITH n AS (SELECT DISTINCT label, {NORMAL} AS n FROM nodes WHERE label IN ('Technology', 'Person', 'Organization', 'Topic')),
p AS (SELECT a.label, a.n AS x, b.n AS y, least(length(a.n), length(b.n)) AS short, greatest(length(a.n), length(b.n)) AS long FROM n a JOIN n b ON a.label = b.label AND a.n < b.n),
s AS (SELECT label, x, y, CASE WHEN (contains(x, y) OR contains(y, x)) AND short >= 3 AND long - short <= 3 THEN 0.9 ELSE 1.0::DOUBLE - levenshtein(x, y) / long::DOUBLE END AS score FROM p)
SELECT * FROM s WHERE score >= 0.85""")
def similar_names(g: Graph) -> DataFrame:
    return dedup.similar_names(g.nodes.where("label IN ('Technology', 'Person', 'Organization', 'Topic')"))


@query("""WITH m AS (SELECT t.uid AS gone, l.keep FROM technologies t JOIN (SELECT name, brand, min(uid) AS keep FROM technologies GROUP BY name, brand) l ON t.name = l.name AND t.brand = l.brand WHERE uid <> keep),
e AS (SELECT coalesce(a.keep, src) AS s, coalesce(b.keep, dst) AS d, type, confidence, a.keep IS NOT NULL OR b.keep IS NOT NULL AS moved FROM depends_on LEFT JOIN m a ON a.gone = src LEFT JOIN m b ON b.gone = dst WHERE coalesce(a.keep, src) <> coalesce(b.keep, dst)),
t AS (SELECT *, max(CAST(moved AS INT)) OVER (PARTITION BY s, d, type) AS touched FROM e)
SELECT s AS src, d AS dst, type, confidence FROM t WHERE touched = 0 UNION ALL SELECT s, d, type, max(confidence) FROM t WHERE touched = 1 GROUP BY s, d, type""")
def redirected_edges(g: Graph) -> DataFrame:
    """Technologies of one name and brand become one."""
    least = g.technologies.groupBy("name", "brand").agg(F.min("uid").alias("keep"))
    merges = g.technologies.join(least, ["name", "brand"]).where("uid <> keep").select(F.col("uid").alias("gone"), "keep")
    return dedup.redirect(g.depends_on, merges)


def _spelled(g: Graph) -> DataFrame:
    """Technologies in the order of their keys, some of whose names are spelled otherwise, and typed by their kind."""
    key, name = F.col("key"), F.col("name")
    other = F.when(key % 4 == 0, F.upper(F.translate(name, " ", "_"))).when(key % 4 == 1, F.concat(name, F.lit("s"))).when(key % 9 == 2, F.concat(F.lit("new "), name)).otherwise(name)
    return g.technologies.select("uid", key.alias("ord"), other.alias("name"), F.when(key % 11 != 0, F.col("kind")).alias("type"))


@query()
def ordered_merges(g: Graph) -> DataFrame:
    """Which technologies an ordered pass merges into which; no SQL, equal to a plain pass over all pairs in the tests."""
    return ordered_dedup.ordered_merges(_spelled(g))


@query()
def ordered_relations(g: Graph) -> DataFrame:
    """Dependencies between the technologies that an ordered pass leaves."""
    relations = g.depends_on.select("src", "dst", "type", F.lit(0.5).alias("weight"), "confidence", F.xxhash64("src", "dst").alias("chunk"))
    return ordered_dedup.merged_relations(relations, ordered_dedup.ordered_merges(_spelled(g)).select("gone", "keep"))


@query("""SELECT 'article:' || l_orderkey AS src, 'tech:' || l_partkey AS dst, 'DISCUSSES' AS type, CAST(sum(l_quantity) AS DOUBLE) AS weight, round(avg(1.0::DOUBLE - l_discount), 6) AS confidence, min(l_linenumber) AS chunk FROM lineitem GROUP BY l_orderkey, l_partkey""")
def merged_edges(g: Graph) -> DataFrame:
    key = F.col
    lines = g.table("lineitem").select(F.concat(F.lit("article:"), key("l_orderkey").cast("string")).alias("src"), F.concat(F.lit("tech:"), key("l_partkey").cast("string")).alias("dst"), F.lit("DISCUSSES").alias("type"), key("l_quantity").alias("weight"), (F.lit(1.0) - key("l_discount")).alias("confidence"), key("l_linenumber").alias("chunk"))
    return dedup.merge_edges(lines)


@query("""WITH k AS (SELECT uid, name, kind FROM technologies WHERE size > 10), i AS (SELECT uid, upper(name) AS name, CASE WHEN key % 2 = 0 THEN brand END AS kind FROM technologies WHERE kind IN ('promo', 'small', 'large'))
SELECT coalesce(k.uid, i.uid) AS uid, coalesce(k.name, i.name) AS name, coalesce(i.kind, k.kind) AS kind, k.uid IS NULL AS created FROM k FULL JOIN i ON k.uid = i.uid""")
def upserted_nodes(g: Graph) -> DataFrame:
    known = g.technologies.where("size > 10").select("uid", "name", "kind")
    incoming = g.technologies.where("kind IN ('promo', 'small', 'large')").select("uid", F.upper("name").alias("name"), F.when(F.col("key") % 2 == 0, F.col("brand")).alias("kind"))
    return dedup.upsert_nodes(known, incoming, ["name"], ["kind"])


@query("""WITH i AS (SELECT 'tech:' || key AS src, 'tech:' || (key // 3) AS dst, 'DEPENDS_ON' AS type, 0.1::DOUBLE AS confidence FROM technologies UNION ALL SELECT 'tech:' || key, 'tech:' || (key + 5), 'DEPENDS_ON', 0.2::DOUBLE FROM technologies)
SELECT * FROM depends_on UNION ALL SELECT * FROM i WHERE NOT EXISTS (SELECT 1 FROM depends_on d WHERE d.src = i.src AND d.dst = i.dst) AND src IN (SELECT uid FROM technologies) AND dst IN (SELECT uid FROM technologies)""")
def upserted_edges(g: Graph) -> DataFrame:
    make = lambda target, c: g.technologies.select("uid", F.concat(F.lit("tech:"), target.cast("string")).alias("dst"), F.lit("DEPENDS_ON").alias("type"), F.lit(c).alias("confidence")).withColumnRenamed("uid", "src")
    incoming = make(F.floor(F.col("key") / 3), 0.1).unionByName(make(F.col("key") + 5, 0.2))
    return dedup.upsert_edges(g.depends_on, incoming, g.technologies)


@query("""WITH t AS (SELECT uid, CASE WHEN key % 2 = 0 THEN upper(name) ELSE name END AS name FROM technologies), n AS (SELECT dst, count(*) AS n FROM discusses GROUP BY dst),
c AS (SELECT t.uid, lower(name) AS folded, coalesce(n, 0) AS n FROM t LEFT JOIN n ON n.dst = t.uid), r AS (SELECT *, first_value(uid) OVER (PARTITION BY folded ORDER BY n DESC, uid) AS keep FROM c)
SELECT uid AS gone, keep FROM r WHERE uid <> keep""")
def merged_topics(g: Graph) -> DataFrame:
    topics = g.technologies.select("uid", F.when(F.col("key") % 2 == 0, F.upper("name")).otherwise(F.col("name")).alias("name"))
    return dedup.merge_topics(topics, g.discusses)


@query(r"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS ts FROM documents),
p AS (SELECT doc_id, len(ts) AS size, unnest(ts) AS term FROM t), i AS (SELECT doc_id, term, size, count(*) AS tf FROM p GROUP BY ALL),
tot AS (SELECT count(*) AS n, avg(len(ts)) AS mean_size FROM t),
q AS (SELECT DISTINCT item_id AS query, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS term FROM benchmark), w AS (SELECT * FROM q WHERE term <> ''),
h AS (SELECT * FROM i WHERE term IN (SELECT term FROM w)), df AS (SELECT term, count(*) AS df FROM h GROUP BY term),
s AS (SELECT w.query, doc_id, round(sum(ln(1.0::DOUBLE + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * size / mean_size))), 6) AS score
  FROM h JOIN df USING (term) JOIN w USING (term), tot GROUP BY w.query, doc_id),
r AS (SELECT query, doc_id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS rank FROM s)
SELECT query, doc_id, score, rank FROM r WHERE rank <= 5""")
def bm25_search(g: Graph) -> DataFrame:
    """The five best documents for the words of each benchmark item."""
    docs = g.table("documents")
    index = retrieval.postings(docs, "doc_id")
    terms = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda t: t != "")
    totals = docs.select(F.size(terms).alias("size")).agg(F.count("*").alias("n"), F.avg("size").alias("mean_size"))
    wanted = g.table("benchmark").select(F.col("item_id").alias("query"), F.explode(F.split(F.lower("text"), r"[^\p{L}\p{N}]+")).alias("term")).where("term <> ''")
    return retrieval.bm25(index, totals, wanted, "doc_id").select("query", "doc_id", "score", "rank")


@query("""WITH x AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(x::DOUBLE) AS m FROM x GROUP BY label, i),
s AS (SELECT m.label, x.vec_id, round(sum(x.x::DOUBLE * m.m) / sqrt(sum(x.x::DOUBLE * x.x::DOUBLE) * sum(m.m * m.m)), 6) AS score FROM x JOIN m ON x.i = m.i GROUP BY m.label, x.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS k FROM s) SELECT label, vec_id, score FROM r WHERE k <= 5""")
def label_neighbours(g: Graph) -> DataFrame:
    """The vectors nearest to the mean of each label."""
    return retrieval.centroid_neighbours(g.table("embeddings"))


@query("""WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), z AS (SELECT vec_id, sqrt(sum(x * x)) AS z FROM x GROUP BY vec_id),
s AS (SELECT q.vec_id AS query, e.vec_id, sum(q.x * e.x) AS dot FROM x q JOIN x e ON q.i = e.i WHERE q.vec_id % 20 = 0 AND e.vec_id <> q.vec_id GROUP BY ALL),
r AS (SELECT query, s.vec_id, round(dot / (a.z * b.z), 6) AS score FROM s JOIN z a ON a.vec_id = query JOIN z b ON b.vec_id = s.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rank FROM r) SELECT query, vec_id, score, rank FROM k WHERE rank <= 5""")
def vector_top_k(g: Graph) -> DataFrame:
    """The five vectors nearest to each vector whose id is divisible by 20."""
    vectors = g.table("embeddings")
    return retrieval.nearest_vectors(vectors, vectors.where("vec_id % 20 = 0"))


@query()
def vector_index_search(g: Graph) -> DataFrame:
    """The same by an index over all vectors, which a search reads in part; no SQL, as it may miss some: recall is measured in the tests."""
    vectors = g.table("embeddings")
    index = vector_index.open_index(g.spark, vectors, f"{shared_folder(g.spark)}/vector-index-{uuid.uuid4().hex}")
    return vectors.selectExpr("vec_id AS query", "vec_id", "0D AS score", "0 AS rank").limit(0) if index is None else vector_index.search(index, vectors, vectors.where("vec_id % 20 = 0"))


@query("""WITH u AS (SELECT t.uid, t.name, count(d.src) AS n FROM topics t LEFT JOIN tagged_with d ON d.dst = t.uid GROUP BY t.uid, t.name)
SELECT * FROM (SELECT 'local' AS way, uid, name, 1.0::DOUBLE AS score FROM technologies WHERE contains(lower(name), 'gear') ORDER BY uid LIMIT 50)
UNION ALL SELECT * FROM (SELECT 'global', uid, name, 1.3::DOUBLE FROM u ORDER BY n DESC, uid LIMIT 5)
UNION ALL SELECT * FROM (SELECT 'temporal', uid, title, round(CASE WHEN relevance = 'must-read' THEN 1.7::DOUBLE ELSE 1.5::DOUBLE END, 6) FROM articles WHERE published_date >= DATE '2001-01-01' ORDER BY published_date DESC, uid LIMIT 20)""")
def three_way_retrieval(g: Graph) -> DataFrame:
    used = g.tagged_with.groupBy(F.col("dst").alias("uid")).agg(F.count("*").alias("n"))
    topics = g.topics.join(used, "uid", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return retrieval.three_ways(g.technologies, topics, g.articles, "gear", "2001-01-01")


@query("""WITH m AS (SELECT DISTINCT lower(name) AS mention FROM technologies UNION SELECT lower(name) FROM topics WHERE uid LIKE '%r:%'),
w AS (SELECT DISTINCT uid, unnest(string_split(lower(name), ' ')) AS word FROM technologies), mw AS (SELECT DISTINCT mention, unnest(string_split(mention, ' ')) AS word FROM m),
a AS (SELECT mention, uid, 10.0::DOUBLE AS score FROM m JOIN technologies ON lower(name) = mention UNION ALL SELECT mention, uid, 8.0 FROM m JOIN topics ON lower(name) = mention UNION ALL SELECT mention, uid, 6.0 FROM mw JOIN w USING (word))
SELECT mention, uid, max(score) AS score FROM a GROUP BY mention, uid""")
def resolved_entities(g: Graph) -> DataFrame:
    """The technologies' names and the regions' play the names that questions mention."""
    asked = g.technologies.select(F.lower("name").alias("mention")).union(g.topics.where("uid LIKE '%r:%'").select(F.lower("name"))).distinct()
    return retrieval.resolve(asked, g.technologies, g.topics)


@query("""WITH b AS (SELECT DISTINCT src AS uid, dst AS x FROM (SELECT src, dst FROM depends_on UNION ALL SELECT dst, src FROM depends_on)),
r AS (SELECT DISTINCT uid, x FROM (SELECT uid, x FROM b UNION ALL SELECT a.uid, c.x FROM b a JOIN b c ON a.x = c.uid) WHERE uid <> x),
cl AS (SELECT e AS uid, count(DISTINCT c) AS n FROM (SELECT unnest(related_entities) AS e, uid AS c FROM claims) GROUP BY e),
s AS (SELECT t.uid, (SELECT count(*) FROM b WHERE b.uid = t.uid) AS direct, (SELECT count(*) FROM r WHERE r.uid = t.uid) AS two_hops, coalesce(cl.n, 0) AS claims, 1 AS communities,
  (SELECT count(DISTINCT src) FROM depends_on d WHERE d.dst = t.uid) AS dependents FROM technologies t LEFT JOIN cl ON cl.uid = t.uid),
z AS (SELECT *, round(least(2 * direct + 0.5::DOUBLE * two_hops + 3 * claims + 5 * communities + 10 * dependents, 100.0::DOUBLE), 1) AS score FROM s)
SELECT *, CASE WHEN score >= 70 THEN 'critical' WHEN score >= 40 THEN 'high' WHEN score >= 15 THEN 'medium' ELSE 'low' END AS level FROM z""")
def entity_impact(g: Graph) -> DataFrame:
    claims = g.claims.select(F.explode("related_entities").alias("uid"), F.col("uid").alias("claim"))
    reach = match.reach(g.depends_on, 2)
    return retrieval.impact(g.technologies, g.depends_on, reach, claims, g.technologies.select("uid", F.col("brand").alias("community")))


@query("""WITH e AS (SELECT src, list(DISTINCT dst) AS expected FROM discusses GROUP BY src), f AS (SELECT src, list(DISTINCT dst) AS found FROM discusses WHERE CAST(substr(dst, 6) AS BIGINT) % 3 <> 0 GROUP BY src),
r AS (SELECT a.relevance AS difficulty, CASE WHEN len(expected) > 0 THEN len(list_filter(expected, lambda x: list_contains(coalesce(found, []), x))) / len(expected)::DOUBLE ELSE 0.0 END AS recall FROM e JOIN articles a ON a.uid = e.src LEFT JOIN f ON f.src = e.src)
SELECT coalesce(difficulty, 'overall') AS difficulty, count(*) AS n, round(avg(recall), 6) AS recall, count(*) FILTER (WHERE recall >= 0.7) AS good, count(*) FILTER (WHERE recall >= 0.3 AND recall < 0.7) AS partial, count(*) FILTER (WHERE recall < 0.3) AS poor FROM r GROUP BY ROLLUP (difficulty)""")
def retrieval_scores(g: Graph) -> DataFrame:
    """What an article discusses against the two thirds of it that a search is supposed to find."""
    found = F.collect_set(F.when(F.substring("dst", 6, 20).cast("bigint") % 3 != 0, F.col("dst"))).alias("found")
    both = g.discusses.groupBy(F.col("src").alias("uid")).agg(F.collect_set("dst").alias("expected"), found)
    return retrieval.retrieval_scores(both.join(g.articles, "uid").select(F.col("relevance").alias("difficulty"), "expected", "found"))


@query(r"""WITH c AS (SELECT DISTINCT item_id AS key, lower(unnest(regexp_extract_all(text, '\b[A-Z][A-Za-z0-9-]{1,}(?:\s[A-Z][A-Za-z0-9-]+)*\b'))) AS name FROM benchmark),
f AS (SELECT DISTINCT key, name FROM c WHERE name NOT IN ('the', 'a', 'an', 'and', 'or', 'is', 'was', 'in', 'on', 'for', 'to', 'by')), n AS (SELECT DISTINCT lower(name) AS n FROM nodes)
SELECT key, count(*) AS n_cited, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM n WHERE contains(n.n, f.name))) AS n_grounded FROM f GROUP BY key""")
def grounding(g: Graph) -> DataFrame:
    cited = g.table("benchmark").select(F.col("item_id").alias("key"), F.explode(T.cited_names(F.col("text"))).alias("name"))
    return retrieval.grounded(cited, g.nodes)


@query("""WITH s AS (SELECT uid FROM articles WHERE contains(lower(title), '7') ORDER BY published_date DESC, uid LIMIT 40)
SELECT dst, count(*) AS n FROM edges WHERE type = 'MENTIONS' AND src IN (SELECT uid FROM s) GROUP BY dst ORDER BY n DESC, dst LIMIT 3""")
def concept_expansion(g: Graph) -> DataFrame:
    return retrieval.expand_concept(g.articles, match.of_types(g.edges, "MENTIONS"), "7")


@query("""WITH e AS (SELECT *, CASE type WHEN 'DEPENDS_ON' THEN 'structural' WHEN 'SUBTOPIC_OF' THEN 'hierarchy' ELSE 'unknown' END AS space FROM edges WHERE type IN ('DEPENDS_ON', 'SUBTOPIC_OF', 'AFFILIATED_WITH')),
n AS (SELECT s.name AS src_name, e.type, t.name AS dst_name, max(confidence) AS confidence, any_value(space) AS space FROM e JOIN nodes s ON s.uid = src JOIN nodes t ON t.uid = dst GROUP BY ALL),
r AS (SELECT *, CASE space WHEN 'structural' THEN 1.0::DOUBLE WHEN 'hierarchy' THEN 0.8::DOUBLE WHEN 'unknown' THEN 0.3::DOUBLE END AS weight, row_number() OVER (PARTITION BY space ORDER BY confidence DESC, src_name, type, dst_name) AS rank FROM n) SELECT * FROM r WHERE rank <= 10""")
def ranked_context(g: Graph) -> DataFrame:
    edges = match.of_types(g.edges, "DEPENDS_ON", "SUBTOPIC_OF", "AFFILIATED_WITH").withColumn("space", space_of(F.col("type"), context=True))
    return retrieval.ranked_context(edges, g.nodes, {"structural": 1.0, "hierarchy": 0.8, "unknown": 0.3})

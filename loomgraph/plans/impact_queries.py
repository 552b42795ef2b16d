"""Queries for what questions name, what changes reach, communities of two levels, labels and backlogs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators import communities, impact, loading, match, retrieval
from loomgraph.plans.bindings import Graph, uid
from loomgraph.plans.registry import query


def _strings(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


PHRASES = rf"""q AS (SELECT conv_id, turn, text, lower(text) AS low FROM conversations WHERE role = 'user'),
ph AS (SELECT conv_id, turn, list_concat(
  list_distinct_in_order(list_filter(list_transform(regexp_extract_all(text, '\b[a-zA-Z][a-zA-Z-]{{3,}}\b'), lambda w: lower(w)), lambda w: NOT list_contains({_strings([*T.PHRASE_STOPS, *[k.lower() for k in T.KNOWN_ENTITIES]])}, w))),
  list_distinct_in_order(list_filter(regexp_extract_all(text, '[가-힣]{{3,}}'), lambda w: NOT list_contains({_strings(T.PHRASE_STOPS)}, w))))[1:3] AS phrases FROM q)"""


def in_order(body: str) -> str:
    """DuckDB's list_distinct keeps no order: list_distinct_in_order(x) written out."""
    name = "list_distinct_in_order("
    while name in body:
        start = body.index(name)
        at, depth = start + len(name), 1
        while depth:
            depth += {"(": 1, ")": -1}.get(body[at], 0)
            at += 1
        inner = body[start + len(name) : at - 1]
        body = f"{body[:start]}list_filter({inner}, lambda each, i: list_position({inner}, each) = i){body[at:]}"
    return body


#: Texts of a concept that question_entities looks at, the first by id.
FIRST_TEXTS = 40
HOLDING = """x AS (SELECT DISTINCT unnest(phrases) AS phrase FROM ph), h AS (SELECT phrase, uid, row_number() OVER (PARTITION BY phrase ORDER BY uid) AS k FROM x JOIN claims ON contains(lower(content), phrase)),
m AS (SELECT uid AS src, unnest(related_entities) AS dst FROM claims)"""
RANKED = "r AS (SELECT *, row_number() OVER (PARTITION BY phrase ORDER BY n DESC, dst) AS rank FROM n)"
EXPANDED = f"""{HOLDING}, n AS (SELECT phrase, dst, count(*) AS n FROM h JOIN m ON m.src = h.uid WHERE k <= {FIRST_TEXTS} GROUP BY phrase, dst),
{RANKED}"""


def _phrases(g: Graph) -> DataFrame:
    asked = g.table("conversations").where("role = 'user'").select("conv_id", "turn", "text")
    return asked.withColumn("phrases", T.concept_phrases(F.col("text"), T.KNOWN_ENTITIES))


def _expanded(g: Graph, asked: DataFrame, most: int | None = None) -> DataFrame:
    phrases = asked.select(F.explode("phrases").alias("phrase")).distinct()
    mentions = g.claims.select(F.col("uid").alias("src"), F.explode("related_entities").alias("dst"))
    return retrieval.expand_concepts(phrases, g.claims.select("uid", F.col("content").alias("text")), mentions, most)


@query(in_order(f"WITH {PHRASES}, {HOLDING}, n AS (SELECT phrase, dst, count(*) AS n FROM h JOIN m ON m.src = h.uid GROUP BY phrase, dst), {RANKED} SELECT phrase, dst, n, rank FROM r WHERE rank <= 3"))
def concepts_expanded(g: Graph) -> DataFrame:
    """Entities that stand most often with each concept of all questions, over all texts that have it."""
    return _expanded(g, _phrases(g))


STATIC = ", ".join(f"CASE WHEN {' OR '.join(f'contains(low, {_strings([w])[1:-1]})' for w in words)} THEN {_strings(names)} ELSE [] END" for words, names in T.CONCEPT_ENTITIES)
ENTITIES = rf"""e AS (SELECT conv_id, turn, flatten(list(names ORDER BY place)) AS names FROM (SELECT conv_id, turn, place, list(t.name ORDER BY rank) AS names
  FROM (SELECT conv_id, turn, unnest(phrases) AS phrase, generate_subscripts(phrases, 1) AS place FROM ph) p JOIN r USING (phrase) JOIN technologies t ON t.uid = dst WHERE rank <= 3 GROUP BY ALL) GROUP BY conv_id, turn),
a AS (SELECT conv_id, turn, text, list_distinct_in_order(list_concat(list_filter({_strings(T.KNOWN_ENTITIES)}, lambda w: contains(low, lower(w))), flatten([{STATIC}]), coalesce(names, []))) AS found FROM q LEFT JOIN e USING (conv_id, turn)),
b AS (SELECT *, regexp_extract_all(text, '[A-Z][a-zA-Z0-9-]+(?:\s[A-Z][a-zA-Z0-9-]+)*') AS runs FROM a),
c AS (SELECT *, list_concat(found, list_filter(runs, lambda w, i: list_position(list_transform(runs, lambda v: lower(v)), lower(w)) = i AND NOT list_contains(list_transform(found, lambda v: lower(v)), lower(w)) AND NOT list_contains({_strings(T.PHRASE_STOPS)}, lower(w)))) AS more FROM b),
d AS (SELECT *, regexp_extract_all(text, '[가-힣]{{2,}}') AS hangul FROM c),
f AS (SELECT *, list_concat(more, list_filter(hangul, lambda w, i: list_position(hangul, w) = i AND NOT list_contains({_strings(T.PHRASE_STOPS)}, w) AND NOT list_contains(more, w))) AS most,
  list_filter(regexp_split_to_array(text, '[,?!。？]\s*'), lambda p: length(p) > 4)[1:2] AS clauses FROM d)
SELECT conv_id, turn, array_to_string((CASE WHEN len(most) = 0 THEN [text] WHEN len(most) < 3 THEN list_distinct_in_order(list_concat(most, list_transform(list_filter(clauses, lambda p: NOT list_contains(most, p)), lambda p: trim(p)))) ELSE most END)[1:8], '|') AS entities FROM f WHERE text IS NOT NULL"""


@query(in_order(f"WITH {PHRASES}, {EXPANDED}, {ENTITIES}"))
def question_entities(g: Graph) -> DataFrame:
    """What each question of a user asks about, with the technologies that the graph adds to its concepts."""
    asked = _phrases(g).where("text IS NOT NULL")
    named = _expanded(g, asked, FIRST_TEXTS).join(g.technologies.select(F.col("uid").alias("dst"), "name"), "dst")
    single = asked.select("conv_id", "turn", F.posexplode("phrases").alias("place", "phrase")).join(named, "phrase")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("place", "rank", "name"))), lambda s: s["name"])
    added = single.groupBy("conv_id", "turn").agg(ordered.alias("added"))
    out = asked.join(added, ["conv_id", "turn"], "left")
    return out.select("conv_id", "turn", F.array_join(T.question_entities(F.col("text"), F.col("added")), "|").alias("entities"))


@query("""WITH s AS (SELECT uid FROM technologies WHERE key % 20 = 0), e AS (SELECT *, row_number() OVER () AS id FROM edges), w AS (SELECT id, src, dst, type, confidence FROM e UNION ALL SELECT id, dst, src, type, confidence FROM e),
one AS (SELECT s.uid, w.* FROM s JOIN w ON w.src = s.uid), d AS (SELECT one.uid, 'direct' AS part, type AS kind, label, name, confidence AS score FROM one JOIN nodes n ON n.uid = one.dst),
two AS (SELECT one.uid, one.id AS e1, w.id AS e2, w.dst FROM one JOIN w ON w.src = one.dst AND w.id <> one.id), three AS (SELECT DISTINCT two.uid, w.dst FROM two JOIN w ON w.src = two.dst AND w.id <> e1 AND w.id <> e2),
i AS (SELECT DISTINCT x.uid, n.label, n.name FROM (SELECT uid, dst FROM two UNION SELECT uid, dst FROM three) x JOIN nodes n ON n.uid = x.dst WHERE x.dst <> x.uid), j AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY label, name) AS k FROM i),
f AS (SELECT uid, dst AS at, 1 AS hops FROM one), t AS (SELECT DISTINCT f.uid, w.dst AS at, 2 AS hops FROM f JOIN w ON w.src = f.at WHERE w.dst IN (SELECT src FROM about) AND w.dst <> f.uid),
c AS (SELECT x.uid, about.dst AS claim, min(hops) AS hops FROM (SELECT * FROM f UNION ALL SELECT * FROM t) x JOIN about ON about.src = x.at GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY hops, claim) AS k FROM c),
z AS (SELECT brand, count(*) - 1 AS n FROM technologies GROUP BY brand)
SELECT * FROM d UNION ALL SELECT uid, 'indirect', NULL, label, name, NULL FROM j WHERE k <= 30 UNION ALL SELECT uid, 'claim', NULL, 'Claim', claim, hops FROM r WHERE k <= 10
UNION ALL SELECT uid, 'community', NULL, 'Community', z.brand, n FROM technologies JOIN z ON z.brand = technologies.brand WHERE key % 20 = 0""")
def impact_listing(g: Graph) -> DataFrame:
    """What a change of each technology whose key is divisible by 20 reaches within three edges."""
    members = g.technologies.select("uid", F.col("brand").alias("community"))
    return impact.listing(g.technologies.where("key % 20 = 0"), g.nodes, g.edges, g.about, members)


LINKS = """u AS (SELECT 'topic:n:' || n_nationkey AS uid, 'region ' || n_regionkey AS community FROM nation),
l AS (SELECT t.brand AS c1, u.community AS c2, count(DISTINCT t.uid) AS shared FROM discusses d JOIN technologies t ON t.uid = d.dst JOIN tagged_with g ON g.src = d.src JOIN u ON u.uid = g.dst GROUP BY ALL)"""


def _links(g: Graph) -> DataFrame:
    brands = g.technologies.select("uid", F.col("brand").alias("community"))
    regions = g.table("nation").select(uid("topic:n", F.col("n_nationkey")).alias("uid"), F.concat(F.lit("region "), F.col("n_regionkey").cast("string")).alias("community"))
    return communities.cross_level_links(brands, g.discusses, g.tagged_with, regions)


@query(f"WITH {LINKS} SELECT * FROM l")
def community_parents(g: Graph) -> DataFrame:
    """Brands' communities and the regions' communities over them, by the technologies that tie them."""
    return _links(g)


@query(f"""WITH RECURSIVE {LINKS}, p AS (SELECT DISTINCT '1:' || c1 AS a, '2:' || c2 AS b FROM l), w AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p), reach AS (SELECT a AS id, a AS other FROM w UNION SELECT reach.id, w.b FROM reach JOIN w ON w.a = reach.other),
k AS (SELECT id, min(other) AS component FROM reach GROUP BY id), o AS (SELECT component, count(*) AS members, list(substr(id, 3) ORDER BY id)[1:2] AS names FROM k GROUP BY component)
SELECT CAST(substr(id, 1, 1) AS INT) AS level, substr(id, 3) AS member, 'Meta: ' || array_to_string(names, ' + ') AS meta, members FROM k JOIN o USING (component)""")
def meta_communities(g: Graph) -> DataFrame:
    return communities.meta_communities(_links(g))


@query("""WITH own AS (SELECT uid, brand AS community FROM technologies), c AS (SELECT d.src, t.brand AS community, count(DISTINCT t.uid) AS n FROM discusses d JOIN technologies t ON t.uid = d.dst GROUP BY ALL),
m AS (SELECT src, dst AS uid FROM edges WHERE type IN ('MENTIONS', 'WRITTEN_BY')), t AS (SELECT DISTINCT g.dst AS uid, c.community FROM tagged_with g JOIN c ON c.src = g.src WHERE g.dst NOT IN (SELECT 'topic:n:' || n_nationkey FROM nation WHERE n_regionkey < 3) ORDER BY ALL LIMIT 30),
x AS (SELECT * FROM own UNION SELECT uid, community FROM m JOIN c USING (src) UNION SELECT src, community FROM c WHERE n >= 2 UNION SELECT * FROM t)
SELECT community, string_split(uid, ':')[1] AS kind, count(*) AS members FROM x GROUP BY ALL""")
def communities_enriched(g: Graph) -> DataFrame:
    """Members of each brand's community by kind, once persons, organizations, articles and topics are in."""
    own = g.technologies.select("uid", F.col("brand").alias("community"))
    grouped = g.table("nation").where("n_regionkey < 3").select(uid("topic:n", F.col("n_nationkey")).alias("uid"))
    out = communities.enriched_members(own, g.discusses, match.of_types(g.edges, "MENTIONS", "WRITTEN_BY"), g.tagged_with, grouped)
    return out.groupBy("community", F.substring_index("uid", ":", 1).alias("kind")).agg(F.count("*").alias("members"))


CATEGORY = "CASE kind WHEN 'promo' THEN 'Artifact' WHEN 'large' THEN 'Concept' WHEN 'medium' THEN 'Secret' ELSE 'Environment' END"


@query(f"""WITH t AS (SELECT DISTINCT kind AS type, {CATEGORY} AS category FROM technologies WHERE kind <> 'small' UNION ALL SELECT 'Actor', 'Actor'),
e AS (SELECT t.uid, coalesce(category, 'Actor') AS label FROM technologies t LEFT JOIN t AS c ON c.type = t.kind) SELECT * FROM e WHERE label IN ({_strings(loading.LABELS)[1:-1]})""")
def labels_by_category(g: Graph) -> DataFrame:
    """Labels of technologies by their kind; one kind is not known, one has a category that may not be a label."""
    kinds = g.technologies.where("kind <> 'small'").select(F.col("kind").alias("type"), F.expr(CATEGORY).alias("category")).distinct()
    kinds = kinds.union(kinds.agg(F.lit("Actor").alias("type"), F.lit("Actor").alias("category")))
    return loading.labelled(g.technologies.select("uid", F.col("kind").alias("type")), kinds)


@query("""WITH a AS (SELECT uid, CASE WHEN key % 2 = 0 THEN content END AS long, CASE WHEN key % 3 <> 0 THEN content END AS short FROM claims), e AS (SELECT src, dst FROM supports UNION ALL SELECT src, dst FROM about),
n AS (SELECT uid, count(*) AS rels FROM (SELECT src AS uid FROM e UNION ALL SELECT dst FROM e WHERE src <> dst) GROUP BY uid)
SELECT a.uid, CASE WHEN length(long) > 100 THEN long ELSE short END AS text, coalesce(rels, 0) AS rels FROM a LEFT JOIN n ON n.uid = a.uid WHERE (length(long) > 100 OR length(short) > 30) AND coalesce(rels, 0) <= 5""")
def texts_to_read_again(g: Graph) -> DataFrame:
    """Claims with few edges whose full text or summary is worth reading; every second has a full text, two of three a summary."""
    key = F.col("key")
    rows = g.claims.select("uid", F.when(key % 2 == 0, F.col("content")).alias("full"), F.when(key % 3 != 0, F.col("content")).alias("summary"))
    return loading.to_read_again(rows, g.supports.unionByName(g.about))


@query("""WITH p AS (SELECT uid, lower(regexp_extract(content, '[A-Za-z]{12,}')) AS id, lower(content) AS content FROM claims), o AS (SELECT id, max(uid) AS dst FROM p WHERE id <> '' GROUP BY id)
SELECT DISTINCT p.uid AS src, o.dst, 0.9::DOUBLE AS confidence FROM p JOIN o ON contains(p.content, o.id) AND p.id <> o.id WHERE length(p.content) >= 100""")
def cited_documents(g: Graph) -> DataFrame:
    """Documents, each known by its first word of twelve letters, and those whose text has that word."""
    return loading.cited_ids(g.claims.select("uid", F.regexp_extract("content", "[A-Za-z]{12,}", 0).alias("id"), "content"))


@query("""WITH e AS (SELECT DISTINCT dst AS uid FROM supports), r AS (SELECT c.uid, e.uid IS NOT NULL AS has, CASE WHEN key % 3 > 0 THEN valid_from END AS ts FROM claims c LEFT JOIN e ON e.uid = c.uid)
SELECT count(*) AS total, count(*) FILTER (WHERE has) AS with_evidence, count(*) FILTER (WHERE NOT has) AS to_migrate, count(*) FILTER (WHERE NOT has AND ts IS NOT NULL) AS recoverable, count(*) FILTER (WHERE NOT has AND ts IS NULL) AS without_time FROM r""")
def evidence_migration(g: Graph) -> DataFrame:
    """Claims by whether others support them, and whether the time of their article is known."""
    claimed = g.claims.select("uid", F.when(F.col("key") % 3 > 0, F.col("valid_from")).alias("extracted_at"))
    return loading.evidence_migration(g.claims, g.supports.select(F.col("dst").alias("uid")), claimed)


@query("""WITH n AS (SELECT src AS uid, count(*) AS entities FROM discusses GROUP BY src), r AS (SELECT a.src AS uid, count(*) AS relations FROM depends_on d JOIN discusses a ON a.dst = d.src JOIN discusses b ON b.dst = d.dst AND b.src = a.src GROUP BY a.src)
SELECT n.uid, entities, coalesce(relations, 0) AS relations, coalesce(relations, 0) = 0 OR relations / entities::DOUBLE < 0.7::DOUBLE AS again FROM n LEFT JOIN r ON r.uid = n.uid""")
def second_pass(g: Graph) -> DataFrame:
    """Articles whose technologies have few dependencies among themselves."""
    entities = g.discusses.groupBy(F.col("src").alias("uid")).agg(F.count("*").alias("entities"))
    a = g.discusses.select(F.col("src").alias("uid"), F.col("dst").alias("s"))
    ahead = a.join(g.depends_on.select(F.col("src").alias("s"), F.col("dst").alias("d")), "s").join(a.withColumnRenamed("s", "d"), ["uid", "d"])
    relations = ahead.groupBy("uid").agg(F.count("*").alias("relations"))
    found = entities.join(relations, "uid", "left").withColumn("relations", F.coalesce("relations", F.lit(0)))
    return loading.second_pass(found)


@query("""WITH p AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM edges WHERE src <> dst), d AS (SELECT uid, count(*) AS degree FROM (SELECT a AS uid FROM p UNION ALL SELECT b FROM p) GROUP BY uid)
SELECT 'top' AS end, * FROM (SELECT uid, degree FROM d ORDER BY degree DESC, uid LIMIT 5) UNION ALL SELECT 'bottom', * FROM (SELECT uid, degree FROM d ORDER BY degree, uid DESC LIMIT 5)""")
def degree_extremes(g: Graph) -> DataFrame:
    """The nodes with most and with fewest neighbours."""
    pairs = g.edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).where("a <> b").distinct()
    degree = pairs.select(F.explode(F.array("a", "b")).alias("uid")).groupBy("uid").agg(F.count("*").alias("degree"))
    return loading.extremes(degree, "degree", "uid")


TITLE = "(?i)<title[^>]*>([^<]*)"


@query(f"""WITH t AS (SELECT page_id, lower(coalesce(regexp_extract(html, '{TITLE}', 1), '') || ' ' || coalesce(url, '')) AS t FROM pages)
SELECT page_id, len(list_filter({_strings(T.RELEVANT_WORDS)}, lambda w: contains(t, w))) > 0 AS relevant FROM t""")
def relevant_pages(g: Graph) -> DataFrame:
    return g.table("pages").select("page_id", T.relevant(F.regexp_extract("html", TITLE, 1), F.col("url")).alias("relevant"))


FOUND = ", ".join(f"CASE WHEN regexp_matches(lower(coalesce(text, '')), '{p}') THEN '{m}' END" for m, p in T.MODULES.items())


@query(f"""WITH m AS (SELECT doc_id, list_filter([{FOUND}], lambda x: x IS NOT NULL) AS found FROM documents)
SELECT doc_id, CASE WHEN len(found) = 0 THEN 'general' ELSE array_to_string(found, ',') END AS modules FROM m""")
def document_modules(g: Graph) -> DataFrame:
    return g.table("documents").select("doc_id", F.array_join(T.modules(F.col("text")), ",").alias("modules"))


@query(f"""WITH s AS (SELECT uid, (size - 25) / 25.0::DOUBLE AS stance, size / 50.0::DOUBLE AS influence, name || CASE key % 3 WHEN 0 THEN ' 성장' WHEN 1 THEN ' 위험' ELSE '' END AS quote FROM technologies),
t AS (SELECT *, CASE WHEN stance > 0.3 THEN '{T.TONES["positive"]}' WHEN stance < -0.3 THEN '{T.TONES["negative"]}' ELSE '{T.TONES["neutral"]}' END AS tone FROM s)
SELECT uid, tone, CASE WHEN influence > 0.7 THEN '{T.INTENSITIES["strong"]}' WHEN influence > 0.4 THEN '{T.INTENSITIES["sure"]}' ELSE '{T.INTENSITIES["careful"]}' END AS intensity,
NOT ((stance > 0.3 AND contains(quote, '위험')) OR (stance < -0.3 AND contains(quote, '성장'))) AS fits FROM t""")
def voices(g: Graph) -> DataFrame:
    """Tone and intensity of technologies, and whether what they are quoted with fits their tone."""
    key = F.col("key")
    quote = F.concat("name", F.when(key % 3 == 0, F.lit(" 성장")).when(key % 3 == 1, F.lit(" 위험")).otherwise(F.lit("")))
    rows = g.technologies.select("uid", T.tone((F.col("size") - 25) / 25.0).alias("tone"), T.intensity(F.col("size") / 50.0).alias("intensity"), quote.alias("quote"))
    return rows.select("uid", "tone", "intensity", T.quote_fits(F.col("quote"), F.col("tone")).alias("fits"))


@query("""SELECT uid, trim(replace(replace(name, ' ', '_') || '_', '_', ' ')) AS name, printf('%.0f%%', size / 64.0::DOUBLE * 100) AS share, printf('%.4f', size / 64.0::DOUBLE * 0.5) AS score FROM technologies""")
def formatted_figures(g: Graph) -> DataFrame:
    share = F.col("size") / F.lit(64.0)
    spelled = F.concat(F.replace("name", F.lit(" "), F.lit("_")), F.lit("_"))
    return g.technologies.select("uid", T.clean_name(spelled).alias("name"), T.percent(share).alias("share"), T.fixed(share * 0.5).alias("score"))

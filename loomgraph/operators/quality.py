"""Twelve dimensions of a graph's quality, of 100 points together, from counts that no pair or path has to be listed for."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.match import of_types
from loomgraph.plans.session import written

#: The labels that a whole graph has, those of entities and of content, types of lineage.
LABELS = ["Article", "Paper", "Repo", "Technology", "Person", "Organization", "Topic", "Claim", "Community", "MetaEdge", "Lever", "MetaLever", "CrawlLog"]
ENTITIES, NAMED, CONTENT = ["Technology", "Person", "Organization", "Topic"], ["Technology", "Person", "Organization"], ["Article", "Paper"]
LINEAGE = ["EVOLVED_FROM", "INFLUENCES", "ALTERNATIVE_TO"]
#: Characters left out when names are compared, pairs that are counted at most a label, nodes within two edges that earn all points.
LOOSE = {"Technology": [" ", "-", "."], "Person": [], "Organization": [" "]}
MOST_PAIRS, WIDE = 20, 15
#: Nodes with most edges that are looked at alone before the reach of all is searched.
HUBS = 1_000
#: Points of each dimension.
MOST = {"schema": 8, "rules": 8, "claims": 10, "communities": 10, "edge_metadata": 10, "connectivity": 8, "dedup": 6, "temporal": 8, "enrichment": 8, "retrieval": 8, "depth": 8, "tools": 8}
#: Properties that are read; a table without one of them has null there.
NODE = {
    "name": "string", "active": "boolean", "status": "string", "confidence": "double", "claim_type": "string", "verified": "boolean", "has_history": "boolean", "level": "int",
    "summary": "string", "member_count": "long", "published_date": "string", "full_content": "string",
}
EDGE = {"confidence": "double", "analysis_space": "string", "source": "string", "note": "string", "extracted_at": "string"}


def _with(df: DataFrame, keys: list[str], properties: dict[str, str]) -> DataFrame:
    return df.select(*keys, *[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in properties.items()])


def _one(df: DataFrame, column: Column | None = None) -> int:
    return df.agg(F.coalesce(F.count("*") if column is None else column, F.lit(0))).first()[0]


def equal_pairs(nodes: DataFrame, marks: list[str], most: int = MOST_PAIRS) -> int:
    """Pairs of nodes (uid, name) whose names are equal, case and any one of the marks left out; no more than `most` are counted.

    Names are counted first. Only if no way to compare them gives `most` pairs are the pairs listed, which are then few.
    """
    name = F.lower("name")
    ways = [name, *[F.replace(name, F.lit(m), F.lit("")) for m in marks]]
    keyed = nodes.where("name IS NOT NULL").select("uid", F.posexplode(F.array(*ways)).alias("way", "key")).distinct()
    groups = keyed.groupBy("way", "key").agg(F.count("*").alias("n")).where("n > 1")
    if _one(groups.groupBy("way").agg(F.sum(F.expr("n * (n - 1) div 2")).alias("pairs")), F.max("pairs")) >= most:
        return most
    held = keyed.join(groups.select("way", "key"), ["way", "key"], "left_semi")
    pairs = held.withColumnRenamed("uid", "a").join(held.withColumnRenamed("uid", "b"), ["way", "key"]).where("a < b").select("a", "b")
    return min(most, pairs.distinct().count())


def two_edge_paths(edges: DataFrame, differ: str | None = None) -> int:
    """Paths of two directed edges (src, dst), not the same edge twice; with `differ`, those whose edges differ in that column, neither null.

    At each node edges in times edges out, less those of equal value or, for a loop, itself; no path is listed.
    """
    keyed = edges.select("src", "dst", (F.col(differ) if differ else F.lit("")).alias("key")).where("key IS NOT NULL")
    at = _by_node(keyed)
    if differ:
        return _one(at, F.sum(F.col("paths") - F.col("same")))
    return _one(at, F.sum("paths")) - keyed.where("src = dst").count()


def _by_node(keyed: DataFrame) -> DataFrame:
    """(uid, degree, paths, same): edges (src, dst, key) of each node, a loop once, its edges in times out, and those of equal keys; null keys count in degrees only."""
    loop = F.when(F.col("src") == F.col("dst"), 1).otherwise(0)
    end = lambda c, i, o, loops: F.struct(F.col(c).alias("uid"), "key", F.lit(i).alias("i"), F.lit(o).alias("o"), loops.alias("loops"))
    by_key = keyed.select(F.inline(F.array(end("src", 0, 1, loop), end("dst", 1, 0, F.lit(0))))).groupBy("uid", "key").agg(*[F.sum(c).alias(c) for c in ("i", "o", "loops")])
    known = lambda c: F.coalesce(F.sum(F.when(F.col("key").isNotNull(), c)), F.lit(0))
    i, o = F.col("i"), F.col("o")
    return by_key.groupBy("uid").agg(F.sum(i + o - F.col("loops")).alias("degree"), (known(i) * known(o)).alias("paths"), known(i * o).alias("same"))


def hub_reach(seeds: DataFrame, edges: DataFrame, degrees: DataFrame) -> float:
    """At most what `mean_reach` gives: what seeds (uid) reach over the HUBS nodes with most edges by degrees (uid, degree).

    Only edges at these few nodes are dealt out.
    """
    hubs = F.broadcast(degrees.orderBy(F.desc("degree"), "uid").limit(HUBS).select(F.col("uid").alias("hub")))
    own = edges.select("src", "dst")
    near = own.join(hubs, F.col("src") == F.col("hub")).select("hub", F.col("dst").alias("uid")).unionAll(own.join(hubs, F.col("dst") == F.col("hub")).select("hub", F.col("src").alias("uid")))
    near = written(near.distinct())
    wide = F.broadcast(near.groupBy("hub").agg((F.count("*") - 1).alias("n")))  # a row for each hub
    best = near.join(wide, "hub").groupBy("uid").agg(F.max("n").alias("n"))
    tied = seeds.select("uid").distinct().join(degrees.select("uid"), "uid", "left_semi")
    return _one(tied.join(best, "uid", "left"), F.avg(F.coalesce("n", F.lit(0))))


def mean_reach(seeds: DataFrame, edges: DataFrame, enough: int = WIDE, degrees: DataFrame | None = None) -> float:
    """Mean number of nodes within two undirected edges of the seeds (uid) that have any edge; `enough` at least as a bound if that is clear.

    A seed reaches what its largest neighbour is tied to. Only if these alone do not mean `enough` are the pairs listed, which
    are then few. A seed comes back to itself by two edges between the same nodes. With degrees (uid, degree) of all nodes with edges,
    neighbours with most edges are looked at alone first.
    """
    if degrees is not None and (bound := hub_reach(seeds, edges, degrees)) >= enough:
        return float(bound)
    both = edges.select("src", "dst").unionAll(edges.where("src <> dst").select("dst", "src"))
    near = written(both.groupBy(F.col("src").alias("uid"), F.col("dst").alias("at")).agg(F.count("*").alias("edges")))
    first = near.join(seeds.select("uid").distinct(), "uid", "left_semi")
    wide = near.groupBy(F.col("uid").alias("at")).agg(F.count("*").alias("n"))
    bound = first.join(wide, "at").groupBy("uid").agg(F.max("n").alias("n")).agg(F.avg(F.col("n") - 1)).first()[0]
    if bound is None:
        return 0.0
    if bound >= enough:
        return float(bound)
    second = first.select("uid", F.col("at").alias("mid"), F.col("edges").alias("used")).join(near.select(F.col("uid").alias("mid"), "at", "edges"), "mid")
    # Back over the same edge only if there are two of them; a loop is no second edge after itself.
    second = second.where("(uid <> at OR edges > 1) AND NOT (mid = uid AND at = uid AND edges < 2)")
    pairs = first.select("uid", "at").unionAll(second.select("uid", "at")).distinct()
    return float(pairs.groupBy("uid").agg(F.count("*").alias("n")).agg(F.avg("n")).first()[0])


def _share(part: float, whole: float, full: float) -> float:
    """How much of the share that earns all points is reached, 1 at most."""
    return min(part / whole / full, 1.0) if whole else 0.0


def measures(nodes: DataFrame, edges: DataFrame) -> dict[str, float]:
    """The counts that the dimensions come from: one pass over nodes, one over edges with the labels of their ends, and one by node."""
    # Both are read several times: written once, long texts as their lengths and names only where they are compared.
    short = {"name": F.when(F.col("label").isin(list(LOOSE)), F.col("name")), "summary": F.length("summary"), "full_content": F.length("full_content")}
    nodes = written(_with(nodes, ["uid", "label"], NODE).withColumns(short))
    kinds = {"type": "type", "space": "analysis_space", "inferred": "source <=> 'inferred'"} | {c: f"{of} IS NOT NULL" for c, of in (("noted", "note"), ("sure", "confidence"), ("sourced", "source"), ("timed", "extracted_at"))}
    edges = written(_with(edges, ["src", "dst", "type"], EDGE).select("src", "dst", *[F.expr(e).alias(c) for c, e in kinds.items()]))
    # Types, spaces and what else edges are told apart by are few together: a number for each goes along with an edge, not their texts.
    marks = written(edges.select(*kinds).distinct().withColumn("mark", F.row_number().over(Window.orderBy(*kinds))))
    numbered = F.broadcast(marks.select("mark", *[F.col(c).alias(f"__{c}") for c in kinds]))
    edges = edges.join(numbered, reduce(and_, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in kinds]))
    label, when = F.col("label"), F.count_if
    content, claim, community = label.isin(CONTENT), label == "Claim", label == "Community"
    of_nodes = nodes.agg(
        F.count("*").alias("nodes"), F.size(F.collect_set(F.when(label.isin(LABELS), label))).alias("labels"), when((label == "MetaEdge") & F.col("active")).alias("rules"),
        when(claim).alias("claims"), F.avg(F.when(claim, F.col("confidence"))).alias("sureness"), F.count_distinct(F.when(claim, F.coalesce("claim_type", F.lit("")))).alias("kinds"),
        when(claim & F.col("verified")).alias("verified"), when(claim & F.col("has_history")).alias("histories"),
        when(community).alias("communities"), F.size(F.collect_set(F.when(community, F.coalesce("level", F.lit(0))))).alias("levels"),
        when(community & (F.col("summary") > 0)).alias("summed_up"), when(community & F.col("summary").isNotNull() & (F.col("member_count") > 0)).alias("enriched"),
        when(label.isin(ENTITIES)).alias("entities"), when(label.isin(NAMED)).alias("named"), when(content).alias("content"),
        when(content & (F.col("published_date") != "")).alias("dated"), when(content & (F.col("full_content") > 100)).alias("full"), when(content & (F.col("summary") > 20)).alias("summaries"),
        when((label == "Lever") & (F.col("status") == "active")).alias("levers"), when((label == "MetaLever") & F.col("active")).alias("meta_levers"), when(label == "CrawlLog").alias("logs"),
    ).first().asDict()
    labels = nodes.select("uid", "label")
    source = F.when(F.col("type").isin("MEMBER_OF", "EXECUTED", "CLAIMS"), F.col("src")).alias("source")  # the only ones that are counted once each
    ended = edges.select("src", "dst", "mark", source).join(labels.select(F.col("uid").alias("src"), F.col("label").alias("a")), "src").drop("src")
    ended = ended.join(labels.select(F.col("uid").alias("dst"), F.col("label").alias("b")), "dst").groupBy("mark", "a", "b", "source").agg(F.count("*").alias("n"))
    ended = ended.join(F.broadcast(marks), "mark")
    typed = lambda *t: F.col("type").isin(*t)
    n = lambda c: F.sum(F.when(c, F.col("n")))
    of_edges = ended.agg(
        F.sum("n").alias("edges"), n(F.col("inferred")).alias("inferred"), n(F.col("noted")).alias("notes"), n(F.col("sure")).alias("sure"),
        n(F.col("space").isNotNull()).alias("spaced"), n(F.col("sourced")).alias("sourced"), n(F.col("timed")).alias("timed"), n(F.col("a") != F.col("b")).alias("cross"),
        F.size(F.collect_set("space")).alias("spaces"), F.size(F.collect_set("type")).alias("types"), n(typed("PARENT_COMMUNITY")).alias("parents"), n(typed(*LINEAGE)).alias("lineage"),
        n(typed("SUPPORTS", "CONTRADICTS") & (F.col("a") == "Claim") & (F.col("b") == "Claim")).alias("between_claims"),
        F.count_distinct(F.when(typed("MEMBER_OF") & (F.col("b") == "Community"), F.col("source"))).alias("members"),
        F.count_distinct(F.when(typed("EXECUTED") & (F.col("a") == "Lever") & (F.col("b") == "CrawlLog"), F.col("source"))).alias("executed"),
        F.count_distinct(F.when(typed("CLAIMS") & F.col("a").isin(CONTENT) & (F.col("b") == "Claim"), F.col("source"))).alias("claimed"),
    ).first().asDict()
    by_node = written(_by_node(edges.select("src", "dst", F.col("space").alias("key"))))
    of_ends = by_node.join(labels, "uid").agg(F.count("*").alias("tied"), F.avg(F.when(F.col("label").isin(*CONTENT, "Repo"), F.col("degree"))).alias("edges_of_content")).first().asDict()
    community_edges = of_types(edges, "PARENT_COMMUNITY")
    rest = {
        "pairs": sum(equal_pairs(nodes.where(F.col("label") == name), marks) for name, marks in LOOSE.items()),
        "chains": two_edge_paths(edges.where("inferred")),
        "crossing": _one(by_node, F.sum(F.col("paths") - F.col("same"))),
        "hierarchy": 0 if not of_edges["parents"] else 2 if two_edge_paths(community_edges) else 1,
        "reach": mean_reach(nodes.where("label = 'Article'"), edges, degrees=by_node.select("uid", "degree")),
    }
    return {k: v or 0 for k, v in (of_nodes | of_edges | of_ends | rest).items()}


def dimensions(nodes: DataFrame, edges: DataFrame, tools: float = 0.0, text_index: bool = True) -> DataFrame:
    """(dimension, score, most): the twelve dimensions of nodes (uid, label, properties) and edges (src, dst, type, properties), and their total.

    tools: the share of the planned tools that exist, text_index: whether there is a full-text index, as tables show neither.
    An empty graph has what these two earn and the point for having no equal names, as published. Edges whose ends are
    not both nodes count nowhere but in degrees, reach and paths. Scores are rounded to two places; a total within 0.05 of 100 is 100.
    """
    m = measures(nodes, edges)
    up = lambda name, full: min(m[name] / full, 1.0)
    claims = 2.5 * (min(max((m["sureness"] - 0.3) / 0.5, 0.0), 1.0) + up("kinds", 4) + _share(m["verified"], m["claims"], 0.3) + up("between_claims", 10)) if m["claims"] else 0.0
    communities = 2.5 * (up("levels", 3) + _share(m["members"], m["entities"], 0.5) + _share(m["summed_up"], m["communities"], 0.8) + up("parents", 5)) if m["communities"] else 0.0
    metadata = 2.5 * (sum(_share(m[c], m["edges"], 0.8) for c in ("sure", "spaced", "sourced")) + up("spaces", 6)) if m["edges"] else 0.0
    apart = 1 - (m["nodes"] - m["tied"]) / m["nodes"] / 0.05 if m["nodes"] else 0.0
    connectivity = 2 * (_share(2 * m["edges"], m["nodes"], 3) + max(apart, 0.0) + _share(m["cross"], m["edges"], 0.7) + up("types", 15)) if m["nodes"] else 0.0
    scores = {
        "schema": m["labels"] / len(LABELS) * 8,
        "rules": up("rules", 6) * 3 + up("inferred", 20) * 3 + up("notes", 10) * 2,
        "claims": claims,
        "communities": communities,
        "edge_metadata": metadata,
        "connectivity": connectivity,
        "dedup": max(1 - (m["pairs"] / m["named"] if m["named"] else 0.0) / 0.1, 0.0) * 6,
        "temporal": 2 * (_share(m["histories"], m["claims"], 0.5) + _share(m["dated"], m["content"], 0.8) + _share(m["timed"], m["edges"], 0.3) + up("logs", 3)),
        "enrichment": 1.5 * (up("levers", 6) + up("meta_levers", 2) + up("inferred", 50) + _share(m["enriched"], m["communities"], 0.8)) + 2 * up("executed", 2),
        "retrieval": 1.5 * (_share(m["full"], m["content"], 0.6) + _share(m["summaries"], m["content"], 0.8) + up("edges_of_content", 5) + _share(m["claimed"], m["content"], 0.7)) + text_index + up("reach", WIDE),
        "depth": 2 * (up("lineage", 5) + up("between_claims", 20)) + 1.5 * (up("chains", 10) + up("crossing", 20)) + up("hierarchy", 2),
        "tools": min(tools / 0.8, 1.0) * 8,
    }
    scores = {k: min(round(v + 1e-9, 2), float(MOST[k])) for k, v in scores.items()}
    most = sum(MOST.values())
    total = round(sum(scores.values()), 2)
    rows = [(k, v, MOST[k]) for k, v in scores.items()] + [("total", float(most) if most - total < 0.05 else total, most)]
    return nodes.sparkSession.createDataFrame(rows, "dimension string, score double, most int")

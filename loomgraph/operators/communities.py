"""Communities and structure: grouped components, label spreading, centrality, bridges, holes and cycles."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.components import FEW, connected_components
from loomgraph.plans.session import checkpointed, piled, shared_folder, together, written


def community_name(names: Column) -> Column:
    """Up to three names joined, else the first two as an ecosystem."""
    head = F.array_join(F.slice(names, 1, 2), " & ")
    return F.when(F.size(names) <= 3, F.array_join(names, " & ")).otherwise(F.concat(head, F.lit(" Ecosystem")))


def component_communities(pairs: DataFrame, nodes: DataFrame, least: int = 2) -> DataFrame:
    """(community, name, members) of the components of pairs (a, b) with at least so many nodes.

    Only the first four names are carried for the community's name, however many members it has.
    """
    members = connected_components(pairs, "a", "b").join(nodes.select(F.col("uid").alias("id"), "name"), "id")
    sized = members.groupBy("component").agg(F.count("*").alias("members")).where(F.col("members") >= least)
    first = members.withColumn("k", F.row_number().over(Window.partitionBy("component").orderBy("name", "id"))).where("k <= 4")
    named = first.groupBy("component").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "name"))), lambda s: s["name"]).alias("names"))
    return sized.join(named, "component").select(F.col("component").alias("community"), community_name(F.col("names")).alias("name"), "members")


def cross_level_links(lower: DataFrame, discusses: DataFrame, tagged: DataFrame, upper: DataFrame) -> DataFrame:
    """(c1, c2, shared): communities of members that content discusses, and of topics that the same content is tagged with;
    shared is the number of different members. lower and upper: (uid, community).
    """
    seen = discusses.select("src", F.col("dst").alias("uid")).join(lower.select("uid", F.col("community").alias("c1")), "uid")
    above = tagged.select("src", F.col("dst").alias("uid")).join(upper.select("uid", F.col("community").alias("c2")), "uid").select("src", "c2").distinct()
    return seen.join(above, "src").select("c1", "c2", "uid").distinct().groupBy("c1", "c2").agg(F.count("*").alias("shared"))


def meta_communities(links: DataFrame) -> DataFrame:
    """(member, level, meta, members): communities of both levels that links (c1, c2) connect; each group is named after its
    first two members.
    """
    key = lambda level, c: F.concat(F.lit(f"{level}:"), F.col(c).cast("string"))
    members = connected_components(links.select(key(1, "c1").alias("a"), key(2, "c2").alias("b")), "a", "b")
    first = members.withColumn("k", F.row_number().over(Window.partitionBy("component").orderBy("id"))).where("k <= 2")
    named = first.groupBy("component").agg(F.concat(F.lit("Meta: "), F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda i: F.substring_index(i, ":", -1)), " + ")).alias("meta"))
    sized = members.groupBy("component").agg(F.count("*").alias("members"))
    level, name = F.substring("id", 1, 1).cast("int").alias("level"), F.expr("substring(id, 3)").alias("member")
    return members.join(named.join(sized, "component"), "component").select(name, level, "meta", "members")


def enriched_members(own: DataFrame, discusses: DataFrame, mentions: DataFrame, tagged: DataFrame, in_groups: DataFrame, least: int = 2, topics: int = 30) -> DataFrame:
    """(uid, community): members and those that content ties to them.

    Of content that discusses a community's members: whom it mentions, itself if it discusses so many of them, and the first
    topics it is tagged with over all communities, unless they are in a group (uid) of their own.
    """
    own = own.select("uid", "community").distinct()
    seen = discusses.select("src", F.col("dst").alias("uid")).join(own, "uid").distinct()
    content = seen.groupBy("src", "community").agg(F.count("*").alias("n"))
    named = mentions.select("src", F.col("dst").alias("uid")).join(content.select("src", "community"), "src").select("uid", "community")
    itself = content.where(F.col("n") >= least).select(F.col("src").alias("uid"), "community")
    loose = tagged.select("src", F.col("dst").alias("uid")).join(in_groups.select("uid"), "uid", "left_anti")
    themes = loose.join(content.select("src", "community"), "src").select("uid", "community").distinct()
    themes = themes.join(own, ["uid", "community"], "left_anti").orderBy("uid", "community").limit(topics)
    return own.unionByName(named).unionByName(itself).unionByName(themes).distinct()


def spread_labels(pairs: DataFrame, rounds: int = 5) -> DataFrame:
    """(uid, community): every node takes the label of greatest total weight around it (least label of equals), for some rounds.

    A deterministic stand-in for a randomised modularity method; pairs are (a, b, n).
    """
    both = checkpointed(pairs.select("a", "b", "n").unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "n")))
    labels = both.select(F.col("a").alias("uid")).distinct().withColumn("community", F.col("uid"))
    for _ in range(rounds):
        votes = both.join(labels.select(F.col("uid").alias("b"), "community"), "b").groupBy("a", "community").agg(F.sum("n").alias("w"))
        best = votes.groupBy("a").agg(F.min(F.struct((-F.col("w")).alias("less"), F.col("community").alias("community")))["community"].alias("community"))
        labels = checkpointed(best.withColumnRenamed("a", "uid"))
    return labels


def topic_groups(topic_members: DataFrame, least_members: int = 2, least_shared: int = 2, rounds: int = 1000) -> DataFrame:
    """(topic, seed): topics in order of id; each that is left seeds a group of those left that share enough members with it.

    topic_members: (topic, member). A round takes the least topic left, so there are as many rounds as groups: this is for
    topics, of which there are few, not for members.
    """
    own = topic_members.select("topic", "member").distinct()
    big = own.groupBy("topic").agg(F.count("*").alias("n")).where(F.col("n") >= least_members).select("topic")
    shared = own.join(own.withColumnRenamed("topic", "other"), "member").groupBy("topic", "other").agg(F.count("*").alias("n")).where((F.col("n") >= least_shared) & (F.col("topic") <= F.col("other")))
    shared, left, done = checkpointed(shared), checkpointed(big), None
    for _ in range(rounds):
        seed = left.agg(F.min("topic").alias("seed")).first()["seed"]
        if seed is None:
            break
        group = shared.where(F.col("topic") == seed).select(F.col("other").alias("topic")).join(left, "topic", "left_semi")
        taken = checkpointed(group.withColumn("seed", F.lit(seed)))
        left = checkpointed(left.join(taken.select("topic"), "topic", "left_anti"))
        done = taken if done is None else done.unionAll(taken)
    else:
        raise RuntimeError(f"topics are left after {rounds} rounds")
    return done if done is not None else big.withColumn("seed", F.lit(None).cast("string")).limit(0)


def degree_centrality(edges: DataFrame) -> DataFrame:
    """Neighbours of each node over all other nodes, edges taken as undirected and single."""
    pairs = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).where("a <> b").distinct()
    degree = pairs.select(F.explode(F.array("a", "b")).alias("uid")).groupBy("uid").agg(F.count("*").alias("degree"))
    total = F.broadcast(degree.agg(F.count("*").alias("total")))  # one row
    return degree.crossJoin(total).withColumn("centrality", F.round(F.col("degree") / (F.col("total") - 1), 6)).drop("total")


def page_rank(edges: DataFrame, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """(uid, rank) after a fixed number of rounds; weights split a node's rank, and nodes without out-edges spread theirs evenly."""
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("uid")).distinct()
    share = checkpointed(edges.groupBy("src", "dst").agg(F.sum("weight").alias("w")).withColumn("share", F.col("w") / F.sum("w").over(Window.partitionBy("src"))).select("src", "dst", "share"))
    n = nodes.count()
    ends = nodes.join(share.select(F.col("src").alias("uid"), F.lit(True).alias("leads")).distinct(), "uid", "left")
    ranks = checkpointed(ends.select("uid", F.col("leads").isNull().alias("dangling"), F.lit(1.0 / n).alias("rank")))
    for i in range(rounds):
        lost = ranks.where("dangling").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
        given = share.join(ranks.select(F.col("uid").alias("src"), "rank"), "src").groupBy("dst").agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        base = ranks.select("uid", "dangling").join(given.withColumnRenamed("dst", "uid"), "uid", "left").crossJoin(F.broadcast(lost))  # one row
        ranks = base.select("uid", "dangling", ((1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / n)).alias("rank"))
        if i % 5 == 4:
            ranks = checkpointed(ranks)
    return ranks.select("uid", "rank")


def bridges(edges: DataFrame, communities: DataFrame, least: int = 2, k: int = 10) -> DataFrame:
    """(uid, n): nodes with neighbours in several communities other than their own, most first."""
    pairs = edges.select("src", "dst").unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    own = pairs.join(communities.select(F.col("uid").alias("src"), F.col("community").alias("home")), "src")
    away = own.join(communities.select(F.col("uid").alias("dst"), "community"), "dst").where("community <> home")
    return away.groupBy(F.col("src").alias("uid")).agg(F.count_distinct("community").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "uid").limit(k)


def structural_holes(edges: DataFrame, communities: DataFrame, most: float = 0.05, k: int = 10) -> DataFrame:
    """(a, b, density): pairs of communities with the fewest edges between them for their sizes, pairs without any included."""
    sizes = communities.groupBy("community").agg(F.count("*").alias("n"))
    left, right = sizes.select(F.col("community").alias("a"), F.col("n").alias("na")), sizes.select(F.col("community").alias("b"), F.col("n").alias("nb"))
    grid = left.join(F.broadcast(right) if sizes.count() <= 10_000 else right, F.col("a") < F.col("b"))
    of = lambda end, name: communities.select(F.col("uid").alias(end), F.col("community").alias(name))
    crossing = edges.join(of("src", "x"), "src").join(of("dst", "y"), "dst").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    counted = grid.join(crossing.groupBy("a", "b").agg(F.count("*").alias("e")), ["a", "b"], "left")
    density = F.round(F.coalesce("e", F.lit(0)) / (2.0 * F.col("na") * F.col("nb")), 6)
    return counted.select("a", "b", density.alias("density")).where(F.col("density") < most).orderBy("density", "a", "b").limit(k)


def simple_cycles(edges: DataFrame, longest: int = 5) -> DataFrame:
    """(path, length): directed cycles of 2 to `longest` distinct nodes, each once, from its least node."""
    step = edges.select("src", "dst").where("src <> dst").distinct()
    paths, found = step.where("dst > src").select(F.col("src").alias("start"), F.col("dst").alias("at"), F.array("src", "dst").alias("path")), None
    for length in range(2, longest + 1):
        back = paths.join(step.select(F.col("src").alias("at"), F.col("dst").alias("start")), ["at", "start"]).select("path", F.lit(length).alias("length"))
        found = back if found is None else found.unionAll(back)
        if length < longest:
            ahead = paths.join(step, paths["at"] == step["src"]).where((F.col("dst") > F.col("start")) & ~F.array_contains("path", F.col("dst")))
            paths = ahead.select("start", F.col("dst").alias("at"), F.array_append("path", F.col("dst")).alias("path"))
    return found


#: Rows of state (a source and a node that it reaches) of one block of sources, at most.
STATE = 200_000_000
#: Edges up to which a core is sent to the tasks, the numbers that a search there holds at a time, and tasks at most.
SENT, HELD, MOST_TASKS = 500_000, 2_000_000, 10_000


def _without_trees(step: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The graph once nodes of one neighbour are taken off, again and again: its edges, its nodes, and the nodes that are gone.

    Nodes are (uid, w, squares): w counts the node and all that hung on it, squares sums the squares of the sizes of what hung on it, neighbour by
    neighbour. Of two nodes that only have each other one stays. Each round also takes two steps off the longest paths that are searched later.
    A node carries the number of its neighbours and these in one number (all combined by exclusive or, so the last one left is told by it): a round reads no edges.
    """
    few = nodes.count() <= FEW
    number = written(nodes.select("uid", F.monotonically_increasing_id().alias("id")))
    ends = step.join(number.select(F.col("uid").alias("dst"), F.col("id").alias("other")), "dst")
    around = ends.groupBy(F.col("src").alias("uid")).agg(F.count("*").alias("n"), F.bit_xor("other").alias("near"))
    state = written(number.join(around, "uid").select("uid", "id", "n", "near", F.lit(1.0).alias("w"), F.lit(0.0).alias("squares"), F.lit(False).alias("gone")))
    one = F.expr("n = 1 AND NOT gone")
    while not state.where(one).isEmpty():
        hung = state.where(one).groupBy(F.col("near").alias("at")).agg(F.count("*").alias("less"), F.bit_xor("id").alias("those"), F.sum("w").alias("more"), F.sum(F.col("w") * F.col("w")).alias("square"))
        met = state.join(F.broadcast(hung) if few else hung, F.expr("id = at"), "left")
        met = met.withColumn("goes", one & (F.col("at").isNull() | (F.col("id") > F.col("near")))).withColumn("takes", F.expr("at IS NOT NULL AND NOT goes"))
        to = lambda name, value: F.when(F.col("takes"), value).otherwise(F.col(name)).alias(name)
        changed = [to("n", F.col("n") - F.col("less")), to("near", F.col("near").bitwiseXOR(F.col("those"))), to("w", F.col("w") + F.col("more")), to("squares", F.col("squares") + F.col("square"))]
        state = written(met.select("uid", "id", *changed, F.expr("gone OR goes").alias("gone")))
    left, gone = (state.where(which).select("uid", "w", "squares") for which in ("NOT gone", "gone"))
    for end in ("src", "dst"):
        step = step.join(state.where("gone").select(F.col("uid").alias(end)), end, "left_anti")
    return written(step.select("src", "dst")), left, gone


def _sent_dependencies(step: DataFrame, sources: DataFrame, nodes: DataFrame) -> DataFrame:
    """As _block_dependencies, for so few edges that each task holds all and searches from its own sources."""
    ends = step.select("src", "dst").toPandas()
    if ends.empty:
        return sources.select("uid", F.lit(0.0).alias("owed")).limit(0)
    uids, src = np.unique(ends["src"].to_numpy(dtype=object), return_inverse=True)
    place = {uid: i for i, uid in enumerate(uids)}
    order = np.argsort(src, kind="stable")
    near = ends["dst"].map(place).to_numpy()[order]
    begin = np.searchsorted(src[order], np.arange(len(uids)))
    weight = np.ones(len(uids))
    for uid, w in nodes.join(step.select(F.col("src").alias("uid")).distinct(), "uid", "left_semi").select("uid", "w").toPandas().itertuples(index=False):
        weight[place[uid]] = w

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(uids))
        for batch in batches:
            own = batch[batch["uid"].isin(place.keys())]
            at, w = own["uid"].map(place).to_numpy(dtype=np.int64), own["w"].to_numpy(dtype=float)
            size = max(1, HELD // len(near))
            for low in range(0, len(at), size):
                total += _owed(near, begin, weight, at[low : low + size]) @ w[low : low + size]
        hit = np.flatnonzero(total)
        yield pd.DataFrame({"uid": uids[hit], "owed": total[hit]})

    work = sources.count() * len(near)
    return sources.select("uid", "w").repartition(min(MOST_TASKS, 1 + work // HELD)).mapInPandas(run, "uid string, owed double")


def _owed(near: np.ndarray, begin: np.ndarray, weight: np.ndarray, sources: np.ndarray) -> np.ndarray:
    """(node, source): what the shortest paths from each source owe to the nodes on them; near holds the neighbours of each node, from begin on."""
    whole = lambda values: np.add.reduceat(values[near], begin, axis=0)
    level, paths = np.full((len(begin), len(sources)), -1, np.int32), np.zeros((len(begin), len(sources)))
    level[sources, np.arange(len(sources))], paths[sources, np.arange(len(sources))] = 0, 1.0
    front, last = paths.copy(), 0
    while True:
        ahead = whole(front)
        new = (ahead > 0) & (level < 0)
        if not new.any():
            break
        last += 1
        level[new] = last
        front = np.where(new, ahead, 0.0)
        paths += front
    more = np.zeros_like(paths)
    for d in range(last, 1, -1):
        due = np.where(level == d, weight[:, None] / np.maximum(paths, 1.0) + more, 0.0)
        more += np.where(level == d - 1, whole(due), 0.0)
    return np.where(level > 0, paths * more, 0.0)


def _block_dependencies(step: DataFrame, sources: DataFrame, nodes: DataFrame) -> DataFrame:
    """(uid, owed), a row or several of each node: what the shortest paths from the sources (uid, w) to the nodes (uid, w), each counted w times at both
    ends, owe to other nodes on them; nodes without any have no row.

    Levels of a breadth-first search from all sources of the block count shortest paths; going back, each node's dependency is shared
    among those before it.
    """
    if step.count() <= SENT:
        return _sent_dependencies(step, sources, nodes)
    level = written(sources.select(F.col("uid").alias("s"), F.col("uid").alias("v"), F.lit(1.0).alias("paths")))
    levels, far, total = [level], F.lit(None).cast("double"), []
    while True:
        ahead = level.join(step, level["v"] == step["src"]).select("s", F.col("dst").alias("v"), "paths", F.lit(True).alias("new"))
        for known in levels[-2:]:  # neighbours of a level are in it, in the one before, or new
            ahead = ahead.unionByName(known.select("s", "v", "paths", F.lit(False).alias("new")))
        level = written(ahead.groupBy("s", "v").agg(F.sum("paths").alias("paths"), F.min("new").alias("new")).where("new").select("s", "v", "paths"))
        if level.isEmpty():
            break
        levels.append(level)
    # Of each node: what it and all that its paths lead on to owe, for each path to it; its neighbours one level before take that on.
    weights, turned = nodes.select(F.col("uid").alias("v"), "w"), step.select(F.col("dst").alias("v"), F.col("src").alias("u"))
    back = None
    for d in range(len(levels) - 1, 0, -1):
        own = levels[d].join(weights, "v").select("s", "v", "paths", "w", far.alias("more"))
        if back is not None:
            handed = back.select("s", "v", (F.col("w") / F.col("paths") + F.col("more")).alias("due")).join(turned, "v")
            own = own.unionByName(handed.select("s", F.col("u").alias("v"), far.alias("paths"), far.alias("w"), F.col("due").alias("more")))
        sums = own.groupBy("s", "v").agg(F.max("paths").alias("paths"), F.max("w").alias("w"), F.coalesce(F.sum("more"), F.lit(0.0)).alias("more"))
        back = written(sums.where("paths IS NOT NULL"))
        total = piled(total, back)
    owed = (together(total) if total else levels[0].withColumn("more", F.lit(0.0)).limit(0)).select("s", "v", (F.col("paths") * F.col("more")).alias("owed"))
    return owed.join(sources.select(F.col("uid").alias("s"), "w"), "s").select(F.col("v").alias("uid"), (F.col("owed") * F.col("w")).alias("owed"))


def betweenness(edges: DataFrame, share: float = 1.0, state: int = STATE) -> DataFrame:
    """(uid, score): of all shortest paths between two other nodes of an undirected graph, whatever their length, the share that passes through uid.

    Trees that hang on the graph are taken off first: what passes through their nodes is known from the sizes of what hangs on them, and each node
    that is left stands for all that hung on it (share 1 only). Sources are taken in blocks whose state, sources x nodes, is bounded; each block's sums are
    written before the next begins, so a graph of any size takes bounded space. share < 1 takes that share of sources (by hash) and scales their sums up: an estimate whose
    error is below e with probability 1 - 2 n exp(-2 k e^2) for k sources and n nodes; share 1 is exact. Loops and parallel edges change nothing.
    """
    spark = edges.sparkSession
    whole = written(edges.select("src", "dst").unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct())
    nodes = written(whole.select(F.col("src").alias("uid")).distinct())
    n = nodes.count()
    step, core, gone = whole, nodes.withColumns({"w": F.lit(1.0), "squares": F.lit(0.0)}), None
    if share == 1.0:
        step, core, gone = _without_trees(whole, nodes)
    turn = F.pmod(F.xxhash64(F.col("uid"), F.lit("source")), F.lit(1 << 30))
    sources = core.where(turn < int(share * (1 << 30)))
    k = sources.count()
    blocks = max(1, -(-k * core.count() // state))
    into = f"{shared_folder(spark)}/betweenness-{uuid.uuid4().hex}"
    for block in range(blocks):
        some = sources.where(F.pmod(F.xxhash64("uid"), F.lit(blocks)) == block)
        _block_dependencies(step, some, core).groupBy("uid").agg(F.sum("owed").alias("owed")).write.mode("append").parquet(into)
    sums = spark.read.parquet(into).groupBy("uid").agg(F.sum("owed").alias("owed"))
    if gone is not None:
        # Of pairs that a node parts: all pairs of others, less those on one side of it.
        known = core.unionByName(gone)
        part = connected_components(whole).withColumnRenamed("id", "uid")
        known = known.join(part, "uid").join(part.groupBy("component").agg(F.count("*").cast("double").alias("size")), "component")
        rest = F.col("size") - F.col("w")
        parted = (F.col("size") - 1) * (F.col("size") - 1) - rest * rest - F.col("squares")
        sums = known.select("uid", parted.alias("owed")).unionByName(sums).groupBy("uid").agg(F.sum("owed").alias("owed"))
    scale = (n / max(k, 1) if gone is None else 1) / max((n - 1) * (n - 2), 1)
    return nodes.join(sums, "uid", "left").select("uid", F.round(F.coalesce("owed", F.lit(0.0)) * scale, 9).alias("score"))

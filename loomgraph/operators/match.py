"""Pattern matching on edge tables (src, dst, type, ...): hops, anti-patterns, pairs over shared members, bounded paths.

Every hop is an equi-join on an endpoint. Pairs that share a member explode the members and join on them, so no
cartesian product over nodes is ever planned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.plans.session import checkpointed, shuffled


def both_ways(edges: DataFrame) -> DataFrame:
    """Every edge from either of its ends."""
    turned = edges.select(*[F.col({"src": "dst", "dst": "src"}.get(c, c)).alias(c) for c in edges.columns])
    return edges.unionAll(turned)


def of_types(edges: DataFrame, *types: str) -> DataFrame:
    return edges.where(F.col("type").isin(*types))


def top_per(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str | None = None) -> DataFrame:
    """The first k rows of each group in a total order (Spark pushes the limit below the sort's shuffle)."""
    name = rank or "__rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)
    return out if rank else out.drop(name)


def neighbours(nodes: DataFrame, edges: DataFrame, limit: int = 20) -> DataFrame:
    """(uid, type, neighbour, name): undirected neighbours of each node, at most `limit` for each; uid tells the nodes apart.

    Names, which may be long texts, are looked up once it is known which neighbours are among the first.
    """
    # Each pair once before it is turned: half of the rows to tell apart. A null end comes first.
    back = (F.col("src") > F.col("dst")) | F.col("dst").isNull()
    pairs = edges.select(F.when(back, F.col("dst")).otherwise(F.col("src")).alias("a"), F.when(back, F.col("src")).otherwise(F.col("dst")).alias("b"), "type").distinct()
    step = lambda src, dst: F.struct(F.col(src).alias("src"), F.col(dst).alias("dst"), "type")
    ways = F.when(F.col("a").eqNullSafe(F.col("b")), F.array(step("a", "b"))).otherwise(F.array(step("a", "b"), step("b", "a")))
    known = nodes.select(F.col("uid").alias("dst"))
    near = pairs.select(F.inline(ways)).where("dst IS NOT NULL").join(shuffled(known), "dst", "left_semi")
    first = top_per(near, ["src"], [F.col("type"), F.col("dst")], limit)
    named = first.join(shuffled(nodes.select(F.col("uid").alias("dst"), "name")), "dst")
    return named.select(F.col("src").alias("uid"), "type", F.col("dst").alias("neighbour"), "name")


def two_hops_without_shortcut(edges: DataFrame) -> DataFrame:
    """(src, dst): a -> b -> c where a -> c is missing and a is not c."""
    first = edges.select("src", F.col("dst").alias("mid"))
    second = edges.select(F.col("src").alias("mid"), "dst")
    return first.join(second, "mid").where("src <> dst").select("src", "dst").distinct().join(edges.select("src", "dst"), ["src", "dst"], "left_anti")


def shared_members(rows: DataFrame, key: str, members: str) -> DataFrame:
    """(a, b, shared): pairs a < b of keys whose arrays share members; shared counts a's entries that b has, repeats included."""
    single = rows.select(key, F.explode(members).alias("m"))
    left = single.groupBy(F.col(key).alias("a"), "m").agg(F.count("*").alias("n"))
    right = single.select(F.col(key).alias("b"), "m").distinct()
    return left.join(right, "m").where("a < b").groupBy("a", "b").agg(F.sum("n").alias("shared"))


def co_occurrence(edges: DataFrame) -> DataFrame:
    """(a, b, n): pairs a < b of targets with the number of sources that point at both."""
    own = edges.select("src", "dst").distinct()
    return own.select("src", F.col("dst").alias("a")).join(own.select("src", F.col("dst").alias("b")), "src").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))


def reach(edges: DataFrame, depth: int) -> DataFrame:
    """(uid, reached, distance): nodes reached from every edge end within `depth` undirected hops, the end itself left out."""
    step = both_ways(edges.select("src", "dst")).distinct()
    frontier = found = step.select(F.col("src").alias("uid"), F.col("dst").alias("reached"), F.lit(1).alias("distance")).where("uid <> reached")
    for d in range(2, depth + 1):
        ahead = frontier.select("uid", F.col("reached").alias("src")).join(step, "src").select("uid", F.col("dst").alias("reached"), F.lit(d).alias("distance")).where("uid <> reached")
        frontier = ahead.distinct().join(found.select("uid", "reached"), ["uid", "reached"], "left_anti")
        found = found.unionAll(frontier)
    return found


def trails(seeds: DataFrame, edges: DataFrame, depth: int, limit: int | None = None) -> DataFrame:
    """(seed, path, hops): undirected walks from seeds that use no edge twice, as arrays of node ids."""
    numbered = edges.select("src", "dst", F.concat_ws("|", "src", "type", "dst").alias("edge"))
    step = both_ways(numbered)
    paths = seeds.select(F.col("uid").alias("seed"), F.col("uid").alias("at"), F.array("uid").alias("path"), F.array().cast("array<string>").alias("used"))
    out = None
    for hops in range(1, depth + 1):
        paths = paths.join(step, paths["at"] == step["src"]).where(~F.array_contains("used", F.col("edge")))
        paths = paths.select("seed", F.col("dst").alias("at"), F.array_append("path", F.col("dst")).alias("path"), F.array_append("used", F.col("edge")).alias("used"))
        if limit is not None:
            paths = top_per(paths, ["seed"], [F.array_join("path", ">")], limit)
        level = paths.select("seed", "path", F.lit(hops).alias("hops"))
        out = level if out is None else out.unionAll(level)
    return out


def shortest_distance(edges: DataFrame, pairs: DataFrame, depth: int = 5) -> DataFrame:
    """(a, b, distance) of each wanted pair within `depth` undirected hops; null beyond. Searches only from the wanted starts."""
    step = both_ways(edges.select("src", "dst")).distinct()
    frontier = seen = pairs.select(F.col("a").alias("seed"), F.col("a").alias("at"), F.lit(0).alias("distance")).distinct()
    for d in range(1, depth + 1):
        ahead = frontier.join(step, frontier["at"] == step["src"]).select("seed", F.col("dst").alias("at"), F.lit(d).alias("distance")).distinct()
        frontier = checkpointed(ahead.join(seen.select("seed", "at"), ["seed", "at"], "left_anti"))
        seen = seen.unionAll(frontier)
    near = seen.select(F.col("seed").alias("a"), F.col("at").alias("b"), "distance")
    return pairs.select("a", "b").distinct().join(near, ["a", "b"], "left")


#: Paths of a pair that are told.
ROUTES = 3


def _shortest_parts(starts: DataFrame, step: DataFrame, depth: int, forward: bool) -> list[DataFrame]:
    """For each number of hops up to depth, (seed, at, paths): nodes at that distance from the seed and their ROUTES least shortest paths.

    Forward paths go from the seed to the node, others from the node to the seed; more than the least few never matter, as all paths
    of a node and distance are of one length and go on in the same ways.
    """
    level = checkpointed(starts.select("seed", F.col("seed").alias("at"), F.array(F.array("seed")).alias("paths")))
    levels, seen = [level], level.select("seed", "at")
    for _ in range(depth):
        grown = F.array_append("path", F.col("dst")) if forward else F.array_prepend("path", F.col("dst"))
        ahead = level.join(step, level["at"] == step["src"]).select("seed", "dst", F.explode("paths").alias("path"))
        ahead = ahead.join(seen.withColumnRenamed("at", "dst"), ["seed", "dst"], "left_anti").select("seed", F.col("dst").alias("at"), grown.alias("path"))
        few = top_per(ahead, ["seed", "at"], [F.col("path")], ROUTES)
        level = checkpointed(few.groupBy("seed", "at").agg(F.array_sort(F.collect_list("path")).alias("paths")))
        levels.append(level)
        seen = seen.unionAll(level.select("seed", "at"))
    return levels


def shortest_routes(edges: DataFrame, pairs: DataFrame, depth: int = 5) -> DataFrame:
    """(a, b, distance, rank, path): of each wanted pair the first ROUTES of its shortest undirected paths of at most `depth` hops.

    Two searches meet in the middle: from the starts over half of the hops and from the ends over the other half, so neither goes as far as a
    search from one end, and only nodes where both meet make paths. A pair of one node has the path of that node; pairs too far apart have no rows.
    """
    wanted = checkpointed(pairs.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL").distinct())
    step = checkpointed(both_ways(edges.select("src", "dst")).where("src <> dst").distinct())
    ahead = _shortest_parts(wanted.select(F.col("a").alias("seed")).distinct(), step, (depth + 1) // 2, forward=True)
    back = _shortest_parts(wanted.select(F.col("b").alias("seed")).distinct(), step, depth // 2, forward=False)
    left, found = wanted, None
    for d in range(depth + 1):
        near, far = ahead[(d + 1) // 2], back[d // 2]
        met = left.join(near.select(F.col("seed").alias("a"), "at", "paths"), "a").join(far.select(F.col("seed").alias("b"), "at", F.col("paths").alias("rest")), ["b", "at"])
        whole = F.flatten(F.transform("paths", lambda p: F.transform("rest", lambda r: F.concat(p, F.slice(r, F.lit(2), F.size(r))))))
        routes = top_per(met.select("a", "b", F.explode(whole).alias("path")), ["a", "b"], [F.col("path")], ROUTES, rank="rank")
        level = checkpointed(routes.select("a", "b", F.lit(d).alias("distance"), "rank", "path"))
        found = level if found is None else found.unionByName(level)
        left = checkpointed(left.join(level.select("a", "b"), ["a", "b"], "left_anti"))
    return found

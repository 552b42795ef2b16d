"""Round-based influence simulation: events, propagation, actions, decay, checks, predictions.

Nodes are rows (uid, stance, volatility, influence, susceptibility, activity, ...); edges (src, dst, type, weight). Each step
is one DataFrame plan over all nodes; the round loop checkpoints, so that a lost executor costs one round at most.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.plans.session import checkpointed

#: The propagation defaults, edge types that turn the sign, and what each type carries on.
DECAY, HOPS, THRESHOLD, CALM = 0.6, 3, 0.01, 0.1
INVERTED = ("COMPETES_WITH",)
CARRIES = {
    "IMPACTS": ["volatility", "stance"],
    "DEPENDS_ON": ["volatility"],
    "INFLUENCES": ["stance"],
    "COMPETES_WITH": ["stance"],
    "ALLIED_WITH": ["stance"],
    "LEADS_TO": ["event_activation"],
    "REACTS_TO": ["volatility", "stance"],
    "BELONGS_TO": ["stance"],
    "SUPPLIES": ["volatility"],
    "REGULATES": ["stance", "volatility"],
}


def schedule(events: DataFrame, rounds: int) -> DataFrame:
    """Events with a round; those without one (0 or less) are spread over the rounds but the last three, in order of id.

    Numbering rows needs one order over the unassigned events alone.
    """
    free = events.where("round <= 0")
    n = max(1, free.count())
    gap = max(1, max(1, rounds - 3) // n)
    placed = free.withColumn("i", F.row_number().over(Window.orderBy("event")) - 1).withColumn("round", F.least(1 + F.col("i") * gap, F.lit(rounds - 2)).cast("int")).drop("i")
    return events.where("round > 0").unionByName(placed)


def inject(events: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(event, uid, delta, direct): what each event (event, magnitude) does along IMPACTS edges; if it has none, half along INFLUENCES and REACTS_TO."""
    hit = edges.join(events.select(F.col("event").alias("src"), "magnitude"), "src").join(nodes.select(F.col("uid").alias("dst"), "susceptibility"), "dst")
    delta = F.col("magnitude") * F.coalesce("weight", F.lit(1.0)) * F.coalesce("susceptibility", F.lit(0.5))
    direct = hit.where("type = 'IMPACTS'").select(F.col("src").alias("event"), F.col("dst").alias("uid"), delta.alias("delta"), F.lit(True).alias("direct"))
    rest = hit.where("type IN ('INFLUENCES', 'REACTS_TO')").select(F.col("src").alias("event"), F.col("dst").alias("uid"), (delta * 0.5).alias("delta"), F.lit(False).alias("direct"))
    return direct.unionByName(rest.join(direct.select("event"), "event", "left_anti"))


def stirred(nodes: DataFrame, injected: DataFrame) -> DataFrame:
    """Nodes with the volatility that direct hits add, 1 at most."""
    added = injected.where("direct").groupBy("uid").agg(F.sum("delta").alias("added"))
    return nodes.join(added, "uid", "left").withColumn("volatility", F.least(F.lit(1.0), F.col("volatility") + F.coalesce("added", F.lit(0.0)))).drop("added")


def propagate(seeds: DataFrame, edges: DataFrame, nodes: DataFrame, hops: int = HOPS, decay: float = DECAY, threshold: float = THRESHOLD) -> DataFrame:
    """(source, target, effect, distance, type, property): influence from seeds (uid, effect) along edges, each node once.

    Of several sources that reach a node at one distance, the least (source, type) counts. Effects below the threshold go no further.
    """
    into = edges.select("src", "dst", "type", "weight").join(nodes.select(F.col("uid").alias("dst"), "susceptibility"), "dst")
    frontier = seeds.select("uid", "effect")
    visited, found = frontier.select("uid"), None
    for distance in range(1, hops + 1):
        effect = F.col("effect") * decay * F.coalesce("weight", F.lit(1.0)) * F.coalesce("susceptibility", F.lit(0.5)) * F.when(F.col("type").isin(*INVERTED), -1.0).otherwise(1.0)
        sent = frontier.join(into, frontier["uid"] == into["src"]).select("src", "dst", "type", effect.alias("effect")).where(F.abs("effect") >= threshold)
        sent = sent.join(visited.select(F.col("uid").alias("dst")), "dst", "left_anti")
        first = sent.withColumn("k", F.row_number().over(Window.partitionBy("dst").orderBy("src", "type"))).where("k = 1")
        level = first.select(F.col("src").alias("source"), F.col("dst").alias("target"), "effect", F.lit(distance).alias("distance"), "type")
        level = checkpointed(level)
        found = level if found is None else found.unionByName(level)
        frontier = level.select(F.col("target").alias("uid"), "effect")
        visited = visited.unionAll(frontier.select("uid"))
    table = F.create_map(*[x for k, v in CARRIES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return found.withColumn("property", F.explode(F.coalesce(table[F.col("type")], F.array(F.lit("stance")))))


def blast_radius(effects: DataFrame) -> DataFrame:
    """Affected nodes in all, by distance and by edge type (one pass with grouping sets)."""
    name = F.when(F.grouping("distance") == 0, F.concat(F.lit("distance "), F.col("distance").cast("string"))).when(F.grouping("type") == 0, F.col("type")).otherwise("all")
    return effects.groupingSets([[], ["distance"], ["type"]], "distance", "type").agg(F.count_distinct("target").alias("affected"), name.alias("part")).select("part", "affected")


def apply_effects(nodes: DataFrame, effects: DataFrame) -> DataFrame:
    """(target, property, old, new, delta): stance moves within -1 and 1, volatility by the size of the effect within 0 and 1."""
    values = nodes.select(F.col("uid").alias("target"), "stance", "volatility")
    e = effects.where("property IN ('stance', 'volatility')").join(values, "target")
    stance = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("stance") + F.col("effect")))
    volatility = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("volatility") + F.abs("effect")))
    is_stance = F.col("property") == "stance"
    out = e.select("target", "property", F.when(is_stance, F.col("stance")).otherwise(F.col("volatility")).alias("old"), F.when(is_stance, stance).otherwise(volatility).alias("new"))
    return out.withColumn("delta", F.col("new") - F.col("old"))


def written(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    new = changes.groupBy(F.col("target").alias("uid")).agg(F.max(F.when(F.col("property") == "stance", F.col("new"))).alias("s"), F.max(F.when(F.col("property") == "volatility", F.col("new"))).alias("v"))
    return nodes.join(new, "uid", "left").withColumn("stance", F.coalesce("s", "stance")).withColumn("volatility", F.coalesce("v", "volatility")).drop("s", "v")


def calmed(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("volatility", F.col("volatility") * (1 - CALM))


OPERATORS = {">": "__gt__", ">=": "__ge__", "<": "__lt__", "<=": "__le__", "==": "__eq__", "!=": "__ne__"}


def condition(left: Column, operator: str, right: Column | float, margin: float = 0.0) -> Column:
    """A comparison; a margin raises the bar of > and >= and lowers that of < and <=."""
    bar = right if isinstance(right, Column) else F.lit(right)
    bar = bar + margin if operator.startswith(">") else bar - margin if operator.startswith("<") else bar
    return getattr(left, OPERATORS[operator])(bar)


@dataclass(frozen=True)
class PairRule:
    """Fires on two nodes a, b whose difference (absolute, or a minus b) in a property meets a bar, if they are linked when `linked` says so."""

    name: str
    property: str
    operator: str
    bar: float
    absolute: bool = True
    linked: str | None = None


def fire(rules: list[PairRule], nodes: DataFrame, edges: DataFrame, most: int = 50) -> DataFrame:
    """(rule, a, b) over pairs of the `most` nodes of greatest influence (the engine's own bound)."""
    top = nodes.orderBy(F.desc("influence"), "uid").limit(most).withColumn("i", F.row_number().over(Window.orderBy(F.desc("influence"), "uid")))
    top = checkpointed(top)
    a, b = (top.select(*[F.col(c).alias(f"{end}_{c}") for c in top.columns]) for end in "ab")
    pairs = a.join(F.broadcast(b), F.col("a_i") < F.col("b_i"))
    out = []
    for r in rules:
        gap = F.col(f"a_{r.property}") - F.col(f"b_{r.property}")
        hit = pairs.where(condition(F.abs(gap) if r.absolute else gap, r.operator, r.bar)).select(F.lit(r.name).alias("rule"), F.col("a_uid").alias("a"), F.col("b_uid").alias("b"))
        if r.linked is not None:
            link = edges.where(F.col("type") == r.linked).select(F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y")).distinct()
            hit = hit.join(link, (F.least("a", "b") == F.col("x")) & (F.greatest("a", "b") == F.col("y")), "left_semi")
        out.append(hit)
    return reduce(DataFrame.unionByName, out)


@dataclass(frozen=True)
class Action:
    """What nodes of a kind may do: a condition on one property, an effect on one, and how often."""

    name: str
    kind: str
    priority: int
    cooldown: int
    property: str
    operator: str
    bar: float
    target: str
    change: str
    amount: float


def act(nodes: DataFrame, actions: list[Action], done: DataFrame | None, round_: int, most: int = 1) -> DataFrame:
    """(uid, action, round, property, new): the actions of highest priority whose condition holds and whose cooldown is over; done: (uid, action, round)."""
    busy = nodes.where("activity > 0.1")
    found = []
    for a in actions:
        old = F.col(a.target)
        new = {"add": old + a.amount, "subtract": old - a.amount, "multiply": old * a.amount, "set": F.lit(a.amount)}[a.change]
        low = -1.0 if a.target == "stance" else 0.0
        held = F.greatest(F.lit(low), F.least(F.lit(1.0), new)) if a.target in ("stance", "volatility") else new
        ready = busy.where((F.col("kind") == a.kind) & condition(F.col(a.property), a.operator, a.bar)).select("uid", F.lit(a.name).alias("action"), F.lit(a.priority).alias("priority"), F.lit(a.target).alias("property"), held.alias("new"))
        if done is not None:
            ready = ready.join(done.where((F.col("action") == a.name) & (F.col("round") > round_ - a.cooldown)).select("uid"), "uid", "left_anti")
        found.append(ready)
    ranked = reduce(DataFrame.unionByName, found).withColumn("k", F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("priority"), "action")))
    return ranked.where(F.col("k") <= most).select("uid", "action", F.lit(round_).alias("round"), "property", "new")


def violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, n): values out of range, and loops."""
    bad = nodes.agg(F.count_if(F.expr("stance NOT BETWEEN -1 AND 1")).alias("s"), F.count_if(F.expr("volatility NOT BETWEEN 0 AND 1")).alias("v"))
    return bad.selectExpr("stack(2, 'stance', s, 'volatility', v) AS (kind, n)").unionAll(edges.where("src = dst").agg(F.count("*").alias("n")).selectExpr("'loop' AS kind", "n"))


def simulate(nodes: DataFrame, edges: DataFrame, events: DataFrame, actions: list[Action], rounds: int, settle: float = 0.005) -> tuple[DataFrame, DataFrame]:
    """Runs the rounds; returns the nodes, and a summary (round, volatility, stance, effects, acts) of each. Stops once settled after five rounds."""
    planned, state, done, before = schedule(events, rounds), checkpointed(nodes), None, None
    rows = []
    for r in range(1, rounds + 1):
        hits = inject(planned.where(F.col("round") == r), edges, state)
        state = stirred(state, hits)
        seeds = hits.groupBy("uid").agg(F.sum("delta").alias("effect"))
        changes = checkpointed(apply_effects(state, propagate(seeds, edges, state)))
        state = written(state, changes)
        acts = checkpointed(act(state, actions, done, r))
        own = acts.select(F.col("uid").alias("target"), "property", "new")
        state = checkpointed(calmed(written(state, own)))
        done = acts if done is None else checkpointed(done.unionByName(acts))
        mean = state.agg(F.avg("volatility").alias("v"), F.avg("stance").alias("s")).first()
        rows.append((r, mean["v"], mean["s"], changes.count(), acts.count()))
        if r >= 5 and before is not None and abs(mean["v"] - before) < settle:
            break
        before = mean["v"]
    return state, nodes.sparkSession.createDataFrame(rows, "round int, volatility double, stance double, effects long, acts long")


def predictions(changes: DataFrame, made: str, days: int = 90) -> DataFrame:
    """(id, target, direction, size, due): what the largest moves foretell, id a prefix of a digest."""
    key = F.substring(F.sha2(F.concat_ws("|", "target", "property", F.lit(made)).cast("binary"), 256), 1, 12)
    return changes.select(key.alias("id"), "target", F.when(F.col("delta") > 0, "up").otherwise("down").alias("direction"), F.round(F.abs("delta"), 6).alias("size"), F.date_add(F.lit(made).cast("date"), days).alias("due"))


def lens_budget(total: int, weights: dict[str, float]) -> dict[str, int]:
    """How many of `total` insights each tier of lenses may give."""
    return {k: round(total * w) for k, w in weights.items()}

"""Rules over pairs of entities, compiled to joins and predicates.

A rule is data: conditions on properties (seven comparisons; a property, a difference, an absolute difference or a literal on the left), on relationships
that must or must not lead from source to target, and on communities. Compiling takes the pairs from what a rule itself asks for, so no rule
compares all pairs: a relationship that must exist is an equi-join with its edges, equal communities are an equi-join (with cells of
the bound where an absolute difference must stay below it), a relationship that must not exist is an anti-join, and all else is one predicate.

Rules that watch a property run on change: only pairs whose source changed in that property are looked at. The others run over all pairs, each
once, with the lesser uid as the source.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The rules, their order, conditions and bounds.
RULES: dict[str, dict] = {
    "opposition": {
        "trigger": "on_change",
        "watch": ["stance"],
        "priority": 10,
        "conditions": [
            {"type": "property_comparison", "left": "source.stance", "operator": "-", "right": "target.stance", "compare": ">", "value": 0.6},
            {"type": "relationship_exists", "pattern": "(source)-[:INFLUENCES|COMPETES_WITH|DEPENDS_ON]->(target)", "condition": "exists"},
            {"type": "relationship_exists", "pattern": "(source)-[:OPPOSES]->(target)", "condition": "not_exists"},
        ],
    },
    "alliance": {
        "trigger": "evaluate",
        "priority": 8,
        "conditions": [
            {"type": "property_comparison", "left": "abs(source.stance - target.stance)", "compare": "<", "value": 0.2},
            {"type": "community", "condition": "source.community_id == target.community_id"},
            {"type": "relationship_exists", "pattern": "(source)-[:ALLIED_WITH]->(target)", "condition": "not_exists"},
        ],
    },
    "flight_to_safety": {
        "trigger": "on_change",
        "watch": ["volatility"],
        "priority": 9,
        "conditions": [
            {"type": "property_comparison", "left": "source.volatility", "compare": ">", "value": 0.7},
            {"type": "property_comparison", "left": "source.object_type", "compare": "in", "value": ["Investor", "ForeignInvestor", "InstitutionalInvestor"]},
        ],
    },
    "dependency_crisis": {
        "trigger": "on_change",
        "watch": ["volatility"],
        "priority": 7,
        "conditions": [
            {"type": "relationship_exists", "pattern": "(source)-[:DEPENDS_ON]->(target)", "condition": "exists"},
            {"type": "property_comparison", "left": "target.volatility", "compare": ">", "value": 0.5},
        ],
    },
    "influence_propagation": {
        "trigger": "on_change",
        "watch": ["stance"],
        "priority": 6,
        "conditions": [
            {"type": "property_comparison", "left": "source.influence_score", "compare": ">", "value": 0.7},
            {"type": "relationship_exists", "pattern": "(source)-[:INFLUENCES]->(target)", "condition": "exists"},
        ],
    },
    "community_cohesion": {
        "trigger": "evaluate",
        "priority": 5,
        "conditions": [
            {"type": "community", "condition": "source.community_id == target.community_id"},
            {"type": "property_comparison", "left": "abs(source.stance - target.stance)", "compare": ">", "value": 0.3},
        ],
    },
    "event_chain": {
        "trigger": "on_change",
        "watch": ["is_active"],
        "priority": 10,
        "conditions": [
            {"type": "property_comparison", "left": "source.object_type", "compare": "==", "value": "Event"},
            {"type": "property_comparison", "left": "source.is_active", "compare": "==", "value": True},
            {"type": "relationship_exists", "pattern": "(source)-[:LEADS_TO]->(target:Event)", "condition": "exists"},
            {"type": "property_comparison", "left": "source.magnitude", "compare": ">", "value": 0.5},
        ],
    },
}

COMPARE = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    ">": lambda a, b: a.cast("double") > float(b),
    "<": lambda a, b: a.cast("double") < float(b),
    ">=": lambda a, b: a.cast("double") >= float(b),
    "<=": lambda a, b: a.cast("double") <= float(b),
    "in": lambda a, b: a.isin(*b),
}


class CompiledRule:
    """A rule as joins and one predicate over the properties of source (s_...) and target (t_...).

    declared: whether a left side with an operator and a right side is their difference; as published, the left side alone counts.
    """

    def __init__(self, name: str, rule: dict, properties: Iterable[str], declared: bool = False):
        self.name, self.trigger, self.watch, self.priority = name, rule.get("trigger", "evaluate"), rule.get("watch", []), rule.get("priority", 5)
        self.properties, self.declared = set(properties), declared
        self.needed: list[tuple[list[str], str | None]] = []
        self.barred: list[tuple[list[str], str | None]] = []
        self.same_community, self.band = False, None
        tests = []
        for c in rule.get("conditions", []):
            if c["type"] == "relationship_exists":
                (self.needed if c.get("condition") == "exists" else self.barred).append(self._pattern(c["pattern"]))
            elif c["type"] == "community":
                equal = F.col("s_community_id") == F.col("t_community_id")
                self.same_community |= "==" in c["condition"]
                tests.append(equal & (F.col("s_community_id") != "") if "==" in c["condition"] else ~equal if "!=" in c["condition"] else F.lit(False))
            elif c["type"] == "property_comparison":
                tests.append(self._comparison(c))
            else:
                raise ValueError(f"rule {name}: there is no condition {c['type']}")
        self.predicate = reduce(Column.__and__, tests, F.lit(True))

    @staticmethod
    def _pattern(pattern: str) -> tuple[list[str], str | None]:
        found = re.fullmatch(r"\(source\)-\[:([A-Z_|]+)\]->\(target(?::(\w+))?\)", pattern)
        if found is None:
            raise ValueError(f"not a pattern from source to target: {pattern}")
        return found[1].split("|"), found[2]

    def _value(self, expression: str) -> Column | None:
        if (inner := re.fullmatch(r"abs\((\S+) - (\S+)\)", expression)) or (inner := re.fullmatch(r"(\S+) - (\S+)", expression)):
            a, b = (self._value(x) for x in inner.groups())
            if a is None or b is None:
                return None
            difference = a.cast("double") - b.cast("double")
            return F.abs(difference) if expression.startswith("abs(") else difference
        if found := re.fullmatch(r"(source|target)\.(\w+)", expression):
            return F.col(f"{found[1][0]}_{found[2]}") if found[2] in self.properties else None
        return F.lit(float(expression)) if re.fullmatch(r"-?[\d.]+", expression) else F.lit(expression)

    def _comparison(self, c: dict) -> Column:
        left = f"{c['left']} {c['operator']} {c['right']}" if self.declared and c.get("right") else c["left"]
        value, bar, how = self._value(left), c.get("value"), c.get("compare") or c.get("operator")
        if value is None or bar is None:
            return F.lit(False)
        if how not in COMPARE:
            raise ValueError(f"rule {self.name}: there is no comparison {how}")
        near = re.fullmatch(r"abs\(source\.(\w+) - target\.\1\)", left)
        if near and how in ("<", "<=") and float(bar) > 0:
            self.band = (near[1], float(bar) * (1 + 1e-9))  # a hair wider, so rounding parts no pair
        return F.coalesce(COMPARE[how](value, bar), F.lit(False))

    def _side(self, nodes: DataFrame, side: str) -> DataFrame:
        return nodes.select(*[F.col(c).alias(f"{side}_{c}") for c in nodes.columns])

    def _linked(self, edges: DataFrame, link: tuple[list[str], str | None]) -> DataFrame:
        return edges.where(F.col("type").isin(*link[0])).select(F.col("src").alias("s_uid"), F.col("dst").alias("t_uid")).distinct()

    def pairs(self, sources: DataFrame, nodes: DataFrame, edges: DataFrame, once: bool) -> DataFrame:
        """(rule, priority, source, target) of the pairs that meet the rule; once: each pair from its lesser uid only."""
        s, t = self._side(sources, "s"), self._side(nodes, "t")
        if self.needed:
            met = s.join(self._linked(edges, self.needed[0]), "s_uid").join(t, "t_uid")
        elif self.same_community and self.band and self.band[0] in self.properties:
            name, width = self.band
            cell = lambda side: F.floor(F.col(f"{side}_{name}") / width)
            s = s.withColumn("cell", cell("s"))
            t = t.withColumn("cell", F.explode(F.array(cell("t") - 1, cell("t"), cell("t") + 1)))
            met = s.join(t, (F.col("s_community_id") == F.col("t_community_id")) & (s["cell"] == t["cell"])).drop("cell")
        elif self.same_community:
            met = s.join(t, F.col("s_community_id") == F.col("t_community_id"))
        else:  # nothing ties the target to the source: its neighbours are looked at
            near = edges.select(F.col("src").alias("s_uid"), F.col("dst").alias("t_uid")).unionAll(edges.select("dst", "src")).distinct()
            met = s.join(near, "s_uid").join(t, "t_uid")
        met = met.where((F.col("s_uid") < F.col("t_uid")) if once else (F.col("s_uid") != F.col("t_uid"))).where(self.predicate)
        for types, kind in self.needed:
            met = met.where(F.col("t_object_type") == kind) if kind else met
        for link in self.needed[1:]:
            met = met.join(self._linked(edges, link), ["s_uid", "t_uid"], "left_semi")
        for link in self.barred:
            there = self._linked(edges, link) if link[1] is None else self._linked(edges, link).join(nodes.where(F.col("object_type") == link[1]).select(F.col("uid").alias("t_uid")), "t_uid", "left_semi")
            met = met.join(there, ["s_uid", "t_uid"], "left_anti")
        return met.select(F.lit(self.name).alias("rule"), F.lit(self.priority).alias("priority"), F.col("s_uid").alias("source"), F.col("t_uid").alias("target"))


def compiled(nodes: DataFrame, rules: dict[str, dict] | None = None, declared: bool = False) -> list[CompiledRule]:
    """The rules in order of priority."""
    return sorted((CompiledRule(name, rule, nodes.columns, declared) for name, rule in (RULES if rules is None else rules).items()), key=lambda r: -r.priority)


def _united(parts: list[DataFrame], nodes: DataFrame) -> DataFrame:
    empty = nodes.select(F.lit("").alias("rule"), F.lit(0).alias("priority"), F.col("uid").alias("source"), F.col("uid").alias("target")).limit(0)
    return reduce(DataFrame.unionByName, parts, empty)


def fired_on_change(changes: DataFrame, nodes: DataFrame, edges: DataFrame, rules: dict[str, dict] | None = None, declared: bool = False) -> DataFrame:
    """Pairs that rules on change hit, for changes (uid, property): only those whose source changed in a property that the rule watches."""
    parts = []
    for rule in compiled(nodes, rules, declared):
        if rule.trigger == "on_change":
            touched = changes.where(F.col("property").isin(*rule.watch)).select("uid").distinct()
            parts.append(rule.pairs(nodes.join(touched, "uid", "left_semi"), nodes, edges, once=False))
    return _united(parts, nodes)


def fired_on_evaluation(nodes: DataFrame, edges: DataFrame, rules: dict[str, dict] | None = None, declared: bool = False) -> DataFrame:
    """Pairs that the rules without a watch hit, each pair once."""
    return _united([rule.pairs(nodes, nodes, edges, once=True) for rule in compiled(nodes, rules, declared) if rule.trigger == "evaluate"], nodes)

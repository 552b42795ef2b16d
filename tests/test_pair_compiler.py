"""Compiled pair rules against a plain evaluation of all pairs, and cascades against a queue."""

from __future__ import annotations

import random

import pytest

from loomgraph.operators import cascade as B
from loomgraph.operators import pair_compiler as R

NODE = "uid string, object_type string, community_id string, stance double, volatility double, influence_score double, is_active boolean, magnitude double"
EDGE = "src string, dst string, type string"


def value(text, s, t):
    if text.startswith("abs("):
        d = value(text[4:-1], s, t)
        return None if d is None else abs(d)
    if " - " in text:
        a, b = (value(x, s, t) for x in text.split(" - "))
        return None if a is None or b is None else a - b
    side, name = text.split(".")
    return (s if side == "source" else t).get(name)


def holds(c, s, t, edges):
    if c["type"] == "community":
        return s["community_id"] is not None and s["community_id"] == t["community_id"] != ""
    if c["type"] == "relationship_exists":
        types, target = R.CompiledRule._pattern(c["pattern"])
        there = any((s["uid"], t["uid"], k) in edges for k in types) and (target is None or t["object_type"] == target)
        return there == (c["condition"] == "exists")
    a, b = value(c["left"], s, t), c["value"]
    if a is None:
        return False
    return {"in": lambda: a in b, "==": lambda: a == b, "!=": lambda: a != b, ">": lambda: a > b, "<": lambda: a < b, ">=": lambda: a >= b, "<=": lambda: a <= b}[c["compare"]]()


def world(spark, n=60):
    random.seed(9)
    some = lambda: random.choice([None, *[x / 10 for x in range(-10, 11)]])
    nodes = [(f"n{i:02d}", random.choice(["Event", "Event", "Investor", "Actor", None]), random.choice(["c1", "c2", "", None]), some(), some(), some(), random.choice([True, False, None]), some()) for i in range(n)]
    nodes += [("n60", "Event", "", 0.1, 0.1, 0.1, True, 0.9), ("n61", "Event", None, 0.1, 0.1, 0.1, False, None), ("n62", "Actor", None, 0.1, 0.1, 0.1, False, None)]
    kinds = ["INFLUENCES", "COMPETES_WITH", "DEPENDS_ON", "OPPOSES", "LEADS_TO", "ALLIED_WITH"]
    edges = {(f"n{random.randrange(n):02d}", f"n{random.randrange(n):02d}", random.choice(kinds)) for _ in range(1800)} | {("n60", "n61", "LEADS_TO"), ("n60", "n62", "LEADS_TO")}
    return spark.createDataFrame(nodes, NODE), spark.createDataFrame(sorted(edges), EDGE), [dict(zip([c.split()[0] for c in NODE.split(", ")], x)) for x in nodes], edges


def test_every_rule_against_all_pairs(spark):
    frame, links, nodes, edges = world(spark)
    near = {(a, b) for a, b, _ in edges} | {(b, a) for a, b, _ in edges}
    changed = {(n["uid"], p) for n in nodes for p in ("stance", "volatility", "is_active") if (int(n["uid"][1:]) + len(p)) % 4}
    changes = spark.createDataFrame(sorted(changed), "uid string, property string")
    want_change, want_all = set(), set()
    for name, rule in R.RULES.items():
        tied = any(c["type"] == "relationship_exists" and c["condition"] == "exists" for c in rule["conditions"])
        for s in nodes:
            for t in nodes:
                if s["uid"] == t["uid"] or not all(holds(c, s, t, edges) for c in rule["conditions"]):
                    continue
                if rule["trigger"] == "on_change" and any((s["uid"], p) in changed for p in rule["watch"]) and (tied or (s["uid"], t["uid"]) in near):
                    want_change.add((name, s["uid"], t["uid"]))
                if rule["trigger"] == "evaluate" and s["uid"] < t["uid"]:
                    want_all.add((name, s["uid"], t["uid"]))
    got = [(r["rule"], r["source"], r["target"]) for r in R.fired_on_change(changes, frame, links).collect()]
    assert len(got) == len(set(got)) and set(got) == want_change
    assert {r[0] for r in got} == {n for n, r in R.RULES.items() if r["trigger"] == "on_change"}
    got = [(r["rule"], r["source"], r["target"]) for r in R.fired_on_evaluation(frame, links).collect()]
    assert len(got) == len(set(got)) and set(got) == want_all and {r[0] for r in got} == {"alliance", "community_cohesion"}


def test_declared_differences_and_all_comparisons(spark):
    nodes = spark.createDataFrame([("a", "Actor", "c", 0.9, 0.1, 0.5, True, 1.0), ("b", "Actor", "d", 0.5, 0.1, 0.5, True, 1.0), ("c", "Actor", "c", -0.5, 0.1, 0.5, True, 1.0)], NODE)
    edges = spark.createDataFrame([("a", "b", "INFLUENCES"), ("a", "c", "INFLUENCES")], EDGE)
    changes = spark.createDataFrame([("a", "stance")], "uid string, property string")
    only = {"opposition": R.RULES["opposition"]}
    assert {r["target"] for r in R.fired_on_change(changes, nodes, edges, only).collect()} == {"b", "c"}  # as published: the left side alone
    assert {r["target"] for r in R.fired_on_change(changes, nodes, edges, only, declared=True).collect()} == {"c"}
    link = {"type": "relationship_exists", "pattern": "(source)-[:INFLUENCES]->(target)", "condition": "exists"}
    for how, bar, hit in (("<=", 0.5, "bc"), (">=", 0.5, "b"), ("!=", 0.5, "c"), ("==", 0.5, "b"), ("<", 0.5, "c"), ("in", [0.5], "b")):
        rule = {"r": {"conditions": [link, {"type": "property_comparison", "left": "target.stance", "compare": how, "value": bar}]}}
        assert "".join(sorted(r["target"] for r in R.fired_on_evaluation(nodes, edges, rule).collect())) == hit
    apart = {"r": {"conditions": [link, {"type": "community", "condition": "source.community_id != target.community_id"}]}}
    assert [r["target"] for r in R.fired_on_evaluation(nodes, edges, apart).collect()] == ["b"]
    with pytest.raises(ValueError):
        R.compiled(nodes, {"r": {"conditions": [{"type": "weather"}]}})
    assert R.fired_on_evaluation(nodes, edges, {}).count() == 0


def test_cascade_against_a_queue(spark):
    random.seed(3)
    bindings = {(f"b{random.randrange(30)}", f"b{random.randrange(30)}", random.choice(["notify", "invalidate_downstream"])) for _ in range(45)} | {("b0", "b1", "notify"), ("b1", "b0", "notify"), ("self", "self", "notify")}
    roots = ["b0", "b3", "b7", "self", "nowhere", None, "b0"]
    want = set()
    for root in {r for r in roots if r}:
        seen, layer, depth = {}, [root], 0
        while layer:
            depth += 1
            step = {}
            for at in layer:
                for s, t, action in bindings:
                    if s == at and t not in seen:
                        step[t] = min(step.get(t, (at, action)), (at, action))
            seen |= {t: (depth, *by) for t, by in step.items()}
            layer = [t for t in step if t != root]
        want |= {(root, t, *x) for t, x in seen.items()}
    got = B.cascade(spark.createDataFrame([(r,) for r in roots], "name string"), spark.createDataFrame(sorted(bindings), "source string, target string, action string"))
    rows = [tuple(r) for r in got.select("root", "target", "depth", "via", "action").collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    assert {(r["root"], r["length"]) for r in B.circles(got).collect()} == {(a, d) for a, t, d, *_ in want if a == t} and ("self", 1) in {tuple(r) for r in B.circles(got).collect()}
    assert B.cascade(spark.createDataFrame([], "name string"), spark.createDataFrame([], "source string, target string, action string")).count() == 0


def test_cascades_of_few_bindings_take_no_rounds(spark, monkeypatch):
    rng = random.Random(5)
    bindings = {(f"n{rng.randrange(25):02d}", f"n{rng.randrange(25):02d}", rng.choice(["a", "b", None])) for _ in range(70)} | {("n00", "n00", "a"), ("n01", None, "a"), (None, "n02", "a")}
    bindings = spark.createDataFrame(sorted(bindings, key=repr), "source string, target string, action string")
    roots = spark.createDataFrame([(f"n{i:02d}",) for i in range(0, 30, 2)] + [(None,)], "name string")
    tables, plain = [], B.written
    monkeypatch.setattr(B, "written", lambda df: tables.append(1) or plain(df))
    run = lambda: sorted(map(tuple, B.cascade(roots, bindings).collect()), key=repr)
    got, n = run(), len(tables)
    monkeypatch.setattr(B, "SENT", 0)
    assert got == run() and len(got) > 100
    assert n == 1 and len(tables) > 5  # before, a table for each round

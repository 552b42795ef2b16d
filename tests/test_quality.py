"""Counts of the quality dimensions against listing every pair and path, and points of hand-made graphs."""

from __future__ import annotations

import itertools
import random

import pytest

from conftest import SMALL
from loomgraph.operators import quality as Q
from loomgraph.plans import registry


def edges_of(spark, rows):
    return spark.createDataFrame(rows, "src string, dst string, space string")


def random_edges(seed, nodes=7, n=18):
    random.seed(seed)
    return [(f"n{random.randrange(nodes)}", f"n{random.randrange(nodes)}", random.choice(["a", "b", None])) for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_paths_and_reach_against_listing(spark, seed):
    rows = [*random_edges(seed), ("x", "y", "a"), ("x", "y", "b"), ("u", "u", "a"), ("p", "q", "a")]
    two = [(e, f) for (i, e), (j, f) in itertools.permutations(enumerate(rows), 2) if e[1] == f[0]]
    frame = edges_of(spark, rows)
    assert Q.two_edge_paths(frame) == len(two)
    assert Q.two_edge_paths(frame, "space") == sum(e[2] is not None and f[2] is not None and e[2] != f[2] for e, f in two)
    reach = {}
    for seed_node in {x for e in rows for x in e[:2]}:
        ways = [(seed_node, ())]
        for _ in range(2):
            ways = [(b if at == a else a, (*used, i)) for at, used in ways for i, (a, b, _) in enumerate(rows) if at in (a, b) and i not in used]
            reach.setdefault(seed_node, set()).update(at for at, _ in ways)
    seeds = spark.createDataFrame([(x,) for x in [*reach, "lone"]], "uid string")
    assert Q.mean_reach(seeds, frame, enough=1000) == pytest.approx(sum(map(len, reach.values())) / len(reach))


def test_reach_of_hubs_is_a_bound(spark):
    rows = [(f"a{i}", "hub", "x") for i in range(40)] + [("b", "c", "x")]
    seeds = spark.createDataFrame([(f"a{i}",) for i in range(40)] + [("b",)], "uid string")
    got = Q.mean_reach(seeds, edges_of(spark, rows))
    assert 15 <= got <= (40 * 40 + 1) / 41
    assert Q.mean_reach(seeds.limit(0), edges_of(spark, rows)) == 0.0


def test_equal_pairs_against_listing(spark):
    names = ["Data Base", "database", "data-base", "DATA.BASE", "Node.js", "nodejs", "node js", None, "", "alone"]
    frame = spark.createDataFrame([(f"u{i}", n) for i, n in enumerate(names)], "uid string, name string")
    marks = [" ", "-", "."]
    alike = lambda a, b: any(a.lower().replace(m, "") == b.lower().replace(m, "") for m in marks) or a.lower() == b.lower()
    want = sum(a is not None and b is not None and alike(a, b) for a, b in itertools.combinations(names, 2))
    assert Q.equal_pairs(frame, marks) == want > 2
    assert Q.equal_pairs(frame, marks, most=2) == 2
    many = spark.range(30).selectExpr("concat('u', id) AS uid", "'same' AS name")
    assert Q.equal_pairs(many, []) == Q.MOST_PAIRS and Q.equal_pairs(many.limit(0), [" "]) == 0


def test_points_of_a_small_graph(spark):
    nodes = spark.createDataFrame(
        [
            ("t1", "Technology", "A", None, None, None, None, None), ("t2", "Technology", "a", None, None, None, None, None), ("c1", "Claim", None, 0.8, "fact", True, None, None),
            ("c2", "Claim", None, 0.4, "opinion", None, None, None), ("m", "Community", "M", None, None, None, 1, "about"), ("l", "Lever", "L", None, None, None, None, None),
            ("g", "CrawlLog", "G", None, None, None, None, None), ("odd", "Other", "?", None, None, None, None, None),
        ],
        "uid string, label string, name string, confidence double, claim_type string, verified boolean, level int, summary string",
    )
    edges = spark.createDataFrame(
        [
            ("c1", "c2", "SUPPORTS", 0.5, "causal", "inferred"), ("t1", "m", "MEMBER_OF", None, "hierarchy", None), ("t1", "m", "MEMBER_OF", None, None, None), ("l", "g", "EXECUTED", None, None, None),
            ("t1", "t2", "EVOLVED_FROM", None, "structural", "inferred"), ("m", "t1", "PARENT_COMMUNITY", None, None, None), ("t1", "nobody", "DEPENDS_ON", 0.5, None, None),
        ],
        "src string, dst string, type string, confidence double, analysis_space string, source string",
    )
    m = Q.measures(nodes, edges)
    assert (m["nodes"], m["labels"], m["edges"], m["members"], m["executed"], m["pairs"], m["tied"], m["chains"], m["crossing"], m["hierarchy"]) == (8, 5, 6, 1, 1, 1, 7, 0, 0, 1)
    got = {r["dimension"]: r["score"] for r in Q.dimensions(nodes, edges, tools=0.4).collect()}
    assert got == {
        "schema": 3.08,
        "rules": 0.3,
        "claims": round(2.5 * (0.6 + 0.5 + 1.0 + 0.1), 2),
        "communities": round(2.5 * (1 / 3 + 1.0 + 1.0 + 0.2), 2),
        "edge_metadata": round(2.5 * (1 / 6 / 0.8 + 3 / 6 / 0.8 + 2 / 6 / 0.8 + 3 / 6), 2),
        "connectivity": round(2 * (12 / 8 / 3 + 0 + 4 / 6 / 0.7 + 5 / 15), 2),
        "dedup": 0.0,
        "temporal": round(2 / 3, 2),
        "enrichment": round(1.5 * 2 / 50 + 1.0, 2),
        "retrieval": 1.0,
        "depth": round(2 * (1 / 5 + 1 / 20) + 0.5, 2),
        "tools": 4.0,
        "total": pytest.approx(sum(v for k, v in got.items() if k != "total")),
    }


def test_points_of_nothing(spark):
    nodes, edges = spark.createDataFrame([], "uid string, label string"), spark.createDataFrame([], "src string, dst string, type string")
    got = {r["dimension"]: r["score"] for r in Q.dimensions(nodes, edges, text_index=False).collect()}
    assert {k for k, v in got.items() if v} == {"dedup", "total"} and got["dedup"] == 6.0


def test_reach_over_hubs_alone_is_never_more(spark):
    rows = [*random_edges(3), *[(f"a{i}", "hub", "x") for i in range(40)], *[(f"a{i}", "hub", "y") for i in range(5)], ("u", "u", "x")]
    frame = edges_of(spark, rows)
    seeds = spark.createDataFrame([(f"a{i}",) for i in range(40)] + [("n1",), ("u",), ("lone",)], "uid string")
    degrees = Q._by_node(frame.withColumnRenamed("space", "key")).select("uid", "degree")
    assert {r["uid"]: r["degree"] for r in degrees.collect()} == {u: sum(u in e[:2] for e in rows) for e in rows for u in e[:2]}
    assert 15 <= Q.hub_reach(seeds, frame, degrees) <= Q.mean_reach(seeds, frame, enough=1000)
    assert Q.mean_reach(seeds, frame, enough=1000, degrees=degrees) == Q.mean_reach(seeds, frame, enough=1000)


def test_nodes_of_all_dimensions_are_numbered(spark, monkeypatch):
    given = []
    monkeypatch.setattr(Q, "dimensions", lambda nodes, edges, **more: given.extend((nodes, edges)) or nodes)
    registry.QUERIES["quality_dimensions"](spark, SMALL)
    nodes, edges = given
    assert [dict(nodes.dtypes)["uid"], dict(edges.dtypes)["src"], dict(edges.dtypes)["dst"]] == ["bigint"] * 3  # before, texts
    assert nodes.where("uid IS NULL").isEmpty() and nodes.count() == nodes.select("uid").distinct().count() == nodes.select("uid", "label").distinct().count()

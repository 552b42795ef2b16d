"""Shortest paths of both searches against a plain search, and walks that use no edge twice."""

from __future__ import annotations

import itertools
import random

import pytest

from loomgraph.operators import impact, match


def plain_routes(links, a, b, depth):
    if a == b:
        return [[a]]
    paths = [[a]]
    seen = {a}
    for _ in range(depth):
        paths = [p + [v] for p in paths for v in sorted({y for x, y in links if x == p[-1]}) if v not in seen]
        seen |= {p[-1] for p in paths}
        if hits := sorted(p for p in paths if p[-1] == b):
            return hits[: match.ROUTES]
    return []


def test_routes_against_a_plain_search(spark):
    random.seed(6)
    pairs = {(f"n{random.randrange(40):02d}", f"n{random.randrange(40):02d}") for _ in range(48)} | {(f"g{i}{j}", f"g{i + di}{j + dj}") for i in range(4) for j in range(4) for di, dj in ((0, 1), (1, 0))}
    links = {(a, b) for a, b in pairs if a != b} | {(b, a) for a, b in pairs if a != b}
    names = sorted({x for e in links for x in e})
    wanted = random.sample(list(itertools.product(names, names)), 150) + [("g00", "g32"), ("g00", "g22"), ("n00", "n00"), ("nobody", "n01"), (None, "n01")]
    edges = spark.createDataFrame([(a, b, "R") for a, b in sorted(pairs)] + [("g00", "g01", "S")], "src string, dst string, type string")
    got = {}
    for r in match.shortest_routes(edges, spark.createDataFrame(wanted, "a string, b string")).orderBy("a", "b", "rank").collect():
        assert r["distance"] == len(r["path"]) - 1 and r["rank"] == len(got.setdefault((r["a"], r["b"]), [])) + 1
        got[r["a"], r["b"]].append(r["path"])
    want = {(a, b): p for a, b in wanted if a and (p := plain_routes(links, a, b, 5))}
    assert got == want and len(got["g00", "g22"]) == 3 and max(len(p[0]) for p in got.values()) == 6


@pytest.mark.parametrize("depth", [2, 3])
def test_walks_use_no_edge_twice(spark, depth):
    random.seed(8)
    edges = [(f"n{random.randrange(9)}", f"n{random.randrange(9)}", random.choice("RST"), 0.5) for _ in range(9)] + [("p", "q", "R", 0.5), ("p", "q", "S", 0.5), ("x", "y", "R", 0.5), ("y", "y", "R", 0.5), ("t", "u", "R", 0.1), ("t", "u", "S", 0.1), ("t", "u", "T", 0.1)]
    frame = spark.createDataFrame(edges, "src string, dst string, type string, confidence double")
    nodes = sorted({x for e in edges for x in e[:2]})
    want = set()
    for seed in nodes:
        walks = [(seed, ())]
        for n in range(1, depth + 1):
            walks = [(b if at == a else a, (*used, i)) for at, used in walks for i, (a, b, *_) in enumerate(edges) if at in (a, b) and i not in used]
            want |= {(seed, at) for at, _ in walks if n > 1 and at != seed}
    step = match.both_ways(frame.select("src", "dst"))
    step = frame.select("src", "dst").unionAll(frame.where("src <> dst").select("dst", "src"))
    got = {(r["uid"], r["at"]) for r in impact.beyond_neighbours(step, step, depth).collect()}
    assert got == want


@pytest.mark.parametrize("depth", [2, 3, 4])
def test_first_names_beyond_are_those_of_all_walks(spark, depth):
    rng = random.Random(depth)
    pairs = [(f"n{rng.randrange(12):02d}", f"n{rng.randrange(12):02d}") for _ in range(22)] + [("n00", f"m{i:02d}") for i in range(40)] + [("n01", "n00")] * 2
    edges = spark.createDataFrame([p for p in pairs if p[0] != p[1]], "src string, dst string")
    step = edges.unionAll(edges.select(edges["dst"].alias("src"), edges["src"].alias("dst"))).localCheckpoint()
    named = step.selectExpr("src AS dst", "substring(src, 1, 1) AS label", "if(src = 'm03', null, concat('name ', int(substring(src, 2)) div 2)) AS name").distinct()
    far = impact.beyond_neighbours(step, step, depth).withColumnRenamed("at", "dst").join(named, "dst").select("uid", "label", "name").distinct().collect()
    for k in (1, 3, 30):
        got = impact.first_beyond(step, step, named, depth, k).collect()
        order = lambda r: (r["label"], r["name"] is not None, r["name"] or "")
        want = [r for uid in {r["uid"] for r in far} for r in sorted((r for r in far if r["uid"] == uid), key=order)[:k]]
        assert sorted(map(str, got)) == sorted(map(str, want))

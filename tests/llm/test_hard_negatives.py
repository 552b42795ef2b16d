"""Hard negatives against SQL and brute force, bounds against exact scores, and rows that take no part."""

from __future__ import annotations

import random

import numpy as np
import pytest
from test_llm import SMALL

from compare import rows, same
from loomgraph.llm import hard_negatives as H
from loomgraph.llm import queries

SCHEMA = "vec_id long, embedding array<float>, label int, summary string"


def brute(table):
    own = []
    for vec_id, x, label, *_ in table:
        if vec_id is None or label is None or x is None or any(c is None or not np.isfinite(c) for c in x):
            continue
        own.append((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, [int(np.floor(256 * np.float64(np.float32(c)))) for c in x]))
    dot = lambda a, b: sum(p * q for p, q in zip(a, b))
    out = []
    for a in own:
        if a[0] % 50:
            continue
        scored = sorted(((-dot(a[2], b[2]), b[0], b[1]) for b in own if b[0] != a[0]))
        for less, positive, _ in [s for s in scored if s[2] == a[1]][:5]:
            inside = [s for s in scored if s[2] != a[1] and 50 * -less <= 100 * -s[0] <= 95 * -less][:3]
            out += [(a[0], positive, k + 1, s[1], -less, -s[0]) for k, s in enumerate(inside)]
    return sorted(out)


def test_query_matches_sql(spark, duck):
    got = queries.QUERIES["op12_hard_negatives"](spark, SMALL).toPandas()
    assert len(got) > 50 and same(rows(got), rows(duck.execute(H.ORACLE_SQL).df()))


@pytest.mark.parametrize("block, first", [(8192, 256), (3, 2)])
def test_against_brute_force(spark, monkeypatch, block, first):
    monkeypatch.setattr(H, "FIRST_ROWS", first)
    monkeypatch.setattr(H, "TILE_ANCHORS", 2)
    random.seed(3)
    draw = lambda n: [random.choice([-0.5, -0.25, 0.0, 0.1, 0.5, 0.75]) for _ in range(n)]  # noqa: E731  few values, so scores tie
    table = [(5 * i, draw(5), i % 3, "s") for i in range(200)]
    table += [(10**6, draw(3), 1, "s"), (10**6 + 1, [], 1, "s"), (10**6 + 50, draw(9), 2, None), (350, draw(5), 1, "s"), (355, draw(5), 0, "s"), (355, draw(5), 1, "s")]
    table += [(None, draw(5), 1, "s"), (50, None, 1, "s"), (100, draw(5), None, "s"), (150, [0.5, None], 1, "s"), (200, [float("nan")], 1, "s"), (250, [float("inf")], 1, "s"), (-50, draw(5), 2, "s")]
    frame = spark.createDataFrame(table, SCHEMA).repartition(5)
    got = sorted(map(tuple, H.hard_negatives(frame, block=block).collect()))
    assert got == brute(table)


def test_great_components_saturate(spark):
    table = [(50, [1e30, 1.0], 1, ""), (1, [1e30, 2.0], 1, ""), (2, [6e4, 0.0], 2, ""), (3, [-1e30, 0.0], 2, "")]
    got = H.hard_negatives(spark.createDataFrame(table, SCHEMA)).collect()
    assert [(r["positive_id"], r["negative_id"]) for r in got] == [(1, 2)] and got[0]["positive_score"] == (1 << 48) + 256 * 512


def test_no_rows(spark):
    assert H.hard_negatives(spark.createDataFrame([], SCHEMA)).count() == 0
    assert H.hard_negatives(spark.createDataFrame([(50, [0.5], 1, "")], SCHEMA)).count() == 0


def test_bounds_hold_and_dismiss():
    rng = np.random.default_rng(1)
    x = np.floor(256 * (rng.normal(size=(300, 64)) * 0.2 + np.repeat(rng.normal(size=(300, 4)), 16, axis=1)))
    rows_ = H.Rows(np.arange(300), np.zeros(300, int), x, H.summaries(x))
    exact, kept = x @ x.T, []
    for mean, deviation in rows_.levels:
        middle, spread = mean @ mean.T, deviation @ deviation.T
        assert np.all(middle - spread <= exact) and np.all(exact <= middle + spread)
        kept.append(np.mean(middle + spread >= np.sort(exact, axis=1)[:, -5][:, None]))
    assert kept[0] >= kept[1] >= kept[2] and kept[1] < 0.2  # narrower segments dismiss more

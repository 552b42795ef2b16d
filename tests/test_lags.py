"""Lagged correlations against all pairs in numpy, and how few pairs are computed."""

from __future__ import annotations

import numpy as np

from loomgraph.operators import temporal as W


def all_pairs(series, lags, least):
    out = []
    names = sorted(u for u, points in series.items() if len(points) >= 3 and np.std(list(points.values())) > 1e-10)
    z = {u: {t: (v - np.mean(list(series[u].values()))) / np.std(list(series[u].values())) for t, v in series[u].items()} for u in names}
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            found = []
            for lag in range(-lags, lags + 1):
                if abs(lag) <= len(z[a]) // 2 and (shared := [t for t in z[b] if t + lag in z[a]]):
                    found.append((round(sum(z[a][t + lag] * z[b][t] for t in shared) / len(z[a]), 6), lag))
            best = min(found, key=lambda x: (-abs(x[0]), x[1]))
            if best[1] and abs(best[0]) > least:
                out.append((a, b, *best))
    return sorted(out)


def test_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(W, "SERIES_BLOCK", 7)
    rng = np.random.default_rng(4)
    walk = rng.normal(size=(6, 40)).cumsum(axis=1)
    series = {f"s{i:02d}": {t: float((-1) ** i * walk[i % 6][t + i % 4] + rng.normal(scale=0.2)) for t in range(1, 33) if (t * i) % 11 != 1} for i in range(30)}
    series |= {"flat": dict.fromkeys(range(9), 1.0), "short": {1: 0.0, 2: 1.0}, "late": {t: float(np.sin(t)) for t in range(28, 33)}}
    frame = spark.createDataFrame([(u, t, v) for u, points in series.items() for t, v in points.items()], "uid string, round int, value double").repartition(5)
    want = all_pairs(series, 3, 0.6)
    got = sorted((r["a"], r["b"], r["correlation"], r["lag"]) for r in W.lagged_correlation(frame, least=0.6, k=10_000).collect())
    assert [(a, b, lag) for a, b, _, lag in got] == [(a, b, lag) for a, b, _, lag in want] and len(want) > 20
    assert np.allclose([r[2] for r in got], [r[2] for r in want], atol=2e-6)
    assert W.lagged_correlation(frame.limit(0)).count() == 0


def test_spectra_bound_all_lags_and_dismiss():
    rng = np.random.default_rng(5)
    z = rng.normal(size=(200, 64)).cumsum(axis=1) * rng.choice([0, 1], size=(200, 1)) + np.sin(np.outer(rng.uniform(0.1, 3, 200), np.arange(64))) * 8
    z = (z - z.mean(1, keepdims=True)) / z.std(1, keepdims=True)
    bound, most = W._band_sizes(z, 3) @ W._band_sizes(z, 3).T / 64, np.zeros((200, 200))
    for lag in range(-3, 4):
        most = np.maximum(most, np.abs(z[:, max(lag, 0) : 64 + min(lag, 0)] @ z[:, max(-lag, 0) : 64 - max(lag, 0)].T) / 64)
    assert np.all(most <= bound + 1e-9)
    upper = np.triu_indices(200, 1)
    assert (bound[upper] > 0.9).sum() < 0.3 * len(upper[0]) and (most[upper] > 0.9).sum() > 50

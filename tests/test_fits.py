"""Fits of all features at once against numpy, feature by feature."""

import hashlib

import numpy as np
import pytest

from strandline.operators import fits, testing


def matrix(draw, features, samples, scale=10.0):
    return [(f"f{i}", f"s{k}", float(draw.normal(scale * i, 3))) for i in range(features) for k in range(samples) if draw.random() < 0.8]


def test_poisson_bootstrap(spark):
    draw = np.random.default_rng(1)
    rows = matrix(draw, 6, 40)
    known = {f"s{k}": (float(draw.normal(70, 8)), float(k % 2), "abc"[k % 3]) for k in range(40)}
    df = spark.createDataFrame([(f, s, v, *known[s]) for f, s, v in rows] + [("f0", "lost", None, 1.0, 1.0, "a")], "feature string, sample string, value double, age double, male double, g string")
    got = {(r.feature, r["sample"]): r.value for r in testing.regressed(df, ["age", "male"], "g", ["age"], boots=5, seed=3).collect()}
    assert got.pop(("f0", "lost")) is None
    weights = []
    for f in {f for f, _, _ in rows}:
        mine = [(s, v) for g, s, v in rows if g == f]
        x = np.array([[1, known[s][0], known[s][1], known[s][2] == "b", known[s][2] == "c"] for s, _ in mine], float)
        y, effects = np.array([v for _, v in mine]), []
        for d in range(1, 6):
            u = np.array([int(hashlib.md5(f"3|{f}|{s}|{d}".encode()).hexdigest()[:8], 16) / 2**32 for s, _ in mine])
            w = sum((u >= t).astype(float) for t in fits.POISSON)
            weights += w.tolist()
            effects.append(np.linalg.lstsq(x * np.sqrt(w)[:, None], y * np.sqrt(w), rcond=None)[0][1])
        for (s, v), a in zip(mine, x[:, 1]):
            assert got[f, s] == pytest.approx(v - np.median(effects) * a, rel=1e-6, abs=1e-6)
    assert abs(np.mean(weights) - 1) < 0.1 and abs(np.var(weights) - 1) < 0.25
    again = {(r.feature, r["sample"]): r.value for r in testing.regressed(df.repartition(7), ["age", "male"], "g", ["age"], boots=5, seed=3).collect()}
    assert all(again[k] == pytest.approx(v, rel=1e-9) for k, v in got.items())


def test_effects_are_those_of_least_squares(spark):
    draw = np.random.default_rng(2)
    rows = matrix(draw, 8, 30) + [("small", "s1", 2.0), ("small", "s2", 5.0)]
    known = {f"s{k}": [float(draw.normal(7, 1)), float(k % 2), float(k % 3 == 0)] for k in range(30)}
    samples = spark.createDataFrame([(s, *v) for s, v in known.items()] + [("no", None, 1.0, 1.0)], "sample string, rin double, sex double, ad double")
    df = spark.createDataFrame(rows + [("f0", "no", 1.0)], "feature string, sample string, value double")
    got = {(r.feature, r["sample"]): r.value for r in testing.without_effects(df, samples, ["rin", "sex"], ["ad"]).collect()}
    assert len(got) == len(rows)
    for f in {f for f, _, _ in rows}:
        mine = [(s, v) for g, s, v in rows if g == f]
        x = np.array([known[s] for s, _ in mine])
        x, y = x - x.mean(0), np.array([v for _, v in mine])
        effect = np.linalg.lstsq(np.column_stack([np.ones(len(x)), x]), y, rcond=None)[0][1:3]
        for (s, v), e in zip(mine, x):
            assert got[f, s] == pytest.approx(v - e[:2] @ effect, abs=1e-6)


def reweighted(y, size, x, a, steps=50):
    beta = np.zeros(x.shape[1])
    beta[0] = np.log((y / size).mean())
    for _ in range(steps):
        mu = np.clip(size * np.exp(np.clip(x @ beta, -30, 30)), 1e-6, None)
        w = mu / (1 + a * mu)
        h = x.T @ (w[:, None] * x) + 1e-8 * np.eye(x.shape[1])
        new = np.linalg.solve(h, x.T @ (w * (x @ beta + (y - mu) / mu)))
        moved, beta = np.abs(new - beta).max(), new
        if moved < 1e-8:
            break
    return beta, np.sqrt(np.linalg.inv(h)[-1, -1])


def test_count_tests_equal_single_fits(spark):
    draw, n = np.random.default_rng(3), 24
    samples = [(f"s{k}", "ab"[k % 2], float(draw.normal(7, 1))) for k in range(n)]
    sizes = {s: 0.5 + k / n for k, (s, _, _) in enumerate(samples)}
    counts = [(f"f{i}", s, float(draw.negative_binomial(5, 5 / (5 + (30 + i) * sizes[s])))) for i in range(40) for s, _, _ in samples]
    df = spark.createDataFrame([c for c in counts if c[2]] + [("zero", "s0", 0.0)], "feature string, sample string, value double")
    factors = spark.createDataFrame(list(sizes.items()), "sample string, size_factor double")
    got = {r.feature: r for r in testing.count_tests(df, factors, spark.createDataFrame(samples, "sample string, g string, rin double"), ["rin"], "g", "a", "b").collect()}
    rin, size = np.array([r for _, _, r in samples]), np.array(list(sizes.values()))
    x = np.column_stack([np.ones(n), (rin - rin.mean()) / rin.std(ddof=1), [g == "b" for _, g, _ in samples]])
    for i in range(40):
        r = got[f"f{i}"]
        beta, se = reweighted(np.array([c for f, _, c in counts if f == f"f{i}"]), size, x, r.dispersion)
        assert (r.log2fc, r.se, r.stat) == pytest.approx((beta[-1] / np.log(2), se / np.log(2), beta[-1] / se), rel=1e-6) and r.converged and 0 <= r.p <= 1
    assert len(got) == 41 and got["zero"].p is None and got["zero"].base_mean == 0
    few = testing.count_tests(df, factors, spark.createDataFrame(samples, "sample string, g string, rin double"), ["rin"], "g", "a", "b", steps=2)
    assert {r.converged for r in few.collect() if r.feature != "zero"} == {False}

"""Studentised ranges, order statistics dealt by ranges and merges by a spine of keys, against exact or brute-force figures."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions import distributions as dist
from strandline.operators import merging, ranks, testing


@pytest.mark.parametrize("df", [1, 2, 3, 5, 29, 30, 97, 1000])
def test_two_groups_are_a_t_test(df):
    q = np.array([1e-3, 0.1, 0.2, 1, 3, 8, 20, 100, 1000, 1e5, 1e7])
    got, want = (f(x, *(np.full(len(q), float(v)) for v in a)) for f, x, a in ((dist.range_tail, q, (2, df)), (dist.t_tail, q / math.sqrt(2), (df,))))
    seen = want > 1e-200
    assert (np.abs(got - want)[seen] < 1e-8 * want[seen]).all() and (got[~seen] <= 1e-199).all()


# Upper 5 % and 1 % points of the studentised range, by groups and df, from published tables.
POINTS = {(3, 1): (26.98, 135.0), (3, 10): (3.877, 5.270), (3, 120): (3.356, 4.200), (5, 5): (5.673, 8.421), (5, 60): (3.977, 4.818), (10, 1): (49.07, 245.6), (10, 20): (5.008, 6.086), (10, 120): (4.560, 5.299)}


def test_published_points():
    for (k, v), points in POINTS.items():
        for p, want in zip((0.05, 0.01), points):
            q = dist.range_quantile(np.array([p]), np.array([k]), np.array([v]))
            assert q[0] == pytest.approx(want, rel=1e-3)
            assert dist.range_tail(q, np.array([k]), np.array([v]))[0] == pytest.approx(p, rel=1e-9)
    assert np.isnan(dist.range_tail(np.array([-1.0, 1.0, 1.0]), np.array([3.0, 1.0, 3.0]), np.array([5.0, 5.0, 0.0]))).all()


def test_tukey_intervals(spark):
    draw = random.Random(2)
    groups = {"a": [draw.gauss(0, 1) for _ in range(6)], "b": [draw.gauss(3, 1) for _ in range(9)], "c": [draw.gauss(0.2, 1) for _ in range(5)]}
    rows = [("f", g, x) for g, xs in groups.items() for x in xs] + [("flat", g, 1.0) for g in "aabb"] + [("single", "a", 1.0), ("single", "b", 2.0), ("f", "c", None)]
    got = {(r.feature, r.comparison): r for r in testing.tukey(spark.createDataFrame(rows, "feature string, grp string, value double")).collect()}
    assert set(got) == {("f", "b-a"), ("f", "c-a"), ("f", "c-b"), ("flat", "b-a"), ("single", "b-a")}
    df = sum(len(x) - 1 for x in groups.values())
    ms = sum((len(x) - 1) * statistics.variance(x) for x in groups.values()) / df
    critical = dist.range_quantile(np.array([0.05]), np.array([3]), np.array([df]))[0]
    for x, y in (("a", "b"), ("a", "c"), ("b", "c")):
        r, d = got["f", f"{y}-{x}"], statistics.mean(groups[y]) - statistics.mean(groups[x])
        reach = critical * math.sqrt(ms / 2 * (1 / len(groups[x]) + 1 / len(groups[y])))
        assert (r.difference, r.lower, r.upper) == pytest.approx((d, d - reach, d + reach)) and r.df == df
        assert (r.p < 0.05) == (r.lower > 0 or r.upper < 0)
    for key in (("flat", "b-a"), ("single", "b-a")):
        assert got[key].p is None and got[key].lower is None


@pytest.mark.parametrize("parts", [1, 7])
def test_medians(spark, parts):
    draw = random.Random(parts)
    rows = [(draw.choice(["a", "b", None]), draw.choice([1, None]), draw.choice([None, draw.gauss(0, 1), 3.0, 4.0])) for _ in range(300)]
    rows += [("one", 1, 5.0), ("two", 1, 1.0), ("two", 1, 4.0), ("none", 1, None), ("same", 1, 2.0), ("same", 1, 2.0)] + [("hot", 2, float(i // 40)) for i in range(401)]
    df = spark.createDataFrame(rows, "g string, h int, value double").repartition(parts)
    got = {(r.g, r.h): r.m for r in ranks.medians(df, ["g", "h"], "value", "m").collect()}
    want = {}
    for g, h, v in rows:
        if v is not None:
            want.setdefault((g, h), []).append(v)
    want = {k: statistics.median(v) for k, v in want.items()} | {("none", 1): None}
    assert got == {k: v if v is None else pytest.approx(v) for k, v in want.items()}
    assert ranks.medians(df.limit(0), ["g"], "value", "m").count() == 0


def test_merge_shuffles_each_source_once(spark):
    draw = random.Random(1)
    make = lambda n, name: [(draw.choice(["k1", "k2", "k3", f"{name}{i}", None]), i) for i in range(n)]
    tables = {name: make(12, name) for name in "abc"}
    frames = {name: spark.createDataFrame(rows, "sequence string, v int") for name, rows in tables.items()}
    for null_safe in (False, True):
        got = merging.merge_sources(frames, null_safe=null_safe)
        want = []
        for key in {k for rows in tables.values() for k, _ in rows if k is not None or null_safe}:
            sides = [[v for k, v in tables[n] if k == key] or [None] for n in "abc"]
            want += [(key, a, b, c) for a in sides[0] for b in sides[1] for c in sides[2]]
        if not null_safe:
            want += [(None, *(v if m == n else None for m in "abc")) for n in "abc" for k, v in tables[n] if k is None]
        assert sorted(map(str, (tuple(r) for r in got.select("sequence", "a_v", "b_v", "c_v").collect()))) == sorted(map(str, want))
        assert got.filter(F.col("a_v").isNotNull() != F.col("a_present")).count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "FullOuter" not in plan

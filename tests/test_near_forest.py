"""Spanning forests of near parts, without their pairs, against the forest of all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from wakeline.operators import forest

SHAPE = "id long, x_m double, y_m double"


def cases():
    pick = random.Random(8)
    yield "spread", [(k, pick.uniform(-200, 200), pick.uniform(-200, 200)) for k in range(250)]
    yield "lattice", [(pick.randrange(10**6) * 100 + k, 3.0 * (k % 15), 3.0 * (k // 15)) for k in range(200)]
    yield "crowd and copies", [(k * 37 % 211, (k % 7) * 0.01 + 9.0 * (k % 2), 0.0) for k in range(200)]
    yield "lengths of 0", [(1, 0.0, 0.0), (5, 0.0, 0.0), (2, 1e-8, 0.0), (4, 1e-8, 0.0), (3, 0.0, 1e-8), (9, 7.0, 0.0)]
    yield "odd", [(1, 0.0, -0.0), (2, -0.0, 0.0), (3, None, 1.0), (4, math.nan, 1.0), (5, math.inf, 0.0), (None, 0.0, 0.0), (6, 10.0, 0.0), (7, 0.0, 10.000001)]


def brute(rows, gap, digits):
    edges, parent, out = [], {}, []
    good = sorted(r for r in rows if r[0] is not None and all(v is not None and math.isfinite(v) for v in r[1:]))
    for n, a in enumerate(good):
        for b in good[n + 1 :]:
            if (d := math.hypot(a[1] - b[1], a[2] - b[2])) <= gap:
                edges.append((round(d, digits), a[0], b[0]))

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for w, a, b in sorted(edges):
        if root(a) != root(b):
            parent[root(a)] = root(b)
            out.append((a, b, w))
    return sorted(out)


@pytest.mark.parametrize(("name", "rows"), list(cases()))
def test_near_forest_is_that_of_all_pairs(spark, name, rows):
    got = sorted(tuple(r) for r in forest.near_forest(spark.createDataFrame(rows, SHAPE), 10.0, digits=6).collect())
    assert got == brute(rows, 10.0, 6)


def test_crowds_list_few_pairs(spark, monkeypatch):
    """All 200 million pairs of 20000 parts are near; no step may hold more rows than a few for each part."""
    seen = []
    real = forest.cut
    monkeypatch.setattr(forest, "cut", lambda df, name: seen.append(real(df, name)) or seen[-1])
    crowd = spark.range(20_000).selectExpr("id", "(id * 7919 % 997) * 1e0 AS x_m", "(id * 104729 % 991) * 1e0 AS y_m")
    assert forest.near_forest(crowd, 3000.0).count() == 19_999
    assert max(t.count() for t in seen) <= 20 * 20_000


def test_heights_and_least_gaps_of_groups(spark):
    pick = random.Random(2)
    rows = [(k, pick.uniform(0, 90), pick.uniform(0, 90)) for k in range(120)]
    grouped = [(g, *r) for r in rows for g in {int(r[1] // 30), int((r[1] + 5) // 30)}]
    got = {r.g: r.height for r in forest.near_heights(spark.createDataFrame(grouped, "g int, " + SHAPE), 10.0, "g", 6).collect()}
    assert got == {g: max(w for *_, w in brute([r[1:] for r in grouped if r[0] == g], 10.0, 6)) for g in {r[0] for r in grouped}}
    parts = spark.createDataFrame(rows, SHAPE)
    least = {r.component: r.w for r in forest.least_apart(parts, parts.select("id", (F.col("id") % 5).alias("component")), 10.0).collect()}
    for c in range(5):
        assert least[c] == min(math.hypot(a[1] - b[1], a[2] - b[2]) for a in rows for b in rows if a[0] % 5 == c != b[0] % 5)

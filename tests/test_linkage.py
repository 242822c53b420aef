"""Linkage without pairs against all pairs, on odd inputs."""

import math
import random

import pytest

from wakeline.operators import events, linkage

SHAPE = "id long, x_m double, y_m double, bearing double"


def brute(rows, gap, turn):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    good = [r for r in rows if r[0] is not None and all(v is not None and math.isfinite(v) for v in (r[1:3] if turn is None else r[1:]))]
    for k, a in enumerate(good):
        for b in good[:k]:
            d = (a[3] - b[3]) % 180.0 if turn is not None else 0.0
            if math.hypot(a[1] - b[1], a[2] - b[2]) <= gap and (turn is None or min(d, 180.0 - d) <= turn):
                x, y = root(a[0]), root(b[0])
                parent[max(x, y)] = min(x, y)
    return sorted((r[0], root(r[0])) for r in rows if r[0] is not None)


def cases():
    pick = random.Random(5)
    yield "dense", [(k, pick.uniform(-50, 50), pick.uniform(-50, 50), pick.uniform(-200, 400)) for k in range(300)]
    yield "sparse", [(k, pick.uniform(-300, 300), pick.uniform(-300, 300), pick.uniform(0, 180)) for k in range(300)]
    yield "lattice", [(k, 10.0 * (k % 12), 10.0 * (k // 12), 30.0 * (k % 6)) for k in range(100)]
    yield "two walls just too far apart", [(k, 10.0000001 * (k % 2), 0.05 * k, 0.0) for k in range(200)]
    yield "odd", [(1, 0.0, 0.0, 10.0), (2, 0.0, 0.0, 190.0), (3, 1.0, None, 5.0), (4, math.nan, 1.0, 5.0), (5, 6.0, 8.0, None), (6, 1.0, 1.0, 100.0), (7, math.inf, 0.0, 0.0), (8, -math.inf, 0.0, 0.0)]
    yield "one id at two places", [(5, 0.0, 0.0, 0.0), (5, 500.0, 0.0, 0.0), (6, 3.0, 0.0, 0.0), (2, 505.0, 0.0, 0.0), (9, 250.0, 0.0, 0.0)]


@pytest.mark.parametrize(("name", "rows"), list(cases()))
@pytest.mark.parametrize("turn", [None, 40.0])
def test_linked_is_that_of_all_pairs(spark, name, rows, turn):
    got = linkage.linked(spark.createDataFrame(rows, SHAPE), 10.0, turn).collect()
    assert sorted((r["id"], r["component"]) for r in got) == brute(rows, 10.0, turn)


def test_link_lists_no_pairs(spark, monkeypatch):
    """Nearly all of the 1.25 thousand million pairs of a crowd are linked; no step may hold more rows than it has points."""
    seen = []
    real = linkage.cut
    monkeypatch.setattr(linkage, "cut", lambda df, name: seen.append(real(df, name)) or seen[-1])
    crowd = spark.range(50_000).selectExpr("id", "(id * 7919 % 997) * 1e0 AS x_m", "(id * 104729 % 991) * 1e0 AS y_m", "(id % 180) * 1e0 AS bearing")
    assert events.link(crowd, 3000.0).select("component").distinct().count() == 1
    assert events.link(crowd, 3000.0, 40.0).select("component").distinct().count() == 1
    assert max(t.count() for t in seen) <= 50_000

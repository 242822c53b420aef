"""Spanning forests against Kruskal's, hierarchies against components at each height, resampling against its definition."""

import math
import random

import numpy as np
import pytest

from wakeline.operators import bootstrap, forest, graph


def kruskal(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    kept = set()
    for w, a, b in sorted((w, min(a, b), max(a, b)) for a, b, w in edges if a is not None and b is not None and w is not None and a != b):
        if root(a) != root(b):
            parent[root(a)] = root(b)
            kept.add((a, b, w))
    return kept


def graphs():
    pick = random.Random(2)
    yield [(k, k + 1, float(k)) for k in range(60)]  # every component's least edge leads the same way
    yield [(0, k, 1.0) for k in range(1, 80)] + [(k, k + 1, 1.0) for k in range(1, 79)]  # a hub, and ties
    yield [(pick.randint(0, 60), pick.randint(0, 60), float(pick.randint(0, 9))) for _ in range(150)] + [(1, 1, 0.0), (None, 2, 1.0), (2, 3, None)]


@pytest.mark.parametrize("edges", graphs())
def test_forest_is_kruskals(spark, edges):
    got = forest.spanning_forest(spark.createDataFrame(edges, "a long, b long, w double")).collect()
    assert len(got) == len({tuple(r) for r in got}) and {tuple(r) for r in got} == kruskal(edges)


def test_forest_of_nothing(spark):
    none = spark.createDataFrame([], "a long, b long, w double")
    assert forest.spanning_forest(none).collect() == []
    levels = forest.dendrogram(spark.createDataFrame([(5,)], "id long"), none, (1.0,))
    assert [tuple(r) for r in levels.collect()] == [(1.0, 5, 5, 1)]


def test_heights_of_groups_that_share_ids(spark):
    rows = [(1, 1, 2, 1.0), (1, 2, 3, 5.0), (1, 1, 3, 2.0), (2, 1, 2, 7.0), (2, 8, 9, 3.0), (3, 4, 4, 1.0)]
    got = forest.merge_heights(spark.createDataFrame(rows, "g long, a long, b long, w double"), "g").collect()
    assert {tuple(r) for r in got} == {(1, 2.0), (2, 7.0)}


def test_hierarchy_is_the_components_of_each_height(spark):
    edges = [(a, b, w) for a, b, w in list(graphs())[2] if None not in (a, b, w)]
    e, nodes = spark.createDataFrame(edges, "a long, b long, w double"), spark.createDataFrame([(k,) for k in range(64)], "id long")
    heights = (0.5, 2.0, 2.0, 5.0, 20.0)
    rows = forest.dendrogram(nodes, forest.spanning_forest(e), heights).collect()
    label = {k: k for k in range(64)}
    for h in sorted(set(heights)):
        up = {r.part: r.component for r in rows if r.height == h}
        assert set(label.values()) == up.keys()
        label = {k: up[c] for k, c in label.items()}
        want = {r.id: r.component for r in graph.with_singles(nodes, e.filter(f"w <= {h}")).collect()}
        assert label == want
        assert all(r.n == sum(c == r.component for c in want.values()) for r in rows if r.height == h)


def test_binomial_is_the_inverse_distribution():
    n = np.array([0, 1, 5, 40, 3000])
    for p in (0.001, 0.3, 0.99, 1.0):
        for u in (2.0**-33, 0.2, 0.7, 0.999999):
            got = bootstrap.binomial(n, p, np.full(len(n), u))
            for m, k in zip(n.tolist(), got.tolist(), strict=True):
                upto = [0.0]
                for j in range(m + 1):
                    log_p = math.lgamma(m + 1) - math.lgamma(j + 1) - math.lgamma(m - j + 1)
                    upto.append(upto[-1] + (math.exp(log_p + j * math.log(p) + (m - j) * math.log1p(-p)) if p < 1 else float(j == m)))
                want = next((j for j in range(m + 1) if upto[j + 1] >= u), m)
                assert k == want, (m, p, u)


@pytest.mark.parametrize("block", [4096, 7])
def test_each_draw_picks_as_many_tiles_as_there_are(spark, block):
    n, draws = 30, 400
    rows = [(f"t{k:03}", 1.0, *(float(k == j) for j in range(n))) for k in range(n)] + [("z", None, *[None] * n)]
    names = tuple(f"w{j}" for j in range(n))
    df = spark.createDataFrame(rows, "tile string, one double, " + ", ".join(f"{c} double" for c in names))
    got = bootstrap.bootstrap_sums(df.repartition(4), draws, ("one", *names), block=block).orderBy("draw").toPandas()
    weights = got[list(names)].to_numpy()
    last = n + 1 - weights.sum(axis=1)  # what the tile of nulls was picked
    assert (got["one"] == weights.sum(axis=1)).all() and (last >= 0).all() and len(got) == draws
    mean, var, cov = weights.mean(), weights.var(axis=0).mean(), np.cov(weights.T)
    assert abs(mean - 1) < 0.02 and abs(var - (1 - 1 / (n + 1))) < 0.1  # those of a multinomial with equal chances
    assert abs((cov.sum() - np.trace(cov)) / (n * (n - 1)) + 1 / (n + 1)) < 0.02
    again = bootstrap.bootstrap_sums(df.coalesce(1), draws, ("one", *names), block=block).orderBy("draw").toPandas()
    assert again.equals(got)


def test_interval_of_constant_tiles(spark):
    tiles = spark.createDataFrame([(k, 1, 2, 0) for k in range(50)], "tile int, tp int, n int, zero int")
    sums = bootstrap.bootstrap_sums(tiles, 20, ("tp", "n", "zero"))
    assert tuple(bootstrap.interval(sums, "tp", "n").first()) == (0.5, 0.5, 0.5, 20)
    assert bootstrap.interval(sums, "tp", "zero").first().draws == 0
    assert bootstrap.bootstrap_sums(tiles.limit(0), 20, ("tp",)).collect() == []

"""Similarity joins and energy distances against all pairs, whatever the size of blocks."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wakeline.operators import similarity

SMALL = "/root/testdata/sf0.01/embeddings.parquet"


def vectors(n, dim, seed, clusters=0):
    random = np.random.default_rng(seed)
    v = random.standard_normal((n, dim))
    if clusters:
        v = 8 * random.standard_normal((clusters, dim))[random.integers(0, clusters, n)] + v
    v[n // 2 : n // 2 + n // 4] = v[: n // 4] * 1.5 + 0.1 * random.standard_normal((n // 4, dim))
    return v


def all_pairs(left, right, at_least):
    u, w = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (left, right))
    return {(int(i), int(j)) for i, j in np.argwhere(u @ w.T >= at_least)}


def frame(spark, v, odd=()):
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + list(odd)
    return spark.createDataFrame(rows, "id long, v array<double>").withColumns({c: F.lit(1) for c in ("row", "u", "dim", "cell")})


ODD = [(900, None), (901, []), (902, [0.0] * 20), (903, [1.0] * 19), (904, [math.nan] * 20), (905, [None] + [1.0] * 19), (906, [math.inf] + [1.0] * 19)]


@pytest.mark.parametrize(("at_least", "block"), [(0.4, 16_384), (0.4, 20), (0.9, 20), (0.97, 20), (0.999, 20)])
@pytest.mark.parametrize("clusters", [0, 9])
def test_pairs_are_all_pairs(spark, at_least, block, clusters):
    v = vectors(160, 20, 1, clusters)
    df = frame(spark, v, ODD)
    got = similarity.similar_pairs(df, None, at_least, block=block).collect()
    want = {(i, j) for i, j in all_pairs(v, v, at_least) if i < j}
    assert len(got) == len(want) and {(r.a, r.b) for r in got} == want
    other = vectors(90, 20, 2, clusters)
    other[:20] = v[:20]
    got = similarity.similar_pairs(df, frame(spark, other, ODD), at_least, block=block).collect()
    odd = {(903, 903)}  # of one length with itself only
    assert len(got) == len({(r.a, r.b) for r in got}) and {(r.a, r.b) for r in got} == all_pairs(v, other, at_least) | odd


@pytest.mark.parametrize("block", [16_384, 5])
def test_far_cells_are_left_out(spark, block):
    v = vectors(120, 20, 3, 4)
    df = frame(spark, v)
    units = similarity.unit_vectors(df)
    got = similarity.similar_by_blocks(units, units, 0.8, block)
    assert {(min(r.a, r.b), max(r.a, r.b)) for r in got.collect()} == {(i, j) for i, j in all_pairs(v, v, 0.8) if i < j}


def test_few_candidates_near_one(spark):
    df = spark.read.parquet(SMALL).select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    units = similarity.unit_vectors(df)
    n = units.count()
    assert similarity.met_by_signs(units, units, 0.97).count() < 0.1 * n * (n - 1) / 2


def test_flips_are_the_small_sums():
    random = np.random.default_rng(0)
    for n in (1, 5, 9):
        squares = (random.standard_normal(n) ** 2).tolist()
        want = {b for b in range(1 << n) if sum(s for k, s in enumerate(squares) if b >> k & 1) <= 1.0}
        assert sorted(similarity.flips(squares, 1.0)) == sorted(want)


@pytest.mark.parametrize("block", [16_384, 7])
def test_energy_by_all_pairs(spark, block):
    random = np.random.default_rng(4)
    clouds = {k: (random.standard_normal((m, 2)), random.standard_normal((n, 2)) + k) for k, (m, n) in enumerate([(30, 20), (1, 1), (40, 3)])}
    rows = [[(k, *map(float, p)) for k, c in clouds.items() for p in c[side]] for side in (0, 1)]
    rows[0] += [(7, 0.0, 0.0), (0, None, 1.0)]
    a, b = (spark.createDataFrame(r, "g long, x double, y double") for r in rows)
    got = {r.g: r.energy for r in similarity.energy_distance(a, b, "g", block).collect()}
    mean = lambda p, q: np.linalg.norm(p[:, None] - q[None], axis=2).mean()
    assert got.keys() == clouds.keys()
    for k, (p, q) in clouds.items():
        assert math.isclose(got[k], 2 * mean(p, q) - mean(p, p) - mean(q, q), abs_tol=1e-9)


def test_empty(spark):
    none = spark.createDataFrame([], "id long, v array<double>")
    for at_least in (0.5, 0.98):
        assert similarity.similar_pairs(none, None, at_least).collect() == []
        assert similarity.similar_pairs(none, none, at_least).collect() == []

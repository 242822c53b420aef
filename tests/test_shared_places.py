"""Clouds that share places, against plain distances to every particle."""

import random

import numpy as np
import pytest

from wakeline.operators import clouds, scoring


@pytest.mark.parametrize("wide", [3.0, 300.0])
def test_shared_places_are_met_once(spark, monkeypatch, wide):
    pick = random.Random(3)
    spots = [(pick.uniform(-wide / 2, wide / 2), pick.uniform(-wide / 4, wide / 4)) for _ in range(40)]
    dots = [(k % 2, k % 3 or None, *pick.choice(spots)) for k in range(900)]
    rows = [(f"m{k}", k % 2, pick.uniform(-wide / 2, wide / 2), pick.uniform(-wide / 4, wide / 4), 20.0 + k) for k in range(50)] + [("n", 0, None, 0.0, 1.0)]
    at = spark.createDataFrame(rows, "mmsi string, t int, lon double, lat double, sigma double")
    cloud = spark.createDataFrame(dots, "t int, member int, p_lon double, p_lat double")
    monkeypatch.setattr(clouds, "TILE", (16, 4))
    want = {}
    for m, t, lon, lat, s in rows:
        for member in (None, 1, 2):
            d = clouds.distances_km(*(clouds._unit(*np.array(p, float).T) for p in ([(lon or 0.0, lat)], [(x, y) for u, c, x, y in dots if (u, c) == (t, member)])))[0]
            want[m, member] = (None, None) if lon is None else (d.min(), np.exp(-0.5 * (d / s) ** 2).mean())
    got = {(r.mmsi, r.member): (r.min_distance_km, r.density_score) for r in clouds.against_clouds(at, cloud, ("t",), "sigma", ("member",), ("min_distance_km", "density_score")).collect()}
    assert got.keys() == want.keys()
    for k, values in want.items():
        assert got[k] == values if values[0] is None else np.allclose(got[k], values, rtol=1e-9, atol=1e-12)


def test_members_are_met_together_and_keep_their_boxes(spark, monkeypatch):
    """One search for all members of a cluster; a position outside a member's own box has no row of it."""
    asked = []
    real = scoring.against_clouds
    monkeypatch.setattr(scoring, "against_clouds", lambda *a, **k: asked.append((a[0].count(), a[2])) or real(*a, **k))
    particles = spark.createDataFrame([(0, m, 0, 10.0 * m + 0.1 * k, 25.0) for m in range(3) for k in range(5)], "cluster_id int, member int, t long, p_lon double, p_lat double")
    positions = spark.createDataFrame([("a", 0, 0.2, 25.0), ("b", 0, 10.2, 25.0), ("c", 0, 5.0, 25.0)], "mmsi string, t long, lon double, lat double")
    got = {(r.member, r.mmsi) for r in scoring.backward_scores(positions, particles, 0).collect()}
    assert got == {(0, "a"), (1, "b")}
    assert asked == [(3, ("cluster_id", "t"))]


def test_densities_are_interpolated_where_pairs_are_many(spark, monkeypatch):
    """Before, every position met every particle; now nodes meet, and nothing differs beyond rounding."""
    pick = np.random.default_rng(9)
    n, m = 3000, 6000
    lon, lat = -93 + 1.5 * pick.random(n), 25 + pick.random(n)
    lon[:5] += 40.0  # alone, some of them far from everything
    x, y = -93 + 1.5 * pick.random(m), 25 + pick.random(m)
    x[:3] += 0.0, 1.5, 40.0
    scenario = pick.integers(0, 3, m)
    met = []
    real = clouds._kernel_sums
    monkeypatch.setattr(clouds, "_kernel_sums", lambda a, b, *rest: met.append(a.shape[1] * b.shape[1]) or real(a, b, *rest))
    order = np.argsort(scenario, kind="stable")
    got = clouds.interpolated_densities(lon, lat, x[order], y[order], np.ones(m), scenario[order], 3, 50.0)
    assert sum(met) < n * m / 4
    want = np.stack([np.exp(-0.5 * (clouds.distances_km(clouds._unit(lon, lat), clouds._unit(x[scenario == k], y[scenario == k])) / 50.0) ** 2).mean(axis=1) for k in range(3)], axis=1)
    assert np.abs(got - want).max() < clouds.PRECISION and got.min() >= 0
    # The same through Spark, beside a position without a place.
    at = spark.createDataFrame([(f"m{k}", 0, float(lon[k]), float(lat[k])) for k in range(n)] + [("none", 0, None, 25.0)], "mmsi string, t int, lon double, lat double")
    cloud = spark.createDataFrame([(0, int(scenario[k]), float(x[k]), float(y[k])) for k in range(m)], "t int, scenario_id int, p_lon double, p_lat double")
    rows = scoring.time_scores(at, cloud, 50.0, ("scenario_id",), ("density_score",), ("mmsi",)).collect()
    assert n * m >= clouds.MANY and len(rows) == 3 * (n + 1)
    for r in rows:
        assert r.density_score is None if r.mmsi == "none" else abs(r.density_score - want[int(r.mmsi[1:]), r.scenario_id]) < clouds.PRECISION

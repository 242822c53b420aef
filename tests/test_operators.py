"""Operators on small literal tables: ties, nulls, repeated rows."""

import numpy as np
from pyspark.sql import functions as F

from wakeline.operators import asof, audit, forward, fusion, graph
from wakeline.operators.buckets import box_join, radius_join

HOUR = 3_600_000_000


def test_asof_tie_takes_the_earlier_report(spark):
    reports = spark.createDataFrame([("a", 0, 1.0, 1.0), ("a", 2 * HOUR, 2.0, 2.0)], "mmsi string, us long, lon double, lat double")
    times = spark.createDataFrame([(HOUR,), (9 * HOUR,)], "t long")
    got = asof.asof_nearest(reports, asof.grid_for(reports, times), 3 * HOUR).collect()
    assert [(r.t, r.us) for r in got] == [(HOUR, 0)]


def test_components_by_brute_force(spark):
    edges = [(i, i + 1) for i in range(1, 40) if i % 7] + [(100, k) for k in range(101, 160)] + [(5, 5), (1, 2)]
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = graph.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.id: r.component for r in got} == label


def test_components_of_no_edges(spark):
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_window_of_the_first_best(spark):
    oil = spark.createDataFrame([(1, "a", 0, k, k % 4, 0.0, 0.0 if k % 4 == 2 else 1.0) for k in range(16)], "cluster_id int, mmsi string, member int, pid long, hour int, lon double, lat double")
    samples = spark.createDataFrame([(1, 1, 0.0, 0.0)], "cluster_id int, sid int, lon double, lat double")
    best = forward.best_windows(forward.window_search(oil, samples, 1.0, forward.windows(spark)), oil, samples, 1.0).collect()[0]
    assert (best.start_h, best.end_h, best.precision, best.recall, best.member_support) == (2, 3, 1.0, 1.0, 1.0)


def test_rule_sweep_and_choice(spark):
    s = spark.createDataFrame([(c, m, f, 0.9, 0.9, f) for c in range(4) for m, f in (("t", 0.9), ("u", 0.2))], "case_id int, mmsi string, fwd_f double, bwd_point double, member_support double, combined double")
    cases = spark.createDataFrame([(c, "t", "calibration" if c % 2 else "test") for c in range(4)], "case_id int, truth string, split string")
    rules = spark.createDataFrame([(0, 0.5, 0.5, 0.5, 1.0), (1, 0.95, 0.5, 0.5, 1.0)], "rule_id int, a double, b double, c double, m double")
    swept = fusion.sweep_rules(s, cases, rules)
    rows = {(r.rule_id, r.split): r for r in swept.collect()}
    assert rows[0, "test"].correct_attribution == 1.0 and rows[1, "test"].no_accusation_when_present == 1.0 and rows[0, "test"].false_accusation == 0.0
    assert fusion.choose_rule(swept).collect()[0].rule_id == 0


def test_ranks_share_their_mean_on_ties(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (2.0,)], "v double").withColumn("g", F.lit(1))
    assert sorted(r.q for r in df.select(audit.average_rank(F.col("v"), "g").alias("q")).collect()) == [1.5, 1.5, 3.0]


def test_radius_join_at_antimeridian_and_poles(spark):
    rng = np.random.default_rng(3)
    lon = np.concatenate([rng.uniform(178, 182, 60), rng.uniform(-180, 180, 60), rng.uniform(-5, 5, 60)])
    lat = np.concatenate([rng.uniform(-3, 3, 60), rng.uniform(84, 90, 30), rng.uniform(-90, -86, 30), rng.uniform(59, 61, 60)])
    lon = (lon + 180) % 360 - 180
    made = lambda i: spark.createDataFrame([(int(k), float(lon[k]), float(lat[k])) for k in range(180)], f"{i} long, lon double, lat double")
    p, q, x = np.radians(lat), np.radians(lat)[:, None], np.radians(lon)
    d = 2 * 6371.0088 * np.arcsin(np.sqrt(np.minimum(1, np.sin((p - q) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin((x - x[:, None]) / 2) ** 2)))
    for km in (30.0, 200.0, 3000.0):
        got = {(r.a, r.b) for r in radius_join(made("a"), made("b"), km).collect()}
        assert got == {(int(a), int(b)) for a, b in zip(*np.nonzero(d <= km), strict=True)}


def test_box_join_over_the_antimeridian(spark):
    points = spark.createDataFrame([(1, 0, 179.9, 1.0), (2, 0, -179.9, 1.0), (3, 0, 0.0, 1.0), (4, 0, -179.9, 89.0)], "p int, k int, lon double, lat double")
    boxes = spark.createDataFrame([(1, 0, 179.0, 181.0, 0.0, 2.0), (2, 0, -400.0, 400.0, 88.0, 95.0), (3, 0, -180.5, -179.95, 0.0, 2.0)], "b int, k int, lon0 double, lon1 double, lat0 double, lat1 double")
    assert {(r.p, r.b) for r in box_join(points, boxes, ("k",)).collect()} == {(1, 1), (2, 1), (4, 2), (1, 3)}


def test_clouds_in_slices(spark, monkeypatch):
    """Statistics by all pairs, however positions are sliced; null and odd coordinates, keys without a cloud, null keys."""
    from wakeline.operators import clouds

    rng = np.random.default_rng(5)
    place = lambda: (float(rng.uniform(-1, 1)), float(rng.uniform(-1, 1)))
    rows = [(f"m{k}", k % 3, *place(), 2.0 + k % 2) for k in range(60)] + [("n", 0, None, 1.0, 1.0), ("o", 1, float("nan"), 1.0, 1.0), ("p", 9, 0.0, 0.0, 1.0), ("q", None, 0.0, 0.0, 1.0)]
    dots = [(k % 3, ("a", "b", None)[k % 5 % 3], *place()) for k in range(70)] + [(0, "a", float("nan"), 0.0), (0, "a", None, 0.0), (7, "a", 0.0, 0.0), (2, "lost", None, None)]
    at = spark.createDataFrame(rows, "mmsi string, t int, lon double, lat double, sigma double")
    cloud = spark.createDataFrame(dots, "t int, run string, p_lon double, p_lat double")
    for size in (4096, 5):
        monkeypatch.setattr(clouds, "SLICE", size)
        got = {(r.mmsi, r.t, r.run): r for r in clouds.against_clouds(at, cloud, ("t",), "sigma", ("run",)).collect()}
        want = {(m, t, run) for m, t, *_ in rows for u, run, x, y in dots if t == u and x is not None and x == x and y is not None}
        assert got.keys() == want
        for m, t, lon, lat, s in rows:
            for run in ("a", "b", None):
                if (r := got.get((m, t, run))) is None:
                    continue
                if lon is None or lon != lon:
                    assert r.density_score is None and r.min_distance_km is None
                    continue
                p = np.radians([(x, y) for u, c, x, y in dots if u == t and c == run and x is not None and x == x])
                a, b = np.radians(lon), np.radians(lat)
                h = np.sin((p[:, 1] - b) / 2) ** 2 + np.cos(b) * np.cos(p[:, 1]) * np.sin((p[:, 0] - a) / 2) ** 2
                d = 2 * 6371.0088 * np.arcsin(np.sqrt(h))
                assert np.isclose(r.min_distance_km, d.min()) and np.isclose(r.median_distance_km, np.median(d))
                assert np.isclose(r.density_score, np.exp(-0.5 * (d / s) ** 2).mean()) and np.isclose(r.fraction_particles_10km, (d <= 10).mean())
    assert clouds.against_clouds(at.limit(0), cloud, ("t",), "sigma").collect() == []
    assert clouds.against_clouds(at, cloud.limit(0), ("t",), "sigma").collect() == []


def test_particles_at_one_place_are_one_row(spark):
    import numpy as np

    from wakeline.operators import clouds

    where = [(-93.0 + k * 0.03, 25.0 + k * 0.02, 1 + (k * 5) % 7) for k in range(9)]
    cloud = spark.createDataFrame([(1, x, y) for x, y, n in where for _ in range(n)], "t int, p_lon double, p_lat double")
    at = spark.createDataFrame([("a", 1, -92.9, 25.1, 20.0), ("b", 1, -92.7, 25.2, 3.0)], "mmsi string, t int, lon double, lat double, sigma double")
    whole = clouds.distances_km
    got = {r.mmsi: r for r in clouds.against_clouds(at, cloud, ("t",), "sigma").collect()}
    for a in at.collect():
        unit = lambda x, y: clouds._unit(np.array(x), np.array(y))
        d = whole(unit([a.lon], [a.lat]), unit([x for x, _, n in where for _ in range(n)], [y for _, y, n in where for _ in range(n)]))[0]
        want = [d.min(), *np.quantile(d, [0.1, 0.5]), *((d <= k).mean() for k in (2, 5, 10)), np.exp(-0.5 * (d / a.sigma) ** 2).mean()]
        assert np.allclose([got[a.mmsi][c] for c in clouds.STATISTICS], want, rtol=1e-12, atol=1e-12)
    weighted = clouds._quantiles(np.array([[3.0, 1.0]]), np.array([3.0, 1.0]), [0.1, 0.5])
    assert np.allclose(np.ravel(weighted), np.quantile([1.0, 3.0, 3.0, 3.0], [0.1, 0.5]))


def test_searches_cost_few_pairs_and_no_broadcast(spark):
    import random

    from wakeline.operators import buckets, events, forward

    pick = random.Random(4)
    rows = [(k, pick.random() * 0.5, 25 + pick.random() * 0.5) for k in range(400)]
    a, b = (spark.createDataFrame(rows, f"{c} long, lon double, lat double") for c in ("i", "j"))
    got = {r.i: (r.j, r.dist_km) for r in buckets.nearest_within(a, b.filter("j % 3 = 0"), "i", "j", 8.0).collect()}
    pairs = [(r.i, r.dist_km, r.j) for r in buckets.radius_join(a, b.filter("j % 3 = 0"), 8.0).collect()]
    want = {}
    for i, d, j in sorted(pairs, reverse=True):
        want[i] = (j, d)
    assert got == want
    parts = spark.createDataFrame([(k, x * 1e5, y * 1e5, 0.0) for k, x, y in rows], "id long, x_m double, y_m double, bearing double")
    near = {}
    for r in events.near_pairs(parts, 3000.0).collect():
        for one, other in ((r.a, r.b), (r.b, r.a)):
            near[one] = min(near.get(one, (9e9, 0)), (r.gap, other))
    assert {r.id: (r.gap, r.other) for r in events.nearest_other(parts, 3000.0).collect()} == {k: near.get(k, (None, None)) for k, _, _ in rows}
    oil = spark.createDataFrame([(0, "m", k % 3, k, k % 48, 1.0 + k % 2, 25.0) for k in range(300)], "cluster_id int, mmsi string, member int, pid long, hour int, lon double, lat double")
    spots = spark.createDataFrame([(0, k, 1.001, 25.0) for k in range(200)], "cluster_id int, sid long, lon double, lat double")
    assert forward.reaching(oil, spots, 2.0).count() == 150
    plan = buckets.radius_join(a, b, 8.0)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan

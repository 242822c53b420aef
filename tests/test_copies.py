"""Copies of shapes and places are looked at once; every row of them is told."""

import random

import numpy as np

from wakeline.functions import polygon
from wakeline.operators import matching, regions, similarity
from wakeline.plans import registry, shapes  # noqa: F401


def test_equal_regions_meet_once(spark, monkeypatch):
    looked = []
    real = regions.overlaps
    monkeypatch.setattr(regions, "overlaps", lambda pairs, *a: looked.append(pairs.count()) or real(pairs, *a))
    box = lambda x: [[{"x": x, "y": 0.0}, {"x": x + 2.0, "y": 0.0}, {"x": x + 2.0, "y": 2.0}, {"x": x, "y": 2.0}]]
    rows = [(k, box(1.0 * (k % 2))) for k in range(40)] + [(99, None), (98, [])]
    a = spark.createDataFrame(rows, "a long, rings array<array<struct<x:double,y:double>>>")
    got = {(r.a, r.b): round(r.inter_area, 9) for r in regions.overlapping(a, a.withColumnRenamed("a", "b"), "a", "b").collect()}
    assert got == {(i, j): 4.0 if i % 2 == j % 2 else 2.0 for i in range(40) for j in range(40)}
    assert looked == [4]


def test_equal_boxes_meet_once(spark, monkeypatch, tmp_path):
    """Suppliers 10500 keys apart own equal boxes."""
    looked = []
    real = polygon.overlaps
    monkeypatch.setattr(polygon, "overlaps", lambda pairs, *a: looked.append(pairs.count()) or real(pairs, *a))
    spark.range(20).selectExpr("7 + id * 10500 AS s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    got = {(r.a, r.b) for r in registry.QUERIES["polygon_overlap"](spark, str(tmp_path)).collect()}
    ids = [7 + k * 10500 for k in range(20)]
    assert got == {(i, j) for i in ids for j in ids if i < j} and looked == [1]


def test_distances_are_those_of_places(spark, monkeypatch):
    looked = []
    real = matching.radius_join
    monkeypatch.setattr(matching, "radius_join", lambda a, b, *k: looked.append((a.count(), b.count())) or real(a, b, *k))
    events = spark.createDataFrame([(k, -93.0 + 0.1 * (k % 2), 25.0) for k in range(10)] + [(77, None, 1.0)], "cluster_id long, lon double, lat double")
    found = spark.createDataFrame([(k, -93.0, 25.0 + 0.1 * (k % 3)) for k in range(30)], "det_id long, lon double, lat double")
    got = {(r.cluster_id, r.det_id, r.near) for r in matching.distance_table(events, found).collect()}
    assert got == {(c, d, c % 2 == 0 and d % 3 == 0) for c in range(10) for d in range(30)}
    assert looked == [(3, 3)]


def test_energy_of_copies(spark, monkeypatch):
    pick = random.Random(1)
    spots = [(pick.random(), pick.random()) for _ in range(12)]
    sides = [[pick.choice(spots) for _ in range(n)] for n in (300, 200)]
    rows = []
    real = similarity.cut
    monkeypatch.setattr(similarity, "cut", lambda df, name: rows.append((name, (t := real(df, name)).count())) or t)
    a, b = (spark.createDataFrame([("g", *p) for p in s], "g string, x double, y double") for s in sides)
    got = similarity.energy_distance(a, b, "g", 4).first().energy
    mean = lambda p, q: np.hypot(*(np.array(p)[:, None] - np.array(q)[None]).transpose(2, 0, 1)).mean()
    assert np.isclose(got, 2 * mean(*sides) - mean(sides[0], sides[0]) - mean(sides[1], sides[1]))
    assert dict(rows)["clouds"] <= 24

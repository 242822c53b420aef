"""Regions of any shape against plain even-odd tests and against sums over a fine grid; hulls against all points."""

import math
import random

import pytest
from pyspark.sql import functions as F

from wakeline.functions import polygon
from wakeline.operators import regions

KIND = "array<array<struct<x:double,y:double>>>"


def star(pick, x, y, size, corners, least=0.2):
    """A ring around a point that is seldom convex."""
    out = []
    for k in range(corners):
        r, t = size * pick.uniform(least, 1), 2 * math.pi * k / corners
        out.append((x + r * math.cos(t), y + r * math.sin(t)))
    return out[:: pick.choice((1, -1))]


def made(seed, n=12):
    pick = random.Random(seed)
    out = []
    for k in range(n):
        x, y, size = pick.uniform(-3, 3), pick.uniform(-3, 3), pick.uniform(0.05, 2)
        rings = [star(pick, x, y, size, pick.randint(3, 12), 0.5)]
        if k % 2:
            rings.append(star(pick, x, y, size * 0.2, 5))
        out.append(rings)
    return out


def rows(found):
    return [(k, [[{"x": x, "y": y} for x, y in r] for r in rings]) for k, rings in enumerate(found)]


def inside(rings, x, y):
    odd = False
    for ring in rings:
        for (px, py), (qx, qy) in zip(ring, ring[1:] + ring[:1], strict=True):
            if (py > y) != (qy > y) and (x - px) * abs(qy - py) < (qx - px) * (y - py) * math.copysign(1, qy - py):
                odd = not odd
    return odd


@pytest.mark.parametrize("depth", [0, 2, 5])
def test_points(spark, depth):
    found, pick = made(1), random.Random(2)
    points = [(n, pick.uniform(-5, 5), pick.uniform(-5, 5)) for n in range(600)] + [(900, None, 1.0), (901, 1.0, None)]
    odd = [(50, None), (51, []), (52, [[]]), (53, [[{"x": None, "y": 1.0}]]), (54, [[{"x": 0.3, "y": 0.3}]])]
    df = spark.createDataFrame(rows(found) + odd, f"id long, rings {KIND}").withColumn("level", F.lit(1))
    got = regions.points_in_regions(spark.createDataFrame(points, "p long, x double, y double"), df, "p", "id", depth).collect()
    want = {(n, k) for n, x, y in points if None not in (x, y) for k, rings in enumerate(found) if inside(rings, x, y)}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_cover_has_cells_wholly_inside():
    for rings in made(3):
        cells = regions.cover_cells(rings)
        assert len(set(cells)) == len(cells)
        for level, i, j, full in cells:
            size = 2.0**-level
            spots = [((i + a) * size, (j + b) * size) for a in (0.01, 0.5, 0.99) for b in (0.01, 0.5, 0.99)]
            assert not full or all(inside(rings, *p) for p in spots)
    assert any(full for rings in made(3) for *_, full in regions.cover_cells(rings))


def test_overlaps(spark):
    a, b = made(4, 10), made(5, 10)
    one, two = (spark.createDataFrame(rows(x), f"{n} long, rings {KIND}") for x, n in ((a, "a"), (b, "b")))
    got = {(r.a, r.b): r for r in regions.overlapping(one, two, "a", "b").collect()}
    step = 0.02
    for i, p in enumerate(a):
        for j, q in enumerate(b):
            xs, ys = ([c[k] for c in p[0]] for k in (0, 1))
            spots = [(min(xs) + (m + 0.5) * step, min(ys) + (n + 0.5) * step) for m in range(int((max(xs) - min(xs)) / step) + 1) for n in range(int((max(ys) - min(ys)) / step) + 1)]
            counts = [(inside(p, *s), inside(q, *s)) for s in spots]
            both, own = sum(c == (True, True) for c in counts) * step**2, sum(c[0] for c in counts) * step**2
            shared = got[i, j].inter_area if (i, j) in got else 0.0
            assert abs(shared - both) < 0.05 + 0.02 * own
    same = regions.overlapping(one, one.withColumnRenamed("a", "b"), "a", "b").filter("a = b").collect()
    assert len(same) == 10 and all(abs(r.iou - 1) < 1e-9 for r in same)


def test_part_of_a_convex_window_is_the_clip():
    pick = random.Random(6)
    for _ in range(40):
        ring, window = star(pick, 0, 0, 1, 9), [(-0.5, -0.4), (0.6, -0.5), (0.5, 0.5), (-0.3, 0.4)]
        part = polygon.clip(ring, window)
        assert abs(regions.shared_area([ring], [window]) - (polygon._area(part) if part else 0)) < 1e-9


@pytest.mark.parametrize("held", [100_000, 7])
def test_hulls(spark, held):
    pick = random.Random(7)
    groups = {"one": [(1.0, 2.0)] * 3, "two": [(0.0, 0.0), (1.0, 1.0)], "line": [(float(k), 2.0 * k) for k in range(9)], "big": [(pick.gauss(0, 1), pick.gauss(0, 1)) for _ in range(500)], None: [(0.0, 0.0), (0.0, 1.0), (1.0, 0.0), (0.2, 0.2)]}
    data = [(g, x, y) for g, ps in groups.items() for x, y in ps] + [("one", None, 1.0)]
    pick.shuffle(data)
    got = {r.g: [(p.x, p.y) for p in r.ring] for r in regions.convex_hulls(spark.createDataFrame(data, "g string, x double, y double").repartition(5), "g", held).collect()}
    assert got.keys() == groups.keys()
    for g, ps in groups.items():
        ring = got[g]
        assert set(ring) <= set(ps)
        if len(ring) > 2:
            for p, q in zip(ring, ring[1:] + ring[:1], strict=True):
                assert all((q[0] - p[0]) * (y - p[1]) - (q[1] - p[1]) * (x - p[0]) >= -1e-12 for x, y in ps)
    assert (got["one"], sorted(got["two"]), sorted(got["line"])) == ([(1.0, 2.0)], [(0.0, 0.0), (1.0, 1.0)], [(0.0, 0.0), (8.0, 16.0)])


def test_nothing(spark):
    none = spark.createDataFrame([], f"a long, rings {KIND}")
    assert regions.overlapping(none, none.withColumnRenamed("a", "b"), "a", "b").collect() == []
    assert regions.points_in_regions(spark.createDataFrame([(1, 0.0, 0.0)], "p long, x double, y double"), none, "p", "a").collect() == []
    assert regions.convex_hulls(spark.createDataFrame([], "g long, x double, y double"), "g").collect() == []


def test_covers_and_rings_are_not_broadcast(spark):
    from pyspark.sql import functions as F

    from wakeline.operators import regions

    corner = lambda a, b: F.struct((F.col("id") + a).alias("x"), F.lit(float(b)).alias("y"))
    boxes = spark.range(4).select("id", F.array(F.array(*(corner(a, b) for a, b in ((0.1, 0.1), (0.9, 0.1), (0.9, 0.9), (0.1, 0.9))))).alias("rings"))
    points = spark.range(40).select(F.col("id").alias("p"), (F.col("id") / 10 + 0.05).alias("x"), F.lit(0.5).alias("y"))
    found = regions.points_in_regions(points, boxes, "p", "id")
    assert sorted((r.p, r.id) for r in found.collect()) == [(p, p // 10) for p in range(40) if 0.1 < (p % 10) / 10 + 0.05 < 0.9]
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_equal_places_and_shapes_meet_once(spark, monkeypatch):
    """Before, every point was tested against every region whose border is near it."""
    ring = [(0.0, 0.0), (3.0, 0.5), (1.0, 2.0)]
    shape = [[{"x": x, "y": y} for x, y in ring]]
    areas = spark.createDataFrame([(k, shape) for k in range(30)] + [(90, None)], "id long, rings array<array<struct<x:double,y:double>>>")
    points = spark.createDataFrame([(k, *((1.0, 1.0), (0.1, 1.9), (2.7, 0.5), (None, 1.0))[k % 4]) for k in range(80)], "p long, x double, y double")
    held = []
    real = regions.cut
    monkeypatch.setattr(regions, "cut", lambda df, name: held.append((name, real(df, name))) or held[-1][1])
    monkeypatch.setattr(regions, "LIST", 7)
    got = [tuple(r) for r in regions.points_in_regions(points, areas, "p", "id").collect()]
    assert len(got) == len(set(got)) and set(got) == {(p, k) for p in range(80) if p % 4 in (0, 2) for k in range(30)}
    assert {name: df.count() for name, df in held if name in ("shapes", "places")} == {"shapes": 1, "places": 2}

"""Regions: polygons of any shape, with holes, joined by quadtree covers; convex hulls as mergeable aggregates.

A region is an array of rings, each an array of struct(x, y), open or closed: the first bounds it, the others are holes
in it. Its cover is a set of quadtree cells (level, ix, iy): cells wholly inside, and small ones that its border crosses.
A point looks its cell up at each level in use; two regions meet where a cell of one is, or lies in, a cell of the other.
So joins are on cells, large regions cost few of them, and only points in border cells are tested against rings.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from wakeline.functions import polygon
from wakeline.operators.buckets import dealt_join
from wakeline.sources.work import cut

#: Halvings below the level whose cells are as large as a region.
DEPTH = 5
#: Ids of equal regions that a list holds, about.
LIST = 1024
#: Points that a task holds of all groups before it reduces them to hulls.
HELD = 100_000

Point = tuple[float, float]


def _rings(value: list) -> list[list[Point]]:
    return [[(p["x"], p["y"]) for p in ring] for ring in value]


def _crosses(p: Point, q: Point, x0: float, y0: float, x1: float, y1: float) -> bool:
    """Whether a segment touches a closed box."""
    low, high = 0.0, 1.0
    for a, d, lo, hi in ((p[0], q[0] - p[0], x0, x1), (p[1], q[1] - p[1], y0, y1)):
        if d == 0:
            if a < lo or a > hi:
                return False
        else:
            s, t = (lo - a) / d, (hi - a) / d
            low, high = max(low, min(s, t)), min(high, max(s, t))
            if low > high:
                return False
    return True


def _inside(rings: list[list[Point]], x: float, y: float) -> bool:
    odd = False
    for ring in rings:
        for (px, py), (qx, qy) in zip(ring, ring[1:] + ring[:1], strict=True):
            if (py > y) != (qy > y) and x < px + (y - py) / (qy - py) * (qx - px):
                odd = not odd
    return odd


def cover_cells(rings: list[list[Point]], depth: int = DEPTH) -> list[tuple[int, int, int, bool]]:
    """(level, ix, iy, inside): a cell of level k is 2 ** -k wide."""
    edges = [e for ring in rings for e in zip(ring, ring[1:] + ring[:1], strict=True)]
    if not edges:
        return []
    xs, ys = ([p[k] for p, _ in edges] for k in (0, 1))
    wide = max(max(xs) - min(xs), max(ys) - min(ys))
    top = max(-60, min(60, -math.ceil(math.log2(wide)))) if wide > 0 else 60 - depth
    size, out = 2.0**-top, []
    columns, rows = (range(math.floor(min(v) / size), math.floor(max(v) / size) + 1) for v in (xs, ys))
    first = [(top, i, j, edges) for i in columns for j in rows]
    while first:
        level, i, j, near = first.pop()
        size = 2.0**-level
        box = (i * size, j * size, (i + 1) * size, (j + 1) * size)
        near = [(p, q) for p, q in near if _crosses(p, q, *box)]
        if not near:
            if _inside(rings, (i + 0.5) * size, (j + 0.5) * size):
                out.append((level, i, j, True))
        elif level - top == depth:
            out.append((level, i, j, False))
        else:
            first += [(level + 1, 2 * i + a, 2 * j + b, near) for a in (0, 1) for b in (0, 1)]
    return out


def cover(regions: DataFrame, key: str = "id", rings: str = "rings", depth: int = DEPTH) -> DataFrame:
    """(key, level, ix, iy, inside) of each region. A region that is null, without rings, or with a null in it has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, value in enumerate(batch.column(rings).to_pylist()):
                if not value or any(not r or any(p is None or p["x"] is None or p["y"] is None for p in r) for r in value):
                    continue
                cells = cover_cells(_rings(value), depth)
                columns = [pa.array(c, k) for c, k in zip(zip(*cells, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.bool_()), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array([n] * len(cells))), *columns], [key, "level", "ix", "iy", "inside"])

    kind = regions.schema[key].dataType.simpleString()
    return regions.select(key, rings).mapInArrow(run, f"{key} {kind}, level int, ix long, iy long, inside boolean")


def contains(rings: Column, x: Column, y: Column) -> Column:
    """Whether a point is inside the first ring and in no hole: an odd number of borders lies to its right."""
    return F.aggregate(rings, F.lit(False), lambda odd, ring: odd != polygon.contains(ring, x, y))


def points_in_regions(points: DataFrame, regions: DataFrame, point: str, region: str, depth: int = DEPTH) -> DataFrame:
    """(point, region) for each point (x, y) in a region (rings). A point on a border may be told either way."""
    # Places and shapes that are equal meet once; ids of both follow.
    shapes, own = distinct_shapes(regions, region, "rings", "_shape")
    # Few bytes, but much work: shapes are dealt to as many tasks as the session shuffles to.
    dealt = shapes.repartition(int(shapes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_shape")
    cells = cut(cover(dealt, "_shape", depth=depth), "cover")
    levels = [r.level for r in cells.select("level").distinct().collect()]  # at most 121 of them
    if not levels:
        return points.select(point).join(regions.select(region).limit(0), F.lit(True))
    held = points.filter("x IS NOT NULL AND y IS NOT NULL").select(point, "x", "y")
    asked = held.select("x", "y").distinct().withColumn("level", F.explode(F.array(*map(F.lit, levels))))
    at = lambda c: F.floor(F.col(c) * F.pow(F.lit(2.0), F.col("level"))).alias(f"i{c}")
    met = asked.select("x", "y", "level", at("x"), at("y")).join(cells.hint("merge"), ["level", "ix", "iy"])
    # Covers and rings are larger than their files say: they are merged, never broadcast.
    border = met.filter("NOT inside").select("x", "y", "_shape").join(shapes.hint("merge"), "_shape")
    tested = border.filter(contains(F.col("rings"), F.col("x"), F.col("y"))).select("x", "y", "_shape")
    found = cut(met.filter("inside").select("x", "y", "_shape").unionByName(tested), "places")
    # A shape's ids are lists of bounded length until its places have met their points.
    many = F.ceil(F.count("*").over(Window.partitionBy("_shape")) / LIST)
    lists = own.withColumn("_k", F.pmod(F.xxhash64(region), many)).groupBy("_shape", "_k")
    ids = found.join(lists.agg(F.collect_list(region).alias("_ids")).drop("_k").hint("merge"), "_shape").select("x", "y", "_ids")
    return dealt_join(ids, held, ["x", "y"]).select(point, F.explode("_ids").alias(region))


def meeting(a: DataFrame, b: DataFrame, left: str, right: str) -> DataFrame:
    """(left, right): regions of two covers of which a cell of one is, or lies in, a cell of the other."""
    top = a.select("level").unionByName(b.select("level")).agg(F.min("level")).first()[0]
    if top is None:
        return a.select(left).join(b.select(right).limit(0), F.lit(True))

    def above(cells: DataFrame, own: bool) -> DataFrame:
        steps = F.sequence(F.lit(0), F.col("level") - top) if own else F.filter(F.sequence(F.lit(0), F.col("level") - top), lambda s: s > 0)
        up = cells.withColumn("s", F.explode(steps)).withColumn("d", F.pow(F.lit(2.0), F.col("s")))
        place = [F.floor(F.col(c) / F.col("d")).alias(c) for c in ("ix", "iy")]
        return up.select(*(c for c in (left, right) if c in cells.columns), (F.col("level") - F.col("s")).alias("level"), *place)

    plain, keys = lambda c: c.drop("inside"), ["level", "ix", "iy"]
    one = above(plain(a), True).join(plain(b), keys).select(left, right)
    two = plain(a).join(above(plain(b), False), keys).select(left, right)
    return one.unionByName(two).distinct()


def _triangles(rings: list[list[Point]], o: Point) -> list[tuple[float, list[Point]]]:
    """Signed triangles from a point to each edge, whose sum is the region: the outer ring turns left, holes right."""
    out = []
    for k, ring in enumerate(rings):
        turn = sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:] + ring[:1], strict=True))
        sign = 1.0 if (turn > 0) == (k == 0) else -1.0
        for p, q in zip(ring, ring[1:] + ring[:1], strict=True):
            cross = (p[0] - o[0]) * (q[1] - o[1]) - (q[0] - o[0]) * (p[1] - o[1])
            if cross:
                out.append((math.copysign(sign, sign * cross), [o, p, q]))
    return out


def shared_area(a: list[list[Point]], b: list[list[Point]]) -> float:
    """The area of the part that two regions share: triangles of one against triangles of the other, by sign."""
    o = a[0][0]
    boxed = [[(s, t, min(x for x, _ in t), max(x for x, _ in t), min(y for _, y in t), max(y for _, y in t)) for s, t in _triangles(r, o)] for r in (a, b)]
    total = 0.0
    for s, t, x0, x1, y0, y1 in boxed[0]:
        for r, u, u0, u1, v0, v1 in boxed[1]:
            if u0 < x1 and x0 < u1 and v0 < y1 and y0 < v1:
                part = polygon.clip(t, u)
                if len(part) > 2:
                    total += s * r * polygon._area(part)
    return max(0.0, total)


def region_area(rings: Column) -> Column:
    """The first ring's area without those of the holes."""
    return 2 * polygon.area(rings[0]) - F.aggregate(rings, F.lit(0.0), lambda s, r: s + polygon.area(r))


def overlaps(pairs: DataFrame, a: str = "rings_a", b: str = "rings_b") -> DataFrame:
    """``pairs`` of regions with inter_area, what they share, and iou, its part of what either holds."""
    schema = StructType([*pairs.schema.fields]).add("inter_area", DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            areas = [shared_area(_rings(p), _rings(q)) for p, q in zip(batch.column(a).to_pylist(), batch.column(b).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(areas, pa.float64())], schema.names)

    either = region_area(F.col(a)) + region_area(F.col(b)) - F.col("inter_area")
    return pairs.mapInArrow(run, schema).withColumn("iou", F.when(either > 0, F.col("inter_area") / either).otherwise(0.0))


def distinct_shapes(df: DataFrame, key: str, shape: str, name: str) -> tuple[DataFrame, DataFrame]:
    """(name, shape) of each different shape, named by the least key that has it, and (name, key) of all rows with one."""
    given = df.select(key, shape).filter(F.col(key).isNotNull() & F.col(shape).isNotNull())
    held = cut(given.groupBy(shape).agg(F.min(key).alias(name)), "shapes")
    return held, cut(given.join(held.hint("merge"), shape).select(name, key), "members")


def overlapping(a: DataFrame, b: DataFrame, left: str, right: str) -> DataFrame:
    """(left, right, inter_area, iou) of the regions (rings) of two tables that share an area. Regions of equal rings meet
    others once; their ids follow."""
    (one, own), (two, other) = (distinct_shapes(df, key, "rings", name) for df, key, name in ((a, left, "_p"), (b, right, "_q")))
    pairs = meeting(*(cut(cover(df, key), "cover") for df, key in ((one, "_p"), (two, "_q"))), "_p", "_q")
    pairs = pairs.join(one.withColumnRenamed("rings", "rings_a"), "_p").join(two.withColumnRenamed("rings", "rings_b"), "_q")
    found = cut(overlaps(pairs).filter("inter_area > 0").select("_p", "_q", "inter_area", "iou"), "overlaps")
    return found.join(own.hint("merge"), "_p").join(other.hint("merge"), "_q").select(left, right, "inter_area", "iou")


def equal_area(rings: Column) -> Column:
    """Rings in degrees (x east, y north) on the plane in which areas are those of the WGS84 ellipsoid, in square metres."""
    return F.transform(rings, polygon.equal_area_ring)


def convex_hulls(points: DataFrame, key: str, held: int = HELD) -> DataFrame:
    """(key, ring): the convex hull of each group's points (x, y), counter-clockwise; one or two points are their own hull.

    Tasks reduce what they hold to hulls before they hand it on, and hulls of hulls are the groups' hulls, so that a group
    of any size meets as a few points a task. Points with a null are left out.
    """
    kind = points.schema[key].dataType.simpleString()
    rows = points.select(key, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).filter("x IS NOT NULL AND y IS NOT NULL")

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict = {}
        n, most, id_type = 0, held, None

        def out() -> pa.RecordBatch:
            flat = [(g, *p) for g, ps in groups.items() for p in polygon.hull(ps)]
            groups.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in flat], t) for k, t in enumerate((id_type, pa.float64(), pa.float64()))], [key, "x", "y"])

        for batch in batches:
            id_type = batch.column(key).type
            for g, x, y in zip(*(batch.column(c).to_pylist() for c in (key, "x", "y")), strict=True):
                groups.setdefault(g, []).append((x, y))
                n += 1
                if n >= most:
                    for g, ps in groups.items():
                        groups[g] = polygon.hull(ps)
                    n = sum(map(len, groups.values()))
                    if n > most / 2:  # many groups, or many corners
                        yield out()
                        n = 0
        if groups:
            yield out()

    def merge(rows: pa.Table) -> pa.Table:
        ring = polygon.hull(list(zip(rows.column("x").to_pylist(), rows.column("y").to_pylist(), strict=True)))
        points_type = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
        return pa.table({key: rows.column(key).slice(0, 1), "ring": pa.array([[{"x": x, "y": y} for x, y in ring]], points_type)})

    return rows.mapInArrow(reduce, f"{key} {kind}, x double, y double").groupBy(key).applyInArrow(merge, f"{key} {kind}, ring array<struct<x:double,y:double>>")


def rectangle(x: Column, y: Column, length: Column, width: Column, bearing: Column) -> Column:
    """The ring of a rectangle about (x, y) whose long side runs along a bearing from north."""
    s, c = F.sin(F.radians(bearing)), F.cos(F.radians(bearing))
    corner = lambda a, b: F.struct((x + a * length / 2 * s + b * width / 2 * c).alias("x"), (y + a * length / 2 * c - b * width / 2 * s).alias("y"))
    return F.array(corner(1, 1), corner(1, -1), corner(-1, -1), corner(-1, 1))


def cluster_shapes(parts: DataFrame, membership: DataFrame, pairs: DataFrame) -> DataFrame:
    """(component, n, area, hull_area, fill, isolation): how much of its convex hull a cluster fills, and its least gap to
    a part outside, of the ``pairs`` (a, b, w) given (null: none is that near).

    ``parts`` has id and ring, ``membership`` id and component.
    """
    side = lambda c: membership.select(F.col("id").alias(c), F.col("component").alias(f"c{c}"))
    apart = pairs.join(side("a"), "a").join(side("b"), "b").filter("ca <> cb")
    least = apart.select(F.col("ca").alias("component"), "w").unionByName(apart.select(F.col("cb").alias("component"), "w")).groupBy("component").agg(F.min("w").alias("w"))
    return with_isolation(parts, membership, least)


def with_isolation(parts: DataFrame, membership: DataFrame, least: DataFrame) -> DataFrame:
    """``cluster_shapes`` from the least gap (component, w) of each cluster that has one."""
    j = parts.join(membership, "id")
    sums = j.groupBy("component").agg(F.count("*").alias("n"), F.sum(polygon.area(F.col("ring"))).alias("area"))
    corners = j.select("component", F.explode("ring").alias("p")).select("component", "p.x", "p.y")
    hull = convex_hulls(corners, "component").select("component", polygon.area(F.col("ring")).alias("hull_area"))
    out = sums.join(hull, "component").join(least.withColumnRenamed("w", "isolation"), "component", "left")
    return out.select("component", "n", "area", "hull_area", F.when(F.col("hull_area") > 0, F.col("area") / F.col("hull_area")).alias("fill"), "isolation")

"""Small geometry on arrays of struct(x, y): area, containment, clipping, shape."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

WGS84_A, WGS84_E = 6378137.0, 0.0818191908426215


def _edges(ring: Column) -> Column:
    """(p, q) for each edge of a ring, open or closed."""
    return F.zip_with(ring, F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1)), lambda p, q: F.struct(p.alias("p"), q.alias("q")))


def area(ring: Column) -> Column:
    """Planar area; corners are taken relative to the first, so that it does not matter where the ring lies."""
    x, y = ring[0]["x"], ring[0]["y"]
    cross = lambda s, e: s + (e["p"]["x"] - x) * (e["q"]["y"] - y) - (e["q"]["x"] - x) * (e["p"]["y"] - y)
    return F.abs(F.aggregate(_edges(ring), F.lit(0.0), cross)) / 2.0


def perimeter(ring: Column) -> Column:
    return F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + F.hypot(e["q"]["x"] - e["p"]["x"], e["q"]["y"] - e["p"]["y"]))


def polsby_popper(ring: Column) -> Column:
    """1 for a circle, towards 0 for ragged shapes."""
    return 4 * math.pi * area(ring) / F.pow(perimeter(ring), F.lit(2.0))


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Whether a point lies inside, by crossings of a ray to the right."""

    def crosses(e: Column) -> Column:
        p, q = e["p"], e["q"]
        at = p["x"] + (y - p["y"]) / (q["y"] - p["y"]) * (q["x"] - p["x"])
        return F.coalesce(((p["y"] > y) != (q["y"] > y)) & (x < at), F.lit(False))

    return F.size(F.filter(_edges(ring), crosses)) % 2 == 1


def geodesic_area_m2(ring: Column) -> Column:
    """Area on the WGS84 ellipsoid of a ring in degrees (x east, y north): the ring in equal-area coordinates (longitude,
    authalic sine of latitude), whose planar area is exact but for edges not being geodesics."""

    return area(equal_area_ring(ring))


def equal_area_ring(ring: Column) -> Column:
    """A ring in degrees in equal-area coordinates, in metres."""

    def north(lat: Column) -> Column:
        s = F.sin(F.radians(lat))
        es = WGS84_E * s
        return WGS84_A * (1 - WGS84_E**2) / 2 * (s / (1 - es * es) + F.log((1 + es) / (1 - es)) / (2 * WGS84_E))

    return F.transform(ring, lambda p: F.struct((F.radians(p["x"]) * WGS84_A).alias("x"), north(p["y"]).alias("y")))


def clip(subject: list[tuple[float, float]], window: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """The part of a polygon inside a convex one, edge by edge."""
    turn = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(window, window[1:] + window[:1], strict=True))
    window = window if turn > 0 else window[::-1]
    out = subject
    for (ax, ay), (bx, by) in zip(window, window[1:] + window[:1], strict=True):
        side = [(bx - ax) * (y - ay) - (by - ay) * (x - ax) for x, y in out]
        new = []
        for i, ((px, py), s) in enumerate(zip(out, side, strict=True)):
            (qx, qy), t = out[i - 1], side[i - 1]
            if (s >= 0) != (t >= 0):
                k = t / (t - s)
                new.append((qx + k * (px - qx), qy + k * (py - qy)))
            if s >= 0:
                new.append((px, py))
        out = new
    return out


def _area(ring: list[tuple[float, float]]) -> float:
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True))) / 2


def overlaps(pairs: DataFrame, a: str = "ring_a", b: str = "ring_b") -> DataFrame:
    """``pairs`` with inter_area and iou of two rings, the second one convex. Which pairs to look at is for a box join to say."""
    out_schema = StructType([*pairs.schema.fields]).add("inter_area", DoubleType()).add("iou", DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            inter, iou = [], []
            for p, q in zip(batch.column(a).to_pylist(), batch.column(b).to_pylist(), strict=True):
                p, q = ([(v["x"], v["y"]) for v in r] for r in (p, q))
                inter.append(_area(clip(p, q)))
                whole = _area(p) + _area(q) - inter[-1]
                iou.append(inter[-1] / whole if whole else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(inter, pa.float64()), pa.array(iou, pa.float64())], out_schema.names)

    return pairs.mapInArrow(run, out_schema)


def hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """The corners of the convex hull, counter-clockwise; fewer than three points, or points on a line, keep their ends."""
    points = sorted(set(points))
    if len(points) < 2:
        return points
    out: list[tuple[float, float]] = []
    for side in (points, points[::-1]):
        part: list[tuple[float, float]] = []
        for p in side:
            while len(part) > 1 and (part[-1][0] - part[-2][0]) * (p[1] - part[-2][1]) <= (part[-1][1] - part[-2][1]) * (p[0] - part[-2][0]):
                part.pop()
            part.append(p)
        out += part[:-1]
    return out


def smallest_rectangle(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float, tuple[float, float], tuple[float, float]]:
    """Length, width, bearing of the long axis (0 to 180 from north) and its two ends, of the smallest rotated rectangle."""
    h = np.array(hull(list(zip(x.tolist(), y.tolist(), strict=True))))
    best = None
    for i in range(len(h)):
        d = h[(i + 1) % len(h)] - h[i]
        if not d.any():
            continue
        u = d / np.hypot(*d)
        v = np.array([-u[1], u[0]])
        s, t = h @ u, h @ v
        size = (np.ptp(s), np.ptp(t))
        if best is None or size[0] * size[1] < best[0] - 1e-9:
            best = (size[0] * size[1], size, u, v, (s.min() + s.max()) / 2, (t.min() + t.max()) / 2)
    if best is None:
        return 0.0, 0.0, 0.0, tuple(h[0]), tuple(h[0])
    _, size, u, v, s, t = best
    axis, length, width = (u, *size) if size[0] >= size[1] else (v, *size[::-1])
    middle = s * u + t * v
    ends = middle - axis * length / 2, middle + axis * length / 2
    return float(length), float(width), math.degrees(math.atan2(axis[0], axis[1])) % 180, tuple(map(float, ends[0])), tuple(map(float, ends[1]))


def rectangles(shapes: DataFrame, key: str = "id", ring: str = "ring") -> DataFrame:
    """(key, length, width, bearing, end1_x, end1_y, end2_x, end2_y) of each ring's smallest rotated rectangle."""
    names = ["length", "width", "bearing", "end1_x", "end1_y", "end2_x", "end2_y"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.column(ring).to_pylist():
                length, width, bearing, a, b = smallest_rectangle(np.array([p["x"] for p in r]), np.array([p["y"] for p in r]))
                rows.append((length, width, bearing, *a, *b))
            yield pa.RecordBatch.from_arrays([batch.column(key), *(pa.array([r[k] for r in rows], pa.float64()) for k in range(7))], [key, *names])

    kind = shapes.schema[key].dataType.simpleString()
    return shapes.select(key, ring).mapInArrow(run, f"{key} {kind}, " + ", ".join(f"{n} double" for n in names))

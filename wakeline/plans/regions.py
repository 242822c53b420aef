"""Queries of regions of any shape and of clusters' hulls.

Each supplier owns an L with a square hole: a box without its upper right quarter and without a box near its lower left
corner. SQL adds and subtracts boxes. What the operators see is turned about a point, so that no edge is straight; a turn
changes no area and no containment.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from wakeline.operators import events, forest, regions
from wakeline.plans.registry import query
from wakeline.plans.shapes import AUTHALIC
from wakeline.plans.slicks import LINK_M, PAIR_SQL, components, sql_of
from wakeline.sources import testdata as td

SHAPE = {"id": "s_suppkey", "x": "((s_suppkey * 31) % 500) * 1e-2 - 93e0 + 37e-5", "y": "((s_suppkey * 17) % 300) * 1e-2 + 25e0 + 41e-5", "w": "(s_suppkey % 7 + 1) * 8e-2", "h": "(s_suppkey % 5 + 1) * 6e-2"}
#: Boxes of a shape as parts of its width and height, and how they count.
PARTS = ((0, 0, 1, 1, 1), (0.5, 0.5, 1, 1, -1), (0.125, 0.125, 0.25, 0.25, -1))
BOX_SQL = f"""{sql_of('sh', 'supplier', SHAPE)}, bx AS (SELECT id, x + a * w AS x0, y + b * h AS y0, x + c * w AS x1, y + d * h AS y1, s
  FROM sh, (VALUES {', '.join(f'({a}e0, {b}e0, {c}e0, {d}e0, {s})' for a, b, c, d, s in PARTS)}) p(a, b, c, d, s))"""
CENTRE, TURN = (-90.5, 26.5), 0.5


def turned(x: Column, y: Column) -> tuple[Column, Column]:
    (cx, cy), s, c = CENTRE, math.sin(TURN), math.cos(TURN)
    return cx + (x - cx) * c - (y - cy) * s, cy + (x - cx) * s + (y - cy) * c


def shapes(spark, d, turn: bool = True):
    def ring(*corners: tuple[float, float]) -> Column:
        at = [(F.col("x") + a * F.col("w"), F.col("y") + b * F.col("h")) for a, b in corners]
        return F.array(*(F.struct(x.alias("x"), y.alias("y")) for x, y in (turned(*p) if turn else p for p in at)))

    # One ring is open, the other closed; they turn the same way round.
    outer = ring((0, 0), (1, 0), (1, 0.5), (0.5, 0.5), (0.5, 1), (0, 1))
    hole = ring((0.125, 0.125), (0.25, 0.125), (0.25, 0.25), (0.125, 0.25), (0.125, 0.125))
    return td.derived(spark, d, "supplier", SHAPE).select("id", F.array(outer, hole).alias("rings"))


@query("region_metrics", f"WITH {BOX_SQL} SELECT id, sum(s * (x1 - x0) * (y1 - y0)) AS area FROM bx GROUP BY id", "area")
def _(spark, d):
    return shapes(spark, d).select("id", regions.region_area(F.col("rings")).alias("area"))


@query("region_points", f"WITH {BOX_SQL}, {sql_of('det', 'customer', td.DETECTION)} SELECT det_id, id FROM det JOIN bx ON lon > x0 AND lon < x1 AND lat > y0 AND lat < y1 GROUP BY det_id, id HAVING sum(s) > 0")
def _(spark, d):
    x, y = turned(F.col("lon"), F.col("lat"))
    points = td.derived(spark, d, "customer", td.DETECTION).select("det_id", x.alias("x"), y.alias("y"))
    return regions.points_in_regions(points, shapes(spark, d), "det_id", "id")


SHARED = "sum(a.s * b.s * greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)))"


@query("region_overlap", f"""WITH {BOX_SQL}, own AS (SELECT id, sum(s * (x1 - x0) * (y1 - y0)) AS area FROM bx GROUP BY id),
p AS (SELECT a.id AS a, b.id AS b, {SHARED} AS inter_area FROM bx a JOIN bx b ON a.id < b.id GROUP BY a.id, b.id)
SELECT a, b, inter_area, inter_area / (x.area + y.area - inter_area) AS iou FROM p JOIN own x ON x.id = a JOIN own y ON y.id = b WHERE inter_area > 1e-7""", "inter_area iou")
def _(spark, d):
    s = shapes(spark, d)
    found = regions.overlapping(s.withColumnRenamed("id", "a"), s.withColumnRenamed("id", "b"), "a", "b")
    return found.filter("a < b AND inter_area > 1e-7")


# After all is decided: which shapes the reference overlaps, in square kilometres on the ellipsoid. The reference is the
# largest shape, six times as wide and high.
REFERENCE = "arg_min(struct_pack(id := id, x := x, y := y, w := w, h := h), (-round(w * h, 9), id))"


@query("reference_overlap", f"""WITH {BOX_SQL}, big AS (SELECT unnest({REFERENCE}) FROM sh), rf AS (SELECT x + a * 6 * w AS x0, y + b * 6 * h AS y0, x + c * 6 * w AS x1, y + d * 6 * h AS y1, s
  FROM big, (VALUES {', '.join(f'({a}e0, {b}e0, {c}e0, {d}e0, {s})' for a, b, c, d, s in PARTS)}) p(a, b, c, d, s)),
flat AS (SELECT id, s, radians(x0) * 6378137e0 AS x0, radians(x1) * 6378137e0 AS x1, {AUTHALIC('y0')} AS y0, {AUTHALIC('y1')} AS y1 FROM bx),
rflat AS (SELECT s, radians(x0) * 6378137e0 AS x0, radians(x1) * 6378137e0 AS x1, {AUTHALIC('y0')} AS y0, {AUTHALIC('y1')} AS y1 FROM rf),
own AS (SELECT id, sum(s * (x1 - x0) * (y1 - y0)) AS area FROM flat GROUP BY id), whole AS (SELECT sum(s * (x1 - x0) * (y1 - y0)) AS area FROM rflat),
p AS (SELECT a.id, {SHARED} AS inter FROM flat a, rflat b GROUP BY a.id)
SELECT id, inter / 1e6 AS overlap_km2, inter / (own.area + whole.area - inter) AS iou FROM p JOIN own USING (id), whole WHERE inter > 1""", "overlap_km2 iou", digits=4)
def _(spark, d):
    s = shapes(spark, d, turn=False)
    size = td.derived(spark, d, "supplier", SHAPE)
    big = size.agg(F.min_by(F.struct("id", "x", "y"), F.struct(-F.round(F.col("w") * F.col("h"), 9), "id")).alias("o")).select("o.*")
    grown = lambda c: lambda p: F.struct((F.col("x") + 6 * (p["x"] - F.col("x"))).alias("x"), (F.col("y") + 6 * (p["y"] - F.col("y"))).alias("y"))  # noqa: E731, ARG005
    reference = s.join(big, "id").select(F.lit("reference").alias("ref"), F.transform("rings", lambda r: F.transform(r, grown(r))).alias("rings"))
    flat = lambda df: df.withColumn("rings", regions.equal_area(F.col("rings")))
    found = regions.overlapping(flat(s), flat(reference), "id", "ref").filter("inter_area > 1")
    return found.select("id", (F.col("inter_area") / 1e6).alias("overlap_km2"), "iou")


NEAR_M = 4500.0
#: Parts are rectangles four times as long as wide, in kilometres.
CORNERS = ", ".join(f"({a}, {b})" for a, b in ((1, 1), (1, -1), (-1, -1), (-1, 1)))
HULL_SQL = f"""{PAIR_SQL}, ed AS (SELECT a, b, gap FROM pr UNION ALL SELECT b, a, gap FROM pr),
reach(id, c) AS (SELECT id, id FROM parts UNION SELECT ed.b, reach.c FROM reach JOIN ed ON reach.id = ed.a AND ed.gap <= {NEAR_M}), comp AS (SELECT id, min(c) AS component FROM reach GROUP BY id),
corner AS (SELECT component, id * 4 + row_number() OVER (PARTITION BY id ORDER BY u, v) AS n, x_m / 1e3 + u * l * sin(t) + v * l / 4 * cos(t) AS x, y_m / 1e3 + u * l * cos(t) - v * l / 4 * sin(t) AS y
  FROM (SELECT id, x_m, y_m, sqrt(area_m2) / 1e3 AS l, radians(bearing) AS t FROM parts) JOIN comp USING (id), (VALUES {CORNERS}) c(u, v)),
side AS (SELECT component, px, py, qx, qy FROM (
  SELECT p.component, p.x AS px, p.y AS py, q.x AS qx, q.y AS qy, min((q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x)) AS least
  FROM corner p JOIN corner q ON q.component = p.component AND q.n <> p.n JOIN corner r ON r.component = p.component AND r.n <> p.n AND r.n <> q.n GROUP BY ALL) WHERE least > 0),
hulls AS (SELECT component, abs(sum((px - x0) * (qy - y0) - (qx - x0) * (py - y0))) / 2 AS hull_area FROM side JOIN (SELECT component, min(x) AS x0, min(y) AS y0 FROM corner GROUP BY component) USING (component) GROUP BY component),
sums AS (SELECT component, count(*) AS n, sum(area_m2) / 1e6 AS area FROM parts JOIN comp USING (id) GROUP BY component),
apart AS (SELECT x.component, min(gap) AS isolation FROM ed JOIN comp x ON x.id = ed.a JOIN comp y ON y.id = ed.b WHERE x.component <> y.component GROUP BY x.component)"""


@query("cluster_hulls", f"WITH RECURSIVE {HULL_SQL} SELECT component, n, area, hull_area, area / hull_area AS fill, isolation FROM sums JOIN hulls USING (component) LEFT JOIN apart USING (component)", "area hull_area fill isolation", digits=7)
def _(spark, d):
    parts = components(spark, d)
    long = F.sqrt("area_m2") / 1e3
    ring = regions.rectangle(F.col("x_m") / 1e3, F.col("y_m") / 1e3, 2 * long, long / 2, F.col("bearing"))
    membership = events.link(parts, NEAR_M)
    return regions.with_isolation(parts.select("id", ring.alias("ring")), membership, forest.least_apart(parts, membership, LINK_M))

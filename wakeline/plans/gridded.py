"""Queries of gridded fields: written from the events, scanned with filters, sampled at points and times."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wakeline.functions import geo
from wakeline.plans.registry import query
from wakeline.sources import grid
from wakeline.sources import testdata as td
from wakeline.sources.work import work_dir

DAY = 24 * td.HOUR
START = td.EPOCH_H * td.HOUR
AXES = (
    grid.Axis("time", START, DAY, 40, 4), grid.Axis("depth", 0, 10, 2, 1), grid.Axis("latitude", 25.375, 0.75, 4, 2), grid.Axis("longitude", -92.375, 1.25, 4, 2),
)
PLACE = {"i_time": f"cast(floor((us - {START}) / {DAY}e0) as bigint)", "i_latitude": "cast(floor((user_id % 30) / 75e-1) as bigint)", "i_longitude": "cast(floor((user_id % 50) / 125e-1) as bigint)"}
VALUES = {"u": "value * ((event_id % 3) - 1e0)", "v": "value * ((event_id % 5) - 2e0)"}
CELL_SQL = f"""placed AS (SELECT {td.columns(PLACE)}, {td.columns(VALUES)}, event_type = 'purchase' AS deep FROM (SELECT *, {td.US['duckdb']} AS us FROM events)),
cells AS (SELECT i_time, 0 AS i_depth, i_latitude, i_longitude, avg(u) AS u, avg(v) AS v FROM placed GROUP BY ALL
  UNION ALL SELECT i_time, 1, i_latitude, i_longitude, avg(u), avg(v) FROM placed WHERE deep GROUP BY ALL),
field AS (SELECT {START} + i_time * {DAY} AS time, i_depth * 10 AS depth, 25.375e0 + i_latitude * 75e-2 AS latitude, -92.375e0 + i_longitude * 125e-2 AS longitude, u, v FROM cells WHERE i_time BETWEEN 0 AND 39)"""


def written(spark, d) -> str:
    e = td.table(spark, d, "events").withColumn("us", F.expr(td.US["spark"]))
    placed = e.selectExpr(*(f"{x} AS {c}" for c, x in (PLACE | VALUES).items()), "event_type = 'purchase' AS deep")
    by = ["i_time", "i_depth", "i_latitude", "i_longitude"]
    top, deep = placed.withColumn("i_depth", F.lit(0)), placed.filter("deep").withColumn("i_depth", F.lit(1))
    path = f"{work_dir(spark)}/wakeline/field-{uuid.uuid4().hex}"
    grid.write_grid(top.unionByName(deep).groupBy(*by).agg(F.avg("u").alias("u"), F.avg("v").alias("v")), path, AXES, ("u", "v"))
    return path


@query("grid_scan", f"WITH {CELL_SQL} SELECT * FROM field WHERE depth = 0 AND time >= {START + 5 * DAY} AND time < {START + 12 * DAY} AND latitude > 26", "latitude longitude u v")
def _(spark, d):
    field = grid.read_grid(spark, written(spark, d))
    box = field.filter((F.col("depth") == 0) & (F.col("time") >= START + 5 * DAY) & (F.col("time") < START + 12 * DAY) & (F.col("latitude") > 26))
    return box.drop("chunk")


@query("grid_extent", f"WITH {CELL_SQL} SELECT depth, min(time) AS first_time, max(time) AS last_time, min(latitude) AS south, max(latitude) AS north, min(longitude) AS west, max(longitude) AS east, count(*) AS n FROM field GROUP BY depth", "south north west east")
def _(spark, d):
    field = grid.read_grid(spark, written(spark, d))
    side = lambda f, c, n: f(c).alias(n)
    return field.groupBy("depth").agg(
        side(F.min, "time", "first_time"), side(F.max, "time", "last_time"), side(F.min, "latitude", "south"), side(F.max, "latitude", "north"), side(F.min, "longitude", "west"), side(F.max, "longitude", "east"), F.count("*").alias("n"),
    )


ASKED = {"id": "s_suppkey", "time": f"{START} + (s_suppkey % 400) * {2 * td.HOUR}", "latitude": "25e0 + ((s_suppkey * 17) % 300) * 1e-2", "longitude": "-93e0 + ((s_suppkey * 31) % 500) * 1e-2"}


@query("grid_forcing", f"""WITH {CELL_SQL}, asked AS (SELECT {td.columns(ASKED)} FROM supplier),
spot AS (SELECT *, (time - {START}) / {DAY}e0 AS p, (latitude - 25.375e0) / 75e-2 AS q, (longitude + 92.375e0) / 125e-2 AS r FROM asked),
corner AS (SELECT id, CAST(floor(p) AS BIGINT) + a AS i, CAST(floor(q) AS BIGINT) + b AS j, CAST(floor(r) AS BIGINT) + c AS k,
  (CASE a WHEN 1 THEN p - floor(p) ELSE 1 - (p - floor(p)) END) * (CASE b WHEN 1 THEN q - floor(q) ELSE 1 - (q - floor(q)) END) * (CASE c WHEN 1 THEN r - floor(r) ELSE 1 - (r - floor(r)) END) AS w
  FROM spot, range(2) x(a), range(2) y(b), range(2) z(c)),
met AS (SELECT id, CASE WHEN count(*) = count(u) THEN sum(w * u) END AS u, CASE WHEN count(*) = count(v) THEN sum(w * v) END AS v
  FROM corner LEFT JOIN (SELECT * FROM cells WHERE i_depth = 0) c ON c.i_time = i AND c.i_latitude = j AND c.i_longitude = k WHERE w > 0 GROUP BY id)
SELECT id, u, v, sqrt(u * u + v * v) AS speed, (degrees(atan2(u, v)) + 360) % 360 AS to_deg, (degrees(atan2(u, v)) + 180) % 360 AS from_deg FROM met""", "u v speed to_deg from_deg")
def _(spark, d):
    field = grid.read_grid(spark, written(spark, d)).filter("depth = 0")
    axes = [a for a in AXES if a.name != "depth"]
    out = grid.sample_grid(td.derived(spark, d, "supplier", ASKED), field, axes, ("u", "v"))
    u, v = F.col("u"), F.col("v")
    return out.select("id", "u", "v", F.hypot(u, v).alias("speed"), geo.flow_to_deg(u, v).alias("to_deg"), geo.wind_from_deg(u, v).alias("from_deg"))

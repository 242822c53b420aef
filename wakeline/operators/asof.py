"""Positions of moving entities at given times.

Reports and wanted times are stacked into one table and each wanted row takes the last report before and the first one
after it within its entity, by two window frames over one partitioning: one shuffle, no pair of times is ever compared.
An entity with far more reports than fit a task is cut into time cells first (``cell_us``): each wanted time needs
reports of its own cell and, carried over the border, the nearest one on either side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.functions.geo import haversine_km, wrap180
from wakeline.functions.nulls import finite


def clean_reports(raw: DataFrame, key: str = "mmsi", time: str = "us", lon: str = "lon", lat: str = "lat", tie: str | None = None, keep: str = "first") -> DataFrame:
    """Entity ids as strings without a trailing ``.0``, numbers by try-cast, incomplete rows dropped, one row for each
    entity and time (the first or last by ``tie``)."""
    number = lambda c: F.expr(f"try_cast(`{c}` AS double)")
    out = raw.withColumn(key, F.regexp_replace(F.col(key).cast("string"), r"\.0$", "")).withColumn(lon, number(lon)).withColumn(lat, number(lat)).withColumn(time, F.expr(f"try_cast(`{time}` AS bigint)"))
    out = out.dropna(subset=[key, time, lon, lat]).filter(finite(F.col(lon), F.col(lat)))
    order = F.col(tie or lon)
    w = Window.partitionBy(key, time).orderBy(order if keep == "first" else order.desc())
    return out.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def in_range(lat: Column, lon: Column) -> Column:
    return lat.between(-90, 90) & lon.between(-180, 180)


def neighbours(reports: DataFrame, wanted: DataFrame, key: str = "mmsi", fields: tuple[str, ...] = ("us", "lon", "lat"), cell_us: int | None = None) -> DataFrame:
    """(key, t, prv, nxt) for each row of ``wanted`` (key, t): structs of the last report at or before and the first
    at or after, null where there is none. An exact hit appears on both sides."""
    record = F.struct(*(F.col(c) for c in fields))
    seen = reports.select(key, F.col("us").alias("t"), F.lit(0).alias("q"), record.alias("r"))
    asked = wanted.select(key, "t", F.lit(1).alias("q"), F.lit(None).cast(seen.schema["r"].dataType).alias("r"))
    if cell_us is None:
        stacked = seen.unionByName(asked).withColumn("cell", F.lit(0))
    else:
        cell = F.floor(F.col("t") / cell_us).cast("long")
        seen, asked = seen.withColumn("cell", cell), asked.withColumn("cell", cell)
        # The last and first report of each cell are carried to the next cells that hold wanted times.
        edges = seen.groupBy(key, "cell").agg(F.min_by("r", "t").alias("lo"), F.max_by("r", "t").alias("hi"))
        cells = edges.unionByName(asked.select(key, "cell").distinct().join(edges.select(key, "cell"), [key, "cell"], "left_anti"), allowMissingColumns=True)
        w = Window.partitionBy(key).orderBy("cell")
        carried = cells.select(key, "cell", F.last("hi", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("before"), F.first("lo", True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("after"))
        extra = carried.select(key, "cell", F.explode(F.array("before", "after")).alias("r")).filter("r is not null").select(key, F.col("r.us").alias("t"), F.lit(0).alias("q"), "r", "cell")
        stacked = seen.unionByName(asked).unionByName(extra)
    up = Window.partitionBy(key, "cell").orderBy("t", "q").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = Window.partitionBy(key, "cell").orderBy("t", F.desc("q")).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    found = stacked.withColumn("prv", F.last("r", True).over(up)).withColumn("nxt", F.first("r", True).over(down))
    return found.filter("q = 1").select(key, "t", "prv", "nxt")


def grid_for(reports: DataFrame, times: DataFrame, key: str = "mmsi") -> DataFrame:
    """Every entity at every time (t)."""
    return reports.select(key).distinct().crossJoin(F.broadcast(times.select("t")))


def asof_nearest(reports: DataFrame, wanted: DataFrame, tolerance_us: int, key: str = "mmsi", fields: tuple[str, ...] = ("us", "lon", "lat"), cell_us: int | None = None) -> DataFrame:
    """The nearest report within a tolerance; the earlier of two as near; wanted rows without one are dropped."""
    near = neighbours(reports, wanted, key, fields, cell_us)
    before, after = F.col("t") - F.col("prv.us"), F.col("nxt.us") - F.col("t")
    pick = F.when(F.col("nxt").isNull() | (before <= after), F.col("prv")).otherwise(F.col("nxt"))
    return near.withColumn("r", pick).filter(F.abs(F.col("r.us") - F.col("t")) <= tolerance_us).select(key, "t", *(F.col(f"r.{c}").alias(c) for c in fields))


def bracket_interpolate(reports: DataFrame, wanted: DataFrame, max_gap_us: int, edge_us: int, max_knots: float, key: str = "mmsi", cell_us: int | None = None) -> DataFrame:
    """(key, t, lon, lat, method, gap_min, offset_min): exact, else linear between reports if the bracket is short and
    the implied speed plausible, else the nearest report within the edge tolerance (the previous one on ties), else
    unavailable with nulls. Longitudes cross the antimeridian."""
    return _interpolated(neighbours(reports, wanted, key, cell_us=cell_us), max_gap_us, edge_us, max_knots, key)


def _interpolated(near: DataFrame, max_gap_us: int, edge_us: int, max_knots: float, key: str) -> DataFrame:
    """``bracket_interpolate`` of (key, t, prv, nxt)."""
    t, p, n = F.col("t"), F.col("prv"), F.col("nxt")
    gap = n["us"] - p["us"]
    knots = haversine_km(p["lat"], p["lon"], n["lat"], n["lon"]) / 1.852 / F.nullif(gap / 3.6e9, F.lit(0.0))
    f = (t - p["us"]) / F.nullif(gap.cast("double"), F.lit(0.0))
    back, ahead = t - p["us"], n["us"] - t
    side = F.when(n.isNull() | (back <= ahead), p).otherwise(n)
    off = F.abs(side["us"] - t)
    method = (
        F.when(n["us"] == t, "exact").when((gap <= max_gap_us) & (knots <= max_knots), "interp")
        .when(off <= edge_us, "edge_nearest").otherwise("unavailable")
    )
    by = lambda exact, interp, edge: F.when(F.col("method") == "exact", exact).when(F.col("method") == "interp", interp).when(F.col("method") == "edge_nearest", edge)
    return near.withColumn("method", method).select(
        key, "t", "method",
        by(n["lon"], wrap180(p["lon"] + f * wrap180(n["lon"] - p["lon"])), side["lon"]).alias("lon"),
        by(n["lat"], p["lat"] + f * (n["lat"] - p["lat"]), side["lat"]).alias("lat"),
        by(F.lit(0.0), gap / 6e7, F.lit(None)).alias("gap_min"),
        by(F.lit(0.0), F.least(back, ahead) / 6e7, off / 6e7).alias("offset_min"),
    )


def state_at(reports: DataFrame, t_us: int, max_gap_us: int, edge_us: int, max_knots: float, key: str = "mmsi") -> DataFrame:
    """The interpolated position at one time with speed and course of the nearest report. For one time the reports around
    it are aggregates, so that an entity of any size is reduced before it is shuffled."""
    record = F.struct("us", "lon", "lat")
    away = F.struct(F.abs(F.col("us") - t_us), F.col("us"))
    side = lambda f, inside: f(F.when(inside, record), F.when(inside, F.col("us")))
    around = reports.groupBy(key).agg(
        side(F.max_by, F.col("us") <= t_us).alias("prv"), side(F.min_by, F.col("us") >= t_us).alias("nxt"), F.min_by("sog", away).alias("sog"), F.min_by("cog", away).alias("cog"), (F.min(F.abs(F.col("us") - t_us)) / 6e7).alias("nearest_report_min"),
    )
    around = around.withColumn("t", F.lit(t_us).cast("long"))
    place = _interpolated(around.select(key, "t", "prv", "nxt"), max_gap_us, edge_us, max_knots, key)
    return place.join(around.select(key, "sog", "cog", "nearest_report_min"), key)


def track_at(track: DataFrame, wanted: DataFrame, max_gap_us: int, key: str = "mmsi", cell_us: int | None = None) -> DataFrame:
    """Linear position on a track; null over longer gaps and outside it."""
    out = bracket_interpolate(track, wanted, max_gap_us, -1, float("inf"), key, cell_us)
    return out.select(key, "t", "lon", "lat")


def gaps(reports: DataFrame, start_us: int, end_us: int, min_gap_min: float, key: str = "mmsi") -> DataFrame:
    """Reporting gaps of at least ``min_gap_min`` inside a period, in whole seconds: gap_start, gap_end, gap_min, jump_km."""
    w = Window.partitionBy(key).orderBy("us")
    inside = reports.filter(F.col("us").between(start_us, end_us))
    steps = inside.select(key, F.col("us").alias("gap_start"), F.lead("us").over(w).alias("gap_end"), "lon", "lat", F.lead("lon").over(w).alias("lon2"), F.lead("lat").over(w).alias("lat2"))
    steps = steps.withColumn("gap_min", F.floor((F.col("gap_end") - F.col("gap_start")) / 1e6) / 60.0)
    return steps.filter(F.col("gap_min") >= min_gap_min).select(key, "gap_start", "gap_end", "gap_min", haversine_km(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")).alias("jump_km"))

"""Matching of detections with reporting entities, structures and entities gone silent."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wakeline.functions.geo import dead_reckoned
from wakeline.operators.buckets import dealt_join, nearest_within, radius_join
from wakeline.sources.work import cut

MOVING_KM, STATIONARY_KM, PLATFORM_KM = 1.5, 0.5, 0.5


def nearest_state(detections: DataFrame, states: DataFrame, moving_km: float = MOVING_KM, stationary_km: float = STATIONARY_KM, moving_knots: float = 0.5) -> DataFrame:
    """The nearest entity of each detection, kept if within the radius of its class. The nearest is chosen first: one
    that fails its radius hides farther ones that would pass theirs."""
    found = nearest_within(detections.select("det_id", "lon", "lat"), states.select("mmsi", "sog", "lon", "lat"), "det_id", "mmsi", max(moving_km, stationary_km))
    moving = F.coalesce(F.col("sog") >= moving_knots, F.lit(False))
    ok = found.withColumn("moving", moving).filter(F.col("dist_km") <= F.when(F.col("moving"), moving_km).otherwise(stationary_km))
    return ok.select("det_id", F.when(F.col("moving"), "ais_moving").otherwise("ais_stationary").alias("label"), F.col("mmsi").alias("match_id"), F.col("dist_km").alias("match_km"), F.col("r_lon").alias("m_lon"), F.col("r_lat").alias("m_lat"))


def nearest_platform(detections: DataFrame, platforms: DataFrame, platform_km: float = PLATFORM_KM) -> DataFrame:
    found = nearest_within(detections.select("det_id", "lon", "lat"), platforms.select("id", "lon", "lat"), "det_id", "id", platform_km)
    return found.select("det_id", F.lit("platform_no_ais").alias("label"), F.col("id").cast("string").alias("match_id"), F.col("dist_km").alias("match_km"), F.col("r_lon").alias("m_lon"), F.col("r_lat").alias("m_lat"))


def match_detections(detections: DataFrame, states: DataFrame, platforms: DataFrame, **radii: float) -> DataFrame:
    """Entities first, then structures, else a candidate for a dark vessel; offsets in metres."""
    radii = {"moving_km": MOVING_KM, "stationary_km": STATIONARY_KM, "platform_km": PLATFORM_KM} | radii
    both = nearest_state(detections, states, radii["moving_km"], radii["stationary_km"]).withColumn("o", F.lit(0)).unionByName(nearest_platform(detections, platforms, radii["platform_km"]).withColumn("o", F.lit(1)))
    first = both.groupBy("det_id").agg(F.min_by(F.struct("label", "match_id", "match_km", "m_lon", "m_lat"), "o").alias("m"))
    j = detections.join(first, "det_id", "left")
    return j.select(
        "det_id", "lon", "lat", F.coalesce("m.label", F.lit("dark_vessel_candidate")).alias("label"), F.col("m.match_id").alias("match_id"), F.col("m.match_km").alias("match_km"),
        ((F.col("lon") - F.col("m.m_lon")) * 111320.0 * F.cos(F.radians(F.col("m.m_lat")))).alias("d_lon_m"), ((F.col("lat") - F.col("m.m_lat")) * 110540.0).alias("d_lat_m"),
    )


def silent_entities(reports: DataFrame, t0_us: int, window_us: int, horizon_us: int) -> DataFrame:
    """Last report before T0 of entities without one near T0, dead-reckoned to T0: mmsi, last_min, dr_km, lon, lat."""
    recent = reports.filter(F.col("us").between(t0_us - window_us, t0_us + window_us)).select("mmsi").distinct()
    before = reports.filter((F.col("us") >= t0_us - horizon_us) & (F.col("us") < t0_us - window_us)).join(recent, "mmsi", "left_anti")
    last = before.groupBy("mmsi").agg(F.max_by(F.struct("us", "lon", "lat", "sog", "cog"), "us").alias("r"))
    hours = (t0_us - F.col("r.us")) / 3.6e9
    knots, course = F.coalesce("r.sog", F.lit(0.0)), F.coalesce("r.cog", F.lit(0.0))
    lat, lon = dead_reckoned(F.col("r.lat"), F.col("r.lon"), course, knots, hours)
    return last.select("mmsi", (hours * 60).alias("last_min"), (knots * 1.852 * hours).alias("dr_km"), lon.alias("lon"), lat.alias("lat"))


def match_silent(unmatched: DataFrame, silent: DataFrame, start_km: float = MOVING_KM, grow: float = 0.3, cap_km: float = 3.0) -> DataFrame:
    """The nearest silent entity among those whose own radius, growing with the reckoned distance up to a cap, reaches
    the detection."""
    pairs = radius_join(unmatched.select("det_id", "lon", "lat"), silent, cap_km)
    ok = pairs.filter(F.col("dist_km") <= F.least(start_km + grow * F.col("dr_km"), F.lit(cap_km)))
    w = Window.partitionBy("det_id").orderBy("dist_km", "mmsi")
    return ok.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("det_id", F.col("mmsi").alias("silent_mmsi"), F.col("last_min").alias("silent_last_report_min"), F.col("dist_km").alias("silent_dist_km"))


def relabel_silent(matched: DataFrame, reports: DataFrame, silent: DataFrame) -> DataFrame:
    """Dark candidates outside the reports' box have no coverage; those a silent entity explains are named so."""
    box = reports.agg(F.min("lon").alias("x0"), F.max("lon").alias("x1"), F.min("lat").alias("y0"), F.max("lat").alias("y1"))
    j = matched.crossJoin(F.broadcast(box)).withColumn("covered", F.col("lon").between(F.col("x0"), F.col("x1")) & F.col("lat").between(F.col("y0"), F.col("y1"))).drop("x0", "x1", "y0", "y1")
    found = match_silent(j.filter("label = 'dark_vessel_candidate' and covered"), silent)
    j = j.join(found, "det_id", "left")
    label = F.when(F.col("label") != "dark_vessel_candidate", F.col("label")).when(~F.col("covered"), "no_ais_coverage").when(F.col("silent_mmsi").isNotNull(), "ais_silent_at_t0").otherwise(F.col("label"))
    return j.withColumn("label", label).drop("covered")


def geolocation_offset(matched: DataFrame, at_least: int = 3) -> DataFrame:
    """Offsets of targets that do not move; statistics are null under ``at_least`` of them."""
    s = matched.filter(F.col("label").isin("ais_stationary", "platform_no_ais"))
    size = F.hypot("d_lon_m", "d_lat_m")
    enough = lambda x, n: F.when(F.count("*") >= at_least, x).alias(n)
    return s.agg(F.count("*").alias("n"), enough(F.median("d_lon_m"), "median_dx_m"), enough(F.median("d_lat_m"), "median_dy_m"), enough(F.median(size), "median_abs_offset_m"), enough(F.percentile(size, F.lit(0.9)), "p90_abs_offset_m"))


def nearest_structure(tracks: DataFrame, structures: DataFrame, radius_km: float) -> DataFrame:
    """The nearest structure of each track's median position within a radius: structure_id, structure_km, else null."""
    found = nearest_within(tracks.select("mmsi", F.col("m_lon").alias("lon"), F.col("m_lat").alias("lat")), structures.select("id", "lon", "lat"), "mmsi", "id", radius_km)
    return tracks.join(found.select("mmsi", F.col("id").alias("structure_id"), F.col("dist_km").alias("structure_km")), "mmsi", "left")


def sar_evidence(events: DataFrame, labelled: DataFrame, radius_km: float = 25.0) -> DataFrame:
    """The nearest labelled detection of each entity for each event: cluster_id, mmsi, sar_label, sar_dist_km."""
    named = labelled.filter(F.col("label").startswith("ais_")).select(F.col("match_id").alias("mmsi"), F.col("label").alias("sar_label"), "det_id", "lon", "lat")
    # Detections of an entity at one place, and events at one place, meet once; events follow their places.
    spots = cut(named.groupBy("mmsi", "sar_label", "lon", "lat").agg(F.min("det_id").alias("det_id")), "spots")
    own = events.select("cluster_id", F.col("lon").alias("r_lon"), F.col("lat").alias("r_lat")).distinct()
    own = cut(own.withColumn("_several", F.count("*").over(Window.partitionBy("cluster_id")) > 1), "events")
    met = radius_join(spots, own.select(F.col("r_lon").alias("lon"), F.col("r_lat").alias("lat")).distinct(), radius_km)
    first = lambda df, *by: df.withColumn("_n", F.row_number().over(Window.partitionBy(*by, "mmsi").orderBy("dist_km", "det_id"))).filter("_n = 1").drop("_n")
    least = cut(first(met, "r_lon", "r_lat").select("r_lon", "r_lat", "mmsi", "sar_label", "det_id", "dist_km"), "nearest")
    found = dealt_join(least, own, ["r_lon", "r_lat"])
    # Only events that are at several places choose among them.
    out = found.filter("NOT _several").unionByName(first(found.filter("_several"), "cluster_id"))
    return out.select("cluster_id", "mmsi", "sar_label", F.col("dist_km").alias("sar_dist_km"))


def distance_table(events: DataFrame, detections: DataFrame, near_km: float = 2.0, radius_km: float = 25.0) -> DataFrame:
    """Detections within a radius of each event, with a flag for the near ones. Distances are those of places, worked out
    once however many events and detections are there."""
    places = detections.select("lon", "lat").distinct()
    met = cut(radius_join(places, events.select("lon", "lat").distinct(), radius_km), "places")
    own = events.select("cluster_id", F.col("lon").alias("r_lon"), F.col("lat").alias("r_lat"))
    near = met.join(detections.select("det_id", "lon", "lat").hint("merge"), ["lon", "lat"]).join(own.hint("merge"), ["r_lon", "r_lat"])
    return near.select("cluster_id", "det_id", "dist_km", (F.col("dist_km") <= near_km).alias("near"))


def percentile_rank(values: DataFrame, reference: DataFrame, value: str, buckets: int = 1000) -> DataFrame:
    """Share of reference values up to each value, by one ordered pass over both tables' distinct values."""
    counts = reference.groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n")).unionByName(values.groupBy(F.col(value).alias("v")).agg(F.lit(0).cast("long").alias("n"))).groupBy("v").agg(F.sum("n").alias("n"))
    lo, hi = counts.agg(F.min("v"), F.max("v")).first()
    width = ((hi - lo) / buckets or 1.0) if hi is not None else 1.0
    b = counts.withColumn("b", F.floor((F.col("v") - F.lit(lo)) / width))
    sums = b.groupBy("b").agg(F.sum("n").alias("s"))
    before = sums.select("b", F.coalesce(F.sum("s").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("s").over(Window.partitionBy(F.lit(1))).alias("all"))
    run = b.join(before, "b").withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy("b").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    return values.join(run.select(F.col("v").alias(value), (F.col("upto") / F.col("all")).alias("percentile_rank")), value)


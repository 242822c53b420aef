"""Summaries of forecast particles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wakeline.functions.nulls import share

MASSES = ("mass_oil", "mass_evaporated", "mass_dispersed")


def probability_grid(particles: DataFrame, cell_deg: float = 0.02) -> DataFrame:
    """Share of an event's floating particles in each cell at each lead time, with the cell's centre."""
    afloat = particles.filter("status <> 'stranded'")
    key = ["cluster_id", "lead_h"]
    n = afloat.groupBy(*key, F.floor(F.col("lon") / cell_deg).alias("ix"), F.floor(F.col("lat") / cell_deg).alias("iy")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*key))
    return n.select(*key, "ix", "iy", "n", (F.col("n") / total).alias("probability"), ((F.col("ix") + 0.5) * cell_deg).alias("lon"), ((F.col("iy") + 0.5) * cell_deg).alias("lat"))


def beaching(particles: DataFrame) -> DataFrame:
    """Share of elements that strand, and when, by event."""
    first = particles.groupBy("cluster_id", "run", "element").agg(F.min(F.when(F.col("status") == "stranded", F.col("lead_h"))).alias("h"))
    return first.groupBy("cluster_id").agg(share(F.col("h").isNotNull()).alias("p_beached"), F.min("h").alias("earliest_beaching_h"), F.median("h").alias("median_beaching_h"))


def mass_budget(particles: DataFrame) -> DataFrame:
    """Masses by run, oil type and lead time as shares of the run's total at its first lead time."""
    sums = particles.groupBy("run", "oil_type", "lead_h").agg(*(F.sum(c).alias(c) for c in MASSES))
    whole = sum((F.col(c) for c in MASSES), F.lit(0.0))
    initial = F.first(whole).over(Window.partitionBy("run").orderBy("oil_type", "lead_h"))
    return sums.withColumn("initial", initial).select("run", "oil_type", "lead_h", "initial", *((F.col(c) / F.col("initial")).alias(c.replace("mass_", "frac_")) for c in MASSES))


def centroid_track(particles: DataFrame) -> DataFrame:
    """Mean position with 10 and 90 % envelopes of floating particles."""
    q = [F.percentile(c, F.lit(p)).alias(f"{c}_p{round(p * 100)}") for c in ("lon", "lat") for p in (0.1, 0.9)]
    return particles.filter("status <> 'stranded'").groupBy("cluster_id", "lead_h").agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat"), *q)


def coverage(particles: DataFrame) -> DataFrame:
    """Active particles by hour, with deactivations so far."""
    by = particles.groupBy("cluster_id", "lead_h").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "stranded").alias("out"))
    w = Window.partitionBy("cluster_id").orderBy("lead_h").rowsBetween(Window.unboundedPreceding, 0)
    return by.select("cluster_id", "lead_h", "n", F.sum("out").over(w).alias("out_so_far"))


def endpoint_spread(particles: DataFrame, group: tuple[str, ...] = ("cluster_id",)) -> DataFrame:
    """RMS distance from the mean, covariance ellipse (axes and azimuth) of end points, in degrees."""
    m = particles.groupBy(*group).agg(F.avg("lon").alias("m_lon"), F.avg("lat").alias("m_lat"), F.var_samp("lon").alias("vx"), F.var_samp("lat").alias("vy"), F.covar_samp("lon", "lat").alias("cxy"), F.count("*").alias("n"))
    half, root = (F.col("vx") + F.col("vy")) / 2, F.sqrt(F.pow((F.col("vx") - F.col("vy")) / 2, F.lit(2.0)) + F.pow("cxy", F.lit(2.0)))
    return m.select(
        *group, "n", "m_lon", "m_lat", F.sqrt((F.col("vx") + F.col("vy")) * (F.col("n") - 1) / F.col("n")).alias("rms"), F.sqrt(half + root).alias("major"), F.sqrt(F.greatest(half - root, F.lit(0.0))).alias("minor"),
        F.pmod(90.0 - F.degrees(0.5 * F.atan2(2 * F.col("cxy"), F.col("vx") - F.col("vy"))), F.lit(180.0)).alias("azimuth"),
    )


def histogram_overlap(a: DataFrame, b: DataFrame, cell_deg: float) -> DataFrame:
    """Sum of the smaller of both clouds' shares in each cell."""
    def shares(df: DataFrame, name: str) -> DataFrame:
        n = df.groupBy(F.floor(F.col("lon") / cell_deg).alias("ix"), F.floor(F.col("lat") / cell_deg).alias("iy")).agg(F.count("*").alias("n"))
        return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("all")))).select("ix", "iy", (F.col("n") / F.col("all")).alias(name))

    return shares(a, "pa").join(shares(b, "pb"), ["ix", "iy"]).agg(F.coalesce(F.sum(F.least("pa", "pb")), F.lit(0.0)).alias("overlap"))


def interpolate_grid(points: DataFrame, grid: DataFrame, step_deg: float, step_us: int) -> DataFrame:
    """Trilinear values of a gridded field at (id, t, lon, lat). ``grid``: it, ix, iy, u, v at whole steps. Eight corners by
    equi-join; a point with a missing corner gets null."""
    fx, fy, ft = F.col("lon") / step_deg, F.col("lat") / step_deg, F.col("t") / float(step_us)
    p = points.select("id", F.floor(fx).alias("x0"), F.floor(fy).alias("y0"), F.floor(ft).alias("t0"), (fx - F.floor(fx)).alias("wx"), (fy - F.floor(fy)).alias("wy"), (ft - F.floor(ft)).alias("wt"))
    corner = F.explode(F.array(*(F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy"), F.lit(c).alias("dt")) for a in (0, 1) for b in (0, 1) for c in (0, 1))))
    c = p.withColumn("c", corner)
    side = lambda w, d: F.when(F.col(d) == 1, F.col(w)).otherwise(1 - F.col(w))
    c = c.withColumn("w", side("wx", "c.dx") * side("wy", "c.dy") * side("wt", "c.dt")).withColumn("ix", F.col("x0") + F.col("c.dx")).withColumn("iy", F.col("y0") + F.col("c.dy")).withColumn("it", F.col("t0") + F.col("c.dt"))
    j = c.filter("w > 0").join(grid, ["it", "ix", "iy"], "left")
    whole = F.count_if(F.col("u").isNull()) == 0
    return j.groupBy("id").agg(F.when(whole, F.sum(F.col("w") * F.col("u"))).alias("u"), F.when(whole, F.sum(F.col("w") * F.col("v"))).alias("v"))

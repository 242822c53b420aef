"""Forward tests: virtual releases against a slick, over every release window at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.functions.kernels import f_score
from wakeline.functions.nulls import share
from wakeline.operators.asof import bracket_interpolate, grid_for
from wakeline.operators.buckets import radius_join
from wakeline.sources.work import cut

N_HOURS = 48
DURATIONS = (1, 2, 3, 6, 12)


def windows(spark: SparkSession, durations: tuple[int, ...] = DURATIONS, hours: int = N_HOURS) -> DataFrame:
    """(w, start_h, end_h, mask): each window [start, end) with its hours as bits, numbered by duration, then start."""
    rows = [(a, a + d) for d in durations for a in range(hours - d + 1)]
    return spark.createDataFrame([(w, a, b, sum(1 << h for h in range(a, b))) for w, (a, b) in enumerate(rows)], "w int, start_h int, end_h int, mask long")


def release_points(reports: DataFrame, times: DataFrame, land: DataFrame | None, cell_deg: float, max_gap_us: int, edge_us: int, max_knots: float, t0_us: int, copies: int = 2, jitter_deg: float = 0.0005) -> DataFrame:
    """Positions along each track at the given times, on water, replicated with a jitter by hash: mmsi, t, hour, k, lon, lat."""
    at = bracket_interpolate(reports, grid_for(reports, times), max_gap_us, edge_us, max_knots).filter("method <> 'unavailable'")
    at = at.withColumn("ix", F.floor(F.col("lon") / cell_deg)).withColumn("iy", F.floor(F.col("lat") / cell_deg))
    if land is not None:
        at = at.join(land, ["ix", "iy"], "left_anti")
    many = at.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    u = lambda s: F.pmod(F.xxhash64("mmsi", "t", "k", F.lit(s)), F.lit(1 << 20)) / float(1 << 20) - 0.5
    hour = F.greatest(F.ceil((t0_us - F.col("t")) / 3.6e9) - 1, F.lit(0)).cast("int")
    return many.select("mmsi", "t", hour.alias("hour"), "k", (F.col("lon") + u(1) * jitter_deg).alias("lon"), (F.col("lat") + u(2) * jitter_deg).alias("lat"))


def reaching(oil: DataFrame, samples: DataFrame, hit_km: float) -> DataFrame:
    """The rows of ``oil`` near any sample of their event; each place is looked at once."""
    places = oil.select("cluster_id", "lon", "lat").distinct()
    spots = samples.select("cluster_id", "lon", "lat").distinct()
    found = cut(radius_join(places, spots, hit_km, on=("cluster_id",)).select("cluster_id", "lon", "lat").distinct(), "places")
    return oil.join(found, ["cluster_id", "lon", "lat"], "left_semi")


def window_search(oil: DataFrame, samples: DataFrame, hit_km: float, grid: DataFrame) -> DataFrame:
    """Precision, recall and F of every window for each event and entity.

    ``oil``: cluster_id, mmsi, member, pid, hour, lon, lat at T0; ``samples``: cluster_id, sid, lon, lat of the slick.
    Particles of one place meet the samples once, with the hours that they have there as bits of one number. A sample keeps
    the hours that reach it in the same way, so that a window is one AND. A particle counts once, however often its row is repeated.
    """
    hours = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("hour").cast("int"))).alias("hours")
    places = oil.groupBy("cluster_id", "mmsi", "lon", "lat").agg(hours)
    pairs = radius_join(places, samples.select("cluster_id", "sid", "lon", "lat"), hit_km, on=("cluster_id",)).select("cluster_id", "mmsi", "sid", "hours")
    near = reaching(oil, samples, hit_km).groupBy("cluster_id", "mmsi", "hour").agg(F.count_distinct("pid").alias("n_near"))
    hist = oil.groupBy("cluster_id", "mmsi", "hour").agg(F.count_distinct("pid").alias("n")).join(near, ["cluster_id", "mmsi", "hour"], "left")
    g = F.broadcast(grid)
    precision = hist.join(g, (F.col("hour") >= F.col("start_h")) & (F.col("hour") < F.col("end_h"))).groupBy("cluster_id", "mmsi", "w").agg((F.sum(F.coalesce("n_near", F.lit(0))) / F.sum("n")).alias("precision"))
    masks = pairs.groupBy("cluster_id", "mmsi", "sid").agg(F.bit_or("hours").alias("hours"))
    kinds = masks.groupBy("cluster_id", "mmsi", "hours").agg(F.count("*").alias("n"))
    reached = kinds.join(g, F.col("hours").bitwiseAND(F.col("mask")) != 0).groupBy("cluster_id", "mmsi", "w").agg(F.sum("n").alias("reached"))
    size = samples.groupBy("cluster_id").agg(F.count("*").alias("n_samples"))
    every = oil.select("cluster_id", "mmsi").distinct().join(size, "cluster_id").crossJoin(g)
    key = ["cluster_id", "mmsi", "w"]
    out = every.join(precision, key, "left").join(reached, key, "left")
    p, r = F.coalesce("precision", F.lit(0.0)), F.coalesce("reached", F.lit(0)) / F.col("n_samples")
    return out.select(*key, "start_h", "end_h", p.alias("precision"), r.alias("recall"), F.when(p + r > 0, f_score(p, r)).otherwise(0.0).alias("f"))


def best_windows(scored: DataFrame, oil: DataFrame, samples: DataFrame, hit_km: float) -> DataFrame:
    """The first best window of each event and entity, and the share of all its members that reach the slick in it."""
    first = F.struct(F.round("f", 6), -F.col("w"))
    best = scored.groupBy("cluster_id", "mmsi").agg(F.max_by(F.struct("start_h", "end_h", "precision", "recall", "f"), first).alias("b")).select("cluster_id", "mmsi", "b.*")
    hit = reaching(oil, samples, hit_km).select("cluster_id", "mmsi", "member", "hour").distinct().join(best, ["cluster_id", "mmsi"]).filter((F.col("hour") >= F.col("start_h")) & (F.col("hour") < F.col("end_h"))).select("cluster_id", "mmsi", "member").distinct().withColumn("hit", F.lit(True))
    members = oil.select("cluster_id", "mmsi", "member").distinct().join(hit, ["cluster_id", "mmsi", "member"], "left")
    support = members.groupBy("cluster_id", "mmsi").agg(share(F.col("hit")).alias("member_support"))
    return best.join(support, ["cluster_id", "mmsi"])


def fractions_skill(observed: DataFrame, modelled: DataFrame, widths: tuple[int, ...], keys: tuple[str, ...] = ("cluster_id",)) -> DataFrame:
    """Fractions skill score of two sets of cells (ix, iy) for odd neighbourhood widths; null if both are empty there."""
    out = None
    both = observed.select(*keys, "ix", "iy", F.lit(1).alias("o"), F.lit(0).alias("m")).distinct().unionByName(modelled.select(*keys, "ix", "iy", F.lit(0).alias("o"), F.lit(1).alias("m")).distinct())
    for n in widths:
        r = n // 2
        spread = both.withColumn("ix", F.explode(F.sequence(F.col("ix") - r, F.col("ix") + r))).withColumn("iy", F.explode(F.sequence(F.col("iy") - r, F.col("iy") + r)))
        cells = spread.groupBy(*keys, "ix", "iy").agg((F.sum("o") / float(n * n)).alias("po"), (F.sum("m") / float(n * n)).alias("pm"))
        diff, whole = F.sum(F.pow(F.col("po") - F.col("pm"), F.lit(2.0))), F.sum(F.pow("po", F.lit(2.0)) + F.pow("pm", F.lit(2.0)))
        row = cells.groupBy(*keys).agg(F.lit(n).alias("width"), F.when(whole > 0, 1.0 - diff / whole).alias("fss"))
        out = row if out is None else out.unionByName(row)
    return out

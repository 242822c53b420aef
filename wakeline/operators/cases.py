"""Synthetic cases: releases sampled from entities' tracks, accepted by coverage and domain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.operators.numbering import numbered

M32 = 1 << 32


def chance(attempt: Column, stratum: Column, salt: int, seed: int) -> Column:
    """A whole number below 2 ** 32, from attempt, stratum and salt."""
    x = (attempt * 31 + stratum * 17 + salt * 1009 + seed * 7919 + 1) * F.lit(2654435761) % M32
    return (F.floor(x / 65536) + x % 65536 * 40503) % M32


def sample_cases(
    pool: DataFrame,
    per_stratum: int,
    strata: Sequence[tuple[float, float]],
    durations_h: Sequence[int],
    step_h: float,
    bounds: tuple[float, float, float, float],
    min_coverage: float = 0.8,
    margin_deg: float = 0.25,
    tries: int = 50,
    seed: int = 0,
) -> DataFrame:
    """(case_id, stratum, mmsi, tau_end_h, tau_start_h, duration_h, n_points, track_extent_km, moving) from ``pool`` (mmsi,
    tau_h, lon, lat): where entities were, tau hours before T0.

    An attempt picks an entity, a duration and an end within its stratum (lo, hi), by hash. It is accepted if the entity's
    points between the end and the start cover at least ``min_coverage`` of the steps and all lie ``margin_deg`` inside the
    bounds (west, south, east, north). Of each stratum the first ``per_stratum`` accepted attempts of ``tries`` times as
    many are cases; a stratum can have fewer. Attempts are judged side by side, by one join with the tracks.
    """
    spark, n = pool.sparkSession, per_stratum * tries
    entities = numbered(pool.filter("mmsi IS NOT NULL").select("mmsi").distinct(), ["mmsi"], "_e")
    total = entities.agg(F.greatest(F.count("*"), F.lit(1)).alias("_n"))  # one row
    limits = spark.createDataFrame([(k, float(lo), float(hi)) for k, (lo, hi) in enumerate(strata)], "_k long, _lo double, _hi double")
    drawn = spark.range(n).withColumnRenamed("id", "_t").crossJoin(F.broadcast(limits)).crossJoin(F.broadcast(total))  # as many as asked for
    pick = lambda salt: chance(F.col("_t"), F.col("_k"), salt, seed)
    lengths = F.array(*(F.lit(int(h)) for h in durations_h))
    end = F.col("_lo") + pick(2) / float(M32) * (F.col("_hi") - F.col("_lo"))
    length = F.get(lengths, (pick(1) % len(durations_h)).cast("int"))
    rounded = F.floor(end / step_h + 0.5) * F.lit(float(step_h))
    drawn = drawn.select("_t", "_k", (pick(0) % F.col("_n")).alias("_e"), length.alias("duration_h"), rounded.alias("tau_end_h"))
    asked = drawn.join(entities, "_e").drop("_e")
    track = pool.filter("tau_h IS NOT NULL AND lon IS NOT NULL AND lat IS NOT NULL").select("mmsi", "tau_h", "lon", "lat")
    met = asked.join(track, "mmsi").filter((F.col("tau_h") > F.col("tau_end_h")) & (F.col("tau_h") <= F.col("tau_end_h") + F.col("duration_h")))
    west, south, east, north = bounds
    inside = F.col("lon").between(west + margin_deg, east - margin_deg) & F.col("lat").between(south + margin_deg, north - margin_deg)
    spread = F.hypot((F.max("lon") - F.min("lon")) * 99.0, (F.max("lat") - F.min("lat")) * 111.0)
    seen = met.groupBy("_k", "_t", "mmsi", "duration_h", "tau_end_h").agg(F.count("*").alias("n_points"), F.bool_and(inside).alias("_in"), spread.alias("track_extent_km"))
    good = seen.filter(F.col("_in") & (F.col("n_points") >= min_coverage * F.col("duration_h") / F.lit(float(step_h))))
    place = F.row_number().over(Window.partitionBy("_k").orderBy("_t"))  # as many rows as attempts at most
    kept = good.withColumn("_p", place).filter(F.col("_p") <= per_stratum).join(F.broadcast(limits), "_k")
    return kept.select(
        (F.lit(1000) + F.col("_k") * per_stratum + F.col("_p") - 1).alias("case_id"),
        F.format_string("%d-%dh", F.col("_lo").cast("int"), F.col("_hi").cast("int")).alias("stratum"),
        "mmsi",
        "tau_end_h",
        (F.col("tau_end_h") + F.col("duration_h")).alias("tau_start_h"),
        "duration_h",
        "n_points",
        "track_extent_km",
        (F.col("track_extent_km") > 1.0).alias("moving"),
    )

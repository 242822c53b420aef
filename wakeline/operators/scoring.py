"""Compatibility of positions with particle clouds: kernel statistics, summaries, ensembles.

Positions meet clouds of equal time (and scenario or member) as arrays, in ``clouds``: each position's distances are
reduced to one row of statistics where they are computed, and no pair is ever a row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wakeline.functions import binning
from wakeline.functions.geo import KM_PER_DEG_LAT, KM_PER_DEG_LON
from wakeline.functions.kernels import gaussian, growing_sigma
from wakeline.functions.nulls import finite, share
from wakeline.operators.buckets import box_join, in_box
from wakeline.operators.clouds import STATISTICS, against_clouds
from wakeline.sources.work import cut

RANK_DP = 6


def ranked(df: DataFrame, by: str, name: str, *within: str, descending: bool = True) -> DataFrame:
    """Competition rank (ties share the smallest) of a rounded score, nulls last. A global rank (no ``within``) needs
    only the distinct rounded scores in one place, with their counts."""
    value = F.round(F.col(by), RANK_DP)
    order = value.desc_nulls_last() if descending else value.asc_nulls_last()
    if within:
        return df.withColumn(name, F.rank().over(Window.partitionBy(*within).orderBy(order)).cast("int"))
    counted = df.groupBy(value.alias("_v")).agg(F.count("*").alias("_n"))
    w = Window.orderBy(F.col("_v").desc_nulls_last() if descending else F.col("_v").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    places = counted.select("_v", (F.coalesce(F.sum("_n").over(w), F.lit(0)) + 1).cast("int").alias(name))
    return df.withColumn("_w", value).join(places, F.col("_w").eqNullSafe(F.col("_v"))).drop("_w", "_v")


def time_scores(positions: DataFrame, particles: DataFrame, sigma_km: float, cloud_keys: Sequence[str] = (), wanted: Sequence[str] = STATISTICS, by: Sequence[str] = ()) -> DataFrame:
    """Kernel statistics of each position (mmsi, t, lon, lat) against the particles (p_lon, p_lat) of its time, for each
    value of ``cloud_keys``; times without a cloud give no row, particles that are not finite do not count."""
    held = positions.select("mmsi", "t", "lon", "lat", F.lit(float(sigma_km)).alias("sigma"))
    return against_clouds(held, particles, ("t",), "sigma", cloud_keys, wanted, by).drop("sigma")


def summarise(scores: DataFrame, n_times: int, key: str = "mmsi") -> DataFrame:
    """Peak, mean, coverage and counts for each entity; the peak is the first time of the highest score."""
    first = F.struct(F.round("density_score", RANK_DP), -F.col("t"))
    out = scores.groupBy(key).agg(
        F.count("*").alias("matched_hours"), (F.count("*") / F.lit(float(n_times))).alias("coverage_fraction"),
        F.max("density_score").alias("point_release_score"), F.avg("density_score").alias("continuous_release_score"), F.max_by("t", first).alias("peak_time"),
        F.max_by("min_distance_km", first).alias("peak_min_distance_km"), F.max_by("p10_distance_km", first).alias("peak_p10_distance_km"),
        F.min("min_distance_km").alias("best_min_distance_km"), F.min("p10_distance_km").alias("best_p10_distance_km"),
        F.count_if(F.col("density_score") >= 0.05).alias("hours_density_gt_005"), F.count_if(F.col("density_score") >= 0.10).alias("hours_density_gt_01"),
    )
    return ranked(ranked(out, "point_release_score", "point_rank"), "continuous_release_score", "continuous_rank")


def minimum_distance_scores(scores: DataFrame, sigma_km: float, n_times: int, key: str = "mmsi") -> DataFrame:
    """The first version's score: the kernel of the least distance, times the coverage."""
    own = gaussian(F.col("min_distance_km"), sigma_km)
    return scores.groupBy(key).agg((F.max(own) * F.count("*") / F.lit(float(n_times))).alias("v1_score"), F.count_if(F.col("min_distance_km") <= 5).alias("hours_5km"))


def release_age_table(scores: DataFrame, t0_us: int, key: str = "mmsi") -> DataFrame:
    aged = scores.withColumn("age_h", binning.hours_before(t0_us, F.col("t")))
    aged = aged.withColumn("release_age_bin", binning.age_bin(F.col("age_h"))).filter("release_age_bin is not null")
    first = F.struct(F.round("density_score", RANK_DP), -F.col("t"))
    out = aged.groupBy(key, "release_age_bin").agg(
        F.count("*").alias("matched_hours_in_bin"), F.max("density_score").alias("peak_density_score"), F.avg("density_score").alias("mean_density_score"),
        F.max_by("age_h", first).alias("peak_age_hours"), F.max_by("min_distance_km", first).alias("peak_min_distance_km"),
    )
    return ranked(out, "peak_density_score", "rank_in_age_bin", "release_age_bin")


def scenario_scores(positions: DataFrame, ensemble: DataFrame, t0_us: int, sigma_km: float) -> DataFrame:
    """Per scenario, entity and age bin: peak and mean score, rank in the scenario's bin."""
    ts = time_scores(positions, ensemble, sigma_km, ("scenario_id",), ("density_score",), ("mmsi",))
    aged = ts.withColumn("age_h", binning.hours_before(t0_us, F.col("t"))).withColumn("release_age_bin", binning.age_bin(F.col("age_h"))).filter("release_age_bin is not null")
    first = F.struct(F.round("density_score", RANK_DP), -F.col("t"))
    out = aged.groupBy("scenario_id", "mmsi", "release_age_bin").agg(
        F.count("*").alias("matched_hours"), F.max("density_score").alias("point_score"), F.avg("density_score").alias("mean_score"), F.max_by("age_h", first).alias("peak_age_hours"),
    )
    return ranked(out, "point_score", "scenario_rank", "scenario_id", "release_age_bin")


def robust_table(members: DataFrame, keys: Sequence[str], member: str, score: str, rank: str, age: str = "peak_age_hours") -> DataFrame:
    """Quantiles of score, rank and peak age over the members, with top-k fractions."""
    aggs = [F.count_distinct(member).alias("scenarios_evaluated")]
    for name, c in (("score", score), ("rank", rank), ("peak_age", age)):
        if name != "peak_age":
            aggs.append(F.avg(c).alias(f"{name}_mean"))
        aggs += [F.median(c).alias(f"{name}_median"), F.percentile(c, F.lit(0.1)).alias(f"{name}_q10"), F.percentile(c, F.lit(0.9)).alias(f"{name}_q90")]
    aggs += [share(F.col(rank) <= k).alias(f"top{k}_fraction") for k in (1, 3, 5, 10)]
    return members.groupBy(*keys).agg(*aggs)


# Backward scores with an age-dependent kernel.

CUTOFF_SIGMA = 6.0


def backward_scores(positions: DataFrame, particles: DataFrame, t0_us: int, gate_sigma: float = 3.0) -> DataFrame:
    """(cluster_id, member, mmsi, t): density, min_distance_km, gate_hit. Only entities inside the cloud's box widened by
    six kernel widths are compared; others give no row."""
    cloud = particles.filter(finite(F.col("p_lon"), F.col("p_lat"))).withColumn("tau_h", binning.hours_before(t0_us, F.col("t")))
    key = ["cluster_id", "member", "t"]
    boxes = cloud.groupBy(*key, "tau_h").agg(F.min("p_lon").alias("x0"), F.max("p_lon").alias("x1"), F.min("p_lat").alias("y0"), F.max("p_lat").alias("y1"), F.avg("p_lat").alias("y"))
    boxes = boxes.withColumn("sigma", growing_sigma(F.col("tau_h"))).withColumn("pad", CUTOFF_SIGMA * F.col("sigma"))
    dx, dy = F.least(F.lit(180.0), F.col("pad") / (KM_PER_DEG_LON * F.greatest(F.cos(F.radians("y")), F.lit(1e-9)))), F.col("pad") / KM_PER_DEG_LAT
    boxes = boxes.select(*key, "tau_h", "sigma", (F.col("x0") - dx).alias("lon0"), (F.col("x1") + dx).alias("lon1"), (F.col("y0") - dy).alias("lat0"), (F.col("y1") + dy).alias("lat1"))
    # Members of a cluster share most places, so that all of them are met at once by the positions in any member's box.
    boxes = cut(boxes, "boxes")
    edges = (("lon0", F.min), ("lon1", F.max), ("lat0", F.min), ("lat1", F.max))
    joint = boxes.groupBy("cluster_id", "t", "tau_h", "sigma").agg(*(f(c).alias(c) for c, f in edges))
    near = box_join(positions.select("mmsi", "t", "lon", "lat"), joint, ("t",)).select("mmsi", "lon", "lat", "sigma", "tau_h", "cluster_id", "t")
    found = against_clouds(near, cloud.select(*key, "p_lon", "p_lat"), ("cluster_id", "t"), "sigma", ("member",), ("min_distance_km", "density_score"))
    found = found.join(boxes.drop("tau_h", "sigma"), key).filter(in_box())
    return found.select("cluster_id", "member", "mmsi", "t", "tau_h", F.col("density_score").alias("density"), "min_distance_km", (F.col("min_distance_km") <= gate_sigma * F.col("sigma")).alias("gate_hit"))


def backward_members(scores: DataFrame, hours: int = 49, tau0_h: float = 12.0) -> DataFrame:
    """Point and age-weighted score of each member. Hours without a row count as 0 but keep their weight, the sum of the
    weights being that of the whole grid."""
    import math

    whole = sum(math.exp(-h / tau0_h) for h in range(hours))
    first = F.struct(F.round("density", RANK_DP), F.col("tau_h"))
    out = scores.groupBy("cluster_id", "member", "mmsi").agg(
        F.count("*").alias("positions"), F.bool_or("gate_hit").alias("gate_hit"), F.max("density").alias("s_point"),
        (F.sum(F.exp(-F.bround("tau_h") / tau0_h) * F.col("density")) / F.lit(whole)).alias("s_weighted"), F.max_by("tau_h", first).alias("peak_age_hours"), F.max_by("min_distance_km", first).alias("peak_min_distance_km"),
    )
    return ranked(ranked(out, "s_weighted", "rank_weighted", "cluster_id", "member"), "s_point", "rank_point", "cluster_id", "member")


def backward_robust(members: DataFrame, positioned: DataFrame, min_positions: int = 2) -> DataFrame:
    """``positioned``: mmsi, positions (hours with a position, scored or not)."""
    out = members.groupBy("cluster_id", "mmsi").agg(
        F.bool_or("gate_hit").alias("gate_hit"), F.count_distinct("member").alias("members"), F.median("s_weighted").alias("bwd_weighted"),
        F.percentile("s_weighted", F.lit(0.1)).alias("bwd_weighted_q10"), F.percentile("s_weighted", F.lit(0.9)).alias("bwd_weighted_q90"), F.median("s_point").alias("bwd_point"),
        F.median("rank_weighted").alias("bwd_rank_median"), share(F.col("rank_weighted") <= 1).alias("bwd_top1_fraction"), share(F.col("rank_weighted") <= 3).alias("bwd_top3_fraction"),
        share(F.col("rank_weighted") <= 5).alias("bwd_top5_fraction"), F.median("peak_age_hours").alias("bwd_peak_age_median"),
        F.median("rank_point").alias("bwd_point_rank_median"), F.median("peak_min_distance_km").alias("bwd_peak_min_distance_km"),
    )
    return out.join(positioned, "mmsi", "left").withColumn("passes_funnel", F.col("gate_hit") & (F.coalesce("positions", F.lit(0)) >= min_positions))


def backward_bins(scores: DataFrame) -> DataFrame:
    """Best density of each member and age bin, ranked, then medians over the members."""
    binned = scores.withColumn("release_age_bin", binning.age_bin(F.col("tau_h"))).filter("release_age_bin is not null")
    best = binned.groupBy("cluster_id", "member", "mmsi", "release_age_bin").agg(F.max("density").alias("density"))
    best = ranked(best, "density", "rank", "cluster_id", "member", "release_age_bin")
    return best.groupBy("cluster_id", "mmsi", "release_age_bin").agg(F.median("density").alias("density_median"), F.median("rank").alias("rank_median"), share(F.col("rank") <= 5).alias("top5_fraction"))


def funnel(robust: DataFrame, positioned: DataFrame, min_positions: int = 2) -> DataFrame:
    whole = positioned.agg(F.count("*").alias("ais_vessels_in_window"), F.count_if(F.col("positions") >= min_positions).alias("positioned_ge_min_hours"))
    return robust.groupBy("cluster_id").agg(F.count_if("passes_funnel").alias("within_gate_of_backward_cloud")).crossJoin(F.broadcast(whole))


def cloud_summary(particles: DataFrame) -> DataFrame:
    ok = particles.filter(finite(F.col("p_lon"), F.col("p_lat")))
    return ok.groupBy("cluster_id", "member", "t").agg(F.avg("p_lon").alias("lon"), F.avg("p_lat").alias("lat"), F.stddev_samp("p_lon").alias("lon_std"), F.stddev_samp("p_lat").alias("lat_std"), F.count("*").alias("n"))

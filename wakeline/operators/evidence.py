"""Evidence on single entities: gaps and jumps, fresh-discharge geometry, motion state, source type, age cues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.functions.geo import axis_difference, haversine_km
from wakeline.functions.kernels import geometry_score, head_proximity, heading_alignment, okubo_age_h, width_age_h
from wakeline.functions.nulls import share
from wakeline.operators import asof


def valid_mmsi(mmsi: Column) -> Column:
    return mmsi.rlike("^[2-7][0-9]{8}$")


def most_common_name(name: Column) -> Column:
    """Aggregate: the most common name that is not blank, the smallest of ties; empty if there is none."""
    trimmed = F.trim(name)
    return F.coalesce(F.mode(F.when(trimmed != "", trimmed), True), F.lit(""))


def behaviour(reports: DataFrame, t0_us: int, window_h: int = 48, gap_min: float = 60.0, max_knots: float = 50.0, key: str = "mmsi") -> DataFrame:
    """Counts of reports, gaps and implausible jumps before T0; gaps as an array of (hi_h, lo_h) hours before T0."""
    t1 = t0_us - window_h * 3_600_000_000
    w = Window.partitionBy(key).orderBy("us")
    inside = reports.filter(F.col("us").between(t1, t0_us))
    steps = inside.select(
        key, "us", F.lag("us").over(w).alias("p_us"), haversine_km(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon")).alias("km")
    )
    seconds = F.floor((F.col("us") - F.col("p_us")) / 1e6)
    gap = F.when(seconds / 60.0 >= gap_min, seconds / 60.0)
    knots = F.when(seconds > 0, F.col("km") / 1.852 / (seconds / 3600.0)).otherwise(0.0)
    span = F.when(gap.isNotNull(), F.struct(((t0_us - F.col("p_us")) / 3.6e9).alias("hi_h"), ((t0_us - F.col("us")) / 3.6e9).alias("lo_h")))
    out = steps.groupBy(key).agg(
        F.count("*").alias("ais_reports_48h"), F.count(gap).alias("ais_gaps"), F.coalesce(F.max(gap), F.lit(0.0)).alias("ais_longest_gap_min"), F.array_sort(F.collect_list(span), lambda a, b: F.when(a["hi_h"] > b["hi_h"], -1).when(a["hi_h"] < b["hi_h"], 1).otherwise(0)).alias("gaps"),
        ((t0_us - F.max("us")) / 6e7).alias("ais_last_report_before_t0_min"), F.count_if(knots > max_knots).alias("ais_speed_jumps"),
    )
    return out.withColumn("mmsi_standard", valid_mmsi(F.col(key)))


def static_columns(reports: DataFrame, key: str = "mmsi") -> DataFrame:
    """(key, name, vessel_type, length_m): what an entity says of itself: its most common name and type (the smallest of
    ties; null if it never names a type) and its largest length."""
    return reports.groupBy(key).agg(most_common_name(F.col("name")).alias("name"), F.mode("vessel_type", True).alias("vessel_type"), F.max("length_m").alias("length_m"))


def gap_text(gaps: Column) -> Column:
    """Gaps as text, hours to one place: ``39.3-37.6h;8.0-5.7h``."""
    return F.array_join(F.transform(gaps, lambda g: F.format_string("%.1f-%.1fh", g["hi_h"], g["lo_h"])), ";")


def gap_overlaps(gaps: Column, start_h: Column, end_h: Column) -> Column:
    """Whether a gap meets the release window; unknown windows do not."""
    return F.coalesce(F.exists(gaps, lambda g: (g["lo_h"] < end_h) & (g["hi_h"] > start_h)), F.lit(False))


def discharge_geometry(events: DataFrame, state: DataFrame, nearest: DataFrame, pairs: DataFrame, spread_km_h: float = 3.0, min_ref_km: float = 0.5, moving_knots: float = 0.5) -> DataFrame:
    """Proximity of an entity to a slick's ends at T0 and its heading along the slick's axis. ``events``: cluster_id, ends
    and axis; ``state``: from ``state_at``; ``nearest``: mmsi with n_lon, n_lat of the nearest report, used without a
    position at T0; ``pairs``: the (cluster_id, mmsi) that pass the funnel."""
    j = pairs.join(events, "cluster_id").join(state.join(nearest, "mmsi"), "mmsi")
    lon, lat = F.coalesce("lon", "n_lon"), F.coalesce("lat", "n_lat")
    d_end = F.least(haversine_km(lat, lon, F.col("end1_lat"), F.col("end1_lon")), haversine_km(lat, lon, F.col("end2_lat"), F.col("end2_lon")))
    moving = F.coalesce((F.col("sog") >= moving_knots) & (F.col("cog") < 360), F.lit(False))
    angle = F.when(moving, axis_difference(F.col("cog"), F.col("axis_bearing_deg")))
    near = head_proximity(d_end, F.greatest(spread_km_h * F.col("nearest_report_min") / 60.0, F.lit(min_ref_km)))
    return j.select(
        "cluster_id", "mmsi", "method", d_end.alias("dist_to_slick_end_km"), near.alias("geo_head_proximity"), angle.alias("heading_vs_axis_deg"), heading_alignment(angle).alias("geo_heading_alignment"),
        F.when(moving, geometry_score(near, heading_alignment(angle))).otherwise(near).alias("geo_fresh_discharge"),
    )


def nearest_report(reports: DataFrame, t_us: int, key: str = "mmsi") -> DataFrame:
    away = F.struct(F.abs(F.col("us") - t_us), F.col("us"))
    return reports.groupBy(key).agg(F.min_by("lon", away).alias("n_lon"), F.min_by("lat", away).alias("n_lat"))


def track_metrics(reports: DataFrame, radius_km: float = 0.5, slow_knots: float = 0.5, key: str = "mmsi") -> DataFrame:
    """Spread of a track about its median position, and speeds; null speeds do not count."""
    middle = reports.groupBy(key).agg(F.median("lon").alias("m_lon"), F.median("lat").alias("m_lat"))
    d = reports.join(middle, key).withColumn("d", haversine_km(F.col("lat"), F.col("lon"), F.col("m_lat"), F.col("m_lon")))
    return d.groupBy(key).agg(
        F.count("*").alias("n_reports"), ((F.max("us") - F.min("us")) / 3.6e9).alias("track_span_h"), F.median("d").alias("p50_spread_km"), F.percentile("d", F.lit(0.9)).alias("position_spread_km"),
        F.max("d").alias("max_excursion_km"), share(F.col("d") <= radius_km).alias("stationarity_score"), F.median("sog").alias("median_sog"), F.avg((F.col("sog") < slow_knots).cast("double")).alias("frac_sog_lt_slow"),
    )


#: State, largest 90 % spread (km), largest excursion (km), least share of slow reports.
STILL = (("stationary", 0.25, 1.0, 0.9), ("loitering", 2.0, 5.0, 0.8))


def motion_state(metrics: DataFrame, still: tuple = STILL, min_reports: int = 10, min_span_h: float = 6.0, mixed: float = 0.5) -> DataFrame:
    """Ordered rules over track metrics, with the reason as text. Without speeds the geometry decides alone."""
    spread, far, slow, fixed = F.col("position_spread_km"), F.col("max_excursion_km"), F.col("frac_sog_lt_slow"), F.col("stationarity_score")
    brief = (F.col("n_reports") < min_reports) | (F.col("track_span_h") < min_span_h)
    moved = far > still[1][2]
    state, why = F.when(brief & moved, "moving").when(brief, "undetermined"), F.when(brief & moved, F.format_string("short track, moved %.1f km", far)).when(brief, "too few reports or hours")
    for name, most, farthest, least in still:
        fits = (spread <= most) & (far <= farthest) & (slow.isNull() | (slow >= least))
        state, why = state.when(fits, name), why.when(fits, F.format_string("90%% within %.2f km, at most %.2f km away", spread, far))
    return metrics.withColumn("motion_state", state.when(fixed >= mixed, "mixed").otherwise("moving")).withColumn("motion_reason", why.when(fixed >= mixed, F.format_string("%.2f of reports at the median position, excursion %.1f km", fixed, far)).otherwise(F.format_string("90%% spread %.2f km", spread)))


def source_type(tracks: DataFrame, near_km: float = 0.5) -> DataFrame:
    """From motion state and the distance to the nearest structure: source_type and its basis."""
    still = F.col("motion_state").isin("stationary", "loitering", "mixed")
    close = F.coalesce(F.col("structure_km") <= near_km, F.lit(False))
    kind = F.when(still & close, "fixed installation").when(still, "stationary vessel").when(F.col("motion_state") == "moving", "vessel under way").otherwise("unknown")
    basis = F.when(still & close, F.format_string("%s, %.2f km from a structure", F.col("motion_state"), F.col("structure_km"))).otherwise(F.col("motion_state"))
    return tracks.withColumn("source_type", kind).withColumn("source_type_basis", basis)


#: Class of SAR darkness, interval in hours.
DARKNESS = {"strong/fresh-looking": (0.0, 6.0), "intermediate": (2.0, 24.0), "weak/weathered-looking": (6.0, 48.0)}


def darkness_class(damping_db: Column, sharpness: Column) -> Column:
    return F.when((damping_db >= 6) & (sharpness >= 0.5), "strong/fresh-looking").when(damping_db >= 3, "intermediate").otherwise("weak/weathered-looking")


def age_cues(events: DataFrame, initial_m: float = 100.0, diffusivities: tuple[float, ...] = (1.0, 3.0, 10.0)) -> DataFrame:
    """(cluster_id, cue, lo_h, hi_h) from slick width, the diffusion diagram, the persistence prior and SAR darkness."""
    w = F.col("width_m")
    ages = [width_age_h(w, initial_m, k) for k in diffusivities]
    dark = lambda k: F.coalesce(*(F.when(F.col("darkness_class") == c, F.lit(v[k])) for c, v in DARKNESS.items()))
    cue = lambda name, lo, hi: F.struct(F.lit(name).alias("cue"), lo.alias("lo_h"), hi.alias("hi_h"))
    cues = F.array(
        cue("width_diffusion", F.least(*ages), F.greatest(*ages)), cue("okubo_1971", okubo_age_h(w), okubo_age_h(w)), cue("persistence_prior", F.lit(2.0), F.lit(12.0)), cue("sar_darkness", dark(0), dark(1)),
    )
    return events.select("cluster_id", F.inline(cues))


def age_summary(cues: DataFrame, best: DataFrame) -> DataFrame:
    """Interval of the best supported suspect's window (cluster_id, start_h, end_h), else of the appearance cues; a
    conflict is a window older than the appearance allows."""
    own = cues.filter(F.col("cue").isin("width_diffusion", "okubo_1971", "persistence_prior")).groupBy("cluster_id").agg(F.min("lo_h").alias("lo"), F.max("hi_h").alias("appearance_age_hi_h"))
    j = own.join(best, "cluster_id", "left")
    return j.select(
        "cluster_id", F.coalesce("start_h", "lo").alias("age_lo_h"), F.coalesce("end_h", "appearance_age_hi_h").alias("age_hi_h"), "appearance_age_hi_h",
        F.coalesce(F.col("start_h") > F.col("appearance_age_hi_h"), F.lit(False)).alias("age_conflict"),
    )


def track_behaviour_rows(reports: DataFrame, t0_us: int, gap_min: float) -> DataFrame:
    """Gap rows with jump distances, for export."""
    return asof.gaps(reports, t0_us - 48 * 3_600_000_000, t0_us, gap_min)

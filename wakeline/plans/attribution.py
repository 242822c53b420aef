"""Queries of the scoring stages: positions, kernel scores, ensembles, backward scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.functions import binning
from wakeline.operators import asof, audit, scoring
from wakeline.plans.registry import query
from wakeline.sources import testdata as td

SIGMA = 50.0


def positions_v2(spark: SparkSession, d: str) -> DataFrame:
    reports = td.window(td.ais(spark, d), td.TOLERANCE)
    return asof.asof_nearest(reports, asof.grid_for(reports, td.times(spark)), td.TOLERANCE)


def interpolated(spark: SparkSession, d: str, cell_us: int | None = None) -> DataFrame:
    reports = td.window(td.ais(spark, d), td.BRACKET)
    return asof.bracket_interpolate(reports, asof.grid_for(reports, td.times(spark)), td.BRACKET, td.EDGE, td.KNOTS, cell_us=cell_us)


def positions_v21(spark: SparkSession, d: str) -> DataFrame:
    return interpolated(spark, d).filter("method <> 'unavailable'").select("mmsi", "t", "lon", "lat")


def cloud(spark: SparkSession, d: str) -> DataFrame:
    return td.derived(spark, d, "part", td.CLOUD)


def ensemble(spark: SparkSession, d: str) -> DataFrame:
    return td.derived(spark, d, "lineitem", td.ENSEMBLE)


def backward(spark: SparkSession, d: str) -> DataFrame:
    return td.derived(spark, d, "lineitem", td.BACKWARD)


@query("ais_clean", f"""WITH {td.AIS_SQL}, dirty AS (
  SELECT event_id, CASE WHEN event_id % 3 = 0 THEN mmsi || '.0' ELSE mmsi END AS mmsi, CASE WHEN event_id % 11 = 0 THEN 'late' ELSE CAST(us AS VARCHAR) END AS us,
    CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 17 = 0 THEN 'x' ELSE CAST(lat AS VARCHAR) END AS lat, CAST(lon AS VARCHAR) AS lon FROM raw_ais)
SELECT event_id, mmsi, us, lat, lon FROM (
  SELECT event_id, regexp_replace(mmsi, '\\.0$', '') AS mmsi, try_cast(us AS BIGINT) AS us, try_cast(lat AS DOUBLE) AS lat, try_cast(lon AS DOUBLE) AS lon,
    row_number() OVER (PARTITION BY regexp_replace(mmsi, '\\.0$', ''), try_cast(us AS BIGINT) ORDER BY event_id) AS n
  FROM dirty WHERE try_cast(us AS BIGINT) IS NOT NULL AND try_cast(lat AS DOUBLE) IS NOT NULL AND mmsi IS NOT NULL) WHERE n = 1""", "lat lon", digits=8)  # fmt: skip
def _(spark, d):
    raw = td.raw_ais(spark, d).selectExpr(
        "event_id", "case when event_id % 3 = 0 then mmsi || '.0' else mmsi end AS mmsi", "case when event_id % 11 = 0 then 'late' else cast(us as string) end AS us",
        "case when event_id % 13 = 0 then null when event_id % 17 = 0 then 'x' else cast(lat AS string) end AS lat", "cast(lon AS string) AS lon",
    )
    return asof.clean_reports(raw, tie="event_id").select("event_id", "mmsi", "us", "lat", "lon")


@query("asof_nearest", f"WITH {td.V2_SQL} SELECT mmsi, t, us, lon, lat FROM pos", "lon lat")
def _(spark, d):
    return positions_v2(spark, d)


@query("asof_nearest_cells", f"WITH {td.V2_SQL} SELECT mmsi, t, us, lon, lat FROM pos", "lon lat")
def _(spark, d):
    reports = td.window(td.ais(spark, d), td.TOLERANCE)
    return asof.asof_nearest(reports, asof.grid_for(reports, td.times(spark)), td.TOLERANCE, cell_us=12 * td.HOUR)


@query("bracket_interpolate", f"WITH {td.V21_ALL_SQL} SELECT * FROM pos21", "lon lat gap_min offset_min", digits=9)
def _(spark, d):
    return interpolated(spark, d)


@query("bracket_interpolate_cells", f"WITH {td.V21_ALL_SQL} SELECT * FROM pos21", "lon lat gap_min offset_min", digits=9)
def _(spark, d):
    return interpolated(spark, d, cell_us=12 * td.HOUR)


@query("state_at", f"""WITH {td.V21_ALL_SQL}, closest AS (
  SELECT mmsi, arg_min(sog, abs(us - {td.T0}) * 2 + CASE WHEN us > {td.T0} THEN 1 ELSE 0 END) AS sog, arg_min(cog, abs(us - {td.T0}) * 2 + CASE WHEN us > {td.T0} THEN 1 ELSE 0 END) AS cog, min(abs(us - {td.T0})) / 6e7 AS nearest_report_min FROM aisw GROUP BY mmsi)
SELECT mmsi, t, method, lon, lat, gap_min, offset_min, sog, cog, nearest_report_min FROM pos21 JOIN closest USING (mmsi) WHERE t = {td.T0}""", "lon lat gap_min offset_min sog cog nearest_report_min", digits=9)  # fmt: skip
def _(spark, d):
    return asof.state_at(td.window(td.ais(spark, d), td.BRACKET), td.T0, td.BRACKET, td.EDGE, td.KNOTS)


@query("track_at", f"""WITH {td.near_sql(td.BRACKET)}
SELECT mmsi, t, CASE WHEN nus = t THEN nlon WHEN nus - pus <= {6 * td.HOUR} THEN plon + (t - pus) / CAST(nus - pus AS DOUBLE) * (nlon - plon) END AS lon,
  CASE WHEN nus = t THEN nlat WHEN nus - pus <= {6 * td.HOUR} THEN plat + (t - pus) / CAST(nus - pus AS DOUBLE) * (nlat - plat) END AS lat FROM near""", "lon lat", digits=9)  # fmt: skip
def _(spark, d):
    reports = td.window(td.ais(spark, d), td.BRACKET)
    return asof.track_at(reports, asof.grid_for(reports, td.times(spark)), 6 * td.HOUR, cell_us=12 * td.HOUR)


@query("ais_gaps", f"""WITH {td.AIS_SQL}, steps AS (
  SELECT mmsi, us AS gap_start, lead(us) OVER w AS gap_end, lon, lat, lead(lon) OVER w AS lon2, lead(lat) OVER w AS lat2 FROM ais WHERE us BETWEEN {td.T1} AND {td.T0} WINDOW w AS (PARTITION BY mmsi ORDER BY us))
SELECT mmsi, gap_start, gap_end, floor((gap_end - gap_start) / 1e6) / 60 AS gap_min, {td.haversine('lat', 'lon', 'lat2', 'lon2')} AS jump_km FROM steps WHERE floor((gap_end - gap_start) / 1e6) / 60 >= 480""", "gap_min jump_km")  # fmt: skip
def _(spark, d):
    return asof.gaps(td.ais(spark, d), td.T1, td.T0, 480.0)


def _stats(sigma: str, d: str = "d") -> str:
    return f"""min({d}) AS min_distance_km, quantile_cont({d}, 0.1) AS p10_distance_km, median({d}) AS median_distance_km, avg(({d} <= 2)::INT) AS fraction_particles_2km,
  avg(({d} <= 5)::INT) AS fraction_particles_5km, avg(({d} <= 10)::INT) AS fraction_particles_10km, avg(exp(-0.5e0 * pow({d} / {sigma}, 2))) AS density_score"""


STATS = "min_distance_km p10_distance_km median_distance_km fraction_particles_2km fraction_particles_5km fraction_particles_10km density_score"
HAV = td.haversine("pos.lat", "pos.lon", "c.p_lat", "c.p_lon")


def _scores(pos: str) -> str:
    return f"{pos}, {td.CLOUD_SQL}, ts AS (SELECT mmsi, t, any_value(lon) AS lon, any_value(lat) AS lat, {_stats(str(SIGMA) + 'e0')} FROM (SELECT mmsi, pos.t AS t, lon, lat, {HAV} AS d FROM pos JOIN cloud c USING (t)) GROUP BY mmsi, t)"


def _placed(scores: DataFrame) -> DataFrame:
    return scores.withColumns({c: F.round(c, 9) + 0.0 for c in ("lon", "lat")})


@query("v2_time_scores", f"WITH {_scores(td.V2_SQL)} SELECT * REPLACE (round(lon, 9) + 0.0 AS lon, round(lat, 9) + 0.0 AS lat) FROM ts", STATS)
def _(spark, d):
    return _placed(scoring.time_scores(positions_v2(spark, d), cloud(spark, d), SIGMA))


@query("v2_1_time_scores", f"WITH {_scores(td.V21_SQL)} SELECT * REPLACE (round(lon, 9) + 0.0 AS lon, round(lat, 9) + 0.0 AS lat) FROM ts", STATS)
def _(spark, d):
    return _placed(scoring.time_scores(positions_v21(spark, d), cloud(spark, d), SIGMA))


SUMMARY_SQL = f"""summary AS (
  SELECT mmsi, count(*) AS matched_hours, count(*) / {td.N_TIMES}e0 AS coverage_fraction, max(density_score) AS point_release_score, avg(density_score) AS continuous_release_score,
    min(t) FILTER (WHERE pr = 1) AS peak_time, min(min_distance_km) FILTER (WHERE pr = 1) AS peak_min_distance_km, min(p10_distance_km) FILTER (WHERE pr = 1) AS peak_p10_distance_km, min(min_distance_km) AS best_min_distance_km,
    min(p10_distance_km) AS best_p10_distance_km, count(*) FILTER (WHERE density_score >= 0.05) AS hours_density_gt_005, count(*) FILTER (WHERE density_score >= 0.10) AS hours_density_gt_01
  FROM (SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY round(density_score, 6) DESC, t) AS pr FROM ts) GROUP BY mmsi)"""


@query("v2_summary", f"""WITH {_scores(td.V2_SQL)}, {SUMMARY_SQL}
SELECT *, CAST(rank() OVER (ORDER BY round(point_release_score, 6) DESC) AS INT) AS point_rank, CAST(rank() OVER (ORDER BY round(continuous_release_score, 6) DESC) AS INT) AS continuous_rank FROM summary""",
    "coverage_fraction point_release_score continuous_release_score peak_min_distance_km peak_p10_distance_km best_min_distance_km best_p10_distance_km")
def v2_summary(spark, d):
    return scoring.summarise(scoring.time_scores(positions_v2(spark, d), cloud(spark, d), SIGMA), td.N_TIMES)


@query("v1_scores", f"""WITH {_scores(td.V2_SQL)} SELECT mmsi, max(exp(-0.5e0 * pow(min_distance_km / {SIGMA}e0, 2))) * count(*) / {td.N_TIMES}e0 AS v1_score, count(*) FILTER (WHERE min_distance_km <= 5) AS hours_5km FROM ts GROUP BY mmsi""", "v1_score")
def _(spark, d):
    return scoring.minimum_distance_scores(scoring.time_scores(positions_v2(spark, d), cloud(spark, d), SIGMA), SIGMA, td.N_TIMES)


def _bin(x: str) -> str:
    edges = binning.AGE_EDGES
    return "CASE " + " ".join(f"WHEN {x} {'>=' if k == 0 else '>'} {edges[k]} AND {x} <= {edges[k + 1]} THEN '{label}'" for k, label in enumerate(binning.AGE_LABELS)) + " END"


AGED = f"aged AS (SELECT *, ({td.T0} - t) / 3.6e9 AS age_h, {_bin(f'(({td.T0} - t) / 3.6e9)')} AS release_age_bin FROM ts)"


def _age_table(name: str) -> str:
    return f"""{AGED}, {name} AS (SELECT *, CAST(rank() OVER (PARTITION BY release_age_bin ORDER BY round(peak_density_score, 6) DESC) AS INT) AS rank_in_age_bin FROM (
  SELECT mmsi, release_age_bin, count(*) AS matched_hours_in_bin, max(density_score) AS peak_density_score, avg(density_score) AS mean_density_score,
    min(age_h) FILTER (WHERE pr = 1) AS peak_age_hours, min(min_distance_km) FILTER (WHERE pr = 1) AS peak_min_distance_km
  FROM (SELECT *, row_number() OVER (PARTITION BY mmsi, release_age_bin ORDER BY round(density_score, 6) DESC, t) AS pr FROM aged WHERE release_age_bin IS NOT NULL) GROUP BY mmsi, release_age_bin))"""


@query("release_age", f"WITH {_scores(td.V2_SQL)}, {_age_table('a')} SELECT * FROM a", "peak_density_score mean_density_score peak_age_hours peak_min_distance_km")
def release_age(spark, d):
    return scoring.release_age_table(scoring.time_scores(positions_v2(spark, d), cloud(spark, d), SIGMA), td.T0)


@query("v2_vs_v2_1", f"""WITH {_scores(td.V2_SQL)}, {_age_table('a')}, b AS (SELECT mmsi, release_age_bin, peak_density_score, rank_in_age_bin FROM ({f'WITH {_scores(td.V21_SQL)}, ' + _age_table('a21') + ' SELECT * FROM a21'})),
j AS (SELECT coalesce(a.mmsi, b.mmsi) AS mmsi, coalesce(a.release_age_bin, b.release_age_bin) AS bin, a.peak_density_score AS s1, b.peak_density_score AS s2, a.rank_in_age_bin AS r1, b.rank_in_age_bin AS r2
  FROM a FULL JOIN b ON a.mmsi = b.mmsi AND a.release_age_bin = b.release_age_bin),
both_ AS (SELECT *, rank() OVER (PARTITION BY bin ORDER BY round(s1, 6)) + (count(*) OVER (PARTITION BY bin, round(s1, 6)) - 1) / 2e0 AS q1, rank() OVER (PARTITION BY bin ORDER BY round(s2, 6)) + (count(*) OVER (PARTITION BY bin, round(s2, 6)) - 1) / 2e0 AS q2 FROM j WHERE s1 IS NOT NULL AND s2 IS NOT NULL)
SELECT bin, n_v2, n_v2_1, spearman, top10_overlap, max_rank_change FROM (SELECT bin, count(s1) AS n_v2, count(s2) AS n_v2_1, count(*) FILTER (WHERE r1 <= 10 AND r2 <= 10) AS top10_overlap, max(abs(r1 - r2)) FILTER (WHERE r1 <= 10) AS max_rank_change FROM j GROUP BY bin)
JOIN (SELECT bin, corr(q1, q2) AS spearman FROM both_ GROUP BY bin) USING (bin)""", "spearman")  # fmt: skip
def _(spark, d):
    tables = [scoring.release_age_table(scoring.time_scores(p(spark, d), cloud(spark, d), SIGMA), td.T0) for p in (positions_v2, positions_v21)]
    return audit.compare_rankings(*tables, "mmsi", "release_age_bin", "peak_density_score", "rank_in_age_bin")


SCENARIO_SQL = f"""{td.V2_SQL}, {td.ENSEMBLE_SQL}, ts AS (SELECT scenario_id, mmsi, t, avg(exp(-0.5e0 * pow(d / {SIGMA}e0, 2))) AS density_score FROM (SELECT scenario_id, mmsi, pos.t AS t, {HAV} AS d FROM pos JOIN ens c USING (t)) GROUP BY scenario_id, mmsi, t),
{AGED}, sc AS (SELECT *, CAST(rank() OVER (PARTITION BY scenario_id, release_age_bin ORDER BY round(point_score, 6) DESC) AS INT) AS scenario_rank FROM (
  SELECT scenario_id, mmsi, release_age_bin, count(*) AS matched_hours, max(density_score) AS point_score, avg(density_score) AS mean_score, min(age_h) FILTER (WHERE pr = 1) AS peak_age_hours
  FROM (SELECT *, row_number() OVER (PARTITION BY scenario_id, mmsi, release_age_bin ORDER BY round(density_score, 6) DESC, t) AS pr FROM aged WHERE release_age_bin IS NOT NULL) GROUP BY scenario_id, mmsi, release_age_bin))"""


@query("ensemble_scenarios", f"WITH {SCENARIO_SQL} SELECT * FROM sc", "point_score mean_score peak_age_hours")
def _(spark, d):
    return scoring.scenario_scores(positions_v2(spark, d), ensemble(spark, d), td.T0, SIGMA)


def _quantiles(name: str, c: str, mean: bool = True) -> str:
    return (f"avg({c}) AS {name}_mean, " if mean else "") + f"median({c}) AS {name}_median, quantile_cont({c}, 0.1) AS {name}_q10, quantile_cont({c}, 0.9) AS {name}_q90"


@query("ensemble_robust", f"""WITH {SCENARIO_SQL} SELECT mmsi, release_age_bin, count(DISTINCT scenario_id) AS scenarios_evaluated, {_quantiles('score', 'point_score')}, {_quantiles('rank', 'scenario_rank')}, {_quantiles('peak_age', 'peak_age_hours', False)},
  avg((scenario_rank <= 1)::INT) AS top1_fraction, avg((scenario_rank <= 3)::INT) AS top3_fraction, avg((scenario_rank <= 5)::INT) AS top5_fraction, avg((scenario_rank <= 10)::INT) AS top10_fraction FROM sc GROUP BY mmsi, release_age_bin""",
    "score_mean score_median score_q10 score_q90 rank_mean rank_median rank_q10 rank_q90 peak_age_median peak_age_q10 peak_age_q90 top1_fraction top3_fraction top5_fraction top10_fraction")
def ensemble_robust(spark, d):
    sc = scoring.scenario_scores(positions_v2(spark, d), ensemble(spark, d), td.T0, SIGMA)
    return scoring.robust_table(sc, ["mmsi", "release_age_bin"], "scenario_id", "point_score", "scenario_rank")


BWD_SQL = f"""{td.V21_SQL}, {td.BACKWARD_SQL}, box AS (
  SELECT *, sqrt(1e0 + pow(tau_h * 0.18e0, 2)) AS sigma FROM (SELECT cluster_id, member, t, ({td.T0} - t) / 3.6e9 AS tau_h, min(p_lon) AS x0, max(p_lon) AS x1, min(p_lat) AS y0, max(p_lat) AS y1, avg(p_lat) AS y FROM bwd GROUP BY cluster_id, member, t)),
pairs AS (SELECT b.cluster_id, b.member, mmsi, b.t, tau_h, sigma, {HAV} AS d FROM pos JOIN box b ON pos.t = b.t AND lon BETWEEN x0 - 6 * sigma / (111.32e0 * cos(radians(y))) AND x1 + 6 * sigma / (111.32e0 * cos(radians(y))) AND lat BETWEEN y0 - 6 * sigma / 110.54e0 AND y1 + 6 * sigma / 110.54e0
  JOIN bwd c ON c.cluster_id = b.cluster_id AND c.member = b.member AND c.t = b.t),
bs AS (SELECT cluster_id, member, mmsi, t, tau_h, avg(exp(-0.5e0 * pow(d / sigma, 2))) AS density, min(d) AS min_distance_km, min(d) <= 3 * any_value(sigma) AS gate_hit FROM pairs GROUP BY cluster_id, member, mmsi, t, tau_h)"""


def backward_scores(spark, d):
    return scoring.backward_scores(positions_v21(spark, d), backward(spark, d), td.T0)


@query("backward_scores", f"WITH {BWD_SQL} SELECT * FROM bs", "tau_h density min_distance_km")
def _(spark, d):
    return backward_scores(spark, d)


MEMBER_SQL = f"""{BWD_SQL}, mem AS (SELECT *, CAST(rank() OVER (PARTITION BY cluster_id, member ORDER BY round(s_weighted, 6) DESC) AS INT) AS rank_weighted, CAST(rank() OVER (PARTITION BY cluster_id, member ORDER BY round(s_point, 6) DESC) AS INT) AS rank_point FROM (
  SELECT cluster_id, member, mmsi, count(*) AS positions, bool_or(gate_hit) AS gate_hit, max(density) AS s_point, sum(exp(-round(tau_h) / 12e0) * density) / (SELECT sum(exp(-k / 12e0)) FROM range(49) g(k)) AS s_weighted,
    min(tau_h) FILTER (WHERE pr = 1) AS peak_age_hours, min(min_distance_km) FILTER (WHERE pr = 1) AS peak_min_distance_km
  FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id, member, mmsi ORDER BY round(density, 6) DESC, tau_h DESC) AS pr FROM bs) GROUP BY cluster_id, member, mmsi))"""


@query("backward_members", f"WITH {MEMBER_SQL} SELECT * FROM mem", "s_point s_weighted peak_age_hours peak_min_distance_km")
def _(spark, d):
    return scoring.backward_members(backward_scores(spark, d))


ROBUST_SQL = f"""{MEMBER_SQL}, positioned AS (SELECT mmsi, count(*) AS positions FROM pos GROUP BY mmsi), rob AS (
  SELECT *, gate_hit AND coalesce(positions, 0) >= 2 AS passes_funnel FROM (SELECT cluster_id, mmsi, bool_or(gate_hit) AS gate_hit, count(DISTINCT member) AS members, median(s_weighted) AS bwd_weighted, quantile_cont(s_weighted, 0.1) AS bwd_weighted_q10, quantile_cont(s_weighted, 0.9) AS bwd_weighted_q90,
    median(s_point) AS bwd_point, median(rank_weighted) AS bwd_rank_median, avg((rank_weighted <= 1)::INT) AS bwd_top1_fraction, avg((rank_weighted <= 3)::INT) AS bwd_top3_fraction, avg((rank_weighted <= 5)::INT) AS bwd_top5_fraction, median(peak_age_hours) AS bwd_peak_age_median, median(rank_point) AS bwd_point_rank_median, median(peak_min_distance_km) AS bwd_peak_min_distance_km FROM mem GROUP BY cluster_id, mmsi) LEFT JOIN positioned USING (mmsi))"""
ROBUST = "bwd_weighted bwd_weighted_q10 bwd_weighted_q90 bwd_point bwd_rank_median bwd_top1_fraction bwd_top3_fraction bwd_top5_fraction bwd_peak_age_median bwd_point_rank_median bwd_peak_min_distance_km"


def positioned(spark, d):
    return positions_v21(spark, d).groupBy("mmsi").agg(F.count("*").alias("positions"))


def robust(spark, d):
    return scoring.backward_robust(scoring.backward_members(backward_scores(spark, d)), positioned(spark, d))


@query("backward_robust", f"WITH {ROBUST_SQL} SELECT * FROM rob", ROBUST)
def _(spark, d):
    return robust(spark, d)


@query("backward_bins", f"""WITH {BWD_SQL}, best AS (SELECT cluster_id, member, mmsi, release_age_bin, max(density) AS density FROM (SELECT *, {_bin('tau_h')} AS release_age_bin FROM bs) WHERE release_age_bin IS NOT NULL GROUP BY ALL),
r AS (SELECT *, rank() OVER (PARTITION BY cluster_id, member, release_age_bin ORDER BY round(density, 6) DESC) AS rk FROM best)
SELECT cluster_id, mmsi, release_age_bin, median(density) AS density_median, median(rk) AS rank_median, avg((rk <= 5)::INT) AS top5_fraction FROM r GROUP BY ALL""", "density_median rank_median top5_fraction")  # fmt: skip
def _(spark, d):
    return scoring.backward_bins(backward_scores(spark, d))


@query("funnel", f"""WITH {ROBUST_SQL} SELECT cluster_id, (SELECT count(*) FROM positioned) AS ais_vessels_in_window, (SELECT count(*) FROM positioned WHERE positions >= 2) AS positioned_ge_min_hours,
  count(*) FILTER (WHERE passes_funnel) AS within_gate_of_backward_cloud FROM rob GROUP BY cluster_id""")  # fmt: skip
def _(spark, d):
    return scoring.funnel(robust(spark, d), positioned(spark, d))


@query("cloud_summary", f"WITH {td.BACKWARD_SQL} SELECT cluster_id, member, t, avg(p_lon) AS lon, avg(p_lat) AS lat, stddev_samp(p_lon) AS lon_std, stddev_samp(p_lat) AS lat_std, count(*) AS n FROM bwd GROUP BY ALL", "lon lat lon_std lat_std", digits=9)
def _(spark, d):
    return scoring.cloud_summary(backward(spark, d))

"""Queries of the evidence, matching, event, forward, forecast, fusion and audit operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.operators import asof, audit, events, evidence, forecast, forward, fusion, matching
from wakeline.plans.registry import query
from wakeline.sources import testdata as td

GAP_MIN = 480.0
RADII = {"moving_km": 15.0, "stationary_km": 10.0, "platform_km": 8.0}
LINK_M, HIT_KM, CELL = 6000.0, 2.0, 0.02

FORECAST = {
    "cluster_id": "cast(l_orderkey % 5 as int)", "run": "cast(l_suppkey % 3 as int)", "element": "l_partkey", "lead_h": "cast(l_linenumber * 6 as int)", "status": "case when l_returnflag = 'R' then 'stranded' else 'active' end",
    "oil_type": "l_linestatus", "mass_oil": "l_quantity * 1e0", "mass_evaporated": "l_quantity * l_discount * 1e0", "mass_dispersed": "l_quantity * l_tax * 1e0",
    "lon": "-93e0 + ((l_partkey * 37) % 500) * 1e-2 + 3e-3", "lat": "25e0 + ((l_orderkey * 91) % 300) * 1e-2 + 3e-3",
}
OIL = {
    "cluster_id": "cast(l_orderkey % 5 as int)", "mmsi": "cast(l_suppkey % 20 as {string})", "member": "l_linenumber", "pid": "l_orderkey * 10 + l_linenumber", "hour": "cast((l_partkey + l_linenumber) % 48 as int)",
    "lon": "-93e0 + ((l_partkey * 37) % 100) * 1e-2", "lat": "25e0 + ((l_orderkey * 91) % 100) * 1e-2",
}
SAMPLE = {"cluster_id": "cast(p_partkey % 5 as int)", "sid": "p_partkey", "lon": "-93e0 + ((p_partkey * 53) % 997) * 1e-3", "lat": "25e0 + ((p_partkey * 29) % 991) * 1e-3"}
SUSPECT = {
    "cluster_id": "cast(s_suppkey % 7 as int)", "mmsi": "cast(s_suppkey as {string})", "fwd_f": "((s_suppkey * 37) % 101) / 101e0", "bwd_point": "((s_suppkey * 53) % 97) / 97e0",
    "member_support": "case when s_suppkey % 9 = 0 then null else ((s_suppkey * 17) % 89) / 89e0 end", "combined": "((s_suppkey * 71) % 103) / 103e0",
}
MEMBER = {"tile": "l_suppkey % 20", "cluster": "l_partkey % 7", "object": "case when l_orderkey % 3 = 0 then l_orderkey % 5 else l_partkey % 7 end", "area": "l_quantity * 1e0"}


def components(spark: SparkSession, d: str) -> DataFrame:
    return td.derived(spark, d, "customer", td.COMPONENT).withColumnRenamed("component_id", "id")


def detections(spark: SparkSession, d: str) -> DataFrame:
    return td.derived(spark, d, "customer", td.DETECTION)


def platforms(spark: SparkSession, d: str) -> DataFrame:
    return td.derived(spark, d, "supplier", td.PLATFORM)


def states(spark: SparkSession, d: str) -> DataFrame:
    return asof.state_at(td.window(td.ais(spark, d), td.BRACKET), td.T0, td.BRACKET, td.EDGE, td.KNOTS).filter("method <> 'unavailable'")


def particles(spark: SparkSession, d: str) -> DataFrame:
    return td.derived(spark, d, "lineitem", FORECAST)


def sql_of(name: str, table: str, spec: dict[str, str]) -> str:
    return f"{name} AS (SELECT {td.columns(spec)} FROM {table})"


PARTS_SQL = f"parts AS (SELECT component_id AS id, * EXCLUDE (component_id) FROM (SELECT {td.columns(td.COMPONENT)} FROM customer))"
CAST_SQL, OIL_SQL, SAMPLE_SQL = sql_of("fc", "lineitem", FORECAST), sql_of("oil", "lineitem", OIL), sql_of("sam", "part", SAMPLE)


@query("behaviour", f"""WITH {td.AIS_SQL}, s1 AS (SELECT mmsi, us, lat, lon, lag(us) OVER w AS pus, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM ais WHERE us BETWEEN {td.T1} AND {td.T0} WINDOW w AS (PARTITION BY mmsi ORDER BY us)),
s2 AS (SELECT *, floor((us - pus) / 1e6) AS secs, {td.haversine('plat', 'plon', 'lat', 'lon')} AS km FROM s1)
SELECT mmsi, count(*) AS ais_reports_48h, count(*) FILTER (WHERE secs / 60 >= {GAP_MIN}) AS ais_gaps, coalesce(max(secs / 60) FILTER (WHERE secs / 60 >= {GAP_MIN}), 0) AS ais_longest_gap_min, ({td.T0} - max(us)) / 6e7 AS ais_last_report_before_t0_min,
  count(*) FILTER (WHERE secs > 0 AND km / 1.852e0 / (secs / 3600) > 50) AS ais_speed_jumps, regexp_matches(mmsi, '^[2-7][0-9]{{8}}$') AS mmsi_standard, count(*) FILTER (WHERE secs / 60 >= {GAP_MIN} AND ({td.T0} - us) / 3.6e9 < 24 AND ({td.T0} - pus) / 3.6e9 > 6) > 0 AS gap_in_window FROM s2 GROUP BY mmsi""",
    "ais_longest_gap_min ais_last_report_before_t0_min")
def behaviour(spark, d):
    out = evidence.behaviour(td.ais(spark, d), td.T0, gap_min=GAP_MIN)
    return out.withColumn("gap_in_window", evidence.gap_overlaps(F.col("gaps"), F.lit(6.0), F.lit(24.0))).drop("gaps")


METRIC_SQL = f"""{td.AIS_SQL}, aisw AS (SELECT * FROM ais WHERE us BETWEEN {td.T1} AND {td.T0}), mid AS (SELECT mmsi, median(lon) AS m_lon, median(lat) AS m_lat FROM aisw GROUP BY mmsi), far AS (SELECT a.*, {td.haversine('lat', 'lon', 'm_lat', 'm_lon')} AS d FROM aisw a JOIN mid USING (mmsi)),
met AS (SELECT mmsi, count(*) AS n_reports, (max(us) - min(us)) / 3.6e9 AS track_span_h, median(d) AS p50_spread_km, quantile_cont(d, 0.9) AS position_spread_km, max(d) AS max_excursion_km, avg((d <= 20)::INT) AS stationarity_score, median(sog) AS median_sog, avg((sog < 20)::INT) AS frac_sog_lt_slow FROM far GROUP BY mmsi)"""
METRICS = "track_span_h p50_spread_km position_spread_km max_excursion_km stationarity_score median_sog frac_sog_lt_slow"
STILL = (("stationary", 20.0, 100.0, 0.1), ("loitering", 60.0, 600.0, 0.1))


def metrics(spark, d):
    return evidence.track_metrics(td.window(td.ais(spark, d)), 20.0, 20.0)


@query("track_metrics", f"WITH {METRIC_SQL} SELECT * FROM met", METRICS)
def _(spark, d):
    return metrics(spark, d)


def _rung(k: int) -> str:
    name, most, farthest, least = STILL[k]
    return f"WHEN position_spread_km <= {most} AND max_excursion_km <= {farthest} AND (frac_sog_lt_slow IS NULL OR frac_sog_lt_slow >= {least}) THEN '{name}'"


MOTION_SQL = f"""{METRIC_SQL}, mot AS (SELECT mmsi, CASE WHEN (n_reports < 10 OR track_span_h < 6) AND max_excursion_km > {STILL[1][2]} THEN 'moving' WHEN n_reports < 10 OR track_span_h < 6 THEN 'undetermined'
  {_rung(0)} {_rung(1)} WHEN stationarity_score >= 0.5 THEN 'mixed' ELSE 'moving' END AS motion_state FROM met)"""


@query("motion_state", f"WITH {MOTION_SQL} SELECT *, true AS has_reason FROM mot")
def _(spark, d):
    return evidence.motion_state(metrics(spark, d), STILL).select("mmsi", "motion_state", (F.length("motion_reason") > 0).alias("has_reason"))


STATE_SQL = f"""{td.V21_ALL_SQL}, closest AS (SELECT mmsi, arg_min(sog, abs(us - {td.T0}) * 2 + CASE WHEN us > {td.T0} THEN 1 ELSE 0 END) AS sog FROM aisw GROUP BY mmsi),
st AS (SELECT mmsi, lon AS s_lon, lat AS s_lat, sog FROM pos21 JOIN closest USING (mmsi) WHERE t = {td.T0} AND method <> 'unavailable')"""
MATCH_SQL = f"""{STATE_SQL}, {sql_of('det', 'customer', td.DETECTION)}, plat AS (SELECT id, lon AS s_lon, lat AS s_lat FROM (SELECT {td.columns(td.PLATFORM)} FROM supplier)),
n1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY det_id ORDER BY km, mmsi) AS n FROM (SELECT det_id, mmsi, sog, s_lon, s_lat, {td.haversine('lat', 'lon', 's_lat', 's_lon')} AS km FROM det, st) WHERE km <= 15) WHERE n = 1),
n2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY det_id ORDER BY km, id) AS n FROM (SELECT det_id, id, s_lon, s_lat, {td.haversine('lat', 'lon', 's_lat', 's_lon')} AS km FROM det, plat) WHERE km <= 8) WHERE n = 1),
best AS (SELECT det_id, CASE WHEN coalesce(sog >= 0.5, false) THEN 'ais_moving' ELSE 'ais_stationary' END AS label, mmsi AS match_id, km, s_lon, s_lat, 0 AS o FROM n1 WHERE km <= CASE WHEN coalesce(sog >= 0.5, false) THEN 15 ELSE 10 END
  UNION ALL SELECT det_id, 'platform_no_ais', CAST(id AS VARCHAR), km, s_lon, s_lat, 1 FROM n2),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY det_id ORDER BY o) AS n FROM best) WHERE n = 1),
mat AS (SELECT det.det_id, lon, lat, coalesce(label, 'dark_vessel_candidate') AS label, match_id, km AS match_km, (lon - s_lon) * 111320e0 * cos(radians(s_lat)) AS d_lon_m, (lat - s_lat) * 110540e0 AS d_lat_m FROM det LEFT JOIN one USING (det_id))"""


def matched(spark, d):
    return matching.match_detections(detections(spark, d), states(spark, d), platforms(spark, d), **RADII)


@query("match_detections", f"WITH {MATCH_SQL} SELECT * FROM mat", "lon lat match_km d_lon_m d_lat_m", digits=4)
def _(spark, d):
    return matched(spark, d)


@query("geolocation_offset", f"""WITH {MATCH_SQL} SELECT count(*) AS n, median(d_lon_m) AS median_dx_m, median(d_lat_m) AS median_dy_m, median(sqrt(d_lon_m * d_lon_m + d_lat_m * d_lat_m)) AS median_abs_offset_m,
  quantile_cont(sqrt(d_lon_m * d_lon_m + d_lat_m * d_lat_m), 0.9) AS p90_abs_offset_m FROM mat WHERE label IN ('ais_stationary', 'platform_no_ais')""", "median_dx_m median_dy_m median_abs_offset_m p90_abs_offset_m", digits=4)  # fmt: skip
def _(spark, d):
    return matching.geolocation_offset(matched(spark, d))


@query("silent_entities", f"""WITH {td.AIS_SQL}, l AS (SELECT mmsi, max(us) AS u FROM ais WHERE us >= {td.T0 - 96 * td.HOUR} AND us < {td.T0 - 12 * td.HOUR} AND mmsi NOT IN (SELECT mmsi FROM ais WHERE us BETWEEN {td.T0 - 12 * td.HOUR} AND {td.T0 + 12 * td.HOUR}) GROUP BY mmsi),
r AS (SELECT a.*, ({td.T0} - us) / 3.6e9 AS h, coalesce(sog, 0) * 1.852e0 * ({td.T0} - us) / 3.6e9 AS km FROM ais a JOIN l ON a.mmsi = l.mmsi AND a.us = l.u)
SELECT mmsi, h * 60 AS last_min, km AS dr_km, lon + km * sin(radians(coalesce(cog, 0))) / (111.32e0 * cos(radians(lat))) AS lon, lat + km * cos(radians(coalesce(cog, 0))) / 110.54e0 AS lat FROM r""", "last_min dr_km lon lat")  # fmt: skip
def _(spark, d):
    return matching.silent_entities(td.ais(spark, d), td.T0, 12 * td.HOUR, 96 * td.HOUR)


@query("distance_table", f"""WITH {sql_of('det', 'customer', td.DETECTION)}, plat AS (SELECT {td.columns(td.PLATFORM)} FROM supplier)
SELECT * FROM (SELECT id AS cluster_id, det_id, {td.haversine('det.lat', 'det.lon', 'plat.lat', 'plat.lon')} AS dist_km, {td.haversine('det.lat', 'det.lon', 'plat.lat', 'plat.lon')} <= 2 AS near FROM det, plat) WHERE dist_km <= 25""", "dist_km")  # fmt: skip
def _(spark, d):
    return matching.distance_table(platforms(spark, d).withColumnRenamed("id", "cluster_id"), detections(spark, d))


PAIR_SQL = f"""{PARTS_SQL}, pr AS (SELECT a.id AS a, b.id AS b, sqrt((a.x_m - b.x_m) ** 2 + (a.y_m - b.y_m) ** 2) AS gap, least((((a.bearing - b.bearing) % 180) + 180) % 180, 180 - (((a.bearing - b.bearing) % 180) + 180) % 180) AS turn FROM parts a JOIN parts b ON a.id < b.id WHERE sqrt((a.x_m - b.x_m) ** 2 + (a.y_m - b.y_m) ** 2) <= {LINK_M})"""


@query("near_pairs", f"WITH {PAIR_SQL} SELECT * FROM pr", "gap turn")
def _(spark, d):
    return events.near_pairs(components(spark, d), LINK_M)


LINK_SQL = f"""{PAIR_SQL}, e AS (SELECT a, b FROM pr UNION ALL SELECT b, a FROM pr), reach(id, c) AS (SELECT id, id FROM parts UNION SELECT e.b, reach.c FROM reach JOIN e ON reach.id = e.a), comp AS (SELECT id, min(c) AS component FROM reach GROUP BY id)"""


@query("link", f"WITH RECURSIVE {LINK_SQL} SELECT * FROM comp")
def _(spark, d):
    return events.link(components(spark, d), LINK_M)


EVENT_SQL = f"""{LINK_SQL}, ev AS (SELECT component, count(*) AS n_parts, sum(area_m2) AS area_m2, sum(prob_mean * area_m2) / sum(area_m2) AS confidence, max(prob_mean) AS prob_max, sum(x_m * area_m2) / sum(area_m2) AS x_m, sum(y_m * area_m2) / sum(area_m2) AS y_m,
    CASE WHEN count(*) >= 2 THEN sqrt(sum(area_m2 * cos(2 * radians(bearing))) ** 2 + sum(area_m2 * sin(2 * radians(bearing))) ** 2) / sum(area_m2) END AS coherence, string_agg(id::VARCHAR, ',' ORDER BY id) AS component_ids, (component % 15) * 1e0 AS wind_speed FROM parts JOIN comp USING (id) GROUP BY component),
ev2 AS (SELECT *, CASE WHEN wind_speed BETWEEN 2.5 AND 10 THEN 'ok' WHEN wind_speed BETWEEN 1.5 AND 12 THEN 'marginal' ELSE 'unsuitable' END AS wind_class, concat_ws('; ', CASE WHEN area_m2 < 23000 THEN 'area below the detector''s reliable size' END, CASE WHEN NOT (x_m BETWEEN 10000 AND 390000 AND y_m BETWEEN 10000 AND 390000) THEN 'outside the domain' END) AS ineligible_reason FROM ev),
ev3 AS (SELECT *, ineligible_reason = '' AS eligible, confidence * CASE wind_class WHEN 'ok' THEN 1e0 WHEN 'marginal' THEN 0.5e0 ELSE 0.2e0 END * (1 - exp(-area_m2 / 1e5)) AS slick_potential FROM ev2)"""


@query("build_events", f"""WITH RECURSIVE {EVENT_SQL} SELECT *, CAST(row_number() OVER (ORDER BY round(slick_potential, 6) DESC, component) AS INT) AS potential_rank, eligible AND row_number() OVER (PARTITION BY eligible ORDER BY round(slick_potential, 6) DESC, component) <= 12 AS selected FROM ev3""",
    "area_m2 confidence prob_max x_m y_m coherence wind_speed slick_potential", digits=4)
def _(spark, d):
    p = components(spark, d)
    return events.build_events(p, events.link(p, LINK_M), (F.col("component") % 15).cast("double"))


@query("nearest_other", f"""WITH {PAIR_SQL}, bo AS (SELECT a AS id, b AS other, gap FROM pr UNION ALL SELECT b, a, gap FROM pr), n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY gap, other) AS k FROM bo)
SELECT parts.id, other, gap FROM parts LEFT JOIN (SELECT * FROM n WHERE k = 1) n ON n.id = parts.id""", "gap")  # fmt: skip
def _(spark, d):
    return events.nearest_other(components(spark, d), LINK_M)


@query("area_sweep", f"WITH {PARTS_SQL} SELECT a_min_m2, count(*) FILTER (WHERE area_m2 >= a_min_m2) AS n_kept, count(*) FILTER (WHERE area_m2 < a_min_m2 AND prob_mean < 0.5) AS bad_removed, sum(CASE WHEN area_m2 >= a_min_m2 THEN area_m2 ELSE 0 END) / sum(area_m2) AS area_share FROM parts, (VALUES (5e3), (23e3), (6e4)) v(a_min_m2) GROUP BY a_min_m2", "area_share a_min_m2")
def _(spark, d):
    return events.area_sweep(components(spark, d), (5e3, 23e3, 6e4), F.col("prob_mean") >= 0.5)


@query("cluster_quality", f"""WITH {sql_of('m', 'lineitem', MEMBER)}, c AS (SELECT tile, cluster, object, sum(area) AS area FROM m GROUP BY ALL), bc AS (SELECT max(area) AS best, sum(area) AS w, count(*) AS k FROM c GROUP BY tile, cluster), bo AS (SELECT max(area) AS best, sum(area) AS w, count(*) AS k FROM c GROUP BY tile, object)
SELECT * FROM (SELECT count(*) AS n_clusters, sum(best) / sum(w) AS purity, avg((k > 1)::INT) AS mixed_rate FROM bc), (SELECT count(*) AS n_objects, sum(best) / sum(w) AS recovery, avg((k > 1)::INT) AS split_rate FROM bo)""", "purity mixed_rate recovery split_rate")  # fmt: skip
def _(spark, d):
    return events.cluster_quality(td.derived(spark, d, "lineitem", MEMBER))


@query("probability_grid", f"""WITH {CAST_SQL}, g AS (SELECT cluster_id, lead_h, CAST(floor(lon / {CELL}e0) AS BIGINT) AS ix, CAST(floor(lat / {CELL}e0) AS BIGINT) AS iy, count(*) AS n FROM fc WHERE status <> 'stranded' GROUP BY ALL)
SELECT *, n / sum(n) OVER (PARTITION BY cluster_id, lead_h) AS probability, (ix + 0.5e0) * {CELL} AS lon, (iy + 0.5e0) * {CELL} AS lat FROM g""", "probability lon lat")  # fmt: skip
def _(spark, d):
    return forecast.probability_grid(particles(spark, d), CELL)


@query("beaching", f"WITH {CAST_SQL}, f AS (SELECT cluster_id, run, element, min(lead_h) FILTER (WHERE status = 'stranded') AS h FROM fc GROUP BY ALL) SELECT cluster_id, avg((h IS NOT NULL)::INT) AS p_beached, min(h) AS earliest_beaching_h, median(h) AS median_beaching_h FROM f GROUP BY cluster_id", "p_beached median_beaching_h")
def _(spark, d):
    return forecast.beaching(particles(spark, d))


@query("mass_budget", f"""WITH {CAST_SQL}, s AS (SELECT run, oil_type, lead_h, sum(mass_oil) AS o, sum(mass_evaporated) AS e, sum(mass_dispersed) AS p FROM fc GROUP BY ALL), i AS (SELECT *, first_value(o + e + p) OVER (PARTITION BY run ORDER BY oil_type, lead_h) AS initial FROM s)
SELECT run, oil_type, lead_h, initial, o / initial AS frac_oil, e / initial AS frac_evaporated, p / initial AS frac_dispersed FROM i""", "initial frac_oil frac_evaporated frac_dispersed")  # fmt: skip
def _(spark, d):
    return forecast.mass_budget(particles(spark, d))


@query("centroid_track", f"WITH {CAST_SQL} SELECT cluster_id, lead_h, avg(lon) AS lon, avg(lat) AS lat, quantile_cont(lon, 0.1) AS lon_p10, quantile_cont(lon, 0.9) AS lon_p90, quantile_cont(lat, 0.1) AS lat_p10, quantile_cont(lat, 0.9) AS lat_p90 FROM fc WHERE status <> 'stranded' GROUP BY ALL", "lon lat lon_p10 lon_p90 lat_p10 lat_p90")
def _(spark, d):
    return forecast.centroid_track(particles(spark, d))


@query("coverage", f"WITH {CAST_SQL}, b AS (SELECT cluster_id, lead_h, count(*) AS n, count(*) FILTER (WHERE status = 'stranded') AS k FROM fc GROUP BY ALL) SELECT cluster_id, lead_h, n, CAST(sum(k) OVER (PARTITION BY cluster_id ORDER BY lead_h) AS BIGINT) AS out_so_far FROM b")
def _(spark, d):
    return forecast.coverage(particles(spark, d))


@query("endpoint_spread", f"""WITH {CAST_SQL}, m AS (SELECT cluster_id, count(*) AS n, avg(lon) AS m_lon, avg(lat) AS m_lat, var_samp(lon) AS vx, var_samp(lat) AS vy, covar_samp(lon, lat) AS c FROM fc GROUP BY cluster_id)
SELECT cluster_id, n, m_lon, m_lat, sqrt((vx + vy) * (n - 1) / n) AS rms, sqrt((vx + vy) / 2 + sqrt(((vx - vy) / 2) ** 2 + c * c)) AS major, sqrt(greatest((vx + vy) / 2 - sqrt(((vx - vy) / 2) ** 2 + c * c), 0)) AS minor, (90 - degrees(0.5e0 * atan2(2 * c, vx - vy)) + 180) % 180 AS azimuth FROM m""", "m_lon m_lat rms major minor azimuth")  # fmt: skip
def _(spark, d):
    return forecast.endpoint_spread(particles(spark, d))


@query("histogram_overlap", f"""WITH {CAST_SQL}, a AS (SELECT CAST(floor(lon / 0.1e0) AS BIGINT) AS ix, CAST(floor(lat / 0.1e0) AS BIGINT) AS iy, count(*) FILTER (WHERE run = 0) AS p, count(*) FILTER (WHERE run > 0) AS q FROM fc GROUP BY ALL)
SELECT sum(least(p / (SELECT sum(p) FROM a), q / (SELECT sum(q) FROM a))) AS overlap FROM a""", "overlap")  # fmt: skip
def _(spark, d):
    p = particles(spark, d)
    return forecast.histogram_overlap(p.filter("run = 0"), p.filter("run > 0"), 0.1)


GRID_SQL = "wn AS (SELECT CAST(row_number() OVER (ORDER BY d, a) - 1 AS INT) AS w, CAST(a AS INT) AS start_h, CAST(a + d AS INT) AS end_h FROM (VALUES (1), (2), (3), (6), (12)) v(d), range(48) g(a) WHERE a + d <= 48)"
WINDOW_SQL = f"""{OIL_SQL}, {SAMPLE_SQL}, {GRID_SQL}, pairs AS (SELECT o.cluster_id, o.mmsi, pid, hour, sid FROM oil o JOIN sam s ON o.cluster_id = s.cluster_id AND abs(o.lat - s.lat) < 0.03 WHERE {td.haversine('o.lat', 'o.lon', 's.lat', 's.lon')} <= {HIT_KM}),
hist AS (SELECT o.cluster_id, o.mmsi, o.hour, count(DISTINCT o.pid) AS n, count(DISTINCT p.pid) AS k FROM oil o LEFT JOIN (SELECT DISTINCT cluster_id, mmsi, pid, hour FROM pairs) p ON o.pid = p.pid AND o.cluster_id = p.cluster_id AND o.mmsi = p.mmsi AND o.hour = p.hour GROUP BY ALL),
prec AS (SELECT cluster_id, mmsi, w, sum(k) / sum(n) AS p FROM hist JOIN wn ON hour >= start_h AND hour < end_h GROUP BY ALL), rec AS (SELECT cluster_id, mmsi, w, count(DISTINCT sid) AS r FROM pairs JOIN wn ON hour >= start_h AND hour < end_h GROUP BY ALL),
sc AS (SELECT cluster_id, mmsi, w, start_h, end_h, coalesce(p, 0) AS precision, coalesce(r, 0) / n_samples AS recall FROM (SELECT DISTINCT cluster_id, mmsi FROM oil) JOIN (SELECT cluster_id, count(*) AS n_samples FROM sam GROUP BY cluster_id) USING (cluster_id) CROSS JOIN wn LEFT JOIN prec USING (cluster_id, mmsi, w) LEFT JOIN rec USING (cluster_id, mmsi, w))"""


@query("window_search", f"WITH {WINDOW_SQL} SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f FROM sc", "precision recall f")
def _(spark, d):
    return forward.window_search(td.derived(spark, d, "lineitem", OIL), td.derived(spark, d, "part", SAMPLE), HIT_KM, forward.windows(spark))


@query("fractions_skill", f"""WITH {OIL_SQL}, {SAMPLE_SQL}, both_ AS (SELECT cluster_id, CAST(floor(lon * 20) AS BIGINT) AS ix, CAST(floor(lat * 20) AS BIGINT) AS iy, 1 AS o, 0 AS m FROM sam GROUP BY ALL UNION ALL SELECT cluster_id, CAST(floor(lon * 20) AS BIGINT), CAST(floor(lat * 20) AS BIGINT), 0, 1 FROM oil GROUP BY ALL),
sp AS (SELECT cluster_id, width, ix + dx AS ix, iy + dy AS iy, sum(o) / (width * width * 1e0) AS po, sum(m) / (width * width * 1e0) AS pm FROM both_, (VALUES (1), (3), (5)) v(width), range(-2, 3) a(dx), range(-2, 3) b(dy) WHERE abs(dx) <= width // 2 AND abs(dy) <= width // 2 GROUP BY cluster_id, width, ix + dx, iy + dy)
SELECT cluster_id, width, CASE WHEN sum(po * po + pm * pm) > 0 THEN 1 - sum((po - pm) ** 2) / sum(po * po + pm * pm) END AS fss FROM sp GROUP BY ALL""", "fss")  # fmt: skip
def _(spark, d):
    at = lambda df: df.select("cluster_id", F.floor(F.col("lon") * 20).alias("ix"), F.floor(F.col("lat") * 20).alias("iy"))
    return forward.fractions_skill(at(td.derived(spark, d, "part", SAMPLE)), at(td.derived(spark, d, "lineitem", OIL)), (1, 3, 5))


@query("decide", f"""WITH {sql_of('s', 'supplier', SUSPECT)}, s1 AS (SELECT *, coalesce(fwd_f >= 0.5 AND bwd_point >= 0.3 AND coalesce(member_support, 0) >= 0.2 AND fwd_f > 0, false) AS v31_supported, (SELECT coalesce(max(o.fwd_f), 0) FROM s o WHERE o.cluster_id = s.cluster_id AND o.mmsi <> s.mmsi) AS runner FROM s),
s2 AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY v31_supported DESC, round(combined, 6) DESC, mmsi) AS k FROM s1)
SELECT * EXCLUDE (runner, k), CASE WHEN v31_supported AND k = 1 AND fwd_f >= runner THEN 'high-confidence flag (calibrated)' WHEN v31_supported THEN 'supported' ELSE 'lead only' END AS v31_decision FROM s2""", "fwd_f bwd_point member_support combined")  # fmt: skip
def _(spark, d):
    return fusion.decide(td.derived(spark, d, "supplier", SUSPECT), 0.5, 0.3, 0.2)


@query("class_metrics", """WITH c AS (SELECT o_orderpriority AS t, CASE WHEN o_orderkey % 3 = 0 THEN '5-LOW' ELSE o_orderpriority END AS p FROM orders), k AS (SELECT t AS c, count(*) AS n, count(*) FILTER (WHERE t = p) AS hit, (SELECT count(*) FROM c d WHERE d.p = c.t) AS np FROM c GROUP BY t)
SELECT CAST(sum(n) AS BIGINT) AS n, sum(hit) / sum(n) AS accuracy, avg(hit / n) AS balanced_accuracy, avg(coalesce(2e0 * hit / nullif(n + np, 0), 0)) AS macro_f1 FROM k""", "accuracy balanced_accuracy macro_f1")  # fmt: skip
def _(spark, d):
    o = td.table(spark, d, "orders").selectExpr("o_orderpriority AS t", "case when o_orderkey % 3 = 0 then '5-LOW' else o_orderpriority end AS p")
    return audit.class_metrics(o, "t", "p")


@query("threshold_sweep", f"""WITH {PARTS_SQL}, s AS (SELECT threshold, count(*) FILTER (WHERE prob_mean >= threshold AND bearing < 90) AS tp, count(*) FILTER (WHERE prob_mean >= threshold AND bearing >= 90) AS fp, count(*) FILTER (WHERE prob_mean < threshold AND bearing < 90) AS fn FROM parts, (VALUES (0.2e0), (0.5e0), (0.8e0)) v(threshold) GROUP BY threshold)
SELECT threshold, tp / nullif(tp + fp + fn, 0) AS iou, 2 * tp / nullif(2 * tp + fp + fn, 0) AS dice, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall FROM s""", "threshold iou dice precision recall")  # fmt: skip
def _(spark, d):
    return audit.threshold_sweep(components(spark, d), "prob_mean", F.col("bearing") < 90, (0.2, 0.5, 0.8))


@query("duplicates", "SELECT o_custkey, n, first_id, CAST(dense_rank() OVER (ORDER BY first_id) - 1 AS INT) AS group_id FROM (SELECT o_custkey, count(*) AS n, min(o_orderkey) AS first_id FROM orders GROUP BY o_custkey HAVING count(*) > 1)")
def _(spark, d):
    return audit.duplicates(td.table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("id")), "o_custkey")


@query("value_equality", "SELECT count(*) AS n, avg((o_totalprice IS NOT DISTINCT FROM y)::INT) AS exact_fraction, max(abs(o_totalprice - y)) AS max_abs_diff, avg(abs(o_totalprice - y)) AS mean_abs_diff, sqrt(avg((o_totalprice - y) ** 2)) AS rmse, count(*) FILTER (WHERE y IS NULL) AS null_disagreement FROM (SELECT o_totalprice, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN o_totalprice ELSE o_totalprice + 1 END AS y FROM orders)", "exact_fraction max_abs_diff mean_abs_diff rmse")
def _(spark, d):
    o = td.table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("v"))
    other = o.withColumn("v", F.expr("case when o_orderkey % 7 = 0 then null when o_orderkey % 2 = 0 then v else v + 1 end"))
    return audit.value_equality(o, other, "o_orderkey", "v")


@query("robust_contrast", """WITH x AS (SELECT o_orderpriority AS g, o_orderkey % 4 = 0 AS side, o_totalprice * 1e0 AS v FROM orders), m AS (SELECT g, side, median(v) AS m FROM x GROUP BY ALL), dv AS (SELECT g, side, any_value(m) AS m, median(abs(v - m)) AS mad FROM x JOIN m USING (g, side) GROUP BY ALL)
SELECT g, max(m) FILTER (WHERE side) AS inside, max(m) FILTER (WHERE NOT side) AS outside, max(mad) FILTER (WHERE NOT side) AS mad, max(m) FILTER (WHERE side) - max(m) FILTER (WHERE NOT side) AS contrast, (max(m) FILTER (WHERE side) - max(m) FILTER (WHERE NOT side)) / (1.4826e0 * max(mad) FILTER (WHERE NOT side)) AS cnr FROM dv GROUP BY g""", "inside outside mad contrast cnr")  # fmt: skip
def _(spark, d):
    o = td.table(spark, d, "orders").select(F.col("o_orderpriority").alias("g"), (F.col("o_orderkey") % 4 == 0).alias("side"), F.col("o_totalprice").cast("double").alias("v"))
    return audit.robust_contrast(o, "g", "side", "v")

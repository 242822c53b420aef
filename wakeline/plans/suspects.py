"""Queries of fusion, cases and rules, evidence on suspects and age, over tables derived from the driver's."""

from __future__ import annotations

from pyspark.sql import functions as F

from wakeline.operators import asof, audit, evidence, forecast, forward, fusion, matching
from wakeline.plans.registry import query
from wakeline.plans.slicks import MATCH_SQL, OIL, SAMPLE, WINDOW_SQL, matched, sql_of
from wakeline.sources import testdata as td

K = "s_suppkey"
PAIR = {"cluster_id": f"cast({K} % 7 as int)", "mmsi": f"cast({K} as {{string}})"}
ROBUST = PAIR | {
    "k": K, "passes_funnel": f"{K} % 5 <> 0", "bwd_weighted": f"(({K} * 41) % 113) / 113e0", "bwd_point": f"(({K} * 53) % 97) / 97e0",
    "bwd_top3_fraction": f"(({K} * 19) % 83) / 83e0", "bwd_top5_fraction": f"(({K} * 23) % 79) / 79e0",
}
FORWARD = PAIR | {"k": K, "fwd_f": f"(({K} * 37) % 101) / 101e0", "fss_skilful": f"{K} % 3 = 0", "window_start_h": f"({K} % 40) * 1e0", "window_end_h": f"({K} % 40 + 1 + {K} % 9) * 1e0"}
GEOMETRY = PAIR | {"k": K, "geo_fresh_discharge": f"(({K} * 29) % 89) / 89e0"}
BEHAVIOUR = {"mmsi": PAIR["mmsi"], "k": K, "gap_hi": f"({K} % 48 + 2) * 1e0", "gap_lo": f"({K} % 48) * 1e0", "mmsi_standard": f"{K} % 10 <> 0", "ais_speed_jumps": f"case when {K} % 11 = 0 then null else {K} % 2 end"}
MOTION = {"mmsi": PAIR["mmsi"], "k": K, "motion_state": f"case when {K} % 2 = 0 then 'moving' else 'stationary' end"}
SAR = PAIR | {"k": K, "sar_label": f"case when {K} % 3 = 0 then 'ais_silent_at_t0' else 'ais_moving' end", "sar_dist_km": f"({K} % 5) * 9e-1"}
MISSING = {"f": 4, "g": 6, "b": 8, "m": 9, "sar": 2}
PARTS = {"r": ROBUST, "f": FORWARD, "g": GEOMETRY, "b": BEHAVIOUR, "m": MOTION, "sar": SAR}


def part(spark, d, name):
    out = td.derived(spark, d, "supplier", PARTS[name])
    return (out.filter(F.col("k") % MISSING[name] != 0) if name in MISSING else out).drop("k")


def _part_sql(name: str) -> str:
    kept = f" WHERE {K} % {MISSING[name]} <> 0" if name in MISSING else ""
    return f"{name} AS (SELECT * EXCLUDE (k) FROM (SELECT {td.columns(PARTS[name])} FROM supplier{kept}))"


FUSE_SQL = ", ".join(map(_part_sql, PARTS)) + """, j AS (
  SELECT r.* EXCLUDE (passes_funnel), f.fwd_f IS NOT NULL AS fwd_evaluated, coalesce(f.fwd_f, 0) AS fwd_f, coalesce(fss_skilful, false) AS skilful, window_start_h, window_end_h, geo_fresh_discharge, gap_hi, gap_lo,
    coalesce(mmsi_standard, true) AS std, coalesce(ais_speed_jumps, 0) AS jumps, coalesce(motion_state, 'not in table') AS motion_state, sar_label, sar_dist_km,
    coalesce(sar_label = 'ais_silent_at_t0' AND sar_dist_km <= 2, false) AS flag_ais_silent_seen_by_sar_near_slick, bwd_point >= 0.135 AS bwd_ok
  FROM r LEFT JOIN f USING (cluster_id, mmsi) LEFT JOIN g USING (cluster_id, mmsi) LEFT JOIN b USING (mmsi) LEFT JOIN m USING (mmsi) LEFT JOIN sar USING (cluster_id, mmsi) WHERE r.passes_funnel
), rel AS (SELECT *, CASE WHEN max(bwd_weighted) OVER c > 0 THEN bwd_weighted / max(bwd_weighted) OVER c ELSE 0 END AS bwd_rel, CASE WHEN max(fwd_f) OVER c > 0 THEN fwd_f / max(fwd_f) OVER c ELSE 0 END AS fwd_rel FROM j WINDOW c AS (PARTITION BY cluster_id)),
t AS (SELECT *, sqrt(bwd_rel * fwd_rel) AS combined, CASE WHEN skilful AND bwd_ok AND bwd_top3_fraction >= 0.5 THEN 0 WHEN skilful OR (bwd_ok AND bwd_top5_fraction >= 0.5) THEN 1 WHEN sqrt(bwd_rel * fwd_rel) > 0 THEN 2 ELSE 3 END AS tn FROM rel),
fused AS (SELECT *, ['strongly consistent', 'consistent', 'weak', 'not supported'][tn + 1] AS tier, coalesce(geo_fresh_discharge >= 0.5 AND window_end_h <= 3, false) AS flag_fresh_discharge_match,
    coalesce(gap_lo < window_end_h AND gap_hi > window_start_h, false) AS flag_ais_gap_in_release_window, NOT std OR jumps > 0 AS flag_identity_anomaly, coalesce(fwd_f > 0 AND window_end_h >= 47, false) AS flag_window_at_48h_boundary,
    CASE WHEN fwd_f > 0 AND bwd_ok THEN 'forward+backward' WHEN bwd_ok AND NOT fwd_evaluated THEN 'backward only (forward not evaluated)' WHEN bwd_ok THEN 'backward only' WHEN fwd_f > 0 THEN 'forward only' ELSE 'neither' END AS direction_agreement,
    CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY tn, round(combined, 6) DESC, mmsi) AS INT) AS suspect_rank FROM t)"""
FUSED = ["cluster_id", "mmsi", "fwd_evaluated", "motion_state", "sar_label", "sar_dist_km", "bwd_rel", "fwd_rel", "combined", "tier", "direction_agreement", "suspect_rank", "flag_fresh_discharge_match",
         "flag_ais_gap_in_release_window", "flag_identity_anomaly", "flag_window_at_48h_boundary", "flag_ais_silent_seen_by_sar_near_slick"]


def fused(spark, d):
    gap = F.struct(F.col("gap_hi").alias("hi_h"), F.col("gap_lo").alias("lo_h"))
    b = part(spark, d, "b").withColumn("gaps", F.array(gap)).drop("gap_hi", "gap_lo")
    return fusion.fuse(part(spark, d, "r"), part(spark, d, "f"), part(spark, d, "g"), b, part(spark, d, "m"), part(spark, d, "sar"))


@query("fuse", f"WITH {FUSE_SQL} SELECT {', '.join(FUSED)} FROM fused", "sar_dist_km bwd_rel fwd_rel combined")
def _(spark, d):
    return fused(spark, d).select(*FUSED)


CASE = {"case_id": "cast(n_nationkey as int)", "truth": "cast(n_nationkey * 3 + 1 as {string})", "stratum": "case when n_nationkey % 2 = 0 then 'near' else 'far' end", "moving": "n_nationkey % 3 = 0", "tau_start_h": "(n_nationkey % 30 + 6) * 1e0", "tau_end_h": "(n_nationkey % 30) * 1e0"}
CASES_SQL = f"{FUSE_SQL}, {sql_of('cs', 'nation', CASE)}, cases AS (SELECT * FROM cs)"
SCORED_SQL = f"""{CASES_SQL}, sk AS (SELECT *, rank() OVER (PARTITION BY cluster_id ORDER BY round(bwd_weighted, 6) DESC) AS rb, rank() OVER (PARTITION BY cluster_id ORDER BY round(fwd_f, 6) DESC) AS rf FROM fused),
res AS (SELECT case_id, truth, stratum, moving, coalesce(n.n, 0) AS n_suspects, s.tier IS NOT NULL AS truth_passes_funnel, s.suspect_rank AS rank_fused, coalesce(s.tier, 'not in funnel') AS tier_truth, CAST(rb AS INT) AS rank_backward_only, CAST(CASE WHEN s.fwd_f > 0 THEN rf END AS INT) AS rank_forward_only,
  coalesce(n.top_tier, 'none') AS top_tier, n.top_vessel, CASE WHEN s.fwd_f > 0 THEN greatest(0, least(s.window_end_h, tau_start_h) - greatest(s.window_start_h, tau_end_h)) END AS window_overlap_h,
  CASE WHEN s.fwd_f > 0 THEN abs((s.window_start_h + s.window_end_h) / 2 - (tau_start_h + tau_end_h) / 2) END AS window_mid_error_h
  FROM cases LEFT JOIN (SELECT cluster_id, count(*) AS n, min(tier) FILTER (WHERE suspect_rank = 1) AS top_tier, min(mmsi) FILTER (WHERE suspect_rank = 1) AS top_vessel FROM fused GROUP BY cluster_id) n ON n.cluster_id = case_id
  LEFT JOIN sk s ON s.cluster_id = case_id AND s.mmsi = truth)"""


def cases(spark, d):
    return td.derived(spark, d, "nation", CASE)


@query("score_cases", f"WITH {SCORED_SQL} SELECT * FROM res", "window_overlap_h window_mid_error_h")
def _(spark, d):
    return fusion.score_cases(cases(spark, d), fused(spark, d))


TOPS = [(m, k) for m in ("fused", "backward_only", "forward_only") for k in (1, 3, 5)]
SKILL = "funnel_recall truth_consistent_or_better median_window_mid_error_h " + " ".join(f"top{k}_{m}" for m, k in TOPS)


@query("skill_table", f"""WITH {SCORED_SQL}, u AS (SELECT *, unnest(['all', stratum, CASE WHEN moving THEN 'moving' ELSE 'stationary' END]) AS subset FROM res)
SELECT subset, count(*) AS n, avg(truth_passes_funnel::INT) AS funnel_recall, {', '.join(f'avg((coalesce(rank_{m}, 999) <= {k})::INT) AS top{k}_{m}' for m, k in TOPS)},
  avg((tier_truth IN ('strongly consistent', 'consistent'))::INT) AS truth_consistent_or_better, median(window_mid_error_h) AS median_window_mid_error_h FROM u GROUP BY subset""", SKILL)
def _(spark, d):
    return fusion.skill_table(fusion.score_cases(cases(spark, d), fused(spark, d)))


ACCUSED = PAIR | {
    "fwd_f": f"(({K} * 37) % 101) / 101e0", "bwd_point": f"(({K} * 53) % 97) / 97e0", "member_support": f"case when {K} % 9 = 0 then null else (({K} * 17) % 89) / 89e0 end", "combined": f"(({K} * 71) % 103) / 103e0",
}
TRUTHS = {"case_id": "cast(n_nationkey as int)", "truth": "cast(n_nationkey + 7 as {string})", "split": "case when n_nationkey % 2 = 0 then 'calibration' else 'test' end"}
GRID = [(i, a, b, c, m) for i, (a, b, c, m) in enumerate((a, b, c, m) for a in (0.0, 0.4, 0.7) for b in (0.0, 0.5) for c in (0.0, 0.3) for m in (1.0, 1.2))]
RULES_SQL = f"rules(rule_id, a, b, c, m) AS (VALUES {', '.join(f'({i}, {a}e0, {b}e0, {c}e0, {m}e0)' for i, a, b, c, m in GRID)})"
SWEEP_SQL = f"""{sql_of('su', 'supplier', ACCUSED)}, tr AS (SELECT {td.columns(TRUTHS)} FROM nation), {RULES_SQL},
v AS (SELECT su.*, case_id, truth, split, h.hidden FROM su JOIN tr ON cluster_id = case_id CROSS JOIN (VALUES (false), (true)) h(hidden) WHERE NOT h.hidden OR mmsi <> truth),
ru AS (SELECT v.*, coalesce((SELECT max(o.fwd_f) FROM v o WHERE o.case_id = v.case_id AND o.hidden = v.hidden AND o.mmsi <> v.mmsi), 0) AS runner FROM v),
ok AS (SELECT ru.*, rules.*, coalesce(fwd_f >= a AND bwd_point >= b AND coalesce(member_support, 0) >= c AND (fwd_f > 0 OR a = 0), false) AS ok FROM ru, rules),
k AS (SELECT *, row_number() OVER (PARTITION BY rule_id, case_id, hidden ORDER BY ok DESC, round(combined, 6) DESC, mmsi) AS n, count(*) FILTER (WHERE ok) OVER (PARTITION BY rule_id, case_id, hidden) AS n_ok, bool_or(ok AND mmsi = truth) OVER (PARTITION BY rule_id, case_id, hidden) AS t_ok FROM ok),
top AS (SELECT *, CASE WHEN ok AND fwd_f >= m * runner THEN mmsi END AS accused FROM k WHERE n = 1),
swept AS (SELECT rule_id, split, count(*) FILTER (WHERE NOT hidden) AS n, avg(coalesce(accused = truth, false)::INT) FILTER (WHERE NOT hidden) AS correct_attribution, avg(t_ok::INT) FILTER (WHERE NOT hidden) AS truth_supported, avg((n_ok = 0)::INT) FILTER (WHERE NOT hidden) AS no_accusation_when_present,
  count(*) FILTER (WHERE hidden AND accused IS NOT NULL) / count(*) FILTER (WHERE NOT hidden) AS false_accusation, a, b, c, m FROM top GROUP BY rule_id, split, a, b, c, m)"""
SWEPT = "correct_attribution truth_supported no_accusation_when_present false_accusation a b c m"


def swept(spark, d):
    rules = spark.createDataFrame(GRID, "rule_id int, a double, b double, c double, m double")
    su = td.derived(spark, d, "supplier", ACCUSED).withColumnRenamed("cluster_id", "case_id")
    return fusion.sweep_rules(su, td.derived(spark, d, "nation", TRUTHS), rules)


@query("sweep_rules", f"WITH {SWEEP_SQL} SELECT * FROM swept", SWEPT)
def _(spark, d):
    return swept(spark, d)


@query("choose_rule", f"""WITH {SWEEP_SQL} SELECT rule_id, correct_attribution, false_accusation FROM swept WHERE split = 'calibration'
ORDER BY false_accusation <= 0.1 DESC, CASE WHEN false_accusation <= 0.1 THEN correct_attribution END DESC NULLS LAST, false_accusation, correct_attribution DESC, m DESC, a DESC, b DESC, c DESC LIMIT 1""", "correct_attribution false_accusation")
def _(spark, d):
    return fusion.choose_rule(swept(spark, d)).select("rule_id", "correct_attribution", "false_accusation")


EVENT = {"cluster_id": "cast(n_nationkey as int)", "end1_lon": "-93e0 + n_nationkey * 2e-1", "end1_lat": "25e0 + n_nationkey * 1e-1", "end2_lon": "-93e0 + n_nationkey * 2e-1 + 1e-1", "end2_lat": "25e0 + n_nationkey * 1e-1 + 5e-2", "axis_bearing_deg": "((n_nationkey * 17) % 180) * 1e0"}
NEAR_SQL = f"near_rep AS (SELECT mmsi, arg_min(lon, abs(us - {td.T0}) * 2 + (us > {td.T0})::INT) AS n_lon, arg_min(lat, abs(us - {td.T0}) * 2 + (us > {td.T0})::INT) AS n_lat, arg_min(sog, abs(us - {td.T0}) * 2 + (us > {td.T0})::INT) AS sog, arg_min(cog, abs(us - {td.T0}) * 2 + (us > {td.T0})::INT) AS cog, min(abs(us - {td.T0})) / 6e7 AS rep_min FROM aisw GROUP BY mmsi)"
GEO_SQL = f"""{td.V21_ALL_SQL}, {NEAR_SQL}, {sql_of('ev', 'nation', EVENT)}, g AS (
  SELECT cluster_id, mmsi, method, coalesce(lon, n_lon) AS x, coalesce(lat, n_lat) AS y, rep_min, coalesce(sog >= 0.5 AND cog < 360, false) AS mov, ((cog - axis_bearing_deg) % 180 + 180) % 180 AS q, end1_lat, end1_lon, end2_lat, end2_lon
  FROM ev JOIN pos21 ON TRY_CAST(mmsi AS INT) % 25 = cluster_id JOIN near_rep USING (mmsi) WHERE t = {td.T0}),
h AS (SELECT *, least({td.haversine('y', 'x', 'end1_lat', 'end1_lon')}, {td.haversine('y', 'x', 'end2_lat', 'end2_lon')}) AS dist, CASE WHEN mov THEN least(q, 180 - q) END AS ang FROM g),
s AS (SELECT *, exp(-pow(dist / greatest(3 * rep_min / 60, 0.5), 5)) AS prox, exp(-ln(2) * pow(ang / 45, 2)) AS ali FROM h)"""


@query("discharge_geometry", f"WITH {GEO_SQL} SELECT cluster_id, mmsi, method, dist AS dist_to_slick_end_km, prox AS geo_head_proximity, ang AS heading_vs_axis_deg, ali AS geo_heading_alignment, CASE WHEN mov THEN (2 * prox + ali) / 3 ELSE prox END AS geo_fresh_discharge FROM s",
    "dist_to_slick_end_km geo_head_proximity heading_vs_axis_deg geo_heading_alignment geo_fresh_discharge")
def _(spark, d):
    reports = td.window(td.ais(spark, d), td.BRACKET)
    state = asof.state_at(reports, td.T0, td.BRACKET, td.EDGE, td.KNOTS)
    pairs = state.select(F.pmod(F.col("mmsi").cast("int"), F.lit(25)).alias("cluster_id"), "mmsi")
    return evidence.discharge_geometry(td.derived(spark, d, "nation", EVENT), state, evidence.nearest_report(reports, td.T0), pairs)


SLICK = {"cluster_id": "cast(n_nationkey as int)", "width_m": "100e0 + n_nationkey * 37e0", "damping": "(n_nationkey % 9) * 1e0", "sharpness": "((n_nationkey * 3) % 10) * 1e-1"}
DARK = "CASE WHEN damping >= 6 AND sharpness >= 0.5 THEN 'strong/fresh-looking' WHEN damping >= 3 THEN 'intermediate' ELSE 'weak/weathered-looking' END"
WIDTH = lambda k: f"greatest(pow(width_m / 4, 2) - 625, 0) / (2 * {k}e0) / 3600"
CUE_SQL = f"""{sql_of('sl', 'nation', SLICK)}, dk AS (SELECT *, {DARK} AS dark FROM sl), cues AS (
  SELECT cluster_id, 'width_diffusion' AS cue, {WIDTH(10)} AS lo_h, {WIDTH(1)} AS hi_h FROM dk UNION ALL SELECT cluster_id, 'okubo_1971', pow(pow(width_m / 4 * 100, 2) / 0.0108, 1 / 2.34e0) / 3600, pow(pow(width_m / 4 * 100, 2) / 0.0108, 1 / 2.34e0) / 3600 FROM dk
  UNION ALL SELECT cluster_id, 'persistence_prior', 2, 12 FROM dk UNION ALL SELECT cluster_id, 'sar_darkness', CASE dark WHEN 'strong/fresh-looking' THEN 0 WHEN 'intermediate' THEN 2 ELSE 6 END, CASE dark WHEN 'strong/fresh-looking' THEN 6 WHEN 'intermediate' THEN 24 ELSE 48 END FROM dk)"""


def cues(spark, d):
    s = td.derived(spark, d, "nation", SLICK)
    return evidence.age_cues(s.withColumn("darkness_class", evidence.darkness_class(F.col("damping"), F.col("sharpness"))))


@query("age_cues", f"WITH {CUE_SQL} SELECT * FROM cues", "lo_h hi_h")
def _(spark, d):
    return cues(spark, d)


@query("age_summary", f"""WITH {CUE_SQL}, o AS (SELECT cluster_id, min(lo_h) AS lo, max(hi_h) AS hi FROM cues WHERE cue <> 'sar_darkness' GROUP BY cluster_id), b AS (SELECT CAST(n_nationkey AS INT) AS cluster_id, n_nationkey * 2e0 AS s, n_nationkey * 2e0 + 3 AS e FROM nation WHERE n_nationkey % 3 = 0)
SELECT cluster_id, coalesce(s, lo) AS age_lo_h, coalesce(e, hi) AS age_hi_h, hi AS appearance_age_hi_h, coalesce(s > hi, false) AS age_conflict FROM o LEFT JOIN b USING (cluster_id)""", "age_lo_h age_hi_h appearance_age_hi_h")
def _(spark, d):
    best = td.table(spark, d, "nation").filter("n_nationkey % 3 = 0").selectExpr("cast(n_nationkey as int) AS cluster_id", "n_nationkey * 2e0 AS start_h", "n_nationkey * 2e0 + 3 AS end_h")
    return evidence.age_summary(cues(spark, d), best)


TRACK = {"mmsi": "cast(s_suppkey as {string})", "motion_state": "case when s_suppkey % 4 = 0 then 'moving' when s_suppkey % 4 = 1 then 'stationary' when s_suppkey % 4 = 2 then 'mixed' else 'undetermined' end", "structure_km": "case when s_suppkey % 5 = 0 then null else (s_suppkey % 7) * 2e-1 end"}


@query("source_type", f"WITH {sql_of('t', 'supplier', TRACK)} SELECT mmsi, CASE WHEN motion_state IN ('stationary', 'mixed') THEN CASE WHEN coalesce(structure_km <= 0.5, false) THEN 'fixed installation' ELSE 'stationary vessel' END WHEN motion_state = 'moving' THEN 'vessel under way' ELSE 'unknown' END AS source_type FROM t")
def _(spark, d):
    return evidence.source_type(td.derived(spark, d, "supplier", TRACK)).select("mmsi", "source_type")


@query("relabel_silent", f"""WITH {MATCH_SQL}, bx AS (SELECT min(lon) AS x0, max(lon) AS x1, min(lat) AS y0, max(lat) AS y1 FROM aisw), l AS (SELECT mmsi, max(us) AS u FROM ais WHERE us >= {td.T0 - 96 * td.HOUR} AND us < {td.T0 - 12 * td.HOUR} AND mmsi NOT IN (SELECT mmsi FROM ais WHERE us BETWEEN {td.T0 - 12 * td.HOUR} AND {td.T0 + 12 * td.HOUR}) GROUP BY mmsi),
r AS (SELECT a.mmsi, lon, lat, coalesce(cog, 0) AS cog, coalesce(sog, 0) * 1.852e0 * ({td.T0} - us) / 3.6e9 AS km FROM ais a JOIN l ON a.mmsi = l.mmsi AND a.us = l.u),
sil AS (SELECT mmsi, km, lon + km * sin(radians(cog)) / (111.32e0 * cos(radians(lat))) AS s_lon, lat + km * cos(radians(cog)) / 110.54e0 AS s_lat FROM r),
c AS (SELECT *, lon BETWEEN x0 AND x1 AND lat BETWEEN y0 AND y1 AS covered FROM mat, bx),
p AS (SELECT det_id, sil.mmsi, {td.haversine('c.lat', 'c.lon', 's_lat', 's_lon')} AS dist, km FROM c, sil WHERE label = 'dark_vessel_candidate' AND covered), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY det_id ORDER BY dist, mmsi) AS n FROM p WHERE dist <= least(1.5 + 0.3 * km, 3)) WHERE n = 1)
SELECT det_id, CASE WHEN label <> 'dark_vessel_candidate' THEN label WHEN NOT covered THEN 'no_ais_coverage' WHEN f.mmsi IS NOT NULL THEN 'ais_silent_at_t0' ELSE label END AS label, f.mmsi AS silent_mmsi FROM c LEFT JOIN f USING (det_id)""")
def _(spark, d):
    silent = matching.silent_entities(td.ais(spark, d), td.T0, 12 * td.HOUR, 96 * td.HOUR)
    return matching.relabel_silent(matched(spark, d), td.window(td.ais(spark, d), td.BRACKET), silent).select("det_id", "label", "silent_mmsi")


GRID_POINT = {"id": "s_suppkey", "t": f"{td.T1} + (s_suppkey % 40) * {td.HOUR} + {td.HOUR // 4}", "lon": "-93e0 + (s_suppkey % 17) * 13e-2", "lat": "25e0 + (s_suppkey % 13) * 11e-2"}


@query("interpolate_grid", f"""WITH {sql_of('p', 'supplier', GRID_POINT)}, q AS (SELECT id, CAST(floor(lon / 0.25e0) AS BIGINT) AS x0, CAST(floor(lat / 0.25e0) AS BIGINT) AS y0, CAST(floor(t / {td.HOUR}e0) AS BIGINT) AS t0, lon / 0.25e0 - floor(lon / 0.25e0) AS wx, lat / 0.25e0 - floor(lat / 0.25e0) AS wy, t / {td.HOUR}e0 - floor(t / {td.HOUR}e0) AS wt FROM p),
c AS (SELECT id, x0 + dx AS ix, y0 + dy AS iy, t0 + dt AS it, (CASE WHEN dx = 1 THEN wx ELSE 1 - wx END) * (CASE WHEN dy = 1 THEN wy ELSE 1 - wy END) * (CASE WHEN dt = 1 THEN wt ELSE 1 - wt END) AS w FROM q, range(2) a(dx), range(2) b(dy), range(2) e(dt))
SELECT id, CASE WHEN max(iy) <= 104 THEN sum(w * (ix * 1e-2 + iy * 2e-2)) END AS u, CASE WHEN max(iy) <= 104 THEN sum(w * ((it - {td.T1 // td.HOUR}) * 1e-1 - ix * 1e-2)) END AS v FROM c WHERE w > 0 GROUP BY id""", "u v")
def _(spark, d):
    hours = spark.range(td.N_TIMES + 1).select((F.col("id") + td.T1 // td.HOUR).alias("it"))
    # A bounded grid, made here: each axis is a range.
    axes = hours.select("it", F.explode(F.sequence(F.lit(-373).cast("long"), F.lit(-360).cast("long"))).alias("ix")).select("*", F.explode(F.sequence(F.lit(99).cast("long"), F.lit(104).cast("long"))).alias("iy"))
    grid = axes.select("it", "ix", "iy", (F.col("ix") * 1e-2 + F.col("iy") * 2e-2).alias("u"), ((F.col("it") - td.T1 // td.HOUR) * 1e-1 - F.col("ix") * 1e-2).alias("v"))
    return forecast.interpolate_grid(td.derived(spark, d, "supplier", GRID_POINT), grid, 0.25, td.HOUR)


@query("release_points", f"WITH {td.V21_SQL} SELECT mmsi, t, CAST(greatest(ceil(({td.T0} - t) / 3.6e9) - 1, 0) AS INT) AS hour, CAST(k AS INT) AS k, lon, lat FROM pos, range(2) g(k) WHERE NOT (CAST(floor(lon / 0.5e0) AS BIGINT) % 2 = 0 AND CAST(floor(lat / 0.5e0) AS BIGINT) % 2 = 0)", "lon lat", digits=2)
def _(spark, d):
    reports = td.window(td.ais(spark, d), td.BRACKET)
    land = spark.range(-400, 400, 2).select(F.col("id").alias("ix"), F.explode(F.sequence(F.lit(-180).cast("long"), F.lit(180).cast("long"), F.lit(2).cast("long"))).alias("iy"))
    return forward.release_points(reports, td.times(spark), land, 0.5, td.BRACKET, td.EDGE, td.KNOTS, td.T0, jitter_deg=0.0)


@query("best_windows", f"""WITH {WINDOW_SQL}, sf AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f FROM sc),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id, mmsi ORDER BY round(f, 6) DESC, w) AS n FROM sf) WHERE n = 1),
hit AS (SELECT DISTINCT o.cluster_id, o.mmsi, o.member FROM oil o JOIN pairs p ON p.pid = o.pid AND p.cluster_id = o.cluster_id AND p.mmsi = o.mmsi AND p.hour = o.hour JOIN b ON b.cluster_id = o.cluster_id AND b.mmsi = o.mmsi WHERE o.hour >= start_h AND o.hour < end_h),
sup AS (SELECT o.cluster_id, o.mmsi, avg((h.member IS NOT NULL)::INT) AS member_support FROM (SELECT DISTINCT cluster_id, mmsi, member FROM oil) o LEFT JOIN hit h ON h.cluster_id = o.cluster_id AND h.mmsi = o.mmsi AND h.member = o.member GROUP BY ALL)
SELECT cluster_id, mmsi, start_h, end_h, precision, recall, f, member_support FROM b JOIN sup USING (cluster_id, mmsi)""", "precision recall f member_support")
def _(spark, d):
    oil, samples = td.derived(spark, d, "lineitem", OIL), td.derived(spark, d, "part", SAMPLE)
    return forward.best_windows(forward.window_search(oil, samples, 2.0, forward.windows(spark)), oil, samples, 2.0)


@query("percentile_rank", "SELECT s_suppkey, s_acctbal, (SELECT count(*) FROM customer WHERE c_acctbal <= s_acctbal) / (SELECT count(*) FROM customer) AS percentile_rank FROM supplier", "s_acctbal percentile_rank")
def _(spark, d):
    s = td.table(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    return matching.percentile_rank(s, td.table(spark, d, "customer").select(F.col("c_acctbal").alias("s_acctbal")), "s_acctbal")


@query("outer_with_source", "SELECT coalesce(c_custkey, o_custkey) AS k, c_nationkey, n, CASE WHEN c_custkey IS NULL THEN 'right_only' WHEN o_custkey IS NULL THEN 'left_only' ELSE 'both' END AS source FROM customer FULL JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey % 3 = 0 GROUP BY o_custkey) ON c_custkey = o_custkey")
def _(spark, d):
    counts = td.table(spark, d, "orders").filter("o_custkey % 3 = 0").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"))
    return audit.outer_with_source(td.table(spark, d, "customer").selectExpr("c_custkey AS k", "c_nationkey"), counts, ["k"])


@query("anchored_pairs", "SELECT anchor, o_orderkey AS id FROM (SELECT o_orderkey, min(o_orderkey) OVER (PARTITION BY o_custkey) AS anchor FROM orders) WHERE o_orderkey <> anchor")
def _(spark, d):
    return audit.anchored_pairs(td.table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("id")), "o_custkey")


@query("config_difference", "SELECT n_name AS name, n_regionkey::VARCHAR AS \"left\", CASE WHEN n_nationkey % 4 = 0 THEN 'x' ELSE n_regionkey::VARCHAR END AS \"right\", CASE WHEN n_nationkey % 4 <> 0 THEN 'same' WHEN n_name = 'ALGERIA' THEN 'allowed' ELSE 'differs' END AS status FROM nation")
def _(spark, d):
    n = td.table(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("value"), "n_nationkey")
    other = n.withColumn("value", F.when(F.col("n_nationkey") % 4 == 0, "x").otherwise(F.col("value")))
    return audit.config_difference(n.select("name", "value"), other.select("name", "value"), ("ALGERIA",))


@query("sar_evidence", f"""WITH {MATCH_SQL}, plat2 AS (SELECT id, s_lon, s_lat FROM plat), p AS (SELECT id AS cluster_id, match_id AS mmsi, label AS sar_label, det_id, {td.haversine('lat', 'lon', 'plat2.s_lat', 'plat2.s_lon')} AS dist FROM mat, plat2 WHERE label LIKE 'ais_%')
SELECT cluster_id, mmsi, sar_label, dist AS sar_dist_km FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id, mmsi ORDER BY dist, det_id) AS n FROM p WHERE dist <= 25) WHERE n = 1""", "sar_dist_km")
def _(spark, d):
    from wakeline.plans.slicks import platforms

    return matching.sar_evidence(platforms(spark, d).withColumnRenamed("id", "cluster_id"), matched(spark, d))


@query("most_common_names", "SELECT c_nationkey, mode_name FROM (SELECT c_nationkey, c_mktsegment AS mode_name, row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, c_mktsegment) AS n FROM customer GROUP BY c_nationkey, c_mktsegment) WHERE n = 1")
def _(spark, d):
    return td.table(spark, d, "customer").groupBy("c_nationkey").agg(evidence.most_common_name(F.col("c_mktsegment")).alias("mode_name"))

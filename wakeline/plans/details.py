"""Queries of bins, projections, texts and small joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from wakeline.functions import binning, geo, kernels, nulls
from wakeline.operators import asof, audit, buckets, events, evidence, fusion, matching, tables
from wakeline.operators.numbering import numbered
from wakeline.plans.registry import query
from wakeline.plans.slicks import EVENT_SQL, GAP_MIN, LINK_M, METRIC_SQL, MOTION_SQL, PAIR_SQL, PARTS_SQL, STILL, SUSPECT, components, detections, metrics, platforms, sql_of
from wakeline.plans.suspects import TRACK
from wakeline.sources import sinks
from wakeline.sources import testdata as td

# Bins and categories.

EDGES, NAMES = (-1000.0, 0.0, 2500.0, 7500.0), ("debt", "low", "middle")


@query("half_open_bins", f"""SELECT c_custkey, CASE WHEN b >= -1000 AND b < 0 THEN 'debt' WHEN b >= 0 AND b < 2500 THEN 'low' WHEN b >= 2500 AND b < 7500 THEN 'middle' END AS bin
FROM (SELECT c_custkey, CASE WHEN c_custkey % 50 = 0 THEN 25e2 * (c_custkey % 4) ELSE CAST(c_acctbal AS DOUBLE) END AS b FROM customer)""")
def _(spark, d):
    balance = F.when(F.col("c_custkey") % 50 == 0, 2500.0 * (F.col("c_custkey") % 4)).otherwise(F.col("c_acctbal").cast("double"))
    return td.table(spark, d, "customer").select("c_custkey", binning.cut_half_open(balance, EDGES, NAMES).alias("bin"))


HOURS = "(c_custkey * 13 % 520 - 10) * 1e-1"


@query("age_order", f"""SELECT c_custkey, CASE WHEN h >= -1e-3 AND h <= 6 THEN 0 WHEN h > 6 AND h <= 12 THEN 1 WHEN h > 12 AND h <= 24 THEN 2 WHEN h > 24 AND h <= 36 THEN 3 WHEN h > 36 AND h <= 48.01 THEN 4 END AS place,
  CAST(ceil(h) - 1 AS INT) AS hour FROM (SELECT c_custkey, {HOURS} AS h FROM customer)""")
def _(spark, d):
    h = td.table(spark, d, "customer").selectExpr("c_custkey", f"{HOURS} AS h")
    return h.select("c_custkey", binning.age_ordinal(F.col("h")).cast("int").alias("place"), binning.hour_bucket(F.col("h")).alias("hour"))


@query("valid_positions", "SELECT c_custkey FROM (SELECT c_custkey, (c_custkey * 37 % 4000 - 2000) * 1e-1 AS lon, (c_custkey * 29 % 2100 - 1050) * 1e-1 AS lat FROM customer) WHERE lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90")
def _(spark, d):
    at = td.table(spark, d, "customer").selectExpr("c_custkey", "(c_custkey * 37 % 4000 - 2000) * 1e-1 AS lon", "(c_custkey * 29 % 2100 - 1050) * 1e-1 AS lat")
    return at.filter(asof.in_range(F.col("lat"), F.col("lon"))).select("c_custkey")


@query("decibels", "SELECT l_orderkey, l_linenumber, CASE WHEN x > 0 THEN 10 * log10(x) END AS db FROM (SELECT l_orderkey, l_linenumber, CAST(l_discount AS DOUBLE) * CAST(l_quantity AS DOUBLE) AS x FROM lineitem)", "db")
def _(spark, d):
    x = td.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount").cast("double") * F.col("l_quantity").cast("double")).alias("x"))
    return x.select("l_orderkey", "l_linenumber", kernels.decibel(F.col("x")).alias("db"))


@query("nan_extremes", """WITH o AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE round(CAST(o_totalprice AS DOUBLE), -4) END AS p FROM orders)
SELECT o_custkey, avg(p) AS mean, count(p) AS n, arg_max(o_orderkey, (p, -o_orderkey)) FILTER (WHERE p IS NOT NULL) AS first_highest, arg_min(o_orderkey, (p, o_orderkey)) FILTER (WHERE p IS NOT NULL) AS first_lowest FROM o GROUP BY o_custkey""", "mean")
def _(spark, d):
    price = F.when(F.col("o_orderkey") % 7 == 0, float("nan")).otherwise(F.round(F.col("o_totalprice").cast("double"), -4))
    o = td.table(spark, d, "orders").select("o_custkey", "o_orderkey", nulls.nan_to_null(price).alias("p"))
    known = F.when(F.col("p").isNotNull(), F.col("p"))
    key = F.when(known.isNotNull(), F.col("o_orderkey"))
    best = o.filter("p IS NOT NULL").groupBy("o_custkey").agg(nulls.first_max(key, known, F.col("o_orderkey")).alias("first_highest"), nulls.first_min(key, known, F.col("o_orderkey")).alias("first_lowest"))
    return o.groupBy("o_custkey").agg(F.avg("p").alias("mean"), F.count("p").alias("n")).join(best, "o_custkey", "left")


# Projections and distances.

LAT0, LON0 = "26e0", "(-90e0 + (det_id % 7) * 1e0)"
LAEA_SQL = f"""{sql_of('det', 'customer', td.DETECTION)}, pr AS (SELECT det_id, lon, lat, radians(lat) AS p, radians({LAT0}) AS p0, radians(lon - {LON0}) AS q FROM det),
xy AS (SELECT *, sqrt(2 / (1 + sin(p0) * sin(p) + cos(p0) * cos(p) * cos(q))) AS k FROM pr)"""


@query("local_projection", f"WITH {LAEA_SQL} SELECT det_id, 6371.0088e0 * k * cos(p) * sin(q) AS x, 6371.0088e0 * k * (cos(p0) * sin(p) - sin(p0) * cos(p) * cos(q)) AS y, lat AS lat_back, lon AS lon_back FROM xy", "x y lat_back lon_back")
def _(spark, d):
    det = detections(spark, d).withColumns({"lat0": F.expr(LAT0), "lon0": F.expr(LON0)})
    x, y = geo.laea_forward(F.col("lat"), F.col("lon"), F.col("lat0"), F.col("lon0"))
    flat = det.select("det_id", "lat0", "lon0", x.alias("x"), y.alias("y"))
    lat, lon = geo.laea_inverse(F.col("x"), F.col("y"), F.col("lat0"), F.col("lon0"))
    return flat.select("det_id", "x", "y", lat.alias("lat_back"), lon.alias("lon_back"))


@query("flat_distances", f"WITH {sql_of('det', 'customer', td.DETECTION)} SELECT det_id, sqrt(((-90 - lon) * 111.32e0 * cos(radians(lat))) ** 2 + ((26 - lat) * 110.54e0) ** 2) AS km FROM det", "km")
def _(spark, d):
    return detections(spark, d).select("det_id", geo.planar_km(F.col("lat"), F.col("lon"), F.lit(26.0), F.lit(-90.0)).alias("km"))


@query("interval_overlaps", "SELECT l_orderkey, l_linenumber, greatest(0e0, least(a + b, 30e0) - greatest(a, 10e0)) AS hours FROM (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) AS a, (l_partkey % 13) * 1e0 AS b FROM lineitem)", "hours")
def _(spark, d):
    spans = td.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("a"), (F.col("l_partkey") % 13).cast("double").alias("b"))
    return spans.select("l_orderkey", "l_linenumber", buckets.interval_overlap(F.col("a"), F.col("a") + F.col("b"), F.lit(10.0), F.lit(30.0)).alias("hours"))


# Events and parts.


@query("area_parts", f"WITH {PARTS_SQL} SELECT id, area_m2, CASE WHEN area_m2 < 23000 THEN 'area below threshold' END AS reason FROM parts", "area_m2")
def _(spark, d):
    kept, out = events.area_split(components(spark, d), 23_000.0)
    return kept.withColumn("reason", F.lit(None).cast("string")).unionByName(out).select("id", "area_m2", "reason")


@query("linked_by_bearing", f"""WITH RECURSIVE {PAIR_SQL}, e AS (SELECT a, b FROM pr WHERE turn <= 40 UNION ALL SELECT b, a FROM pr WHERE turn <= 40),
reach(id, c) AS (SELECT id, id FROM parts UNION SELECT e.b, reach.c FROM reach JOIN e ON reach.id = e.a) SELECT id, min(c) AS component FROM reach GROUP BY id""")
def _(spark, d):
    return events.link(components(spark, d), LINK_M, max_turn=40.0)


@query("nearest_oriented", f"""WITH {PAIR_SQL}, bo AS (SELECT a AS id, b AS other, gap, turn FROM pr UNION ALL SELECT b, a, gap, turn FROM pr), n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY gap, other) AS k FROM bo WHERE id % 3 > 0 AND other % 3 > 0)
SELECT parts.id, other, gap, turn FROM parts LEFT JOIN (SELECT * FROM n WHERE k = 1) n ON n.id = parts.id WHERE parts.id % 3 > 0""", "gap turn")
def _(spark, d):
    return events.nearest_oriented(components(spark, d).withColumn("oriented", F.col("id") % 3 > 0), LINK_M)


@query("events_override", f"""WITH RECURSIVE {EVENT_SQL} SELECT component, eligible, component % 11 = 0 AS selected, CASE WHEN component % 11 = 0 THEN 'analyst_override' ELSE '' END AS selection_basis FROM ev3""")
def _(spark, d):
    p = components(spark, d)
    made = events.build_events(p, events.link(p, LINK_M), (F.col("component") % 15).cast("double"))
    named = td.table(spark, d, "customer").filter("c_custkey % 11 = 0").select(F.col("c_custkey").alias("component"))
    return events.with_override(made, named).select("component", "eligible", "selected", "selection_basis")


# Entities.


@query("gap_texts", f"""WITH {td.AIS_SQL}, s1 AS (SELECT mmsi, us, lag(us) OVER (PARTITION BY mmsi ORDER BY us) AS pus FROM ais WHERE us BETWEEN {td.T1} AND {td.T0}),
g AS (SELECT mmsi, ({td.T0} - pus) / 3.6e9 AS hi, ({td.T0} - us) / 3.6e9 AS lo FROM s1 WHERE floor((us - pus) / 1e6) / 60 >= {GAP_MIN})
SELECT m.mmsi, coalesce(string_agg(printf('%.1f-%.1fh', hi, lo), ';' ORDER BY hi DESC), '') AS gaps FROM (SELECT DISTINCT mmsi FROM s1) m LEFT JOIN g USING (mmsi) GROUP BY m.mmsi""")
def _(spark, d):
    found = evidence.behaviour(td.ais(spark, d), td.T0, gap_min=GAP_MIN)
    return found.select("mmsi", evidence.gap_text(F.col("gaps")).alias("gaps"))


STATIC = "CAST(user_id AS {kind}) AS mmsi, CASE WHEN event_id % 5 = 0 THEN '  ' WHEN event_id % 3 = 0 THEN 'B ' || (user_id % 9) ELSE 'A ' || (user_id % 9) END AS name, CASE WHEN event_id % 4 > 0 AND user_id % 6 > 0 THEN 70 + event_id % 3 END AS vessel_type, CASE WHEN event_id % 2 = 0 THEN value END AS length_m"


@query("static_columns", f"""WITH s AS (SELECT {STATIC.format(kind='VARCHAR')} FROM events), n AS (SELECT mmsi, trim(name) AS x, count(*) AS c FROM s WHERE trim(name) <> '' GROUP BY ALL), t AS (SELECT mmsi, vessel_type AS x, count(*) AS c FROM s WHERE vessel_type IS NOT NULL GROUP BY ALL)
SELECT m.mmsi, coalesce(name, '') AS name, vessel_type, length_m FROM (SELECT mmsi, max(length_m) AS length_m FROM s GROUP BY mmsi) m LEFT JOIN (SELECT mmsi, arg_min(x, (-c, x)) AS name FROM n GROUP BY mmsi) a ON a.mmsi = m.mmsi LEFT JOIN (SELECT mmsi, arg_min(x, (-c, x)) AS vessel_type FROM t GROUP BY mmsi) b ON b.mmsi = m.mmsi""", "length_m")
def _(spark, d):
    return evidence.static_columns(td.table(spark, d, "events").selectExpr(*STATIC.format(kind="STRING").split(", ")))


@query("nearest_structures", f"""WITH {METRIC_SQL}, plat AS (SELECT {td.columns(td.PLATFORM)} FROM supplier), p AS (SELECT mmsi, id, {td.haversine('m_lat', 'm_lon', 'plat.lat', 'plat.lon')} AS km FROM mid, plat),
n AS (SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY km, id) AS k FROM p WHERE km <= 60) SELECT mid.mmsi, id AS structure_id, km AS structure_km FROM mid LEFT JOIN (SELECT * FROM n WHERE k = 1) n ON n.mmsi = mid.mmsi""", "structure_km")
def _(spark, d):
    middle = td.window(td.ais(spark, d)).groupBy("mmsi").agg(F.median("lon").alias("m_lon"), F.median("lat").alias("m_lat"))
    return matching.nearest_structure(middle, platforms(spark, d), 60.0).select("mmsi", "structure_id", "structure_km")


WITHIN = "printf('90%% within %.2f km, at most %.2f km away', position_spread_km, max_excursion_km)"
RUNGS = " ".join(f"WHEN motion_state = '{name}' THEN {WITHIN}" for name, *_ in STILL)


@query("motion_reasons", f"""WITH {MOTION_SQL}, j AS (SELECT * FROM mot JOIN met USING (mmsi)) SELECT mmsi, CASE WHEN n_reports < 10 OR track_span_h < 6 THEN CASE WHEN motion_state = 'moving' THEN printf('short track, moved %.1f km', max_excursion_km) ELSE 'too few reports or hours' END
  {RUNGS} WHEN motion_state = 'mixed' THEN printf('%.2f of reports at the median position, excursion %.1f km', stationarity_score, max_excursion_km) ELSE printf('90%% spread %.2f km', position_spread_km) END AS motion_reason FROM j""")
def _(spark, d):
    return evidence.motion_state(metrics(spark, d), STILL).select("mmsi", "motion_reason")


@query("source_basis", f"""WITH {sql_of('t', 'supplier', TRACK)} SELECT mmsi, CASE WHEN motion_state IN ('stationary', 'mixed') AND coalesce(structure_km <= 0.5, false) THEN printf('%s, %.2f km from a structure', motion_state, structure_km) ELSE motion_state END AS source_type_basis FROM t""")
def _(spark, d):
    return evidence.source_type(td.derived(spark, d, "supplier", TRACK)).select("mmsi", "source_type_basis")


# Rankings and cases.

CASES = "SELECT DISTINCT s_suppkey % 7 AS case_id, CAST(min(s_suppkey) OVER (PARTITION BY s_suppkey % 7) AS {kind}) AS truth FROM supplier"


@query("hidden_truth", f"WITH {sql_of('s', 'supplier', SUSPECT)}, c AS ({CASES.format(kind='VARCHAR')}) SELECT cluster_id, mmsi, combined FROM s WHERE (cluster_id, mmsi) NOT IN (SELECT (case_id, truth) FROM c)", "combined")
def _(spark, d):
    supplier = td.table(spark, d, "supplier").select("s_suppkey")
    cases = supplier.groupBy((F.col("s_suppkey") % 7).cast("int").alias("case_id")).agg(F.min("s_suppkey").cast("string").alias("truth"))
    return fusion.hide(td.derived(spark, d, "supplier", SUSPECT), cases).select("cluster_id", "mmsi", "combined")


RANK_SQL = f"""{sql_of('s', 'supplier', SUSPECT)}, a AS (SELECT cluster_id, mmsi, rank() OVER (PARTITION BY cluster_id ORDER BY round(combined, 6) DESC) AS r FROM s),
b AS (SELECT cluster_id, mmsi, rank() OVER (PARTITION BY cluster_id ORDER BY round(combined + CASE WHEN cluster_id % 2 = 0 THEN 0 ELSE fwd_f END, 6) DESC) AS r FROM s),
ta AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY r, mmsi) AS k FROM a QUALIFY k <= 4), tb AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY r, mmsi) AS k FROM b QUALIFY k <= 4)"""


@query("identical_order", f"""WITH {RANK_SQL} SELECT x.cluster_id, CAST(n AS INT) AS n, x.members = y.members AS same_members, x.ordered = y.ordered AS same_order
FROM (SELECT cluster_id, count(*) AS n, string_agg(mmsi, ',' ORDER BY mmsi) AS members, string_agg(mmsi, ',' ORDER BY k) AS ordered FROM ta GROUP BY cluster_id) x
JOIN (SELECT cluster_id, string_agg(mmsi, ',' ORDER BY mmsi) AS members, string_agg(mmsi, ',' ORDER BY k) AS ordered FROM tb GROUP BY cluster_id) y USING (cluster_id)""")
def _(spark, d):
    from wakeline.operators.scoring import ranked

    s = td.derived(spark, d, "supplier", SUSPECT)
    moved = s.withColumn("combined", F.col("combined") + F.when(F.col("cluster_id") % 2 == 0, 0.0).otherwise(F.col("fwd_f")))
    return audit.identical_order(*(ranked(x, "combined", "r", "cluster_id") for x in (s, moved)), "mmsi", "cluster_id", "r", 4)


@query("markdown_report", """SELECT line FROM (SELECT 0 AS k, '| segment | n | mean |' AS line UNION ALL SELECT 1, '| --- | --- | --- |'
UNION ALL SELECT 2, '| ' || c_mktsegment || ' | ' || count(*) || ' | ' || printf('%.2f', round(avg(CAST(c_acctbal AS DOUBLE)), 2)) || ' |' FROM customer GROUP BY c_mktsegment)""")
def _(spark, d):
    table = td.table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("c_acctbal").cast("double")), 2).alias("mean"))
    text = sinks.markdown(table, ("segment", "absent", "n", "mean"))  # five segments
    return spark.createDataFrame([(x,) for x in text.split("\n")], "line string")


# Tables.


@query("mixed_order", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderstatus, o_totalprice DESC, o_orderkey) - 1 AS place FROM orders")
def _(spark, d):
    o = td.table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return numbered(o, ["o_orderstatus", F.desc("o_totalprice"), "o_orderkey"], "place").select("o_orderkey", "place")


@query("union_catalogues", "SELECT s_suppkey AS id, s_name AS name, CAST(s_acctbal AS DOUBLE) AS balance, NULL AS segment FROM supplier UNION ALL SELECT c_custkey, c_name, NULL, c_mktsegment FROM customer", "balance")
def _(spark, d):
    own = td.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").cast("double").alias("balance"))
    other = td.table(spark, d, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_name").alias("name"), F.col("c_custkey").alias("id"))
    return own.unionByName(other, allowMissingColumns=True)


TILE = {"id": "c_custkey", "col0": "(c_custkey * 7919) % 9973 * 2 - 4000", "row0": "(c_custkey * 104729) % 9967 * 2 - 4000"}


@query("shared_windows", f"""WITH {sql_of('t', 'customer', TILE)} SELECT a.id AS a, b.id AS b, greatest(0, b.col0 - a.col0) AS a_col, greatest(0, b.row0 - a.row0) AS a_row, greatest(0, a.col0 - b.col0) AS b_col, greatest(0, a.row0 - b.row0) AS b_row,
  512 - abs(a.col0 - b.col0) AS width, 512 - abs(a.row0 - b.row0) AS height FROM t a JOIN t b ON a.id < b.id AND abs(a.col0 - b.col0) < 512 AND abs(a.row0 - b.row0) < 512""")
def _(spark, d):
    return tables.shared_windows(td.derived(spark, d, "customer", TILE), 512)

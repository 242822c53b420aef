"""The driver's tables as domain tables. Expressions are text that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOUR = 3_600_000_000
EPOCH_H = 473_352  # 2024-01-01 in hours
T0_H, WINDOW_H = 480, 48
T0 = (EPOCH_H + T0_H) * HOUR
T1 = T0 - WINDOW_H * HOUR
N_TIMES = WINDOW_H + 1

US = {"spark": "unix_micros(cast(ts as timestamp))", "duckdb": "epoch_us(ts)"}
H = f"(us / 3.6e9 - {EPOCH_H}e0)"
AIS = {
    "mmsi": "cast(user_id as {string})",
    "lon": f"-93e0 + (user_id % 50) * 1e-1 + {H} * 2e-3 + ((event_id * 7919) % 1000) / 1e5 + case when event_id % 37 = 0 then 5e0 else 0e0 end",
    "lat": f"25e0 + (user_id % 30) * 1e-1 + {H} * 1e-3 + ((event_id * 104729) % 1000) / 1e5",
    "sog": "value",
    "cog": "((event_id * 37) % 400) * 1e0",
}
CLOUD = {"t": f"{T1} + (p_partkey % {N_TIMES}) * {HOUR}", "p_lon": "-93e0 + ((p_partkey * 37) % 500) * 1e-2", "p_lat": "25e0 + ((p_partkey * 91) % 300) * 1e-2"}
ENSEMBLE = {
    "scenario_id": "cast(l_suppkey % 27 as int)", "t": f"{T1} + ((l_orderkey + l_linenumber) % {N_TIMES}) * {HOUR}",
    "p_lon": "-93e0 + ((l_partkey * 37) % 500) * 1e-2", "p_lat": "25e0 + ((l_orderkey * 91) % 300) * 1e-2",
}
BACKWARD = {
    "cluster_id": "cast(l_orderkey % 5 as int)", "member": "cast(l_suppkey % 9 as int)", "t": f"{T1} + ((l_partkey + l_linenumber) % {N_TIMES}) * {HOUR}",
    "p_lon": "-93e0 + (l_orderkey % 5) * 1e0 + ((l_partkey * 37) % 100) * 1e-2", "p_lat": "255e-1 + (l_orderkey % 5) * 5e-1 + ((l_orderkey * 91) % 100) * 1e-2",
}
PLATFORM = {"id": "s_suppkey", "name": "s_name", "lon": "-93e0 + ((s_suppkey * 31) % 500) * 1e-2", "lat": "25e0 + ((s_suppkey * 17) % 300) * 1e-2"}
DETECTION = {"det_id": "c_custkey", "lon": "-93e0 + ((c_custkey * 53) % 5000) * 1e-3", "lat": "25e0 + ((c_custkey * 29) % 3000) * 1e-3", "seen": "c_nationkey"}
COMPONENT = {
    "component_id": "c_custkey", "area_m2": "5e3 + abs(c_acctbal) * 1e1", "prob_mean": "((c_custkey * 13) % 100) * 1e-2", "x_m": "((c_custkey * c_custkey * 7919) % 39979) * 1e1", "y_m": "((c_custkey * 104729) % 39989) * 1e1",
    "bearing": "((c_custkey * 11) % 180) * 1e0",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def columns(spec: dict[str, str], engine: str = "duckdb") -> str:
    kind = {"string": "string" if engine == "spark" else "varchar"}
    return ", ".join(f"{e.format(**kind)} AS {c}" for c, e in spec.items())


def derived(spark: SparkSession, sf_dir: str, name: str, spec: dict[str, str]) -> DataFrame:
    return table(spark, sf_dir, name).selectExpr(*(f"{e.format(string='string')} AS {c}" for c, e in spec.items()))


def raw_ais(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of every fifth event are cut to the hour, which makes exact hits and repeated times."""
    us = f"case when event_id % 5 = 0 then {US['spark']} - {US['spark']} % {HOUR} else {US['spark']} end"
    events = table(spark, sf_dir, "events").withColumn("us", F.expr(us))
    return events.selectExpr("event_id", "us", *(f"{e.format(string='string')} AS {c}" for c, e in AIS.items()))


def ais(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned: the lowest event of an entity and time."""
    from wakeline.operators.asof import clean_reports

    return clean_reports(raw_ais(spark, sf_dir), tie="event_id")


def window(reports: DataFrame, margin_us: int = 0) -> DataFrame:
    return reports.filter(F.col("us").between(T1 - margin_us, T0 + margin_us))


def times(spark: SparkSession) -> DataFrame:
    return spark.range(N_TIMES).select((F.lit(T1) + F.col("id") * HOUR).cast("long").alias("t"))


AIS_SQL = f"""raw_ais AS (
  SELECT event_id, us, {columns(AIS)} FROM (SELECT *, CASE WHEN event_id % 5 = 0 THEN {US['duckdb']} - {US['duckdb']} % {HOUR} ELSE {US['duckdb']} END AS us FROM events)
), ais AS (
  SELECT event_id, us, mmsi, lon, lat, sog, cog FROM (SELECT *, row_number() OVER (PARTITION BY mmsi, us ORDER BY event_id) AS n FROM raw_ais) WHERE n = 1
)"""
GRID_SQL = f"grid AS (SELECT {T1} + k * {HOUR} AS t FROM range({N_TIMES}) g(k))"


def haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = f"pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)"
    return f"(2 * 6371.0088e0 * asin(sqrt(least(1e0, greatest(0e0, {a})))))"


def near_sql(margin_us: int) -> str:
    return f"""{AIS_SQL}, {GRID_SQL}, aisw AS (SELECT * FROM ais WHERE us BETWEEN {T1 - margin_us} AND {T0 + margin_us}),
want AS (SELECT mmsi, t FROM (SELECT DISTINCT mmsi FROM aisw), grid),
prv AS (SELECT w.mmsi, w.t, a.us AS pus, a.lon AS plon, a.lat AS plat FROM want w ASOF LEFT JOIN aisw a ON w.mmsi = a.mmsi AND w.t >= a.us),
nxt AS (SELECT w.mmsi, w.t, a.us AS nus, a.lon AS nlon, a.lat AS nlat FROM want w ASOF LEFT JOIN aisw a ON w.mmsi = a.mmsi AND w.t <= a.us),
near AS (SELECT * FROM prv JOIN nxt USING (mmsi, t))"""


def wrap(x: str) -> str:
    return f"((({x} + 180e0) % 360e0 + 360e0) % 360e0 - 180e0)"


DLON = "(nlon - plon)"
TOLERANCE, BRACKET, EDGE, KNOTS = 3 * HOUR, 12 * HOUR, HOUR, 50.0
V2_SQL = f"""{near_sql(TOLERANCE)}, pos AS (
  SELECT mmsi, t, us, lon, lat FROM (
    SELECT mmsi, t, CASE WHEN left_side THEN pus ELSE nus END AS us, CASE WHEN left_side THEN plon ELSE nlon END AS lon, CASE WHEN left_side THEN plat ELSE nlat END AS lat
    FROM (SELECT *, nus IS NULL OR coalesce(t - pus <= nus - t, false) AS left_side FROM near)) WHERE abs(us - t) <= {TOLERANCE})"""
V21_ALL_SQL = f"""{near_sql(BRACKET)}, bracket AS (
  SELECT *, {haversine('plat', 'plon', 'nlat', 'nlon')} / 1.852e0 / nullif((nus - pus) / 3.6e9, 0) AS knots, nus IS NULL OR coalesce(t - pus <= nus - t, false) AS left_side FROM near
), chosen AS (
  SELECT *, CASE WHEN left_side THEN pus ELSE nus END AS eus, CASE WHEN left_side THEN plon ELSE nlon END AS elon, CASE WHEN left_side THEN plat ELSE nlat END AS elat,
    CASE WHEN nus = t THEN 'exact' WHEN nus - pus <= {BRACKET} AND knots <= {KNOTS} THEN 'interp' WHEN abs(CASE WHEN left_side THEN pus ELSE nus END - t) <= {EDGE} THEN 'edge_nearest' ELSE 'unavailable' END AS method FROM bracket
), pos21 AS (
  SELECT mmsi, t, method,
    CASE method WHEN 'exact' THEN nlon WHEN 'interp' THEN {wrap(f'plon + (t - pus) / CAST(nus - pus AS DOUBLE) * {wrap(DLON)}')} WHEN 'edge_nearest' THEN elon END AS lon,
    CASE method WHEN 'exact' THEN nlat WHEN 'interp' THEN plat + (t - pus) / CAST(nus - pus AS DOUBLE) * (nlat - plat) WHEN 'edge_nearest' THEN elat END AS lat,
    CASE method WHEN 'exact' THEN 0e0 WHEN 'interp' THEN (nus - pus) / 6e7 END AS gap_min,
    CASE method WHEN 'exact' THEN 0e0 WHEN 'interp' THEN least(t - pus, nus - t) / 6e7 WHEN 'edge_nearest' THEN abs(eus - t) / 6e7 END AS offset_min FROM chosen)"""
V21_SQL = V21_ALL_SQL + ", pos AS (SELECT mmsi, t, lon, lat FROM pos21 WHERE method <> 'unavailable')"
CLOUD_SQL = f"cloud AS (SELECT {columns(CLOUD)} FROM part)"
ENSEMBLE_SQL = f"ens AS (SELECT {columns(ENSEMBLE)} FROM lineitem)"
BACKWARD_SQL = f"bwd AS (SELECT {columns(BACKWARD)} FROM lineitem)"

"""Queries of synthetic cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from wakeline.operators import cases
from wakeline.plans.attribution import positions_v2
from wakeline.plans.registry import query
from wakeline.sources import testdata as td

STRATA, DURATIONS = ((0, 3), (3, 12), (12, 24), (24, 40)), (2, 4, 6, 8)
EACH, TRIES, SEED = 6, 50, 3
BOUNDS, MARGIN, COVER = (-93.5, 24.5, -88.0, 28.5), 0.25, 0.8


def chance_sql(salt: int) -> str:
    return f"((x{salt} // 65536 + x{salt} % 65536 * 40503) % 4294967296)"


X = ", ".join(f"((t * 31 + k * 17 + {s} * 1009 + {SEED} * 7919 + 1) * 2654435761) % 4294967296 AS x{s}" for s in range(3))
W, S, E, N = BOUNDS


@query("release_cases", f"""WITH {td.V2_SQL}, pool AS (SELECT mmsi, ({td.T0} - t) / 3.6e9 AS tau, lon, lat FROM pos), ent AS (SELECT mmsi, row_number() OVER (ORDER BY mmsi) - 1 AS e, count(*) OVER () AS n FROM (SELECT DISTINCT mmsi FROM pool)),
st(k, lo, hi) AS (VALUES {', '.join(f'({k}, {lo}, {hi})' for k, (lo, hi) in enumerate(STRATA))}), h AS (SELECT t, k, lo, hi, {X} FROM range({EACH * TRIES}) a(t), st),
drawn AS (SELECT t, k, lo, hi, {chance_sql(0)} % (SELECT max(n) FROM ent) AS e, [{', '.join(map(str, DURATIONS))}][{chance_sql(1)} % {len(DURATIONS)} + 1] AS d, floor(lo + {chance_sql(2)} / 4294967296e0 * (hi - lo) + 5e-1) AS tau_end FROM h),
seen AS (SELECT k, t, lo, hi, drawn.e, any_value(ent.mmsi) AS mmsi, d, tau_end, count(*) AS n_points, bool_and(lon BETWEEN {W + MARGIN} AND {E - MARGIN} AND lat BETWEEN {S + MARGIN} AND {N - MARGIN}) AS ok, sqrt(((max(lon) - min(lon)) * 99) ** 2 + ((max(lat) - min(lat)) * 111) ** 2) AS km
  FROM drawn JOIN ent ON ent.e = drawn.e JOIN pool ON pool.mmsi = ent.mmsi AND tau > tau_end AND tau <= tau_end + d GROUP BY ALL HAVING ok AND n_points >= {COVER} * d),
kept AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY t) AS p FROM seen QUALIFY p <= {EACH})
SELECT 1000 + k * {EACH} + p - 1 AS case_id, lo || '-' || hi || 'h' AS stratum, mmsi, tau_end AS tau_end_h, tau_end + d AS tau_start_h, d AS duration_h, n_points, km AS track_extent_km, km > 1 AS moving FROM kept""", "tau_end_h tau_start_h track_extent_km")
def _(spark, d):
    pool = positions_v2(spark, d).select("mmsi", ((td.T0 - F.col("t")) / 3.6e9).alias("tau_h"), "lon", "lat")
    return cases.sample_cases(pool, EACH, STRATA, DURATIONS, 1.0, BOUNDS, COVER, MARGIN, TRIES, SEED)

"""Nearest labelled detections: places meet once, also where many events share one."""

import random

from pyspark.sql import functions as F

from wakeline.functions.geo import haversine_km
from wakeline.operators import matching


def test_events_at_one_place_meet_detections_once(spark, monkeypatch):
    """Before, each event met each detection near it."""
    pick = random.Random(4)
    places = [(round(pick.uniform(0, 0.5), 2), round(pick.uniform(40, 40.4), 2)) for _ in range(8)]
    found = [(k, *pick.choice(places), pick.choice(("ais_moving", "ais_stationary", "dark_vessel_candidate")), f"m{k % 3}") for k in range(200)]
    events = [(k, *places[k % 5]) for k in range(100)] + [(7, *places[0]), (7, *places[1])]  # 7 is at several places
    at = spark.createDataFrame(found, "det_id long, lon double, lat double, label string, match_id string")
    ev = spark.createDataFrame(events, "cluster_id long, lon double, lat double")
    rows = []
    real = matching.radius_join
    monkeypatch.setattr(matching, "radius_join", lambda *a, **k: rows.append(real(*a, **k)) or rows[-1])
    got = sorted(tuple(r) for r in matching.sar_evidence(ev, at).collect())
    assert rows[0].count() <= 8 * 3 * 2 * 5
    cross = ev.withColumnsRenamed({"lon": "x", "lat": "y"}).crossJoin(at.filter("label like 'ais%'")).withColumn("d", haversine_km(F.col("lat"), F.col("lon"), F.col("y"), F.col("x"))).filter("d <= 25")
    least = cross.groupBy("cluster_id", "match_id").agg(F.min(F.struct("d", "det_id", "label")).alias("n"))
    assert got == sorted((r.cluster_id, r.match_id, r.n.label, r.n.d) for r in least.collect())

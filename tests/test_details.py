"""Refusals of writers, overrides and comparisons at their edges."""

import pytest
from pyspark.sql import functions as F

from wakeline.operators import audit, events, evidence
from wakeline.sources import sinks


def test_a_table_is_written_once(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "id long")
    path = sinks.write_once(df, f"{tmp_path}/a")
    with pytest.raises(Exception, match="(?i)already exists"):
        sinks.write_once(df, path)
    with pytest.raises(PermissionError, match="frozen"):
        sinks.write_once(df, f"{tmp_path}/frozen/b", frozen=[f"{tmp_path}/frozen/"])
    with pytest.raises(PermissionError, match="frozen"):
        sinks.write_once(df, f"{tmp_path}/frozen", frozen=[f"{tmp_path}/frozen"])
    assert spark.read.parquet(sinks.write_once(df, f"{tmp_path}/frozen2", frozen=[f"{tmp_path}/frozen"])).count() == 1


def test_without_names_the_ranking_stands(spark):
    ranked = spark.createDataFrame([(1, True), (2, False)], "component long, selected boolean")
    none = spark.createDataFrame([], "component long")
    got = {r.component: (r.selected, r.selection_basis) for r in events.with_override(ranked, none).collect()}
    assert got == {1: (True, "policy_top_potential"), 2: (False, "")}
    named = spark.createDataFrame([(2,), (2,), (9,)], "component long")
    got = [(r.component, r.selected, r.selection_basis) for r in events.with_override(ranked, named).orderBy("component").collect()]
    assert got == [(1, False, ""), (2, True, "analyst_override")]


def test_orders_of_rankings(spark):
    a = [("g", "x", 1), ("g", "y", 2), ("g", "z", 3), ("h", "x", 1), ("h", "y", 1), ("i", "x", 1), ("j", "x", None)]
    b = [("g", "y", 1), ("g", "x", 2), ("g", "z", 3), ("h", "y", 1), ("h", "x", 1), ("k", "x", 1)]
    one, two = (spark.createDataFrame(x, "grp string, key string, r int") for x in (a, b))
    got = {r.grp: (r.n, r.same_members, r.same_order) for r in audit.identical_order(one, two, "key", "grp", "r", 2).collect()}
    assert got == {"g": (2, True, False), "h": (2, True, True), "i": (1, False, False), "k": (0, False, False)}


def test_null_scores_are_below_every_threshold(spark):
    df = spark.createDataFrame([(0.9, True), (None, True), (0.2, False), (None, False)], "p double, truth boolean")
    got = {r.threshold: (r.precision, r.recall) for r in audit.threshold_sweep(df, "p", F.col("truth"), [0.1, 0.5]).collect()}
    assert got == {0.1: (0.5, 0.5), 0.5: (1.0, 0.5)}


def test_static_columns_of_silent_entities(spark):
    rows = [("1", " ", None, None), ("1", None, None, 3.0), ("2", "B", 70, 5.0), ("2", "A", 71, None), ("2", " A ", 71, 9.0)]
    df = spark.createDataFrame(rows, "mmsi string, name string, vessel_type int, length_m double")
    got = {r.mmsi: (r.name, r.vessel_type, r.length_m) for r in evidence.static_columns(df).collect()}
    assert got == {"1": ("", None, 3.0), "2": ("A", 71, 9.0)}


def test_cases_keep_to_their_rules(spark):
    from wakeline.operators import cases

    hours = [k * 0.5 for k in range(1, 100)]
    pool = [("still", h, 0.0, 0.0) for h in hours] + [("moves", h, h * 0.05, 0.0) for h in hours] + [("gaps", h, 0.0, 0.0) for h in hours if h % 4 == 0] + [("outside", h, 9.9, 0.0) for h in hours]
    pool += [(None, 1.0, 0.0, 0.0), ("still", None, 0.0, 0.0)]
    df = spark.createDataFrame(pool, "mmsi string, tau_h double, lon double, lat double")
    rules = dict(per_stratum=10, strata=((0, 3), (12, 24), (60, 70)), durations_h=(2, 4), step_h=0.5, bounds=(-10.0, -10.0, 10.0, 10.0), seed=1)
    got = cases.sample_cases(df, **rules).collect()
    assert {r.stratum for r in got} == {"0-3h", "12-24h"} and len(got) == 20  # no points lie in the third
    assert {r.mmsi for r in got} == {"still", "moves"} and len({r.case_id for r in got}) == 20
    for r in got:
        lo, hi = map(int, r.stratum.removesuffix("h").split("-"))
        inside = [p for p in pool if p[0] == r.mmsi and p[1] is not None and r.tau_end_h < p[1] <= r.tau_start_h]
        assert lo <= r.tau_end_h <= hi and r.tau_end_h * 2 == int(r.tau_end_h * 2) and r.duration_h in (2, 4)
        assert r.n_points == len(inside) >= 0.8 * r.duration_h / 0.5
        assert r.moving == (r.mmsi == "moves")
    assert sorted(map(tuple, cases.sample_cases(df.repartition(5), **rules).collect())) == sorted(map(tuple, got))
    assert cases.sample_cases(df.limit(0), **rules).collect() == []


def test_rounds_and_wraps_as_sql_does(spark):
    import random

    import duckdb

    from wakeline.functions.geo import wrap180
    from wakeline.plans.registry import rounded
    from wakeline.sources.testdata import wrap

    pick = random.Random(3)
    values = [None, 0.0, -0.0, 0.49999999999999994, 1e300, 2.0**53 + 2, float("inf"), float("-inf"), 1.005, -92.985, 2.675, 179.99999999999997, -180.0]
    values += [-93 + pick.randrange(10**6) / 1e5 for _ in range(2000)] + [k + 0.005 for k in range(-99, 99)] + [pick.uniform(-400, 400) for _ in range(500)]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double").cache()
    con = duckdb.connect()
    con.execute("CREATE TABLE t (k INT, v DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(values)))
    for digits in (2, 6):
        got = [r[0] for r in df.orderBy("k").select(rounded(F.col("v"), digits)).collect()]
        assert got == [r[0] for r in con.execute(f"SELECT round(v, {digits}) FROM t ORDER BY k").fetchall()]
    finite = "v IS NOT NULL AND abs(v) < 1e6"
    got = [r[0] for r in df.filter(finite).orderBy("k").select(wrap180(F.col("v"))).collect()]
    assert got == [r[0] for r in con.execute(f"SELECT {wrap('v')} FROM t WHERE {finite} ORDER BY k").fetchall()]

"""Joins whose pairs far outnumber their rows: every pair, in many tasks."""

import random

import pytest
from pyspark.sql import functions as F

from wakeline.operators import buckets, hashing, similarity, tables


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("crowd", [2048, 7])
def test_every_pair_of_a_crowd(spark, crowd):
    left = spark.range(60).select(F.col("id").alias("a"), F.when(F.col("id") < 50, 0).otherwise(F.col("id")).alias("k"))
    right = spark.range(40).select(F.col("id").alias("b"), (F.col("id") % 2 * 55).alias("k"))
    got = [tuple(r) for r in buckets.dealt_join(left, right, ["k"], crowd).select("a", "b").collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a in range(60) for b in range(40) if (0 if a < 50 else a) == b % 2 * 55}


def test_windows_are_dealt_to_tasks(spark):
    """Before, the grid cells of a small file went through the driver, and one task made all pairs."""
    rows = [(k, k * 7919 % 1201 - 300, k * 104729 % 907 - 300) for k in range(400)]
    met = tables.shared_windows(spark.createDataFrame(rows, "id long, col0 long, row0 long"), 256)
    assert "Broadcast" not in plan_of(met)
    want = {(a, b, max(0, d - c), max(0, s - r), max(0, c - d), max(0, r - s), 256 - abs(c - d), 256 - abs(r - s)) for a, c, r in rows for b, d, s in rows if a < b and abs(c - d) < 256 and abs(r - s) < 256}
    got = [tuple(r) for r in met.collect()]
    assert len(got) == len(want) and set(got) == want
    assert met.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_few_hashes_meet(spark, monkeypatch):
    """Before, eight bands of seven or eight bits let one pair of random hashes in 28 meet."""
    rows = [(n, pick.getrandbits(63)) for pick in [random.Random(7)] for n in range(2000)]
    df = spark.createDataFrame(rows, "id long, hash long")
    met = []
    real = hashing.dealt_join
    monkeypatch.setattr(hashing, "dealt_join", lambda *a: met.append(real(*a)) or met[-1])
    assert hashing.near_hashes(df, df, 7).count() == 2000
    assert met[0].count() < 2000 * 2000 / 200


def test_near_copies_are_found_without_patterns(spark, monkeypatch):
    """Before, each vector was written under hundreds of sign patterns, and candidates were shuffled with both vectors."""
    pick = random.Random(8)
    rows = [(n, [pick.gauss(0, 1) for _ in range(64)]) for n in range(300)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    held = []
    real = similarity.cut
    monkeypatch.setattr(similarity, "cut", lambda df, name: held.append(real(df, name)) or held[-1])
    got = similarity.similar_pairs(df, df.withColumn("v", F.transform("v", lambda x: x * 2)), 0.97)
    assert {(r.a, r.b) for r in got.collect()} == {(n, n) for n in range(300)}
    assert sum(t.count() for t in held) <= 4 * 300

"""Pairs of near rows, each made once, in many tasks."""

import math
import random

from wakeline.operators import buckets, events, tables


def test_near_pairs_are_made_once_and_dealt(spark, monkeypatch):
    """Before, every pair was made both ways, in the few tasks of a small file."""
    pick = random.Random(3)
    rows = [(pick.randrange(10**6), pick.uniform(-9000, 9000), pick.uniform(-9000, 9000), float(k * 11 % 180)) for k in range(400)]
    made = []
    real = buckets.dealt_join
    monkeypatch.setattr(buckets, "dealt_join", lambda *a: made.append(real(*a)) or made[-1])
    met = events.near_pairs(spark.createDataFrame(rows, "id long, x_m double, y_m double, bearing double"), 3000.0)
    assert met.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = [tuple(r) for r in met.collect()]
    want = {}
    for a in rows:
        for b in rows:
            if a[0] < b[0] and math.hypot(a[1] - b[1], a[2] - b[2]) <= 3000.0:
                turn = abs(a[3] - b[3]) % 180
                want[a[0], b[0]] = (math.hypot(a[1] - b[1], a[2] - b[2]), min(turn, 180 - turn))
    assert len(got) == len(want)
    for a, b, gap, turn in got:
        assert math.isclose(want[a, b][0], gap, rel_tol=1e-12) and want[a, b][1] == turn
    cells = lambda r: (math.floor(r[1] / 3000), math.floor(r[2] / 3000))
    both = sum(max(abs(p - q) for p, q in zip(cells(a), cells(b), strict=True)) <= 1 for a in rows for b in rows)
    assert made[0].count() < 0.6 * both + 400


def test_windows_are_made_once(spark, monkeypatch):
    """Before, every pair of tiles was made both ways."""
    made = []
    real = buckets.dealt_join
    monkeypatch.setattr(buckets, "dealt_join", lambda *a: made.append(real(*a)) or made[-1])
    crowd = spark.createDataFrame([(k, k % 7, k % 5) for k in range(100)], "id long, col0 long, row0 long")
    assert tables.shared_windows(crowd, 64).count() == 100 * 99 // 2
    assert made[0].count() == 100 * 100  # one cell against itself, not nine
    spread = spark.createDataFrame([(k, (k % 2) * 40, 0) for k in range(100)], "id long, col0 long, row0 long")
    assert tables.shared_windows(spread, 32).count() == 2 * (50 * 49 // 2)
    assert made[1].count() == 2 * 50 * 50 + 50 * 50  # across cells each pair once

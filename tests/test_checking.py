"""Hashes in bands against all pairs, folds by their definition, checks that fail, numbers without one large task."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from wakeline.operators import checks, folds, hashing, numbering
from wakeline.sources import work


@pytest.mark.parametrize("radius", [0, 3, 7])
def test_hashes_in_bands(spark, radius):
    pick = random.Random(1)
    base = [pick.getrandbits(63) for _ in range(30)]
    rows = [(n, pick.choice(base) ^ sum(1 << k for k in pick.sample(range(63), pick.randint(0, 9)))) for n in range(150)]
    rows += [(n, base[0]) for n in range(200, 230)] + [(300, None), (301, 0), (302, 2**63 - 1)]
    df = spark.createDataFrame(rows, "id long, hash long")
    got = hashing.near_hashes(df, df, radius).collect()
    held = [(i, h) for i, h in rows if h is not None]
    want = {(i, j, (g ^ h).bit_count()) for i, g in held for j, h in held if (g ^ h).bit_count() <= radius}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_hash_of_odd_vectors(spark):
    rows = [(1, [float(k) for k in range(64)]), (2, [0.0] * 64), (3, None), (4, [1.0] * 63), (5, [None] + [1.0] * 63)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = {r.id: r.h for r in df.select("id", hashing.difference_hash("v").alias("h")).collect()}
    assert got == {1: 2**63 - 1, 2: 0, 3: None, 4: None, 5: None}


def test_few_hashes_are_compared(spark):
    pick = random.Random(3)
    rows = [(n, pick.getrandbits(63)) for n in range(800)]
    df = spark.createDataFrame(rows, "id long, hash long")
    plan = hashing.near_hashes(df, df, 7)
    assert plan.count() == 800  # each with itself; of random hashes, bands of seven bits leave one pair in sixteen


def orders(seed):
    pick = random.Random(seed)
    return [(g, pick.choices(["a", "b", None], [6, 3, 1])[0]) for g in range(70) for _ in range(pick.choice([1, 1, 1, 2, 3, 8]))] + [(None, "a"), (None, "b")]


def test_folds_hold_whole_groups_evenly(spark):
    rows = orders(4)
    df = spark.createDataFrame(rows, "g long, y string")
    got = folds.group_folds(df, "g", F.col("y"), 4).collect()
    by_group = Counter(g for g, _ in rows)
    assert {r.g: r.n for r in got} == by_group and len(got) == len(by_group)
    fold = {r.g: r.fold for r in got}
    assert set(fold.values()) == set(range(4))
    held = defaultdict(Counter)
    for g, y in rows:
        held[y][fold[g]] += 1
    for counts in held.values():
        assert max(counts.values()) - min(counts[f] for f in range(4)) <= 4
    again = folds.group_folds(df.repartition(7), "g", F.col("y"), 4).collect()
    assert {r.g: r.fold for r in again} == fold


def test_folds_beyond_the_bound_are_by_turns(spark):
    rows = orders(5)
    got = folds.group_folds(spark.createDataFrame(rows, "g long, y string"), "g", F.col("y"), 4, most_kinds=2).collect()
    assert len(got) == len({g for g, _ in rows}) and all(r.fold in range(4) for r in got)


def test_deal_is_greedy():
    dealt = folds.deal([([4, 0], 3), ([0, 3], 2), ([1, 1], 1)], 2)
    assert dealt == [[0, 1, 0], [1, 0], [1]]
    assert folds.deal([], 3) == []


def test_checks(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (3, None)], "id long, n long")
    good = checks.checked(df, "good", rows=F.count("*") == 3, ids=checks.every(F.col("id") > 0))
    assert sorted(r.id for r in good.collect()) == [1, 2, 3]
    with work.tables_written() as tables, pytest.raises(checks.BrokenCheck, match="n is False"):
        checks.checked(df, "bad", rows=F.count("*") == 3, n=checks.every(F.col("n") > 0))
    with pytest.raises(Exception, match="(?i)not.*exist"):
        spark.read.parquet(tables[0])
    with pytest.raises(checks.BrokenCheck, match="total is None"):
        checks.checked(df.limit(0), "none", total=F.sum("n") == 0)
    assert checks.checked(df.limit(0), "empty", all=checks.every(F.col("n") > 0)).count() == 0


def test_numbers(spark):
    pick = random.Random(6)
    rows = [(pick.choice(["x", "x", "x", "y", None]), pick.randint(0, 10**6), k) for k in range(500)]
    df = spark.createDataFrame(rows, "g string, v long, id long").repartition(6)
    for within in ([], ["g"]):
        got = numbering.numbered(df, [F.desc("v"), F.col("id")], "at", within).collect()
        groups = defaultdict(list)
        for g, v, k in rows:
            groups[g if within else 0].append((-v, k))
        want = {k: n for group in groups.values() for n, (_, k) in enumerate(sorted(group))}
        assert {r.id: r.at for r in got} == want and len(got) == len(rows)
    assert numbering.numbered(df.limit(0), ["v"], "at").collect() == []

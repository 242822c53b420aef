"""Quantiles of near pairs' distances against a list of all pairs."""

import math
import random

import numpy as np

from wakeline.operators import gaps


def test_quantiles_are_those_of_all_pairs(spark, monkeypatch):
    pick = random.Random(6)
    rows = [(k, pick.uniform(-40, 40), pick.choice((0.0, 3.0, 12.5)), k % 3 // 2, k % 2) for k in range(150)] + [(900, None, 1.0, 0, 0), (901, math.nan, 1.0, 0, 0)]
    want = {}
    for n, a in enumerate(rows[:150]):
        for b in rows[n + 1 : 150]:
            if (d := math.hypot(a[1] - b[1], a[2] - b[2])) <= 10.0:
                want.setdefault((max(a[3], b[3]), a[4] == b[4]), []).append(d)
    parts = spark.createDataFrame(rows, "id long, x_m double, y_m double, kind int, twin int")
    monkeypatch.setattr(gaps, "SLICE", 20)
    monkeypatch.setattr(gaps, "BLOCK", 100)
    got = {(r.kind, r.same): tuple(r)[2:] for r in gaps.gap_quantiles(parts, 10.0, 2, (0.1, 0.5, 0.9)).collect()}
    assert got.keys() == want.keys()
    for k, d in want.items():
        assert np.allclose(got[k], (len(d), *np.quantile(d, [0.1, 0.5, 0.9])), rtol=1e-12)
    assert gaps.gap_quantiles(parts.limit(0), 10.0, 2, (0.5,)).collect() == []

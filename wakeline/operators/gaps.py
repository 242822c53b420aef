"""Exact quantiles of the distances of near pairs, without a row for each pair.

Pairs are made and counted in tasks, each for the parts of one cell and its neighbours, in blocks of bounded size. A first
pass counts them in narrow bins; the bins that hold the places asked for are known then, and a second pass counts the
distances in these alone.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wakeline.functions.nulls import finite
from wakeline.operators.buckets import NEAR, cell
from wakeline.sources.work import cut

#: Bins of a distance, parts of a cell in one task, and pairs held at once.
BINS, SLICE, BLOCK = 1 << 14, 4096, 1 << 18


def gap_quantiles(parts: DataFrame, gap_m: float, kinds: int, shares: Sequence[float]) -> DataFrame:
    """(kind, same, n, q0, q1, ...): number and interpolated quantiles of the distances of pairs of parts (id, x_m, y_m,
    kind: 0 to ``kinds`` - 1, twin: 0 or 1) at most ``gap_m`` apart. A pair is of the greater kind of its two parts;
    ``same`` tells whether their twins are equal."""
    x, y = (F.col(c).cast("double") for c in ("x_m", "y_m"))
    held = parts.filter(F.col("id").isNotNull() & finite(x, y)).select("id", x.alias("x"), y.alias("y"), F.col("kind").cast("int"), F.col("twin").cast("int"), cell(x, gap_m).alias("cx"), cell(y, gap_m).alias("cy"))
    held = cut(held, "parts")
    sizes = held.groupBy("cx", "cy").agg(F.ceil(F.count("*") / SLICE).alias("slices"))
    own = cut(held.join(sizes, ["cx", "cy"]).withColumn("slice", F.pmod(F.xxhash64("id"), F.col("slices"))).drop("slices"), "own")
    around = held
    for c in ("cx", "cy"):
        around = around.withColumn(c, F.explode(F.array(*(F.col(c) + k for k in NEAR))))
    around = cut(around.join(sizes, ["cx", "cy"]).withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1))).drop("slices"), "around")
    wide = gap_m / BINS

    def counted(chosen: dict[int, np.ndarray] | None) -> DataFrame:
        """(code, v, n): bins, or the distances in the ``chosen`` bins of each code, with their number of pairs."""

        def count(mine: pa.Table, theirs: pa.Table) -> pa.Table:
            a, b = ({c: t.column(c).to_numpy() for c in ("id", "x", "y", "kind", "twin")} for t in (mine, theirs))
            bins, found = np.zeros((2 * kinds, BINS + 1), np.int64), []
            step = max(1, BLOCK // max(1, len(b["id"])))
            for at in range(0, len(a["id"]) if len(b["id"]) else 0, step):
                i, j = np.nonzero(a["id"][at : at + step, None] < b["id"][None])
                d = np.hypot(a["x"][at : at + step][i] - b["x"][j], a["y"][at : at + step][i] - b["y"][j])
                near = d <= gap_m
                i, j, d = i[near] + at, j[near], d[near]
                code = np.maximum(a["kind"][i], b["kind"][j]) * 2 + (a["twin"][i] == b["twin"][j])
                bin_ = np.minimum((d / wide).astype(np.int64), BINS)
                if chosen is None:
                    bins += np.bincount(code * (BINS + 1) + bin_, minlength=bins.size).reshape(bins.shape)
                else:
                    for c, wanted in chosen.items():
                        found.append((c, d[(code == c) & wanted[bin_]]))
            if chosen is None:
                c, v = np.nonzero(bins)
                return pa.table({"code": c, "v": v.astype(float), "n": bins[c, v]})
            out = []
            for c in chosen:
                v, n = np.unique(np.concatenate([np.zeros(0), *(d for k, d in found if k == c)]), return_counts=True)
                out.append(pa.table({"code": np.full(len(v), c, np.int64), "v": v, "n": n.astype(np.int64)}))
            return pa.concat_tables(out)

        by = ["cx", "cy", "slice"]
        return own.groupBy(*by).cogroup(around.groupBy(*by)).applyInArrow(count, "code long, v double, n long").groupBy("code", "v").agg(F.sum("n").alias("n"))

    bins = [tuple(r) for r in counted(None).collect()]  # at most BINS a code
    rows, chosen, asked = [], {}, []
    for code in sorted({c for c, *_ in bins}):
        at, n = (np.array(v) for v in zip(*sorted((int(v), n) for c, v, n in bins if c == code), strict=True))
        upto, whole = np.cumsum(n), int(n.sum())
        wanted = np.zeros(BINS + 1, bool)
        for share in shares:
            place = share * (whole - 1)
            for k in (int(place), min(int(place) + 1, whole - 1)):
                hit = int(np.searchsorted(upto, k, side="right"))
                wanted[at[hit]] = True
                asked.append((code, float(at[hit]), k - int(upto[hit] - n[hit])))
        chosen[code] = wanted
        rows.append((code, whole))
    spark = parts.sparkSession
    schema = "kind int, same boolean, n long, " + ", ".join(f"q{k} double" for k in range(len(shares)))
    if not rows:
        return spark.createDataFrame([], schema)
    places = spark.createDataFrame(asked, "code long, bin double, k long").distinct()
    values = cut(counted(chosen).withColumn("bin", F.least(F.floor(F.col("v") / wide), F.lit(BINS)).cast("double")), "values")
    upto = values.withColumn("upto", F.sum("n").over(Window.partitionBy("code", "bin").orderBy("v")))
    hit = {(r.code, r.bin, r.k): r.v for r in upto.join(F.broadcast(places), ["code", "bin"]).filter("k < upto AND k >= upto - n").select("code", "bin", "k", "v").collect()}
    out, step = [], iter(asked)
    for code, whole in rows:
        q = []
        for share in shares:
            low, high = hit[next(step)], hit[next(step)]
            part = share * (whole - 1)
            q.append(low + (high - low) * (part - int(part)))
        out.append((code // 2, bool(code % 2), whole, *q))
    return spark.createDataFrame(out, schema)

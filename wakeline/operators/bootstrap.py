"""Bootstrap of ratios of sums over tiles, with exact multinomial weights that a hash decides.

A draw picks as many tiles as there are, with replacement. The tiles are dealt into blocks; the driver splits each draw's
picks over the blocks (a row of numbers for each block), and a task splits a block's share over its tiles, both by
conditional binomials: of the picks left, those for the next one of m equal places are binomial with probability 1 / m.
A binomial is the inverse of its distribution function at a hash of draw and place. A task adds up all draws of its block
in arrays, so that no row is made for a tile and a draw.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wakeline.functions.nulls import safe_ratio
from wakeline.sources.work import cut

#: Tiles of a block.
BLOCK = 4096


def uniform(draw: np.ndarray, place: int, seed: int) -> np.ndarray:
    """Numbers inside (0, 1) from a 32-bit mix of draw, place and seed."""
    h = (draw.astype(np.uint64) * np.uint64(2654435761) + np.uint64((place * 40503 + seed * 69069 + 1) % 2**32)) & np.uint64(0xFFFFFFFF)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = ((h ^ (h >> np.uint64(shift))) * np.uint64(factor)) & np.uint64(0xFFFFFFFF)
    return ((h ^ (h >> np.uint64(16))).astype(np.float64) + 0.5) / 2.0**32


def binomial(n: np.ndarray, p: float, u: np.ndarray) -> np.ndarray:
    """The least k whose distribution function is not below ``u``, for each n."""
    if p >= 1:
        return n.copy()
    factorial = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, int(n.max(initial=0)) + 1)))])
    spread = 12 * np.sqrt(n * p * (1 - p)) + 12
    low = np.maximum(0, np.floor(n * p - spread)).astype(np.int64)
    out = np.empty(len(n), np.int64)
    width = int((2 * spread).max(initial=0)) + 2
    for at in range(0, len(n), max(1, 4_000_000 // width)):
        rows = slice(at, at + max(1, 4_000_000 // width))
        m = n[rows, None]
        k = low[rows, None] + np.arange(width)
        inside = k <= m
        j = np.minimum(k, m)
        log_p = factorial[m] - factorial[j] - factorial[m - j] + j * np.log(p) + (m - j) * np.log1p(-p)
        upto = np.cumsum(np.where(inside, np.exp(log_p), 0.0), axis=1)
        out[rows] = low[rows] + (upto < u[rows, None]).sum(axis=1)
    return np.minimum(out, n)


def split(n: np.ndarray, sizes: list[int], first: int, seed: int) -> list[np.ndarray]:
    """How many of each draw's ``n`` picks fall to each of several groups of equal places, whose hash places begin at ``first``."""
    draws, left, total, out = np.arange(1, len(n) + 1), n.copy(), sum(sizes), []
    for k, size in enumerate(sizes):
        picked = binomial(left, size / total, uniform(draws, first + k, seed))
        out.append(picked)
        left, total = left - picked, total - size
    return out


def bootstrap_sums(tiles: DataFrame, draws: int, columns: tuple[str, ...], tile: str = "tile", seed: int = 0, block: int = BLOCK) -> DataFrame:
    """(draw, *columns): the sums of ``columns`` over the tiles of each draw. ``tiles`` has one row for each tile, in the
    order of which they are numbered; nulls add nothing. Without tiles there are no rows."""
    # Numbers without a window over all: ranges of tiles, counted, then numbered within.
    dealt = tiles.select(F.col(tile).alias("_t"), *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns))
    spread = cut(dealt.repartitionByRange("_t").withColumn("_r", F.spark_partition_id()), "tiles")
    sizes = {r["_r"]: r["n"] for r in spread.groupBy("_r").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    if not total:
        return dealt.select(F.lit(0).alias("draw"), *columns).limit(0)
    spark, starts, at = tiles.sparkSession, [], 0
    for r in sorted(sizes):
        starts.append((r, at))
        at += sizes[r]
    within = F.row_number().over(Window.partitionBy("_r").orderBy("_t")) - 1
    placed = spread.join(F.broadcast(spark.createDataFrame(starts, "_r int, _first long")), "_r").withColumn("_at", F.col("_first") + within)
    blocks = [min(block, total - k) for k in range(0, total, block)]
    # Hash places: those of the tiles, then those of the blocks.
    shares = split(np.full(draws, total, np.int64), blocks, total, seed)
    share_rows = spark.createDataFrame([(k, s.tolist()) for k, s in enumerate(shares)], "_b long, _picks array<long>")

    def weigh(mine: pa.Table) -> pa.Table:
        mine = mine.sort_by("_at")
        picks = np.array(mine.column("_picks")[0].as_py(), np.int64)
        values = np.stack([mine.column(c).to_numpy() for c in columns])
        sums = np.zeros((len(columns), draws))
        for k, weight in enumerate(split(picks, [1] * len(mine), mine.column("_at")[0].as_py(), seed)):
            sums += values[:, k, None] * weight
        return pa.table({"draw": pa.array(np.arange(1, draws + 1, dtype=np.int32))} | {c: pa.array(s) for c, s in zip(columns, sums, strict=True)})

    kinds = ", ".join(f"{c} double" for c in columns)
    keyed = placed.withColumn("_b", F.floor(F.col("_at") / block)).join(share_rows, "_b")
    return keyed.groupBy("_b").applyInArrow(weigh, f"draw int, {kinds}").groupBy("draw").agg(*(F.sum(c).alias(c) for c in columns))


def interval(sums: DataFrame, above: str, below: str, level: float = 0.95) -> DataFrame:
    """(mean, lo, hi, draws) of the ratio of two sums; draws whose denominator is zero are left out."""
    ratio = sums.select(safe_ratio(F.col(above), F.col(below)).alias("x")).filter("x IS NOT NULL")
    side = (1 - level) / 2
    return ratio.agg(F.avg("x").alias("mean"), F.percentile("x", F.lit(side)).alias("lo"), F.percentile("x", F.lit(1 - side)).alias("hi"), F.count("*").alias("draws"))

"""Difference hashes of vectors, and pairs of hashes that differ in few bits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.operators.buckets import dealt_join
from wakeline.sources.work import cut

#: Bits of a hash: of 64 numbers, whether each but the first is larger than the one before.
BITS = 63


def difference_hash(vector: str) -> Column:
    """63 bits in a long; a vector of another length than 64, or with a null, has none."""
    steps = " | ".join(f"if({vector}[{k + 1}] > {vector}[{k}], {1 << k}L, 0L)" for k in range(BITS))
    whole = f"size({vector}) = {BITS + 1} AND NOT exists({vector}, x -> x IS NULL)"
    return F.expr(f"CASE WHEN {whole} THEN {steps} END")


def near_hashes(left: DataFrame, right: DataFrame, radius: int, bits: int = BITS) -> DataFrame:
    """(a, b, distance): ids of ``left`` and ``right`` (id, hash) whose hashes differ in at most ``radius`` bits.

    Cut into radius // 2 + 1 bands, such hashes differ in one bit at most of some band. Left hashes therefore go under each
    band as it is and with each of its bits flipped, right ones as they are; a pair that meets in several bands counts in
    the first. Only distinct hashes are compared, then ids follow, so that a hash of many rows is compared once. Null
    hashes pair with none.
    """
    left, right = (cut(df.filter("hash IS NOT NULL").select("id", "hash"), "hashed") for df in (left, right))
    bands = radius // 2 + 1
    most = radius // bands
    ends = [bits * k // bands for k in range(bands + 1)]

    def part(x: Column, k: int) -> Column:
        return F.shiftrightunsigned(x, ends[k]).bitwiseAND(F.lit((1 << (ends[k + 1] - ends[k])) - 1).cast("long"))

    def prepared(df: DataFrame, name: str, flipped: bool) -> DataFrame:
        flips = lambda k: [0, *(1 << j for j in range(ends[k + 1] - ends[k]))] if flipped else [0]
        parts = [F.struct(F.lit(k).alias("band"), part(F.col(name), k).bitwiseXOR(F.lit(f).cast("long")).alias("part")) for k in range(bands) for f in flips(k)]
        return df.select(F.col("hash").alias(name)).distinct().select(name, F.inline(F.array(*parts)))

    met = dealt_join(prepared(left, "ha", most > 0), prepared(right, "hb", False), ["band", "part"])
    apart = F.col("ha").bitwiseXOR(F.col("hb"))
    first = F.coalesce(*(F.when(F.bit_count(part(apart, k)) <= most, k) for k in range(bands)))
    pairs = met.filter((F.bit_count(apart) <= radius) & (F.col("band") == first)).select("ha", "hb", F.bit_count(apart).cast("int").alias("distance"))
    ids = lambda df, n, h: df.select(F.col("id").alias(n), F.col("hash").alias(h))
    return pairs.join(ids(left, "a", "ha"), "ha").join(ids(right, "b", "hb"), "hb").select("a", "b", "distance")

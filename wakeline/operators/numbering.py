"""Row numbers within groups of any size, a group or the whole table not being one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.sources.work import cut


def numbered(df: DataFrame, order: Sequence[str | Column], name: str, within: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``name``: 0, 1, ... in an order, within each group of equal ``within``; nulls of those are one group.

    Rows are sorted into ranges of (group, order); a range numbers its own, and a sum over the counts of ranges (a row for
    each group and range) says where it begins. Rows that the order does not tell apart are numbered in any order.
    """
    columns = {f"_o{k}": c if isinstance(c, Column) else F.col(c) for k, c in enumerate(order)}
    plain = [c for c in within]
    ranges = df.repartitionByRange(*(F.col(c) for c in plain), *columns.values()).withColumn("_p", F.spark_partition_id())
    held = cut(ranges, "ranges")
    counts = held.groupBy(*plain, "_p").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*plain).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*(F.col(c).alias(f"_w{k}") for k, c in enumerate(plain)), F.col("_p").alias("_q"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    own = F.row_number().over(Window.partitionBy(*plain, "_p").orderBy(*columns.values())) - 1
    same = F.col("_p") == F.col("_q")
    for k, c in enumerate(plain):
        same = same & F.col(c).eqNullSafe(F.col(f"_w{k}"))
    placed = held.withColumn("_own", own).join(starts, same)
    return placed.select(*df.columns, (F.col("_first") + F.col("_own")).cast("long").alias(name))

"""Relational building blocks: top and sampled rows of groups, counts, pivots, summaries, set comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.operators.buckets import meet_once


def top_n(df: DataFrame, n: int, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first ``n`` rows of each group. Spark limits each partition before it shuffles."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def sample_n(df: DataFrame, n: int, keys: Sequence[str], id_col: str, seed: int = 0) -> DataFrame:
    """``n`` rows of each group without replacement, by a hash of their id: the same rows each time."""
    return top_n(df, n, keys, F.md5(F.concat_ws("-", F.col(id_col).cast("string"), F.lit(str(seed))).cast("binary")), F.col(id_col))


def strided(df: DataFrame, n: int, order: str) -> DataFrame:
    """``n`` rows evenly spaced in the order of a unique column (all, if fewer), the first and last among them.

    Ranks come from counts of value ranges, so that no task sorts the table.
    """
    total = df.count()
    if total <= n:
        return df
    lo, hi = df.agg(F.min(order), F.max(order)).first()
    width = max(1, (hi - lo) // 4096 + 1)
    b = df.withColumn("_b", F.floor((F.col(order) - lo) / width))
    sums = b.groupBy("_b").agg(F.count("*").alias("_c"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # 4096 rows at most
    firsts = sums.select("_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_f"))
    ranked = b.join(F.broadcast(firsts), "_b").withColumn("_r", F.col("_f") + F.row_number().over(Window.partitionBy("_b").orderBy(order)) - 1)
    # Row r is taken if it is the floor of k * (total - 1) / (n - 1) for some k.
    k = F.ceil(F.col("_r") * (n - 1) / (total - 1))
    return ranked.filter(F.floor(k * (total - 1) / (n - 1)) == F.col("_r")).drop("_b", "_f", "_r")


def value_counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def pivot_share(df: DataFrame, row: str, column: str, values: Sequence[str], amount: str) -> DataFrame:
    """Sums of ``amount`` by row and column, 0 where nothing is, as shares of their row."""
    wide = df.groupBy(row).pivot(column, list(values)).agg(F.sum(amount)).fillna(0.0, subset=list(values))
    total = sum((F.col(v) for v in values[1:]), F.col(values[0]))
    return wide.select(row, *(F.when(total != 0, F.col(v) / total).alias(v) for v in values))


def crosstab(df: DataFrame, row: str, column: str, every: str = "all") -> DataFrame:
    """Counts of each pair of values, with margins named ``every``."""
    name = lambda c: F.when(F.grouping(c) == 1, every).otherwise(F.col(c)).alias(c)
    return df.cube(row, column).agg(F.count("*").alias("n"), name(row).alias("_r"), name(column).alias("_c")).select(F.col("_r").alias(row), F.col("_c").alias(column), "n")


def describe(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    v = F.col(value)
    quantiles = [F.percentile(v, F.lit(q)).alias(f"q{round(100 * q)}") for q in (0.25, 0.5, 0.75)]
    return df.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("least"), *quantiles, F.max(v).alias("most"))


def robust_stats(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Statistics of the finite values, with counts of zeros, NaN, infinite values and nulls."""
    v = F.col(value)
    fine = F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")), v)
    return df.groupBy(*keys).agg(
        F.count(fine).alias("n_finite"), F.percentile(fine, F.lit(0.01)).alias("p1"), F.percentile(fine, F.lit(0.99)).alias("p99"),
        F.min(fine).alias("least"), F.max(fine).alias("most"), F.avg(fine).alias("mean"), F.stddev_pop(fine).alias("std"),
        F.count_if(fine == 0).alias("n_zero"), F.count_if(F.isnan(v)).alias("n_nan"), F.count_if(F.abs(v) == float("inf")).alias("n_inf"), F.count_if(v.isNull()).alias("n_null"),
    )


def agreement(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Pearson correlation and median absolute difference of two columns."""
    return df.groupBy(*keys).agg(F.corr(x, y).alias("pearson"), F.median(F.abs(F.col(x) - F.col(y))).alias("median_abs_diff"), F.count("*").alias("n"))


def moving_box_sum(cells: DataFrame, half: int, value: str = "v", keys: Sequence[str] = ()) -> DataFrame:
    """Sum of ``value`` over the box of ``half`` cells to each side, at each cell (ix, iy) that is there: one window along
    each axis. Rows between must exist along the first axis for the second to see them, so sparse tables are spread first."""
    spread = cells.select(*keys, F.explode(F.sequence(F.col("ix") - half, F.col("ix") + half)).alias("ix"), "iy", value)
    along = spread.groupBy(*keys, "ix", "iy").agg(F.sum(value).alias("_s"))
    w = Window.partitionBy(*keys, "ix").orderBy("iy").rangeBetween(-half, half)
    return cells.select(*keys, "ix", "iy").join(along.withColumn("box_sum", F.sum("_s").over(w)).drop("_s"), [*keys, "ix", "iy"])


def cumulative_share(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """Share of the group's rows up to each value."""
    return df.withColumn("cumulative", F.cume_dist().over(Window.partitionBy(*keys).orderBy(value)))


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows by how often they occur in excess in either table: the columns, side, n. Empty if both hold the same rows."""
    columns = a.columns
    both = a.withColumn("_d", F.lit(1)).unionByName(b.withColumn("_d", F.lit(-1)))
    d = both.groupBy(*columns).agg(F.sum("_d").alias("d")).filter("d <> 0")
    return d.select(*columns, F.when(F.col("d") > 0, "left").otherwise("right").alias("side"), F.abs("d").alias("n"))


def side_by_side(a: DataFrame, b: DataFrame, row: str) -> DataFrame:
    """Two tables joined row by row on an explicit row number that each holds once; missing rows are null."""
    return a.join(b, row, "full_outer")


def existing(df: DataFrame, *columns: str) -> DataFrame:
    """Of the named columns those that the table has."""
    return df.select(*(c for c in columns if c in df.columns))


def envelope(df: DataFrame, keys: Sequence[str], buffer: float, step: float) -> DataFrame:
    """Smallest box around all points, widened and snapped outward to a grid."""
    down = lambda c: (F.floor((F.min(c) - buffer) / step) * step).alias(f"{c}_min")
    up = lambda c: (F.ceil((F.max(c) + buffer) / step) * step).alias(f"{c}_max")
    return df.groupBy(*keys).agg(down("lon"), up("lon"), down("lat"), up("lat"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Inverse-frequency weights: rows over classes times the class's rows."""
    counts = value_counts(df, label)
    whole = counts.agg(F.sum("n").alias("_all"), F.count("*").alias("_k"))
    return counts.crossJoin(F.broadcast(whole)).select(label, "n", (F.col("_all") / (F.col("_k") * F.col("n"))).alias("weight"))  # one row


def share_of_total(df: DataFrame, keys: Sequence[str], amount: str, within: Sequence[str]) -> DataFrame:
    summed = df.groupBy(*keys).agg(F.sum(amount).alias("amount"))
    return summed.withColumn("share", F.col("amount") / F.sum("amount").over(Window.partitionBy(*within)))


def best_so_far(df: DataFrame, run: str, step: str, score: str, patience: int) -> DataFrame:
    """Running best of each run, steps since it improved, and whether patience is used up by then."""
    w = Window.partitionBy(run).orderBy(step)
    before = F.max(score).over(w.rowsBetween(Window.unboundedPreceding, -1))
    out = df.withColumn("best", F.max(score).over(w)).withColumn("improved", before.isNull() | (F.col(score) > before))
    out = out.withColumn("_row", F.row_number().over(w))
    out = out.withColumn("since", F.col("_row") - F.max(F.when(F.col("improved"), F.col("_row"))).over(w))
    return out.withColumn("stopped", F.max((F.col("since") >= patience).cast("int")).over(w) == 1).drop("_row")


def checks(df: DataFrame, keys: Sequence[str], **conditions: Column) -> DataFrame:
    """Named checks of each group, a null counting as failed, and whether all hold."""
    held = df.groupBy(*keys).agg(*(F.bool_and(F.coalesce(c, F.lit(False))).alias(n) for n, c in conditions.items()))
    out = F.lit(True)
    for n in conditions:
        out = out & F.col(n)
    return held.withColumn("accepted", out)


def margin_risk(df: DataFrame, *margins: str, low: float, high: float) -> DataFrame:
    """The least of several margins (nulls aside) and its risk: high below ``low``, medium below ``high``, else low."""
    least = F.least(*(F.col(m) for m in margins))
    return df.withColumn("min_margin", least).withColumn("risk", F.when(F.col("min_margin") < low, "high").when(F.col("min_margin") < high, "medium").when(F.col("min_margin").isNull(), "unknown").otherwise("low"))


def block_average(cells: DataFrame, factor: int, value: str = "v", keys: Sequence[str] = ()) -> DataFrame:
    """Means over blocks of ``factor`` by ``factor`` cells; null where less than half of a block is valid."""
    b = lambda c: F.floor(F.col(c) / factor).alias(c)
    n = F.count(value)
    return cells.groupBy(*keys, b("ix"), b("iy")).agg(n.alias("n_valid"), F.when(n * 2 >= factor * factor, F.avg(value)).alias(value))


def owned(items: DataFrame, tile: float, halo: float) -> DataFrame:
    """Items (x, y) seen by overlapping tiles, each once: by the tile whose core holds its centre. Returns also how many
    tiles see it."""
    core = lambda c: F.floor(F.col(c) / tile)
    seen = lambda c: (F.floor((F.col(c) + halo) / tile) - F.floor((F.col(c) - halo) / tile) + 1)
    return items.withColumns({"tile_x": core("x"), "tile_y": core("y"), "n_tiles": (seen("x") * seen("y")).cast("long")})


def shared_windows(tiles: DataFrame, pixels: int) -> DataFrame:
    """(a, b, a_col, a_row, b_col, b_row, width, height): the part that two tiles (id, col0, row0 on one pixel grid, each
    ``pixels`` wide and high) share, as windows of either. Tiles meet in grid cells as large as a tile."""
    near = lambda c: F.floor(F.col(c) / pixels)
    met = meet_once(tiles.select("id", "col0", "row0"), near("col0"), near("row0"))
    met = met.filter((F.abs(F.col("col0") - F.col("col02")) < pixels) & (F.abs(F.col("row0") - F.col("row02")) < pixels))
    first = F.col("id") < F.col("id2")
    side = lambda c, own: F.when(first == F.lit(own), F.col(c)).otherwise(F.col(f"{c}2"))
    met = met.select(*(side(c, own).alias(n) for own, names in ((True, ("a", "ac", "ar")), (False, ("b", "bc", "br"))) for c, n in zip(("id", "col0", "row0"), names, strict=True)))
    start = lambda x, y: F.greatest(F.lit(0), F.col(y) - F.col(x))
    size = lambda x, y: pixels - F.abs(F.col(x) - F.col(y))
    out = met.select(
        "a",
        "b",
        start("ac", "bc").alias("a_col"),
        start("ar", "br").alias("a_row"),
        start("bc", "ac").alias("b_col"),
        start("br", "ar").alias("b_row"),
        size("ac", "bc").alias("width"),
        size("ar", "br").alias("height"),
    )
    return out


def tent_blend(values: DataFrame, window: int, stride: int) -> DataFrame:
    """Windows of ``window`` cells at every ``stride`` along x hold a prediction p (w0: start); a cell's blend is the mean
    weighted by a tent that peaks in the middle of the window."""
    x = F.col("w0") + F.col("k")
    tent = 1.0 - F.abs(F.col("k") - (window - 1) / 2.0) / ((window + 1) / 2.0)
    return values.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(window - 1)))).groupBy(x.alias("x")).agg((F.sum(tent * F.col("p")) / F.sum(tent)).alias("blend"), F.count("*").alias("n_windows"))


def manifest_difference(frozen: DataFrame, now: DataFrame) -> DataFrame:
    """(path, status) of two manifests (path, sha256): same, changed, missing or new."""
    j = frozen.select("path", F.col("sha256").alias("x")).join(now.select("path", F.col("sha256").alias("y")), "path", "full_outer")
    return j.select("path", F.when(F.col("y").isNull(), "missing").when(F.col("x").isNull(), "new").when(F.col("x") == F.col("y"), "same").otherwise("changed").alias("status"))


def schema_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(name, left, right, status) of the columns of two tables."""
    from wakeline.operators.audit import config_difference

    spark = a.sparkSession
    of = lambda df: spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in df.schema], "name string, value string")
    return config_difference(of(a), of(b))

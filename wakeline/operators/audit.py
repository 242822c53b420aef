"""Audits of tables and rankings: agreement, duplicates, similarity, splits, classification metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.functions.nulls import safe_ratio
from wakeline.operators.numbering import numbered


def average_rank(value: Column, *within: str) -> Column:
    """Rank from 1 upward, ties sharing their mean."""
    w = Window.partitionBy(*within)
    return F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(*within, value)) - 1) / 2.0


def compare_rankings(a: DataFrame, b: DataFrame, key: str, group: str, score: str, rank: str, k: int = 10) -> DataFrame:
    """Two rankings of the same entities by group: full outer join, rank correlation over shared rows, top-k overlap and
    the largest move of a top-k entity."""
    of = lambda df, n: df.select(key, F.col(group).alias("bin"), F.col(score).alias(f"s{n}"), F.col(rank).alias(f"r{n}"))
    j = of(a, 1).join(of(b, 2), [key, "bin"], "full_outer")
    both = j.filter("s1 is not null and s2 is not null").withColumn("v1", F.round("s1", 6)).withColumn("v2", F.round("s2", 6))
    both = both.withColumn("q1", average_rank(F.col("v1"), "bin")).withColumn("q2", average_rank(F.col("v2"), "bin"))
    spearman = both.groupBy("bin").agg(F.corr("q1", "q2").alias("spearman"))
    counts = j.groupBy("bin").agg(
        F.count("s1").alias("n_v2"), F.count("s2").alias("n_v2_1"), F.count_if((F.col("r1") <= k) & (F.col("r2") <= k)).alias("top10_overlap"),
        F.max(F.when(F.col("r1") <= k, F.abs(F.col("r1") - F.col("r2")))).alias("max_rank_change"),
    )
    return counts.join(spearman, "bin")


def identical_order(a: DataFrame, b: DataFrame, key: str, group: str, rank: str, k: int = 6) -> DataFrame:
    """(group, n, same_members, same_order): whether two rankings have the same first ``k`` entities of each group, and in
    the same order; ties of a rank are taken by entity. ``n`` is how many the first has. A group of one ranking alone
    differs."""
    top = lambda df, n: df.filter(F.col(rank).isNotNull()).withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(rank, key))).filter(F.col("_n") <= k).groupBy(group).agg(F.array_sort(F.collect_list(F.struct("_n", F.col(key).alias("_k")))).alias(n))
    j = top(a, "_a").join(top(b, "_b"), group, "full_outer")
    names = lambda c: F.transform(c, lambda x: x["_k"])
    same = lambda x, y: F.coalesce(x == y, F.lit(False))
    members = same(F.array_sort(names("_a")), F.array_sort(names("_b")))
    return j.select(group, F.coalesce(F.size("_a"), F.lit(0)).alias("n"), members.alias("same_members"), same(names("_a"), names("_b")).alias("same_order"))


def outer_with_source(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """Full outer join with ``source``: both, left_only or right_only."""
    j = a.withColumn("_l", F.lit(True)).join(b.withColumn("_r", F.lit(True)), list(on), "full_outer")
    return j.withColumn("source", F.when(F.col("_l") & F.col("_r"), "both").when(F.col("_l"), "left_only").otherwise("right_only")).drop("_l", "_r")


def require_unique(df: DataFrame, *keys: str) -> DataFrame:
    """``df``, after a check that no key repeats."""
    if not df.groupBy(*keys).count().filter("count > 1").isEmpty():
        raise ValueError(f"keys repeat: {', '.join(keys)}")
    return df


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with their count, smallest id and group number (by key order)."""
    counted = df.groupBy(*keys).agg(F.count("*").alias("n"), F.min("id").alias("first_id")).filter("n > 1")
    return numbered(counted, ["first_id"], "group_id").withColumn("group_id", F.col("group_id").cast("int"))


def anchored_pairs(df: DataFrame, key: str) -> DataFrame:
    """(anchor, id) for the members of each group of equal keys, the anchor being the smallest id."""
    anchors = df.groupBy(key).agg(F.min("id").alias("anchor"), F.count("*").alias("n")).filter("n > 1")
    return df.join(anchors, key).filter(F.col("id") != F.col("anchor")).select("anchor", "id")


def value_equality(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Equality report of one column of two tables: shared rows, exact share, error sizes, disagreeing nulls."""
    j = a.select(key, F.col(value).alias("x")).join(b.select(key, F.col(value).alias("y")), key)
    diff = F.col("x") - F.col("y")
    return j.agg(
        F.count("*").alias("n"), F.avg(F.col("x").eqNullSafe(F.col("y")).cast("double")).alias("exact_fraction"), F.max(F.abs(diff)).alias("max_abs_diff"), F.avg(F.abs(diff)).alias("mean_abs_diff"),
        F.sqrt(F.avg(diff * diff)).alias("rmse"), F.count_if(F.col("x").isNull() != F.col("y").isNull()).alias("null_disagreement"),
    )


def config_difference(a: DataFrame, b: DataFrame, allowed: Sequence[str] = ()) -> DataFrame:
    """(name, left, right, status) of two tables of (name, value)."""
    j = a.select("name", F.col("value").alias("left")).join(b.select("name", F.col("value").alias("right")), "name", "full_outer")
    same = F.col("left").eqNullSafe(F.col("right"))
    return j.withColumn("status", F.when(same, "same").when(F.col("name").isin(*allowed), "allowed").otherwise("differs"))


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def class_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Accuracy, balanced accuracy and macro F1, from the confusion table."""
    c = confusion(df, truth, predicted)
    cells = c.select(F.col("truth").alias("c"), F.col("n").alias("t"), F.lit(0).alias("p"), F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0).alias("hit"))
    cells = cells.unionByName(c.select(F.col("predicted").alias("c"), F.lit(0).alias("t"), F.col("n").alias("p"), F.lit(0).alias("hit")))
    by = cells.groupBy("c").agg(F.sum("t").alias("t"), F.sum("p").alias("p"), F.sum("hit").alias("hit")).filter("t > 0")
    f1 = F.coalesce(safe_ratio(2.0 * F.col("hit"), F.col("t") + F.col("p")), F.lit(0.0))
    return by.agg(F.sum("t").alias("n"), (F.sum("hit") / F.sum("t")).alias("accuracy"), F.avg(F.col("hit") / F.col("t")).alias("balanced_accuracy"), F.avg(f1).alias("macro_f1"))


def overlap_metrics(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """IoU, Dice, precision, recall from summed counts."""
    return [safe_ratio(tp, tp + fp + fn).alias("iou"), safe_ratio(2 * tp, 2 * tp + fp + fn).alias("dice"), safe_ratio(tp, tp + fp).alias("precision"), safe_ratio(tp, tp + fn).alias("recall")]


def threshold_sweep(df: DataFrame, score: str, truth: Column, thresholds: Sequence[float]) -> DataFrame:
    """Metrics for each threshold, in one pass: a row counts towards the number of thresholds it reaches, and running
    sums over that number give every threshold's counts. A null score reaches none."""
    reached = F.lit(0)
    for x in thresholds:
        reached = reached + F.coalesce(F.col(score) >= x, F.lit(False)).cast("int")
    counts = df.groupBy(reached.alias("k")).agg(F.count_if(truth).alias("pos"), F.count_if(~truth).alias("neg"))
    spark = df.sparkSession
    grid = spark.createDataFrame([(k + 1, float(x)) for k, x in enumerate(sorted(thresholds))], "j int, threshold double")
    sums = F.broadcast(grid).crossJoin(counts).groupBy("threshold").agg(
        F.sum(F.when(F.col("k") >= F.col("j"), F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("k") >= F.col("j"), F.col("neg")).otherwise(0)).alias("fp"), F.sum(F.when(F.col("k") < F.col("j"), F.col("pos")).otherwise(0)).alias("fn"),
    )
    return sums.select("threshold", *overlap_metrics(F.col("tp"), F.col("fp"), F.col("fn")))


def robust_contrast(df: DataFrame, group: str, side: str, value: str) -> DataFrame:
    """Medians inside and outside, MAD outside and contrast to noise for each group."""
    med = df.groupBy(group, side).agg(F.median(value).alias("m"))
    dev = df.join(med, [group, side]).groupBy(group, side).agg(F.first("m").alias("m"), F.median(F.abs(F.col(value) - F.col("m"))).alias("mad"))
    wide = dev.groupBy(group).agg(F.max(F.when(F.col(side), F.col("m"))).alias("inside"), F.max(F.when(~F.col(side), F.col("m"))).alias("outside"), F.max(F.when(~F.col(side), F.col("mad"))).alias("mad"))
    return wide.withColumn("contrast", F.col("inside") - F.col("outside")).withColumn("cnr", safe_ratio(F.col("inside") - F.col("outside"), 1.4826 * F.col("mad")))


def stratified_halves(df: DataFrame, stratum: str, id_col: str, seed: int = 0) -> DataFrame:
    """Alternate assignment in a hashed order within each stratum."""
    w = Window.partitionBy(stratum).orderBy(F.xxhash64(id_col, F.lit(seed)), id_col)
    return df.withColumn("split", F.when(F.row_number().over(w) % 2 == 1, "calibration").otherwise("test"))

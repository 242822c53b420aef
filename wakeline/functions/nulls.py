"""Null, NaN and tie rules that Spark leaves open."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nan_to_null(x: Column) -> Column:
    """Aggregates skip nulls but not NaN."""
    return F.when(~F.isnan(x), x)


def finite(*columns: Column) -> Column:
    out = F.lit(True)
    for x in columns:
        out = out & x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return out


def first_max(value: Column, by: Column, then: Column) -> Column:
    """The value at the largest ``by``; among ties the one of the smallest ``then`` (a number)."""
    return F.max_by(value, F.struct(by, -then))


def first_min(value: Column, by: Column, then: Column) -> Column:
    return F.min_by(value, F.struct(by, then))


def share(condition: Column) -> Column:
    """Fraction of the rows for which a condition holds; null counts as no."""
    return F.avg(F.coalesce(condition, F.lit(False)).cast("double"))


def safe_ratio(a: Column, b: Column) -> Column:
    """Null where the denominator is 0."""
    return F.when(b != 0, a / b)

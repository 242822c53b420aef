"""Binning of numbers and times."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR_US = 3_600_000_000
#: Release-age bins in hours: right-closed, the lowest edge included.
AGE_EDGES = (-0.001, 6.0, 12.0, 24.0, 36.0, 48.01)
AGE_LABELS = ("0-6h", "6-12h", "12-24h", "24-36h", "36-48h")


def cut_right_closed(x: Column, edges: Sequence[float], labels: Sequence) -> Column:
    """Label of the bin lo < x <= hi, the first bin taking its lower edge too; null outside."""
    out = F.lit(None)
    for k in reversed(range(len(labels))):
        low = x >= edges[0] if k == 0 else x > edges[k]
        out = F.when(low & (x <= edges[k + 1]), F.lit(labels[k])).otherwise(out)
    return out


def cut_half_open(x: Column, edges: Sequence[float], labels: Sequence) -> Column:
    """Label of the bin lo <= x < hi; null outside."""
    out = F.lit(None)
    for k in reversed(range(len(labels))):
        out = F.when((x >= edges[k]) & (x < edges[k + 1]), F.lit(labels[k])).otherwise(out)
    return out


def age_bin(hours: Column) -> Column:
    return cut_right_closed(hours, AGE_EDGES, AGE_LABELS)


def age_ordinal(hours: Column) -> Column:
    """Place of the age bin; labels do not sort by age."""
    return cut_right_closed(hours, AGE_EDGES, range(len(AGE_LABELS)))


def hours_before(t0_us: int | Column, us: Column) -> Column:
    return (t0_us - us) / float(HOUR_US)


def hour_bucket(hours: Column) -> Column:
    """(h, h+1] belongs to h."""
    return (F.ceil(hours) - 1).cast("int")


def wind_class(speed: Column, low: float = 2.5, high: float = 10.0, marginal: tuple[float, float] = (1.5, 12.0)) -> Column:
    """How well a slick shows at a wind speed (m/s)."""
    inside = (speed >= low) & (speed <= high)
    near = (speed >= marginal[0]) & (speed <= marginal[1])
    return F.when(speed.isNull(), "unknown").when(inside, "ok").when(near, "marginal").otherwise("unsuitable")

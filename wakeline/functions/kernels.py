"""Scalar kernels of the scoring stages."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def gaussian(distance: Column, sigma: float | Column) -> Column:
    return F.exp(-0.5 * F.pow(distance / sigma, F.lit(2.0)))


def growing_sigma(age_h: Column, sigma0_km: float = 1.0, error_m_s: float = 0.05) -> Column:
    """Kernel width after drifting for a time with an uncertain current."""
    return F.sqrt(F.lit(sigma0_km**2) + F.pow(age_h * (error_m_s * 3.6), F.lit(2.0)))


def persistence(age_h: Column, tau_h: float = 12.0) -> Column:
    return F.exp(-age_h / tau_h)


def head_proximity(distance_km: Column, reference_km: Column) -> Column:
    return F.exp(-F.pow(distance_km / reference_km, F.lit(5.0)))


def heading_alignment(difference_deg: Column) -> Column:
    """1 along the axis, one half at 45 degrees."""
    return F.exp(-math.log(2.0) * F.pow(difference_deg / 45.0, F.lit(2.0)))


def geometry_score(proximity: Column, alignment: Column) -> Column:
    return (2.0 * proximity + alignment) / 3.0


def f_score(precision: Column, recall: Column) -> Column:
    return 2.0 * precision * recall / F.greatest(precision + recall, F.lit(1e-12))


def size_factor(area_m2: Column, reference_m2: float = 100_000.0) -> Column:
    """Saturates towards 1 with the area."""
    return 1.0 - F.exp(-area_m2 / reference_m2)


def width_age_h(width_m: Column, initial_m: float, diffusivity: float) -> Column:
    """Hours in which a line of an initial width diffuses to a width of four standard deviations."""
    grown = F.pow(width_m / 4.0, F.lit(2.0)) - (initial_m / 4.0) ** 2
    return F.greatest(grown, F.lit(0.0)) / (2.0 * diffusivity) / 3600.0


def okubo_age_h(width_m: Column) -> Column:
    """From the oceanic diffusion diagram, variance in cm2 = 0.0108 t^2.34 with t in seconds."""
    variance = F.pow(width_m / 4.0 * 100.0, F.lit(2.0))
    return F.pow(variance / 0.0108, F.lit(1 / 2.34)) / 3600.0


def decibel(x: Column) -> Column:
    return F.when(x > 0, 10.0 * F.log10(x))

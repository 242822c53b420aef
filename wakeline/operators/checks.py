"""Assertions about a table, checked in the pass that writes it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from wakeline.sources import work


class BrokenCheck(AssertionError):
    """A table does not hold what it was said to hold."""


def checked(df: DataFrame, name: str, **checks: Column) -> DataFrame:
    """``df``, written to the work folder, if every check holds; else nothing is left of it and ``BrokenCheck`` names the
    checks that fail with what was seen.

    A check is an aggregate of the rows that must be true, such as ``F.count("*") == F.sum("n")``; null is not true. All
    are observed while the table is written, without another pass.
    """
    seen = Observation(name)
    with work.tables_written() as tables:
        out = work.cut(df.observe(seen, *(c.alias(k) for k, c in checks.items())), name)
    found = seen.get
    broken = {k: found[k] for k in checks if found[k] is not True}
    if broken:
        work.remove(df.sparkSession, tables)
        raise BrokenCheck(f"{name}: {', '.join(f'{k} is {v}' for k, v in broken.items())}")
    return out


def every(condition: Column) -> Column:
    """A check that each row meets a condition; a table without rows meets it."""
    return F.count_if(~F.coalesce(condition, F.lit(False))) == 0

"""Named queries with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def rounded(x: Column, digits: int) -> Column:
    """``x`` to so many places as DuckDB rounds: the scaled double, halves away from zero. Spark's ``round`` goes by the
    decimal digits of a double, which differs where the scaled double is a half, or just under one."""
    scaled = x * 10.0**digits
    size = F.abs(scaled)
    whole = F.floor(size)
    near = F.when(size - whole >= 0.5, whole + 1).otherwise(whole).cast("double") * F.signum(scaled) / 10.0**digits
    return F.when(size < 2.0**52, near).otherwise(x)  # no places are left beyond, or it is not finite


def query(name: str, sql: str | None = None, doubles: str = "", digits: int = 6) -> Callable[[Query], Query]:
    """Registers a query; ``doubles`` are result columns that both sides round to ``digits`` places."""

    def register(f: Query) -> Query:
        columns = doubles.split()

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(spark, sf_dir)
            return out.withColumns({c: rounded(F.col(c).cast("double"), digits) + 0.0 for c in columns})

        QUERIES[name] = run
        if sql:
            SQL[name] = f"SELECT * REPLACE ({', '.join(f'round(CAST({c} AS DOUBLE), {digits}) + 0.0 AS {c}' for c in columns)}) FROM ({sql})" if columns else sql
        return f

    return register

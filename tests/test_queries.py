"""Every registered query of the engine against its SQL in DuckDB."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__  # noqa: F401  registers every query
from wakeline.plans import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else round(v, 9) if isinstance(v, float) else v
    return sorted(tuple(str(plain(r[i])) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_matches_sql(spark, con, name):
    df = registry.QUERIES[name](spark, DATA)
    got = con.execute(registry.SQL[name])
    names, rows = [d[0] for d in got.description], got.fetchall()
    assert sorted(df.columns) == sorted(names)
    assert table(df.columns, df.collect()) == table(names, rows)


def test_entry_works(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())

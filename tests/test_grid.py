"""Gridded fields: what is written is read, filters spare chunks, interpolation is that of plain numpy."""

import json
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wakeline.sources import grid

AXES = (grid.Axis("time", 100, 10, 7, 3), grid.Axis("latitude", 20.5, 0.5, 5, 2), grid.Axis("longitude", -3, 1, 6, 4))


def cells(seed=1, share=0.6):
    pick = random.Random(seed)
    places = [(i, j, k) for i in range(7) for j in range(5) for k in range(6) if pick.random() < share]
    return {p: (pick.uniform(-5, 5), None if pick.random() < 0.1 else pick.uniform(0, 1)) for p in places}


@pytest.fixture(scope="module")
def field(spark, tmp_path_factory):
    held, path = cells(), str(tmp_path_factory.mktemp("grid") / "field")
    rows = [(*p, *v) for p, v in held.items()] + [(-1, 0, 0, 1.0, 1.0), (0, 9, 0, 1.0, 1.0), (None, 0, 0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "i_time long, i_latitude long, i_longitude long, u double, v double")
    grid.write_grid(df.repartition(3), path, AXES, ("u", "v"))
    return held, path


def coordinates(p):
    return tuple(a.start + a.step * i for a, i in zip(AXES, p, strict=True))


def test_all_cells_come_back(spark, field):
    held, path = field
    got = {tuple(r)[:3]: tuple(r)[3:5] for r in grid.read_grid(spark, path).collect()}
    assert got == {coordinates(p): v for p, v in held.items()}
    assert [t for _, t in grid.read_grid(spark, path).dtypes] == ["bigint", "double", "bigint", "double", "double", "string"]


def test_the_format_is_zarr(field):
    held, path = field
    meta = json.load(open(f"{path}/u/.zarray"))
    assert (meta["zarr_format"], meta["shape"], meta["chunks"], meta["dtype"]) == (2, [7, 5, 6], [3, 2, 4], "<f8")
    block = np.frombuffer(zlib.decompress(open(f"{path}/u/1.0.1", "rb").read()), "<f8").reshape(3, 2, 4)
    for (i, j, k), (u, _) in held.items():
        if (i // 3, j // 2, k // 4) == (1, 0, 1):
            assert block[i % 3, j % 2, k % 4] == u
    assert not np.isfinite(block[:, :, 2:]).any()  # beyond the end of the axis


@pytest.mark.parametrize(
    ("condition", "chunks"),
    [("time >= 100", 3 * 3 * 2), ("time < 130", 1 * 3 * 2), ("time = 130 AND latitude > 22.4", 1 * 1 * 2), ("time IN (100, 160)", 2 * 3 * 2), ("longitude BETWEEN 1 AND 2", 3 * 3 * 1), ("time > 160", 0), ("u > 0 AND time <= 120", 1 * 3 * 2), ("NOT time < 130", 2 * 3 * 2), ("time < 110 OR time > 150", 3 * 3 * 2)],
)
def test_filters_spare_chunks(spark, field, condition, chunks):
    held, path = field
    df = grid.read_grid(spark, path).filter(condition)
    assert df.rdd.getNumPartitions() == chunks or chunks == 0
    rows = [(*coordinates(p), *v) for p, v in held.items()]
    want = spark.createDataFrame(rows, "time long, latitude double, longitude long, u double, v double").filter(condition)
    assert sorted(tuple(r)[:4] for r in df.collect()) == sorted(tuple(r)[:4] for r in want.collect())


def test_repeated_cell_is_refused(spark, tmp_path):
    df = spark.createDataFrame([(0, 0, 0, 1.0, 1.0)] * 2, "i_time long, i_latitude long, i_longitude long, u double, v double")
    with pytest.raises(Exception, match="more than once"):
        grid.write_grid(df, str(tmp_path / "g"), AXES, ("u", "v"))


def test_interpolation(spark, field):
    held, path = field
    pick = random.Random(4)
    points = [(n, pick.uniform(95, 165), pick.uniform(20.4, 22.6), pick.uniform(-3.2, 2.2)) for n in range(150)]
    points += [(n + 150, *map(float, coordinates(p))) for n, p in enumerate(list(held)[:20])] + [(900, None, 21.0, 0.0)]
    df = spark.createDataFrame(points, "id long, time double, latitude double, longitude double")
    got = {r.id: r for r in grid.sample_grid(df, grid.read_grid(spark, path), AXES, ("u", "v")).collect()}
    full = np.full((7, 5, 6), np.nan)
    for p, (u, _) in held.items():
        full[p] = u
    n_values = 0
    for n, *at in points:
        want = None
        if None not in at:
            f = [(x - a.start) / a.step for x, a in zip(at, AXES, strict=True)]
            want = 0.0
            for corner in np.ndindex(2, 2, 2):
                w, place = 1.0, []
                for x, c in zip(f, corner, strict=True):
                    low = int(np.floor(x))
                    w *= x - low if c else 1 - (x - low)
                    place.append(low + c)
                if w > 0:
                    inside = all(0 <= i < s for i, s in zip(place, full.shape, strict=True))
                    want += w * (full[tuple(place)] if inside else np.nan)
            want = None if np.isnan(want) else want
        n_values += want is not None
        assert (got[n].u is None) == (want is None) and (want is None or abs(got[n].u - want) < 1e-9)
    assert n_values > 20 and len(got) == len(points)


def test_no_cells(spark, tmp_path):
    df = spark.createDataFrame([], "i_time long, i_latitude long, i_longitude long, u double, v double")
    assert grid.write_grid(df, str(tmp_path / "g"), AXES, ("u", "v")) == 0
    read = grid.read_grid(spark, str(tmp_path / "g"))
    assert read.count() == 0 and read.filter(F.col("time") > 0).count() == 0

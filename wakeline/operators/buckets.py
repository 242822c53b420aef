"""Range and nearest joins by grid cells: equi-joins on cells with a residual filter, never a comparison of all pairs."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.functions.geo import EARTH_KM, haversine_km
from wakeline.sources.work import cut

NEAR = (-1, 0, 1)
#: Left rows of a key that one slice of it holds, about.
CROWD = 2048


def dealt_join(left: DataFrame, right: DataFrame, keys: list[str], crowd: int = CROWD) -> DataFrame:
    """Equi-join of rows (left ones distinct) whose pairs far outnumber them. By their bytes such rows would go to few
    tasks, or through the driver; here they go to as many tasks as the session shuffles to, and a key of many left rows is
    cut into slices, each of which meets all right rows of the key."""
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slices = left.groupBy(*keys).agg(F.ceil(F.count("*") / crowd).cast("int").alias("_slices")).hint("merge")
    by = [*keys, "_slice"]
    x = left.join(slices, keys).withColumn("_slice", F.pmod(F.xxhash64(*left.columns), F.col("_slices")).cast("int")).drop("_slices")
    y = right.join(slices, keys).withColumn("_slice", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1))).drop("_slices")
    return x.repartition(n, *by).join(y.repartition(n, *by).hint("merge"), by).drop("_slice")


def cell(x: Column, size: float) -> Column:
    return F.floor(x / size).cast("long")


def meet_once(rows: DataFrame, cx: Column, cy: Column, reach: int = 1) -> DataFrame:
    """Pairs of rows (id, ...) with different ids whose cells are at most ``reach`` apart along each axis, each pair once;
    columns of the second row have a 2. Cells look only forward, for half of the cells around them."""
    half = [(i, j) for i in range(reach + 1) for j in range(-reach, reach + 1) if (i, j) >= (0, 0)]
    left = rows.withColumn("_cx", cx).withColumn("_cy", cy)
    to = F.array(*(F.struct((F.col("_cx") - i).alias("_cx"), (F.col("_cy") - j).alias("_cy"), F.lit((i, j) == (0, 0)).alias("_own")) for i, j in half))
    around = left.select(*(F.col(c).alias(f"{c}2") for c in rows.columns), F.inline(to))
    met = dealt_join(left, around, ["_cx", "_cy"])
    return met.filter(F.when(F.col("_own"), F.col("id") < F.col("id2")).otherwise(F.col("id") != F.col("id2"))).select(*rows.columns, *(f"{c}2" for c in rows.columns))


def _bands(radius_km: float) -> tuple[float, Callable[[Column], Column]]:
    """Height of a latitude band, and the number of cells around the globe in a band: as many as are at least as wide as
    the radius anywhere in the band or next to it, one near the poles."""
    half = min(math.pi / 2, radius_km / (2 * EARTH_KM))
    dy = math.degrees(2 * half) * 1.01

    def around(band: Column) -> Column:
        top = F.least(F.lit(90.0), F.greatest(F.abs((band - 1) * dy - 90.0), F.abs((band + 2) * dy - 90.0)))
        reach = math.sin(half) * 1.01 / F.greatest(F.cos(F.radians(top)), F.lit(1e-12))
        width = 2.0 * F.degrees(F.asin(F.least(F.lit(1.0), reach)))
        return F.greatest(F.lit(1), F.floor(360.0 / width)).cast("long")

    return dy, around


def _column_of(lon: Column, n: Column) -> Column:
    """Cell of a longitude among ``n`` around the globe."""
    return F.least(F.floor(F.pmod(lon + 180.0, F.lit(360.0)) * n / 360.0).cast("long"), n - 1)


def radius_join(left: DataFrame, right: DataFrame, radius_km: float, lon: str = "lon", lat: str = "lat", on: tuple[str, ...] = ()) -> DataFrame:
    """Pairs within a radius, with ``dist_km``; right columns must have other names than left ones but for ``lon``,
    ``lat`` (which become r_lon, r_lat) and ``on``. Cells go around the globe and are as wide as the radius at any
    latitude, so that the antimeridian and the poles are no borders. Points without finite coordinates have no pair."""
    dy, around = _bands(radius_km)
    small = right.withColumnRenamed(lon, "r_lon").withColumnRenamed(lat, "r_lat").withColumn("_cy", cell(F.col("r_lat") + 90.0, dy))
    small = small.withColumn("_cy", F.explode(F.array(F.col("_cy") - 1, F.col("_cy"), F.col("_cy") + 1))).withColumn("_n", around(F.col("_cy")))
    near = _column_of(F.col("r_lon"), F.col("_n"))
    small = small.withColumn("_cx", F.explode(F.array_distinct(F.array(*(F.pmod(near + k, F.col("_n")) for k in (-1, 0, 1)))))).drop("_n")
    big = left.withColumn("_cy", cell(F.col(lat) + 90.0, dy)).withColumn("_cx", _column_of(F.col(lon), around(F.col("_cy"))))
    # Exploded rows are merged, never broadcast: a small file can hold many.
    out = big.join(small.hint("merge"), [*on, "_cx", "_cy"]).withColumn("dist_km", haversine_km(F.col(lat), F.col(lon), F.col("r_lat"), F.col("r_lon")))
    return out.filter(F.col("dist_km") <= radius_km).drop("_cx", "_cy")


#: Parts of a radius that are searched one after another, for rows that have found nothing yet.
RINGS = (1 / 16, 1 / 4, 1.0)


def in_rings(left: DataFrame, left_id: str, search: Callable[[DataFrame, float], DataFrame]) -> DataFrame:
    """What ``search`` (left, part of the radius) finds of each left row at the first part where it finds anything. Crowded
    rows are done with the smallest part, so that pairs are few where rows are many."""
    rest, out = cut(left, "asked"), None
    for part in RINGS:
        found = cut(search(rest, part), "nearest")
        done = found.select(F.col(left_id).alias("_done"))
        rest = rest.join(done, F.col(left_id).eqNullSafe(F.col("_done")), "left_anti")
        out = found if out is None else out.unionByName(found)
    return out


def nearest_within(left: DataFrame, right: DataFrame, left_id: str, right_id: str, radius_km: float) -> DataFrame:
    """The nearest right row within a radius of each left row (ties: smaller id); rows without one are left out. Left rows
    of one place (lon, lat) search once, and of right rows at one place only the smallest id is met."""
    spot = F.struct("lon", "lat").alias("_place")
    near = cut(right.groupBy("lon", "lat").agg(F.min_by(F.struct(*right.columns), right_id).alias("r")).select("r.*"), "targets")
    w = Window.partitionBy("_place").orderBy("dist_km", right_id)
    first = lambda rest, part: radius_join(rest, near, radius_km * part).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    found = in_rings(left.select("lon", "lat", spot).distinct(), "_place", first).drop("_place")
    own = Window.partitionBy(left_id).orderBy("dist_km", right_id)
    return left.join(found, ["lon", "lat"]).withColumn("_n", F.row_number().over(own)).filter("_n = 1").drop("_n")


def in_box() -> Column:
    """Whether a point (lon, lat) is in a box (lon0, lon1, lat0, lat1), which may reach over +-180."""
    inside = F.col("lon").between(F.col("lon0"), F.col("lon1")) | (F.pmod(F.col("lon") - F.col("lon0"), F.lit(360.0)) <= F.col("lon1") - F.col("lon0"))
    return inside & F.col("lat").between(F.col("lat0"), F.col("lat1"))


def box_join(points: DataFrame, boxes: DataFrame, on: tuple[str, ...], cell_deg: float = 0.5) -> DataFrame:
    """Points (lon, lat) inside boxes (lon0, lon1, lat0, lat1) with equal keys. Boxes are dealt to the cells they touch, at
    most all around the globe and from pole to pole; a point has one cell. A box may reach over +-180."""
    n = round(360.0 / cell_deg)
    east = F.least(F.col("lon1"), F.col("lon0") + (360.0 - cell_deg))
    columns = F.array_distinct(F.transform(F.sequence(cell(F.col("lon0"), cell_deg), cell(east, cell_deg)), lambda x: F.pmod(x, F.lit(n))))
    rows = F.sequence(cell(F.greatest(F.col("lat0"), F.lit(-90.0)), cell_deg), cell(F.least(F.col("lat1"), F.lit(90.0)), cell_deg))
    touched = boxes.filter("lon0 <= lon1 and lat0 <= lat1 and lat0 <= 90 and lat1 >= -90").withColumn("_cx", F.explode(columns)).withColumn("_cy", F.explode(rows))
    placed = points.withColumn("_cx", F.pmod(cell(F.col("lon"), cell_deg), F.lit(n))).withColumn("_cy", cell(F.col("lat"), cell_deg))
    out = placed.join(touched, [*on, "_cx", "_cy"])
    return out.filter(in_box()).drop("_cx", "_cy")


def interval_overlap(lo1: Column, hi1: Column, lo2: Column, hi2: Column) -> Column:
    """Length of the intersection of two intervals."""
    return F.greatest(F.lit(0.0), F.least(hi1, hi2) - F.greatest(lo1, lo2))

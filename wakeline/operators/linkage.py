"""Single linkage of points without a row for each pair of them.

Points are put into cells that are narrower than the gap, so that all of a cell are linked. What is left is which
neighbouring cells hold a linked pair. Boxes around their points tell: if even their farthest sides are near enough, the
cells are linked, if their nearest sides are not, they hold no pair, else both boxes are quartered. Cells that are linked
already, by whatever way, are asked no more. Work grows with the points, not with the pairs among them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.functions.geo import axis_difference
from wakeline.functions.nulls import finite
from wakeline.operators import graph
from wakeline.sources.work import cut

#: Cells of a gap's length. Two points of a cell are at most sqrt(2) / CELLS of the gap apart, and cells farther than
#: REACH from each other hold no pair.
CELLS, REACH = 1.5, 2
#: After so many quarterings what is still undecided is decided by its points.
LEVELS = 12
#: Degrees; boxes decide about turns only beyond it, as differences are rounded.
SLACK = 1e-9
KEY = ("kx", "ky", "kt")


def _boxes(points: DataFrame, level: int) -> DataFrame:
    """The boxes around the points of each cell of a level; ``name`` is that of the widest cell."""
    ends = [f(c).alias(f"{c}{n}") for c in ("x", "y", "turned", "bearing") for n, f in ((0, F.min), (1, F.max))]
    return points.withColumns(_at(level)).groupBy("name", *KEY).agg(*ends)


def _side(df: DataFrame, side: str) -> DataFrame:
    return df.withColumnsRenamed({c: f"{c}_{side}" for c in df.columns})


def _bounds(c: str) -> tuple[Column, Column]:
    """Least and greatest distance along one axis of two boxes."""
    p0, p1, q0, q1 = (F.col(f"{c}{n}_{side}") for side in "pq" for n in (0, 1))
    return F.greatest(F.lit(0.0), q0 - p1, p0 - q1), F.greatest(q1 - p0, p1 - q0)


def _judged(pairs: DataFrame, gap_m: float, max_turn: float | None) -> DataFrame:
    """Pairs of boxes with ``sure`` (all their points are linked); those that hold no linked points are left out."""
    (x0, x1), (y0, y1) = _bounds("x"), _bounds("y")
    sure, never = F.hypot(x1, y1) <= gap_m, F.hypot(x0, y0) > gap_m
    if max_turn is not None:
        low, high = F.col("turned0_q") - F.col("turned1_p"), F.col("turned1_q") - F.col("turned0_p")
        holds = lambda d: (low <= d) & (high >= d)
        at = lambda d: F.least(F.abs(d), 180.0 - F.abs(d))
        most = F.when(holds(90.0) | holds(-90.0), F.lit(90.0)).otherwise(F.greatest(at(low), at(high)))
        least = F.when(holds(0.0), F.lit(0.0)).otherwise(F.least(at(low), at(high)))
        single = (F.col("bearing0_p") == F.col("bearing1_p")) & (F.col("bearing0_q") == F.col("bearing1_q"))
        exact = axis_difference(F.col("bearing0_p"), F.col("bearing0_q")) <= max_turn
        sure = sure & F.when(single, exact).otherwise(most <= max_turn - SLACK)
        never = never | F.when(single, ~exact).otherwise(least > max_turn + SLACK)
    return pairs.withColumn("sure", sure).filter(F.col("sure") | ~never)


def _point_pairs(points: DataFrame, pairs: DataFrame, gap_m: float, max_turn: float | None) -> DataFrame:
    """(a, b): names of the cells whose points, at different places, are linked, of ``pairs`` of small cells."""
    places = points.select("name", *KEY, "x", "y", "bearing").distinct()
    for side in "pq":
        pairs = pairs.join(_side(places, side), [f"{c}_{side}" for c in ("name", *KEY)])
    ok = F.hypot(F.col("x_p") - F.col("x_q"), F.col("y_p") - F.col("y_q")) <= gap_m
    if max_turn is not None:
        ok = ok & (axis_difference(F.col("bearing_p"), F.col("bearing_q")) <= max_turn)
    return pairs.filter(ok).select(F.col("name_p").alias("a"), F.col("name_q").alias("b")).distinct()


def _at(level: int) -> dict[str, Column]:
    """The cell of a point at a level."""
    return {k: F.floor(F.col(c) * float(1 << level)) for c, k in zip(("u", "v", "t"), KEY, strict=True)}


def linked(parts: DataFrame, gap_m: float, max_turn: float | None = None) -> DataFrame:
    """(id, component) for every row of ``parts`` (id, x_m, y_m, bearing): single linkage of points at most ``gap_m`` apart
    whose axes differ by at most ``max_turn`` degrees, if given. The component is its smallest id."""
    if not gap_m > 0 or (max_turn is not None and not max_turn > 0):
        raise ValueError("gap and turn must be above 0")
    x, y = (F.col(c).cast("double") for c in ("x_m", "y_m"))
    bearing = turned = turn = F.lit(0.0)
    ok = F.col("id").isNotNull() & finite(x, y)
    if max_turn is not None:
        whole = math.floor(180.0 / max_turn + 1e-6) + 1  # cells narrower than the turn
        bearing = F.col("bearing").cast("double")
        turned = F.pmod(bearing, F.lit(180.0))
        turn, ok = turned * (whole / 180.0), ok & finite(bearing)
    values = {"x": x, "y": y, "bearing": bearing, "turned": turned, "u": x * (CELLS / gap_m), "v": y * (CELLS / gap_m), "t": turn}
    placed = parts.filter(ok).select("id", *(v.alias(c) for c, v in values.items())).withColumns(_at(0))
    named = placed.join(placed.groupBy(*KEY).agg(F.min("id").alias("name")), [*KEY])
    points = everything = cut(named.select("id", "name", *values), "points")

    boxes = cut(_boxes(points, 0), "boxes")
    around = _side(boxes, "q").select("*", *(F.col(f"{k}_q").alias(k) for k in KEY[:2]))
    for k in KEY[:2]:
        around = around.withColumn(k, F.explode(F.sequence(F.col(k) - REACH, F.col(k) + REACH)))
    own = _side(boxes, "p").select("*", *(F.col(f"{k}_p").alias(k) for k in KEY[:2]))
    order = lambda side: F.struct(*(f"{k}_{side}" for k in KEY))
    asked = own.join(around.hint("merge"), [*KEY[:2]]).filter(order("p") < order("q"))

    edges = points.select(F.col("name").alias("a"), F.col("name").alias("b")).limit(0)
    for level in range(LEVELS + 1):
        judged = cut(_judged(asked, gap_m, max_turn), "judged")
        edges = edges.unionByName(judged.filter("sure").select(F.col("name_p").alias("a"), F.col("name_q").alias("b")).distinct())
        cells = cut(graph.components(edges), "cells")
        edges = cells.select(F.col("id").alias("a"), F.col("component").alias("b"))
        rest = judged.filter("not sure")
        for side in "pq":
            to = cells.select(F.col("id").alias(f"name_{side}"), F.col("component").alias(f"in_{side}"))
            rest = rest.join(to, f"name_{side}", "left").withColumn(f"in_{side}", F.coalesce(f"in_{side}", f"name_{side}"))
        pairs = cut(rest.filter("in_p <> in_q").select(*(f"{c}_{side}" for side in "pq" for c in ("name", *KEY))), "undecided")
        if pairs.isEmpty():
            break
        sides = [pairs.select(*(F.col(f"{c}_{side}").alias(c) for c in ("name", *KEY))) for side in "pq"]
        points = cut(points.withColumns(_at(level)).join(sides[0].union(sides[1]).distinct(), ["name", *KEY], "left_semi").select(*points.columns), "points")
        if level == LEVELS:
            edges = edges.unionByName(_point_pairs(points.withColumns(_at(level)), pairs, gap_m, max_turn))
            break
        finer = _boxes(points, level + 1).withColumns({f"over_{k}": F.shiftright(k, 1) for k in KEY})
        asked = pairs
        for side in "pq":
            below = _side(finer, side)
            over = [F.col(f"over_{k}_{side}") == F.col(f"old_{k}") for k in KEY]
            old = asked.withColumnsRenamed({f"{k}_{side}": f"old_{k}" for k in KEY} | {f"name_{side}": "old_name"})
            asked = old.join(below, [F.col("old_name") == F.col(f"name_{side}"), *over]).drop("old_name", *(f"old_{k}" for k in KEY), *(f"over_{k}_{side}" for k in KEY))

    # Each point hangs on the first of its cell, and so on the first of all linked cells; an id at several places links them.
    stars = everything.join(edges.withColumnRenamed("a", "name"), "name", "left").select(F.col("id").alias("a"), F.coalesce("b", "name").alias("b"))
    return graph.with_singles(parts, stars if level < LEVELS else stars.unionByName(edges))

"""Minimum spanning forests by rounds of least edges, and the hierarchy of clusters that a forest holds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.functions.nulls import finite
from wakeline.operators import graph
from wakeline.operators.buckets import NEAR, cell
from wakeline.sources.work import cut

#: Most halvings of a gap, and pairs for each point that the first search may meet.
HALVINGS, PAIRS = 24, 16


def _ordered(a: Column, b: Column) -> tuple[Column, Column]:
    return F.when(a <= b, a).otherwise(b), F.when(a <= b, b).otherwise(a)


def _roots(best: DataFrame) -> DataFrame:
    """(c, root): where each component's least edges lead. Chains of least edges end in two components that chose the same
    edge; the smaller of the two is the root. Each round follows twice as many edges."""
    other = best.select(F.col("c").alias("other"), F.col("other").alias("back"))
    p = best.join(other, "other")
    root = (F.col("back") == F.col("c")) & (F.col("c") < F.col("other"))
    p = cut(p.select("c", F.when(root, F.col("c")).otherwise(F.col("other")).alias("root")), "roots")
    while True:
        far = p.select(F.col("c").alias("root"), F.col("root").alias("far"))
        p = cut(p.join(far, "root").select("c", F.col("far").alias("root"), (F.col("far") != F.col("root")).alias("moved")), "roots")
        moved = p.filter("moved").limit(1).count()
        p = p.drop("moved")
        if not moved:
            return p


def spanning_forest(edges: DataFrame) -> DataFrame:
    """(a, b, w), a < b: the minimum spanning forest of ``edges`` (a, b, w).

    Edges are ordered by w, then their ends, so that the forest is unique; of parallel edges the least counts, loops and
    edges with a null do not. In each round every component takes its least edge out, what these join becomes one, and of
    the edges between two components only the least stays; rounds at least halve the components that have an edge left.
    """
    low, high = _ordered(F.col("a"), F.col("b"))
    e = edges.filter("a IS NOT NULL AND b IS NOT NULL AND w IS NOT NULL").filter(F.col("a") != F.col("b"))
    e = e.select(low.alias("a"), high.alias("b"), F.col("w").cast("double").alias("w")).groupBy("a", "b").agg(F.min("w").alias("w"))
    e = cut(e.select(F.col("a").alias("ca"), F.col("b").alias("cb"), F.struct("w", "a", "b").alias("e")), "forest-edges")
    return _forest(e)[0]


def _forest(e: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The forest (a, b, w) of written edges (ca, cb, e: w, a, b) between components, and what each component that has an
    edge belongs to then (c, root)."""
    kept = become = None
    while not e.isEmpty():
        out = lambda c, other: e.select(F.col(c).alias("c"), "e", F.col(other).alias("other"))  # noqa: E731, B023
        least = out("ca", "cb").unionByName(out("cb", "ca")).groupBy("c").agg(F.min(F.struct("e", "other")).alias("x"))
        best = cut(least.select("c", "x.e", "x.other"), "least")
        chosen = best.select("e").distinct()
        kept = chosen if kept is None else kept.unionByName(chosen)
        to = _roots(best)
        if become is None:
            become = to
        else:
            moved = to.select(F.col("c").alias("root"), F.col("root").alias("far"))
            become = cut(become.join(moved, "root", "left").select("c", F.coalesce("far", "root").alias("root")), "become")
        for c in ("ca", "cb"):
            e = e.join(to.withColumnRenamed("c", c), c).drop(c).withColumnRenamed("root", c)
        low, high = _ordered(F.col("ca"), F.col("cb"))
        e = e.filter(F.col("ca") != F.col("cb")).select(low.alias("ca"), high.alias("cb"), "e")
        e = cut(e.groupBy("ca", "cb").agg(F.min("e").alias("e")), "forest-edges")
    return (e.select("e") if kept is None else kept).select("e.a", "e.b", "e.w"), become


def _start(places: DataFrame, gap_m: float, on: list[str]) -> int:
    """How often to halve the gap before the first search, for few pairs of places."""
    n = places.count()
    for h in range(HALVINGS):
        r = gap_m / 2.0**h
        sizes = places.groupBy(*on, F.floor(F.col("x") / r), F.floor(F.col("y") / r)).agg(F.count("*").alias("n"))
        if (sizes.agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0) * 9 <= PAIRS * n:
            return h
    return HALVINGS


def _apart(places: DataFrame, r: float, on: list[str]) -> DataFrame:
    """The places that have one of another component (c) in a cell next to theirs, with their cell (cx, cy)."""
    held = places.withColumn("cx", cell(F.col("x"), r)).withColumn("cy", cell(F.col("y"), r))
    kinds = held.groupBy(*on, "cx", "cy").agg(F.min("c").alias("low"), F.max("c").alias("high"))
    for k in ("cx", "cy"):
        kinds = kinds.withColumn(k, F.explode(F.array(*(F.col(k) + j for j in NEAR))))
    mixed = kinds.groupBy(*on, "cx", "cy").agg(F.min("low").alias("low"), F.max("high").alias("high")).filter("low <> high")
    return held.join(mixed.select(*on, "cx", "cy"), [*on, "cx", "cy"], "left_semi")


def _pairs_apart(places: DataFrame, r: float, on: list[str]) -> DataFrame:
    """(ca, cb, a, b, d): places of two components at most ``r`` apart, each pair once, by cells as wide as that."""
    near = cut(_apart(places, r, on), "apart")
    other = near.select(*on, F.col("id").alias("b"), F.col("c").alias("cb"), F.col("x").alias("x2"), F.col("y").alias("y2"), "cx", "cy")
    for k in ("cx", "cy"):
        other = other.withColumn(k, F.explode(F.array(*(F.col(k) + j for j in NEAR))))
    met = near.withColumnsRenamed({"id": "a", "c": "ca"}).join(other.hint("merge"), [*on, "cx", "cy"]).filter("a < b AND ca <> cb")
    return met.select("ca", "cb", "a", "b", F.hypot(F.col("x") - F.col("x2"), F.col("y") - F.col("y2")).alias("d")).filter(F.col("d") <= r)


def near_forest(parts: DataFrame, gap_m: float, on: Sequence[str] = (), digits: int | None = None) -> DataFrame:
    """(a, b, w), a < b: the minimum spanning forest of all pairs of ``parts`` (id, x_m, y_m, and ``on``) at most ``gap_m``
    apart with equal ``on``, w being the distance (rounded to ``digits``). Ids are unique, also across ``on``.

    Pairs are never all listed. Those within a small radius are, with few for each part; their forest is part of the whole
    one. Then the radius doubles, and only parts near one of another component are searched. Of parts at one place all hang
    on the smallest id, as in the whole forest, and only that one is searched.
    """
    on = list(on)
    x, y = (F.col(c).cast("double") for c in ("x_m", "y_m"))
    held = cut(parts.filter(F.col("id").isNotNull() & finite(x, y)).select(*on, "id", (x + 0.0).alias("x"), (y + 0.0).alias("y")), "parts")
    first = held.groupBy(*on, "x", "y").agg(F.min("id").alias("first"))
    places = cut(first.select(*on, F.col("first").alias("id"), F.col("first").alias("c"), "x", "y"), "places")
    hung = held.join(first, [*on, "x", "y"]).filter("id <> first")
    length = (lambda d: F.round(d, digits)) if digits is not None else (lambda d: d)
    out = hung.select(F.col("first").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("w"))
    start = _start(places, gap_m, on)
    for h in range(start, -1, -1):
        r = gap_m / 2.0**h
        met = _pairs_apart(places, r if digits is None else r + 10.0**-digits, on).withColumn("w", length(F.col("d"))).filter(F.col("d") <= gap_m)
        # Later searches hold no shorter edge: one whose length is rounded up beyond this radius waits for the next.
        edges = cut((met if h == 0 else met.filter(F.col("w") <= r)).select("ca", "cb", F.struct("w", "a", "b").alias("e")), "near")
        zero = edges.filter("e.w = 0").select("e.a", "e.b")
        if h == start and not zero.isEmpty():
            # Lengths of 0 between places: ids decide, and the place with the smaller one meets every part of the other.
            touched = zero.select(F.col("a").alias("first")).union(zero.select(F.col("b").alias("first"))).distinct()
            ties = hung.join(touched, "first", "left_semi").select(F.col("first").alias("a"), F.col("id").alias("b"))
            ties = ties.unionByName(zero.withColumnRenamed("b", "first").join(hung.select("first", F.col("id").alias("b")), "first").select("a", "b"))
            edges = cut(edges.unionByName(ties.select(F.col("a").alias("ca"), F.col("b").alias("cb"), F.struct(F.lit(0.0).alias("w"), "a", "b").alias("e"))), "near")
            hung = hung.join(touched, "first", "left_anti")
            out = hung.select(F.col("first").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("w"))
        kept, to = _forest(edges)
        out = out.unionByName(kept)
        if to is not None:
            places = places.join(to.withColumnRenamed("c", "_c"), F.col("c") == F.col("_c"), "left").withColumn("c", F.coalesce("root", "c")).select(*on, "id", "c", "x", "y")
            places = cut(places, "places")
            if places.groupBy(*on).agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low <> high").isEmpty():
                break
    return out


def least_apart(parts: DataFrame, membership: DataFrame, gap_m: float) -> DataFrame:
    """(component, w): the least distance from a part of each component (``membership``: id, component) to one of another,
    up to ``gap_m``; only parts near one of another component meet."""
    x, y = (F.col(c).cast("double") for c in ("x_m", "y_m"))
    placed = parts.filter(finite(x, y)).select("id", x.alias("x"), y.alias("y")).join(membership.select("id", F.col("component").alias("c")), "id")
    met = _pairs_apart(placed, gap_m, [])
    both = met.select(F.col("ca").alias("component"), "d").unionByName(met.select(F.col("cb").alias("component"), "d"))
    return both.groupBy("component").agg(F.min("d").alias("w"))


def near_heights(parts: DataFrame, gap_m: float, group: str, digits: int | None = None) -> DataFrame:
    """``merge_heights`` of all pairs of a group's parts (group, id, x_m, y_m) at most ``gap_m`` apart."""
    own = parts.filter(F.col("id").isNotNull() & F.col(group).isNotNull()).distinct().withColumn("id", F.struct(F.col(group).alias("g"), F.col("id").alias("id")))
    return near_forest(own, gap_m, (group,), digits).groupBy(F.col("a.g").alias(group)).agg(F.max("w").alias("height"))


def merge_heights(edges: DataFrame, group: str) -> DataFrame:
    """(group, height): the longest edge of each group's minimum spanning forest, from edges (group, a, b, w). An id may
    be in several groups; groups without an edge have no row."""
    end = lambda c: F.struct(F.col(group).alias("g"), F.col(c).alias("id"))
    forest = spanning_forest(edges.filter("a IS NOT NULL AND b IS NOT NULL").select(end("a").alias("a"), end("b").alias("b"), "w"))
    return forest.groupBy(F.col("a.g").alias(group)).agg(F.max("w").alias("height"))


def dendrogram(nodes: DataFrame, forest: DataFrame, heights: Sequence[float]) -> DataFrame:
    """(height, part, component, n): what each cluster (``part``) of the height before belongs to at each height, and how
    many nodes that ``component`` has; before the first height each node is a part. Clusters are named by their smallest
    id (long).

    The forest's edges are used once: those up to a height join clusters, the others meet the clusters by name.
    """
    parts = nodes.select(F.col("id").alias("component")).distinct().withColumn("n", F.lit(1).cast("long"))
    left, out = forest.select("a", "b", "w"), None
    for height in sorted(set(heights)):
        joined = graph.components(left.filter(F.col("w") <= height)).withColumnRenamed("component", "top")
        step = parts.select(F.col("component").alias("id"), "n").join(joined, "id", "left").select(F.col("id").alias("part"), F.coalesce("top", "id").alias("component"), "n")
        sizes = step.groupBy("component").agg(F.sum("n").alias("n"))
        step = cut(step.drop("n").join(sizes, "component").select(F.lit(float(height)).alias("height"), "part", "component", "n"), "dendrogram")
        out = step if out is None else out.unionByName(step)
        parts = step.select("component", "n").distinct()
        moved = step.filter("part <> component").select("part", "component")
        left = left.filter(F.col("w") > height)
        for c in ("a", "b"):
            to = moved.select(F.col("part").alias(c), F.col("component").alias("to"))
            left = left.join(to, c, "left").withColumn(c, F.coalesce("to", c)).drop("to")
        left = cut(left.select("a", "b", "w"), "dendrogram-edges")
    return out


def sweep(levels: DataFrame) -> DataFrame:
    """(height, n_components, largest, single_share) from a ``dendrogram``."""
    clusters = levels.select("height", "component", "n").distinct()
    return clusters.groupBy("height").agg(F.count("*").alias("n_components"), F.max("n").alias("largest"), F.avg((F.col("n") == 1).cast("double")).alias("single_share"))

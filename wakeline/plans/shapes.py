"""Queries of shapes, clustering validation, case sampling and run checks."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from wakeline.functions import polygon
from wakeline.operators import audit, buckets, gaps, regions, tables
from wakeline.plans.registry import query
from wakeline.plans.slicks import FORECAST, MEMBER, PAIR_SQL, components, particles, sql_of
from wakeline.sources import testdata as td
from wakeline.sources.work import cut

# Each supplier owns a right-angled box w by h, turned by no angle, so that SQL can say its area and overlaps.
BOX = {"id": "s_suppkey", "x": "((s_suppkey * 31) % 500) * 1e-2 - 93e0", "y": "((s_suppkey * 17) % 300) * 1e-2 + 25e0", "w": "(s_suppkey % 7 + 1) * 4e-2", "h": "(s_suppkey % 5 + 1) * 3e-2"}
BOX_SQL = sql_of("bx", "supplier", BOX)


def boxes(spark, d):
    corner = lambda dx, dy: F.struct((F.col("x") + dx * F.col("w")).alias("x"), (F.col("y") + dy * F.col("h")).alias("y"))
    return td.derived(spark, d, "supplier", BOX).withColumn("ring", F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1)))


@query("shape_metrics", f"WITH {BOX_SQL} SELECT id, w * h AS area, 2 * (w + h) AS perimeter, pi() * w * h / (w + h) ** 2 AS compactness FROM bx", "area perimeter compactness")
def _(spark, d):
    r = F.col("ring")
    return boxes(spark, d).select("id", polygon.area(r).alias("area"), polygon.perimeter(r).alias("perimeter"), polygon.polsby_popper(r).alias("compactness"))


AUTHALIC = lambda x: f"(6378137e0 * (1 - 0.0818191908426215e0 ** 2) / 2 * (sin(radians({x})) / (1 - (0.0818191908426215e0 * sin(radians({x}))) ** 2) + ln((1 + 0.0818191908426215e0 * sin(radians({x}))) / (1 - 0.0818191908426215e0 * sin(radians({x})))) / (2 * 0.0818191908426215e0)))"


@query("geodesic_area", f"WITH {BOX_SQL} SELECT id, radians(w) * 6378137e0 * ({AUTHALIC('(y + h)')} - {AUTHALIC('y')}) / 1e6 AS km2 FROM bx", "km2", digits=5)
def _(spark, d):
    return boxes(spark, d).select("id", (polygon.geodesic_area_m2(F.col("ring")) / 1e6).alias("km2"))


@query("points_in_polygons", f"WITH {BOX_SQL}, {sql_of('det', 'customer', td.DETECTION)} SELECT det_id, id FROM det JOIN bx ON lon > x AND lon < x + w AND lat > y AND lat < y + h")
def _(spark, d):
    b = boxes(spark, d).select("id", "ring", F.col("x").alias("lon0"), (F.col("x") + F.col("w")).alias("lon1"), F.col("y").alias("lat0"), (F.col("y") + F.col("h")).alias("lat1"), F.lit(0).alias("k"))
    # Points of one place and equal boxes are looked at once; their ids follow.
    shapes, members = regions.distinct_shapes(b.withColumn("box", F.struct("ring", "lon0", "lon1", "lat0", "lat1", "k")), "id", "box", "shape")
    det = td.derived(spark, d, "customer", td.DETECTION)
    places = det.select("lon", "lat", F.lit(0).alias("k")).distinct()
    near = buckets.box_join(places, shapes.select("shape", "box.*"), ("k",), cell_deg=0.1)
    # SQL leaves the border out; so do points whose coordinates equal a corner's.
    inner = (F.col("lon") > F.col("lon0")) & (F.col("lon") < F.col("lon1")) & (F.col("lat") > F.col("lat0")) & (F.col("lat") < F.col("lat1"))
    found = cut(near.filter(polygon.contains(F.col("ring"), F.col("lon"), F.col("lat")) & inner).select("lon", "lat", "shape"), "inside")
    return found.join(det.select("det_id", "lon", "lat").hint("merge"), ["lon", "lat"]).join(members.hint("merge"), "shape").select("det_id", "id")


@query("polygon_overlap", f"WITH {BOX_SQL}, p AS (SELECT a.id AS a, b.id AS b, greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) AS inter_area, a.w * a.h + b.w * b.h AS s FROM bx a JOIN bx b ON a.id < b.id) SELECT a, b, inter_area, inter_area / (s - inter_area) AS iou FROM p WHERE inter_area > 1e-9", "inter_area iou")
def _(spark, d):
    # Corners of one against boxes of the other are not enough for crossing boxes: both are dealt to the cells they touch.
    size = 0.1
    shapes, members = regions.distinct_shapes(boxes(spark, d), "id", "ring", "shape")  # equal boxes are looked at once
    corner = lambda f, c: f(F.transform("ring", lambda p: p[c]))
    span = lambda c: F.explode(F.sequence(F.floor(corner(F.array_min, c) / size), F.floor(corner(F.array_max, c) / size)))
    dealt = shapes.withColumn("cx", span("x")).withColumn("cy", span("y"))
    a = dealt.select("cx", "cy", F.col("shape").alias("p"), F.col("ring").alias("ring_a"))
    b = dealt.select("cx", "cy", F.col("shape").alias("q"), F.col("ring").alias("ring_b"))
    pairs = a.join(b.hint("merge"), ["cx", "cy"]).filter("p <= q").select("p", "q", "ring_a", "ring_b").dropDuplicates(["p", "q"])
    met = cut(polygon.overlaps(pairs).filter("inter_area > 1e-9").select("p", "q", "inter_area", "iou"), "overlaps")
    own = lambda shape, name: members.select(F.col("shape").alias(shape), F.col("id").alias(name)).hint("merge")
    both = met.join(own("p", "i"), "p").join(own("q", "j"), "q").filter("p <> q OR i < j")
    return both.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "inter_area", "iou")


TURN = 0.5  # radians, counter-clockwise; a square's long side is either of two


@query("rotated_rectangles", f"""WITH {BOX_SQL} SELECT id, greatest(w, h) AS length, least(w, h) AS width,
  CASE WHEN abs(w - h) < 1e-6 THEN (90 - degrees({TURN}e0)) % 90 WHEN w > h THEN 90 - degrees({TURN}e0) ELSE 180 - degrees({TURN}e0) END AS bearing FROM bx""", "length width bearing", digits=5)
def _(spark, d):
    s, c = math.sin(TURN), math.cos(TURN)
    turned = F.transform("ring", lambda p: F.struct((p["x"] * c - p["y"] * s).alias("x"), (p["x"] * s + p["y"] * c).alias("y")))
    found = polygon.rectangles(boxes(spark, d).withColumn("ring", turned))
    square = F.col("length") - F.col("width") < 1e-6
    return found.select("id", "length", "width", F.when(square, F.col("bearing") % 90).otherwise(F.col("bearing")).alias("bearing"))


@query("gap_distributions", f"""WITH {PAIR_SQL}, s AS (SELECT CASE WHEN a.area_m2 < 3e4 AND b.area_m2 < 3e4 THEN 'small' ELSE 'mixed' END AS stratum, a.id % 2 = b.id % 2 AS intra, gap FROM pr JOIN parts a ON a.id = pr.a JOIN parts b ON b.id = pr.b)
SELECT stratum, intra, count(*) AS n, quantile_cont(gap, 0.1) AS q10, median(gap) AS q50, quantile_cont(gap, 0.9) AS q90 FROM s GROUP BY ALL""", "q10 q50 q90", digits=4)
def _(spark, d):
    parts = components(spark, d).select("id", "x_m", "y_m", (~F.coalesce(F.col("area_m2") < 3e4, F.lit(False))).cast("int").alias("kind"), (F.col("id") % 2).alias("twin"))
    found = gaps.gap_quantiles(parts, 6000.0, 2, (0.1, 0.5, 0.9))
    stratum = F.when(F.col("kind") == 0, "small").otherwise("mixed")
    return found.select(stratum.alias("stratum"), F.col("same").alias("intra"), "n", F.col("q0").alias("q10"), F.col("q1").alias("q50"), F.col("q2").alias("q90"))


@query("best_threshold", f"""WITH m AS (SELECT ((c_custkey * 13) % 100) * 1e-2 AS p, (c_custkey * 11) % 180 < 90 AS truth FROM customer), s AS (SELECT k / 20e0 AS threshold, count(*) FILTER (WHERE p >= k / 20e0 AND truth) AS tp, count(*) FILTER (WHERE p >= k / 20e0 AND NOT truth) AS fp, count(*) FILTER (WHERE p < k / 20e0 AND truth) AS fn FROM m, range(1, 20) g(k) GROUP BY k)
SELECT threshold, 2 * tp / (2 * tp + fp + fn) AS dice FROM s ORDER BY round(2 * tp / (2 * tp + fp + fn), 9) DESC, threshold LIMIT 1""", "threshold dice")
def _(spark, d):
    swept = audit.threshold_sweep(components(spark, d), "prob_mean", F.col("bearing") < 90, [k / 20 for k in range(1, 20)])
    return swept.orderBy(F.round("dice", 9).desc(), "threshold").limit(1).select("threshold", "dice")


@query("endpoint_radii", f"""WITH {sql_of('fc', 'lineitem', FORECAST)}, m AS (SELECT cluster_id, avg(lon) AS x, avg(lat) AS y FROM fc GROUP BY cluster_id), r AS (SELECT cluster_id, run, sqrt((lon - x) ** 2 + (lat - y) ** 2) AS d, lon, lat FROM fc JOIN m USING (cluster_id)),
c AS (SELECT cluster_id, run, avg(lon) AS x, avg(lat) AS y FROM fc GROUP BY ALL), b AS (SELECT cluster_id, sqrt(var_pop(x) + var_pop(y)) AS between_runs FROM c GROUP BY cluster_id)
SELECT cluster_id, median(d) AS r50, quantile_cont(d, 0.9) AS r90, any_value(between_runs) AS between_runs FROM r JOIN b USING (cluster_id) GROUP BY cluster_id""", "r50 r90 between_runs")
def _(spark, d):
    p = particles(spark, d)
    middle = p.groupBy("cluster_id").agg(F.avg("lon").alias("x"), F.avg("lat").alias("y"))
    away = p.join(middle, "cluster_id").withColumn("d", F.hypot(F.col("lon") - F.col("x"), F.col("lat") - F.col("y")))
    radii = away.groupBy("cluster_id").agg(F.median("d").alias("r50"), F.percentile("d", F.lit(0.9)).alias("r90"))
    runs = p.groupBy("cluster_id", "run").agg(F.avg("lon").alias("x"), F.avg("lat").alias("y"))
    return radii.join(runs.groupBy("cluster_id").agg(F.sqrt(F.var_pop("x") + F.var_pop("y")).alias("between_runs")), "cluster_id")


@query("wrong_merges", f"WITH {sql_of('m', 'lineitem', MEMBER)}, c AS (SELECT tile, cluster, count(DISTINCT object) AS k FROM m GROUP BY ALL) SELECT tile, count(*) AS n_clusters, CAST(sum(k - 1) AS BIGINT) AS wrong_merges FROM c GROUP BY tile")
def _(spark, d):
    c = td.derived(spark, d, "lineitem", MEMBER).groupBy("tile", "cluster").agg(F.count_distinct("object").alias("k"))
    return c.groupBy("tile").agg(F.count("*").alias("n_clusters"), F.sum(F.col("k") - 1).alias("wrong_merges"))


@query("sample_cases", """SELECT c_mktsegment AS stratum, c_custkey AS id FROM (SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5(c_custkey::VARCHAR || '-5'), c_custkey) AS n FROM customer WHERE c_acctbal > 0) WHERE n <= 10""")
def _(spark, d):
    ok = td.table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_mktsegment").alias("stratum"), F.col("c_custkey").alias("id"))
    return tables.sample_n(ok, 10, ["stratum"], "id", 5)


@query("typed_copy", "SELECT s_suppkey, s_acctbal, CASE WHEN s_suppkey % 3 = 0 THEN 'fixed installation' END AS source_type, s_suppkey % 3 = 0 AS annotated FROM supplier", "s_acctbal")
def _(spark, d):
    s = td.table(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    kinds = audit.require_unique(s.filter("s_suppkey % 3 = 0").select("s_suppkey", F.lit("fixed installation").alias("source_type")), "s_suppkey")
    return s.join(kinds, "s_suppkey", "left").withColumn("annotated", F.col("source_type").isNotNull())


@query("table_integrity", "SELECT count(*) AS n, count(*) - count(DISTINCT o_orderkey) AS repeated, count(*) FILTER (WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) AS orphans, count(*) FILTER (WHERE o_totalprice IS NULL OR o_totalprice < 0) AS bad_values FROM orders")
def _(spark, d):
    o = td.table(spark, d, "orders")
    keys = o.groupBy("o_orderkey").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated"))
    orphans = o.join(td.table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_anti").agg(F.count("*").alias("orphans"))
    bad = o.agg(F.count_if(F.col("o_totalprice").isNull() | (F.col("o_totalprice") < 0)).alias("bad_values"))
    return keys.crossJoin(orphans).crossJoin(bad)  # one row each


@query("pixel_windows", f"WITH {BOX_SQL} SELECT id, CAST(greatest(0, floor((x + 93) / 1e-2)) AS INT) AS col0, CAST(least(512, ceil((x + w + 93) / 1e-2)) AS INT) AS col1 FROM bx")
def _(spark, d):
    b = td.derived(spark, d, "supplier", BOX)
    at = lambda e: (e + 93) / 1e-2
    return b.select("id", F.greatest(F.lit(0), F.floor(at(F.col("x")))).cast("int").alias("col0"), F.least(F.lit(512), F.ceil(at(F.col("x") + F.col("w")))).cast("int").alias("col1"))


@query("run_status", "SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'failed: not a number' ELSE 'ok' END AS status, CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey * 2e0 END AS value FROM supplier", "value")
def _(spark, d):
    raw = td.table(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 4 == 0, "x").otherwise((F.col("s_suppkey") * 2).cast("string")).alias("raw"))
    value = F.expr("try_cast(raw AS DOUBLE)")
    return raw.select("s_suppkey", F.when(value.isNull(), "failed: not a number").otherwise("ok").alias("status"), value.alias("value"))


@query("versions_kept", "SELECT s_suppkey, version, version = max(version) OVER (PARTITION BY s_suppkey) AS current FROM (SELECT s_suppkey, 1 AS version FROM supplier UNION ALL SELECT s_suppkey, 2 FROM supplier WHERE s_suppkey % 4 = 0)")
def _(spark, d):
    from pyspark.sql import Window

    s = td.table(spark, d, "supplier").select("s_suppkey")
    both = s.withColumn("version", F.lit(1)).unionByName(s.filter("s_suppkey % 4 = 0").withColumn("version", F.lit(2)))
    return both.withColumn("current", F.col("version") == F.max("version").over(Window.partitionBy("s_suppkey")))


@query("stratified_halves", "SELECT c_mktsegment, abs(count(*) FILTER (WHERE true) - 2 * ((count(*) + 1) // 2)) AS odd, (count(*) + 1) // 2 AS n_calibration, count(*) // 2 AS n_test FROM customer GROUP BY c_mktsegment")
def _(spark, d):
    halves = audit.stratified_halves(td.table(spark, d, "customer").select("c_mktsegment", "c_custkey"), "c_mktsegment", "c_custkey")
    counts = halves.groupBy("c_mktsegment").agg(F.count_if(F.col("split") == "calibration").alias("n_calibration"), F.count_if(F.col("split") == "test").alias("n_test"))
    return counts.withColumn("odd", F.col("n_calibration") - F.col("n_test"))

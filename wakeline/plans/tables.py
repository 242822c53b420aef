"""Queries of the relational building blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from wakeline.operators import similarity
from wakeline.operators import tables as ops
from wakeline.plans.registry import query
from wakeline.plans.slicks import FORECAST, MEMBER, particles, sql_of
from wakeline.sources import testdata as td

CAST_SQL = sql_of("fc", "lineitem", FORECAST)


def orders(spark, d):
    return td.table(spark, d, "orders").withColumn("price", F.col("o_totalprice").cast("double"))


def lines(spark, d):
    return td.table(spark, d, "lineitem").withColumn("qty", F.col("l_quantity").cast("double"))


@query("top_per_group", """SELECT o_custkey, o_orderkey, price FROM (
  SELECT o_custkey, o_orderkey, CAST(o_totalprice AS DOUBLE) AS price, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 3""", "price")
def _(spark, d):
    return ops.top_n(orders(spark, d), 3, ["o_custkey"], F.desc("price"), F.col("o_orderkey")).select("o_custkey", "o_orderkey", "price")


@query("sample_per_group", """SELECT o_orderpriority, o_orderkey FROM (
  SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '-7'), o_orderkey) AS n FROM orders) WHERE n <= 25""")
def _(spark, d):
    return ops.sample_n(orders(spark, d), 25, ["o_orderpriority"], "o_orderkey", 7).select("o_orderpriority", "o_orderkey")


@query("strided_sample", """WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS r, count(*) OVER () AS t FROM orders)
SELECT o_orderkey FROM r WHERE r IN (SELECT k * ((SELECT count(*) FROM orders) - 1) // 99 FROM range(100) g(k))""")
def _(spark, d):
    return ops.strided(orders(spark, d), 100, "o_orderkey").select("o_orderkey")


@query("value_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def _(spark, d):
    return ops.value_counts(td.table(spark, d, "events"), "event_type")


@query("pivot_share", """SELECT l_returnflag, coalesce(sum(q) FILTER (WHERE l_linestatus = 'F'), 0) / sum(q) AS F, coalesce(sum(q) FILTER (WHERE l_linestatus = 'O'), 0) / sum(q) AS O
FROM (SELECT l_returnflag, l_linestatus, CAST(l_quantity AS DOUBLE) AS q FROM lineitem WHERE l_linestatus IN ('F', 'O')) GROUP BY l_returnflag""", "F O")
def _(spark, d):
    return ops.pivot_share(lines(spark, d), "l_returnflag", "l_linestatus", ["F", "O"], "qty")


@query("crosstab", """SELECT CASE WHEN grouping(l_returnflag) = 1 THEN 'all' ELSE l_returnflag END AS l_returnflag,
  CASE WHEN grouping(l_linestatus) = 1 THEN 'all' ELSE l_linestatus END AS l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def _(spark, d):
    return ops.crosstab(lines(spark, d), "l_returnflag", "l_linestatus")


DESCRIBED = "mean std least q25 q50 q75 most"


@query("describe", """SELECT o_orderpriority, count(v) AS n, avg(v) AS mean, stddev_samp(v) AS std, min(v) AS least, quantile_cont(v, 0.25) AS q25, median(v) AS q50, quantile_cont(v, 0.75) AS q75, max(v) AS most
FROM (SELECT o_orderpriority, CAST(o_totalprice AS DOUBLE) AS v FROM orders) GROUP BY o_orderpriority""", DESCRIBED, digits=4)
def _(spark, d):
    return ops.describe(orders(spark, d), ["o_orderpriority"], "price")


@query("robust_stats", """WITH x AS (SELECT event_type, CASE WHEN event_id % 11 = 0 THEN 'NaN'::DOUBLE WHEN event_id % 13 = 0 THEN 'Infinity'::DOUBLE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 19 = 0 THEN 0 ELSE value END AS v FROM events),
y AS (SELECT event_type, v, CASE WHEN v IS NOT NULL AND NOT isnan(v) AND NOT isinf(v) THEN v END AS f FROM x)
SELECT event_type, count(f) AS n_finite, quantile_cont(f, 0.01) AS p1, quantile_cont(f, 0.99) AS p99, min(f) AS least, max(f) AS most, avg(f) AS mean, stddev_pop(f) AS std,
  count(*) FILTER (WHERE f = 0) AS n_zero, count(*) FILTER (WHERE isnan(v)) AS n_nan, count(*) FILTER (WHERE isinf(v)) AS n_inf, count(*) FILTER (WHERE v IS NULL) AS n_null FROM y GROUP BY event_type""", "p1 p99 least most mean std")
def _(spark, d):
    odd = "case when event_id % 11 = 0 then double('NaN') when event_id % 13 = 0 then double('Infinity') when event_id % 17 = 0 then null when event_id % 19 = 0 then 0 else value end AS v"
    return ops.robust_stats(td.table(spark, d, "events").selectExpr("event_type", odd), ["event_type"], "v")


@query("agreement", "SELECT l_returnflag, corr(q, p) AS pearson, median(abs(q - p)) AS median_abs_diff, count(*) AS n FROM (SELECT l_returnflag, CAST(l_quantity AS DOUBLE) AS q, CAST(l_extendedprice AS DOUBLE) AS p FROM lineitem) GROUP BY l_returnflag", "pearson median_abs_diff")
def _(spark, d):
    return ops.agreement(lines(spark, d).withColumn("p", F.col("l_extendedprice").cast("double")), ["l_returnflag"], "qty", "p")


@query("group_flags", """SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'O' ) AS n_open, max(CASE WHEN o_orderstatus = 'O' AND o_totalprice > 200000 THEN 1 ELSE 0 END) = 1 AS any_large_open FROM orders GROUP BY o_custkey""")
def _(spark, d):
    is_open = F.col("o_orderstatus") == "O"
    return orders(spark, d).groupBy("o_custkey").agg(F.count_if(is_open).alias("n_open"), F.bool_or(is_open & (F.col("price") > 200000)).alias("any_large_open"))


@query("union_distinct", "SELECT count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier)")
def _(spark, d):
    keys = td.table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).union(td.table(spark, d, "supplier").select("s_nationkey")).distinct()
    return keys.agg(F.count("*").alias("n"))


@query("intersect_keys", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def _(spark, d):
    return td.table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(td.table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")))


@query("distinct_rounded", "SELECT DISTINCT l_returnflag, CAST(round(l_extendedprice / 1000) AS BIGINT) AS thousands FROM lineitem")
def _(spark, d):
    return lines(spark, d).select("l_returnflag", F.round(F.col("l_extendedprice").cast("double") / 1000).cast("long").alias("thousands")).distinct()


@query("multiset_difference", """SELECT k, CASE WHEN s > 0 THEN 'left' ELSE 'right' END AS side, CAST(abs(s) AS BIGINT) AS n FROM (
  SELECT k, sum(v) AS s FROM (SELECT c_nationkey AS k, 1 AS v FROM customer UNION ALL SELECT s_nationkey, -1 FROM supplier) GROUP BY k) WHERE s <> 0""")
def _(spark, d):
    return ops.multiset_difference(td.table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), td.table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")))


@query("side_by_side", "SELECT coalesce(c_custkey, s_suppkey) AS row_, c_name, s_name FROM customer FULL JOIN supplier ON c_custkey = s_suppkey")
def _(spark, d):
    a, b = td.table(spark, d, "customer").selectExpr("c_custkey AS row_", "c_name"), td.table(spark, d, "supplier").selectExpr("s_suppkey AS row_", "s_name")
    return ops.side_by_side(a, b, "row_")


@query("tolerant_projection", "SELECT n_nationkey, n_name FROM nation")
def _(spark, d):
    return ops.existing(td.table(spark, d, "nation"), "n_nationkey", "n_name", "n_population")


@query("row_extremes", "SELECT l_orderkey, l_linenumber, least(l_discount * 1e0, l_tax * 1e0) AS low, greatest(l_discount * 1e0, l_tax * 1e0) AS high FROM lineitem", "low high")
def _(spark, d):
    a, b = (F.col(c).cast("double") for c in ("l_discount", "l_tax"))
    return lines(spark, d).select("l_orderkey", "l_linenumber", F.least(a, b).alias("low"), F.greatest(a, b).alias("high"))


CELLS_SQL = f"{CAST_SQL}, cells AS (SELECT cluster_id, CAST(floor(lon / 0.05e0) AS BIGINT) AS ix, CAST(floor(lat / 0.05e0) AS BIGINT) AS iy, CAST(count(*) AS BIGINT) AS v FROM fc GROUP BY ALL)"


def cells(spark, d):
    at = lambda c: F.floor(F.col(c) / 0.05)
    return particles(spark, d).groupBy("cluster_id", at("lon").alias("ix"), at("lat").alias("iy")).agg(F.count("*").alias("v"))


@query("moving_box_sum", f"""WITH {CELLS_SQL}, n AS (SELECT dx, dy FROM range(-2, 3) a(dx), range(-2, 3) b(dy))
SELECT a.cluster_id, a.ix, a.iy, CAST(sum(b.v) AS BIGINT) AS box_sum FROM cells a CROSS JOIN n JOIN cells b ON b.cluster_id = a.cluster_id AND b.ix = a.ix + dx AND b.iy = a.iy + dy GROUP BY ALL""")
def _(spark, d):
    return ops.moving_box_sum(cells(spark, d), 2, keys=["cluster_id"])


@query("block_average", f"""WITH {CELLS_SQL} SELECT cluster_id, CAST(floor(ix / 4e0) AS BIGINT) AS ix, CAST(floor(iy / 4e0) AS BIGINT) AS iy, count(v) AS n_valid, CASE WHEN count(v) >= 8 THEN avg(v) END AS v FROM cells GROUP BY cluster_id, floor(ix / 4e0), floor(iy / 4e0)""", "v")
def _(spark, d):
    return ops.block_average(cells(spark, d), 4, keys=["cluster_id"])


@query("cumulative_share", "SELECT o_orderkey, cume_dist() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) AS cumulative FROM orders", "cumulative")
def _(spark, d):
    return ops.cumulative_share(orders(spark, d), "o_totalprice", "o_orderpriority").select("o_orderkey", "cumulative")


@query("nulls_last_order", """SELECT c_custkey, best, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY best DESC NULLS LAST, c_custkey) AS INT) AS place
FROM customer LEFT JOIN (SELECT o_custkey, max(CAST(o_totalprice AS DOUBLE)) AS best FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey""", "best")
def _(spark, d):
    from pyspark.sql import Window

    best = orders(spark, d).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("price").alias("best"))
    w = Window.partitionBy("c_nationkey").orderBy(F.desc_nulls_last("best"), "c_custkey")
    return td.table(spark, d, "customer").join(best, "c_custkey", "left").select("c_custkey", "best", F.row_number().over(w).alias("place"))


@query("envelope", f"WITH {CAST_SQL} SELECT cluster_id, floor((min(lon) - 0.1e0) / 0.25e0) * 0.25e0 AS lon_min, ceil((max(lon) + 0.1e0) / 0.25e0) * 0.25e0 AS lon_max, floor((min(lat) - 0.1e0) / 0.25e0) * 0.25e0 AS lat_min, ceil((max(lat) + 0.1e0) / 0.25e0) * 0.25e0 AS lat_max FROM fc GROUP BY cluster_id", "lon_min lon_max lat_min lat_max")
def _(spark, d):
    return ops.envelope(particles(spark, d), ["cluster_id"], 0.1, 0.25)


@query("class_weights", "SELECT o_orderpriority, count(*) AS n, (SELECT count(*) FROM orders) / ((SELECT count(DISTINCT o_orderpriority) FROM orders) * count(*)) AS weight FROM orders GROUP BY o_orderpriority", "weight")
def _(spark, d):
    return ops.class_weights(orders(spark, d), "o_orderpriority")


@query("share_of_total", "SELECT l_returnflag, l_linestatus, sum(CAST(l_quantity AS DOUBLE)) AS amount, sum(CAST(l_quantity AS DOUBLE)) / sum(sum(CAST(l_quantity AS DOUBLE))) OVER (PARTITION BY l_returnflag) AS share FROM lineitem GROUP BY l_returnflag, l_linestatus", "amount share")
def _(spark, d):
    return ops.share_of_total(lines(spark, d), ["l_returnflag", "l_linestatus"], "qty", ["l_returnflag"])


@query("best_so_far", """WITH r AS (SELECT o_custkey AS run, o_orderkey AS step, CAST(o_totalprice AS DOUBLE) AS score FROM orders), b AS (SELECT *, max(score) OVER w AS best, row_number() OVER w AS k, max(score) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM r WINDOW w AS (PARTITION BY run ORDER BY step)),
i AS (SELECT *, prev IS NULL OR score > prev AS improved FROM b), s AS (SELECT *, k - max(CASE WHEN improved THEN k END) OVER (PARTITION BY run ORDER BY step) AS since FROM i)
SELECT run, step, score, best, improved, CAST(since AS INT) AS since, bool_or(since >= 3) OVER (PARTITION BY run ORDER BY step) AS stopped FROM s""", "score best")
def _(spark, d):
    return ops.best_so_far(orders(spark, d).select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("step"), F.col("price").alias("score")), "run", "step", "score", 3)


@query("acceptance", """SELECT l_returnflag, bool_and(coalesce(l_quantity > 0, false)) AS positive, bool_and(coalesce(l_discount <= 0.05, false)) AS cheap, bool_and(coalesce(l_quantity > 0, false)) AND bool_and(coalesce(l_discount <= 0.05, false)) AS accepted FROM lineitem GROUP BY l_returnflag""")
def _(spark, d):
    return ops.checks(lines(spark, d), ["l_returnflag"], positive=F.col("qty") > 0, cheap=F.col("l_discount") <= 0.05)


@query("coverage_margins", """SELECT id, m, CASE WHEN m < 0.3 THEN 'high' WHEN m < 1 THEN 'medium' WHEN m IS NULL THEN 'unknown' ELSE 'low' END AS risk FROM (
  SELECT s_suppkey AS id, least(lon + 93, -88 - lon, lat - 25, 28 - lat) AS m FROM (SELECT s_suppkey, -93e0 + ((s_suppkey * 31) % 500) * 1e-2 AS lon, 25e0 + ((s_suppkey * 17) % 300) * 1e-2 AS lat FROM supplier))""", "m")
def _(spark, d):
    p = td.derived(spark, d, "supplier", td.PLATFORM).selectExpr("id", "lon + 93 AS w", "-88 - lon AS e", "lat - 25 AS s", "28 - lat AS n")
    return ops.margin_risk(p, "w", "e", "s", "n", low=0.3, high=1.0).select("id", F.col("min_margin").alias("m"), "risk")


@query("validity", f"WITH {CAST_SQL} SELECT cluster_id, count(*) AS n, count(*) FILTER (WHERE status = 'active' AND mass_oil > 0 AND mass_evaporated + mass_dispersed <= mass_oil AND lat BETWEEN 25.5 AND 27.5) AS n_valid FROM fc GROUP BY cluster_id")
def _(spark, d):
    ok = (F.col("status") == "active") & (F.col("mass_oil") > 0) & (F.col("mass_evaporated") + F.col("mass_dispersed") <= F.col("mass_oil")) & F.col("lat").between(25.5, 27.5)
    return particles(spark, d).groupBy("cluster_id").agg(F.count("*").alias("n"), F.count_if(ok).alias("n_valid"))


@query("roles", """SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') THEN 'contaminated'
  WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') THEN 'train' WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') THEN 'test' ELSE 'unused' END AS role FROM customer""")
def _(spark, d):
    seen = orders(spark, d).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.bool_or(F.col("o_orderstatus") == "F").alias("f"), F.bool_or(F.col("o_orderstatus") == "O").alias("o"))
    role = F.when(F.col("f") & F.col("o"), "contaminated").when(F.col("f"), "train").when(F.col("o"), "test").otherwise("unused")
    return td.table(spark, d, "customer").join(seen, "c_custkey", "left").select("c_custkey", role.alias("role"))


@query("three_hourly", f"WITH {td.V2_SQL} SELECT mmsi, t FROM pos WHERE (t - {td.T1}) % {3 * td.HOUR} = 0")
def _(spark, d):
    from wakeline.plans.attribution import positions_v2

    return positions_v2(spark, d).filter((F.col("t") - td.T1) % (3 * td.HOUR) == 0).select("mmsi", "t")


TILE_SQL = sql_of("m", "lineitem", MEMBER)


@query("tile_confusion", f"""WITH {TILE_SQL}, c AS (SELECT tile, cluster, object, area, area >= 20 AS said, object % 2 = 0 AS truth FROM m),
hit AS (SELECT tile, cluster, bool_or(truth) AS met FROM c WHERE said GROUP BY ALL), obj AS (SELECT tile, object, bool_or(said) AS found FROM c WHERE truth GROUP BY ALL)
SELECT t.tile, tp, fp, fn, tn, coalesce(false_components, 0) AS false_components, coalesce(missed_components, 0) AS missed_components FROM (SELECT tile, count(*) FILTER (WHERE said AND truth) AS tp, count(*) FILTER (WHERE said AND NOT truth) AS fp, count(*) FILTER (WHERE NOT said AND truth) AS fn, count(*) FILTER (WHERE NOT said AND NOT truth) AS tn FROM c GROUP BY tile) t
LEFT JOIN (SELECT tile, count(*) FILTER (WHERE NOT met) AS false_components FROM hit GROUP BY tile) h ON h.tile = t.tile LEFT JOIN (SELECT tile, count(*) FILTER (WHERE NOT found) AS missed_components FROM obj GROUP BY tile) o ON o.tile = t.tile""")
def _(spark, d):
    said, truth = F.col("area") >= 20, F.col("object") % 2 == 0
    c = td.derived(spark, d, "lineitem", MEMBER).withColumns({"said": said, "truth": truth})
    counts = c.groupBy("tile").agg(*(F.count_if(x).alias(n) for n, x in (("tp", F.col("said") & F.col("truth")), ("fp", F.col("said") & ~F.col("truth")), ("fn", ~F.col("said") & F.col("truth")), ("tn", ~F.col("said") & ~F.col("truth")))))
    false = c.filter("said").groupBy("tile", "cluster").agg(F.bool_or("truth").alias("met")).groupBy("tile").agg(F.count_if(~F.col("met")).alias("false_components"))
    missed = c.filter("truth").groupBy("tile", "object").agg(F.bool_or("said").alias("found")).groupBy("tile").agg(F.count_if(~F.col("found")).alias("missed_components"))
    return counts.join(false, "tile", "left").join(missed, "tile", "left").fillna(0, ["false_components", "missed_components"])


@query("view_deltas", f"""WITH {TILE_SQL}, v AS (SELECT unnest(['full', CASE WHEN tile % 4 <> 0 THEN 'acq_clean' END, CASE WHEN tile % 5 <> 0 THEN 'place_clean' END]) AS view, area >= 20 AS said, object % 2 = 0 AS truth FROM m),
s AS (SELECT view, count(*) FILTER (WHERE said AND truth) / count(*) FILTER (WHERE said OR truth) AS iou FROM v WHERE view IS NOT NULL GROUP BY view) SELECT view, iou, iou - (SELECT iou FROM s WHERE view = 'full') AS delta FROM s""", "iou delta")
def _(spark, d):
    said, truth = F.col("area") >= 20, F.col("object") % 2 == 0
    views = F.array(F.lit("full"), F.when(F.col("tile") % 4 != 0, "acq_clean"), F.when(F.col("tile") % 5 != 0, "place_clean"))
    v = td.derived(spark, d, "lineitem", MEMBER).select(F.explode(views).alias("view"), said.alias("said"), truth.alias("truth")).filter("view is not null")
    s = v.groupBy("view").agg((F.count_if(F.col("said") & F.col("truth")) / F.count_if(F.col("said") | F.col("truth"))).alias("iou"))
    return s.crossJoin(F.broadcast(s.filter("view = 'full'").select(F.col("iou").alias("whole")))).select("view", "iou", (F.col("iou") - F.col("whole")).alias("delta"))  # one row


@query("recall_by_size", f"""WITH {TILE_SQL}, o AS (SELECT tile, object, sum(area) AS area, bool_or(cluster < 4) AS found FROM m GROUP BY ALL)
SELECT size, count(*) AS n, count(*) FILTER (WHERE NOT found) AS missed, count(*) FILTER (WHERE NOT found) / count(*) AS miss_rate, sum(area) / sum(sum(area)) OVER () AS share_of_area FROM (SELECT *, CASE WHEN area < 1e4 THEN 'small' WHEN area < 1.2e4 THEN 'medium' ELSE 'large' END AS size FROM o) GROUP BY size""", "miss_rate share_of_area")
def _(spark, d):
    o = td.derived(spark, d, "lineitem", MEMBER).groupBy("tile", "object").agg(F.sum("area").alias("area"), F.bool_or(F.col("cluster") < 4).alias("found"))
    size = F.when(F.col("area") < 1e4, "small").when(F.col("area") < 1.2e4, "medium").otherwise("large")
    s = o.groupBy(size.alias("size")).agg(F.count("*").alias("n"), F.count_if(~F.col("found")).alias("missed"), F.sum("area").alias("a"))
    whole = s.agg(F.sum("a").alias("w"))  # one row
    return s.crossJoin(F.broadcast(whole)).select("size", "n", "missed", (F.col("missed") / F.col("n")).alias("miss_rate"), (F.col("a") / F.col("w")).alias("share_of_area"))


@query("class_balance", f"WITH {TILE_SQL} SELECT tile % 3 AS split, avg(area) AS mean, stddev_pop(area) AS std, avg((object % 2 = 0)::INT) AS positive_share FROM m GROUP BY tile % 3", "mean std positive_share")
def _(spark, d):
    return td.derived(spark, d, "lineitem", MEMBER).groupBy((F.col("tile") % 3).alias("split")).agg(F.avg("area").alias("mean"), F.stddev_pop("area").alias("std"), F.avg((F.col("object") % 2 == 0).cast("double")).alias("positive_share"))


@query("clip_fractions", f"WITH {TILE_SQL}, c AS (SELECT tile, area, cluster = 3 AS inside FROM m) SELECT tile, avg((area <= 2)::INT) AS clipped_low, avg((area >= 49)::INT) AS clipped_high, avg(area) FILTER (WHERE inside) - avg(area) AS inside_minus_scene FROM c GROUP BY tile", "clipped_low clipped_high inside_minus_scene")
def _(spark, d):
    m = td.derived(spark, d, "lineitem", MEMBER)
    return m.groupBy("tile").agg(F.avg((F.col("area") <= 2).cast("double")).alias("clipped_low"), F.avg((F.col("area") >= 49).cast("double")).alias("clipped_high"), (F.avg(F.when(F.col("cluster") == 3, F.col("area"))) - F.avg("area")).alias("inside_minus_scene"))


@query("first_exit", f"WITH {CAST_SQL} SELECT cluster_id, element, min(lead_h) AS first_exit_h FROM fc WHERE status = 'stranded' GROUP BY ALL")
def _(spark, d):
    return particles(spark, d).filter("status = 'stranded'").groupBy("cluster_id", "element").agg(F.min("lead_h").alias("first_exit_h"))


@query("energy_distance", f"""WITH {CAST_SQL}, p AS (SELECT cluster_id || '/' || lead_h AS cloud, run = 0 AS side, lon AS x, lat AS y FROM fc),
d AS (SELECT a.cloud, a.side AS s, b.side AS r, avg(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS m FROM p a JOIN p b USING (cloud) GROUP BY ALL)
SELECT cloud, 2 * max(m) FILTER (WHERE s AND NOT r) - max(m) FILTER (WHERE s AND r) - max(m) FILTER (WHERE NOT s AND NOT r) AS energy FROM d GROUP BY cloud HAVING bool_or(s) AND NOT bool_and(s)""", "energy")
def _(spark, d):
    at = particles(spark, d).select(F.concat_ws("/", "cluster_id", "lead_h").alias("cloud"), "run", F.col("lon").alias("x"), F.col("lat").alias("y"))
    return similarity.energy_distance(at.filter("run = 0"), at.filter("run > 0"), "cloud")


VECTOR_SQL = "e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), u AS (SELECT id, v, sqrt(list_dot_product(v, v)) AS l FROM e)"
ALIKE, VERIFIED = 0.42, 0.48


def vectors(spark, d):
    return td.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


@query("similar_pairs", f"WITH {VECTOR_SQL} SELECT a.id AS a, b.id AS b, list_dot_product(a.v, b.v) / a.l / b.l AS similarity, list_dot_product(a.v, b.v) / a.l / b.l >= {VERIFIED} AS verified FROM u a JOIN u b ON a.id < b.id WHERE list_dot_product(a.v, b.v) / a.l / b.l >= {ALIKE}", "similarity")
def _(spark, d):
    v = vectors(spark, d)
    return similarity.similar_pairs(v, None, ALIKE).withColumn("verified", F.col("similarity") >= VERIFIED)


@query("cross_corpus", f"WITH {VECTOR_SQL} SELECT a.id AS a, max(list_dot_product(a.v, b.v) / a.l / b.l) AS best FROM u a JOIN u b ON a.id % 2 = 0 AND b.id % 2 = 1 WHERE list_dot_product(a.v, b.v) / a.l / b.l >= {ALIKE} GROUP BY a.id", "best")
def _(spark, d):
    v = vectors(spark, d)
    return similarity.similar_pairs(v.filter("id % 2 = 0"), v.filter("id % 2 = 1"), ALIKE).groupBy("a").agg(F.max("similarity").alias("best"))


# Each vector as it is, against altered ones: component k of vector i is scaled by 1 + ((i * (k + 1) * 37) % 7 - 3) * c.
ALTERED = 0.97


@query("altered_copies", f"""WITH {VECTOR_SQL}, x AS (SELECT id, v, l FROM u), y AS (SELECT id, list_transform(range(len(v)), lambda k: v[k + 1] * (1 + ((id * (k + 1) * 37) % 7 - 3) * (CASE WHEN id % 3 = 0 THEN 15e-2 ELSE 5e-2 END))) AS w FROM u),
z AS (SELECT id, w, sqrt(list_dot_product(w, w)) AS m FROM y) SELECT x.id AS a, z.id AS b, list_dot_product(v, w) / l / m AS similarity FROM x, z WHERE list_dot_product(v, w) / l / m >= {ALTERED}""", "similarity")
def _(spark, d):
    v = vectors(spark, d)
    by = F.when(F.col("id") % 3 == 0, F.lit(0.15)).otherwise(F.lit(0.05))
    scaled = F.transform("v", lambda p, k: p.cast("double") * (1 + ((F.col("id") * (k + 1) * 37) % 7 - 3) * by))
    return similarity.similar_pairs(v, v.select("id", scaled.alias("v")), ALTERED)


@query("hash_overlap", "SELECT count(*) AS n, count(DISTINCT doc_id) AS documents FROM (SELECT doc_id, sha256(text) AS h FROM documents WHERE source = (SELECT min(source) FROM documents)) WHERE h IN (SELECT sha256(text) FROM documents WHERE source <> (SELECT min(source) FROM documents))")
def _(spark, d):
    docs = td.table(spark, d, "documents").select("doc_id", "source", F.sha2("text", 256).alias("h"))
    first = docs.agg(F.min("source").alias("s"))
    own, other = docs.join(F.broadcast(first), F.col("source") == F.col("s"), "left_semi"), docs.join(F.broadcast(first), F.col("source") == F.col("s"), "left_anti").filter("source is not null")
    return own.join(other.select("h").distinct(), "h", "left_semi").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("documents"))


@query("owned_items", """SELECT c_custkey, CAST(floor(x / 5e4) AS BIGINT) AS tile_x, CAST(floor(y / 5e4) AS BIGINT) AS tile_y, CAST((floor((x + 5e3) / 5e4) - floor((x - 5e3) / 5e4) + 1) * (floor((y + 5e3) / 5e4) - floor((y - 5e3) / 5e4) + 1) AS BIGINT) AS n_tiles
FROM (SELECT c_custkey, ((c_custkey * c_custkey * 7919) % 39979) * 1e1 AS x, ((c_custkey * 104729) % 39989) * 1e1 AS y FROM customer)""")
def _(spark, d):
    c = td.derived(spark, d, "customer", td.COMPONENT).selectExpr("component_id AS c_custkey", "x_m AS x", "y_m AS y")
    return ops.owned(c, 5e4, 5e3).drop("x", "y")


@query("tent_blend", """WITH w AS (SELECT p_partkey * 4 AS w0, ((p_partkey * 13) % 101) / 101e0 AS p FROM part), e AS (SELECT w0 + k AS x, 1 - abs(k - 3.5e0) / 4.5e0 AS t, p FROM w, range(8) g(k)) SELECT x, sum(t * p) / sum(t) AS blend, count(*) AS n_windows FROM e GROUP BY x""", "blend")
def _(spark, d):
    w = td.table(spark, d, "part").selectExpr("p_partkey * 4 AS w0", "((p_partkey * 13) % 101) / double(101) AS p")
    return ops.tent_blend(w, 8, 4)


@query("schema_difference", "SELECT * FROM (VALUES ('n_nationkey', 'int', CAST(NULL AS VARCHAR), 'differs'), ('n_name', 'string', 'string', 'same'), ('n_regionkey', 'int', 'bigint', 'differs')) v(name, \"left\", \"right\", status)")
def _(spark, d):
    n = td.table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return ops.schema_difference(n, n.select("n_name", F.col("n_regionkey").cast("long").alias("n_regionkey")))


@query("dominant_type", f"""WITH {td.AIS_SQL}, k AS (SELECT mmsi, 'type ' || (event_id % 4) AS kind, lon, lat FROM ais), n AS (SELECT mmsi, kind, count(*) AS c FROM k GROUP BY ALL)
SELECT mmsi, arg_min(kind, (-c, kind)) AS kind, m_lon, m_lat FROM n JOIN (SELECT mmsi, median(lon) AS m_lon, median(lat) AS m_lat FROM k GROUP BY mmsi) USING (mmsi) GROUP BY mmsi, m_lon, m_lat""", "m_lon m_lat", digits=9)
def _(spark, d):
    k = td.ais(spark, d).withColumn("kind", F.concat(F.lit("type "), (F.col("event_id") % 4).cast("string")))
    return k.groupBy("mmsi").agg(F.mode("kind", True).alias("kind"), F.median("lon").alias("m_lon"), F.median("lat").alias("m_lat"))

"""Queries of forests, hierarchies of clusters and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from wakeline.operators import bootstrap, events, forest
from wakeline.plans.registry import query
from wakeline.plans.slicks import LINK_M, MEMBER, PAIR_SQL, components, sql_of
from wakeline.sources import testdata as td

GAPS = (1500.0, 3000.0, 4500.0, 6000.0)

#: An edge is in the forest unless smaller ones (by length, then ends) already join its ends.
FOREST_SQL = f"""{PAIR_SQL}, ed AS (SELECT a, b, round(gap, 6) AS w FROM pr),
both_ways AS (SELECT a AS x, b AS y, w, a, b FROM ed UNION ALL SELECT b, a, w, a, b FROM ed),
reach(a, b, w, node) AS (
  SELECT a, b, w, a FROM ed
  UNION SELECT r.a, r.b, r.w, e.y FROM reach r JOIN both_ways e ON e.x = r.node AND (e.w, e.a, e.b) < (r.w, r.a, r.b)),
mst AS (SELECT a, b, w FROM ed WHERE (a, b) NOT IN (SELECT (a, b) FROM reach WHERE node = b))"""


def near_forest(spark, d):
    return forest.near_forest(components(spark, d), LINK_M, digits=6)


@query("spanning_forest", f"WITH RECURSIVE {FOREST_SQL} SELECT a, b, w FROM mst", "w")
def _(spark, d):
    return near_forest(spark, d)


# Objects are stripes of the plane; a part at a border is in two of them.
OBJECT_SQL = "SELECT id, CAST(floor(x_m / 5e4) AS BIGINT) AS g FROM parts UNION SELECT id, CAST(floor((x_m + 1e4) / 5e4) AS BIGINT) FROM parts"


@query("merge_heights", f"""WITH RECURSIVE {PAIR_SQL}, ob AS ({OBJECT_SQL}), ed AS (SELECT o.g, a, b, round(gap, 6) AS w FROM pr JOIN ob o ON o.id = a JOIN ob q ON q.id = b AND q.g = o.g),
both_ways AS (SELECT g, a AS x, b AS y, w, a, b FROM ed UNION ALL SELECT g, b, a, w, a, b FROM ed),
reach(g, a, b, w, node) AS (SELECT g, a, b, w, a FROM ed UNION SELECT r.g, r.a, r.b, r.w, e.y FROM reach r JOIN both_ways e ON e.g = r.g AND e.x = r.node AND (e.w, e.a, e.b) < (r.w, r.a, r.b))
SELECT g, max(w) AS height FROM ed WHERE (g, a, b) NOT IN (SELECT (g, a, b) FROM reach WHERE node = b) GROUP BY g""", "height")
def _(spark, d):
    parts = components(spark, d)
    stripe = lambda x: F.floor(x / 5e4).alias("g")
    objects = parts.select("id", stripe(F.col("x_m"))).union(parts.select("id", stripe(F.col("x_m") + 1e4))).distinct()
    return forest.near_heights(parts.select("id", "x_m", "y_m").join(objects, "id"), LINK_M, "g", digits=6)


GAPS_SQL = ", ".join(f"({g:g}e0)" for g in GAPS)
LEVEL_SQL = f"""{PAIR_SQL}, gaps(height) AS (VALUES {GAPS_SQL}), ed AS (SELECT a, b, gap FROM pr UNION ALL SELECT b, a, gap FROM pr),
reach(height, id, c) AS (SELECT height, id, id FROM parts, gaps UNION SELECT r.height, ed.b, r.c FROM reach r JOIN ed ON r.id = ed.a AND ed.gap <= r.height),
comp AS (SELECT height, id, min(c) AS component FROM reach GROUP BY ALL), sized AS (SELECT height, component, count(*) AS n FROM comp GROUP BY ALL)"""


def levels(spark, d):
    return forest.dendrogram(components(spark, d), forest.near_forest(components(spark, d), LINK_M), GAPS)


@query("dendrogram", f"""WITH RECURSIVE {LEVEL_SQL}, prior AS (SELECT c.height, c.id, c.component, p.component AS part FROM comp c JOIN comp p ON p.id = c.id AND p.height = (SELECT max(height) FROM gaps WHERE height < c.height)
  UNION ALL SELECT height, id, component, id FROM comp WHERE height = (SELECT min(height) FROM gaps))
SELECT DISTINCT prior.height, part, component, n FROM prior JOIN sized USING (height, component)""", "height")
def _(spark, d):
    return levels(spark, d)


@query("linkage_sweep", f"WITH RECURSIVE {LEVEL_SQL} SELECT height, count(*) AS n_components, max(n) AS largest, avg((n = 1)::INT) AS single_share FROM sized GROUP BY height", "height single_share")
def _(spark, d):
    return forest.sweep(levels(spark, d))


# The weights of the resampling in SQL: the same hash, the same conditional binomials, one tile after another.
DRAWS, SEED = 200, 7
MIX = "(((CAST(draw AS UBIGINT) * 2654435761 + (i * 40503 + {seed} * 69069 + 1) % 4294967296) & 4294967295))"
STEP = lambda x, shift, factor: f"((xor({x}, {x} >> {shift}) * {factor}) & 4294967295)"
CHANCE = "exp(lgamma(r + 1) - lgamma(k + 1) - lgamma(r - k + 1) + k * ln(1e0 / m) + (r - k) * ln(1 - 1e0 / m))"
BOOT_SQL = f"""{sql_of('mem', 'lineitem', MEMBER)}, per AS (SELECT tile, count(*) FILTER (WHERE cluster = object) AS tp, count(*) AS n FROM mem GROUP BY tile),
numbered AS (SELECT tile, CAST(tp AS DOUBLE) AS tp, CAST(n AS DOUBLE) AS n, row_number() OVER (ORDER BY tile) - 1 AS i, count(*) OVER () AS tiles FROM per),
draws AS (SELECT CAST(d AS INT) AS draw FROM range(1, {DRAWS + 1}) g(d)),
h0 AS (SELECT draw, i, {MIX.format(seed=SEED)} AS h FROM draws, numbered),
h1 AS (SELECT draw, i, {STEP('h', 16, 2246822507)} AS h FROM h0), h2 AS (SELECT draw, i, {STEP('h', 13, 3266489909)} AS h FROM h1),
uni AS (SELECT draw, i, (xor(h, h >> 16) + 5e-1) / 4294967296e0 AS u FROM h2),
walk(draw, i, r, tp, n) AS (
  SELECT draw, CAST(0 AS BIGINT), (SELECT CAST(max(tiles) AS BIGINT) FROM numbered), 0e0, 0e0 FROM draws
  UNION ALL
  SELECT draw, i + 1, r - w, tp + w * t_tp, n + w * t_n FROM (
    SELECT s.*, CASE WHEN m = 1 THEN r ELSE CAST(len(list_filter(range(0, r + 1), lambda q: list_sum(list_transform(range(0, q + 1), lambda k: {CHANCE})) < u)) AS BIGINT) END AS w
    FROM (SELECT k.draw, k.i, k.r, k.tp, k.n, u, t.tp AS t_tp, t.n AS t_n, t.tiles - t.i AS m FROM walk k JOIN numbered t ON t.i = k.i JOIN uni ON uni.draw = k.draw AND uni.i = k.i) s)),
sums AS (SELECT draw, tp, n FROM walk WHERE i = (SELECT max(tiles) FROM numbered))"""


def draws(spark, d):
    m = td.derived(spark, d, "lineitem", MEMBER)
    tiles = m.groupBy("tile").agg(F.count_if(F.col("cluster") == F.col("object")).alias("tp"), F.count("*").alias("n"))
    return bootstrap.bootstrap_sums(tiles, DRAWS, ("tp", "n"), seed=SEED)


@query("bootstrap_draws", f"WITH RECURSIVE {BOOT_SQL} SELECT * FROM sums", "tp n")
def _(spark, d):
    return draws(spark, d)


@query("bootstrap_interval", f"WITH RECURSIVE {BOOT_SQL} SELECT avg(tp / n) AS mean, quantile_cont(tp / n, 0.025) AS lo, quantile_cont(tp / n, 0.975) AS hi, count(*) AS draws FROM sums WHERE n > 0", "mean lo hi")
def _(spark, d):
    return bootstrap.interval(draws(spark, d), "tp", "n")


# Candidates, and the quality of linkage over settings.

MIN_AREA, LOOK = 23_000.0, 6000.0


@query("candidate_builder", f"""WITH RECURSIVE {PAIR_SQL}, kp AS (SELECT * FROM parts WHERE area_m2 >= {MIN_AREA}), kr AS (SELECT pr.* FROM pr JOIN kp x ON x.id = a JOIN kp y ON y.id = b),
ed AS (SELECT a, b FROM kr WHERE gap <= 4500 AND turn <= 60 UNION ALL SELECT b, a FROM kr WHERE gap <= 4500 AND turn <= 60),
reach(id, c) AS (SELECT id, id FROM kp UNION SELECT ed.b, reach.c FROM reach JOIN ed ON reach.id = ed.a), comp AS (SELECT id, min(c) AS component FROM reach GROUP BY id),
sums AS (SELECT component, count(*) AS n_parts, sum(area_m2) AS area_m2, sum(prob_mean * area_m2) / sum(area_m2) AS confidence,
  CASE WHEN count(*) >= 2 THEN sqrt(sum(area_m2 * cos(2 * radians(bearing))) ** 2 + sum(area_m2 * sin(2 * radians(bearing))) ** 2) / sum(area_m2) END AS coherence FROM kp JOIN comp USING (id) GROUP BY component),
apart AS (SELECT c, min(gap) AS isolation_m FROM (SELECT unnest([x.component, y.component]) AS c, gap FROM kr JOIN comp x ON x.id = a JOIN comp y ON y.id = b WHERE x.component <> y.component) GROUP BY c)
SELECT row_number() OVER (ORDER BY round(area_m2, 6) DESC, component) - 1 AS candidate, component, n_parts, area_m2, confidence, coherence, isolation_m FROM sums LEFT JOIN apart ON c = component""", "area_m2 confidence coherence isolation_m", digits=4)
def _(spark, d):
    return events.candidates(components(spark, d), 4500.0, MIN_AREA, 60.0, LOOK)


SETTINGS: list[tuple[float, float | None]] = [(2000.0, None), (4500.0, None), (4500.0, 30.0)]


@query("linkage_quality", f"""WITH RECURSIVE {PAIR_SQL}, st(s, gap_m, max_turn) AS (VALUES {', '.join(f"({k}, {g}e0, {'NULL' if t is None else f'{t}e0'})" for k, (g, t) in enumerate(SETTINGS))}),
both_ways AS (SELECT a, b, gap, turn FROM pr UNION ALL SELECT b, a, gap, turn FROM pr), ed AS (SELECT s, a, b FROM both_ways, st WHERE gap <= gap_m AND (max_turn IS NULL OR turn <= max_turn)),
reach(s, id, c) AS (SELECT s, id, id FROM parts, st UNION SELECT r.s, ed.b, r.c FROM reach r JOIN ed ON ed.s = r.s AND r.id = ed.a), comp AS (SELECT s, id, min(c) AS k FROM reach GROUP BY ALL),
cell AS (SELECT s, id % 4 AS tile, k, id % 9 AS object, sum(area_m2) AS area FROM comp JOIN parts USING (id) GROUP BY ALL),
byc AS (SELECT s, count(*) AS n_clusters, sum(best) / sum(whole) AS purity, avg((kinds > 1)::INT) AS mixed_rate FROM (SELECT s, max(area) AS best, sum(area) AS whole, count(*) AS kinds FROM cell GROUP BY s, tile, k) GROUP BY s),
byo AS (SELECT s, count(*) AS n_objects, sum(best) / sum(whole) AS recovery, avg((kinds > 1)::INT) AS split_rate FROM (SELECT s, max(area) AS best, sum(area) AS whole, count(*) AS kinds FROM cell GROUP BY s, tile, object) GROUP BY s)
SELECT gap_m, max_turn, n_clusters, purity, mixed_rate, n_objects, recovery, split_rate FROM st JOIN byc USING (s) JOIN byo USING (s)""", "purity mixed_rate recovery split_rate")
def _(spark, d):
    parts = components(spark, d).withColumns({"tile": F.col("id") % 4, "object": F.col("id") % 9})
    return events.linkage_quality(parts, SETTINGS)

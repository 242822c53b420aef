"""Queries of hashes, folds and checked tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from wakeline.operators import checks, folds, hashing
from wakeline.plans.registry import query
from wakeline.plans.slicks import MEMBER, sql_of
from wakeline.plans.tables import VECTOR_SQL, vectors
from wakeline.sources import testdata as td

RADIUS, FOLDS = 7, 5
BITS_SQL = "CAST(list_sum(list_transform(range(63), lambda k: CASE WHEN {v}[k + 2] > {v}[k + 1] THEN CAST(1 AS HUGEINT) << k ELSE 0 END)) AS BIGINT)"


@query("difference_hash", f"WITH {VECTOR_SQL} SELECT id, {BITS_SQL.format(v='v')} AS hash FROM e")
def _(spark, d):
    return vectors(spark, d).select("id", hashing.difference_hash("v").alias("hash"))


# Each vector against copies in which every eleventh to thirteenth number is turned round.
ALTERED = "CASE WHEN k % (11 + id % 3) = 0 THEN -v[k + 1] ELSE v[k + 1] END"


@query("near_hashes", f"""WITH {VECTOR_SQL}, x AS (SELECT id, {BITS_SQL.format(v='v')} AS hash FROM e), y AS (SELECT id, list_transform(range(64), lambda k: {ALTERED}) AS w FROM e), z AS (SELECT id, {BITS_SQL.format(v='w')} AS hash FROM y)
SELECT x.id AS a, z.id AS b, CAST(bit_count(xor(x.hash, z.hash)) AS INT) AS distance FROM x, z WHERE bit_count(xor(x.hash, z.hash)) <= {RADIUS}""")
def _(spark, d):
    v = vectors(spark, d)
    turned = v.select("id", F.expr("transform(v, (p, k) -> CASE WHEN k % (11 + id % 3) = 0 THEN -p ELSE p END)").alias("v"))
    hashed = lambda df: df.select("id", hashing.difference_hash("v").alias("hash"))
    return hashing.near_hashes(hashed(v), hashed(turned), RADIUS)


LABELS = ("F", "O", "P")
COST = " + ".join(f"h[f * 3 + {j + 1}] * p[{j + 1}] * w[{j + 1}]" for j in range(3))
FOLD_SQL = f"""gr AS (SELECT o_custkey AS g, count(*) AS n, [{', '.join(f"count(*) FILTER (WHERE o_orderstatus = '{x}')" for x in LABELS)}] AS p FROM orders GROUP BY o_custkey),
named AS (SELECT *, '{{' || array_to_string(list_filter([{', '.join(f"CASE WHEN p[{j + 1}] > 0 THEN '\"{x}\":' || p[{j + 1}] END" for j, x in enumerate(LABELS))}], lambda x: x IS NOT NULL), ',') || '}}' AS kind FROM gr),
kinds AS (SELECT kind, any_value(p) AS p, any_value(n) AS n, count(*) AS m FROM named GROUP BY kind),
sums AS (SELECT [{', '.join(f'CAST(sum(p[{j + 1}] * (m % {FOLDS})) AS BIGINT)' for j in range(3))}] AS t FROM kinds),
wt AS (SELECT list_transform(t, lambda x: CASE WHEN x > 0 THEN 1000000000000 // x // x ELSE 0 END) AS w FROM sums),
late AS (SELECT kind, p, n, c, row_number() OVER (ORDER BY n DESC, kind, c) AS s FROM kinds, range({FOLDS}) g(c) WHERE c < m % {FOLDS}),
walk(s, h, r, kind, c, fold) AS (
  SELECT CAST(0 AS BIGINT), list_transform(range({FOLDS * 3}), lambda x: CAST(0 AS BIGINT)), list_transform(range({FOLDS}), lambda x: CAST(0 AS BIGINT)), '', CAST(0 AS BIGINT), 0
  UNION ALL
  SELECT s, list_transform(range({FOLDS * 3}), lambda x: h[x + 1] + CASE WHEN x // 3 = best THEN p[x % 3 + 1] ELSE 0 END), list_transform(range({FOLDS}), lambda x: r[x + 1] + CASE WHEN x = best THEN n ELSE 0 END), kind, c, best
  FROM (SELECT l.s, h, r, l.kind, l.c, p, n, CAST(list_sort(list_transform(range({FOLDS}), lambda f: [{COST}, r[f + 1], f]))[1][3] AS INT) AS best FROM walk JOIN late l ON l.s = walk.s + 1, wt)),
numb AS (SELECT g, n, kind, row_number() OVER (PARTITION BY kind ORDER BY g) - 1 AS place FROM named)"""


@query("group_folds", f"""WITH RECURSIVE {FOLD_SQL} SELECT g, numb.n, numb.kind, CASE WHEN place < m - m % {FOLDS} THEN CAST(place % {FOLDS} AS INT) ELSE walk.fold END AS fold
FROM numb JOIN kinds USING (kind) LEFT JOIN walk ON walk.s > 0 AND walk.kind = numb.kind AND walk.c = place - (m - m % {FOLDS})""")
def _(spark, d):
    out = folds.group_folds(td.table(spark, d, "orders"), "o_custkey", F.col("o_orderstatus"), FOLDS)
    return out.withColumnRenamed("o_custkey", "g")


@query("checked_table", f"WITH {sql_of('m', 'lineitem', MEMBER)} SELECT tile, cluster, object, count(*) AS n, sum(area) AS area FROM m GROUP BY ALL", "area")
def _(spark, d):
    m = td.derived(spark, d, "lineitem", MEMBER)
    cells = m.groupBy("tile", "cluster", "object").agg(F.count("*").alias("n"), F.sum("area").alias("area"))
    total = m.count()
    return checks.checked(cells, "cells", rows_kept=F.sum("n") == total, some_rows=checks.every(F.col("n") > 0), areas=checks.every(F.col("area") > 0))

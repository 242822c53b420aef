"""Folds of whole groups with even label counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.operators.numbering import numbered

#: Kinds of groups (their counts of each label) that the driver weighs at most.
MOST_KINDS = 200_000


def weights(totals: list[int]) -> list[int]:
    """How much an imbalance of each label counts: the inverse square of its total, in whole numbers."""
    return [10**12 // t // t if t else 0 for t in totals]


def deal(kinds: list[tuple[list[int], int]], folds: int) -> list[list[int]]:
    """For each kind of group (counts of each label, how many groups are left over) the folds of those groups, in order.

    Each group goes where it keeps the squared label counts of folds lowest, weighed by ``weights``; then to the fold with
    the fewest rows, then to the first.
    """
    n = len(kinds[0][0]) if kinds else 0
    w = weights([sum(c[j] * m for c, m in kinds) for j in range(n)])
    held, rows, out = [[0] * n for _ in range(folds)], [0] * folds, []
    for counts, left in kinds:
        mine = []
        for _ in range(left):
            best = min(range(folds), key=lambda f: (sum(held[f][j] * counts[j] * w[j] for j in range(n)), rows[f], f))  # noqa: B023
            held[best] = [a + b for a, b in zip(held[best], counts, strict=True)]
            rows[best] += sum(counts)
            mine.append(best)
        out.append(mine)
    return out


def group_folds(df: DataFrame, group: str, label: Column, folds: int, most_kinds: int = MOST_KINDS) -> DataFrame:
    """(group, n, kind, fold): whole groups, dealt so that every fold has about as many rows of each label.

    Groups with equal label counts are of one kind. Of a kind, ``folds`` groups at a time go to one fold each, which
    changes no balance; the driver deals what is left over, largest groups first, from a table with a row for each kind.
    With more than ``most_kinds`` kinds, groups of the rarest are dealt by turns alone. A null label is a label; groups
    within a kind are taken in their order.
    """
    counts = df.groupBy(group, F.coalesce(label.cast("string"), F.lit("")).alias("_l")).agg(F.count("*").alias("_n"))
    profile = F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_l", "_n")))))
    groups = counts.groupBy(group).agg(F.sum("_n").alias("n"), profile.alias("kind"))
    table = groups.groupBy("kind").agg(F.count("*").alias("m"), F.max("n").alias("n"))
    known = table.orderBy(F.desc("m"), "kind").limit(most_kinds).collect()
    spark = df.sparkSession
    import json

    known = sorted(((json.loads(r.kind), r.kind, r.m, r.n) for r in known), key=lambda x: (-x[3], x[1]))
    labels = sorted({k for counts_, *_ in known for k in counts_})
    dealt = deal([([c.get(k, 0) for k in labels], m % folds) for c, _, m, _ in known], folds)
    rows = [(kind, m - m % folds, mine) for (_, kind, m, _), mine in zip(known, dealt, strict=True)]
    rest = spark.createDataFrame(rows, "kind string, _even long, _rest array<int>")
    placed = numbered(groups, [group], "_at", ["kind"]).join(rest, "kind", "left")
    turn = F.pmod(F.col("_at"), F.lit(folds)).cast("int")
    over = F.col("_at") >= F.col("_even")
    fold = F.when(over, F.get("_rest", (F.col("_at") - F.col("_even")).cast("int"))).otherwise(turn)
    return placed.select(group, "n", "kind", fold.alias("fold"))

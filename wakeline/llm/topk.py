"""Exact top-k inner products by Fagin's threshold algorithm.

Vectors are dealt by hash of their row into blocks of bounded size. Each block has a sorted list for each dimension. For a
query the lists are read in step, from the end that its sign favours; every vector met is scored at once (random
access), and reading stops when the sum over dimensions of query times last value read, the most that an unread
vector can reach, is under the k-th score. Blocks are independent: each gives its k best, and the k best of those are
the answer. Query blocks meet candidate blocks by a join on the candidate block, never all in one task.

Components are integers floor(1024 x), and scores are exact. Defined results: vectors that are null or empty, or hold
null or non-finite components, take no part, neither do rows without an id; only vectors of equal length are compared;
each row is a candidate of its own, also one that repeats another, and each row that asks is a query of its own, whose
candidates are all rows but itself; ties go to the smaller id; a query with fewer candidates than k gets them all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wakeline.llm import common

K = 10
SCALE = 1024
#: Rows of a block: at least and at most, about ``BLOCKS`` blocks in between; a block's vectors are ``BLOCK_BYTES`` at most.
BLOCK, LARGE_BLOCK, BLOCKS, BLOCK_BYTES = 4096, 32768, 48, 32 << 20
QUERIES = 4096


class Lists:
    """Sorted lists of one block."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.rows, self.ids, self.vectors = rows, ids, vectors
        self.order = np.argsort(vectors, axis=0, kind="stable")
        self.sorted = np.take_along_axis(vectors, self.order, axis=0)

    def best(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best, by score, then id; ``own`` is the query's row."""
        n = len(self.ids)
        up = np.flatnonzero(query < 0)
        down = np.flatnonzero(query > 0)
        met = self.rows == own
        rows, scores = np.zeros(0, np.int64), np.zeros(0, query.dtype)
        at, step = 0, 16
        while at < n:
            to = min(n, at + step)
            new = np.unique(np.concatenate([self.order[at:to][:, up].ravel(), self.order[n - to : n - at][:, down].ravel()]))
            new = new[~met[new]]
            met[new] = True
            rows, scores = np.concatenate([rows, new]), np.concatenate([scores, self.vectors[new] @ query])
            if len(rows) > k:
                kept = np.lexsort((self.ids[rows], -scores))[:k]
                rows, scores = rows[kept], scores[kept]
            if len(up) + len(down) == 0:
                new = np.flatnonzero(~met)
                rows, scores = new[np.argsort(self.ids[new], kind="stable")][:k], np.zeros(min(k, len(new)), query.dtype)
                break
            bound = self.sorted[to - 1, up] @ query[up] + self.sorted[n - to, down] @ query[down]
            if len(rows) >= k and scores.min() > bound:
                break
            at, step = to, step * 2
        kept = np.lexsort((self.ids[rows], -scores))[:k]
        return self.ids[rows[kept]], scores[kept]


def _whole(vector: Column) -> Column:
    """Whether every component is a finite number."""
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def _packed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each block: numbers of rows, ids and integer vectors as bytes."""

    def pack(table: pa.Table) -> pa.Table:
        numbers = {c: table.column(n).to_numpy().astype("<i8").tobytes() for c, n in (("rows", "row"), ("ids", "vec_id"))}
        vectors = np.floor(SCALE * np.array(table.column("vector").to_pylist(), np.float64))
        held = {**numbers, "vectors": vectors.astype("<f8").tobytes()}
        return pa.table({k: table.column(k).slice(0, 1) for k in keys} | {c: pa.array([x], pa.binary()) for c, x in held.items()})

    schema = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys) + ", rows binary, ids binary, vectors binary"
    return rows.groupBy(*keys).applyInArrow(pack, schema)


def top_k(df: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, block: int | None = None, query_block: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score; ``queries`` is a condition on ``vec_id``.

    Each block of queries is copied once for each block of rows, in a join that is merged: what is copied must never be
    broadcast, however small it was before.
    """
    vector = F.transform(F.col(f"`{vector_col}`"), lambda x: x.cast("double"))
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), vector.alias("vector")).filter(F.col("vec_id").isNotNull() & _whole(F.col("vector")))
    rows = common.cut(rows.withColumns({"dim": F.size("vector"), "row": F.monotonically_increasing_id()}), "vectors")
    n, asked, widest = rows.agg(F.count("*"), F.count_if(queries), F.coalesce(F.max("dim"), F.lit(1))).first()
    fits = lambda most: max(1, min(most, BLOCK_BYTES // (8 * widest)))
    block, query_block = fits(block or min(LARGE_BLOCK, max(BLOCK, n // BLOCKS))), fits(query_block)
    blocks, query_blocks = max(1, -(-n // block)), max(1, -(-asked // query_block))
    place = lambda m: F.pmod(F.xxhash64("row"), F.lit(m)).cast("int")
    held = _packed(rows.withColumn("block", place(blocks)), ["dim", "block"])
    sent = _packed(rows.filter(queries).withColumn("part", place(query_blocks)), ["dim", "part"])
    sent = sent.select("dim", "part", F.col("rows").alias("q_rows"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    met = held.hint("merge").join(sent.hint("merge"), ["dim", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, last = None, None
        for batch in batches:
            for row in batch.to_pylist():
                vectors, asked = (np.frombuffer(row[c], "<f8").reshape(-1, row["dim"]) for c in ("vectors", "q_vectors"))
                exact = np.abs(vectors).max() * np.abs(asked).max() * row["dim"] < 2**52
                if last != (row["dim"], row["block"], exact):
                    lists = Lists(np.frombuffer(row["rows"], "<i8"), np.frombuffer(row["ids"], "<i8"), vectors if exact else _integers(vectors))
                    last = (row["dim"], row["block"], exact)
                found = []
                queries = zip(np.frombuffer(row["q_rows"], "<i8"), np.frombuffer(row["q_ids"], "<i8"), asked if exact else _integers(asked), strict=True)
                for own, q, v in queries:
                    ids, scores = lists.best(v, int(own), k)
                    found.append((np.full(len(ids), own), np.full(len(ids), q), ids, np.array([_long(s) for s in scores], np.int64)))
                columns = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["own", "query_id", "vec_id", "score"])

    best = met.select("dim", "block", "rows", "ids", "vectors", "q_rows", "q_ids", "q_vectors").mapInArrow(common.settled(run), "own long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("own").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _integers(vectors: np.ndarray) -> np.ndarray:
    """Python integers, for components whose inner products a double does not hold exactly."""
    return np.array([[int(x) for x in v] for v in vectors], object).reshape(vectors.shape)


def _long(score: float | int) -> int:
    """Scores beyond 64 bits are held at the end of the range."""
    return max(-(2**63), min(2**63 - 1, int(score)))


def op8_threshold_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(common.read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


SQL = """
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.row, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum([q.v[i] * c.v[i] FOR i IN range(1, len(q.v) + 1)]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.row <> c.row AND len(q.v) = len(c.v)
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""

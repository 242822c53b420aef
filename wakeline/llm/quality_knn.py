"""Text quality by nearest-neighbour voting on latent-semantic vectors.

A text is a bag of token shapes (runs of small letters, capitals, digits, and each mark for itself), of shape pairs, and
of what repeats (words that equal the one before, words and lines seen already). Terms are hashed into ``TERMS``
columns; inverse document frequencies come from all documents. A truncated singular value decomposition of a bounded
sample of labelled documents gives the latent space. The labelled vectors are broadcast, their number being the bound;
every document's cosines with all of them are computed in blocks, and the ``NEIGHBOURS`` nearest vote with the
power ``SHARPNESS`` of their similarity.

Defined results: null and empty texts, and those without a term, score the share of good labels in the sample; without
labels the score is 0.5; a document labelled more than once counts with each label; repeated rows get the same score
each; equal similarities are all that matter, so ties at the last neighbour share its weight.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructType

from wakeline.llm import common

TERMS = 4096
RANK = 48
NEIGHBOURS = 25
SHARPNESS = 4
#: Labelled documents that are vectors in the vote, by a hash of their id.
LABELLED = 4000
#: The fixed cut of the score.
CUT = 0.3
BLOCK = 256

_SHAPE = bytearray(range(256))
for _b in range(256):
    if 97 <= _b <= 122 or _b >= 128:
        _SHAPE[_b] = 97
    elif 65 <= _b <= 90:
        _SHAPE[_b] = 65
    elif 48 <= _b <= 57:
        _SHAPE[_b] = 48
    elif _b in (9, 11, 12, 13):
        _SHAPE[_b] = 32
_SHAPE_OF = np.frombuffer(bytes(_SHAPE), np.uint8)


class _Terms(dict):
    def __missing__(self, shape: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        value = self[shape] = xxhash.xxh3_64_intdigest(shape) >> 1
        return value


_terms = _Terms()
_PREVIOUS, _SEEN, _LINE = (xxhash.xxh3_64_intdigest(x) >> 1 for x in (b"same as previous", b"seen before", b"line seen before"))


def terms(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Columns and the log of one more than their counts, per thousand tokens."""
    raw = text.encode("utf-8", "replace")
    if not raw.strip():
        return np.zeros(0, np.int64), np.zeros(0)
    shape = _SHAPE_OF[np.frombuffer(raw, np.uint8)]
    kept = np.concatenate([[True], shape[1:] != shape[:-1]])
    ids = np.fromiter(map(_terms.__getitem__, shape[kept].tobytes().split()), np.int64)
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x]
    before = sum(map(bytes.__eq__, words[1:], words[:-1]))
    extra = np.repeat([_PREVIOUS, _SEEN, _LINE], [before, len(words) - len(set(words)), len(lines) - len(set(lines))])
    pairs = (ids[:-1] * 31 + ids[1:] * 17) & (2**62 - 1)
    columns, n = np.unique(np.concatenate([ids, pairs, extra]) % TERMS, return_counts=True)
    return columns, np.log1p(1000 * n / len(words))


@dataclass
class Model:
    space: np.ndarray | None  # (TERMS, rank): idf times components
    vectors: np.ndarray | None  # (labelled, rank), of length 1
    good: np.ndarray | None
    prior: float

    def project(self, bags: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        out = np.zeros((len(bags), self.space.shape[1]), np.float32)
        for i, (columns, weight) in enumerate(bags):
            out[i] = weight.astype(np.float32) @ self.space[columns]
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)

    def score(self, texts: list[str]) -> np.ndarray:
        out = np.full(len(texts), self.prior)
        if self.vectors is None:
            return out
        k = min(NEIGHBOURS, len(self.vectors))
        for a in range(0, len(texts), BLOCK):
            v = self.project([terms(t) for t in texts[a : a + BLOCK]])
            near = np.maximum(v @ self.vectors.T, 0)
            last = np.partition(near, -k, axis=1)[:, -k, None]
            weight = np.where(near > last, near, 0).astype(np.float64) ** SHARPNESS
            ties = near == last
            room = k - (near > last).sum(1, keepdims=True)
            weight += ties * (last.astype(np.float64) ** SHARPNESS) * room / np.maximum(ties.sum(1, keepdims=True), 1)
            total = weight.sum(1)
            out[a : a + BLOCK] = np.where(total > 0, weight @ self.good / np.where(total > 0, total, 1), self.prior)
        return np.clip(out, 0, 1)


def fit(bags: list[tuple[np.ndarray, np.ndarray]], good: np.ndarray, idf: np.ndarray, rank: int = RANK) -> Model:
    """The latent space and the labelled vectors in it; the decomposition is by random projection with power steps."""
    if not bags:
        return Model(None, None, None, 0.5)
    x = np.zeros((len(bags), TERMS), np.float32)
    for i, (columns, weight) in enumerate(bags):
        x[i, columns] = weight
    x *= idf.astype(np.float32)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    rank = min(rank, len(bags))
    q = np.linalg.qr(x @ (x.T @ (x @ np.random.default_rng(5).standard_normal((TERMS, rank + 16)).astype(np.float32))))[0]
    right = np.linalg.svd(q.T @ x, full_matrices=False)[2][:rank]
    model = Model((right.T * idf[:, None]).astype(np.float32), None, good, float(good.mean()))
    model.vectors = model.project(bags)
    return model


def _frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each column occurs, and the number of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = np.zeros(TERMS, np.int64), 0
        for batch in batches:
            for text in common.strings(batch, "text"):
                held[terms(text)[0]] += 1
                n += 1
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array([*some.tolist(), TERMS], pa.int32()), pa.array([*held[some].tolist(), n], pa.int64())], ["term", "n"])

    out = np.zeros(TERMS + 1, np.int64)
    for r in docs.select("text").mapInArrow(common.settled(run), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r["term"]] = r["n"]
    return out[:TERMS], int(out[TERMS])


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", labelled: int = LABELLED) -> Model:
    """``labels``: id and label (0 or 1); about ``labelled`` of them (all, if fewer) become vectors, by a hash of the id."""
    docs = common.keyed(df, id_col, text_col)
    marks = labels.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("good")).filter("doc_id is not null and good in (0, 1)")
    share = min(1 << 30, (labelled << 30) // max(1, marks.count()))
    marks = marks.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [terms(t) for t in common.strings(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("good"), pa.array([b[0] for b in bags], pa.list_(pa.int64())), pa.array([b[1] for b in bags], pa.list_(pa.float64()))], ["doc_id", "good", "columns", "weight"])

    schema = StructType([docs.schema["doc_id"]]).add("good", IntegerType()).add("columns", ArrayType(LongType())).add("weight", ArrayType(DoubleType()))
    got = docs.join(F.broadcast(marks), "doc_id").select("doc_id", "good", "text").mapInArrow(common.settled(run), schema).toPandas()
    rows = sorted(((i, g, tuple(c), tuple(w)) for i, g, c, w in zip(got["doc_id"], got["good"], got["columns"], got["weight"], strict=True)), key=lambda r: (r[0], r[1]))
    seen, n = _frequencies(docs)
    idf = np.log((n + 1) / (seen + 1)) + 1
    return fit([(np.array(c, np.int64), np.array(w)) for _, _, c, w in rows], np.array([g for _, g, _, _ in rows], np.float64), idf)


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    rows = common.keyed(df, id_col, text_col)
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(held.value.score(common.strings(batch, "text")))], ["doc_id", "score"])

    return rows.mapInArrow(common.settled(run), StructType([rows.schema["doc_id"]]).add("score", DoubleType()))


def in_training(id_col: Column) -> Column:
    return common.crc_of_id(id_col) % 5 != 0


def op6_neighbour_voting(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = common.read(spark, sf_dir, "labels").filter(in_training(F.col("doc_id")))
    out = score(docs, train(docs, labels))
    return out.select("doc_id", (~in_training(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))

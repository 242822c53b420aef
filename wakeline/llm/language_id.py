"""Language identification by prediction by partial matching.

Each language has a context tree over bytes of order 0 to 3, with escape probabilities (method C: a context seen T times
with D different successors escapes with D / (T + D)), down to 1 / 256 for each byte. Successors that a longer context
knows are not excluded below it, so that a code is a little longer than with exclusion. The trees are frozen after
training, so the code length of a text is a sum over its positions, and the language with the shortest code wins.

A tree is kept as sorted arrays of what was seen, eight bytes for each context and successor: its size follows the
training rows, at most ``MODEL_BYTES`` in all, and that is checked.

Defined results: a null text, an empty one or one without a letter is ``und`` with score 0; ties go to the first
language in string order; with nothing to learn from, every text is ``und``. Rows are kept one for one, repeated rows
too, and the other columns of the input do not matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.llm import common

ORDER = 3
UNDETERMINED = "und"
LETTER = re.compile(r"[^\W\d_]")
#: Rows of each language that training reads, by a hash of their id.
DOCS_PER_LANGUAGE = 1500
#: Size of all trees that is broadcast at most.
MODEL_BYTES = 256 << 20
_PAD = bytes(ORDER)
_FOUND = "struct<lang_pred:string,score:double,bits_per_byte:double>"


def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number of four bytes for each byte of the joined texts (three zeros open each), and where each text starts and ends."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    ends = np.cumsum(sizes + ORDER)
    joined = np.frombuffer(_PAD + _PAD.join(raw), np.uint8)
    grams = np.zeros(len(joined), np.uint32)
    for k in range(ORDER + 1):
        grams[ORDER:] |= joined[k : len(joined) - ORDER + k].astype(np.uint32) << np.uint32(8 * (ORDER - k))
    return grams, ends - sizes, ends


class Tree:
    """Of one language: for each order, what was seen with its code length, and contexts with the length of their escape."""

    def __init__(self, grams: np.ndarray, n: np.ndarray) -> None:
        self.orders = []
        for order in range(ORDER, -1, -1):
            seen, at = np.unique(grams & np.uint32(2 ** (8 * order + 8) - 1), return_inverse=True)
            times = np.bincount(at, n, len(seen))
            contexts, at = np.unique(seen >> np.uint32(8), return_inverse=True)
            total, kinds = np.bincount(at, times, len(contexts)), np.bincount(at, minlength=len(contexts))
            bits, escape = -np.log2(times / (total + kinds)[at]), -np.log2(kinds / (total + kinds))
            self.orders.append((seen.astype(np.uint32), bits.astype(np.float32), contexts.astype(np.uint32), escape.astype(np.float32)))

    @property
    def size(self) -> int:
        return sum(x.nbytes for held in self.orders for x in held)

    def bits(self, grams: np.ndarray) -> np.ndarray:
        """Code length of the last byte of each number, given the bytes before."""
        out = np.zeros(len(grams), np.float64)
        left = np.arange(len(grams))
        for order, (seen, bits, contexts, escape) in zip(range(ORDER, -1, -1), self.orders, strict=True):
            g = grams[left] & np.uint32(2 ** (8 * order + 8) - 1)
            at = np.minimum(np.searchsorted(seen, g), len(seen) - 1)
            hit = seen[at] == g
            out[left[hit]] += bits[at[hit]]
            left, g = left[~hit], g[~hit] >> np.uint32(8)
            at = np.minimum(np.searchsorted(contexts, g), len(contexts) - 1)
            out[left] += np.where(contexts[at] == g, escape[at], 0)
        out[left] += 8
        return out


#: The trees by language, in string order.
Model = dict[str, Tree]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        by_lang: dict[str, list[str]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), common.strings(batch, "text"), strict=True):
            by_lang.setdefault(lang, []).append(text)
        for lang, texts in by_lang.items():
            for a, b in common.chunks(texts):
                grams, starts, ends = encode(texts[a:b])
                inside = np.zeros(len(grams) + 1, np.int32)
                np.add.at(inside, starts, 1)
                np.add.at(inside, ends, -1)
                codes, n = np.unique(grams[np.cumsum(inside)[:-1] > 0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "code", "n"])


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = DOCS_PER_LANGUAGE) -> Model:
    """Learns from about ``per_language`` rows of each non-null language (all, if fewer): those whose hashed id is under a share.

    The rows chosen are read whole and counted on the executors; the driver gets the counts of their byte sequences.
    """
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text")).filter("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, min(1 << 30, (per_language << 30) // n)).otherwise(share)
    chosen = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share).select("lang", "text")
    counts = chosen.mapInArrow(common.settled(_count), "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toPandas()
    model = {str(lang): Tree(g["code"].to_numpy(np.uint32), g["n"].to_numpy(np.float64)) for lang, g in sorted(counts.groupby("lang"), key=lambda x: str(x[0]))}
    if sum(t.size for t in model.values()) > MODEL_BYTES:
        raise ValueError("the trees are too large to broadcast: learn from fewer rows of each language")
    return model


def score_texts(model: Model, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, posterior (equal priors) and bits a byte of each text."""
    n = len(texts)
    langs, score, per_byte = [UNDETERMINED] * n, np.zeros(n), np.zeros(n)
    names = list(model)
    for a, b in common.chunks(texts) if model else ():
        own = [i for i in range(a, b) if LETTER.search(texts[i])]
        if not own:
            continue
        grams, starts, ends = encode([texts[i] for i in own])
        distinct, place = np.unique(grams, return_inverse=True)
        between = np.stack([starts, ends], axis=1).ravel()
        total = np.stack([np.add.reduceat(np.append(tree.bits(distinct)[place], 0.0), between)[::2] for tree in model.values()], axis=1)
        best = total.argmin(axis=1)
        least = total[np.arange(len(own)), best]
        score[own] = 1 / np.exp2(np.maximum(least[:, None] - total, -1000)).sum(axis=1)
        per_byte[own] = least / (ends - starts)
        for i, k in zip(own, best.tolist(), strict=True):
            langs[i] = names[k]
    return langs, score, per_byte


def classify(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``df`` with ``lang_pred``, ``score`` and ``bits_per_byte``; columns of these names are replaced.

    Only the text goes to Python and only these three come back.
    """
    new = ["lang_pred", "score", "bits_per_byte"]
    kept = [c for c in df.columns if c not in new]
    held = df.sparkSession.sparkContext.broadcast(model)

    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            for batch in batches:
                texts = [x if x is not None else "" for x in batch.to_pylist()]
                langs, score, bits = score_texts(held.value, texts)
                yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(score), pa.array(bits)], new)
        finally:
            common.give_back()

    found.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    judge = F.arrow_udf(found, _FOUND).asNondeterministic()  # so that no filter makes it run twice
    rows = df.select(*(F.col(f"`{c}`") for c in kept), judge(F.col(f"`{text_col}`").cast("string")).alias("_found"))
    return rows.select(*(F.col(f"`{c}`") for c in kept), *(F.col("_found")[c].alias(c) for c in new))


def in_training(id_col: Column) -> Column:
    return common.crc_of_id(id_col) % 4 != 2


def op7_language_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    model = train(docs.filter(in_training(F.col("doc_id"))))
    out = classify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (~in_training(F.col("doc_id"))).alias("held_out"), "lang_pred", "score", "bits_per_byte")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language can be told: not ``und``, and likelier than not."""
    model = train(docs.filter(in_training(F.col("doc_id"))))
    return classify(docs, model).filter((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= 0.5)).select("doc_id", "text", "lang", "source", "n_chars")

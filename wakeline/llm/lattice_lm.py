"""Document likelihood over a subword lattice.

The pieces and scores are those of a published vocabulary, used as given: its scores are ranks, and a rank r weighs
1 / (r + 10). A text is its words, lower case, each opened by the word mark, then one end. Every way to spell a word in
pieces counts: a forward recursion in log space, walking a trie of the pieces, sums the probabilities of all
segmentations. Characters without a piece are spelled by their UTF-8 bytes. Pieces that lower-casing changes cannot
occur; the rest share their mass. With ``whole_words``, each word of the training rows is one more arc of the lattice, across the whole word:
its count less a discount, as a share of all words. The discounts add up to the share of words that are spelled in
pieces, so that the probabilities of all words have the sum of those of their spellings. From the training rows also comes the
share of ends among tokens, which is the probability that a text ends. Since no piece crosses a word, the marginal log
probability of a text is the sum over its words, the probabilities that it goes on before each, and that of its end.

Counts cover the whole corpus: tasks count words into tables that a shuffle adds up, and each distinct word is scored once.
Words with a share of at least 1 / ``COMMON`` of all tokens, so at most ``COMMON`` of them, are broadcast. For the others,
texts are dealt by hash into chunks of bounded size; each chunk meets the table only in the rare words it has, so that no
task holds the vocabulary of the corpus and a word costs a chunk one row. The number of chunks follows the corpus.

Defined results: null and empty texts have one token, the end; repeated rows get the same scores each; without training
rows every base probability is 1 and the end has probability 1/2; a null id counts as held out.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructType

from wakeline.llm import common

END = ""
MARK = "▁"
CHUNK_BYTES = 8 << 20
#: Words that a task counts before it passes them on.
HELD_WORDS = 400_000
#: Words of at least this share of all tokens (one part in so many) are broadcast.
COMMON = 400_000
LN10, LOG2 = math.log(10), math.log10(2)


def tokens(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().split()


class Pieces:
    """Log probabilities of pieces and of bytes: a trie of characters, a piece's under the key ``None`` of its node."""

    def __init__(self, names: list[str], log_p: np.ndarray) -> None:
        table = dict(zip(names, log_p.tolist(), strict=True))
        self.bytes = [table.pop(f"<0x{b:02X}>", -math.inf) for b in range(256)]
        self.table = table
        self.trie: dict = {}
        for name, p in table.items():
            node = self.trie
            for c in name:
                node = node.setdefault(c, {})
            node[None] = p

    def log_word(self, word: str) -> float:
        """Log of the summed probability of all segmentations: ``total[j]`` is that of the first j characters."""
        word = MARK + word
        n, trie, exp, log1p = len(word), self.trie, math.exp, math.log1p
        total = [-math.inf] * (n + 1) if n < 10_000 else array("d", [-math.inf]) * (n + 1)
        total[0] = 0.0
        for i in range(n):
            held = total[i]
            node = trie.get(word[i])
            if node is None or None not in node:
                total[i + 1] = _add(total[i + 1], held + sum(self.bytes[b] for b in word[i].encode("utf-8", "replace")))
            j = i + 1
            while node is not None:
                p = node.get(None)
                if p is not None:
                    p += held
                    old = total[j]
                    total[j] = p if old == -math.inf else p + log1p(exp(old - p)) if p > old else old + log1p(exp(p - old))
                if j == n:
                    break
                node = node.get(word[j])
                j += 1
        return total[n]


def _add(a: float, b: float) -> float:
    """Log of the sum of two numbers given by their logs."""
    low, high = (a, b) if a < b else (b, a)
    return high if low == -math.inf else high + math.log1p(math.exp(low - high))


class Arcs:
    """Whole words as arcs beside their spellings: absolute discounting by the words seen once and twice."""

    def __init__(self, words: int, kinds: int, once: int, twice: int) -> None:
        """``words`` of ``kinds``, so many of them seen once and twice; none: all words are spelled."""
        self.words, self.discount = words, (once + 0.5) / (once + 2 * twice + 1)
        self.spelled = self.discount * kinds / words if words else 1.0

    def log10(self, c: np.ndarray, log_p: np.ndarray) -> np.ndarray:
        """Log10 probabilities of words seen ``c`` times whose spellings have ``log_p``."""
        spelled = log_p + math.log10(self.spelled)
        if not self.words:
            return spelled
        whole = np.log2(np.where(c > 0, c - self.discount, 1.0) / self.words)
        return np.where(c > 0, np.logaddexp2(spelled / LOG2, whole) * LOG2, spelled)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(1)
def published(path: str) -> Pieces:
    """The pieces of a published vocabulary, weighted by its scores."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    names = [model.id_to_piece(i) for i in range(n)]
    score = np.array([model.get_score(i) for i in range(n)])
    # A piece that its own lower-casing changes never matches.
    kept = [i for i in range(n) if not (model.is_unknown(i) or model.is_control(i)) and (model.is_byte(i) or names[i] == names[i].encode().lower().decode())]
    order = sorted(kept, key=lambda i: (model.is_byte(i), -score[i], i))
    weight = 1 / (np.arange(len(order)) + 10.0)
    return Pieces([names[i] for i in order], np.log(weight / weight.sum()))


def count_words(docs: DataFrame, training: Column) -> DataFrame:
    """word, c (times in training rows), of all rows; the end is the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[Counter, Counter] = (Counter(), Counter())

        def out() -> pa.RecordBatch:
            words = list(held[0].keys() | held[1].keys())
            batch = pa.RecordBatch.from_arrays([pa.array([w.decode() for w in words], pa.string()), pa.array([held[1][w] for w in words], pa.int64())], ["word", "c"])
            for h in held:
                h.clear()
            return batch

        for batch in batches:
            for text, trained in zip(common.strings(batch, "text"), batch.column("training").to_pylist(), strict=True):
                own = held[bool(trained)]
                own.update(tokens(text))
                own[b""] += 1
                if len(held[0]) + len(held[1]) > HELD_WORDS:
                    yield out()
        yield out()

    return docs.select("text", training.alias("training")).mapInArrow(common.settled(run), "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def score(df: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, chunk_bytes: int = CHUNK_BYTES, most_common: int = COMMON, written: bool = False, whole_words: bool = False) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score (both log10) for each row.

    ``training`` is a condition on ``doc_id`` and ``text``. ``written`` says that ``df`` reads files, so that its rows come
    in the same order each time; any other table is written first. ``whole_words`` adds the training words' own arcs.
    """
    path = path or vocabulary_path()
    spark = df.sparkSession
    docs = common.keyed(df, id_col, text_col)
    counts = count_words(docs, training)

    def with_log(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = published(path)
        for batch in batches:
            log_p = [pieces.log_word(w) / LN10 if w else 0.0 for w in batch.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(log_p, pa.float64())], ["word", "c", "log_p"])

    words = common.cut(counts.mapInArrow(common.settled(with_log), "word string, c long, log_p double"), "words")
    ended, once, twice = F.sum(F.when(F.col("word") == END, F.col("c"))), F.count_if((F.col("c") == 1) & (F.col("word") != END)), F.count_if((F.col("c") == 2) & (F.col("word") != END))
    total, kinds, ends, once, twice = words.filter("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(ended, F.lit(0)), once, twice).first()
    rest = math.log10(total + 0.1 * (kinds + 1))
    ending = (ends + 0.5) / (total + 1)
    log_end, log_on = math.log10(ending), math.log10(1 - ending) if ending < 1 else 0.0
    arc = Arcs(total - ends, kinds - (ends > 0), once, twice) if whole_words else Arcs(0, 0, 0, 0)
    often = words.filter((F.col("word") != END) & (F.col("c") * most_common >= total) & (F.col("c") > 0))
    often = [(r["word"].encode(), r["c"], float(arc.log10(np.array([r["c"]]), np.array([r["log_p"]]))[0])) for r in often.collect()]
    end = (math.log10(ends + 0.1) - rest, log_end, ends)
    known = spark.sparkContext.broadcast({w: (math.log10(c + 0.1) - rest, p + log_on, c) for w, c, p in often} | {b"": end})
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = int(max(48, size // chunk_bytes))
    # The row's place spreads repeated rows over the chunks; a text's scores do not depend on its chunk.
    placed = docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text", F.monotonically_increasing_id()), F.lit(groups)))
    dealt = (placed if written else common.cut(placed, "dealt")).repartition(groups, "chunk")

    def rare(table: pa.Table) -> pa.Table:
        often = known.value
        found = set().union(*(tokens(t) for t in table.column("text").to_pylist())).difference(often)
        return pa.table({"chunk": pa.array([table.column("chunk")[0].as_py()] * len(found), pa.int64()), "word": pa.array([w.decode() for w in found], pa.string())})

    needed = dealt.groupBy("chunk").applyInArrow(rare, "chunk long, word string").join(words, "word")
    names = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def scored(texts: pa.Table, own: pa.Table) -> pa.Table:
        often = known.value
        place = dict(zip(often, range(len(often)), strict=True))
        place.update(zip((w.encode() for w in own.column("word").to_pylist()), range(len(often), len(often) + len(own)), strict=True))
        c = own.column("c").to_numpy()
        base, log_p, times = np.array(list(often.values()), float).T
        base, log_p, times = np.concatenate([base, np.log10(c + 0.1) - rest]), np.concatenate([log_p, arc.log10(c, own.column("log_p").to_numpy()) + log_on]), np.concatenate([times, c])
        place, last, rows = place.__getitem__, place[b""], []
        for text in texts.column("text").to_pylist():
            found = tokens(text)
            at = np.fromiter(map(place, found), np.int64, len(found))
            rows.append((len(at) + 1, int((times[at] > 0).sum()) + int(times[last] > 0), total, float(base[at].sum() + base[last]), float(log_p[at].sum() + log_p[last])))
        columns = zip(*rows, strict=True) if rows else [[]] * 5
        return pa.table({"doc_id": texts.column("doc_id")} | {k: pa.array(list(x), pa.int64() if i < 3 else pa.float64()) for i, (k, x) in enumerate(zip(names, columns, strict=True))})

    schema = StructType([docs.schema["doc_id"]])
    for i, k in enumerate(names):
        schema = schema.add(k, LongType() if i < 3 else DoubleType())
    return dealt.groupBy("chunk").cogroup(needed.groupBy("chunk")).applyInArrow(scored, schema)


def in_training(id_col: Column) -> Column:
    return common.crc_of_id(id_col) % 10 != 0


def op2_lattice_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score(common.read(spark, sf_dir, "documents"), in_training(F.col("doc_id")), written=True, whole_words=True)
    return out.select("doc_id", (~in_training(F.col("doc_id"))).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


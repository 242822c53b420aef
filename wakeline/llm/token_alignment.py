"""Alignment of two tokenizers' tokens over the same bytes, with packed bitsets.

A side's bitset has a bit for each byte of a text, set where one of its tokens ends. The AND of two sides' bitsets has the
shared cuts: select lists them, and rank (the number of set bits before a place, from popcounts of words) turns each into
the tokens of either side that lie before it, so that neighbouring cuts bound a group of tokens. In the OR of the bitsets
every set bit ends a stretch that no token ends inside; the ranks of a stretch name the one token of each side over it,
and those pairs are the links, all overlapping pairs and each of them once. Texts are taken together up to a bound, one
bitset for all of them, since both sides end where a text does.

Counts of linked pairs need the whole corpus. The first pass over the texts writes each row's distinct pairs with their
times, so that nothing is tokenised twice; a shuffle counts the rows of each pair. Pairs are numbers under the product of
the vocabularies, yet that product is large: the ``MOST_PAIRS`` pairs of the most rows are broadcast, with the best count
of each token of side A (one number a token), and the occurrences of any other pair meet their counts in a shuffle join.

Defined results: null and empty texts, and texts that a side's tokens do not spell out, have no tokens; a repeated row
counts each time; an empty table gives no rows; other columns than the two named are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType

from wakeline.llm import common, packing

#: Pairs that are broadcast at most (20 bytes each).
MOST_PAIRS = 2_000_000
#: Words whose pieces a task keeps.
CACHE = 200_000
MARK = "▁"
BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")
#: Where no piece goes on: before the spaces that open a word.
SEGMENT = re.compile(" *[^ ]+| +")
NAMES = ("n_a", "n_b", "n_groups", "n_links")


class Bits:
    """A packed bitset with rank and select."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @classmethod
    def at(cls, places: np.ndarray, size: int) -> Bits:
        bits = np.zeros(-(-size // 64) * 64, np.uint8)
        bits[places] = 1
        return cls(np.packbits(bits, bitorder="little").view("<u8"))

    def __and__(self, other: Bits) -> Bits:
        return Bits(self.words & other.words)

    def __or__(self, other: Bits) -> Bits:
        return Bits(self.words | other.words)

    def rank(self, places: np.ndarray) -> np.ndarray:
        """How many bits are set before each place."""
        word, bit = places >> 6, (places & 63).astype(np.uint64)
        words = np.append(self.words, np.uint64(0))[word]
        return self.before[word] + np.bitwise_count(words & ((np.uint64(1) << bit) - np.uint64(1)))

    def select(self) -> np.ndarray:
        """The places of all set bits."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))


class PlainWords(packing.WordIds):
    """Ids of words in which the strings of special tokens are plain text."""

    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.tokenizer.encode_special_tokens = True
        self.special = []


class Pieces(dict):
    """Piece ids of segments, as little-endian 32-bit numbers; a segment begins with a space."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.space = np.array([self.model.piece_to_id(MARK)], "<u4").tobytes()

    def __missing__(self, segment: str) -> bytes:
        # The model puts a space before what it encodes, but nothing before nothing.
        ids = np.array(self.model.encode(segment[1:]), "<u4").tobytes() if len(segment) > 1 else self.space
        if len(segment) <= 48:
            if len(self) >= CACHE:
                self.clear()
            self[segment] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """``text`` begins with a space."""
        return b"".join(map(self.__getitem__, SEGMENT.findall(text)))


class Side:
    """The bytes of each token of a vocabulary, and the ids as decimals with what can follow them."""

    def __init__(self, tokens: list[bytes], inner: str, last: str) -> None:
        self.tokens = pa.array(tokens, pa.binary())
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.decimals = [f"{i}{inner}" for i in range(len(tokens))] + [f"{i}{last}" for i in range(len(tokens))]

    def spelled(self, ids: np.ndarray) -> memoryview:
        """The joined bytes of tokens."""
        found = self.tokens.take(pa.array(ids, pa.int64()))
        return memoryview(found.buffers()[2] or b"").cast("B")[: int(self.length[ids].sum())]


class Aligner:
    """Both tokenizers, and the alignment of many texts at once."""

    def __init__(self, path_a: str, path_b: str) -> None:
        self.encode_a, self.encode_b = PlainWords(path_a), Pieces(path_b)
        byte_of = packing._letter_bytes()
        vocab = self.encode_a.tokenizer.get_vocab(with_added_tokens=True)
        # What is no byte-level entry (an added token) has no bytes; it never occurs, as its string is plain text.
        a = {i: bytes(byte_of.get(c, 0) for c in t) if byte_of.keys() >= set(t) else b"" for t, i in vocab.items()}
        model = self.encode_b.model
        b = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            byte = BYTE_PIECE.fullmatch(piece) if model.is_byte(i) else None
            b.append(bytes([int(byte[1], 16)]) if byte else b"" if model.is_control(i) or model.is_unknown(i) else piece.replace(MARK, " ").encode())
        self.a, self.b = Side([a.get(i, b"") for i in range(max(a) + 1)], ",", "|"), Side(b, ",", ";")
        self.decimals = pa.array(self.a.decimals + self.b.decimals, pa.string())
        self.digits = np.array([len(x) for x in self.a.decimals + self.b.decimals], np.int64)

    def tokens(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """For texts that begin with a space: ids of both sides and the lengths in bytes, all empty where not spelled out."""
        ids_a = [np.frombuffer(x, "<u4").astype(np.int64) for x in self.encode_a.encode_all(texts)]
        ids_b = [np.frombuffer(self.encode_b.encode(x), "<u4").astype(np.int64) for x in texts]
        data = [x.encode() for x in texts]
        whole = b"".join(data)
        if any(side.spelled(np.concatenate(ids)) != whole for side, ids in ((self.a, ids_a), (self.b, ids_b)) if ids):
            none = np.zeros(0, np.int64)
            for i, x in enumerate(data):
                if self.a.spelled(ids_a[i]) != x or self.b.spelled(ids_b[i]) != x:
                    ids_a[i], ids_b[i], data[i] = none, none, b""
        return ids_a, ids_b, np.array([len(x) for x in data], np.int64)

    def align(self, texts: list[str]) -> tuple[list[np.ndarray], list[str], np.ndarray, np.ndarray, np.ndarray]:
        """For nonempty texts, each after a space: the four counts, the digest of the groups, then the distinct pairs of
        each text and their times, with the number of pairs of each text."""
        ids_a, ids_b, size = self.tokens([" " + t for t in texts])
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        per_a, per_b = (np.array([len(x) for x in ids], np.int64) for ids in (ids_a, ids_b))
        a, b = (np.concatenate([*ids, np.zeros(0, np.int64)]) for ids in (ids_a, ids_b))
        end_a, end_b = np.cumsum(self.a.length[a]), np.cumsum(self.b.length[b])
        bits_a, bits_b = Bits.at(end_a - 1, total), Bits.at(end_b - 1, total)
        shared, any_end = bits_a & bits_b, bits_a | bits_b
        n_groups, n_links = (np.diff(bits.rank(ends), prepend=0) for bits in (shared, any_end))

        cuts = shared.select()
        before_a, before_b = (np.concatenate([[0], bits.rank(cuts + 1)]) for bits in (bits_a, bits_b))
        group_a, group_b = shared.rank(end_a - 1), shared.rank(end_b - 1)
        # Where a token stands when each group's tokens of A precede those of B, and whether it is its group's last.
        order = np.empty(len(a) + len(b), np.int64)
        last_a, last_b = (np.arange(len(ids)) + 1 == before[group + 1] for ids, before, group in ((a, before_a, group_a), (b, before_b, group_b)))
        order[np.arange(len(a)) + before_b[group_a]] = a + last_a * len(self.a.length)
        order[np.arange(len(b)) + before_a[group_b + 1]] = b + last_b * len(self.b.length) + len(self.a.decimals)
        joined = memoryview(self.decimals.take(pa.array(order)).buffers()[2] or b"").cast("B")
        upto = np.concatenate([[0], np.cumsum(self.digits[order])])[np.concatenate([[0], np.cumsum(per_a + per_b)])]
        digests = [hashlib.sha256(joined[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]

        stretches = any_end.select()
        pairs = a[bits_a.rank(stretches)] * len(self.b.length) + b[bits_b.rank(stretches)]
        row = np.repeat(np.arange(len(texts)), n_links)
        scale = len(self.a.length) * len(self.b.length)
        distinct, times = np.unique(row * scale + pairs, return_counts=True)
        n_pairs = np.bincount(distinct // scale, minlength=len(texts))
        return [per_a, per_b, n_groups, n_links], digests, distinct % scale, times, n_pairs


@lru_cache(1)
def aligner(path_a: str, path_b: str) -> Aligner:
    """Kept from task to task by a Python worker."""
    return Aligner(path_a, path_b)


def paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def groups(df: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row (a number of its own for each row), the four counts, groups_sha256, pairs and times: distinct linked
    pairs as id of A times the size of B plus id of B, and how many links each has. Write it before it is used: ``row``
    numbers the rows of a task."""
    docs = common.keyed(df, id_col, text_col)
    ints = ArrayType(IntegerType())
    schema = StructType([docs.schema["doc_id"]]).add("row", LongType())
    for c in NAMES:
        schema = schema.add(c, LongType())
    schema = schema.add("groups_sha256", StringType()).add("pairs", ints).add("times", ints)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, row = aligner(path_a, path_b), TaskContext.get().partitionId() << 33
        for batch in batches:
            texts, ids = batch.column("text").to_pylist(), batch.column("doc_id")
            for x, y in common.chunks(texts):
                filled = np.array([i for i in range(x, y) if texts[i]], np.int64)
                counts, digests, pairs, times, n_pairs = tool.align([texts[i] for i in filled])
                wide = [np.zeros(y - x, np.int64) for _ in range(5)]
                for column, found in zip(wide, (*counts, n_pairs), strict=True):
                    column[filled - x] = found
                sha = [""] * (y - x)
                for i, digest in zip(filled - x, digests, strict=True):
                    sha[i] = digest
                ends = pa.array(np.concatenate([[0], np.cumsum(wide[4])]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(v.astype(np.int32))) for v in (pairs, times)]
                numbers = [pa.array(c) for c in (np.arange(row, row + y - x), *wide[:4])]
                yield pa.RecordBatch.from_arrays([ids.slice(x, y - x), *numbers, pa.array(sha, pa.string()), *lists], schema.names)
                row += y - x

    return docs.mapInArrow(common.settled(run), schema)


def counted(aligned: DataFrame, n_b: int, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """The written rows of ``groups`` with n_best and count_sum in place of pairs and times."""
    spark = aligned.sparkSession
    counts = common.cut(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "pairs")
    top = counts.groupBy(F.expr(f"pair div {n_b}").cast("int").alias("a")).agg(F.max("n").alias("n")).toArrow()
    size = counts.count()
    often = counts if size <= most_pairs else counts.orderBy(F.col("n").desc(), "pair").limit(most_pairs)
    held = often.toArrow().sort_by("pair")
    best = np.zeros(1 + max([0, *top.column("a").to_pylist()]), np.int64)
    best[top.column("a").to_numpy()] = top.column("n").to_numpy()
    shared = spark.sparkContext.broadcast((held.column("pair").to_numpy(), held.column("n").to_numpy(), best))
    rest = size > most_pairs
    kept = [f for f in aligned.schema if f.name not in ("pairs", "times")]
    ints = ArrayType(IntegerType())
    schema = StructType([*kept]).add("n_best", LongType()).add("count_sum", LongType())
    if rest:
        schema = schema.add("pairs", ints).add("times", ints)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = shared.value
        for batch in batches:
            lists = batch.column("pairs")
            asked = lists.flatten().to_numpy()
            times = batch.column("times").flatten().to_numpy().astype(np.int64)
            length = lists.value_lengths().to_numpy()
            at = np.minimum(np.searchsorted(pair, asked), max(0, len(pair) - 1))
            known = pair[at] == asked if len(pair) else np.zeros(len(asked), bool)
            count = np.where(known, n[at], 0) if len(pair) else np.zeros(len(asked), np.int64)
            ends = np.cumsum(length)
            upto = lambda v: np.diff(np.concatenate([[0], np.cumsum(v)])[np.concatenate([[0], ends])])  # noqa: E731, B023
            sums = [upto(np.where(known & (count == best[asked // n_b]), times, 0)), upto(count * times)]
            columns = [batch.column(f.name) for f in kept] + [pa.array(s.astype(np.int64)) for s in sums]
            if rest:
                offsets = pa.array(np.concatenate([[0], np.cumsum(upto(~known))]).astype(np.int32))
                columns += [pa.ListArray.from_arrays(offsets, pa.array(v[~known].astype(np.int32))) for v in (asked, times)]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    out = aligned.mapInArrow(common.settled(run), schema)
    if not rest:
        return out
    out = common.cut(out, "counted")
    asked = out.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    tops = F.broadcast(spark.createDataFrame(top))  # a row for each token of A
    told = common.spread_join(asked, counts, ["pair"], "n").withColumn("a", F.expr(f"pair div {n_b}").cast("int"))
    told = told.join(tops.withColumnRenamed("n", "best"), "a")
    more = told.groupBy("row").agg(F.sum(F.when(F.col("n") == F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("n") * F.col("times")).alias("more"))
    joined = out.drop("pairs", "times").join(more, "row", "left")
    add = lambda c, d: (F.col(c) + F.coalesce(F.col(d), F.lit(0))).cast("long").alias(c)
    return joined.select(*(f.name for f in kept), add("n_best", "more_best"), add("count_sum", "more"))


def align(df: DataFrame, path_a: str | None = None, path_b: str | None = None, id_col: str = "doc_id", text_col: str = "text", most_pairs: int = MOST_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for each row."""
    import sentencepiece

    standard = paths() if not (path_a and path_b) else ("", "")
    path_a, path_b = path_a or standard[0], path_b or standard[1]
    n_b = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    out = counted(common.cut(groups(df, path_a, path_b, id_col, text_col), "aligned"), n_b, most_pairs)
    return out.select("doc_id", *NAMES, "n_best", "count_sum", "groups_sha256")


def op13_packed_bitsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(common.read(spark, sf_dir, "documents"))

"""Collocations by level-wise passes over a corpus, one table of frequent phrases for each length.

The pass for length k gets the frequent phrases of length k - 1 as a broadcast and passes on a phrase only where both
phrases of k - 1 words that overlap in it are frequent. The broadcast is a bit table of their hashes of at most
``FILTER_BITS`` bits, however many phrases there are: a phrase that is no member can pass, a member never fails, and
counts are exact, so that the results do not depend on the size of the bit table. Tasks number the words they meet, count
phrases as packed numbers in tables of bounded size and hand those on as strings; a shuffle adds them up. Scores come
from the level tables alone: every cut of a candidate looks up its two parts in one join.

Defined results: a null or empty text has no words; a null language is ``und``; a repeated row counts each time; an empty
table gives no rows; other columns than the two named are not read. Equal scores of cuts go to the earliest cut, equal
ranks cannot occur, since a language has each phrase once.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wakeline.llm import common

#: Occurrences that make a phrase a candidate, words of the longest phrase (three at most), rows returned a language.
LEAST, LONGEST, TOP = 10, 3, 2000
#: A candidate goes if a longer one has at least this percentage of its occurrences.
COVERED = 50
#: Bits of the table of frequent phrases at most: 16 MB.
FILTER_BITS = 1 << 27
#: Words that a task numbers, and phrases that it counts, before it passes them on.
HELD_WORDS, HELD_PHRASES = 300_000, 1_000_000
#: Bytes of text that are split into words together.
SLICE = 1 << 19
#: Bits of a word's number inside a packed phrase.
WORD_BITS = 21
#: What ends a piece, as bytes; each becomes the mark, which is no word.
BREAK = b"."
TO_BREAKS = bytes(BREAK[0] if b in b".,;:!?\n\x0b\x0c\r" else b for b in range(256))
SEED = 42  # that of Spark's xxhash64


def _rotate(h: np.ndarray) -> np.ndarray:
    return (h << np.uint64(7)) | (h >> np.uint64(57))


def phrase_hash(lang: Column, phrase: Column) -> Column:
    """The hash of a phrase from those of its words; ``Members.holds`` has the same in numpy."""

    def step(held: Column, word: Column) -> Column:
        turned = F.shiftleft(held, 7).bitwiseOR(F.shiftrightunsigned(held, 57))
        return turned.bitwiseXOR(F.xxhash64(F.concat(lang, F.lit(" "), word)))

    return F.aggregate(F.split(phrase, " "), F.lit(0).cast("long"), step)


class Members:
    """A bit table of hashes: never false for a member."""

    def __init__(self, words: np.ndarray) -> None:
        self.words, self.mask = words, np.uint64(len(words) * 64 - 1)

    def holds(self, h: np.ndarray) -> np.ndarray:
        at = h & self.mask
        return (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def members(level: DataFrame, most_bits: int = FILTER_BITS) -> Members:
    """The bit table of a written level (lang, phrase); at most ``most_bits`` / 64 numbers reach the driver."""
    wanted = max(1 << 16, 1 << (16 * level.count()).bit_length())
    bits = min(wanted, most_bits)
    at = phrase_hash(F.col("lang"), F.col("phrase")).bitwiseAND(F.lit(bits - 1).cast("long"))
    ones = (
        level.select(at.alias("at"))
        .groupBy(F.shiftright("at", 6).alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("bits"))
        .toArrow()
    )
    words = np.zeros(bits // 64, np.int64)
    words[ones.column("word").to_numpy()] = ones.column("bits").to_numpy()
    return Members(words.view(np.uint64))


class Numbers(dict):
    """Numbers of words in the order they are met; the break has -1."""

    def __init__(self, prefix: bytes | None) -> None:
        super().__init__({BREAK: -1})
        self.prefix = prefix
        self.names: list[bytes] = []
        self.hashes = array("Q")

    def __missing__(self, word: bytes) -> int:
        at = self[word] = len(self.names)
        self.names.append(word)
        if self.prefix is not None:
            self.hashes.append(xxhash.xxh64_intdigest(self.prefix + word, SEED))
        return at


class Tally:
    """Counts of the phrases of ``k`` words of one language, in bounded memory."""

    def __init__(self, lang: str, k: int, known: Members | None) -> None:
        self.lang, self.k, self.known = lang, k, known
        self.carried: list[bytes] = []
        self.clear()

    def clear(self) -> None:
        self.numbers = Numbers(self.lang.encode() + b" " if self.known else None)
        self.names = self.numbers.names
        self.keys, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.fresh: list[tuple[np.ndarray, np.ndarray]] = []
        self.n_fresh = self.total = 0

    def add(self, words: list[bytes]) -> None:
        """Counts words that follow those of the call before."""
        k, words = self.k, self.carried + words
        self.carried = words[len(words) - k + 1 :] if k > 1 else []
        ids = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        n = len(ids) - k + 1
        if n <= 0 or not self.names:
            return
        fits = ids >= 0
        if k == 1:
            self.total += int(fits.sum())
            keys = ids[fits]
        else:
            inside = np.logical_and.reduce([fits[j : j + n] for j in range(k)])
            hashes, h = np.array(self.numbers.hashes), np.zeros(n + 1, np.uint64)
            for j in range(k - 1):
                h = _rotate(h) ^ hashes[ids[j : j + n + 1]]
            frequent = self.known.holds(h)
            at = np.flatnonzero(inside & frequent[:-1] & frequent[1:])
            keys = ids[at]
            for j in range(1, k):
                keys = keys << WORD_BITS | ids[at + j]
        found, times = np.unique(keys, return_counts=True)
        self.fresh.append((found, times))
        self.n_fresh += len(found)
        if self.n_fresh > HELD_PHRASES:
            self.merge()

    def merge(self) -> None:
        keys = np.concatenate([self.keys, *(k for k, _ in self.fresh)])
        times = np.concatenate([self.times, *(t for _, t in self.fresh)])
        order = np.argsort(keys, kind="stable")
        keys, times = keys[order], times[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        self.keys, self.times = keys[first], np.add.reduceat(times, first) if len(first) else times
        self.fresh, self.n_fresh = [], 0

    def full(self) -> bool:
        return len(self.names) > HELD_WORDS or len(self.keys) > HELD_PHRASES

    def out(self) -> Iterator[pa.RecordBatch]:
        """lang, phrase, f of what is held; the empty phrase has the number of words. Nothing is held then."""
        self.merge()
        names = pa.array(self.names, pa.string())
        mask = (1 << WORD_BITS) - 1
        for at in range(0, len(self.keys), 100_000):
            keys, times = self.keys[at : at + 100_000], self.times[at : at + 100_000]
            words = [names.take(pa.array(keys >> WORD_BITS * j & mask)) for j in reversed(range(self.k))]
            phrase = pc.binary_join_element_wise(*words, " ") if self.k > 1 else words[0]
            lang = pa.array([self.lang] * len(keys), pa.string())
            yield pa.RecordBatch.from_arrays([lang, phrase, pa.array(times)], ["lang", "phrase", "f"])
        if self.total:
            columns = [pa.array([self.lang]), pa.array([""]), pa.array([self.total], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "f"])
        self.clear()


def word_lists(texts: list[str]) -> Iterator[list[bytes]]:
    """The words of texts, a break after each piece, in lists of bounded size."""
    for text in texts:
        data = text.encode().lower().translate(TO_BREAKS)
        at = 0
        while at < len(data):
            end = at + SLICE
            if end < len(data):
                cuts = [x for x in (data.find(c, end) for c in (b" ", b"\t", BREAK)) if x >= 0]
                end = min(cuts, default=len(data))
            yield data[at:end].replace(BREAK, b" . ").split()
            at = end
        yield [BREAK]


def gathered(lists: Iterator[list[bytes]], least: int = 1 << 16) -> Iterator[list[bytes]]:
    """Short lists put together."""
    held: list[bytes] = []
    for words in lists:
        held += words
        if len(held) >= least:
            yield held
            held = []
    if held:
        yield held


def count_phrases(docs: DataFrame, k: int, known: Members | None) -> DataFrame:
    """lang, phrase, f of phrases of ``k`` words whose overlapping parts ``known`` holds (for words: all of them, and the
    number of all words as the empty phrase)."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies: dict[str, Tally] = {}
        for batch in batches:
            by_lang: dict[str, list[str]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                by_lang.setdefault(lang, []).append(text)
            for lang, texts in by_lang.items():
                tally = tallies.get(lang) or tallies.setdefault(lang, Tally(lang, k, shared.value))
                for words in gathered(word_lists(texts)):
                    tally.add(words)
                    if tally.full():
                        yield from tally.out()
            if sum(len(t.names) + len(t.keys) + t.n_fresh for t in tallies.values()) > 2 * (HELD_WORDS + HELD_PHRASES):
                for tally in tallies.values():
                    yield from tally.out()
                tallies.clear()  # every text has ended with a break
        for tally in tallies.values():
            yield from tally.out()

    counted = docs.mapInArrow(common.settled(run), "lang string, phrase string, f long")
    return counted.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def levels(df: DataFrame, least: int = LEAST, longest: int = LONGEST, lang_col: str = "lang", text_col: str = "text", filter_bits: int = FILTER_BITS) -> list[DataFrame]:
    """Written tables (lang, phrase, f) of the frequent phrases of 1 to ``longest`` words; the first also holds, as the
    empty phrase, how many words a language has."""
    if not 1 <= longest <= 63 // WORD_BITS:
        raise ValueError("phrases have one to three words")
    lang = F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und"))
    docs = df.select(lang.alias("lang"), common.text_of(text_col).alias("text"))
    kept = (F.col("f") >= least) | (F.col("phrase") == "")
    out = [common.cut(count_phrases(docs, 1, None).filter(kept), "level1")]
    for k in range(2, longest + 1):
        known = members(out[-1].filter("phrase <> ''"), filter_bits)
        out.append(common.cut(count_phrases(docs, k, known).filter(kept), f"level{k}"))
    return out


def _joined(words: Column, start: Column | int, length: Column | int) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def candidates(tables: list[DataFrame], covered: int = COVERED) -> DataFrame:
    """lang, phrase, a, l, r, score of the phrases of two words and more that no longer one covers."""
    found = tables[1]
    for t in tables[2:]:
        found = found.unionByName(t)
    parts = tables[0].filter("phrase <> ''")
    for t in tables[1:-1]:
        parts = parts.unionByName(t)
    words, size = F.split("phrase", " "), F.size(F.split("phrase", " "))
    sides = F.flatten(
        F.transform(
            F.sequence(F.lit(1), size - 1),
            lambda k: F.array(
                F.struct(k.alias("k"), F.lit(True).alias("first"), _joined(words, 1, k).alias("part")),
                F.struct(k.alias("k"), F.lit(False).alias("first"), _joined(words, k + 1, size - k).alias("part")),
            ),
        )
    )
    asked = found.select("lang", "phrase", F.col("f").alias("a"), F.explode(sides).alias("s")).select("lang", "phrase", "a", "s.*")
    # A part has at least as many occurrences as phrases that ask for it.
    told = common.spread_join(asked, parts.select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"], "f")
    cuts = range(1, len(tables))
    side = lambda k, first: F.max(F.when((F.col("k") == k) & (F.col("first") == first), F.col("f")))
    wide = told.groupBy("lang", "phrase").agg(
        F.max("a").alias("a"), *(side(k, True).alias(f"l{k}") for k in cuts), *(side(k, False).alias(f"r{k}") for k in cuts)
    )
    exact = lambda c: f"cast({c} as decimal(38, 0))"
    scored = [
        F.when(
            F.col(f"l{k}").isNotNull(),
            F.struct(
                F.expr(f"(1000000 * {exact('a')} * {exact('a')}) div ({exact(f'l{k}')} * {exact(f'r{k}')})").alias("score"),
                F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"),
            ),
        )
        for k in cuts
    ]
    best = F.least(*scored) if len(scored) > 1 else scored[0]
    out = wide.select("lang", "phrase", "a", best.alias("cut")).select("lang", "phrase", "a", "cut.score", "cut.l", "cut.r")
    if len(tables) < 3:
        return out
    inner = F.flatten(
        F.transform(F.sequence(F.lit(2), size - 1), lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda at: _joined(words, at, n)))
    )
    longer = tables[2]
    for t in tables[3:]:
        longer = longer.unionByName(t)
    over = longer.select("lang", "f", F.explode(inner).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = F.col("longer").isNull() | (100 * F.col("longer").cast("decimal(20, 0)") < covered * F.col("a").cast("decimal(20, 0)"))
    return out.join(over, ["lang", "phrase"], "left").filter(kept).drop("longer")


def mine(df: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, covered: int = COVERED, lang_col: str = "lang", text_col: str = "text", filter_bits: int = FILTER_BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` collocations of each language."""
    tables = levels(df, least, longest, lang_col, text_col, filter_bits)
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = candidates(tables, covered).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    n = tables[0].filter("phrase = ''").select("lang", F.col("f").alias("n"))
    return ranked.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_level_wise_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(common.read(spark, sf_dir, "documents"))


#: The same by grouping all phrases; arithmetic in 128 bits.
SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
worded AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS ws FROM pieces),
counted AS (
  SELECT lang, k, phrase, count(*) AS f FROM (
    SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase
    FROM worded, (VALUES (1), (2), (3)) AS lengths(k))
  GROUP BY ALL),
sizes AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counted WHERE k = 1 GROUP BY lang),
found AS (SELECT lang, k AS size, phrase, f AS a, string_split(phrase, ' ') AS ws FROM counted WHERE k > 1 AND f >= 10),
cut AS (
  SELECT lang, size, phrase, a, c, array_to_string(ws[1:c], ' ') AS first_part, array_to_string(ws[c + 1:size], ' ') AS rest
  FROM found, (VALUES (1), (2)) AS cuts(c) WHERE c < size),
scored AS (
  SELECT cut.*, x.f AS l, y.f AS r,
    (CAST(1000000 AS HUGEINT) * a * a) // (CAST(x.f AS HUGEINT) * y.f) AS score
  FROM cut JOIN counted x ON x.lang = cut.lang AND x.phrase = first_part AND x.k = c
    JOIN counted y ON y.lang = cut.lang AND y.phrase = rest AND y.k = size - c),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
inner_pairs AS (
  SELECT lang, max(a) AS longer, phrase FROM (
    SELECT lang, a, unnest([ws[1] || ' ' || ws[2], ws[2] || ' ' || ws[3]]) AS phrase FROM found WHERE size = 3)
  GROUP BY lang, phrase),
kept AS (
  SELECT best.* FROM best LEFT JOIN inner_pairs i ON i.lang = best.lang AND i.phrase = best.phrase
  WHERE i.longer IS NULL OR 100 * i.longer < 50 * best.a)
SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
  CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, CAST(score AS BIGINT) AS score
FROM kept JOIN sizes ON sizes.lang = kept.lang
QUALIFY rank <= 2000
"""

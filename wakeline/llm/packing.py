"""Best-fit packing of token sequences by bin completion.

Tokenising and cutting are one pass over the texts that leaves a small row for each piece. A piece's length is at most
the capacity, so the packing problem is a histogram of ``capacity`` counts however many pieces there are. The driver
solves the histogram: bin completion takes the largest length left, enumerates the undominated ways to fill the rest of
its sequence, and branches over them depth first; a branch ends when its waste exceeds what an improvement on the
incumbent (best-fit decreasing at first) allows. The search ends at the lower bound, which best fit itself reaches on
large corpora, and gives up after ``NODES`` branches with ``FILLINGS`` fillings each; the best packing found until then is
used, and ``lower_bound`` tells how far from the least it can be. No piece is ever left out. Equal sequences are taken together, so a plan has at most a few
patterns for each length. Executors then rank the pieces of each length and look their sequence up in the plan.

Defined results: a null or empty text is one piece of the end id alone; repeated rows each get their own piece; an
empty table gives no rows. Only documents longer than the capacity are cut, all pieces but the first to full capacity.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from wakeline.llm import common

CAPACITY = 2048
END_ID = 0
#: Branches that the search opens at most; the best packing found until then is the result.
NODES = 4000
#: Fillings tried at each branch.
FILLINGS = 4
#: Words whose ids a task keeps.
CACHE = 200_000
#: The byte-level split before merging, in the terms of Python's own ``re``. Other numbers than decimal digits and four
#: control characters count differently there; texts with one of those (``ODD``) go through the tokenizer itself.
WORDS = re.compile(r" ?[^\W\d_]+|'s|'t|'re|'ve|'m|'ll|'d| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
ODD = frozenset(c for c in map(chr, range(sys.maxunicode + 1)) if c in "\x1c\x1d\x1e\x1f" or unicodedata.category(c) in ("No", "Nl"))
#: A space between white space (or after it, at the end) is part of a longer split; elsewhere a split starts at each space.
INNER_SPACE = re.compile(r"\s \s|\s \Z")


def _letter_bytes() -> dict[str, int]:
    """Bytes by their printable stand-ins in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordIds(dict):
    """Ids of a word as little-endian 32-bit numbers, merged when first asked for and then kept."""

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        file = json.loads(Path(path).read_text())
        special = {x["content"]: x["id"] for x in file["added_tokens"]}
        byte_of = _letter_bytes()
        ranks = {bytes(byte_of[c] for c in token): i for token, i in file["model"]["vocab"].items() if token not in special}
        self.tokenizer = Tokenizer.from_file(path)
        # The file numbers its tokens in the order of their merges, so that ids are ranks.
        self.merge = tiktoken.Encoding("words", pat_str="(?s:.+)", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.special = list(special)

    def __missing__(self, word: str) -> bytes:
        """``word``: what follows a space up to the next one."""
        ids = self.split(" " + word)
        if len(word) <= 48:
            if len(self) >= CACHE:
                self.clear()
            self[word] = ids
        return ids

    def split(self, text: str) -> bytes:
        return b"".join(array("I", self.merge(x)).tobytes() for x in WORDS.findall(text))

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        for a, b in common.chunks(texts):
            letters = set().union(*texts[a:b])
            odd = letters & ODD
            for text in texts[a:b]:
                if odd and not odd.isdisjoint(text) or any(x in text for x in self.special):
                    yield array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
                elif INNER_SPACE.search(text):
                    yield self.split(text)
                else:
                    first, *rest = text.split(" ")
                    yield self.split(first) + b"".join(map(self.__getitem__, rest))


def word_ids(path: str) -> WordIds:
    """Kept from task to task by a Python worker."""
    return common.kept(("words", path), lambda: WordIds(path))


def pieces(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32 and, if asked for, the ids themselves."""
    rows = common.keyed(df, id_col, text_col)
    schema = StructType([rows.schema["doc_id"], *(StructField(c, LongType()) for c in ("start", "length", "ids_crc32"))]).add("piece", IntegerType())
    if keep_ids:
        schema = schema.add("ids", ArrayType(IntegerType()))
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer_path)
        for batch in batches:
            row, start, length, crc, piece, ids = [], [], [], [], [], []
            for i, data in enumerate(words.encode_all(batch.column("text").to_pylist())):
                data += end
                total = len(data) // 4
                at = 0
                while at < total:
                    size = (total - 1) % capacity + 1 if at == 0 else capacity
                    part = data[4 * at : 4 * (at + size)]
                    piece.append(0 if at == 0 else piece[-1] + 1)
                    row.append(i)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(part))
                    if keep_ids:
                        ids.append(part)
                    at += size
            columns = [batch.column("doc_id").take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc)), pa.array(piece, pa.int32())]
            if keep_ids:
                values = pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32))
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32)), values))
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return rows.mapInArrow(common.settled(run), schema)


# The plan, on the driver.

Pattern = tuple[int, ...]


def best_fit(hist: np.ndarray, capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing over a histogram; sequences with equal contents are handled together."""
    open_by_room: list[list[tuple[Pattern, int]]] = [[] for _ in range(capacity + 1)]
    rooms = np.zeros(capacity + 1, bool)
    for size in range(capacity, 0, -1):
        left = int(hist[size])
        while left:
            fits = np.flatnonzero(rooms[size:])
            if len(fits):
                room = size + int(fits[0])
                pattern, n = open_by_room[room].pop()
                used = min(n, left)
                if used < n:
                    open_by_room[room].append((pattern, n - used))
                rooms[room] = bool(open_by_room[room])
                new = (*pattern, size)
            else:
                per = capacity // size
                used = left if per == 1 else max(1, left // per)
                new, room = (size,) * (min(per, left) if per > 1 else 1), capacity
                if per > 1 and left < per:
                    used = 1
                room = capacity - sum(new) + size
                left -= used * (len(new) - 1)
            left -= used
            room -= size
            open_by_room[room].append((new, used))
            rooms[room] = True
    return [x for group in open_by_room for x in group]


def greedy(hist: np.ndarray, room: int) -> Pattern:
    """The filling that takes the largest length that fits, again and again."""
    out: list[int] = []
    left = hist[: room + 1].copy()
    while room > 0:
        sizes = np.flatnonzero(left[1 : room + 1])
        if not len(sizes):
            break
        size = int(sizes[-1]) + 1
        n = min(int(left[size]), room // size)
        out += [size] * n
        left[size] -= n
        room -= n * size
    return tuple(out)


def fillings(hist: np.ndarray, room: int, want: int, budget: int = 400) -> list[Pattern]:
    """Undominated fillings of ``room`` from what ``hist`` has, least waste first, larger lengths first among equals.

    A filling is dominated if one of its lengths can be exchanged for a longer one that still fits, or if another
    length can be added; extending each choice to the largest that fits leaves those out.
    """
    if room <= 0:
        return [()]
    found: list[tuple[int, Pattern]] = []
    steps = 0

    def extend(chosen: Pattern, room_left: int, cap: int, depth: int) -> bool:
        nonlocal steps
        top = min(room_left, cap)
        sizes = np.flatnonzero(hist[1 : top + 1]) + 1 if top > 0 else np.zeros(0, int)
        if depth == 1 and len(sizes):
            sizes = sizes[-1:]
        ended = True
        for size in sizes[::-1].tolist():
            if hist[size] <= chosen.count(size):
                continue
            steps += 1
            ended = False
            if size == room_left:
                found.append((0, (*chosen, size)))
                return len(found) >= want
            if depth > 1 and extend((*chosen, size), room_left - size, size, depth - 1):
                return True
            if depth == 1:
                found.append((room_left - size, (*chosen, size)))
            if steps > budget:
                return True
        if ended and chosen:
            found.append((room_left, chosen))
        return False

    for depth in (1, 2, 3, 8):
        steps = 0
        if extend((), room, room, depth) and any(waste == 0 for waste, _ in found):
            break
    if not found:
        return [()]
    if all(waste for waste, _ in found):  # fillings of more pieces than were tried
        filled = greedy(hist, room)
        found = [(waste, p) for waste, p in found if waste <= room - sum(filled)] + [(room - sum(filled), filled)]
    unique = {tuple(sorted(p, reverse=True)): waste for waste, p in found}
    return sorted(unique, key=lambda p: (unique[p], len(p), [-x for x in p]))[:want]


def lower_bound(hist: np.ndarray, capacity: int) -> int:
    """No packing has fewer sequences: by volume, and by lengths of which no two fit together."""
    sizes = np.arange(len(hist))
    best = -(-int((hist * sizes).sum()) // capacity)
    over = np.cumsum(hist[::-1])[::-1]
    volume = np.cumsum(hist * sizes)
    for k in range(1, capacity // 2 + 1):
        big, mid = int(over[capacity - k + 1]), int(over[capacity // 2 + 1] - over[capacity - k + 1])
        mid_volume = int(volume[capacity - k] - volume[capacity // 2])
        small = int(volume[capacity // 2] - volume[k - 1])
        best = max(best, big + mid + max(0, -(-(small - (mid * capacity - mid_volume)) // capacity)))
    return best


def complete_bins(hist: np.ndarray, capacity: int = CAPACITY, nodes: int = NODES, width: int = FILLINGS) -> list[tuple[Pattern, int]]:
    """Patterns and how often each is used, in as few sequences as the search finds."""
    hist = np.asarray(hist, np.int64).copy()
    best = best_fit(hist, capacity)
    count = sum(n for _, n in best)
    bound = lower_bound(hist, capacity)
    total = int((hist * np.arange(len(hist))).sum())
    path: list[tuple[Pattern, int]] = []
    # A branch: counts left, its largest length that can remain, waste so far, sequences so far, its fillings not yet tried.
    stack: list[list] = [[hist, capacity, 0, 0, None]]
    opened = 0
    while stack and count > bound and opened < nodes:
        state = stack[-1]
        left, top, waste, used, options = state
        if options is None:
            while top > 0 and not left[top]:
                top -= 1
            if top == 0:
                if used < count:
                    best, count = list(path), used
                options = []
            elif waste > (count - 1) * capacity - total:
                options = []
            else:
                rest = left.copy()
                rest[top] -= 1
                patterns = [(top, *p) for p in fillings(rest, capacity - top, width)]
                often = [min(int(left[x]) // p.count(x) for x in set(p)) for p in patterns]
                # As often as counts allow first, then once: what lies between is a run of single uses.
                options = [(p, n) for p, n in zip(patterns, often, strict=True)] + [(p, 1) for p, n in zip(patterns, often, strict=True) if n > 1]
            state[1], state[4] = top, options
        if not options:
            stack.pop()
            if path:
                path.pop()
            continue
        pattern, times = options.pop(0)
        sizes, need = np.unique(pattern, return_counts=True)
        after = left.copy()
        after[sizes] -= need * times
        opened += 1
        path.append((pattern, times))
        stack.append([after, top, waste + times * (capacity - sum(pattern)), used + times, None])
    return best


def intervals(plan: list[tuple[Pattern, int]]) -> dict[str, np.ndarray]:
    """For each length, ranks from ``rank`` on go to sequences from ``sequence`` on, ``per`` to each, from ``offset`` on."""
    rows, ranks, base = [], {}, 0
    for pattern, times in plan:
        offset = 0
        for size in sorted(set(pattern), reverse=True):
            per = pattern.count(size)
            rows.append((size, ranks.get(size, 0), base, per, offset))
            ranks[size] = ranks.get(size, 0) + per * times
            offset += per * size
        base += times
    data = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "sequence", "per", "offset"), data.T, strict=True))


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (rows of ``pieces``, already written) with sequence_id and offset."""
    spark = cut.sparkSession
    by_length = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    hist = np.zeros(capacity + 1, np.int64)
    for length, n in by_length.items():
        hist[length] = n
    plan = spark.sparkContext.broadcast(intervals(complete_bins(hist, capacity)))
    groups = max(64, int(hist.sum()) // 50_000)
    dealt = cut.withColumn("part", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(groups)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = dealt.groupBy("length", "part").agg(F.count("*").alias("n")).withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long")).drop("n")
    within = Window.partitionBy("length", "part").orderBy("doc_id", "start", "ids_crc32")
    ranked = dealt.withColumn("rank", F.row_number().over(within) - 1).join(firsts, ["length", "part"]).withColumn("rank", (F.col("rank") + F.col("first")).cast("long")).drop("first", "part")
    ranked = ranked.select(*cut.columns, "rank")
    schema = StructType([*(ranked.schema[c] for c in cut.columns)]).add("sequence_id", LongType()).add("offset", LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = plan.value
        scale = int(hist.sum()) + 1
        key = p["length"] * scale + p["rank"]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(key, length * scale + rank, side="right") - 1
            step = rank - p["rank"][at]
            sequence, offset = p["sequence"][at] + step // p["per"][at], p["offset"][at] + step % p["per"][at] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], schema.names)

    return ranked.mapInArrow(common.settled(run), schema)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    cut = common.cut(pieces(docs, path or tokenizer_path(), capacity=capacity, keep_ids=keep_ids), "pieces")
    return pack(cut, capacity)


def op10_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(common.read(spark, sf_dir, "documents"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece, with its token ids: those of a sequence, laid by ``offset``, are one training sequence."""
    return pack_documents(docs, keep_ids=True).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids")

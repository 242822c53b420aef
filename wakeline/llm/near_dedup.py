"""Near-duplicate classes by Order MinHash.

A text is the sequence of its five-word shingles, each labelled with its occurrence number, so that none repeats. Each
of ``SKETCHES`` sketches takes the ``PICKS`` shingles of the smallest hash and keeps them in text order; texts close in
edit distance agree on a sketch, texts with the same shingles in another order do not. Texts that agree are candidates,
verified by an alignment of their shingle sequences in a band: with M aligned shingles of n and m, the similarity is
M / (n + m - M), and a pair is linked from 0.8 on. Alignments of such pairs have at most (n + m) / 9 gaps, which is the
width of the band.

Identical word sequences are one node. In a bucket each member is first compared with one centre (the smallest id).
Where members of a bucket are then in different components, all its pairs across components are looked at, in blocks
that are dealt over tasks: a pair whose lengths or whose number of common shingles rule out ``SIMILARITY`` goes, every
other one is aligned, unless a link found in the block has put the two together. So each pair that agrees on a sketch is
compared or in one class already. Classes are the connected components of the links.

Ids are integers. A row is known by its id, a hash of its text (null ids match) and a number of its own, never by the id
alone. Defined results: texts without words (null, empty) are a class of their own each; a text of fewer than five words
is one shingle; equal word sequences always share a class; repeated rows keep their number and share a class; a class
keeps one row, the one with the smallest id (a null id comes last; of equal ids, by the hash of the text). The class id is
the smallest id in the class; a class without an id, or whose smallest id another class already has (ids may repeat),
gets a negative number from its text, or from the row's number if there are no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.llm import common
from wakeline.operators import graph

SHINGLE = 5
SIMILARITY = 0.8
SKETCHES = 16
PICKS = 3
#: Members of a bucket, and their shingles, that are held against as many others at once, about.
BLOCK, BLOCK_SHINGLES = 512, 1 << 20
#: Counted ids up to which they are broadcast.
BROADCAST_ROWS = 500_000

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_RNG = np.random.default_rng(20)
_PLACE = _RNG.integers(1, 2**63, SHINGLE, np.uint64) * np.uint64(2) + np.uint64(1)
_SEED = _RNG.integers(1, 2**63, SKETCHES, np.uint64)
_C1, _C2, _C3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _C1
    x = (x ^ (x >> np.uint64(27))) * _C2
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_words = _Words()


def split(text: str) -> list[bytes]:
    """Words: digits, letters and all beyond ASCII, A-Z in lower case."""
    return text.encode("utf-8", "replace").translate(_FOLD).split()


def shingles(tokens: list[bytes]) -> np.ndarray:
    """Occurrence-labelled hashes of the shingles, in text order."""
    if not tokens:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_words.__getitem__, tokens), np.uint64, len(tokens))
    n = max(1, len(w) - SHINGLE + 1)
    h = np.zeros(n, np.uint64)
    for k in range(min(SHINGLE, len(w))):
        h += w[k : k + n] * _PLACE[k]
    h = _mix(h)
    order = np.argsort(h, kind="stable")
    same = np.concatenate([[False], h[order][1:] == h[order][:-1]])
    if same.any():
        run = np.arange(n) - np.maximum.accumulate(np.where(same, 0, np.arange(n)))
        h[order] = np.where(same, _mix(h[order] + run.astype(np.uint64) * _C3), h[order])
    return h


def sketch(h: np.ndarray) -> np.ndarray:
    """A key for each sketch: its picks, combined in text order."""
    picks = min(PICKS, len(h))
    if len(h) > 100_000:
        at = np.stack([np.argpartition(_mix(h ^ s), picks - 1)[:picks] for s in _SEED])
    else:
        value = (h[None, :] ^ _SEED[:, None]) * _C1
        value = (value ^ (value >> np.uint64(29))) * _C2
        at = np.argpartition(value, picks - 1, axis=1)[:, :picks] if picks < len(h) else np.tile(np.arange(picks), (SKETCHES, 1))
    at.sort(axis=1)
    key = _SEED.copy()
    for k in range(picks):
        key = _mix(key * _C3 + h[at[:, k]])
    return key


def aligned(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Length of the longest common subsequence within the band. No value repeats in a sequence, so that it is the
    longest rising run of matched positions, found over the matches alone."""
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    near = np.abs(i - j) <= band
    i, j = i[near], j[near]
    j = j[np.argsort(i)]
    if len(j) < 2 or (j[1:] > j[:-1]).all():
        return len(j)
    from bisect import bisect_left

    tails: list[int] = []
    for x in j.tolist():
        at = bisect_left(tails, x)
        tails[at : at + 1] = [x]
    return len(tails)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Of two shingle sequences; below ``SIMILARITY`` it may come out lower than without the band."""
    if not len(a) or not len(b) or min(len(a), len(b)) < SIMILARITY * max(len(a), len(b)):
        return 0.0
    m = aligned(a, b, (len(a) + len(b)) // 9 + 1)
    return m / (len(a) + len(b) - m)


def sketches(docs: DataFrame) -> DataFrame:
    """own_id, text_hash, e1 and e2 (hash of the word sequence), n (shingles), keys, row (a number of its own)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            e1, e2, n, keys = [], [], [], []
            for text in common.strings(batch, "text"):
                tokens = split(text)
                digest = xxhash.xxh3_128_intdigest(b" ".join(tokens))
                e1.append((digest >> 64) - (1 << 63))
                e2.append((digest & (2**64 - 1)) - (1 << 63))
                h = shingles(tokens)
                n.append(len(h))
                keys.append(sketch(h).view(np.int64) if len(h) else [])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), *(pa.array(x, pa.int64()) for x in (e1, e2, n)), pa.array(keys, pa.list_(pa.int64()))], ["own_id", "text_hash", "e1", "e2", "n", "keys"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    return out.mapInArrow(common.settled(run), "own_id long, text_hash long, e1 long, e2 long, n long, keys array<long>").withColumn("row", F.monotonically_increasing_id())


def sequences(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Shingle sequences (32 bits a shingle) of the nodes ``ids`` (id, own_id, own_hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seq = [shingles(split(t)).astype("<u4").tobytes() for t in common.strings(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(seq, pa.binary())], ["id", "seq"])

    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    found = held.join(wanted, held["doc_id"].eqNullSafe(wanted["own_id"]) & (held["text_hash"] == wanted["own_hash"]))
    return found.select("id", "text").mapInArrow(common.settled(run), "id long, seq binary").dropDuplicates(["id"])


def verify(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) that the alignment links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sa, sb = batch.column("seq_a"), batch.column("seq_b")
            near = [similarity(*(np.frombuffer(x[k].as_py(), "<u4") for x in (sa, sb))) >= threshold for k in range(len(batch))]
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    ids = common.cut(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct().join(nodes, "id").select("id", "own_id", "own_hash"), "ids")
    seq = common.cut(sequences(docs, ids), "sequences")
    of = lambda c: seq.select(F.col("id").alias(c), F.col("seq").alias(f"seq_{c}"))
    # A centre of many pairs: its sequence is dealt to several tasks, each with a part of the pairs.
    held = pairs.groupBy("b").agg(F.count("*").alias("held")).withColumn("salts", F.ceil(F.col("held") / BLOCK))
    held = common.cut(held, "held")
    salted = common.spread_join(pairs, held, ["b"], "held").withColumn("salt", F.pmod(F.xxhash64("a"), "salts")).select("a", "b", "salt")
    centres = of("b").join(held, "b").select("b", "seq_b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    return salted.join(of("a"), "a").join(centres, ["b", "salt"]).select("a", "b", "seq_a", "seq_b").mapInArrow(common.settled(run), "a long, b long")


def _alike(n: str, m: str):
    return F.least(n, m) >= SIMILARITY * F.greatest(n, m)


def _links(batch: pa.RecordBatch) -> tuple[list[int], list[int]]:
    """Links between a bucket's blocks lo and hi (rows of one k, key, lo and hi) that join components."""
    k, lo, hi = (batch.column(x)[0].as_py() for x in ("k", "lo", "hi"))
    ids, n, component, block = (batch.column(x).to_numpy() for x in ("id", "n", "component", "block"))
    if (component == component[0]).all():
        return [], []
    component = component.copy()
    keys = batch.column("keys").flatten().to_numpy().reshape(-1, SKETCHES)[:, :k]
    seqs = [np.frombuffer(x.as_py(), "<u4") for x in batch.column("seq")]
    known, codes = np.unique(np.concatenate(seqs), return_inverse=True)
    codes = np.split(codes, np.cumsum(n)[:-1])
    marked = np.zeros(len(known), np.int64)
    left, right = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
    a, b = [], []
    for x in left:
        y = right[right > x] if lo == hi else right
        y = y[component[y] != component[x]]
        y = y[np.minimum(n[y], n[x]) >= SIMILARITY * np.maximum(n[y], n[x])]
        y = y[~(keys[y] == keys[x]).any(axis=1)]  # an earlier sketch has that pair
        if not len(y):
            continue
        marked[codes[x]] = 1
        common_ = np.add.reduceat(marked[np.concatenate([codes[i] for i in y])], np.cumsum(n[y]) - n[y])
        marked[codes[x]] = 0
        for i in y[common_ / (n[y] + n[x] - common_) >= SIMILARITY]:
            if component[i] != component[x] and similarity(seqs[x], seqs[i]) >= SIMILARITY:
                a.append(int(ids[x]))
                b.append(int(ids[i]))
                component[component == component[i]] = component[x]
    return a, b


def remaining(members: DataFrame) -> DataFrame:
    """Links (a, b) that join components within a bucket (k, key, size, total); ``members`` has id, n, component, keys, seq."""
    cells = ["k", "key", "lo", "hi"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in _links(batch)], ["a", "b"])

        held = None
        for batch in batches:
            if not len(batch):
                continue
            held = batch if held is None else pa.concat_batches([held, batch])
            ends = np.flatnonzero(np.any([np.diff(held.column(c).to_numpy()) != 0 for c in cells], axis=0)) + 1
            for start, end in zip([0, *ends], ends, strict=False):
                yield found(held.slice(start, end - start))
            held = held.slice(ends[-1]) if len(ends) else held
        if held is not None:
            yield found(held)

    blocks = F.ceil(F.greatest(F.col("size") / BLOCK, F.col("total") / BLOCK_SHINGLES))
    dealt = members.withColumn("block", F.pmod(F.xxhash64("id"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    dealt = dealt.select("k", "key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "id", "n", "component", "keys", "seq")
    return dealt.repartition(*cells).sortWithinPartitions(*cells).mapInArrow(common.settled(run), "a long, b long")


def _named(nodes: DataFrame, comp: DataFrame) -> DataFrame:
    """``nodes`` with the component they are in so far (their own id, if none)."""
    return nodes.join(comp, "id", "left").withColumn("component", F.coalesce("component", "id"))


def _first():
    """Orders the rows of a class; the least one stands for it."""
    return F.struct(F.col("own_id").isNull().alias("no_id"), "own_id", "text_hash", "row")


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row: doc_id, class_id, n_shingles, class_size (rows of the class), kept (the row that stands for its class)."""
    return classified(df, id_col, text_col).drop("text_hash")


def classified(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``classes`` with the hash of each text, text_hash."""
    docs = common.keyed(df, id_col, text_col)
    rows = common.cut(sketches(docs), "sketches")
    # A node stands for a word sequence: its row of the smallest id, numbered anew.
    firsts = rows.filter("n > 0").groupBy("e1", "e2").agg(F.min(_first()).alias("first"), F.count("*").alias("copies")).select(F.col("first.row").alias("row"), "first", "copies")
    nodes = rows.join(firsts, "row")
    nodes = common.cut(nodes.select(F.col("row").alias("id"), "n", "keys", "own_id", F.col("text_hash").alias("own_hash"), "e1", "e2", "first", "copies"), "nodes")

    placed = nodes.select("id", "n", F.posexplode("keys").alias("k", "key"))
    centres = placed.groupBy("k", "key").agg(F.min(F.struct("id", "n")).alias("c"), F.count("*").alias("size"))
    centres = common.cut(centres.filter("size > 1").select("k", "key", F.col("c.id").alias("centre"), F.col("c.n").alias("m"), "size"), "centres")
    shared = common.cut(common.spread_join(placed, centres, ["k", "key"], "size"), "shared")
    pairs = common.cut(shared.filter((F.col("id") != F.col("centre")) & _alike("n", "m")).select(F.col("id").alias("a"), F.col("centre").alias("b")).distinct(), "pairs")
    links = common.cut(verify(pairs, docs, nodes), "links")
    comp = graph.components(links)

    # Buckets whose members are in different components: their other pairs.
    at = _named(shared, comp).select("id", "n", "k", "key", "size", "component")
    apart = at.groupBy("k", "key").agg((F.min("component") != F.max("component")).alias("apart"), F.max("size").alias("size"), F.sum("n").alias("total")).filter("apart and size > 2").select("k", "key", "size", "total")
    apart = common.cut(apart, "apart")
    left = common.cut(common.spread_join(at.drop("n", "size"), apart, ["k", "key"], "size"), "left")
    seq = common.cut(sequences(docs, left.select("id").distinct().join(nodes, "id").select("id", "own_id", "own_hash")), "sequences")
    links = links.unionByName(common.cut(remaining(left.join(nodes, "id").join(seq, "id")), "links"))
    comp = common.cut(graph.components(links), "components")

    # The names of the classes: their smallest ids, each given once.
    named = common.cut(_named(nodes.select("id", "e1", "e2", "first", "copies"), comp), "named")
    heads = named.groupBy("component").agg(F.min("first").alias("head"), F.min(-1 - F.pmod("e1", F.lit(1 << 62))).alias("spare")).select("head", "spare")
    lone = rows.filter("n = 0").select(_first().alias("head"), (F.lit(-(1 << 62) - 1) - F.col("row")).alias("spare"))
    heads = common.cut(heads.unionByName(lone).select("head.*", "spare"), "heads")
    owners = heads.filter("not no_id").groupBy("own_id").agg(F.min(F.struct("text_hash", "row")).alias("owner"))
    names = heads.filter("not no_id").join(owners, "own_id").select("row", F.when(F.col("row") == F.col("owner.row"), F.col("own_id")).otherwise(F.col("spare")).alias("class"))
    names = common.cut(names.unionByName(heads.filter("no_id").select("row", F.col("spare").alias("class"))), "names").withColumnRenamed("row", "head")

    tops = named.groupBy("component").agg(F.min("first")["row"].alias("head"), F.sum("copies").alias("size")).join(names, "head")
    tops = common.cut(tops, "tops")
    by_text = common.cut(common.spread_join(named, tops, ["component"], "size").select("e1", "e2", "head", "class", "size", "copies"), "texts")
    worded = common.spread_join(rows.filter("n > 0"), by_text, ["e1", "e2"], "copies")
    wordless = rows.filter("n = 0").join(names, F.col("row") == F.col("head")).withColumn("size", F.lit(1).cast("long"))
    columns = [F.col("own_id").alias("doc_id"), F.col("class").alias("class_id"), F.col("n").alias("n_shingles"), F.col("size").alias("class_size"), (F.col("row") == F.col("head")).alias("kept"), "text_hash"]
    return worded.select(columns).unionByName(wordless.select(columns))


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(common.read(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each class: the one with the smallest id. Every row without words stays."""
    keys = classified(docs).groupBy("doc_id", "text_hash").agg(F.max("kept").alias("kept"), ((F.count("*") > 1) & (F.max("n_shingles") > 0)).alias("repeated"))
    keys = common.cut(keys.filter("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_hash").alias("kept_hash"), "repeated"), "kept")
    held = docs.withColumn("text_hash", F.xxhash64(common.text_of("text")))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("kept_id")) & (F.col("text_hash") == F.col("kept_hash"))
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    out = held.join(keys.filter("not repeated"), same, "left_semi").select(columns)
    repeated = keys.filter("repeated")
    if n := repeated.count():
        some = held.join(F.broadcast(repeated) if n <= BROADCAST_ROWS else repeated, same, "left_semi")
        one = some.groupBy("doc_id", "text_hash").agg(F.min(F.struct(columns[1:])).alias("x"))
        out = out.unionByName(one.select("doc_id", "x.*"))
    return out

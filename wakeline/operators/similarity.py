"""Exact similarity joins of vectors, and sums over all pairs of two clouds, in blocks of bounded size.

Rows are gathered around pivots, cells of pivots whose angles cannot come close enough are left out, and what remains
meets block by block as matrix products, in single precision with room for its errors, then in double for what is left.
Each side is cut into about as many blocks whatever its rows, so that what is shuffled grows with them.

Candidates alone can also be named by signs (``met_by_signs``). Near 1, two unit vectors of similarity s lie within
R = 2 - 2s (squared), so in at least one of m bands of coordinates within R / m. Where they differ in sign there, their
distance holds both components, and those of one of the two sum to at most R / (2m) squared. A row therefore goes under its
own sign pattern in each band, and once more under every pattern that flips components of so small a sum; one side's own
pattern meets the other's flipped ones. Vectors are turned by a fixed orthogonal matrix first, so that no band is empty or
constant.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.sources.work import cut

#: Rows of one side in a block, if it has fewer than BLOCKS blocks then, and at most.
BLOCK, BLOCKS, WIDEST = 16_384, 8, 65_536
#: Pivots at most; they are compared with each other on the driver.
PIVOTS = 128
#: Coordinates of a band.
BAND = 16


@lru_cache(8)
def turn(dim: int) -> np.ndarray:
    """A fixed orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def unit_vectors(df: DataFrame, vector: str = "v") -> DataFrame:
    """(row, id, dim, u), written: vectors of length 1. Vectors that are null, empty, zero, or hold a null or a number that
    is not finite are left out."""
    v = F.transform(vector, lambda p: p.cast("double"))
    length = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda s, p: s + p * p))
    out = df.select("id", v.alias("_v")).withColumn("_l", length).filter((F.col("_l") > 0) & (F.col("_l") < math.inf))
    unit = F.transform("_v", lambda p: p / F.col("_l"))
    return cut(out.select(F.monotonically_increasing_id().alias("row"), "id", F.size("_v").alias("dim"), unit.alias("u")), "unit")


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Lists of one length as the rows of a matrix."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy().reshape(len(flat), -1)


def flips(squares: list[float], most: float) -> list[int]:
    """The sets of places, as bits, whose squares sum to at most ``most``; the empty set first."""
    order = sorted(range(len(squares)), key=squares.__getitem__)
    out: list[int] = []

    def grow(bits: int, left: float, at: int) -> None:
        out.append(bits)
        for k in range(at, len(order)):
            if squares[order[k]] > left:
                break
            grow(bits | 1 << order[k], left - squares[order[k]], k + 1)

    grow(0, most, 0)
    return out


def sign_patterns(units: DataFrame, at_least: float, band: int = BAND) -> DataFrame:
    """(row, dim, band, pattern, own): the pattern of each band, and those that small flips make of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, int, int, int, bool]] = []
            for row, dim, u in zip(*(batch.column(c).to_pylist() for c in ("row", "dim", "u")), strict=True):
                parts = np.array_split(np.array(u) @ turn(dim), -(-dim // band))
                most = (2 - 2 * at_least) / len(parts) / 2 + 1e-9
                for k, part in enumerate(parts):
                    own = int(sum(1 << j for j in np.flatnonzero(part >= 0).tolist()))
                    found += [(row, dim, k, own ^ bits, not bits) for bits in flips((part * part).tolist(), most)]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_())
            columns = [pa.array(c, k) for c, k in zip(zip(*found, strict=True) if found else [[]] * 5, kinds, strict=True)]
            for at in range(0, len(found), 100_000):
                yield pa.RecordBatch.from_arrays([c.slice(at, 100_000) for c in columns], ["row", "dim", "band", "pattern", "own"])

    return units.mapInArrow(run, "row long, dim int, band int, pattern long, own boolean")


def met_by_signs(left: DataFrame, right: DataFrame, at_least: float) -> DataFrame:
    """(a, b): rows that may be alike, each pair once."""
    keys = ["dim", "band", "pattern"]
    side = lambda df, name: cut(sign_patterns(df, at_least), "signs").withColumnRenamed("row", name)
    a = side(left, "a")
    b = side(right, "b") if right is not left else a.withColumnRenamed("a", "b")
    there = a.filter("own").drop("own").join(b.drop("own"), keys).select("a", "b")
    back = a.filter("NOT own").drop("own").join(b.filter("own").drop("own"), keys).select("a", "b")
    met = there.unionByName(back)
    return (met.filter("a < b") if right is left else met).distinct()


def _dealt(df: DataFrame, name: str, blocks: DataFrame) -> DataFrame:
    """Rows with the block of their cell that they belong to; ``blocks`` has the number of blocks of each (dim, cell)."""
    return df.join(F.broadcast(blocks), ["dim", "cell"]).withColumn(name, F.pmod(F.xxhash64("row"), F.col("blocks")))


def similar_by_blocks(left: DataFrame, right: DataFrame, at_least: float, block: int | None = None) -> DataFrame:
    """(a, b, similarity) of ids, by matrix products of blocks. Cells are pivots' neighbourhoods."""
    own = right is left
    spark = left.sparkSession
    rows = left.count()
    block = block or min(WIDEST, max(BLOCK, -(-rows // BLOCKS)))
    n_pivots = int(min(PIVOTS, max(1, rows // block)))
    chosen = left.orderBy(F.xxhash64("row"), "row").limit(n_pivots).select("dim", "u").toArrow()
    pivots: dict[int, np.ndarray] = {}
    for dim in set(chosen.column("dim").to_pylist()):
        pivots[dim] = matrix(chosen.filter(pa.compute.equal(chosen.column("dim"), dim)).column("u"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, angle = np.zeros(len(batch), np.int32), np.full(len(batch), math.pi)
            dims = batch.column("dim").to_numpy()
            for dim in set(dims.tolist()) & pivots.keys():
                at = np.flatnonzero(dims == dim)
                near = matrix(batch.column("u").take(pa.array(at))) @ pivots[dim].T
                cell[at] = near.argmax(axis=1)
                angle[at] = np.arccos(np.clip(near.max(axis=1), -1, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(angle)], [*batch.schema.names, "cell", "angle"])

    def placed(df: DataFrame) -> DataFrame:
        kind = df.schema["id"].dataType.simpleString()
        return cut(df.mapInArrow(place, f"row long, id {kind}, dim int, u array<double>, cell int, angle double"), "placed")

    a = placed(left)
    b = a if own else placed(right)
    sizes = [{(r.dim, r.cell): (r.n, r.angle) for r in x.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("angle").alias("angle")).collect()} for x in (a, b)]
    wide = math.acos(max(-1.0, min(1.0, at_least))) + 1e-6
    meet = []
    for (dim, p), (_, reach_p) in sizes[0].items():
        for (other, q), (n_q, reach_q) in sizes[1].items():
            if dim != other or own and q < p:
                continue
            if dim in pivots:
                apart = math.acos(float(np.clip(pivots[dim][p] @ pivots[dim][q], -1, 1)))
                if apart - reach_p - reach_q > wide:
                    continue
            meet.append((dim, p, q, -(-n_q // block)))
    if not meet:
        return a.join(b.select(F.col("id").alias("b")).limit(0)).select(F.col("id").alias("a"), "b", F.lit(0.0).alias("similarity"))
    blocks = [spark.createDataFrame([(d, c, -(-n // block)) for (d, c), (n, _) in s.items()], "dim int, cell int, blocks int") for s in sizes]
    meeting = spark.createDataFrame(meet, "dim int, cell int, other int, other_blocks int")  # at most PIVOTS squared a dim
    x = _dealt(a, "i", blocks[0]).join(F.broadcast(meeting), ["dim", "cell"])
    x = x.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("other_blocks").cast("long") - 1)))
    kinds = [left.schema["id"].dataType.simpleString(), right.schema["id"].dataType.simpleString()]
    ids = lambda mine: [F.col("id").alias(n) if n == mine else F.lit(None).cast(k).alias(n) for n, k in zip("ab", kinds, strict=True)]
    x = x.select("dim", F.col("cell").alias("p"), F.col("other").alias("q"), "i", "j", F.lit(0).alias("side"), "row", *ids("a"), "u")
    back = meeting.join(blocks[0].withColumnRenamed("blocks", "own_blocks"), ["dim", "cell"]).select("dim", F.col("cell").alias("p"), F.col("other").alias("cell"), "own_blocks")
    y = _dealt(b, "j", blocks[1]).join(F.broadcast(back), ["dim", "cell"])
    y = y.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("own_blocks").cast("long") - 1)))
    y = y.select("dim", "p", F.col("cell").alias("q"), "i", "j", F.lit(1).alias("side"), "row", *ids("b"), "u")
    if own:  # of two blocks of one cell, one order is enough
        x, y = x.filter("p < q OR i <= j"), y.filter("p < q OR i <= j")

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The pairs of two blocks, a tile of them at a time."""
        both = pa.Table.from_batches(list(batches))
        mine, other = (both.filter(pa.compute.equal(both.column("side"), k)) for k in (0, 1))
        if not len(mine) or not len(other):
            return
        u, v, rows, theirs = matrix(mine.column("u")), matrix(other.column("u")), mine.column("row").to_numpy(), other.column("row").to_numpy()
        same = own and both.column("p")[0] == both.column("q")[0] and both.column("i")[0] == both.column("j")[0]
        low = at_least - (u.shape[1] + 16) * 1e-7  # beyond what single precision errs
        p, q = u.astype(np.float32), v.astype(np.float32)
        for at in range(0, len(u), 512):
            for to in range(0, len(v), 4096):
                near = np.flatnonzero(p[at : at + 512] @ q[to : to + 4096].T >= low)
                for some in np.array_split(near, -(-len(near) // 65_536)) if len(near) else ():
                    i, j = np.divmod(some, min(4096, len(v) - to))
                    i, j = i + at, j + to
                    s = np.einsum("ij,ij->i", u[i], v[j])
                    good = s >= at_least
                    if same:
                        good &= rows[i] < theirs[j]
                    columns = [mine.column("a").take(pa.array(i[good])), other.column("b").take(pa.array(j[good])), pa.array(s[good])]
                    yield pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], ["a", "b", "similarity"])

    by = ["dim", "p", "q", "i", "j"]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # work grows with pairs, not with bytes
    return x.unionByName(y).repartition(tasks, *by).groupBy(*by).applyInArrow(product, f"a {kinds[0]}, b {kinds[1]}, similarity double")


def similar_pairs(left: DataFrame, right: DataFrame | None, at_least: float, vector: str = "v", block: int | None = None) -> DataFrame:
    """Pairs (a from ``left``, b from ``right``) of ids whose vectors have cosine similarity ``at_least`` or more, exactly.

    Without ``right``, the pairs of ``left`` with itself, each once, the smaller id first. Vectors that ``unit_vectors``
    leaves out have no pair, those of unlike lengths meet none; repeated rows pair like others.
    """
    a = unit_vectors(left, vector)
    b = a if right is None else unit_vectors(right, vector)
    out = similar_by_blocks(a, b, at_least, block)
    return out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity") if right is None else out


def energy_distance(a: DataFrame, b: DataFrame, key: str, block: int = BLOCK) -> DataFrame:
    """Energy distance of two planar clouds (x, y) of each group: 2 E|A-B| - E|A-A'| - E|B-B'|.

    Points of a cloud at one place are one row with their number. Each cloud is dealt into blocks of ``block`` places; a
    task takes two blocks and hands on a count and a sum of distances, so that neither a cloud nor a list of pairs is ever
    in one place. Groups with only one cloud have no row.
    """
    points = lambda df, side: df.select(F.col(key).alias("k"), F.lit(side).alias("side"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    given = points(a, 0).unionByName(points(b, 1)).filter("x IS NOT NULL AND y IS NOT NULL")
    both = cut(given.groupBy("k", "side", "x", "y").agg(F.count("*").alias("m")).withColumn("row", F.monotonically_increasing_id()), "clouds")
    sizes = cut(both.groupBy("k", "side").agg(F.sum("m").alias("n"), F.ceil(F.count("*") / block).cast("int").alias("blocks")), "sizes")
    dealt = both.join(sizes.select("k", "side", "blocks"), ["k", "side"]).withColumn("own", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int")).drop("blocks")
    other = sizes.select("k", F.col("side").alias("with"), F.col("blocks").alias("with_blocks"))
    by = ["k", "s", "t", "i", "j"]
    spread = dealt.join(other, "k").withColumn("o", F.explode(F.sequence(F.lit(0), F.col("with_blocks") - 1)))
    first = spread.filter("side <= `with`").select("k", F.col("side").alias("s"), F.col("with").alias("t"), F.col("own").alias("i"), F.col("o").alias("j"), "x", "y", "m")
    second = spread.filter("`with` <= side").select("k", F.col("with").alias("s"), F.col("side").alias("t"), F.col("o").alias("i"), F.col("own").alias("j"), "x", "y", "m")
    second = second.select(*(F.col(c).alias(c) for c in second.columns))

    def total(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        p, q = (np.stack([t.column(c).to_numpy() for c in "xy"], axis=1) for t in (mine, theirs))
        u, v = (t.column("m").to_numpy().astype(float) for t in (mine, theirs))
        n = 0.0
        for at in range(0, len(p), 64):
            for to in range(0, len(q), 1024):
                x, y = (p[at : at + 64, None, k] - q[None, to : to + 1024, k] for k in (0, 1))
                x *= x
                y *= y
                x += y
                n += float(u[at : at + 64] @ np.sqrt(x, out=x) @ v[to : to + 1024])
        head = mine if len(mine) else theirs
        return pa.table({c: head.column(c).slice(0, 1) for c in ("k", "s", "t")} | {"d": pa.array([n])})

    kind = both.schema["k"].dataType.simpleString()
    sums = first.groupBy(*by).cogroup(second.groupBy(*by)).applyInArrow(total, f"k {kind}, s int, t int, d double")
    wide = sums.groupBy("k").agg(*(F.sum(F.when((F.col("s") == s) & (F.col("t") == t), F.col("d"))).alias(f"d{s}{t}") for s, t in ((0, 0), (0, 1), (1, 1))))
    counts = sizes.groupBy("k").agg(*(F.sum(F.when(F.col("side") == s, F.col("n"))).cast("double").alias(f"n{s}") for s in (0, 1)))
    energy = F.expr("2 * d01 / n0 / n1 - d00 / n0 / n0 - d11 / n1 / n1")
    return wide.join(counts, "k").filter("n0 > 0 AND n1 > 0").select(F.col("k").alias(key), energy.alias("energy"))

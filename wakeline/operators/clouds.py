"""Positions against particle clouds without a row for each pair.

The positions of one key (an hour, say) are dealt into slices of about ``SLICE``, and the particles of that key go to each
of its slices, once, whatever number of clouds (events, members, scenarios) they form; particles of a cloud at one place
are one row with their number. A task takes a slice with its
clouds and works out all statistics in blocks: neither pairs nor distances are ever shuffled, and the slices of one busy
hour are dealt over tasks. Slices grow with the clouds, so that what is sent to them grows with the positions. Where clouds
of one key mostly hold the same places, densities and least distances are worked out once for each place. The clouds of
one key have to fit a task (16 bytes a particle).

Densities alone are not summed particle by particle where that would be much: the kernel is smooth, so that in boxes of two
kernel widths polynomials through a few hundred nodes stand for it to within ``PRECISION`` of its peak. Particles are dealt to
the nodes of their boxes, nodes meet nodes, and positions read theirs: work grows with the particles plus the positions.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DoubleType, StructType

from wakeline.functions.geo import EARTH_KM
from wakeline.functions.nulls import finite
from wakeline.sources.work import cut

SLICE, LARGEST = 4096, 65_536
#: Particles of a key for each position of a slice.
PER_POSITION = 16
#: Distances held at once.
BLOCK = 1 << 20
#: Places and positions that meet at once where clouds share places.
TILE = (8192, 16)
SHARED = {"min_distance_km", "density_score"}
#: Nodes along each side of a box, the width of a box in kernel widths, the distance in kernel widths beyond which the
#: kernel is below rounding, and what an interpolated density may be off by.
NODES, WIDTH, FAR, PRECISION = 20, 2.0, 9.0, 1e-12
#: Positions times particles from which densities are interpolated, and the widest kernel (km) and the most kinds of them.
MANY, WIDEST_KM, KINDS = 1 << 24, 500.0, 8
#: Powers of a chord's square that sum to the square of its angle, for chords of up to ``SHORT`` (squared).
SERIES, SHORT = tuple(2 / (n * n * math.comb(2 * n, n)) for n in range(1, 10)), 0.05
STATISTICS = ("min_distance_km", "p10_distance_km", "median_distance_km", "fraction_particles_2km", "fraction_particles_5km", "fraction_particles_10km", "density_score")


def _unit(lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    lon, lat = np.radians(lon), np.radians(lat)
    return np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)])


def distances_km(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Great-circle distances of all unit vectors of ``a`` to all of ``b``, from their chords."""
    chord = np.zeros((a.shape[1], b.shape[1]))
    for x, y in zip(a, b, strict=True):
        d = x[:, None] - y[None, :]
        d *= d
        chord += d
    np.sqrt(chord, out=chord)
    chord *= 0.5
    np.minimum(chord, 1.0, out=chord)
    np.arcsin(chord, out=chord)
    chord *= 2 * EARTH_KM
    return chord


def _quantiles(d: np.ndarray, weight: np.ndarray, shares: Sequence[float]) -> list[np.ndarray]:
    """Interpolated quantiles of each row, each column counting ``weight`` times."""
    if not shares:
        return []
    if (weight == 1).all():
        return list(np.quantile(d, shares, axis=1))
    order = np.argsort(d, axis=1)
    d, upto = np.take_along_axis(d, order, axis=1), np.cumsum(weight[order], axis=1)
    out = []
    for q in shares:
        place = q * (int(weight.sum()) - 1)
        low, high = (np.take_along_axis(d, (upto <= k).sum(axis=1)[:, None], axis=1)[:, 0] for k in (int(place), min(int(place) + 1, int(weight.sum()) - 1)))
        out.append(low + (high - low) * (place - int(place)))
    return out


def _statistics(d: np.ndarray, sigma: np.ndarray, wanted: Sequence[str], weight: np.ndarray) -> list[np.ndarray]:
    """``weight``: how many particles are at each place."""
    names = [c for c in ("p10_distance_km", "median_distance_km") if c in wanted]
    out = dict(zip(names, _quantiles(d, weight, [0.1 if c == "p10_distance_km" else 0.5 for c in names]), strict=True))
    n = weight.sum()
    if "min_distance_km" in wanted:
        out["min_distance_km"] = d.min(axis=1)
    for km in (2, 5, 10):
        if f"fraction_particles_{km}km" in wanted:
            out[f"fraction_particles_{km}km"] = (d <= km) @ weight / n
    if "density_score" in wanted:
        z = d / sigma[:, None]
        z *= z
        z *= -0.5
        out["density_score"] = np.exp(z, out=z) @ weight / n
    return [out[c] for c in wanted]


def _square_angles(chord: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Squares of the angles of chords, from the chords' squares."""
    if chord.max() <= SHORT:
        # Further terms are below rounding.
        terms = next((n for n in range(1, len(SERIES)) if SERIES[n] * chord.max() ** n < 1e-17), len(SERIES))
        room.fill(SERIES[terms - 1])
        for c in SERIES[terms - 2 :: -1] if terms > 1 else ():
            room *= chord
            room += c
        room *= chord
        return room
    np.sqrt(chord, out=room)
    room *= 0.5
    np.minimum(room, 1.0, out=room)
    np.arcsin(room, out=room)
    room *= 2.0
    room *= room
    return room


def shared_statistics(a: np.ndarray, b: np.ndarray, sigma: np.ndarray, weight: np.ndarray, wanted: Sequence[str]) -> dict[str, np.ndarray]:
    """Statistics (of ``SHARED``), a column for each cloud, of unit vectors ``a`` against the places ``b`` that clouds
    share; ``weight`` holds how many particles of each cloud (column) are at each place."""
    density, nearest = np.zeros((a.shape[1], weight.shape[1])), np.full((a.shape[1], weight.shape[1]), np.inf)
    wide, high = TILE
    scale = -0.5 * (EARTH_KM / sigma) ** 2
    one, two = np.empty((high, wide)), np.empty((high, wide))
    for p in range(0, b.shape[1], wide):
        there, w = b[:, p : p + wide], weight[p : p + wide]
        held = w > 0
        for k in range(0, a.shape[1], high):
            here = a[:, k : k + high]
            square, room = (x[: here.shape[1], : there.shape[1]] for x in (one, two))
            np.subtract(here[0][:, None], there[0], out=square)
            square *= square
            for axis in (1, 2):
                np.subtract(here[axis][:, None], there[axis], out=room)
                room *= room
                square += room
            if "min_distance_km" in wanted:
                for c in range(w.shape[1]):
                    if held[:, c].any():
                        least = (square if held[:, c].all() else square[:, held[:, c]]).min(axis=1)
                        np.minimum(nearest[k : k + high, c], least, out=nearest[k : k + high, c])
            if "density_score" in wanted:
                z = _square_angles(square, room)
                z *= scale[k : k + high, None]
                density[k : k + high] += np.exp(z, out=z) @ w
    chord = np.minimum(np.sqrt(nearest) * 0.5, 1.0)
    return {"density_score": density / weight.sum(axis=0), "min_distance_km": np.arcsin(chord) * (2 * EARTH_KM)}


def _kernel_sums(a: np.ndarray, b: np.ndarray, sigma: float, weight: np.ndarray | None) -> np.ndarray:
    """Sums of the kernel of unit vectors ``a`` over ``b``, weighted by each column of ``weight``, in blocks; without
    weights, the kernel itself."""
    scale = -0.5 * (EARTH_KM / sigma) ** 2
    out, (wide, high) = np.zeros((a.shape[1], b.shape[1] if weight is None else weight.shape[1])), TILE
    one, two = np.empty((high, wide)), np.empty((high, wide))
    for p in range(0, b.shape[1], wide):
        there = b[:, p : p + wide]
        for k in range(0, a.shape[1], high):
            here = a[:, k : k + high]
            square, room = (x[: here.shape[1], : there.shape[1]] for x in (one, two))
            np.subtract(here[0][:, None], there[0], out=square)
            square *= square
            for axis in (1, 2):
                np.subtract(here[axis][:, None], there[axis], out=room)
                room *= room
                square += room
            z = _square_angles(square, room)
            z *= scale
            np.exp(z, out=z)
            if weight is None:
                out[k : k + high, p : p + wide] = z
            else:
                out[k : k + high] += z @ weight[p : p + wide]
    return out


#: Chebyshev nodes, and what each counts in the barycentric formula.
_PLACES = np.cos(np.pi * (np.arange(NODES) + 0.5) / NODES)
_COUNTS = (-1.0) ** np.arange(NODES) * np.sin(np.pi * (np.arange(NODES) + 0.5) / NODES)


def _shares(u: np.ndarray) -> np.ndarray:
    """A row for each place in [-1, 1]: what each node's value counts for there."""
    d = u[:, None] - _PLACES
    hit = np.abs(d) < 1e-15
    w = _COUNTS / np.where(hit, 1.0, d)
    w /= w.sum(axis=1)[:, None]
    on = hit.any(axis=1)
    w[on] = hit[on]
    return w


def _box_nodes(box: tuple[int, int], size: float) -> np.ndarray:
    x, y = ((k + (_PLACES + 1.0) / 2.0) * size for k in box)
    return _unit(np.repeat(x, NODES), np.tile(y, NODES))


def _boxed(x: np.ndarray, y: np.ndarray, size: float) -> list[tuple[tuple[int, int], np.ndarray]]:
    """Boxes with the rows in them, in the rows' order."""
    i, j = np.floor(x / size).astype(np.int64), np.floor(y / size).astype(np.int64)
    order = np.lexsort((j, i))
    cuts = np.flatnonzero((np.diff(i[order]) != 0) | (np.diff(j[order]) != 0)) + 1
    return [((int(i[rows[0]]), int(j[rows[0]])), rows) for rows in np.split(order, cuts)] if len(x) else []


def interpolated_densities(lon: np.ndarray, lat: np.ndarray, x: np.ndarray, y: np.ndarray, many: np.ndarray, cloud: np.ndarray, clouds: int, sigma: float) -> np.ndarray:
    """Mean kernel (width ``sigma``, km) of each position (lon, lat: rows) over each cloud's particles (columns), ``many``
    at each place (x, y); ``cloud`` numbers the places' clouds in ascending order. Off by less than ``PRECISION``."""
    size, all_nodes = math.degrees(WIDTH * sigma / EARTH_KM), NODES * NODES
    within = lambda c, k: _shares((c / size - k) * 2.0 - 1.0)
    # Boxes of few places keep these, others hold nodes.
    boxes, held = _boxed(x, y, size), []
    middles = _unit(*(np.array([(box[k] + 0.5) * size for box, _ in boxes]) for k in (0, 1)))
    for box, rows in boxes:
        if len(rows) <= all_nodes:
            weight = np.zeros((len(rows), clouds))
            weight[np.arange(len(rows)), cloud[rows]] = many[rows]
            held.append((_unit(x[rows], y[rows]), weight))
            continue
        weight = np.zeros((clouds, NODES, NODES))
        for k in range(0, len(rows), TILE[0]):
            part = rows[k : k + TILE[0]]
            east, north = within(x[part], box[0]) * many[part][:, None], within(y[part], box[1])
            cuts = np.flatnonzero(np.diff(cloud[part], prepend=-1, append=-1))
            for first, end in zip(cuts[:-1], cuts[1:], strict=True):
                weight[cloud[part[first]]] += east[first:end].T @ north[first:end]
        held.append((None, weight.reshape(clouds, all_nodes).T))
    out = np.zeros((len(lon), clouds))
    # Half the diagonals of two boxes count too.
    reach = (FAR + WIDTH * math.sqrt(2.0)) * sigma
    dense, between = {}, {}
    for box, rows in _boxed(lon, lat, size):
        middle = _unit(*(np.array([(k + 0.5) * size]) for k in box))
        near = np.flatnonzero(distances_km(middle, middles)[0] <= reach)
        sums, own = np.zeros((min(len(rows), all_nodes), clouds)), len(rows) <= all_nodes
        here = _unit(lon[rows], lat[rows]) if own else _box_nodes(box, size)
        direct = [k for k in near if own or held[k][0] is not None]
        if direct:
            there = [_box_nodes(boxes[k][0], size) if held[k][0] is None else held[k][0] for k in direct]
            sums += _kernel_sums(here, np.concatenate(there, axis=1), sigma, np.concatenate([held[k][1] for k in direct]))
        if own:
            out[rows] = sums
            continue
        dense[box] = rows, sums
        for k in near:
            if held[k][0] is None:
                (i, j), (u, v) = box, boxes[k][0]
                between.setdefault((abs(u - i), j, v), []).append((box, k))
    # Boxes of two rows that lie as far apart east have one matrix, those as far apart west its mirror image.
    for (apart, j, v), pairs in between.items():
        matrix = _kernel_sums(_box_nodes((0, j), size), _box_nodes((apart, v), size), sigma, None)
        mirror = matrix.reshape([NODES] * 4)[::-1, :, ::-1].reshape(matrix.shape)
        for box, k in pairs:
            dense[box][1][:] += (matrix if boxes[k][0][0] >= box[0] else mirror) @ held[k][1]
    for box, (rows, sums) in dense.items():
        for k in range(0, len(rows), TILE[0]):
            part = rows[k : k + TILE[0]]
            share = within(lon[part], box[0])[:, :, None] * within(lat[part], box[1])[:, None, :]
            out[part] = share.reshape(len(part), all_nodes) @ sums
    # Rounding may leave what is nothing just below 0.
    return np.maximum(out, 0.0) / np.bincount(cloud, many, clouds)


def against_clouds(positions: DataFrame, particles: DataFrame, on: Sequence[str], sigma: str, cloud_keys: Sequence[str] = (), wanted: Sequence[str] = STATISTICS, by: Sequence[str] = ()) -> DataFrame:
    """``positions`` (with lon, lat and the column ``sigma``) once for each cloud of ``on`` and ``cloud_keys``, with
    statistics of its distances to the particles (p_lon, p_lat). Particles that are not finite do not count; a position
    without a cloud gives no row, one without finite coordinates gives nulls. Rows are dealt to tasks ``by`` columns of the
    positions, if given, while a position's clouds are still one row."""
    on, own = list(on), positions.columns
    carried = [c for c in own if c not in on]
    of = StructType([particles.schema[c] for c in cloud_keys])
    for c in wanted:
        of = of.add(c, DoubleType())
    schema = StructType([*(positions.schema[c] for c in on), *(positions.schema[c] for c in carried)]).add("_of", ArrayType(of))
    of_type = to_arrow_type(of)
    held = cut(positions, "positions")
    own_points = particles.filter(finite(F.col("p_lon"), F.col("p_lat"))).select(*on, *cloud_keys, F.col("p_lon").cast("double").alias("_x"), F.col("p_lat").cast("double").alias("_y"))
    # Particles at one place are one row, however many there are.
    points = cut(own_points.groupBy(*on, *cloud_keys, "_x", "_y").agg(F.count("*").alias("_m")), "clouds")
    sizes = points.groupBy(*on).agg(F.count("*").alias("_size"))
    slice_ = F.least(F.lit(LARGEST), F.greatest(F.lit(SLICE), F.col("_size") / PER_POSITION))
    counts = held.groupBy(*on).agg(F.count("*").alias("_n")).join(sizes, on).select(*on, F.ceil(F.col("_n") / slice_).alias("_slices"))
    slices = held.join(counts, on).withColumn("_slice", F.pmod(F.xxhash64(*own), F.col("_slices"))).drop("_slices")
    clouds = points.join(counts, on).withColumn("_slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_slices") - 1))).drop("_slices")

    def score(rows: pa.Table, cloud: pa.Table) -> pa.Table:
        column = lambda c: rows.column(c).to_numpy().astype(float)
        x, y, s = column("lon"), column("lat"), column(sigma)
        ok = np.isfinite(x) & np.isfinite(y)
        here = _unit(np.where(ok, x, 0), np.where(ok, y, 0))
        all_there = _unit(cloud.column("_x").to_numpy(), cloud.column("_y").to_numpy())
        many = cloud.column("_m").to_numpy().astype(float)
        code = np.zeros(len(cloud), np.int64)
        for k in cloud_keys:
            own = cloud.column(k).combine_chunks().dictionary_encode()
            code = code * (len(own.dictionary) + 1) + own.indices.fill_null(len(own.dictionary)).to_numpy()
        order = np.argsort(code, kind="stable")
        edges = np.flatnonzero(np.diff(code[order], prepend=-1, append=-1)) if len(rows) and len(code) else np.zeros(0, int)
        out, shared = [], None
        kinds = np.unique(s[ok])
        if set(wanted) == {"density_score"} and len(edges) > 1 and len(x) * len(code) >= MANY and 1 <= len(kinds) <= KINDS and kinds[0] > 0 and kinds[-1] <= WIDEST_KM:
            number = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
            px, py = (cloud.column(c).to_numpy()[order] for c in ("_x", "_y"))
            density = np.zeros((len(x), len(edges) - 1))
            for kind in kinds:
                own_rows = np.flatnonzero(ok & (s == kind))
                density[own_rows] = interpolated_densities(x[own_rows], y[own_rows], px, py, many[order], number, len(edges) - 1, float(kind))
            shared = {"density_score": density}
        elif len(edges) > 2 and set(wanted) <= SHARED:
            places, at = np.unique(cloud.column("_x").to_numpy() + 1j * cloud.column("_y").to_numpy(), return_inverse=True)
            if len(places) * (len(edges) - 1) <= 8 * len(cloud):
                spread = np.zeros((len(places), len(edges) - 1))
                np.add.at(spread, (at[order], np.repeat(np.arange(len(edges) - 1), np.diff(edges))), many[order])
                shared = shared_statistics(here, _unit(places.real, places.imag), s, spread, wanted)
        for n, (first, end) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            if shared:
                out.append([shared[c][:, n] for c in wanted])
                continue
            there, weight = all_there[:, order[first:end]], many[order[first:end]]
            step = max(1, BLOCK // there.shape[1])
            parts = [_statistics(distances_km(here[:, k : k + step], there), s[k : k + step], wanted, weight) for k in range(0, len(x), step)]
            out.append([np.concatenate(p) for p in zip(*parts, strict=True)])
        # The clouds of a position lie next to each other.
        which = pa.array(np.tile(order[edges[:-1]], len(rows)) if out else np.zeros(0, np.int64))
        values = [pa.array(np.stack(f, axis=1).ravel(), mask=np.repeat(~ok, len(out))) for f in zip(*out, strict=True)] if out else [pa.array([], pa.float64()) for _ in wanted]
        fields = [*(cloud.column(k).take(which).combine_chunks().cast(of_type.field(k).type) for k in cloud_keys), *values]
        ends = pa.array(np.arange(len(rows) + 1) * len(out), pa.int32())
        found = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(fields, fields=list(of_type)))
        return pa.table([*(rows.column(k) for k in on), *(rows.column(c) for c in carried), found], schema.names)

    met = slices.groupBy(*on, "_slice").cogroup(clouds.groupBy(*on, "_slice")).applyInArrow(score, schema)
    if by:
        met = met.repartition(int(met.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)
    return met.select(*on, *carried, F.inline("_of")).select(*on, *cloud_keys, *carried, *wanted)

"""Gridded fields as a data source: chunked arrays in the Zarr format (version 2), one task a chunk.

A grid is a folder with an array for each variable and each axis; a variable's array is cut into chunks of one shape, a
file each, and a chunk that holds nothing has no file. ``read_grid`` gives a row for each cell. Comparisons of an axis
with a value reach the source, which plans a task only for chunks whose coordinates can pass, and Spark applies them again
to the cells. Chunks and axes are read with Arrow's file systems, wherever they are.
"""

from __future__ import annotations

import itertools
import json
import zlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import DoubleType, LongType, StringType, StructType

from wakeline.sources import files

PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
#: Whether any coordinate from ``low`` to ``high`` can pass a filter.
CAN_PASS = {
    GreaterThan: lambda low, high, x: high > x,
    GreaterThanOrEqual: lambda low, high, x: high >= x,
    LessThan: lambda low, high, x: low < x,
    LessThanOrEqual: lambda low, high, x: low <= x,
    EqualTo: lambda low, high, x: low <= x <= high,
    In: lambda low, high, x: any(low <= y <= high for y in x),
}


@dataclass(frozen=True)
class Axis:
    """A regular axis: its coordinates, all whole numbers or not, and how many of them a chunk has."""

    name: str
    start: float
    step: float
    size: int
    chunk: int

    def values(self) -> np.ndarray:
        whole = float(self.start).is_integer() and float(self.step).is_integer()
        return (self.start + self.step * np.arange(self.size)).astype("<i8" if whole else "<f8")


def _array(shape: Sequence[int], chunks: Sequence[int], kind: str, axes: Sequence[str]) -> dict[str, str]:
    fill = 0 if kind == "<i8" else "NaN"
    meta = {
        "zarr_format": 2,
        "shape": list(shape),
        "chunks": list(chunks),
        "dtype": kind,
        "order": "C",
        "fill_value": fill,
        "filters": None,
        "compressor": {"id": "zlib", "level": 1},
    }
    return {".zarray": json.dumps(meta), ".zattrs": json.dumps({"_ARRAY_DIMENSIONS": list(axes)})}


def _store(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path)


def _read(path: str, name: str) -> bytes | None:
    store, base = _store(path)
    if store.get_file_info(f"{base}/{name}").type == pyarrow.fs.FileType.NotFound:
        return None
    with store.open_input_file(f"{base}/{name}") as file:
        return file.read()


def write_grid(cells: DataFrame, path: str, axes: Sequence[Axis], variables: Sequence[str]) -> int:
    """Writes cells (i_<axis>: place on each axis; the variables) and returns how many chunks have any.

    A cell may come once; null is no value; places off the axes are left out. A chunk is one task's rows, so its size is bounded by its shape.
    """
    spark, names = cells.sparkSession, [a.name for a in axes]
    shape, chunks = [a.size for a in axes], [a.chunk for a in axes]
    files.put_bytes(spark, f"{path}/.zgroup", json.dumps({"zarr_format": 2}).encode())
    for a in axes:
        values = a.values()
        for name, text in _array([a.size], [a.size], values.dtype.str, [a.name]).items():
            files.put_bytes(spark, f"{path}/{a.name}/{name}", text.encode())
        files.put_bytes(spark, f"{path}/{a.name}/0", zlib.compress(values.tobytes(), 1))
    for v in variables:
        for name, text in _array(shape, chunks, "<f8", names).items():
            files.put_bytes(spark, f"{path}/{v}/{name}", text.encode())
    placed = cells
    for a in axes:
        placed = placed.filter(F.col(f"i_{a.name}").between(0, a.size - 1))
    which_chunk = [F.floor(F.col(f"i_{a.name}") / a.chunk).alias(f"c_{a.name}") for a in axes]
    keyed = placed.select(*which_chunk, *(F.col(f"i_{n}").cast("long") for n in names), *(F.col(v).cast("double") for v in variables))

    def chunk(rows: pa.Table) -> pa.Table:
        which = [rows.column(f"c_{n}")[0].as_py() for n in names]
        at = tuple(rows.column(f"i_{n}").to_numpy() - c * a.chunk for n, c, a in zip(names, which, axes, strict=True))
        if len(np.unique(np.ravel_multi_index(at, chunks))) < len(rows):
            raise ValueError("a cell comes more than once")
        store, base = _store(path)
        for v in variables:
            block = np.full(chunks, np.nan)
            block[at] = rows.column(v).to_numpy()
            with store.open_output_stream(f"{base}/{v}/{'.'.join(map(str, which))}", compression=None) as out:
                out.write(zlib.compress(block.astype("<f8").tobytes(), 1))
        return pa.table({"n": pa.array([len(rows)])})

    return keyed.groupBy(*(f"c_{n}" for n in names)).applyInArrow(chunk, "n long").count()


@dataclass
class Chunk(InputPartition):
    place: tuple[int, ...]


class GridReader(DataSourceReader):
    def __init__(self, path: str, axes: dict[str, np.ndarray], chunks: list[int], variables: list[str], schema: StructType) -> None:
        self.path, self.axes, self.chunks, self.variables, self.schema = path, axes, chunks, variables, schema
        self.wanted: list[tuple[str, Filter]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Narrows the chunks; every filter is given back, for Spark to apply to cells."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in self.axes and type(f) in CAN_PASS:
                self.wanted.append((name, f))
            yield f

    def partitions(self) -> Sequence[InputPartition]:
        kept = []
        for (name, values), size in zip(self.axes.items(), self.chunks, strict=True):
            parts = [values[k : k + size] for k in range(0, len(values), size)]
            tests = [f for n, f in self.wanted if n == name]
            kept.append([k for k, v in enumerate(parts) if all(CAN_PASS[type(f)](v.min(), v.max(), f.value) for f in tests)])
        return [Chunk(place) for place in itertools.product(*kept)]

    def read(self, partition: Chunk | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no chunk is left
            return
        own = [v[k * size : (k + 1) * size] for v, k, size in zip(self.axes.values(), partition.place, self.chunks, strict=True)]
        name, inside = ".".join(map(str, partition.place)), tuple(slice(0, len(v)) for v in own)
        blocks = []
        for v in self.variables:
            data = _read(self.path, f"{v}/{name}")
            full = np.frombuffer(zlib.decompress(data), "<f8").reshape(self.chunks) if data else np.full(self.chunks, np.nan)
            blocks.append(full[inside].ravel())
        held = np.flatnonzero(~np.isnan(blocks).all(axis=0))
        at = np.unravel_index(held, [len(v) for v in own])
        columns = [pa.array(v[i]) for v, i in zip(own, at, strict=True)]
        columns += [pa.array(b[held], from_pandas=True) for b in blocks]
        columns.append(pa.array([name] * len(held), pa.string()))
        yield pa.RecordBatch.from_arrays(columns, self.schema.names)


class Grid(DataSource):
    """``spark.read.format("grid").load(path)``: the axes, the variables and ``chunk``, the name of each cell's chunk.

    A cell in which no variable has a value has no row; NaN is null."""

    @classmethod
    def name(cls) -> str:
        return "grid"

    def _meta(self) -> tuple[dict[str, np.ndarray], list[int], list[str]]:
        path = self.options["path"]
        store, base = _store(path)
        found = {}
        for info in store.get_file_info(pyarrow.fs.FileSelector(base)):
            if info.type == pyarrow.fs.FileType.Directory:
                meta, attributes = (_read(path, f"{info.base_name}/{x}") for x in (".zarray", ".zattrs"))
                found[info.base_name] = (json.loads(meta), json.loads(attributes)["_ARRAY_DIMENSIONS"])
        variables = sorted(n for n, (_, dims) in found.items() if dims != [n])
        shapes = {json.dumps((found[v][0]["chunks"], found[v][0]["shape"], found[v][1])) for v in variables}
        if len(shapes) != 1:
            raise ValueError("the variables of a grid have one shape")
        dims = found[variables[0]][1]
        axes = {n: np.frombuffer(zlib.decompress(_read(path, f"{n}/0")), found[n][0]["dtype"]) for n in dims}
        return axes, found[variables[0]][0]["chunks"], variables

    def schema(self) -> StructType:
        axes, _, variables = self._meta()
        out = StructType()
        for n, v in axes.items():
            out = out.add(n, LongType() if v.dtype.kind == "i" else DoubleType())
        for v in variables:
            out = out.add(v, DoubleType())
        return out.add("chunk", StringType())

    def reader(self, schema: StructType) -> GridReader:
        return GridReader(self.options["path"], *self._meta(), schema)


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(Grid)
    return spark.read.format("grid").load(path)


def sample_grid(points: DataFrame, cells: DataFrame, axes: Sequence[Axis], variables: Sequence[str], key: str = "id") -> DataFrame:
    """(key, *variables): linear interpolation at points, which have a column for each axis; keys are unique.

    A point meets only the corners of its cell, by their places. Null where a corner that counts has no value or lies
    outside, or a coordinate is null.
    """
    corners = points.select(F.col(key).alias("_k"), F.lit(1.0).alias("_w"), *(F.col(a.name).alias(f"_v_{a.name}") for a in axes))
    for a in axes:
        at = (F.col(f"_v_{a.name}") - a.start) / F.lit(float(a.step))
        part = at - F.floor(at)
        sides = F.array(F.struct(F.floor(at).alias("i"), (1 - part).alias("w")), F.struct((F.floor(at) + 1).alias("i"), part.alias("w")))
        corners = corners.withColumn("_s", F.explode(F.filter(sides, lambda s: s["w"] > 0)))
        corners = corners.withColumns({f"_i_{a.name}": F.col("_s.i"), "_w": F.col("_w") * F.col("_s.w")}).drop("_s")
    place = [F.round((F.col(a.name) - a.start) / F.lit(float(a.step))).cast("long").alias(f"_i_{a.name}") for a in axes]
    met = corners.join(cells.select(*place, *variables), [f"_i_{a.name}" for a in axes], "left")
    whole = lambda v: F.when(F.count("*") == F.count(v), F.sum(F.col("_w") * F.col(v)))
    out = met.groupBy(F.col("_k").alias(key)).agg(*(whole(v).alias(v) for v in variables))
    return points.select(key).join(out, key, "left")

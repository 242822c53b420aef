"""Helpers shared by the text operators: batch walking, settled tasks."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable, Iterator
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.sources.work import cut, work_dir  # noqa: F401

#: Characters that are looked at together.
TEXT_CHUNK = 1 << 19

#: Keys that ``spread_join`` broadcasts at most.
HEAVY = 10_000

T = TypeVar("T")
Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


#: What a Python worker keeps from task to task, and whether the task at hand has asked for it.
_kept: dict = {}
_asked = [False]


def kept(key: Hashable, make: Callable[[], T]) -> T:
    """What ``make`` gives, made once by a worker and kept for its next tasks: one thing at a time, until a task of
    another kind ends."""
    _asked[0] = True
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def give_back() -> None:
    """Hands freed memory back to the system: Python workers live on after a task."""
    if not _asked[0]:
        _kept.clear()
    _asked[0] = False
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def settled(run: Run) -> Run:
    """``run`` for ``mapInArrow``, giving memory back when its task ends."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return inner


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def crc_of_id(id_col: Column) -> Column:
    """crc32 of the id written as text: the split hash of the held-out rows. A null id has 0."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")), F.lit(0).cast("long"))


def text_of(column: str = "text") -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns that an operator needs, under fixed names, so that no other column can clash."""
    return df.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(text_col).alias("text"))


def spread_join(rows: DataFrame, one: DataFrame, on: list[str], size: str) -> DataFrame:
    """``rows`` joined with ``one``, which has a row for each key and, in ``size``, at least how many of ``rows`` have that key.

    Keys with more than one in ``HEAVY`` of the sum of sizes are joined by broadcast and their rows stay where they are;
    there are fewer than ``HEAVY`` such keys whatever the data. What is left has no heavy key and is joined by its keys.
    ``one`` is read more than once and should be a written table.
    """
    least = (one.agg(F.sum(size)).first()[0] or 0) // HEAVY
    heavy = F.broadcast(one.filter(F.col(size) > least))
    light = one.filter(F.col(size) <= least)
    return rows.join(heavy, on).unionByName(rows.join(heavy.select(on), on, "left_anti").join(light, on))


def chunks(texts: list[str], limit: int = TEXT_CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about ``limit`` characters; a longer text is a range of its own."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > limit:
            yield start, i
            start, held = i, 0
        held += len(text)
    if start < len(texts):
        yield start, len(texts)


def strings(batch: pa.RecordBatch, name: str) -> list[str]:
    return [x if x is not None else "" for x in batch.column(name).to_pylist()]

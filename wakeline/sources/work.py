"""The shared work folder, and tables written there to end a lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Lists that ``cut`` adds its tables to, of the scopes that this thread is in.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def work_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (``spark.checkpoint.dir``).

    Only a single-machine session that names none gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="wakeline-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: the lineage ends there."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/wakeline/{name}-{uuid.uuid4().hex}"
    for held in _scopes.get():
        held.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def tables_written() -> Iterator[list[str]]:
    """Collects the paths of the tables that ``cut`` writes inside, for ``remove`` when no DataFrame needs them any more."""
    held: list[str] = []
    before = _scopes.set((*_scopes.get(), held))
    try:
        yield held
    finally:
        _scopes.reset(before)


def unread(tables: Iterable[str], df: DataFrame) -> list[str]:
    """Those of ``tables`` that ``df`` does not read."""
    plain = lambda path: "/" + path.split(":", 1)[-1].lstrip("/")
    files = [plain(f) for f in df.inputFiles()]
    return [t for t in tables if not any(f.startswith(plain(t) + "/") for f in files)]


def remove(spark: SparkSession, paths: Iterable[str]) -> None:
    """Deletes tables of the work folder."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)

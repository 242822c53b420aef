"""Writers: tables, GeoJSON, nested JSON, Markdown, lineage manifests, write-once protection."""

from __future__ import annotations

import json
import platform
import time
from collections.abc import Iterable, Sequence
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from wakeline.operators.tables import top_n
from wakeline.sources import files


def write_once(df: DataFrame, path: str, kind: str = "parquet", frozen: Sequence[str] = (), **options) -> str:
    """Writes a table to a path that must not exist yet and must not lie under a frozen folder."""
    if any(path.rstrip("/") == f.rstrip("/") or path.startswith(f.rstrip("/") + "/") for f in frozen):
        raise PermissionError(f"frozen: {path}")
    df.write.mode("errorifexists").options(**options).format(kind).save(path)
    return path


def features(df: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """A row for each row: ``feature``, a GeoJSON point with the other columns as properties."""
    others = [c for c in df.columns if c not in (lon, lat)]
    geometry = F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*others).alias("properties"))).alias("feature"))


def write_feature_lines(df: DataFrame, path: str, **kw) -> str:
    """GeoJSON features, one a line, in as many part files as the table has partitions: for tables of any size."""
    features(df, **kw).write.text(path)
    return path


def write_feature_collection(df: DataFrame, path: str, **kw) -> str:
    """One GeoJSON document, for reports that one file has to hold; rows pass through the driver one partition at a time."""
    lines = [r.feature for r in features(df, **kw).toLocalIterator()]
    return files.put_bytes(df.sparkSession, path, ('{"type":"FeatureCollection","features":[' + ",".join(lines) + "]}").encode())


def compact(df: DataFrame, digits: int = 4) -> DataFrame:
    """Fractions rounded, NaN as null."""
    fine = lambda c: F.round(F.when(~F.isnan(c), F.col(c)), digits).alias(c)
    return df.select(*(fine(f.name) if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f.name) for f in df.schema))


def summary_json(suspects: DataFrame, n: int, *columns: str) -> DataFrame:
    """(cluster_id, summary): the first ``n`` suspects of each event as a JSON text, by rank."""
    best = top_n(compact(suspects), n, ["cluster_id"], F.col("suspect_rank"))
    listed = F.array_sort(F.collect_list(F.struct("suspect_rank", *(c for c in columns if c != "suspect_rank"))))
    return best.groupBy("cluster_id").agg(F.count("*").alias("n"), listed.alias("top")).select("cluster_id", F.to_json(F.struct("cluster_id", "n", "top")).alias("summary"))


def frame_maps(positions: DataFrame, frames: str, most: int, seed: int = 0) -> DataFrame:
    """(mmsi, frames): a JSON map of frame to [lon, lat] of at most ``most`` frames of each entity, sampled by hash: the
    sampling is the feature."""
    order = F.md5(F.concat_ws("-", F.col("mmsi").cast("string"), F.col(frames).cast("string"), F.lit(str(seed))).cast("binary"))
    kept = top_n(compact(positions), most, ["mmsi"], order, F.col(frames))
    entry = F.struct(F.col(frames).cast("string").alias("k"), F.array("lon", "lat").alias("v"))
    return kept.groupBy("mmsi").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry)))).alias("frames"))


def markdown(df: DataFrame, columns: Iterable[str], digits: int = 2) -> str:
    """A report table of the columns that exist, for tables that a page holds."""
    kept = [c for c in columns if c in df.columns]
    cell = lambda x: "" if x is None else f"{x:.{digits}f}" if isinstance(x, float) else str(x)
    rows = [[cell(r[c]) for c in kept] for r in df.select(*kept).toLocalIterator()]
    return "\n".join("| " + " | ".join(r) + " |" for r in [kept, ["---"] * len(kept), *rows])


def write_headered(df: DataFrame, path: str) -> str:
    """Plain text with a header line in each part file."""
    df.write.option("header", "true").option("sep", "\t").csv(path)
    return path


def latest(known: DataFrame, new: DataFrame, key: str, stamp: str) -> DataFrame:
    """A manifest with new records put in: the latest of each key, the new one of ties."""
    both = known.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return top_n(both, 1, [key], F.desc(stamp), F.desc("_new")).drop("_new")


def hashes(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, sha256) of every file under the paths, hashed where it is read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
    return found.select("path", F.sha2("content", 256).alias("sha256"))


class Stage:
    """Lineage of a stage: parameters, hashes of inputs and outputs, time, outcome, written as JSON when it ends.

    ``with Stage(spark, folder, "scoring", {...}, inputs) as stage: stage.output(path)``. A failure is recorded and raised.
    """

    def __init__(self, spark: SparkSession, folder: str, name: str, params: dict | None = None, inputs: Sequence[str] = ()) -> None:
        self.spark, self.path, self.name, self.params = spark, f"{folder.rstrip('/')}/{name}.manifest.json", name, params or {}
        self.inputs, self.outputs, self.notes = list(inputs), [], {}

    def output(self, path: str) -> str:
        self.outputs.append(path)
        return path

    def __enter__(self) -> Stage:
        self.began = time.time()
        return self

    def __exit__(self, kind, error, trace) -> bool:
        hashed = lambda paths: {r.path: r.sha256 for r in hashes(self.spark, *paths).toLocalIterator()} if paths else {}
        there = [p for p in self.outputs if files.exists(self.spark, p)]
        record = {
            "stage": self.name, "status": "failed" if kind else "ok", "error": repr(error) if error else None, "finished_utc": datetime.now(UTC).isoformat(), "seconds": round(time.time() - self.began, 2),
            "params": self.params, "notes": self.notes, "inputs": hashed(self.inputs), "outputs": hashed(there), "env": {"python": platform.python_version(), "spark": self.spark.version},
        }
        files.put_bytes(self.spark, self.path, json.dumps(record, indent=1, default=str).encode())
        return False



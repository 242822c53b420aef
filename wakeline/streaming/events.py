"""Streaming forms of windows, joins and duplicate removal on report streams (mmsi, ts, ...).

Each takes a streaming DataFrame and returns one; ``settle`` runs a stream over what its source has and returns the rows it
gave out. All of them append: a window's row comes once, when the watermark has passed the window's end, and its state
goes then, so that state is bounded by the rows of the last ``late`` before the newest. Rows behind the watermark are
dropped, and windows that it has not passed are still open, which is the feature; ``settle`` can end a stream, which closes them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.sources.work import work_dir
from wakeline.streaming.silence import STORE


def sliding_counts(reports: DataFrame, width: str = "6 hours", step: str = "1 hour", late: str = "1 hour") -> DataFrame:
    w = F.window("ts", width, step)
    return reports.withWatermark("ts", late).groupBy(w.alias("w"), "mmsi").agg(F.count("*").alias("n")).select("mmsi", F.unix_micros("w.start").alias("start_us"), "n")


def hourly(reports: DataFrame, late: str = "1 hour") -> DataFrame:
    """Tumbling hours: rows and mean value."""
    out = reports.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return out.select(F.unix_micros("w.start").alias("start_us"), "n", "mean")


def sessions(reports: DataFrame, gap: str = "60 minutes", late: str = "1 hour") -> DataFrame:
    """Stretches of each entity's track without a gap."""
    out = reports.withWatermark("ts", late).groupBy("mmsi", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select("mmsi", F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), "n")


def within(left: DataFrame, right: DataFrame, minutes: int, late: str = "1 hour") -> DataFrame:
    """Pairs of reports of one entity at most so many minutes apart: ``left`` (mmsi, ts, id), ``right`` (mmsi, ts, id).
    Watermarks and the interval let Spark drop what can no longer meet."""
    a = left.withWatermark("ts", late).select(F.col("mmsi"), F.col("ts").alias("a_ts"), F.col("id").alias("a"))
    b = right.withWatermark("ts", late).select(F.col("mmsi").alias("b_mmsi"), F.col("ts").alias("b_ts"), F.col("id").alias("b"))
    near = F.expr(f"mmsi = b_mmsi AND b_ts BETWEEN a_ts - INTERVAL {minutes} MINUTES AND a_ts + INTERVAL {minutes} MINUTES")
    return a.join(b, near).select("mmsi", "a", "b")


def without_repeats(reports: DataFrame, *keys: str, late: str = "1 hour") -> DataFrame:
    """The first report of each key while its watermark lasts."""
    return reports.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys))


def settle(stream: DataFrame, end: Callable[[], None] | None = None) -> DataFrame:
    """Runs the stream over all that its source has, in append mode: every row that it gave out.

    ``end`` adds to the source what lets the watermark pass all windows that are open then; the stream goes on from where
    it was and gives these out too, so that the result is whole.
    """
    spark = stream.sparkSession
    spark.conf.set(*STORE)
    base = f"{work_dir(spark)}/wakeline/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).outputMode("append").format("parquet").option("path", f"{base}/out")
    writer.start().awaitTermination()
    if end is not None:
        end()
        writer.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")

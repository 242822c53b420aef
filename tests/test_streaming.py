"""Streams in several batches, with rows in no order and rows that come too late."""

import random

import pytest
from pyspark.sql import functions as F

from wakeline.streaming import events, silence

MINUTE = 60_000_000
SCHEMA = "mmsi string, us long, id long"


def batches(seed):
    """Reports in six batches; each batch begins before the last one ends."""
    pick = random.Random(seed)
    out, n = [], 0
    for b in range(6):
        rows = []
        for _ in range(40):
            n += 1
            rows.append((f"m{pick.randint(0, 5)}", (b * 600 + pick.randint(0, 900)) * MINUTE + pick.randint(1, 30_000_000), n))
        out.append(rows)
    out[1].append(("early", 5 * MINUTE + 1, 1000))
    out[2].append((None, 1300 * MINUTE, 1001))
    out[2].append(("m1", None, 1002))
    out[3] += [out[3][0], (*out[3][0][:2], 1)]  # a repeated row, and another id at the same time
    out[4].append(("early", 2000 * MINUTE + 7, 1003))
    return out


def by_hand(found, gap, late):
    """A batch drops rows behind the watermark that the batch before it told silences by; what the last one passes is told."""
    behind, watermark, newest, kept = None, None, None, {}
    for rows in found:
        for m, us, i in rows:
            if m is None or us is None:
                continue
            newest_here = us if newest is None else max(newest, us)
            if behind is None or us > behind:
                kept.setdefault(m, {}).setdefault(us, []).append(i)
            newest = newest_here
        behind, watermark = watermark, newest // 1000 * 1000 - late
    out = set()
    for m, times in kept.items():
        order = sorted(times)
        for us, after in zip(order, [*order[1:], None], strict=True):
            if (after is None or after > us + gap) and us + gap <= watermark:
                out.add((m, us, min(times[us]), us + gap))
    return out


def as_stream(spark, folder, found, files):
    for k, rows in enumerate(found):
        df = spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_micros("us")).drop("us")
        df.coalesce(1).write.mode("append").parquet(f"{folder}/{'all' if files else k}")
    reader = spark.readStream.schema("mmsi string, id long, ts timestamp").option("maxFilesPerTrigger", 1)
    return reader.parquet(f"{folder}/all")


@pytest.mark.parametrize("seed", [1, 2])
def test_silences_over_batches(spark, tmp_path, seed):
    found = batches(seed)
    got = events.settle(silence.silences(as_stream(spark, tmp_path, found, True), 2.0, "30 minutes")).collect()
    want = by_hand(found, 120 * MINUTE, 30 * MINUTE)
    assert ({tuple(r) for r in got} - want, want - {tuple(r) for r in got}) == (set(), set()) and len(got) == len(want)
    for r in got:
        assert r.silent_us - r.last_us == 120 * MINUTE
    dropped = by_hand([[r for b in found for r in b]], 120 * MINUTE, 30 * MINUTE)
    assert dropped != want  # some rows came too late


def test_state_does_not_grow_with_the_stream(spark, tmp_path):
    rows = [[(f"m{k}", (b * 1000 + k) * MINUTE, b * 100 + k) for k in range(20)] for b in range(8)]
    stream = silence.silences(as_stream(spark, tmp_path / "in", rows, True), 2.0, "30 minutes")
    spark.conf.set(*silence.STORE)
    query = stream.writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).outputMode("append").format("noop").start()
    query.awaitTermination()
    held = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    assert len(held) >= 8 and max(held[2:]) <= max(held[:2]) * 1.5


def test_windows_come_once(spark, tmp_path):
    rows = [[("m", (b * 60 + k) * MINUTE, b * 10 + k) for k in range(3)] for b in range(5)]
    got = events.settle(events.hourly(as_stream(spark, tmp_path, rows, True).withColumn("value", F.lit(1.0)), "10 minutes")).collect()
    assert sorted((r.start_us // MINUTE, r.n) for r in got) == [(0, 3), (60, 3), (120, 3)]


def test_an_ended_stream_tells_its_last_windows(spark, tmp_path):
    rows = [[("m", (b * 60 + k) * MINUTE, b * 10 + k) for k in range(3)] for b in range(5)]
    reports = as_stream(spark, tmp_path, rows, True)

    def end():
        last = spark.createDataFrame([(None, None, 10**6 * MINUTE)], SCHEMA.replace("us long, id long", "id long, us long"))
        last.withColumn("ts", F.timestamp_micros("us")).drop("us").write.mode("append").parquet(f"{tmp_path}/all")

    got = events.settle(events.hourly(reports.withColumn("value", F.lit(1.0)), "10 minutes"), end).collect()
    assert sorted((r.start_us // MINUTE, r.n) for r in got) == [(60 * k, 3) for k in range(5)]
    got = events.settle(events.sessions(as_stream(spark, tmp_path / "again", rows, True), late="10 minutes"), lambda: None).collect()
    assert sum(r.n for r in got) < 15  # nothing more came


@pytest.mark.parametrize("name", ["stream_sliding", "stream_hourly", "stream_sessions"])
def test_stream_queries_count_every_report(spark, name):
    import __spark_entry__ as e

    times = 6 if name == "stream_sliding" else 1
    got = e.queries()[name](spark, "/root/testdata/sf0.001")
    assert got.agg(F.sum("n")).first()[0] == times * spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()

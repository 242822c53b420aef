"""Entities that fall silent, as a stream: per-entity state, event-time timers, append output."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Where timers and lists of state are kept; Spark's default store has neither.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
RESULT = "mmsi string, last_us long, id long, silent_us long"


class Silence(StatefulProcessor):
    """Holds an entity's reports until the watermark is ``gap_us`` past them, then tells of each that none followed.

    A report is judged only when everything that could follow it in time has come or is too late to count, so that the
    order in which reports come and how they fall into batches do not matter. The state of an entity is its reports of
    the last ``gap_us`` before the watermark and those after it; a silent entity has none.
    """

    def __init__(self, gap_us: int) -> None:
        self.gap_us = gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.reports = handle.getListState("reports", "us long, id long")

    def _due_ms(self, us: int) -> int:
        return -(-(us + self.gap_us) // 1000)

    def _keep(self, reports: list[tuple[int, int]]) -> None:
        if reports:
            self.reports.put(reports)
            self.handle.registerTimer(self._due_ms(reports[0][0]))
        else:
            self.reports.clear()

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = {us: i for us, i in self.reports.get()} if self.reports.exists() else {}
        before = min(held, default=None)
        for pdf in rows:
            for us, i in zip(pdf["us"].tolist(), pdf["id"].tolist(), strict=True):
                held[us] = min(i, held.get(us, i))
        if before is not None and min(held) < before:
            self.handle.deleteTimer(self._due_ms(before))
        self._keep(sorted(held.items()))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = sorted(map(tuple, self.reports.get()))
        now, found = timerValues.getCurrentWatermarkInMs(), []
        while held and self._due_ms(held[0][0]) <= now:
            us, i = held.pop(0)
            if not held or held[0][0] > us + self.gap_us:
                found.append((key[0], us, i, us + self.gap_us))
        self._keep(held)
        if found:
            yield pd.DataFrame(found, columns=["mmsi", "last_us", "id", "silent_us"])

    def close(self) -> None:
        pass


def silences(reports: DataFrame, hours: float, late: str = "1 hour") -> DataFrame:
    """(mmsi, last_us, id, silent_us): each report (mmsi, ts, id) that no other of its entity follows within ``hours``.

    A silence comes out once the watermark, ``late`` behind the newest report, has passed its end; later reports of the
    entity start anew. Reports behind the watermark are dropped. Of reports at the same time the least id counts; those
    without an entity or a time are left out. ``STORE`` has to be set in the session before the query starts.
    """
    timed = reports.filter("mmsi IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", late)
    rows = timed.select(F.col("mmsi").cast("string").alias("mmsi"), "ts", F.unix_micros("ts").alias("us"), F.col("id").cast("long").alias("id"))
    return rows.groupBy("mmsi").transformWithStateInPandas(Silence(int(hours * 3.6e9)), outputStructType=RESULT, outputMode="Append", timeMode="EventTime")

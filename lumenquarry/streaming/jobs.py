"""The life of queued jobs as a stream with timers: claims, attempts, backoff and jobs that fall silent."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .events import ATTEMPTS, STALE

#: The first wait after a failed attempt, in seconds; each further one is twice as long.
BACKOFF = 5
OUTPUT = "job_id bigint, at timestamp, status string, attempts int, run_after timestamp"


class JobProcessor(StatefulProcessor):
    """One job's state and its timer. Times are those of events, so a log gives the same rows however it is cut into batches.

    claimed starts an attempt, beat shows that it goes on, failed ends it, succeeded ends the job. An attempt that is silent for STALE seconds is lost,
    which counts as failed at that time. After attempt n a job waits BACKOFF * 2 ** (n - 1) seconds and is then ready; after ATTEMPTS it has failed.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", "status string, attempts int")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        status, attempts = self.state.get() if self.state.exists() else ("", 0)
        out = []
        for event, ts in self._sorted(rows):
            self._unset()
            after = None
            if event == "queued":
                status = "queued"
            elif event in ("claimed", "beat"):
                status, attempts = "running", attempts + (event == "claimed")
                self._set(ts + pd.Timedelta(seconds=STALE))
            elif event == "succeeded":
                status = "succeeded"
            else:
                status, after = self._failed(attempts, ts)
            out.append((key[0], ts, status, attempts, after))
        self.state.update((status, int(attempts)))
        yield self._rows(out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        status, attempts = self.state.get()
        at, after = pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms"), None
        if status == "running":
            status, after = self._failed(attempts, at)
        elif status == "queued":
            status = "ready"
        self.state.update((status, int(attempts)))
        yield self._rows([(key[0], at, status, attempts, after)])

    def _sorted(self, rows: Iterator[pd.DataFrame]) -> list[tuple[str, pd.Timestamp]]:
        found = [r for df in rows for r in zip(df["seq"], df["event"], df["ts"], strict=True)]
        return [(event, ts) for _, event, ts in sorted(found)]

    def _failed(self, attempts: int, at: pd.Timestamp) -> tuple[str, pd.Timestamp | None]:
        if attempts >= ATTEMPTS:
            return "failed", None
        after = at + pd.Timedelta(seconds=BACKOFF * 2 ** max(0, attempts - 1))
        self._set(after)
        return "queued", after

    def _set(self, at: pd.Timestamp) -> None:
        self.handle.registerTimer(int(at.timestamp() * 1000))

    def _unset(self) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)

    @staticmethod
    def _rows(out: list[tuple]) -> pd.DataFrame:
        df = pd.DataFrame(out, columns=["job_id", "at", "status", "attempts", "run_after"])
        return df.astype({"attempts": "int32"}).assign(at=pd.to_datetime(df["at"]), run_after=pd.to_datetime(df["run_after"]))

    def close(self) -> None:
        pass


def job_changes(events: DataFrame, late: str = "10 seconds") -> DataFrame:
    """(job_id, at, status, attempts, run_after) for each change, of a stream of events (job_id, seq, event, ts); needs the RocksDB state store."""
    marked = events.select("job_id", "seq", "event", "ts").withWatermark("ts", late)
    return marked.groupBy("job_id").transformWithStateInPandas(statefulProcessor=JobProcessor(), outputStructType=OUTPUT, outputMode="Update", timeMode="EventTime")

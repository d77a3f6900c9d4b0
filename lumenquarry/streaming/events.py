"""Structured Streaming over an event log: windows with late data, sessions, rate counters, duplicates, jobs and idempotent merges."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def marked(events: DataFrame, ts: str, late: str) -> DataFrame:
    """The events with a watermark; times without a zone are taken in the session's."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def tumbling(events: DataFrame, ts: str, size: str, late: str, *by: str) -> DataFrame:
    out = marked(events, ts, late).groupBy(F.window(ts, size), *by).agg(F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n")


def sliding(events: DataFrame, ts: str, size: str, step: str, late: str, value: str) -> DataFrame:
    out = marked(events, ts, late).groupBy(F.window(ts, size, step)).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "mean")


def sessions(events: DataFrame, ts: str, gap: str, late: str, key: str) -> DataFrame:
    out = marked(events, ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def rate(events: DataFrame, ts: str, late: str, who: str) -> DataFrame:
    return tumbling(events, ts, "60 seconds", late, who)


def first_seen(events: DataFrame, ts: str, late: str, *keys: str) -> DataFrame:
    """One of each key's rows within the watermark (which one isn't defined; batch code uses latest_per_key())."""
    return marked(events, ts, late).dropDuplicatesWithinWatermark(list(keys))


def merge_into(path: str, spark: SparkSession, key: str, order: str):
    """A foreachBatch function that keeps the newest row of each key in versioned snapshots; a batch that comes again changes nothing."""
    from ..operators.relational import latest_per_key
    from ..sources.files import Snapshots

    def run(batch: DataFrame, batch_id: int) -> None:
        store = Snapshots(spark, path)
        rows = store.read().unionByName(batch) if store.versions() else batch
        store.write(latest_per_key(rows.dropDuplicates(), [key], F.desc(order), *[F.col(c) for c in batch.columns]))

    return run


#: Seconds that a running job may be silent, and attempts before it fails.
STALE, ATTEMPTS = 90, 3


def job_states(events: DataFrame) -> DataFrame:
    """(job_id, status, attempts, backoff) folded from a job's events (job_id, seq, event): queued, claimed, succeeded, failed, lost."""
    attempts = F.count_if(F.col("event") == "claimed")
    last = F.max_by("event", F.struct("seq", "event"))
    t = events.groupBy("job_id").agg(last.alias("last"), attempts.alias("attempts"))
    retry = F.col("last").isin("failed", "lost") & (F.col("attempts") < ATTEMPTS)
    status = F.when(F.col("last") == "claimed", "running").when(F.col("last") == "succeeded", "succeeded").when(retry | (F.col("last") == "queued"), "queued").otherwise("failed")
    return t.select("job_id", status.alias("status"), "attempts", F.when(retry, 5 * F.pow(F.lit(2), F.greatest(F.lit(0), F.col("attempts") - 1))).cast("int").alias("backoff"))


def job_machine(events: DataFrame, ts: str = "ts") -> DataFrame:
    """The same as a stream: state by job, and a timer that reports a job lost after STALE seconds of silence."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        attempts, status = state.get if state.exists else (0, "")
        if state.hasTimedOut:
            status = "queued" if attempts < ATTEMPTS else "failed"
            state.remove()
            yield pd.DataFrame({"job_id": [key[0]], "status": [status], "attempts": [attempts]})
            return
        for batch in batches:
            for event in batch.sort_values("seq")["event"]:
                attempts += event == "claimed"
                status = {"queued": "queued", "claimed": "running", "succeeded": "succeeded"}.get(event, "queued" if attempts < ATTEMPTS else "failed")
        state.update((int(attempts), status))
        if status == "running":
            state.setTimeoutDuration(STALE * 1000)
        yield pd.DataFrame({"job_id": [key[0]], "status": [status], "attempts": [attempts]})

    return events.groupBy("job_id").applyInPandasWithState(run, "job_id bigint, status string, attempts int", "attempts int, status string", "update", "ProcessingTimeTimeout")

"""Timers of jobs against a plain simulation and the batch fold."""

import datetime as dt
import random

import pytest

from lumenquarry.streaming.events import job_states
from lumenquarry.streaming.jobs import job_changes

T0 = dt.datetime(2026, 1, 1)


def simulated(events, end):
    """The final state of one job by the rules, event by event; timers go off up to ``end``."""
    status, attempts, timer = "", 0, None

    def failed(at):
        return ("failed", None) if attempts >= 3 else ("queued", at + dt.timedelta(seconds=5 * 2 ** max(0, attempts - 1)))

    def fire(until):
        nonlocal status, timer
        while timer is not None and timer <= until:
            at, timer = timer, None
            if status == "running":
                status, timer = failed(at)
            elif status == "queued":
                status = "ready"

    for event, ts in events:
        timer = None
        if event == "queued":
            status = "queued"
        elif event in ("claimed", "beat"):
            status, attempts, timer = "running", attempts + (event == "claimed"), ts + dt.timedelta(seconds=90)
        elif event == "succeeded":
            status = "succeeded"
        else:
            status, timer = failed(ts)
    fire(end)
    return status, attempts


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(name)


def test_jobs_with_timers(rocks, tmp_path):
    r, jobs = random.Random(1), {}
    for job in range(20):
        now, log = T0 + dt.timedelta(seconds=r.randrange(10)), [("queued", T0)]
        for _ in range(r.randint(0, 3)):
            now += dt.timedelta(seconds=r.randint(1, 8))
            log.append(("claimed", now))
            for _ in range(r.randint(0, 2)):
                now += dt.timedelta(seconds=r.randint(1, 8))
                log.append(("beat", now))
            now += dt.timedelta(seconds=r.randint(1, 8))
            if (end := r.choice(["failed", "succeeded", None])) is None:
                break  # it falls silent
            log.append((end, now))
            if end == "succeeded":
                break
        jobs[job] = log
    schema = "job_id bigint, seq int, event string, ts timestamp"
    rows = [(job, i, e, t) for job, log in jobs.items() for i, (e, t) in enumerate(log)]
    far = T0 + dt.timedelta(hours=1)
    source = tmp_path / "in"
    rocks.createDataFrame(rows, schema).coalesce(1).write.parquet(str(source))
    for i in range(3):  # later events of another job move time on, one batch after another
        rocks.createDataFrame([(999, i, "queued", far + dt.timedelta(hours=i))], schema).coalesce(1).write.mode("append").parquet(str(source))
    stream = rocks.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(source))
    got: list = []
    query = job_changes(stream).writeStream.outputMode("update").foreachBatch(lambda df, _: got.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(150)
    last = {}
    for x in got:
        if x["job_id"] != 999:
            last[x["job_id"]] = (x["status"], x["attempts"])
    assert last == {job: simulated(log, far) for job, log in jobs.items()}
    # Where no timer went off, the batch fold says the same.
    fold = {x["job_id"]: (x["status"], x["attempts"]) for x in job_states(rocks.createDataFrame([x[:3] for x in rows if x[2] != "beat"], "job_id bigint, seq int, event string")).collect()}
    assert all(last[j] == fold[j] for j in jobs if last[j][0] in ("succeeded", "failed") and jobs[j][-1][0] in ("succeeded", "failed"))
    waits = [(x["run_after"] - x["at"]).total_seconds() for x in got if x["run_after"] is not None]
    assert set(waits) <= {5.0, 10.0} and waits

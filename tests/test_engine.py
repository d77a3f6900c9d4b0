"""Sources, ingestion, grounding and streams on small inputs."""

import datetime as dt
import json

from pyspark.sql import functions as F

from lumenquarry.operators import clusters, grounding, search
from lumenquarry.sources import files, ingest
from lumenquarry.streaming import events as st


def test_jsonl_and_taxonomy(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "t": "x"}\n\n{"id": "broken\n{"id": 2}\n')
    rows = files.read_jsonl(spark, str(tmp_path / "a.jsonl"), "id int, t string").collect()
    assert sorted((r.id or 0, r._corrupt_record is not None) for r in rows) == [(0, True), (1, False), (2, False)]
    (tmp_path / "tax.json").write_text(json.dumps({"severity": [{"id": "low", "keywords": ["a"]}, {"id": "high", "team": "t"}]}))
    assert [(r.label_id, r["rank"]) for r in files.taxonomy(spark, str(tmp_path / "tax.json")).orderBy("rank").collect()] == [("low", 0), ("high", 1)]
    files.write_jsonl(spark.range(3), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 3
    assert files.from_cursor(files.cursor({"a": 1})) == {"a": 1}


def test_metrics_delta(spark, tmp_path):
    (tmp_path / "a").write_text('# HELP x\nx_total{k="v"} 3\ny 1.5\n')
    (tmp_path / "b").write_text('x_total{k="v"} 5\nz 2\n')
    d = files.metric_delta(files.metric_samples(spark, str(tmp_path / "a")), files.metric_samples(spark, str(tmp_path / "b")))
    assert {(r.name, r.delta) for r in d.collect()} == {("x_total", 2.0), ("y", -1.5), ("z", 2.0)}


def test_ingestion_is_idempotent(spark, tmp_path):
    store = files.Snapshots(spark, str(tmp_path / "store"))
    batch = spark.createDataFrame([(1, "first a@b.io", 1), (1, "second", 2), (2, "  ", 1), (None, "x", 1), (3, "<b>c</b>", 1)], "id int, text string, seq int")
    assert ingest.ingest(store, batch, "id", "text", "seq") == {"version": 2, "created": 2, "updated": 0, "quarantined": 2}
    again = ingest.ingest(store, batch, "id", "text", "seq")
    assert (again["created"], again["updated"]) == (0, 2)
    assert {(r.id, r.text) for r in store.read().collect()} == {(1, "second"), (3, "c")}


def test_grounding(spark):
    answers = spark.createDataFrame([("a", ["[KB-1]", " kb-1", "KB-9"])], "answer string, citations array<string>")
    retrieved = spark.createDataFrame([("a", "KB-1"), ("a", "KB-2")], "answer string, source string")
    assert {(r.cited, r.source) for r in grounding.citations(answers, retrieved).collect()} == {("KB-1", "KB-1"), ("kb-1", "KB-1"), ("KB-9", None)}
    steps = spark.createDataFrame([("a", 1, "restart the modem now"), ("a", 2, "call billing")], "answer string, step int, text string")
    units = spark.createDataFrame([("a", "please restart the old modem now")], "answer string, text string")
    g = grounding.grounded_steps(steps, units)
    assert {(r.step, r.grounded) for r in g.collect()} == {(1, True), (2, False)}
    v = grounding.validation(g).head()
    assert (v.n, v.grounded, v.ratio, v.valid) == (2, 1, 0.5, False)
    edges = grounding.lineage(retrieved, spark.createDataFrame([("a", "KB-1")], "answer string, source string"), spark.createDataFrame([("a", "KB-2", 1)], "answer string, source string, step int"))
    assert [tuple(r) for r in grounding.broken_lineage(edges).collect()] == [("a", "KB-2", "cited_not_selected")]
    s = spark.createDataFrame([(0.8, 0.5, True, True, True), (0.8, 0.5, False, True, True), (0.8, 1.0, True, False, True)], "c double, r double, v boolean, s boolean, g boolean")
    status, value = grounding.policy(*[F.col(c) for c in "crvsg"])
    assert [(a, round(b, 4)) for a, b in s.select(status, value).collect()] == [("resolved", 0.6), ("unreliable", 0.4), ("abstained", 0.54)]
    e = grounding.extractive_steps(spark.createDataFrame([("a", 1, "restart the modem"), ("a", 2, "restart the modem again"), ("a", 3, "call us")], "answer string, position int, text string")).head()
    assert e.chosen == ["restart the modem", "call us"]


def test_case_diff(spark):
    old = spark.createDataFrame([(1, ["a", "b"], "x"), (2, ["a"], "x")], "id int, items array<string>, intent string")
    new = spark.createDataFrame([(1, ["b", "c"], "y"), (2, ["a"], "x")], "id int, items array<string>, intent string")
    rows = {r.id: r for r in grounding.case_diff(old, new, "id", "items", ["intent"]).collect()}
    assert (rows[1].added, rows[1].removed, rows[1].common, rows[1].changed, rows[1].reproduced) == (["c"], ["a"], 1, ["intent"], False) and rows[2].reproduced


def test_fusion_by_hand(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query bigint, doc bigint, rank int")
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query bigint, doc bigint, rank int")
    rows = search.reciprocal_rank_fusion({"a": (a, 1.0), "b": (b, 0.25)}).orderBy("rank").collect()
    assert [r.doc for r in rows] == [11, 10, 12] and abs(rows[0].rrf - (1 / 62 + 0.25 / 61)) < 1e-12


def test_clusters(spark):
    rows = [(1, i, [1.0, 0.01 * i]) for i in range(3)] + [(1, 10 + i, [0.01 * i, 1.0]) for i in range(2)]
    d = spark.createDataFrame(rows, "g bigint, k bigint, v array<double>")
    assert {r.key: r.cluster for r in clusters.average_linkage(d, "k", "v", "g").collect()} == {0: 0, 1: 0, 2: 0, 10: 10, 11: 10}
    days = spark.createDataFrame([("a", dt.datetime(2024, 1, d)) for d in (1, 3, 3)], "k string, ts timestamp")
    assert clusters.daily_counts(days, "k", "ts", 4).head().counts == [0, 1, 0, 2]


def run_stream(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_streams_agree_with_batches(spark, sf_dir, tmp_path):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    (tmp_path / "in").mkdir()
    e.orderBy("ts").coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "in"))
    src = st.stream(spark, str(tmp_path / "in"), e.schema)
    got = run_stream(st.tumbling(src, "ts", "6 hours", "1 hour", "event_type"), "tumbling", "complete")
    want = e.groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n")).select("w.start", "w.end", "event_type", "n")
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()
    sessions = run_stream(st.sessions(src, "ts", "30 minutes", "1 hour", "user_id"), "sessions", "complete")
    assert sessions.agg(F.sum("n")).head()[0] == e.count()


def test_job_states(spark):
    rows = [(1, 1, "queued"), (1, 2, "claimed"), (1, 3, "failed"), (2, 1, "queued"), (2, 2, "claimed"), (2, 3, "succeeded"), (3, 1, "claimed"), (3, 2, "lost"), (3, 3, "claimed"), (3, 4, "failed"), (3, 5, "claimed"), (3, 6, "failed"), (4, 1, "claimed")]
    out = {r.job_id: (r.status, r.attempts, r.backoff) for r in st.job_states(spark.createDataFrame(rows, "job_id bigint, seq int, event string")).collect()}
    assert out == {1: ("queued", 1, 5), 2: ("succeeded", 1, None), 3: ("failed", 3, None), 4: ("running", 1, None)}


def test_merging_stream(spark, tmp_path):
    merge = st.merge_into(str(tmp_path / "s"), spark, "id", "seq")
    batch = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "id int, seq int, v string")
    merge(batch, 0)
    merge(batch, 0)
    assert {tuple(r) for r in files.Snapshots(spark, str(tmp_path / "s")).read().collect()} == {(1, 2, "b"), (2, 1, "c")}

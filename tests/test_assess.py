"""Operators of assess, against brute force and by hand; streams with late rows."""

import json
import math
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenquarry.operators import assess, classify, clusters, drift, grounding, search
from lumenquarry.plans import catalogue_assess
from lumenquarry.streaming import events as st


def test_permutation_against_numpy(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(400, 6)) + 0.5
    v[:60, 0] += 3
    rows = [(i, x.tolist(), i < 60) for i, x in enumerate(v)] + [(999, None, True)]
    df = spark.createDataFrame(rows, "id bigint, v array<double>, r boolean").repartition(7)
    one = assess.centroid_permutation(df, "id", "v", F.col("r"), 200).head()
    a, b = v[:60].mean(0), v[60:].mean(0)
    assert abs(one.distance - (1 - a @ b / np.linalg.norm(a) / np.linalg.norm(b))) < 1e-9 and one.p == pytest.approx(1 / 201)
    same = assess.centroid_permutation(df.where("id >= 60 and id < 999"), "id", "v", F.col("id") % 5 == 0, 200).head()
    assert 0.02 < same.p <= 1
    again = assess.centroid_permutation(df.where("id >= 60 and id < 999").coalesce(1), "id", "v", F.col("id") % 5 == 0, 200).head()
    assert again.p == same.p and again.distance == pytest.approx(same.distance)
    assert assess.centroid_permutation(df.limit(0), "id", "v", F.col("r"), 5).count() == 0


def test_affect_training_is_the_optimum(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 4))
    y = np.where(x[:, 0] > 0.6, 2, np.where(x[:, 1] > 0, 1, 0))
    df = spark.createDataFrame([(row.tolist(), str(k)) for row, k in zip(x, y.tolist())] + [(None, "1"), ([0.0] * 4, None)], "cues array<double>, label string")
    classes, w, b = classify.affect_training(df, "cues", "label")
    assert classes == ["0", "1", "2"]
    z = x @ np.array(w).T + np.array(b)
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    weight = len(y) / (3 * np.bincount(y)[y])
    gradient = ((p - np.eye(3)[y]) * weight[:, None]).T @ x + np.array(w) / 2.0
    assert np.abs(gradient).max() < 0.05 and (p.argmax(1) == y).mean() > 0.85


def test_grounding_by_meaning_and_specifics(spark):
    steps = spark.createDataFrame([("a", 1, "reboot it", [1.0, 0.0]), ("a", 2, "pay $55 now", [1.0, 0.1]), ("a", 3, "alone", [0.0, 1.0])], "answer string, step int, text string, vector array<double>")
    units = spark.createDataFrame([("a", "k", "restart the box", [1.0, 0.2]), ("a", "m", None, [0.0, 1.0])], "answer string, source string, text string, vector array<double>")
    cited = spark.createDataFrame([("a", 1, "k"), ("a", 2, "k"), ("a", 2, "k")], "answer string, step int, source string")
    rows = {r.step: r for r in grounding.grounded_steps(steps, units, cited=cited).collect()}
    assert [rows[i].grounded for i in (1, 2, 3)] == [True, False, False]
    assert rows[2].invented == 1 and rows[2].similarity > 0.9 and rows[3].similarity == 0 and rows[1].support == 0


def test_decisions_wait_for_the_cooldown(spark):
    c = spark.createDataFrame([("a", True, False, None), ("b", True, False, 0.5), ("c", None, False, None)], "cluster string, significant boolean, covered boolean, overlap double")
    now = F.expr("timestamp'2024-01-02 00:00:00'")
    late = spark.sql("SELECT timestamp'2024-01-01 12:00:00' AS started, false AS active")
    assert {(r.cluster, r.needs, r.due) for r in assess.discovery_decisions(c, late, now).collect()} == {("a", True, False), ("b", False, False), ("c", False, False)}
    assert {r.cluster: r.due for r in assess.discovery_decisions(c, late.limit(0), now).collect()} == {"a": True, "b": False, "c": False}


def test_findings_need_a_least_count(spark):
    totals = spark.createDataFrame([(1000, 9, 9, 60, 0)], "requests bigint, feedback bigint, rated bigint, unreliable bigint, degraded bigint")
    groups = spark.createDataFrame([("x", 10, 4, 4, 0), ("y", 20, 10, 9, 6), (None, 0, 0, 0, 0)], "group string, requests bigint, feedback bigint, rejected bigint, abstained bigint")
    rated = spark.createDataFrame([(True, ["k", "k"], ["k"]), (True, ["k"], ["k"]), (False, None, ["t"]), (True, ["t"], ["k"])], "bad boolean, c array<string>, r array<string>")
    sources = assess.source_counts(rated, "c", "r", F.col("bad"), F.when(F.col("source") == "k", "article").otherwise("ticket"))
    confusions = spark.createDataFrame([("p", "q", 1), ("p", "r", 2)], "predicted string, corrected string, n bigint")
    out = {(r.kind, r.severity, r.subject) for r in assess.all_findings(totals, groups, sources, confusions).collect()}
    assert out == {("data_sufficiency", "info", "ratings"), ("problem_intent", "high", "y"), ("weak_article", "high", "k"), ("intent_confusion", "medium", "p > r"), ("abstention_cluster", "medium", "y"), ("grounding_failures", "high", "unreliable")}


def test_fast_alerts_need_rows(spark):
    rows = spark.createDataFrame([("recent", "a", 1.0)] * 40 + [("baseline", "b", 2.0)] * 40 + [("baseline", None, None)], "side string, c string, e double")
    negative = spark.sql("SELECT CAST(NULL AS DOUBLE) AS negative")
    got = {r.signal: (r.alert, r.status) for r in assess.fast_alerts(rows, F.col("c") == "a", F.col("e"), ["c"], negative).collect()}
    assert got == {"abstention_rate": (True, "alert"), "mean_evidence": (True, "alert"), "js_c": (True, "alert"), "negative_feedback": (False, "alert")}
    few = assess.fast_alerts(rows.where("side = 'recent'"), F.col("c") == "a", F.col("e"), ["c"], negative).collect()
    assert {(r.alert, r.status) for r in few} == {(False, "insufficient_data")}


def test_empty_windows_give_no_statistics(spark):
    one = spark.createDataFrame([("recent", "a", 1.0), ("recent", "b", 2.0)], "side string, c string, x double")
    for rows in (one, one.limit(0)):
        t = drift.counts(rows, "c")
        assert drift.jensen_shannon(t).head().js is None and drift.ks(rows, "x").head().d is None
        assert all(r.z is None for r in drift.proportion_z(t).collect()) and (drift.chi2(t).head().statistic or 0) == 0
        assert {(r.alert, r.status) for r in drift.report(rows, ["c"], "x").collect()} == {(False, "insufficient_data")}


def test_extractive_answers_by_brute_force(spark, sf_dir):
    got = {r.answer: r.chosen for r in catalogue_assess.extractive_answers(spark, sf_dir).collect()}
    part = {r.p_partkey: f"{r.p_name} {r.p_type}" for r in spark.read.parquet(f"{sf_dir}/part.parquet").collect()}
    lines: dict = {}
    for r in spark.read.parquet(f"{sf_dir}/lineitem.parquet").collect():
        lines.setdefault(r.l_orderkey, []).append((r.l_linenumber, part[r.l_partkey]))
    words = lambda s: set(re.findall("[a-z0-9]+", s.lower()))
    for order, rows in lines.items():
        want: list = []
        for _, s in sorted(rows):
            if len(want) < 7 and all(len(words(s) & words(o)) / min(len(words(s)), len(words(o))) < 0.6 for o in want):
                want.append(s)
        assert got[order] == want


def test_distinct_keywords_by_brute_force(spark, sf_dir):
    got = {r.cluster: r.terms for r in catalogue_assess.distinct_keywords(spark, sf_dir).collect()}
    docs, known = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("role", "text"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    weights: dict = {}
    for r in clusters.keyword_weights(docs, "role", "text", grams=2, stop=search.STOP_WORDS, background=known).collect():
        weights.setdefault(r.cluster, []).append((-round(r.weight, 9), r.term))
    assert set(got) == set(weights)
    for role, rows in weights.items():
        want: list = []
        for _, term in sorted(rows):
            if len(want) < 8 and not any(term in x or x in term for x in want):
                want.append(term)
        assert got[role] == want


def test_keywords_of_small_and_empty_clusters(spark):
    d = spark.createDataFrame([("a", "red box"), ("a", None), (None, "box"), ("b", ""), ("b", "of it")], "c string, t string")
    # In a, red and red box weigh alike and red comes first as a term, so red box is out, and box, which the null cluster has too, follows.
    assert {r.cluster: r.terms for r in clusters.distinct_keywords(d, "c", "t", 3, grams=2).collect()} == {"a": ["red", "box"], None: ["box"]}
    assert clusters.distinct_keywords(d.limit(0), "c", "t", 3).count() == 0


def _stream(spark, tmp_path, batches, schema):
    folder = tmp_path / "in"
    folder.mkdir()
    for i, rows in enumerate(batches):
        (folder / f"{i}.json").write_text("\n".join(map(json.dumps, rows)))
        os.utime(folder / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))  # files are taken by age
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


def _run(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    done = q.awaitTermination(60)
    q.stop()
    assert done
    return df.sparkSession.table(name).collect()


def test_late_rows_are_left_out_of_closed_windows(spark, tmp_path):
    t = lambda m: f"2024-01-01T{m // 60:02}:{m % 60:02}:00"
    batches = [[{"ts": t(1), "u": "a", "x": 1.0}, {"ts": t(8), "u": "a", "x": 3.0}], [{"ts": t(200), "u": "b", "x": 9.0}], [{"ts": t(201), "u": "b", "x": 1.0}], [{"ts": t(2), "u": "a", "x": 100.0}], [{"ts": t(500), "u": "c", "x": 0.0}], [{"ts": t(501), "u": "c", "x": 0.0}]]
    src = _stream(spark, tmp_path, batches, "ts timestamp, u string, x double")
    rows = _run(st.sliding(src, "ts", "10 minutes", "5 minutes", "30 minutes", "x"), "late_sliding", "append")
    got = {(r.start.hour * 60 + r.start.minute): (r.n, r["mean"]) for r in rows}
    # Minute 2 came when its windows were closed.
    assert got[0] == (2, 2.0) and got[5] == (1, 3.0) and got[1435] == (1, 1.0) and got[200] == (2, 5.0)
    rates = {(r.u, r.start.minute + 60 * r.start.hour): r.n for r in _run(st.rate(src, "ts", "30 minutes", "u"), "late_rates", "append")}
    assert rates == {("a", 1): 1, ("a", 8): 1, ("b", 200): 1, ("b", 201): 1}
    firsts = _run(st.first_seen(src, "ts", "30 minutes", "u"), "late_firsts", "append")
    assert sorted(r.u for r in firsts) == ["a", "b", "c"]


def test_job_machine_follows_the_batch_form(spark, tmp_path):
    batches = [[{"job_id": 1, "seq": 1, "event": "queued"}, {"job_id": 1, "seq": 2, "event": "claimed"}], [{"job_id": 1, "seq": 3, "event": "failed"}, {"job_id": 2, "seq": 1, "event": "claimed"}], [{"job_id": 2, "seq": 2, "event": "succeeded"}]]
    src = _stream(spark, tmp_path, batches, "job_id bigint, seq int, event string")
    # A timer would ask for batches without rows for ever.
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    try:
        rows = _run(st.job_machine(src), "jobs", "update")
    finally:
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    last = {r.job_id: (r.status, r.attempts) for r in rows}
    flat = spark.createDataFrame([tuple(r.values()) for b in batches for r in b], "job_id bigint, seq int, event string")
    assert last == {r.job_id: (r.status, r.attempts) for r in st.job_states(flat).collect()} == {1: ("queued", 1), 2: ("succeeded", 1)}


def test_steps_are_dealt_by_answers_into_tasks_by_rows(spark, sf_dir, monkeypatch):
    """A shuffle's bytes tell little of what its rows take in memory, so tasks are counted by rows; results stay."""
    from lumenquarry.plans import catalogue_assess
    from lumenquarry.sources import files

    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    few = catalogue_assess.step_grounding(spark, sf_dir).collect()
    monkeypatch.setattr(files, "TASK_ROWS", 500)
    many = catalogue_assess.step_grounding(spark, sf_dir)
    assert f", {-(-rows // 500)}), REPARTITION_BY_NUM" in many._jdf.queryExecution().toString()
    assert sorted(map(tuple, few)) == sorted(map(tuple, many.collect()))


def test_distinct_keywords_of_many_tasks_and_rounds(spark, monkeypatch):
    """Texts and terms in many tasks, and clusters whose heaviest candidates are all alike: the same terms as greedily from all weights."""
    monkeypatch.setattr(clusters, "TEXT_BYTES", 200)
    monkeypatch.setattr(clusters, "TERM_BYTES", 100)
    monkeypatch.setattr(clusters, "CANDIDATES", 3)
    r = random.Random(4)
    word = lambda: "".join(r.choice("abc") for _ in range(r.randint(3, 6)))
    rows = [(r.choice(["a", "b", None]), " ".join(word() for _ in range(r.randint(0, 30)))) for _ in range(120)] + [("one", "same"), ("one", "same same"), ("none", None)]
    d = spark.createDataFrame(rows, "c string, t string")
    tf: dict = {}
    for c, t in rows:
        w = (t or "").split()
        for term in w + [f"{x} {y}" for x, y in zip(w, w[1:])]:
            tf[c, term] = tf.get((c, term), 0) + 1
    df: dict = {}
    for _, term in tf:
        df[term] = df.get(term, 0) + 1
    weights = clusters.keyword_weights(d, "c", "t", grams=2)
    got = {(x.cluster, x.term): x.weight for x in weights.collect()}
    assert got == pytest.approx({(c, term): (1 + math.log(n)) * (math.log(6 / (1 + df[term])) + 1) for (c, term), n in tf.items()})
    want: dict = {}
    for (c, term), x in sorted(got.items(), key=lambda e: (-round(e[1], 9), e[0][1])):
        have = want.setdefault(c, [])
        if len(have) < 8 and not any(term in y or y in term for y in have):
            have.append(term)
    assert {x.cluster: x.terms for x in clusters.distinct_keywords(d, "c", "t", grams=2).collect()} == want
    # No task sorts whole rows for an aggregate of strings, and terms are dealt once, by their number.
    plan = weights._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert "SortAggregate" not in plan and plan.count("Exchange") == 2 == plan.count("REPARTITION_BY_NUM")

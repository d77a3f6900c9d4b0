"""Average linkage of any size, joint topics, exact quantiles and places in an order, against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenquarry.functions import quantiles
from lumenquarry.functions.quantiles import exact_quantiles
from lumenquarry.operators import clusters, drift, relational


def greedy(rows, cut, weights=None):
    """The nearest pair of all is merged, one by one."""
    groups = {i: [i] for i in range(len(rows))}
    x = np.array(rows, float)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    w = np.ones(len(x)) if weights is None else np.array(weights, float)
    while len(groups) > 1:
        names = sorted(groups)
        means = np.array([(x[groups[i]] * w[groups[i]][:, None]).sum(axis=0) / w[groups[i]].sum() for i in names])
        near = np.round(means @ means.T, 12)
        near[np.tril_indices(len(names))] = -np.inf
        i, j = divmod(int(np.argmax(near)), len(names))
        if near[i, j] < 1 - cut:
            break
        groups[names[i]] += groups.pop(names[j])
    return {k: g for g, ks in groups.items() for k in ks}


def points(n, seed, centres=12, dims=6, noise=0.5):
    r = np.random.default_rng(seed)
    c = r.normal(size=(centres, dims))
    return [(c[r.integers(centres)] + noise * r.normal(size=dims)).round(6).tolist() for _ in range(n)]


@pytest.mark.parametrize("largest", [2000, 25])
def test_average_linkage_matches_greedy_merges(spark, monkeypatch, largest):
    monkeypatch.setattr(clusters, "LARGEST", largest)  # the smaller one takes distributed rounds
    monkeypatch.setattr(clusters, "LINKED", 20)
    sets = {0: points(90, 1), 1: points(10, 2), None: points(60, 3, noise=0.2)}
    rows = [(g, k, v, 9) for g, vs in sets.items() for k, v in enumerate(vs)] + [(1, None, [1.0] * 6, 1), (1, 999, None, 1)]
    df = spark.createDataFrame(rows, "label int, key bigint, vector array<double>, c int")
    got = {(r["group"], r["key"]): r["cluster"] for r in clusters.average_linkage(df, "key", "vector", "label").collect()}
    assert got == {(g, k): c for g, vs in sets.items() for k, c in greedy(vs, 0.55).items()}
    assert clusters.average_linkage(df.where("false"), "key", "vector", "label").count() == 0


def test_equal_vectors_end(spark, monkeypatch):
    monkeypatch.setattr(clusters, "LARGEST", 5)
    rows = [(0, k, [1.0, 0.0] if k % 2 else [0.0, 1.0]) for k in range(24)]
    got = {r["key"]: r["cluster"] for r in clusters.average_linkage(spark.createDataFrame(rows, "g int, key bigint, v array<double>"), "key", "v", "g").collect()}
    assert got == {k: k % 2 for k in range(24)}


def test_many_rows_take_rounds(spark):
    x = points(2600, 4, centres=40, dims=16, noise=0.25)
    df = spark.createDataFrame([(0, k, v) for k, v in enumerate(x)], "g int, key bigint, v array<double>")
    got = {r["key"]: r["cluster"] for r in clusters.average_linkage(df, "key", "v", "g").collect()}
    v = np.array(x) / np.linalg.norm(x, axis=1, keepdims=True)
    owner = clusters._merged(v, np.ones(len(v)), np.arange(len(v)), 0.55)
    assert got == dict(enumerate(owner.tolist()))


def test_late_rounds_are_one_tasks_work(spark, monkeypatch):
    """A group that goes through rounds is finished in a task once few points have lost their neighbour, though it has many points yet."""
    monkeypatch.setattr(clusters, "LARGEST", 300)
    folders = []
    monkeypatch.setattr(clusters, "written", lambda df, path, write=clusters.written: folders.append(path) or write(df, path))
    x = points(1200, 6, centres=300, dims=16, noise=0.2)
    rows = [(None, k, v) for k, v in enumerate(x)] + [(None, 5000, [float("nan")] * 16)]
    got = {r["key"]: r["cluster"] for r in clusters.average_linkage(spark.createDataFrame(rows, "g int, key bigint, v array<double>"), "key", "v", "g", 0.8).collect()}
    assert got == greedy(x, 0.8) | {5000: 5000}
    assert sum("/known-" in f for f in folders) < 8 and sum("/finished-" in f for f in folders) == 1


def test_nearest_by_brute_force(monkeypatch):
    """Single precision leaves out no nearest point: near ties, equal points, and only a point itself."""
    monkeypatch.setattr(clusters, "LINKED", 7)
    monkeypatch.setattr(clusters, "EXACT", 5)
    r = np.random.default_rng(3)
    v = r.normal(size=(60, 9))
    v[20:40] = v[0] + 1e-8 * r.normal(size=(20, 9))
    v[40:50] = v[1]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    k, rows = np.arange(60) * 3 - 50, np.r_[0:60:2, 1]
    full = np.round(v @ v.T, clusters.DIGITS)
    np.fill_diagonal(full, -np.inf)
    best, at, turn = clusters._nearest(v, v.astype(np.float32), k, rows, np.arange(60))
    for i, b, a, t in zip(rows, best, at, turn, strict=True):
        tied = np.flatnonzero(full[i] >= full[i].max() - 2e-12)  # products of matrices round otherwise at times
        assert abs(b - full[i].max()) < 2e-12 and a in tied and t == clusters._turn(k[[i]], k[[a]])[0]
        if i in range(40, 50):
            assert t == min(clusters._turn(k[[i]], k[[j]])[0] for j in tied)
    assert clusters._nearest(v, v.astype(np.float32), k, np.array([4]), np.array([4]))[1].tolist() == [-1]


def test_joint_topics(spark):
    """A topic that only recent rows have is found; where both windows are alike, nothing is, over 50 seeds in one job."""
    r, rows = random.Random(5), []
    for seed in range(51):
        x = points(160, 100 + seed, centres=8, noise=0.3)
        rows += [(seed, k, [*v, 0.0, 0.0], r.random() < 0.3) for k, v in enumerate(x)]
        if seed == 50:
            rows += [(seed, 1000 + k, [0.0] * 6 + [9.0, float(k % 3)], True) for k in range(30)]
    df = spark.createDataFrame(rows, "seed int, key bigint, v array<double>, recent boolean")
    found = drift.joint_topics(df, "key", "v", "recent", "seed").where("kind is not null").collect()
    assert any(x["seed"] == 50 and x["kind"] == "new_topic" and x["cluster"] >= 1000 for x in found)
    assert len({x["seed"] for x in found if x["seed"] < 50}) <= 5


@pytest.mark.parametrize("n", [1, 2, 3, 10, 997, 30_000])
def test_exact_quantiles(spark, n):
    r = np.random.default_rng(n)
    x = np.concatenate([r.normal(size=n - n // 3), np.repeat(r.normal(), n // 3)])  # a third of all rows are one value
    df = spark.createDataFrame([("a", float(v)) for v in x] + [("b", None), ("c", 5.0), (None, 1.0), (None, 2.0)], "g string, v double")
    qs = [0.0, 0.05, 0.1, 0.5, 0.9, 0.95, 0.99, 1.0]
    got = {row["g"]: (row["n"], row["q"]) for row in exact_quantiles(df, "v", qs, "g").collect()}
    assert got["a"][0] == n and got["a"][1] == pytest.approx(np.quantile(x, qs).tolist())
    assert got["b"] == (0, None) and got["c"] == (1, [5.0] * len(qs)) and got[None][1][3] == 1.5
    one = exact_quantiles(df.where("g = 'a'"), "v", [0.5]).head()
    assert one["n"] == n and one["q"][0] == pytest.approx(float(np.median(x)))
    assert exact_quantiles(df.where("false"), "v", [0.5]).head()["n"] == 0


def test_quantiles_of_few_groups_sort_no_group(spark, monkeypatch):
    """Neither a join nor an aggregate puts a group's rows into one task: only counted values are sorted. With more groups than are sent, values are the same."""
    df = spark.range(50_000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7 % 50).cast("double").alias("v"))
    found = exact_quantiles(df, "v", [0.5, 0.95], "g")
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "SortAggregate" not in plan
    got = sorted(map(tuple, found.collect()))
    monkeypatch.setattr(quantiles, "SENT", 2)
    assert got == sorted(map(tuple, exact_quantiles(df, "v", [0.5, 0.95], "g").collect())) and [r[1] for r in got] == [16667, 16667, 16666]


def test_places_in_an_order(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("x")).repartition(7)
    rows = {r["x"]: (r["i"], r["n"]) for r in relational.numbered(df, "x").collect()}
    assert rows == {x: (x, 1000) for x in range(1000)}
    assert sorted(r["x"] for r in relational.evenly(df, 4, "x").collect()) == [0, 250, 500, 750]
    assert relational.evenly(df.limit(3), 50, "x").count() == 3 and relational.evenly(df.where("false"), 5, "x").count() == 0

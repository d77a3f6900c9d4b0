"""Exact and approximate vector search against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenquarry.functions import vectors as vx
from lumenquarry.operators.vector_index import VectorIndex, recall


def frame(spark, rows):
    return spark.createDataFrame([(i, [float(v) for v in x], a) for i, x, a in rows], "vec_id bigint, embedding array<float>, label int")


def brute(rows, queries, k, allowed=None):
    out = {}
    for q, x, _ in queries:
        x = np.array(x) / np.linalg.norm(x)
        scored = [(-round(float(x @ (np.array(y) / np.linalg.norm(y))), 9), i) for i, y, a in rows if i != q and (allowed is None or a in allowed)]
        out[q] = [i for _, i in sorted(scored)[:k]]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["vec_id"])
    return out


def points(n, seed=1, centres=30, dims=16):
    r = np.random.default_rng(seed)
    c = r.normal(size=(centres, dims))
    return [(i, c[i % centres] + 0.5 * r.normal(size=dims), i % 7) for i in range(n)]


@pytest.mark.parametrize("broadcast", [64 * 2**20, 1000])
def test_exact_search_in_blocks_and_groups(spark, monkeypatch, broadcast):
    monkeypatch.setattr(vx, "BROADCAST", broadcast)  # the smaller one deals queries to groups
    monkeypatch.setattr(vx, "CHUNK", 50)
    monkeypatch.setattr(vx, "SALTS", 3)
    rows = points(400)
    df = frame(spark, rows).repartition(5).unionByName(spark.createDataFrame([(9000, None, 1), (None, [1.0] * 16, 1)], "vec_id bigint, embedding array<float>, label int"))
    got = found(vx.top_k(df, df.where("vec_id % 20 = 0"), 6))
    assert got == brute(rows, [r for r in rows if r[0] % 20 == 0], 6)


def test_ties_go_to_smaller_keys(spark):
    rows = [(i, [1.0, 0.0] if i % 2 else [0.0, 1.0], 0) for i in range(100)]
    df = frame(spark, rows)
    assert found(vx.top_k(df.repartition(4), df.where("vec_id in (3, 50)"), 4)) == {3: [1, 5, 7, 9], 50: [0, 2, 4, 6]}
    assert vx.top_k(df, df.where("false"), 4).count() == 0 and vx.top_k(df.where("false"), df, 4).count() == 0


def test_best_columns_is_a_sort():
    r = np.random.default_rng(3)
    scores, keys = r.integers(0, 6, (20, 90)).astype(float), r.permutation(90)[None, :]
    s, k = vx.best_columns(scores, keys, 7)
    for i in range(20):
        want = sorted(zip(-scores[i], keys[0], strict=True))[:7]
        assert list(zip(-s[i], k[i], strict=True)) == want


def test_index_finds_and_filters(spark, tmp_path):
    rows = points(6000, centres=60)
    df = frame(spark, rows)
    index = VectorIndex.build(df.where("vec_id < 5000"), str(tmp_path / "i"), attribute="label")
    index.add(df.where("vec_id >= 5000"), attribute="label")
    queries = df.where("vec_id % 100 = 0")
    exact = vx.top_k(df, queries, 10)
    got = index.search(queries, 10)
    assert recall(got, exact).agg(F.avg("recall")).head()[0] >= 0.95
    assert got.groupBy("query_id").count().where("count <> 10").count() == 0
    only = index.search(queries, 10, allowed=[3])
    assert recall(only, vx.top_k(df.where("label = 3"), queries, 10)).agg(F.avg("recall")).head()[0] >= 0.95
    # A filter that leaves few rows makes queries go on to all cells.
    rare = df.withColumn("label", F.when(F.col("vec_id") < 4, 99).otherwise(F.col("label")))
    other = VectorIndex.build(rare, str(tmp_path / "j"), attribute="label")
    assert found(other.search(queries.where("vec_id in (100, 200)"), 3, probes=2, allowed=[99], exclude_self=False)).keys() == {100, 200}
    self_found = index.search(queries, 1, exclude_self=False).where("query_id = vec_id").count()
    assert self_found == queries.count()


def test_index_reads_probed_cells_only(spark, tmp_path):
    df = frame(spark, points(4000, centres=64))
    index = VectorIndex.build(df, str(tmp_path / "i"), cells=64)
    plan = index._probed(df.where("vec_id = 7").selectExpr("vec_id as query_id", "embedding as v"), 5, 2, None, True)
    plan.collect()
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in text.lower()


def test_odd_vectors(spark, tmp_path):
    rows = [(i, [1.0] * 16 if i % 3 else [0.0] * 16, 0) for i in range(50)]  # a third are zero vectors, the others equal
    df = frame(spark, rows)
    index = VectorIndex.build(df, str(tmp_path / "i"))
    got = index.search(df.where("vec_id = 1"), 5)
    assert found(got) == {1: [2, 4, 5, 7, 8]}
    assert index.search(df.where("false"), 5).count() == 0
    with pytest.raises(ValueError):
        VectorIndex.build(df.where("false"), str(tmp_path / "k"))


def test_index_of_copies_finds_what_a_filter_leaves(spark, tmp_path):
    """Queries whose own copies a filter leaves out have neighbours in further cells."""
    x = np.random.default_rng(3).normal(size=(400, 32)).astype(np.float32)
    df = spark.createDataFrame([(i, x[i % 400].tolist(), i % 400 % 10) for i in range(4000)], "vec_id bigint, embedding array<float>, label int").repartition(4).cache()
    asked = df.where("vec_id % 20 < 10 and vec_id < 400")
    index = VectorIndex.build(df, str(tmp_path / "i"), attribute="label")
    rows = recall(index.search(asked, 10, allowed=[0, 1]), vx.top_k(df.where("label < 2"), asked, 10)).collect()
    assert len(rows) == 200 and np.mean([r["recall"] for r in rows]) >= 0.95


def test_codes_leave_out_nothing_that_could_be_among_the_best():
    from lumenquarry.operators.vector_index import reachable

    r = np.random.default_rng(4)
    exact, off = r.normal(size=(20, 300)), r.uniform(0, 0.3, 300)
    at = reachable(exact + r.uniform(-1, 1, (20, 300)) * off, off, 5)
    assert len(at) < 300 and set(np.argsort(-exact, axis=1)[:, :5].reshape(-1)) <= set(at)


def test_equal_vectors_tie_by_key_wherever_they_lie(spark):
    x = np.random.default_rng(5).normal(size=(7, 61))
    df = spark.createDataFrame([(i, x[i % 7].tolist()) for i in range(1501)], "vec_id bigint, embedding array<double>").coalesce(1)
    got = vx.top_k(df, df.where("vec_id in (0, 703, 1500)"), 12).collect()
    want = {q: [i for i in range(1501) if i % 7 == q % 7 and i != q][:12] for q in (0, 703, 1500)}
    assert {q: [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] for q in want} == want

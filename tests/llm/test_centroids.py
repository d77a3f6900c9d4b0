import hashlib
import math
import random

import numpy as np
from pyspark.sql import functions as F

from lumenquarry.llm import centroids
from lumenquarry.llm.queries import op11_centroid_clustering


def brute(rows, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * v) for v in x]) for i, x in rows if x is not None and len(x) == 64 and all(v is not None and math.isfinite(v) for v in x)]
    start = sorted((hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest(), x) for i, x in kept)[:k]
    c = [x for _, x in start]
    far = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y, strict=True))
    near = lambda x: min((far(x, y), j) for j, y in enumerate(c))
    for _ in range(rounds):
        groups = {}
        for _, x in kept:
            groups.setdefault(near(x)[1], []).append(x)
        for j, xs in groups.items():
            c[j] = [sum(col) // len(xs) for col in zip(*xs, strict=True)]
    out = [(i, *near(x)[::-1]) for i, x in kept]
    by = {j: sum(d for _, h, d in out if h == j) for j in range(len(c))}
    return sorted((i if i is not None else -1, j, d, by[j], sum(by.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, j, d in out)


def got(df):
    return sorted((-1 if r["vec_id"] is None else r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in df.collect())


def test_tables_match_brute_force(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert got(op11_centroid_clustering(spark, sf_dir)) == brute(rows)


def test_odd_rows(spark):
    r = random.Random(1)
    some = [[r.choice([-1.5, 0.0, 0.25, 2.0]) for _ in range(64)] for _ in range(25)]
    odd = [None, [], [1.0] * 63, [1.0] * 65, [1.0] * 63 + [None], [1.0] * 63 + [float("nan")], [1.0] * 63 + [float("-inf")]]
    rows = [(i % 20, x) for i, x in enumerate([*some, *odd, *some[:5]])] + [(None, some[3]), (None, some[4])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumns({"cluster": F.lit("x"), "row": F.lit(2), "key": F.lit(3), "vector": F.lit(4)})
    assert got(centroids.clustered(df)) == brute(rows)
    assert centroids.clustered(df.where("false")).count() == 0
    few = df.where("vec_id < 3").limit(3)
    assert got(centroids.clustered(few)) == brute([(x["vec_id"], x["embedding"]) for x in few.collect()])
    same = spark.createDataFrame([(i, [0.5] * 64) for i in range(20)], "vec_id bigint, embedding array<float>")  # all tie
    assert {x[1:5] for x in got(centroids.clustered(same))} == {(0, 0, 0, 0)}


def test_wide_numbers(spark):
    rows = [(i, [float(i % 3)] * 63 + [1e6 * (i % 5)]) for i in range(30)] + [(30, [3e4] * 64)]
    assert got(centroids.clustered(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))) == brute(rows)
    huge = spark.createDataFrame([(1, [1e300] * 64), (2, [0.0] * 64)] + [(i, [-1e300] * 64) for i in range(3, 12)], "vec_id bigint, embedding array<double>")
    assert centroids.clustered(huge).count() == 11


def test_screening_prunes_and_is_exact():
    r = np.random.default_rng(5)
    c = r.integers(-3000, 3000, (8, 64)) * np.repeat(r.integers(0, 5, (8, 8)), 8, axis=1)
    x = np.concatenate([y + r.integers(-500, 500, (200, 64)) for y in c])
    near, best, exact = centroids.screened(x, centroids.segment_norms(x), c)
    all_d = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
    assert (near == all_d.argmin(axis=1)).all() and (best == all_d.min(axis=1)).all()
    assert exact < 0.5 * all_d.size

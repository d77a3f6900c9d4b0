"""What all-pairs search and proposals leave on disk and read."""

import time

import numpy as np
from pyspark.sql import functions as F

from lumenquarry.functions import vectors as vx
from lumenquarry.operators import discovery


def shuffled(spark):
    """Bytes of shuffle files by name."""
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    jvm = spark.sparkContext._jvm
    return {x: jvm.java.io.File(x).length() for x in found.split("\n") if x.endswith(".data")}


def test_groups_of_queries_are_not_repeated_on_disk(spark, monkeypatch):
    monkeypatch.setattr(vx, "BROADCAST", 2**17)  # a sixth of the queries
    x = np.random.default_rng(6).normal(size=(1500, 64))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>").repartition(3)
    before, most = shuffled(spark), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables that are too large to be broadcast
    try:
        got = vx.top_k(df, df, 3).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    left = lambda: sum(size for name, size in shuffled(spark).items() if name not in before)
    end = time.time() + 20
    while left() > 4 * x.nbytes and time.time() < end:
        time.sleep(0.2)
    assert left() <= 4 * x.nbytes
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    scores = unit @ unit.T
    np.fill_diagonal(scores, -2)
    want = np.argsort(-scores, axis=1)[:, :3]
    found = {(r["query_id"], r["rank"]): r["vec_id"] for r in got}
    assert len(got) == len(found) == 4500 and all(found[i, j + 1] == want[i, j] for i in range(1500) for j in range(3))


def test_members_are_made_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def costly(x):
        seen.add(1)
        return x

    rows = [(i % 2, i, [1.0, float(i)], f"word{i % 5} other{i % 2}", "a", i / 100) for i in range(60)]
    members = spark.createDataFrame(rows, "cluster int, key int, vector array<double>, text string, nearest string, top double").withColumn("text", costly("text"))
    existing = spark.createDataFrame([("a", "team")], "label_id string, team string")
    got = {r["cluster"]: r for r in discovery.proposed(members, existing).collect()}
    assert seen.value == 60 and set(got) == {0, 1} and got[0]["size"] == got[1]["size"] == 30 and len(got[0]["examples"]) == 3
    assert got[0]["top_similarity"] == sum(r[5] for r in rows if r[0] == 0) / 30

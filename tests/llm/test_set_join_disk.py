"""What the join leaves on disk while it runs."""

import random
import time

import numpy as np
from lumenquarry.llm import families
from lumenquarry.llm.common import Workspace
from lumenquarry.llm.set_join import TOKEN, index_lists, jaccard_join, tokens


def shuffle_files(spark):
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {x for x in found.split("\n") if "/shuffle_" in x}


def test_shuffle_files_go_with_the_query(spark):
    before = shuffle_files(spark)
    kept = Workspace(spark, "test").keep(spark.range(20_000).repartition(3, "id"), "rows")
    end = time.time() + 20
    while shuffle_files(spark) - before and time.time() < end:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before and kept.count() == 20_000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_features_go_once_groups_are_found(spark, monkeypatch):
    seen, labels = [], families._labels

    def looked(docs, classes, groups, work, compare):
        fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(work.path)
        names = [s.getPath().getName() for s in fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(fs)]
        seen.extend((name, spark.read.parquet(f"{work.path}/{name}").columns) for name in names)
        return labels(docs, classes, groups, work, compare)

    monkeypatch.setattr(families, "_labels", looked)
    df = spark.createDataFrame([(i, " ".join(f"w{i // 2}-{j}" for j in range(40)) + f" x{i}") for i in range(50)], "doc_id bigint, text string")
    assert {r.doc_id: r.component_id for r in jaccard_join(df).collect()} == {i: i - i % 2 for i in range(50)}
    assert {name for name, _ in seen} == {"rows", "groups", "ids"} and not any(c in ("bits", "firsts") for _, columns in seen for c in columns)


def test_lists_are_those_of_the_prefixes(spark):
    r = random.Random(4)
    rows = [((i % 3 << 33) + i, 40 + i % 50, [r.randrange(400) << 50 | r.randrange(2) << 23 for _ in range(r.randint(0, 12))]) for i in range(300)]
    packed = [(c, n, bytearray(tokens(np.array(s, np.uint64)).tobytes() if s else b"")) for c, n, s in rows]
    df = spark.createDataFrame(packed, "cls bigint, n bigint, firsts binary").coalesce(1)
    lists = {}
    for c, n, s in rows:
        for i, x in enumerate(s):
            lists.setdefault(x >> (64 - 8 * TOKEN), []).append((c, n, i))
    want = sorted((t, *e, len(x), min(x)[0]) for t, x in lists.items() if len(x) > 1 for e in x)
    assert sorted(tuple(x) for x in index_lists(df).collect()) == want

import random
import zlib

import numpy as np
from lumenquarry.llm import quality_classifier as q
from lumenquarry.llm.queries import op8_quality_classifier


def auc(rows):
    good, bad = np.array([s for s, y in rows if y == 1]), np.array([s for s, y in rows if y == 0])
    return np.mean((good[:, None] > bad[None]) + 0.5 * (good[:, None] == bad[None]))


def test_whole_table(spark, sf_dir):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = op8_quality_classifier(spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    if len({y for _, y in held}) == 2:
        assert auc(held) > 0.9


def table(spark, n=600):
    r = random.Random(4)
    words = ["".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 7))) for _ in range(400)]
    text = lambda y: " ".join(w if y else w + r.choice(("###", "%%%")) if r.random() < 0.5 else w.upper() for w in r.choices(words, k=60))
    rows = [(i, text(i % 3 > 0), int(i % 3 > 0)) for i in range(n)]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id bigint, text string, quality string")
    return docs, spark.createDataFrame([(i, y, 0) for i, _, y in rows], "doc_id bigint, quality int, text int")


def test_held_out_accuracy_and_calibration(spark):
    docs, labels = table(spark)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    rows = [(r.score, truth[r.doc_id]) for r in q.scored(docs, q.fitted(docs, labels)).collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert auc(rows) > 0.97 and abs(np.mean([s for s, _ in rows]) - np.mean([y for _, y in rows])) < 0.1


def test_held_out_labels_are_never_used(spark):
    docs, labels = table(spark, 300)
    from pyspark.sql import functions as F

    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r.doc_id: r.score for r in q.scored(docs, q.fitted(docs, x)).collect()} for x in (labels, turned))
    assert a == b


def test_odd_rows(spark):
    docs, labels = table(spark, 60)
    more = docs.unionByName(spark.createDataFrame([(900, None, ""), (901, "", ""), (None, "a b", ""), (902, "w " * 100_000, ""), (902, "twice", "")], docs.schema))
    noisy = labels.unionByName(spark.createDataFrame([(None, 1, 0), (900, None, 0), (901, 1, 0), (902, 0, 0), (777, 1, 0)], labels.schema))
    model = q.fitted(more, noisy)
    assert q.scored(more, model).count() == more.count() and q.scored(more.limit(0), model).count() == 0
    alone = q.fitted(docs, labels.where("quality = 1"))
    assert {r.score for r in q.scored(docs, alone).collect()} == {1.0}
    assert {r.score for r in q.scored(docs, q.fitted(docs, labels.limit(0))).collect()} == {0.5}

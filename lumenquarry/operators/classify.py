"""Multi-label classification: rules, neighbours, prototypes and their ensemble."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import CHUNK, mean_vector, packed


def rules(docs: DataFrame, doc: str, text: str, keywords: DataFrame) -> DataFrame:
    """(doc, label, p): keywords (label, keyword) that begin at a word's start, each weighted by its words; p = mass / (sum + 1).

    keywords is a taxonomy: its size doesn't grow with the documents, and it is broadcast only below Spark's own threshold.
    """
    k = keywords.select("label", "keyword", F.greatest(F.lit(1), F.size(F.split("keyword", " "))).alias("w"))
    hit = docs.select(F.col(doc).alias("doc"), F.lower(text).alias("t")).join(k, F.expr("t rlike concat('(^|[^a-z0-9_])\\\\Q', lower(keyword), '\\\\E')"))
    mass = hit.groupBy("doc", "label").agg(F.sum("w").alias("m"))
    return mass.select("doc", "label", (F.col("m") / (F.sum("m").over(Window.partitionBy("doc")) + 1)).alias("p"))


def neighbour_votes(neighbours: DataFrame, temperature: float = 0.08) -> DataFrame:
    """(query, label, p) from rows (query, label, score, weight)."""
    votes = neighbours.groupBy("query", "label").agg(F.sum(F.col("weight") * F.exp(F.col("score") / temperature)).alias("v"))
    return votes.select("query", "label", (F.col("v") / F.sum("v").over(Window.partitionBy("query"))).alias("p"))


def prototypes(rows: DataFrame, label: str, vector: str) -> DataFrame:
    """(label, prototype): mean vectors, a row for each label."""
    return mean_vector(rows.withColumnRenamed(label, "label"), ["label"], vector, "prototype")


def prototype_softmax(rows: DataFrame, key: str, vector: str, protos: DataFrame, temperature: float = 0.05) -> DataFrame:
    """(key, label, p): softmax over cosines with all prototypes: one matrix product for each chunk of rows, beside one row that holds the taxonomy.

    Keys are integers. Rows without key or vector are left out; so are prototypes without a vector.
    """
    kind = protos.schema["label"].dataType.simpleString()
    known = protos.where("prototype is not null").select(F.col("label").cast("string").alias("label"), F.col("prototype").cast("array<double>").alias("prototype"))
    table = F.broadcast(known.agg(F.sort_array(F.collect_list(F.struct("label", "prototype"))).alias("protos")))  # one row: the taxonomy

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = np.frombuffer(r["ids"], np.int64)
                if not r["protos"] or not len(ids):
                    continue
                m = np.array([p["prototype"] for p in r["protos"]])
                m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
                z = (np.frombuffer(r["matrix"]).reshape(len(ids), -1) @ m.T) / temperature
                e = np.exp(z - z.max(axis=1, keepdims=True))
                e /= e.sum(axis=1, keepdims=True)
                labels = pa.array([p["label"] for p in r["protos"]] * len(ids), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, len(m))), labels, pa.array(e.reshape(-1))], ["key", "label", "p"])

    found = packed(rows, key, vector, CHUNK).join(table).mapInArrow(run, "key bigint, label string, p double")
    return found.withColumn("label", F.col("label").cast(kind))


def ensemble(parts: list[tuple[DataFrame, float]], key: str = "key") -> DataFrame:
    """(key, label, confidence): the label with the largest weighted sum; ties by label."""
    rows = None
    for frame, weight in parts:
        part = frame.select(F.col(frame.columns[0]).alias(key), "label", (F.col("p") * weight).alias("p"))
        rows = part if rows is None else rows.unionByName(part)
    sums = rows.groupBy(key, "label").agg(F.sum("p").alias("p"))
    best = Window.partitionBy(key).orderBy(F.desc(F.round("p", 9)), "label")
    return sums.withColumn("n", F.row_number().over(best)).where("n = 1").select(key, "label", F.round("p", 3).alias("confidence"))


def combined_affect(cues: DataFrame, key: str, weights: list[list[float]], intercept: list[float], classes: list[str]) -> DataFrame:
    """(key, label, p): softmax(W x + b) over an array column ``cues``."""
    scores = [F.aggregate(F.zip_with("cues", F.array(*[F.lit(float(w)) for w in row]), lambda x, w: x * w), F.lit(float(b)), lambda a, x: a + x) for row, b in zip(weights, intercept, strict=True)]
    out = cues.withColumn("z", F.array(*scores)).withColumn("top", F.array_max("z")).withColumn("e", F.transform("z", lambda z: F.exp(z - F.col("top"))))
    out = out.withColumn("total", F.aggregate("e", F.lit(0.0), lambda a, x: a + x))
    return out.select(F.col(key).alias("key"), F.posexplode("e").alias("i", "e"), "total").select("key", F.element_at(F.array(*[F.lit(c) for c in classes]), F.col("i") + 1).alias("label"), (F.col("e") / F.col("total")).alias("p"))


def affect_training(rows: DataFrame, cues: str, label: str, c: float = 2.0, iterations: int = 200) -> tuple[list[str], list[list[float]], list[float]]:
    """(classes, weights, intercepts) for combined_affect(): a multinomial logistic regression with balanced class weights.

    The penalty is half the squared weights over ``c``, for summed losses. Spark fits it over all rows; only the model, of classes times
    cues, comes to the driver. Rows without cues or label are left out.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    t = rows.where(F.col(cues).isNotNull() & F.col(label).isNotNull()).select(F.col(cues).cast("array<double>").alias("x"), F.col(label).cast("string").alias("name"))
    counts = t.groupBy("name").agg(F.count("*").alias("n")).orderBy("name").collect()  # one row for each class
    classes, n = [r["name"] for r in counts], sum(r["n"] for r in counts)
    known = F.create_map(*[F.lit(z) for i, r in enumerate(counts) for z in (r["name"], F.struct(F.lit(float(i)).alias("label"), F.lit(n / (len(counts) * r["n"])).alias("weight")))])
    t = t.select(array_to_vector("x").alias("features"), F.element_at(known, F.col("name")).alias("k")).select("features", "k.label", "k.weight")
    model = LogisticRegression(family="multinomial", weightCol="weight", regParam=1.0 / (c * n), standardization=False, maxIter=iterations, tol=1e-9).fit(t)
    return classes, model.coefficientMatrix.toArray().tolist(), model.interceptVector.toArray().tolist()

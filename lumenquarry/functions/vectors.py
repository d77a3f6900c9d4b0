"""Vectors as array columns, and exact search of a query set against all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import removed, scratch, written

#: Rows of the corpus and queries in one matrix; bytes of query vectors that are broadcast; tasks that share a group of queries at most.
CHUNK, BLOCK, BROADCAST, SALTS = 4096, 2048, 64 * 2**20, 64
#: Queries and rows that are multiplied at a time. Scores are compared after rounding, so that equal vectors tie wherever they lie.
TILE, DIGITS = 512, 12


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def mean_vector(df: DataFrame, keys: list[str], vector: str, to: str = "mean") -> DataFrame:
    """Elementwise mean by group: pre-aggregated on the map side, one row for each group and position is shuffled."""
    parts = df.select(*keys, F.posexplode(vector).alias("pos", "x")).groupBy(*keys, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"])
    return parts.groupBy(*keys).agg(ordered.alias(to))


def _unit(vectors: list) -> np.ndarray:
    m = np.array(vectors, np.float64)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300) if len(m) else m


def packed(rows: DataFrame, key: str, vector: str, size: int) -> DataFrame:
    """(ids, matrix): unit vectors of up to ``size`` rows of one task as one row. Rows without key or vector are left out; all vectors have one length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, size):
                part = batch.slice(start, size)
                m = _unit(part.column("v").to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array([part.column("k").to_numpy().tobytes()], pa.binary()), pa.array([m.tobytes()], pa.binary())], ["ids", "matrix"])

    return rows.select(F.col(key).cast("bigint").alias("k"), F.col(vector).alias("v")).where("k is not null and v is not null").mapInArrow(run, "ids binary, matrix binary")


def best_columns(scores: np.ndarray, keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest scores of each row and their keys (one row of keys, or one for each row), best first; ties by the smaller key."""
    keys = np.broadcast_to(keys, scores.shape)
    if scores.shape[1] > 4 * k:
        cut = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
        over, tied = scores > cut, scores == cut
        wanted = k - over.sum(axis=1, keepdims=True)
        by_key = np.argsort(np.where(tied, keys, np.iinfo(np.int64).max), axis=1, kind="stable") if (tied.sum(axis=1, keepdims=True) > wanted).any() else None
        if by_key is not None:
            first = np.zeros_like(tied)
            np.put_along_axis(first, by_key, np.arange(scores.shape[1])[None, :] < wanted, axis=1)
            tied &= first
        at = np.nonzero(over | tied)[1].reshape(len(scores), k)
        scores, keys = np.take_along_axis(scores, at, axis=1), np.take_along_axis(keys, at, axis=1)
    order = np.lexsort((keys, -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, axis=1), np.take_along_axis(keys, order, axis=1)


def _numbers(column: pa.Array, i: int, kind: type) -> np.ndarray:
    """The numbers in one binary value, not copied."""
    return np.frombuffer(column[i].as_buffer(), kind)


def merge_best(scores: np.ndarray, keys: np.ndarray, found: np.ndarray, names: np.ndarray) -> None:
    """Puts scores ``found`` of columns ``names`` among each row's k best, in place: only what reaches a row's last one is sorted."""
    k = scores.shape[1]
    r, c = np.nonzero(found >= scores[:, -1:] - 10.0**-DIGITS)
    new = np.round(found[r, c], DIGITS)
    some = np.unique(r)
    r = np.concatenate([r, np.repeat(some, k)])
    x, y = np.concatenate([new, scores[some].reshape(-1)]), np.concatenate([names[c], keys[some].reshape(-1)])
    order = np.lexsort((y, -x, r))
    r = r[order]
    first = order[np.arange(len(r)) - np.searchsorted(r, r) < k]  # every row that changes had k and keeps k
    scores[some], keys[some] = x[first].reshape(-1, k), y[first].reshape(-1, k)


def _best(k: int, exclude_self: bool):
    """Rows of a chunk of the corpus beside a block of queries in, each query's k best of the whole task out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                c, q = _numbers(batch.column("ids"), i, np.int64), _numbers(batch.column("qids"), i, np.int64)
                m, n = _numbers(batch.column("matrix"), i, np.float64).reshape(len(c), -1), _numbers(batch.column("qmatrix"), i, np.float64).reshape(len(q), -1)
                scores, keys = best.setdefault(q.tobytes(), (np.full((len(q), k), -np.inf), np.full((len(q), k), np.iinfo(np.int64).max)))
                shared = exclude_self and np.isin(q, c).any()
                for a in range(0, len(q), TILE):
                    for b in range(0, len(c), TILE):
                        found = n[a : a + TILE] @ m[b : b + TILE].T
                        if shared:
                            found[q[a : a + TILE, None] == c[None, b : b + TILE]] = -np.inf
                        merge_best(scores[a : a + TILE], keys[a : a + TILE], found, c[b : b + TILE])
        for qids, (scores, keys) in best.items():
            q = np.repeat(np.frombuffer(qids, np.int64), k)
            ok = np.isfinite(scores.reshape(-1))
            yield pa.RecordBatch.from_arrays([pa.array(x.reshape(-1)[ok]) for x in (q, keys, scores)], ["query_id", "c", "score"])

    return run


def top_k(corpus: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", exclude_self: bool = True) -> DataFrame:
    """(query_id, <key>, score, rank): the k rows with the largest cosine for each query; ties by the smaller key.

    Both sides are packed into matrices of bounded size, and a task multiplies chunks of the corpus with blocks of queries and keeps k rows for each query;
    only these are shuffled. Queries whose counted size is under BROADCAST bytes are broadcast. More are dealt to groups of that size, which meet the corpus
    one after another: both sides are written once, and nothing is repeated on disk, however many queries there are. Query ids are unique.
    """
    rows, components = queries.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).agg(F.count("*"), F.coalesce(F.sum(F.size(vector)), F.lit(0))).head()
    blocks = packed(queries.repartition(max(1, -(-rows // BLOCK))), key, vector, BLOCK).select(F.col("ids").alias("qids"), F.col("matrix").alias("qmatrix"))
    chunks = packed(corpus, key, vector, CHUNK)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "c")

    def met(some: DataFrame, others: DataFrame) -> DataFrame:
        pairs = some.join(F.broadcast(others)).select("ids", "matrix", "qids", "qmatrix")  # each chunk with a bounded number of blocks
        found = pairs.mapInArrow(_best(k, exclude_self), "query_id bigint, c bigint, score double")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumnRenamed("c", key)

    groups = -(-components * 8 // BROADCAST)
    if groups <= 1:
        return met(chunks, blocks)
    spark = corpus.sparkSession
    path = scratch(spark, "top-k")
    chunks = written(chunks.repartition(min(SALTS, 2 * spark.sparkContext.defaultParallelism)), f"{path}/corpus")
    blocks = written(blocks.withColumn("g", F.pmod(F.xxhash64("qids"), F.lit(groups))), f"{path}/queries", "g")
    for (g,) in blocks.select("g").distinct().orderBy("g").collect():  # one for each group
        one = met(chunks, blocks.where(F.col("g") == g).drop("g"))
        written(one, f"{path}/found/g={g}")
    removed(spark, f"{path}/corpus", f"{path}/queries")
    return spark.read.schema(one.schema).parquet(f"{path}/found/*")

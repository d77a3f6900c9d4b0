"""Centroid clustering on exact integers, screened by the norms of segments.

A vector becomes integers floor(scale * x). Its components are cut into segments; beside each vector stands the floor
of each segment's Euclidean norm, a compressed form of one number a segment. By Cauchy-Schwarz the squared distance to a
centroid is at least the sum over segments of the squared difference of norms; with floors, a difference less by one is
still a bound, and an exact one in integers. The centroid of the least bound gets an exact distance first; of the others, those
whose bound doesn't exceed it. The others can't be nearest, not even by a tie.

Vectors and norms are written once. A round reads them, and each task sends one row of sums for each centroid; only these are
shuffled and meet at the driver as k sums, so that a cluster of any size is no task of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, unused

DIMENSIONS, SCALE, CLUSTERS, ROUNDS, SEED = 64, 1024, 8, 10, 3
SEGMENT = 8
#: Integers under this have squared distances that fit 64 bits; vectors with larger ones are computed in Python's integers.
NARROW = 2**27
#: Partial sums of many tasks are added in so many groups first.
SALTS = 32
_KEPT = pa.schema([("row", pa.int64()), ("ints", pa.list_(pa.int64())), ("norms", pa.list_(pa.int64())), ("wide", pa.list_(pa.string()))])


def integers(x: list[float], scale: int = SCALE) -> list[int]:
    """floor(scale * x) of finite numbers, also where the product is no finite double."""
    return [int(np.floor(scale * v)) if abs(v) < 2.0**53 else scale * int(v) for v in map(float, x)]


def segment_norms(x: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
    """The floor of the norm of each segment of rows of narrow integers."""
    starts = np.arange(0, x.shape[1], segment)
    squares = np.add.reduceat(x * x, starts, axis=1)
    root = np.sqrt(squares.astype(np.float64)).astype(np.int64)
    root -= root * root > squares
    return root + ((root + 1) * (root + 1) <= squares)


def _lists(flat: np.ndarray, width: int, null: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Rows of ``width`` values as lists; null where ``null`` says so."""
    offsets = np.concatenate(([0], np.cumsum(np.where(null, 0, width)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.reshape(-1), kind), mask=pa.array(null))


def _prepared(scale: int, segment: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.array(batch.column("vector").to_pylist(), np.float64)
            wide = (np.abs(x) >= NARROW / scale).any(axis=1)
            ints = np.floor(scale * x[~wide]).astype(np.int64)
            columns = [
                batch.column("row"), _lists(ints, x.shape[1], wide, pa.int64()),
                _lists(segment_norms(ints, segment) if len(ints) else ints, -(-x.shape[1] // segment), wide, pa.int64()),
                pa.array([[str(v) for v in integers(r, scale)] if w else None for r, w in zip(x, wide, strict=True)], pa.list_(pa.string())),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=_KEPT)

    return run


def screened(x: np.ndarray, norms: np.ndarray, centroids: np.ndarray, segment: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest centroid of each row of narrow integers, its squared distance, and how many exact distances that took."""
    own = segment_norms(centroids, segment)
    gaps = np.maximum(np.abs(norms[:, None, :] - own[None, :, :]) - 1, 0)
    bound = (gaps * gaps).sum(axis=2)
    near = bound.argmin(axis=1)
    first, best = near.copy(), ((x - centroids[near]) ** 2).sum(axis=1)
    exact = len(x)
    for j in range(len(centroids)):
        at = np.flatnonzero((bound[:, j] <= best) & (first != j))
        d = ((x[at] - centroids[j]) ** 2).sum(axis=1)
        better = (d < best[at]) | ((d == best[at]) & (j < near[at]))
        near[at[better]], best[at[better]] = j, d[better]
        exact += len(at)
    return near, best, exact


def _nearest(batch: pa.RecordBatch, centroids: list[list[int]], segment: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(places in the batch, vectors, nearest centroids, distances): the narrow vectors of a batch, then the wide ones."""
    wide = np.asarray(batch.column("ints").is_null())
    c = np.array(centroids, object)
    narrow = not len(c) or max(abs(v) for row in centroids for v in row) < NARROW
    at = np.flatnonzero(~wide)
    if len(at) and narrow:
        x = batch.column("ints").flatten().to_numpy().reshape(len(at), -1)
        near, best, _ = screened(x, batch.column("norms").flatten().to_numpy().reshape(len(at), -1), c.astype(np.int64), segment)
        yield at, x, near, best
    for i in np.flatnonzero(wide) if narrow else range(batch.num_rows):
        row = batch.column("wide")[i].as_py() if wide[i] else batch.column("ints")[i].as_py()
        x = np.array([int(v) for v in row], object)[None, :]
        d = ((x - c) ** 2).sum(axis=1)
        j = min(range(len(c)), key=lambda k: (d[k], k))
        yield np.array([i]), x, np.array([j]), np.array([d[j]], object)


def _sums(centroids: list[list[int]], segment: int):
    """A task's sums: one row for each centroid to which some vector is nearest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = [0] * len(centroids), [0] * len(centroids)
        for batch in batches:
            for _, x, near, _ in _nearest(batch, centroids, segment):
                for j in np.unique(near):
                    rows = x[near == j]
                    count[j], total[j] = count[j] + len(rows), total[j] + rows.sum(axis=0).astype(object)
        used = [j for j, n in enumerate(count) if n]
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(used, pa.int32()), "n": pa.array([count[j] for j in used], pa.int64()), "sums": pa.array([[str(v) for v in total[j]] for j in used], pa.list_(pa.string()))})

    return run


def _added(table: pa.Table) -> pa.Table:
    """Rows of one cluster as one: exact sums of any size."""
    sums = [str(sum(map(int, column))) for column in zip(*table.column("sums").to_pylist(), strict=True)]
    return pa.table({"cluster": table.column("cluster")[:1].combine_chunks(), "n": pa.array([sum(table.column("n").to_pylist())], pa.int64()), "sums": pa.array([sums], pa.list_(pa.string()))})


def _assigned(centroids: list[list[int]], segment: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, distance = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, object)
            for at, _, near, best in _nearest(batch, centroids, segment):
                cluster[at], distance[at] = near, best
            distance = pa.array([int(d) if d < 2**63 else None for d in distance], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(cluster), distance], ["row", "cluster", "distance"])

    return run


def clustered(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS,
    dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED, segment: int = SEGMENT,
) -> DataFrame:
    """A row for each kept vector: its key, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Kept are vectors with exactly ``dimensions`` components, none null or non-finite; others, null vectors included, give no row. Centroids
    start as the vectors with the smallest sha256 of ``seed:key`` (a null key counts as empty; equal keys go by their components).
    Fewer vectors than ``clusters`` give fewer centroids. Distances are squared; of equally near centroids the smaller number wins. A
    centroid becomes the floor of its vectors' mean, and stays where it has none. Repeated rows count each. An empty table gives no rows. A
    distance or sum beyond 64 bits is null. Other columns aren't read.
    """
    work = Workspace(vectors.sparkSession, "centroids")
    x = F.transform(vectors[vector], lambda v: v.cast("double"))
    sound = (F.size("vector") == dimensions) & F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = vectors.select(vectors[key].alias("key"), x.alias("vector")).where(F.coalesce(sound, F.lit(False)))
    rows = work.keep(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256)
    first = rows.orderBy(hashed, "vector").limit(clusters).select("vector").collect()  # the start: ``clusters`` rows
    centroids = [integers(r["vector"], scale) for r in first]
    kept = work.keep(rows.select("row", "vector").mapInArrow(_prepared(scale, segment), "row bigint, ints array<bigint>, norms array<bigint>, wide array<string>"), "kept")
    for _ in range(rounds if centroids else 0):
        parts = kept.mapInArrow(_sums(centroids, segment), "cluster int, n bigint, sums array<string>")
        for keys in (["cluster", F.pmod(F.xxhash64("sums"), F.lit(SALTS))], ["cluster"]):
            parts = parts.groupBy(*keys).applyInArrow(_added, "cluster int, n bigint, sums array<string>")
        for r in parts.collect():  # a row for each centroid
            centroids[r["cluster"]] = [int(s) // r["n"] for s in r["sums"]]
    found = work.keep(kept.mapInArrow(_assigned(centroids, segment), "row bigint, cluster int, distance bigint"), "assigned")
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("sum"), F.count("*").alias("n"), F.count("distance").alias("known")).collect()
    fits = lambda v: v if v is not None and v < 2**63 else None
    by = {r["cluster"]: fits(int(r["sum"])) if r["n"] == r["known"] else None for r in sums}
    total = fits(sum(by.values())) if None not in by.values() else None
    digests = [(j, by.get(j), total, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centroids)]
    facts = vectors.sparkSession.createDataFrame(digests, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    name = unused(facts.withColumns({"distance": F.lit(0), "row": F.lit(0)}), key)
    out = rows.select("row", F.col("key").alias(name)).join(found, "row").join(F.broadcast(facts), "cluster")
    return out.select(name, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

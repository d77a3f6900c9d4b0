"""Connected components of an edge table: union-find within each partition, then alternating large and small stars.

Each round reads and writes a table in the shared folder; the number of rounds grows with the
logarithm of the longest path that is left between partitions. Neighbours' minima are pre-aggregated and joined on
salted keys, so that a node with very many edges is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace

SALTS = 8
#: Edges that union-find holds at a time in one task.
HELD = 1_000_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) in, (node, least node of its tree) out: the trees that a task's edges make, HELD edges at a time."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := root.setdefault(x, x)) != x:
            root[x] = x = root[y]
        return x

    def out() -> pa.RecordBatch:
        pairs = [(x, r) for x in root if (r := find(x)) != x]
        a = np.array(pairs, np.int64).reshape(-1, 2)
        root.clear()
        return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], ["u", "v"])

    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            a, b = find(u), find(v)
            if a != b:
                root[max(a, b)] = min(a, b)
        if len(root) > HELD:
            yield out()
    yield out()


def _with_minimum(edges: DataFrame) -> DataFrame:
    """(u, v) -> (u, v, m): m is the least of u and its neighbours."""
    m = edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    m = m.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    return edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(m, ["u", "salt"]).drop("salt")


def connected_components(edges: DataFrame, work: Workspace, name: str = "components") -> DataFrame:
    """(node, component) for every node that has an edge; the component is its least node.

    ``edges`` has bigint columns u and v. Rows with a null end and loops are ignored; repeated edges count once. An empty
    table has no components.
    """
    now = edges.where("u is not null and v is not null and u <> v").select("u", "v").mapInArrow(_forest, "u bigint, v bigint")
    now = work.keep(now.distinct(), f"{name}-0")
    i, before = 0, tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).head())
    while True:
        # Large star: every larger neighbour of u is linked with the least neighbour of u.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_minimum(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        # Small star: u and its smaller neighbours are linked with the least of them.
        small = _with_minimum(large.distinct())
        after = small.select("u", F.col("m").alias("v")).unionByName(small.select(F.col("v").alias("u"), F.col("m").alias("v")))
        after = work.keep(after.where("u <> v").distinct(), f"{name}-{i + 1}")
        mark = tuple(after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).head())
        work.drop(f"{name}-{i}")
        now, i, changed, before = after, i + 1, mark != before, mark
        if not changed:
            roots = now.select(F.col("v").alias("node")).distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))

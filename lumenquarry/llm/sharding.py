"""Sharding by fixed virtual slots. Only DataFrame functions.

Records are hashed into ``slots`` virtual slots, bytes are summed by slot, and a versioned table maps slots to shards. The
map is small whatever the corpus: one row for each slot and version. A new version edits as few slots as bring
the shards' sizes near each other.
"""

from __future__ import annotations

import heapq
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, text_or_empty

SLOTS, SHARDS = 4096, 16


def size_of(text: str) -> Column:
    return (F.octet_length(text_or_empty(text)) + 1).cast("bigint")


def virtual_slot(slots: int = SLOTS) -> Column:
    """A record's slot. The text takes part, so that records that share an id, or have none, are spread."""
    return F.pmod(F.xxhash64(F.col("doc_id"), F.crc32(text_or_empty("text").cast("binary"))), F.lit(slots)).cast("int")


def slot_bytes(docs: DataFrame, slots: int = SLOTS) -> list[int]:
    """Bytes of each slot. At most ``slots`` rows come to the driver."""
    rows = docs.groupBy(virtual_slot(slots).alias("v")).agg(F.sum(size_of("text")).alias("b")).collect()
    out = [0] * slots
    for r in rows:
        out[r["v"]] = r["b"]
    return out


def first_map(weights: list[int], shards: int = SHARDS) -> list[int]:
    """slot -> shard: the heaviest slot first, each to the lightest shard so far."""
    heap, out = [(0, s) for s in range(shards)], [0] * len(weights)
    for v in sorted(range(len(weights)), key=lambda v: (-weights[v], v)):
        total, shard = heapq.heappop(heap)
        out[v] = shard
        heapq.heappush(heap, (total + weights[v], shard))
    return out


def rebalanced(old: list[int], weights: list[int], shards: int, tolerance: float = 0.02) -> list[int]:
    """An edited map: slots leave shards that are gone or over the mean by more than ``tolerance``, and no others."""
    out, totals = list(old), [0] * shards
    for v, s in enumerate(old):
        if s < shards:
            totals[s] += weights[v]
    limit = (1 + tolerance) * sum(weights) / shards
    moved = [v for v, s in enumerate(old) if s >= shards]
    for v in sorted((v for v, s in enumerate(old) if s < shards), key=lambda v: (-weights[v], v)):
        if weights[v] and totals[old[v]] - weights[v] / 2 > limit:
            totals[old[v]] -= weights[v]
            moved.append(v)
    heap = [(t, s) for s, t in enumerate(totals)]
    heapq.heapify(heap)
    for v in sorted(moved, key=lambda v: (-weights[v], v)):
        total, shard = heapq.heappop(heap)
        out[v] = shard
        heapq.heappush(heap, (total + weights[v], shard))
    return out


def write_map(spark: SparkSession, path: str, version: int, shard_of: list[int]) -> None:
    """Adds a version to the stored map. Versions are partitions and are never changed."""
    rows = spark.range(1).select(F.posexplode(F.from_json(F.lit(json.dumps(shard_of)), "array<int>")).alias("virtual_slot", "shard"))
    rows.coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={version}")


def read_map(spark: SparkSession, path: str, version: int) -> list[int]:
    rows = spark.read.schema("virtual_slot int, shard int").parquet(f"{path}/version={version}").orderBy("virtual_slot").collect()
    return [r["shard"] for r in rows]


def sharded(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, path: str | None = None, version: int = 1, edit: tuple[int, int] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot, shard and slot, the place in the shard, gapless from 0.

    The law is that of bytes: sizes are near equal, as near as the heaviest slot allows. docs has doc_id and text, both
    nullable (a null text has no bytes); repeated rows are separate records in one virtual slot. The map is
    stored as ``version`` under ``path``; with ``edit`` = (old version, old number of shards) it is that version, edited.
    An empty table has an empty result.
    """
    spark = docs.sparkSession
    path = path or f"{Workspace(spark, 'slot-map').path}"
    rows = docs.select("doc_id", "text")
    weights = slot_bytes(rows, slots)
    write_map(spark, path, version, rebalanced(read_map(spark, path, edit[0]), weights, shards) if edit else first_map(weights, shards))
    shard_of = F.lit(read_map(spark, path, version)).cast("array<int>")
    crc = F.crc32(text_or_empty("text").cast("binary"))
    light = rows.select("doc_id", size_of("text").alias("size"), crc.alias("text_crc32"), virtual_slot(slots).alias("virtual_slot"))
    light = light.withColumn("shard", F.element_at(shard_of, F.col("virtual_slot") + 1))
    # Places: counted by virtual slot, summed over the slots of a shard, and numbered within a virtual slot alone.
    counts = rows.groupBy(virtual_slot(slots).alias("virtual_slot")).agg(F.count("*").alias("n")).withColumn("shard", F.element_at(shard_of, F.col("virtual_slot") + 1))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1))
    before = counts.select("virtual_slot", F.coalesce(before, F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")) - 1
    out = light.withColumn("within", within).join(F.broadcast(before), "virtual_slot")  # one row for each virtual slot
    return out.select("doc_id", "size", "text_crc32", "virtual_slot", "shard", (F.col("before") + F.col("within")).alias("slot"))

"""Relational building blocks: merges, paging, ranks, set operations and joins on arrays."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import scratch, written

#: Pairs that one task of overlapping() counts, about.
PAIRS = 1_000_000


def conjunction(*predicates: Column | None) -> Column:
    """All predicates that are given."""
    return reduce(lambda a, b: a & b, [p for p in predicates if p is not None], F.lit(True))


def window_between(ts: Column, now: Column, start: str, end: str) -> Column:
    """The half-open window (now - end, now - start]."""
    return (ts <= now - F.expr(f"INTERVAL {start}")) & (ts > now - F.expr(f"INTERVAL {end}"))


def latest_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order, which should be total."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def top_per_group(df: DataFrame, keys: list[str], k: int, *order: Column, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def upserted(target: DataFrame, delta: DataFrame, key: str, keep: list[str] | None = None) -> DataFrame:
    """The target after an upsert by key: delta's rows win, but for the columns in ``keep`` where the key exists. Adds ``op``.

    delta has one row for each key; see latest_per_key().
    """
    keep = keep or []
    t, d = target.alias("t"), delta.withColumn("_new", F.lit(True)).alias("d")
    both = t.join(d, F.col(f"t.{key}") == F.col(f"d.{key}"), "full_outer")
    new, old = F.col("d._new").isNotNull(), F.col(f"t.{key}").isNotNull()
    cols = [F.coalesce(f"t.{key}", f"d.{key}").alias(key)]
    for c in target.columns:
        if c != key:
            cols.append((F.when(old, F.col(f"t.{c}")).otherwise(F.col(f"d.{c}")) if c in keep else F.when(new, F.col(f"d.{c}")).otherwise(F.col(f"t.{c}"))).alias(c))
    return both.select(*cols, F.when(new & old, "updated").when(new, "created").otherwise("kept").alias("op"))


def deleted(target: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return target.join(ids.select(key), key, "left_anti")


def in_ranges(df: DataFrame, *order: str) -> DataFrame:
    """The rows, written once, with ``part``: the number of their range in the given order. Parts are data, the same whenever they are read."""
    return written(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), scratch(df.sparkSession, "ranges"))


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """Adds i, each row's place from 0 in a total order, and n, the number of rows; no task sorts all rows."""
    rows = in_ranges(df, *order)
    counts = rows.groupBy("part").agg(F.count("*").alias("c"))
    every = Window.partitionBy(F.lit(1))  # a row for each range
    before = F.coalesce(F.sum("c").over(every.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("part", before.alias("before"), F.sum("c").over(every).alias("n"))
    inner = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return rows.join(starts, "part").withColumn("i", F.col("before") + inner).drop("part", "before")


def evenly(df: DataFrame, count: int, *order: str) -> DataFrame:
    """``count`` rows at even distances in a total order, or all rows where there are fewer; equal places give one row."""
    rows = numbered(df, *order)
    n = rows.agg(F.max("n").alias("m"))  # one row
    wanted = rows.sparkSession.range(count).join(n).select(F.floor(F.col("id") * F.col("m") / float(count)).alias("i")).distinct()
    return rows.join(F.broadcast(wanted), "i", "left_semi").drop("i", "n")


def keyset_page(df: DataFrame, sort: str, key: str, after: tuple | None, limit: int) -> DataFrame:
    """The page after the cursor, newest first; one row more than ``limit`` tells that there is another page."""
    if after is not None:
        at, last = F.lit(after[0]).cast(df.schema[sort].dataType), F.lit(after[1])
        df = df.where((F.col(sort) < at) | ((F.col(sort) == at) & (F.col(key) < last)))
    return df.orderBy(F.desc(sort), F.desc(key)).limit(limit + 1)


def offset_page(df: DataFrame, limit: int, offset: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def page_with_total(df: DataFrame, limit: int, offset: int, *order: Column, total: str = "total") -> DataFrame:
    """offset_page() with the number of all rows beside each; an empty page has no row to tell it."""
    return offset_page(df, limit, offset, *order).join(F.broadcast(df.agg(F.count("*").alias(total))))


def anti_join_members(df: DataFrame, key: str, groups: DataFrame, members: str) -> DataFrame:
    """Rows whose key is in no group's array: the array is exploded first, so that the join has an equality."""
    return df.join(groups.select(F.explode(members).alias(key)).distinct(), key, "left_anti")


def overlapping(left: DataFrame, left_id: str, right: DataFrame, right_id: str, array: str) -> DataFrame:
    """Pairs of rows whose arrays share an element, and how many they share, by an equi-join of exploded elements.

    How many pairs come of it is counted first, from the elements' frequencies: a task gets about PAIRS of them. The bytes that go into
    such a join don't tell, as each of few rows may meet very many.
    """
    a = left.select(F.col(left_id).alias("left_id"), F.explode(F.array_distinct(array)).alias("x"))
    b = right.select(F.col(right_id).alias("right_id"), F.explode(F.array_distinct(array)).alias("x"))
    met = a.groupBy("x").agg(F.count("*").alias("m")).join(b.groupBy("x").agg(F.count("*").alias("n")), "x")
    pairs = met.agg(F.coalesce(F.sum(F.col("m").cast("double") * F.col("n")), F.lit(0.0))).head()[0]
    tasks = max(left.sparkSession.sparkContext.defaultParallelism, math.ceil(pairs / PAIRS))
    # Pairs are dealt before they are counted: in front of that, a map of them would grow as long as its task has pairs.
    found = a.repartition(tasks, "x").join(b.repartition(tasks, "x"), "x").select("left_id", "right_id")
    return found.repartition(tasks, "left_id", "right_id").groupBy("left_id", "right_id").agg(F.count("*").alias("shared"))


def asof(left: DataFrame, right: DataFrame, by: str, ts: str, value: str) -> DataFrame:
    """left with the newest ``value`` of right at or before its ``ts``: one sort of the union, no range join."""
    a = left.withColumns({"_right": F.lit(0), "_value": F.lit(None).cast(right.schema[value].dataType)})
    b = right.select(by, ts, F.col(value).alias("_value")).withColumn("_right", F.lit(1))
    w = Window.partitionBy(by).orderBy(ts, F.desc("_right")).rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True).withColumn(f"asof_{value}", F.last("_value", ignorenulls=True).over(w))
    return both.where("_right = 0").drop("_right", "_value")


def share(weight: str, *by: str) -> Column:
    """A row's part of its group's total."""
    return F.col(weight) / F.sum(weight).over(Window.partitionBy(*by))

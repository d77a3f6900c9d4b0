"""Data-health checks: each is a row (name, n), and a report rates them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str, name: str) -> DataFrame:
    """How many rows of child refer to no row of parent. Null keys refer to nothing and aren't counted."""
    ids = parent.select(F.col(parent_key).alias(key))
    return child.where(F.col(key).isNotNull()).join(ids, key, "left_anti").agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")


def duplicates(df: DataFrame, digest: str, name: str) -> DataFrame:
    """How many groups of rows share a digest."""
    return df.groupBy(digest).agg(F.count("*").alias("c")).where("c > 1").agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")


def violations(df: DataFrame, condition, name: str) -> DataFrame:
    return df.agg(F.count_if(condition).alias("n")).select(F.lit(name).alias("name"), "n")


def report(*checks: DataFrame, warn_above: int = 0) -> DataFrame:
    """(name, n, level) of all checks."""
    rows = checks[0]
    for c in checks[1:]:
        rows = rows.unionByName(c)
    return rows.withColumn("level", F.when(F.col("n") > warn_above, "warn").otherwise("ok"))

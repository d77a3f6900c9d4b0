"""Feedback analytics with Wilson bounds, and rule-based findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def wilson_low(hits: Column, n: Column, z: float = 1.96) -> Column:
    p, w = hits / n, F.lit(z * z) / n
    return F.when(n > 0, (p + w / 2 - F.lit(z) * F.sqrt(p * (1 - p) / n + w / (4 * n))) / (1 + w))


def wilson_high(hits: Column, n: Column, z: float = 1.96) -> Column:
    p, w = hits / n, F.lit(z * z) / n
    return F.when(n > 0, (p + w / 2 + F.lit(z) * F.sqrt(p * (1 - p) / n + w / (4 * n))) / (1 + w))


def totals(requests: DataFrame, feedback: DataFrame, key: str, good: Column) -> DataFrame:
    """(requests, feedback, rated, coverage, helpful_rate): rates are null where nothing was counted."""
    a = requests.agg(F.count("*").alias("requests"))
    b = feedback.agg(F.count("*").alias("feedback"), F.count_distinct(key).alias("rated"), F.count_if(good).alias("good"))
    return a.join(b).select("requests", "feedback", "rated", F.try_divide("rated", "requests").alias("coverage"), F.try_divide("good", "feedback").alias("helpful_rate"))


def by_group(requests: DataFrame, feedback: DataFrame, group: str, good: Column) -> DataFrame:
    """(group, requests, feedback, helpful, low): both counted apart, then joined; low is the Wilson bound of the unhelpful share."""
    a = requests.groupBy(group).agg(F.count("*").alias("requests"))
    b = feedback.groupBy(group).agg(F.count("*").alias("feedback"), F.count_if(good).alias("helpful"))
    rows = a.join(b, group, "full_outer").na.fill(0, ["requests", "feedback", "helpful"])
    return rows.withColumn("low", wilson_low(F.col("feedback") - F.col("helpful"), F.col("feedback")))


def source_scorecard(feedback: DataFrame, sources: str, bad: Column) -> DataFrame:
    """(source, n, rejected, share, weak): each feedback counts once for a source."""
    rows = feedback.select(bad.alias("bad"), F.explode(F.array_distinct(sources)).alias("source"))
    t = rows.groupBy("source").agg(F.count("*").alias("n"), F.count_if("bad").alias("rejected")).withColumn("share", F.col("rejected") / F.col("n"))
    return t.withColumn("weak", (F.col("rejected") >= 2) | ((F.col("n") >= 3) & (F.col("share") >= 0.5)))


def findings(groups: DataFrame, group: str, least: int = 3) -> DataFrame:
    """(severity, subject, finding): groups whose unhelpful share is high for sure, or that nobody rates; the worst first."""
    bad = groups.where((F.col("feedback") >= least) & (F.col("low") >= 0.3)).select(F.lit("high").alias("severity"), F.col(group).cast("string").alias("subject"), F.lit("often_unhelpful").alias("finding"))
    mute = groups.where((F.col("requests") >= 10) & (F.col("feedback") == 0)).select(F.lit("low").alias("severity"), F.col(group).cast("string").alias("subject"), F.lit("never_rated").alias("finding"))
    rank = F.when(F.col("severity") == "high", 0).otherwise(1)
    return bad.unionByName(mute).orderBy(rank, "subject")

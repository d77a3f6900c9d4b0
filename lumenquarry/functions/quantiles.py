"""Exact quantiles of groups of any size, by selection: a sketch brackets each wanted rank, then only what lies in the brackets is counted."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import scratch, written

#: Groups up to which the brackets go to every task. A join by group would sort each group's rows in one task.
SENT = 10_000
#: Of the sketch: its ranks are off by at most one in so many.
ACCURACY = 2000


def exact_quantiles(df: DataFrame, value: str, qs: list[float], *by: str, accuracy: int = ACCURACY) -> DataFrame:
    """(by, n, q): q has the quantiles of each group's values with linear interpolation between ranks; nulls don't count.

    Two passes. The first makes a mergeable sketch of each group and takes a bracket of values around each wanted rank. The second counts the values below
    each bracket and, value by value, those inside, which are few of a group's rows; only these counts are sorted. No task holds a
    group: up to SENT groups, brackets are broadcast. The first pass runs at once. A group without values has n 0 and a null q; a table without rows gives none, or one row with n 0 where there is no ``by``.
    """
    ends = [min(max(q + d, 0.0), 1.0) for q in qs for d in (-2.0 / accuracy, 2.0 / accuracy)]
    v = F.col(value).cast("double")
    rows = df.select(*by, v.alias("v")).where(~F.isnan("v") | F.col("v").isNull())
    # The sketch's answers are values that occur; the ends are rounded outwards by their ranks' error, and 0 and 1 are the extremes.
    stats = rows.groupBy(*by).agg(
        F.count("v").alias("n"), F.percentile_approx("v", F.array(*[F.lit(e) for e in ends]), F.lit(2 * accuracy)).alias("ends"), F.min("v").alias("least"), F.max("v").alias("most"),
    )
    few = F.col("n") <= 2 * accuracy  # a bracket holds some ranks on either side only beyond this; up to it, it holds all
    bracket = [
        F.struct(
            F.lit(i).alias("i"), F.floor(F.lit(q) * (F.col("n") - 1)).alias("k"), (F.lit(q) * (F.col("n") - 1) - F.floor(F.lit(q) * (F.col("n") - 1))).alias("part"),
            F.when(few | F.lit(ends[2 * i] == 0.0), F.col("least")).otherwise(F.col("ends")[2 * i]).alias("lo"),
            F.when(few | F.lit(ends[2 * i + 1] == 1.0), F.col("most")).otherwise(F.col("ends")[2 * i + 1]).alias("hi"),
        )
        for i, q in enumerate(qs)
    ]
    stats = stats.select(*[F.col(c).alias(f"by_{c}") for c in by], "n", F.array(*bracket).alias("brackets"))
    stats = written(stats, scratch(df.sparkSession, "brackets"))
    same = [F.col(c).eqNullSafe(F.col(f"by_{c}")) for c in by]
    sent = F.broadcast if not by or stats.count() <= SENT else lambda few: few
    both = rows.where("v is not null").join(sent(stats), same or None)
    # Rows below a bracket count for it as they pass; rows inside stay, by value.
    below = both.groupBy(*[f"by_{c}" for c in by]).agg(*[F.count_if(F.col("v") < F.col("brackets")[i]["lo"]).alias(f"b{i}") for i in range(len(qs))])
    below = below.select(*[f"by_{c}" for c in by], F.array(*[f"b{i}" for i in range(len(qs))]).alias("below"))
    inside = both.where(F.exists("brackets", lambda b: (F.col("v") >= b["lo"]) & (F.col("v") <= b["hi"])))
    # Numbers alone are aggregated by hash; brackets come back by their group, as an aggregate that held them would sort its rows.
    inside = inside.groupBy(*[F.col(f"by_{c}").alias(c) for c in by], "v").agg(F.count("*").alias("c")).join(sent(stats), same or None)
    inside = inside.select(*[f"by_{c}" for c in by], "v", "c", F.explode(F.filter("brackets", lambda b: (F.col("v") >= b["lo"]) & (F.col("v") <= b["hi"]))).alias("b"))
    order = Window.partitionBy(*[f"by_{c}" for c in by], "b.i").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("upto", F.sum("c").over(order))
    keys = [F.col(f"by_{c}").alias(f"in_{c}") for c in by]
    joined = inside.select(*keys, "v", "b", "upto").join(sent(below), [F.col(f"in_{c}").eqNullSafe(F.col(f"by_{c}")) for c in by] or None)
    total = F.col("upto") + F.get("below", F.col("b.i"))
    at = joined.select(*[F.col(f"in_{c}") for c in by], "v", "b", total.alias("total")).groupBy(*[f"in_{c}" for c in by], "b.i").agg(
        F.min(F.when(F.col("total") > F.col("b.k"), F.col("v"))).alias("low"), F.min(F.when(F.col("total") > F.col("b.k") + 1, F.col("v"))).alias("high"), F.first("b.part").alias("part"),
    )
    value_at = F.col("low") + F.when(F.col("part") > 0, (F.col("high") - F.col("low")) * F.col("part")).otherwise(0.0)
    found = at.groupBy(*[f"in_{c}" for c in by]).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", value_at.alias("x")))), lambda s: s["x"]).alias("q"))
    sizes = stats.select(*[f"by_{c}" for c in by], "n")
    out = sizes.join(sent(found), [F.col(f"by_{c}").eqNullSafe(F.col(f"in_{c}")) for c in by] or None, "left")
    return out.select(*[F.col(f"by_{c}").alias(c) for c in by], "n", "q")

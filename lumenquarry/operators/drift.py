"""Drift between a baseline and a recent window. Rows have a column ``side`` of 'baseline' or 'recent'."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.quantiles import exact_quantiles
from ..sources.files import scratch, written
from .clusters import average_linkage
from .relational import in_ranges, window_between


def sides(df: DataFrame, ts: str, now: Column, recent: str, baseline: str) -> DataFrame:
    """Rows of (now - recent, now] and of (now - baseline, now - recent], with their side."""
    t = F.col(ts)
    inside = window_between(t, now, "0 hours", baseline)
    return df.where(inside).withColumn("side", F.when(window_between(t, now, "0 hours", recent), "recent").otherwise("baseline"))


def counts(df: DataFrame, category: str) -> DataFrame:
    """(category, a, b): counts in the baseline and the recent window. Null and '' are 'unknown'."""
    c = F.coalesce(F.nullif(F.col(category), F.lit("")), F.lit("unknown")).alias("category")
    return df.groupBy(c).agg(F.count_if(F.col("side") == "baseline").alias("a"), F.count_if(F.col("side") == "recent").alias("b"))


def psi(table: DataFrame, pseudo: float = 0.5) -> DataFrame:
    """(category, p, q, part): contributions to the population stability index, with pseudo-counts."""
    every = Window.partitionBy(F.lit(1))
    p = (F.col("a") + pseudo) / F.sum(F.col("a") + pseudo).over(every)
    q = (F.col("b") + pseudo) / F.sum(F.col("b") + pseudo).over(every)
    return table.select("category", p.alias("p"), q.alias("q")).withColumn("part", (F.col("q") - F.col("p")) * F.log(F.col("q") / F.col("p")))


def chi2(table: DataFrame, least: float = 5.0) -> DataFrame:
    """(statistic, dof): homogeneity, with categories expected under ``least`` times in the smaller window pooled."""
    every = Window.partitionBy(F.lit(1))
    t = table.withColumns({"na": F.sum("a").over(every), "nb": F.sum("b").over(every)})
    small = (F.col("a") + F.col("b")) * F.least("na", "nb") < least * (F.col("na") + F.col("nb"))
    pooled = t.groupBy(F.when(small, "(other)").otherwise(F.col("category")).alias("category"), "na", "nb").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    n, row = F.col("na") + F.col("nb"), F.col("a") + F.col("b")
    ea, eb = row * F.col("na") / n, row * F.col("nb") / n
    # Nothing is expected of a window without rows.
    square = lambda x, e: F.coalesce(F.try_divide((F.col(x) - e) * (F.col(x) - e), e), F.lit(0.0))
    part = square("a", ea) + square("b", eb)
    return pooled.agg(F.sum(part).alias("statistic"), (F.count("*") - 1).alias("dof"))


def proportion_z(table: DataFrame) -> DataFrame:
    """(category, a, b, delta, z): pooled two-proportion statistics of each category; null where the variance is 0 or a window is empty."""
    every = Window.partitionBy(F.lit(1))
    t = table.withColumns({"na": F.sum("a").over(every), "nb": F.sum("b").over(every)})
    pool = (F.col("a") + F.col("b")) / (F.col("na") + F.col("nb"))
    se = F.sqrt(pool * (1 - pool) * (F.try_divide(F.lit(1.0), "na") + F.try_divide(F.lit(1.0), "nb")))
    delta = F.try_divide("b", "nb") - F.try_divide("a", "na")
    return t.select("category", "a", "b", delta.alias("delta"), F.when(se > 0, delta / se).alias("z"))


def changes(table: DataFrame, level: float = 0.01, least: float = 0.03, least_count: int = 3, exact_below: float = 10.0) -> DataFrame:
    """(category, a, b, delta, p, psi_share, flag) of counts: each category's change of share, its own test, its share of the stability index, and a flag.

    p is that of Fisher's exact test where an expected count is under ``exact_below``, else of z. The flag is new or vanished where one window has none and the
    other ``least_count`` or more, up or down where p is under ``level`` and the share changed by ``least`` or more, else steady. Only counts reach Python.
    """
    every = Window.partitionBy(F.lit(1))
    t = table.withColumns({"na": F.sum("a").over(every), "nb": F.sum("b").over(every)})

    @F.pandas_udf("double")
    def p(a: pd.Series, b: pd.Series, na: pd.Series, nb: pd.Series) -> pd.Series:
        return pd.Series([_proportion_p(int(w), int(x), int(y), int(z), exact_below) for w, x, y, z in zip(a, b, na, nb, strict=True)])

    parts = psi(table).withColumn("psi_share", F.coalesce(F.try_divide("part", F.sum("part").over(every)), F.lit(0.0))).select("category", "psi_share")
    delta = F.coalesce(F.try_divide("b", "nb"), F.lit(0.0)) - F.coalesce(F.try_divide("a", "na"), F.lit(0.0))
    t = t.select("category", "a", "b", delta.alias("delta"), p("a", "b", "na", "nb").alias("p")).join(parts, "category")
    sure = (F.col("p") < level) & (F.abs("delta") >= least)
    flag = F.when((F.col("a") == 0) & (F.col("b") >= least_count), "new").when((F.col("b") == 0) & (F.col("a") >= least_count), "vanished").when(sure & (F.col("delta") > 0), "up").when(sure, "down").otherwise("steady")
    return t.withColumn("flag", flag)


def ks(df: DataFrame, value: str) -> DataFrame:
    """(d, n_a, n_b): the two-sample statistic. Equal values are aggregated first, so that the running sums see distinct values only."""
    v = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count_if(F.col("side") == "baseline").alias("a"), F.count_if(F.col("side") == "recent").alias("b"))
    # Two levels of running sums: within ranges of values, then over the ranges' totals, so that no task sorts all values.
    ranged = in_ranges(v, "v")
    inner = Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumns({"ca": F.sum("a").over(inner), "cb": F.sum("b").over(inner)})
    totals = ranged.groupBy("part").agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    outer = Window.partitionBy(F.lit(1)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.withColumns({"ba": F.coalesce(F.sum("ta").over(outer), F.lit(0)), "bb": F.coalesce(F.sum("tb").over(outer), F.lit(0)), "na": F.sum("ta").over(Window.partitionBy(F.lit(1))), "nb": F.sum("tb").over(Window.partitionBy(F.lit(1)))})
    gap = F.abs(F.try_divide(F.col("ca") + F.col("ba"), F.col("na")) - F.try_divide(F.col("cb") + F.col("bb"), F.col("nb")))
    return local.join(before, "part").agg(F.max(gap).alias("d"), F.max("na").alias("n_a"), F.max("nb").alias("n_b"))


def jensen_shannon(table: DataFrame) -> DataFrame:
    """(js): base-2 divergence of the two windows' shares; null where a window is empty."""
    every = Window.partitionBy(F.lit(1))
    t = table.select(F.try_divide(F.col("a"), F.sum("a").over(every)).alias("p"), F.try_divide(F.col("b"), F.sum("b").over(every)).alias("q")).withColumn("m", (F.col("p") + F.col("q")) / 2)
    part = lambda x: F.when(F.col(x) > 0, F.col(x) * F.log2(F.col(x) / F.col("m"))).when(F.col(x) == 0, 0.0)
    return t.agg(((F.sum(part("p")) + F.sum(part("q"))) / 2).alias("js"))


def numeric_summary(df: DataFrame, value: str) -> DataFrame:
    """(side, n, mean, p10, median, p90), exact, of windows of any size."""
    q = exact_quantiles(df, value, [0.1, 0.5, 0.9], "side").drop("n")
    t = df.groupBy("side").agg(F.count(value).alias("n"), F.avg(value).alias("mean")).join(q, "side")
    return t.select("side", "n", "mean", F.col("q")[0].alias("p10"), F.col("q")[1].alias("median"), F.col("q")[2].alias("p90"))


def holm(ps: DataFrame, alpha: float = 0.01) -> DataFrame:
    """Adds rank, limit and survives to (signal, p): step-down, all from the first failure on fail."""
    w = Window.partitionBy(F.lit(1)).orderBy("p", "signal")
    m = F.count("*").over(Window.partitionBy(F.lit(1)))
    rows = ps.withColumn("rank", F.row_number().over(w)).withColumn("limit", F.lit(alpha) / (m - F.col("rank") + 1))
    failed = F.max(F.when(F.col("p") > F.col("limit"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("survives", failed == 0)


#: Least effects by kind of signal: stability index, distance of distributions, rise of a rate.
GATES = {"distribution": 0.1, "value": 0.15, "rate": 0.05}


def report(df: DataFrame, categories: list[str], value: str, alpha: float = 0.01, least_rows: int = 30, rates: dict[str, Column] | None = None, falls: bool = False, gates: dict[str, float] | None = None) -> DataFrame:
    """(signal, kind, statistic, p, effect, survives, alert, status): one family of tests, corrected together, each with its own gate of effect.

    Columns of ``categories`` are tested as distributions, ``value`` by its two samples (with ``falls`` it alerts only where the mean falls), each of ``rates``, a
    condition by name, for a rise of its share. An alert survives the correction and reaches its kind's gate; ``gates`` overrides GATES. With fewer than
    ``least_rows`` rows in a window nothing alerts. p-values are taken from small aggregates by Arrow functions.
    """
    gates = GATES | (gates or {})
    @F.pandas_udf("double")
    def chi2_p(x: pd.Series, dof: pd.Series) -> pd.Series:
        return pd.Series([stats.chi2_sf(a, int(b)) if pd.notna(a) else 1.0 for a, b in zip(x, dof, strict=True)])

    @F.pandas_udf("double")
    def ks_p(d: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([stats.ks_sf(a, int(b), int(c)) if pd.notna(a) else 1.0 for a, b, c in zip(d, n, m, strict=True)])

    rows = None
    for c in categories:
        table = counts(df, c)
        part = chi2(table).join(psi(table).agg(F.sum("part").alias("effect"))).select(F.lit(c).alias("signal"), F.lit("distribution").alias("kind"), "statistic", chi2_p("statistic", "dof").alias("p"), "effect")
        rows = part if rows is None else rows.unionByName(part)
    mean = lambda side: F.avg(F.when(F.col("side") == side, F.col(value)))
    fell = df.agg((mean("recent") < mean("baseline")).alias("fell"))  # one row
    one = ks(df, value).select(F.lit(value).alias("signal"), F.lit("value").alias("kind"), F.col("d").alias("statistic"), ks_p("d", "n_a", "n_b").alias("p"), F.col("d").alias("effect"))
    one = one.join(fell).withColumn("effect", F.when(F.coalesce("fell", F.lit(False)), F.col("effect")).otherwise(0.0) if falls else F.col("effect")).drop("fell")
    rows = one if rows is None else rows.unionByName(one)
    for name, condition in (rates or {}).items():
        t = changes(counts(df.withColumn("hit", F.when(condition, "yes").otherwise("no")), "hit")).where("category = 'yes'")
        rows = rows.unionByName(t.select(F.lit(name).alias("signal"), F.lit("rate").alias("kind"), F.col("delta").alias("statistic"), "p", F.col("delta").alias("effect")))
    size = df.agg(F.count_if(F.col("side") == "recent").alias("nr"), F.count_if(F.col("side") == "baseline").alias("nb"))
    out = holm(rows, alpha).join(size)
    enough = (F.col("nr") >= least_rows) & (F.col("nb") >= least_rows)
    gate = F.coalesce(*[F.when(F.col("kind") == k, F.lit(float(g))) for k, g in gates.items()])
    alert = F.col("survives") & (F.col("effect") >= gate) & enough
    return out.select("signal", "kind", "statistic", "p", "effect", "survives", alert.alias("alert"), F.when(~enough, "insufficient_data").when(F.max(alert.cast("int")).over(Window.partitionBy(F.lit(1))) == 1, "alert").otherwise("ok").alias("status"))


def _proportion_p(a: int, b: int, na: int, nb: int, exact_below: float) -> float:
    """Two-sided p of two proportions: Fisher's exact test where an expected count is small, else z; 1 where nothing can differ."""
    n, both = na + nb, a + b
    if not na or not nb or both in (0, n):
        return 1.0
    if min(both, n - both) * min(na, nb) / n < exact_below:
        return stats.fisher_exact(a, na - a, b, nb - b)
    pool = both / n
    return stats.normal_two_sided((b / nb - a / na) / (pool * (1 - pool) * (1 / na + 1 / nb)) ** 0.5)


def category_tests(df: DataFrame, category: str, recent: str, exact_below: float = 10.0) -> DataFrame:
    """(category, a, b, p, dimension_p): a test of each category's share, and one for all: min(1, k times the least p) of k categories.

    Only counts by category reach Python. Null and '' are 'unknown'; a null side counts as baseline.
    """
    sided = df.withColumn("side", F.when(F.col(recent), "recent").otherwise("baseline"))
    every = Window.partitionBy(F.lit(1))
    t = counts(sided, category).withColumns({"na": F.sum("a").over(every), "nb": F.sum("b").over(every), "k": F.count("*").over(every)})

    @F.pandas_udf("double")
    def p(a: pd.Series, b: pd.Series, na: pd.Series, nb: pd.Series) -> pd.Series:
        return pd.Series([_proportion_p(int(w), int(x), int(y), int(z), exact_below) for w, x, y, z in zip(a, b, na, nb, strict=True)])

    t = t.withColumn("p", p("a", "b", "na", "nb"))
    return t.withColumn("dimension_p", F.least(F.lit(1.0), F.col("k") * F.min("p").over(every))).select("category", "a", "b", "p", "dimension_p")


def over_representation(df: DataFrame, cluster: str, recent: str, least: float = 2.0, level: float = 0.05, surge: float = 0.15, by: str | None = None) -> DataFrame:
    """(by, cluster, size, recent, enrichment, p, kind): clusters that hold more recent rows than chance gives, by the hypergeometric tail.

    p is weighted by cluster size (Bonferroni: p times all rows over the cluster's rows). kind is ``new_topic`` where baseline rows are
    at most ``surge`` of the cluster, ``surge`` for others that pass ``level`` and ``least``, else null. ``by`` parts the rows into runs of their own.
    """
    keys = [by] if by else []
    t = df.groupBy(*keys, cluster).agg(F.count("*").alias("size"), F.count_if(F.col(recent)).alias("recent"))
    return enriched(t, cluster, least, level, surge, keys)


def enriched(t: DataFrame, cluster: str, least: float, level: float, surge: float, keys: list[str]) -> DataFrame:
    """over_representation() of counts (keys, cluster, size, recent)."""
    every = Window.partitionBy(*(keys or [F.lit(1)]))
    t = t.withColumns({"n": F.sum("size").over(every), "m": F.sum("recent").over(every)})

    @F.pandas_udf("double")
    def tail(k: pd.Series, n: pd.Series, m: pd.Series, size: pd.Series) -> pd.Series:
        return pd.Series([stats.hypergeom_sf(int(w), int(x), int(y), int(z)) for w, x, y, z in zip(k, n, m, size, strict=True)])

    p = F.least(F.lit(1.0), tail("recent", "n", "m", "size") * F.col("n") / F.col("size"))
    t = t.withColumn("enrichment", F.try_divide(F.col("recent") * F.col("n"), F.col("size") * F.col("m"))).withColumn("p", p)
    passes = (F.col("p") < level) & (F.col("enrichment") >= least)
    kind = F.when(passes & (F.col("size") - F.col("recent") <= surge * F.col("size")), "new_topic").when(passes, "surge")
    return t.select(*keys, cluster, "size", "recent", "enrichment", "p", kind.alias("kind"))


def joint_topics(df: DataFrame, key: str, vector: str, recent: str, by: str, cut: float = 0.55, least_rows: int = 3, least: float = 2.0, level: float = 0.05, surge: float = 0.15) -> DataFrame:
    """(by, cluster, size, recent, enrichment, p, kind): both windows clustered together, then tested for clusters that recent rows crowd.

    Equal vectors are one point with a weight, so repeated complaints neither cost nor change distances; average linkage at cosine distance ``cut`` joins
    points; clusters of fewer than ``least_rows`` rows aren't tested, but their rows count. A cluster's name is its least key.
    """
    points = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).groupBy(by, F.col(vector).alias("vector")).agg(F.min(key).alias("point"), F.count("*").alias("rows"), F.count_if(F.col(recent)).alias("recent"))
    points = written(points, scratch(df.sparkSession, "points"))
    found = average_linkage(points, "point", "vector", by, cut, weight="rows")
    same = F.col("group").eqNullSafe(F.col(by)) & (F.col("key") == F.col("point"))
    counts = points.join(found, same).groupBy(by, "cluster").agg(F.sum("rows").alias("size"), F.sum("recent").alias("recent"))
    # Small clusters stand together as one that is never reported.
    small = F.col("size") < least_rows
    counts = counts.groupBy(by, F.when(~small, F.col("cluster")).alias("cluster")).agg(F.sum("size").alias("size"), F.sum("recent").alias("recent"))
    return enriched(counts, "cluster", least, level, surge, [by]).where("cluster is not null")


def dimension_test(df: DataFrame, category: str, recent: str, exact_below: float = 10.0) -> DataFrame:
    """(omnibus_p, category_p, k, p): chi-square over all categories, the least p of single ones, and both combined. One row."""
    from .assess import combined_p

    @F.pandas_udf("double")
    def tail(x: pd.Series, dof: pd.Series) -> pd.Series:
        return pd.Series([stats.chi2_sf(a, int(b)) if pd.notna(a) and b > 0 else 1.0 for a, b in zip(x, dof, strict=True)])

    sided = df.withColumn("side", F.when(F.col(recent), "recent").otherwise("baseline"))
    one = chi2(counts(sided, category)).select(tail("statistic", "dof").alias("omnibus_p"))
    two = category_tests(df, category, recent, exact_below).agg(F.min("p").alias("category_p"), F.count("*").alias("k"))
    return one.join(two).select("omnibus_p", "category_p", "k", combined_p(F.col("omnibus_p"), F.col("category_p"), F.col("k")).alias("p"))

"""Evaluation: retrieval metrics, classification reports, gates and grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantiles


def retrieval(ranked: DataFrame, relevant_total: DataFrame, k: int = 5) -> DataFrame:
    """Per query: hit, precision, recall, reciprocal rank and nDCG at k from (query, rank, relevant) and (query, total)."""
    hit = F.when(F.col("relevant") & (F.col("rank") <= k), 1)
    gains = F.sum(F.when(hit == 1, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0))
    t = ranked.groupBy("query").agg(F.coalesce(F.max(hit), F.lit(0)).alias("hit"), F.count(hit).alias("n"), F.coalesce(1 / F.min(F.when(F.col("relevant"), F.col("rank"))), F.lit(0.0)).alias("rr"), gains.alias("dcg"))
    rows = t.join(relevant_total, "query")
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(k), F.col("total"))).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    return rows.select("query", F.col("hit").cast("double"), (F.col("n") / k).alias("precision"), F.when(F.col("total") > 0, F.col("n") / F.col("total")).otherwise(0.0).alias("recall"), "rr", F.when(F.col("total") > 0, F.col("dcg") / ideal).otherwise(0.0).alias("ndcg"))


def report(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(label, support, precision, recall, f1) for labels that the truth has."""
    cells = df.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    support = cells.groupBy(F.col("t").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)).alias("hit"))
    named = cells.groupBy(F.col("p").alias("label")).agg(F.sum("n").alias("named"))
    rows = support.join(named, "label", "left").na.fill(0, ["named"])
    p, r = F.coalesce(F.try_divide("hit", "named"), F.lit(0.0)), F.col("hit") / F.col("support")
    return rows.select("label", "support", p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


def latencies(df: DataFrame, value: str, *by: str) -> DataFrame:
    """(by, n, mean, p50, p90, p95, p99, max), exact, of groups of any size; ``by`` isn't null."""
    q = exact_quantiles(df, value, [0.5, 0.9, 0.95, 0.99], *by).drop("n")
    t = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.max(value).alias("max")).join(q, list(by))
    return t.select(*by, "n", "mean", *[F.col("q")[i].alias(x) for i, x in enumerate(("p50", "p90", "p95", "p99"))], "max")


def flattened(reports: DataFrame, key: str, report: str, depth: int = 8) -> DataFrame:
    """(key, path, value): the numbers of JSON reports by dotted path; entries of lists by their place from 0. Booleans and what isn't a number are no metrics.

    A report that isn't JSON has no paths. Objects and lists are opened ``depth`` levels deep.
    """
    spark = reports.sparkSession
    level, out = reports.select(F.col(key).alias("key"), F.lit("").alias("path"), F.try_parse_json(F.col(report)).alias("v")).where("v is not null"), None
    for _ in range(depth):
        opened = spark.sql("SELECT key, concat(path, if(path = '', '', '.'), coalesce(e.key_, cast(e.pos AS string))) AS path, e.value AS v, schema_of_variant(e.value) AS kind FROM {level}, LATERAL variant_explode(v) AS e(pos, key_, value)", level=level)
        numbers = opened.where("kind not like 'OBJECT%' and kind not like 'ARRAY%' and kind not in ('BOOLEAN', 'STRING', 'VOID')")
        part = numbers.select("key", "path", F.expr("try_variant_get(v, '$', 'double')").alias("value")).where("value is not null")
        out = part if out is None else out.unionByName(part)
        level = opened.where("kind like 'OBJECT%' or kind like 'ARRAY%'").select("key", "path", "v")
    return out.withColumnRenamed("key", key)


def gate(metrics: DataFrame, checks: DataFrame) -> DataFrame:
    """(path, value, status): ok, below, above or missing for checks (path, min, max)."""
    rows = checks.join(metrics, "path", "left")
    status = F.when(F.col("value").isNull(), "missing").when(F.col("value") < F.col("min"), "below").when(F.col("value") > F.col("max"), "above").otherwise("ok")
    return rows.select("path", "value", status.alias("status"))


def grid(df: DataFrame, thresholds: list[float], score: str, truth: Column) -> DataFrame:
    """(threshold, balanced_accuracy): every threshold is a conditional sum of one pass."""
    parts = []
    for t in thresholds:
        p = F.col(score) >= t
        tp, tn = F.count_if(p & truth) / F.count_if(truth), F.count_if(~p & ~truth) / F.count_if(~truth)
        parts.append(F.struct(F.lit(t).alias("threshold"), ((tp + tn) / 2).alias("balanced_accuracy")))
    return df.agg(F.array(*parts).alias("x")).select(F.inline("x"))


def bootstrap(df: DataFrame, key: str, delta: str, replicates: int = 200, seed: int = 11) -> DataFrame:
    """(mean, low, high): a paired bootstrap with Poisson weights from hashes, so that every replicate is a sum in one pass."""
    u = lambda i: F.pmod(F.xxhash64(F.lit(seed), F.lit(i), F.col(key)), F.lit(1_000_000)) / 1_000_000

    def weight(i: int) -> Column:
        out, total, p = F.lit(8), 0.0, 0.36787944117144233
        steps = []
        for n in range(8):
            total += p
            steps.append((n, total))
            p /= n + 1
        for n, limit in reversed(steps):
            out = F.when(u(i) < limit, n).otherwise(out)
        return out

    sums = df.agg(F.avg(delta).alias("mean"), F.array(*[F.sum(weight(i) * F.col(delta)) / F.greatest(F.sum(weight(i)), F.lit(1)) for i in range(replicates)]).alias("r"))
    return sums.select("mean", F.explode("r").alias("x")).groupBy("mean").agg(F.percentile("x", 0.025).alias("low"), F.percentile("x", 0.975).alias("high"))

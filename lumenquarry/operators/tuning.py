"""A grid over settings of retrieval in one plan: settings travel as columns through scoring, fusion, blending and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def retrieval_grid(
    postings: DataFrame, terms: DataFrame, first: DataFrame, relevant: DataFrame, n_docs: int, second: Column,
    max_dfs: list[float], weights: list[float], blends: list[float], k: int = 10, pool: int = 50, top: int = 20, most: int = 12, least: int = 3, rrf: int = 60,
) -> DataFrame:
    """(max_df, weight, blend, queries, hit, mrr): means over queries of what each setting finds among the first k.

    ``max_df`` is the share of documents that a term of lexical search may be in, ``weight`` that of the lexical list in fusion with ``first`` (query, doc, rank), ``blend``
    the share of ``second``, a column over ``doc``, for the first ``top``. ``relevant`` has (query, doc). Terms are weighed once for each max_df, lists fused once for each
    (max_df, weight); nothing is scored again for another setting. Queries without a hit count 0.
    """
    values = lambda xs: F.explode(F.array(*[F.lit(float(x)) for x in xs]))
    own, whole = Window.partitionBy("max_df", "query").orderBy("df", "term"), Window.partitionBy("max_df", "query")
    rare = F.col("df") <= F.col("max_df") * n_docs
    t = terms.select("query", "term", "df", values(max_dfs).alias("max_df")).withColumns({"i": F.row_number().over(own), "rare": rare, "some": F.max(rare).over(whole)})
    t = t.where((F.col("rare") & (F.col("i") <= most)) | (~F.col("some") & (F.col("i") <= least))).select("max_df", "query", "term")
    score = F.sum("tf") / F.log(1 + F.first("length"))
    lexical = t.join(postings, "term").groupBy("max_df", "query", "doc").agg(score.alias("score"))
    order = Window.partitionBy("max_df", "query").orderBy(F.desc(F.round("score", 9)), "doc")
    lexical = lexical.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= pool).select("max_df", "query", "doc", "rank", F.lit(True).alias("lexical"))
    both = lexical.unionByName(first.where(F.col("rank") <= pool).select(values(max_dfs).alias("max_df"), "query", "doc", "rank", F.lit(False).alias("lexical")))
    weighed = both.withColumn("weight", values(weights))
    part = F.when(F.col("lexical"), F.col("weight")).otherwise(1.0) / (rrf + F.col("rank"))
    fused = weighed.groupBy("max_df", "weight", "query", "doc").agg(F.sum(part).alias("rrf"), F.min("rank").alias("best"))
    order = Window.partitionBy("max_df", "weight", "query").orderBy(F.desc(F.round("rrf", 12)), "best", "doc")
    fused = fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    fused = fused.withColumn("most", F.max("rrf").over(Window.partitionBy("max_df", "weight", "query"))).withColumn("blend", values(blends))
    final = F.col("blend") * second + (1 - F.col("blend")) * F.col("rrf") / F.col("most")
    order = Window.partitionBy("max_df", "weight", "blend", "query").orderBy(F.desc(F.round(final, 9)), F.desc(F.round("rrf", 12)), "doc")
    found = fused.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).join(relevant.select("query", "doc").distinct(), ["query", "doc"])
    best = found.groupBy("max_df", "weight", "blend", "query").agg(F.min("place").alias("place"))
    asked = terms.select("query").distinct().select("query", values(max_dfs).alias("max_df")).withColumn("weight", values(weights)).withColumn("blend", values(blends))
    rows = asked.join(best, ["max_df", "weight", "blend", "query"], "left")
    return rows.groupBy("max_df", "weight", "blend").agg(F.count("*").alias("queries"), F.avg(F.when(F.col("place").isNotNull(), 1.0).otherwise(0.0)).alias("hit"), F.avg(F.coalesce(1 / F.col("place"), F.lit(0.0))).alias("mrr"))


def best_setting(grid: DataFrame) -> DataFrame:
    """The row with the largest mrr; of equal ones the first by settings."""
    return grid.orderBy(F.desc(F.round("mrr", 9)), "max_df", "weight", "blend").limit(1)

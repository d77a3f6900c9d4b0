"""Ranked retrieval: lexical, BM25, fusion, blending, the adaptive ladder and the evidence gate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import stem, tokens


# English words that say nothing about a text, left out of the index by default.
STOP_WORDS = "a an and are as at be been but by for from had has have he her his i if in into is it its my no not of on or our she so than that the their them then there these they this to was we were what when which who will with would you your".split()


def analysed(text: Column, stop: list[str] | None = None) -> Column:
    """The stems of a text's tokens but for stop words."""
    stop = STOP_WORDS if stop is None else stop
    return F.transform(F.filter(tokens(text), lambda t: ~t.isin(stop)) if stop else tokens(text), stem)


def analysed_documents(docs: DataFrame, doc: str, text: str, stop: list[str] | None = None) -> DataFrame:
    """(doc, terms, length); a null text has no terms."""
    return docs.select(F.col(doc).alias("doc"), analysed(F.col(text), stop).alias("terms")).withColumn("length", F.size("terms").cast("bigint"))


def postings(docs: DataFrame, terms: DataFrame | None = None, few: int = 200_000) -> DataFrame:
    """(doc, length, term, tf) of analysed documents: of all terms, or of those in ``terms`` alone.

    Terms of queries are counted; up to ``few`` are broadcast, so that no other posting is shuffled.
    """
    rows = docs.select("doc", "length", F.explode("terms").alias("term"))
    if terms is not None:
        wanted = terms.select("term").distinct()
        rows = rows.join(F.broadcast(wanted) if wanted.count() <= few else wanted, "term", "left_semi")
    return rows.groupBy("doc", "length", "term").agg(F.count("*").alias("tf"))


def document_frequency(docs: DataFrame) -> DataFrame:
    """(term, df): terms are made distinct within a document, so that only partial counts are shuffled."""
    return docs.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def query_terms(queries: DataFrame, query: str, text: str, df: DataFrame, stop: list[str] | None = None) -> DataFrame:
    """(query, term, qtf, df): all known terms of each query, and how often it has each."""
    q = queries.select(F.col(query).alias("query"), F.explode(analysed(F.col(text), stop)).alias("term")).groupBy("query", "term").agg(F.count("*").alias("qtf"))
    return q.join(df, "term")


def rarest_terms(terms: DataFrame, n_docs: int, max_df: float = 0.4, most: int = 12, least: int = 3) -> DataFrame:
    """(query, term, df): for lexical search, the rarest terms of each query that at most ``max_df`` of the documents have, or else its ``least`` rarest."""
    order, whole = Window.partitionBy("query").orderBy("df", "term"), Window.partitionBy("query")
    rare = F.col("df") <= F.lit(max_df * n_docs)
    rows = terms.withColumns({"i": F.row_number().over(order), "rare": rare, "some": F.max(rare).over(whole)})
    # Ordered by df, rare terms come first.
    return rows.where((F.col("rare") & (F.col("i") <= most)) | (~F.col("some") & (F.col("i") <= least))).select("query", "term", "df")


def okapi_idf(df: DataFrame, n_docs: int, floor: float = 0.25) -> DataFrame:
    """(term, idf): ln(N - df + 0.5) - ln(df + 0.5); where that is negative, ``floor`` times the mean over all terms."""
    raw = df.select("term", (F.log(F.lit(n_docs) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean"))  # one row
    return raw.join(F.broadcast(mean)).select("term", F.when(F.col("raw") < 0, floor * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def bm25(index: DataFrame, terms: DataFrame, idf: DataFrame, average_length: float, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query, doc, score) over all terms of the queries, repeated ones as often as they stand there; scores over 0 stay."""
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.lit(average_length)))
    weighted = terms.select("query", "term", "qtf").join(idf, "term")
    return weighted.join(index, "term").groupBy("query", "doc").agg(F.sum(part).alias("score")).where("score > 0")


def ranked(scores: DataFrame, k: int, digits: int = 9) -> DataFrame:
    """Adds rank by score (rounded, so that sums in another order tie alike), then doc; k of each query stay."""
    order = Window.partitionBy("query").orderBy(F.desc(F.round("score", digits)), "doc")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def reciprocal_rank_fusion(lists: dict[str, tuple[DataFrame, float]], k: int = 60) -> DataFrame:
    """(query, doc, rrf, best_rank, rank) of weighted ranked lists; ties by best rank, then doc."""
    rows = None
    for frame, weight in lists.values():
        part = frame.select("query", "doc", "rank", F.lit(weight).alias("w"))
        rows = part if rows is None else rows.unionByName(part)
    fused = rows.groupBy("query", "doc").agg(F.sum(F.col("w") / (F.lit(k) + F.col("rank"))).alias("rrf"), F.min("rank").alias("best_rank"))
    order = Window.partitionBy("query").orderBy(F.desc(F.round("rrf", 12)), "best_rank", "doc")
    return fused.withColumn("rank", F.row_number().over(order))


def blended(fused: DataFrame, reranked: str, share: float = 0.7, top: int = 20) -> DataFrame:
    """Adds final = share * p + (1 - share) * rrf / max(rrf) for the ``top`` of each query, and its rank."""
    best = Window.partitionBy("query")
    rows = fused.where(F.col("rank") <= top).withColumn("final", share * F.col(reranked) + (1 - share) * F.col("rrf") / F.max("rrf").over(best))
    order = Window.partitionBy("query").orderBy(F.desc(F.round("final", 9)), F.desc(F.round("rrf", 12)), "doc")
    return rows.withColumn("final_rank", F.row_number().over(order))


def margins(ranked_rows: DataFrame) -> DataFrame:
    """(query, margin): the first score less the second; null where there is no second, which stands for no limit."""
    w = Window.partitionBy("query").orderBy("rank")
    return ranked_rows.withColumn("next", F.lead("score").over(w)).where("rank = 1").select("query", (F.col("score") - F.col("next")).alias("margin"))


def adaptive(dense: DataFrame, hybrid: DataFrame, threshold: float) -> DataFrame:
    """Dense results where the margin suffices, hybrid ones elsewhere: one plan, split by a flag."""
    flag = margins(dense).select("query", (F.col("margin").isNull() | (F.col("margin") >= threshold)).alias("stop"))
    a = dense.join(flag.where("stop"), "query").select("query", "doc", "rank", F.lit("dense").alias("stage"))
    b = hybrid.join(flag.where("not stop"), "query").select("query", "doc", "rank", F.lit("hybrid").alias("stage"))
    return a.unionByName(b)


def ladder(stages: list[tuple[str, DataFrame]], thresholds: list[float]) -> DataFrame:
    """(query, doc, score, rank, stage): each query's rows of the first stage whose margin is at least its threshold, or else of the last one.

    A stage without a second row has no limit. A stage that gives a query no row passes it on. One plan, split by a column: no loop over queries.
    """
    names = [n for n, _ in stages]
    flags = None
    for i, (_, frame) in enumerate(stages[:-1]):
        one = margins(frame).where(F.col("margin").isNull() | (F.col("margin") >= thresholds[i])).select("query", F.lit(i).alias("i"))
        flags = one if flags is None else flags.unionByName(one)
    chosen = flags.groupBy("query").agg(F.min("i").alias("stop"))
    out = None
    for i, (name, frame) in enumerate(stages):
        rows = frame.select("query", "doc", "score", "rank")
        part = rows.join(chosen.where(F.col("stop") == i).select("query"), "query", "left_semi") if i < len(names) - 1 else rows.join(chosen.select("query"), "query", "left_anti")
        part = part.withColumn("stage", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def expansion_terms(top_docs: DataFrame, index: DataFrame, own: DataFrame, df: DataFrame, n_docs: int, max_df: float = 0.4, most: int = 6) -> DataFrame:
    """(query, term, df): terms in two or more of a query's first three documents (their postings) and not in the query, the rarest first."""
    first = top_docs.where("rank <= 3").select("query", "doc")
    seen = index.select("doc", "term").join(first, "doc").groupBy("query", "term").agg(F.count("*").alias("n")).where("n >= 2")
    fresh = seen.join(own.select("query", "term"), ["query", "term"], "left_anti").join(df, "term").where(F.col("df") <= F.lit(max_df * n_docs))
    return fresh.withColumn("i", F.row_number().over(Window.partitionBy("query").orderBy("df", "term"))).where(F.col("i") <= most).select("query", "term", "df")


def selected_evidence(ranked_rows: DataFrame, kind: str, most: dict[str, int]) -> DataFrame:
    """The first rows of each query and kind: ``most`` says how many of each; other kinds are left out. Adds place."""
    order = Window.partitionBy("query", kind).orderBy("rank", "doc")
    limit = F.coalesce(*[F.when(F.col(kind) == k, F.lit(n)) for k, n in most.items()], F.lit(0))
    return ranked_rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)


def compared(strategies: dict[str, DataFrame], base: str) -> DataFrame:
    """(query, doc, a rank for each strategy, movement for each other): ranks side by side; movement is the base's rank less the other's."""
    rows = None
    for name, frame in strategies.items():
        part = frame.select("query", "doc", F.lit(name).alias("strategy"), "rank")
        rows = part if rows is None else rows.unionByName(part)
    wide = rows.groupBy("query", "doc").pivot("strategy", list(strategies)).agg(F.min("rank"))
    return wide.select("query", "doc", *[F.col(n).alias(f"rank_{n}") for n in strategies], *[(F.col(base) - F.col(n)).alias(f"moved_{n}") for n in strategies if n != base])


@dataclass(frozen=True)
class Evidence:
    floor: float = 0.25
    span: float = 0.45
    best: float = 0.45
    rerank: float = 0.30
    consensus: float = 0.25
    enough: float = 0.55


def evidence(rows: DataFrame, group: str, config: Evidence = Evidence()) -> DataFrame:
    """(query, confidence, sufficient): the best score, the mean of the list and the share of the strongest group among the first five."""
    clip = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    first = rows.where("rank <= 5").withColumn("w", F.greatest(F.col("score"), F.lit(1e-6)))
    groups = first.groupBy("query", group).agg(F.sum("w").alias("w")).groupBy("query").agg((F.max("w") / F.sum("w")).alias("consensus"))
    best = first.groupBy("query").agg(F.max("score").alias("best"))
    c = config.best * clip((F.col("best") - config.floor) / config.span) + config.rerank * clip(F.col("best")) + config.consensus * F.col("consensus")
    return best.join(groups, "query").select("query", c.alias("confidence"), (c >= config.enough).alias("sufficient"))


def diversified(rows: DataFrame, vector: str, k: int = 10, share: float = 0.7) -> DataFrame:
    """(query, doc, position): greedy maximal marginal relevance over each query's short list."""
    import numpy as np
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "doc"], ascending=[False, True])
        v = np.array(pdf["v"].tolist(), float)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        near, score, left, out = v @ v.T, pdf["score"].to_numpy(), list(range(len(pdf))), []
        while left and len(out) < k:
            best = max(left, key=lambda i: (share * score[i] - (1 - share) * max((near[i, j] for j in out), default=0.0), -i))
            out.append(best)
            left.remove(best)
        return pd.DataFrame({"query": pdf["query"].iloc[out].to_numpy(), "doc": pdf["doc"].iloc[out].to_numpy(), "position": range(1, len(out) + 1)})

    return rows.select("query", "doc", "score", F.col(vector).alias("v")).groupBy("query").applyInPandas(run, "query bigint, doc bigint, position bigint")

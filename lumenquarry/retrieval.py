"""One entry for retrieval: strategies by name over a lexical and a vector index, with filters, fusion and a ladder of stages."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import vectors as vx
from .operators import search
from .operators.lexical_index import LexicalIndex, cover_density
from .operators.vector_index import VectorIndex

Strategy = Callable[["Retrieval", DataFrame, int, "list | None"], DataFrame]
STRATEGIES: dict[str, Strategy] = {}


def strategy(name: str) -> Callable[[Strategy], Strategy]:
    """Registers a function of (retrieval, queries, k, allowed) that returns (query, doc, score, rank)."""

    def add(f: Strategy) -> Strategy:
        STRATEGIES[name] = f
        return f

    return add


@dataclass
class Retrieval:
    """What strategies search: documents' postings, their vectors (exact: rows of ``doc``, ``vector`` and ``attribute``), an index of these. Queries have columns query, text, vector, as far as a strategy reads them."""

    lexical: LexicalIndex | None = None
    vectors: DataFrame | None = None
    index: VectorIndex | None = None
    pool: int = 50
    weights: tuple[float, float, float] = (1.0, 1.0, 0.25)
    margins: tuple[float, ...] = (0.02, 0.001)
    rerank: Callable[[DataFrame], DataFrame] | None = None
    stop: list[str] | None = None

    def search(self, queries: DataFrame, strategy: str, k: int = 10, allowed: list | None = None) -> DataFrame:
        """(query, doc, score, rank): the k best of each query by a registered strategy, among documents whose attribute is ``allowed``."""
        if strategy not in STRATEGIES:
            raise ValueError(f"no strategy {strategy!r}; there are {', '.join(sorted(STRATEGIES))}")
        return STRATEGIES[strategy](self, queries, k, allowed).where(F.col("rank") <= k)

    def _terms(self, queries: DataFrame) -> DataFrame:
        return search.query_terms(queries, "query", "text", self.lexical.terms, self.stop)

    def _dense(self, found: DataFrame) -> DataFrame:
        return found.select(F.col("query_id").alias("query"), F.col("doc"), "score", "rank")


@strategy("bm25")
def _bm25(r: Retrieval, queries: DataFrame, k: int, allowed: list | None) -> DataFrame:
    terms = r._terms(queries)
    idf = search.okapi_idf(r.lexical.terms, r.lexical.n_docs)
    return search.ranked(search.bm25(r.lexical.postings(terms, allowed, positions=False), terms, idf, r.lexical.average_length), k)


@strategy("lexical")
def _lexical(r: Retrieval, queries: DataFrame, k: int, allowed: list | None) -> DataFrame:
    terms = search.rarest_terms(r._terms(queries), r.lexical.n_docs)
    return search.ranked(cover_density(r.lexical.postings(terms, allowed, positions=False), terms), k)


@strategy("phrase")
def _phrase(r: Retrieval, queries: DataFrame, k: int, allowed: list | None) -> DataFrame:
    """Documents that hold the two rarest terms of a query, by how close these stand."""
    terms = search.rarest_terms(r._terms(queries), r.lexical.n_docs, most=2)
    return search.ranked(cover_density(r.lexical.postings(terms, allowed), terms, "all"), k)


@strategy("dense")
def _exact(r: Retrieval, queries: DataFrame, k: int, allowed: list | None) -> DataFrame:
    rows = r.vectors if allowed is None else r.vectors.where(F.col("attribute").cast("string").isin([str(x) for x in allowed]))
    return r._dense(vx.top_k(rows, queries.select(F.col("query").alias("doc"), "vector"), k, "doc", "vector", exclude_self=False))


@strategy("ann")
def _ann(r: Retrieval, queries: DataFrame, k: int, allowed: list | None) -> DataFrame:
    return r._dense(r.index.search(queries.select(F.col("query").alias("doc"), "vector"), k, key="doc", vector="vector", allowed=allowed, exclude_self=False))


@strategy("hybrid")
def _hybrid(r: Retrieval, queries: DataFrame, k: int, allowed: list | None) -> DataFrame:
    """Fusion of what there is: dense (approximate where there is an index), BM25 and lexical."""
    names = [n for n, has in (("ann" if r.index else "dense", r.index or r.vectors), ("bm25", r.lexical), ("lexical", r.lexical)) if has is not None]
    by = dict(zip(("dense", "bm25", "lexical"), r.weights, strict=True))
    lists = {n: (STRATEGIES[n](r, queries, r.pool, allowed), by["dense" if n == "ann" else n]) for n in names}
    return search.reciprocal_rank_fusion(lists).withColumnRenamed("rrf", "score")


@strategy("reranked")
def _reranked(r: Retrieval, queries: DataFrame, k: int, allowed: list | None) -> DataFrame:
    """The hybrid's first 20, blended with ``p`` of a scorer that the caller provides."""
    if r.rerank is None:
        raise ValueError("give Retrieval a rerank function that adds p")
    rows = r.rerank(_hybrid(r, queries, k, allowed).where("rank <= 20").withColumnRenamed("score", "rrf"))
    return search.blended(rows, "p").select("query", "doc", F.col("final").alias("score"), F.col("final_rank").alias("rank"))


@strategy("adaptive")
def _adaptive(r: Retrieval, queries: DataFrame, k: int, allowed: list | None) -> DataFrame:
    """Dense where its margin suffices, else hybrid where that one's does, else reranked if there is a scorer."""
    names = ["ann" if r.index else "dense", "hybrid", *(["reranked"] if r.rerank else [])]
    return search.ladder([(n, STRATEGIES[n](r, queries, r.pool, allowed)) for n in names], list(r.margins[: len(names) - 1]))

"""The engine's own queries over the test tables, each with DuckDB SQL of the same result where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors as vx
from ..functions.quantiles import exact_quantiles
from ..operators import classify, clusters, grounding, metrics, search
from ..operators.lexical_index import LexicalIndex, cover_density
from ..sources.files import kept, spread, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r4(c, name: str):
    return F.round(c, 4).alias(name)


# --- search over vectors: every row whose id is divisible by 100 is a query, against all rows -----------------------

_PAIRS = """WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v, label AS ql FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT query_id, vec_id, ql, label, list_inner_product(q.v, e.embedding::DOUBLE[]) / sqrt(list_inner_product(q.v, q.v) * list_inner_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) AS score
      FROM q, embeddings e WHERE e.vec_id <> q.query_id),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)"""


def _embeddings(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "embedding", "label")


def _dense(spark, sf, k: int, where: str = "true"):
    e = _embeddings(spark, sf)
    return vx.top_k(e.where(where), e.where("vec_id % 100 = 0"), k)


@query(_PAIRS + " SELECT query_id, vec_id, rank::INT AS rank, round(score, 4) AS score FROM t WHERE rank <= 5")
def dense_topk(spark, sf):
    return _dense(spark, sf, 5).select("query_id", "vec_id", "rank", r4("score", "score"))


@query(_PAIRS.replace("WHERE e.vec_id <> q.query_id", "WHERE e.vec_id <> q.query_id AND e.label < 5") + " SELECT query_id, vec_id, rank::INT AS rank, round(score, 4) AS score FROM t WHERE rank <= 5")
def dense_topk_filtered(spark, sf):
    return _dense(spark, sf, 5, "label < 5").select("query_id", "vec_id", "rank", r4("score", "score"))


@query(_PAIRS + """, g AS (SELECT query_id, any_value(ql) ql, max((label = ql)::INT) AS hit, sum((label = ql)::INT) AS n, coalesce(1.0 / min(CASE WHEN label = ql THEN rank END), 0) AS rr,
  sum(CASE WHEN label = ql THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg FROM t WHERE rank <= 5 GROUP BY 1),
w AS (SELECT label, count(*) - 1 AS total FROM embeddings GROUP BY 1),
m AS (SELECT hit, n / 5.0 AS p, CASE WHEN total > 0 THEN n / total ELSE 0 END AS r, rr, CASE WHEN total > 0 THEN dcg / (SELECT sum(1 / log2(i + 1)) FROM range(1, 6) x(i) WHERE i <= greatest(1, least(5, total))) ELSE 0 END AS nd FROM g JOIN w ON w.label = g.ql)
SELECT count(*) AS n, round(avg(hit), 4) AS hit_at_5, round(avg(p), 4) AS precision_at_5, round(avg(r), 4) AS recall_at_5, round(avg(rr), 4) AS mrr, round(avg(nd), 4) AS ndcg_at_5 FROM m""")
def dense_ir_metrics(spark, sf):
    e = _embeddings(spark, sf)
    labels = e.select("vec_id", "label")
    found = _dense(spark, sf, 5).join(labels, "vec_id").join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("ql")), "query_id")
    ranked = found.select(F.col("query_id").alias("query"), "rank", (F.col("label") == F.col("ql")).alias("relevant"))
    sizes = e.groupBy("label").agg((F.count("*") - 1).alias("total"))
    totals = e.where("vec_id % 100 = 0").join(sizes, "label").select(F.col("vec_id").alias("query"), "total")
    m = metrics.retrieval(ranked, totals, 5)
    return m.agg(F.count("*").alias("n"), r4(F.avg("hit"), "hit_at_5"), r4(F.avg("precision"), "precision_at_5"), r4(F.avg("recall"), "recall_at_5"), r4(F.avg("rr"), "mrr"), r4(F.avg("ndcg"), "ndcg_at_5"))


_VOTES = _PAIRS + """, v AS (SELECT query_id, ql, label, sum(exp(score / 0.08)) AS v FROM t WHERE rank <= 10 GROUP BY ALL),
p AS (SELECT query_id, ql, label, v / sum(v) OVER (PARTITION BY query_id) AS p FROM v)"""


def _votes(spark, sf):
    e = _embeddings(spark, sf).select("vec_id", "label")
    return classify.neighbour_votes(_dense(spark, sf, 10).join(e, "vec_id").select(F.col("query_id").alias("query"), "label", "score", F.lit(1.0).alias("weight")))


@query(_VOTES + " SELECT query_id AS query, label, round(p, 4) AS p FROM p")
def knn_vote_classify(spark, sf):
    return _votes(spark, sf).select("query", "label", r4("p", "p"))


_PROTO = """WITH x AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(x::DOUBLE) AS x FROM x GROUP BY ALL),
p AS (SELECT label, list(x ORDER BY i) AS v FROM m GROUP BY 1),
c AS (SELECT vec_id, p.label, list_inner_product(e.embedding::DOUBLE[], p.v) / (sqrt(list_inner_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_inner_product(p.v, p.v))) AS s FROM embeddings e, p),
w AS (SELECT vec_id, label, exp((s - max(s) OVER (PARTITION BY vec_id)) / 0.05) AS e FROM c), f AS (SELECT vec_id, label, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM w)"""


def _softmax(spark, sf):
    e = _embeddings(spark, sf)
    return classify.prototype_softmax(e, "vec_id", "embedding", classify.prototypes(e, "label", "embedding"))


@query(_PROTO + " SELECT vec_id AS key, label, round(p, 4) AS p FROM f")
def prototype_softmax(spark, sf):
    return _softmax(spark, sf).select("key", "label", r4("p", "p"))


@query(_PROTO + ", b AS (SELECT vec_id, arg_max(label, p) AS predicted FROM f GROUP BY 1) SELECT e.label AS truth, predicted, count(*) AS n FROM b JOIN embeddings e USING (vec_id) GROUP BY ALL")
def confusion_matrix(spark, sf):
    best = classify.ensemble([(_softmax(spark, sf), 1.0)]).select(F.col("key").alias("vec_id"), F.col("label").alias("predicted"))
    return best.join(_embeddings(spark, sf), "vec_id").groupBy(F.col("label").alias("truth"), "predicted").agg(F.count("*").alias("n"))


@query(_PROTO + """, b AS (SELECT vec_id, arg_max(label, p) AS predicted FROM f GROUP BY 1), j AS (SELECT e.label AS t, predicted AS p FROM b JOIN embeddings e USING (vec_id)),
s AS (SELECT t, count(*) AS support, sum((t = p)::INT) AS hit FROM j GROUP BY 1), n AS (SELECT p, count(*) AS named FROM j GROUP BY 1),
cr AS (SELECT t AS label, support, coalesce(hit / named, 0) AS pr, hit / support AS re FROM s LEFT JOIN n ON t = n.p)
SELECT label, support, round(pr, 4) AS precision, round(re, 4) AS recall, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 4) AS f1 FROM cr""")
def classification_report(spark, sf):
    best = classify.ensemble([(_softmax(spark, sf), 1.0)]).select(F.col("key").alias("vec_id"), F.col("label").alias("predicted"))
    m = metrics.report(best.join(_embeddings(spark, sf), "vec_id"), "label", "predicted")
    return m.select("label", "support", r4("precision", "precision"), r4("recall", "recall"), r4("f1", "f1"))


@query(_PROTO + ", " + _VOTES.removeprefix("WITH ").replace("p AS (SELECT query_id, ql", "pv AS (SELECT query_id, ql") + """, u AS (SELECT query_id AS key, label, 0.65 * p AS p FROM pv UNION ALL SELECT vec_id, label, 0.35 * p FROM f WHERE vec_id % 100 = 0),
z AS (SELECT key, label, sum(p) AS p FROM u GROUP BY ALL) SELECT key, label, round(p, 3) AS confidence FROM z QUALIFY row_number() OVER (PARTITION BY key ORDER BY round(p, 9) DESC, label) = 1""")
def ensemble_argmax(spark, sf):
    return classify.ensemble([(_votes(spark, sf).select(F.col("query").alias("key"), "label", "p"), 0.65), (_softmax(spark, sf).where("key % 100 = 0"), 0.35)])


@query("""WITH x AS (SELECT (label >= 5)::INT AS side, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT side, i, avg(x::DOUBLE) AS x FROM x GROUP BY ALL),
p AS (SELECT side, list(x ORDER BY i) AS v FROM m GROUP BY 1) SELECT round(1 - list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))), 4) AS shift FROM p a, p b WHERE a.side = 0 AND b.side = 1""")
def centroid_shift(spark, sf):
    m = vx.mean_vector(_embeddings(spark, sf).withColumn("side", F.when(F.col("label") >= 5, 1).otherwise(0)), ["side"], "embedding")
    v = m.agg(F.max(F.when(F.col("side") == 0, F.col("mean"))).alias("a"), F.max(F.when(F.col("side") == 1, F.col("mean"))).alias("b"))
    return v.select(r4(1 - vx.cosine(F.col("a"), F.col("b")), "shift"))


@query(_PAIRS + " SELECT query_id, round(score, 4) AS nearest FROM t WHERE rank = 1")
def nn_similarity(spark, sf):
    return _dense(spark, sf, 1).select("query_id", r4("score", "nearest"))


@query(_PAIRS + ", n AS (SELECT ql, score FROM t WHERE rank = 1), c AS (SELECT quantile_cont(score, 0.05) AS cut FROM n WHERE ql < 5) SELECT count(*) FILTER (WHERE ql >= 5) AS n, count(*) FILTER (WHERE ql >= 5 AND score < cut) AS unseen FROM n, c")
def unseen_rate(spark, sf):
    labels = _embeddings(spark, sf).select(F.col("vec_id").alias("query_id"), "label")
    n = _dense(spark, sf, 1).join(labels, "query_id")
    cut = exact_quantiles(n.where("label < 5"), "score", [0.05]).select(F.col("q")[0].alias("cut"))  # one row
    new = F.col("label") >= 5
    return n.join(F.broadcast(cut)).agg(F.count_if(new).alias("n"), F.count_if(new & (F.col("score") < F.col("cut"))).alias("unseen"))


@query(_PAIRS + """, f AS (SELECT query_id, label, sum(greatest(score, 1e-6)) AS w FROM t WHERE rank <= 5 GROUP BY ALL), g AS (SELECT query_id, max(w) / sum(w) AS c FROM f GROUP BY 1), b AS (SELECT query_id, max(score) AS best FROM t WHERE rank <= 5 GROUP BY 1),
x AS (SELECT query_id AS query, 0.45 * greatest(0, least(1, (best - 0.25) / 0.45)) + 0.30 * greatest(0, least(1, best)) + 0.25 * c AS confidence FROM b JOIN g USING (query_id)) SELECT query, round(confidence, 4) AS confidence, confidence >= 0.55 AS sufficient FROM x""")
def evidence_confidence(spark, sf):
    labels = _embeddings(spark, sf).select("vec_id", "label")
    rows = _dense(spark, sf, 5).join(labels, "vec_id").select(F.col("query_id").alias("query"), "label", "score", "rank")
    return search.evidence(rows, "label").select("query", r4("confidence", "confidence"), "sufficient")


@query(_PROTO + """, b AS (SELECT vec_id, arg_max(label, p) AS c FROM f GROUP BY 1), j AS (SELECT e.label AS l, c FROM b JOIN embeddings e USING (vec_id)), k AS (SELECT c, l, count(*)::DOUBLE AS n FROM j GROUP BY ALL),
a AS (SELECT c, sum(n) AS a, max(n) AS best FROM k GROUP BY 1), d AS (SELECT l, sum(n) AS b FROM k GROUP BY 1), t AS (SELECT sum(n) AS t FROM k),
s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM k) AS idx, (SELECT sum(a * (a - 1) / 2) FROM a) AS pa, (SELECT sum(b * (b - 1) / 2) FROM d) AS pb, (SELECT sum(best) FROM a) AS best,
  (SELECT sum(n / t * ln(n * t / (a * b))) FROM k JOIN a USING (c) JOIN d USING (l), t) AS mi, (SELECT -sum(a / t * ln(a / t)) FROM a, t) AS ha, (SELECT -sum(b / t * ln(b / t)) FROM d, t) AS hb)
SELECT round(best / t, 4) AS purity, round((idx - pa * pb / (t * (t - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (t * (t - 1) / 2)), 4) AS ari, round(2 * mi / (ha + hb), 4) AS nmi FROM s, t""")
def cluster_purity_nmi_ari(spark, sf):
    best = classify.ensemble([(_softmax(spark, sf), 1.0)]).select(F.col("key").alias("vec_id"), F.col("label").alias("cluster"))
    m = clusters.agreement(best.join(_embeddings(spark, sf), "vec_id"), "cluster", "label")
    return m.select(r4("purity", "purity"), r4("ari", "ari"), r4("nmi", "nmi"))


@query()
def agglomerative_clusters(spark, sf):
    """Average linkage within each label, of any size."""
    return clusters.average_linkage(_embeddings(spark, sf), "vec_id", "embedding", "label")


@query()
def mmr_rerank(spark, sf):
    e = _embeddings(spark, sf)
    rows = _dense(spark, sf, 10).join(e.select("vec_id", "embedding"), "vec_id").select(F.col("query_id").alias("query"), F.col("vec_id").alias("doc"), "score", "embedding")
    return search.diversified(rows, "embedding")


# --- lexical search: items divisible by 100 are queries, against all documents --------------------------------------

_STOP = ", ".join(f"'{w}'" for w in search.STOP_WORDS)


def _stems(text: str) -> str:
    cases = " ".join(f"WHEN t LIKE '%{x}' AND length(t) >= {len(x) + 3} THEN left(t, length(t) - {len(x)})" for x in tx.SUFFIXES)
    return f"list_transform(list_filter(regexp_extract_all(lower(coalesce({text}, '')), '[a-z0-9]+'), lambda t: t NOT IN ({_STOP})), lambda t: CASE {cases} ELSE t END)"


_INDEX = f"""WITH tk AS (SELECT doc_id AS doc, {_stems("text")} AS ts FROM documents), ix AS (SELECT doc, len(ts) AS length, unnest(ts) AS term FROM tk),
tf AS (SELECT doc, length, term, count(*) AS tf FROM ix GROUP BY ALL), dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), st AS (SELECT count(*) AS n, avg(len(ts)) AS al FROM tk),
qt AS (SELECT query, term, count(*) AS qtf FROM (SELECT item_id AS query, unnest({_stems("text")}) AS term FROM benchmark WHERE item_id % 100 = 0) GROUP BY ALL),
kt AS (SELECT query, term, df, df <= 0.4 * n AS rare, bool_or(df <= 0.4 * n) OVER (PARTITION BY query) AS has_rare, row_number() OVER (PARTITION BY query ORDER BY df, term) AS i FROM qt JOIN dfs USING (term), st),
rt AS (SELECT query, term, df FROM kt WHERE (rare AND i <= 12) OR (NOT has_rare AND i <= 3))"""
_BM25 = _INDEX + """, raw AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS r FROM dfs, st), idf AS (SELECT term, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw),
bm AS (SELECT query, doc, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / al))) AS score FROM qt JOIN idf USING (term) JOIN tf USING (term), st GROUP BY ALL HAVING score > 0),
bk AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) AS rank FROM bm)"""
_LEX = _BM25 + """, lx AS (SELECT query, doc, 0.1 * sum(tf) / ln(1 + any_value(length)) AS score FROM rt JOIN tf USING (term) GROUP BY ALL),
lk AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) AS rank FROM lx)"""
_RRF = _LEX + """, u AS (SELECT query, doc, rank, 1.0 AS w FROM bk WHERE rank <= 50 UNION ALL SELECT query, doc, rank, 0.25 FROM lk WHERE rank <= 50), fu AS (SELECT query, doc, sum(w / (60 + rank)) AS rrf, min(rank) AS best FROM u GROUP BY ALL),
fr AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(rrf, 12) DESC, best, doc) AS rank FROM fu)"""


def _documents(spark, sf):
    return spread(table(spark, sf, "documents").select("doc_id", "text"))


#: The same with every item as a query.
_ALL_INDEX, _ALL_RRF = (x.replace("FROM benchmark WHERE item_id % 100 = 0", "FROM benchmark") for x in (_INDEX, _RRF))


def _lexicon(spark, sf, items="item_id % 100 = 0"):
    """The kept index, and the known terms of the queries."""
    docs = f"{sf}/documents.parquet"
    index = LexicalIndex(spark, kept(spark, "lexical-index", docs, lambda path: LexicalIndex.build(spread(table(spark, sf, "documents").select("doc_id", "text", "lang")), path, attribute="lang")))
    return index, search.query_terms(table(spark, sf, "benchmark").where(items), "item_id", "text", index.terms)


def _scores(spark, sf, items="item_id % 100 = 0"):
    index, terms = _lexicon(spark, sf, items)
    postings = index.postings(terms, positions=False)
    return search.bm25(postings, terms, search.okapi_idf(index.terms, index.n_docs), index.average_length), cover_density(postings, search.rarest_terms(terms, index.n_docs))


@query(_BM25 + " SELECT query, doc, rank::INT AS rank, round(score, 4) AS score FROM bk WHERE rank <= 10")
def bm25_topk(spark, sf):
    return search.ranked(_scores(spark, sf)[0], 10).select("query", "doc", "rank", r4("score", "score"))


@query(_LEX + " SELECT query, doc, rank::INT AS rank, round(score, 4) AS score FROM lk WHERE rank <= 10")
def lexical_topk(spark, sf):
    return search.ranked(_scores(spark, sf)[1], 10).select("query", "doc", "rank", r4("score", "score"))


@query(_INDEX + " SELECT term, df FROM dfs")
def doc_frequency(spark, sf):
    return _lexicon(spark, sf)[0].terms


@query(_ALL_INDEX + " SELECT query, term, df FROM rt")
def idf_pruned_terms(spark, sf):
    """The rarest terms of every item."""
    index, terms = _lexicon(spark, sf, "true")
    return search.rarest_terms(terms, index.n_docs)


def _fused(spark, sf, items="item_id % 100 = 0"):
    a, b = (search.ranked(x, 50) for x in _scores(spark, sf, items))
    return search.reciprocal_rank_fusion({"bm25": (a, 1.0), "lexical": (b, 0.25)}), a, b


@query(_ALL_RRF + """, a AS (SELECT query, doc, rank FROM bk WHERE rank <= 10), b AS (SELECT query, doc, rank FROM lk WHERE rank <= 10), c AS (SELECT query, doc, rank FROM fr WHERE rank <= 10)
SELECT query, doc, a.rank::INT AS rank_bm25, b.rank::INT AS rank_lexical, c.rank::INT AS rank_fused, (a.rank - b.rank)::INT AS moved_lexical, (a.rank - c.rank)::INT AS moved_fused FROM a FULL JOIN b USING (query, doc) FULL JOIN c USING (query, doc)""")
def strategy_comparison(spark, sf):
    """The first ten of three strategies side by side for every item, with movements of ranks."""
    fused, a, b = _fused(spark, sf, "true")
    return search.compared({"bm25": a.where("rank <= 10"), "lexical": b.where("rank <= 10"), "fused": fused.where("rank <= 10")}, "bm25")


@query(_RRF + " SELECT query, doc, rank::INT AS rank, round(rrf, 6) AS rrf FROM fr WHERE rank <= 20")
def rrf_fusion(spark, sf):
    return _fused(spark, sf)[0].where("rank <= 20").select("query", "doc", "rank", F.round("rrf", 6).alias("rrf"))


@query(_RRF + """, p AS (SELECT *, 0.7 / (1 + doc % 7) + 0.3 * rrf / max(rrf) OVER (PARTITION BY query) AS final FROM fr WHERE rank <= 20)
SELECT query, doc, (row_number() OVER (PARTITION BY query ORDER BY round(final, 9) DESC, round(rrf, 12) DESC, doc))::INT AS final_rank, round(final, 4) AS final FROM p""")
def rerank_blend(spark, sf):
    """The second score is a column that a scorer provides; here it is a function of the id."""
    rows = _fused(spark, sf)[0].withColumn("p", 1 / (1 + F.col("doc") % 7))
    return search.blended(rows, "p").select("query", "doc", "final_rank", r4("final", "final"))


@query(_RRF + """, mg AS (SELECT query, max(CASE WHEN rank = 1 THEN score END) - max(CASE WHEN rank = 2 THEN score END) AS m FROM bk WHERE rank <= 50 GROUP BY 1)
SELECT query, doc, rank::INT AS rank, 'dense' AS stage FROM bk JOIN mg USING (query) WHERE rank <= 5 AND (m IS NULL OR m >= 1.0) UNION ALL SELECT query, doc, rank::INT, 'hybrid' FROM fr JOIN mg USING (query) WHERE rank <= 5 AND m < 1.0""")
def adaptive_ladder(spark, sf):
    fused, first, _ = _fused(spark, sf)
    return search.adaptive(first.where("rank <= 50"), fused, 1.0).where("rank <= 5")


@query(_BM25 + """, td AS (SELECT query, term, count(*) AS c FROM bk JOIN tf USING (doc) WHERE rank <= 3 GROUP BY ALL HAVING count(*) >= 2)
SELECT query, term, df FROM td JOIN dfs USING (term), st WHERE df <= 0.4 * n AND NOT EXISTS (SELECT 1 FROM qt WHERE qt.query = td.query AND qt.term = td.term) QUALIFY row_number() OVER (PARTITION BY query ORDER BY df, term) <= 6""")
def expansion_terms(spark, sf):
    index, terms = _lexicon(spark, sf)
    return search.expansion_terms(search.ranked(_scores(spark, sf)[0], 3), index.postings(positions=False), terms, index.terms, index.n_docs)


_SETS = """WITH q AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS a FROM benchmark WHERE item_id % 100 = 0), d AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS b FROM documents)"""


@query(_SETS + " SELECT item_id, doc_id, round(len(list_intersect(a, b)) / len(a), 4) AS containment, round(CASE WHEN least(len(a), len(b)) > 0 THEN len(list_intersect(a, b)) / least(len(a), len(b)) ELSE 0 END, 4) AS overlap FROM d, q")
def containment_overlap(spark, sf):
    """Items divisible by 100, a stated query set, against all documents."""
    words = F.array_distinct(tx.tokens(F.col("text")))
    q = table(spark, sf, "benchmark").where("item_id % 100 = 0").select("item_id", words.alias("a"))
    d = _documents(spark, sf).select("doc_id", words.alias("b")).join(q)
    return d.select("item_id", "doc_id", r4(grounding.containment(F.col("a"), F.col("b")), "containment"), r4(grounding.overlap_coefficient(F.col("a"), F.col("b")), "overlap"))


@query("""WITH k(label, keyword) AS (VALUES ('cause', 'the'), ('cause', 'that'), ('place', 'in'), ('way', 'with the'), ('way', 'by')), h AS (SELECT doc_id, label, sum(len(string_split(keyword, ' '))) AS m FROM documents, k WHERE regexp_matches(lower(text), '(^|[^a-z0-9_])' || keyword) GROUP BY ALL)
SELECT doc_id AS doc, label, round(m / (sum(m) OVER (PARTITION BY doc_id) + 1), 4) AS p FROM h""")
def rules_classify(spark, sf):
    k = spark.createDataFrame([("cause", "the"), ("cause", "that"), ("place", "in"), ("way", "with the"), ("way", "by")], "label string, keyword string")
    return classify.rules(table(spark, sf, "documents"), "doc_id", "text", F.broadcast(k)).select("doc", "label", r4("p", "p"))


# --- documents and text ----------------------------------------------------------------------------------------------


@query("SELECT md5(lower(text) || '|') AS h, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def content_hash_duplicates(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", tx.content_hash(F.col("text"), F.lit(None).cast("string")).alias("h"))
    return d.groupBy("h").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query("SELECT min(doc_id) AS doc_id, count(*) AS occurrences FROM documents GROUP BY md5(lower(text))")
def first_seen_dedup(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.md5(F.lower("text")).alias("h"))
    return d.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("occurrences")).drop("h")


@query(f"SELECT doc_id, len(regexp_extract_all(text, '{tx.EMAIL}'))::INT AS emails, len(regexp_extract_all(text, '{tx.IPV4}'))::INT AS addresses FROM documents WHERE regexp_matches(text, '{tx.EMAIL}|{tx.IPV4}')")
def pii_counts(spark, sf):
    d = table(spark, sf, "documents").where(F.col("text").rlike(f"{tx.EMAIL}|{tx.IPV4}"))
    return d.select("doc_id", F.regexp_count("text", F.lit(tx.EMAIL)).alias("emails"), F.regexp_count("text", F.lit(tx.IPV4)).alias("addresses"))


@query("""WITH d AS (SELECT c_custkey, lpad((c_custkey * 7919)::VARCHAR, 12, '0') AS s FROM customer), x AS (SELECT c_custkey, i, substr(reverse(s), i, 1)::INT AS n FROM d, range(1, 13) r(i))
SELECT c_custkey, sum(CASE WHEN i % 2 = 1 THEN n WHEN n > 4 THEN 2 * n - 9 ELSE 2 * n END) % 10 = 0 AS valid FROM x GROUP BY 1""")
def luhn_check(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", tx.luhn(F.lpad((F.col("c_custkey") * 7919).cast("string"), 12, "0")).alias("valid"))


@query("SELECT c_custkey, trim(regexp_replace(lower(c_name || ' / ' || c_mktsegment), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM customer")
def slug(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", tx.slug(F.concat("c_name", F.lit(" / "), "c_mktsegment")).alias("slug"))


@query("SELECT doc_id, ((length(text) + 3) // 4)::BIGINT AS tokens, length(text)::INT AS chars FROM documents")
def token_estimates(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.estimated_tokens(F.col("text")).alias("tokens"), F.length("text").alias("chars"))


@query("""WITH d AS (SELECT doc_id, text, list_filter(string_split_regex(text, '[ \\t\\n\\r]+'), lambda w: w <> '') AS w FROM documents),
k AS (SELECT *, list_transform(w, lambda x: 1 + ('0x' || substr(md5(x), 2, 2))::INT % greatest(length(x) - 2, 1)) AS places FROM d)
SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[!-/:-@\\[-`{-~]', '', 'g'), '[ \\t\\n\\r]+', ' ', 'g')) AS plain, upper(replace(text, 'ß', 'ss')) AS loud,
  array_to_string(list_slice(w, 1, greatest(4, ceil(len(w) * 0.6)::INT)), ' ') AS cut, 'hi there, ' || text || ' thanks in advance' AS noisy,
  array_to_string(list_transform(list_zip(w, places), lambda p: CASE WHEN length(p[1]) < 4 OR ('0x' || substr(md5(p[1]), 1, 1))::INT >= 2 THEN p[1]
    WHEN ('0x' || substr(md5(p[1]), 4, 1))::INT % 3 = 0 THEN left(p[1], p[2]) || substr(p[1], p[2] + 2, 1) || substr(p[1], p[2] + 1, 1) || substr(p[1], p[2] + 3)
    WHEN ('0x' || substr(md5(p[1]), 4, 1))::INT % 3 = 1 THEN left(p[1], p[2]) || substr(p[1], p[2] + 2)
    ELSE left(p[1], p[2] + 1) || substr(p[1], p[2] + 1) END), ' ') AS typos FROM k""")
def perturbed_texts(spark, sf):
    kinds = {"plain": "lower_no_punctuation", "loud": "upper", "cut": "truncated", "noisy": "noise", "typos": "typos"}
    return _documents(spark, sf).select("doc_id", *[tx.perturbed(F.col("text"), kind).alias(name) for name, kind in kinds.items()])


@query()
def normalize_text(spark, sf):
    return tx.normalised(table(spark, sf, "pages").select("page_id", "html"), "html").select("page_id", "normalised")


@query()
def redact_pii(spark, sf):
    return tx.redacted(_documents(spark, sf), "text").select("doc_id", "redacted.text", "redacted.counts")


@query("""WITH t AS (SELECT lang AS cluster, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS term FROM documents), f AS (SELECT cluster, term, count(*) AS tf FROM t WHERE length(term) > 2 GROUP BY ALL), d AS (SELECT term, count(*) AS df FROM f GROUP BY 1),
n AS (SELECT count(*) AS n FROM (SELECT DISTINCT lang FROM documents)), k AS (SELECT cluster, term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS weight FROM f JOIN d USING (term), n)
SELECT cluster, term, round(weight, 4) AS weight, (row_number() OVER (PARTITION BY cluster ORDER BY round(weight, 9) DESC, term))::INT AS rank FROM k QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY round(weight, 9) DESC, term) <= 8""")
def ctfidf_keywords(spark, sf):
    return clusters.keywords(table(spark, sf, "documents").select("lang", "text"), "lang", "text").withColumn("weight", F.round("weight", 4))


@query("SELECT role, count(*) AS turns, count(DISTINCT conv_id) AS conversations, round(avg(length(text)), 4) AS mean_chars, max(length(text))::INT AS max_chars FROM conversations GROUP BY 1")
def conversation_turn_stats(spark, sf):
    n = F.length("text")
    return table(spark, sf, "conversations").groupBy("role").agg(F.count("*").alias("turns"), F.count_distinct("conv_id").alias("conversations"), r4(F.avg(n), "mean_chars"), F.max(n).alias("max_chars"))

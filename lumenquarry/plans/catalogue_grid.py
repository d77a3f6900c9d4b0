"""Queries of tuning, nested gates, discovery, cues and table functions, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tables
from ..operators import cues, discovery, metrics, search, tuning
from ..sources.files import few, kept, removed, scratch, table, written
from .catalogue import _LEX, _documents, _embeddings, _lexicon, _scores, query, r4
from .catalogue_review import _SENTENCES

_GRID = ((0.05, 0.4), (0.0, 0.25, 1.0), (0.0, 0.5))


@query(_LEX.replace("rt AS (", "rt0 AS (", 1).replace("FROM rt JOIN", "FROM rt0 JOIN") + f""", g AS (SELECT x AS max_df FROM (VALUES {", ".join(f"({x}::DOUBLE)" for x in _GRID[0])}) t(x)), ws AS (SELECT x AS weight FROM (VALUES {", ".join(f"({x}::DOUBLE)" for x in _GRID[1])}) t(x)),
bs AS (SELECT x AS blend FROM (VALUES {", ".join(f"({x}::DOUBLE)" for x in _GRID[2])}) t(x)),
gt AS (SELECT max_df, query, term, df <= max_df * n AS rare, bool_or(df <= max_df * n) OVER (PARTITION BY max_df, query) AS any_rare, row_number() OVER (PARTITION BY max_df, query ORDER BY df, term) AS i FROM qt JOIN dfs USING (term), st, g),
gl AS (SELECT max_df, query, doc, sum(tf) / ln(1 + any_value(length)) AS score FROM gt JOIN tf USING (term) WHERE (rare AND i <= 12) OR (NOT any_rare AND i <= 3) GROUP BY ALL),
gr AS (SELECT max_df, query, doc, rank, true AS lexical FROM (SELECT *, row_number() OVER (PARTITION BY max_df, query ORDER BY round(score, 9) DESC, doc) AS rank FROM gl) WHERE rank <= 50 UNION ALL SELECT max_df, query, doc, rank, false FROM bk, g WHERE rank <= 50),
gf AS (SELECT max_df, weight, query, doc, sum(CASE WHEN lexical THEN weight ELSE 1.0 END / (60 + rank)) AS rrf, min(rank) AS best FROM gr, ws GROUP BY ALL),
gk AS (SELECT *, row_number() OVER (PARTITION BY max_df, weight, query ORDER BY round(rrf, 12) DESC, best, doc) AS rank, max(rrf) OVER (PARTITION BY max_df, weight, query) AS most FROM gf),
gb AS (SELECT *, row_number() OVER (PARTITION BY max_df, weight, blend, query ORDER BY round(blend / (1 + doc % 7) + (1 - blend) * rrf / most, 9) DESC, round(rrf, 12) DESC, doc) AS place FROM gk, bs WHERE rank <= 20),
gm AS (SELECT max_df, weight, blend, query, min(place) AS place FROM gb JOIN labels ON doc_id = doc AND quality = 1 WHERE place <= 10 GROUP BY ALL)
SELECT max_df, weight, blend, count(*) AS queries, round(avg(CASE WHEN place IS NULL THEN 0 ELSE 1 END), 6) AS hit, round(avg(coalesce(1.0 / place, 0)), 6) AS mrr FROM (SELECT * FROM (SELECT DISTINCT query FROM qt JOIN dfs USING (term)), g, ws, bs) LEFT JOIN gm USING (max_df, weight, blend, query) GROUP BY 1, 2, 3""")
def retrieval_grid(spark, sf):
    """Settings of hybrid retrieval side by side; documents labelled good are relevant."""
    index, terms = _lexicon(spark, sf)
    first = search.ranked(_scores(spark, sf)[0], 50)
    good = table(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias("doc"))
    relevant = terms.select("query").distinct().join(F.broadcast(good))  # a stated query set against labelled documents
    found = tuning.retrieval_grid(index.postings(terms, positions=False), terms, first, relevant, index.n_docs, 1 / (1 + F.col("doc") % 7), *map(list, _GRID))
    return found.select("max_df", "weight", "blend", "queries", F.round("hit", 6).alias("hit"), F.round("mrr", 6).alias("mrr"))


def _reports(spark, sf):
    q = F.col("l_quantity").cast("double")
    t = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("report")).agg(F.count("*").alias("n"), F.sum(q).alias("s"), F.min(q).alias("lo"), F.max(q).alias("hi"))
    body = F.struct(F.struct(F.col("n").alias("rows"), F.struct(F.col("s").alias("sum"), F.lit("x").alias("unit")).alias("quantity")).alias("totals"), F.array("lo", "hi").alias("range"), F.lit(True).alias("complete"))
    return t.select("report", F.to_json(body).alias("json"))


_PATHS = """WITH t AS (SELECT l_returnflag AS report, count(*)::DOUBLE AS n, sum(l_quantity)::DOUBLE AS s, min(l_quantity)::DOUBLE AS lo, max(l_quantity)::DOUBLE AS hi FROM lineitem GROUP BY 1),
p AS (SELECT report, 'totals.rows' AS path, n AS value FROM t UNION ALL SELECT report, 'totals.quantity.sum', s FROM t UNION ALL SELECT report, 'range.0', lo FROM t UNION ALL SELECT report, 'range.1', hi FROM t)"""


@query(_PATHS + " SELECT report, path, round(value, 4) AS value FROM p")
def nested_metrics(spark, sf):
    """Nested JSON reports as numbers by dotted path."""
    return metrics.flattened(_reports(spark, sf), "report", "json").select("report", "path", r4("value", "value"))


@query(_PATHS + """, c(path, min, max) AS (VALUES ('range.1', 1.0, 60.0), ('range.0', 2.0, NULL), ('totals.rows', NULL, 5.0), ('complete', 1.0, NULL), ('range.2', 0.0, NULL))
SELECT c.path, round(p.value, 4) AS value, CASE WHEN p.value IS NULL THEN 'missing' WHEN p.value < c.min THEN 'below' WHEN p.value > c.max THEN 'above' ELSE 'ok' END AS status FROM c LEFT JOIN (SELECT * FROM p WHERE report = 'A') p USING (path)""")
def nested_gates(spark, sf):
    """Gates over the nested report of one flag: a boolean is no number, and a place that a list doesn't have is missing."""
    checks = spark.createDataFrame([("range.1", 1.0, 60.0), ("range.0", 2.0, None), ("totals.rows", None, 5.0), ("complete", 1.0, None), ("range.2", 0.0, None)], "path string, min double, max double")
    found = metrics.flattened(_reports(spark, sf).where("report = 'A'"), "report", "json")
    return metrics.gate(found.select("path", "value"), checks).select("path", r4("value", "value"), "status")


_CUES = ", ".join(f"least(len(list_filter(w, lambda x: x IN ({', '.join(repr(y) for y in ws)}))) / n, 1.0)" for ws in cues.WORDS.values()) + """, least(len(regexp_extract_all(t, '!')) / n, 1.0), least(len(regexp_extract_all(t, '[?]')) / n, 1.0),
least(len(regexp_extract_all(t, '[A-Z]')) / c, 1.0), least(len(regexp_extract_all(t, '[0-9]')) / c, 1.0), least(len(regexp_extract_all(t, '[!?]{2,}')) / n, 1.0), least(ln(1 + len(w)) / 10, 1.0)"""


@query(f"""WITH a AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents), b AS (SELECT *, greatest(len(w), 1) AS n, greatest(length(t), 1) AS c FROM a)
SELECT doc_id, round(list_sum(list_transform(list_zip([{_CUES}], range(1, 15)), lambda p: p[1] * p[2])), 5) AS weighted, len([{_CUES}])::INT AS n FROM b""")
def text_cues(spark, sf):
    """A weighted sum of each text's fourteen cues."""
    found = _documents(spark, sf).select("doc_id", cues.cues(F.col("text")).alias("c"))
    return found.select("doc_id", F.round(F.aggregate(F.transform("c", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x), 5).alias("weighted"), F.size("c").alias("n"))


@query()
def affect_from_text(spark, sf):
    """From text to label: trained on labelled rows whose hash isn't 1 mod 3, judged by accuracy on the others beside that of the commonest class."""
    rows = _documents(spark, sf).join(table(spark, sf, "labels").select("doc_id", F.col("quality").cast("string").alias("label")), "doc_id")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = cues.AffectModel(spark, kept(spark, "affect-model", f"{sf}/labels.parquet", lambda path: cues.AffectModel.train(rows.where(~held), "text", "label", path)))
    found = model.predicted(rows.where(held), "doc_id", "text").join(rows.select(F.col("doc_id").alias("key"), F.col("label").alias("truth")), "key")
    share = found.groupBy("truth").agg(F.count("*").alias("n")).agg((F.max("n") / F.sum("n")).alias("commonest"))
    return found.agg(F.count("*").alias("held_out"), F.avg((F.col("label") == F.col("truth")).cast("double")).alias("accuracy")).join(share)


@query(f"SELECT doc_id, i::INT AS i, length(s)::INT AS chars FROM (SELECT doc_id, unnest(p) AS s, generate_subscripts(p, 1) - 1 AS i FROM (SELECT doc_id, list_filter({_SENTENCES}, lambda x: x <> '') AS p FROM documents))")
def sentence_table(spark, sf):
    """Sentences by a table function in SQL."""
    tables.register(spark)
    return spark.sql("SELECT doc_id, s.i, length(s.sentence) AS chars FROM {docs}, LATERAL sentences(text) AS s", docs=_documents(spark, sf))


@query("WITH x AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(x::DOUBLE) AS x FROM x GROUP BY ALL) SELECT label, round(sqrt(sum(x * x)), 5) AS length FROM m GROUP BY 1")
def mean_vector_lengths(spark, sf):
    """Lengths of labels' mean vectors by an aggregate function in SQL."""
    tables.register(spark)
    return spark.sql("SELECT label, round(sqrt(aggregate(v, 0D, (a, x) -> a + x * x)), 5) AS length FROM (SELECT label, vector_mean(embedding) AS v FROM {e} GROUP BY label)", e=_embeddings(spark, sf))


@query()
def cluster_proposals(spark, sf):
    """Labels as clusters: texts of documents with the vectors' ids, the nearest other vector's label, and what to propose for each."""
    e = _embeddings(spark, sf)
    path = scratch(spark, "profile")
    profile = written(discovery.neighbour_profile(_dense_all(spark, sf)), path)
    # Texts of other documents aren't shuffled.
    texts = _documents(spark, sf).withColumnRenamed("doc_id", "vec_id").join(few(profile.select(F.col("query").alias("vec_id"))), "vec_id", "left_semi")
    rows = e.join(texts, "vec_id").join(profile, F.col("vec_id") == F.col("query"))
    members = rows.select(F.col("label").alias("cluster"), F.col("vec_id").alias("key"), F.col("embedding").alias("vector"), "text", F.concat(F.lit("label_"), F.get("labels", F.lit(0))).alias("nearest"), "top")
    existing = e.select(F.concat(F.lit("label_"), F.col("label")).alias("label_id"), F.lit("team").alias("team")).distinct()
    found = discovery.proposed(members, existing, covered=0.35, agreed=0.2)
    removed(spark, path)
    return found


def _dense_all(spark, sf):
    from ..functions import vectors as vx

    e = _embeddings(spark, sf)
    return vx.top_k(e, e, 5).join(e.select("vec_id", "label"), "vec_id").select(F.col("query_id").alias("query"), "rank", "score", "label")

"""Queries of operators/assess.py and operators/grounding.py, of affect classification and sliding windows, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assess, classify, clusters, drift, grounding
from ..operators.search import STOP_WORDS
from ..sources.files import table, tasks
from ..streaming import events as streams
from .catalogue import _PAIRS, _dense, query, r4


def _events(spark, sf):
    return table(spark, sf, "events")


# --- grounded answers: an order stands for an answer, its lines for steps, suppliers and parts for sources and units --------


@query("""WITH a AS (SELECT DISTINCT l_orderkey AS answer, 'S-' || l_suppkey AS cited FROM lineitem), r AS (SELECT DISTINCT l_orderkey AS answer, 's-' || l_suppkey AS source FROM lineitem WHERE l_linenumber <= 3)
SELECT a.answer, cited, source FROM a LEFT JOIN r ON a.answer = r.answer AND lower(cited) = lower(source)""")
def answer_citations(spark, sf):
    """Citations in brackets, in another case than the sources' ids; those of later lines weren't retrieved."""
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber")
    answers = rows.groupBy(F.col("l_orderkey").alias("answer")).agg(F.collect_list(F.concat(F.lit("[S-"), "l_suppkey", F.lit(" ]"))).alias("citations"))
    retrieved = rows.where("l_linenumber <= 3").select(F.col("l_orderkey").alias("answer"), F.concat(F.lit("s-"), "l_suppkey").alias("source")).distinct()
    return grounding.citations(answers, retrieved)


_STEPS = """WITH s AS (SELECT l_orderkey AS answer, l_partkey AS step, p_name || ' of size ' || p_size || CASE WHEN q > 40 THEN ' for $77' ELSE '' END AS text, l_partkey AS source FROM (SELECT l_orderkey, l_partkey, max(l_quantity) AS q FROM lineitem GROUP BY ALL) JOIN part ON p_partkey = l_partkey),
u AS (SELECT p_partkey AS source, p_name || ' ' || p_type || CASE WHEN p_size % 2 = 0 THEN ' of size ' || p_size ELSE '' END AS text FROM part),
w AS (SELECT answer, step, list_distinct(regexp_extract_all(lower(s.text), '[a-z0-9]+')) AS a, list_distinct(regexp_extract_all(lower(u.text), '[a-z0-9]+')) AS b, s.text LIKE '%$77' AND NOT contains(regexp_replace(lower(u.text), '[^a-z0-9]', '', 'g'), '77') AS lacks FROM s JOIN u USING (source)),
g AS (SELECT answer, step, len(list_intersect(a, b)) / len(a) AS support, lacks::INT AS invented, len(list_intersect(a, b)) / len(a) >= 0.75 AND NOT lacks AS grounded FROM w)"""


def _steps(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_type", "p_size")
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    n = tasks(rows.count())
    lines = rows.repartition(n, "l_orderkey").groupBy("l_orderkey", "l_partkey").agg(F.max("l_quantity").alias("quantity"))
    lines = lines.join(part, F.col("l_partkey") == F.col("p_partkey"))
    price = F.when(F.col("quantity") > 40, " for $77").otherwise("")
    steps = lines.select(F.col("l_orderkey").alias("answer"), F.col("l_partkey").alias("step"), F.concat("p_name", F.lit(" of size "), "p_size", price).alias("text"), F.col("l_partkey").alias("source"))
    known = F.concat("p_name", F.lit(" "), "p_type", F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" of size "), "p_size")).otherwise(""))
    units = lines.select(F.col("l_orderkey").alias("answer"), F.col("l_partkey").alias("source"), known.alias("text"))
    return grounding.grounded_steps(steps.drop("source"), units, cited=steps.select("answer", "step", "source"), parts=n)


@query(_STEPS + " SELECT answer, step, round(support, 4) AS support, invented, grounded FROM g")
def step_grounding(spark, sf):
    """A step names a part, its size and sometimes a price, which no source states."""
    return _steps(spark, sf).select("answer", "step", r4("support", "support"), "invented", "grounded")


@query(_STEPS + " SELECT answer, count(*) AS n, count(*) FILTER (WHERE grounded) AS grounded, round(count(*) FILTER (WHERE grounded) / count(*), 4) AS ratio, count(*) FILTER (WHERE grounded) / count(*) >= 0.6 AS valid FROM g GROUP BY 1")
def answer_validation(spark, sf):
    return grounding.validation(_steps(spark, sf)).withColumn("ratio", F.round("ratio", 4))


@query(_STEPS + """, c AS (SELECT l_orderkey AS answer, l_linenumber <= 3 AS valid, l_returnflag = 'N' AS relevant FROM lineitem), p AS (SELECT answer, count(*) AS n, count(*) FILTER (WHERE support < 0.5) AS bad, avg(grounded::INT) AS grounded, avg((step % 2 = 0)::INT) AS coverage FROM g GROUP BY 1),
q AS (SELECT answer, count(*) AS cites, count(*) FILTER (WHERE NOT valid) AS invalid, count(*) FILTER (WHERE valid AND relevant) AS good FROM c GROUP BY 1), j AS (SELECT * FROM p LEFT JOIN q USING (answer))
SELECT count(*) AS answered, round(1 - sum(bad) / sum(n), 4) AS faithfulness, round(count(*) FILTER (WHERE bad > 0 OR invalid > 0) / count(*), 4) AS hallucinated, round(1 - sum(invalid) / sum(cites), 4) AS validity, round(sum(good) / sum(cites - invalid), 4) AS precision, round(avg(coverage), 4) AS coverage, round(avg(grounded), 4) AS grounded FROM j""")
def answer_quality(spark, sf):
    steps = _steps(spark, sf).select("answer", "step", F.col("support").alias("containment"), "grounded", (F.col("step") % 2 == 0).alias("cited"))
    cites = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("answer"), (F.col("l_linenumber") <= 3).alias("valid"), (F.col("l_returnflag") == "N").alias("relevant"))
    cites = cites.repartition(tasks(cites.count()), "answer")
    scores = assess.answer_scores(steps, cites)
    return scores.select("answered", *[F.round(c, 4).alias(c) for c in scores.columns[1:]])


@query("""WITH r AS (SELECT DISTINCT l_orderkey AS answer, l_suppkey AS source FROM lineitem WHERE l_linenumber <= 4), s AS (SELECT DISTINCT l_orderkey AS answer, l_suppkey AS source FROM lineitem WHERE l_linenumber BETWEEN 2 AND 5), c AS (SELECT l_orderkey AS answer, l_suppkey AS source, l_linenumber AS step FROM lineitem WHERE l_linenumber >= 3), d AS (SELECT DISTINCT answer, source FROM c)
SELECT 'selected_not_retrieved' AS check, count(*) AS n FROM (FROM s EXCEPT FROM r) UNION ALL SELECT 'cited_not_retrieved', count(*) FROM (FROM d EXCEPT FROM r) UNION ALL SELECT 'cited_not_selected', count(*) FROM (FROM d EXCEPT FROM s)
UNION ALL SELECT 'invalid_citation_survived', count(*) FROM (FROM d INTERSECT SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_linenumber = 7) UNION ALL SELECT 'step_missing', count(*) FROM (SELECT DISTINCT answer, source FROM c WHERE step = 6)""")
def lineage_checks(spark, sf):
    """All invariants over edges of which some are broken by construction; step 6 isn't there."""
    l = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("answer"), F.col("l_suppkey").alias("source"), F.col("l_linenumber").alias("step"))
    edges = grounding.lineage(l.where("step <= 4"), l.where("step between 2 and 5"), l.where("step >= 3"))
    return grounding.broken_lineage(edges, l.where("step <> 6"), l.where("step = 7")).groupBy("check").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag AS name, count(*) AS n, round(avg(l_quantity), 4) AS mean, round(quantile_cont(l_quantity, 0.95), 4) AS p95 FROM lineitem GROUP BY 1")
def trace_latencies(spark, sf):
    """Stages and their latencies from arrays of structs, one trace for each order."""
    t = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_returnflag").alias("name"), F.col("l_quantity").alias("latency"))).alias("trace"))
    return grounding.stage_latencies(t).select("name", "n", r4("mean", "mean"), r4("p95", "p95"))


@query("""WITH o AS (SELECT l_orderkey, list_distinct(list(l_partkey) FILTER (WHERE l_linenumber <= 3)) AS o, list_distinct(list(l_partkey) FILTER (WHERE l_linenumber >= 2)) AS n, max(l_returnflag) AS x, min(l_returnflag) AS y FROM lineitem GROUP BY 1 HAVING o IS NOT NULL AND n IS NOT NULL)
SELECT l_orderkey, len(list_filter(n, lambda i: NOT list_contains(o, i)))::INT AS added, len(list_filter(o, lambda i: NOT list_contains(n, i)))::INT AS removed, len(list_intersect(o, n))::INT AS common, x <> y AS changed, x = y AND list_sort(o) = list_sort(n) AS reproduced FROM o""")
def case_changes(spark, sf):
    """An order's first three lines against those from the second on, as two runs of a case."""
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    items = F.sort_array(F.collect_set("l_partkey")).alias("items")
    flags = l.groupBy("l_orderkey").agg(F.max("l_returnflag").alias("x"), F.min("l_returnflag").alias("y"))
    run = lambda rows, flag: rows.groupBy("l_orderkey").agg(items).join(flags.select("l_orderkey", F.col(flag).alias("flag")), "l_orderkey")
    d = grounding.case_diff(run(l.where("l_linenumber <= 3"), "x"), run(l.where("l_linenumber >= 2"), "y"), "l_orderkey", "items", ["flag"])
    return d.select("l_orderkey", F.size("added").alias("added"), F.size("removed").alias("removed"), "common", (F.size("changed") > 0).alias("changed"), "reproduced")


@query()
def extractive_answers(spark, sf):
    """Names of an order's parts as steps; one too like an earlier one is skipped. A fold, for which tests have a brute-force version."""
    part = table(spark, sf, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("text"))
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(part, F.col("l_partkey") == F.col("p_partkey"))
    return grounding.extractive_steps(lines.select(F.col("l_orderkey").alias("answer"), F.col("l_linenumber").alias("position"), "text"))


# --- findings, alerts, decisions ------------------------------------------------------------------------------------------

_W = "({0} / {1} + 1.9208 / {1} - 1.96 * sqrt({0} / {1} * (1 - {0} / {1}) / {1} + 0.9604 / ({1} * {1}))) / (1 + 3.8416 / {1})"
_GROUPS = "SELECT event_type AS g, count(*) AS requests, count(*) FILTER (WHERE value > 20) AS feedback, count(*) FILTER (WHERE value > 45) AS rejected, count(*) FILTER (WHERE value < 15) AS abstained FROM events GROUP BY 1"


@query(f"""WITH g AS ({_GROUPS}), h AS (SELECT *, rejected / feedback AS share, {_W.format("rejected", "feedback")} AS low, abstained / requests AS out FROM g WHERE feedback > 0),
t AS (SELECT count(*) AS requests, count(*) FILTER (WHERE value > 20) AS feedback, count(*) FILTER (WHERE event_type = 'error') AS unreliable, count(*) FILTER (WHERE value > 100) AS degraded FROM events),
l AS (SELECT l_orderkey, max(l_returnflag) = 'R' AS bad, list(l_suppkey) AS c, list(l_suppkey) FILTER (WHERE l_returnflag = 'R' AND l_quantity > 48) AS r FROM lineitem GROUP BY 1),
s AS (SELECT source, sum(b) AS rejected, sum(k) AS helpful, sum(e) AS explicit FROM (SELECT unnest(list_distinct(c)) AS source, bad::INT AS b, (NOT bad)::INT AS k, 0 AS e FROM l UNION ALL SELECT unnest(list_distinct(r)), 0, 0, 1 FROM l) GROUP BY 1),
x AS (SELECT *, rejected / nullif(rejected + helpful, 0) AS share, rejected + helpful AS cited FROM s),
f AS (SELECT 'problem_intent' AS kind, CASE WHEN low >= 0.4 THEN 'high' ELSE 'medium' END AS severity, g AS subject, share AS value FROM h WHERE feedback >= 5 AND share >= 0.4 AND low >= 0.2
UNION ALL SELECT 'weak_article', CASE WHEN explicit >= 3 THEN 'high' ELSE 'medium' END, source::VARCHAR, share FROM x WHERE source % 2 = 0 AND (explicit >= 2 OR (cited >= 3 AND share >= 0.5))
UNION ALL SELECT 'rejected_ticket', 'medium', source::VARCHAR, share FROM x WHERE source % 2 = 1 AND (explicit >= 2 OR (cited >= 3 AND share >= 0.6))
UNION ALL SELECT 'intent_confusion', 'medium', o_orderpriority || ' > ' || o_orderstatus, count(*) FROM orders GROUP BY o_orderpriority, o_orderstatus HAVING count(*) >= 2
UNION ALL SELECT 'abstention_cluster', 'medium', g, out FROM h WHERE abstained >= 5 AND out >= 0.3
UNION ALL SELECT 'grounding_failures', 'high', 'unreliable', unreliable / requests FROM t WHERE unreliable >= 0.05 * requests
UNION ALL SELECT 'llm_degradation', 'high', 'degraded', degraded / requests FROM t WHERE degraded >= 0.1 * requests)
SELECT kind, severity, subject, round(value, 4) AS value FROM f""")
def improvement_findings(spark, sf):
    """Events stand for requests and their ratings, orders for rated answers with cited sources."""
    e, n = _events(spark, sf).select("event_type", "value"), F.count_if
    groups = e.groupBy(F.col("event_type").alias("group")).agg(F.count("*").alias("requests"), n(F.col("value") > 20).alias("feedback"), n(F.col("value") > 45).alias("rejected"), n(F.col("value") < 15).alias("abstained"))
    totals = e.agg(F.count("*").alias("requests"), n(F.col("value") > 20).alias("feedback"), n(F.col("value") > 20).alias("rated"), n(F.col("event_type") == "error").alias("unreliable"), n(F.col("value") > 100).alias("degraded"))
    wrong = (F.col("l_returnflag") == "R") & (F.col("l_quantity") > 48)
    rated = table(spark, sf, "lineitem").groupBy("l_orderkey").agg((F.max("l_returnflag") == "R").alias("bad"), F.collect_set("l_suppkey").alias("cited"), F.collect_set(F.when(wrong, F.col("l_suppkey"))).alias("named"))
    sources = assess.source_counts(rated, "cited", "named", F.col("bad"), F.when(F.col("source").cast("bigint") % 2 == 0, "article").otherwise("ticket"))
    confusions = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("predicted"), F.col("o_orderstatus").alias("corrected")).agg(F.count("*").alias("n"))
    return assess.all_findings(totals, groups, sources, confusions).withColumn("value", F.round("value", 4))


_SIDES = "SELECT event_type, value, CASE WHEN ts > (SELECT max(ts) FROM events) - INTERVAL 3 DAY THEN 'recent' ELSE 'baseline' END AS side FROM events"


@query(f"""WITH s AS ({_SIDES}), c AS (SELECT coalesce(nullif(event_type, ''), 'unknown') AS k, count(*) FILTER (WHERE side = 'baseline') AS a, count(*) FILTER (WHERE side = 'recent') AS b FROM s GROUP BY 1), p AS (SELECT a / sum(a) OVER () AS p, b / sum(b) OVER () AS q FROM c),
j AS (SELECT sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2 AS js FROM p),
v AS (SELECT 'abstention_rate' AS signal, avg((event_type = 'error')::INT) FILTER (WHERE side = 'recent') - avg((event_type = 'error')::INT) FILTER (WHERE side = 'baseline') AS value, 0.1 AS lim FROM s
UNION ALL SELECT 'mean_evidence', avg(value) FILTER (WHERE side = 'baseline') - avg(value) FILTER (WHERE side = 'recent'), 0.05 FROM s UNION ALL SELECT 'js_event_type', js, 0.1 FROM j UNION ALL SELECT 'negative_feedback', avg((value < 30)::INT) FILTER (WHERE side = 'recent'), 0.35 FROM s),
n AS (SELECT count(*) FILTER (WHERE side = 'recent') >= 30 AND count(*) FILTER (WHERE side = 'baseline') >= 30 AS enough FROM s)
SELECT signal, round(value, 4) AS value, enough AND value > lim AS alert, CASE WHEN NOT enough THEN 'insufficient_data' WHEN max((enough AND value > lim)::INT) OVER () = 1 THEN 'alert' ELSE 'ok' END AS status FROM v, n""")
def fast_drift_alerts(spark, sf):
    """The last three days against those before; errors stand for abstentions, values for evidence."""
    e = _events(spark, sf).select("event_type", "value", "ts")
    end = F.broadcast(e.agg(F.max("ts").alias("end")))  # one row
    sided = e.join(end).select("event_type", "value", F.when(F.col("ts") > F.col("end") - F.expr("interval 3 days"), "recent").otherwise("baseline").alias("side"))
    negative = sided.where("side = 'recent'").agg(F.avg((F.col("value") < 30).cast("int")).alias("negative"))
    out = assess.fast_alerts(sided, F.col("event_type") == "error", F.col("value"), ["event_type"], negative)
    return out.select("signal", r4("value", "value"), "alert", "status")


@query("""WITH c AS (SELECT p_brand AS cluster, count(*) > 2 AS significant, min(p_size) > 30 AS covered, nullif(avg((p_size > 25)::INT), 0) AS overlap FROM part GROUP BY 1)
SELECT cluster, significant AND NOT covered AND coalesce(overlap, 0) < 0.5 AS needs, significant AND NOT covered AND coalesce(overlap, 0) < 0.5 AS due FROM c""")
def discovery_due(spark, sf):
    """Brands stand for clusters; the last run was 30 hours ago."""
    c = table(spark, sf, "part").groupBy(F.col("p_brand").alias("cluster")).agg((F.count("*") > 2).alias("significant"), (F.min("p_size") > 30).alias("covered"), F.nullif(F.avg((F.col("p_size") > 25).cast("int")), F.lit(0.0)).alias("overlap"))
    runs = spark.sql("SELECT timestamp'2024-01-01 00:00:00' AS started, false AS active")
    return assess.discovery_decisions(c, runs, F.expr("timestamp'2024-01-02 06:00:00'"))


# --- tests, grids, recall -------------------------------------------------------------------------------------------------


@query()
def centroid_permutation(spark, sf):
    """Are the vectors of labels under 3 elsewhere than the others? 500 replicates."""
    return assess.centroid_permutation(table(spark, sf, "embeddings"), "vec_id", "embedding", F.col("label") < 3)


@query()
def dimension_tests(spark, sf):
    """One p for event types: the omnibus test and the categories' own, combined."""
    e = _events(spark, sf).select("event_type", "ts")
    end = F.broadcast(e.agg(F.max("ts").alias("end")))  # one row
    return drift.dimension_test(e.join(end).select("event_type", (F.col("ts") > F.col("end") - F.expr("interval 3 days")).alias("recent")), "event_type", "recent")


@query("""WITH i AS (SELECT p_partkey AS item, p_brand AS class, p_size % 2 = 0 AS novel, CASE WHEN p_retailprice % 3 < 2 THEN p_type END AS cluster FROM part), z AS (SELECT cluster, count(*) AS size FROM i WHERE cluster IS NOT NULL GROUP BY 1),
c AS (SELECT class, cluster, count(*) AS n, any_value(size) AS size FROM i JOIN z USING (cluster) WHERE novel GROUP BY ALL), b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY class ORDER BY n DESC, cluster) = 1)
SELECT t.class, total, flagged, cluster, coalesce(n, 0)::BIGINT AS found, round(coalesce(n / size, 0), 4) AS purity, coalesce(n / size, 0) >= 0.05 AS recovered FROM (SELECT class, count(*) AS total, count(cluster) AS flagged FROM i WHERE novel GROUP BY 1) t LEFT JOIN b ON t.class = b.class""")
def discovery_evaluation(spark, sf):
    i = table(spark, sf, "part").select(F.col("p_partkey").alias("item"), F.col("p_brand").alias("class"), (F.col("p_size") % 2 == 0).alias("novel"), F.when(F.col("p_retailprice") % 3 < 2, F.col("p_type")).alias("cluster"))
    return assess.discovery_scores(i, 0.05).withColumn("purity", F.round("purity", 4))


@query("""WITH k AS (SELECT l_orderkey AS key, l_returnflag AS label, sum(l_quantity) AS q, count(*) AS c FROM lineitem GROUP BY ALL), p AS (SELECT key, label, q / sum(q) OVER (PARTITION BY key) AS a, c / sum(c) OVER (PARTITION BY key) AS b FROM k), w(weight) AS (VALUES (0.0), (0.35), (0.65), (1.0)),
t AS (SELECT l_orderkey AS key, arg_max(l_returnflag, (l_extendedprice, l_linenumber)) AS label FROM lineitem GROUP BY 1), s AS (SELECT weight, key, label FROM p, w QUALIFY row_number() OVER (PARTITION BY weight, key ORDER BY round(weight * a + (1 - weight) * b, 9) DESC, label) = 1)
SELECT weight::DOUBLE AS weight, round(avg((s.label = t.label)::INT), 4) AS accuracy FROM s JOIN t USING (key) GROUP BY 1""")
def ensemble_grid(spark, sf):
    """Shares of quantity and of lines as two classifiers of an order's return flag; the flag of its dearest line is the truth."""
    from pyspark.sql import Window

    l = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_returnflag").alias("label"), "l_quantity", "l_extendedprice", "l_linenumber")
    k, own = l.groupBy("key", "label").agg(F.sum("l_quantity").alias("q"), F.count("*").alias("c")), Window.partitionBy("key")
    p = k.select("key", "label", (F.col("q") / F.sum("q").over(own)).alias("a"), (F.col("c") / F.sum("c").over(own)).alias("b"))
    truth = l.groupBy("key").agg(F.max_by("label", F.struct("l_extendedprice", "l_linenumber")).alias("label"))
    grid = assess.weight_grid(p.select("key", "label", F.col("a").alias("p")), p.select("key", "label", F.col("b").alias("p")), truth, [0.0, 0.35, 0.65, 1.0])
    return grid.select("weight", r4("accuracy", "accuracy"))


@query(_PAIRS + """, x AS (SELECT query_id AS query, vec_id AS doc FROM t WHERE rank <= 10), f AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s WHERE label < 8)
SELECT x.query, count(*) AS wanted, count(f.vec_id) AS hits, round(count(f.vec_id) / count(*), 4) AS recall FROM x LEFT JOIN f ON x.query = f.query_id AND x.doc = f.vec_id AND f.r <= 10 GROUP BY 1""")
def filtered_recall(spark, sf):
    """How much of the exact first ten a search filtered by label finds."""
    first = lambda where: _dense(spark, sf, 10, where).select(F.col("query_id").alias("query"), F.col("vec_id").alias("doc"))
    e = table(spark, sf, "embeddings").select("vec_id", "embedding", "label")
    from ..functions import vectors as vx

    found = vx.top_k(e.where("label < 8"), e.where("vec_id % 100 = 0"), 10).select(F.col("query_id").alias("query"), F.col("vec_id").alias("doc"))
    return assess.candidate_recall(first("true"), found).withColumn("recall", F.round("recall", 4))


# --- affect, sliding windows ----------------------------------------------------------------------------------------------

_CUES = [[4.0, -2.0, 1.0], [0.5, 3.0, -1.0], [-1.0, 0.0, 2.0]]
_Z = ", ".join(f"{a} * c[1] + {b} * c[2] + {d} * c[3] + {i}" for (a, b, d), i in zip(_CUES, (0.1, 0.0, -0.2), strict=True))


@query(f"""WITH z AS (SELECT vec_id AS key, [{_Z}] AS z FROM (SELECT vec_id, embedding::DOUBLE[] AS c FROM embeddings)), e AS (SELECT key, list_transform(z, lambda x: exp(x - list_max(z))) AS e FROM z), r AS (SELECT key, unnest(['high', 'low', 'mid']) AS label, unnest(e) AS e, list_sum(e) AS total FROM e)
SELECT key, label, round(e / total, 4) AS p FROM r""")
def affect_labels(spark, sf):
    """Given weights over three cues, here the first numbers of each vector."""
    cues = table(spark, sf, "embeddings").select("vec_id", F.slice(F.col("embedding").cast("array<double>"), 1, 3).alias("cues"))
    return classify.combined_affect(cues, "vec_id", _CUES, [0.1, 0.0, -0.2], ["high", "low", "mid"]).select("key", "label", r4("p", "p"))


@query()
def affect_model(spark, sf):
    """Weights of a logistic regression of three classes of labels over whole vectors."""
    rows = table(spark, sf, "embeddings").select(F.col("embedding").alias("cues"), (F.col("label") % 3).alias("label"))
    classes, weights, intercepts = classify.affect_training(rows, "cues", "label")
    return spark.createDataFrame(list(zip(classes, weights, intercepts, strict=True)), "class string, weights array<double>, intercept double")


@query("""WITH w AS (SELECT time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL (6 * i) HOUR AS start, value FROM events, range(4) r(i)) SELECT start, start + INTERVAL 24 HOUR AS "end", count(*) AS n, round(avg(value), 4) AS mean FROM w GROUP BY 1""")
def sliding_windows(spark, sf):
    """A day long, every six hours; the streaming form's own function, over a table."""
    w = streams.sliding(_events(spark, sf).select("ts", "value"), "ts", "24 hours", "6 hours", "1 hour", "value")
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n", r4("mean", "mean"))


_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


@query(f"""WITH r AS (SELECT role AS cluster, false AS known, text FROM conversations UNION ALL SELECT NULL, true, text FROM documents),
w AS (SELECT cluster, known, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), lambda t: length(t) > 2 AND t NOT IN ({_STOP})) AS w FROM r),
t AS (SELECT cluster, known, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w), f AS (SELECT cluster, known, term, count(*) AS tf FROM t GROUP BY ALL), d AS (SELECT term, count(*) AS df FROM f GROUP BY 1),
n AS (SELECT count(*) AS n FROM (SELECT DISTINCT cluster, known FROM r)), k AS (SELECT cluster, term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS weight FROM f JOIN d USING (term), n WHERE NOT known)
SELECT cluster, term, round(weight, 4) AS weight, (row_number() OVER (PARTITION BY cluster ORDER BY round(weight, 9) DESC, term))::INT AS rank FROM k QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY round(weight, 9) DESC, term) <= 8""")
def ctfidf_bigrams(spark, sf):
    """Words and pairs that set roles apart from each other and from the documents, which are the background."""
    docs, known = table(spark, sf, "conversations").select("role", "text"), table(spark, sf, "documents").select("text")
    return clusters.keywords(docs, "role", "text", grams=2, stop=STOP_WORDS, background=known).withColumn("weight", F.round("weight", 4))


@query()
def distinct_keywords(spark, sf):
    """The same weights, without terms that hold one another. Tests have a brute-force version."""
    docs, known = table(spark, sf, "conversations").select("role", "text"), table(spark, sf, "documents").select("text")
    return clusters.distinct_keywords(docs, "role", "text", grams=2, stop=STOP_WORDS, background=known)

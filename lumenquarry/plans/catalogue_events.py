"""Queries over events, orders and other relational tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import clusters, drift, health, metrics, quality, relational
from ..sources.files import table
from .catalogue import query, r4


def _sides(spark, sf):
    e = table(spark, sf, "events")
    now = F.broadcast(e.agg(F.max("ts").alias("now")))  # one row
    return drift.sides(e.join(now), "ts", F.col("now"), "7 days", "28 days")


_SIDES = """WITH n AS (SELECT max(ts) AS now FROM events), s AS (SELECT *, ts > now - INTERVAL 7 DAY AS recent FROM events, n WHERE ts > now - INTERVAL 28 DAY AND ts <= now),
t AS (SELECT event_type AS category, count(*) FILTER (WHERE NOT recent) AS a, count(*) FILTER (WHERE recent) AS b FROM s GROUP BY 1), g AS (SELECT sum(a) AS na, sum(b) AS nb FROM t)"""


@query("SELECT date_trunc('day', ts) AS bucket, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors, round(avg(value), 4) AS mean FROM events GROUP BY 1")
def timeline_day(spark, sf):
    return table(spark, sf, "events").groupBy(F.date_trunc("day", "ts").alias("bucket")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), r4(F.avg("value"), "mean"))


@query("SELECT date_trunc('hour', ts) AS bucket, event_type, count(*) AS n FROM events GROUP BY ALL")
def timeline_hour_mix(spark, sf):
    return table(spark, sf, "events").groupBy(F.date_trunc("hour", "ts").alias("bucket"), "event_type").agg(F.count("*").alias("n"))


@query(_SIDES + ", x AS (SELECT category, (a + 0.5) / sum(a + 0.5) OVER () AS p, (b + 0.5) / sum(b + 0.5) OVER () AS q FROM t) SELECT category, round(p, 4) AS p, round(q, 4) AS q, round((q - p) * ln(q / p), 6) AS part FROM x")
def psi_event_type(spark, sf):
    return drift.psi(drift.counts(_sides(spark, sf), "event_type")).select("category", r4("p", "p"), r4("q", "q"), F.round("part", 6).alias("part"))


@query(_SIDES + """, x AS (SELECT CASE WHEN (a + b) * least(na, nb) / (na + nb) < 5 THEN '(other)' ELSE category END AS c, sum(a) AS a, sum(b) AS b, any_value(na) AS na, any_value(nb) AS nb FROM t, g GROUP BY 1),
e AS (SELECT *, (a + b) * na / (na + nb) AS ea, (a + b) * nb / (na + nb) AS eb FROM x) SELECT round(sum((a - ea) ** 2 / ea + (b - eb) ** 2 / eb), 4) AS statistic, count(*) - 1 AS dof FROM e""")
def chi2_statistic(spark, sf):
    return drift.chi2(drift.counts(_sides(spark, sf), "event_type")).select(r4("statistic", "statistic"), "dof")


_Z = _SIDES + """, x AS (SELECT category, a, b, b / nb - a / na AS delta, (a + b) / (na + nb) AS pool, na, nb FROM t, g), z AS (SELECT category, a, b, delta, delta / sqrt(pool * (1 - pool) * (1 / na + 1 / nb)) AS z FROM x)"""


@query(_Z + " SELECT category, a, b, round(delta, 4) AS delta, round(z, 4) AS z FROM z")
def proportion_z(spark, sf):
    return drift.proportion_z(drift.counts(_sides(spark, sf), "event_type")).select("category", "a", "b", r4("delta", "delta"), r4("z", "z"))


@query(_Z.replace("z AS (SELECT category, a, b, delta,", "y AS (SELECT category, ((b + 0.5) / sum(b + 0.5) OVER () - (a + 0.5) / sum(a + 0.5) OVER ()) * ln(((b + 0.5) / sum(b + 0.5) OVER ()) / ((a + 0.5) / sum(a + 0.5) OVER ())) AS part FROM t), z AS (SELECT category, a, b, delta,")
    + """ SELECT category, a, b, round(delta, 4) AS delta, round(part / sum(part) OVER (), 4) AS psi_share, CASE WHEN a = 0 AND b >= 3 THEN 'new' WHEN b = 0 AND a >= 3 THEN 'vanished' WHEN abs(z) > 2.5758293035489004 AND abs(delta) >= 0.03 THEN CASE WHEN delta > 0 THEN 'up' ELSE 'down' END ELSE 'steady' END AS flag FROM z JOIN y USING (category)""")
def category_changes(spark, sf):
    """Counts here are large enough for z everywhere, which SQL can tell; smaller ones are tested exactly (small_sample_changes)."""
    return drift.changes(drift.counts(_sides(spark, sf), "event_type"), exact_below=0.0).select("category", "a", "b", r4("delta", "delta"), r4("psi_share", "psi_share"), "flag")


@query(_SIDES + ", v AS (SELECT value, count(*) FILTER (WHERE NOT recent) AS a, count(*) FILTER (WHERE recent) AS b FROM s WHERE value IS NOT NULL GROUP BY 1), c AS (SELECT sum(a) OVER w / sum(a) OVER () AS fa, sum(b) OVER w / sum(b) OVER () AS fb FROM v WINDOW w AS (ORDER BY value)) SELECT round(max(abs(fa - fb)), 6) AS d FROM c")
def ks_statistic(spark, sf):
    return drift.ks(_sides(spark, sf), "value").select(F.round("d", 6).alias("d"))


@query(_SIDES + ", x AS (SELECT a / na AS p, b / nb AS q, (a / na + b / nb) / 2 AS m FROM t, g) SELECT round((sum(CASE WHEN p > 0 THEN p * log2(p / m) ELSE 0 END) + sum(CASE WHEN q > 0 THEN q * log2(q / m) ELSE 0 END)) / 2, 6) AS js FROM x")
def js_divergence(spark, sf):
    return drift.jensen_shannon(drift.counts(_sides(spark, sf), "event_type")).select(F.round("js", 6).alias("js"))


@query(_SIDES + " SELECT CASE WHEN recent THEN 'recent' ELSE 'baseline' END AS side, count(value) AS n, round(avg(value), 4) AS mean, round(quantile_cont(value, 0.1), 4) AS p10, round(quantile_cont(value, 0.5), 4) AS median, round(quantile_cont(value, 0.9), 4) AS p90 FROM s GROUP BY 1")
def numeric_summary(spark, sf):
    return drift.numeric_summary(_sides(spark, sf), "value").select("side", "n", *[r4(c, c) for c in ("mean", "p10", "median", "p90")])


@query("""WITH p AS (SELECT event_type AS signal, 1.0 / (1 + count(*) % 1000) AS p FROM events GROUP BY 1), x AS (SELECT *, row_number() OVER (ORDER BY p, signal) AS rank, count(*) OVER () AS m FROM p),
y AS (SELECT *, max((p > 0.01 / (m - rank + 1))::INT) OVER (ORDER BY rank) AS failed FROM x) SELECT signal, rank::INT AS rank, failed = 0 AS survives FROM y""")
def holm_correction(spark, sf):
    ps = table(spark, sf, "events").groupBy(F.col("event_type").alias("signal")).agg((1.0 / (1 + F.count("*") % 1000)).alias("p"))
    return drift.holm(ps).select("signal", "rank", "survives")


@query()
def drift_report(spark, sf):
    return drift.report(_sides(spark, sf), ["event_type"], "value", rates={"error_rate": F.col("event_type") == "error"})


@query("""WITH l AS (SELECT max(ts::DATE) AS last FROM events), x AS (SELECT event_type, date_diff('day', ts::DATE, last) AS age FROM events, l), c AS (SELECT event_type, count(*) FILTER (WHERE age >= 7) AS early, count(*) FILTER (WHERE age < 7) AS late FROM x WHERE age < 14 GROUP BY 1)
SELECT *, CASE WHEN early = 0 THEN 'new' WHEN late >= 1.5 * early THEN 'rising' WHEN late <= 0.5 * early THEN 'fading' ELSE 'steady' END AS pattern FROM c""")
def time_pattern(spark, sf):
    return clusters.time_pattern(table(spark, sf, "events"), "event_type", "ts")


@query("SELECT event_type, count(value) AS n, round(avg(value), 4) AS mean, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.9), 4) AS p90, round(quantile_cont(value, 0.95), 4) AS p95, round(quantile_cont(value, 0.99), 4) AS p99, round(max(value), 4) AS max FROM events GROUP BY 1")
def latency_percentiles(spark, sf):
    m = metrics.latencies(table(spark, sf, "events"), "value", "event_type")
    return m.select("event_type", "n", *[r4(c, c) for c in ("mean", "p50", "p90", "p95", "p99", "max")])


@query("SELECT event_id, round(value / sum(value) OVER (PARTITION BY user_id), 6) AS share FROM events WHERE value > 0")
def share_over_window(spark, sf):
    return table(spark, sf, "events").where("value > 0").select("event_id", F.round(relational.share("value", "user_id"), 6).alias("share"))


@query("SELECT event_id, round(value - lead(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 4) AS gap FROM events")
def lead_gap(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf, "events").select("event_id", r4(F.col("value") - F.lead("value").over(w), "gap"))


@query("SELECT json_extract_string(props, '$.k')::BIGINT AS k, count(*) AS n, round(avg(value), 4) AS mean FROM events GROUP BY 1")
def json_path_rollup(spark, sf):
    return table(spark, sf, "events").groupBy(F.expr("try_cast(get_json_object(props, '$.k') as bigint)").alias("k")).agg(F.count("*").alias("n"), r4(F.avg("value"), "mean"))


@query("SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling_windows(spark, sf):
    t = table(spark, sf, "events").groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return t.select(F.col("w.start").alias("start"), "event_type", "n")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, sid""")
def session_windows(spark, sf):
    t = table(spark, sf, "events").groupBy(F.session_window("ts", "30 minutes").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return t.select("user_id", F.col("w.start").alias("start"), "n")


@query("SELECT a.event_id, (SELECT max(b.value) FROM events b WHERE b.user_id = a.user_id AND b.event_type = 'view' AND b.ts = (SELECT max(c.ts) FROM events c WHERE c.user_id = a.user_id AND c.event_type = 'view' AND c.ts <= a.ts)) AS asof_value FROM events a WHERE a.event_type = 'purchase'")
def asof_join(spark, sf):
    e = table(spark, sf, "events")
    views = e.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return relational.asof(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), views, "user_id", "ts", "value").select("event_id", "asof_value")


@query("SELECT date_trunc('minute', ts) AS start, user_id, count(*) AS n FROM events GROUP BY ALL")
def rate_counter(spark, sf):
    t = table(spark, sf, "events").groupBy(F.window("ts", "60 seconds").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return t.select(F.col("w.start").alias("start"), "user_id", "n")


# --- orders, customers and lines -------------------------------------------------------------------------------------


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_per_key(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return relational.latest_per_key(o, ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey")).drop("o_orderdate")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def never_ordered(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey").join(o, "c_custkey", "left_anti")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def semi_join(spark, sf):
    o = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey").join(o, "c_custkey", "left_semi")


@query("SELECT o_custkey, o_orderkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey))::INT AS rank FROM orders QUALIFY rank <= 3")
def topk_per_group(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return relational.top_per_group(o, ["o_custkey"], 3, F.desc("o_totalprice"), F.col("o_orderkey")).drop("o_totalprice")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' OR (o_orderdate = TIMESTAMP '1998-01-01' AND o_orderkey < 500) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 26")
def keyset_page(spark, sf):
    return relational.keyset_page(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey", ("1998-01-01 00:00:00", 500), 25)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 100")
def offset_page(spark, sf):
    return relational.offset_page(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), 25, 100, F.desc("o_totalprice"), F.col("o_orderkey"))


_DELTA = "WITH d AS (SELECT c_custkey * 2 AS c_custkey, 'new-' || c_custkey AS c_name, c_acctbal + 1 AS c_acctbal FROM customer)"


@query(_DELTA + """ SELECT coalesce(t.c_custkey, d.c_custkey) AS c_custkey, CASE WHEN t.c_custkey IS NOT NULL THEN t.c_name ELSE d.c_name END AS c_name, round(coalesce(d.c_acctbal, t.c_acctbal), 2) AS c_acctbal,
CASE WHEN d.c_custkey IS NULL THEN 'kept' WHEN t.c_custkey IS NULL THEN 'created' ELSE 'updated' END AS op FROM customer t FULL JOIN d ON t.c_custkey = d.c_custkey""")
def merge_upsert(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    delta = c.select((F.col("c_custkey") * 2).alias("c_custkey"), F.concat(F.lit("new-"), F.col("c_custkey").cast("string")).alias("c_name"), (F.col("c_acctbal") + 1).alias("c_acctbal"))
    return relational.upserted(c, delta, "c_custkey", ["c_name"]).withColumn("c_acctbal", F.round("c_acctbal", 2))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000 AND o_custkey IS NOT NULL)")
def delete_by_ids(spark, sf):
    gone = table(spark, sf, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return relational.deleted(table(spark, sf, "customer").select("c_custkey"), gone, "c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = (SELECT min(o_orderpriority) FROM orders))")
def array_anti_join(spark, sf):
    o = table(spark, sf, "orders")
    low = F.broadcast(o.agg(F.min("o_orderpriority").alias("low")))  # one row
    groups = o.join(low).where("o_orderpriority = low").groupBy(F.col("o_orderkey") % 64).agg(F.collect_set("o_custkey").alias("members"))
    return relational.anti_join_members(table(spark, sf, "customer").select("c_custkey"), "c_custkey", groups, "members")


@query("""WITH s AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) SELECT a.l_orderkey AS left_id, b.l_orderkey AS right_id, count(*) AS shared FROM s a JOIN s b ON a.l_suppkey = b.l_suppkey AND a.l_orderkey % 100 = 0 AND a.l_orderkey <> b.l_orderkey GROUP BY ALL HAVING count(*) >= 2""")
def array_overlap_join(spark, sf):
    """Orders divisible by 100, a stated query set, against all orders."""
    s = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("suppliers"))
    return relational.overlapping(s.where("l_orderkey % 100 = 0"), "l_orderkey", s, "l_orderkey", "suppliers").where("left_id <> right_id and shared >= 2")


@query("""WITH s AS (SELECT l_orderkey, list_distinct(list(l_partkey) FILTER (WHERE l_linenumber <= 3)) AS o, list_distinct(list(l_partkey) FILTER (WHERE l_linenumber >= 2)) AS n FROM lineitem GROUP BY 1)
SELECT l_orderkey, len(list_filter(coalesce(n, []), lambda x: NOT list_contains(coalesce(o, []), x)))::INT AS added, len(list_filter(coalesce(o, []), lambda x: NOT list_contains(coalesce(n, []), x)))::INT AS removed FROM s""")
def set_diff_old_new(spark, sf):
    s = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_linenumber") <= 3, F.col("l_partkey"))).alias("o"), F.collect_set(F.when(F.col("l_linenumber") >= 2, F.col("l_partkey"))).alias("n"))
    return s.select("l_orderkey", F.size(F.array_except("n", "o")).alias("added"), F.size(F.array_except("o", "n")).alias("removed"))


_HEALTH = """SELECT 'lines_without_order' AS name, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'orders_without_customer', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'customers_without_nation', count(*) FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation) UNION ALL SELECT 'labels_without_document', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT 'duplicate_texts', count(*) FROM (SELECT md5(text) FROM documents GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'negative_balance', count(*) FROM customer WHERE c_acctbal < 0"""


@query(f"SELECT name, n, CASE WHEN n > 0 THEN 'warn' ELSE 'ok' END AS level FROM ({_HEALTH})")
def health_summary(spark, sf):
    t = {n: table(spark, sf, n) for n in ("lineitem", "orders", "customer", "nation", "labels", "documents")}
    digest = t["documents"].where("text is not null").select(F.md5("text").alias("h"))
    return health.report(
        health.orphans(t["lineitem"], "l_orderkey", t["orders"], "o_orderkey", "lines_without_order"), health.orphans(t["orders"], "o_custkey", t["customer"], "c_custkey", "orders_without_customer"),
        health.orphans(t["customer"], "c_nationkey", t["nation"], "n_nationkey", "customers_without_nation"), health.orphans(t["labels"], "doc_id", t["documents"], "doc_id", "labels_without_document"),
        health.duplicates(digest, "h", "duplicate_texts"), health.violations(t["customer"], F.col("c_acctbal") < 0, "negative_balance"),
    )


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, grouping_id(l_returnflag, l_linestatus)::BIGINT AS level FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def rollup_cube(spark, sf):
    return table(spark, sf, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.grouping_id().alias("level"))


@query("SELECT l_returnflag, l_shipdate, count(*) AS n FROM (SELECT l_returnflag, date_trunc('year', l_shipdate) AS l_shipdate FROM lineitem) GROUP BY GROUPING SETS ((l_returnflag), (l_shipdate), ())")
def grouping_sets(spark, sf):
    t = table(spark, sf, "lineitem").select("l_returnflag", F.date_trunc("year", "l_shipdate").alias("l_shipdate"))
    return t.groupingSets([["l_returnflag"], ["l_shipdate"], []], "l_returnflag", "l_shipdate").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS last_three FROM orders")
def window_frames(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(-2, 0)
    return table(spark, sf, "orders").select("o_orderkey", F.round(F.sum("o_totalprice").over(w), 2).alias("last_three"))


@query()
def approx_distinct(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey").alias("parts"))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 4) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def fact_rollup(spark, sf):
    t = table(spark, sf, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp")).groupBy("l_returnflag", "l_linestatus")
    return t.agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), r4(F.avg("l_discount"), "avg_disc"), F.count("*").alias("n"))


@query("SELECT r_name, count(DISTINCT c_custkey) AS customers, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def star_join(spark, sf):
    t = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return t.groupBy("r_name").agg(F.count_distinct("c_custkey").alias("customers"), F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


# --- feedback quality: labels are ratings, documents requests --------------------------------------------------------

_WILSON = "CASE WHEN n > 0 THEN (b / n + 3.8416 / n / 2 - 1.96 * sqrt(b / n * (1 - b / n) / n + 3.8416 / n / (4 * n))) / (1 + 3.8416 / n) END"
_RATED = "WITH f AS (SELECT lang, source, doc_id, quality FROM labels JOIN documents USING (doc_id))"


def _rated(spark, sf):
    return table(spark, sf, "labels").select("doc_id", "quality", "toxic").join(table(spark, sf, "documents").select("doc_id", "lang", "source"), "doc_id")


@query("SELECT (SELECT count(*) FROM documents) AS requests, count(*) AS feedback, count(DISTINCT doc_id) AS rated, round(count(DISTINCT doc_id) / (SELECT count(*) FROM documents), 4) AS coverage, round(count(*) FILTER (WHERE quality = 1) / count(*), 4) AS helpful_rate FROM labels")
def quality_totals(spark, sf):
    t = quality.totals(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id", F.col("quality") == 1)
    return t.select("requests", "feedback", "rated", r4("coverage", "coverage"), r4("helpful_rate", "helpful_rate"))


_BY = f"{_RATED}, r AS (SELECT source, count(*) AS requests FROM documents GROUP BY 1), g AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE quality = 1) AS helpful, count(*) FILTER (WHERE quality <> 1) AS b FROM f GROUP BY 1), x AS (SELECT source, requests, coalesce(n, 0) AS n, coalesce(helpful, 0) AS helpful, coalesce(b, 0) AS b FROM r LEFT JOIN g USING (source)), w AS (SELECT *, {_WILSON} AS low FROM x)"


@query(_BY + " SELECT source, requests, n AS feedback, helpful, round(low, 4) AS low FROM w")
def quality_by_group(spark, sf):
    g = quality.by_group(table(spark, sf, "documents").select("source"), _rated(spark, sf), "source", F.col("quality") == 1)
    return g.select("source", "requests", "feedback", "helpful", r4("low", "low"))


@query(_BY + " SELECT 'high' AS severity, source AS subject, 'often_unhelpful' AS finding FROM w WHERE n >= 3 AND low >= 0.05 UNION ALL SELECT 'low', source, 'never_rated' FROM w WHERE requests >= 10 AND n = 0")
def quality_findings(spark, sf):
    g = quality.by_group(table(spark, sf, "documents").select("source"), _rated(spark, sf), "source", F.col("quality") == 1)
    return quality.findings(g.withColumn("low", F.col("low") + 0.25), "source")


@query(_RATED + " SELECT source, count(*) AS n, count(*) FILTER (WHERE quality = 0) AS rejected, round(count(*) FILTER (WHERE quality = 0) / count(*), 4) AS share FROM f GROUP BY 1")
def source_scorecard(spark, sf):
    t = quality.source_scorecard(_rated(spark, sf).withColumn("sources", F.array("source", "source")), "sources", F.col("quality") == 0)
    return t.select("source", "n", "rejected", r4("share", "share"))


@query("""WITH m AS (SELECT 'quality' AS path, avg(quality) AS value FROM labels UNION ALL SELECT 'toxic', avg(toxic) FROM labels), c(path, lo, hi) AS (VALUES ('quality', 0.5, 1.0), ('toxic', 0.0, 0.01), ('absent', 0.0, 1.0))
SELECT path, round(value, 4) AS value, CASE WHEN value IS NULL THEN 'missing' WHEN value < lo THEN 'below' WHEN value > hi THEN 'above' ELSE 'ok' END AS status FROM c LEFT JOIN m USING (path)""")
def gate_check(spark, sf):
    m = table(spark, sf, "labels").agg(F.avg("quality").alias("quality"), F.avg("toxic").alias("toxic")).select(F.expr("stack(2, 'quality', quality, 'toxic', toxic) as (path, value)"))
    checks = spark.createDataFrame([("quality", 0.5, 1.0), ("toxic", 0.0, 0.01), ("absent", 0.0, 1.0)], "path string, min double, max double")
    return metrics.gate(m, checks).withColumn("value", F.round("value", 4))


@query("""WITH e AS (SELECT value, event_type = 'purchase' AS t FROM events), th(threshold) AS (VALUES (10.0), (25.0), (50.0), (75.0)) SELECT threshold::DOUBLE AS threshold, round((count(*) FILTER (WHERE value >= threshold AND t) / count(*) FILTER (WHERE t) + count(*) FILTER (WHERE NOT value >= threshold AND NOT t) / count(*) FILTER (WHERE NOT t)) / 2, 4) AS balanced_accuracy FROM e, th GROUP BY 1""")
def param_grid_sweep(spark, sf):
    return metrics.grid(table(spark, sf, "events"), [10.0, 25.0, 50.0, 75.0], "value", F.col("event_type") == "purchase").withColumn("balanced_accuracy", F.round("balanced_accuracy", 4))


@query()
def bootstrap_ci(spark, sf):
    return metrics.bootstrap(table(spark, sf, "labels"), "doc_id", "quality")


@query("""SELECT bucket, json_group_object(event_type, n)::VARCHAR AS mix, sum(n)::BIGINT AS n FROM (SELECT date_trunc('hour', ts) AS bucket, event_type, count(*) AS n FROM events GROUP BY ALL ORDER BY event_type) GROUP BY 1""")
def timeline_hour_map(spark, sf):
    """For each hour a map from event type to its count, as JSON in the order of types."""
    t = table(spark, sf, "events").groupBy(F.date_trunc("hour", "ts").alias("bucket"), "event_type").agg(F.count("*").alias("n"))
    m = t.groupBy("bucket").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "n")))).alias("mix"), F.sum("n").alias("n"))
    return m.select("bucket", F.to_json("mix").alias("mix"), "n")


@query("SELECT o_orderkey, o_totalprice::DOUBLE AS price, count(*) OVER () AS total FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def page_with_total(spark, sf):
    """The third page of twenty, each row beside the number of all rows."""
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("price"))
    return relational.page_with_total(o, 20, 40, F.desc("price"), F.asc("o_orderkey"))

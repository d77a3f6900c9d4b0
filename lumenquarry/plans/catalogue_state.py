"""Queries of merges by bucket, rules of alerts, support scores and collapsed evidence, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import review
from ..sources import ingest
from ..sources.files import scratch, table
from ..sources.merge import MergeTable
from .catalogue import query

_CUSTOMER = "c_custkey bigint, c_name string, c_acctbal double"


def _customers(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").cast("bigint").alias("c_custkey"), "c_name", F.col("c_acctbal").cast("double").alias("c_acctbal"))


def _merged(spark, sf, **options):
    """Two thirds of the customers, then a batch of the even ones with new balances, which comes twice."""
    t = MergeTable(spark, scratch(spark, "customers"), "c_custkey", _CUSTOMER, buckets=8)
    c = _customers(spark, sf)
    t.merge(c.where("c_custkey % 3 > 0"), [F.asc("c_name")], 0, "load")
    batch = c.where("c_custkey % 2 = 0").withColumn("c_acctbal", F.when(F.col("c_custkey") % 4 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    first = t.merge(batch, [F.asc("c_name")], 1, "load", **options)
    return t, first, t.merge(batch, [F.asc("c_name")], 1, "load", **options)


@query("""SELECT count(*) FILTER (WHERE c_custkey % 3 = 0)::BIGINT AS created, count(*) FILTER (WHERE c_custkey % 3 > 0 AND c_custkey % 4 = 0)::BIGINT AS updated, 0::BIGINT AS again FROM customer WHERE c_custkey % 2 = 0""")
def merge_counts(spark, sf):
    """What a batch created and updated, and that it does nothing when it comes again."""
    _, first, again = _merged(spark, sf)
    return spark.createDataFrame([(first["created"], first["updated"], again["created"] + again["updated"] + again["buckets"])], "created bigint, updated bigint, again bigint")


@query("SELECT c_custkey::BIGINT AS c_custkey, c_name, c_acctbal::DOUBLE + CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE 0 END AS c_acctbal FROM customer WHERE c_custkey % 3 > 0 OR c_custkey % 2 = 0")
def merged_rows(spark, sf):
    return _merged(spark, sf)[0].read()


@query("SELECT c_custkey::BIGINT AS c_custkey, c_acctbal::DOUBLE + CASE WHEN c_custkey % 4 = 0 AND (c_custkey % 3 = 0 OR c_acctbal < 0) THEN 1 ELSE 0 END AS c_acctbal FROM customer WHERE c_custkey % 3 > 0 OR c_custkey % 2 = 0")
def conditional_update(spark, sf):
    """Rows that exist are updated only where the old balance is negative."""
    return _merged(spark, sf, when=F.col("old.c_acctbal") < 0)[0].read().select("c_custkey", "c_acctbal")


_RULES = [("many_errors", "error", ">", 0.18, 2), ("few_views", "view", "<", 0.2, 3), ("any_purchase", "purchase", ">", 0.25, 1)]
_SHARES = "WITH e AS (SELECT ts::DATE AS d, event_type AS metric, count(*) AS n FROM events GROUP BY ALL), s AS (SELECT metric, d, n / sum(n) OVER (PARTITION BY d) AS value FROM e)"


@query(_SHARES + f""", r(rule, metric, op, threshold, periods) AS (VALUES {", ".join(str(x) for x in _RULES)}),
o AS (SELECT rule, d, value, periods, CASE op WHEN '>' THEN value > threshold ELSE value < threshold END AS over, row_number() OVER (PARTITION BY rule ORDER BY d) AS i FROM s JOIN r USING (metric)),
g AS (SELECT *, i - max(CASE WHEN NOT over THEN i ELSE 0 END) OVER (PARTITION BY rule ORDER BY d) AS run FROM o)
SELECT rule, d AS "at", round(value, 4) AS value, run::BIGINT AS run FROM g WHERE over AND run >= periods""")
def alert_rules(spark, sf):
    """A table of rules over shares of event types by day."""
    e = table(spark, sf, "events").groupBy(F.to_date("ts").alias("at"), F.col("event_type").alias("metric")).agg(F.count("*").alias("n"))
    day = e.groupBy("at").agg(F.sum("n").alias("all"))
    series = e.join(day, "at").select("metric", "at", (F.col("n") / F.col("all")).alias("value"))
    rules = spark.createDataFrame(_RULES, "rule string, metric string, op string, threshold double, periods int")
    return review.fired(series, rules).select("rule", "at", F.round("value", 4).alias("value"), "run")


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, max(l_quantity::DOUBLE / 50) AS s FROM lineitem GROUP BY ALL)
SELECT l_orderkey, round(list_sum(list(s ORDER BY l_linenumber)), 4) AS total, round(max(s), 4) AS best, count(*) AS cited FROM b GROUP BY 1""")
def support_scores(spark, sf):
    """A map from each cited source to its score; repeated citations count as their best."""
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity").cast("double") / 50).alias("score"))
    values = F.map_values("support")
    s = review.support_map(rows, "l_orderkey", "l_linenumber", "score")
    return s.select("l_orderkey", F.round(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), 4).alias("total"), F.round(F.array_max(values), 4).alias("best"), F.size("support").cast("bigint").alias("cited"))


@query("""WITH d AS (SELECT lang, doc_id, trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')) AS t FROM documents)
SELECT lang, min(doc_id) AS doc_id, count(*) AS alike FROM d GROUP BY lang, t""")
def collapsed_evidence(spark, sf):
    """Of evidence that reads alike one piece stays, that of the least id, with how many it stands for."""
    d = table(spark, sf, "documents").select("lang", "doc_id", "text")
    return review.collapsed(d, ["lang"], "text", "doc_id").select("lang", "doc_id", "alike")


@query("""WITH c AS (SELECT c_custkey, c_mktsegment AS seg, c_name AS name, c_acctbal::DOUBLE AS bal, CASE WHEN c_custkey % 7 = 0 THEN 'x' ELSE '' END || substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-' || substr(m, 13, 4) || '-' || substr(m, 17, 4) || '-' || substr(m, 21) AS id FROM (SELECT *, md5(c_custkey::VARCHAR) AS m FROM customer))
SELECT c_custkey, concat_ws(',', CASE WHEN seg NOT IN ('BUILDING', 'MACHINERY') THEN 'segment' END, CASE WHEN NOT regexp_full_match(name, '[A-Za-z]+#[0-9]*[02468]') THEN 'name' END, CASE WHEN NOT regexp_full_match(id, '[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}') THEN 'id' END,
  CASE WHEN length(seg) NOT BETWEEN 1 AND 9 THEN 'length' END, CASE WHEN bal NOT BETWEEN 0 AND 5000 THEN 'balance' END) AS errors FROM c""")
def row_validation(spark, sf):
    """Customers by five checks: a set of values, a pattern, ids, lengths and a range."""
    m = F.md5(F.col("c_custkey").cast("string"))
    whole = F.concat(F.when(F.col("c_custkey") % 7 == 0, "x").otherwise(""), *[x for i, (a, n) in enumerate([(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]) for x in ([F.lit("-")] if i else []) + [F.substring(m, a, n)]])
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_name", F.col("c_acctbal").cast("double").alias("c_acctbal"), whole.alias("id"))
    checks = {
        "segment": ingest.not_one_of("c_mktsegment", ["BUILDING", "MACHINERY"]), "name": ingest.not_like("c_name", "[A-Za-z]+#[0-9]*[02468]"), "id": ingest.not_uuid("id"),
        "length": ingest.length_outside("c_mktsegment", 1, 9), "balance": ingest.out_of_range("c_acctbal", 0, 5000),
    }
    return ingest.with_errors(c, checks).select("c_custkey", F.array_join("errors", ",").alias("errors"))


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority NOT IN (SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderpriority < '3')")
def unknown_label_rows(spark, sf):
    """Orders whose priority isn't in a taxonomy of the first two."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return ingest.unknown_labels(o, "o_orderpriority", o.where("o_orderpriority < '3'").select(F.col("o_orderpriority").alias("label_id")), "label_id").select("o_orderkey", "o_orderpriority")

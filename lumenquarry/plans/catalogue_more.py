"""Further queries: counts, lists, validation, calendars, patterns and policies."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import clusters, grounding, quality, relational, review
from ..sources.files import table
from ..sources.ingest import validated
from .catalogue import query, r4


@query("SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM benchmark) AS items, (SELECT count(*) FROM labels WHERE quality = 1) AS helpful, (SELECT count(*) FROM embeddings) AS vectors, (SELECT count(DISTINCT lang) FROM documents) AS languages")
def corpus_counts(spark, sf):
    one = lambda name, c, alias: table(spark, sf, name).agg(c.alias(alias))
    n = F.count("*")
    parts = [one("documents", n, "documents"), one("benchmark", n, "items"), one("labels", F.count_if(F.col("quality") == 1), "helpful"), one("embeddings", n, "vectors"), one("documents", F.count_distinct("lang"), "languages")]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p)  # one row each
    return out


@query("SELECT n_name, (row_number() OVER (ORDER BY CASE WHEN n_regionkey = 0 THEN NULL ELSE n_regionkey END NULLS LAST, n_name))::INT AS place FROM nation")
def labels_in_order(spark, sf):
    """A taxonomy's labels by rank, those without one last."""
    rank = F.when(F.col("n_regionkey") != 0, F.col("n_regionkey"))
    return table(spark, sf, "nation").select("n_name", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(rank.asc_nulls_last(), "n_name")).alias("place"))


@query("SELECT n_regionkey, array_to_string(list_sort(list_distinct(list_concat(list(n_name), ['NEW', 'ALGERIA'])))[1:5], ',') AS names FROM nation GROUP BY 1")
def extended_labels(spark, sf):
    t = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.collect_list("n_name").alias("a"))
    return t.select("n_regionkey", F.array_join(F.slice(F.array_sort(F.array_union("a", F.array(F.lit("NEW"), F.lit("ALGERIA")))), 1, 5), ",").alias("names"))


@query("SELECT o_orderkey, string_agg(l_linenumber || ':' || l_returnflag, ',' ORDER BY l_linenumber, l_returnflag) AS lines FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey IN (1, 2, 3, 4, 5, 32, 33) GROUP BY 1")
def case_detail(spark, sf):
    """A point lookup with its nested, ordered children."""
    ids = [1, 2, 3, 4, 5, 32, 33]
    t = table(spark, sf, "orders").where(F.col("o_orderkey").isin(ids)).select("o_orderkey").join(table(spark, sf, "lineitem").where(F.col("l_orderkey").isin(ids)), F.col("o_orderkey") == F.col("l_orderkey"))
    nested = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_returnflag")))
    return t.groupBy("o_orderkey").agg(F.array_join(F.transform(nested, lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["l_returnflag"])), ",").alias("lines"))


@query("SELECT doc_id, CASE WHEN EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 1) THEN 'helpful' WHEN EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) THEN 'not_helpful' ELSE 'none' END AS rated FROM documents d")
def rated_filter(spark, sf):
    best = table(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"))
    t = table(spark, sf, "documents").select("doc_id").join(best.withColumn("here", F.lit(1)), "doc_id", "left")
    return t.select("doc_id", F.when(F.col("q") == 1, "helpful").when(F.col("here") == 1, "not_helpful").otherwise("none").alias("rated"))


@query(r"WITH f AS (SELECT doc_id, trim(regexp_replace(text, '[ \t\n\r]+', ' ', 'g')) AS t FROM documents) SELECT doc_id, CASE WHEN length(t) <= 180 THEN t ELSE rtrim(left(t, 179)) || '…' END AS excerpt FROM f")
def excerpts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.excerpt(F.col("text")).alias("excerpt"))


@query("SELECT CASE WHEN trim(coalesce(text, '')) = '' THEN 'blank_text' WHEN length(text) > 5000 THEN 'text_too_long' ELSE 'good' END AS verdict, count(*) AS n FROM documents GROUP BY 1")
def validation_split(spark, sf):
    t = validated(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text", 5000)
    return t.groupBy(F.coalesce(F.get("errors", F.lit(0)), F.lit("good")).alias("verdict")).agg(F.count("*").alias("n"))


@query("SELECT o_custkey, o_orderkey FROM orders WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders)")
def latest_version(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    last = F.broadcast(o.agg(F.max("o_orderdate").alias("last")))  # one row
    return o.join(last, F.col("o_orderdate") == F.col("last")).select("o_custkey", "o_orderkey")


@query("WITH c AS (SELECT DISTINCT (json_extract_string(props, '$.k'))::BIGINT * 7 AS id FROM events) SELECT count(*) AS dangling FROM c WHERE id IS NOT NULL AND id NOT IN (SELECT p_partkey FROM part) AND id NOT IN (SELECT s_suppkey FROM supplier)")
def dangling_references(spark, sf):
    ids = table(spark, sf, "events").select((F.expr("try_cast(get_json_object(props, '$.k') as bigint)") * 7).alias("id")).where("id is not null").distinct()
    left = ids.join(table(spark, sf, "part").select(F.col("p_partkey").alias("id")), "id", "left_anti").join(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id")), "id", "left_anti")
    return left.agg(F.count("*").alias("dangling"))


@query("WITH q AS (SELECT unnest([30, 10, 20]) AS id, generate_subscripts([30, 10, 20], 1) AS place) SELECT place::INT - 1 AS place, c_name FROM q JOIN customer ON c_custkey = id")
def lookup_in_order(spark, sf):
    ids = spark.range(1).select(F.posexplode(F.array(F.lit(30), F.lit(10), F.lit(20))).alias("place", "id"))
    return ids.join(table(spark, sf, "customer"), F.col("c_custkey") == F.col("id")).select("place", "c_name")


@query("SELECT source, CASE WHEN count(*) >= 5 THEN round(count(*) FILTER (WHERE quality = 0) / count(*), 4) END AS rate FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def negative_rate(spark, sf):
    t = table(spark, sf, "labels").select("doc_id", "quality").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    return t.groupBy("source").agg(F.when(F.count("*") >= 5, F.round(F.count_if(F.col("quality") == 0) / F.count("*"), 4)).alias("rate"))


@query("SELECT split_part(o_orderpriority, '-', 1) AS reason, count(*) AS n, (row_number() OVER (ORDER BY count(*) DESC, split_part(o_orderpriority, '-', 1)))::INT AS place FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def reason_counts(spark, sf):
    t = table(spark, sf, "orders").where("o_orderstatus = 'F'").groupBy(F.split_part("o_orderpriority", F.lit("-"), F.lit(1)).alias("reason")).agg(F.count("*").alias("n"))
    return t.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("n"), "reason")))


@query("SELECT 'discounted' AS pattern, count(*) FILTER (WHERE l_discount > 0.05) AS n FROM lineitem UNION ALL SELECT 'returned', count(*) FILTER (WHERE l_returnflag = 'R') FROM lineitem UNION ALL SELECT 'large', count(*) FILTER (WHERE l_quantity >= 45) FROM lineitem")
def failure_patterns(spark, sf):
    t = table(spark, sf, "lineitem").agg(F.count_if(F.col("l_discount") > 0.05).alias("a"), F.count_if(F.col("l_returnflag") == "R").alias("b"), F.count_if(F.col("l_quantity") >= 45).alias("c"))
    return t.select(F.expr("stack(3, 'discounted', a, 'returned', b, 'large', c) as (pattern, n)"))


@query("WITH c AS (SELECT date_trunc('day', ts) AS bucket, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT bucket, event_type AS top, n FROM c QUALIFY row_number() OVER (PARTITION BY bucket ORDER BY n DESC, event_type) = 1")
def top_per_bucket(spark, sf):
    c = table(spark, sf, "events").groupBy(F.date_trunc("day", "ts").alias("bucket"), "event_type").agg(F.count("*").alias("n"))
    return relational.latest_per_key(c, ["bucket"], F.desc("n"), F.col("event_type")).select("bucket", F.col("event_type").alias("top"), "n")


@query("WITH c AS (SELECT event_type, sum(value) AS total FROM events GROUP BY 1) SELECT event_type, rank() OVER (ORDER BY floor(total / 1e9) DESC)::INT AS place FROM c")
def best_with_ties(spark, sf):
    c = table(spark, sf, "events").groupBy("event_type").agg(F.sum("value").alias("total"))
    return c.select("event_type", F.rank().over(Window.partitionBy(F.lit(1)).orderBy(F.desc(F.floor(F.col("total") / 1e9)))).alias("place"))


@query("WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents) SELECT doc_id FROM d WHERE i IN (SELECT floor(j * n / 50.0)::BIGINT FROM range(50) r(j), (SELECT any_value(n) AS n FROM d))")
def even_sample(spark, sf):
    """Fifty rows at even distances by key, a sampling operator; numbers come from ranges, so that no task sorts all rows."""
    return relational.evenly(table(spark, sf, "documents").select("doc_id"), 50, "doc_id").select("doc_id")


@query("WITH c AS (SELECT unnest(generate_series((SELECT max(ts)::DATE FROM events) - INTERVAL 13 DAY, (SELECT max(ts)::DATE FROM events), INTERVAL 1 DAY))::DATE AS day), k AS (SELECT DISTINCT event_type FROM events), e AS (SELECT event_type, ts::DATE AS day, count(*) AS n FROM events WHERE value > 90 GROUP BY ALL) SELECT k.event_type, c.day, coalesce(n, 0) AS n FROM k CROSS JOIN c LEFT JOIN e ON e.event_type = k.event_type AND e.day = c.day")
def calendar_counts(spark, sf):
    e = table(spark, sf, "events")
    last = F.broadcast(e.agg(F.max(F.to_date("ts")).alias("last")))  # one row
    days = e.select("event_type").distinct().join(last).select("event_type", F.explode(F.sequence(F.date_sub("last", 13), F.col("last"))).alias("day"))
    n = e.where("value > 90").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return days.join(n, ["event_type", "day"], "left").select("event_type", "day", F.coalesce("n", F.lit(0)).alias("n"))


def _injection_sql():
    from .catalogue_review import _HOSTILE

    clean = f"regexp_replace({_HOSTILE}, '{review.INVISIBLE}', '', 'g')"
    return f"SELECT conv_id, turn, regexp_matches({clean}, '{review.INJECTION}') OR regexp_matches({clean}, '{review.EVIDENCE_INJECTION}') AS flagged FROM conversations"


@query(_injection_sql())
def injection_flags(spark, sf):
    """Turns, some with hostile sentences added, by both nets."""
    from .catalogue_review import _added

    return table(spark, sf, "conversations").select("conv_id", "turn", review.looks_hostile(_added()).alias("flagged"))


@query("SELECT c_custkey, to_base64(encode('{\"id\":' || c_custkey || '}')) AS token FROM customer")
def cursor_tokens(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.base64(F.to_json(F.struct(F.col("c_custkey").alias("id"))).cast("binary")).alias("token"))


@query("SELECT label, sha1(array_to_string(list_sort(list(vec_id::VARCHAR)), '|')) AS id, count(*) AS size FROM embeddings GROUP BY 1 HAVING count(*) >= 3")
def recurring_ids(spark, sf):
    found = clusters.recurring(table(spark, sf, "embeddings").withColumn("cluster", F.col("label")), "vec_id", "cluster", "label")
    return found.select(F.col("top").alias("label"), "id", "size")


@query("SELECT toxic, round(avg(quality), 4) AS mean, count(*) AS n, round((count(*) FILTER (WHERE quality = 1) / count(*) + 3.8416 / count(*) / 2 + 1.96 * sqrt(avg(quality) * (1 - avg(quality)) / count(*) + 3.8416 / count(*) / (4 * count(*)))) / (1 + 3.8416 / count(*)), 4) AS high FROM labels GROUP BY 1")
def wilson_interval(spark, sf):
    n, k = F.count("*"), F.count_if(F.col("quality") == 1)
    return table(spark, sf, "labels").groupBy("toxic").agg(r4(F.avg("quality"), "mean"), n.alias("n"), r4(quality.wilson_high(k, n), "high"))


@query("SELECT event_type, avg(CASE WHEN user_id % 2 = 0 THEN value END) IS NOT NULL AS known, round(avg(CASE WHEN user_id % 2 = 0 THEN value END) - avg(CASE WHEN user_id % 2 = 1 THEN value END), 4) AS gap FROM events GROUP BY 1")
def calibration_gap(spark, sf):
    even = F.avg(F.when(F.col("user_id") % 2 == 0, F.col("value")))
    return table(spark, sf, "events").groupBy("event_type").agg(even.isNotNull().alias("known"), r4(even - F.avg(F.when(F.col("user_id") % 2 == 1, F.col("value"))), "gap"))


@query("SELECT count(*) AS leaks FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 1)")
def stale_leaks(spark, sf):
    gone = table(spark, sf, "part").where("p_size = 1").select(F.col("p_partkey").alias("l_partkey"))
    return table(spark, sf, "lineitem").select("l_partkey").join(gone, "l_partkey", "left_semi").agg(F.count("*").alias("leaks"))


@query("SELECT source, round(count(*) FILTER (WHERE lang = 'en') / count(*), 4) AS en, round(count(*) FILTER (WHERE lang = 'de') / count(*), 4) AS de, round(greatest(count(*) FILTER (WHERE lang = 'en') - count(*) FILTER (WHERE lang = 'de'), 0) / count(*), 4) AS fall FROM documents GROUP BY 1")
def stage_shares(spark, sf):
    en, de, n = F.count_if(F.col("lang") == "en"), F.count_if(F.col("lang") == "de"), F.count("*")
    return table(spark, sf, "documents").groupBy("source").agg(r4(en / n, "en"), r4(de / n, "de"), r4(F.greatest(en - de, F.lit(0)) / n, "fall"))


@query("""WITH x AS (SELECT doc_id, (doc_id % 10) / 10.0 AS c, (doc_id % 7) / 7.0 AS r, doc_id % 7 >= 4 AS v, doc_id % 10 >= 3 AS s, doc_id % 3 > 0 AS g FROM documents)
SELECT doc_id, CASE WHEN NOT s THEN 'abstained' WHEN NOT v THEN 'unreliable' WHEN NOT g THEN 'degraded' ELSE 'resolved' END AS status, round(CASE WHEN NOT s THEN least(c, 0.54) WHEN NOT v THEN least(0.4, c * 0.5) ELSE c * (0.5 + 0.5 * r) END, 4) AS confidence FROM x""")
def answer_policy(spark, sf):
    i = F.col("doc_id")
    status, value = grounding.policy(i % 10 / 10.0, i % 7 / 7.0, i % 7 >= 4, i % 10 >= 3, i % 3 > 0)
    return table(spark, sf, "documents").select("doc_id", status.alias("status"), r4(value, "confidence"))


@query("SELECT o_orderstatus AS status, count(*) AS depth, max(o_orderdate) AS newest, count(*) FILTER (WHERE o_orderpriority LIKE '1%') AS urgent FROM orders GROUP BY 1")
def queue_depth(spark, sf):
    return table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("depth"), F.max("o_orderdate").alias("newest"), F.count_if(F.col("o_orderpriority").startswith("1")).alias("urgent"))


@query("SELECT d.doc_id, d.n_chars, l.quality IS NOT NULL AS in_labels FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) l USING (doc_id)")
def presence_flag(spark, sf):
    l = table(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"))
    return table(spark, sf, "documents").select("doc_id", "n_chars").join(l, "doc_id", "left").select("doc_id", "n_chars", F.col("q").isNotNull().alias("in_labels"))


@query("SELECT quality AS truth, (toxic = 0)::INT AS predicted, count(*) AS n FROM labels GROUP BY ALL")
def label_confusion(spark, sf):
    return table(spark, sf, "labels").groupBy(F.col("quality").alias("truth"), F.when(F.col("toxic") == 0, 1).otherwise(0).alias("predicted")).agg(F.count("*").alias("n"))

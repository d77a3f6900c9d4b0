"""The queries of this subpackage, each a thin call of its operator over whole tables, and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, html_text, quality_classifier, quality_rules, repair, secrets, sharding, warc
from .centroids import clustered
from .common import table
from .decontamination import contamination
from .near_duplicates import near_duplicates
from .packing import pack, pieces
from .set_join import jaccard_join


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """The place of a public tokenizer's file; LUMENQUARRY_TOKENIZERS names another folder."""
    if folder := os.environ.get("LUMENQUARRY_TOKENIZERS"):
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.drop("text")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path()))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op6_near_duplicates": op6_near_duplicates,
    "op7_decontamination": op7_decontamination,
    "op9_packing": op9_packing,
}

#: DuckDB SQL for the queries that SQL can express on whole tables.
ORACLES: dict[str, str] = {}


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    found = quality_rules.judged(docs, quality_rules.references(docs))
    return found.select("doc_id", "quality.*").drop("text")


QUERIES["op3_quality_rules"] = op3_quality_rules


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    found = secrets.scanned(docs, secrets.train(secrets.sample(spark, secrets.ordinary_words(docs))))
    base, spans = found["secrets"]["base"], found["secrets"]["spans"]
    counts = [F.size(F.filter(base, lambda x, k=k: x["k"] == k)).cast("bigint").alias(f"n_{name}") for k, name in enumerate(secrets.KINDS[:3])]
    return found.select("doc_id", *counts, F.sha2(secrets.listed(base), 256).alias("base_sha256"), secrets.listed(spans).alias("spans"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.sharded(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES["op1_secret_scans"] = op1_secret_scans
QUERIES["op2_sharding"] = op2_sharding


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    said = F.lit(f"{chat.END}{chat.START}assistant ok").alias("text")
    extra = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said)
    return chat.summary(chat.rendered(chat.folded(chat.events_of_turns(turns.unionByName(extra)), rewinds=False)))


QUERIES["op4_html_extraction"] = op4_html_extraction
QUERIES["op5_warc"] = op5_warc
QUERIES["op10_chat_formatting"] = op10_chat_formatting


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = quality_classifier.fitted(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1
    found = quality_classifier.scored(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


QUERIES["op8_quality_classifier"] = op8_quality_classifier


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


QUERIES["op11_centroid_clustering"] = op11_centroid_clustering


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return repair.repaired_all(turns, repair.damaged(turns))


QUERIES["op12_conversation_repair"] = op12_conversation_repair


def op13_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "n_shingles", "component_id")


QUERIES["op13_ngram_jaccard_join"] = op13_ngram_jaccard_join


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = pipeline


ORACLES["op5_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n FROM pages), g AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS holder FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN n >= 1000 AND page_id <> holder THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> holder THEN holder END AS refers_to FROM g"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES["op7_decontamination"] = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
i AS (SELECT item_id, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, list_slice(w, k, k + n - 1) AS g FROM i, unnest(range(1, len(w) - n + 2)) t(k)),
s AS (SELECT doc_id, w, n FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n),
dw AS (SELECT doc_id, n, k, list_slice(w, k, k + n - 1) AS g FROM s, unnest(range(1, len(w) - n + 2)) t(k)),
h AS (SELECT doc_id, item_id, k, n FROM dw JOIN bw USING (n, g)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM h, unnest(range(k, k + n)) t(p) GROUP BY 1),
j AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN j USING (doc_id)"""

ORACLES["op10_chat_formatting"] = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e AS (SELECT *, length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) + length(role) + 24 AS n FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(n)::BIGINT AS formatted_chars FROM e GROUP BY 1"""


def _clustered_sql(clusters: int = 8, rounds: int = 10) -> str:
    """Lloyd's rounds one after another; list positions stand for components."""
    distance = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: ((p[1] - p[2]) * (p[1] - p[2]))::HUGEINT))"
    nearest = f"SELECT v.r, v.id, v.x, min(struct_pack(d := {distance}, j := c.j)) AS m FROM v, c{{i}} c GROUP BY 1, 2, 3"
    floor = "(sum(x[k]) - ((sum(x[k]) % count(*)) + count(*)) % count(*)) // count(*)"
    parts = [
        """v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id AS id, list_transform(embedding, lambda e: floor(1024 * e::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS j, x FROM (SELECT sha256('3:' || coalesce(id::VARCHAR, '')) AS h, x FROM v ORDER BY h, x LIMIT {clusters}))",
    ]
    for i in range(rounds):
        means = f"SELECT j, list(q ORDER BY k) AS x FROM (SELECT m.j AS j, k, {floor} AS q FROM n, unnest(range(1, 65)) t(k) GROUP BY 1, 2) GROUP BY 1"
        parts.append(f"c{i + 1} AS MATERIALIZED (WITH n AS ({nearest.format(i=i)}), w AS ({means}) SELECT c.j, coalesce(w.x::BIGINT[], c.x) AS x FROM c{i} c LEFT JOIN w ON w.j = c.j)")
    return f"""WITH {", ".join(parts)}, a AS (SELECT id, m.j AS j, m.d AS d FROM ({nearest.format(i=rounds)})), t AS (SELECT j, sum(d) AS s FROM a GROUP BY 1)
SELECT a.id AS vec_id, a.j::INT AS cluster, a.d::BIGINT AS distance, t.s::BIGINT AS cluster_inertia, (SELECT sum(s) FROM t)::BIGINT AS inertia,
  sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM a JOIN t USING (j) JOIN c{rounds} c ON c.j = a.j"""


ORACLES["op11_centroid_clustering"] = _clustered_sql()


def _repair_sql() -> str:
    """The program's layers as a recursive query over distinct signatures; CRC-32 from its table of 256 remainders."""
    step = ", ".join(f"('{x}', '{e}', {q}, {to}, {c})" for x in ("d", *"suaxSUAX") for q, e, to, c in repair.steps(x))
    inserted = ", ".join(str(x) for x in repair._inserted())
    key = "coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"
    one = "CASE WHEN {0} & 1 = 1 THEN xor({0} >> 1, 3988292384) ELSE {0} >> 1 END"
    table = "range(256)"
    for _ in range(8):
        table = f"list_transform({table}, lambda v: {one.format('v')})"
    return f"""WITH RECURSIVE k AS (SELECT {table} AS tab),
t AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  xor(list_reduce(list_transform(string_split({key}, ''), lambda ch: ord(ch)::BIGINT), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 20 AS f FROM conversations, k),
d AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE WHEN f = 1 THEN '' WHEN f = 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM t, unnest(range(CASE WHEN f = 3 THEN 2 ELSE 1 END)) WHERE f <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, substr(role, 1, 1) AS c, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS body FROM d),
g AS (SELECT *, body = '' AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, right(body, 1) NOT IN ('.', '!', '?') AS cut,
  lag(c) OVER (PARTITION BY conv_id ORDER BY i) || c AS two FROM o),
s AS (SELECT *, CASE WHEN blank OR again THEN 'd' ELSE (CASE WHEN c IN ('s', 'u', 'a') THEN CASE WHEN cut THEN upper(c) ELSE c END WHEN cut THEN 'X' ELSE 'x' END) END AS symbol FROM g),
m AS (SELECT conv_id, string_agg(symbol, '' ORDER BY i) AS sig, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank,
  count(*) FILTER (WHERE NOT blank AND again) AS duplicate, count(*) FILTER (WHERE NOT blank AND NOT again AND cut) AS truncated, count(*) FILTER (WHERE two NOT IN ('su', 'ua', 'au')) AS illegal FROM s GROUP BY 1),
cl(q, k, via) AS (VALUES {inserted}), st(symbol, edit, q, goal, cost) AS (VALUES {step}),
dp AS (SELECT sig, 0 AS i, 0 AS q, 0 AS cost, '' AS audit FROM (SELECT DISTINCT sig FROM m)
  UNION ALL SELECT sig, i + 1, goal, best.cost, best.audit FROM (
    SELECT sig, i, goal, min(struct_pack(cost := dp.cost + 2 * cl.k + st.cost, audit := dp.audit || repeat('I', cl.k) || st.edit)) AS best
    FROM dp JOIN cl ON cl.q = dp.q JOIN st ON st.symbol = substr(sig, i + 1, 1) AND st.q = cl.via WHERE i < length(sig) GROUP BY 1, 2, 3)),
a AS (SELECT sig, min(struct_pack(cost := cost + 2 * k, audit := audit || repeat('I', k))) AS best FROM dp JOIN cl USING (q) WHERE i = length(sig) AND via IN (0, 3) GROUP BY 1),
e AS (SELECT conv_id, p, substr(best.audit, p, 1) AS edit, length(replace(substr(best.audit, 1, p), 'I', '')) AS i, length(replace(substr(best.audit, 1, p), 'D', '')) AS n
  FROM m JOIN a USING (sig), unnest(range(1, length(best.audit) + 1)) x(p)),
r AS (SELECT e.conv_id, p, edit, n, o.role, CASE WHEN edit = 'I' THEN '' ELSE o.text END AS text,
  max(CASE WHEN edit = 'K' AND n = 1 AND o.c = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e.conv_id) AS lead FROM e LEFT JOIN o ON o.conv_id IS NOT DISTINCT FROM e.conv_id AND o.i = e.i WHERE edit <> 'D'),
h AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (n - lead) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY p) AS whole FROM r GROUP BY 1)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN m ON m.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN a USING (sig) LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM c.conv_id"""


ORACLES["op12_conversation_repair"] = _repair_sql()


def _linked_sql(percent: int, more: str = "") -> str:
    """All pairs that share a shingle, their exact overlaps, and the least document that links reach."""
    return f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^ \x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, k, k + 4), ' ') AS g FROM w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) t(k) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= {percent} * (x.n + y.n - shared)),
r AS (SELECT doc_id, doc_id AS c FROM w UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id WHERE r.c < l.b),
m AS (SELECT doc_id, min(c) AS c FROM r GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id{more} FROM w JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)"""


ORACLES["op6_near_duplicates"] = _linked_sql(75, ", m.c = w.doc_id AS kept")
ORACLES["op13_ngram_jaccard_join"] = _linked_sql(80)

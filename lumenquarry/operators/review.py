"""Grounded answers, review queues and rules over them: sentences, specifics, support, budgets, proposals, alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Specific statements that an answer must not make up: where to go, whom to write to, how much, long numbers.
SPECIFICS = {
    "urls": r"https?://\S+|www\.\S+",
    "emails": r"[\w.+-]+@[\w-]+\.[\w.-]+",
    "money": r"[£$€]\s?[0-9][0-9,.]*",
    "numbers": r"\b[0-9][0-9\s().-]{6,}[0-9]\b",
}
SPECIFIC = "|".join(SPECIFICS.values())
# Phrases that give orders to a reader that is a model; the first net is for requests, both are for evidence.
INJECTION = (
    r"(?i)(ignore (all |any |the )?(previous|prior|above|earlier) (instructions|prompts?|rules)|disregard (the |all )?(system|previous|prior|above)|"
    r"you are now|reveal (your|the) (system )?prompt|jailbreak|do anything now)"
)
EVIDENCE_INJECTION = (
    r"(?i)((ignore|disregard|forget|override|bypass)\b[^.\n]{0,40}\b(instructions?|prompts?|rules?|guidelines?|system|above|previous|prior|earlier)|"
    r"\b(new|updated|real) (instructions?|rules?|system prompt)\b|\bfrom now on\b|\byou (must|should|will) (now )?(only )?(respond|reply|output|answer|say|cite)\b|"
    r"\b(system|assistant|developer) (prompt|message|override|mode)\b|\bdeveloper mode\b|\bjailbreak\b|\bdo anything now\b|"
    r"\b(reveal|print|repeat|show) (your|the) (system |hidden )?(prompt|instructions)\b|\bdo not (follow|obey) (the )?(rules|instructions|evidence)\b|"
    r"\brespond only with\b|\bpretend (to be|you are)\b|\bact as (if you|an? (unrestricted|different))\b)"
)
# Labels of speakers, tokens that part messages, ids in brackets, characters that don't show.
ROLE_LABEL = r"\b(SYSTEM|ASSISTANT|USER|HUMAN|DEVELOPER)\s*:|(?m)^\s*(system|assistant|user|human|developer)\s*:"
ROLE_TOKEN = r"(?im)(<\|[^|>]{1,30}\|>|\[/?(INST|SYS)\]|<<\s*/?SYS\s*>>|^\s*(system|assistant|user|human|ai)\s*:|```+)"
FORGED_ID = r"\[\s*([A-Za-z]{2,6}[-_ ]?[0-9]{1,8})\s*\]"
INVISIBLE = "[\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]"
REMOVED = "[removed: instruction-like text]"


def sentences(text: Column, least: int = 0) -> Column:
    """The parts of a text that end with . ! or ? before white space, those of more than ``least`` characters. Null has none."""
    parts = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "([.!?])[ \\t\\r\\n]+", "$1\x01"), "\x01")
    return F.filter(parts, lambda s: F.length(s) > least)


def specifics(text: Column) -> Column:
    """All specific statements of a text, squashed; each place counts once."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({SPECIFIC})"), F.lit(0))
    return F.filter(F.transform(found, squashed), lambda x: x != "")


def squashed(text: Column) -> Column:
    """Letters, digits, currency signs, @ and points of a text in lower case; points at the end go."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9£$€@.]", ""), "[.]+$", "")


def invented(answer: Column, evidence: Column) -> Column:
    """Specific statements of an answer that its evidence doesn't hold."""
    known = squashed(F.coalesce(evidence, F.lit("")))
    return F.filter(specifics(answer), lambda x: ~F.contains(known, x))


def looks_hostile(text: Column) -> Column:
    """Whether a request holds a phrase of either net, characters that don't show left out. A null text doesn't."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), INVISIBLE, "")
    return t.rlike(INJECTION) | t.rlike(EVIDENCE_INJECTION)


def neutralised(text: Column) -> Column:
    """Evidence that can't command a reader: characters that don't show and tags go, forged ids in brackets become round ones, sentences with a hostile phrase or
    a speaker's label become a mark, other role tokens a blank. Entities and compatibility forms are for text.normalised(), before. A null text is empty."""
    t = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), INVISIBLE, ""), "<[^>|]+>", " ")
    parts = F.split(F.regexp_replace(F.regexp_replace(t, FORGED_ID, "($1)"), "([.!?])[ \\t\\r\\n]+|\\n+", "$1\x01"), "\x01")
    hostile = lambda x: x.rlike(EVIDENCE_INJECTION) | x.rlike(INJECTION) | x.rlike(ROLE_LABEL)
    safe = F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.when(hostile(x), F.lit(REMOVED)).otherwise(F.regexp_replace(x, ROLE_TOKEN, " ")))
    return F.trim(F.regexp_replace(F.array_join(safe, " "), "[ \\t\\r\\n]+", " "))


def rewritten(text: Column, words: dict[str, str]) -> Column:
    """Each word between single blanks that has an entry, replaced."""
    table = F.create_map(*[F.lit(x) for kv in words.items() for x in kv])
    return F.array_join(F.transform(F.split(text, " "), lambda w: F.coalesce(F.try_element_at(table, w), w)), " ")


def tolerant_json(text: Column, schema: str) -> Column:
    """The object between the first { and the last } of an answer; null if it isn't JSON."""
    return F.from_json(F.nullif(F.regexp_extract(text, "(?s)\\{.*\\}", 0), F.lit("")), schema)


def support_map(rows: DataFrame, answer: str, source: str, supported: str) -> DataFrame:
    """(answer, support): a map from each cited source to whether it supports the answer; repeated citations count as their best."""
    best = rows.where(F.col(source).isNotNull()).groupBy(answer, source).agg(F.max(supported).alias("ok"))
    return best.groupBy(answer).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(source, "ok")))).alias("support"))


def clipped(rows: DataFrame, group: str, order: list, size: Column, budget: int, levels: list[int]) -> DataFrame:
    """Rows with ``clip``: each group takes the first level whose clipped sizes fit the budget; at the last one, rows are dropped from the end."""
    one = Window.partitionBy(group)
    fits = [F.sum(F.least(size, F.lit(x))).over(one) <= budget for x in levels]
    level = F.coalesce(*[F.when(f, F.lit(x)) for f, x in zip(fits, levels, strict=True)], F.lit(levels[-1]))
    rows = rows.withColumn("clip", F.least(size, level))
    return rows.withColumn("used", F.sum("clip").over(one.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))).where(F.col("used") <= budget)


def novel(df: DataFrame, abstained: Column, evidence: Column, threshold: float) -> DataFrame:
    """Rows that were abstained from, or whose evidence is known and weak."""
    return df.where(F.coalesce(abstained, F.lit(False)) | F.coalesce(evidence < threshold, F.lit(False)))


def candidates(df: DataFrame, key: str, content: list[str], abstained: Column, evidence: Column, threshold: float, reviewed: DataFrame) -> DataFrame:
    """Novel rows that nobody has reviewed, one of each content: that of the least key."""
    rows = novel(df, abstained, evidence, threshold).join(reviewed.select(key), key, "left_anti")
    return rows.groupBy(*content).agg(F.min(key).alias(key), F.count("*").alias("alike"))


def proposals(members: DataFrame, cluster: str, label: str, name: str, least: int = 3, covered: float = 0.8, extend: float = 0.5) -> DataFrame:
    """(cluster, size, label, share, action, label_id): what to do about each cluster, by the share of its commonest known label.

    Clusters of fewer than ``least`` are dropped; ``covered`` or more is covered, ``extend`` or more extends that label, less is a new
    label, whose id is the cluster's least name, with a number where several clusters have it.
    """
    counts = members.groupBy(cluster, label).agg(F.count("*").alias("n"), F.min(name).alias("name"))
    top = counts.groupBy(cluster).agg(F.sum("n").alias("size"), F.max_by(label, F.struct(F.when(F.col(label).isNotNull(), F.col("n")).alias("n"), F.col(label))).alias("label"), F.max(F.when(F.col(label).isNotNull(), F.col("n"))).alias("most"), F.min("name").alias("name"))
    share = F.coalesce(F.col("most") / F.col("size"), F.lit(0.0))
    action = F.when(F.col("size") < least, "drop").when(share >= covered, "covered").when(share >= extend, "extend").otherwise("new")
    rows = top.withColumn("share", share).withColumn("action", action)
    number = F.row_number().over(Window.partitionBy("action", "name").orderBy(cluster))
    fresh = F.when(number > 1, F.concat("name", F.lit("_"), number.cast("string"))).otherwise(F.col("name"))
    return rows.withColumn("label_id", F.when(F.col("action") == "new", fresh).when(F.col("action") == "extend", F.col("label").cast("string"))).select(cluster, "size", "label", "share", "action", "label_id")


def decided(taxonomy: DataFrame, decisions: DataFrame) -> DataFrame:
    """A taxonomy (label_id, description and, where there are, arrays keywords and examples) after decisions (label_id, decision, into and the same columns).

    Accepted labels are added where they are new. A merged label, known or proposed, goes into another, which takes over its keywords and examples behind its own, each once.
    A label merged into one that isn't in the taxonomy goes all the same. Rejected proposals, other decisions and a merge into itself change nothing. Chains of merges go step by step:
    each decision is about labels of the table it is given.
    """
    lists = [c for c in ("keywords", "examples") if c in taxonomy.columns and c in decisions.columns]
    added = decisions.where("decision = 'accept'").dropDuplicates(["label_id"]).select("label_id", "description", *lists).join(taxonomy.select("label_id"), "label_id", "left_anti")
    now = taxonomy.select("label_id", "description", *lists).unionByName(added)
    merges = decisions.where("decision = 'merge' and into <> label_id").select("label_id", F.col("into").alias("target"), *[F.col(c).alias(f"own_{c}") for c in lists])
    merges = merges.dropDuplicates(["label_id"])
    kept = now.join(merges.select("label_id"), "label_id", "left_anti")
    if not lists:
        return kept
    # What a merged label had in the taxonomy, and what its decision brings.
    had = merges.join(now.select("label_id", *lists), "label_id", "left")
    none = F.array().cast("array<string>")
    whole = [F.concat(F.coalesce(c, none), F.coalesce(f"own_{c}", none)).alias(c) for c in lists]
    more = had.select("target", "label_id", *whole).groupBy("target").agg(*[F.array_sort(F.collect_list(F.struct("label_id", F.col(c).alias("xs")))).alias(c) for c in lists])
    out = kept.alias("k").join(more.alias("m"), F.col("k.label_id") == F.col("m.target"), "left")
    merged = [F.array_distinct(F.concat(F.coalesce(f"k.{c}", none), F.coalesce(F.flatten(F.transform(f"m.{c}", lambda s: s["xs"])), none))).alias(c) for c in lists]
    return out.select("k.label_id", "k.description", *merged)


def linked(left: DataFrame, right: DataFrame, member: str) -> DataFrame:
    """(left_id, right_id, shared): for each group of the left table the group of the right one with which it shares most members; ties go to the least id."""
    both = left.select("left_id", member).distinct().join(right.select("right_id", member).distinct(), member).groupBy("left_id", "right_id").agg(F.count("*").alias("shared"))
    best = both.groupBy("left_id").agg(F.min_by(F.struct("right_id", "shared"), F.struct(-F.col("shared"), F.col("right_id"))).alias("b"))
    return best.select("left_id", "b.right_id", "b.shared")


def superseded(df: DataFrame, key: str, order: list, status: str, pending: str, to: str = "superseded") -> DataFrame:
    """Rows with their status: of each key's pending rows all but the last become ``to``. What a conditional update writes as the next version."""
    last = F.row_number().over(Window.partitionBy(key, F.col(status) == pending).orderBy(*order)) == 1
    return df.withColumn(status, F.when((F.col(status) == pending) & ~last, F.lit(to)).otherwise(F.col(status)))


def alerts(series: DataFrame, at: str, value: str, threshold: float, periods: int) -> DataFrame:
    """Rows at which a value has been over the threshold for ``periods`` rows in a row. The series is one of bounded length, as a metric by day is."""
    recent = Window.orderBy(at).rowsBetween(-(periods - 1), 0)
    over = F.col(value) > threshold
    return series.withColumn("firing", (F.count(F.when(over, 1)).over(recent) == periods)).where("firing").drop("firing")


def fired(series: DataFrame, rules: DataFrame) -> DataFrame:
    """(rule, metric, at, value, run): where a rule (rule, metric, op, threshold, periods) of ``>`` or ``<`` has held for ``periods`` rows of its metric in a row.

    ``series`` has (metric, at, value), one row for each metric and time; run says for how many rows the rule has held. A null value ends a run.
    """
    own = Window.partitionBy("rule").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    holds = F.coalesce(F.when(F.col("op") == ">", F.col("value") > F.col("threshold")).otherwise(F.col("value") < F.col("threshold")), F.lit(False))
    rows = series.join(rules, "metric").withColumn("holds", holds).withColumn("i", F.row_number().over(Window.partitionBy("rule").orderBy("at")))
    run = F.col("i") - F.max(F.when(F.col("holds"), F.lit(0)).otherwise(F.col("i"))).over(own)
    return rows.withColumn("run", run.cast("bigint")).where(F.col("holds") & (F.col("run") >= F.col("periods"))).select("rule", "metric", "at", "value", "run")


def collapsed(rows: DataFrame, by: list[str], text: str, key: str) -> DataFrame:
    """(by, key, alike): of rows whose text has the same letters and digits one stays, that with the least key. A null text is empty. Texts meet as digests."""
    alike = F.sha2(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " ")), 256)
    return rows.groupBy(*by, alike.alias("digest")).agg(F.min(key).alias(key), F.count("*").alias("alike")).drop("digest")


def wrongly_rejected(df: DataFrame, rejected: str, retrieved: str) -> Column:
    """Rejected sources that had not been retrieved."""
    return F.array_except(F.coalesce(rejected, F.expr("array()")), F.coalesce(retrieved, F.expr("array()")))

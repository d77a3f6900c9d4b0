"""Judging a running system: findings, fast alerts, permutation tests, answer and discovery scores, weight grids, recall of candidate searches."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quality import wilson_low


@dataclass(frozen=True)
class Rules:
    """Limits of the findings: counts that make a case, and shares that make it bad."""

    ratings: int = 10
    coverage: float = 0.05
    group_ratings: int = 5
    group_share: float = 0.4
    group_low: float = 0.2
    group_severe: float = 0.4
    rejections: int = 2
    severe_rejections: int = 3
    cited: int = 3
    article_share: float = 0.5
    ticket_share: float = 0.6
    confusions: int = 2
    abstained: int = 5
    abstained_share: float = 0.3
    unreliable_share: float = 0.05
    degraded_share: float = 0.10


def source_counts(feedback: DataFrame, cited: str, rejected: str, bad: Column, kind: Column) -> DataFrame:
    """(source, type, rejected, helpful, explicit): how often a source was cited in bad and in other rated answers, and named as wrong.

    cited and rejected are arrays; a source counts once for a rating. ``kind`` is an expression over ``source``. Null arrays name nothing.
    """
    empty = F.expr("cast(array() as array<string>)")
    names = lambda c: F.transform(F.array_distinct(F.coalesce(c, empty)), lambda s: s.cast("string"))
    both = feedback.select(bad.alias("bad"), names(F.col(cited)).alias("c"), names(F.col(rejected)).alias("r"))
    rows = both.select("bad", F.inline(F.concat(F.transform("c", lambda s: F.struct(s.alias("source"), F.lit(False).alias("named"))), F.transform("r", lambda s: F.struct(s.alias("source"), F.lit(True).alias("named"))))))
    t = rows.groupBy("source").agg(F.count_if(F.col("bad") & ~F.col("named")).alias("rejected"), F.count_if(~F.col("bad") & ~F.col("named")).alias("helpful"), F.count_if("named").alias("explicit"))
    return t.withColumn("type", kind)


def all_findings(totals: DataFrame, groups: DataFrame, sources: DataFrame, confusions: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(kind, severity, subject, value): the eight rules over aggregates; each needs a least count before it speaks.

    totals: one row (requests, feedback, rated, unreliable, degraded). groups: (group, requests, feedback, rejected, abstained).
    sources: as source_counts() gives them. confusions: (predicted, corrected, n). No rows in, no findings out; order by severity_rank.
    """
    say = lambda df, kind, severity, subject, value: df.select(F.lit(kind).alias("kind"), (severity if isinstance(severity, Column) else F.lit(severity)).alias("severity"), subject.alias("subject"), value.cast("double").alias("value"))
    c, r = F.col, rules
    few = totals.where(c("feedback") < r.ratings)
    thin = totals.where((c("feedback") >= r.ratings) & (c("rated") < r.coverage * c("requests")))
    g = groups.withColumns({"share": F.try_divide("rejected", "feedback"), "low": wilson_low(c("rejected"), c("feedback")), "out": F.try_divide("abstained", "requests")})
    s = sources.withColumn("share", F.try_divide(c("rejected"), c("rejected") + c("helpful"))).withColumn("cited", c("rejected") + c("helpful"))
    over = lambda share: (c("explicit") >= r.rejections) | ((c("cited") >= r.cited) & (c("share") >= share))
    parts = [
        say(few, "data_sufficiency", "info", F.lit("ratings"), c("feedback")),
        say(thin, "data_sufficiency", "info", F.lit("coverage"), c("rated") / c("requests")),
        say(g.where((c("feedback") >= r.group_ratings) & (c("share") >= r.group_share) & (c("low") >= r.group_low)), "problem_intent", F.when(c("low") >= r.group_severe, "high").otherwise("medium"), c("group").cast("string"), c("share")),
        say(s.where((c("type") == "article") & over(r.article_share)), "weak_article", F.when(c("explicit") >= r.severe_rejections, "high").otherwise("medium"), c("source"), c("share")),
        say(s.where((c("type") == "ticket") & over(r.ticket_share)), "rejected_ticket", "medium", c("source"), c("share")),
        say(confusions.where(c("n") >= r.confusions), "intent_confusion", "medium", F.concat_ws(" > ", "predicted", "corrected"), c("n")),
        say(g.where((c("abstained") >= r.abstained) & (c("out") >= r.abstained_share)), "abstention_cluster", "medium", c("group").cast("string"), c("out")),
        say(totals.where(c("unreliable") >= r.unreliable_share * c("requests")).where("unreliable > 0"), "grounding_failures", "high", F.lit("unreliable"), c("unreliable") / c("requests")),
        say(totals.where(c("degraded") >= r.degraded_share * c("requests")).where("degraded > 0"), "llm_degradation", "high", F.lit("degraded"), c("degraded") / c("requests")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "high", 0).when(severity == "medium", 1).otherwise(2)


@dataclass(frozen=True)
class Alerts:
    least: int = 30
    abstention: float = 0.10
    evidence: float = 0.05
    divergence: float = 0.10
    negative: float = 0.35


def fast_alerts(sided: DataFrame, abstained: Column, evidence: Column, categories: list[str], negative: DataFrame, limits: Alerts = Alerts()) -> DataFrame:
    """(signal, value, limit, alert, status) of a recent window against a baseline, from rows with a ``side`` and one row (negative).

    abstention_rate: its rise; mean_evidence: its fall; js_<category>: base-2 divergence; negative_feedback: the share in ``negative``.
    With fewer than ``least`` rows on a side nothing alerts and status is insufficient_data; an unknown value doesn't alert.
    """
    from .drift import counts, jensen_shannon

    recent, base = F.col("side") == "recent", F.col("side") == "baseline"
    n = sided.agg(F.count_if(recent).alias("nr"), F.count_if(base).alias("nb"))  # one row
    mean = lambda x, side: F.avg(F.when(side, x))
    flag = F.coalesce(abstained, F.lit(False)).cast("int")
    levels = sided.agg((mean(flag, recent) - mean(flag, base)).alias("a"), (mean(evidence, base) - mean(evidence, recent)).alias("e"))
    row = lambda df, name, value, limit: df.select(F.lit(name).alias("signal"), value.alias("value"), F.lit(limit).alias("limit"))
    rows = row(levels, "abstention_rate", F.col("a"), limits.abstention).unionByName(row(levels, "mean_evidence", F.col("e"), limits.evidence))
    for name in categories:
        rows = rows.unionByName(row(jensen_shannon(counts(sided, name)), f"js_{name}", F.col("js"), limits.divergence))
    rows = rows.unionByName(row(negative, "negative_feedback", F.col("negative"), limits.negative)).join(F.broadcast(n))
    enough = (F.col("nr") >= limits.least) & (F.col("nb") >= limits.least)
    alert = enough & F.coalesce(F.col("value") > F.col("limit"), F.lit(False))
    any_alert = F.max(alert.cast("int")).over(Window.partitionBy(F.lit(1))) == 1  # a handful of signals
    return rows.select("signal", "value", "limit", alert.alias("alert"), F.when(~enough, "insufficient_data").when(any_alert, "alert").otherwise("ok").alias("status"))


def discovery_decisions(clusters: DataFrame, runs: DataFrame, now: Column, cooldown_hours: float = 24.0, covered: float = 0.5) -> DataFrame:
    """(cluster, needs, due): whether a cluster needs a proposal, and whether a discovery run may start for it.

    clusters: (cluster, significant, covered, overlap), overlap the largest share of it in one proposal (null: none). runs: (started,
    active); none may be active or have started within the cooldown. No runs at all: due at once.
    """
    last = runs.agg(F.max("started").alias("last"), F.coalesce(F.bool_or("active"), F.lit(False)).alias("active"))  # one row
    needs = F.coalesce(F.col("significant") & ~F.col("covered"), F.lit(False)) & (F.coalesce(F.col("overlap"), F.lit(0.0)) < covered)
    cool = F.col("last").isNull() | (F.unix_timestamp(now) - F.unix_timestamp("last") >= cooldown_hours * 3600)
    return clusters.join(F.broadcast(last)).select("cluster", needs.alias("needs"), (needs & cool & ~F.col("active")).alias("due"))


_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))  # fixed values of the splitmix64 generator


def _uniform(keys: np.ndarray, replicate: int) -> np.ndarray:
    """A number in [0, 1) for each key and replicate: splitmix64 of both."""
    with np.errstate(over="ignore"):
        z = keys + _MIX[0] * np.uint64(replicate + 1)
        z = (z ^ (z >> np.uint64(30))) * _MIX[1]
        z = (z ^ (z >> np.uint64(27))) * _MIX[2]
        return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2.0**53


def centroid_permutation(df: DataFrame, key: str, vector: str, recent: Column, replicates: int = 500, seed: int = 17) -> DataFrame:
    """(distance, p): cosine distance of two windows' mean vectors, and how often random windows are as far apart, (1 + k) / (1 + n).

    In each replicate a hash of key and seed puts every row into the recent window with the recent share as its chance. A task sums
    its rows' vectors for all replicates as matrix products and sends one row for each, so that rows aren't shuffled and a lost task
    gives the same sums again. Rows without a vector are left out; a window without rows gives null.
    """
    rows = df.where(F.col(vector).isNotNull()).select(F.xxhash64(F.lit(seed), F.col(key)).alias("h"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(recent, F.lit(False)).alias("r"))
    share = F.broadcast(rows.agg(F.avg(F.col("r").cast("int")).alias("share")))  # one row

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = count = None
        for b in batches:
            v, h, p = np.array(b["v"].tolist(), float), b["h"].to_numpy().view(np.uint64), b["share"].iloc[0] if len(b) else 0.0
            if not len(v):
                continue
            # Row 0 is what was observed, row 1 all rows, the others are replicates.
            member = np.vstack([b["r"].to_numpy(float), np.ones(len(v)), *[_uniform(h, i) < p for i in range(replicates)]])
            total, count = (member @ v, member.sum(axis=1)) if total is None else (total + member @ v, count + member.sum(axis=1))
        if total is not None:
            yield pd.DataFrame({"i": range(len(total)), "n": count, "s": total.tolist()})

    parts = rows.join(share).mapInPandas(sums, "i int, n double, s array<double>")
    # Each replicate's sums by dimension: replicates x dimensions rows, however many documents there are.
    cells = parts.select("i", "n", F.posexplode("s").alias("d", "x")).groupBy("i", "d").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    every = cells.where("i = 1").select("d", F.col("x").alias("ax"), F.col("n").alias("an"))
    pair = cells.where("i <> 1").join(every, "d").withColumns({"u": F.try_divide(F.col("x"), F.col("n")), "w": F.try_divide(F.col("ax") - F.col("x"), F.col("an") - F.col("n"))})
    norm = F.sqrt(F.sum(F.col("u") * F.col("u"))) * F.sqrt(F.sum(F.col("w") * F.col("w")))
    far = pair.groupBy("i").agg((1 - F.sum(F.col("u") * F.col("w")) / F.when(norm > 0, norm).otherwise(1.0)).alias("distance"))
    seen = F.broadcast(far.where("i = 0").select(F.col("distance").alias("seen")))  # one row
    return far.where("i > 1").join(seen).groupBy(F.col("seen").alias("distance")).agg(((1 + F.count_if(F.col("distance") >= F.col("seen"))) / F.lit(1.0 + replicates)).alias("p"))


def combined_p(omnibus: Column, least: Column, k: Column) -> Column:
    """One p of a dimension from its omnibus test and the least of its k categories' tests: twice the better one, at most 1."""
    return F.least(F.lit(1.0), 2 * F.least(omnibus, k * least))


def answer_scores(steps: DataFrame, citations: DataFrame, least: float = 0.5) -> DataFrame:
    """One row of rates over answers: faithful steps, answers with an unfaithful step or invalid citation, valid, right and complete citations.

    steps: (answer, step, containment, grounded, cited), cited a boolean. citations: (answer, valid, relevant). Rates of nothing are null.
    """
    bad = F.coalesce(F.col("containment"), F.lit(0.0)) < least
    per = steps.groupBy("answer").agg(F.count("*").alias("n"), F.count_if(bad).alias("bad"), F.avg(F.col("grounded").cast("int")).alias("grounded"), F.avg(F.col("cited").cast("int")).alias("coverage"))
    cites = citations.groupBy("answer").agg(F.count("*").alias("cites"), F.count_if(~F.col("valid")).alias("invalid"), F.count_if(F.col("valid") & F.col("relevant")).alias("right"))
    t = per.join(cites, "answer", "left").na.fill(0, ["cites", "invalid", "right"])
    rate = lambda a, b: F.try_divide(a, b)
    return t.agg(
        F.count("*").alias("answered"),
        (1 - rate(F.sum("bad"), F.sum("n"))).alias("faithfulness"),
        rate(F.count_if((F.col("bad") > 0) | (F.col("invalid") > 0)), F.count("*")).alias("hallucinated"),
        (1 - rate(F.sum("invalid"), F.sum("cites"))).alias("validity"),
        rate(F.sum("right"), F.sum(F.col("cites") - F.col("invalid"))).alias("precision"),
        F.avg("coverage").alias("coverage"),
        F.avg("grounded").alias("grounded"),
    )


def discovery_scores(items: DataFrame, least_purity: float = 0.8) -> DataFrame:
    """(class, total, flagged, cluster, found, purity, recovered) for each novel class; items: (item, class, novel, cluster).

    An item is flagged if it has a cluster. A class's cluster is the one that holds most of it (ties: the least); purity is its share there.
    """
    sizes = items.where("cluster is not null").groupBy("cluster").agg(F.count("*").alias("size"))
    cells = items.where("novel and cluster is not null").groupBy("class", "cluster").agg(F.count("*").alias("n")).join(sizes, "cluster")
    best = cells.groupBy("class").agg(F.min_by(F.struct("cluster", "n", "size"), F.struct(-F.col("n"), F.col("cluster"))).alias("b"))
    t = items.where("novel").groupBy("class").agg(F.count("*").alias("total"), F.count("cluster").alias("flagged")).join(best, "class", "left")
    purity = F.coalesce(F.col("b.n") / F.col("b.size"), F.lit(0.0))
    return t.select("class", "total", "flagged", F.col("b.cluster").alias("cluster"), F.coalesce("b.n", F.lit(0)).alias("found"), purity.alias("purity"), (purity >= least_purity).alias("recovered"))


def weight_grid(first: DataFrame, second: DataFrame, truth: DataFrame, weights: list[float]) -> DataFrame:
    """(weight, accuracy) of w * first + (1 - w) * second, each (key, label, p), against truth (key, label); ties go to the least label.

    All weights are tried in one pass: an array of sums by key and label, and a maximum for each weight.
    """
    rows = first.select("key", "label", F.col("p").alias("a"), F.lit(0.0).alias("b")).unionByName(second.select("key", "label", F.lit(0.0).alias("a"), F.col("p").alias("b")))
    sums = rows.groupBy("key", "label").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    score = lambda w: F.round(w * F.col("a") + (1 - w) * F.col("b"), 9)
    best = sums.groupBy("key").agg(F.array(*[F.min_by("label", F.struct(-score(w), F.col("label"))) for w in weights]).alias("best"))
    t = best.join(truth.select("key", F.col("label").alias("t")), "key").select("t", F.posexplode("best").alias("i", "label"))
    rate = t.groupBy("i").agg(F.avg((F.col("label") == F.col("t")).cast("int")).alias("accuracy"))
    return rate.select(F.element_at(F.array(*[F.lit(w) for w in weights]), F.col("i") + 1).alias("weight"), "accuracy")


def candidate_recall(exact: DataFrame, candidates: DataFrame) -> DataFrame:
    """(query, wanted, hits, recall) of a candidate search against the exact one, both (query, doc); a query without candidates has 0."""
    hit = candidates.select("query", "doc").distinct().withColumn("hit", F.lit(1))
    t = exact.select("query", "doc").distinct().join(hit, ["query", "doc"], "left").groupBy("query").agg(F.count("*").alias("wanted"), F.count("hit").alias("hits"))
    return t.withColumn("recall", F.col("hits") / F.col("wanted"))

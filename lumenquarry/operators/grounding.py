"""Checks of answers against their evidence, answer policy, lineage and case replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..functions.vectors import cosine
from .metrics import latencies
from .review import invented


def containment(a: Column, b: Column) -> Column:
    """Share of a's distinct tokens that b has; 0 for no tokens."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    return F.when(F.size(x) > 0, F.size(F.array_intersect(x, y)) / F.size(x)).otherwise(F.lit(0.0))


def overlap_coefficient(a: Column, b: Column) -> Column:
    x, y = F.array_distinct(a), F.array_distinct(b)
    small = F.least(F.size(x), F.size(y))
    return F.when(small > 0, F.size(F.array_intersect(x, y)) / small).otherwise(F.lit(0.0))


def citations(answers: DataFrame, retrieved: DataFrame) -> DataFrame:
    """(answer, cited, source): each distinct citation, brackets and blanks stripped, matched without regard to case; source is null if invalid."""
    flat = answers.select("answer", F.explode("citations").alias("raw")).select("answer", F.trim(F.regexp_replace("raw", "[\\[\\]\\s]", "")).alias("cited")).distinct()
    known = retrieved.select(F.col("answer").alias("a"), "source")
    return flat.join(known, (F.col("answer") == F.col("a")) & (F.lower("cited") == F.lower("source")), "left").select("answer", "cited", "source")


def grounded_steps(steps: DataFrame, units: DataFrame, least: float = 0.75, near: float = 0.45, cited: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """(answer, step, support, similarity, invented, grounded): a step is grounded if the units of its sources hold enough of its tokens, or
    one of them is near in meaning, and it states nothing specific that they lack.

    steps: (answer, step, text), units: (answer, text); both may have a column ``vector``. With ``cited`` (answer, step, source), units
    have a source, and only those of a step's own citations count; else all of its answer's. An answer's units are what was retrieved
    for it, a list of bounded length. A step without units has support and similarity 0. ``parts`` deals answers to so many tasks, once for all
    joins, where the sizes of shuffles would leave tasks too large.
    """
    if parts:
        steps, units, cited = (df if df is None else df.repartition(parts, "answer") for df in (steps, units, cited))
    vectors = "vector" in steps.columns and "vector" in units.columns
    of = ["answer"]
    if cited is not None:
        units, of = cited.select("answer", "step", "source").distinct().join(units, ["answer", "source"]), ["answer", "step"]
    texts = F.sort_array(F.collect_list(F.coalesce("text", F.lit(""))))
    known = units.groupBy(*of).agg(F.array_join(texts, " ").alias("known"), *([F.collect_list("vector").alias("near_to")] if vectors else []))
    rows = steps.join(known, of, "left").withColumn("known", F.coalesce("known", F.lit("")))
    similarity = F.coalesce(F.array_max(F.transform("near_to", lambda v: cosine(F.col("vector"), v))), F.lit(0.0)) if vectors else F.lit(0.0)
    rows = rows.select("answer", "step", containment(tokens(F.col("text")), tokens(F.col("known"))).alias("support"), F.greatest(similarity, F.lit(0.0)).alias("similarity"), F.size(invented(F.col("text"), F.col("known"))).alias("invented"))
    return rows.withColumn("grounded", ((F.col("support") >= least) | (F.col("similarity") >= near)) & (F.col("invented") == 0))


def validation(grounded: DataFrame, least_ratio: float = 0.6) -> DataFrame:
    """(answer, n, grounded, ratio, valid)."""
    rows = grounded.groupBy("answer").agg(F.count("*").alias("n"), F.count_if("grounded").alias("grounded"))
    ratio = F.when(F.col("n") > 0, F.col("grounded") / F.col("n")).otherwise(1.0)
    return rows.withColumn("ratio", ratio).withColumn("valid", ratio >= least_ratio)


def policy(confidence: Column, ratio: Column, valid: Column, sufficient: Column, generated: Column, threshold: float = 0.55) -> tuple[Column, Column]:
    """(status, adjusted confidence): abstained, unreliable, degraded or resolved."""
    status = F.when(~sufficient, "abstained").when(~valid, "unreliable").when(~generated, "degraded").otherwise("resolved")
    scaled = confidence * (0.5 + 0.5 * ratio)
    value = F.when(~sufficient, F.least(confidence, F.lit(threshold - 0.01))).when(~valid, F.least(F.lit(0.4), confidence * 0.5)).otherwise(scaled)
    return status, value


def lineage(retrieved: DataFrame, selected: DataFrame, cited: DataFrame) -> DataFrame:
    """(answer, from, to, kind): edges query -> source -> evidence -> step. Each frame has answer and source, cited also step."""
    a = retrieved.select("answer", F.lit("query").alias("from"), F.col("source").cast("string").alias("to"), F.lit("retrieved").alias("kind"))
    b = selected.select("answer", F.col("source").cast("string").alias("from"), F.lit("evidence").alias("to"), F.lit("selected").alias("kind"))
    c = cited.select("answer", F.col("source").cast("string").alias("from"), F.col("step").cast("string").alias("to"), F.lit("cited").alias("kind"))
    return a.unionByName(b).unionByName(c)


def broken_lineage(edges: DataFrame, steps: DataFrame | None = None, invalid: DataFrame | None = None) -> DataFrame:
    """(answer, source, check): sources selected without having been retrieved, cited without having been retrieved or selected; cited by a
    step that isn't there (with ``steps``: answer, step); or cited though found invalid (with ``invalid``: answer, source)."""
    got = edges.where("kind = 'retrieved'").select("answer", F.col("to").alias("source")).distinct()
    chosen = edges.where("kind = 'selected'").select("answer", F.col("from").alias("source")).distinct()
    ends = edges.where("kind = 'cited'").select("answer", F.col("from").alias("source"), F.col("to").alias("step"))
    cited = ends.select("answer", "source").distinct()
    both = ["answer", "source"]
    found = [(chosen.join(got, both, "left_anti"), "selected_not_retrieved"), (cited.join(got, both, "left_anti"), "cited_not_retrieved"), (cited.join(chosen, both, "left_anti"), "cited_not_selected")]
    if invalid is not None:
        found.append((cited.join(invalid.select("answer", F.col("source").cast("string").alias("source")), both, "left_semi"), "invalid_citation_survived"))
    if steps is not None:
        known = steps.select("answer", F.col("step").cast("string").alias("step"))
        found.append((ends.join(known, ["answer", "step"], "left_anti").select(*both).distinct(), "step_missing"))
    out = None
    for rows, check in found:
        rows = rows.withColumn("check", F.lit(check))
        out = rows if out is None else out.unionByName(rows)
    return out


def case_diff(old: DataFrame, new: DataFrame, key: str, items: str, fields: list[str]) -> DataFrame:
    """Added, removed and common items of two runs, which fields changed, and whether the run was reproduced."""
    both = old.alias("o").join(new.alias("n"), key)
    o, n = F.col(f"o.{items}"), F.col(f"n.{items}")
    changed = F.array_compact(F.array(*[F.when(~F.col(f"o.{f}").eqNullSafe(F.col(f"n.{f}")), F.lit(f)) for f in fields]))
    return both.select(key, F.array_except(n, o).alias("added"), F.array_except(o, n).alias("removed"), F.size(F.array_intersect(o, n)).alias("common"), changed.alias("changed"), ((o == n) & (F.size(changed) == 0)).alias("reproduced"))


def stage_latencies(traces: DataFrame) -> DataFrame:
    """(name, n, mean, p95) from an array column ``trace`` of structs (name, latency); p95 is exact."""
    m = latencies(traces.select(F.explode("trace").alias("t")).select("t.name", "t.latency").where("name is not null"), "latency", "name")
    return m.select("name", "n", "mean", "p95")


def extractive_steps(steps: DataFrame, most: int = 7, overlap: float = 0.6) -> DataFrame:
    """(answer, chosen): a fold over each answer's ordered steps that skips those too like an earlier one."""
    parts = F.sort_array(F.collect_list(F.struct("position", "text")))
    start = F.expr("cast(array() as array<string>)")

    def step(acc: Column, x: Column) -> Column:
        near = F.exists(acc, lambda y: overlap_coefficient(tokens(y), tokens(x["text"])) >= overlap)
        return F.when(near | (F.size(acc) >= most), acc).otherwise(F.array_append(acc, x["text"]))

    return steps.groupBy("answer").agg(F.aggregate(parts, start, step).alias("chosen"))

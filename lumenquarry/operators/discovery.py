"""Proposals of new or extended labels from clusters of rows that the known corpus explains badly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import slug
from ..functions.vectors import cosine, mean_vector
from ..sources.files import few, removed, scratch, written
from .clusters import distinct_keywords


def neighbour_profile(neighbours: DataFrame, most: int = 5) -> DataFrame:
    """(query, labels, top): labels of each row's ``most`` nearest known rows, nearest first, and the largest similarity, from (query, rank, score, label)."""
    rows = neighbours.where(F.col("rank") <= most)
    return rows.groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "label"))), lambda s: s["label"]).alias("labels"), F.max("score").alias("top"))


def proposed(
    members: DataFrame, existing: DataFrame, background: DataFrame | None = None, least: int = 3, covered: float = 0.75, agreed: float = 0.6, examples: int = 3, keywords: int = 8,
    stop: list[str] | None = None,
) -> DataFrame:
    """(cluster, size, recommendation, label_id, keywords, examples, nearest, team, agreement, top_similarity, cohesion): what to do about each cluster.

    ``members`` has (cluster, key, vector, text, nearest, top): the label and the similarity of a row's nearest known row. ``existing`` has (label_id, team). A cluster whose
    mean similarity is ``covered`` or more extends the label that most members are nearest to, if at least ``agreed`` of them are; else it is left out, as
    known rows look like it without one owner. Others are new labels, named by their first two keywords; a name that is taken gets the next free number.
    Examples are the members nearest to the centroid. Clusters of fewer than ``least`` rows are left out. Null vectors, texts and labels don't count.
    Keywords are heavier in the cluster than in the others and in ``background``; ties go by term and by key.
    """
    spark, own = members.sparkSession, Window.partitionBy("cluster")
    path = scratch(spark, "proposals")
    # Written once, whatever members cost; texts are then read for keywords and for examples alone, and never pass by cluster.
    rows = written(members.where("cluster is not null").withColumn("row", F.monotonically_increasing_id()), f"{path}/members")
    sizes = written(rows.groupBy("cluster").agg(F.count("*").alias("size")).where(F.col("size") >= least), f"{path}/sizes")
    sized = rows.join(few(sizes), "cluster")
    centroid = written(mean_vector(sized.where("vector is not null"), ["cluster"], "vector", "centroid"), f"{path}/centroids")
    near = written(sized.join(few(centroid, 20_000), "cluster", "left").select("cluster", "key", "row", "top", cosine(F.col("vector"), F.col("centroid")).alias("near")), f"{path}/near")
    first = near.withColumn("place", F.row_number().over(own.orderBy(F.desc_nulls_last(F.round("near", 9)), "key"))).where(F.col("place") <= examples)
    first = written(first.select("cluster", "row", "place"), f"{path}/first")
    shown = rows.select("row", "text").join(few(first), "row").groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda s: s["text"]).alias("examples"))
    facts = near.groupBy("cluster").agg(F.count("*").alias("size"), F.avg("near").alias("cohesion"), F.avg("top").alias("top_similarity")).join(shown, "cluster")
    votes = sized.where("nearest is not null").groupBy("cluster", "nearest").agg(F.count("*").alias("n"))
    winner = votes.groupBy("cluster").agg(F.min_by("nearest", F.struct(-F.col("n"), F.col("nearest"))).alias("nearest"), F.max("n").alias("n"))
    words = distinct_keywords(sized, "cluster", "text", keywords, stop=stop, background=background).withColumnRenamed("terms", "keywords")
    out = facts.join(winner, "cluster", "left").join(words, "cluster", "left").withColumn("agreement", F.coalesce(F.col("n") / F.col("size"), F.lit(0.0)))
    known = F.coalesce(F.col("top_similarity") >= covered, F.lit(False))
    out = out.where(~known | (F.col("agreement") >= agreed)).withColumn("extends", known)
    out = out.join(existing.select(F.col("label_id").alias("nearest"), "team"), "nearest", "left")
    label = F.when(F.col("extends"), F.col("nearest")).otherwise(free_names(slug(F.array_join(F.slice("keywords", 1, 2), "_"), default="emerging_issue")))
    out = _with_taken(out, existing).withColumn("label_id", label)
    out = out.select("cluster", "size", F.when(F.col("extends"), "extend_existing").otherwise("new_class").alias("recommendation"), "label_id", "keywords", "examples", "nearest", "team", "agreement", "top_similarity", "cohesion")
    out = written(out, f"{path}/proposed")
    removed(spark, *[f"{path}/{name}" for name in ("members", "sizes", "centroids", "near", "first")])
    return out


def _with_taken(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """Adds base, taken (numbers that known labels have already given to it; 1 is the bare name) and turn among new labels of one base, larger clusters first."""
    base = slug(F.array_join(F.slice("keywords", 1, 2), "_"), default="emerging_issue")
    rows = rows.withColumn("base", base)
    number = lambda c: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(c, "_([0-9]{1,9})$", 1), F.lit("")), F.lit("999999999")).cast("int"), F.lit(1))
    names = existing.select(F.col("label_id").alias("name"))
    numbers = names.select(F.explode(F.array(F.struct(F.col("name").alias("b"), F.lit(1).alias("i")), F.struct(F.regexp_replace("name", "_[0-9]{1,9}$", "").alias("b"), number(F.col("name")).alias("i")))).alias("x")).select("x.b", "x.i")
    taken = numbers.distinct().groupBy("b").agg(F.collect_set("i").alias("taken"))
    turn = F.row_number().over(Window.partitionBy("base", "extends").orderBy(F.desc("size"), "cluster"))
    return rows.join(taken, F.col("base") == F.col("b"), "left").drop("b").withColumn("taken", F.coalesce("taken", F.array().cast("array<int>"))).withColumn("turn", turn)


def free_names(base: Column) -> Column:
    """The name that is the turn-th free one of its base: the bare one, then _2, _3 and so on, without those that are taken."""
    free = F.filter(F.sequence(F.lit(1), (F.col("turn") + F.size("taken")).cast("int")), lambda i: ~F.array_contains(F.col("taken"), i))
    n = F.element_at(free, F.col("turn"))
    return F.when(n == 1, base).otherwise(F.concat(base, F.lit("_"), n.cast("string")))

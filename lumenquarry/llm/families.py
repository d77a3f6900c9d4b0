"""Linked components of documents, from coarse groups of classes to links that are confirmed on full sets.

Documents with equal sets form a class, and one row stands for it. An operator gives coarse groups that hold every pair to be
confirmed. Each is cut by set size into blocks of bounded weight, and all pairs within a block are compared. A group of
several blocks goes on with one representative of what each block linked, in new blocks, as long as that
links more; only what then isn't linked with the group's largest part is compared with all blocks. So a text of a
family that holds together is shuffled a bounded number of times. Nothing is capped.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, broadcast_if_small, text_or_empty
from .graph import connected_components

#: Shingles in one block, and how many a small document counts as (which bounds the documents in a block).
BLOCK, LEAST_WEIGHT = 200_000, 400


@dataclass(frozen=True)
class Comparison:
    """How blocks are compared. ``within``: rows (component, block, cls, n, text) of a block to (component, block, cls, n, root), root the
    least class that links reach; ``between``: rows (root, text, left, right) to links (u, v) of roots; at ``percent`` of similarity."""

    within: Callable[[pa.Table], pa.Table]
    between: Callable[[pa.Table], pa.Table]
    percent: int


def int64_lists(rows: np.ndarray, at: list[int], count: int) -> pa.Array:
    """Rows of int64 as lists, row i in place at[i]; null elsewhere."""
    out = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * np.int32(rows.shape[1] if len(rows) else 0)), pa.array(rows.reshape(-1), pa.int64()))
    where = np.full(count, -1, np.int64)
    where[at] = np.arange(len(at))
    return out.take(pa.array(where, mask=where < 0))


def grouped(docs: DataFrame, signed: DataFrame, features: list[str], groups: Callable[[DataFrame, Workspace], DataFrame], compare: Comparison, name: str) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id, kept, first_of_group for each row of ``signed`` (doc_id, text_key, n_shingles, cls, features).

    cls is a digest of the document's set, null for one without words, which is its own component. ``groups`` gives (cls, component) of
    classes (cls, n, first, features) that may be linked. Names are by the rules of near_duplicates.
    """
    work = Workspace(docs.sparkSession, name)
    rows = work.keep(signed, "signed")
    # One row for each class; copies are aggregated on the map side first. From here on a number stands for the
    # class: written once with the table, it is fixed.
    classes = rows.where("cls is not null").groupBy(F.col("cls").alias("digest")).agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("first"),
        F.first("n_shingles").alias("n"), *[F.first(c).alias(c) for c in features],
    )
    classes = work.keep(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    # Features are the bulk of what is kept: those of rows go once their class has them, those of classes once groups are found.
    rows = work.keep(rows.select("doc_id", "text_key", "n_shingles", "cls"), "rows")
    work.drop("signed")
    found = work.keep(groups(classes, work), "groups")
    ids = work.keep(classes.select("digest", "cls", "first", "n"), "ids")
    work.drop_others("rows", "groups", "ids")
    labels = _labels(docs, ids, found, work, compare)
    named = ids.select("digest", "cls", "first").join(labels.withColumnRenamed("root", "component"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    least = named.groupBy("component").agg(F.min("first").alias("least"))
    named = work.keep(named.select("digest", "component").join(least, "component").select(F.col("digest").alias("cls"), "least"), "named")
    work.drop_others("rows", "named")
    out = rows.join(named, "cls", "left")
    own = F.col("cls").isNull()
    component = F.when(own, F.col("doc_id")).otherwise(F.col("least.doc_id"))
    return out.select(
        "doc_id", "text_key", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"),
        (own | (F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("text_key") == F.col("least.text_key")))).alias("first_of_group"),
    )


def _blocked(members: DataFrame, *keys: str) -> DataFrame:
    """Adds block to (component, cls, n, ...): in each group by keys, blocks of about BLOCK shingles in the order of set sizes.

    Only sums by set size pass through a window; classes of one size are dealt to blocks by hash.
    """
    weight = F.greatest("n", F.lit(LEAST_WEIGHT))
    sums = members.groupBy(*keys, "n").agg(F.sum(weight).alias("weight"))
    before = F.sum("weight").over(Window.partitionBy(*keys).orderBy("n").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(*keys, "n", F.floor(F.coalesce(before, F.lit(0)) / BLOCK).cast("int").alias("base"), F.ceil(F.col("weight") / BLOCK).cast("int").alias("parts"))
    return members.join(sums, [*keys, "n"]).withColumn("block", F.col("base") + F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int")).drop("base", "parts")


def _compared(blocks: DataFrame, texts: DataFrame, compare: Comparison) -> DataFrame:
    """(component, block, cls, n, root) of classes in blocks, all pairs within each block compared."""
    rows = blocks.select("component", "block", "cls", "n").join(texts, "cls")
    return rows.groupBy("component", "block").applyInArrow(compare.within, "component bigint, block int, cls bigint, n bigint, root bigint")


def _in_several(blocks: DataFrame) -> DataFrame:
    """The components that have several blocks."""
    return blocks.groupBy("component").agg(F.min("block").alias("lo"), F.max("block").alias("hi")).where("lo < hi").select("component")


def _labels(docs: DataFrame, classes: DataFrame, groups: DataFrame, work: Workspace, compare: Comparison) -> DataFrame:
    """(cls, root) for classes that may have links: classes have one root if confirmed links join them."""
    members = groups.join(classes.select("cls", "n", "first.doc_id", "first.text_key"), "cls")
    members = work.keep(_blocked(members, "component"), "blocks")
    texts = _texts(docs, members, work)
    own = work.keep(_compared(members, texts, compare), "own")
    several = work.keep(_in_several(members), "several")
    if not several.head(1):
        return own.select("cls", "root")
    large = work.keep(own.join(several, "component", "left_semi"), "large")
    # Representatives of the parts that blocks linked, in ever fewer blocks.
    reps, links, level = large.where("cls = root").select("component", "cls", "n"), None, 0
    while True:
        blocks = work.keep(_blocked(reps, "component"), f"level-{level}")
        found = work.keep(_compared(blocks, texts, compare), f"linked-{level}")
        new = found.where("cls <> root").select(F.col("cls").alias("u"), F.col("root").alias("v"))
        links = new if links is None else links.unionByName(new)
        left, had = found.where("cls = root").count(), found.count()
        if 2 * left > had or not _in_several(blocks).head(1):
            break
        reps, level = found.where("cls = root").select("component", "cls", "n"), level + 1
    links = work.keep(links, "links")
    joined = work.keep(_joined(large, links, work, "joined"), "parts")
    # What isn't in a group's largest part may still be linked with any text of another part.
    sizes = joined.groupBy("component", "root").agg(F.count("*").alias("members"))
    main = sizes.groupBy("component").agg(F.max_by("root", F.struct("members", "root")).alias("main"), F.count("*").alias("parts")).where("parts > 1").drop("parts")
    apart = work.keep(joined.join(main, "component").withColumn("rest", F.col("root") != F.col("main")).select("component", "cls", "n", "root", "rest"), "apart")
    if apart.head(1):
        links = links.unionByName(_met(apart, texts, work, compare))
        joined = _joined(large, links, work, "all")
    return own.join(several, "component", "left_anti").select("cls", "root").unionByName(joined.select("cls", "root"))


def _joined(parts: DataFrame, links: DataFrame, work: Workspace, name: str) -> DataFrame:
    """The rows of parts (cls, root, ...) with the roots that links between roots lead to."""
    ends = connected_components(links, work, name).toDF("root", "end")
    return parts.join(ends, "root", "left").withColumn("root", F.coalesce("end", "root")).drop("end")


def _met(apart: DataFrame, texts: DataFrame, work: Workspace, compare: Comparison) -> DataFrame:
    """Links between all that is not in a group's largest part and all of the group."""
    blocks = work.keep(_blocked(apart, "component", "rest"), "apart-blocks")
    ranges = work.keep(blocks.groupBy("component", "rest", "block").agg(F.min("n").alias("lo"), F.max("n").alias("hi")), "ranges")
    a, b = ranges.where("rest").alias("a"), ranges.alias("b")
    meet = (F.col("a.component") == F.col("b.component")) & (~F.col("b.rest") | (F.col("a.block") <= F.col("b.block")))
    sized = (F.lit(100) * F.col("a.hi") >= F.lit(compare.percent) * F.col("b.lo")) & (F.lit(100) * F.col("b.hi") >= F.lit(compare.percent) * F.col("a.lo"))
    meetings = a.join(b, meet & sized).select(F.col("a.component").alias("component"), F.col("a.block").alias("i"), F.col("b.rest").alias("other"), F.col("b.block").alias("j"))
    sides = meetings.select("*", F.explode(F.array(F.struct(F.lit(True).alias("rest"), F.col("i").alias("block"), F.lit(True).alias("left")), F.struct(F.col("other").alias("rest"), F.col("j").alias("block"), F.lit(False).alias("left")))).alias("side"))
    # A block that meets itself is one side and the other.
    sides = sides.groupBy("component", "i", "other", "j", "side.rest", "side.block").agg(F.bool_or("side.left").alias("left"), F.bool_or(~F.col("side.left")).alias("right"))
    rows = blocks.select("component", "rest", "block", "cls", "root").join(texts, "cls").join(sides, ["component", "rest", "block"])
    return work.keep(rows.groupBy("component", "i", "other", "j").applyInArrow(compare.between, "u bigint, v bigint"), "met")


def _texts(docs: DataFrame, members: DataFrame, work: Workspace) -> DataFrame:
    """(cls, text): a whole text of each class among the members."""
    few = broadcast_if_small(members.select("doc_id", "text_key", "cls"), members.count())
    source = docs.select("doc_id", "text", F.xxhash64(text_or_empty("text")).alias("text_key")).alias("d")
    texts = source.join(few.alias("w"), F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d.text_key") == F.col("w.text_key")))
    # Repeated rows give one text more than once; any of them will do.
    return work.keep(texts.select("cls", "text").groupBy("cls").agg(F.first("text").alias("text")), "texts")

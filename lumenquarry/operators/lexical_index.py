"""A kept lexical index: positional postings, document frequencies and sizes, written once and read by every search."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import SUFFIXES
from .search import STOP_WORDS

#: Folders that postings lie in, by a hash of the term: searches read those of their terms.
BUCKETS = 64
#: Documents for each task that writes postings, and tokens that are inverted at a time.
TASK_DOCUMENTS, TOKENS = 5000, 1_000_000
#: Postings that are read from a table's lists at a time.
READ = 200_000
#: A row: a term in some hundred documents. Lists are bytes: of each document its id, length, number of places and attribute's number in ``names``, and all places.
_LISTS = {"docs": np.int64, "lengths": np.int64, "tfs": np.int32, "attributes": np.int32, "places": np.int32}
_POSTINGS = "term string, df bigint, tokens bigint, names array<string>, " + ", ".join(f"{c} binary" for c in _LISTS)


def _stemmed(token: str, stop: frozenset[str]) -> str | None:
    """functions.text.stem() of a token in Python; None for a stop word."""
    return None if token in stop else next((token[: -len(s)] for s in SUFFIXES if token.endswith(s) and len(token) >= len(s) + 3), token)


def _inverter(stop: list[str]):
    """A function of batches: documents in, a row for each term of some hundred documents out, with all its postings there."""
    token, words = re.compile("[a-z0-9]+"), frozenset(stop)

    def posted(docs: pa.Array, attributes: pa.Array, counts: list[int], flat: list[str]) -> pa.RecordBatch:
        raw = pa.array(flat, pa.string()).dictionary_encode()
        # Each distinct token is stemmed once; stop words leave no place behind.
        stems = pa.array([_stemmed(t, words) for t in raw.dictionary.to_pylist()], pa.string()).dictionary_encode()
        codes = stems.indices.fill_null(-1).to_numpy()[raw.indices.to_numpy()]
        of = np.repeat(np.arange(len(counts)), counts)[codes >= 0]
        codes = codes[codes >= 0]
        sizes = np.bincount(of, minlength=len(counts))
        position = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        # By term and document; what is equal keeps its order, so positions ascend.
        key = codes.astype(np.int64) * len(counts) + of
        order = np.argsort(key, kind="stable")
        starts = lambda x: np.flatnonzero(np.r_[True, x[1:] != x[:-1]][: len(x)])
        first = starts(key[order])  # of each posting, among tokens
        at, term = of[order[first]], codes[order[first]]
        heads = starts(term)  # of each term, among postings
        ends, edges = np.r_[first, len(key)], np.r_[heads, len(first)]
        named = attributes.dictionary_encode()
        numbers = named.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        flat_lists = {"docs": docs.to_numpy()[at], "lengths": sizes[at], "tfs": np.diff(ends), "attributes": numbers[at], "places": position[order]}
        columns = [stems.dictionary.take(pa.array(term[heads])), pa.array(np.diff(edges)), pa.array(np.diff(ends[edges])), pa.array([named.dictionary.to_pylist()] * len(heads), pa.list_(pa.string()))]
        for name, kind in _LISTS.items():
            # The values of one row after another are its bytes already: only where rows begin is told.
            begins = (ends[edges] if name == "places" else edges) * np.dtype(kind).itemsize
            columns.append(pa.Array.from_buffers(pa.binary(), len(heads), [None, pa.py_buffer(begins.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat_lists[name], kind))]))
        return pa.RecordBatch.from_arrays(columns, ["term", "df", "tokens", "names", *_LISTS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, attributes = batch.column("doc"), batch.column("attribute")
            begun, counts, flat = 0, [], []
            for i, text in enumerate(batch.column("text")):
                before = len(flat)
                flat += token.findall((text.as_py() or "").lower())
                counts.append(len(flat) - before)
                if len(flat) >= TOKENS or i == batch.num_rows - 1:
                    yield posted(docs.slice(begun, len(counts)), attributes.slice(begun, len(counts)), counts, flat)
                    begun, counts, flat = i + 1, [], []

    return run


def _reader(allowed: list | None, positions: bool):
    """A function of batches: rows of the postings' table in, postings out, those of ``allowed`` attributes alone."""
    wanted = None if allowed is None else pa.array([str(x) for x in allowed], pa.string())

    def read(part: pa.RecordBatch) -> pa.RecordBatch:
        flat = {c: np.frombuffer(b"".join(part.column(c).to_pylist()), kind) for c, kind in _LISTS.items() if positions or c != "places"}
        dfs, names = part.column("df").to_numpy(), part.column("names")
        row = np.repeat(np.arange(part.num_rows), dfs)
        offsets = names.offsets.to_numpy()
        none = flat["attributes"] < 0
        attribute = names.values.take(pa.array(flat["attributes"] + offsets[row], mask=none))
        columns = [part.column("term").take(pa.array(row)), pa.array(flat["docs"]), pa.array(flat["lengths"]), pa.array(flat["tfs"].astype(np.int64))]
        if positions:
            columns.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(flat["tfs"])], pa.int32()), pa.array(flat["places"])))
        out = pa.RecordBatch.from_arrays([*columns, attribute], ["term", "doc", "length", "tf", *(["positions"] if positions else []), "attribute"])
        return out if wanted is None else out.filter(pc.is_in(attribute, wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group = (np.cumsum(batch.column("df").to_numpy()) - 1) // READ
            edges = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1), batch.num_rows]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if b > a:
                    yield read(batch.slice(a, b - a))

    return run


class LexicalIndex:
    """An index in a folder: ``postings`` (_POSTINGS: terms with lists) by bucket of the term, ``terms`` (term, df), ``stats``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.n_docs, self.average_length = spark.read.parquet(f"{path}/stats").select("n", "average").head()

    @classmethod
    def build(cls, docs: DataFrame, path: str, doc: str = "doc_id", text: str = "text", attribute: str | None = None, stop: list[str] | None = None) -> LexicalIndex:
        """Indexes all documents; one with a null or empty text has no posting but counts. Document ids are integers; ``attribute`` is what filters ask for."""
        a = F.col(attribute).cast("string") if attribute else F.lit(None).cast("string")
        rows = docs.select(F.col(doc).cast("bigint").alias("doc"), F.col(text).alias("text"), a.alias("attribute"))
        found = rows.mapInArrow(_inverter(STOP_WORDS if stop is None else stop), _POSTINGS).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int"))
        # Dealt by bucket and a hash of the documents: the postings of a very common term meet as many tasks as the size asks for, and no second pass
        # over the texts is spent on finding ranges.
        n = docs.count()
        tasks = max(docs.sparkSession.sparkContext.defaultParallelism, math.ceil(n / TASK_DOCUMENTS))
        cut = F.pmod(F.xxhash64("docs"), F.lit(math.ceil(tasks / BUCKETS)))
        dealt = found.repartition(tasks, "bucket", cut).sortWithinPartitions("bucket", "term")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
        postings = docs.sparkSession.read.schema(f"bucket int, {_POSTINGS}").parquet(f"{path}/postings")
        postings.groupBy("term").agg(F.sum("df").alias("df")).write.mode("overwrite").parquet(f"{path}/terms")
        total = postings.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total"))  # one row
        total.select(F.lit(n).cast("bigint").alias("n"), (F.col("total") / F.lit(max(n, 1))).alias("average")).write.mode("overwrite").parquet(f"{path}/stats")
        return cls(docs.sparkSession, path)

    @property
    def terms(self) -> DataFrame:
        return self.spark.read.schema("term string, df bigint").parquet(f"{self.path}/terms")

    def postings(self, terms: DataFrame | None = None, allowed: list | None = None, positions: bool = True) -> DataFrame:
        """Postings of the terms of queries, or all. ``allowed`` attributes filter before anything is scored; where no cover is asked for, positions needn't be read."""
        rows = self.spark.read.schema(f"bucket int, {_POSTINGS}").parquet(f"{self.path}/postings")
        if terms is not None:
            wanted = terms.select("term", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int").alias("bucket")).distinct()
            rows = rows.join(wanted, ["bucket", "term"], "left_semi")
        columns = ["term", "df", "names", *[c for c in _LISTS if positions or c != "places"]]
        return rows.select(*columns).mapInArrow(_reader(allowed, positions), f"term string, doc bigint, length bigint, tf bigint, {'positions array<int>, ' if positions else ''}attribute string")


def cover_density(postings: DataFrame, terms: DataFrame, need: str = "any", weight: float = 0.1) -> DataFrame:
    """(query, doc, score): covers of a query in a document, weighed by how little else they hold, over ln(1 + length).

    A cover is a least interval of positions that satisfies the query; it counts ``weight`` / (1 + positions in it that aren't the query's). With
    ``need`` "any" one term satisfies a query, and each of its occurrences is a cover. With "all" a cover holds every term of the query (those of
    ``terms``), and documents without one of them have no score. A query's terms are distinct.
    """
    rows = terms.select("query", "term").join(postings, "term")
    if need == "any":
        found = rows.groupBy("query", "doc").agg(F.sum("tf").alias("covers"), F.first("length").alias("length"))
        return found.select("query", "doc", (weight * F.col("covers") / F.log(1 + F.col("length"))).alias("score"))
    sizes = terms.groupBy("query").agg(F.count_distinct("term").alias("m"))
    # A document's postings of one query: as many rows as the query has terms.
    one = rows.groupBy("query", "doc").agg(F.collect_list(F.struct("term", "positions")).alias("lists"), F.first("length").alias("length"), F.count("*").alias("had"))
    one = one.join(sizes, "query").where(F.col("had") == F.col("m"))
    placed = F.flatten(F.transform("lists", lambda x, no: F.transform(x["positions"], lambda p: F.struct(p.alias("pos"), no.alias("no")))))
    one = one.withColumn("at", F.array_sort(placed)).withColumn("at", F.transform("at", lambda e, i: F.struct(e["pos"].alias("pos"), e["no"].alias("no"), i.alias("i"))))
    return one.withColumn("sum", _covers(F.col("at"), F.col("m"))).select("query", "doc", (weight * F.col("sum") / F.log(1 + F.col("length"))).alias("score"))


def _covers(at: Column, m: Column) -> Column:
    """The sum of 1 / (1 + noise) over the least covers of all m terms, in one pass over sorted (pos, no, i).

    ``last`` has the newest entry of each term. The oldest of these begins the cover that ends here; it is least if it began later than the one before.
    """
    start = F.struct(F.array_repeat(F.lit(-1), m.cast("int")).alias("last"), F.lit(-1).alias("begun"), F.lit(0.0).alias("sum"))

    def step(acc: Column, e: Column) -> Column:
        last = F.transform(acc["last"], lambda x, j: F.when(j == e["no"], e["i"]).otherwise(x))
        begins = F.array_min(last)
        noise = e["pos"] - F.get(at, F.greatest(begins, F.lit(0)))["pos"] - (e["i"] - begins)
        fresh = begins > acc["begun"]
        return F.struct(last.alias("last"), F.greatest(begins, acc["begun"]).alias("begun"), (acc["sum"] + F.when(fresh, 1.0 / (1 + noise)).otherwise(0.0)).alias("sum"))

    return F.aggregate(at, start, step, lambda acc: acc["sum"])

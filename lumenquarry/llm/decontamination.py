"""Benchmark decontamination by a prefix-filtered set join.

Each benchmark item is cut into windows of ten words (an item with fewer words is one window). A document
contains a window only if it contains all of the window's shingles, so by the prefix principle with full containment one shingle
is necessary: the rarest. Shingles are ordered by their counts over all documents (ties by value); documents'
shingles are looked up among these prefixes alone. What is found is checked against the windows' ends (positional
and length bounds) and then word by word.

The windows go to the tasks in blocks of at most ``BLOCK`` windows, the proven bound of each broadcast; more
blocks mean more steps of the same narrow stage, and documents are never shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import unused

WINDOW, SHINGLE = 10, 3
#: Windows in one block: so few that a word's number has 21 bits.
BLOCK = 100_000
#: A-Z to a-z; the other ASCII characters that stand between words to spaces.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


def _windows(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for item, text in zip(batch["item_id"], batch["text"], strict=True):
                w = words(text)
                found = {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else ()
                out += [(item, b" ".join(x).decode("utf-8", "surrogatepass")) for x in found]
            yield pd.DataFrame(out, columns=["item", "window"])

    return run


@dataclass
class Block:
    """Windows as arrays of word numbers; 0 is any word that no window has."""

    vocabulary: dict[bytes, int]
    lengths: np.ndarray  # of each window
    cells: np.ndarray  # word numbers, a row for each window, padded with 0
    items: list[list[str]]  # of each window
    shingles: dict[int, np.ndarray]  # by shingle size: sorted keys of all shingles in the windows
    prefix: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] | None = None  # by size: sorted keys, windows, offsets


def _keys(ids: np.ndarray, size: int) -> np.ndarray:
    """At each position the shingle as a number; 0 if a word of it is in no window."""
    n = len(ids) - size + 1
    if n <= 0:
        return np.empty(0, np.int64)
    key, known = np.zeros(n, np.int64), np.ones(n, bool)
    for i in range(size):
        part = ids[i : i + n]
        key = (key << 21) | part
        known &= part > 0
    return np.where(known, key, 0)


def _block(rows: list, size: int, shingle: int) -> Block:
    vocabulary: dict[bytes, int] = {}
    lengths, cells, items = [], [], []
    for row in rows:
        w = row["window"].encode("utf-8", "surrogatepass").split()
        lengths.append(len(w))
        cells.append([vocabulary.setdefault(x, len(vocabulary) + 1) for x in w] + [0] * (size - len(w)))
        items.append(list(row["items"]))
    block = Block(vocabulary, np.array(lengths, np.int64), np.array(cells, np.int64).reshape(-1, size), items, {})
    by: dict[int, list] = {}
    for n, c in zip(lengths, block.cells, strict=True):
        by.setdefault(min(shingle, n), []).append(_keys(c[:n], min(shingle, n)))
    block.shingles = {k: np.unique(np.concatenate(v)) for k, v in by.items()}
    return block


def _order(block: Block, counts: dict[tuple[int, int], int], shingle: int) -> None:
    """Chooses the rarest shingle of each window as its prefix."""
    chosen: dict[int, list[tuple[int, int, int]]] = {}
    for i, (n, c) in enumerate(zip(block.lengths, block.cells, strict=True)):
        k = min(shingle, int(n))
        keys = _keys(c[:n], k).tolist()
        at = min(range(len(keys)), key=lambda j: (counts.get((k, keys[j]), 0), keys[j]))
        chosen.setdefault(k, []).append((keys[at], i, at))
    block.prefix = {}
    for k, rows in chosen.items():
        keys, windows, offsets = (np.array(x, np.int64) for x in zip(*sorted(rows), strict=True))
        block.prefix[k] = keys, windows, offsets


def _ids(texts, vocabulary: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all texts, with a 0 behind each text, and where each text begins."""
    get, parts, counts = vocabulary.get, [], []
    for text in texts:
        w = words(text)
        counts.append(len(w) + 1)
        parts.append(np.fromiter((get(x, 0) for x in w), np.int64, len(w)))
        parts.append(np.zeros(1, np.int64))
    ends = np.cumsum(counts)
    return np.concatenate(parts) if parts else np.empty(0, np.int64), np.concatenate(([0], ends))


def _counted(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block: Block = shared.value
        totals = {k: np.zeros(len(v), np.int64) for k, v in block.shingles.items()}
        for batch in batches:
            ids, _ = _ids(batch["text"], block.vocabulary)
            for k, known in block.shingles.items():
                keys = _keys(ids, k)
                keys = keys[keys > 0]
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                totals[k] += np.bincount(at[known[at] == keys], minlength=len(known))
        for k, known in block.shingles.items():
            some = totals[k] > 0
            yield pd.DataFrame({"size": k, "key": known[some], "n": totals[k][some]})

    return run


def _searched(shared, last: bool):
    """Adds a block's hits to the columns that earlier blocks have filled; the last one sums them up."""

    def found(block: Block, texts: list, old_hits: list, old_items: list):
        ids, begin = _ids(texts, block.vocabulary)
        hits, items = np.zeros(len(ids) + 1, np.int64), [set(x) for x in old_items]
        for k, (known, windows, offsets) in block.prefix.items():
            keys = _keys(ids, k)
            where = np.flatnonzero(keys)
            lo, hi = np.searchsorted(known, keys[where], "left"), np.searchsorted(known, keys[where], "right")
            n = hi - lo
            where, row = np.repeat(where, n), np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            window, start = windows[row], where - offsets[row]
            doc = np.searchsorted(begin, where, "right") - 1
            length = block.lengths[window]
            # Bounds: the window lies within its document.
            ok = (start >= begin[doc]) & (start + length <= begin[doc + 1] - 1)
            window, start, doc, length = window[ok], start[ok], doc[ok], length[ok]
            same = np.ones(len(window), bool)
            for j in range(block.cells.shape[1]):
                same &= (j >= length) | (ids[np.minimum(start + j, len(ids) - 1)] == block.cells[window, j])
            for w, d in set(zip(window[same].tolist(), doc[same].tolist(), strict=True)):
                items[d].update(block.items[w])
            np.add.at(hits, start[same], 1)
            np.add.at(hits, start[same] + length[same], -1)
        hit, masks = np.cumsum(hits)[: len(ids)] > 0, []
        for d, old in enumerate(old_hits):
            mask = hit[begin[d] : begin[d + 1] - 1]
            if old is not None:
                mask = mask | np.unpackbits(np.frombuffer(old, np.uint8), count=len(mask)).astype(bool)
            masks.append(mask)
        return (np.diff(begin) - 1).tolist(), masks, [sorted(x) for x in items]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = shared.value
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            old_hits, old_items = (columns.pop(x).to_pylist() for x in ("hits", "items"))
            n_words, masks, items = found(block, columns["text"].to_pylist(), old_hits, old_items)
            columns["n_words"] = pa.array(n_words, pa.int64())
            if last:
                columns["n_hit"] = pa.array([int(m.sum()) for m in masks], pa.int64())
                columns["n_items"] = pa.array([len(x) for x in items], pa.int64())
                columns["items_sha256"] = pa.array([hashlib.sha256(",".join(x).encode("utf-8", "surrogatepass")).hexdigest() for x in items], pa.string())
            else:
                columns["hits"] = pa.array([np.packbits(m).tobytes() if m.any() else None for m in masks], pa.binary())
                columns["items"] = pa.array(items, pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """The columns of docs (doc_id, text and any others) and n_words, n_hit, n_items, items_sha256, contaminated.

    A null or wordless text has no words and no hits; a null or wordless item has no window; items
    with one item_id count once; a null item_id counts as the empty string. Repeated rows get equal results. Where docs
    has a column of such a name, the added one ends in underscores.
    """
    spark, own = docs.sparkSession, docs
    # By position, so that no column's name can clash.
    docs = own.toDF(*[c if c == "text" else f"column {i}" for i, c in enumerate(own.columns)])
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    windows = items.mapInPandas(_windows(window), "item string, window string").groupBy("window").agg(F.collect_set("item").alias("items"))
    blocks = max(1, -(-windows.count() * 5 // (4 * block)))  # a fifth less than `block` each on average
    out = docs.withColumns({"n_words": F.lit(None).cast("bigint"), "hits": F.lit(None).cast("binary"), "items": F.expr("array()").cast("array<string>")})
    numbered = windows.withColumn("block", F.pmod(F.xxhash64("window"), F.lit(blocks)))
    for i in range(blocks):
        shared, kind = _prepared(spark, docs, numbered.where(F.col("block") == i).collect(), window, shingle), T.StructType(docs.schema.fields + [T.StructField("n_words", T.LongType())])
        if i < blocks - 1:
            out = out.mapInArrow(_searched(shared, False), T.StructType(kind.fields + [T.StructField("hits", T.BinaryType()), T.StructField("items", T.ArrayType(T.StringType()))]))
        else:
            out = out.mapInArrow(_searched(shared, True), T.StructType(kind.fields + [T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()), T.StructField("items_sha256", T.StringType())]))
    out = out.withColumn("contaminated", F.col("n_hit") > 0)
    return out.toDF(*own.columns, *[unused(own, c) for c in out.columns[len(own.columns) :]])


def _prepared(spark: SparkSession, docs: DataFrame, rows: list, window: int, shingle: int):
    """A broadcast block, its shingles ordered by their counts over all documents."""
    block = _block(sorted(rows, key=lambda r: r["window"]), window, shingle)
    counts = {}
    if rows:
        shared = spark.sparkContext.broadcast(block)
        counted = docs.select("text").mapInPandas(_counted(shared), "size int, key bigint, n bigint").groupBy("size", "key").agg(F.sum("n").alias("n"))
        counts = {(r["size"], r["key"]): r["n"] for r in counted.collect()}  # at most one row for each shingle of the block
        shared.unpersist()
    _order(block, counts, shingle)
    return spark.sparkContext.broadcast(block)


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, with all their columns, that no window of the benchmark touches."""
    # By position, so that no column's name can clash with what contamination() adds.
    inner = docs.toDF(*[c if c in ("doc_id", "text") else f"column {i}" for i, c in enumerate(docs.columns)])
    return contamination(inner, benchmark).where("not contaminated").select(*inner.columns).toDF(*docs.columns)

"""Tokenising and packing by best-fit decreasing.

Documents are tokenised and cut into full windows and a rest. There are at most ``size`` different lengths, so
packing needs only the number of pieces of each length: the driver runs best-fit decreasing over these counts (a bounded table,
whatever the corpus), with a segment tree over remaining capacity that finds the tightest open window. All
windows that look alike are filled in one step, with the same result as one piece after the other. What comes out are
ranges: pieces number a to b of one length go to windows c to d. Pieces are numbered on the cluster, within
buckets of bounded size, and find their window by their number.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace

SIZE, END = 2048, 1
#: Pieces of one length that one task numbers at a time, about.
BUCKET = 50_000
CACHED_CHUNKS, LONG_CHUNK = 1_200_000, 64
#: Texts with one of these are neither lower-cased nor split by Python's rules beforehand.
_ODD = re.compile("[\x1c-\x1f̀-\U0010ffff]|<\\|")
#: Such among ASCII characters.
_ODD_ASCII = "\x1c", "\x1d", "\x1e", "\x1f", "<|"
_BLANK = re.compile("[ \t\n\r]+")


def _plain(text: str) -> bool:
    return not any(x in text for x in _ODD_ASCII) if text.isascii() else _ODD.search(text) is None


class Encoder:
    """Token ids as little-endian uint32 bytes, with a cache of what stands between blanks.

    This tokenizer drops white space before it looks for words, so the ids of a text are those of its
    chunks. Chunks not met before are encoded together, parted by a special token.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.t, self.cache = Tokenizer.from_file(path), {}
        self.mark_text = "<|endoftext|>"
        self.mark = self.t.token_to_id(self.mark_text)

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [(t.lower().split() if _plain(t) else [x for x in _BLANK.split(t) if x]) for t in texts]
        new = [x for x in set(chain.from_iterable(split)) if x not in self.cache]
        if len(self.cache) + len(new) > CACHED_CHUNKS:
            self.cache.clear()
            new = list(set(chain.from_iterable(split)))
        known = self.cache
        known.update(self._fresh([x for x in new if len(x) <= LONG_CHUNK]))
        if long := [x for x in new if len(x) > LONG_CHUNK]:
            known = {x: known[x] for x in set(chain.from_iterable(split)) - set(long)} | self._fresh(long)
        return [b"".join(map(known.__getitem__, x)) for x in split]

    def _fresh(self, chunks: list[str]) -> dict[str, bytes]:
        plain, out = [x for x in chunks if "<|" not in x], {}
        for x in chunks:
            if "<|" in x:
                out[x] = np.array(self.t.encode(x, add_special_tokens=False).ids, "<u4").tobytes()
        groups = [plain[i : i + 256] for i in range(0, len(plain), 256)]
        for group, found in zip(groups, self.t.encode_batch_fast([self.mark_text.join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, "<u4")
            ends = [*np.flatnonzero(ids == self.mark).tolist(), len(ids)]
            start = 0
            for x, end in zip(group, ends, strict=True):
                out[x] = ids[start:end].tobytes()
                start = end + 1
        return out


@cache
def encoder_of(path: str) -> Encoder:
    """One for all tasks that a Python worker runs, so that its cache stays."""
    return Encoder(path)


def _tokenised(path: str, size: int, with_ids: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, last = encoder_of(path), np.array([END], "<u4").tobytes()
        for batch in batches:
            ids, rows = batch["doc_id"].tolist(), []
            for i in range(0, len(batch), 256):
                texts = [t or "" for t in batch["text"].iloc[i : i + 256]]
                for doc, found in zip(ids[i : i + 256], encoder.encode(texts), strict=True):
                    found += last
                    n = len(found) // 4
                    for start in range(0, n, size):
                        piece = found[4 * start : 4 * (start + size)]
                        rows.append((doc, start, len(piece) // 4, zlib.crc32(piece), n, piece if with_ids else None))
            out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])
            yield out if with_ids else out.drop(columns="ids")

    return run


def pieces(docs: DataFrame, tokenizer: str, size: int = SIZE, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens[, ids]: full windows and a rest of each document.

    A null text is empty; every document, also an empty one, ends with the id 1.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    # Nullable pandas integers would become floats: ids that may be null go as text.
    source = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    out = source.mapInPandas(_tokenised(tokenizer, size, with_ids), "doc_id string, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + ", ids binary" * with_ids)
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


class CapacityTree:
    """A segment tree over capacities 0 to size: which have open windows, and which such capacity is the least from a given one on."""

    def __init__(self, size: int):
        self.leaves = 1
        while self.leaves <= size:
            self.leaves *= 2
        self.open = [False] * (2 * self.leaves)

    def set(self, capacity: int, value: bool) -> None:
        i = capacity + self.leaves
        self.open[i] = value
        while i > 1:
            i //= 2
            self.open[i] = self.open[2 * i] or self.open[2 * i + 1]

    def least_from(self, capacity: int) -> int | None:
        """Climbs to the first open subtree on the right, then goes down to its leftmost open leaf."""
        i = capacity + self.leaves
        if self.open[i]:
            return capacity
        while i > 1:
            if i % 2 == 0 and self.open[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.leaves
            i //= 2
        return None


def best_fit_decreasing(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first, pieces, per_window, window, offset): where ``pieces`` pieces of one length from number ``first`` on go.

    Piece first + i goes to window ``window + i // per_window``, ``offset + i % per_window * length`` from its start.
    """
    tree, alike, plan, windows = CapacityTree(size), {}, [], 0
    for length in sorted(counts, reverse=True):
        first, left = 0, counts[length]
        while left:
            capacity = tree.least_from(length)
            if capacity is None:
                per = size // length
                n = -(-left // per)
                capacity, start = size, windows
                windows += n
            else:
                start, n = alike[capacity].pop()
                if not alike[capacity]:
                    tree.set(capacity, False)
                per = capacity // length
            used = min(n, -(-left // per))
            here = min(left, used * per)
            plan.append((length, first, here, per, start, size - capacity))
            full, rest = divmod(here, per)
            for at, many, held in ((start, full, per), (start + full, 1 if rest else 0, rest), (start + used, n - used, 0)):
                if many and (remaining := capacity - held * length):
                    alike.setdefault(remaining, []).append((at, many))
                    tree.set(remaining, True)
            first, left = first + here, left - here
    return plan


def pack(cut: DataFrame, size: int = SIZE, work: Workspace | None = None) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, start, length, ids_crc32, doc_tokens and others).

    Pieces longer than ``size`` are an error. Equal pieces are interchangeable. An empty table stays empty.
    """
    work = work or Workspace(cut.sparkSession, "packing")
    cut = work.keep(cut, "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `size` rows
    if counts and max(counts) > size:
        raise ValueError(f"a piece is longer than {size}")
    steps: dict[int, list] = {}
    for length, *step in best_fit_decreasing(counts, size):
        steps.setdefault(length, []).append(tuple(step))
    step_type = T.StructType([T.StructField(x, T.LongType()) for x in ("first", "pieces", "per", "window", "at")])
    plan = cut.sparkSession.createDataFrame(
        [(length, max(1, -(-counts[length] // BUCKET)), s) for length, s in steps.items()],
        T.StructType([T.StructField("length", T.LongType()), T.StructField("buckets", T.LongType()), T.StructField("steps", T.ArrayType(step_type))]),
    )
    plan = F.broadcast(plan)  # at most `size` rows
    bucket = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "doc_tokens"), F.col("buckets"))
    dealt = cut.join(plan.select("length", "buckets"), "length").withColumn("bucket", bucket).drop("buckets")
    sizes = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    within = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")) - 1
    numbered = dealt.withColumn("within", within).join(before.select("length", "bucket", F.coalesce("before", F.lit(0)).alias("before")), ["length", "bucket"])
    numbered = numbered.withColumn("number", F.col("before") + F.col("within")).join(plan.select("length", "steps"), "length")
    step = F.filter("steps", lambda s: (s["first"] <= F.col("number")) & (F.col("number") < s["first"] + s["pieces"]))[0]
    numbered = numbered.withColumn("step", step).withColumn("i", F.col("number") - F.col("step.first"))
    where = {"sequence_id": F.col("step.window") + F.floor(F.expr("i div step.per")), "offset": F.col("step.at") + F.expr("i % step.per") * F.col("length")}
    return numbered.withColumns(where).select(*cut.columns, "sequence_id", "offset")


def unpacked(packed: DataFrame) -> DataFrame:
    """(doc_id, ids): documents' ids again, from packed pieces that carry ``ids`` (for doc_ids that don't repeat)."""
    parts = F.sort_array(F.collect_list(F.struct("start", "ids")))
    return packed.groupBy("doc_id").agg(F.aggregate(parts, F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["ids"])).alias("ids"))

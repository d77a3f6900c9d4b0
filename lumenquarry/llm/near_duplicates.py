"""MinHash near-duplicates by a multi-index Hamming join.

A document's set is its distinct 5-word shingles. Documents with equal sets form a class; from then on
one row stands for a class, so copies are never paired. Each class has a signature of ``VALUES`` b-bit
MinHash values (b = ``BITS``). The first ``CHUNKS * CHUNK`` of them are cut into chunks; of two signatures that differ in
at most ``CHUNKS * (ERRORS + 1) - 1`` of these values, some chunk differs in at most ERRORS (pigeonhole).
All ways to leave ERRORS values of a chunk out are enumerated as keys, so an equi-join on keys finds every
such pair. At a similarity of 0.75 a pair differs in 14 of 56 values on average (standard deviation 3.2);
27 are guaranteed, and the join misses a pair only if all 14 chunks have two errors or more: 7e-9.

Pairs are never listed where a family of similar texts is large. A bucket is all classes with one key. First every member
of a bucket is joined with the bucket's least class, and those that neither sizes nor signatures rule out are contracted.
Buckets that still hold different groups are listed as pairs if they are small and contracted as a whole if they are
large. That gives coarse groups, which hold every pair to be confirmed; they are confirmed on full sets, made again from
whole texts. Each coarse group is cut by set size into blocks of bounded weight, and all pairs within a block
are compared. A group of several blocks goes on with one representative of what each block linked, in new blocks, as long as that
links more; only what then isn't linked with the group's largest part is compared with all blocks. So a text of a
family that holds together is shuffled a bounded number of times. Nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, text_or_empty
from .families import Comparison, grouped, int64_lists
from .graph import connected_components
from .shingles import MinHash, WordHashes, mix64, set_digest, shingle_hashes

WIDTH, PERCENT = 5, 75
VALUES, BITS = 64, 16
CHUNKS, CHUNK, ERRORS = 14, 4, 1
#: Signatures are compared by the low SKETCH bits of each value. At 75 % a pair differs in 15 of 64 of these on average (standard
#: deviation 3.4), and above FAR in one of a million.
SKETCH, FAR = 4, 32
#: Buckets of at most so many members are listed as pairs; that is so many pairs for each member at most.
SMALL = 32


def chunk_keys(signatures: np.ndarray) -> np.ndarray:
    """64-bit keys of each row of b-bit values: for each chunk, one for each way to leave ERRORS of its values out."""
    s = signatures.astype(np.uint64)
    out = []
    for c in range(CHUNKS):
        for way, left in enumerate(combinations(range(CHUNK), CHUNK - ERRORS)):
            key = np.full(len(s), c * 64 + way + 1, np.uint64)
            for i in left:
                key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + s[:, c * CHUNK + i])
            out.append(key)
    return np.stack(out, axis=1) if len(s) else np.empty((0, 0), np.uint64)


def packed(signatures: np.ndarray) -> np.ndarray:
    """The low SKETCH bits of VALUES values of each row, as int64 words."""
    low = (signatures & np.uint32(2**SKETCH - 1)).astype(np.uint64).reshape(len(signatures), VALUES * SKETCH // 64, 64 // SKETCH)
    shifts = np.arange(0, 64, SKETCH, dtype=np.uint64)
    return np.bitwise_or.reduce(low << shifts, axis=2).view(np.int64)


def distance(a: Column, b: Column) -> Column:
    """In how many of VALUES values of SKETCH bits two packed signatures differ."""
    ones = F.lit(sum(1 << i for i in range(0, 64, SKETCH)))
    total = None
    for i in range(VALUES * SKETCH // 64):
        x = F.element_at(a, i + 1).bitwiseXOR(F.element_at(b, i + 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(ones)
        total = F.bit_count(x) if total is None else total + F.bit_count(x)
    return total


def _signed(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, minhash = WordHashes(), MinHash(VALUES)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                sets = [shingle_hashes(t, width, hashes) for t in part.column("text").to_pylist()]
                full = [i for i, s in enumerate(sets) if len(s)]
                values = np.array([minhash.signature(sets[i]) for i in full], np.uint32).reshape(-1, VALUES) & np.uint32(2**BITS - 1)
                columns = {
                    "doc_id": part.column("doc_id"), "text_key": part.column("text_key"), "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                    "cls": pa.array([set_digest(s) if len(s) else None for s in sets], pa.binary()),
                    "sketch": int64_lists(packed(values), full, len(sets)), "keys": int64_lists(chunk_keys(values).view(np.int64), full, len(sets)),
                }
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def _shared(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of a with all of b. Shingles that only one side has take no part."""
    known = np.intersect1d(np.concatenate(a), np.concatenate(b))
    rows = []
    for side in (a, b):
        flat, owner = np.concatenate(side), np.repeat(np.arange(len(side)), [len(x) for x in side])
        at = np.minimum(np.searchsorted(known, flat), max(len(known) - 1, 0))
        ok = known[at] == flat if len(known) else np.zeros(len(flat), bool)
        order = np.argsort(at[ok], kind="stable")
        rows.append((at[ok][order], owner[ok][order]))
    out = np.zeros((len(a), len(b)), np.float32)
    for start in range(0, len(known), 2048):
        parts = []
        for (at, owner), side in zip(rows, (a, b), strict=True):
            lo, hi = np.searchsorted(at, (start, start + 2048))
            m = np.zeros((len(side), min(2048, len(known) - start)), np.float32)
            m[owner[lo:hi], at[lo:hi] - start] = 1
            parts.append(m)
        out += parts[0] @ parts[1].T
    return out


def _similar(a: list[np.ndarray], b: list[np.ndarray], percent: int) -> np.ndarray:
    """Which sets of a are linked with which of b."""
    both = _shared(a, b)
    n, m = np.array([len(x) for x in a], np.float64)[:, None], np.array([len(x) for x in b], np.float64)[None, :]
    return 100 * both >= percent * (n + m - both)


def _within(width: int, percent: int):
    """(component, block, cls, n, root) for the classes of a block: root is the least class that its links reach."""
    hashes = WordHashes()

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("cls")
        sets = [shingle_hashes(t, width, hashes) for t in table.column("text").to_pylist()]
        root = np.full(len(sets), -1)
        if len(sets) > 1:
            ok = _similar(sets, sets, percent)
            for i in range(len(sets)):
                if root[i] < 0:  # all that i reaches
                    new = np.zeros(len(sets), bool)
                    new[i] = True
                    while new.any():
                        root[new] = i
                        new = ok[new].any(axis=0) & (root < 0)
        else:
            root[:] = 0
        cls = table.column("cls").to_numpy()
        return table.select(["component", "block", "cls", "n"]).append_column("root", pa.array(cls[root], pa.int64()))

    return run


def _between(width: int, percent: int):
    """Links (u, v) between what the roots of one block stand for and those of another."""
    hashes = WordHashes()

    def run(table: pa.Table) -> pa.Table:
        left = table.column("left").to_numpy(zero_copy_only=False)
        right = table.column("right").to_numpy(zero_copy_only=False)
        sets = [shingle_hashes(t, width, hashes) for t in table.column("text").to_pylist()]
        root, x, y = table.column("root").to_numpy(), np.flatnonzero(left), np.flatnonzero(right)
        pairs = np.empty((0, 2), np.int64)
        if len(x) and len(y):
            i, j = np.nonzero(_similar([sets[k] for k in x], [sets[k] for k in y], percent) & (root[x][:, None] != root[y][None, :]))
            pairs = np.unique(np.stack([root[x[i]], root[y[j]]], axis=1), axis=0)
        return pa.table({"u": pa.array(pairs[:, 0], pa.int64()), "v": pa.array(pairs[:, 1], pa.int64())})

    return run


def signatures(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, text_key, n_shingles, cls, sketch, keys; the last three are null for a document without words."""
    rows = docs.select("doc_id", "text", F.xxhash64(text_or_empty("text")).alias("text_key"))
    return rows.mapInArrow(_signed(width), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_key bigint, n_shingles bigint, cls binary, sketch array<bigint>, keys array<bigint>")


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """A row for each row of docs: doc_id, text_key, n_shingles, component_id, kept, first_of_group.

    docs has doc_id and text; other columns aren't read. component_id is the smallest doc_id of the
    documents that confirmed links reach. A document without words, or with a null text, is linked with
    nothing and is its own component. A null doc_id is never a component's name unless the component has no
    other; repeated rows belong to one class. kept is doc_id = component_id (also for two nulls);
    first_of_group is true for all rows with one (doc_id, text_key) in each component, for callers
    that want a single survivor where doc_ids repeat. An empty table gives no rows.
    """
    compare = Comparison(_within(width, percent), _between(width, percent), percent)
    return grouped(docs, signatures(docs, width), ["sketch", "keys"], lambda classes, work: _coarse_groups(classes, work, percent), compare, "near-duplicates")


def _coarse_groups(classes: DataFrame, work: Workspace, percent: int) -> DataFrame:
    """(cls, component) such that two classes that share a key, and that nothing rules out, have one component. Classes alone are left out."""
    members = classes.select("cls", F.explode("keys").alias("key"))
    buckets = work.keep(members.groupBy("key").agg(F.count("*").alias("size"), F.min("cls").alias("lead")).where("size > 1"), "buckets")
    members = work.keep(members.join(buckets, "key"), "members")
    light = classes.select("cls", "n", "sketch")
    lead = light.select(F.col("cls").alias("lead"), F.col("n").alias("m"), F.col("sketch").alias("other"))
    stars = members.where("cls <> lead").select("cls", "lead").distinct().join(light, "cls").join(lead, "lead")
    stars = stars.where(_near(F.col("n"), F.col("sketch"), F.col("m"), F.col("other"), percent)).select(F.col("cls").alias("u"), F.col("lead").alias("v"))
    stars = work.keep(connected_components(stars, work, "stars").withColumnRenamed("node", "cls"), "stars")
    rows = work.keep(members.join(stars, "cls", "left").select("key", "cls", F.coalesce("component", "cls").alias("component")), "placed")
    spread = rows.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size")).where("lo < hi")
    spread = work.keep(spread.select("key", "lo", "size"), "spread")
    apart = rows.join(spread, "key")
    whole = apart.where((F.col("size") > SMALL) & (F.col("component") > F.col("lo"))).select(F.col("component").alias("u"), F.col("lo").alias("v")).distinct()
    few = work.keep(apart.where(F.col("size") <= SMALL).join(light, "cls").select("key", "cls", "component", "n", "sketch"), "few")
    a, b = few.alias("a"), few.alias("b")
    near = _near(F.col("a.n"), F.col("a.sketch"), F.col("b.n"), F.col("b.sketch"), percent)
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.component") < F.col("b.component")) & near)
    pairs = pairs.select(F.col("b.component").alias("u"), F.col("a.component").alias("v")).distinct()
    ends = connected_components(whole.unionByName(pairs), work, "groups").toDF("component", "end")
    found = rows.select("cls", "component").distinct().join(ends, "component", "left").select("cls", F.coalesce("end", "component").alias("component"))
    found = work.keep(found, "coarse")
    sizes = found.groupBy("component").agg(F.count("*").alias("size")).where("size > 1").select("component")
    return found.join(sizes, "component", "left_semi")


def _near(n: Column, sketch: Column, m: Column, other: Column, percent: int) -> Column:
    """Set sizes and signatures that don't rule a link out."""
    return (F.lit(100) * F.least(n, m) >= F.lit(percent) * F.greatest(n, m)) & (distance(sketch, other) <= FAR)


def first_documents(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The documents, with all their columns, of which each is the one that stays of its group.

    It has the group's smallest doc_id and, where rows share this id, the smallest hash of its text; of rows that share both,
    one stays. Documents without words are groups of their own, but for repeated rows.
    """
    work = Workspace(docs.sparkSession, "first-documents")
    stay = near_duplicates(docs, width, percent).where("first_of_group").select(F.col("doc_id").alias("stay_id"), F.col("text_key").alias("stay_key")).distinct()
    stay = work.keep(stay, "stay").alias("s")
    inner = docs.toDF(*[c if c in ("doc_id", "text") else f"column {i}" for i, c in enumerate(docs.columns)])
    keyed = inner.withColumn("text_key", F.xxhash64(text_or_empty("text"))).alias("d")
    found = keyed.join(stay, F.col("d.text_key").eqNullSafe(F.col("s.stay_key")) & F.col("d.doc_id").eqNullSafe(F.col("s.stay_id")), "left_semi")
    one = F.row_number().over(Window.partitionBy("text_key", "doc_id").orderBy("text_key"))
    return found.withColumn("row", one).where("row = 1").select(*inner.columns).toDF(*docs.columns)

"""Exact Jaccard join of shingle sets that skips parts of index lists and derives answers from answers.

Shingles have one order for all sets: the rarer first, by a table of counts of hashed shingles over the whole corpus, whose size is fixed.
Two linked sets share a shingle within their prefixes (their first ``n - ceil(0.8 n) + 1`` shingles), so prefixes alone are
indexed. Documents with equal sets form a class, which is indexed once.

An index list is the classes whose prefix has one shingle, with their sizes and the shingle's position. A list is cut into blocks by size band
and by position: where a pair's first common shingle stands at positions i and j of sets of n and m shingles, at most
``1 + min(n - 1 - i, m - 1 - j)`` can be common, so the smaller set has it early, and blocks that can't reach the needed overlap
are skipped as wholes, without looking at their pairs. Parity bitmaps give another exact bound: each differing shingle flips one bit at most.
That leaves coarse groups, in which pairs are confirmed on full sets, block by block (``families``).

Within a block of sets, an index with positions tells which sets can have answers at all. Of these, the first of a family gets its overlaps with all
sets from full lists. A set that is highly similar to one with known overlaps derives its own: the lists of the shingles that only it
has are added, those of shingles that only the other has are taken off. Whatever is linked already is asked for no answer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, text_or_empty
from .families import Comparison, grouped
from .graph import connected_components
from .shingles import WordHashes, set_digest, shingle_hashes

WIDTH, PERCENT = 5, 80
#: Counters of hashed shingles: 2 ** SLOTS of them, summed in slices and held in every task as one byte each.
SLOTS, SLICES = 20, 64
#: A set's parity bitmap has a power of two bits: as many as shingles or more, and this at least.
BITMAP = 512
#: Index lists of at most so many classes are listed as pairs, in two numbers each.
SMALL = 256
#: Bytes of a shingle that index lists are made by, and entries of lists that one task brings together.
TOKEN, ENTRIES = 5, 1_000_000
#: Texts of an Arrow batch that are taken apart at a time, and words whose hashes a worker keeps.
PART, WORDS = 250, 100_000
#: A set derives its overlaps from those of another at this similarity in percent.
CLOSE = 85


def needed(n: Column | np.ndarray, m: Column | np.ndarray, percent: int = PERCENT):
    """The overlap that linked sets of n and m shingles have at least, before rounding up: 100 * overlap >= percent * (n + m - overlap)."""
    return percent * (n + m) / (100 + percent)


def prefix(n, percent: int = PERCENT):
    """The length of the prefix of a set of n shingles."""
    return n - (-(-percent * n // 100)) + 1


# --- Counts of shingles over the corpus


def _counted(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts = WordHashes(WORDS), np.zeros(2**SLOTS, np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, PART):
                sets = [shingle_hashes(t, width, hashes) for t in batch.column("text").slice(start, PART).to_pylist()]
                counts += np.bincount(slots(np.concatenate(sets)), minlength=len(counts))
        parts = counts.reshape(SLICES, -1)
        full = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([parts[i].tobytes() for i in full], pa.binary())], ["slice", "counts"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of a task's slices: one row for each slice, however many come."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, counts in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            part = np.frombuffer(counts, np.int64)
            total[i] = total[i] + part if i in total else part
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["slice", "counts"])


def slots(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - SLOTS)).astype(np.int64)


def shingle_ranks(docs: DataFrame, width: int = WIDTH) -> np.ndarray:
    """A byte for each slot: how often its shingles stand in the corpus, in steps of a quarter of a doubling. 2 ** SLOTS bytes, whatever the corpus."""
    parts = docs.select("text").mapInArrow(_counted(width), "slice int, counts binary")
    rows = parts.repartition(SLICES, "slice").mapInArrow(_summed, "slice int, counts binary").collect()  # SLICES rows of a fixed size
    counts = np.zeros((SLICES, 2**SLOTS // SLICES), np.int64)
    for r in rows:
        counts[r["slice"]] = np.frombuffer(r["counts"], np.int64)
    return np.minimum(4 * np.log2(counts.reshape(-1) + 1), 255).astype(np.uint8)


# --- Sets, prefixes and bitmaps


def ordered(shingles: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """A set's shingles, the rarer first."""
    return shingles[np.lexsort((shingles, ranks[slots(shingles)]))]


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """The parity of how many shingles fall on each of its bits, as int64 words. Both halves of one, combined by exclusive or, are the next smaller one."""
    bits = max(BITMAP, 1 << (len(shingles) - 1).bit_length())
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def prefix_length(n: Column, percent: int = PERCENT) -> Column:
    return n - F.ceil(F.lit(percent) * n / 100) + 1


def _listed(arrays: list[np.ndarray]) -> pa.Array:
    """int64 arrays as lists; an empty one is an empty list."""
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in arrays]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays), pa.int64()))


def tokens(shingles: np.ndarray) -> np.ndarray:
    """What index lists know of shingles: their first TOKEN bytes, one row each. Different shingles with equal tokens make a list longer, nothing else."""
    return shingles.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :TOKEN]


def _numbers(packed: np.ndarray) -> np.ndarray:
    """Tokens as numbers."""
    wide = np.zeros((len(packed) // TOKEN, 8), np.uint8)
    wide[:, 8 - TOKEN :] = packed.reshape(-1, TOKEN)
    return wide.view(">u8").reshape(-1).astype(np.int64)


def _signed(width: int, percent: int, ranks: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes(WORDS)
        for batch in batches:
            for start in range(0, batch.num_rows, PART):
                part = batch.slice(start, PART)
                sets = [shingle_hashes(t, width, hashes) for t in part.column("text").to_pylist()]
                firsts = [tokens(ordered(s, ranks)[: prefix(len(s), percent)]).tobytes() if len(s) else b"" for s in sets]
                columns = {
                    "doc_id": part.column("doc_id"), "text_key": part.column("text_key"), "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                    "cls": pa.array([set_digest(s) if len(s) else None for s in sets], pa.binary()),
                    "bits": _listed([bitmap(s) if len(s) else s.view(np.int64) for s in sets]), "firsts": pa.array(firsts, pa.binary()),
                }
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def signed(docs: DataFrame, ranks: np.ndarray, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_key, n_shingles, cls, bits, firsts of each row; firsts has the tokens of the prefix in order, none for a document without words."""
    rows = docs.select("doc_id", "text", F.xxhash64(text_or_empty("text")).alias("text_key"))
    return rows.mapInArrow(_signed(width, percent, ranks), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_key bigint, n_shingles bigint, cls binary, bits array<bigint>, firsts binary")


# --- Index lists over all classes


def _bits_allow(n: Column, a: Column, m: Column, b: Column, percent: int) -> Column:
    """Sizes and parity bitmaps don't rule a link out: no more bits differ than shingles may. Sizes of linked sets differ so little that the
    larger bitmap is at most twice as long, and is folded."""
    sizes = F.lit(100) * F.least(n, m) >= F.lit(percent) * F.greatest(n, m)
    xor = lambda x, y: x.bitwiseXOR(y)
    short = F.least(F.size(a), F.size(b))
    folded = lambda x: F.when(F.size(x) > short, F.zip_with(F.slice(x, 1, short), F.slice(x, short + 1, short), xor)).otherwise(x)
    ones = F.aggregate(F.zip_with(folded(a), folded(b), xor), F.lit(0), lambda s, x: s + F.bit_count(x))
    return sizes & (ones <= n + m - F.lit(2) * F.ceil(needed(n, m, percent)))


def _band(n: Column, percent: int) -> Column:
    """Sizes that differ by less than the similarity allows stand in one band or in neighbouring ones."""
    return F.floor(F.log(n.cast("double")) / F.lit(float(np.log(100 / percent))) + 1e-9).cast("int")


def _narrow(x: np.ndarray) -> bytes:
    """Numbers in as few bytes each as all of them need; how many tells their count."""
    return x.astype(np.min_scalar_type(int(x.max()))).tobytes()


def _widened(packed: bytes, count: int) -> np.ndarray:
    return np.frombuffer(packed, f"u{len(packed) // count}").astype(np.int64)


def _packed_entries(buckets: int):
    """(bucket, tokens, base, cls, n, i): what the prefixes of a batch of classes put into the index lists of one bucket, in some ten bytes an entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_cls = batch.column("cls").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(all_cls >> 32)) + 1), batch.num_rows]  # classes of one part are told by small numbers
            for begin, end in zip(edges[:-1], edges[1:], strict=True):
                part = batch.slice(begin, end - begin)
                firsts = part.column("firsts").to_pylist()
                lengths = np.array([len(x) // TOKEN for x in firsts], np.int64)
                token = _numbers(np.frombuffer(b"".join(firsts), np.uint8))
                if not len(token):
                    continue
                cls = part.column("cls").to_numpy()
                base = int(cls.min())
                i = np.arange(len(token)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                of, n = np.repeat(cls - base, lengths), np.repeat(part.column("n").to_numpy(), lengths)
                bucket = token % buckets
                order = np.argsort(bucket, kind="stable")
                cuts = np.concatenate(([0], np.flatnonzero(np.diff(bucket[order])) + 1, [len(order)]))
                rows = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([bucket[x[0]] for x in rows], pa.int32()), pa.array([tokens((token[x] << (64 - 8 * TOKEN)).view(np.uint64)).tobytes() for x in rows], pa.binary()),
                        pa.array([base] * len(rows), pa.int64()), *[pa.array([_narrow(y[x]) for x in rows], pa.binary()) for y in (of, n, i)],
                    ],
                    ["bucket", "tokens", "base", "cls", "n", "i"],
                )

    return run


def _brought_together(table: pa.Table) -> pa.Table:
    """The entries of a bucket's lists that have several."""
    token = _numbers(np.frombuffer(b"".join(table.column("tokens").to_pylist()), np.uint8))
    counts = [len(x) // TOKEN for x in table.column("tokens").to_pylist()]
    cls, n, i = (np.concatenate([_widened(x, c) for x, c in zip(table.column(name).to_pylist(), counts, strict=True)]) for name in ("cls", "n", "i"))
    cls = cls + np.repeat(table.column("base").to_numpy(), counts)
    order = np.lexsort((cls, token))  # the first of a list is its lead
    starts = np.flatnonzero(np.diff(token[order], prepend=-1))
    sizes = np.diff(np.append(starts, len(order)))
    order, size, lead = order[np.repeat(sizes > 1, sizes)], np.repeat(sizes, sizes), np.repeat(cls[order[starts]], sizes)
    return pa.table({"token": token[order], "cls": cls[order], "n": n[order], "i": i[order].astype(np.int32), "size": size[size > 1], "lead": lead[size > 1]})


def index_lists(classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(token, cls, n, i, size, lead) of all lists of several classes, shuffled once: i is the token's place in the prefix, lead the list's least class."""
    n = F.col("n")
    entries = classes.agg(F.coalesce(F.sum(prefix_length(n, percent)), F.lit(0))).head()[0]
    packed = classes.select("cls", "n", "firsts").mapInArrow(_packed_entries(max(1, -(-entries // ENTRIES))), "bucket int, tokens binary, base bigint, cls binary, n binary, i binary")
    return packed.groupBy("bucket").applyInArrow(_brought_together, "token bigint, cls bigint, n bigint, i int, size bigint, lead bigint")


def coarse_groups(classes: DataFrame, work: Workspace, percent: int = PERCENT) -> DataFrame:
    """(cls, component): two classes that some index list doesn't rule out as a pair have one component. Classes alone are left out."""
    # Early: a set of this size and a larger one can have their first common shingle here.
    early = F.col("i") <= F.col("n") - F.ceil(needed(F.col("n"), F.col("n"), percent))
    members = work.keep(index_lists(classes, percent).withColumns({"early": early, "band": _band(F.col("n"), percent)}), "members")
    light = classes.select("cls", "n", "bits")
    lead = light.select(F.col("cls").alias("lead"), F.col("n").alias("m"), F.col("bits").alias("other"))
    stars = members.where("cls <> lead").select("cls", "lead").distinct().join(light, "cls").join(lead, "lead")
    stars = stars.where(_bits_allow(F.col("n"), F.col("bits"), F.col("m"), F.col("other"), percent)).select(F.col("cls").alias("u"), F.col("lead").alias("v"))
    stars = work.keep(connected_components(stars, work, "stars").withColumnRenamed("node", "cls"), "stars")
    rows = work.keep(members.drop("lead").join(stars, "cls", "left").withColumn("component", F.coalesce("component", "cls")), "placed")
    work.drop("members")
    apart = rows.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("token")
    apart = work.keep(rows.join(work.keep(apart, "apart"), "token", "left_semi"), "spread")
    # Short lists: pairs, of which positions and sizes leave some, and bitmaps few. A bitmap goes to the distinct pairs alone, not to each entry.
    few = apart.where(F.col("size") <= SMALL).select("token", "cls", "component", "n", "i")
    a, b = few.alias("a"), few.alias("b")
    both = (F.col("a.token") == F.col("b.token")) & (F.col("a.component") < F.col("b.component"))
    sized = F.lit(100) * F.least("a.n", "b.n") >= F.lit(percent) * F.greatest("a.n", "b.n")
    reach = F.least(F.col("a.n") - F.col("a.i"), F.col("b.n") - F.col("b.i")) >= needed(F.col("a.n"), F.col("b.n"), percent)
    pairs = a.join(b, both & sized & reach).select(F.col("a.cls").alias("cls"), F.col("b.cls").alias("lead"), F.col("a.component").alias("v"), F.col("b.component").alias("u"))
    pairs = work.keep(pairs.distinct(), "pairs").join(light, "cls").join(lead, "lead")
    pairs = pairs.where(_bits_allow(F.col("n"), F.col("bits"), F.col("m"), F.col("other"), percent)).select("u", "v").distinct()
    # Long lists: blocks by band. The smaller set of a pair is early, in the same band as the larger one or in the next lower; late ones alone
    # are skipped. The least component of a band's early entries stands for the block.
    long = apart.where(F.col("size") > SMALL)
    blocks = long.where("early").groupBy("token", "band").agg(F.min("component").alias("v"))
    meets = long.select("token", F.col("component").alias("u"), F.explode(F.array(F.col("band"), F.col("band") - 1)).alias("band")).distinct()
    wide = meets.join(blocks, ["token", "band"]).where("u <> v").select("u", "v").distinct()
    ends = connected_components(pairs.unionByName(wide), work, "groups").toDF("component", "end")
    found = rows.select("cls", "component").distinct().join(ends, "component", "left").select("cls", F.coalesce("end", "component").alias("component"))
    found = work.keep(found, "coarse")
    sizes = found.groupBy("component").agg(F.count("*").alias("size")).where("size > 1").select("component")
    return found.join(sizes, "component", "left_semi")


# --- Blocks of full sets


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All numbers of the ranges [start, end)."""
    lengths = np.maximum(ends - starts, 0)
    return np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum())


class Index:
    """Lists of the sets of one block for each of their shingles, by position; overlaps of one set with all, whole or derived."""

    def __init__(self, sets: list[np.ndarray], percent: int = PERCENT):
        self.percent, self.sizes = percent, np.array([len(s) for s in sets], np.int64)
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes)
        known, ids, counts = np.unique(flat, return_inverse=True, return_counts=True)
        rank = np.empty(len(known), np.int64)
        rank[np.argsort(counts, kind="stable")] = np.arange(len(known))  # a shingle's number is its place from the rarest on
        ids = rank[ids]
        order = np.lexsort((ids, owner))
        self.first = np.concatenate(([0], np.cumsum(self.sizes)))
        self.ids = ids[order]  # the sets one after another, each the rarer first
        place = np.arange(len(order)) - np.repeat(self.first[:-1], self.sizes)
        # Lists one after another, each by position.
        self.span = int(self.sizes.max()) + 1
        keys = self.ids * self.span + place
        by = np.argsort(keys, kind="stable")
        self.keys, self.owner = keys[by], owner[by]
        self.start = np.searchsorted(self.ids[by], np.arange(len(known) + 1))
        self.overlaps: dict[int, np.ndarray] = {}
        self.parent, self.near = np.full(len(sets), -1), np.zeros(len(sets))

    def candidates(self, x: int) -> np.ndarray:
        """Sets that share a shingle of x's prefix at a position from which the needed overlap can be reached; tails of lists are skipped."""
        n = self.sizes[x]
        tokens = self.ids[self.first[x] : self.first[x] + prefix(n, self.percent)]
        furthest = 100 * n / self.percent - n  # of the largest partner
        ends = np.searchsorted(self.keys, tokens * self.span + min(int(furthest), self.span - 2) + 1)
        at = _ranges(self.start[tokens], ends)
        who, m = self.owner[at], self.sizes[self.owner[at]]
        j, i = self.keys[at] % self.span, np.repeat(np.arange(len(tokens)), np.maximum(ends - self.start[tokens], 0))
        ok = (np.minimum(n - i, m - j) >= needed(n, m, self.percent)) & (100 * np.minimum(n, m) >= self.percent * np.maximum(n, m)) & (who != x)
        return np.unique(who[ok])

    def _listed(self, tokens: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner[_ranges(self.start[tokens], self.start[tokens + 1])], minlength=len(self.sizes))

    def answers(self, x: int) -> np.ndarray:
        """Which sets are linked with x, from the overlaps of a close set if there are any, else from the lists of all its shingles."""
        own, p = self.ids[self.first[x] : self.first[x + 1]], self.parent[x]
        if p >= 0:
            other = self.ids[self.first[p] : self.first[p + 1]]
            more, less = np.setdiff1d(own, other, assume_unique=True), np.setdiff1d(other, own, assume_unique=True)
            shared = self.overlaps[p] + self._listed(more) - self._listed(less)
        else:
            shared = self._listed(own)
        self.overlaps[x] = shared
        similar = 100 * shared / (self.sizes + self.sizes[x] - shared)
        closer = (similar >= CLOSE) & (similar > self.near)
        self.parent[closer], self.near[closer] = x, similar[closer]
        return 100 * shared >= self.percent * (self.sizes + self.sizes[x] - shared)


def linked(sets: list[np.ndarray], roots: np.ndarray, asked: np.ndarray, told: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The least root that links between asked and told sets lead each root to, by place; equal roots are linked already."""
    index = Index(sets, percent)
    names, first = np.unique(roots, return_index=True)
    tree = first[np.searchsorted(names, roots)]  # each set's tree is named by its least place
    for x in np.flatnonzero(asked):
        found = index.candidates(x)
        if (told[found] & (tree[found] != tree[x])).any():
            for other in np.unique(tree[index.answers(x) & told]):
                if other != tree[x]:
                    low, high = sorted((int(other), int(tree[x])))
                    tree[tree == high] = low
    return tree


def _within(width: int, percent: int):
    """(component, block, cls, n, root) for the classes of a block: root is the least class that its links reach."""
    hashes = WordHashes(WORDS)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("cls")
        cls = table.column("cls").to_numpy()
        sets = [shingle_hashes(t, width, hashes) for t in table.column("text").to_pylist()]
        all_sets = np.ones(len(sets), bool)
        root = cls[linked(sets, np.arange(len(sets)), all_sets, all_sets, percent)]
        return table.select(["component", "block", "cls", "n"]).append_column("root", pa.array(root, pa.int64()))

    return run


def _between(width: int, percent: int):
    """Links (u, v) between what the roots of one block stand for and those of another."""
    hashes = WordHashes(WORDS)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("root")
        left, right = (table.column(c).to_numpy(zero_copy_only=False) for c in ("left", "right"))
        root = table.column("root").to_numpy()
        sets = [shingle_hashes(t, width, hashes) for t in table.column("text").to_pylist()]
        pairs = np.empty((0, 2), np.int64)
        if left.any() and right.any():
            pairs = np.unique(np.stack([root, root[linked(sets, root, left, right, percent)]], axis=1), axis=0)
            pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        return pa.table({"u": pa.array(pairs[:, 0], pa.int64()), "v": pa.array(pairs[:, 1], pa.int64())})

    return run


def jaccard_join(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id, kept, first_of_group for each row of docs (doc_id, text).

    n_shingles is the size of the document's set of shingles of ``width`` words; a text of fewer words is one shingle. Documents link at a Jaccard
    similarity of ``percent`` or more, exactly (shingles are 64-bit hashes); component_id is the least doc_id that links reach. Null texts and texts without words have no
    shingle and are linked with nothing. A null doc_id names a component only if no other does. Repeated rows are of one class and get equal
    rows each. An empty table gives no rows. Other columns aren't read.
    """
    compare = Comparison(_within(width, percent), _between(width, percent), percent)
    rows = signed(docs, shingle_ranks(docs, width), width, percent)
    return grouped(docs, rows, ["bits", "firsts"], lambda classes, work: coarse_groups(classes, work, percent), compare, "set-join")

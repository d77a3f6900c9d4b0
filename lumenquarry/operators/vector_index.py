"""An approximate index of vectors: cells of an inverted file, product-quantised residuals, probed by an equi-join.

Cells are centroids of unit vectors. A row's residual to its cell's centroid is cut into parts, and each part is replaced by the nearest
of up to 256 code vectors. Rows of a cell lie in blocks of bounded size (ids, codes, unit vectors, attributes), in files by cell; a large cell has
many blocks and is no task of its own. A query reads the blocks of its nearest cells and no others: codes rank a block's rows, and
all that could be among the best, by how far codes are from their rows, are scored exactly. Where a filter leaves fewer than k rows, a query goes on with twice as many cells.

Centroids and codes are fitted on a sample of at most SAMPLE rows, chosen by hashes of keys; every row is indexed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import DIGITS, _unit, best_columns
from ..sources.files import scratch, written

#: Rows that centroids and codes are fitted on at most, rows in one block, queries in one block, and components of one part.
SAMPLE, BLOCK, QUERIES, PART = 20_000, 4096, 256, 8
#: Up to so many rows of a sample are all fitted on; of more, a quarter is held out to calibrate the number of cells.
HELD = 400
#: Rows held out that are asked for when the number of cells is calibrated.
ASKED = 300
_BLOCKS = "cell int, ids binary, codes binary, vectors binary, attributes array<string>"


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """k centroids of rows; an empty one takes the row that is furthest from its own."""
    c = x[np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        d = (c * c).sum(axis=1)[None, :] - 2 * x @ c.T
        near = d.argmin(axis=1)
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        far = np.argsort(-d[np.arange(len(x)), near] - (x * x).sum(axis=1), kind="stable")[: (n == 0).sum()]
        c = total / np.maximum(n, 1)[:, None]
        c[n == 0] = x[far]
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(axis=1)[None, :] - 2 * x @ c.T).argmin(axis=1)


def _calibrated(q: np.ndarray, x: np.ndarray, c: np.ndarray, target: float, own: np.ndarray, k: int = 10) -> int:
    """The least number of cells that hold ``target`` of the k rows x nearest to each of q, of which row ``own`` is itself (-1: none)."""
    scores = q @ x.T
    at = np.flatnonzero(own >= 0)
    scores[at, own[at]] = -np.inf
    near = np.argsort(-scores, axis=1)[:, : min(k, len(x) - 1)]
    place = np.argsort(np.argsort((c * c).sum(axis=1)[None, :] - 2 * q @ c.T, axis=1), axis=1)
    found = np.sort(np.take_along_axis(place, _nearest(x, c)[near], axis=1).reshape(-1))
    return int(found[min(int(np.ceil(target * len(found))), len(found)) - 1]) + 1 if len(found) else 1


def reachable(about: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """Columns that could be among some row's k best, where scores ``about`` are off by at most ``off`` by column."""
    if about.shape[1] <= k:
        return np.arange(about.shape[1])
    least = -np.partition(off - about, k - 1, axis=1)[:, k - 1 : k]
    return np.flatnonzero((about + off >= least - 1e-9).any(axis=0))


def _blocks(rows: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, pa.Table]]:
    """Rows sorted by cell as tables of one cell and at most ``size`` rows."""
    held: list[pa.RecordBatch] = []

    def out() -> Iterator[tuple[int, pa.Table]]:
        table = pa.Table.from_batches(held)
        for start in range(0, table.num_rows, size):
            yield table.column("cell")[0].as_py(), table.slice(start, size)

    for batch in rows:
        cells = batch.column("cell").to_numpy()
        edges = [0, *(np.flatnonzero(cells[1:] != cells[:-1]) + 1), len(cells)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if b > a:
                if held and (held[0].column("cell")[0].as_py() != cells[a] or sum(x.num_rows for x in held) >= size):
                    yield from out()
                    held = []
                held.append(batch.slice(a, b - a))
    if held:
        yield from out()


class VectorIndex:
    """An index in a folder: ``model`` (centroids, codes and the rows held out, a bounded size) and ``blocks`` by cell."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        rows = spark.read.parquet(f"{path}/model").orderBy("part", "i").collect()
        held = [r for r in rows if r["part"] == -3]
        self.held, self.attributes, self.target = np.array([r["x"] for r in held]), [r["attribute"] for r in held], next(r["x"][1] for r in rows if r["part"] == -2)
        self.parts = max(r["part"] for r in rows) + 1
        self.probes = int(next(r["x"][0] for r in rows if r["part"] == -2))
        self.centroids = np.array([r["x"] for r in rows if r["part"] == -1])
        self.codes = [np.array([r["x"] for r in rows if r["part"] == p]) for p in range(self.parts)]

    @classmethod
    def build(cls, vectors: DataFrame, path: str, key: str = "vec_id", vector: str = "embedding", attribute: str | None = None, cells: int | None = None, target: float = 0.98, sample: int = SAMPLE, seed: int = 5) -> VectorIndex:
        """Indexes all rows with a key and a vector that isn't null; all vectors have one length. ``attribute`` is what filters ask for.

        ``cells`` is by default twice the root of the number of rows, 8 to 4096. Keys are integers. How many cells a search probes is
        what gives queries from the sample a recall of ``target`` among the sample's rows: few for vectors that form clusters, many for noise.
        """
        rows = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull())
        n = rows.count()
        if not n:
            raise ValueError("no vectors to index")
        share = min(1.0, 1.5 * sample / n)
        chosen = rows.where(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000))
        chosen = chosen.select(vector, F.col(attribute).cast("string") if attribute else F.lit(None).cast("string")).limit(sample).collect()  # the bounded sample
        x, attributes = _unit([r[0] for r in chosen]), [r[1] for r in chosen]
        # Centroids lean towards the rows that they are fitted on, so others tell how many cells a search needs.
        held = np.arange(len(x)) % 4 == 0 if len(x) > HELD else np.ones(len(x), bool)
        fitted, attributes, held = x[~held] if len(x) > HELD else x, [a for a, h in zip(attributes, held, strict=True) if h], x[held]
        centroids = k_means(fitted, cells or int(np.clip(2 * n**0.5, 8, 4096)), seed=seed)
        centroids = np.unique(np.round(centroids, 9), axis=0)  # equal ones, as of copies, would share rows by chance
        residuals = x - centroids[_nearest(x, centroids)]
        parts = [residuals[:, i : i + PART] for i in range(0, x.shape[1], PART)]
        probes = _calibrated(held[:ASKED], held, centroids, target, np.arange(len(held))[:ASKED])
        model = [(-3, i, r.tolist(), a) for i, (r, a) in enumerate(zip(held, attributes, strict=True))]
        model += [(-2, 0, [float(probes), target], None), *[(-1, i, c.tolist(), None) for i, c in enumerate(centroids)]]
        model += [(p, i, c.tolist(), None) for p, part in enumerate(parts) for i, c in enumerate(k_means(part, 256, seed=seed))]
        vectors.sparkSession.createDataFrame(model, "part int, i int, x array<double>, attribute string").write.mode("overwrite").parquet(f"{path}/model")
        index = cls(vectors.sparkSession, path)
        index._write(rows, key, vector, attribute, "overwrite")
        return index

    def add(self, vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", attribute: str | None = None) -> None:
        """Indexes more rows with the centroids and codes that there are."""
        self._write(vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull()), key, vector, attribute, "append")

    def _write(self, rows: DataFrame, key: str, vector: str, attribute: str | None, mode: str) -> None:
        centroids, codes = self.centroids, self.codes

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = _unit(batch.column("v").to_pylist())
                    yield pa.RecordBatch.from_arrays([pa.array(_nearest(x, centroids), pa.int32()), batch.column("k"), batch.column("a"), pa.array([r.tobytes() for r in x.astype(np.float32)], pa.binary())], ["cell", "k", "a", "x"])

        def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for cell, t in _blocks(batches, BLOCK):
                x = np.frombuffer(b"".join(t.column("x").to_pylist()), np.float32).reshape(t.num_rows, -1)
                left = x - centroids[cell]
                code = np.stack([_nearest(left[:, p * PART : (p + 1) * PART], c) for p, c in enumerate(codes)], axis=1).astype(np.uint8)
                columns = [pa.array([cell], pa.int32()), pa.array([t.column("k").to_numpy().tobytes()], pa.binary()), pa.array([code.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary()), pa.array([t.column("a").to_pylist()], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, ["cell", "ids", "codes", "vectors", "attributes"])

        a = F.col(attribute).cast("string") if attribute else F.lit(None).cast("string")
        placed_rows = rows.select(F.col(key).cast("bigint").alias("k"), F.col(vector).alias("v"), a.alias("a")).mapInArrow(placed, "cell int, k bigint, a string, x binary")
        # Ranges of (cell, hash): a cell of any size is cut where it is too large for one task.
        dealt = placed_rows.repartitionByRange("cell", F.xxhash64("k")).sortWithinPartitions("cell")
        dealt.mapInArrow(blocks, _BLOCKS).write.mode(mode).partitionBy("cell").parquet(f"{self.path}/blocks")

    def search(self, queries: DataFrame, k: int, probes: int | None = None, key: str = "vec_id", vector: str = "embedding", allowed: list | None = None, exclude_self: bool = True) -> DataFrame:
        """(query_id, <key>, score, rank): about the k rows with the largest cosine, among those whose attribute is ``allowed``; ties by the smaller key.

        How many cells are probed is calibrated among the rows held out that are ``allowed``, as those lie further away than the nearest of
        all; where too few of these are, all cells are. A query that finds fewer than k rows probes twice as many cells, up to all.
        """
        own = queries.select(F.col(key).cast("bigint").alias("query_id"), F.col(vector).alias("v")).where("query_id is not null and v is not null")
        path, turn = scratch(self.spark, "vector-search"), 0
        done, left, probes = None, own, min(probes or self._cells(k, allowed), len(self.centroids))
        while True:
            found = self._probed(left, k, probes, allowed, exclude_self)
            if probes >= len(self.centroids):
                break
            found = written(found, f"{path}/found-{turn}")
            short = found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k).select("query_id")
            left = left.join(short, "query_id", "left_anti")
            left, turn = written(left, f"{path}/left-{turn}"), turn + 1
            enough = found.join(short, "query_id", "left_semi")
            if not left.head(1):
                found = enough
                break
            done = enough if done is None else done.unionByName(enough)
            probes = min(2 * probes, len(self.centroids))
        out = found if done is None else done.unionByName(found)
        return out.withColumnRenamed("c", key)

    def _cells(self, k: int, allowed: list | None) -> int:
        """How many cells a search for k rows probes."""
        if allowed is None:
            return self.probes
        names = {str(a) for a in allowed}
        ok = np.flatnonzero([a in names for a in self.attributes])
        if len(ok) <= max(k, 10):
            return len(self.centroids)
        place = {i: j for j, i in enumerate(ok.tolist())}
        own = np.array([place.get(i, -1) for i in range(len(self.held))])[:ASKED]
        return max(self.probes, _calibrated(self.held[:ASKED], self.held[ok], self.centroids, self.target, own))

    def _probed(self, queries: DataFrame, k: int, probes: int, allowed: list | None, exclude_self: bool) -> DataFrame:
        centroids, codes = self.centroids, self.codes
        names = None if allowed is None else {str(x) for x in allowed}

        def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = _unit(batch.column("v").to_pylist())
                    d = (centroids * centroids).sum(axis=1)[None, :] - 2 * x @ centroids.T
                    at = np.argpartition(d, probes - 1, axis=1)[:, :probes]
                    rows = [r.tobytes() for r in x.astype(np.float32)]
                    yield pa.RecordBatch.from_arrays([pa.array(at.reshape(-1), pa.int32()), pa.array(np.repeat(batch.column("query_id").to_numpy(), probes)), pa.array([r for r in rows for _ in range(probes)], pa.binary())], ["cell", "q", "x"])

        def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for cell, t in _blocks(batches, QUERIES):
                yield pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.array([t.column("q").to_numpy().tobytes()], pa.binary()), pa.array([b"".join(t.column("x").to_pylist())], pa.binary())], ["cell", "qids", "qvectors"])

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    ids, q = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["qids"], np.int64)
                    x = np.frombuffer(r["vectors"], np.float32).reshape(len(ids), -1).astype(np.float64)
                    y = np.frombuffer(r["qvectors"], np.float32).reshape(len(q), -1).astype(np.float64)
                    code = np.frombuffer(r["codes"], np.uint8).reshape(len(ids), -1)
                    if names is not None:
                        ok = np.array([a in names for a in r["attributes"]], bool)
                        ids, x, code = ids[ok], x[ok], code[ok]
                    if not len(ids):
                        continue
                    about = sum((y[:, p * PART : (p + 1) * PART] @ c.T)[:, code[:, p]] for p, c in enumerate(codes))
                    read = np.concatenate([c[code[:, p]] for p, c in enumerate(codes)], axis=1)
                    off = np.linalg.norm(x - centroids[r["cell"]] - read, axis=1)
                    at = reachable(about, off, k + exclude_self)
                    scores, keys = np.round(y @ x[at].T, DIGITS), np.broadcast_to(ids[at], (len(q), len(at)))
                    if exclude_self:
                        scores = np.where(keys == q[:, None], -np.inf, scores)
                    scores, keys = best_columns(scores, keys, k)
                    ok = np.isfinite(scores).reshape(-1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q, scores.shape[1])[ok]), pa.array(keys.reshape(-1)[ok]), pa.array(scores.reshape(-1)[ok])], ["query_id", "c", "score"])

        blocks = self.spark.read.schema(_BLOCKS).parquet(f"{self.path}/blocks")
        probe = queries.mapInArrow(probed, "cell int, q bigint, x binary").repartitionByRange("cell", "q").sortWithinPartitions("cell").mapInArrow(asked, "cell int, qids binary, qvectors binary")
        # Files lie by cell: a broadcast of few probes prunes them before they are read.
        found = blocks.join(probe, "cell").mapInArrow(scored, "query_id bigint, c bigint, score double")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "c")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame, key: str = "vec_id") -> DataFrame:
    """(query_id, recall): which share of an exact search's rows an approximate one found."""
    hit = exact.select("query_id", key).join(found.select("query_id", key, F.lit(1).alias("hit")), ["query_id", key], "left")
    return hit.groupBy("query_id").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))

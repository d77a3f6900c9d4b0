"""A quality classifier: random-indexing word vectors, pooled by document, and a two-layer network.

Every word has a random index vector, made from its hash. A word's context vector is the sum of the index vectors of its
neighbours; it is learnt for the words that most documents of the sample have, and added to the index vector. A document
is the mean of its words' vectors. The network's probabilities are calibrated by a temperature on held-back rows of the sample.

The model is fitted on at most ``SAMPLE`` labelled documents (those with the smallest hash of their id); everything that comes
to the driver is bounded by this and by ``VOCABULARY``. Scoring is one narrow pass over whole texts.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace

#: Labelled documents, words with context vectors, dimensions, entries of an index vector that aren't 0, and neighbours on each side.
SAMPLE, VOCABULARY, SIZE, NONZERO, NEIGHBOURS = 12_000, 4_000, 64, 8, 2
HIDDEN, EPOCHS, RATE, DECAY = 32, 400, 0.02, 1e-4
#: Partitions of the sample: each sends one matrix of VOCABULARY * SIZE to the driver.
PARTS = 8
CACHED_WORDS = 250_000
_PIECE = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")


def pieces(token: str) -> list[str]:
    """The words in a token between blanks: letters in lower case, digits as one word, signs as they are; and each one's shape."""
    out = []
    for x in _PIECE.findall(token):
        if x.isdigit():
            out.append("0")
        elif x.isalpha():
            out += [x.lower(), "Aa" if x.istitle() else "AA" if x.isupper() else "aa" if x.islower() else "aA"]
        else:
            out.append(x)
    return out


def index_vectors(words: list[str]) -> np.ndarray:
    """A sparse vector of NONZERO entries of 1 or -1 for each word, one in each NONZERO-th of the dimensions, from the bits of its hash."""
    h = np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))
    out, rows, part = np.zeros((len(words), SIZE), np.float32), np.arange(len(words)), SIZE // NONZERO
    for k in range(NONZERO):
        x = ((h >> np.uint64(64 // NONZERO * k)) & np.uint64(2 ** (64 // NONZERO) - 1)).astype(np.int64)
        out[rows, k * part + x % part] = 1 - 2 * (x // part % 2)
    return out


@dataclass
class Model:
    contexts: dict[str, np.ndarray]
    name: str = field(default_factory=lambda: uuid.uuid4().hex)
    mean: np.ndarray = field(default_factory=lambda: np.zeros(SIZE))
    spread: np.ndarray = field(default_factory=lambda: np.ones(SIZE))
    layers: tuple | None = None  # None: no labelled rows of both classes, every score is ``prior``
    temperature: float = 1.0
    prior: float = 0.5

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((pooled - self.mean) / self.spread @ w1 + b1) @ w2 + b2

    def scores(self, pooled: np.ndarray) -> np.ndarray:
        if self.layers is None:
            return np.full(len(pooled), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.logits(pooled) / self.temperature, -60, 60)))


class Pooler:
    """Means of words' vectors, by document. Tokens' sums are kept until there are CACHED_WORDS."""

    def __init__(self, contexts: dict[str, np.ndarray]):
        self.contexts = contexts
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.sums, self.words = np.zeros((1024, SIZE), np.float32), np.zeros(1024, np.float32)

    def _learn(self, tokens: list[str]) -> None:
        """Sums of the vectors of new tokens' words."""
        own = [pieces(t) for t in tokens]
        at = {w: i for i, w in enumerate({w: None for x in own for w in x})}
        vectors = index_vectors(list(at))
        for w, i in at.items():
            if (v := self.contexts.get(w)) is not None:
                vectors[i] = v
        first, last = len(self.place), len(self.place) + len(tokens)
        if last > len(self.sums):
            more = max(len(self.sums), last - len(self.sums))
            self.sums, self.words = np.pad(self.sums, ((0, more), (0, 0))), np.pad(self.words, (0, more))
        self.sums[first:last] = 0
        sizes = np.array([len(x) for x in own])
        np.add.at(self.sums, first + np.repeat(np.arange(len(own)), sizes), vectors[[at[w] for x in own for w in x]])
        self.words[first:last] = sizes
        self.place.update(zip(tokens, range(first, last), strict=True))

    def pooled(self, texts) -> np.ndarray:
        out = np.zeros((len(texts), SIZE))
        for i, text in enumerate(texts):
            if len(self.place) > CACHED_WORDS:
                self.clear()
            tokens = text.split() if text else []
            if not tokens:
                continue
            if new := [t for t in dict.fromkeys(tokens) if t not in self.place]:
                self._learn(new)
            at = np.fromiter(map(self.place.__getitem__, tokens), np.int64, len(tokens))
            total, n = np.zeros(SIZE), 0.0
            for k in range(0, len(at), 4096):
                part = at[k : k + 4096]
                total += self.sums[part].sum(axis=0, dtype=np.float64)
                n += self.words[part].sum(dtype=np.float64)
            out[i] = total / max(n, 1.0)
        return out


#: The pooler of the newest model in this worker: tasks that follow one another share it.
_KEPT: list = [None, None]


def _pooler(model: Model) -> Pooler:
    if _KEPT[0] != model.name:
        _KEPT[:] = model.name, Pooler(model.contexts)
    return _KEPT[1]


def labelled(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """(doc_id, text, quality): the sample. Rows with crc32(doc_id) mod 3 = 1 and null labels take no part."""
    chosen = labels.where("quality in (0, 1) and doc_id is not null and crc32(cast(doc_id as string)) % 3 <> 1").select("doc_id", "quality").distinct()
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(most)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most `most` rows
    return found.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))


def _frequent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    count: Counter = Counter()
    for batch in batches:
        for text in batch["text"]:
            count.update({w for t in set((text or "").split()) for w in pieces(t)})
    yield pd.DataFrame(list(count.items()), columns=["word", "n"])


def _contexts(vocabulary: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = {w: i for i, w in enumerate(vocabulary)}
        vectors = index_vectors(vocabulary)
        out = np.zeros((len(vocabulary), SIZE), np.float32)
        for batch in batches:
            for text in batch["text"]:
                words = [w for t in (text or "").split() for w in pieces(t)]
                if not words:
                    continue
                rest = {w: len(vocabulary) + i for i, w in enumerate({w: None for w in words if w not in place})}
                table = np.concatenate([vectors, index_vectors(list(rest))]) if rest else vectors
                at = np.array([place[w] if w in place else rest[w] for w in words])
                table = table[at]
                around = np.zeros_like(table)
                for k in range(1, NEIGHBOURS + 1):
                    around[k:] += table[:-k]
                    around[:-k] += table[k:]
                known = at < len(vocabulary)
                np.add.at(out, at[known], around[known])
        yield pd.DataFrame({"m": [out.tobytes()]})

    return run


def _pooled(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pooler = _pooler(shared.value)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "quality": batch["quality"], "v": list(pooler.pooled(batch["text"].tolist()))})

    return run


def _trained(x: np.ndarray, y: np.ndarray, model: Model) -> Model:
    """Full-batch Adam on four fifths of the rows; the temperature is that with the least loss on the others."""
    r = np.random.default_rng(5)
    order = r.permutation(len(y))
    held, own = order[: len(y) // 5], order[len(y) // 5 :]
    model.mean, model.spread = x[own].mean(axis=0), x[own].std(axis=0) + 1e-6
    z, t = (x[own] - model.mean) / model.spread, y[own].astype(float)
    layers = [r.normal(0, SIZE**-0.5, (SIZE, HIDDEN)), np.zeros(HIDDEN), r.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(w) for w in layers], [np.zeros_like(w) for w in layers]
    for epoch in range(1, EPOCHS + 1):
        w1, b1, w2, b2 = layers
        h = np.tanh(z @ w1 + b1)
        error = (1 / (1 + np.exp(-np.clip(h @ w2 + b2, -60, 60))) - t) / len(t)
        back = np.outer(error, w2) * (1 - h * h)
        for i, g in enumerate((z.T @ back + DECAY * w1, back.sum(axis=0), h.T @ error + DECAY * w2, error.sum(keepdims=True))):
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
            layers[i] = layers[i] - RATE * (m[i] / (1 - 0.9**epoch)) / (np.sqrt(v[i] / (1 - 0.999**epoch)) + 1e-8)
    model.layers = tuple(layers)
    if len(held) >= 10:
        logits, truth = model.logits(x[held]), y[held]
        loss = lambda s: np.logaddexp(0, np.where(truth == 1, -logits, logits) / s).mean()
        model.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
    return model


def fitted(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model:
    """A model from at most ``most`` labelled documents; without both classes, scores are the share of label 1 (or 0.5)."""
    spark = docs.sparkSession
    work = Workspace(spark, "classifier")
    sample = work.keep(labelled(docs, labels, most).repartition(PARTS, "doc_id"), "sample")
    counts = sample.select("text").mapInPandas(_frequent, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    vocabulary = [r["word"] for r in counts.orderBy(F.desc("n"), "word").limit(VOCABULARY).collect()]
    contexts: dict[str, np.ndarray] = {}
    if vocabulary:
        sums = sample.select("text").coalesce(PARTS).mapInPandas(_contexts(vocabulary), "m binary").collect()
        total = np.sum([np.frombuffer(r["m"], np.float32).reshape(len(vocabulary), SIZE) for r in sums], axis=0, dtype=np.float64)
        # Contexts at the length of an index vector, so that frequent words don't outweigh the others.
        total *= (NONZERO**0.5 / np.maximum(np.linalg.norm(total, axis=1), 1e-9))[:, None]
        contexts = dict(zip(vocabulary, (index_vectors(vocabulary) + total).astype(np.float32), strict=True))
    model = Model(contexts)
    shared = spark.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = sample.select("doc_id", F.col("quality").cast("int"), "text").mapInPandas(_pooled(shared), f"doc_id {kind}, quality int, v array<double>").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["quality"]))
    work.drop("sample")
    y = np.array([r["quality"] for r in rows])
    if len(set(y.tolist())) < 2:
        model.prior = float(y.mean()) if len(y) else 0.5
        return model
    return _trained(np.array([r["v"] for r in rows]), y, model)


def _scored(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model: Model = shared.value
        pooler = _pooler(model)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": model.scores(pooler.pooled(batch["text"].tolist()))})

    return run


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row. A null or empty text is a document without words: its vector is zero.

    Repeated rows have equal scores; an empty table has an empty result. Other columns aren't read.
    """
    kind, shared = docs.schema["doc_id"].dataType.simpleString(), docs.sparkSession.sparkContext.broadcast(model)
    found = docs.selectExpr("cast(doc_id as string) as doc_id", "text").mapInPandas(_scored(shared), "doc_id string, score double")
    return found.select(F.col("doc_id").cast(kind).alias("doc_id"), "score")

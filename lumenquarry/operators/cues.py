"""Fourteen cues of affect in a text, and a model from text to label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..sources.files import scratch, written
from .classify import affect_training, combined_affect

#: Words that stand for a cue, lower case. Each cue is the share of a text's tokens that are among its words.
WORDS = {
    "negative": "bad wrong worst terrible awful broken useless poor horrible failed failing".split(),
    "positive": "good great thanks thank excellent happy perfect nice helpful resolved".split(),
    "urgent": "urgent urgently now immediately asap emergency today critical".split(),
    "polite": "please kindly appreciate grateful sorry".split(),
    "negation": "not no never none nothing cannot without nor".split(),
    "intense": "very really extremely absolutely completely totally so too".split(),
    "first_person": "i me my mine we us our".split(),
    "threat": "cancel refund lawyer complaint leave report court".split(),
}
#: Cues of form, in their order after those of words.
FORM = ["exclaims", "asks", "shouts", "digits", "repeats", "length"]
NAMES = [*WORDS, *FORM]


def cues(text: Column) -> Column:
    """An array of 14 numbers from 0 to 1: WORDS as shares of tokens, then per character or word !, ?, capitals and digits, runs of ! or ?, and ln(1 + tokens) / 10, at most 1. A null text has zeros."""
    t = F.coalesce(text, F.lit(""))
    chars = F.greatest(F.length(t), F.lit(1))
    known = sorted({w for words in WORDS.values() for w in words})
    count = lambda pattern: F.regexp_count(t, F.lit(pattern))
    among = lambda ws: lambda w: w.isin(ws)

    def of(words: Column) -> Column:
        # A text is cut into tokens once; cues count among the few of them that some cue knows.
        size = words["n"]
        n = F.greatest(size, F.lit(1))
        shares = [F.size(F.filter(words["hits"], among(ws))) / n for ws in WORDS.values()]
        form = [count("!") / n, count("[?]") / n, count("[A-Z]") / chars, count("[0-9]") / chars, count("[!?]{2,}") / n, F.log(1 + size) / 10]
        return F.array(*[F.least(x, F.lit(1.0)) for x in [*shares, *form]])

    seen = F.transform(F.array(tokens(t)), lambda w: F.struct(F.size(w).alias("n"), F.filter(w, lambda x: x.isin(known)).alias("hits")))
    return F.element_at(F.transform(seen, of), 1)


class AffectModel:
    """A multinomial model over cues, kept as a table (class, intercept, weights)."""

    def __init__(self, spark: SparkSession, path: str):
        rows = spark.read.parquet(path).orderBy("class").collect()  # a row for each class
        self.classes, self.intercepts, self.weights = [r["class"] for r in rows], [r["intercept"] for r in rows], [r["weights"] for r in rows]

    @classmethod
    def train(cls, rows: DataFrame, text: str, label: str, path: str) -> AffectModel:
        """Fits all labelled rows and writes the model; rows without a label are left out."""
        # Fourteen numbers a row, written once: training passes over them many times, over the texts once.
        known = written(rows.select(cues(F.col(text)).alias("cues"), F.col(label).alias("label")), scratch(rows.sparkSession, "cues"))
        classes, weights, intercepts = affect_training(known, "cues", "label")
        model = list(zip(classes, map(float, intercepts), [[float(w) for w in ws] for ws in weights], strict=True))
        rows.sparkSession.createDataFrame(model, "class string, intercept double, weights array<double>").write.mode("overwrite").parquet(path)
        return cls(rows.sparkSession, path)

    def scored(self, rows: DataFrame, key: str, text: str) -> DataFrame:
        """(key, label, p) for each class of each row."""
        # Written once, as each class's score reads all cues.
        known = written(rows.select(F.col(key).alias("key"), cues(F.col(text)).alias("cues")), scratch(rows.sparkSession, "cues"))
        return combined_affect(known, "key", self.weights, self.intercepts, self.classes)

    def predicted(self, rows: DataFrame, key: str, text: str) -> DataFrame:
        """(key, label, p): the likeliest class of each row, ties by name."""
        best = F.min_by(F.struct("label", "p"), F.struct(-F.col("p"), F.col("label")))
        return self.scored(rows, key, text).groupBy("key").agg(best.alias("b")).select("key", "b.label", "b.p")

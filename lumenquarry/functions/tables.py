"""Functions for SQL: table functions over texts, and a mean of vectors; register() makes them known to a session."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_END = re.compile(r"([.!?])[ \t\r\n]+")
_STEP = re.compile(r"^[ \t]*(?:[0-9]+[.)]|[-*])[ \t]+(.*\S)", re.M)


@F.udtf(returnType="i int, sentence string")
class Sentences:
    """The parts of a text that end with . ! or ? before white space, numbered from 0. A null text has none."""

    def eval(self, text: str) -> Iterator[tuple[int, str]]:
        parts = _END.sub("\\1\x01", text).split("\x01") if text else []
        yield from enumerate(p for p in parts if p)


@F.udtf(returnType="i int, step string")
class Steps:
    """Lines of a text that begin with a number or a dash, without it, numbered from 0. A null text has none."""

    def eval(self, text: str) -> Iterator[tuple[int, str]]:
        yield from enumerate(_STEP.findall(text) if text else [])


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def vector_mean(v: pd.Series) -> list[float]:
    """The elementwise mean of a group's vectors, for SQL. A group's vectors come into one task; for groups without bound there is vectors.mean_vector()."""
    rows = [np.asarray(x, float) for x in v if x is not None]
    return np.mean(rows, axis=0).tolist() if rows else None


def register(spark: SparkSession) -> None:
    """sentences(text), steps(text) and vector_mean(vector) in SQL."""
    spark.udtf.register("sentences", Sentences)
    spark.udtf.register("steps", Steps)
    spark.udf.register("vector_mean", vector_mean)

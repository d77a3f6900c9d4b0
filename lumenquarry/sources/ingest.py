"""Batch ingestion: validation with quarantine, normalisation, redaction, hashing, last-wins merge."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_hash, normalised, redacted
from ..operators.relational import latest_per_key, upserted
from .files import Snapshots, written
from .merge import MergeTable


def validated(df: DataFrame, key: str, text: str, longest: int = 20_000) -> DataFrame:
    """Adds ``errors``, an array of what is wrong with a row."""
    checks = {"missing_key": F.col(key).isNull(), "blank_text": F.trim(F.coalesce(text, F.lit(""))) == "", "text_too_long": F.length(text) > longest}
    return df.withColumn("errors", F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()])))


def prepared(df: DataFrame, text: str) -> DataFrame:
    """Normalised and redacted text, its counts of personal data and its content hash. Only one Python stage."""
    out = redacted(normalised(df, text, "_n"), "_n", "_r")
    return out.withColumn(text, F.col("_r.text")).withColumn("pii", F.col("_r.counts")).withColumn("content_hash", content_hash(F.col(text), F.lit(None).cast("string"))).drop("_n", "_r")


def ingest(store: Snapshots, batch: DataFrame, key: str, text: str, order: str) -> dict[str, int]:
    """Writes a new version: good rows of the batch, the last of each key by ``order``, merged into the current one."""
    checked = validated(batch, key, text)
    good = latest_per_key(prepared(checked.where("size(errors) = 0").drop("errors"), text), [key], F.desc(order), "content_hash")
    merged = upserted(store.read(), good, key) if store.versions() else good.withColumn("op", F.lit("created"))
    version = store.write(merged)
    ops = {r["op"]: r["count"] for r in store.read(version).groupBy("op").count().collect()}
    rows = store.read(version).drop("op")
    return {"version": store.write(rows), "created": ops.get("created", 0), "updated": ops.get("updated", 0), "quarantined": checked.where("size(errors) > 0").count()}


# --- Checks of rows: each is true where a value is wrong. A null value is wrong only for ``required``.


def required(c: str) -> Column:
    return F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")


def not_one_of(c: str, values: list) -> Column:
    return ~F.col(c).isin(values)


def not_like(c: str, pattern: str) -> Column:
    """Values that a pattern doesn't match as wholes."""
    return ~F.col(c).rlike(f"^(?:{pattern})$")


def not_uuid(c: str) -> Column:
    return not_like(c, "[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")


def length_outside(c: str, least: int, most: int) -> Column:
    return ~F.length(c).between(least, most)


def out_of_range(c: str, least: float, most: float) -> Column:
    return ~F.col(c).between(least, most)


def with_errors(df: DataFrame, checks: dict[str, Column], to: str = "errors") -> DataFrame:
    """Adds an array of the names of checks that a row fails, in their order; rows with an empty one are good, others for quarantine."""
    return df.withColumn(to, F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()])))


def unknown_labels(df: DataFrame, column: str, taxonomy: DataFrame, label: str) -> DataFrame:
    """Rows whose label isn't null and not in the taxonomy."""
    return df.where(F.col(column).isNotNull()).join(taxonomy.select(F.col(label).alias(column)).distinct(), column, "left_anti")


def ingest_into(store: MergeTable, batch: DataFrame, text: str, order: str, batch_id: int | None = None, source: str = "", checks: dict[str, Column] | None = None) -> dict[str, int]:
    """Merges a batch's good rows into a table by bucket: counts of rows created, updated, unchanged and quarantined, and of buckets written.

    The batch is checked and prepared once, and written; the merge and the counts read that. A numbered batch that comes again changes nothing.
    """
    rows = validated(batch, store.key, text) if checks is None else with_errors(batch, checks)
    rows = written(rows, f"{store.path}/checked/{uuid.uuid4().hex}")
    good = prepared(rows.where("size(errors) = 0").drop("errors"), text)
    counts = store.merge(good, [F.desc(order), F.asc("content_hash")], batch_id, source)
    return counts | {"quarantined": rows.where("size(errors) > 0").count()}

"""A content-addressed archive of WARC records.

Payload bytes are stored once, by SHA-256; exact record headers are stored in a table of their own; records come from a join
of both. Reading verifies both digests and the length against what the payload's bytes give.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace

#: Payloads of fewer bytes are never revisits.
LEAST = 1000
_URN = "urn:lumenquarry:page:"


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def _id(page_id: Column) -> Column:
    return F.concat(F.lit(f"<{_URN}"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def write_archive(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", least: int = LEAST) -> None:
    """Writes ``path``/payloads (digest, holder, payload) and ``path``/records (digest, header).

    pages has page_id, url and html. A null html is an empty payload. Of equal payloads of ``least`` bytes or more the
    largest page_id's record is the response and the others revisit it; rows that share this id, or all rows where every id is
    null, are responses. A null url is empty; line ends within a url are percent-encoded.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    # Equal payloads meet on the map side first: one row for each digest and task is shuffled.
    store = rows.groupBy("digest").agg(F.max("page_id").alias("holder"), F.first("payload").alias("payload"))
    store.write.mode("errorifexists").parquet(f"{path}/payloads")
    holders = spark.read.schema(store.schema).parquet(f"{path}/payloads").select("digest", "holder")
    light = rows.select("page_id", "url", "digest", F.sha1("payload").alias("sha1"), F.octet_length("payload").alias("n"))
    light = light.join(holders, "digest")
    revisit = (F.col("n") >= least) & ~F.coalesce(F.col("page_id") == F.col("holder"), F.col("holder").isNull())
    url = F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"), _line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))), _line("WARC-Record-ID", _id(F.col("page_id"))),
        _line("WARC-Target-URI", url), _line("WARC-Date", F.lit(date)), _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, F.concat(_line("WARC-Refers-To", _id(F.col("holder"))), _line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(F.lit("")),
        _line("Content-Type", F.lit("text/html; charset=utf-8")), _line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("n")).cast("string")), F.lit("\r\n"),
    )
    light.select("digest", header.alias("header")).write.mode("errorifexists").parquet(f"{path}/records")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """header, payload, payload_bytes, payload_digest, record_type, record (exact bytes): records joined with verified payloads.

    What isn't selected isn't read or shuffled: digests and lengths are taken where the payloads lie.
    """
    store = spark.read.schema("digest string, payload binary").parquet(f"{path}/payloads")
    checked = store.select("digest", "payload", F.sha2("payload", 256).alias("found"), F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("bigint").alias("payload_bytes"))
    rows = spark.read.schema("digest string, header string").parquet(f"{path}/records").join(checked, "digest", "left")
    kind, length = field("header", "WARC-Type"), F.try_to_number(field("header", "Content-Length"), F.lit("999999999999")).cast("bigint")
    sound = (F.col("found") == F.col("digest")) & (field("header", "WARC-Payload-Digest") == F.concat(F.lit("sha1:"), F.col("sha1"))) & (length == F.when(kind == "revisit", 0).otherwise(F.col("payload_bytes")))
    digest = F.when(F.coalesce(sound, F.lit(False)), F.col("sha1")).otherwise(F.raise_error(F.concat(F.lit("payload is missing or damaged: "), "digest")))
    body = F.when(kind == "revisit", F.lit(b"").cast("binary")).otherwise(F.col("payload"))
    record = F.concat(F.col("header").cast("binary"), body, F.lit("\r\n\r\n").cast("binary"))
    return rows.select("header", "payload", "payload_bytes", digest.alias("payload_digest"), kind.alias("record_type"), record.alias("record"))


def field(header: str, name: str) -> Column:
    return F.regexp_extract(header, f"\r\n{name}: ([^\r\n]*)\r\n", 1)


def page_of(header: str, name: str) -> Column:
    """The page_id in a record's id, as text; null if there is none."""
    return F.nullif(F.regexp_extract(header, f"\r\n{name}: <{_URN}([^>]*)>\r\n", 1), F.lit(""))


def archived(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes the archive and reads it: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    path = path or Workspace(spark, "archive").path
    write_archive(pages, path)
    kind = pages.schema["page_id"].dataType
    rows = read_archive(spark, path)
    return rows.select(page_of("header", "WARC-Record-ID").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of("header", "WARC-Refers-To").cast(kind).alias("refers_to"))


def export_warc(spark: SparkSession, path: str, to: str, compression: str = "gzip") -> None:
    """Standard WARC files: records one after the other, each ended by two line ends."""
    record = F.concat("header", F.when(F.col("record_type") == "revisit", F.lit("")).otherwise(F.col("payload").cast("string")))
    read_archive(spark, path).select(record.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", compression).text(to)


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import gzip
    import re

    for batch in batches:
        for content in batch["content"]:
            data, at, out = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content, 0, []
            while at < len(data):
                end = data.index(b"\r\n\r\n", at) + 4
                n = int(re.search(rb"\r\nContent-Length: (\d+)\r\n", data[at:end])[1])
                out.append((data[at:end].decode(), data[end : end + n]))
                at = end + n + 4
            yield pd.DataFrame(out, columns=["header", "payload"])


def import_warc(spark: SparkSession, path: str) -> DataFrame:
    """header and body of each record in WARC files, plain or gzip. A file is parsed by one task: keep files small."""
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(_parsed, "header string, payload binary")

"""From raw documents to packed sequences. Each stage takes (spark, docs, sf_dir); its result is written and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenquarry.llm import secrets
from lumenquarry.llm.common import Workspace, table
from lumenquarry.llm.decontamination import without_contaminated
from lumenquarry.llm.near_duplicates import first_documents
from lumenquarry.llm.packing import pack, pieces
from lumenquarry.llm.quality_rules import kept_documents
from lumenquarry.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return first_documents(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced; a null or empty text stays as it is, repeated rows are treated alike."""
    return secrets.redacted(docs, secrets.train(secrets.sample(spark, secrets.ordinary_words(docs))))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of tokenised documents and their places in sequences."""
    return pack(pieces(docs.select("doc_id", "text"), tokenizer_path()))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scans", secret_scans),
    ("packing", packing),
]

#: Chains of near duplicates, Markov models, tokenising and best fit aren't SQL; tests compare with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = work.keep(stage(spark, docs, sf_dir), f"{i}-{name}")
    return docs

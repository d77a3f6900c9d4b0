"""What the operators share: reading tables, and tables kept in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import spread, written


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table, dealt to all cores if it is small. Others, whatever their names, are never read."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns))


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, as in tests on one machine, a new one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="lumenquarry-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


class Workspace:
    """Tables that one call of an operator writes to the shared folder and reads again.

    A written table cuts lineage: losing executors costs no more than the stage that runs, and shuffle files behind it are removed.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        return written(df, f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        """Removes tables that nothing reads any more."""
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def drop_others(self, *names: str) -> None:
        """Removes all tables but the named ones."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        self.drop(*[name for s in fs.listStatus(path) if (name := s.getPath().getName()) not in names])


def text_or_empty(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def unused(df: DataFrame, name: str) -> str:
    """A name that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def broadcast_if_small(df: DataFrame, rows: int, most: int = 200_000) -> DataFrame:
    """A broadcast hint for a table known to have few rows; a larger one is joined by a shuffle."""
    return F.broadcast(df) if rows <= most else df

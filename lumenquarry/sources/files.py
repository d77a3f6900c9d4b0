"""Sources and sinks: tables, JSON lines, versioned snapshots."""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Up to so many bytes for each core, a table in fewer files than cores is worth a shuffle.
SPREAD_BYTES = 32 * 2**20


def spread(df: DataFrame) -> DataFrame:
    """A small table that lies in fewer files than there are cores, dealt to all cores; others stay as they are.

    A file of one row group is read by one task, however the scan is split. Spark pushes filters and columns below the deal.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores:
        return df
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size <= cores * SPREAD_BYTES else df


#: Rows of one task where groups or joins hold what they read.
TASK_ROWS = 250_000


def tasks(rows: int) -> int:
    """Tasks for so many rows, each of about TASK_ROWS."""
    return max(1, -(-rows // TASK_ROWS))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a declared schema; blank lines are skipped, broken ones stay in ``_corrupt_record``."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    kind = T._parse_datatype_string(schema)
    kind = T.StructType([*kind.fields, T.StructField("_corrupt_record", T.StringType())])
    return lines.select(F.from_json("value", kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r")).select("r.*")


def write_jsonl(df: DataFrame, path: str, compression: str = "none") -> None:
    df.write.mode("errorifexists").option("compression", compression).json(path)


def taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """(dimension, label_id, team, description, keywords, examples, rank) of a seed {dimension: [label, ...]}; rank is the place in the list."""
    label = "array<struct<id:string,team:string,description:string,keywords:array<string>,examples:array<string>>>"
    one = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string,{label}>")).alias("dimension", "labels"))
    return one.select("dimension", F.posexplode("labels").alias("rank", "l")).select("dimension", F.col("l.id").alias("label_id"), "l.team", "l.description", "l.keywords", "l.examples", "rank")


class Snapshots:
    """A table in numbered versions. A version is written whole, then named as current; readers never see half of one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _fs(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def versions(self) -> list[int]:
        """Versions whose write has ended."""
        fs, path = self._fs("")
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and fs.exists(self._fs(f"{n}/_SUCCESS")[1]))

    def read(self, version: int | None = None) -> DataFrame:
        found = self.versions()
        if not found:
            raise FileNotFoundError(f"{self.path} has no version")
        return self.spark.read.parquet(f"{self.path}/v{found[-1] if version is None else version}")

    def write(self, df: DataFrame) -> int:
        """One writer at a time; a version left by a failed write is overwritten."""
        version = (self.versions() or [0])[-1] + 1
        df.write.mode("overwrite").parquet(f"{self.path}/v{version}")
        return version


def metric_samples(spark: SparkSession, path: str) -> DataFrame:
    """(name, labels, value) of text files in the exposition format of scraped metrics."""
    lines = spark.read.text(path).where("value not like '#%' and trim(value) <> ''")
    part = lambda i: F.regexp_extract("value", r"^([A-Za-z_:][A-Za-z0-9_:]*)(\{[^}]*\})?\s+([^\s]+)", i)
    return lines.select(part(1).alias("name"), part(2).alias("labels"), F.expr("try_cast(regexp_extract(value, '^([A-Za-z_:][A-Za-z0-9_:]*)(\\\\{[^}]*\\\\})?\\\\s+([^\\\\s]+)', 3) as double)").alias("value"))


def metric_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    keys = ["name", "labels"]
    both = before.withColumnRenamed("value", "a").join(after.withColumnRenamed("value", "b"), keys, "full_outer")
    return both.select(*keys, (F.coalesce("b", F.lit(0.0)) - F.coalesce("a", F.lit(0.0))).alias("delta"))


def cursor(values: dict) -> str:
    import base64

    return base64.urlsafe_b64encode(json.dumps(values, sort_keys=True).encode()).decode()


def from_cursor(text: str) -> dict:
    import base64

    return json.loads(base64.urlsafe_b64decode(text))


_KEPT: dict[tuple, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which all executors share; where that is unset on one machine, as in tests, a new one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        found = tempfile.mkdtemp(prefix="lumenquarry-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one."""
    import uuid

    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries that are run meanwhile remove their shuffle files as they end, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(df: DataFrame, path: str, *by: str) -> DataFrame:
    """The rows as a table that is written once: what is read from it later is fixed, whatever is lost, and nothing that was shuffled for it stays."""
    with shuffles_removed(df.sparkSession):
        df.write.mode("overwrite").partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """A written table of narrow rows, for one side of a join: broadcast where it has at most so many, which are counted."""
    return F.broadcast(df) if df.count() <= most else df


def kept(spark: SparkSession, name: str, source: str, build) -> str:
    """The folder of something built from the table at ``source`` by ``build(path)``: once for each session and state of the source's files."""
    path = spark._jvm.org.apache.hadoop.fs.Path(source)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    status = fs.getFileStatus(path)
    files = [status] if status.isFile() else list(fs.listStatus(path))
    state = tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files))
    key = (spark.sparkContext.applicationId, name, source, state)
    if key not in _KEPT:
        to = scratch(spark, name)
        build(to)
        _KEPT[key] = to
    return _KEPT[key]


def removed(spark: SparkSession, *paths: str) -> None:
    """Deletes folders that nothing reads any more."""
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

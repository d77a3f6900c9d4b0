"""A table of one row for each key that takes batches of changes: hash buckets, of which a batch rewrites those it touches, and a manifest."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 64


class MergeTable:
    """A keyed table in a folder, for one writer at a time.

    Rows lie in ``buckets`` folders by a hash of the key. A manifest, written whole under the next number, names the folder of each bucket and the
    batches that are in; the largest number counts. Readers see one manifest and so never half of a batch, and a write that fails leaves
    folders that no manifest names. A batch reads and rewrites only buckets that hold one of its keys; one that was taken before changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str, buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.schema = T._parse_datatype_string(schema)

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def manifest(self) -> dict:
        """The newest manifest: number, folder by bucket, batches by source."""
        fs, path = self._path("manifests")
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        numbers = [int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()]
        if not numbers:
            return {"number": 0, "buckets": {}, "batches": {}}
        text = self.spark.read.text(f"{self.path}/manifests/{max(numbers)}.json", wholetext=True).head()[0]
        return json.loads(text)

    def _publish(self, manifest: dict) -> None:
        fs, draft = self._path(f"manifests/.{uuid.uuid4().hex}")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if not fs.rename(draft, self._path(f"manifests/{manifest['number']}.json")[1]):
            raise RuntimeError(f"manifest {manifest['number']} exists: another writer was faster")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _rows(self, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        found = [folder for b, folder in manifest["buckets"].items() if buckets is None or int(b) in buckets]
        if not found:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in sorted(found)])

    def read(self) -> DataFrame:
        return self._rows(self.manifest())

    def merge(self, batch: DataFrame, order: list[Column], batch_id: int | None = None, source: str = "", keep: list[str] | None = None, when: Column | None = None, fill: bool = False) -> dict[str, int]:
        """Takes a batch with the table's columns; returns counts of rows created, updated, left as they were, and buckets written.

        Of a batch's rows with one key the first in ``order`` counts; a null key is left out. An existing row is replaced but for the columns in
        ``keep``, where ``when`` (a condition on ``old`` and ``new``, structs) holds; with ``fill`` only its nulls are replaced. ``batch_id`` numbers the
        batches of a source; one that isn't above the last taken is left out, so a batch may come twice.
        """
        manifest, names = self.manifest(), self.schema.fieldNames()
        none = {"created": 0, "updated": 0, "unchanged": 0, "buckets": 0}
        if batch_id is not None and batch_id <= manifest["batches"].get(source, -1):
            return none
        new = batch.select(*names).where(F.col(self.key).isNotNull())
        new = new.withColumn("_n", F.row_number().over(Window.partitionBy(self.key).orderBy(*order))).where("_n = 1").drop("_n")
        work = f"data/{uuid.uuid4().hex}"
        new = self._written(new.withColumn("bucket", self._bucket()), f"{work}/batch").drop("bucket")
        touched = sorted(r[0] for r in new.select(self._bucket()).distinct().collect())  # at most ``buckets``
        manifest = manifest | {"number": manifest["number"] + 1, "batches": manifest["batches"] | ({source: batch_id} if batch_id is not None else {})}
        counts = none
        if touched:
            old = self._rows(manifest, touched)
            one = lambda df, name: df.select(F.col(self.key).alias(f"{name}_key"), F.struct(*names).alias(name))
            both = one(old, "old").join(one(new, "new"), F.col("old_key") == F.col("new_key"), "full_outer")
            put = F.col("new").isNotNull() & (F.col("old").isNull() | (F.coalesce(when, F.lit(False)) if when is not None else F.lit(True)))

            def chosen(c: str) -> Column:
                o, n = F.col(f"old.{c}"), F.col(f"new.{c}")
                if c in (keep or []):
                    n = F.when(F.col("old").isNull(), n).otherwise(o)
                elif fill:
                    n = F.coalesce(o, n)
                return F.when(put, n).otherwise(o).alias(c)

            rows = both.select(*[chosen(c) for c in names], F.col("old").isNull().alias("_created"), put.alias("_put"), F.col("old").alias("_old"))
            rows = rows.withColumn("_same", ~F.col("_created") & self._comparable("").eqNullSafe(self._comparable("_old."))).withColumn("bucket", self._bucket())
            # Counts are facts about the written rows: nothing is evaluated twice.
            rows = self._written(rows.drop("_old"), work, partition="bucket")
            c = rows.agg(F.count_if("_created"), F.count_if(F.col("_put") & ~F.col("_created") & ~F.col("_same")), F.count_if(F.col("_put") & F.col("_same") | ~F.col("_put"))).head()
            changed = [r[0] for r in rows.where("_created or not _same").select("bucket").distinct().collect()]
            counts = {"created": c[0], "updated": c[1], "unchanged": c[2], "buckets": len(changed)}
            manifest["buckets"] = manifest["buckets"] | {str(b): f"{work}/bucket={b}" for b in changed}
        self._publish(manifest)
        return counts

    def _comparable(self, prefix: str) -> Column:
        """All columns of a row as one value that has an equality: maps as sorted entries."""
        return F.struct(*[F.array_sort(F.map_entries(f"{prefix}{f.name}")) if isinstance(f.dataType, T.MapType) else F.col(f"{prefix}{f.name}") for f in self.schema.fields])

    def _written(self, rows: DataFrame, name: str, partition: str | None = None) -> DataFrame:
        writer = rows.repartition(self.buckets, "bucket").write.mode("overwrite") if partition else rows.write.mode("overwrite")
        (writer.partitionBy(partition) if partition else writer).parquet(f"{self.path}/{name}")
        return self.spark.read.schema(rows.schema).parquet(f"{self.path}/{name}")

    def sink(self, source: str, *order: Column):
        """A foreachBatch function: each micro-batch is taken once, however often it comes."""

        def run(batch: DataFrame, batch_id: int) -> None:
            self.merge(batch, list(order), batch_id, source)

        return run

    def vacuum(self) -> None:
        """Deletes folders that the newest manifest doesn't name; for when no reader of an older one is left."""
        used = {f.split("/")[1] + "/" + f.split("/")[2] for f in self.manifest()["buckets"].values()}
        fs, path = self._path("data")
        for work in fs.listStatus(path) if fs.exists(path) else []:
            for part in fs.listStatus(work.getPath()):
                if f"{work.getPath().getName()}/{part.getPath().getName()}" not in used and part.isDirectory():
                    fs.delete(part.getPath(), True)

"""Merges that rewrite touched buckets alone, and batches that come twice."""

from pyspark.sql import functions as F

from lumenquarry.sources.merge import MergeTable

SCHEMA = "id bigint, text string, note string, at int"


def state(t):
    return {r["id"]: (r["text"], r["note"], r["at"]) for r in t.read().collect()}


def folders(t):
    return t.manifest()["buckets"]


def test_merge(spark, tmp_path):
    t = MergeTable(spark, str(tmp_path / "t"), "id", SCHEMA, buckets=8)
    assert t.read().count() == 0
    rows = [(i, f"a{i}", None, 1) for i in range(100)] + [(None, "x", "y", 1), (5, "older", None, 0)]
    batch = spark.createDataFrame(rows, SCHEMA).withColumn("bucket_", F.lit("clash"))
    order = [F.desc("at"), F.asc("text")]
    assert t.merge(batch, order, 0, "s") == {"created": 100, "updated": 0, "unchanged": 0, "buckets": 8}
    assert state(t) == {i: (f"a{i}", None, 1) for i in range(100)}
    before = folders(t)
    assert t.merge(batch, order, 0, "s")["buckets"] == 0 and folders(t) == before  # it comes again
    assert t.merge(batch, order)["buckets"] == 0 and folders(t) == before  # equal rows change nothing
    one = spark.createDataFrame([(7, "b7", "n", 2)], SCHEMA)
    got = t.merge(one, order, 1, "s")
    assert got["updated"] == 1 and got["buckets"] == 1 and sum(folders(t)[b] != before[b] for b in before) == 1
    assert state(t)[7] == ("b7", "n", 2) and len(state(t)) == 100
    # Conditional, partial and filling updates.
    older = F.col("new.at") > F.col("old.at")
    assert t.merge(spark.createDataFrame([(7, "old", "z", 1), (8, "b8", "z", 3)], SCHEMA), order, when=older)["updated"] == 1
    assert state(t)[7] == ("b7", "n", 2) and state(t)[8] == ("b8", "z", 3)
    t.merge(spark.createDataFrame([(8, "c8", "q", 4), (9, "c9", "q", 4)], SCHEMA), order, keep=["text"])
    assert state(t)[8] == ("b8", "q", 4) and state(t)[9] == ("a9", "q", 4)
    t.merge(spark.createDataFrame([(9, "d9", "r", 5), (10, "d10", "r", 5)], SCHEMA), order, fill=True)
    assert state(t)[9] == ("a9", "q", 4) and state(t)[10] == ("a10", "r", 1)
    t.vacuum()
    assert len(state(t)) == 100 and t.merge(batch.where("false"), order)["buckets"] == 0


def test_stream_of_batches(spark, tmp_path):
    spark.createDataFrame([(i, "x", None, i) for i in range(50)], SCHEMA).repartition(3).write.parquet(str(tmp_path / "in"))
    t = MergeTable(spark, str(tmp_path / "t"), "id", SCHEMA, buckets=4)
    run = t.sink("log", F.desc("at"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream.writeStream.foreachBatch(run).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(90)
    last = t.manifest()
    assert len(state(t)) == 50 and last["batches"] == {"log": 2}
    run(spark.createDataFrame([(99, "late", None, 1)], SCHEMA), 2)  # a batch number that was taken
    assert t.manifest() == last


def test_ingestion_by_bucket(spark, tmp_path):
    from lumenquarry.sources import ingest

    schema = "id int, text string, seq int, pii map<string,int>, content_hash string"
    t = MergeTable(spark, str(tmp_path / "t"), "id", schema, buckets=4)
    batch = spark.createDataFrame([(1, "first a@b.io", 1), (1, "second", 2), (2, "  ", 1), (None, "x", 1), (3, "<b>c</b> a@b.io", 1)], "id int, text string, seq int")
    got = ingest.ingest_into(t, batch, "text", "seq", 0, "log")
    assert (got["created"], got["updated"], got["quarantined"]) == (2, 0, 2)
    before = folders(t)
    assert ingest.ingest_into(t, batch, "text", "seq", 0, "log")["created"] == 0 and folders(t) == before
    rows = {r["id"]: (r["text"], r["pii"]) for r in t.read().collect()}
    assert rows == {1: ("second", {}), 3: ("c [EMAIL]", {"EMAIL": 1})}
    strict = {"short": ingest.length_outside("text", 7, 99), "missing": ingest.required("id")}
    errors = [r["errors"] for r in ingest.with_errors(batch, strict).orderBy("seq", "text").collect()]
    assert errors.count(["short"]) == 2 and errors.count(["short", "missing"]) == 1 and errors.count([]) == 2

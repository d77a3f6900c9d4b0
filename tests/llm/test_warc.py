import hashlib

import pytest
from lumenquarry.llm import warc
from lumenquarry.llm.queries import op5_warc


def want(rows, least=1000):
    sha = lambda h: hashlib.sha1((h or "").encode()).hexdigest()
    best = {}
    for i, h in rows:
        best[h or ""] = max(best.get(h or "", i), i)
    out = {}
    for i, h in rows:
        n, b = len((h or "").encode()), best[h or ""]
        again = n >= least and i != b
        out[i] = (n, sha(h), "revisit" if again else "response", b if again else None)
    return out


def got(df):
    return {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()}


def test_whole_table(spark, sf_dir):
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    assert got(op5_warc(spark, sf_dir)) == want(rows)


ROWS = [(1, "a" * 1000), (2, "a" * 1000), (3, "a" * 999), (4, "a" * 999), (5, None), (6, ""), (7, "é" * 500 + "\r\n\r\nWARC/1.1\r\n"), (8, "é" * 500 + "\r\n\r\nWARC/1.1\r\n"), (9, "x" * 400_000)]


def test_copies_and_round_trip(spark, tmp_path):
    d = spark.createDataFrame([(i, None if i == 3 else f"http://h/{i}\r\nX: y", h, "d") for i, h in ROWS], "page_id bigint, url string, html string, digest string")
    path = str(tmp_path / "archive")
    assert got(warc.archived(d, path)) == want(ROWS)
    assert spark.read.parquet(f"{path}/payloads").count() == len({h or "" for _, h in ROWS})
    warc.export_warc(spark, path, str(tmp_path / "files"))
    back = warc.import_warc(spark, str(tmp_path / "files/*.gz"))
    pages = {}
    for r in back.collect():
        assert r.header.startswith("WARC/1.1\r\nWARC-Type: ") and r.header.count("\r\n\r\n") == 1
        pages[int(r.header.split("page:")[1].split(">")[0])] = bytes(r.payload)
    kinds = {i: k for i, (_, _, k, _) in want(ROWS).items()}
    assert pages == {i: b"" if kinds[i] == "revisit" else (h or "").encode() for i, h in ROWS}
    records = {bytes(r.record) for r in warc.read_archive(spark, path).select("record").collect()}
    assert {x["header"].encode() + bytes(x["payload"]) + b"\r\n\r\n" for x in back.collect()} == records


def test_null_ids_repeated_rows_and_no_rows(spark):
    d = spark.createDataFrame([(None, "u", "b" * 2000)] * 2 + [(4, "u", "c" * 2000)] * 2 + [(None, "u", "c" * 2000)], "page_id bigint, url string, html string")
    rows = sorted((str(r.page_id), r.record_type, str(r.refers_to)) for r in warc.archived(d).collect())
    assert rows == [("4", "response", "None")] * 2 + [("None", "response", "None")] * 2 + [("None", "revisit", "4")]
    assert warc.archived(d.limit(0)).count() == 0


def test_damage_is_found(spark, tmp_path):
    path = str(tmp_path / "archive")
    warc.write_archive(spark.createDataFrame([(1, "u", "abc")], "page_id bigint, url string, html string"), path)
    spark.read.parquet(f"{path}/payloads").selectExpr("digest", "holder", "cast('abd' as binary) as payload").write.parquet(str(tmp_path / "p"))
    spark.read.parquet(str(tmp_path / "p")).write.mode("overwrite").parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="missing or damaged"):
        warc.read_archive(spark, path).collect()

import random

import brute
import lumenquarry.llm.near_duplicates as nd
from lumenquarry.llm import families
from lumenquarry.llm.near_duplicates import near_duplicates
from lumenquarry.llm.queries import op6_near_duplicates


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def test_whole_table_against_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert result(op6_near_duplicates(spark, sf_dir)) == brute.near_duplicates(rows)


def test_a_larger_table_against_brute_force(spark):
    """Recall of links at sf0.01: all of them."""
    found = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{found}/documents.parquet").select("doc_id", "text").collect()]
    assert result(op6_near_duplicates(spark, found)) == brute.near_duplicates(rows)


def test_families_of_many_blocks(spark, monkeypatch):
    """Small blocks and buckets, so that groups take representatives, levels and meetings: members linked with the centre alone, chains and near misses."""
    monkeypatch.setattr(families, "BLOCK", 4000)
    monkeypatch.setattr(nd, "SMALL", 4)
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))

    def changed(words, times):
        x = list(words)
        for i in r.sample(range(len(x)), times):
            x[i] = word()
        return x

    base = [word() for _ in range(100)]
    rows = [(1000, " ".join(base))]
    rows += [(1001 + i, " ".join(changed(base, r.choice((1, 2, 2, 3, 4))))) for i in range(300)]
    chain = [word() for _ in range(70)]
    for i in range(200):
        chain = changed(chain, 1)
        rows.append((5000 - i, " ".join(chain)))
    r.shuffle(rows)
    assert result(near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))) == brute.near_duplicates(rows)


def test_a_family_of_20000(spark):
    """Copies of one text with a word changed: all are linked, whatever the order of their ids."""
    r = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    rows = [(7 * i % 20011, " ".join(base[:k] + [f"x{i}"] + base[k + 1 :])) for i in range(20_000) for k in [r.randrange(60)]]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).groupBy("component_id").count().collect()
    assert [(x["component_id"], x["count"]) for x in got] == [(0, 20_000)]


def test_chains_and_a_large_group(spark):
    """Documents that drift away from the first one word at a time: neighbours are linked, ends aren't."""
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    now, rows = [word() for _ in range(60)], []
    for i in range(80):
        rows.append((i, " ".join(now)))
        now[r.randrange(60)] = word()
    base = [word() for _ in range(100)]
    for i in range(100, 300):
        x = list(base)
        x[r.randrange(100)] = word()
        rows.append((i, " ".join(x).upper()))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert result(near_duplicates(df)) == brute.near_duplicates(rows)


def test_odd_rows(spark):
    long = "word " * 200_000
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE\x0btwo"), (6, long), (7, long), (None, "one two"), (None, None), (8, "Ünï"), (9, "ünï"), (10, "a\xa0b")]
    df = spark.createDataFrame([(a, b, 1, "x") for a, b in rows], "doc_id bigint, text string, cls int, keys string")
    got = {(r.doc_id, r.component_id, r.kept, r.n_shingles) for r in near_duplicates(df).collect()}
    assert got == {
        (1, 1, True, 0), (2, 2, True, 0), (3, 3, True, 0), (4, 4, True, 1), (5, 4, False, 1), (6, 6, True, 1), (7, 6, False, 1),
        (None, 4, False, 1), (None, None, True, 0), (8, 8, True, 1), (9, 9, True, 1), (10, 10, True, 1),
    }


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b c d e f")] * 3 + [(2, "a b c d e f")], "doc_id bigint, text string")
    rows = near_duplicates(df).collect()
    assert [(r.doc_id, r.component_id, r.kept) for r in sorted(rows)] == [(1, 1, True)] * 3 + [(2, 1, False)]
    assert near_duplicates(df.limit(0)).count() == 0

import random

import brute
import numpy as np
import pytest
from lumenquarry.llm import families, set_join
from lumenquarry.llm.queries import op13_ngram_jaccard_join
from lumenquarry.llm.set_join import Index, jaccard_join, linked


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def expected(rows):
    return {d: x[:2] for d, x in brute.near_duplicates(rows, 80).items()}


def word(r):
    return "".join(r.choice("abcdefgh") for _ in range(6))


def changed(r, words, times):
    x = list(words)
    for i in r.sample(range(len(x)), times):
        x[i] = word(r)
    return x


@pytest.mark.parametrize("scale", ["0.001", "0.01"])
def test_whole_tables_against_brute_force(spark, scale):
    found = f"/root/testdata/sf{scale}"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{found}/documents.parquet").select("doc_id", "text").collect()]
    assert result(op13_ngram_jaccard_join(spark, found)) == expected(rows)


def test_families_of_many_blocks(spark, monkeypatch):
    """Small blocks and lists: members linked with the centre alone, chains, and near misses."""
    monkeypatch.setattr(families, "BLOCK", 4000)
    monkeypatch.setattr(set_join, "SMALL", 4)
    r = random.Random(2)
    base, chain = [word(r) for _ in range(100)], [word(r) for _ in range(70)]
    rows = [(1000, " ".join(base))] + [(1001 + i, " ".join(changed(r, base, r.choice((1, 1, 2, 2, 3, 4))))) for i in range(300)]
    for i in range(200):
        chain = changed(r, chain, 1)
        rows.append((5000 - i, " ".join(chain)))
    for i in range(60):  # one passage in texts of many sizes
        rows.append((6000 + i, " ".join([*base[:60], *[word(r) for _ in range(i)]])))
    r.shuffle(rows)
    assert result(jaccard_join(spark.createDataFrame(rows, "doc_id bigint, text string"))) == expected(rows)


def test_a_family_of_20000(spark):
    r = random.Random(3)
    base = [f"w{i}" for i in range(80)]
    rows = [(7 * i % 20011, " ".join(base[:k] + [f"x{i}"] + base[k + 1 :])) for i in range(20_000) for k in [r.randrange(80)]]
    got = jaccard_join(spark.createDataFrame(rows, "doc_id bigint, text string")).groupBy("component_id").count().collect()
    assert [(x["component_id"], x["count"]) for x in got] == [(0, 20_000)]


def test_odd_rows(spark):
    long = "word " * 200_000
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE\x0btwo"), (6, long), (7, long), (None, "one two"), (None, None), (8, "Ünï"), (9, "ünï"), (10, "a\xa0b")]
    df = spark.createDataFrame([(a, b, 1, "x") for a, b in rows], "doc_id bigint, text string, cls int, bits string")
    got = {(r.doc_id, r.component_id, r.n_shingles) for r in jaccard_join(df).collect()}
    assert got == {(1, 1, 0), (2, 2, 0), (3, 3, 0), (4, 4, 1), (5, 4, 1), (6, 6, 1), (7, 6, 1), (None, 4, 1), (None, None, 0), (8, 8, 1), (9, 9, 1), (10, 10, 1)}


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b c d e f")] * 3 + [(2, "a b c d e f")], "doc_id bigint, text string")
    assert sorted((r.doc_id, r.component_id) for r in jaccard_join(df).collect()) == [(1, 1)] * 3 + [(2, 1)]
    assert jaccard_join(df.limit(0)).count() == 0


def sets(seed, count=120):
    r = np.random.default_rng(seed)
    out = []
    for _ in range(count // 4):
        base = r.integers(0, 2**63, r.integers(1, 90), dtype=np.uint64)
        for _ in range(4):
            keep = base[r.random(len(base)) < 0.95]
            out.append(np.unique(np.concatenate([keep, r.integers(0, 2**63, r.integers(0 if len(keep) else 1, 6), dtype=np.uint64)])))
    return out


@pytest.mark.parametrize("seed", range(5))
def test_an_index_gives_all_answers(seed):
    found = sets(seed)
    index, plain = Index(found), [set(s.tolist()) for s in found]
    ok = np.array([[100 * len(a & b) >= 80 * len(a | b) for b in plain] for a in plain])
    for x in range(len(found)):
        assert set(np.flatnonzero(ok[x])) - {x} <= set(index.candidates(x))  # nothing linked is skipped
        assert (index.answers(x) == ok[x]).all()
    assert (index.parent >= 0).sum() > len(found) / 4  # many answers were derived
    tree = linked(found, np.arange(len(found)), np.ones(len(found), bool), np.ones(len(found), bool))
    reach = np.arange(len(found))
    for _ in found:
        reach = np.array([reach[ok[x]].min() for x in range(len(found))])
    assert (tree == reach).all()


def test_between_two_sides():
    found = sets(9)
    left, right = np.arange(len(found)) % 2 == 0, np.arange(len(found)) % 3 == 0
    plain = [set(s.tolist()) for s in found]
    roots = np.arange(len(found)) // 2  # pairs are linked already
    tree = linked(found, roots, left, right)
    parent = {i: i for i in set(roots.tolist())}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in np.flatnonzero(left):
        for b in np.flatnonzero(right):
            if 100 * len(plain[a] & plain[b]) >= 80 * len(plain[a] | plain[b]):
                x, y = sorted((top(roots[a]), top(roots[b])))
                parent[y] = x
    assert [roots[t] for t in tree] == [top(x) for x in roots]


def test_bitmaps_never_rule_a_link_out(spark):
    from pyspark.sql import functions as F

    r, rows = np.random.default_rng(1), []
    for n in (3, 450, 511, 512, 513, 900, 1025, 3000):
        base = r.integers(0, 2**63, n, dtype=np.uint64)
        for extra in (0, n // 9, n // 4):
            other = np.unique(np.concatenate([base, r.integers(0, 2**63, extra, dtype=np.uint64)]))
            base_ = np.unique(base)
            rows.append((len(base_), set_join.bitmap(base_).tolist(), len(other), set_join.bitmap(other).tolist(), 100 * len(base_) >= 80 * len(other)))
        far = np.unique(r.integers(0, 2**63, n, dtype=np.uint64))
        rows.append((len(base_), set_join.bitmap(base_).tolist(), len(far), set_join.bitmap(far).tolist(), False))
    df = spark.createDataFrame(rows, "n bigint, a array<bigint>, m bigint, b array<bigint>, linked boolean")
    got = df.withColumn("allow", set_join._bits_allow(F.col("n"), F.col("a"), F.col("m"), F.col("b"), 80)).collect()
    assert all(x["allow"] for x in got if x["linked"]) and sum(x["allow"] for x in got if not x["linked"]) == 0

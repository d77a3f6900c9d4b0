"""Hand-computed values of scalar functions and statistics."""

import random

import pytest
from pyspark.sql import functions as F

from lumenquarry.functions import stats, text


def test_statistics():
    assert stats.chi2_sf(5, 2) == pytest.approx(0.0820849986, abs=1e-9)
    assert stats.chi2_sf(30.1, 4) == pytest.approx(4.66e-06, rel=2e-2)
    assert stats.hypergeom_sf(8, 200, 70, 12) == pytest.approx(0.0219586183, abs=1e-9)
    assert stats.ks_sf(0.75, 5, 4) == pytest.approx(18 / 126, abs=1e-12)
    assert stats.ks_sf(0.5, 200, 200) < 1e-15 and stats.ks_sf(0, 3, 3) == 1
    assert stats.normal_two_sided(1.959963985) == pytest.approx(0.05, abs=1e-9)
    assert stats.fisher_exact(1, 9, 11, 3) == pytest.approx(0.002759456, abs=1e-8)
    low, high = stats.wilson(8, 10)
    assert (round(low, 3), round(high, 3)) == (0.49, 0.943) and stats.wilson(0, 0) == (0, 1)
    assert stats.holm({"a": 0.0004, "b": 0.003, "c": 0.2, "d": 0.5}, 0.01) == {"a", "b"}


def test_ks_against_enumeration():
    from itertools import combinations

    n, m = 4, 5
    ds = []
    for own in combinations(range(n + m), n):
        a = b = worst = 0
        for i in range(n + m):
            a, b = a + (i in own), b + (i not in own)
            worst = max(worst, abs(a * m - b * n))
        ds.append(worst)
    for d in sorted(set(ds)):
        assert stats.ks_sf(d / (n * m), n, m) == pytest.approx(sum(x >= d for x in ds) / len(ds), abs=1e-12)


def test_text():
    assert text.normalise(" <p>Ａ&amp;B</p>​\x07 c ") == "A&B c" and text.normalise(None) is None
    out, counts = text.redact("write x@y.org or z.w@v.net, host 192.168.7.250, not 1.2.3.999, card 4111-1111-1111-1111, desk +31 (20) 555 01 23, room 12, 3.5 kg")
    assert counts == {"EMAIL": 2, "CARD": 1, "PHONE": 1, "IP": 1}
    assert out == "write [EMAIL] or [EMAIL], host [IP], not 1.2.3.999, card [CARD], desk [PHONE], room 12, 3.5 kg"
    assert text.redact(None) == (None, {})


def test_columns(spark):
    d = spark.createDataFrame([("4111111111111111", "running", "  Héllo,  World!! "), ("4111111111111112", "ties", "---")], "n string, w string, t string")
    r = d.select(text.luhn(F.col("n")), text.stem(F.col("w")), text.slug(F.col("t")), text.estimated_tokens(F.col("w")), text.excerpt(F.col("t"), 8), text.perturbed(F.lit("a b c d e"), "truncated")).collect()
    assert tuple(r[0]) == (True, "runn", "h_llo_world", 2, "Héllo,…", "a b c d") and tuple(r[1])[:3] == (False, "tie", "unnamed")


def test_top_k_against_brute_force(spark):
    from lumenquarry.functions.vectors import top_k

    r = random.Random(2)
    rows = [(i, [r.choice((-1.0, 0.0, 1.0)) for _ in range(4)] + [0.5]) for i in range(300)]
    d = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = {(x.query_id, x["rank"]): x.vec_id for x in top_k(d, d.where("vec_id % 100 = 0"), 7).collect()}
    for q in (0, 100, 200):
        cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
        best = sorted((-round(cos(rows[q][1], v), 12), i) for i, v in rows if i != q)[:7]
        assert [round(cos(rows[q][1], rows[got[q, k + 1]][1]), 9) for k in range(7)] == [round(-s, 9) for s, _ in best]


def test_small_samples(spark):
    from math import comb

    from lumenquarry.operators import drift

    rows = [("a", False)] * 9 + [("a", True)] * 1 + [("b", False)] * 3 + [("b", True)] * 7 + [(None, None)] * 2
    got = {r.category: r for r in drift.category_tests(spark.createDataFrame(rows, "c string, recent boolean"), "c", "recent").collect()}
    tables = {k: comb(8, k) * comb(14, 10 - k) / comb(22, 10) for k in range(9)}
    assert got["b"].p == pytest.approx(sum(p for p in tables.values() if p <= tables[7] * (1 + 1e-9)))
    assert (got["a"].a, got["a"].b, got["unknown"].a) == (9, 1, 2) and got["a"].dimension_p == pytest.approx(3 * min(r.p for r in got.values()))
    cells = [(1, i < 9) for i in range(10)] + [(2, i < 1) for i in range(90)]
    out = {r.c: r for r in drift.over_representation(spark.createDataFrame(cells, "c int, recent boolean"), "c", "recent").collect()}
    assert out[1].kind == "new_topic" and out[1].enrichment == pytest.approx(9) and out[2].kind is None
    tail = sum(comb(10, k) * comb(90, 10 - k) for k in (9, 10)) / comb(100, 10)
    assert out[1].p == pytest.approx(10 * tail)


def test_threshold_components_against_brute_force(spark):
    from lumenquarry.operators.clusters import threshold_components

    r = random.Random(5)
    rows = [(g, i, [r.gauss(0, 1) for _ in range(3)]) for g in (1, None) for i in range(150)] + [(2, None, [1.0, 0.0, 0.0]), (2, 7, [1.0, 0.0, 0.0])]
    got = {(x.group, x.key): x.cluster for x in threshold_components(spark.createDataFrame(rows, "g int, k bigint, v array<double>"), "k", "v", "g", cut=0.02, block=40).collect()}
    for g in (1, None):
        v = {k: [x / sum(y * y for y in vec) ** 0.5 for x in vec] for h, k, vec in rows if h == g}
        seen = {}
        for k in sorted(v):
            todo = [] if k in seen else [k]
            while todo:
                a = todo.pop()
                if a not in seen:
                    seen[a] = k
                    todo += [b for b in v if sum(x * y for x, y in zip(v[a], v[b], strict=True)) >= 0.98 - 1e-6]
        assert {k: got[g, k] for k in v} == seen
    assert got[2, 7] == 7

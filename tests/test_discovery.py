"""Proposals, cues, table functions and the retrieval facade on small cases with known results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenquarry.functions import tables
from lumenquarry.operators import cues, discovery
from lumenquarry.operators.lexical_index import LexicalIndex, cover_density
from lumenquarry.operators.vector_index import VectorIndex
from lumenquarry.retrieval import STRATEGIES, Retrieval, strategy


def test_proposals(spark):
    v = {"esim": [1.0, 0.1], "bill": [0.1, 1.0], "mixed": [1.0, 1.0]}
    texts = {"esim": "esim activation qrcode fails", "bill": "roaming charge invoice", "mixed": "gamma delta"}
    rows = []
    for c, (name, near, tops) in enumerate([("esim", ["billing", "billing", "network", None], [0.2, 0.3, 0.2, None]), ("bill", ["billing"] * 3 + ["network"], [0.9, 0.8, 0.9, 0.8]), ("mixed", ["a", "b", "c", "d"], [0.9] * 4), ("esim", ["x"] * 3, [0.1] * 3), ("bill", ["billing"] * 2, [0.9] * 2)]):
        rows += [(c, 10 * c + i, [x + 0.01 * i for x in v[name]], texts[name] + (" extra" if c == 3 else ""), near[i], tops[i]) for i in range(len(near))]
    rows.append((None, 99, v["esim"], "left out", "a", 0.1))
    members = spark.createDataFrame(rows, "cluster int, key int, vector array<double>, text string, nearest string, top double")
    existing = spark.createDataFrame([("billing", "money"), ("network", "field"), ("activation_esim", None), ("activation_esim_2", None)], "label_id string, team string")
    got = {r["cluster"]: r for r in discovery.proposed(members, existing).collect()}
    assert set(got) == {0, 1, 3}  # 2 looks known without an owner, 4 is small
    assert got[1]["recommendation"] == "extend_existing" and got[1]["label_id"] == "billing" and got[1]["team"] == "money" and got[1]["agreement"] == 0.75
    assert got[0]["recommendation"] == got[3]["recommendation"] == "new_class" and got[0]["nearest"] == "billing" and got[0]["agreement"] == 0.5
    assert len({got[0]["label_id"], got[3]["label_id"]} | {r["label_id"] for r in existing.collect()}) == 6
    x = np.array([r[2] for r in rows if r[0] == 0])
    centre = x.mean(axis=0)
    sims = x @ centre / np.linalg.norm(x, axis=1) / np.linalg.norm(centre)
    assert got[0]["cohesion"] == pytest.approx(sims.mean()) and len(got[0]["examples"]) == 3
    assert discovery.proposed(members.where("false"), existing).count() == 0


def test_free_names(spark):
    rows = [([], 1), ([], 2), ([1], 1), ([1, 2, 4], 2), ([2], 1), ([2], 2)]
    df = spark.createDataFrame(rows, "taken array<int>, turn int").select(discovery.free_names(F.lit("a")).alias("n"))
    assert [r["n"] for r in df.collect()] == ["a", "a_2", "a_2", "a_5", "a", "a_3"]


def test_cues_and_model(spark, tmp_path):
    rows = [(i, "This is TERRIBLE!! cancel it now" if i % 2 else "thanks, all good please", "bad" if i % 2 else "good") for i in range(40)] + [(40, None, None), (41, "", None)]
    df = spark.createDataFrame(rows, "id int, text string, label string")
    got = {r["id"]: r["c"] for r in df.select("id", cues.cues(F.col("text")).alias("c")).collect()}
    assert all(len(c) == len(cues.NAMES) == 14 for c in got.values()) and got[40] == got[41] == [0.0] * 14
    assert got[1][0] == pytest.approx(1 / 6) and got[1][8] == pytest.approx(2 / 6) and got[0][1] == pytest.approx(2 / 4)
    cues.AffectModel.train(df, "text", "label", str(tmp_path / "m"))
    model = cues.AffectModel(spark, str(tmp_path / "m"))  # read again
    found = {r["key"]: r["label"] for r in model.predicted(df, "id", "text").collect()}
    assert all(found[i] == ("bad" if i % 2 else "good") for i in range(40))


def test_table_functions(spark):
    tables.register(spark)
    df = spark.createDataFrame([(1, "One. Two! three\nfour?"), (2, None), (3, "")], "id int, text string")
    got = spark.sql("SELECT id, s.* FROM {d}, LATERAL sentences(text) s ORDER BY id, i", d=df).collect()
    assert [tuple(r) for r in got] == [(1, 0, "One."), (1, 1, "Two!"), (1, 2, "three\nfour?")]
    steps = spark.sql("SELECT s.* FROM (SELECT '1. Restart it\n - call us\nno step\n2) wait ' AS t), LATERAL steps(t) s").collect()
    assert [r["step"] for r in steps] == ["Restart it", "call us", "wait"]


def covers(positions, m):
    """The sum over least intervals that hold all terms, by trying all of them."""
    at = sorted((p, t) for t, ps in positions.items() for p in ps)
    whole = [(i, j) for i in range(len(at)) for j in range(i, len(at)) if len({t for _, t in at[i : j + 1]}) == m]
    least = [(i, j) for i, j in whole if not any((a, b) != (i, j) and i <= a and b <= j for a, b in whole)]
    return sum(1 / (1 + at[j][0] - at[i][0] - (j - i)) for i, j in least)


def test_cover_density(spark, tmp_path):
    import math
    import random

    r = random.Random(7)
    docs = [(i, " ".join(r.choice(["red", "blue", "sun", "fog", "oak", "elm"]) for _ in range(r.randint(0, 30)))) for i in range(60)] + [(60, None)]
    index = LexicalIndex.build(spark.createDataFrame(docs, "doc_id bigint, text string"), str(tmp_path / "i"))
    assert index.n_docs == 61
    terms = spark.createDataFrame([(1, "red"), (1, "sun"), (1, "oak"), (2, "elm"), (3, "fog"), (3, "nothing")], "query int, term string")
    got = {(x["query"], x["doc"]): x["score"] for x in cover_density(index.postings(terms), terms, "all").collect()}
    want = {}
    for q, ts in {1: ["red", "sun", "oak"], 2: ["elm"]}.items():
        for d, text in docs:
            w = (text or "").split()
            places = {t: [i for i, x in enumerate(w) if x == t] for t in ts}
            if all(places.values()):
                want[q, d] = 0.1 * covers(places, len(ts)) / math.log(1 + len(w))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want) and len(want) > 20


def test_retrieval_by_name(spark, tmp_path):
    docs = spark.createDataFrame([(1, "alpha beta", "x"), (2, "alpha gamma", "y"), (3, "delta", "x")], "doc_id bigint, text string, kind string")
    lexical = LexicalIndex.build(docs, str(tmp_path / "l"), attribute="kind")
    vectors = spark.createDataFrame([(1, [1.0, 0.0], "x"), (2, [0.0, 1.0], "y"), (3, [0.7, 0.7], "x")], "doc bigint, vector array<double>, attribute string")
    index = VectorIndex.build(vectors, str(tmp_path / "v"), key="doc", vector="vector", attribute="attribute")
    asked = spark.createDataFrame([(10, "alpha gamma", [0.1, 1.0])], "query bigint, text string, vector array<double>")
    r = Retrieval(lexical, vectors, index, rerank=lambda rows: rows.withColumn("p", (F.col("doc") == 3).cast("double")), margins=(9.0, 9.0))
    first = {name: r.search(asked, name, 2).where("rank = 1").head()["doc"] for name in ("lexical", "phrase", "dense", "ann", "hybrid", "reranked", "adaptive")}
    assert first == {"lexical": 2, "phrase": 2, "dense": 2, "ann": 2, "hybrid": 2, "reranked": 3, "adaptive": 3}
    assert {x["doc"] for x in r.search(asked, "ann", 5, allowed=["x"]).collect()} == {1, 3}
    assert {x["doc"] for x in r.search(asked, "bm25", 5, allowed=["x"]).collect()} == {1}
    with pytest.raises(ValueError):
        r.search(asked, "nothing")

    @strategy("own")
    def own(retrieval, queries, k, allowed):
        return queries.selectExpr("query", "7L as doc", "1.0D as score", "1 as rank")

    assert r.search(asked, "own").head()["doc"] == 7
    del STRATEGIES["own"]

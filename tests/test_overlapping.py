from lumenquarry.operators import relational


def test_tasks_follow_the_pairs(spark, monkeypatch):
    """Few rows that meet very many are dealt by the pairs they make."""
    monkeypatch.setattr(relational, "PAIRS", 100, raising=False)
    left, right = [(i, [1, i % 3 + 2, None]) for i in range(40)], [(i, [1, 1, i % 5]) for i in range(50)] + [(99, None), (100, [])]
    a, b = (spark.createDataFrame(rows, f"{k} bigint, items array<int>") for rows, k in ((left, "l"), (right, "r")))
    found = relational.overlapping(a, "l", b, "r", "items")
    want = {(i, j): len({x for x in p if x is not None} & set(q or [])) for i, p in left for j, q in right}
    assert {(r.left_id, r.right_id): r.shared for r in found.collect()} == {k: n for k, n in want.items() if n}
    assert found.rdd.getNumPartitions() >= 20

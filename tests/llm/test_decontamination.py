import brute
import pytest
from lumenquarry.llm.decontamination import contamination, without_contaminated
from lumenquarry.llm.queries import op7_decontamination


def result(df):
    return {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()}


def test_whole_table_against_brute_force(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    assert result(op7_decontamination(spark, sf_dir)) == brute.decontaminated(docs, items)


@pytest.mark.parametrize("block", [100_000, 3])
def test_odd_rows_in_one_and_many_blocks(spark, block):
    ten = "one two three four five six seven eight nine ten"
    items = [(1, ten), (2, "Short, item"), (3, "x"), (4, None), (5, "..."), (6, ten + " eleven"), (1, "other " + ten), (None, "née")]
    docs = [
        (1, None), (2, ""), (3, "...!"), (4, ten.upper()), (5, ten.replace(" ", "--") + "-eleven twelve"), (6, "short   item and x"), (7, "short and item"),
        (8, ten[:-1]), (9, "née NÉE"), (10, "a " * 50_000 + ten), (11, "x x x"), (12, ten + " " + ten),
    ]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    b = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id bigint, text string, window int")
    want = brute.decontaminated(docs, [("" if i is None else i, t) for i, t in items])
    assert result(contamination(d, b, block=block)) == want
    more = spark.createDataFrame([(t, i, "c", 1.5) for i, t in docs], "text string, doc_id bigint, n_words string, HITS double")
    kept = without_contaminated(more, b)
    assert kept.columns == more.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, x in want.items() if not x[4]}
    found = contamination(more, b, block=block)
    assert found.columns == [*more.columns, "n_words_", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert {r.doc_id: (r.n_words_, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found.collect()} == want
    assert {r.n_words for r in found.collect()} == {"c"}


def test_empty_tables(spark):
    d, b = spark.createDataFrame([(None, "a b"), (2, "c")], "doc_id bigint, text string"), spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    assert contamination(d.limit(0), b).count() == 0
    assert {(r.doc_id, r.n_words, r.n_hit) for r in contamination(d, b.limit(0)).collect()} == {(None, 2, 0), (2, 1, 0)}

from collections import Counter

from lumenquarry.operators.lexical_index import LexicalIndex, cover_density
from lumenquarry.operators.search import analysed
from pyspark.sql import functions as F

TEXTS = ["The running dogs are running", None, "", "of the", "TOKEN Kelvin İstanbul straße cafés", "a-b_c 12 times\nless ings bed boxes", "word " * 3000]


def _docs(spark):
    return spark.createDataFrame([(i, t, ["x", None, "y"][i % 3]) for i, t in enumerate(TEXTS)], "doc_id bigint, text string, lang string")


def test_postings_are_those_of_the_analyser(spark, tmp_path):
    docs = _docs(spark)
    index = LexicalIndex.build(docs, str(tmp_path / "index"), attribute="lang")
    want = {}
    for r in docs.select("doc_id", "lang", analysed(F.col("text")).alias("terms")).collect():
        for term, tf in Counter(r.terms).items():
            want[r.doc_id, term] = (len(r.terms), tf, [i for i, t in enumerate(r.terms) if t == term], r.lang)
    assert {(r.doc, r.term): (r.length, r.tf, list(r.positions), r.attribute) for r in index.postings().collect()} == want
    assert {r.term: r.df for r in index.terms.collect()} == Counter(term for _, term in want)
    assert {(r.doc, r.term) for r in index.postings(allowed=["y"], positions=False).collect()} == {k for k, v in want.items() if v[3] == "y"}
    assert index.n_docs == len(TEXTS) and abs(index.average_length - sum(tf for _, tf, _, _ in want.values()) / len(TEXTS)) < 1e-12
    none = LexicalIndex.build(docs.where("doc_id = 1"), str(tmp_path / "none"))
    assert none.n_docs == 1 and none.postings().count() == 0 and none.terms.count() == 0
    asked = spark.createDataFrame([(1, "word", 1)], "query bigint, term string, qtf bigint")
    assert [r.doc for r in cover_density(index.postings(asked), asked, "all").collect()] == [6]


def test_texts_are_read_once(spark, tmp_path):
    """Ranges are found by a first pass over all texts, which costs as much as the index itself."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        seen.add(1)
        return text

    docs = spark.range(500).select(F.col("id").alias("doc_id"), counted(F.concat(F.lit("word "), F.col("id").cast("string"))).alias("text"))
    LexicalIndex.build(docs, str(tmp_path / "index"))
    assert seen.value == 500

"""Each stage on its own input, against what brute force says of that input."""

import brute
import corpus_pipeline as cp
from lumenquarry.llm.queries import tokenizer_path
from test_packing import check
from tokenizers import Tokenizer


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    for i, (name, stage) in enumerate(cp.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(i)))
        after = spark.read.parquet(str(tmp_path / str(i)))
        rows = after.collect()
        if name != "packing":
            assert after.columns == docs.columns and len({r.doc_id for r in rows}) == len(rows)
        if name in ("quality_rules", "near_duplicates", "decontamination"):
            assert all(r == before[r.doc_id] for r in rows)
        kept = {r.doc_id for r in rows}
        texts = [(d, r.text) for d, r in before.items()]
        if name == "quality_rules":
            assert kept and not any(brute.quality(before[d].text)[5] for d in kept)
        if name == "near_duplicates":
            assert kept == {d for d, (_, _, k) in brute.near_duplicates(texts).items() if k}
        if name == "decontamination":
            assert kept == {d for d, x in brute.decontaminated(texts, items).items() if not x[4]}
        if name == "secret_scans":
            assert kept == set(before) and not any(brute.secrets(r.text) for r in rows)
            assert all(r.text == before[r.doc_id].text or "[REDACTED]" in r.text for r in rows) and all(r.n_chars == len(r.text) for r in rows)
        if name == "packing":
            check(rows, brute.pieces(texts, Tokenizer.from_file(tokenizer_path())))
        docs = after


def test_repeated_rows_nulls_and_more_columns(spark, sf_dir, tmp_path):
    # Words of letters alone: a text of which a third is digits is one that the quality rules reject.
    text = " ".join(f"{a}{b}ter" for a in ("mo", "lin", "ver", "sa", "con", "dal") for b in ("a", "en", "i", "os", "ul", "ar", "em", "it", "on", "e")) + " password=abcdefgh1"
    rows = [(1, text, "en", "s", 5, "a"), (1, text, "en", "s", 5, "b"), (2, text.upper(), None, None, None, "c"), (None, None, None, None, None, None), (3, "", "en", "s", 0, ""), (4, text + " <p>" + "x" * 300_000, "de", "t", 1, "k")]
    kind = "doc_id bigint, text string, lang string, source string, n_chars bigint, cls string"
    for data in (rows, []):
        docs = spark.createDataFrame(data, kind)
        for i, (name, stage) in enumerate(cp.STAGES):
            path = str(tmp_path / f"{len(data)}-{i}")
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
            if data and name == "near_duplicates":
                assert sorted(r.doc_id for r in docs.collect()) == [1] or sorted(r.doc_id for r in docs.collect()) == [1, 4]
        assert (docs.count() > 0) == bool(data)

import random
from collections import defaultdict

import brute
from lumenquarry.llm.packing import CapacityTree, best_fit_decreasing, pack, pieces, unpacked
from lumenquarry.llm.queries import op9_packing, tokenizer_path
from tokenizers import Tokenizer


def check(rows, ids, size=2048):
    """Every id lies in one piece, pieces lie gapless in their sequences."""
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(docs) == set(ids)
    for d, own in docs.items():
        own.sort(key=lambda r: r.start)
        at = 0
        for r in own:
            assert r.start == at and r.doc_tokens == len(ids[d]) and r.ids_crc32 == brute.crc_of(ids[d][at : at + r.length])
            at += r.length
        assert at == len(ids[d])
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
    assert set(sequences) == set(range(len(sequences)))
    return len(sequences)


def test_whole_table_against_the_tokenizer(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    ids = brute.pieces(docs, Tokenizer.from_file(tokenizer_path()))
    n = check(op9_packing(spark, sf_dir).collect(), ids)
    least = -(-sum(map(len, ids.values())) // 2048)
    assert n <= 1.02 * least + 1


def test_odd_texts(spark):
    texts = [
        None, "", " \n", "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>", "İstanbul ΣΑΣ ǅ ﬀ", "é J̌ x y ́z", "don't WE'LL 'S x'ts", "a\x1cb\x85c\xa0d e",
        "½²³ 123 ٣٤", "日本語 テスト 한국어", "w" * 70_000, "ab " * 30_000, "...!!!", "🎉👩‍👩‍👧", "a<|b", "퟿﻿ x​y",
    ]
    docs = list(enumerate(texts))
    d = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id bigint, text string, start int")
    ids = brute.pieces(docs, Tokenizer.from_file(tokenizer_path()))
    cut = pieces(d, tokenizer_path(), with_ids=True)
    packed = pack(cut)
    rows = packed.collect()
    check(rows, ids)
    assert {r.doc_id: bytes(r.ids) for r in unpacked(packed).collect()} == {d: b"".join(x.to_bytes(4, "little") for x in v) for d, v in ids.items()}


def test_repeated_null_and_no_rows(spark):
    d = spark.createDataFrame([(None, "a b")] * 3 + [(2**60 + 1, "a b")] * 2, "doc_id bigint, text string")
    rows = pack(pieces(d, tokenizer_path())).collect()
    assert sorted(r.offset for r in rows) == [0, 3, 6, 9, 12] and {r.doc_id for r in rows} == {None, 2**60 + 1}
    assert pack(pieces(d.limit(0), tokenizer_path())).count() == 0


def test_bulk_plan_is_best_fit_decreasing():
    r = random.Random(3)
    for _ in range(150):
        size = r.choice([8, 16, 61])
        counts = {n: r.randint(1, 30) for n in r.sample(range(1, size + 1), r.randint(1, size))}
        cells, pieces_ = set(), set()
        for length, first, n, per, window, at in best_fit_decreasing(counts, size):
            for i in range(n):
                pieces_.add((length, first + i))
                for x in range(length):
                    cell = (window + i // per, at + i % per * length + x)
                    assert cell not in cells and cell[1] < size
                    cells.add(cell)
        assert pieces_ == {(n, i) for n, c in counts.items() for i in range(c)}
        room = []
        for n in sorted(counts, reverse=True):
            for _ in range(counts[n]):
                fits = [i for i, c in enumerate(room) if c >= n]
                i = min(fits, key=lambda i: room[i]) if fits else len(room)
                if not fits:
                    room.append(size)
                room[i] -= n
        used = defaultdict(int)
        for w, _ in cells:
            used[w] += 1
        assert sorted(used.values()) == sorted(size - c for c in room)


def test_capacity_tree():
    tree = CapacityTree(10)
    assert tree.least_from(0) is None
    for c in (3, 7, 10):
        tree.set(c, True)
    assert [tree.least_from(i) for i in range(11)] == [3] * 4 + [7] * 4 + [10] * 3
    tree.set(7, False)
    assert tree.least_from(4) == 10

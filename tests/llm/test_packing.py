import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from copair.llm import packing
from tests.llm.helpers import no_docs, odd_docs

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize("text", [
    "don't it's we've SHE'S 's", "a\x85b\xa0c d", "x\x1cy z\x1d", "<|endoftext|> a<|startoftext|>b",
    "Ünï ÇA ß ÀÉ. ... ,,!? foo...bar", "日本語 テスト İstanbul ΣΑΣ", "é a ́b", "12 3.4,5 a1b2", "", " \n\t ",
    "naïve.!? café's (ok),$$$ th***"])
def test_encoder_equals_tokenizer(tokenizer, text):
    got = np.frombuffer(packing.WordEncoder.at(PATH).encode([text, None])[0], dtype="<u4").tolist()
    assert got == tokenizer.encode(text, add_special_tokens=False).ids


def test_every_code_point_between_words(tokenizer):
    texts = [f"q{chr(i)}r s {chr(i)}t" for i in range(1, 0x3100)]
    for text, raw in zip(texts, packing.WordEncoder.at(PATH).encode(texts)):
        assert np.frombuffer(raw, dtype="<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def check_layout(rows, capacity):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_pieces_and_layout_of_odd_documents(spark, tokenizer):
    docs = odd_docs(spark)
    rows = packing.pack(packing.token_pieces(docs, PATH)).collect()
    expect = []
    for d in docs.collect():
        ids = tokenizer.encode(d["text"] or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 2048):
            part = ids[k:k + 2048]
            expect.append((d["doc_id"], k // 2048, k, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    got = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows]
    assert sorted(got, key=repr) == sorted(expect, key=repr)
    n = check_layout(rows, 2048)
    assert n == packing.lower_bound(np.array([e[3] for e in expect]), 2048)


def test_sequences_hold_the_ids(spark, tokenizer):
    docs = odd_docs(spark).where("doc_id < 6")
    pieces = packing.token_pieces(docs, PATH, with_ids=True)
    placed = packing.pack(packing.token_pieces(docs, PATH))
    packed = packing.sequences(pieces, placed).collect()
    assert sum(len(r["ids"]) for r in packed) == placed.agg({"length": "sum"}).first()[0]


def test_empty_table(spark):
    out = packing.pack(packing.token_pieces(no_docs(spark), PATH))
    assert out.count() == 0
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(out.columns)


def test_several_groups_and_rounds(spark):
    sizes = [int(x) for x in np.random.default_rng(3).integers(1, 2049, 3000)]
    pieces = spark.createDataFrame([(i, 0, 0, n, 0) for i, n in enumerate(sizes)],
                                   "doc_id long, piece int, start long, length long, ids_crc32 long")
    out = packing.pack(pieces, group_rows=300)
    n = check_layout(out.collect(), 2048)
    assert out.count() == 3000
    assert n <= 1.02 * packing.lower_bound(np.array(sizes), 2048)


def test_local_search_improves_best_fit():
    improved = 0
    for seed in range(60):
        sizes = sorted(np.random.default_rng(seed).integers(100, 700, 40).tolist(), reverse=True)
        bound = packing.lower_bound(np.array(sizes), 1000)
        start = packing.best_fit(sizes, 1000)
        end = packing.local_search(sizes, start, 1000, bound)
        assert sorted(i for b in end for i in b) == list(range(40))
        assert all(sum(sizes[i] for i in b) <= 1000 for b in end)
        square = lambda bins: sum(sum(sizes[i] for i in b) ** 2 for b in bins)
        assert bound <= len(end) <= len(start) and square(end) >= square(start)
        improved += len(end) < len(start)
    assert improved


def test_one_for_one_exchange():
    # 6+3 | 5+5 cannot be closed by moves; exchanging 3 and 4 can
    assert len(packing.local_search([7, 6, 4, 3], [[0, 2][:1], [1, 3], [2]], 10, 2)) == 2

import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from copair.llm import ffd_tournament as ffd
from tests.llm.helpers import no_docs, odd_docs, rows_of

PATH = public_tokenizers.path("word_bpe_49k.json")
PIECE = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def plain_ffd(lengths, capacity):
    rooms, bins = [], []
    for i, n in enumerate(lengths):
        b = next((b for b, r in enumerate(rooms) if r >= n), None)
        if b is None:
            rooms.append(capacity)
            bins.append([])
            b = len(bins) - 1
        rooms[b] -= n
        bins[b].append(i)
    return bins


@pytest.mark.parametrize("seed", range(40))
def test_tournament_finds_the_first_fit(seed):
    rng = np.random.default_rng(seed)
    lengths = sorted(rng.integers(1, 65, rng.integers(0, 120)).tolist(), reverse=True)
    assert ffd.first_fit_decreasing(lengths, 64) == plain_ffd(lengths, 64)


@pytest.mark.parametrize("seed", range(40))
def test_pouring_places_every_id_once_and_pads_nothing(seed):
    rng = np.random.default_rng(100 + seed)
    lengths = sorted(rng.integers(1, 65, rng.integers(1, 90)).tolist(), reverse=True)
    sequences = ffd.poured(ffd.first_fit_decreasing(lengths, 64), lengths, 64)
    places = sorted((i, s, n) for q in sequences for i, s, n in q)
    for i, n in enumerate(lengths):
        at = 0
        for _, s, m in [p for p in places if p[0] == i]:
            assert s == at and m > 0
            at += m
        assert at == n
    sizes = [sum(n for *_, n in q) for q in sequences]
    assert all(0 < z <= 64 and z & (z - 1) == 0 for z in sizes)


def check(rows, docs, capacity):
    tokenizer = Tokenizer.from_file(PATH)
    ids = [(d["doc_id"], tokenizer.encode(d["text"] or "", add_special_tokens=False).ids + [1]) for d in docs.collect()]
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_sequence.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= capacity and at & (at - 1) == 0
    assert sum(r["length"] for r in rows) == sum(len(v) for _, v in ids)
    for key, own in {k: v for k, v in ids}.items():
        got = sorted(by_doc[key])
        copies = sum(k == key for k, _ in ids)
        assert sum(g[1] for g in got) == copies * len(own) and all(g[3] == len(own) for g in got)
        if copies == 1:
            assert [g[0] for g in got] == [0, *np.cumsum([g[1] for g in got])[:-1]]
        for start, n, crc, _ in got:
            assert crc == zlib.crc32(struct.pack(f"<{n}I", *own[start:start + n]))


@pytest.mark.parametrize("group_rows", [16384, 2])
def test_odd_documents(spark, group_rows):
    docs = odd_docs(spark)
    check(ffd.pack_documents(docs, PATH, group_rows=group_rows).collect(), docs, 2048)


def test_files_not_partitions_decide(spark, scratch):
    odd_docs(spark).repartition(3).write.parquet(f"{scratch}/d")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    takes = []
    for size in ("128m", "2k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        takes.append(rows_of(ffd.pack_documents(spark.read.parquet(f"{scratch}/d"), PATH, group_rows=3), *PIECE))
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert takes[0] == takes[1]


def test_copies_of_one_row_meet_in_many_groups(spark):
    docs = spark.range(3000, numPartitions=3).select(F.lit(7).alias("doc_id"), F.lit("one two three " * 30).alias("text"))
    rows = ffd.pack_documents(docs, PATH, group_rows=100).collect()
    assert len({r["sequence_id"] >> 24 for r in rows}) > 20
    assert sum(r["length"] for r in rows) == 3000 * rows[0]["doc_tokens"]


def test_sequences_hold_the_ids(spark):
    docs = odd_docs(spark).where("doc_id < 6")
    placed = ffd.pack_documents(docs, PATH, with_ids=True)
    out = ffd.sequences(placed).collect()
    total = {r["sequence_id"]: r["n"] for r in placed.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()}
    assert {r["sequence_id"]: len(r["ids"]) for r in out} == total
    assert sum(i == 1 for r in out for i in r["ids"]) >= docs.count()


def test_empty_table_and_capacity(spark):
    assert ffd.pack_documents(no_docs(spark), PATH).count() == 0
    with pytest.raises(ValueError):
        ffd.pack_documents(no_docs(spark), PATH, capacity=1000)

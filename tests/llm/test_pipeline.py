import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
import tokenizers
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from copair.llm import cube_mix, packing, pii_crf, queries, simhash_ring, toxicity_gbt
from copair.llm.common import committed, hash_sample, written
from copair.session import checkpoint_dir
from tests.llm.helpers import no_docs, odd_docs, save


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (6, None, 0), (7, 1, None)], "doc_id long, quality int, toxic int")
    docs = odd_docs(spark).select("doc_id", "text", "lang", "source", "n_chars")
    chats = spark.createDataFrame([(1, 0, "user", None)], "conv_id long, turn long, role string, text string")
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, None)], "vec_id long, embedding array<float>")
    return save(spark, tmp_path_factory.mktemp("odd"), documents=docs, labels=labels, conversations=chats, embeddings=vectors)


@pytest.fixture(scope="module")
def empty_folder(spark, tmp_path_factory):
    return save(spark, tmp_path_factory.mktemp("empty"), documents=no_docs(spark),
                labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"),
                conversations=spark.createDataFrame([], "conv_id long, turn long, role string, text string"),
                embeddings=spark.createDataFrame([], "vec_id long, embedding array<float>"))


COLUMNS = {
    "op1": "doc_id piece start length ids_crc32 sequence_id offset",
    "op2": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op3": "doc_id size source_size target taken",
    "op4": "query_id rank vec_id score",
    "op5": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
    "op6": "doc_id held_out score predicted",
    "op7": "doc_id size text_crc32 law shard slot grown_shard",
    "op8": "doc_id held_out lang_pred score",
    "op9": "doc_id fingerprint component_id",
    "op10": "vec_id n_links component_id kept",
    "op11": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op12": "doc_id leaf subroot root proof_sha256 folded_root verified",
    "op13": "vec_id component n deviation whitened explained identity_error",
}


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_queries_on_odd_and_empty_tables(spark, folder, empty_folder, name):
    query, columns = queries.QUERIES[name], COLUMNS[name.split("_")[0]].split()
    df = query(spark, folder)
    assert set(columns) <= set(df.columns)
    rows = df.collect()
    if name.startswith(("op2", "op3", "op6", "op7", "op8", "op9", "op12")):
        assert len(rows) == 10
    assert query(spark, empty_folder).count() == (1 if name.startswith("op5") else 0)


def test_all_queries_and_the_pipeline_are_registered():
    names = __spark_entry__.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13 and "pipeline" in names


def test_stages_keep_columns_and_extra_ones(spark, folder):
    docs = odd_docs(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        assert out.count() <= 3 * docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() >= docs.count()


def test_pipeline_runs_and_handles_empty(spark, folder, empty_folder):
    assert corpus_pipeline.run(spark, folder).count() > 0
    assert corpus_pipeline.run(spark, empty_folder).count() == 0


def groups_of(prints, bits=3):
    """Component numbers of fingerprints over all pairs."""
    up = list(range(len(prints)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                up[root(i)] = root(j)
    return [root(i) for i in range(len(prints))]


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    """What goes into each stage and comes out, on the small documents with repeated and null ids."""
    small = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = odd_docs(spark).select(*small.columns)
    null_ids = small.where("doc_id % 4 = 1").withColumn("doc_id", F.lit(None).cast("long"))
    other_text = small.where("doc_id % 7 = 2").withColumn("doc_id", F.col("doc_id") - 1)
    repeated = small.where("doc_id % 9 = 3")
    # enough toxic documents to learn from
    labels, more = (spark.read.parquet(f"/root/testdata/{sf}/labels.parquet") for sf in ("sf0.001", "sf0.01"))
    marked = more.where("toxic = 1").withColumn("doc_id", F.col("doc_id") + 1_000_000)
    toxic = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("doc_id", F.col("doc_id") + 1_000_000)
    docs = small.unionByName(odd).unionByName(null_ids).unionByName(other_text).unionByName(repeated).unionByName(
        toxic.join(marked, "doc_id", "left_semi"))
    folder = save(spark, tmp_path_factory.mktemp("staged"), documents=docs.repartition(3), labels=labels.unionByName(marked))
    out = {"documents": spark.read.parquet(f"{folder}/documents.parquet")}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, list(out.values())[-1], folder).write.parquet(f"{folder}/{k}")
        out[name] = spark.read.parquet(f"{folder}/{k}")
    return folder, list(out.values())


def listed(df):
    return [tuple(r) for r in df.collect()]


def test_toxicity_stage_keeps_rows_below_one_half(spark, staged):
    folder, (before, after, *_) = staged
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity_gbt.learn(before.join(labels, "doc_id").select("doc_id", "text", "toxic"))
    scored = before.select("*", toxicity_gbt.score_column("text", model).alias("s")).collect()
    assert Counter(tuple(r)[:-1] for r in scored if r["s"] < 0.5) == Counter(listed(after))
    assert 0 < after.count() < before.count()


def test_near_dedup_stage_against_all_pairs(staged):
    before, after = (listed(df) for df in staged[1][1:3])
    text = staged[1][1].columns.index("text")
    group = dict(zip(before, groups_of([simhash_ring.fingerprint(r[text]) & (1 << 64) - 1 for r in before])))
    members = {}
    for r in before:
        members.setdefault(group[r], []).append(r[0])
    assert len(after) == len(members) < len(before) and {group[r] for r in after} == set(members)
    for r in after:
        ids = [i for i in members[group[r]] if i is not None]
        assert r[0] == (min(ids) if ids else None)


def test_masking_stage_against_spans_of_each_text(spark, staged):
    before, after = staged[1][2:4]
    model, columns, want = pii_crf.learn(before), before.columns, []
    for row in before.collect():
        r = row.asDict()
        if r["text"] is not None:
            base = pii_crf.base_spans(r["text"])
            r["text"] = pii_crf.mask(r["text"], base + pii_crf.added_spans([r["text"]], [base], model)[0])
        r["n_chars"] = None if r["text"] is None else len(r["text"])
        want.append(tuple(r[c] for c in columns))
    assert Counter(want) == Counter(listed(after))
    assert any("<EMAIL>" in (r["text"] or "") for r in after.collect())


def test_mixing_stage_against_targets(staged):
    before, after = (df.collect() for df in staged[1][3:5])
    words = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    size, rows, took = Counter(), Counter(), Counter()
    for r in before:
        size[r["source"]] += words(r)
        rows[r["source"]] += 1
    for r in after:
        took[r["source"]] += words(r)
    one = Counter(map(tuple, before))
    assert all(n <= 3 * one[r] for r, n in Counter(map(tuple, after)).items())
    for s in cube_mix.plan_targets([(k, size[k], rows[k]) for k in size]):
        # landing compares all roundings of 16 documents: nearer than the mean document
        assert abs(took[s.name] - s.target) <= max(size[s.name] / rows[s.name], 1), s


def test_packing_stage_against_the_tokenizer(staged):
    before, after = (df.collect() for df in staged[1][4:6])
    tokenizer = tokenizers.Tokenizer.from_file(queries.TOKENIZER)
    want = Counter()
    for r in before:
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            piece = np.array(ids[k:k + 2048], dtype="<u4")
            want[r["doc_id"], k // 2048, k, len(piece), zlib.crc32(piece.tobytes())] += 1
    assert want == Counter(tuple(r)[:5] for r in after)
    bins = {}
    for r in after:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [sum(n for _, n in b[:i]) for i in range(len(b))] and sum(n for _, n in b) <= 2048
    lengths = sorted((k[3] for k in want.elements()), reverse=True)
    assert len(bins) <= len(packing.best_fit(lengths, 2048))


def test_run_equals_its_stages_and_leaves_only_its_result(spark, staged):
    folder, tables = staged
    root = Path(checkpoint_dir(spark).removeprefix("file:"))
    before = set(root.iterdir())
    out = corpus_pipeline.run(spark, folder)
    assert Counter(tuple(r)[:5] for r in out.collect()) == Counter(tuple(r)[:5] for r in tables[-1].collect())
    assert len(set(root.iterdir()) - before) == 1


def test_scratch_stays_when_a_table_fails(spark):
    kept = written(spark.range(3))
    with pytest.raises(ValueError):
        committed(lambda: (_ for _ in ()).throw(ValueError()), over=[kept])
    assert kept.count() == 3
    out = committed(lambda: written(spark.range(5)).where("id > 1"), over=[kept])
    assert out.count() == 3 and not Path(kept._written_at.removeprefix("file:")).exists()


def test_hash_sample_is_repeatable(spark):
    df = spark.range(5000)
    first, again = (hash_sample(df.repartition(n), 500, "id") for n in (2, 9))
    assert first.exceptAll(again).count() == 0 and 350 < first.count() < 650
    assert hash_sample(df, 5000, "id").count() == 5000


def test_crc_of_null_and_value(spark):
    from copair.llm.common import crc_of
    df = spark.createDataFrame([(17,), (None,)], "doc_id long")
    assert [r[0] for r in df.select(crc_of("doc_id")).collect()] == [__import__("zlib").crc32(b"17"), 0]
    assert df.where(F.pmod(crc_of("doc_id"), F.lit(5)) == 0).count() >= 1

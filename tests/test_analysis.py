"""File readers, sinks and the whole analysis from two FASTA files."""

import os
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from copair.operators import checks, contacts, prep
from copair.operators.checks import EMOptions
from copair.plans import analysis
from copair.sources import fasta

ALPH = "ARNDCEQGHILKMFPSTWYV"


def write(path, text):
    with open(path, "w", newline="") as f:
        f.write(text)
    return str(path)


def test_fasta_with_wrapped_lines_and_line_ends(spark, tmp_path):
    path = write(tmp_path / "a.fa", ">one first\nAR\nND\n\n>two\r\nA-\r\nCE\r\n>three\nGGGG")
    got = [tuple(r) for r in fasta.read_alignment(spark, path).orderBy("pair_id").collect()]
    assert got == [(0, "one first", "ARND"), (1, "two", "A-CE"), (2, "three", "GGGG")]


def test_fasta_order_over_many_splits_and_files(spark, tmp_path):
    for name, start in (("b.fa", 300), ("a.fa", 0)):
        write(tmp_path / name, "".join(f">r{i}\n{'AR' * 10}\n{'ND' * 5}\n" for i in range(start, start + 300)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        df = fasta.read_alignment(spark, str(tmp_path))
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    # the table that fixes the places is read under other split sizes than the text was
    got = [(r.pair_id, r.header, r.seq) for r in df.orderBy("pair_id").collect()]
    assert got == [(i, f"r{i}", "AR" * 10 + "ND" * 5) for i in range(600)]
    # records stay where they are: the only exchange sends the block starts to all tasks
    assert "BroadcastHashJoin" in plan and "Window" not in plan and plan.count("Exchange") == plan.count("BroadcastExchange")


def test_blank_records_and_empty_files(spark, tmp_path):
    write(tmp_path / "a.fa", "\n\n>x\nAR\n\n\n>y\nND\n\n")
    write(tmp_path / "b.fa", "")
    write(tmp_path / "c.fa", ">z\nCC")
    got = [tuple(r) for r in fasta.read_alignment(spark, str(tmp_path)).orderBy("pair_id").collect()]
    assert got == [(0, "x", "AR"), (1, "y", "ND"), (2, "z", "CC")]
    none = fasta.read_alignment(spark, write(tmp_path / "none.txt", "\n"))
    assert none.columns == ["pair_id", "header", "seq"] and none.count() == 0


def test_contact_map_and_its_checks(spark, tmp_path):
    cmap = fasta.read_contact_map(spark, write(tmp_path / "c.csv", "0, 1,0\r\n1,0,0.5\n"))
    got = {(r.pos_a, r.pos_b): r.value for r in cmap.collect()}
    assert got == {(0, 0): 0, (0, 1): 1, (0, 2): 0, (1, 0): 1, (1, 1): 0, (1, 2): 0.5}
    aligned = spark.createDataFrame([(0, "AR", "NDC"), (1, "RA", "DNA"), (2, "RR", "NDC")], "pair_id long, seq_a string, seq_b string")
    with pytest.raises(ValueError, match="1 values other than 0 and 1"):
        prep.preprocess(aligned, 0.5, cmap)
    with pytest.raises(ValueError, match="1 x 3 cells"):
        prep.preprocess(aligned, 0.5, cmap.where("pos_a = 0"))
    words = fasta.read_contact_map(spark, write(tmp_path / "w.csv", "0,x,1\n1,0,0\n"))
    with pytest.raises(ValueError, match="values other"):
        prep.preprocess(aligned, 0.5, words)


def test_pairing_refuses_unpaired_and_identical_sides(spark, tmp_path):
    a = fasta.read_alignment(spark, write(tmp_path / "a.fa", ">1\nAR\n>2\nRA\n>3\nAA\n"))
    b = fasta.read_alignment(spark, write(tmp_path / "b.fa", ">1\nND\n>2\nDN\n"))
    with pytest.raises(ValueError, match="unpaired rows: A has 3 .1 without B."):
        fasta.pair_alignments(a, b)
    with pytest.raises(ValueError, match="hold the same sequences"):
        fasta.pair_alignments(a, a)
    assert fasta.pair_alignments(a.where("pair_id < 2"), b).count() == 2


def test_alphabet_and_length_errors(spark):
    bad = spark.createDataFrame([(0, "AX", "ND"), (1, "RA", "DN")], "pair_id long, seq_a string, seq_b string")
    with pytest.raises(ValueError, match="side A: 1 residues"):
        prep.preprocess(bad)
    ragged = spark.createDataFrame([(0, "AR", "ND"), (1, "RAA", "DN")], "pair_id long, seq_a string, seq_b string")
    with pytest.raises(ValueError, match="side A: rows differ in length"):
        prep.preprocess(ragged)
    left = checks.unknown_residues(spark.createDataFrame([(0, "AXXB"), (1, "BAR"), (2, "ARND")], "pair_id long, seq string"))
    assert sorted(tuple(r) for r in left.collect()) == [("B", 2, 2), ("X", 2, 1)]


def planted(tmp_path, n=360):
    rng = np.random.default_rng(8)
    lines = {"a": [], "b": []}
    for i in range(n):
        a, b = rng.integers(0, 4, 6), rng.integers(0, 4, 5)
        if i < 270:
            b[:3] = (a[:3] + 1) % 4
        # column 5 of A is all gaps but for a few rows, column 4 of B is constant
        lines["a"].append(f">p{i}\n{''.join(ALPH[x] for x in a[:5])}\n{'-' if i % 9 else 'A'}\n")
        lines["b"].append(f">q{i}\n{''.join(ALPH[x + 5] for x in b[:4])}A\n")
    cmap = "\n".join(",".join(str(int(i == j and i < 3)) for j in range(5)) for i in range(6))
    return [write(tmp_path / f"{k}.fa", "".join(v)) for k, v in lines.items()] + [write(tmp_path / "c.csv", cmap)]


def test_whole_analysis(spark, tmp_path):
    a, b, c = planted(tmp_path)
    options = EMOptions(test=True, int_limit=269, predict_contacts=True, residues=True)
    out = f"{tmp_path}/out"
    r = analysis.run(spark, a, b, options, c, out)
    assert r.prepared.kept_a == [0, 1, 2, 3, 4] and r.prepared.kept_b == [0, 1, 2, 3]
    assert r.runs[0].converged and r.runs[0].fits_converged
    last = r.performance.orderBy(F.col("iter").desc()).first()
    assert last.mcc > 0.85  # a few random pairs follow the planted rule by chance
    total = [x.total for x in r.llh.orderBy("iter").collect()]
    assert all(y >= x - 0.01 * abs(x) for x, y in zip(total, total[1:]))
    assert {(x.pos_a, x.pos_b) for x in contacts.top_contacts(r.contacts, 3).collect()} == {(0, 0), (1, 1), (2, 2)}
    n = r.runs[0].n_iters + 1
    read = lambda t: spark.read.parquet(f"{out}/{t}")
    assert read("labels").count() == 360 * n and read("encoded").count() == 360
    assert read("couplings").select("iter").distinct().count() == n == read("models").select("iter").distinct().count()
    res = read("residue_logprobs")
    assert res.count() == 2 * 360 * 9 * n and {x[0] for x in res.select("model").distinct().collect()} == {"alt", "null"}
    sums = res.where(f"model = 'alt' AND iter = {n - 1}").groupBy("pair_id").agg(F.sum("logp").alias("s"))
    trace = r.trace.where(F.col("iter") == n - 1)
    assert sums.join(trace, "pair_id").where(F.abs(F.col("s") - F.col("alt_llh")) > 1e-9).count() == 0
    assert read("contact_map").where("is_contact = 1").count() == 3 and read("one_hot").count() > 0 and read("llh").count() == n


def test_random_starts_are_separate(spark, tmp_path):
    a, b, _ = planted(tmp_path, 120)
    r = analysis.run(spark, a, b, EMOptions(init="random", n_starts=2, max_iters=2))
    assert {x[0] for x in r.trace.select("start").distinct().collect()} == {0, 1}
    first = r.trace.where("iter = 0").groupBy("pair_id").agg(F.countDistinct("z").alias("n"))
    assert first.where("n = 2").count() > 10


def test_matrices_and_truth_of_every_start(spark, tmp_path):
    a, b, _ = planted(tmp_path, 60)
    out = f"{tmp_path}/out"
    options = EMOptions(init="random", n_starts=2, max_iters=2, max_init_iters=2, max_reg_iters=2, history=True, test=True, int_limit=44)
    r = analysis.run(spark, a, b, options, out=out)
    for name, value in (("label_evolution", "z"), ("llh_evolution", "alt_llh")):
        wide = spark.read.parquet(f"{out}/{name}")
        assert wide.count() == 2 * 60
        last = wide.select("start", "pair_id", F.col("2").alias("v")).join(r.trace.where("iter = 2"), ["start", "pair_id"], "left")
        assert last.where(~F.col("v").eqNullSafe(F.col(value))).count() == 0
    assert {(x.n, x.tp + x.fn) for x in r.performance.collect()} == {(60, 45)}
    with pytest.raises(ValueError, match="int_limit is 61"):
        analysis.run(spark, a, b, EMOptions(init="random", test=True, int_limit=61))


@pytest.mark.skipif("COPAIR_EXAMPLE_DATA" not in os.environ, reason="folder with a.fasta, b.fasta, contacts.csv not given")
def test_example_data(spark):
    folder = os.environ["COPAIR_EXAMPLE_DATA"]
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        r = analysis.run(spark, f"{folder}/a.fasta", f"{folder}/b.fasta", EMOptions(test=True, int_limit=1649), f"{folder}/contacts.csv")
    assert r.performance.orderBy(F.col("iter").desc()).first().mcc >= 0.99
    last = r.runs[0].couplings.where(F.col("iter") == r.runs[0].n_iters)
    assert {(x.pos_a, x.pos_b) for x in contacts.top_contacts(last, 4).collect()} == {(7, 6), (3, 3), (1, 1), (10, 9)}

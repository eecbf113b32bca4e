"""Unit goldens (values carried over from the reference's own unit tests)."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from copair.functions.alphabet import ALPHA_PATH, PC_ALT
from copair.operators import checks, labels, null_model, prep
from copair.operators.checks import EMOptions


def _aligned(spark, a, b=None):
    b = b or a
    rows = [(i, x, y) for i, (x, y) in enumerate(zip(a, b))]
    return spark.createDataFrame(rows, "pair_id long, seq_a string, seq_b string")


def test_alpha_path():
    assert ALPHA_PATH[:4] == [40.0, 30.0, 20.0, 10.0]
    assert len(ALPHA_PATH) == 19
    assert ALPHA_PATH[4] == pytest.approx(1.0) and ALPHA_PATH[-1] == pytest.approx(0.001)
    assert ALPHA_PATH[7] == pytest.approx(0.22758459, rel=1e-6)


def test_encode(spark):
    seqs = ["ARN", "DCE", "QGH", "ILK", "MFP", "STW", "YV-"]
    enc = prep.encode_pairs(_aligned(spark, seqs)).orderBy("pair_id").collect()
    assert [list(r.a) for r in enc] == [[0, 1, 2], [3, 4, 5], [6, 7, 8], [9, 10, 11], [12, 13, 14], [15, 16, 17],
                                        [18, 19, 20]]


def test_one_hot(spark):
    enc = prep.encode_pairs(_aligned(spark, ["A-", "V-", "-V"]))
    oh = prep.one_hot(enc).orderBy("pair_id").collect()
    assert [list(r.feat_a) for r in oh] == [[0], [19], [39]]


def _profile(spark, seqs, thr=0.5):
    enc = prep.encode_pairs(_aligned(spark, seqs, ["AC"] * len(seqs) if False else seqs))
    return prep.column_profile(prep.residue_counts(enc), thr)


def test_gappy_none(spark):
    p = _profile(spark, ["ELV", "AVL", "ALR", "ELR"])
    assert p.where("side='A' AND gappy").count() == 0
    p = _profile(spark, ["-LV", "A-L", "AL-", "ELR"])
    assert p.where("side='A' AND gappy").count() == 0


def test_gappy_one(spark):
    p = _profile(spark, ["EL-", "AV-", "ALR", "ELR"])
    assert [r.orig_pos for r in p.where("side='A' AND gappy").collect()] == [2]


def test_gappy_all_raises(spark):
    with pytest.raises(ValueError):
        prep.preprocess(_aligned(spark, ["---", "---", "ALR", "ELR"], ["ARN", "DCE", "QGH", "ILK"]), 0.5)


def test_constant_columns(spark):
    p = _profile(spark, ["ARND", "ARDC", "ANCE", "RNEQ"])
    assert p.where("side='A' AND constant").count() == 0
    p = _profile(spark, ["ARND", "ARDC", "ANCE", "ANEQ"])
    assert [r.orig_pos for r in p.where("side='A' AND constant").collect()] == [0]
    with pytest.raises(ValueError):
        prep.preprocess(_aligned(spark, ["ARND"] * 4, ["ARND", "CCCC", "DDDD", "EEEE"]), 0.5)


def test_process_rebase(spark):
    # gappy original column 2; constant original column 1 -> kept only column 0
    prepared = prep.preprocess(_aligned(spark, ["AL-", "VL-", "MLA"], ["ARN", "DCE", "QGH"]), 0.5)
    assert prepared.kept_a == [0]
    codes = [list(r.a) for r in prepared.pairs.orderBy("pair_id").collect()]
    assert codes == [[0], [19], [12]]
    prepared = prep.preprocess(_aligned(spark, ["A-L", "V-L", "MAL"], ["ARN", "DCE", "QGH"]), 0.5)
    assert prepared.kept_a == [0]  # gappy 1, then constant (original 2)


def test_contact_align(spark):
    prepared = prep.preprocess(_aligned(spark, ["DL-", "KL-", "DL-"], ["KT-", "DT-", "KT-"]), 0.5)
    cmap = spark.createDataFrame([(i, j, 1 if (i, j) == (0, 0) else 0) for i in range(3) for j in range(3)],
                                 "pos_a int, pos_b int, is_contact int")
    out = prep.align_contact_map(cmap, prepared.positions).collect()
    assert [(r.pos_a, r.pos_b, r.is_contact) for r in out] == [(0, 0, 1)]


POST_ALT = [0.90, 0.80, 0.75, 0.5, 0.2, 0.1]
POST_NULL = [0.30, 0.20, 0.30, 0.40, 0.80, 0.80]


def test_posterior(spark):
    df = spark.createDataFrame([(i, a, n) for i, (a, n) in enumerate(zip(POST_ALT, POST_NULL))],
                               "pair_id long, alt_llh double, null_llh double")
    z = [r.z for r in labels.posterior(df, 0.5).orderBy("pair_id").collect()]
    assert np.allclose(z, [0.64565631, 0.64565631, 0.61063923, 0.52497919, 0.35434369, 0.33181223], rtol=1e-6)


@pytest.mark.parametrize("pi,expected", [(1e-6, [0] * 6), (0.1, [0] * 6), (0.25, [0] * 6),
                                         (0.5, [1, 1, 1, 1, 0, 0]), (0.75, [1] * 6), (0.9, [1] * 6)])
def test_harden(spark, pi, expected):
    df = spark.createDataFrame([(i, a, n) for i, (a, n) in enumerate(zip(POST_ALT, POST_NULL))],
                               "pair_id long, alt_llh double, null_llh double")
    z = [int(r.z) for r in labels.posterior(df, pi, "hard").orderBy("pair_id").collect()]
    assert z == expected


def test_convergence_soft(spark):
    df = spark.createDataFrame([(0, 0.99, 0.99), (1, 0.99, 0.99), (2, 0.1, 0.1), (3, 0.1, 0.1), (4, 0.005, 0.01)],
                               "pair_id long, z double, z_prev double")
    assert labels.has_converged(df, mode="soft", tol=5e-3)
    assert not labels.has_converged(df, mode="hard")


def test_pwm_golden(spark):
    rows = [(0, [1, 2, 3], [0], 0.9), (1, [1, 3, 3], [0], 0.9), (2, [3, 2, 5], [0], 0.1)]
    st = spark.createDataFrame(rows, "pair_id long, a array<tinyint>, b array<tinyint>, z double")
    pwm = {(r.side, r.pos, r.aa): r.logp for r in null_model.fit_null(st).collect()}
    assert pwm[("A", 0, 1)] == pytest.approx(math.log(0.18181818), rel=1e-6)
    assert pwm[("A", 0, 3)] == pytest.approx(math.log(1 - 0.18181818), rel=1e-6)
    assert pwm[("A", 1, 2)] == pytest.approx(math.log(0.90909090), rel=1e-6)
    assert pwm[("A", 2, 5)] == pytest.approx(math.log(1 - 0.18181818), rel=1e-6)


def test_pwm_pseudocount(spark):
    rows = [(0, [1, 2, 3], [0], 0.9), (1, [1, 3, 3], [0], 0.9), (2, [3, 2, 5], [0], 0.1), (3, [18, 19, 20], [0], 1.0)]
    st = spark.createDataFrame(rows, "pair_id long, a array<tinyint>, b array<tinyint>, z double")
    pwm = {(r.side, r.pos, r.aa): r.logp for r in null_model.fit_null(st).collect()}
    assert pwm[("A", 0, 18)] == pytest.approx(math.log(1 / 2100))
    arrays = null_model.pwm_arrays(null_model.fit_null(st), 3, 1)
    scored = null_model.null_llh(st, arrays).orderBy("pair_id").collect()
    expected0 = pwm[("A", 0, 1)] + pwm[("A", 1, 2)] + pwm[("A", 2, 3)] + pwm[("B", 0, 0)]
    assert scored[0].null_llh == pytest.approx(expected0)


def test_bic_golden():
    lp = np.log([0.99, 0.90, 0.95, 0.10, 0.05, 0.15])
    assert 100 * math.log(6) - 2 * lp.sum() == pytest.approx(193.900229, rel=1e-6)
    assert 0 * math.log(6) - 2 * lp.sum() == pytest.approx(14.724282, rel=1e-6)


def test_bic_operator(spark):
    dfs = spark.createDataFrame([("A", 0, 100), ("A", 1, 0)], "side string, pos int, df long")
    lp = float(np.log([0.99, 0.90, 0.95, 0.10, 0.05, 0.15]).sum())
    sums = spark.createDataFrame([("A", 0, lp), ("A", 1, lp)], "side string, pos int, sum_logp double")
    from copair.operators.alt_model import bic

    out = {r.pos: r.bic for r in bic(dfs, sums, 6).collect()}
    assert out[0] == pytest.approx(193.900229, rel=1e-6) and out[1] == pytest.approx(14.724282, rel=1e-6)


def test_check_pairs(spark):
    ok = spark.createDataFrame([(i, [i % 3, 1]) for i in range(4)], "pair_id long, codes array<tinyint>")
    other = spark.createDataFrame([(i, [2, i % 2]) for i in range(4)], "pair_id long, codes array<tinyint>")
    assert checks.check_pairs(ok, other)["ok"]
    with pytest.raises(ValueError):
        checks.check_pairs(ok, ok)
    with pytest.raises(ValueError):
        checks.check_pairs(ok, other.where("pair_id < 3"))
    with pytest.raises(ValueError):
        checks.check_pairs(ok.where("pair_id = 0"), other.where("pair_id = 0"))


@pytest.mark.parametrize("bad", [dict(int_frac=0), dict(int_frac=1), dict(int_frac=-1), dict(int_frac=2),
                                 dict(gap_threshold=0), dict(gap_threshold=1), dict(init="cold"),
                                 dict(mode="medium"), dict(n_starts=0), dict(max_iters=1), dict(tol=0),
                                 dict(test=True), dict(test="yes"), dict(int_limit=-1)])
def test_option_bounds(bad):
    with pytest.raises(ValueError):
        EMOptions(**bad)


def test_true_labels(spark):
    pairs = spark.range(5).withColumnRenamed("id", "pair_id")
    y = [r.y for r in labels.true_labels(pairs, 2).orderBy("pair_id").collect()]
    assert y == [1, 1, 1, 0, 0]
    assert [r.y for r in labels.true_labels(pairs, 0).collect()] == [0] * 5
    with pytest.raises(ValueError):
        labels.true_labels(pairs, 6)


def test_random_labels_deterministic(spark):
    pairs = spark.range(2000).withColumnRenamed("id", "pair_id")
    a = labels.random_labels(pairs, 0.75, "soft", 7)
    b = labels.random_labels(pairs.repartition(5), 0.75, "soft", 7)
    ra = {r.pair_id: r.z for r in a.collect()}
    rb = {r.pair_id: r.z for r in b.collect()}
    assert ra == rb
    frac = sum(1 for v in ra.values() if v == 0.9) / len(ra)
    assert 0.7 < frac < 0.8


def test_pc_alt_value():
    assert PC_ALT == pytest.approx(math.log(1 / 210))

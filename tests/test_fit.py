"""Coevolution fit: KKT optimality of the distributed solver, path rules,
scoring agreement between the map-only kernel and the relational form,
and a small end-to-end EM run on a planted coupling."""

import math
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from copair.operators import alt_model, contacts, fit, labels, null_model, prep
from copair.operators.checks import EMOptions
from copair.plans import em

ALPH = "ARNDCEQGHILKMFPSTWYV"


def _planted(spark, n=240, seed=3):
    """A[0] drives B[0] (coupled); other columns independent; first 3/4 of
    the rows are interacting (B[0] follows A[0]), the rest random."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        a = rng.integers(0, 4, size=4)
        b = rng.integers(0, 4, size=4)
        if i < 3 * n // 4:
            b[0] = a[0]
        rows.append((i, "".join(ALPH[x] for x in a), "".join(ALPH[x] for x in b)))
    return spark.createDataFrame(rows, "pair_id long, seq_a string, seq_b string")


@pytest.fixture(scope="module")
def prepared(spark):
    return prep.preprocess(_planted(spark), 0.5)


@pytest.mark.parametrize("weights", [None, "z"])
def test_kkt_at_shipped_settings(spark, prepared, weights):
    state = prepared.pairs.withColumn("z", (F.col("pair_id") % 5 + 1) / 6)
    rows = fit.fit_rows(state, "soft", weighted=weights is not None)
    for alpha in (0.1, 0.01, 0.001):
        alphas = {s: {p: alpha for p in range(4)} for s in "AB"}
        res = fit.fit_columns(rows, prepared.width_a, prepared.width_b, alphas=alphas)
        kkt = fit.kkt_residual(rows, res.sides, res.stats, prepared.width_a, prepared.width_b)
        assert res.converged and max(v.max() for v in kkt.values()) <= 1.001e-5


def _gradient_descent(x, y, w, alpha, r, steps=30000):
    """Slow reference solver: proximal gradient with a safe step."""
    n, k = x.shape
    beta, b, step = np.zeros(k), 0.0, 4.0 / (1 + x.sum(1).max())
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(x @ beta + b)))
        res = w * (p - y) / n
        g = x.T @ res + alpha * (1 - r) * beta
        z = beta - step * g
        beta = np.sign(z) * np.maximum(np.abs(z) - step * alpha * r, 0)
        b -= step * res.sum()
    return beta, b


def test_coefficients_against_a_plain_solver(spark, prepared):
    rows = fit.fit_rows(prepared.pairs, "soft", weighted=False)
    alphas = {s: {p: 0.02 for p in range(4)} for s in "AB"}
    res = fit.fit_columns(rows, prepared.width_a, prepared.width_b, alphas=alphas, tol=1e-9)
    data = rows.toPandas()
    a, b = np.array(data["a"].tolist()), np.array(data["b"].tolist())
    sm = res.sides["B"]
    x = np.zeros((len(a), 4 * 21))
    for q in range(4):
        x[np.arange(len(a)), q * 21 + a[:, q]] = 1
    for m in (0, 5):
        beta, inter = _gradient_descent(x, (b[:, sm.tpos[m]] == sm.tcls[m]).astype(float), np.ones(len(a)), 0.02, 0.99)
        assert np.abs(sm.dense([m])[0] - beta).max() < 1e-4 and abs(sm.b[m] - inter) < 1e-4


def test_result_does_not_depend_on_partitions(spark, prepared):
    alphas = {s: {p: 0.01 for p in range(4)} for s in "AB"}
    fits = [fit.fit_columns(fit.fit_rows(prepared.pairs.repartition(n), "soft", weighted=False), 4, 4, alphas=alphas, tol=1e-9)
            for n in (1, 17)]
    for s in "AB":
        assert np.abs(fits[0].sides[s].dense() - fits[1].sides[s].dense()).max() < 1e-5


def test_closed_form_empty_models(spark, prepared):
    rows = fit.fit_rows(prepared.pairs, "soft", weighted=False)
    alphas = {s: {p: 1.0 for p in range(4)} for s in "AB"}
    res = fit.fit_columns(rows, prepared.width_a, prepared.width_b, alphas=alphas)
    for sm in res.sides.values():
        assert not sm.dense().any()
        assert sm.n_passes == 0
    kkt = fit.kkt_residual(rows, res.sides, res.stats, prepared.width_a, prepared.width_b)
    assert max(v.max() for v in kkt.values()) < 1e-9


def test_a_limit_of_passes_is_visible(spark, prepared):
    rows = fit.fit_rows(prepared.pairs, "soft", weighted=False)
    alphas = {s: {p: 0.001 for p in range(4)} for s in "AB"}
    res = fit.fit_columns(rows, prepared.width_a, prepared.width_b, alphas=alphas, max_iter=1)
    assert not res.converged


def test_constant_and_binary_columns(spark):
    rows = [(i, "AR"[i % 2] + "A", "NDC"[i % 3] + "AR"[(i // 3) % 2]) for i in range(60)]
    pairs = prep.encode_pairs(spark.createDataFrame(rows, "pair_id long, seq_a string, seq_b string"))
    res = fit.fit_columns(fit.fit_rows(pairs, "soft", weighted=False), 2, 2)
    kinds = {(r[0], r[1]): r[3] for r in res.path_table}
    assert kinds == {("A", 0): "binary", ("A", 1): "constant", ("B", 0): "ovr", ("B", 1): "binary"}
    assert all(r[8] for r in res.path_table) and res.alphas["A"][1] == 0.01
    models, coefs, intercepts = alt_model.model_tables(spark, res.sides)
    rel = alt_model.score_alt_relational(pairs, models, coefs, intercepts)
    ker = alt_model.score_alt(pairs, res.sides, 2, 2, per_residue=True)
    a = {(r.pair_id, r.pos): r.logp for r in rel.where("side = 'A'").collect()}
    for r in ker.collect():
        assert all(abs(a[(r.pair_id, p)] - v) < 1e-9 for p, v in enumerate(r.alt_a))
    assert math.isclose(a[(0, 1)], math.log(0.99 - 1 / 210))


def test_many_columns_few_rows(spark):
    rng = np.random.default_rng(11)
    seq = lambda n: "".join(ALPH[x] for x in rng.integers(0, 6, n))
    pairs = prep.encode_pairs(spark.createDataFrame([(i, seq(40), seq(60)) for i in range(60)], "pair_id long, seq_a string, seq_b string"))
    res = fit.fit_columns(fit.fit_rows(pairs, "soft", weighted=False), 40, 60,
                          alphas={"A": dict.fromkeys(range(40), 0.05), "B": dict.fromkeys(range(60), 0.05)})
    assert res.converged


def test_path_selection_finds_coupling(spark, prepared):
    rows = fit.fit_rows(prepared.pairs, "soft", weighted=False)
    res = fit.fit_columns(rows, prepared.width_a, prepared.width_b, dfmax=20)
    # coupled column gets a non-empty model; path table obeys the dfmax rule
    assert res.alphas["B"][0] < 1.0
    for s, p, a, kind, df, slp, bic, in_path, converged, chosen in res.path_table:
        assert in_path and converged and df <= 20
    _, coefs, _ = alt_model.model_tables(spark, res.sides)
    cmap = contacts.apc(contacts.couplings(coefs, prepared.width_a, prepared.width_b))
    top = contacts.top_contacts(cmap, 1).first()
    assert (top.pos_a, top.pos_b) == (0, 0)


def test_kernel_matches_relational(spark, prepared):
    rows = fit.fit_rows(prepared.pairs, "soft", weighted=False)
    alphas = {s: {p: 0.02 for p in range(4)} for s in "AB"}
    res = fit.fit_columns(rows, prepared.width_a, prepared.width_b, alphas=alphas)
    models, coefs, intercepts = alt_model.model_tables(spark, res.sides)
    rel = alt_model.alt_llh_from_residues(alt_model.score_alt_relational(prepared.pairs, models, coefs, intercepts))
    ker = alt_model.score_alt(prepared.pairs, res.sides, prepared.width_a, prepared.width_b)
    j = rel.join(ker.select("pair_id", F.col("alt_llh").alias("k")), "pair_id")
    diff = j.agg(F.max(F.abs(F.col("alt_llh") - F.col("k")))).first()[0]
    assert diff < 1e-9


def test_em_soft_end_to_end(spark, prepared):
    opts = EMOptions(mode="soft", init="warm", max_iters=4, int_frac=0.75)
    r = em.run_em(prepared, opts)
    per = em.llh_per_iter(r.trace).orderBy("iter").collect()
    assert len(per) == r.n_iters + 1
    totals = [p.total for p in per]
    assert all(b >= a - 1.0 for a, b in zip(totals, totals[1:]))  # non-decreasing up to solver tolerance
    last = r.trace.where(F.col("iter") == r.n_iters)
    z = {row.pair_id: row.z for row in last.collect()}
    n = len(z)
    hit = sum(1 for i, v in z.items() if (v >= 0.5) == (i < 3 * n // 4))
    assert hit / n > 0.8


def _hard(**kw):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return EMOptions(mode="hard", **kw)


def test_em_hard_keeps_both_classes_or_says_so(spark, prepared):
    r = em.run_em(prepared, _hard(init="random"))
    last = r.trace.where(F.col("iter") == r.n_iters).groupBy("z").count().collect()
    assert {row.z for row in last} == {0.0, 1.0} and r.converged
    state = prepared.pairs.withColumn("z", F.lit(1.0))
    with pytest.raises(ValueError, match="one class is empty"):
        labels.check_hard_labels(state)
    with pytest.raises(ValueError, match="must be 0 or 1"):
        labels.check_hard_labels(state.withColumn("z", F.lit(0.5)))


def test_contact_fit_counts_the_selected_rows(spark, prepared):
    state = prepared.pairs.withColumn("z", F.when(F.col("pair_id") < 180, 0.9).otherwise(0.1))
    _, res = em.predict_contacts(prepared, state, EMOptions())
    assert res.n_all == 180 == res.stats.n


def test_one_scoring_pass_per_iteration(spark, prepared):
    alphas = {s: {p: 0.02 for p in range(4)} for s in "AB"}
    res = fit.fit_columns(fit.fit_rows(prepared.pairs, "soft", weighted=False), 4, 4, alphas=alphas)
    state = prepared.pairs.withColumn("z", F.lit(0.4))
    pwm = em._pwm(state, "soft", 4, 4)
    both = alt_model.score_alt(state, res.sides, 4, 4, pwm=pwm)
    assert both._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    want = null_model.null_llh(state, pwm).select("pair_id", F.col("null_llh").alias("w"))
    assert both.join(want, "pair_id").where(F.abs(F.col("null_llh") - F.col("w")) > 1e-9).count() == 0
    long = null_model.score_null_long(state, null_model.fit_null(state)).groupBy("pair_id").agg(F.sum("logp").alias("w"))
    assert both.join(long, "pair_id").where(F.abs(F.col("null_llh") - F.col("w")) > 1e-9).count() == 0


def test_trace_is_read_by_iteration(spark, prepared):
    r = em.run_em(prepared, EMOptions(max_iters=2))
    plan = r.trace.where("iter = 1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(iter" in plan

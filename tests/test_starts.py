"""Shared passes over starts, resuming, per-residue tables, bounded passes of the fit, stalls and unknown residues."""

import math
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from copair.operators import alt_model, evaluate, fit, labels, null_model, prep
from copair.operators import kernels as K
from copair.operators.checks import EMOptions
from copair.operators.models import layout
from copair.plans import em
from tests.test_fit import ALPH, _planted


@pytest.fixture(scope="module")
def prepared(spark):
    return prep.preprocess(_planted(spark, 80), 0.5)


#: Few passes a fit: shared and single runs make the same steps, optimal or not.
FEW = {"max_init_iters": 2, "max_reg_iters": 2}


def options(mode="soft", **kw):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return EMOptions(mode=mode, **FEW, **kw)


def rows_of(trace):
    return {(r.iter, r.pair_id): (r.z, r.alt_llh, r.null_llh) for r in trace.collect()}


def assert_same(a, b, tol=1e-4):
    assert a.keys() == b.keys()
    for k in a:
        for x, y in zip(a[k], b[k]):
            assert (x is None) == (y is None) and (x is None or abs(x - y) <= tol * max(1, abs(x))), k


@pytest.mark.parametrize("mode", ["soft", "hard"])
def test_starts_equal_single_runs(spark, prepared, mode):
    opts = options(mode, init="random", max_iters=2, n_starts=3)
    runs = em.em_multistart(prepared, opts)
    assert [r.start for r in runs] == [0, 1, 2] and len({r.all_starts.folder for r in runs}) == 1
    for k in (2,):
        one = em.run_em(prepared, opts, start=k)
        assert_same(rows_of(runs[k].trace), rows_of(one.trace))
        assert runs[k].alphas == one.alphas and (runs[k].n_iters, runs[k].converged) == (one.n_iters, one.converged)
        cells = lambda r: {(c.iter, c.pos_a, c.pos_b): c.strength for c in r.couplings.collect()}
        a, b = cells(runs[k]), cells(one)
        assert a.keys() == b.keys() and all(abs(a[c] - b[c]) < 1e-3 for c in a)


def test_a_converged_start_takes_no_part_in_later_passes(spark, prepared):
    runs = em.em_multistart(prepared, options("hard", init="random", n_starts=3, max_iters=4))
    per_iter = {r.iter: r.n for r in runs[0].all_starts.trace.groupBy("iter").agg(F.countDistinct("start").alias("n")).collect()}
    assert per_iter == {k: sum(k <= r.n_iters for r in runs) for k in range(max(r.n_iters for r in runs) + 1)}
    for r in runs:
        last = {x.pair_id: x.z for x in r.trace.where(F.col("iter") == r.n_iters).collect()}
        assert {x.pair_id: x.z for x in r.final_state.collect()} == last


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_history_gives_the_matrices_without_moving_pairs(spark, prepared):
    runs = em.em_multistart(prepared, options(init="random", max_iters=2, n_starts=2, history=True))
    history = runs[0].all_starts.history
    assert history.count() == prepared.pairs.count()
    long = evaluate.unrolled(history)
    for r in runs:
        assert_same(rows_of(long.where(F.col("start") == r.start)), rows_of(r.trace))
        for of, cols in ((evaluate.label_evolution, [str(k) for k in r.iters]),
                         (evaluate.llh_evolution, [*[str(k) for k in r.iters], "null_llh"])):
            wide, pivoted = of(history, r.iters, start=r.start), of(r.trace, r.iters)
            assert wide.columns == pivoted.columns == ["pair_id", *cols]
            assert sorted(map(tuple, wide.collect()), key=str) == sorted(map(tuple, pivoted.collect()), key=str)
            assert "Exchange" not in plan_of(wide)
        assert evaluate.label_evolution(history, start=r.start).columns == ["pair_id", *map(str, r.iters)]


def test_truth_as_expression_or_column_equals_the_join(spark, prepared):
    trace = em.run_em(prepared, options(max_iters=2)).trace
    table, y = labels.true_labels(prepared.pairs, 40), labels.true_label_expr(40)
    for table_of in (lambda t: evaluate.performance_per_iter(trace, t), lambda t: em.llh_per_iter(trace, t),
                     lambda t: evaluate.confusion(trace.where("iter = 1"), t), lambda t: evaluate.label_report(trace.where("iter = 1"), t)):
        joined, computed = ([r.asDict() for r in table_of(t).collect()] for t in (table, y))
        key = lambda r: str([r.get(c) for c in ("iter", "y", "y_hat")])
        for a, b in zip(sorted(joined, key=key), sorted(computed, key=key), strict=True):
            assert a == pytest.approx(b, nan_ok=True) if None not in a.values() else a == b
        assert "Join" not in plan_of(evaluate.performance_per_iter(trace, y))
    with_y = trace.withColumn("y", y)
    assert {r.iter: r.mcc for r in evaluate.performance_per_iter(with_y, None).collect()} == {
        r.iter: r.mcc for r in evaluate.performance_per_iter(trace, table).collect()}


class Ended(Exception):
    pass


@pytest.mark.parametrize("init", ["warm", "random"])
def test_a_run_that_ended_goes_on_after_its_last_commit(spark, prepared, scratch, monkeypatch, init):
    opts = options(init=init, max_iters=3, n_starts=2 if init == "random" else 1, tol=1e-12)
    starts = list(range(opts.n_starts))
    whole = em.run_starts(prepared, opts, starts)
    score, calls = alt_model.score_starts, []

    def ends_in_the_second(*args, **kw):
        calls.append(1)
        if len(calls) == 2:
            raise Ended
        return score(*args, **kw)

    monkeypatch.setattr(alt_model, "score_starts", ends_in_the_second)
    with pytest.raises(Ended):
        em.run_starts(prepared, opts, starts, f"{scratch}/run")
    monkeypatch.setattr(alt_model, "score_starts", score)
    passes = []
    fits = fit.fit_starts
    monkeypatch.setattr(fit, "fit_starts", lambda *a, **k: passes.append(1) or fits(*a, **k))
    again = em.run_starts(prepared, opts, starts, f"{scratch}/run")
    assert len(passes) < 3  # committed iterations are not fitted again
    for a, b in zip(whole, again):
        assert a.iters == b.iters and a.alphas == b.alphas
        assert_same(rows_of(a.trace), rows_of(b.trace))
        assert {m.iter for m in b.models.select("iter").distinct().collect()} == {m.iter for m in a.models.select("iter").distinct().collect()}
    passes.clear()
    em.run_starts(prepared, opts, starts, f"{scratch}/run")
    assert not passes


def test_residues_of_every_iteration_sum_to_the_trace(spark, prepared):
    runs = em.em_multistart(prepared, options(init="random", n_starts=2, max_iters=2, residues=True))
    t = runs[0].all_starts
    sums = t.residues.groupBy("start", "iter", "pair_id", "model").agg(F.sum("logp").alias("s"), F.count(F.lit(1)).alias("n"))
    both = sums.join(t.trace, ["start", "iter", "pair_id"])
    want = F.when(F.col("model") == "alt", F.col("alt_llh")).otherwise(F.col("null_llh"))
    got = both.agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("s") - want)).alias("d"), F.max("n").alias("cells")).first()
    assert got.n == 2 * 2 * 2 * 80 and got.d < 1e-9 and got.cells == 8


def test_convergence_is_observed_by_the_writing_pass(spark, prepared, monkeypatch):
    from copair.operators import labels
    monkeypatch.setattr(labels, "convergence_df", None)
    r = em.run_em(prepared, options(max_iters=3))
    moved = r.trace.where(F.col("iter") >= r.n_iters - 1).groupBy("pair_id").agg(F.abs(F.max("z") - F.min("z")).alias("d")).agg(F.avg("d")).first()[0]
    assert r.converged == (moved < 0.005)


# --- bounded passes -------------------------------------------------------

def wide_pairs(spark, n, la, lb, codes=6, seed=11):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, codes, (n, la)), rng.integers(0, codes, (n, lb))
    b[: n // 2, :5] = a[: n // 2, :5]
    return spark.createDataFrame([(i, x.tolist(), y.tolist()) for i, (x, y) in enumerate(zip(a, b))],
                                 "pair_id long, a array<tinyint>, b array<tinyint>")


def test_sums_of_a_pass_stay_within_the_bound_at_179_and_253_columns():
    """The larger published shape, 12 classes a column and four strengths: 20,736 open models, 5313 features."""
    sides, trials, usable, previous = {}, {}, {}, {}
    rng = np.random.default_rng(0)
    for s, lt, lo in (("A", 179, 253), ("B", 253, 179)):
        sm = layout(s, lt, lo, [(p, a, range(12)) for p in range(lt) for a in (0.1, 0.05, 0.02, 0.01)])
        key = (0, s)
        sides[key], previous[key] = sm, {}
        usable[key] = np.ones(sm.n_features, dtype=bool)
        trials[key] = {}
        for m in range(sm.n_models):
            t = fit._start(sm, m)
            if m % 3:  # a third in their first pass
                t.full, t.screen = False, np.sort(rng.choice(sm.n_features, 150, replace=False))
                t.feats, t.coefs = t.screen[:60], np.zeros(60)
            trials[key][m] = t
    passes = fit.plan_passes(sides, trials, usable, previous, fit.PASS_BYTES)
    size = lambda p: 8 * (len(p["models"]) * (2 + len(p["cols"])) + sum((len(t.feats) + 1) ** 2 for t in p["trials"]))
    blocks = [b for p in passes for b in p.values()]
    assert sum(len(b["models"]) for b in blocks) == 20736
    assert all(size(b) <= fit.BLOCK_BYTES for b in blocks)
    assert all(sum(size(b) for b in p.values()) <= fit.PASS_BYTES for p in passes) and len(passes) > 5
    for b in blocks:
        assert all(np.isin(t.feats, b["cols"]).all() for t in b["trials"])


def test_many_small_passes_give_the_same_coefficients(spark):
    pairs = wide_pairs(spark, 150, 9, 12)
    rows = fit.fit_rows(pairs, "soft", weighted=False)
    alphas = {"A": dict.fromkeys(range(9), 0.01), "B": dict.fromkeys(range(12), 0.01)}
    one = fit.fit_columns(rows, 9, 12, alphas=alphas, tol=1e-8)
    small = fit.fit_columns(rows, 9, 12, alphas=alphas, tol=1e-8, pass_bytes=1 << 16)
    for s in "AB":
        assert np.abs(one.sides[s].dense() - small.sides[s].dense()).max() < 1e-5
    kkt = fit.kkt_residual(rows, small.sides, small.stats, 9, 12)
    assert small.converged and max(v.max() for v in kkt.values()) <= 1e-7


def test_screening_drops_features_and_the_recheck_returns_them():
    rng = np.random.default_rng(1)
    own = np.arange(40)
    g = rng.uniform(-0.02, 0.02, 40)
    g[[3, 7]] = 0.2, -0.15
    g[9] = 0.06
    empty = np.empty(0, np.int64)
    t = fit.Trial(empty, np.empty(0), 0.0, empty, np.empty(0), 0.0, math.inf, empty, True)
    new, _, state = fit.next_trial(t, 1.0, g, 0.0, np.eye(1), 0.1, 0.0, own, 1e-5, previous=0.11)
    assert state == "open" and not new.full and new.screen.tolist() == [3, 7] and new.feats.tolist() == [3, 7]
    # optimal on the screened features: all are looked at again, and one that violates joins
    calm = fit.Trial(new.screen, np.zeros(2), 0.0, empty, np.empty(0), 0.0, 1.0, new.screen, False)
    again, worst, state = fit.next_trial(calm, 0.9, np.array([0.05, 0.05]), 0.0, np.eye(3), 0.1, 0.0, new.screen, 1e-5)
    assert state == "open" and again.full and worst == 0
    g2 = np.zeros(40)
    g2[20] = 0.3
    back, _, state = fit.next_trial(again, 0.9, g2, 0.0, np.eye(3), 0.1, 0.0, own, 1e-5, previous=0.1)
    assert state == "open" and {3, 7, 20} <= set(back.screen.tolist()) and 20 in back.feats


def test_a_tolerance_below_rounding_ends_and_says_so(spark, prepared):
    rows = fit.fit_rows(prepared.pairs.where("pair_id < 60"), "soft", weighted=False)
    alphas = {s: {p: 0.01 for p in range(4)} for s in "AB"}
    res = fit.fit_columns(rows, 4, 4, alphas=alphas, tol=1e-300)
    assert not res.converged
    kkt = fit.kkt_residual(rows, res.sides, res.stats, 4, 4)
    assert max(v.max() for v in kkt.values()) < 1e-9  # as near as rounding lets it


def test_gather_table_equals_the_dense_product():
    rng = np.random.default_rng(3)
    for share in (0.02, 0.6):
        coefs = np.where(rng.random((30, 8 * 21)) < share, rng.standard_normal((30, 8 * 21)), 0.0)
        feats = [np.flatnonzero(c) for c in coefs]
        table = K.CoefTable(feats, [c[f] for c, f in zip(coefs, feats)])
        assert (table.dense is None) == (share < 0.1)
        codes = rng.integers(0, 21, (70, 8))
        x = K.one_hot_at(codes, np.arange(8 * 21))
        assert np.allclose(table.margins(codes), x @ coefs.T)


def test_null_models_of_all_starts_in_one_aggregate(spark, prepared):
    state = prepared.pairs.withColumns({"x": (F.col("pair_id") % 7) / 7, "y": (F.col("pair_id") % 2).cast("double")})
    both = null_model.pwms_of_starts(state.withColumn("z", F.array("x", "y")), 2, 4, 4)
    soft = null_model.pwm_arrays(null_model.fit_null(state, "soft", "x"), 4, 4)
    hard = null_model.pwm_arrays(null_model.fit_null(state, "hard", "y"), 4, 4)
    for got, want in zip(both, (soft, hard)):
        assert all(np.allclose(got[s], want[s]) for s in "AB")


# --- unknown residues -----------------------------------------------------

def strange(spark):
    rng = np.random.default_rng(5)
    word = lambda: "".join(ALPH[x] for x in rng.integers(0, 4, 3))
    rows = [(i, word(), word()) for i in range(40)] + [(40, "AXR", "AAA"), (41, "ARN", "..."), (42, "AXX", "BAR")]
    return spark.createDataFrame(rows, "pair_id long, seq_a string, seq_b string")


def test_unknown_residues_are_an_error_gaps_or_set_aside(spark):
    with pytest.raises(ValueError, match="not in the alphabet"):
        prep.preprocess(strange(spark))
    gaps = prep.preprocess(strange(spark), on_unknown="gap")
    assert gaps.pairs.count() == 43 and gaps.rejected is None
    one = gaps.pairs.where("pair_id = 42").first()
    assert list(one.a) == [0, 20, 20] and list(one.b) == [20, 0, 1]
    kept = prep.preprocess(strange(spark), on_unknown="quarantine")
    assert kept.pairs.count() == 40
    assert sorted(tuple(r) for r in kept.rejected.collect()) == [(40, "AXR", "AAA"), (41, "ARN", "..."), (42, "AXX", "BAR")]
    with pytest.raises(ValueError, match="on_unknown"):
        EMOptions(on_unknown="drop")


def test_texts_are_read_once(spark):
    pairs = prep.preprocess(_planted(spark), 0.5).pairs
    assert "instr" not in pairs._jdf.queryExecution().optimizedPlan().toString().lower()

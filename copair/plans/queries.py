"""Registered queries: one per operator group of the blueprint, each a
function ``(spark, sf_dir) -> DataFrame`` over the whole test tables.

Doubles are rounded to 6 places and counts cast to BIGINT so that the
DuckDB oracle (``copair.plans.oracle``) can compare values.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from copair.functions.alphabet import GAP, L1_RATIO, N_CODES
from copair.functions.prob import harden_expr, posterior_expr
from copair.operators import alt_model, checks, contacts, evaluate, fit, labels, null_model, prep
from copair.operators.checks import EMOptions
from copair.operators.models import layout
from copair.plans import derived as D
from copair.plans import em

R = 6
DFMAX_GIVEN = 100
TOP_N = 10
METRIC_LIMIT = 20
FIRST_STEP_L1 = 0.02  # l1 strength of the proximal step from the empty models


def _derive(spark, sf):
    return D.derive(spark, sf)


def _r(c: str) -> F.Column:
    return F.round(F.col(c), R).alias(c)


# --- preprocessing --------------------------------------------------------

def _profile(spark, sf):
    return prep.column_profile(prep.residue_counts(D.raw_encoded(spark, sf)), D.GAP_THRESHOLD)


def q_gap_profile(spark, sf):
    p = _profile(spark, sf)
    return p.select("side", "orig_pos", _r("gap_freq"), F.col("gappy").cast("int").alias("gappy"))


def q_column_cardinality(spark, sf):
    p = _profile(spark, sf)
    return p.select("side", "orig_pos", "n_codes", F.col("constant").cast("int").alias("constant"))


def q_kept_positions(spark, sf):
    return _profile(spark, sf).where("kept").select("side", "orig_pos", "pos")


def q_encode_residues(spark, sf):
    return prep.long_view(D.raw_encoded(spark, sf), "orig_pos")


def q_one_hot_features(spark, sf):
    d = _derive(spark, sf)
    return prep.one_hot_long(d.pairs).select("pair_id", "side", F.col("feature").cast("int"))


def q_check_pairs(spark, sf):
    """Three inputs: both sides lack pairs, a side against itself, and the pairs on both sides."""
    enc = D.raw_encoded(spark, sf)
    a = enc.where("pair_id % 7 <> 3").select("pair_id", F.col("a").alias("codes"))
    b = enc.where("pair_id % 5 <> 2").select("pair_id", F.col("b").alias("codes"))
    cases = {"shifted": (a, b), "same": (a, a),
             "paired": (a.join(b.select("pair_id"), "pair_id", "left_semi"), b.join(a.select("pair_id"), "pair_id", "left_semi"))}
    out = [checks.check_pairs_df(x, y).withColumn("kind", F.lit(kind)) for kind, (x, y) in cases.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).select(
        "kind", "n_a", "n_b", "missing_a", "missing_b", F.col("identical").cast("int").alias("identical"),
        F.col("ok").cast("int").alias("ok"))


def q_unknown_residues(spark, sf):
    docs = D.load_table(spark, sf, "documents")
    seqs = docs.select(F.col("doc_id").alias("pair_id"),
                       F.upper(F.regexp_replace("text", "[^A-Za-z]", "")).alias("seq"))
    return checks.unknown_residues(seqs)


def q_on_unknown(spark, sf):
    """Unknown residues under each mode: pairs kept and set aside, and gap codes (with 'error': unknown ones)."""
    aligned = D.strange_alignment(spark, sf)
    out = []
    for mode in prep.ON_UNKNOWN:
        encoded, rejected = prep.stored_pairs(aligned, mode)
        counts = prep.residue_counts(encoded).groupBy("side").agg(
            F.sum(F.when(F.col("orig_pos") == 0, F.col("n"))).alias("n_pairs"),
            F.sum(F.when(F.col("aa") == (-1 if mode == "error" else GAP), F.col("n")).otherwise(0)).alias("n_codes"))
        n = rejected.count() if rejected is not None else 0
        out.append(counts.select(F.lit(mode).alias("mode"), "side", "n_pairs", F.lit(n).cast("long").alias("n_rejected"), "n_codes"))
    return out[0].unionByName(out[1]).unionByName(out[2])


def _orig_contact_map(spark, sf):
    """Truth on the original grid: B[q] is derived from A[q], so the
    planted contacts are the diagonal cells."""
    p = _profile(spark, sf)
    wb = p.where("side = 'B'").agg(F.max("orig_pos")).first()[0]
    grid = p.where("side = 'A'").select(F.col("orig_pos").alias("pos_a"),
                                          F.explode(F.sequence(F.lit(0), F.lit(int(wb)))).alias("pos_b"))
    return grid.select("pos_a", "pos_b", (F.col("pos_a") == F.col("pos_b")).cast("double").alias("value"),
                       (F.col("pos_a") == F.col("pos_b")).cast("int").alias("is_contact")), p


def q_align_contact_map(spark, sf):
    cmap, p = _orig_contact_map(spark, sf)
    return prep.align_contact_map(cmap, p)


def q_check_contact_map(spark, sf):
    """The whole map, one with values that are neither 0 nor 1, and one that lacks rows."""
    cmap, p = _orig_contact_map(spark, sf)
    odd = F.when((F.col("pos_a") + F.col("pos_b")) % 11 == 5, F.lit(0.5)).otherwise(F.col("value"))
    cases = {"good": cmap, "bad_values": cmap.withColumn("value", odd), "short": cmap.where("pos_a < 9")}
    out = [checks.check_contact_map_df(m, p).withColumn("kind", F.lit(kind)) for kind, m in cases.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).select(
        "kind", "n_cells", "rows", "cols", "bad_values", "n_contacts", "len_a", "len_b", F.col("ok").cast("int").alias("ok"))


# --- labels ---------------------------------------------------------------

def q_true_labels(spark, sf):
    d = _derive(spark, sf)
    n = d.pairs.count()
    return labels.true_labels(d.pairs, int(math.floor(0.75 * n)) - 1, n)


_KEYS = ("side", "pos", "alpha")


def _given_path_table(d):
    """(side, pos, alpha, df, sum_logp, bic, in_path) for every given model, and the model tables."""
    models, coefs, intercepts = tables = D.given_models(d)
    La, Lb = d.prepared.width_a, d.prepared.width_b
    sums = fit.logprob_table(d.spark, d.pairs, alt_model.sides_from_tables(*tables, La, Lb), La, Lb)
    dfs = alt_model.degrees_of_freedom(models, coefs, _KEYS)
    table = alt_model.bic(dfs, sums, d.pairs.count(), _KEYS)
    return alt_model.dfmax_path(table, DFMAX_GIVEN), tables


def _selected(d):
    """The chosen rows of the path table, and the model tables of the chosen models."""
    table, tables = _given_path_table(d)
    sel = alt_model.select_by_bic(table)
    chosen = F.broadcast(sel.select(*_KEYS))  # one row per column
    return sel, [t.join(chosen, list(_KEYS)) for t in tables]


def _alt(d):
    La, Lb = d.prepared.width_a, d.prepared.width_b
    _, tables = _selected(d)
    return alt_model.score_alt(d.pairs, alt_model.sides_from_tables(*tables, La, Lb), La, Lb, per_residue=True)


def _null_soft(d):
    st = d.prior()
    pwm = null_model.fit_null(st.select("pair_id", "a", "b", "z"), "soft")
    return st, pwm


def _posterior_df(d):
    alt = _alt(d).select("pair_id", "alt_llh")
    st, pwm = _null_soft(d)
    nl = null_model.null_llh(st, null_model.pwm_arrays(pwm, d.prepared.width_a, d.prepared.width_b))
    j = nl.select("pair_id", "z", "null_llh").join(alt, "pair_id")
    return j.withColumn("z_post", posterior_expr("alt_llh", "null_llh", D.INT_FRAC))


def q_posterior(spark, sf):
    p = _posterior_df(_derive(spark, sf))
    return p.select("pair_id", F.round("z_post", R).alias("z"))


def q_harden(spark, sf):
    p = _posterior_df(_derive(spark, sf))
    return p.select("pair_id", harden_expr("z_post").alias("z_hard"))


def q_convergence(spark, sf):
    p = _posterior_df(_derive(spark, sf))
    c = labels.convergence_df(p, "z_post", "z", "soft", 0.005)
    return c.select("n", _r("sum_abs_diff"), _r("mean_abs_diff"), F.col("converged").cast("int").alias("converged"))


def q_select_interacting(spark, sf):
    p = _posterior_df(_derive(spark, sf)).withColumn("zh", harden_expr("z_post"))
    return labels.select_interacting(p, "zh").select("pair_id", F.round("z_post", R).alias("z"))


def q_select_noninteracting(spark, sf):
    p = _posterior_df(_derive(spark, sf)).withColumn("zh", harden_expr("z_post"))
    return labels.select_noninteracting(p, "zh").select("pair_id", F.round("z_post", R).alias("z"))


def q_select_for_contacts(spark, sf):
    p = _posterior_df(_derive(spark, sf))
    return labels.select_for_contacts(p, "soft", "z_post").select("pair_id", F.round("z_post", R).alias("z"))


def q_random_labels(spark, sf):
    d = _derive(spark, sf)
    return labels.random_labels(d.pairs.select("pair_id"), D.INT_FRAC, "soft", 42)


# --- null model -----------------------------------------------------------

def q_null_pwm_soft(spark, sf):
    _, pwm = _null_soft(_derive(spark, sf))
    return pwm.select("side", "pos", "aa", _r("logp"))


def q_null_pwm_hard(spark, sf):
    st = _derive(spark, sf).prior()
    pwm = null_model.fit_null(st.select("pair_id", "a", "b", F.col("z_hard").alias("z")), "hard")
    return pwm.select("side", "pos", "aa", _r("logp"))


def q_null_score(spark, sf):
    d = _derive(spark, sf)
    st, pwm = _null_soft(d)
    return null_model.score_null_long(st, pwm).select("pair_id", "side", "pos", _r("logp"))


def q_null_llh(spark, sf):
    d = _derive(spark, sf)
    st, pwm = _null_soft(d)
    nl = null_model.null_llh(st, null_model.pwm_arrays(pwm, d.prepared.width_a, d.prepared.width_b))
    return nl.select("pair_id", _r("null_llh"))


# --- coevolution model on given tables -------------------------------------

def q_degrees_of_freedom(spark, sf):
    d = _derive(spark, sf)
    models, coefs, _ = D.given_models(d)
    return alt_model.degrees_of_freedom(models, coefs, ("side", "pos", "alpha"))


def q_bic(spark, sf):
    table, _ = _given_path_table(_derive(spark, sf))
    return table.select("side", "pos", "alpha", "df", _r("sum_logp"), _r("bic"))


def q_dfmax_path(spark, sf):
    table, _ = _given_path_table(_derive(spark, sf))
    return table.select("side", "pos", "alpha", "df", F.col("in_path").cast("int").alias("in_path"))


def q_select_by_bic(spark, sf):
    sel, _ = _selected(_derive(spark, sf))
    return sel.select("side", "pos", "alpha", "df", _r("bic"))


def q_alt_score(spark, sf):
    sc = _alt(_derive(spark, sf))
    a = sc.select("pair_id", F.lit("A").alias("side"), F.posexplode("alt_a").alias("pos", "logp"))
    b = sc.select("pair_id", F.lit("B").alias("side"), F.posexplode("alt_b").alias("pos", "logp"))
    return a.unionByName(b).select("pair_id", "side", F.col("pos").cast("int"), _r("logp"))


def q_alt_llh(spark, sf):
    return _alt(_derive(spark, sf)).select("pair_id", _r("alt_llh"))


def q_fit_first_step(spark, sf):
    """Screening pass: max |gradient| of every intercept-only model, i.e. the
    smallest alpha*r at which it is still empty, and the proximal step from it."""
    d = _derive(spark, sf)
    La, Lb = d.prepared.width_a, d.prepared.width_b
    rows = d.pairs.select("a", "b", F.lit(1.0).alias("w"))
    stats = fit.row_stats(rows, La, Lb)
    sides, tables = {}, []
    for s, lt, lo in (("A", La, Lb), ("B", Lb, La)):
        sides[s] = layout(s, lt, lo, [(p, 0.0, c) for p, c in enumerate(fit.column_classes(stats, s))])
        fit.closed_form_intercepts(sides[s], stats)
        tables += [(s, m, int(p), int(c)) for m, (p, c) in enumerate(zip(sides[s].tpos, sides[s].tcls))]
    names = spark.createDataFrame(tables, "side string, model long, pos int, cls int")
    g = fit.gradients(rows, sides, La, Lb, stats.n).select("side", "model", F.posexplode("g").alias("f", "g"))
    top = g.where(F.col("f") % N_CODES < 20).groupBy("side", "model").agg(
        F.max(F.abs("g")).alias("max_grad"),
        F.sum(F.greatest(F.abs("g") - F.lit(FIRST_STEP_L1), F.lit(0.0))).alias("step_l1"),
        F.sum((F.abs("g") > FIRST_STEP_L1).cast("long")).alias("step_nonzero"))
    return top.join(F.broadcast(names), ["side", "model"]).select(
        "side", "pos", "cls", _r("max_grad"), F.round(F.col("max_grad") / L1_RATIO, R).alias("alpha_max"), _r("step_l1"), "step_nonzero")


# --- contacts ---------------------------------------------------------------

def _given_cmap(d):
    _, (_, coefs, _) = _selected(d)
    return contacts.apc(contacts.couplings(coefs, d.prepared.width_a, d.prepared.width_b))


def _aligned_truth(spark, sf):
    cmap, p = _orig_contact_map(spark, sf)
    return prep.align_contact_map(cmap, p)


def q_couplings(spark, sf):
    return _given_cmap(_derive(spark, sf)).select("pos_a", "pos_b", _r("strength"), "name")


def q_apc(spark, sf):
    return _given_cmap(_derive(spark, sf)).select("pos_a", "pos_b", _r("strength"), _r("apc"))


def q_top_contacts(spark, sf):
    t = contacts.top_contacts(_given_cmap(_derive(spark, sf)), TOP_N)
    return t.select("pos_a", "pos_b", _r("apc"))


def q_contact_metrics(spark, sf):
    d = _derive(spark, sf)
    m = contacts.contact_metrics(_given_cmap(d), _aligned_truth(spark, sf), METRIC_LIMIT)
    return m.select("rank", "pos_a", "pos_b", "tp", _r("tpr"), _r("ppv"))


def q_contact_mcc(spark, sf):
    d = _derive(spark, sf)
    cmap, truth = _given_cmap(d), _aligned_truth(spark, sf)
    both = [contacts.contact_mcc(cmap, truth, c).withColumn("col", F.lit(c)) for c in ("strength", "apc")]
    return both[0].unionByName(both[1]).select("col", "tp", "tn", "fp", "fn", _r("mcc"))


def q_binarize_contacts(spark, sf):
    cmap = _given_cmap(_derive(spark, sf))
    strong = contacts.binarize_contacts(cmap, 0.5).withColumnRenamed("predicted", "strong")
    return contacts.binarize_contacts(strong, col="apc").select("pos_a", "pos_b", "predicted", "strong")


# --- EM tables on a fixed-coevolution-model trace ----------------------------

def _given_sides(d):
    _, tables = _selected(d)
    return alt_model.sides_from_tables(*tables, d.prepared.width_a, d.prepared.width_b)


def _trace(d, truth=None):
    return D.fixed_alt_trace(d, _given_sides(d), truth)


def q_residue_llh(spark, sf):
    """Per iteration, model and column: pairs and their summed residue log-probabilities."""
    d = _derive(spark, sf)
    long = D.fixed_alt_residues(d, _given_sides(d)).groupBy("iter", "model", "side", "pos").agg(
        F.count(F.lit(1)).alias("n"), F.sum("logp").alias("logp"))
    return long.select("iter", "model", "side", F.col("pos").cast("int").alias("pos"), "n", _r("logp"))


def q_weighted_llh(spark, sf):
    w = em.weighted_llh(_trace(_derive(spark, sf)))
    return w.select("iter", "pair_id", _r("alt_int"), _r("null_nonint"))


def q_llh_per_iter(spark, sf):
    d = _derive(spark, sf)
    t = em.llh_per_iter(_trace(d, d.truth()))
    return t.select("iter", *[_r(c) for c in ("sum_alt", "sum_null", "sum_alt_int", "sum_null_nonint", "total",
                                              "true_alt", "true_null", "true_total")])


def q_llh_monotonic(spark, sf):
    t = em.llh_monotonic(em.llh_per_iter(_trace(_derive(spark, sf))))
    return t.select(F.col("monotonic").cast("int").alias("monotonic"), "n_iters")


def _last_iter(trace):
    return trace.where("iter = 2")


def q_confusion(spark, sf):
    d = _derive(spark, sf)
    c = evaluate.confusion(_last_iter(_trace(d, d.truth())), None, "soft")
    return c.select("y", "y_hat", "n", _r("share"))


def q_label_report(spark, sf):
    d = _derive(spark, sf)
    r = evaluate.label_report(_last_iter(_trace(d, d.truth())), None, "soft")
    return r.select("n", "n_classes", "tp", "tn", "fp", "fn", _r("mcc"), _r("log_loss"))


def q_performance_per_iter(spark, sf):
    d = _derive(spark, sf)
    r = evaluate.performance_per_iter(_trace(d, d.truth()), None, "soft")
    return r.select("iter", "n", "tp", "tn", "fp", "fn", _r("mcc"), _r("log_loss"))


def q_label_evolution(spark, sf):
    d = _derive(spark, sf)
    e = evaluate.label_evolution(D.fixed_alt_history(d, _given_sides(d)), [0, 1, 2])
    return e.select("pair_id", *[F.round(F.col(str(k)), R).alias(f"z_{k}") for k in range(3)])


def q_llh_evolution(spark, sf):
    d = _derive(spark, sf)
    e = evaluate.llh_evolution(D.fixed_alt_history(d, _given_sides(d)), [0, 1, 2])
    return e.select("pair_id", *[F.round(F.col(str(k)), R).alias(f"alt_{k}") for k in range(3)], _r("null_llh"))


def q_alt_vs_null(spark, sf):
    return evaluate.alt_vs_null(_trace(_derive(spark, sf))).select("iter", "pair_id", _r("alt_llh"), _r("null_llh"))


# --- model fitting and EM (rows-only checks; exactness by pytest) ------------

def q_fit_columns(spark, sf):
    d = _derive(spark, sf)
    res = fit.fit_columns(fit.fit_rows(d.pairs, "soft", weighted=False), d.prepared.width_a, d.prepared.width_b)
    return spark.createDataFrame(res.path_table, "side string, pos int, alpha double, kind string, df bigint, "
                                                 "sum_logp double, bic double, in_path boolean, converged boolean, chosen boolean")


FIT_KKT_ALPHA = 0.01
KKT_BOUND = 1.001e-5  # the solver's bound, and rounding of one more pass


def q_fit_kkt(spark, sf):
    """Fit every column at one strength and measure the optimality conditions in another pass."""
    d = _derive(spark, sf)
    La, Lb = d.prepared.width_a, d.prepared.width_b
    rows = fit.fit_rows(d.pairs, "soft", weighted=False)
    res = fit.fit_columns(rows, La, Lb, alphas={"A": dict.fromkeys(range(La), FIT_KKT_ALPHA), "B": dict.fromkeys(range(Lb), FIT_KKT_ALPHA)})
    kkt = fit.kkt_residual(rows, res.sides, res.stats, La, Lb)
    return spark.createDataFrame(
        [(s, int(p), int(c), int(kkt[s][m] <= KKT_BOUND), int(sm.converged[m])) for s, sm in res.sides.items()
         for m, (p, c) in enumerate(zip(sm.tpos, sm.tcls))], "side string, pos int, cls int, optimal int, converged int")


def _em(spark, sf, **kw):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        opts = EMOptions(**kw)
    d = _derive(spark, sf)
    return d, opts, em.run_em(d.prepared, opts)


def _with_converged(r):
    return r.trace.withColumn("converged", F.lit(r.converged))


def q_em_soft(spark, sf):
    return _with_converged(_em(spark, sf, mode="soft", init="warm")[2])


def q_em_hard(spark, sf):
    return _with_converged(_em(spark, sf, mode="hard", init="random")[2])


def q_em_multistart(spark, sf):
    """Five random starts in shared passes."""
    d = _derive(spark, sf)
    runs = em.em_multistart(d.prepared, EMOptions(mode="soft", init="random", n_starts=5))
    ended = spark.createDataFrame([(r.start, r.converged) for r in runs], "start int, converged boolean")
    return runs[0].all_starts.trace.join(F.broadcast(ended), "start")


def q_predict_contacts(spark, sf):
    d, opts, r = _em(spark, sf, mode="soft", init="warm")
    cmap, _ = em.predict_contacts(d.prepared, r.final_state, opts)
    return cmap.select("pos_a", "pos_b", _r("strength"), _r("apc"), "name")


QUERIES = {
    "gap_profile": q_gap_profile,
    "column_cardinality": q_column_cardinality,
    "kept_positions": q_kept_positions,
    "encode_residues": q_encode_residues,
    "one_hot_features": q_one_hot_features,
    "check_pairs": q_check_pairs,
    "unknown_residues": q_unknown_residues,
    "on_unknown": q_on_unknown,
    "align_contact_map": q_align_contact_map,
    "check_contact_map": q_check_contact_map,
    "true_labels": q_true_labels,
    "posterior": q_posterior,
    "harden": q_harden,
    "convergence": q_convergence,
    "select_interacting": q_select_interacting,
    "select_noninteracting": q_select_noninteracting,
    "select_for_contacts": q_select_for_contacts,
    "random_labels": q_random_labels,
    "null_pwm_soft": q_null_pwm_soft,
    "null_pwm_hard": q_null_pwm_hard,
    "null_score": q_null_score,
    "null_llh": q_null_llh,
    "degrees_of_freedom": q_degrees_of_freedom,
    "bic": q_bic,
    "dfmax_path": q_dfmax_path,
    "select_by_bic": q_select_by_bic,
    "alt_score": q_alt_score,
    "alt_llh": q_alt_llh,
    "fit_first_step": q_fit_first_step,
    "couplings": q_couplings,
    "apc": q_apc,
    "top_contacts": q_top_contacts,
    "contact_metrics": q_contact_metrics,
    "contact_mcc": q_contact_mcc,
    "binarize_contacts": q_binarize_contacts,
    "residue_llh": q_residue_llh,
    "weighted_llh": q_weighted_llh,
    "llh_per_iter": q_llh_per_iter,
    "llh_monotonic": q_llh_monotonic,
    "confusion": q_confusion,
    "label_report": q_label_report,
    "performance_per_iter": q_performance_per_iter,
    "label_evolution": q_label_evolution,
    "llh_evolution": q_llh_evolution,
    "alt_vs_null": q_alt_vs_null,
    "fit_columns": q_fit_columns,
    "fit_kkt": q_fit_kkt,
    "em_soft": q_em_soft,
    "em_hard": q_em_hard,
    "em_multistart": q_em_multistart,
    "predict_contacts": q_predict_contacts,
}

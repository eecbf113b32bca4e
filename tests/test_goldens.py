"""Known values of models, contacts and evaluation tables on tiny inputs."""

import math

import pytest
from pyspark.sql import functions as F

from copair.functions.alphabet import PC_ALT
from copair.operators import alt_model, contacts, evaluate, fit, labels, null_model, prep
from copair.plans import em
from copair.streaming.score import score_pairs

ALPH = "ARNDCEQGHILKMFPSTWYV-"


def pairs_of(spark, rows):
    letters = [(i, "".join(ALPH[c] for c in a), "".join(ALPH[c] for c in b)) for i, (a, b) in enumerate(rows)]
    return prep.encode_pairs(spark.createDataFrame(letters, "pair_id long, seq_a string, seq_b string"))


def test_fitted_probability_and_unseen_class(spark):
    pairs = pairs_of(spark, [((3,), (11,)), ((11,), (3,))] * 3)
    res = fit.fit_columns(fit.fit_rows(pairs, "soft", weighted=False), 1, 1, alphas={"A": {0: 0.1}, "B": {0: 0.1}})
    scored = alt_model.score_alt(pairs, res.sides, 1, 1, per_residue=True).collect()
    # the optimum of the convex objective
    assert all(math.exp(r.alt_a[0]) == pytest.approx(0.799237, abs=1e-5) for r in scored)
    new = alt_model.score_alt(pairs_of(spark, [((19,), (20,))]), res.sides, 1, 1, per_residue=True).first()
    assert new.alt_a[0] == pytest.approx(PC_ALT) and new.alt_b[0] == pytest.approx(PC_ALT)


def test_null_scores_per_residue(spark):
    pairs = pairs_of(spark, [((1, 2, 3), (0,)), ((1, 3, 3), (0,)), ((3, 2, 5), (0,))])
    weights = spark.createDataFrame([(0, 0.9), (1, 0.9), (2, 0.1)], "pair_id long, z double")
    state = pairs.join(weights, "pair_id")
    pwm = null_model.fit_null(state)
    got = {(r.pair_id, r.pos): r.logp for r in null_model.score_null_long(pairs, pwm).where("side = 'A'").collect()}
    one, nine = math.log(0.2 / 1.1), math.log(0.9 / 1.1)
    assert [got[(0, p)] for p in range(3)] == pytest.approx([one, math.log(1.0 / 1.1), one])
    assert [got[(2, p)] for p in range(3)] == pytest.approx([nine, math.log(1.0 / 1.1), nine])
    assert got[(1, 1)] == pytest.approx(math.log(0.1 / 1.1))
    other = pairs_of(spark, [((20, 2, 3), (0,))])
    assert null_model.score_null_long(other, pwm).where("side = 'A' AND pos = 0").first().logp == pytest.approx(math.log(1 / 2100))


@pytest.mark.parametrize("z", [[1.0, 0.0], [0.9, 1e-3], [0.99, 1e-6]])
def test_weighted_llh(spark, z):
    alt, null = [math.log(0.9), math.log(1e-3)], [math.log(1e-2), math.log(0.8)]
    trace = spark.createDataFrame([(0, i, z[i], alt[i], null[i]) for i in range(2)],
                                  "iter int, pair_id long, z double, alt_llh double, null_llh double")
    for r in em.weighted_llh(trace).collect():
        assert r.alt_int == pytest.approx(z[r.pair_id] * alt[r.pair_id])
        assert r.null_nonint == pytest.approx((1 - z[r.pair_id]) * null[r.pair_id])
    total = sum(z[i] * alt[i] + (1 - z[i]) * null[i] for i in range(2))
    assert em.llh_per_iter(trace).first().total == pytest.approx(total)


@pytest.mark.parametrize("mode, now, before, converged", [
    ("hard", [1, 1, 0], [1, 1, 0], True), ("hard", [1, 1, 0], [1, 0, 0], False), ("hard", [0, 0, 0], [0, 0, 0], True),
    ("hard", [1, 0, 1], [0, 1, 0], False), ("soft", [0.99, 0.99, 0.1, 0.1, 0.005], [0.99, 0.99, 0.1, 0.1, 0.01], True),
    ("soft", [0.5, 0.5], [0.5, 0.5], True), ("soft", [0.5, 0.52], [0.5, 0.5], False), ("soft", [0.5, 0.5099], [0.5, 0.5], True),
    ("soft", [0.4, 0.6], [0.6, 0.4], False), ("soft", [0.51, 0.49], [0.5, 0.5], False)])
def test_convergence(spark, mode, now, before, converged):
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(now, before)], "z double, z_prev double")
    assert labels.has_converged(df, mode=mode, tol=0.005) is converged


def test_couplings_and_correction(spark):
    coefs = spark.createDataFrame([("A", 0, 1.0, 1, 1, 2, 3.0), ("A", 0, 1.0, 2, 1, 4, 0.0), ("B", 1, 1.0, 5, 0, 0, -4.0), ("B", 0, 1.0, 5, 1, 0, 2.0)],
                                  "side string, pos int, alpha double, cls int, feat_pos int, feat_aa int, value double")
    cmap = contacts.apc(contacts.couplings(coefs, 2, 2))
    got = {(r.pos_a, r.pos_b): (r.strength, r.name, r.apc) for r in cmap.collect()}
    assert got[(0, 1)][:2] == (5.0, "A0:B1") and got[(1, 0)][0] == 2.0 and got[(0, 0)][0] == got[(1, 1)][0] == 0
    # row means 2.5 and 1, column means 1 and 2.5, mean 1.75
    assert got[(0, 1)][2] == pytest.approx(5 - 2.5 * 2.5 / 1.75) and got[(0, 0)][2] == pytest.approx(-2.5 / 1.75)
    flat = contacts.apc(contacts.couplings(coefs.limit(0), 2, 2)).collect()
    assert all(r.strength == 0 and r.apc is None for r in flat)
    plan = cmap._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    # sets are corrected apart, also a set named by nulls
    two = contacts.apc(grid(spark, [[1, 3], [2, 2]]).withColumn("start", F.lit(1)).unionByName(
        grid(spark, [[5, 1], [1, 1]]).withColumn("start", F.lit(None).cast("int"))), keys=("start",))
    by_set = {(r.start, r.pos_a, r.pos_b): r.apc for r in two.collect()}
    assert len(by_set) == 8 and by_set[(1, 0, 1)] == pytest.approx(3 - 2 * 2.5 / 2) and by_set[(None, 0, 0)] == pytest.approx(5 - 3 * 3 / 2)


def grid(spark, values, name="strength"):
    return spark.createDataFrame([(i, j, float(v)) for i, row in enumerate(values) for j, v in enumerate(row)], f"pos_a int, pos_b int, {name} double")


def test_ranks_ties_and_metrics(spark):
    cmap = grid(spark, [[1, 3], [3, -1]])
    truth = spark.createDataFrame([(0, 0, 0), (0, 1, 1), (1, 0, 0), (1, 1, 1)], "pos_a int, pos_b int, is_contact int")
    assert [(r.pos_a, r.pos_b) for r in contacts.top_contacts(cmap, 3, "strength").collect()] == [(0, 1), (1, 0), (0, 0)]
    m = contacts.contact_metrics(cmap, truth, 4, "strength").orderBy("rank").collect()
    assert [(r.tp, r.tpr, r.ppv) for r in m] == [(1, 1.0, 1.0), (1, 0.5, 0.5), (1, 0.5, 1 / 3), (2, 1.0, 0.5)]
    mcc = contacts.contact_mcc(cmap, truth).first()
    assert (mcc.tp, mcc.tn, mcc.fp, mcc.fn) == (1, 0, 2, 1) and mcc.mcc == pytest.approx(-2 / math.sqrt(3 * 2 * 2 * 1))
    assert contacts.contact_mcc(grid(spark, [[1, 1], [1, 1]]), truth).first().mcc == 0.0
    with pytest.raises(ValueError):
        contacts.top_contacts(cmap, 0)


def test_label_tables(spark):
    trace = spark.createDataFrame([(0, 1, 1.0, -1.0, -2.0), (0, 2, 0.0, -3.0, -4.0), (0, 3, 0.2, -5.0, -6.0),
                                   (1, 1, 0.9, -1.5, -2.5), (1, 2, 0.6, -3.5, -4.5), (1, 3, 0.1, -5.5, -6.5)],
                                  "iter int, pair_id long, z double, alt_llh double, null_llh double")
    truth = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "pair_id long, y int")
    by_iter = {r.iter: r for r in evaluate.performance_per_iter(trace, truth).collect()}
    assert by_iter[0].mcc == 1.0 and by_iter[0].log_loss == pytest.approx(-math.log(0.8) / 3, abs=1e-9)  # clipped at 1e-15
    assert (by_iter[1].tp, by_iter[1].tn, by_iter[1].fp, by_iter[1].fn) == (1, 1, 1, 0) and by_iter[1].mcc == pytest.approx(0.5)
    one_class = evaluate.label_report(trace.where("iter = 0"), truth.withColumn("y", F.lit(1))).first()
    assert one_class.mcc is None and one_class.log_loss is None
    c = {(r.y, r.y_hat): (r.n, r.share) for r in evaluate.confusion(trace.where("iter = 1"), truth).collect()}
    assert c == {(0, 0): (1, 0.5), (0, 1): (1, 0.5), (1, 0): (0, 0.0), (1, 1): (1, 1.0)}
    e = {r.pair_id: (r["0"], r["1"], r.null_llh) for r in evaluate.llh_evolution(trace).collect()}
    assert e == {1: (-1.0, -1.5, -2.0), 2: (-3.0, -3.5, -4.0), 3: (-5.0, -5.5, -6.0)}
    assert {r.pair_id: r["1"] for r in evaluate.label_evolution(trace, [0, 1]).collect()} == {1: 0.9, 2: 0.6, 3: 0.1}
    assert em.llh_monotonic(em.llh_per_iter(trace)).first().monotonic is False


def test_stream_of_pairs_is_scored(spark, tmp_path):
    pairs = pairs_of(spark, [((i % 3, 3), (i % 3, 5 + i % 2)) for i in range(30)])
    res = fit.fit_columns(fit.fit_rows(pairs, "soft", weighted=False), 2, 2, alphas={s: {0: 0.05, 1: 0.05} for s in "AB"})
    pwm = null_model.pwm_arrays(null_model.fit_null(pairs.withColumn("z", F.lit(0.0))), 2, 2)
    batch = score_pairs(pairs, res.sides, pwm, 2, 2)
    pairs.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(pairs.schema).parquet(f"{tmp_path}/in")
    query = (score_pairs(stream, res.sides, pwm, 2, 2).writeStream.format("parquet").option("path", f"{tmp_path}/out")
             .option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start())
    query.awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.count() == 30 and got.exceptAll(batch).count() == 0

"""Sums of a Newton pass and scores: same values as their plain forms, in bounded memory."""

import tracemalloc

import numpy as np

from copair.operators import kernels as K
from copair.operators import fit
from copair.operators.fit import Trial

N = 2 * K.ROW_CHUNK_CELLS // 100  # several chunks


def _block(rng, models=24, width=6):
    cols = np.array([p * 21 + a for p in range(width) for a in range(4)])
    trials = []
    for m in range(models):
        feats = np.sort(rng.choice(cols, m % 9, replace=False))
        coefs = rng.normal(size=len(feats)) * (40 if m == 5 else 1)  # one model's margins are beyond rounding of 1 - p
        trials.append(Trial(feats, coefs, 0.1 * m, feats, coefs, 0.0, 0.0, cols, True))
    return {"trials": trials, "cols": cols, "tpos": np.arange(models) % 3, "tcls": np.arange(models) % 4}


def _plain(o, t, w, part):
    loss, gb, g, h = [], [], [], []
    x = K.one_hot_at(o, part["cols"])
    for k, trial in enumerate(part["trials"]):
        at = np.searchsorted(part["cols"], trial.feats)
        s = x[:, at] @ trial.coefs + trial.b
        y = t[:, part["tpos"][k]] == part["tcls"][k]
        p = K.sigmoid(s)
        xa = np.hstack([x[:, at], np.ones((len(o), 1))])
        loss.append((w * (np.logaddexp(0.0, s) - y * s)).sum())
        gb.append((w * (p - y)).sum())
        g.append(x.T @ (w * (p - y)))
        h.append((xa.T @ ((w * p * (1 - p))[:, None] * xa)).ravel())
    return np.concatenate([loss, gb, *g, *h])


def test_newton_sums_equal_the_plain_sums_and_stay_in_the_cache():
    rng = np.random.default_rng(0)
    o, t = rng.integers(-1, 5, (N, 6)), rng.integers(0, 5, (N, 3))
    w = np.where(rng.random(N) < 0.2, 0.0, rng.random(N)) / N
    part = _block(rng)
    want = _plain(o, t, w, part)
    assert np.abs(K.newton_sums(o, t, w, part) - want).max() < 1e-12
    assert np.abs(K.newton_sums(o, t, w, part, hessian=False) - want[:24 * (2 + 24)]).max() < 1e-12
    tracemalloc.start()
    K.newton_sums(o, t, w, part)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 << 20  # a matrix of all rows alone has 3.8 MB; whole batches took many of them


def test_models_at_one_point_share_their_sums(monkeypatch):
    rng = np.random.default_rng(3)
    part = _block(rng, models=12)
    four = {k: v if k == "cols" else [x for x in v for _ in range(4)] if k == "trials" else np.repeat(v, 4) for k, v in part.items()}
    o, t, w = rng.integers(0, 4, (300, 6)), rng.integers(0, 4, (300, 3)), np.full(300, 1 / 300)
    asked = []
    plain = K.CoefTable.by_model
    monkeypatch.setattr(K.CoefTable, "by_model", lambda self, r: asked.append(self.n_models) or plain(self, r))
    assert np.abs(K.newton_sums(o, t, w, four) - _plain(o, t, w, four)).max() < 1e-12
    assert asked == [12]  # 48 models, 12 points


def test_newton_sums_without_rows_or_features():
    rng = np.random.default_rng(1)
    part = _block(rng)
    assert not K.newton_sums(np.empty((0, 6), int), np.empty((0, 3), int), np.empty(0), part).any()
    empty = np.empty(0, np.int64)
    bare = {"trials": [Trial(empty, np.empty(0), 0.0, empty, np.empty(0), 0.0, 0.0, empty, True)], "cols": empty,
            "tpos": np.array([0]), "tcls": np.array([1])}
    got = K.newton_sums(np.zeros((3, 0), int), np.array([[1], [0], [1]]), np.full(3, 1 / 3), bare)
    assert np.allclose(got, [np.log(2), 0.5 - 2 / 3, 0.25])


def test_group_scores_equal_the_plain_ones_and_stay_in_the_cache():
    rng = np.random.default_rng(2)
    o, t = rng.integers(0, 4, (N, 6)), rng.integers(0, 5, (N, 3))
    feats = [np.sort(rng.choice(24, 5, replace=False)) // 4 * 21 + rng.integers(0, 4, 5) for _ in range(5)]
    feats = [np.unique(f) for f in feats]
    model = {"feats": feats, "coefs": [rng.normal(size=len(f)) for f in feats], "b": rng.normal(size=5)}
    cls_map = np.full((3, 21), -1)
    cls_map[0, :4] = np.arange(4)  # four classes, the fifth is none of the model's
    groups = {"kind": np.array([0, 1, 2]), "gpos": np.array([0, 1, 2]), "first": np.array([0, 4, 0]), "count": np.array([4, 1, 0]),
              "n_ovr_models": 4, "cls_map": cls_map, "pos_cls": np.array([-1, 1, -1]), "neg_cls": np.array([-1, 0, -1]),
              "const_cls": np.array([-1, -1, 2])}
    p = K.sigmoid(np.stack([K.one_hot_at(o, f) @ c + b for f, c, b in zip(feats, model["coefs"], model["b"])], axis=1))
    want = np.full((N, 3), K.PC_ALT)
    some = t[:, 0] < 4
    want[some, 0] = np.log(p[some, t[some, 0]]) - np.log(p[some, :4].sum(axis=1))
    want[t[:, 1] == 1, 1] = np.log(p[t[:, 1] == 1, 4])
    want[t[:, 1] == 0, 1] = np.log(1 - p[t[:, 1] == 0, 4])
    want[t[:, 2] == 2, 2] = np.log(K.CONSTANT_PROB)
    tracemalloc.start()
    got = K.group_logprobs(t, o, model, groups)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(got, want)
    assert peak < got.nbytes + (2 << 20)


def test_packed_rows_come_back(spark, monkeypatch):
    monkeypatch.setattr(fit, "PACK_BYTES", 100)  # some rows a block
    rows = spark.range(0, 50, 1, 1).selectExpr("array(cast(id % 5 as tinyint), cast(-1 as tinyint)) as a", "array(cast(id % 3 as tinyint)) as b",
                                               "array(cast(id as double), 0.5D) as w")
    packed = fit._packed(rows, 2, 1)
    back = [x for batch in [packed.toArrow()] for x in fit._batches(batch.to_batches(), 2, 1)]
    assert len(back) > 5
    assert np.concatenate([w for _, w in back]).tolist() == [[i, 0.5] for i in range(50)]
    assert np.concatenate([c["A"][0] for c, _ in back]).tolist() == [[i % 5, -1] for i in range(50)]
    assert np.concatenate([c["B"][0] for c, _ in back]).tolist() == [[i % 3] for i in range(50)]

"""NumPy kernels run inside Spark tasks (``mapInArrow``) on Arrow batches.

They only see one partition's rows plus model-sized arrays shipped by
broadcast; they never hold more than a row chunk of margins at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from copair.functions.alphabet import CONSTANT_PROB, N_CODES, PC_ALT

ROW_CHUNK_CELLS = 1_000_000  # rows x models per chunk (8 MB of doubles)
SUM_ROWS = 1024  # rows per chunk of the sums of a Newton pass, so that its matrices stay in the cache
FEW_FEATURES = 64  # used features up to which a dense product is cheaper than gathering


def codes_matrix(col: pa.Array, width: int) -> np.ndarray:
    """list<int8> Arrow column -> (n, width) int64 matrix."""
    n = len(col)
    if width == 0:
        return np.zeros((n, 0), dtype=np.int64)
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.int64, copy=False).reshape(n, width)


def sigmoid(s: np.ndarray) -> np.ndarray:
    """Logistic function without overflow (exp of non-positive values only);
    keeps tiny probabilities (used for scoring)."""
    e = np.abs(s)
    np.negative(e, out=e)
    np.exp(e, out=e)
    inv = e + 1.0
    np.reciprocal(inv, out=inv)
    e *= inv
    return np.where(s >= 0, inv, e)


def row_chunks(n: int, m: int, most: int | None = None):
    step = max(1, ROW_CHUNK_CELLS // max(m, 1))
    step = min(step, most) if most else step
    for lo in range(0, n, step):
        yield lo, min(n, lo + step)


class CoefTable:
    """Coefficients by (feature position, residue): the models a residue speaks to, and its values there.

    A row then adds the entries of its own L residues; a product with its 21 L wide one-hot
    form would multiply mostly zeros.  Where most models have most of the used features, the
    dense product over these is the cheaper form of the same sums; over few features it always is.
    """

    def __init__(self, feats: list[np.ndarray], coefs: list[np.ndarray]):
        self.n_models = len(feats)
        feat = (np.concatenate(feats) if feats else np.empty(0)).astype(np.int64)
        model = np.repeat(np.arange(len(feats)), [len(f) for f in feats])
        value = np.concatenate(coefs) if coefs else np.empty(0)
        order = np.argsort(feat, kind="stable")
        self.feat, first = np.unique(feat[order], return_index=True)
        self.models = np.split(model[order], first[1:]) if len(feat) else []
        self.values = np.split(value[order], first[1:]) if len(feat) else []
        self.dense = None
        if len(self.feat) <= FEW_FEATURES or len(feat) > 0.15 * len(self.feat) * self.n_models:
            self.dense = np.zeros((len(self.feat), self.n_models))
            for i, (m, v) in enumerate(zip(self.models, self.values)):
                np.add.at(self.dense[i], m, v)

    def margins(self, codes: np.ndarray) -> np.ndarray:
        """(rows, models) sums of the coefficients of each row's residues."""
        return self.by_model(codes.T).T

    def by_model(self, residues: np.ndarray) -> np.ndarray:
        """``margins`` of transposed codes (positions, rows): (models, rows)."""
        if self.dense is not None:
            return self.dense.T @ one_hot_rows(residues, self.feat)
        out = np.zeros((self.n_models, residues.shape[1]))
        for f, m, v in zip(self.feat, self.models, self.values):
            rows = np.flatnonzero(residues[f // N_CODES] == f % N_CODES)
            if len(rows):
                out[m[:, None], rows] += v[:, None]
        return out


def one_hot_rows(residues: np.ndarray, feats: np.ndarray) -> np.ndarray:
    """(feats, rows) 0/1 doubles of transposed codes (positions, rows): the one-hot rows ``feats`` alone."""
    return (residues[feats // N_CODES] == (feats % N_CODES).astype(residues.dtype)[:, None]).astype(np.float64)


def one_hot_at(codes: np.ndarray, feats: np.ndarray) -> np.ndarray:
    """(rows, feats) 0/1 doubles: the one-hot columns ``feats`` alone."""
    return one_hot_rows(codes.T, feats).T


def newton_sums(o_codes: np.ndarray, t_codes: np.ndarray, w: np.ndarray, part: dict, hessian: bool = True) -> np.ndarray:
    """Sums over rows for a block of models, one after the other in one vector: weighted
    log-loss and gradient of the intercept per model, gradient at the block's columns
    (models x columns) and, with ``hessian``, each model's Hessian of (working features, intercept).

    A chunk's matrices are models or features by rows and small enough to stay in the cache, so
    that a model's features are whole rows and every product reads memory in order.  Models at
    the same point (the strengths of a round start where the last one ended) share their sums."""
    cols = part["cols"]
    if "table" not in part:  # kept beside the broadcast block in this worker
        points: dict = {}
        same = [points.setdefault((p, c, t.b, t.feats.tobytes(), t.coefs.tobytes()), len(points))
                for p, c, t in zip(part["tpos"].tolist(), part["tcls"].tolist(), part["trials"])]
        part["same"], part["first"] = np.array(same, dtype=np.int64), np.unique(same, return_index=True)[1]
        own = [part["trials"][k] for k in part["first"]]
        part["table"] = CoefTable([t.feats for t in own], [t.coefs for t in own])
    same, first = part["same"], part["first"]
    trials = [part["trials"][k] for k in first]
    n_models = len(trials)
    # a model's rows of the one-hot matrix; the row after its last is the intercept's
    place = [np.append(np.searchsorted(cols, t.feats), len(cols)) for t in trials]
    loss, gb, g = np.zeros(n_models), np.zeros(n_models), np.zeros((n_models, len(cols)))
    h = [np.zeros((len(p), len(p))) for p in place] if hessian else []
    b = np.array([t.b for t in trials])[:, None]
    tpos, tcls, x = part["tpos"][first], part["tcls"][first].astype(np.int8)[:, None], None
    fpos, faa = cols // N_CODES, (cols % N_CODES).astype(np.int8)[:, None]
    for lo, hi in row_chunks(len(w), max(len(cols), n_models), SUM_ROWS):
        ws = w[lo:hi]
        residues = np.ascontiguousarray(o_codes[lo:hi].T, dtype=np.int8)
        if x is None or x.shape[1] != hi - lo:  # the last chunk is shorter
            x = np.ones((len(cols) + 1, hi - lo))
            mine, scaled = (np.empty((max((len(p) for p in place), default=0), hi - lo)) for _ in range(2))
        x[:-1] = residues[fpos] == faa
        s = part["table"].by_model(residues)
        s += b
        y = np.ascontiguousarray(t_codes[lo:hi].T, dtype=np.int8)[tpos] == tcls
        e = np.abs(s)
        np.negative(e, out=e)
        np.exp(e, out=e)
        inv = e + 1.0
        each = np.log(inv)  # log(1 + exp(s)) - y s
        each += np.maximum(s, 0.0)
        each -= s * y
        loss += each @ ws
        np.reciprocal(inv, out=inv)
        e *= inv  # the smaller of p and 1 - p, inv is the larger
        r = inv - 0.5  # p - y with p = 0.5 + the distance on the side of s
        np.copysign(r, s, out=r)
        r += 0.5
        r -= y
        r *= ws
        gb += r.sum(axis=1)
        g += r @ x[:-1].T
        if hessian:
            e *= inv
            e *= ws
            for i, p in enumerate(place):
                xa = np.take(x, p, axis=0, out=mine[:len(p)], mode="clip")
                h[i] += np.multiply(xa, e[i], out=scaled[:len(p)]) @ xa.T
    return np.concatenate([loss[same], gb[same], g[same].ravel(), *([h[k].ravel() for k in same] if hessian else [])])


def _group_logprobs(S, t_residues, groups):
    """Log-probability of the observed class of every (group, row), from margins
    (models, rows) and transposed codes (positions, rows).

    groups: dict with arrays
      kind (G,) 0=ovr 1=binary 2=constant, gpos (G,), cls_map (G, 21)
      -> model index of each class code or -1 (not a class of the model),
      first (G,) / count (G,) contiguous model ranges of ovr groups,
      pos_cls (G,) for binary: positive class, neg_cls (G,) negative class,
      const_cls (G,) for constant groups.
    """
    n = S.shape[1]
    kind, gpos = groups["kind"], groups["gpos"]
    G = len(kind)
    out = np.full((G, n), PC_ALT)
    if G == 0 or n == 0:
        return out
    obs = t_residues[gpos]  # (G, n)
    P = sigmoid(S)
    # one-vs-rest: sigmoid normalised over the classes of the group
    ovr = np.where(kind == 0)[0]
    if len(ovr):
        # ovr models come first, contiguous per group, groups in order:
        # reduceat over that block gives every group's denominator
        starts = groups["first"][ovr]
        denom = np.add.reduceat(P[: groups["n_ovr_models"]], starts, axis=0)
        midx = groups["cls_map"][ovr[:, None], obs[ovr]]  # (|ovr|, n)
        seen = midx >= 0
        pm = np.where(seen, P[np.where(seen, midx, 0), np.arange(n)], 0.0)
        with np.errstate(divide="ignore", invalid="ignore"):
            lp = np.log(pm) - np.log(denom)
        ok = seen & (pm > 0)
        out[ovr] = np.where(ok, lp, PC_ALT)
    binr = np.where(kind == 1)[0]
    if len(binr):
        p1 = P[groups["first"][binr]]
        o = obs[binr]
        p = np.where(o == groups["pos_cls"][binr][:, None], p1,
                     np.where(o == groups["neg_cls"][binr][:, None], 1.0 - p1, 0.0))
        with np.errstate(divide="ignore"):
            lp = np.log(p)
        out[binr] = np.where(p > 0, lp, PC_ALT)
    const = np.where(kind == 2)[0]
    if len(const):
        o = obs[const]
        out[const] = np.where(o == groups["const_cls"][const][:, None], np.log(CONSTANT_PROB), PC_ALT)
    return out


def group_logprobs(t_codes, o_codes, model, groups):
    """(n, G) observed-class log-probabilities for one side, chunked by rows."""
    n, m = t_codes.shape[0], len(model["b"])
    out = np.empty((n, len(groups["kind"])))
    if "table" not in model:
        model["table"] = CoefTable(model["feats"], model["coefs"])
    for lo, hi in row_chunks(n, max(m, len(model["table"].feat), 1), SUM_ROWS):
        s = model["table"].by_model(np.ascontiguousarray(o_codes[lo:hi].T, dtype=np.int8)) + np.asarray(model["b"])[:, None]
        out[lo:hi] = _group_logprobs(s, np.ascontiguousarray(t_codes[lo:hi].T), groups).T
    return out

"""Model-sized description of fitted columns, with sparse coefficients."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from copair.functions.alphabet import N_CODES

KIND_NAMES = ["ovr", "binary", "constant"]
OVR, BINARY, CONSTANT = 0, 1, 2

#: Broadcasts of model blocks are checked against this bound.
MAX_MODEL_BYTES = 512 << 20


@dataclass
class SideModels:
    """All models of one target side.

    A *group* is one (column, alpha); it has a model per class (one-vs-rest), one
    model (two classes) or none (constant).  Model ``m`` has the features
    ``feats[m]`` (``feat_pos * 21 + aa``) with values ``coefs[m]`` and intercept
    ``b[m]``; zero coefficients are not stored."""

    side: str
    width_t: int
    width_o: int
    gpos: np.ndarray
    galpha: np.ndarray
    kind: np.ndarray
    classes: list[np.ndarray]
    first: np.ndarray  # first model of a group
    count: np.ndarray
    cls_map: np.ndarray  # (groups, 21) model of a class code, or -1
    pos_cls: np.ndarray
    neg_cls: np.ndarray
    const_cls: np.ndarray
    n_ovr_models: int
    tpos: np.ndarray
    tcls: np.ndarray
    malpha: np.ndarray
    mgroup: np.ndarray
    b: np.ndarray
    feats: list[np.ndarray] = field(default_factory=list)
    coefs: list[np.ndarray] = field(default_factory=list)
    converged: np.ndarray = None
    n_passes: int = 0

    def __post_init__(self):
        if not self.feats:
            self.feats = [np.empty(0, np.int64) for _ in self.tpos]
            self.coefs = [np.empty(0) for _ in self.tpos]
        if self.converged is None:
            self.converged = np.zeros(self.n_models, dtype=bool)

    @property
    def n_models(self) -> int:
        return len(self.tpos)

    @property
    def n_features(self) -> int:
        return self.width_o * N_CODES

    @property
    def nbytes(self) -> int:
        return 16 * sum(map(len, self.feats)) + 32 * self.n_models

    def dense(self, idx=None) -> np.ndarray:
        """(models, features) block; callers choose a bounded ``idx``."""
        idx = range(self.n_models) if idx is None else idx
        out = np.zeros((len(idx), self.n_features))
        for i, m in enumerate(idx):
            out[i, self.feats[m]] = self.coefs[m]
        return out

    def set(self, m: int, feats: np.ndarray, coefs: np.ndarray, b: float) -> None:
        used = coefs != 0
        self.feats[m], self.coefs[m], self.b[m] = feats[used], coefs[used], b

    def add(self, m: int, feat: int, value: float) -> None:
        at = np.flatnonzero(self.feats[m] == feat)
        if len(at):
            self.coefs[m][at[0]] += value
        else:
            self.feats[m] = np.append(self.feats[m], feat)
            self.coefs[m] = np.append(self.coefs[m], value)

    def groups_dict(self) -> dict:
        return {
            "kind": self.kind, "gpos": self.gpos, "cls_map": self.cls_map, "first": self.first,
            "pos_cls": self.pos_cls, "neg_cls": self.neg_cls, "const_cls": self.const_cls,
            "n_ovr_models": self.n_ovr_models,
        }

    def model_dict(self, idx=None) -> dict:
        """What a data pass needs of the models ``idx``."""
        idx = np.arange(self.n_models) if idx is None else np.asarray(idx, dtype=np.int64)
        return {"feats": [self.feats[m] for m in idx], "coefs": [self.coefs[m] for m in idx], "b": self.b[idx],
                "tpos": self.tpos[idx], "tcls": self.tcls[idx], "n_features": self.n_features}

    def models_of(self, g: int) -> range:
        return range(self.first[g], self.first[g] + self.count[g]) if self.kind[g] != CONSTANT else range(0)

    def group_df(self) -> np.ndarray:
        """Per group: distinct features with a non-zero coefficient in any class."""
        out = np.zeros(len(self.kind), dtype=np.int64)
        for g in range(len(self.kind)):
            used = [self.feats[m][self.coefs[m] != 0] for m in self.models_of(g)]
            out[g] = len(np.unique(np.concatenate(used))) if used else 0
        return out

    def group_converged(self) -> np.ndarray:
        return np.array([all(self.converged[m] for m in self.models_of(g)) for g in range(len(self.kind))], dtype=bool)

    def subset_groups(self, keep) -> "SideModels":
        """The listed groups as models of their own."""
        keep = [int(g) for g in keep]
        sub = layout(self.side, self.width_t, self.width_o,
                     [(int(self.gpos[g]), float(self.galpha[g]), self.classes[g], int(self.kind[g])) for g in keep])
        place = {(int(p), float(a)): g for g, (p, a) in enumerate(zip(sub.gpos, sub.galpha))}
        for g in keep:
            to = place[(int(self.gpos[g]), float(self.galpha[g]))]
            for m, n in zip(self.models_of(g), sub.models_of(to)):
                sub.feats[n], sub.coefs[n], sub.b[n] = self.feats[m], self.coefs[m], self.b[m]
                sub.converged[n] = self.converged[m]
        sub.n_passes = self.n_passes
        return sub


def layout(side: str, width_t: int, width_o: int, spec: list[tuple]) -> SideModels:
    """Lay out groups ``(pos, alpha, classes[, kind])``: one-vs-rest groups first (their
    models contiguous), then binary, then constant ones."""
    kinds = [t[3] if len(t) > 3 else (OVR if len(t[2]) >= 3 else BINARY if len(t[2]) == 2 else CONSTANT) for t in spec]
    order = sorted(range(len(spec)), key=lambda i: (kinds[i], spec[i][0], -spec[i][1]))
    n = len(spec)
    gpos, galpha, kind = np.zeros(n, np.int64), np.zeros(n), np.zeros(n, np.int64)
    first, count = np.full(n, -1, np.int64), np.zeros(n, np.int64)
    cls_map = np.full((n, N_CODES), -1, np.int64)
    pos_cls, neg_cls, const_cls = (np.full(n, -1, np.int64) for _ in range(3))
    classes, models = [], []
    for g, i in enumerate(order):
        p, a, cl = spec[i][:3]
        cl = np.array(sorted(int(c) for c in cl), dtype=np.int64)
        classes.append(cl)
        gpos[g], galpha[g], kind[g] = p, a, kinds[i]
        if kinds[i] == CONSTANT:
            const_cls[g] = cl[0] if len(cl) else -1
            continue
        own = cl if kinds[i] == OVR else cl[1:]
        if kinds[i] == BINARY:
            neg_cls[g], pos_cls[g] = cl
        first[g], count[g] = len(models), len(own)
        for c in own:
            cls_map[g, c] = len(models)
            models.append((p, c, a, g))
    column = lambda k, t: np.array([m[k] for m in models], dtype=t)
    n_ovr = int(count[kind == OVR].sum())
    return SideModels(side, width_t, width_o, gpos, galpha, kind, classes, first, count, cls_map, pos_cls, neg_cls, const_cls,
                      n_ovr, column(0, np.int64), column(1, np.int64), column(2, float), column(3, np.int64),
                      np.zeros(len(models)))


def check_broadcast(sides: dict) -> None:
    nbytes = sum(sm.nbytes for sm in sides.values())
    if nbytes > MAX_MODEL_BYTES:
        raise ValueError(f"models of {nbytes} bytes exceed the broadcast bound of {MAX_MODEL_BYTES}")

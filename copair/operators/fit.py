"""Distributed fitting of the coevolution model: for every column of one
side, an elastic-net logistic regression (one-vs-rest over the column's
classes; one model for two classes) on the one-hot encoding of the other
side, optionally weighted, for one or many regularisation strengths, and for
one or many weightings of the same rows (the starts of an EM run).

Objective of one model (n = rows fitted, r = l1 ratio, intercept free):
    (1/n) sum_i w_i logloss(y_i, b + x_i.beta) + alpha (r |beta|_1 + (1-r)/2 |beta|^2)

Active-set proximal Newton, the open models of both sides and all starts together:
  1. one aggregation gives classes, class weights and closed-form intercepts;
     models with alpha*r >= 0.25*mean(w) are optimal at beta = 0 (every gradient of
     the intercept-only model is a weighted covariance of 0/1 variables) and need
     no pass;
  2. a pass broadcasts sparse coefficients; each task returns, per block of models,
     the loss, the gradient and the Hessian on the models' working features only;
  3. screening: a model's first pass has the gradient of all features; after it only
     those whose gradient is near the strength (the sequential strong rule, floored
     at half the strength) or that are in use take part.  A model that is optimal on
     them gets a pass with all features again: violators join, or it is done, so the
     rule never decides a result;
  4. block plan: blocks hold at most ``BLOCK_BYTES`` of sums and passes ``pass_bytes``,
     whatever the number of open models and features; more models mean more passes;
  5. partials are summed by (block, bucket) and then by block, so that no task sees
     all of them; the task that sums a block also makes its models' step: coordinate
     descent on the quadratic model, a halved step if the loss rose, admission of
     features that violate optimality, and the optimality (KKT) residual.  Only
     sparse coefficients and screened feature numbers return to the driver;
  6. a model leaves when its residual over all features is at most ``tol``.  One that
     rounding keeps from it (50 halvings, or ``STUCK`` passes without progress) stops
     and is marked, as is what a caller's pass limit leaves.
Strengths are solved in rounds, strongest first, warm-started; a column leaves
after its first model with df > dfmax.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copair.functions.alphabet import ALPHA_PATH, CONSTANT_ALPHA, DFMAX, GAP, L1_RATIO, N_CODES
from copair.operators import kernels as K
from copair.operators.models import KIND_NAMES, SideModels, check_broadcast, layout

#: Intercept of a class with no weight or all weight (its optimum is infinite).
INTERCEPT_CLAMP = 35.0
#: Models per block of a pass, and bytes of a block's sums (one model may exceed them alone).
BLOCK_MODELS = 32
BLOCK_BYTES = 4 << 20
#: Bytes of all sums that a task keeps in one pass.
PASS_BYTES = 64 << 20
#: Bytes of a block of packed rows.
PACK_BYTES = 1 << 20
#: Features that may enter a model's working set in one pass.
ADMIT = 60
#: Passes without progress after which a model counts as stalled.
STUCK = 12


# --------------------------------------------------------------------------
# statistics pass
# --------------------------------------------------------------------------

@dataclass
class RowStats:
    n: int
    sum_w: float
    counts: dict  # side -> (L, 21) row counts per code
    wsum: dict  # side -> (L, 21) weight sums per code


def stats_of_starts(rows: DataFrame, width_a: int, width_b: int, starts: int, members: bool) -> list[RowStats]:
    """One aggregation over ``rows(a, b, w array)``: count and weight per (side, pos, aa) and start.

    With ``members`` only rows of positive weight belong to a start; otherwise all do.
    At most 21 (La+Lb) rows reach the driver."""
    side = lambda s, c: F.struct(F.lit(s).alias("side"), F.col(c).alias("codes"))
    lv = rows.select("w", F.inline(F.array(side("A", "a"), side("B", "b")))).select(
        "w", "side", F.posexplode("codes").alias("pos", "aa"))
    one = [F.count(F.when(F.col("w")[k] > 0, 1) if members else F.lit(1)).alias(f"n{k}") for k in range(starts)]
    agg = lv.groupBy("side", "pos", "aa").agg(*one, *[F.sum(F.col("w")[k]).alias(f"s{k}") for k in range(starts)]).collect()
    widths, out = {"A": width_a, "B": width_b}, []
    some = "A" if width_a else "B"
    for k in range(starts):
        counts, wsum = ({s: np.zeros((widths[s], N_CODES)) for s in widths} for _ in range(2))
        for r in agg:
            counts[r.side][r.pos, r.aa] = r[f"n{k}"]
            wsum[r.side][r.pos, r.aa] = r[f"s{k}"] or 0.0
        n, sum_w = (int(counts[some][0].sum()), float(wsum[some][0].sum())) if widths[some] else (0, 0.0)
        out.append(RowStats(n, sum_w, counts, wsum))
    return out


def _one_start(rows: DataFrame) -> DataFrame:
    return rows.select("a", "b", F.array(F.col("w").cast("double")).alias("w"))


def row_stats(rows: DataFrame, width_a: int, width_b: int) -> RowStats:
    """``stats_of_starts`` of ``rows(a, b, w double)``."""
    return stats_of_starts(_one_start(rows), width_a, width_b, 1, members=False)[0]


def column_classes(stats: RowStats, side: str) -> list[np.ndarray]:
    return [np.flatnonzero(c > 0) for c in stats.counts[side]]


def closed_form_intercepts(sm: SideModels, stats: RowStats) -> None:
    ones = stats.wsum[sm.side][sm.tpos, sm.tcls]
    with np.errstate(divide="ignore", invalid="ignore"):
        logit = np.log(ones) - np.log(stats.sum_w - ones)
    sm.b[:] = np.clip(np.nan_to_num(logit, nan=0.0, posinf=INTERCEPT_CLAMP, neginf=-INTERCEPT_CLAMP),
                      -INTERCEPT_CLAMP, INTERCEPT_CLAMP)


# --------------------------------------------------------------------------
# distributed passes
# --------------------------------------------------------------------------

_PART = "block int, bucket int, blob binary"


def _reduced(rows: DataFrame, partial, finish, schema: str, blocks: int) -> DataFrame:
    """Sum the vectors ``partial(batches) -> {block: vector}`` of all tasks, then ``finish(block, sum)``.

    Two levels: a bucket of about sqrt(tasks) partials, then a block's buckets; up to 32 tasks
    a block's partials are few enough (``BLOCK_BYTES`` each) for one."""
    tasks = max(1, rows.rdd.getNumPartitions())
    fan = math.isqrt(tasks) if tasks > 32 else tasks

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = TaskContext.get().partitionId() % fan
        for block, vector in partial(batches).items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int32()), pa.array([bucket], pa.int32()), pa.array([vector.tobytes()], pa.binary())],
                names=["block", "bucket", "blob"])

    def total(pdf: pd.DataFrame) -> np.ndarray:
        out = np.frombuffer(pdf["blob"].iloc[0]).copy()
        for blob in pdf["blob"].iloc[1:]:
            out += np.frombuffer(blob)
        return out

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": [key[0]], "bucket": [key[1]], "blob": [total(pdf).tobytes()]})

    def last(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return finish(int(key[0]), total(pdf))

    parts = rows.mapInArrow(emit, _PART)
    sums = parts.groupBy("block", "bucket").applyInPandas(add, _PART) if tasks > 32 else parts
    # a number of its own: the sums are few bytes, but each block is a good deal of work
    return sums.repartition(blocks, "block").groupBy("block").applyInPandas(last, schema)


def _packed(rows: DataFrame, width_a: int, width_b: int) -> DataFrame:
    """``rows(a, b, w array)`` as blocks ``(n, a, b, w)`` of rows, matrices of bytes and doubles: a pass then
    reads a block at once, not every array of every row."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for codes, w in _batches(batches, width_a, width_b):
            step = max(1, PACK_BYTES // (width_a + width_b + 8 * w.shape[1]))
            for lo in range(0, len(w), step):
                a, b = (np.ascontiguousarray(c[lo:lo + step], dtype=np.int8) for c in codes["A"])
                mine = np.ascontiguousarray(w[lo:lo + step])
                yield pa.RecordBatch.from_arrays([pa.array([len(mine)], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in (a, b, mine)]],
                                                 names=["n", "a", "b", "w"])

    return rows.mapInArrow(pack, "n int, a binary, b binary, w binary")


def _batches(batches: Iterator[pa.RecordBatch], width_a: int, width_b: int):
    """``(side -> (own codes, opposite codes), weights (rows, starts))`` of Arrow batches of ``(a, b, w)``."""
    for batch in batches:
        n = batch.num_rows
        if "n" in batch.schema.names:  # blocks of ``_packed``
            for size, *blobs in zip(*(batch.column(c) for c in ("n", "a", "b", "w"))):
                size = size.as_py()
                a, b, w = (np.frombuffer(x.as_buffer(), t) for x, t in zip(blobs, (np.int8, np.int8, np.float64)))
                a, b = a.reshape(size, width_a), b.reshape(size, width_b)
                yield {"A": (a, b), "B": (b, a)}, w.reshape(size, -1)
        elif n:
            a, b = K.codes_matrix(batch.column("a"), width_a), K.codes_matrix(batch.column("b"), width_b)
            w = batch.column("w").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
            yield {"A": (a, b), "B": (b, a)}, w


def logprob_sums(rows: DataFrame, sides: dict, width_a: int, width_b: int, members: bool) -> dict:
    """Sum over a start's rows of the observed-class log-probability per group (for BIC).

    ``sides[(start, side)]``; the result has the same keys."""
    check_broadcast(sides)
    keys = list(sides)
    bc = rows.sparkSession.sparkContext.broadcast([(sides[k].model_dict(), sides[k].groups_dict()) for k in keys])

    def partial(batches):
        acc: dict = {}
        for codes, w in _batches(batches, width_a, width_b):
            for i, (start, s) in enumerate(keys):
                mine = w[:, start] > 0 if members else slice(None)
                t, o = (c[mine] for c in codes[s])
                lp = K.group_logprobs(t, o, *bc.value[i]).sum(axis=0)
                acc[i] = acc[i] + lp if i in acc else lp
        return acc

    finish = lambda i, v: pd.DataFrame({"i": i, "g": np.arange(len(v)), "v": v})
    out = {k: np.zeros(len(sides[k].kind)) for k in keys}
    for r in _reduced(rows, partial, finish, "i int, g long, v double", len(keys)).collect():
        out[keys[r.i]][r.g] = r.v
    bc.unpersist()
    return out


def group_logprob_sums(rows: DataFrame, sides: dict, width_a: int, width_b: int) -> dict[str, np.ndarray]:
    """``logprob_sums`` of ``rows(a, b)`` for the sides of one model set."""
    sums = logprob_sums(_one_start(rows.select("a", "b", F.lit(1.0).alias("w"))), {(0, s): sm for s, sm in sides.items()},
                        width_a, width_b, members=False)
    return {s: sums[(0, s)] for s in sides}


def logprob_table(spark, rows: DataFrame, sides: dict, width_a: int, width_b: int) -> DataFrame:
    """``(side, pos, alpha, sum_logp)`` of every group."""
    sums = group_logprob_sums(rows, sides, width_a, width_b)
    return spark.createDataFrame(
        [(s, int(p), float(a), float(v)) for s, sm in sides.items() for p, a, v in zip(sm.gpos, sm.galpha, sums[s])],
        "side string, pos int, alpha double, sum_logp double")


# --------------------------------------------------------------------------
# one model's step
# --------------------------------------------------------------------------

def descend(g: np.ndarray, h: np.ndarray, w: np.ndarray, l1: float, l2: float, sweeps: int = 200, eps: float = 1e-9) -> np.ndarray:
    """Minimise the quadratic model by coordinate descent; the last coordinate is the free intercept.

    ``g`` and ``h`` are loss gradient and Hessian at ``w`` (without the l2 term)."""
    new, n = w.copy(), len(w)
    diag = (h.diagonal() + np.r_[np.full(n - 1, l2), 0.0]).tolist()
    everything = [j for j in range(n) if diag[j] > 1e-14]
    coords = everything
    hd = np.zeros(n)  # h @ (new - w)
    for _ in range(sweeps):
        biggest = 0.0
        for j in coords:
            at = float(new[j])
            slope = float(g[j]) + float(hd[j])
            if j == n - 1:
                value = at - slope / diag[j]
            else:
                point = diag[j] * at - (slope + l2 * at)
                value = math.copysign(max(abs(point) - l1, 0.0), point) / diag[j]
            step = value - at
            if step:
                new[j] = value
                hd += step * h[j]
                biggest = max(biggest, abs(step) * math.sqrt(diag[j]))
        if biggest >= eps:  # the coordinates in use first, then a look at all again
            coords = [j for j in everything if new[j] or j == n - 1]
        elif coords is everything or len(coords) == len(everything):
            break
        else:
            coords = everything
    return new


def residual(g: np.ndarray, gb: float, w: np.ndarray, l1: float, l2: float) -> tuple[float, np.ndarray]:
    """Largest violation of the optimality conditions, and each feature's."""
    full = g + l2 * w
    each = np.where(w != 0, np.abs(full + l1 * np.sign(w)), np.maximum(np.abs(full) - l1, 0.0))
    return max(float(each.max(initial=0.0)), abs(gb)), each


@dataclass
class Trial:
    """State of an open model between passes: the accepted point and the one on trial."""

    feats: np.ndarray  # working set of the trial point, ascending
    coefs: np.ndarray
    b: float
    old_feats: np.ndarray
    old_coefs: np.ndarray
    old_b: float
    old_value: float
    screen: np.ndarray  # features that take part, ascending; meaningless while ``full``
    full: bool  # all features take part in the next pass
    halved: int = 0
    stuck: int = 0


_NONE = np.empty(0, np.int64)


def _start(sm: SideModels, m: int) -> Trial:
    order = np.argsort(sm.feats[m])
    f, c = sm.feats[m][order], sm.coefs[m][order]
    return Trial(f, c, float(sm.b[m]), f, c, float(sm.b[m]), math.inf, _NONE, True)


def next_trial(t: Trial, loss: float, g: np.ndarray, gb: float, h: np.ndarray, l1: float, l2: float, own: np.ndarray,
               tol: float, previous: float | None = None) -> tuple[Trial, float, str]:
    """From the sums at the trial point to the next one: ``(trial, residual, 'open' | 'done' | 'stalled')``.

    ``g`` is the gradient of the features ``own`` (ascending): all that occur if ``t.full``, else ``t.screen``.
    ``previous`` is the l1 strength at which the starting point was optimal (None: the empty model)."""
    value = loss + l1 * np.abs(t.coefs).sum() + 0.5 * l2 * (t.coefs ** 2).sum()
    w = np.zeros(len(own))
    w[np.searchsorted(own, t.feats)] = t.coefs
    worst, each = residual(g, gb, w, l1, l2)
    if worst <= tol:
        same = Trial(t.feats, t.coefs, t.b, t.feats, t.coefs, t.b, value, t.screen, True)
        return same, worst, "done" if t.full else "open"
    if value > t.old_value + 1e-12 * max(1.0, abs(t.old_value)):  # the step was too long: halve it
        feats = np.union1d(t.feats, t.old_feats)
        half, old = np.zeros(len(feats)), np.searchsorted(feats, t.old_feats)
        half[np.searchsorted(feats, t.feats)] += 0.5 * t.coefs
        half[old] += 0.5 * t.old_coefs
        new = Trial(feats, half, 0.5 * (t.b + t.old_b), t.old_feats, t.old_coefs, t.old_b, t.old_value,
                    t.screen, t.full, t.halved + 1, t.stuck)
        if new.halved <= 50:
            return new, worst, "open"
        # back at the accepted point: all features are looked at before the model counts as stalled
        back = Trial(t.old_feats, t.old_coefs, t.old_b, t.old_feats, t.old_coefs, t.old_b, t.old_value, t.screen, True, 0, t.stuck + 1)
        return back, worst, "stalled" if t.full or back.stuck >= STUCK else "open"
    stuck = t.stuck + 1 if t.old_value - value <= 1e-14 * max(1.0, abs(value)) else 0
    new = descend(np.r_[g[np.searchsorted(own, t.feats)], gb], h, np.r_[t.coefs, t.b], l1, l2)
    each[np.searchsorted(own, t.feats)] = 0.0
    wrong = np.flatnonzero(each > 0)
    enter = own[wrong[np.argsort(-each[wrong], kind="stable")[:ADMIT]]]
    if t.full and len(np.setdiff1d(enter, t.screen)):
        stuck = 0  # screening had left out features that matter
    elif stuck >= STUCK and not t.full:
        again = Trial(t.feats, t.coefs, t.b, t.feats, t.coefs, t.b, value, t.screen, True, 0, STUCK - 1)
        return again, worst, "open"
    stay = new[:-1] != 0
    feats = np.r_[t.feats[stay], enter]
    coefs = np.r_[new[:-1][stay], np.zeros(len(enter))]
    order = np.argsort(feats)
    screen = t.screen
    if t.full:
        size = np.abs(g + l2 * w)
        before = float(size.max(initial=0.0)) if previous is None else previous
        strong = own[size >= max(2 * l1 - before, 0.5 * l1)]
        screen = np.union1d(np.union1d(np.union1d(strong, own[wrong]), t.feats), t.screen)
    nxt = Trial(feats[order], coefs[order], float(np.clip(new[-1], -INTERCEPT_CLAMP, INTERCEPT_CLAMP)),
                t.feats, t.coefs, t.b, value, screen, False, 0, stuck)
    return nxt, worst, "stalled" if stuck >= STUCK else "open"


_STEP = ("part int, model int, feats array<long>, coefs array<double>, b double, old_feats array<long>, "
         "old_coefs array<double>, old_b double, old_value double, screen array<long>, full boolean, halved int, "
         "stuck int, residual double, state string")


def plan_passes(sides: dict, trials: dict, usable: dict, previous: dict, pass_bytes: int) -> list[dict]:
    """Blocks of open models, dealt into passes whose sums stay within ``pass_bytes`` (or hold one block)."""
    blocks = []
    for key, own in trials.items():
        sm, width = sides[key], int(usable[key].sum())
        for full in (True, False):
            ids: list[int] = []
            cols, hessians = _NONE, 0

            def close():
                if ids:
                    rows = len(ids) * (2 + len(cols)) + hessians
                    blocks.append((8 * rows, {
                        "key": key, "models": list(ids), "trials": [own[m] for m in ids], "tpos": sm.tpos[ids], "tcls": sm.tcls[ids],
                        "alpha": sm.malpha[ids], "cols": cols, "previous": [previous[key].get(m) for m in ids]}))

            for m in sorted(m for m in own if own[m].full == full):
                t = own[m]
                wider = np.flatnonzero(usable[key]) if full else np.union1d(cols, t.screen)
                more = hessians + (len(t.feats) + 1) ** 2
                if ids and (len(ids) == BLOCK_MODELS or 8 * ((len(ids) + 1) * (2 + len(wider)) + more) > BLOCK_BYTES):
                    close()
                    ids, wider, more = [], wider if full else t.screen, (len(t.feats) + 1) ** 2
                ids.append(m)
                cols, hessians = wider, more
            close()
    passes: list[dict] = []
    room = 0
    for size, block in blocks:
        if not passes or size > room:
            passes.append({})
            room = pass_bytes
        passes[-1][len(passes[-1])] = block
        room -= size
    return passes


def _newton_pass(rows: DataFrame, sides: dict, trials: dict, blocks: dict, counts: dict, width_a: int, width_b: int,
                 l1_ratio: float, tol: float) -> None:
    """One data pass and one step of the models in ``blocks``; updates ``trials`` and ``sides``."""
    keys = list(sides)
    bc = rows.sparkSession.sparkContext.broadcast(blocks)

    def partial(batches):
        acc: dict = {}
        for codes, w in _batches(batches, width_a, width_b):
            for i, part in bc.value.items():
                start, s = part["key"]
                t, o = codes[s]
                v = K.newton_sums(o, t, w[:, start] / counts[start], part)
                acc[i] = acc[i] + v if i in acc else v
        return acc

    def finish(i: int, v: np.ndarray) -> pd.DataFrame:
        part, out = bc.value[i], []
        cols, n = part["cols"], len(part["models"])
        loss, gb, g = v[:n], v[n:2 * n], v[2 * n:2 * n + n * len(cols)].reshape(n, len(cols))
        at = 2 * n + n * len(cols)
        for k, (m, t, alpha, before) in enumerate(zip(part["models"], part["trials"], part["alpha"], part["previous"])):
            size = len(t.feats) + 1
            h = v[at:at + size * size].reshape(size, size)
            at += size * size
            own = cols if t.full else t.screen
            new, worst, state = next_trial(t, loss[k], g[k, np.searchsorted(cols, own)], gb[k], h, alpha * l1_ratio,
                                           alpha * (1 - l1_ratio), own, tol, None if before is None else before * l1_ratio)
            out.append((keys.index(part["key"]), m, new.feats, new.coefs, new.b, new.old_feats, new.old_coefs, new.old_b,
                        new.old_value, new.screen, new.full, new.halved, new.stuck, worst, state))
        return pd.DataFrame(out, columns=[c.split()[0] for c in _STEP.split(", ")])

    arr = lambda x, t: np.array(x, dtype=t)
    for r in _reduced(rows, partial, finish, _STEP, len(blocks)).collect():  # sparse coefficients: model-sized
        key = keys[r.part]
        t = Trial(arr(r.feats, np.int64), arr(r.coefs, float), r.b, arr(r.old_feats, np.int64), arr(r.old_coefs, float),
                  r.old_b, r.old_value, arr(r.screen, np.int64), r.full, r.halved, r.stuck)
        # the accepted point is the best one known: it is what a stall or a caller's limit leaves
        sides[key].set(r.model, t.old_feats, t.old_coefs, t.old_b)
        if r.state == "open":
            trials[key][r.model] = t
        else:
            sides[key].converged[r.model] = r.state == "done"
            del trials[key][r.model]
    bc.unpersist()


def solve(rows: DataFrame, sides: dict, stats: list[RowStats], width_a: int, width_b: int, open_models: dict,
          l1_ratio: float = L1_RATIO, tol: float = 1e-5, max_passes: int | None = None, previous: dict | None = None,
          pass_bytes: int = PASS_BYTES) -> None:
    """Fit the models ``open_models[(start, side)]`` (numbers) in place.

    ``previous[(start, side)][model]`` is the strength a warm start was optimal at."""
    usable, previous = {}, previous or {}
    for (start, s), sm in sides.items():
        st = stats[start]
        usable[(start, s)] = st.counts["B" if s == "A" else "A"].ravel() > 0  # codes that never occur have no gradient
        usable[(start, s)][np.arange(sm.width_o) * N_CODES + GAP] = False
        sm.converged |= sm.malpha * l1_ratio >= 0.25 * st.sum_w / max(st.n, 1)
    trials = {k: {m: _start(sm, m) for m in open_models.get(k, ()) if not sm.converged[m]} for k, sm in sides.items()}
    counts = [max(st.n, 1) for st in stats]
    rounds = 0
    while any(trials.values()) and (max_passes is None or rounds < max_passes):
        for k, sm in sides.items():
            sm.n_passes += bool(trials[k])
        for blocks in plan_passes(sides, trials, usable, {k: previous.get(k, {}) for k in sides}, pass_bytes):
            _newton_pass(rows, sides, trials, blocks, counts, width_a, width_b, l1_ratio, tol)
        rounds += 1


def gradients(rows: DataFrame, sides: dict, width_a: int, width_b: int, n: int) -> DataFrame:
    """``(side, model, loss, gb, g)`` of ``rows(a, b, w)``: loss and gradient of every model, one pass."""
    check_broadcast(sides)
    blocks = {}
    for s, sm in sides.items():
        step = max(1, min(BLOCK_MODELS, BLOCK_BYTES // (8 * max(1, sm.n_features))))
        for k in range(0, sm.n_models, step):
            ids = np.arange(k, min(k + step, sm.n_models))
            blocks[len(blocks)] = {"side": s, "models": ids, "trials": [_start(sm, m) for m in ids], "tpos": sm.tpos[ids],
                                   "tcls": sm.tcls[ids], "cols": np.arange(sm.n_features)}
    bc = rows.sparkSession.sparkContext.broadcast(blocks)

    def partial(batches):
        acc: dict = {}
        for codes, w in _batches(batches, width_a, width_b):
            for i, part in bc.value.items():
                t, o = codes[part["side"]]
                v = K.newton_sums(o, t, w[:, 0] / n, part, hessian=False)
                acc[i] = acc[i] + v if i in acc else v
        return acc

    def finish(i: int, v: np.ndarray) -> pd.DataFrame:
        part = bc.value[i]
        m = len(part["models"])
        return pd.DataFrame({"side": part["side"], "model": part["models"], "loss": v[:m], "gb": v[m:2 * m],
                             "g": list(v[2 * m:].reshape(m, -1))})

    schema = "side string, model long, loss double, gb double, g array<double>"
    return _reduced(_one_start(rows), partial, finish, schema, max(1, len(blocks)))


def kkt_residual(rows: DataFrame, sides: dict, stats: RowStats, width_a: int, width_b: int,
                 l1_ratio: float = L1_RATIO) -> dict[str, np.ndarray]:
    """Largest optimality violation per model, from one more pass over the rows."""
    out = {s: np.zeros(sm.n_models) for s, sm in sides.items()}
    for r in gradients(rows, sides, width_a, width_b, stats.n).collect():
        sm = sides[r.side]
        g = np.array(r.g)
        g[np.arange(sm.width_o) * N_CODES + GAP] = 0.0
        alpha = sm.malpha[r.model]
        gb = 0.0 if abs(sm.b[r.model]) >= INTERCEPT_CLAMP else r.gb
        out[r.side][r.model] = residual(g, gb, sm.dense([r.model])[0], alpha * l1_ratio, alpha * (1 - l1_ratio))[0]
    return out


# --------------------------------------------------------------------------
# entry points
# --------------------------------------------------------------------------

@dataclass
class FitResult:
    sides: dict  # side -> SideModels with one group per column (chosen alpha)
    alphas: dict  # side -> {pos: alpha}
    path_table: list | None  # rows (side, pos, alpha, kind, df, sum_logp, bic, in_path, converged, chosen)
    stats: RowStats
    n_all: int
    path: dict | None = None  # side -> SideModels of every fitted path group

    @property
    def converged(self) -> bool:
        return all(bool(sm.converged.all()) for sm in self.sides.values())


def fit_rows(state: DataFrame, mode: str, weighted: bool, z: str = "z") -> DataFrame:
    """Rows and weights of an M-step: hard -> z = 1 rows with weight 1;
    soft -> all rows weighted by z; unweighted -> all rows, weight 1."""
    if mode == "hard" and weighted:
        return state.where(F.col(z) == 1).select("a", "b", F.lit(1.0).alias("w"))
    if weighted:
        return state.select("a", "b", F.col(z).cast("double").alias("w"))
    return state.select("a", "b", F.lit(1.0).alias("w"))


def fit_columns(rows: DataFrame, width_a: int, width_b: int, n_all: int | None = None,
                alphas: dict | None = None, init: dict | None = None, dfmax: int = DFMAX,
                l1_ratio: float = L1_RATIO, max_iter: int | None = None, tol: float = 1e-5,
                path: list[float] | None = None, alphas_per_round: int = 4, pass_bytes: int = PASS_BYTES) -> FitResult:
    """Fit every column of both sides on ``rows(a, b, w)``.

    ``alphas=None`` searches the regularisation path (strongest first; a column's path
    ends before its first model with df > dfmax; minimum BIC over n_all rows, ties to
    the stronger alpha).  Otherwise ``alphas[side][pos]`` fixes one strength per column;
    ``init`` (sides of a previous fit) warm-starts.  ``max_iter`` (None: no limit) bounds
    the passes of a round; models left over are marked in ``converged``.
    """
    return fit_starts(_one_start(rows), width_a, width_b, [alphas], [init], members=False, n_all=n_all, dfmax=dfmax,
                      l1_ratio=l1_ratio, max_iter=max_iter, tol=tol, path=path, alphas_per_round=alphas_per_round,
                      pass_bytes=pass_bytes)[0]


def fit_starts(rows: DataFrame, width_a: int, width_b: int, alphas: list[dict | None], init: list[dict | None],
               members: bool, n_all: int | None = None, dfmax: int = DFMAX, l1_ratio: float = L1_RATIO,
               max_iter: int | None = None, tol: float = 1e-5, path: list[float] | None = None,
               alphas_per_round: int = 4, pass_bytes: int = PASS_BYTES) -> list[FitResult]:
    """``fit_columns`` of every start on ``rows(a, b, w array<double>)``, a weight per start, in shared passes.

    With ``members`` a start has the rows of positive weight alone (hard labels); otherwise all.
    """
    rows = rows.select("a", "b", "w").persist()
    packed = _packed(rows, width_a, width_b).persist()
    try:
        stats = stats_of_starts(rows, width_a, width_b, len(alphas), members)
        if any(st.n == 0 for st in stats):
            raise ValueError("no rows to fit: the interacting class is empty")
        counts = [st.n if n_all is None else n_all for st in stats]
        options = (width_a, width_b, l1_ratio, max_iter, tol, pass_bytes)
        fixed = [k for k, a in enumerate(alphas) if a is not None]
        searched = [k for k, a in enumerate(alphas) if a is None]
        out: dict[int, FitResult] = {}
        sides, previous = {}, {}
        for k in fixed:
            for s, lt, lo in (("A", width_a, width_b), ("B", width_b, width_a)):
                cls = column_classes(stats[k], s)
                sm = sides[(k, s)] = layout(s, lt, lo, [(p, float(alphas[k][s][p]), cls[p]) for p in range(lt)])
                closed_form_intercepts(sm, stats[k])
                previous[(k, s)] = _warm_start(sm, init[k][s]) if init[k] is not None else {}
        if fixed:
            solve(packed, sides, stats, width_a, width_b, {key: range(sm.n_models) for key, sm in sides.items()}, l1_ratio, tol,
                  max_iter, previous, pass_bytes)
        for k in fixed:
            mine = {s: sides[(k, s)] for s in "AB"}
            chosen = {s: {int(p): float(a) for p, a in zip(sm.gpos, sm.galpha)} for s, sm in mine.items()}
            out[k] = FitResult(mine, chosen, None, stats[k], counts[k])
        if searched:
            out |= _search(packed, stats, searched, counts, members, dfmax, list(ALPHA_PATH if path is None else path),
                           alphas_per_round, *options)
        return [out[k] for k in range(len(alphas))]
    finally:
        packed.unpersist()
        rows.unpersist()


def _search(rows, stats, starts, n_all, members, dfmax, path, per_round, width_a, width_b, l1_ratio, max_iter, tol,
            pass_bytes) -> dict[int, FitResult]:
    sides = {}
    for k in starts:
        for s, lt, lo in (("A", width_a, width_b), ("B", width_b, width_a)):
            spec = []
            for p, cl in enumerate(column_classes(stats[k], s)):
                spec += [(p, a, cl) for a in path] if len(cl) > 1 else [(p, CONSTANT_ALPHA, cl)]
            sides[(k, s)] = layout(s, lt, lo, spec)
            closed_form_intercepts(sides[(k, s)], stats[k])
    # groups of each column, strongest first
    order = {key: {p: sorted(np.flatnonzero(sm.gpos == p), key=lambda g: -sm.galpha[g]) for p in set(sm.gpos.tolist())}
             for key, sm in sides.items()}
    in_path: dict = {key: {p: [] for p in order[key]} for key in sides}
    at = 0
    trivial = min(0.25 * stats[k].sum_w / max(stats[k].n, 1) for k in starts) / l1_ratio
    open_columns = {key: set(order[key]) for key in sides}
    while any(open_columns.values()) and at < len(path):
        # strengths solved in closed form cost no pass: take them along
        end = at
        while end < len(path) and path[end] >= trivial:
            end += 1
        end = min(len(path), end + per_round)
        todo = {key: [m for p in cols for g in order[key][p][at:end] for m in sides[key].models_of(g)]
                for key, cols in open_columns.items()}
        previous: dict = {key: {} for key in sides}
        if at:
            for key, cols in open_columns.items():
                for p in cols:
                    previous[key] |= _continue_path(sides[key], order[key][p], at, end)
        solve(rows, sides, stats, width_a, width_b, todo, l1_ratio, tol, max_iter, previous, pass_bytes)
        for key, sm in sides.items():
            dfs = sm.group_df()
            for p in list(open_columns[key]):
                for g in order[key][p][at:end]:
                    if dfs[g] > dfmax:
                        open_columns[key].discard(p)
                        break
                    in_path[key][p].append(g)
        at = end
    fitted = {key: sm.subset_groups([g for p in order[key] for g in in_path[key][p]]) for key, sm in sides.items()}
    sums = logprob_sums(rows, fitted, width_a, width_b, members)
    out = {}
    for k in starts:
        chosen, table, alphas = {}, [], {}
        for s in "AB":
            sm = fitted[(k, s)]
            dfs, done = sm.group_df(), sm.group_converged()
            bic = dfs * math.log(n_all[k]) - 2.0 * sums[(k, s)]
            keep = []
            for p in sorted(order[(k, s)]):
                best = min(np.flatnonzero(sm.gpos == p), key=lambda g: (round(bic[g], 6), -sm.galpha[g]))
                keep.append(best)
                for g in sorted(np.flatnonzero(sm.gpos == p), key=lambda g: -sm.galpha[g]):
                    table.append((s, int(p), float(sm.galpha[g]), KIND_NAMES[sm.kind[g]], int(dfs[g]), float(sums[(k, s)][g]),
                                  float(bic[g]), True, bool(done[g]), bool(g == best)))
            alphas[s] = {int(sm.gpos[g]): float(sm.galpha[g]) for g in keep}
            chosen[s] = sm.subset_groups(keep)
        out[k] = FitResult(chosen, alphas, table, stats[k], n_all[k], {s: fitted[(k, s)] for s in "AB"})
    return out


def _continue_path(sm: SideModels, groups: list, at: int, end: int) -> dict[int, float]:
    """Start the next strengths of a column from its last solved one; that one's strength by model."""
    if at >= len(groups):
        return {}
    out = {}
    for g in groups[at:end]:
        for m, last in zip(sm.models_of(g), sm.models_of(groups[at - 1])):
            sm.feats[m], sm.coefs[m], sm.b[m] = sm.feats[last], sm.coefs[last], sm.b[last]
            out[m] = float(sm.malpha[last])
    return out


def _warm_start(sm: SideModels, previous: SideModels) -> dict[int, float]:
    """Copy coefficients of matching (pos, class) models of a previous fit; their strengths by model."""
    known = {(int(p), int(c)): m for m, (p, c) in enumerate(zip(previous.tpos, previous.tcls))}
    out = {}
    for m, key in enumerate(zip(sm.tpos.tolist(), sm.tcls.tolist())):
        if key in known and previous.width_o == sm.width_o:
            old = known[key]
            sm.feats[m], sm.coefs[m], sm.b[m] = previous.feats[old], previous.coefs[old], previous.b[old]
            out[m] = float(previous.malpha[old])
    return out

"""Coevolution (alternative) model: scoring, model tables and the
path/BIC selection as DataFrame operators.

Scoring is map-only: the fitted model block (model-sized, size-checked)
is broadcast and ``mapInArrow`` appends each pair's log-likelihood to the
wide row.  The relational form (residues joined to coefficient rows,
grouped per pair/column/class) is kept for model tables given as
DataFrames and as a cross-check; it shuffles per-pair rows, so the
map-only form is the one used inside EM.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from copair.functions.alphabet import CONSTANT_PROB, N_CODES, PC_ALT
from copair.operators import kernels as K
from copair.operators.models import KIND_NAMES, MAX_MODEL_BYTES, check_broadcast, layout
from copair.operators.null_model import pwm_lookup, pwm_residues
from copair.operators.prep import long_view


# --------------------------------------------------------------------------
# map-only scoring with fitted models
# --------------------------------------------------------------------------

def score_alt(state: DataFrame, sides: dict, width_a: int, width_b: int, out: str = "alt_llh",
              per_residue: bool = False, pwm: dict | None = None) -> DataFrame:
    """Append ``alt_llh`` (sum over both sides of the observed-class
    log-probabilities), with ``pwm`` arrays ``null_llh`` in the same pass, and
    optionally the per-residue arrays ``alt_a``/``alt_b``."""
    check_broadcast(sides)
    payload = {s: (sm.model_dict(), sm.groups_dict(), sm.gpos) for s, sm in sides.items()}
    bc = state.sparkSession.sparkContext.broadcast(payload)
    fields = list(state.schema.fields) + [T.StructField(out, T.DoubleType(), True)]
    if pwm is not None:
        fields.append(T.StructField("null_llh", T.DoubleType(), True))
    if per_residue:
        fields += [T.StructField("alt_a", T.ArrayType(T.DoubleType()), True),
                   T.StructField("alt_b", T.ArrayType(T.DoubleType()), True)]
    schema = T.StructType(fields)

    def kernel(batches):
        pl = bc.value
        null_score = pwm_lookup(pwm) if pwm is not None else None
        for batch in batches:
            n = batch.num_rows
            a = K.codes_matrix(batch.column("a"), width_a)
            b = K.codes_matrix(batch.column("b"), width_b)
            total = np.zeros(n)
            per = {}
            for s, (t, o, wt) in (("A", (a, b, width_a)), ("B", (b, a, width_b))):
                mdl, grp, gpos = pl[s]
                lp = K.group_logprobs(t, o, mdl, grp)
                # one group per column: order columns by position
                mat = np.zeros((n, wt))
                mat[:, gpos] = lp
                per[s] = mat
                total += mat.sum(axis=1)
            cols = [batch.column(i) for i in range(batch.num_columns)]
            names = list(batch.schema.names)
            cols.append(pa.array(total, type=pa.float64()))
            names.append(out)
            if null_score is not None:
                cols.append(pa.array(null_score(a, b), type=pa.float64()))
                names.append("null_llh")
            if per_residue:
                for s in ("A", "B"):
                    m = per[s]
                    offsets = pa.array(np.arange(0, (n + 1) * m.shape[1], m.shape[1], dtype=np.int32))
                    cols.append(pa.ListArray.from_arrays(offsets, pa.array(m.ravel(), type=pa.float64())))
                    names.append("alt_a" if s == "A" else "alt_b")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return state.mapInArrow(kernel, schema)


def score_starts(state: DataFrame, sides: list[dict], pwms: list[dict], width_a: int, width_b: int,
                 residues: bool = False) -> DataFrame:
    """Append ``alt_llh`` and ``null_llh`` arrays, an entry per model set, in one pass over the pairs.

    With ``residues`` also ``alt_a``, ``alt_b``, ``null_a``, ``null_b``: per model set the
    log-probability of every position, whose sums are the former."""
    check_broadcast({(i, s): sm for i, one in enumerate(sides) for s, sm in one.items()})
    bc = state.sparkSession.sparkContext.broadcast(
        [({s: (sm.model_dict(), sm.groups_dict(), sm.gpos) for s, sm in one.items()}, pwm) for one, pwm in zip(sides, pwms)])
    extra = [f"{m}_{s}" for m in ("alt", "null") for s in "ab"] if residues else []
    cells = T.ArrayType(T.ArrayType(T.DoubleType()))
    schema = T.StructType([*state.schema.fields, *[T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("alt_llh", "null_llh")],
                           *[T.StructField(c, cells) for c in extra]])

    def kernel(batches):
        sets = [(models, pwm_residues(pwm)) for models, pwm in bc.value]
        for batch in batches:
            n = batch.num_rows
            a, b = K.codes_matrix(batch.column("a"), width_a), K.codes_matrix(batch.column("b"), width_b)
            per = {f"{m}_{s}": [] for m in ("alt", "null") for s in "ab"}
            for models, null in sets:
                for s, t, o in (("A", a, b), ("B", b, a)):
                    model, groups, gpos = models[s]
                    mat = np.zeros(t.shape)
                    mat[:, gpos] = K.group_logprobs(t, o, model, groups)  # one group per column
                    per[f"alt_{s.lower()}"].append(mat)
                for s, mat in zip("ab", null(a, b)):
                    per[f"null_{s}"].append(mat)
            totals = [np.stack([x.sum(axis=1) + y.sum(axis=1) for x, y in zip(per[f"{m}_a"], per[f"{m}_b"])], axis=1)
                      for m in ("alt", "null")]
            cols = [*batch.columns, *[_nested(t) for t in totals], *[_nested(np.stack(per[c], axis=1)) for c in extra]]
            yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names, "alt_llh", "null_llh", *extra])

    return state.mapInArrow(kernel, schema)


def _nested(x: np.ndarray) -> pa.Array:
    """A list column of the rows of ``x`` (lists of lists if it has three dimensions)."""
    values = pa.array(np.ascontiguousarray(x).ravel(), type=pa.float64())
    size = x.size
    for width in x.shape[:0:-1]:
        size = size // width if width else 0
        rows = size if width else int(np.prod(x.shape[:-1]))
        values = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * width), values)
    return values


# --------------------------------------------------------------------------
# model tables (DataFrames) <-> model blocks
# --------------------------------------------------------------------------

def model_tables(spark, sides: dict, iteration: int | None = None):
    """Model-sized DataFrames: ``models(side,pos,alpha,kind,classes,df)``,
    non-zero ``coefs(side,pos,alpha,cls,feat_pos,feat_aa,value)`` and
    ``intercepts(side,pos,alpha,cls,value)``."""
    mrows, crows, irows = [], [], []
    for s, sm in sides.items():
        dfs = sm.group_df()
        for g in range(len(sm.kind)):
            mrows.append((s, int(sm.gpos[g]), float(sm.galpha[g]), KIND_NAMES[sm.kind[g]],
                          [int(c) for c in sm.classes[g]], int(dfs[g])))
        for m in range(sm.n_models):
            p, c, a = int(sm.tpos[m]), int(sm.tcls[m]), float(sm.malpha[m])
            irows.append((s, p, a, c, float(sm.b[m])))
            for f, v in zip(sm.feats[m].tolist(), sm.coefs[m].tolist()):
                crows.append((s, p, a, c, f // N_CODES, f % N_CODES, v))
    models = spark.createDataFrame(
        mrows, "side string, pos int, alpha double, kind string, classes array<int>, df bigint")
    coefs = spark.createDataFrame(
        crows, "side string, pos int, alpha double, cls int, feat_pos int, feat_aa int, value double")
    intercepts = spark.createDataFrame(irows, "side string, pos int, alpha double, cls int, value double")
    if iteration is not None:
        models, coefs, intercepts = (d.withColumn("iter", F.lit(iteration)) for d in (models, coefs, intercepts))
    return models, coefs, intercepts


def sides_from_tables(models: DataFrame, coefs: DataFrame, intercepts: DataFrame,
                      width_a: int, width_b: int) -> dict:
    """Collect given (model-sized, size-checked) tables into model blocks, one
    group per (side, pos, alpha).  ``models`` needs (side, pos, alpha, kind, classes)."""
    widths = {"A": width_a, "B": width_b}
    sizes = coefs.agg(F.count(F.lit(1))).first()[0], models.agg(F.sum(F.size("classes"))).first()[0] or 0
    if 100 * (sizes[0] + sizes[1]) > MAX_MODEL_BYTES:
        raise ValueError(f"model tables of {sizes[1]} models and {sizes[0]} coefficients are too large to broadcast")
    mrows = models.select("side", "pos", "alpha", "kind", "classes").collect()
    crows = coefs.select("side", "pos", "alpha", "cls", "feat_pos", "feat_aa", "value").collect()
    irows = intercepts.select("side", "pos", "alpha", "cls", "value").collect()
    sides = {}
    for s in ("A", "B"):
        o = "B" if s == "A" else "A"
        spec = [(r.pos, float(r.alpha), r.classes, KIND_NAMES.index(r.kind)) for r in mrows if r.side == s]
        sm = layout(s, widths[s], widths[o], spec)
        index = {(int(p), float(a), int(c)): m for m, (p, a, c) in enumerate(zip(sm.tpos, sm.malpha, sm.tcls))}
        for r in crows:
            m = index.get((r.pos, float(r.alpha), r.cls)) if r.side == s else None
            if m is not None and r.feat_aa < 20 and r.feat_pos < widths[o]:
                sm.add(m, r.feat_pos * N_CODES + r.feat_aa, r.value)
        for r in irows:
            m = index.get((r.pos, float(r.alpha), r.cls)) if r.side == s else None
            if m is not None:
                sm.b[m] = r.value
        sm.converged = np.ones(sm.n_models, dtype=bool)
        sides[s] = sm
    return sides


# --------------------------------------------------------------------------
# relational operators on model tables
# --------------------------------------------------------------------------

def degrees_of_freedom(models: DataFrame, coefs: DataFrame, keys=("side", "pos")) -> DataFrame:
    """Distinct non-zero feature columns per model, 0 when none."""
    keys = list(keys)
    d = coefs.where(F.col("value") != 0).groupBy(*keys).agg(
        F.countDistinct("feat_pos", "feat_aa").cast("long").alias("df"))
    return models.select(*keys).distinct().join(d, keys, "left").select(
        *keys, F.coalesce(F.col("df"), F.lit(0).cast("long")).alias("df"))


def bic(dfs: DataFrame, logp_sums: DataFrame, n_obs: int | F.Column, keys=("side", "pos")) -> DataFrame:
    """``df*ln(n) - 2*sum(logp)``."""
    keys = list(keys)
    n = n_obs if isinstance(n_obs, F.Column) else F.lit(float(n_obs))
    return dfs.join(logp_sums, keys).withColumn(
        "bic", F.col("df").cast("double") * F.log(n.cast("double")) - F.lit(2.0) * F.col("sum_logp"))


def dfmax_path(table: DataFrame, dfmax: int, keys=("side", "pos")) -> DataFrame:
    """Keep path points up to (excluding) the first alpha whose df > dfmax,
    walking from the strongest alpha: running max of df <= dfmax."""
    w = Window.partitionBy(*keys).orderBy(F.col("alpha").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return table.withColumn("in_path", F.max("df").over(w) <= F.lit(dfmax))


def select_by_bic(table: DataFrame, keys=("side", "pos")) -> DataFrame:
    """Per column the in-path model of minimum BIC, ties to the stronger alpha.

    BIC is compared to 6 places, so that the order of a sum never decides a tie."""
    w = Window.partitionBy(*keys).orderBy(F.round("bic", 6).asc(), F.col("alpha").desc())
    return table.where("in_path").withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank")


def score_alt_relational(pairs: DataFrame, models: DataFrame, coefs: DataFrame, intercepts: DataFrame,
                         pc: float = PC_ALT) -> DataFrame:
    """Per-residue observed-class log-probability ``(pair_id, side, pos, logp)``
    for one model per (side, pos), from model tables (kinds ovr/binary/constant).

    residues of the opposite side join the (broadcast, model-sized)
    coefficient rows on (feat_pos, feat_aa); margins are summed per
    (pair, side, pos, cls) and normalised over the model's classes."""
    lv = long_view(pairs)
    opp = lv.select("pair_id", F.when(F.col("side") == "A", "B").otherwise("A").alias("side"),
                    F.col("pos").alias("feat_pos"), F.col("aa").alias("feat_aa"))
    lin = opp.join(F.broadcast(coefs.select("side", "pos", "cls", "feat_pos", "feat_aa", "value")),
                   ["side", "feat_pos", "feat_aa"]).groupBy("pair_id", "side", "pos", "cls").agg(
        F.sum("value").alias("xb"))
    mdl = models.select("side", "pos", "kind", "classes")
    cls_rows = mdl.select("side", "pos", "kind", "classes", F.explode("classes").alias("cls"))
    cls_rows = cls_rows.join(F.broadcast(intercepts.select("side", "pos", "cls", F.col("value").alias("b0"))),
                             ["side", "pos", "cls"], "left")
    # every (pair, side, pos, cls) of ovr/binary models
    target = lv.select("pair_id", "side", "pos", F.col("aa").alias("obs"))
    grid = target.join(F.broadcast(cls_rows), ["side", "pos"])
    grid = grid.join(lin, ["pair_id", "side", "pos", "cls"], "left")
    margin = F.coalesce(F.col("b0"), F.lit(0.0)) + F.coalesce(F.col("xb"), F.lit(0.0))
    sig = F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))
    grid = grid.withColumn("sig", sig)
    key = ["pair_id", "side", "pos"]
    agg = grid.groupBy(*key, "kind", "obs", "classes").agg(
        F.sum("sig").alias("denom"),
        F.max(F.when(F.col("cls") == F.col("obs"), F.col("sig"))).alias("sig_obs"),
        F.max(F.when(F.col("cls") == F.element_at("classes", -1), F.col("sig"))).alias("sig_pos"),
    )
    in_cls = F.array_contains(F.col("classes"), F.col("obs"))
    p = (
        F.when(F.col("kind") == "ovr", F.col("sig_obs") / F.col("denom"))
        .when(F.col("kind") == "binary",
              F.when(F.col("obs") == F.element_at("classes", -1), F.col("sig_pos")).otherwise(
                  F.lit(1.0) - F.col("sig_pos")))
        .otherwise(F.lit(CONSTANT_PROB))
    )
    logp = F.when(in_cls & (p > 0), F.log(p)).otherwise(F.lit(pc))
    return agg.select(*key, logp.alias("logp"))


def alt_llh_from_residues(residue_logp: DataFrame) -> DataFrame:
    return residue_logp.groupBy("pair_id").agg(F.sum("logp").alias("alt_llh"))


"""Independence (null) model: a weighted position weight matrix.

fit  : explode the wide rows once, ``groupBy(side, pos, aa).sum(weight)``
       (partial aggregation: at most 21 x (La+Lb) rows leave each task).
score: the PWM is schema-sized (21 x (La+Lb) doubles), so it is broadcast as one
       array per side and looked up in Arrow batches of the wide rows -- map-only,
       no join, no shuffle.  EM scores it in the coevolution model's pass.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from copair.functions.alphabet import N_CODES, PC_NULL
from copair.operators import kernels as K
from copair.operators.prep import long_view

MAX_PWM_CELLS = 21 * 200_000  # size bound for the constant array (doubles)


def _weighted_rows(state: DataFrame, mode: str, z: str) -> DataFrame:
    if mode == "hard":
        rows = state.where(F.col(z) == 0)
    else:
        rows = state
    return rows.select("pair_id", "a", "b", (F.lit(1.0) - F.col(z).cast("double")).alias("w"))


def fit_null(state: DataFrame, mode: str = "soft", z: str = "z", pc: float = PC_NULL) -> DataFrame:
    """``(side, pos, aa, w_sum, logp)`` for every (column, residue) seen in
    the selected rows; ``ln(pc)`` where the weighted count is 0 (also when
    the total weight is 0, e.g. all z = 1)."""
    rows = _weighted_rows(state, mode, z)
    lv = rows.select(
        "w",
        F.inline(
            F.array(
                F.struct(F.lit("A").alias("side"), F.col("a").alias("codes")),
                F.struct(F.lit("B").alias("side"), F.col("b").alias("codes")),
            )
        ),
    ).select("w", "side", F.posexplode("codes").alias("pos", "aa"))
    sums = lv.groupBy("side", "pos", "aa").agg(F.sum("w").alias("w_sum"))
    total = F.sum("w_sum").over(Window.partitionBy("side", "pos"))
    ratio = F.try_divide(F.col("w_sum"), total)
    logp = F.when(ratio > 0, F.log(ratio)).otherwise(F.lit(math.log(pc)))
    return sums.select(
        "side", F.col("pos").cast("int"), F.col("aa").cast("int"), "w_sum", logp.alias("logp")
    )


def pwm_arrays(pwm: DataFrame, width_a: int, width_b: int, pc: float = PC_NULL,
               unseen: str = "log") -> dict[str, list[float]]:
    """Collect the schema-sized PWM into dense ``pos*21+aa`` arrays per side.

    ``unseen='log'`` scores residues missing from the PWM with ``ln(pc)``;
    ``unseen='raw'`` reproduces the reference's raw ``pc`` (quirk Q1)."""
    if (width_a + width_b) * N_CODES > MAX_PWM_CELLS:
        raise ValueError(f"columns {width_a} + {width_b} exceed the bound of a broadcast PWM")
    fill = math.log(pc) if unseen == "log" else pc
    out = {"A": [fill] * (width_a * N_CODES), "B": [fill] * (width_b * N_CODES)}
    for r in pwm.select("side", "pos", "aa", "logp").collect():
        out[r.side][r.pos * N_CODES + r.aa] = float(r.logp)
    return out


def pwm_lookup(arrays: dict[str, list[float]]):
    """``(codes_a, codes_b) -> null log-likelihood`` of code matrices."""
    tables = {s: np.asarray(v).reshape(-1, N_CODES) for s, v in arrays.items()}

    def score(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return sum((tables[s][np.arange(x.shape[1]), x].sum(axis=1) for s, x in (("A", a), ("B", b))), np.zeros(len(a)))

    return score


def pwm_residues(arrays: dict[str, list[float]]):
    """``(codes_a, codes_b) -> (per-position null log-probabilities of A, of B)``."""
    tables = {s: np.asarray(v).reshape(-1, N_CODES) for s, v in arrays.items()}
    return lambda a, b: [tables[s][np.arange(x.shape[1]), x] for s, x in (("A", a), ("B", b))]


def pwms_of_starts(state: DataFrame, starts: int, width_a: int, width_b: int, pc: float = PC_NULL) -> list[dict]:
    """``pwm_arrays`` of every start from ``state(a, b, z array)``, weights 1 - z, in one aggregation.

    Hard labels give weights 0 and 1, so one form serves both modes; a residue without weight
    scores ``ln(pc)``, as does one that never occurs."""
    if (width_a + width_b) * N_CODES > MAX_PWM_CELLS:
        raise ValueError(f"columns {width_a} + {width_b} exceed the bound of a broadcast PWM")
    side = lambda s, c: F.struct(F.lit(s).alias("side"), F.col(c).alias("codes"))
    lv = state.select("z", F.inline(F.array(side("A", "a"), side("B", "b")))).select(
        "z", "side", F.posexplode("codes").alias("pos", "aa"))
    sums = lv.groupBy("side", "pos", "aa").agg(*[F.sum(F.lit(1.0) - F.col("z")[k]).alias(f"w{k}") for k in range(starts)]).collect()
    weight = {"A": np.zeros((starts, width_a, N_CODES)), "B": np.zeros((starts, width_b, N_CODES))}
    for r in sums:
        weight[r.side][:, r.pos, r.aa] = [r[f"w{k}"] for k in range(starts)]
    out = []
    for k in range(starts):
        one = {}
        for s, w in weight.items():
            total = w[k].sum(axis=1, keepdims=True)
            share = np.divide(w[k], total, out=np.zeros_like(w[k]), where=total > 0)
            one[s] = np.where(share > 0, np.log(np.where(share > 0, share, 1.0)), math.log(pc)).ravel().tolist()
        out.append(one)
    return out


def null_llh(state: DataFrame, arrays: dict[str, list[float]], out: str = "null_llh") -> DataFrame:
    """Add the null log-likelihood of every pair (sum over both sides)."""
    widths = [len(arrays[s]) // N_CODES for s in "AB"]
    schema = T.StructType([*state.schema.fields, T.StructField(out, T.DoubleType(), True)])

    def kernel(batches):
        score = pwm_lookup(arrays)
        for batch in batches:
            a, b = (K.codes_matrix(batch.column(c), w) for c, w in zip("ab", widths))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score(a, b), pa.float64())], names=[*batch.schema.names, out])

    return state.mapInArrow(kernel, schema)


def score_null_long(pairs: DataFrame, pwm: DataFrame, pc: float = PC_NULL, unseen: str = "log") -> DataFrame:
    """Per-residue sink form ``(pair_id, side, pos, logp)``: broadcast left
    join against the schema-sized PWM with a default for unseen residues."""
    fill = math.log(pc) if unseen == "log" else pc
    lv = long_view(pairs)
    return lv.join(F.broadcast(pwm.select("side", "pos", "aa", "logp")), ["side", "pos", "aa"], "left").select(
        "pair_id", "side", "pos", F.coalesce(F.col("logp"), F.lit(fill)).alias("logp")
    )

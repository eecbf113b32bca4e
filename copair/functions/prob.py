"""Scalar probability expressions (JVM-side, codegen friendly)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def posterior_expr(alt: Column | str, null: Column | str, int_frac: float) -> Column:
    """E-step: z = pi e^alt / (pi e^alt + (1-pi) e^null), in log-odds form.

    ``1/(1+exp(null-alt+ln((1-pi)/pi)))`` never underflows to 0/0: a huge
    exponent gives +inf and z = 0.
    """
    if not 0.0 < int_frac < 1.0:
        raise ValueError(f"int_frac is {int_frac} but must be in (0, 1)")
    offset = math.log((1.0 - int_frac) / int_frac)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(_c(null) - _c(alt) + F.lit(offset)))


def coin_expr(pair_id: Column | str, seed: int) -> Column:
    """Deterministic fair coin per pair: independent of partitioning, unlike rand()."""
    return (F.xxhash64(_c(pair_id), F.lit(seed)) % 2 == 0).cast("int")


def unit_uniform_expr(pair_id: Column | str, seed: int) -> Column:
    """Deterministic uniform [0,1) per pair: the first 13 hex digits of md5('<pair_id>:<seed>')."""
    digest = F.md5(F.concat(_c(pair_id).cast("string"), F.lit(f":{seed}")).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def harden_expr(z: Column | str, pair_id: Column | str = "pair_id", seed: int = 42) -> Column:
    """Round to 0/1; exactly 0.5 becomes a fair coin (hash of pair_id)."""
    zc = _c(z)
    return (
        F.when(zc > 0.5, F.lit(1))
        .when(zc < 0.5, F.lit(0))
        .otherwise(coin_expr(pair_id, seed))
        .cast("int")
    )


def logloss_expr(y: Column | str, p: Column | str, eps: float = 1e-15) -> Column:
    """Binary cross entropy with p clipped to [eps, 1-eps]."""
    pc = F.least(F.greatest(_c(p).cast("double"), F.lit(eps)), F.lit(1.0 - eps))
    yc = _c(y).cast("double")
    return -(yc * F.log(pc) + (F.lit(1.0) - yc) * F.log(F.lit(1.0) - pc))


def mcc_expr(tp: Column, tn: Column, fp: Column, fn: Column) -> Column:
    """Matthews correlation from counts; 0 when the denominator is 0."""
    tp, tn, fp, fn = (x.cast("double") for x in (tp, tn, fp, fn))
    den = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return F.when(den == 0, F.lit(0.0)).otherwise((tp * tn - fp * fn) / den)

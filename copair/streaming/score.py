"""Score pairs (batch or streaming DataFrame) with fixed, already fitted
models: null and coevolution log-likelihood in one Arrow pass with the
broadcast tables, and the posterior.  All are per-row, so they are valid on a streaming
DataFrame without state or watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame

from copair.functions.prob import posterior_expr
from copair.operators import alt_model


def score_pairs(pairs: DataFrame, sides: dict, pwm_arrays: dict, width_a: int, width_b: int,
                int_frac: float = 0.75) -> DataFrame:
    """``pairs(pair_id, a, b)`` -> ``+ alt_llh, null_llh, z``."""
    scored = alt_model.score_alt(pairs, sides, width_a, width_b, pwm=pwm_arrays)
    return scored.withColumn("z", posterior_expr("alt_llh", "null_llh", int_frac))

"""Hidden labels: ground truth, random starts, E-step posterior, hard
rounding, convergence and the label-based row selections.

All are column expressions on the wide state row ``(pair_id, a, b, z, ...)``,
so they are map-only; convergence is one global aggregate (one row to the
driver)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copair.functions.prob import harden_expr, posterior_expr, unit_uniform_expr


def true_label_expr(int_limit: int) -> F.Column:
    """1 for ``pair_id <= int_limit`` (inclusive), 0 for others and whenever ``int_limit <= 0``."""
    return (F.col("pair_id") <= F.lit(int_limit)).cast("int") if int_limit > 0 else F.lit(0)


def check_int_limit(int_limit: int, n_obs: int) -> None:
    if int_limit > n_obs:
        raise ValueError(f"option int_limit is {int_limit} but must be at most the number of pairs, {n_obs}")


def true_labels(pairs: DataFrame, int_limit: int, n_obs: int | None = None) -> DataFrame:
    """``(pair_id, y)`` by ``true_label_expr``; a limit beyond the number of pairs is an error."""
    if int_limit > 0:
        check_int_limit(int_limit, pairs.count() if n_obs is None else n_obs)
    return pairs.select("pair_id", true_label_expr(int_limit).alias("y"))


def random_labels_expr(int_frac: float, mode: str, seed: int = 42) -> F.Column:
    """Random start: P(high) = int_frac; hard {0,1}, soft {0.1,0.9}."""
    hit = unit_uniform_expr("pair_id", seed) < F.lit(int_frac)
    if mode == "hard":
        return F.when(hit, F.lit(1.0)).otherwise(F.lit(0.0))
    return F.when(hit, F.lit(0.9)).otherwise(F.lit(0.1))


def random_labels(pairs: DataFrame, int_frac: float, mode: str, seed: int = 42) -> DataFrame:
    return pairs.withColumn("z", random_labels_expr(int_frac, mode, seed))


def posterior(df: DataFrame, int_frac: float, mode: str = "soft", alt: str = "alt_llh",
              null: str = "null_llh", out: str = "z", seed: int = 42) -> DataFrame:
    z = posterior_expr(alt, null, int_frac)
    if mode == "hard":
        z = harden_expr(z, "pair_id", seed).cast("double")
    return df.withColumn(out, z)


def harden(df: DataFrame, col: str = "z", out: str = "z_hard", seed: int = 42) -> DataFrame:
    return df.withColumn(out, harden_expr(col, "pair_id", seed))


def convergence_df(df: DataFrame, cur: str = "z", prev: str = "z_prev", mode: str = "soft",
                   tol: float = 0.005) -> DataFrame:
    """One row: ``n, sum_abs_diff, mean_abs_diff, converged``."""
    agg = df.agg(
        F.count(F.lit(1)).cast("long").alias("n"),
        F.sum(F.abs(F.col(cur) - F.col(prev))).alias("sum_abs_diff"),
    ).withColumn("mean_abs_diff", F.col("sum_abs_diff") / F.col("n"))
    if mode == "hard":
        conv = F.col("sum_abs_diff") == 0
    else:
        conv = F.col("mean_abs_diff") < F.lit(tol)
    return agg.withColumn("converged", conv)


def has_converged(df: DataFrame, cur: str = "z", prev: str = "z_prev", mode: str = "soft",
                  tol: float = 0.005) -> bool:
    return bool(convergence_df(df, cur, prev, mode, tol).first()["converged"])


def select_interacting(df: DataFrame, z: str = "z") -> DataFrame:
    """Hard M-step rows for the coevolution model: z = 1."""
    return df.where(F.col(z) == 1)


def select_noninteracting(df: DataFrame, z: str = "z") -> DataFrame:
    """Hard M-step rows for the independence model: z = 0."""
    return df.where(F.col(z) == 0)


def check_hard_labels(df: DataFrame, z: str = "z") -> None:
    """Hard labels are 0 or 1 and both occur; one aggregate."""
    r = df.agg(F.sum((F.col(z) == 1).cast("long")).alias("ones"), F.sum((F.col(z) == 0).cast("long")).alias("zeros"),
               F.count(F.lit(1)).alias("n")).first()
    if (r.ones or 0) + (r.zeros or 0) < r.n:
        raise ValueError("hard labels must be 0 or 1")
    if not r.ones or not r.zeros:
        raise ValueError(f"one class is empty: {r.ones or 0} interacting and {r.zeros or 0} other pairs")


def select_for_contacts(df: DataFrame, mode: str = "soft", z: str = "z", soft_threshold: float = 0.5) -> DataFrame:
    """Rows for the final contact fit: hard z = 1, soft z >= threshold."""
    if mode == "hard":
        return df.where(F.col(z) == 1)
    return df.where(F.col(z) >= F.lit(soft_threshold))

"""Label evaluation and the per-iteration tables behind the reference's
reports and plots (the plots themselves are not drawn).

Two forms keep rows of pairs where they are.  The truth may be a column
expression over the rows, or a column ``y`` they have, instead of a table to be
joined.  A table with a ``history`` (a row per pair, an entry per start and
iteration) gives the matrices of pairs by iterations as a projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from copair.functions.prob import harden_expr, logloss_expr, mcc_expr


#: An entry of ``history``: what iteration ``iter`` of a start gave a pair.
HISTORY = "array<struct<start: int, iter: int, z: double, alt_llh: double, null_llh: double>>"


def with_truth(rows: DataFrame, truth: DataFrame | Column | None, how: str = "inner") -> DataFrame:
    """``rows`` with the true label ``y``: a table ``(pair_id, y)`` is joined, an expression is
    evaluated in place, and None stands for a column ``y`` that ``rows`` has."""
    if truth is None:
        return rows if how == "left" else rows.where(F.col("y").isNotNull())
    if isinstance(truth, Column):
        return rows.withColumn("y", truth)
    return rows.join(truth.select("pair_id", "y"), "pair_id", how)


def unrolled(history: DataFrame) -> DataFrame:
    """A row per pair, start and iteration of a table with a ``history``; other columns stay."""
    others = [c for c in history.columns if c != "history"]
    return history.select(*others, F.inline("history"))


def _joined(pred: DataFrame, truth: DataFrame | Column | None, z: str = "z") -> DataFrame:
    j = with_truth(pred, truth)
    return j.select("pair_id", *([c for c in ("iter", "start") if c in pred.columns]), F.col(z).alias("z"), "y")


def confusion(pred: DataFrame, truth: DataFrame | Column | None, mode: str = "soft", z: str = "z", seed: int = 42) -> DataFrame:
    """Counts on the full 2x2 grid (y, y_hat) plus the row-normalised share."""
    j = _joined(pred, truth, z).withColumn(
        "y_hat", harden_expr("z", "pair_id", seed) if mode == "soft" else F.col("z").cast("int"))
    counts = j.groupBy("y", "y_hat").agg(F.count(F.lit(1)).cast("long").alias("n"))
    spark = pred.sparkSession
    grid = spark.createDataFrame([(y, p) for y in (0, 1) for p in (0, 1)], "y int, y_hat int")
    out = grid.join(counts, ["y", "y_hat"], "left").select(
        "y", "y_hat", F.coalesce(F.col("n"), F.lit(0).cast("long")).alias("n"))
    tot = F.sum("n").over(Window.partitionBy("y"))
    return out.withColumn("share", F.try_divide(F.col("n").cast("double"), tot.cast("double")))


def _report_aggs(mode: str):
    y, h, zc = F.col("y"), F.col("y_hat"), F.col("z")
    aggs = [
        F.count(F.lit(1)).cast("long").alias("n"),
        F.count_distinct("y").cast("long").alias("n_classes"),
        F.sum(F.when((y == 1) & (h == 1), 1).otherwise(0)).cast("long").alias("tp"),
        F.sum(F.when((y == 0) & (h == 0), 1).otherwise(0)).cast("long").alias("tn"),
        F.sum(F.when((y == 0) & (h == 1), 1).otherwise(0)).cast("long").alias("fp"),
        F.sum(F.when((y == 1) & (h == 0), 1).otherwise(0)).cast("long").alias("fn"),
        F.avg(logloss_expr(y, zc)).alias("ll"),
    ]
    return aggs


def _finish_report(agg: DataFrame, mode: str) -> DataFrame:
    mcc = mcc_expr(F.col("tp"), F.col("tn"), F.col("fp"), F.col("fn"))
    one_class = F.col("n_classes") <= 1
    if mode == "soft":
        agg = agg.withColumn("mcc", F.when(one_class, F.lit(None).cast("double")).otherwise(mcc)).withColumn(
            "log_loss", F.when(one_class, F.lit(None).cast("double")).otherwise(F.col("ll")))
    else:
        agg = agg.withColumn("mcc", mcc).withColumn("log_loss", F.lit(None).cast("double"))
    return agg.drop("ll")


def label_report(pred: DataFrame, truth: DataFrame | Column | None, mode: str = "soft", z: str = "z", seed: int = 42) -> DataFrame:
    """R2: one row with MCC (rounded labels in soft mode) and the log-loss
    (soft); NULL when the truth has only one class (soft mode)."""
    j = _joined(pred, truth, z).withColumn(
        "y_hat", harden_expr("z", "pair_id", seed) if mode == "soft" else F.col("z").cast("int"))
    return _finish_report(j.agg(*_report_aggs(mode)), mode)


def performance_per_iter(trace: DataFrame, truth: DataFrame | Column | None, mode: str = "soft", seed: int = 42) -> DataFrame:
    """R2 grouped by iteration (and start); only sums per group are exchanged unless ``truth`` is a table."""
    keys = [c for c in ("start", "iter") if c in trace.columns]
    j = _joined(trace, truth).withColumn(
        "y_hat", harden_expr("z", "pair_id", seed) if mode == "soft" else F.col("z").cast("int"))
    return _finish_report(j.groupBy(*keys).agg(*_report_aggs(mode)), mode)


def _of_history(history: DataFrame, iters: list[int], start: int, col: str) -> list[Column]:
    """``col`` of the given iterations of a start, a column each (null where it took no part)."""
    at = lambda k: F.filter("history", lambda h: (h["start"] == start) & (h["iter"] == k))
    return [F.get(at(k), F.lit(0))[col].alias(str(k)) for k in iters]


def _iters_of(history: DataFrame, start: int) -> list[int]:
    mine = unrolled(history.select("history")).where(F.col("start") == start)
    return sorted(r[0] for r in mine.select("iter").distinct().collect())  # one number per iteration


def label_evolution(trace: DataFrame, iters: list[int] | None = None, col: str = "z", start: int = 0) -> DataFrame:
    """Pairs x iterations matrix of labels.

    A table with a ``history`` is projected, for one start.  A long trace (of one start) is
    grouped by pair and pivoted, which exchanges pairs by iterations."""
    if "history" in trace.columns:
        iters = _iters_of(trace, start) if iters is None else iters
        return trace.select("pair_id", *_of_history(trace, iters, start, col))
    g = trace.groupBy("pair_id")
    piv = g.pivot("iter", iters) if iters is not None else g.pivot("iter")
    return piv.agg(F.first(col))


def llh_evolution(trace: DataFrame, iters: list[int] | None = None, start: int = 0) -> DataFrame:
    """Per-pair alternative llh across iterations plus the first null llh.

    A table with a ``history`` is projected, for one start; a long trace is grouped by pair."""
    if "history" in trace.columns:
        iters = _iters_of(trace, start) if iters is None else iters
        mine = F.filter("history", lambda h: h["start"] == start)
        first = F.get(F.array_sort(F.transform(mine, lambda h: F.struct(h["iter"], h["null_llh"]))), F.lit(0))
        return trace.select("pair_id", *_of_history(trace, iters, start, "alt_llh"), first["null_llh"].alias("null_llh"))
    if iters is None:
        iters = sorted(r[0] for r in trace.select("iter").distinct().collect())
    at = [F.max(F.when(F.col("iter") == k, F.col("alt_llh"))).alias(str(k)) for k in iters]
    return trace.groupBy("pair_id").agg(*at, F.min_by("null_llh", "iter").alias("null_llh"))


def alt_vs_null(trace: DataFrame) -> DataFrame:
    """Per pair and iteration, the alternative and null llh (scatter data)."""
    keys = [c for c in ("start", "iter") if c in trace.columns]
    return trace.select(*keys, "pair_id", "alt_llh", "null_llh")

"""Contacts: coupling strengths from coefficient tables, average product
correction, top-k, rank metrics, MCC and binarisation.

Every input here is model-sized (La x Lb cells), so these are small
DataFrame aggregations and windows; the position grid is generated from
the kept-position lists with ``sequence``/``explode`` (no cross join).
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from copair.functions.prob import mcc_expr


def position_grid(spark, width_a: int, width_b: int) -> DataFrame:
    """All (pos_a, pos_b) cells of a La x Lb matrix."""
    return spark.range(width_a).select(
        F.col("id").cast("int").alias("pos_a"),
        F.explode(F.sequence(F.lit(0), F.lit(width_b - 1))).alias("pos_b"),
    ) if width_b > 0 else spark.createDataFrame([], "pos_a int, pos_b int")


def coupling_blocks(coefs: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Coefficients regrouped by the opposite position block:
    A-models give (pos_a = pos, pos_b = feat_pos), B-models the transpose."""
    a_rows = coefs.where("side = 'A'").select(*keys, F.col("pos").alias("pos_a"), F.col("feat_pos").alias("pos_b"),
                                              "cls", "feat_aa", "value")
    b_rows = coefs.where("side = 'B'").select(*keys, F.col("feat_pos").alias("pos_a"), F.col("pos").alias("pos_b"),
                                              "cls", "feat_aa", "value")
    return a_rows.unionByName(b_rows)


def couplings(coefs: DataFrame, width_a: int, width_b: int, sets: DataFrame | None = None) -> DataFrame:
    """``strength(i,j) = sqrt(sum coefA_i[:, block j]^2 + sum coefB_j[:, block i]^2)``
    over the full grid (0 where no coefficient), with the ``A{i}:B{j}`` name.

    ``sets`` has a row per model set (such as start and iteration) whose columns
    ``coefs`` has too; each set gets a grid of its own."""
    keys = sets.columns if sets is not None else []
    sums = coupling_blocks(coefs, keys).groupBy(*keys, "pos_a", "pos_b").agg(F.sum(F.col("value") * F.col("value")).alias("ss"))
    if sets is None:
        grid = position_grid(coefs.sparkSession, width_a, width_b)
    else:
        cells = F.explode(F.sequence(F.lit(0), F.lit(width_a * width_b - 1))) if width_a * width_b else F.explode(F.array().cast("array<int>"))
        grid = sets.select(*keys, cells.alias("cell")).select(
            *keys, F.expr(f"int(cell div {max(width_b, 1)})").alias("pos_a"), (F.col("cell") % max(width_b, 1)).cast("int").alias("pos_b"))
    out = grid.join(sums, [*keys, "pos_a", "pos_b"], "left").select(
        *keys, "pos_a", "pos_b", F.sqrt(F.coalesce(F.col("ss"), F.lit(0.0))).alias("strength"))
    return out.withColumn("name", F.concat(F.lit("A"), F.col("pos_a"), F.lit(":B"), F.col("pos_b")))


def apc(cmap: DataFrame, col: str = "strength", out: str = "apc", keys: tuple = ()) -> DataFrame:
    """``c_ij - rowmean_i * colmean_j / mean`` (NULL when the mean is 0), per set of ``keys``.

    One aggregate by grouping sets gives all three kinds of means; they form one row per set
    (a map of the rows', a map of the columns', the whole), which meets the cells by a join
    instead of windows that would sort them three times."""
    cells = cmap.withColumn("__set", F.struct(*keys) if keys else F.lit(0))
    sums = cells.groupingSets([["__set", "pos_a"], ["__set", "pos_b"], ["__set"]], "__set", "pos_a", "pos_b").agg(
        F.avg(col).alias("mean"), F.grouping("pos_a").alias("no_a"), F.grouping("pos_b").alias("no_b"))
    of = lambda kept, pos: F.map_from_entries(F.collect_list(F.when(F.col(kept) == 0, F.struct(pos, "mean"))))
    means = sums.groupBy("__set").agg(of("no_a", "pos_a").alias("of_a"), of("no_b", "pos_b").alias("of_b"),
                                      F.max(F.when((F.col("no_a") == 1) & (F.col("no_b") == 1), F.col("mean"))).alias("of_all"))
    corrected = F.col(col) - F.try_divide(F.col("of_a")[F.col("pos_a")] * F.col("of_b")[F.col("pos_b")], F.col("of_all"))
    return cells.join(means, "__set").withColumn(out, corrected).drop("__set", "of_a", "of_b", "of_all")


def top_contacts(cmap: DataFrame, n: int, col: str = "apc") -> DataFrame:
    """The n largest cells, descending (ties by position); n must be in
    [1, cells].  TakeOrderedAndProject: a bounded top-k, no global sort."""
    if n <= 0:
        raise ValueError(f"n is {n} but must be at least 1")
    return cmap.orderBy(F.col(col).desc(), "pos_a", "pos_b").limit(n)


def contact_metrics(cmap: DataFrame, truth: DataFrame, limit: int = 100, col: str = "apc",
                    n_cells: int | None = None) -> DataFrame:
    """TPR and PPV at each rank 1..limit; the TPR denominator is
    ``min(rank, number of true contacts)``; limit truncated to the cells."""
    if n_cells is None:
        n_cells = cmap.count()
    if limit > n_cells:
        warnings.warn(f"limit {limit} exceeds the {n_cells} cells; all of them are used",
                      RuntimeWarning, stacklevel=2)
        limit = n_cells
    positives = truth.where("is_contact = 1").count()
    top = top_contacts(cmap, limit, col).join(truth.select("pos_a", "pos_b", "is_contact"),
                                              ["pos_a", "pos_b"], "left")
    w = Window.orderBy(F.col(col).desc(), "pos_a", "pos_b")
    run = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    ranked = top.withColumn("rank", F.row_number().over(w)).withColumn(
        "tp", F.sum(F.coalesce(F.col("is_contact"), F.lit(0))).over(run).cast("long"))
    denom = F.least(F.col("rank"), F.lit(positives)).cast("double")
    return ranked.select(
        "rank", "pos_a", "pos_b", "tp",
        F.when(denom > 0, F.col("tp") / denom).alias("tpr"),
        (F.col("tp") / F.col("rank")).alias("ppv"),
    )


def binarize_contacts(cmap: DataFrame, threshold: float = 0.0, col: str = "strength") -> DataFrame:
    """1 where the value is strictly greater than the threshold."""
    return cmap.withColumn("predicted", (F.col(col) > F.lit(threshold)).cast("int"))


def contact_mcc(cmap: DataFrame, truth: DataFrame, col: str = "strength") -> DataFrame:
    """MCC of (value > 0) against the true map, one row."""
    j = binarize_contacts(cmap, 0.0, col).join(truth.select("pos_a", "pos_b", "is_contact"), ["pos_a", "pos_b"])
    y, p = F.col("is_contact"), F.col("predicted")
    agg = j.agg(
        F.sum(F.when((y == 1) & (p == 1), 1).otherwise(0)).cast("long").alias("tp"),
        F.sum(F.when((y == 0) & (p == 0), 1).otherwise(0)).cast("long").alias("tn"),
        F.sum(F.when((y == 0) & (p == 1), 1).otherwise(0)).cast("long").alias("fp"),
        F.sum(F.when((y == 1) & (p == 0), 1).otherwise(0)).cast("long").alias("fn"),
    )
    return agg.withColumn("mcc", mcc_expr(F.col("tp"), F.col("tn"), F.col("fp"), F.col("fn")))

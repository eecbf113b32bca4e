"""Validation as Spark aggregates (one small row reaches the driver) and
argument bounds for the user-facing entry points."""

from __future__ import annotations

import sys
import warnings
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copair.functions.alphabet import ALPHABET


def check_pairs_df(a: DataFrame, b: DataFrame) -> DataFrame:
    """One-row summary for two encoded sides ``(pair_id, codes)``:
    counts, rows present on one side only, identical alignments."""
    j = a.select("pair_id", F.col("codes").alias("ca")).join(
        b.select("pair_id", F.col("codes").alias("cb")), "pair_id", "full_outer"
    )
    return j.agg(
        F.count(F.col("ca")).cast("long").alias("n_a"),
        F.count(F.col("cb")).cast("long").alias("n_b"),
        F.sum(F.when(F.col("ca").isNull(), 1).otherwise(0)).cast("long").alias("missing_a"),
        F.sum(F.when(F.col("cb").isNull(), 1).otherwise(0)).cast("long").alias("missing_b"),
        F.coalesce(F.bool_and(F.col("ca") == F.col("cb")), F.lit(False)).alias("identical"),
    ).withColumn(
        "ok",
        (F.col("n_a") == F.col("n_b")) & (F.col("missing_a") == 0) & (F.col("missing_b") == 0)
        & (F.col("n_a") > 1) & ~F.col("identical"),
    )


def check_pairs(a: DataFrame, b: DataFrame, raise_on_error: bool = True) -> dict:
    r = check_pairs_df(a, b).first().asDict()
    if raise_on_error:
        if r["identical"]:
            raise ValueError("sides A and B hold the same sequences")
        if r["n_a"] != r["n_b"] or r["missing_a"] or r["missing_b"]:
            raise ValueError(f"unpaired rows: A has {r['n_a']} ({r['missing_b']} without B), B has {r['n_b']} ({r['missing_a']} without A)")
        if r["n_a"] <= 1:
            raise ValueError("at least two pairs are needed")
    return r


def unknown_residues(seqs: DataFrame, seq_col: str = "seq", key: str = "pair_id") -> DataFrame:
    """Characters outside the alphabet: ``(ch, n, n_seqs)``.

    Known characters are removed first, so clean rows explode to nothing, and a row
    counts each of its characters once: one aggregation, no distinct."""
    left = F.translate(F.col(seq_col), ALPHABET, "")
    chars = seqs.select(left.alias("s")).where("s <> ''").select("s", F.explode(F.array_distinct(F.split("s", ""))).alias("ch"))
    n = F.length("s") - F.length(F.replace(F.col("s"), F.col("ch"), F.lit("")))
    return chars.where("ch <> ''").groupBy("ch").agg(F.sum(n.cast("long")).alias("n"), F.count(F.lit(1)).cast("long").alias("n_seqs"))


def check_alphabet(encoded: DataFrame, raise_on_error: bool = True) -> dict:
    """Unknown codes (-1) and unequal row lengths per side, one aggregate."""
    r = encoded.agg(
        F.min(F.size("a")).alias("min_a"), F.max(F.size("a")).alias("max_a"),
        F.min(F.size("b")).alias("min_b"), F.max(F.size("b")).alias("max_b"),
        F.sum(F.size(F.filter("a", lambda c: c < 0))).alias("bad_a"),
        F.sum(F.size(F.filter("b", lambda c: c < 0))).alias("bad_b"),
    ).first().asDict()
    if raise_on_error:
        if (r["bad_a"] or 0) + (r["bad_b"] or 0) > 0:
            raise ValueError(f"Unknown residue symbols: {r['bad_a']} in A, {r['bad_b']} in B")
        if r["min_a"] != r["max_a"] or r["min_b"] != r["max_b"]:
            raise ValueError("Sequences of an alignment differ in length")
    return r


def check_counts(counts: DataFrame) -> None:
    """``residue_counts`` of valid sides: no unknown code, and as many rows in every column."""
    per_column = counts.groupBy("side", "orig_pos").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("aa") < 0, F.col("n")).otherwise(0)).alias("bad"))
    rows = per_column.groupBy("side").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.sum("bad").alias("bad")).collect()
    for r in rows:
        if r.bad:
            raise ValueError(f"side {r.side}: {r.bad} residues are not in the alphabet")
        if r.low != r.high:
            raise ValueError(f"side {r.side}: rows differ in length")


def check_contact_map_df(contact_map: DataFrame, profile: DataFrame) -> DataFrame:
    """One-row summary: map size against the alignment widths and 0/1 values."""
    widths = profile.groupBy().agg(
        F.sum(F.when(F.col("side") == "A", 1).otherwise(0)).cast("long").alias("len_a"),
        F.sum(F.when(F.col("side") == "B", 1).otherwise(0)).cast("long").alias("len_b"),
    )
    value = F.coalesce(F.col("value"), F.col("is_contact").cast("double")) if "value" in contact_map.columns \
        else F.col("is_contact").cast("double")
    stats = contact_map.agg(
        F.count(F.lit(1)).cast("long").alias("n_cells"),
        (F.max("pos_a") + 1).cast("long").alias("rows"),
        (F.max("pos_b") + 1).cast("long").alias("cols"),
        F.sum(F.when(~value.isin(0.0, 1.0) | value.isNull(), 1).otherwise(0)).cast("long").alias("bad_values"),
        F.sum(F.when(value == 1.0, 1).otherwise(0)).cast("long").alias("n_contacts"),
    )
    # both sides are one-row aggregates: combine by a constant key, not a cross join
    out = stats.withColumn("_k", F.lit(1)).join(widths.withColumn("_k", F.lit(1)), "_k").drop("_k")
    return out.withColumn(
        "ok",
        (F.col("rows") == F.col("len_a")) & (F.col("cols") == F.col("len_b"))
        & (F.col("n_cells") == F.col("len_a") * F.col("len_b")) & (F.col("bad_values") == 0),
    )


def check_contact_map(contact_map: DataFrame, profile: DataFrame, raise_on_error: bool = True) -> dict:
    r = check_contact_map_df(contact_map, profile).first().asDict()
    if raise_on_error and not r["ok"]:
        raise ValueError(
            f"contact map: {r['rows']} x {r['cols']} cells with {r['bad_values']} values other than 0 and 1; "
            f"the alignments have {r['len_a']} x {r['len_b']} columns"
        )
    return r


@dataclass(frozen=True)
class EMOptions:
    """Argument bounds of the EM entry points (same limits as the reference)."""

    int_frac: float = 0.75
    mode: str = "soft"
    init: str = "warm"
    gap_threshold: float = 0.5
    n_starts: int = 1
    dfmax: int = 100
    max_iters: int = 20
    tol: float = 0.005
    on_unknown: str = "error"  # residues outside the alphabet: 'error', 'gap' or 'quarantine'
    int_limit: int | None = None
    test: bool = False
    predict_contacts: bool = False
    residues: bool = False  # keep the log-probability of every residue, iteration and start
    history: bool = False  # keep every iteration's label and log-likelihoods in the row of the pair
    max_init_iters: int | None = None  # data passes of each round of a path fit; None: until optimal
    max_reg_iters: int | None = None  # data passes of a fixed-alpha M-step; None: until optimal
    fit_tol: float = 1e-5  # largest violation of the optimality conditions of a fitted model
    seed: int = 42

    def __post_init__(self):
        open_unit = lambda v: 0.0 < v < 1.0
        rules = {
            "int_frac": (open_unit, "in (0, 1)"),
            "gap_threshold": (open_unit, "in (0, 1)"),
            "init": (("warm", "random").__contains__, "'warm' or 'random'"),
            "mode": (("hard", "soft").__contains__, "'hard' or 'soft'"),
            "test": (lambda v: isinstance(v, bool), "a boolean"),
            "predict_contacts": (lambda v: isinstance(v, bool), "a boolean"),
            "on_unknown": (("error", "gap", "quarantine").__contains__, "'error', 'gap' or 'quarantine'"),
            "residues": (lambda v: isinstance(v, bool), "a boolean"),
            "history": (lambda v: isinstance(v, bool), "a boolean"),
            "int_limit": (lambda v: v is None or v >= 0, "None or at least 0"),
            "n_starts": (lambda v: v >= 1, "at least 1"),
            "dfmax": (lambda v: v > 1, "above 1"),
            "max_iters": (lambda v: v > 1, "above 1"),
            "tol": (lambda v: v > sys.float_info.epsilon, "above the machine precision"),
            "max_init_iters": (lambda v: v is None or v > 1, "None or above 1"),
            "max_reg_iters": (lambda v: v is None or v > 1, "None or above 1"),
        }
        for name, (holds, allowed) in rules.items():
            value = getattr(self, name)
            if not holds(value):
                raise ValueError(f"option {name} is {value!r} but must be {allowed}")
        if self.test and self.int_limit is None:
            raise ValueError("option test needs int_limit")
        notes = {
            "hard mode has seen less use than soft mode": self.mode == "hard",
            f"dfmax {self.dfmax} lets models grow large": self.dfmax >= 120,
            "int_limit has no effect without test": self.int_limit is not None and not self.test,
            "few passes: models may stay short of their optimum": any(
                v is not None and v < 100 for v in (self.max_init_iters, self.max_reg_iters)),
        }
        for text, holds in notes.items():
            if holds:
                warnings.warn(text, RuntimeWarning, stacklevel=2)

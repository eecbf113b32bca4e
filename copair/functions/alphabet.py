"""Residue alphabet and the column expressions that encode sequences.

Fixed values (must equal the reference's for identical results):
  amino-acid order, code = index in this string, gap last:
      ARNDCEQGHILKMFPSTWYV-
  gap code: 20; one-hot width per position: 20 (the gap has no indicator)
  regularisation strengths, strongest first:
      40, 30, 20, 10, and 15 values spaced evenly in log10 from 1 down to 0.001
  l1 ratio of the elastic net: 0.99; default maximum degrees of freedom: 100
  pseudocount for the coevolution model: ln(1/210)
  pseudocount for the independence model: 1/2100
  probability of a constant-column model: 0.99 - 1/210
  alpha recorded for a constant-column model: 0.01
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

ALPHABET = "ARNDCEQGHILKMFPSTWYV-"
GAP = 20
N_AA = 20  # one-hot width per position
N_CODES = 21

ALPHA_PATH = [40.0, 30.0, 20.0, 10.0] + [float(v) for v in np.logspace(0, -3, 15)]
L1_RATIO = 0.99
DFMAX = 100
PC_ALT = math.log(1.0 / 210.0)
PC_NULL = 1.0 / 2100.0
CONSTANT_PROB = 0.99 - 1.0 / 210.0
CONSTANT_ALPHA = 0.01


def encode_expr(seq: Column | str, unknown: int = -1) -> Column:
    """STRING -> ARRAY<TINYINT>: code of each character, ``unknown`` when it is not in the alphabet."""
    s = F.col(seq) if isinstance(seq, str) else seq
    def code(i: Column) -> Column:
        at = F.instr(F.lit(ALPHABET), F.substring(s, i, 1)) - 1
        return (at if unknown == -1 else F.when(at >= 0, at).otherwise(F.lit(unknown))).cast("tinyint")

    codes = F.transform(F.sequence(F.lit(1), F.length(s)), code)
    return F.when(F.length(s) > 0, codes).otherwise(F.array().cast("array<tinyint>"))


def project_expr(codes: Column | str, keep: list[int]) -> Column:
    """Keep the listed (0-based) positions of a code array, in order."""
    c = F.col(codes) if isinstance(codes, str) else codes
    if not keep:
        return F.array().cast("array<tinyint>")
    return F.array(*[c[k] for k in keep])


def one_hot_expr(codes: Column | str) -> Column:
    """Sparse one-hot feature ids ``pos*20 + aa`` for non-gap residues."""
    c = F.col(codes) if isinstance(codes, str) else codes
    ids = F.transform(c, lambda x, p: F.when(x < N_AA, p * N_AA + x.cast("int")))
    return F.filter(ids, lambda v: v.isNotNull())

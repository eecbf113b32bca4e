"""Paired alignments derived from the ``documents`` table.

The test tables carry no sequence data, so each document becomes one pair
of 13-column alignment rows computed from letter counts over the WHOLE
text (no prefixes):

  s          = upper(ASCII letters of text); cnt(x) = occurrences of letter x in s
  m(p)       = 2 if p % 4 = 3, else 4
  side A, column p < 12 : '-' if cnt(LA[p]) = 0, else residue cnt(LA[p]) % m(p)
  side B, column q < 12 : '-' if cnt(LB[q]) = 0; else residue 5 + cnt(LA[q]) % m(q) if the pair
                          interacts (pair_id % 4 <> 0) and cnt(LA[q]) > 0, else 5 + cnt(LB[q]) % m(q)
  column 12             : one residue everywhere (a constant column on both sides)

Rare letters give gappy columns, three of four pairs carry the planted couplings
(q, q) and the others do not, so fits, EM and contacts have something to find.
The same derivation is written in SQL for the DuckDB oracle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the derivation (shared with the oracle SQL).
LETTERS_A = "ABCDEFGHIJKL"
LETTERS_B = "MNOPQRSTUVWX"
RESIDUES_20 = "ARNDCEQGHILKMFPSTWYV"


def letter_counts(texts: pa.Array) -> pa.Array:
    """How often each of ``LETTERS_A + LETTERS_B`` occurs in every text, in either case; null: never."""
    letters = LETTERS_A + LETTERS_B
    place = np.full(256, len(letters), dtype=np.uint8)  # of a UTF-8 byte; those of other characters are no ASCII letters
    for i, letter in enumerate(letters):
        place[[ord(letter), ord(letter.lower())]] = i
    data = texts.fill_null("").cast(pa.large_binary())
    ends = np.frombuffer(data.buffers()[1], np.int64)[data.offset:data.offset + len(data) + 1]
    octets = np.frombuffer(data.buffers()[2] or b"", np.uint8)
    out = np.zeros((len(data), len(letters)), dtype=np.int32)
    for row, lo, hi in zip(out, ends[:-1].tolist(), ends[1:].tolist()):
        row[:] = np.bincount(place[octets[lo:hi]], minlength=len(letters) + 1)[:-1]
    return pa.ListArray.from_arrays(pa.array(np.arange(len(data) + 1, dtype=np.int32) * len(letters)), pa.array(out.ravel()))


def interacts() -> Column:
    """Pairs that carry the planted couplings."""
    return F.col("pair_id") % 4 != 0


def _letter(code: Column) -> Column:
    return F.substring(F.lit(RESIDUES_20), (code + 1).cast("int"), 1)


def alignment_from_documents(documents: DataFrame) -> DataFrame:
    """``documents(doc_id, text, ...)`` -> ``(pair_id, seq_a, seq_b)``; a null text is all gaps."""
    counted = F.arrow_udf(letter_counts, "array<int>")
    base = documents.select(F.col("doc_id").cast("long").alias("pair_id"), counted("text").alias("counts"))
    cols_a, cols_b = [], []
    for p in range(len(LETTERS_A)):
        m = 2 if p % 4 == 3 else 4
        ca, cb = F.col("counts")[p], F.col("counts")[len(LETTERS_A) + p]
        cols_a.append(F.when(ca == 0, F.lit("-")).otherwise(_letter(ca % m)))
        cols_b.append(F.when(cb == 0, F.lit("-")).when(interacts() & (ca > 0), _letter(5 + ca % m)).otherwise(_letter(5 + cb % m)))
    return base.select("pair_id", F.concat(*cols_a, _letter(F.lit(0))).alias("seq_a"),
                       F.concat(*cols_b, _letter(F.lit(5))).alias("seq_b"))


def load_table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

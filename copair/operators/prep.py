"""Preprocessing: encode, column statistics, gappy/constant column filters,
one-hot features and contact-map alignment.

One aggregation pass computes ``(side, orig_pos, aa) -> count`` with
map-side partial aggregation (at most 21 x (La+Lb) groups per task), from
which gap frequency and the number of distinct codes of every column
follow.  The kept-position list is schema-sized (bounded by the
alignment width, not by the number of pairs), so it is collected and
applied as a narrow array projection on the wide row: no join, no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from copair.functions.alphabet import GAP, encode_expr, one_hot_expr, project_expr
from copair.session import stored

MAX_WIDTH = 100_000  # positions per side that may be handled as a driver-side list


@dataclass
class Prepared:
    pairs: DataFrame  # (pair_id, a ARRAY<TINYINT>, b ARRAY<TINYINT>) dense kept positions
    positions: DataFrame  # (side, orig_pos, pos, gap_freq, n_codes, gappy, constant, kept)
    kept_a: list[int]
    kept_b: list[int]
    contact_map: DataFrame | None = None  # (pos_a, pos_b, is_contact) dense positions
    rejected: DataFrame | None = None  # (pair_id, seq_a, seq_b) set aside by on_unknown='quarantine'

    @property
    def width_a(self) -> int:
        return len(self.kept_a)

    @property
    def width_b(self) -> int:
        return len(self.kept_b)


#: What becomes of residues outside the alphabet.
ON_UNKNOWN = ("error", "gap", "quarantine")


def encode_pairs(aligned: DataFrame, on_unknown: str = "error") -> DataFrame:
    """``(pair_id, seq_a, seq_b)`` -> ``(pair_id, a, b)`` raw codes (orig positions); unknown residues
    are -1, or gaps with ``on_unknown='gap'``."""
    unknown = GAP if on_unknown == "gap" else -1
    return aligned.select(
        F.col("pair_id").cast("long"),
        encode_expr("seq_a", unknown).alias("a"),
        encode_expr("seq_b", unknown).alias("b"),
    )


def stored_pairs(aligned: DataFrame, on_unknown: str = "error") -> tuple[DataFrame, DataFrame | None]:
    """``encode_pairs``, written once, and the pairs set aside.

    ``on_unknown='quarantine'`` puts pairs with an unknown residue on either side, whole, into a
    partition of their own, ``(pair_id, seq_a, seq_b)``: one pass writes both, and sides stay paired."""
    if on_unknown not in ON_UNKNOWN:
        raise ValueError(f"option on_unknown is {on_unknown!r} but must be one of {ON_UNKNOWN}")
    if on_unknown != "quarantine":
        return stored(encode_pairs(aligned, on_unknown)), None
    strange = lambda c: F.exists(c, lambda x: x < 0)
    encoded = aligned.select(F.col("pair_id").cast("long"), encode_expr("seq_a").alias("a"), encode_expr("seq_b").alias("b"),
                             "seq_a", "seq_b").withColumn("rejected", strange(F.col("a")) | strange(F.col("b")))
    out = F.col("rejected")
    both = stored(encoded.select("pair_id", F.when(~out, F.col("a")).alias("a"), F.when(~out, F.col("b")).alias("b"),
                                 F.when(out, F.col("seq_a")).alias("seq_a"), F.when(out, F.col("seq_b")).alias("seq_b"),
                                 F.coalesce(out, F.lit(False)).cast("int").alias("rejected")), "rejected")
    return both.where("rejected = 0").select("pair_id", "a", "b"), both.where("rejected = 1").select("pair_id", "seq_a", "seq_b")


def long_view(pairs: DataFrame, pos_name: str = "pos") -> DataFrame:
    """Wide pairs -> ``(pair_id, side, pos, aa)``; derived on demand."""
    sides = F.inline(
        F.array(
            F.struct(F.lit("A").alias("side"), F.col("a").alias("codes")),
            F.struct(F.lit("B").alias("side"), F.col("b").alias("codes")),
        )
    )
    return pairs.select("pair_id", sides).select(
        "pair_id", "side", F.posexplode("codes").alias(pos_name, "aa")
    ).select("pair_id", "side", F.col(pos_name).cast("int"), F.col("aa").cast("int"))


def residue_counts(encoded: DataFrame) -> DataFrame:
    """``(side, orig_pos, aa, n)``: count per column and code; partial
    aggregation keeps the shuffle schema-sized."""
    lv = long_view(encoded, "orig_pos")
    return lv.groupBy("side", "orig_pos", "aa").agg(F.count(F.lit(1)).cast("long").alias("n"))


def column_profile(counts: DataFrame, gap_threshold: float = 0.5) -> DataFrame:
    """Per column: gap frequency, distinct codes (gap counts as a code),
    gappy (``gap_freq >= thr``), constant (one code), kept, and the dense
    position ``pos`` (re-based over kept columns)."""
    if not 0.0 < gap_threshold < 1.0:
        raise ValueError(f"gap_threshold is {gap_threshold} but must be in (0, 1)")
    prof = counts.groupBy("side", "orig_pos").agg(
        (F.sum(F.when(F.col("aa") == GAP, F.col("n")).otherwise(0)) / F.sum("n")).alias("gap_freq"),
        F.count(F.lit(1)).cast("long").alias("n_codes"),
    )
    prof = prof.withColumn("gappy", F.col("gap_freq") >= F.lit(gap_threshold)).withColumn(
        "constant", F.col("n_codes") == 1
    )
    prof = prof.withColumn("kept", ~F.col("gappy") & ~F.col("constant"))
    w = Window.partitionBy("side", "kept").orderBy("orig_pos")
    return prof.withColumn(
        "pos", F.when(F.col("kept"), (F.row_number().over(w) - 1).cast("int"))
    ).select("side", F.col("orig_pos").cast("int"), "pos", "gap_freq", "n_codes", "gappy", "constant", "kept")


def kept_positions(profile: DataFrame) -> tuple[list[int], list[int]]:
    """Collect the schema-sized kept lists; raise like the reference when a
    side has no column left after the gap or the constant filter."""
    rows = profile.select("side", "orig_pos", "gappy", "constant", "kept").limit(2 * MAX_WIDTH + 1).collect()
    if len(rows) > 2 * MAX_WIDTH:
        raise ValueError(f"alignments have more than {MAX_WIDTH} columns a side")
    out = {}
    for side in ("A", "B"):
        srows = [r for r in rows if r.side == side]
        if not srows:
            raise ValueError(f"side {side} has no columns")
        non_gappy = [r for r in srows if not r.gappy]
        if not non_gappy:
            raise ValueError(
                f"side {side}: no column is below the gap threshold"
            )
        if all(r.constant for r in non_gappy):
            raise ValueError(f"side {side}: every column below the gap threshold is constant")
        out[side] = sorted(r.orig_pos for r in srows if r.kept)
    return out["A"], out["B"]


def project_pairs(encoded: DataFrame, kept_a: list[int], kept_b: list[int], *extra: str) -> DataFrame:
    """Narrow projection of the wide rows onto kept columns."""
    return encoded.select(
        "pair_id",
        project_expr("a", kept_a).alias("a"),
        project_expr("b", kept_b).alias("b"),
        *extra,
    )


def one_hot(pairs: DataFrame) -> DataFrame:
    """``(pair_id, feat_a ARRAY<INT>, feat_b ARRAY<INT>)``: sparse one-hot ids
    ``pos*20+aa`` (gap = no feature)."""
    return pairs.select("pair_id", one_hot_expr("a").alias("feat_a"), one_hot_expr("b").alias("feat_b"))


def one_hot_long(pairs: DataFrame) -> DataFrame:
    """Sink form of the binary matrices: ``(pair_id, side, feature)``."""
    oh = one_hot(pairs)
    return oh.select(
        "pair_id",
        F.inline(
            F.array(
                F.struct(F.lit("A").alias("side"), F.col("feat_a").alias("f")),
                F.struct(F.lit("B").alias("side"), F.col("feat_b").alias("f")),
            )
        ),
    ).select("pair_id", "side", F.explode("f").alias("feature"))


def align_contact_map(contact_map: DataFrame, profile: DataFrame) -> DataFrame:
    """Drop removed positions from a contact map: two broadcast inner joins
    on original positions (both sides are schema-sized) -> dense positions."""
    ka = profile.where("side = 'A' AND kept").select(F.col("orig_pos").alias("pos_a"), F.col("pos").alias("new_a"))
    kb = profile.where("side = 'B' AND kept").select(F.col("orig_pos").alias("pos_b"), F.col("pos").alias("new_b"))
    return (
        contact_map.join(F.broadcast(ka), "pos_a")
        .join(F.broadcast(kb), "pos_b")
        .select(F.col("new_a").alias("pos_a"), F.col("new_b").alias("pos_b"), F.col("is_contact").cast("int"))
    )


def preprocess(aligned: DataFrame, gap_threshold: float = 0.5, contact_map: DataFrame | None = None,
               check: bool = True, on_unknown: str = "error") -> Prepared:
    """Both sides: encode -> column statistics -> drop gappy then constant
    columns -> dense wide rows; optionally align a contact map (validated first).

    The encoded pairs are written once; every consumer reads them.  ``on_unknown`` says what
    becomes of residues outside the alphabet: an error, gaps, or their pairs in ``rejected``."""
    from copair.operators.checks import check_contact_map, check_counts

    encoded, rejected = stored_pairs(aligned, on_unknown)
    # one scan: unknown codes (-1) and unequal lengths show in the same counts
    counts = residue_counts(encoded).cache()
    if check:
        check_counts(counts)
    profile = column_profile(counts, gap_threshold).cache()
    kept_a, kept_b = kept_positions(profile)
    pairs = project_pairs(encoded, kept_a, kept_b)
    aligned_map = None
    if contact_map is not None:
        if check:
            check_contact_map(contact_map, profile, raise_on_error=True)
        aligned_map = align_contact_map(contact_map, profile)
    return Prepared(pairs, profile, kept_a, kept_b, aligned_map, rejected)

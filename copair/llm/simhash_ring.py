"""SimHash near-duplicates found by pigeonring filtering.

Fingerprint: words of the whole text, ``width``-word shingles with repeats, a
64-bit XXH64 (seed 42) per shingle, majority vote per bit.  Two fingerprints
link at ``max_bits`` (3) or fewer differing bits.

Candidate search.  A fingerprint is a ring of four 16-bit segments.  If two
fingerprints differ in at most 3 bits, then the pigeonring principle gives a
segment from which EVERY chain of l consecutive segments differs in at most
floor(3 l / 4) bits: 0, 1, 2, 3 bits for l = 1, 2, 3, 4.  So

* the first segment of the chain is equal (16 key bits), and
* the second differs in at most one bit, hence one of its halves is equal
  (8 more key bits).

That gives eight 24-bit keys per distinct fingerprint, complete by proof.  The
join tests the whole chain before the full Hamming distance.  A key shared by
more than ``hot_rows`` fingerprints is split by a further piece: the other 40
bits hold at most 3 differences, so of four 10-bit parts one is equal; this
replaces the hot key by four longer ones and loses no pair (``_split_hot``).
Equal fingerprints are merged before the search, so copies cost one row.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copair.llm.common import identified, written
from copair.llm.components import components

SEGMENTS = 4
SEGMENT_BITS = 64 // SEGMENTS
#: XXH64 seed of the fingerprint's definition (fixed value).
SEED = 42
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str | None, width: int = 3) -> int:
    """Unsigned 64-bit SimHash of a whole text; no words or null: 0."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = list(accumulate(len(w) + 1 for w in words))
        digest = xxhash.xxh64_intdigest
        starts = [0, *ends]
        hashes = [digest(joined[s:e - 1], SEED) for s, e in zip(starts, ends[width - 1:])]
    bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint_column(text: str, width: int = 3) -> Column:
    """The fingerprint as a signed long column."""

    @F.pandas_udf("long")
    def signed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            values = np.array([fingerprint(t, width) for t in texts], dtype=np.uint64)
            yield pd.Series(values.view(np.int64))

    return signed(F.col(text))


def _piece(fp: Column, start: int, bits: int) -> Column:
    """Bits ``start .. start+bits-1`` of the ring, as a long."""
    start %= 64
    low = F.shiftrightunsigned(fp, start)
    if start + bits > 64:
        low = low.bitwiseOR(F.shiftleft(fp, 64 - start))
    return low.bitwiseAND(F.lit((1 << bits) - 1))


def _segment(fp: Column, i: int) -> Column:
    return _piece(fp, SEGMENT_BITS * i, SEGMENT_BITS)


def _chain_ok(x: Column, i: int, max_bits: int) -> Column:
    """Every chain from segment ``i`` stays within its proportional budget."""
    test, total = F.lit(True), F.lit(0)
    for length in range(1, SEGMENTS + 1):
        total = total + F.bit_count(_segment(x, i + length - 1))
        test = test & (total <= F.lit(max_bits * length // SEGMENTS))
    return test


def _keys(nodes: DataFrame) -> DataFrame:
    """``(fp)`` -> ``(fp, seg, key)``: eight keys, one per segment and half of the next one."""
    fp = F.col("fp")
    half = SEGMENT_BITS // 2
    made = [
        F.struct(
            F.lit(i).alias("seg"),
            F.shiftleft(_segment(fp, i), half).bitwiseOR(_piece(fp, SEGMENT_BITS * (i + 1) + half * h, half))
            .bitwiseOR(F.lit((2 * i + h) << 24)).alias("key"),
            F.lit(SEGMENT_BITS * (i + 1) + half * (1 - h)).alias("rest"),
        )
        for i in range(SEGMENTS) for h in range(2)
    ]
    return nodes.select("fp", F.explode(F.array(*made)).alias("k")).select("fp", "k.seg", "k.key", "k.rest")


def _split_hot(keys: DataFrame, hot_rows: int) -> DataFrame:
    """Lengthen keys shared by more than ``hot_rows`` fingerprints.

    Outside a key's 24 bits lie 40 bits: the other half of the next segment and
    two whole segments.  At most 3 of them differ, so one of four 10-bit parts
    is equal: the four longer keys still find every pair.
    """
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_rows).select("key")
    if sizes.isEmpty():
        return keys.select("fp", "seg", "key", F.lit(-1).alias("part"), F.lit(0).cast("long").alias("more"))
    fp = F.col("fp")
    rests = []
    for i in range(SEGMENTS):
        for h in range(2):
            other = _piece(fp, SEGMENT_BITS * (i + 1) + SEGMENT_BITS // 2 * (1 - h), SEGMENT_BITS // 2)
            far = _piece(fp, SEGMENT_BITS * (i + 2), 2 * SEGMENT_BITS)
            whole = F.shiftleft(far, SEGMENT_BITS // 2).bitwiseOR(other)
            rests.append(F.when(F.shiftright("key", 24) == 2 * i + h, whole))
    rest = F.coalesce(*rests)
    hot = keys.join(sizes, "key", "left_semi").withColumn("whole", rest)
    cold = keys.join(sizes, "key", "left_anti")
    parts = F.array(*[F.struct(F.lit(p).alias("part"), _piece(F.col("whole"), 10 * p, 10).alias("more"))
                      for p in range(4)])
    longer = hot.select("fp", "seg", "key", F.explode(parts).alias("p")).select("fp", "seg", "key", "p.part", "p.more")
    return cold.select("fp", "seg", "key", F.lit(-1).alias("part"), F.lit(0).cast("long").alias("more")).unionByName(longer)


def links(nodes: DataFrame, max_bits: int = 3, hot_rows: int = 2000) -> DataFrame:
    """``(fp)`` distinct -> ``(u, v)``: pairs with 1 .. ``max_bits`` differing bits, ``u > v``.

    The budgets above are those of ``max_bits`` <= 3 with four segments.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("max_bits must lie in 0..3 with four ring segments")
    keys = _split_hot(written(_keys(nodes)), hot_rows)
    left, right = keys.alias("l"), keys.alias("r")
    x = F.col("l.fp").bitwiseXOR(F.col("r.fp"))
    chain = F.lit(False)
    for i in range(SEGMENTS):
        chain = chain | ((F.col("l.seg") == i) & _chain_ok(x, i, max_bits))
    same = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in ("key", "part", "more", "seg")]
    test = same[0] & same[1] & same[2] & same[3] & (F.col("l.fp") > F.col("r.fp")) & chain & (F.bit_count(x) <= max_bits)
    return left.join(right, test).select(F.col("l.fp").alias("u"), F.col("r.fp").alias("v")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3,
                    max_bits: int = 3, hot_rows: int = 2000, carry: Iterable[Column] = ()) -> DataFrame:
    """One row per document: ``(id, fp, root, component_id)`` and the columns of ``carry``.

    ``fp`` is the fingerprint as a signed long, ``root`` the smallest fingerprint
    reachable over links and ``component_id`` the smallest id reachable (null if
    every id of the component is null).  Null and empty texts have fingerprint 0
    and link like any other; repeated rows stay repeated; an empty table gives an
    empty result; other columns are not read.
    """
    prints = written(docs.select(F.col(id_col).alias("id"), fingerprint_column(text_col, width).alias("fp"), *carry))
    nodes = written(prints.groupBy("fp").agg(F.min("id").alias("low")))
    found = components(links(nodes.select("fp"), max_bits, hot_rows))
    roots = nodes.join(found, F.col("fp") == F.col("node"), "left").select(
        "fp", "low", F.coalesce("component", "fp").alias("root"))
    lows = roots.groupBy("root").agg(F.min("low").alias("component_id"))
    by_fp = written(roots.join(lows, "root").select("fp", "root", "component_id"))
    others = [c for c in prints.columns if c not in ("id", "fp")]
    return prints.join(by_fp, "fp").select("id", "fp", "root", "component_id", *others)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3,
             max_bits: int = 3) -> DataFrame:
    """The rows of ``docs``, all columns, with one document of each near-duplicate group.

    The row whose id is the group's smallest stays (among repeated rows of that
    id one of them; in a group without ids one row).  Rows carry their identity,
    so ids may repeat or be null: decisions are per row.
    """
    rows, names = identified(docs)
    digest = F.xxhash64(text_col).alias("__digest")  # a row's place alone would depend on the input's files
    groups = near_duplicates(rows, id_col, text_col, width, max_bits, carry=(*map(F.col, names), digest))
    kept = groups.where("id <=> component_id").groupBy("root").agg(F.min(F.struct("__digest", *names)).alias("first"))
    return rows.join(kept.select(*[F.col(f"first.{c}") for c in names]), names, "left_semi").select(*docs.columns)

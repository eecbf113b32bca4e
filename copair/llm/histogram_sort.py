"""Sharding by histogram sort: exact byte counts below probes, then one exchange.

Every row has a 64-bit sort key whose upper 40 bits are a hash of its text and
whose lower 24 bits are a hash of its id: equal texts are neighbours, and a group
of copies with a third of all rows can still be cut between its rows.

``find_splitters`` keeps a bracket of keys per wanted boundary.  Each pass counts,
map side and exactly, the bytes and rows below every probe of every bracket (a
task returns one row per probe gap, whatever its size), and narrows the brackets
to the gap that holds the target.  A boundary is done when it is within tolerance;
probes fall on group borders while brackets are wide, so a group of equal texts
is cut only where it is larger than the tolerance.

With the splitters known, each row's range follows from its key, and the rows are
exchanged once.  Shards consist of several ranges, and the exact row counts per
range give every row its slot, so no task sees a whole shard.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from copair.llm.common import free_name, tasks_for, written

SHARDS = 8
_ID_BITS = 24
_LOW, _HIGH = -(1 << 63), 1 << 63


def byte_size(text: Column) -> Column:
    """UTF-8 bytes plus 1 (null: none)."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def sort_key(text: Column, key: Column) -> Column:
    mask = (1 << _ID_BITS) - 1
    of_text = F.xxhash64(F.coalesce(text, F.lit(""))).bitwiseAND(F.lit(~mask))
    return of_text.bitwiseOR(F.xxhash64(key.cast("string")).bitwiseAND(F.lit(mask)))


def histogram(keyed: DataFrame, probes: np.ndarray) -> pd.DataFrame:
    """Exact ``bytes`` and ``rows`` per gap between sorted probes, and each gap's extreme keys."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(probes) + 1
        size, rows = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        low, high = np.full(n, _HIGH - 1, dtype=np.int64), np.full(n, _LOW, dtype=np.int64)
        for batch in batches:
            key, weight = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            gap = np.searchsorted(probes, key, side="right")
            np.add.at(size, gap, weight)
            rows += np.bincount(gap, minlength=n)
            np.minimum.at(low, gap, key)
            np.maximum.at(high, gap, key)
        used = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(a[used]) for a in (np.arange(n), size, rows, low, high)],
                                         names=["gap", "bytes", "rows", "low", "high"])

    parts = keyed.select("key", "size").mapInArrow(count, "gap long, bytes long, rows long, low long, high long")
    return parts.groupBy("gap").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"), F.min("low").alias("low"),
                                    F.max("high").alias("high")).orderBy("gap").toPandas()


@dataclass
class _Bracket:
    target: float
    tolerance: float
    low: int = _LOW
    high: int = _HIGH
    below_low: int = 0
    below_high: int = 0
    found: int | None = None

    def probes(self, n: int) -> list[int]:
        width = self.high - self.low
        step = max(1, width // (n + 1))
        made = {self.low + step * (i + 1) for i in range(n)}
        if step >= 1 << _ID_BITS:  # on borders between texts
            made = {p >> _ID_BITS << _ID_BITS for p in made}
        return sorted(p for p in made if self.low < p < self.high)

    def take(self, key: int, below: int) -> None:
        """Use an exact count of bytes below ``key``."""
        if below <= self.target and key >= self.low:
            self.low, self.below_low = key, below
        elif below > self.target and key <= self.high:
            self.high, self.below_high = key, below

    def settle(self) -> None:
        err_low, err_high = self.target - self.below_low, self.below_high - self.target
        if min(err_low, err_high) <= self.tolerance or self.high - self.low <= 1:
            self.found = self.low if err_low <= err_high else self.high


def find_splitters(keyed: DataFrame, ranges: int, per_shard: int, tolerance: float = 0.001,
                   most_probes: int = 1 << 20) -> np.ndarray:
    """Sorted splitters that cut ``(key, size)`` into ``ranges`` ranges of nearly equal bytes.

    Every ``per_shard``-th splitter ends a shard and meets ``tolerance`` (a share of
    a shard's bytes) or the smallest possible error; the others meet a fifth of a range.
    """
    whole = histogram(keyed, np.empty(0, dtype=np.int64))
    total = int(whole["bytes"].sum())
    if not total:
        return np.empty(0, dtype=np.int64)
    first, last = int(whole["low"].iloc[0]), int(whole["high"].iloc[0]) + 1
    shards = ranges // per_shard
    probes = max(3, min(32, most_probes // ranges))  # bounds what a pass sends to its tasks
    open_ = [_Bracket(total * j / ranges, tolerance * total / shards if j % per_shard == 0 else 0.2 * total / ranges,
                      first, last, 0, total) for j in range(1, ranges)]
    everything = list(open_)
    while open_:
        points = np.array(sorted({p for b in open_ for p in b.probes(probes)}), dtype=np.int64)
        found = histogram(keyed, points)
        size = np.zeros(len(points) + 1, dtype=np.int64)
        size[found["gap"]] = found["bytes"]
        below = np.cumsum(size)
        # besides the probes, the extreme keys of a gap are exact borders
        borders = [(int(p), int(b)) for p, b in zip(points, below)]
        for g, low, high in zip(found["gap"], found["low"], found["high"]):
            borders.append((int(low), int(below[g] - size[g])))
            borders.append((int(high) + 1, int(below[g])))
        borders.sort()
        keys = [k for k, _ in borders]
        sums = np.array([b for _, b in borders])
        for bracket in open_:
            at = int(np.searchsorted(sums, bracket.target, side="right"))
            for i in (at - 1, at):
                if 0 <= i < len(keys):
                    bracket.take(*borders[i])
            bracket.settle()
        open_ = [b for b in open_ if b.found is None]
    return np.array([min(b.found, _HIGH - 1) for b in everything], dtype=np.int64)


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS,
          bytes_per_range: int = 64 << 20, tolerance: float = 0.001) -> DataFrame:
    """``docs`` plus ``__shard int`` and ``__slot long`` (gapless from 0), exchanged once.

    Shards have nearly equal bytes.  A task of the exchange has one range, which holds about
    ``bytes_per_range``.  Null texts count 1 byte, and null ids are an id of their own; ties (repeated rows
    of one id and text) are one indivisible key, whose rows have different slots; very long
    texts are never cut, so a range may exceed its bytes by one; an empty table gives no rows.
    Where ``docs`` has a column of such a name, the added name is lengthened by underscores;
    the added columns are the last two.
    """
    key, place, nth = (free_name(docs, c) for c in ("__key", "__place", "__nth"))
    shard_col, slot = free_name(docs, "__shard"), free_name(docs, "__slot")
    keyed = docs.withColumn(key, sort_key(F.col(text_col), F.col(id_col)))
    narrow = written(keyed.select(F.col(key).alias("key"), byte_size(F.col(text_col)).alias("size")))
    total = narrow.agg(F.sum("size")).first()[0] or 0
    per_shard = tasks_for(total, bytes_per_range * shards)
    ranges = per_shard * shards
    splitters = np.sort(find_splitters(narrow, ranges, per_shard, tolerance))
    exact = histogram(narrow, splitters)
    rows = np.zeros(ranges, dtype=np.int64)
    rows[exact["gap"]] = exact["rows"]
    by_shard = rows.reshape(shards, per_shard)
    before = (np.cumsum(by_shard, axis=1) - by_shard).ravel()  # rows of the shard in earlier ranges

    @F.pandas_udf("range int, before long")
    def place_of(keys: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(splitters, keys.to_numpy(), side="right")
        return pd.DataFrame({"range": at.astype(np.int32), "before": before[at]})

    dealt = keyed.withColumn(place, place_of(key)).repartitionById(ranges, F.col(f"{place}.range"))
    within = Window.partitionBy(F.col(f"{place}.range")).orderBy(key, id_col)
    numbered = dealt.withColumn(nth, F.row_number().over(within) - 1)
    return numbered.select(*docs.columns, F.expr(f"int({place}.range div {per_shard})").alias(shard_col),
                           (F.col(f"{place}.before") + F.col(nth)).alias(slot))


def write_shards(sharded: DataFrame, path: str) -> None:
    """Files of each shard under ``path/<shard column>=<n>``; the last two columns are shard and slot."""
    shard_col, slot = sharded.columns[-2:]
    sharded.drop(slot).write.partitionBy(shard_col).parquet(path)

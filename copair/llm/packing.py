"""Best-fit packing of tokenized documents with swap-based local search.

1. ``token_pieces``: one map-only pass tokenizes whole texts and cuts only
   documents of more than ``capacity`` tokens.
2. ``pack``: pieces are ordered by a hash of their values and cut into groups of
   ``group_rows``, so no key of the data decides a group's size and no file or
   partition decides a layout.  Each group starts from best-fit decreasing and
   improves it by local search: a document moves, or one is exchanged for one, or
   two for one, whenever that increases the sum of squared fills; emptied bins
   vanish.  The search ends when no step of its neighbourhood helps (see
   ``local_search``) or at the group's lower bound.
3. The pieces of each group's clearly underfull bins are pooled and packed
   again across groups, which recovers the partly filled bins that every group
   leaves, until they fit one group or a round saves nothing.

Only integers are shuffled; texts and token ids stay in the scan's tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copair.llm.common import ranked, written
from copair.llm.word_tokens import WordEncoder

_DOCS_AT_ONCE = 256


def token_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                 capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32[, ids])``: a row per piece, in one pass.

    A document is its ids and ``end_id``; a null or empty text is ``end_id`` alone.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    end = np.array([end_id], dtype="<u4").tobytes()
    step = 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.at(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, _DOCS_AT_ONCE):
                part = batch.slice(at, _DOCS_AT_ONCE)
                out: list[list] = [[] for _ in range(6)]
                for key, raw in zip(part.column(0).to_pylist(), encoder.encode(part.column(1).to_pylist())):
                    raw += end
                    for k in range(0, len(raw), step):
                        piece = raw[k:k + step]
                        for col, v in zip(out, (key, k // step, k // 4, len(piece) // 4, zlib.crc32(piece))):
                            col.append(v)
                        if with_ids:
                            out[5].append(np.frombuffer(piece, dtype="<u4").astype(np.int64))
                arrays = [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    arrays.append(pa.array(out[5], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return read.mapInArrow(cut, schema)


# ---------------------------------------------------------------------------
# one group
# ---------------------------------------------------------------------------

def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Martello and Toth's bound L2 on the number of bins."""
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1)
    n_to, sum_to = np.cumsum(count), np.cumsum(count * np.arange(capacity + 1))
    half, best = capacity // 2, 0
    for p in range(half + 1):
        n12 = n_to[capacity] - n_to[half]
        n2, s2 = n_to[capacity - p] - n_to[half], sum_to[capacity - p] - sum_to[half]
        s3 = sum_to[half] - (sum_to[p - 1] if p else 0)
        best = max(best, int(n12 + max(0, -(-(s3 - (n2 * capacity - s2)) // capacity))))
    return best


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing; ``lengths`` is in decreasing order.  Returns bins of positions."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    rooms = 0  # bit r is set if a bin has room r
    for i, n in enumerate(lengths):
        high = rooms >> n
        if high:
            room = n + (high & -high).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
            bins[b].append(i)
            room -= n
        else:
            b, room = len(bins), capacity - n
            bins.append([i])
        if room:
            by_room.setdefault(room, []).append(b)
            rooms |= 1 << room
    return bins


class _Open:
    """Underfull bins of a group, with an index from a length to the bins that hold it."""

    def __init__(self, lengths: list[int], bins: list[list[int]], capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.bins = {b: list(v) for b, v in enumerate(bins)}
        self.fill = {b: sum(lengths[i] for i in v) for b, v in self.bins.items()}
        self.holders: dict[int, set[int]] = {}
        self.mask = 0
        for b in self.bins:
            self._enter(b)

    def _enter(self, b: int) -> None:
        if self.fill[b] == self.capacity:
            return
        for i in self.bins[b]:
            n = self.lengths[i]
            self.holders.setdefault(n, set()).add(b)
            self.mask |= 1 << n

    def _leave(self, b: int) -> None:
        for i in self.bins[b]:
            n = self.lengths[i]
            held = self.holders.get(n)
            if held:
                held.discard(b)
                if not held:
                    del self.holders[n]
                    self.mask &= ~(1 << n)

    def exchange(self, to: int, give: tuple[int, ...], frm: int, take: tuple[int, ...]) -> None:
        self._leave(to)
        self._leave(frm)
        for b, out, into in ((to, give, take), (frm, take, give)):
            self.bins[b] = [i for i in self.bins[b] if i not in out] + list(into)
            self.fill[b] = sum(self.lengths[i] for i in self.bins[b])
        for b in (to, frm):
            if self.bins[b]:
                self._enter(b)
            else:
                del self.bins[b], self.fill[b]

    def _holder(self, n: int, to: int, gain: int) -> int | None:
        """A bin with a document of length ``n`` whose loss of ``gain`` increases the squares."""
        limit = self.fill[to] + gain
        return next((b for b in self.holders[n] if b != to and self.fill[b] < limit), None)

    def improve(self, to: int, donors: list[int]) -> bool:
        """Apply the step that fills ``to`` most; False if there is none."""
        room, own = self.capacity - self.fill[to], self.bins[to]
        size = self.lengths
        best: tuple[int, tuple[int, ...], int, tuple[int, ...]] | None = None
        gives = [(), *((i,) for i in own)]
        if len(own) <= 24:
            gives += [(i, j) for k, i in enumerate(own) for j in own[:k]]
        for give in gives:  # move; one for one; one for two
            base = sum(size[i] for i in give)
            window = (self.mask & ((1 << (min(base + room, self.capacity) + 1)) - 1)) >> (base + 1)
            while window:
                n = base + window.bit_length()
                if best and n - base <= best[0]:
                    break
                if (b := self._holder(n, to, n - base)) is not None:
                    best = (n - base, give, b, (next(i for i in self.bins[b] if size[i] == n),))
                    break
                window &= (1 << (n - base - 1)) - 1
        for b in donors:  # two for one
            if b == to or b not in self.bins or (best and best[0] == room):
                continue
            theirs = self.bins[b][:24]
            for give in gives[:1 + len(own)]:
                base = size[give[0]] if give else 0
                for k, i in enumerate(theirs):
                    for j in theirs[:k]:
                        gain = size[i] + size[j] - base
                        if 0 < gain <= room and (not best or gain > best[0]) and self.fill[to] + gain > self.fill[b]:
                            best = (gain, give, b, (i, j))
        if best is None:
            return False
        self.exchange(to, best[1], best[2], best[3])
        return True


def local_search(lengths: list[int], bins: list[list[int]], capacity: int, bound: int,
                 donors: int = 8) -> list[list[int]]:
    """Increase the sum of squared fills until no step of the neighbourhood does, or ``bound`` bins remain.

    The neighbourhood: a document from any open bin moves, or is exchanged for one
    or (from bins of at most 24 documents) two of the receiving bin; the ``donors``
    emptiest bins also offer pairs of their first 24 documents for one or none.
    """
    state = _Open(lengths, bins, capacity)
    changed = True
    while changed and len(state.bins) > bound:
        changed = False
        order = sorted((b for b in state.bins if state.fill[b] < capacity), key=lambda b: (-state.fill[b], b))
        emptiest = order[::-1][:donors]
        for b in order:
            while len(state.bins) > bound and b in state.bins and state.fill[b] < capacity and state.improve(b, emptiest):
                changed = True
    return [state.bins[b] for b in sorted(state.bins)]


def pack_lengths(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of positions into ``lengths`` (in decreasing order)."""
    bound = lower_bound(np.asarray(lengths, dtype=np.int64), capacity)
    bins = best_fit(lengths, capacity)
    return bins if len(bins) <= bound else local_search(lengths, bins, capacity, bound)


# ---------------------------------------------------------------------------
# all groups
# ---------------------------------------------------------------------------

_KEYS = ["doc_id", "piece", "length", "ids_crc32"]


def _pack_round(rows: DataFrame, round_: int, capacity: int, group_rows: int, reopen: float) -> DataFrame:
    """Pack groups of ``group_rows`` consecutive rows in the order of a hash of their values."""
    hashed = rows.withColumn("__hash", F.xxhash64(F.lit(round_), *_KEYS))
    dealt = ranked(hashed, ["__hash", *_KEYS], "__rank").drop("__hash").withColumn(
        "__group", F.expr(f"__rank div {group_rows}"))
    schema = f"{rows.schema.simpleString()[7:-1]},sequence_id:bigint,offset:bigint,__open:boolean"

    def pack_group(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "__rank"], ascending=[False, True], ignore_index=True)
        size = pdf["length"].to_numpy()
        bins = pack_lengths(size.tolist(), capacity)
        where = np.concatenate([np.asarray(b, dtype=np.int64) for b in bins])
        sequence, offset, open_ = (np.empty(len(pdf), dtype=t) for t in (np.int64, np.int64, bool))
        number = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
        # a number that no other group or round uses
        sequence[where] = (round_ << 56) + (int(key[0]) << 24) + number
        ends = np.cumsum(size[where])
        first = np.flatnonzero(np.r_[True, np.diff(number) > 0])
        starts = ends - size[where]
        offset[where] = starts - np.repeat(starts[first], np.diff(np.r_[first, len(where)]))
        fill = np.add.reduceat(size[where], first)
        open_[where] = np.repeat(fill < capacity * reopen, np.diff(np.r_[first, len(where)]))
        return pdf.drop(columns=["__group", "__rank"]).assign(sequence_id=sequence, offset=offset, __open=open_)

    return dealt.groupBy("__group").applyInPandas(lambda key, pdf: pack_group(key, pdf),
                                                  schema.replace(":", " ").replace(",", ", "))


def pack(pieces: DataFrame, capacity: int = 2048, group_rows: int = 4096, reopen: float = 0.97) -> DataFrame:
    """``pieces(doc_id, piece, start, length, ids_crc32)`` plus ``sequence_id`` and ``offset``.

    Lengths lie in 1 .. ``capacity``.  Every row is placed once; offsets are
    gapless within a sequence.  Repeated rows are packed one by one.  The layout
    depends on the rows alone, not on partitions.  Bins filled below ``reopen``
    are packed again in the next round, until they fit one group or a round
    saves no bin.  An empty table gives no rows; long texts arrive as several pieces.
    """
    rows = pieces.select(*_KEYS, "start")
    done, bins_before, round_ = None, None, 0
    while True:
        packed = written(_pack_round(rows, round_, capacity, group_rows, reopen))
        n, bins, n_open, bins_open = packed.agg(
            F.count(F.lit(1)), F.count(F.when(F.col("offset") == 0, 1)), F.count(F.when(F.col("__open"), 1)),
            F.count(F.when(F.col("__open") & (F.col("offset") == 0), 1))).first()
        last = n <= group_rows or n_open == 0 or (bins_before is not None and bins >= bins_before)
        fixed = packed if last else packed.where("NOT __open")
        done = fixed if done is None else done.unionByName(fixed)
        if last:
            return done.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
        rows, bins_before, round_ = packed.where("__open").select(*rows.columns), bins_open, round_ + 1


def sequences(pieces: DataFrame, placed: DataFrame) -> DataFrame:
    """``(sequence_id, ids)``: the packed token sequences themselves.

    ``pieces`` carries ``ids`` (``token_pieces(..., with_ids=True)``); a sequence
    holds at most ``capacity`` ids, so a group is bounded.
    """
    keys = ["doc_id", "piece", "ids_crc32", "length"]
    ids = pieces.select(*keys, "ids").dropDuplicates(keys)
    same = [placed[k].eqNullSafe(ids[k]) for k in keys]
    test = same[0] & same[1] & same[2] & same[3]
    members = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.join(ids, test).groupBy("sequence_id").agg(F.flatten(F.transform(members, lambda m: m.ids)).alias("ids"))

"""First-fit decreasing packing with a tournament tree of bin capacities, in randomised groups.

1. One map-only pass tokenizes whole texts, appends the end id and cuts documents of more
   than ``capacity`` ids into full pieces and a rest.  Pieces are dealt into groups by a
   hash of their row's identity and number: random groups, which no key of the data decides.
2. Every group runs first-fit decreasing by itself.  The rooms of its bins are the leaves of
   a tournament tree whose inner nodes hold the larger room of their two children: the
   leftmost bin with enough room is found, and the tree mended, in log2(bins) steps.
3. Documents may be cut freely, so the emptiest bins of the group are poured into the rooms
   of the others until one underfull bin is left.  A sequence of a power of two ids needs no
   padding: that last bin is split into such lengths.  No sequence of any group is padded.

Ids travel once, two bytes each where the vocabulary allows it; a group holds about
``group_bytes`` of text or ``group_rows`` documents, whatever the input's size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copair.llm.common import free_name, identified, tasks_for
from copair.llm.word_tokens import WordEncoder

_DOCS_AT_ONCE = 256


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of positions into ``lengths``, which are in decreasing order."""
    # of any two bins but the last, the second holds what the first could not: together over one capacity
    leaves = 1
    while leaves < min(len(lengths), 2 * sum(lengths) // capacity + 2):
        leaves *= 2
    best = [capacity] * (2 * leaves)  # node k has the children 2k and 2k + 1
    bins: list[list[int]] = []
    for i, n in enumerate(lengths):
        node = 1
        while node < leaves:
            node *= 2
            if best[node] < n:
                node += 1
        if node - leaves == len(bins):
            bins.append([])
        bins[node - leaves].append(i)
        best[node] -= n
        while node > 1:
            node //= 2
            winner = max(best[2 * node], best[2 * node + 1])
            if best[node] == winner:
                break
            best[node] = winner
    return bins


def poured(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of ``(position, start in the piece, length)`` without padding.

    Full bins stay.  The emptiest bin gives documents, cut where needed, to the fullest
    underfull one until it is full, and so on; the last underfull bin is split into
    sequences whose lengths are powers of two.
    """
    parts = [[(i, 0, lengths[i]) for i in b] for b in bins]
    fill = [sum(lengths[i] for i in b) for b in bins]
    done = [parts[b] for b in range(len(bins)) if fill[b] == capacity]
    order = sorted((b for b in range(len(bins)) if fill[b] < capacity), key=lambda b: (-fill[b], b))
    to, frm = 0, len(order) - 1
    while to < frm:
        into, out = order[to], order[frm]
        i, start, n = parts[out].pop()
        n_moved = min(n, capacity - fill[into])
        if n_moved < n:  # its end moves: the document's beginning stays where it was
            parts[out].append((i, start, n - n_moved))
        parts[into].append((i, start + n - n_moved, n_moved))
        fill[into] += n_moved
        fill[out] -= n_moved
        if fill[into] == capacity:
            done.append(parts[into])
            to += 1
        if not fill[out]:
            frm -= 1
    if to == frm:
        left = list(reversed(parts[order[to]]))
        size = fill[order[to]]
        for bit in reversed(range(size.bit_length())):
            if not size >> bit & 1:
                continue
            sequence, room = [], 1 << bit
            while room:
                i, start, n = left.pop()
                if n > room:
                    left.append((i, start + room, n - room))
                    n = room
                sequence.append((i, start, n))
                room -= n
            done.append(sequence)
    return done


def _pieces(rows: DataFrame, tokenizer: str, capacity: int, end_id: int, groups: int) -> DataFrame:
    """``(doc_id, start, doc_tokens, grp, ids)`` of ``rows(doc_id, text, h)``: a row per piece."""
    schema = "doc_id long, start long, doc_tokens long, grp long, ids binary"
    end = np.array([end_id], dtype="<u4")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.at(tokenizer)
        kind = "<u2" if max(encoder.vocabulary, end_id + 1) <= 1 << 16 else "<u4"
        for batch in batches:
            for at in range(0, batch.num_rows, _DOCS_AT_ONCE):
                part = batch.slice(at, _DOCS_AT_ONCE)
                out: list[list] = [[] for _ in range(5)]
                raws = encoder.encode(part.column(1).to_pylist())
                for key, raw, h in zip(part.column(0).to_pylist(), raws, part.column(2).to_pylist()):
                    ids = np.concatenate([np.frombuffer(raw, dtype="<u4"), end]).astype(kind)
                    for k, start in enumerate(range(0, len(ids), capacity)):
                        # another multiple of an odd constant for each piece of a row
                        group = (h + k * 0x9E3779B97F4A7C15) % (1 << 64) % groups
                        for col, v in zip(out, (key, start, len(ids), group, ids[start:start + capacity].tobytes())):
                            col.append(v)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)],
                                                 names=["doc_id", "start", "doc_tokens", "grp", "ids"])

    return rows.mapInArrow(cut, schema)


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                   capacity: int = 2048, end_id: int = 1, group_bytes: int = 8 << 20, group_rows: int = 16384,
                   with_ids: bool = False) -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids])``: a row per piece.

    ``capacity`` is a power of two.  A document is its ids and ``end_id``; a null or empty
    text is ``end_id`` alone.  ``ids`` are little-endian unsigned 32-bit.  Every id lies in one
    piece; a sequence's pieces fill it gaplessly from offset 0 up to ``capacity`` or to a
    smaller power of two.  Repeated rows and null ids are packed one by one, long texts are
    cut, other columns are not read, and an empty table gives no rows.  Equal files give
    equal layouts.
    """
    if capacity & (capacity - 1) or capacity < 1:
        raise ValueError("capacity must be a power of two")
    rows, names = identified(docs)
    n, size = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length(text_col))).first()
    groups = max(tasks_for(n, group_rows), tasks_for(size or 0, group_bytes))
    key = free_name(rows, "__h")
    read = rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                       F.xxhash64(F.lit(11), *names).alias(key))
    vocabulary = WordEncoder.at(tokenizer).vocabulary
    kind = "<u2" if max(vocabulary, end_id + 1) <= 1 << 16 else "<u4"
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

    def pack_group(table: pa.Table) -> pa.Table:
        ids = [np.frombuffer(v, dtype=kind) for v in table.column("ids").to_pylist()]
        doc, start, total = (table.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens"))
        group = table.column("grp")[0].as_py()
        # by content where lengths are equal, so that the order of arrival decides nothing
        order = sorted(range(len(ids)), key=lambda i: (-len(ids[i]), doc[i] is None, doc[i] or 0, start[i], zlib.crc32(ids[i])))
        lengths = [len(ids[i]) for i in order]
        whole = sum(n == capacity for n in lengths)
        bins = first_fit_decreasing(lengths[whole:], capacity)
        sequences = [[(i, 0, capacity)] for i in range(whole)]
        sequences += [[(i + whole, s, n) for i, s, n in q] for q in poured(bins, lengths[whole:], capacity)]
        out: list[list] = [[] for _ in range(7 + with_ids)]
        for number, sequence in enumerate(sequences):
            offset = 0
            for i, s, n in sequence:
                i = order[i]
                raw = ids[i][s:s + n].astype("<u4").tobytes()
                row = (doc[i], start[i] + s, n, zlib.crc32(raw), total[i], (group << 24) + number, offset)
                for col, v in zip(out, (*row, raw)):
                    col.append(v)
                offset += n
        kinds = [pa.int64()] * 7 + [pa.binary()] * with_ids
        names = [c.split()[0] for c in schema.split(", ")] + ["ids"] * with_ids
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=names)

    dealt = _pieces(read, tokenizer, capacity, end_id, groups)
    return dealt.groupBy("grp").applyInArrow(pack_group, schema + ", ids binary" * with_ids)


def sequences(placed: DataFrame) -> DataFrame:
    """``(sequence_id, ids array<int>)`` from ``pack_documents(..., with_ids=True)``: the training sequences.

    A sequence holds at most ``capacity`` ids, so a group is bounded."""
    members = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = placed.groupBy("sequence_id").agg(F.transform(members, lambda m: m.ids).alias("parts"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(b"".join(p), dtype="<u4").astype(np.int32) for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["sequence_id", "ids"])

    return joined.mapInArrow(read, "sequence_id long, ids array<int>")

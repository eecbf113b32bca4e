"""Vector tables: which rows take part, Arrow blocks as numpy, streams of whole groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vec: Column) -> Column:
    """Not null, not all zero, every component present and finite."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vec.isNotNull() & ~bad & F.exists(vec, lambda x: x != 0), F.lit(False))


#: Each length is searched by itself; a table of more lengths than this is an error.
MAX_LENGTHS = 1000


def lengths(rows: DataFrame, vec_col: str) -> list[int]:
    """The distinct lengths of usable vectors, ascending."""
    found = rows.where(usable(F.col(vec_col))).select(F.size(vec_col).alias("n")).distinct().limit(MAX_LENGTHS + 1).collect()
    if len(found) > MAX_LENGTHS:
        raise ValueError(f"vectors of more than {MAX_LENGTHS} lengths")
    return sorted(r[0] for r in found)


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A list column of equal lengths as a float64 matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dims)


def unit(x: np.ndarray) -> np.ndarray:
    # scaled first, so that squares neither overflow nor vanish
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise cosines in double precision; the same rows give the same bits anywhere."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Cut a stream sorted by ``keys`` (integers) into tables of complete groups with their borders.

    Holds one Arrow batch and one open group at a time.
    """
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([held, table]) if held is not None else table
        borders = _borders(table, keys)
        last = int(borders[-2])
        held = table.slice(last)
        if last:
            yield table.slice(0, last).combine_chunks(), borders[:-1]
    if held is not None:
        yield held.combine_chunks(), np.array([0, held.num_rows])


def _borders(table: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(table.num_rows, dtype=bool)
    new[0] = True
    for k in keys:
        v = table.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.r_[np.flatnonzero(new), table.num_rows]


def by_group(rows: DataFrame, keys: list[str], order: list[str], schema: str, columns: list[str],
             work: Callable[[pa.Table, np.ndarray], Iterator[dict[str, np.ndarray]]]) -> DataFrame:
    """Bring the rows of each key together, sorted, and run ``work`` on tables of whole groups."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, borders in whole_groups(batches, keys):
            for out in work(table, borders):
                yield pa.RecordBatch.from_arrays([pa.array(out[n]) for n in names], names=names)

    return rows.select(*columns).repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)

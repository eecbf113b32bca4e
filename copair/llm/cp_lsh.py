"""Embedding near-duplicates by cross-polytope hashing with multiprobe buckets.

Hash: three rounds of random signs and a fast Hadamard transform rotate the
vector (padded to a power of two); its hash is the nearest vertex of the cross
polytope, i.e. the largest coordinate and its sign.  A table joins ``FUNCTIONS``
such hashes.  A row enters its own bucket of every table and the ``probes - 1``
next best ones (vertices whose coordinates are nearly as large).  Two rows are
candidates if one's bucket is among the other's probes.

Candidates are verified by their cosine on the original vectors in double
precision.  Buckets give counts and spanning edges, never lists of pairs: each
bucket emits for each row the number of links first found there (a pair found in
several buckets is counted in the first one, which follows from its hashes) and a
spanning forest of its links.  Equal vectors are merged beforehand and weigh as
many as they are, and each length of vectors has buckets of its own.  Buckets of
more than ``chunk_rows`` rows are cut into chunks, and every pair of chunks is a
task's group, so no group grows with the input.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copair.llm.common import written
from copair.llm.components import components
from copair.llm.vectors import by_group, cosine, lengths, matrix, unit, usable

FUNCTIONS = 2
_ROUNDS = 3
_RANKED = 4  # vertices per function that probes choose from
_EDGE = 1e-9


def hadamard(y: np.ndarray) -> np.ndarray:
    """Normalised fast Walsh-Hadamard transform of each row (length a power of two)."""
    rows, n = y.shape
    h = 1
    while h < n:
        y = y.reshape(rows, n // (2 * h), 2, h)
        y = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(rows, n)
        h *= 2
    return y / np.sqrt(n)


def probe_codes(x: np.ndarray, table: int, probes: int, seed: int = 10) -> np.ndarray:
    """``(rows, probes)`` bucket codes of unit vectors, the own bucket first."""
    n = 1 << max(1, (x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, n - x.shape[1])))
    code, cost = np.zeros((len(x), 1), dtype=np.int64), np.zeros((len(x), 1))
    for k in range(FUNCTIONS):
        rng, y = np.random.default_rng([seed, table, k]), x
        for _ in range(_ROUNDS):
            y = hadamard(y * (2 * rng.integers(0, 2, n) - 1))
        ranked = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :_RANKED]
        value = np.take_along_axis(y, ranked, axis=1)
        gap = (np.abs(value[:, :1]) - np.abs(value)) ** 2
        cost = (cost[:, :, None] + gap[:, None, :]).reshape(len(x), -1)
        code = (code[:, :, None] * 2 * n + (2 * ranked + (value < 0))[:, None, :]).reshape(len(x), -1)
    best = np.argsort(cost, axis=1, kind="stable")[:, :probes]
    return np.take_along_axis(code, best, axis=1)


def spanning(i: np.ndarray, j: np.ndarray) -> list[int]:
    """Positions of links that form a spanning forest of the links ``i - j``."""
    up: dict[int, int] = {}

    def root(a: int) -> int:
        while up.get(a, a) != a:
            up[a] = up.get(up[a], up[a])
            a = up[a]
        return a

    kept = []
    for k, (a, b) in enumerate(zip(i.tolist(), j.tolist())):
        a, b = root(a), root(b)
        if a != b:
            up[a] = b
            kept.append(k)
    return kept


def _buckets(nodes: DataFrame, dims: int, tables: int, probes: int) -> DataFrame:
    """``(vid, copies, v)`` -> a row per table and probed bucket."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                x = unit(matrix(part.column("v"), dims))
                for t in range(tables):
                    codes = probe_codes(x, t, probes)
                    p = codes.shape[1]
                    rows = np.repeat(np.arange(len(x)), p)
                    taken = part.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(rows), t, dtype=np.int32)), pa.array(codes.ravel()),
                         pa.array(np.tile(np.arange(p) == 0, len(x))), *taken.columns],
                        names=["t", "code", "home", "vid", "copies", "v"])

    kind = nodes.schema["v"].dataType.simpleString()
    return nodes.select("vid", "copies", "v").mapInArrow(
        spread, f"t int, code long, home boolean, vid long, copies long, v {kind}")


def _chunked(rows: DataFrame, chunk_rows: int) -> DataFrame:
    """Add ``ci <= cj``: pairs of chunks of large buckets; (0, 0) for the others."""
    sizes = rows.groupBy("t", "code").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > chunk_rows)
    sizes = written(sizes.select("t", "code", F.ceil(F.col("n") / chunk_rows).cast("int").alias("m")))
    plain = lambda df: df.withColumns({"ci": F.lit(0), "cj": F.lit(0), "own": F.lit(0)})
    if sizes.isEmpty():
        return plain(rows)
    large = rows.join(sizes, ["t", "code"]).withColumn("own", F.pmod(F.xxhash64("vid"), F.col("m")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("m") - 1))
    large = large.withColumn("__o", other).withColumns(
        {"ci": F.least("own", "__o"), "cj": F.greatest("own", "__o")}).drop("__o", "m")
    small = plain(rows.join(sizes, ["t", "code"], "left_anti"))
    return small.unionByName(large.select(*small.columns))


def _links_in_buckets(rows: DataFrame, dims: int, probes: int, least: float) -> DataFrame:
    """``(vid, n, other)``: links first found in a bucket, and spanning edges (``other`` not null)."""

    def work(table: pa.Table, borders: np.ndarray) -> Iterator[dict]:
        sizes = np.diff(borders)
        if not (sizes > 1).any():
            return
        vid, copies = (table.column(c).to_numpy() for c in ("vid", "copies"))
        home, own = (table.column(c).to_numpy() for c in ("home", "own"))
        t, ci, cj = (table.column(c).to_numpy() for c in ("t", "ci", "cj"))
        v = matrix(table.column("v").chunk(0), dims)
        x = unit(v)
        out: dict[str, list] = {"vid": [], "n": [], "other": []}
        for a, b in zip(borders[:-1][sizes > 1].tolist(), borders[1:][sizes > 1].tolist()):
            at_home = home[a:b].astype(bool)
            if not at_home.any():
                continue
            s = x[a:b] @ x[a:b].T
            i, j = np.nonzero(np.triu(s >= least - _EDGE, 1))
            use = at_home[i] | at_home[j]
            if ci[a] != cj[a]:
                use &= own[a:b][i] != own[a:b][j]
            elif len(i):
                use &= vid[a:b][i] != vid[a:b][j]
            i, j = i[use], j[use]
            if len(i):
                close = s[i, j] < least + _EDGE
                if close.any():
                    sure = np.ones(len(i), dtype=bool)
                    sure[close] = cosine(v[a:b][i[close]], v[a:b][j[close]]) >= least
                    i, j = i[sure], j[sure]
            if not len(i):
                continue
            first = _first_found(x[a:b], vid[a:b], at_home, i, j, int(t[a]), probes)
            count = (np.bincount(i[first], copies[a:b][j[first]], b - a) +
                     np.bincount(j[first], copies[a:b][i[first]], b - a)).astype(np.int64)
            used = np.flatnonzero(count)
            out["vid"] += vid[a:b][used].tolist()
            out["n"] += count[used].tolist()
            out["other"] += [None] * len(used)
            tree = spanning(i, j)
            out["vid"] += vid[a:b][i[tree]].tolist()
            out["n"] += [0] * len(tree)
            out["other"] += vid[a:b][j[tree]].tolist()
        if out["vid"]:
            yield {k: pa.array(c, pa.int64()) for k, c in out.items()}

    return by_group(rows, ["t", "code", "ci", "cj"], ["vid"], "vid long, n long, other long",
                    ["t", "code", "ci", "cj", "own", "home", "vid", "copies", "v"], work)


def _first_found(x: np.ndarray, vid: np.ndarray, at_home: np.ndarray, i: np.ndarray, j: np.ndarray, t: int,
                 probes: int) -> np.ndarray:
    """Whether this bucket is the first one in which each link is found.

    A link is found in earlier tables if one end's own bucket is among the other's
    probes there.  In this table it may be found in both ends' own buckets: the
    one of the end with the smaller id counts.
    """
    ends, where = np.unique(np.concatenate([i, j]), return_inverse=True)
    a, b = where[:len(i)], where[len(i):]
    first = np.ones(len(i), dtype=bool)
    for earlier in range(t):
        codes = probe_codes(x[ends], earlier, probes)
        first &= ~((codes[a, :1] == codes[b]).any(axis=1) | (codes[b, :1] == codes[a]).any(axis=1))
    codes = probe_codes(x[ends], t, probes)
    both = (codes[a, :1] == codes[b]).any(axis=1) & (codes[b, :1] == codes[a]).any(axis=1) & (codes[a, 0] != codes[b, 0])
    low_home = np.where(vid[i] < vid[j], at_home[i], at_home[j])
    return first & (~both | low_home)


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", least: float = 0.95,
                    tables: int = 5, probes: int = 3, chunk_rows: int = 2000) -> DataFrame:
    """One row per row of ``rows``: ``(vec_id, n_links, component_id, kept)``.

    Rows without an id, and vectors that are null, zero, or hold null or non-finite
    components, link with nothing: 0 links, their own component, kept.  Vectors of
    different lengths do not link.  Repeated rows count as vectors of their own.  An
    empty table gives no rows; other columns are not read.
    """
    every = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v"))
    fits = usable(F.col("v")) & F.col("vec_id").isNotNull()
    by_length = []
    for dims in lengths(every.where("vec_id IS NOT NULL"), "v"):
        same = every.where(fits & (F.size("v") == dims))
        nodes = written(same.groupBy("v").agg(F.min("vec_id").alias("vid"), F.count(F.lit(1)).alias("copies")))
        buckets = written(_buckets(nodes, dims, tables, probes))
        by_length.append((nodes, written(_links_in_buckets(_chunked(buckets, chunk_rows), dims, probes, least))))
    if not by_length:
        return every.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
                            F.lit(True).alias("kept"))
    nodes, found = (reduce(DataFrame.unionByName, each) for each in zip(*by_length))
    counts = found.groupBy("vid").agg(F.sum("n").alias("n"))
    groups = components(found.where("other IS NOT NULL").select(F.col("vid").alias("u"), F.col("other").alias("v")))
    info = nodes.join(counts, "vid", "left").join(groups.withColumnRenamed("node", "vid"), "vid", "left").select(
        "v", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"),
        F.coalesce("component", "vid").alias("component_id"))
    part = every.where(fits).join(info, "v").select("vec_id", "n_links", "component_id")
    rest = every.where(~F.coalesce(fits, F.lit(False))).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return part.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

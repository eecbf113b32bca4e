"""Nearest neighbours by a forest of random-projection trees and one priority queue.

* Fit: on a bounded hash sample, every tree splits by random hyperplanes at the
  median projection down to a fixed depth (complete trees, so a leaf is a number).
* Index: every distinct vector falls to one leaf of each tree.
* Search: a query keeps one priority queue over all trees, ordered by the largest
  distance to a plane that a path had to cross, and visits leaves in that order.
  It goes on while no tree's visited leaves hold more than ``k`` rows, so that
  every query finds ``k`` others if there are so many.
  How many leaves is calibrated: for sample queries the true neighbours (brute
  force over all rows) tell how deep the queue must go for the wanted recall.
* Rerank: rows and visiting queries meet by (tree, leaf, chunk); each group scores
  its block with one matrix product and keeps every query's best few, which are
  scored exactly on the original vectors.  Leaves are cut into chunks of about
  ``chunk_rows`` rows, so groups are bounded at any table size.

Equal vectors are one index row that carries its smallest ids, so thousands of
copies of one vector neither fill a leaf nor hide other neighbours.  Vectors of
different lengths have no cosine: each length has a forest of its own.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from copair.llm.common import hash_sample, tasks_for, written
from copair.llm.vectors import by_group, cosine, lengths, matrix, unit, usable

SCHEMA = "query_id long, rank int, vec_id long, score double"


#: Odd multiplier of a Fibonacci hash (fixed value).
_SPREAD = 0x9E3779B97F4A7C15


@dataclass
class Forest:
    planes: np.ndarray  # (trees, nodes, dims); children of node n are 2n+1 and 2n+2
    cuts: np.ndarray  # (trees, nodes)
    depth: int

    @property
    def trees(self) -> int:
        return len(self.planes)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """``(rows, trees)`` leaf numbers of unit vectors."""
        out = np.zeros((len(x), self.trees), dtype=np.int32)
        for t in range(self.trees):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                right = np.einsum("ij,ij->i", x, self.planes[t, node]) > self.cuts[t, node]
                node = 2 * node + 1 + right
            out[:, t] = node - ((1 << self.depth) - 1)
        return out

    def visits(self, q: np.ndarray, most: int | None = None, held: np.ndarray | None = None,
               least: int = 0) -> list[tuple[int, int]]:
        """``(tree, leaf)`` in the order of the shared priority queue.

        The first ``most``, and further ones until the visited leaves of one tree hold
        ``least`` rows; ``held`` has the rows of every tree's leaves.
        """
        margin = self.planes @ q - self.cuts
        queue = [(0.0, t, 0) for t in range(self.trees)]
        first_leaf, out, rows = (1 << self.depth) - 1, [], [0] * self.trees
        while queue and (most is None or len(out) < most or (held is not None and max(rows) < least)):
            far, t, node = heapq.heappop(queue)
            while node < first_leaf:
                m = margin[t, node]
                near = 2 * node + 1 + (m > 0)
                heapq.heappush(queue, (max(far, abs(m)), t, 4 * node + 3 - near))
                node = near
            leaf = int(node - first_leaf)
            out.append((t, leaf))
            if held is not None:
                rows[t] += int(held[t, leaf])
        return out


def fit(sample: np.ndarray, rows: int, trees: int, leaf_rows: int, seed: int) -> Forest:
    """Trees over unit vectors, deep enough for ``leaf_rows`` of ``rows`` rows a leaf
    (and at least 8 sample rows a leaf)."""
    depth = max(0, int(np.floor(np.log2(max(1, min(rows / leaf_rows, len(sample) / 8))))))
    nodes = (1 << depth) - 1
    planes, cuts = np.zeros((trees, nodes, sample.shape[1])), np.zeros((trees, nodes))
    for t in range(trees):
        rng = np.random.default_rng([seed, t])
        planes[t] = unit(rng.standard_normal(planes[t].shape)) if nodes else planes[t]
        members = {0: np.arange(len(sample))}
        for node in range(nodes):
            rows_here = members.pop(node, np.empty(0, dtype=np.int64))
            value = sample[rows_here] @ planes[t, node]
            cuts[t, node] = np.median(value) if len(value) else 0.0
            members[2 * node + 1] = rows_here[value <= cuts[t, node]]
            members[2 * node + 2] = rows_here[value > cuts[t, node]]
    return Forest(planes, cuts, depth)


def _collected(sample: DataFrame, dims: int) -> np.ndarray:
    """Unit vectors of a bounded sample."""
    table = sample.toArrow()
    if not table.num_rows:
        return np.empty((0, dims))
    return unit(matrix(table.column("v").combine_chunks(), dims))


def _best(rows: DataFrame, queries: np.ndarray, k: int, dims: int) -> list[np.ndarray]:
    """Brute force: the ``k`` vectors of ``rows(v)`` nearest to each of a few queries."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep: list = [(np.empty(0), np.empty((0, dims))) for _ in queries]
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit(matrix(batch.column(0), dims))
            s = queries @ x.T
            for i, row in enumerate(s):
                top = np.argpartition(-row, min(k, len(row)) - 1)[:k]
                score, found = np.r_[keep[i][0], row[top]], np.vstack([keep[i][1], x[top]])
                order = np.argsort(-score, kind="stable")[:k]
                keep[i] = (score[order], found[order])
        q = np.concatenate([np.full(len(s), i) for i, (s, _) in enumerate(keep)]).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(q), pa.array(np.concatenate([s for s, _ in keep])),
             pa.array([v.tolist() for _, f in keep for v in f], pa.list_(pa.float64()))], names=["q", "s", "v"])

    order = Window.partitionBy("q").orderBy(F.col("s").desc(), "v")
    best = rows.select("v").mapInArrow(near, "q long, s double, v array<double>").withColumn(
        "r", F.row_number().over(order)).where(F.col("r") <= k).toPandas()
    return [np.array(best.loc[best["q"] == i, "v"].tolist()).reshape(-1, dims) for i in range(len(queries))]


def _held(index: DataFrame, model, dims: int) -> np.ndarray:
    """Rows in each leaf of each tree, counted in the tasks: ``(trees, leaves)``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = model.value
        n = np.zeros((forest.trees, 1 << forest.depth), dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                leaves = forest.leaves(unit(matrix(batch.slice(at, 2000).column(0), dims)))
                for t in range(forest.trees):
                    n[t] += np.bincount(leaves[:, t], minlength=n.shape[1])
        t, leaf = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(leaf), pa.array(n[t, leaf])], names=["t", "leaf", "n"])

    counts = index.select("v").mapInArrow(count, "t long, leaf long, n long")
    found = counts.groupBy("t", "leaf").agg(F.sum("n").alias("n")).toArrow()  # at most trees x leaves rows
    held = np.zeros((model.value.trees, 1 << model.value.depth), dtype=np.int64)
    held[found.column("t").to_numpy(), found.column("leaf").to_numpy()] = found.column("n").to_numpy()
    return held


def calibrate(forest: Forest, queries: np.ndarray, truth: list[np.ndarray], recall: float) -> int:
    """Leaves to visit so that ``recall`` of the true neighbours lie in a visited one.

    ``truth`` has each query's own vector first, which is left out.
    """
    depth_of: list[int] = []
    for q, near in zip(queries, truth):
        place = {leaf: n + 1 for n, leaf in enumerate(forest.visits(q))}
        for leaves in forest.leaves(near[1:]):
            depth_of.append(min(place[(t, int(leaf))] for t, leaf in enumerate(leaves)))
    return int(np.ceil(np.quantile(depth_of, recall))) if depth_of else 1


def search(rows: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding",
           trees: int = 8, leaf_rows: int = 256, sample: int = 65_536, recall: float = 0.95, calibration: int = 128,
           chunk_rows: int = 4096, seed: int = 4) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest other rows found for each query row.

    ``is_query`` is a condition on ``id``.  Rows without an id and vectors that are
    null, zero, or hold null or non-finite components take no part; vectors of
    another length than the query's are no candidates.  Repeated ids are rows of one
    id: only the query's own id is left out, and an id with vectors of several
    lengths asks with each.  Ties go to smaller ids.  A query finds ``k`` others
    where there are so many, else all.  An empty table gives no rows; other columns
    are not read.
    """
    every = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))
    every = every.where(usable(F.col("v")) & F.col("id").isNotNull())
    found = [_search(every.where(F.size("v") == dims), dims, is_query, k, trees, leaf_rows, sample, recall, calibration,
                     chunk_rows, seed) for dims in lengths(every, "v")]
    return reduce(DataFrame.unionByName, found) if found else rows.sparkSession.createDataFrame([], SCHEMA)


def _search(every: DataFrame, dims: int, is_query: Column, k: int, trees: int, leaf_rows: int, sample: int, recall: float,
            calibration: int, chunk_rows: int, seed: int) -> DataFrame:
    """``search`` over usable vectors ``(id, v)`` of one length."""
    spark = every.sparkSession
    # the k + 1 smallest ids of each distinct vector; the limit is applied before the shuffle
    by_id = Window.partitionBy("v").orderBy("id")
    ids = every.distinct().withColumn("r", F.row_number().over(by_id)).where(F.col("r") <= k + 1)
    index = written(ids.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("vid", F.col("ids")[0]))
    n = index.select(F.count(F.lit(1))).first()[0]
    asked = written(every.where(is_query).distinct().join(index.select("v", "vid"), "v").select("id", "vid", "v"))
    fitted = hash_sample(index.select("vid", "v"), sample, "vid").orderBy("vid").select("v")
    forest = fit(_collected(fitted, dims), n, trees, leaf_rows, seed)
    asked_once = asked.select("vid", "v").dropDuplicates(["vid"])
    probes = _collected(hash_sample(asked_once, calibration, "vid").orderBy("vid").limit(2 * calibration).select("v"), dims)
    if not len(probes):
        return spark.createDataFrame([], SCHEMA)
    visits = calibrate(forest, probes, _best(index, probes, k + 1, dims), recall)
    model = spark.sparkContext.broadcast(forest)  # bounded by trees x sample / 8 planes
    held = spark.sparkContext.broadcast(_held(index, model, dims))  # a count per leaf
    chunks = tasks_for(n, chunk_rows << forest.depth)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                leaves = model.value.leaves(unit(matrix(part.column("v"), dims)))
                vid = part.column("vid").to_numpy()
                # a hash of the id, as ids may have a common factor
                chunk = ((vid.astype(np.uint64) * np.uint64(_SPREAD) >> np.uint64(32)) % np.uint64(chunks)).astype(np.int32)
                for t in range(leaves.shape[1]):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(vid), t, dtype=np.int32)), pa.array(leaves[:, t]),
                         pa.array(chunk), pa.array(np.zeros(len(vid), dtype=bool)),
                         part.column("vid"), part.column("v")], names=["t", "leaf", "chunk", "asks", "vid", "v"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                seen = [model.value.visits(q, visits, held.value, k + 1) for q in unit(matrix(part.column("v"), dims))]
                row = np.repeat(np.arange(len(seen)), [len(s) * chunks for s in seen])
                t, leaf = (np.repeat([x[c] for s in seen for x in s], chunks).astype(np.int32) for c in (0, 1))
                taken = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(t), pa.array(leaf), pa.array(np.tile(np.arange(chunks, dtype=np.int32), len(t) // chunks)),
                     pa.array(np.ones(len(row), dtype=bool)), taken.column("vid"), taken.column("v")],
                    names=["t", "leaf", "chunk", "asks", "vid", "v"])

    schema = f"t int, leaf int, chunk int, asks boolean, vid long, v {index.schema['v'].dataType.simpleString()}"
    meet = index.select("vid", "v").mapInArrow(place, schema).unionByName(asked_once.mapInArrow(ask, schema))

    def score(table: pa.Table, borders: np.ndarray) -> Iterator[dict]:
        vid, asks = table.column("vid").to_numpy(), table.column("asks").to_numpy().astype(bool)
        v = matrix(table.column("v").chunk(0), dims)
        x = unit(v)
        for a, b in zip(borders[:-1], borders[1:]):
            mid = a + int(np.count_nonzero(~asks[a:b]))  # rows come before queries
            for start in range(mid, b if mid > a else mid, 1000):
                q = np.arange(start, min(start + 1000, b))
                s = x[q] @ x[a:mid].T
                near = min(k + 3, mid - a)  # a few more than wanted, then exact scores
                top = np.argpartition(-s, near - 1, axis=1)[:, :near] + a
                pair_q, pair_c = np.repeat(q, near), top.ravel()
                yield {"q": vid[pair_q], "vid": vid[pair_c], "score": cosine(v[pair_q], v[pair_c])}

    scored = by_group(meet, ["t", "leaf", "chunk"], ["asks"], "q long, vid long, score double",
                      ["t", "leaf", "chunk", "asks", "vid", "v"], score)
    once = scored.groupBy("q", "vid").agg(F.max("score").alias("score"))
    rank = Window.partitionBy("q").orderBy(F.col("score").desc(), "vid")
    best = once.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= k + 1)
    listed = best.join(index.select("vid", "ids"), "vid").select("q", "score", F.explode("ids").alias("id"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("neg"), "id")))
    lists = listed.groupBy("q").agg(order.alias("near"))  # at most (k + 1)^2 entries
    own = asked.select(F.col("id").alias("query_id"), F.col("vid").alias("q")).join(lists, "q")
    others = F.slice(F.filter("near", lambda x: x.id != F.col("query_id")), 1, k)
    return own.select("query_id", F.posexplode(others).alias("p", "x")).select(
        "query_id", (F.col("p") + 1).alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.neg")).alias("score"))

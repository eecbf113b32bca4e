"""Mixing sources to target weights by the cube method of balanced sampling.

A source with target ``t`` and size ``s`` takes every document ``floor(t / s)``
times and once more with inclusion probability ``frac(t / s)``.  The extra draws
are balanced on two totals, documents and words:

* Flight: three documents with open probabilities span a one-dimensional null
  space of the two balancing equations.  A random step along it, with the
  martingale odds, closes at least one probability at 0 or 1 and leaves both
  totals as they were.  Each block of a source runs its own flight and leaves
  two documents open, besides a reserve of 14 of graded sizes that it sets aside.
* The open documents of all blocks meet in further blocks until one block per
  source is left.
* Landing: of all roundings of a source's last 16 documents the one whose words
  are nearest to the target is taken.

A source's rows are numbered in the order of a hash of their values, and blocks are
ranges of that number, so a source or an id with a third of all rows is spread over
many tasks.  Random draws depend on block contents alone: reruns agree.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copair.llm.common import free_name, identified, ranked, tasks_for, written

#: Fixed weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
#: Distinct sources are planned on the driver; more than this is an error.
MAX_SOURCES = 100_000
_EPS = 1e-9


@dataclass
class Source:
    index: int
    name: str | None
    size: int
    rows: int
    target: float

    @property
    def copies(self) -> int:
        return min(MAX_REPEAT, math.floor(self.target / self.size + _EPS)) if self.size else 0

    @property
    def extra(self) -> float:
        """Inclusion probability of one more copy."""
        return max(0.0, self.target / self.size - self.copies) if self.size else 0.0


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def plan_targets(sizes: list[tuple[str | None, int, int]], weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> list[Source]:
    """Targets of ``(name, size, rows)``: weights by code point of the name (null last),
    capped at ``max_repeat`` times the size, the excess shared again by weight."""
    order = sorted(sizes, key=lambda r: (r[0] is None, [ord(c) for c in r[0] or ""]))
    total = sum(s for _, s, _ in order)
    weight = [weights[i % len(weights)] for i in range(len(order))]
    cap = [float(max_repeat * s) for _, s, _ in order]
    target, open_ = [0.0] * len(order), set(range(len(order)))
    while open_:
        left = total - sum(cap[i] for i in range(len(order)) if i not in open_)
        share = sum(weight[i] for i in open_)
        above = {i for i in open_ if left * weight[i] / share > cap[i]}
        for i in above or open_:
            target[i] = cap[i] if above else left * weight[i] / share
        if not above:
            break
        open_ -= above
    return [Source(i, n, s, r, target[i]) for i, (n, s, r) in enumerate(order)]


def flight(prob: list[float], size: list[float], rng: np.random.Generator) -> list[float]:
    """Flight phase over one block, balanced on documents and words; at most two stay open."""
    prob = list(prob)
    draws, at = rng.random(len(prob) + 1).tolist(), 0
    active: list[int] = []
    for k in range(len(prob)):
        if not _EPS < prob[k] < 1 - _EPS:
            prob[k] = float(round(prob[k]))
            continue
        active.append(k)
        if len(active) < 3:
            continue
        a, b, c = (size[i] for i in active)
        u = (c - b, a - c, b - a)
        if u == (0.0, 0.0, 0.0):
            u = (1.0, -1.0, 0.0)
        up = min((1 - prob[i]) / x if x > 0 else -prob[i] / x for i, x in zip(active, u) if x)
        down = min(prob[i] / x if x > 0 else (prob[i] - 1) / x for i, x in zip(active, u) if x)
        step = up if draws[at] * (up + down) < down else -down
        at += 1
        still = []
        for i, x in zip(active, u):
            prob[i] += step * x
            if _EPS < prob[i] < 1 - _EPS:
                still.append(i)
            else:
                prob[i] = float(round(prob[i]))
        active = still
    return prob


def reserve(prob: list[float], size: list[float], most: int = 14) -> set[int]:
    """Open documents kept for the landing: half at ranks 0, 1, 3, 7, ... by size, half evenly spread."""
    order = sorted((i for i, p in enumerate(prob) if _EPS < p < 1 - _EPS), key=lambda i: (-size[i], i))
    half = most // 2
    ranks = {(1 << k) - 1 for k in range(half)} | {round((k + 0.5) * len(order) / half) for k in range(half)}
    return {i for r, i in enumerate(order) if r in ranks}


def landing(prob: list[float], size: list[float]) -> list[float]:
    """Close the open probabilities by the rounding nearest in words (and documents).

    At most ``reserve`` and two more are open, so all roundings are compared.
    """
    open_ = [i for i, p in enumerate(prob) if _EPS < p < 1 - _EPS]
    out = [float(round(p)) for p in prob]
    if not open_:
        return out
    words, docs = np.zeros(1), np.zeros(1)
    for i in open_:  # bit j of a rounding's number is the choice for the j-th open document
        words = np.concatenate([words - size[i] * prob[i], words + size[i] * (1 - prob[i])])
        docs = np.concatenate([docs - prob[i], docs + 1 - prob[i]])
    best = int(np.argmin(np.round(np.abs(words) + np.abs(docs), 6)))
    for j, i in enumerate(open_):
        out[i] = float((best >> j) & 1)
    return out


def _fly(rows: DataFrame, blocks: dict[int, int], level: int, seed: int) -> DataFrame:
    """One level: every block of every source runs its flight; a source's single block also lands."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        src, block = int(key[0]), int(key[1])
        pdf = pdf.sort_values("row", ignore_index=True)
        size, start = pdf["size"].astype(float).tolist(), pdf["prob"].tolist()
        held = reserve(start, size)
        prob = flight([0.0 if i in held else p for i, p in enumerate(start)], size,
                      np.random.default_rng([seed, level, src, block]))
        for i in held:
            prob[i] = start[i]
        if blocks[src] == 1:
            prob = landing(prob, size)
        return pdf.assign(prob=prob)

    return rows.groupBy("src", "block").applyInPandas(run, rows.schema)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        block_rows: int = 4096, seed: int = 20) -> tuple[DataFrame, list[Source]]:
    """``(id, src, size, copies)`` for every row, and the sources with their targets.

    Empty and null texts have size 0; a source of size 0 gets target 0.  Repeated
    rows are drawn one by one.  Other columns are not read.  Reruns agree, whatever
    the files and partitions are: rows equal in id, source and text are alike.
    """
    return _mix(docs, [], id_col, text_col, source_col, block_rows, seed)


def _mix(docs: DataFrame, carry: list[str], id_col: str, text_col: str, source_col: str, block_rows: int,
         seed: int) -> tuple[DataFrame, list[Source]]:
    """``mix`` with the columns ``carry`` of each row: ``(id, src, size, copies, ...)``."""
    spark = docs.sparkSession
    source = F.col(source_col).cast("string")
    sized = docs.select(F.coalesce(F.concat(F.lit("1"), source), F.lit("0")).alias("place"), source.alias("source"),
                        F.col(id_col).cast("long").alias("id"), word_count(F.col(text_col)).alias("size"),
                        F.xxhash64(text_col).alias("digest"), F.xxhash64(F.lit(seed), id_col, text_col).alias("h"), *carry)
    # the order of a source's rows is that of a hash of their values: chance to sizes, the same in every run
    numbered = ranked(sized, ["place", "h", "id", "size", "digest"], "row", within="place").drop("place", "h", "digest")
    totals = numbered.groupBy("source").agg(F.sum("size"), F.count(F.lit(1))).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    plan = plan_targets([tuple(r) for r in totals])
    names = spark.createDataFrame([(s.index, s.name, s.copies, s.extra) for s in plan],
                                  "src int, name string, base int, prob double")
    state = numbered.join(F.broadcast(names), F.col("source").eqNullSafe(F.col("name"))).select(
        "id", "src", "size", "base", "prob", "row", F.expr(f"row div {block_rows}").alias("block"), *carry)
    blocks = {s.index: tasks_for(s.rows, block_rows) for s in plan}
    closed = F.col("prob").isin(0.0, 1.0)
    # a block leaves 16 open documents at most: so many blocks meet in one of the next level
    meet = max(2, block_rows // 16)
    out, level = None, 0
    while True:
        flown = written(_fly(state, blocks, level, seed))
        last = max(blocks.values(), default=1) == 1
        done = flown if last else flown.where(closed)
        out = done if out is None else out.unionByName(done)
        if last:
            break
        state = flown.where(~closed).withColumn("block", F.expr(f"block div {meet}"))
        blocks = {i: tasks_for(n, meet) for i, n in blocks.items()}
        level += 1
    return out.select("id", "src", "size", (F.col("base") + F.col("prob").cast("int")).alias("copies"), *carry), plan


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
               block_rows: int = 4096, seed: int = 20) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as the mix takes it.

    Documents meet their decisions by their row's identity, in one exchange of texts.
    """
    rows, names = identified(docs)
    taken, _ = _mix(rows, names, id_col, text_col, source_col, block_rows, seed)
    times = free_name(rows, "__times")
    decided = taken.where("copies > 0").select(*names, F.sequence(F.lit(1), F.col("copies")).alias(times))
    return rows.join(decided, names).withColumn(times, F.explode(times)).select(*docs.columns)

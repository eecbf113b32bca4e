"""Merkle manifest of a table by nested-struct rollup, and a proof for every row.

A leaf is the hash of a row's columns.  The leaves of a tree ascend in a given order;
while several nodes remain, every eight consecutive ones become the hash of their hashes.
The roots of all trees, in their order, are the leaves of a last tree.

1. Leaves are hashed where they are read and numbered within their tree by one range
   exchange (``common.ranked``), so a tree with a third of all rows is many tasks' work.
2. Rollup: the octal digits of the number are columns; they are grouped away one after
   another within blocks of 512 leaves, each step nesting eight child structs into their
   parent's, all on one exchange by block.  The blocks' nodes are the leaves of the next
   tier, until every tree has one node; a tree of any size costs log512 tiers, and no row
   holds more than a block.
3. Proofs come down: a tier's nested rows meet their block's own proof in one aggregation
   (no join); ``transform`` walks the nested structs, putting each node's brothers on its
   path, and ``explode`` emits the members with their whole paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copair.llm.common import ranked, written

FANOUT_BITS = 3
#: Digits grouped away per tier: blocks of 8 ** 3 nodes.
DIGITS = 3
_PATH = "array<struct<left:string,right:string>>"
_LOWER = "abcdefghijklmnopqrstuvwxyz"


def field(col: Column) -> Column:
    """A value as it enters a hash: ``-`` if null, else UTF-8 byte count, ``:``, value."""
    text = col.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def hashed(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the concatenated parts."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, _LOWER.upper(), _LOWER)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path of brothers give."""
    return F.aggregate(path, leaf, lambda acc, p: hashed(p.left, acc, p.right))


def proof_hash(path: Column) -> Column:
    """Hash of all brothers on a path, level by level, left to right."""
    return hashed(F.array_join(F.transform(path, lambda p: F.concat(p.left, p.right)), ""))


def _run_hash(children: Column) -> Column:
    return hashed(F.array_join(F.transform(children, lambda c: c.hash), ""))


def _brothers(children: Column, i: Column) -> Column:
    """The hashes before and after child ``i`` (from 0) of a run."""
    text = lambda part: F.array_join(F.transform(part, lambda c: c.hash), "")
    return F.struct(text(F.slice(children, 1, i)).alias("left"),
                    text(F.slice(children, i + 2, F.size(children))).alias("right"))


def _rollup(nodes: DataFrame) -> DataFrame:
    """``(tree, rank, n, hash, data)`` -> ``(tree, block, n, hash, kids)``, a nested row per block.

    ``n`` is the tree's number of nodes in this tier.  A level is hashed if more than one
    node of the tree remains below it; otherwise the lone node passes.
    """
    digit = lambda k: F.shiftright("rank", FANOUT_BITS * k).bitwiseAND(F.lit(7)).cast("byte")
    rows = nodes.select("tree", F.shiftright("rank", FANOUT_BITS * DIGITS).alias("block"), "n",
                        *[digit(k).alias(f"d{k}") for k in range(DIGITS)], "hash", "data")
    rows = rows.repartition("tree", "block")
    below = ["hash", "data"]
    for k in range(DIGITS):
        keys = ["tree", "block", *[f"d{j}" for j in range(k + 1, DIGITS)]]
        run = F.array_sort(F.collect_list(F.struct(f"d{k}", *below)))
        rows = rows.groupBy(*keys).agg(F.first("n").alias("n"), run.alias("kids"))
        several = F.col("n") > F.lit(1 << (FANOUT_BITS * k))  # nodes remain below this level
        rows = rows.withColumn("hash", F.when(several, _run_hash(F.col("kids"))).otherwise(F.element_at("kids", 1).hash))
        below = ["hash", "kids"]
    return rows.select("tree", "block", "n", "hash", "kids")


def _members(kids: Column, n: Column, path: Column, level: int) -> Column:
    """All members below ``kids``, nodes of ``level``, each with its path (lowest level first)."""
    several = n > F.lit(1 << (FANOUT_BITS * level))

    def member(kid: Column, i: Column) -> Column:
        own = F.when(several, F.concat(F.array(_brothers(kids, i)), path)).otherwise(path)
        if level == 0:
            return F.array(F.struct(kid.hash.alias("hash"), kid.data.alias("data"), own.alias("path")))
        return _members(kid.kids, n, own, level - 1)

    return F.flatten(F.transform(kids, member))


def _emitted(nested: DataFrame, paths: DataFrame) -> DataFrame:
    """``(tree, hash, data, path, top)`` of every member, given ``paths(tree, block, path, top)`` of the blocks."""
    empty = lambda name, of: F.lit(None).cast(of.schema[name].dataType).alias(name)
    own = nested.select("tree", "block", "n", "kids", empty("path", paths), empty("top", paths))
    above = paths.select("tree", "block", empty("n", nested), empty("kids", nested), "path", "top")
    # one nested row and one path per block
    met = own.unionByName(above).groupBy("tree", "block").agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in ("n", "kids", "path", "top")])
    found = _members(F.col("kids"), F.col("n"), F.col("path"), DIGITS - 1)
    return met.select("tree", "top", F.explode(found).alias("m")).select("tree", "m.hash", "m.data", "m.path", "top")


def _proved(nodes: DataFrame, above) -> DataFrame:
    """Members ``(tree, hash, data, path, top)`` of all trees in ``nodes(tree, rank, n, hash, data)``.

    ``above(roots)`` gives ``(tree, path, top)``: what continues the paths of a tree, and what to say of it.
    """
    tiers, tier, bits = [], nodes, FANOUT_BITS * DIGITS
    while True:
        tiers.append(written(_rollup(tier)))
        most = tiers[-1].agg(F.max("n")).first()[0] or 0
        if most <= 1 << bits:
            break
        tier = tiers[-1].select("tree", F.col("block").alias("rank"), F.shiftright(F.col("n") + ((1 << bits) - 1), bits).alias("n"),
                                "hash", F.col("block").alias("data"))
    paths = above(tiers[-1].select("tree", "hash")).select("tree", F.lit(0).cast("long").alias("block"), "path", "top")
    for nested in reversed(tiers[1:]):
        paths = _emitted(nested, paths).select("tree", F.col("data").alias("block"), "path", "top")
    return _emitted(tiers[0], paths)


def _top(roots: DataFrame) -> DataFrame:
    """The tree of all trees' roots: ``(tree, path, top(subroot, root))``."""
    ranks = ranked(roots, ["tree"], "rank", total="n")
    nodes = ranks.select(F.lit("").alias("tree"), "rank", "n", "hash", F.struct("tree", F.col("hash").alias("subroot")).alias("data"))
    no_path = F.array().cast(_PATH).alias("path")
    found = _proved(nodes, lambda root: root.select("tree", no_path, F.col("hash").alias("top")))
    return written(found.select("data.tree", "path", F.struct("data.subroot", F.col("top").alias("root")).alias("top")))


def manifest(docs: DataFrame, columns: list[str], tree: str, order: str, carry: dict[str, Column] | None = None) -> DataFrame:
    """``(order, leaf, subroot, root, path)`` and the columns of ``carry``: a row per row of ``docs``.

    A leaf hashes ``columns`` in their order (``field``).  The leaves of a tree, the rows
    with one value of ``tree``, ascend by ``order`` and then by their hash, nulls first; rows
    equal in both are interchangeable.  Trees ascend bytewise, null first.  ``path`` holds
    each level's brothers before and after, via the subroot to the root.  Null and empty
    values hash differently, texts are hashed whole, repeated rows are leaves of their own,
    other columns are not read, and an empty table gives no rows.
    """
    leaf = hashed(*[field(F.col(c)) for c in columns])
    # the null tree is a value of its own, before all others
    name = F.coalesce(F.concat(F.lit("1"), F.col(tree).cast("string")), F.lit("0"))
    read = docs.select(name.alias("tree"), F.col(order).alias("place"), leaf.alias("hash"),
                       F.struct(*[c.alias(k) for k, c in (carry or {"": F.lit(None)}).items()]).alias("data"))
    nodes = ranked(read, ["tree", "place", "hash"], "rank", within="tree", total="n").withColumn(
        "data", F.struct("place", F.col("data").alias("more")))
    out = _proved(nodes, _top)
    more = [F.col(f"data.more.{k}").alias(k) for k in carry or {}]
    return out.select(F.col("data.place").alias(order), F.col("hash").alias("leaf"), "top.subroot", "top.root", "path", *more)

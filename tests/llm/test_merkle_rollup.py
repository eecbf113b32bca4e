import hashlib

import pytest
from pyspark.sql import functions as F

from copair.llm import merkle_rollup as mr
from tests.llm.helpers import no_docs, odd_docs


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_tree(leaves):
    """Root and, per leaf, the brothers (before, after) level by level."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for i in range(len(leaves)):
            run = at[i] // 8 * 8
            paths[i].append(("".join(level[run:at[i]]), "".join(level[at[i] + 1:run + 8])))
        level = [sha("".join(level[k:k + 8])) for k in range(0, len(level), 8)]
        at = [a // 8 for a in at]
    return level[0], paths


def plain_manifest(rows):
    """``rows(tree, order, leaf)`` -> sorted (order, leaf, subroot, root, path)."""
    trees = {}
    for t, o, leaf in rows:
        trees.setdefault(t, []).append((o is not None, o, leaf))
    names = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    made = {t: plain_tree([x[2] for x in sorted(trees[t], key=lambda x: (x[0], x[1] or 0, x[2]))]) for t in names}
    root, tops = plain_tree([made[t][0] for t in names])
    out = []
    for k, t in enumerate(names):
        for x, path in zip(sorted(trees[t], key=lambda x: (x[0], x[1] or 0, x[2])), made[t][1]):
            out.append((x[1], x[2], made[t][0], root, path + tops[k]))
    return sorted(out, key=repr)


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def check(docs, digits=None):
    out = mr.manifest(docs, COLUMNS, tree="lang", order="doc_id", carry={"extra": F.lit(5)})
    got = sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], [tuple(p) for p in r["path"]]) for r in out.collect()), key=repr)
    rows = [(r["lang"], r["doc_id"], sha("".join(field(r[c]) for c in COLUMNS))) for r in docs.collect()]
    assert got == plain_manifest(rows)
    return out


def test_odd_documents(spark):
    out = check(odd_docs(spark))
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "path", "extra"]


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 511, 512, 513, 1100])
def test_sizes_of_one_tree(spark, n):
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("en").alias("lang"),
                                 F.lit(None).cast("long").alias("n_chars"), F.concat(F.lit("t"), "id").alias("text"))
    check(docs)


def test_many_tiers_and_trees(spark, monkeypatch):
    # blocks of 8 leaves: every level is a tier of its own
    monkeypatch.setattr(mr, "DIGITS", 1)
    docs = spark.range(900, numPartitions=5).select(
        (F.col("id") * 37 % 901).alias("doc_id"), F.lit(None).cast("string").alias("source"),
        F.when(F.col("id") % 3 > 0, F.concat(F.lit("é"), (F.col("id") % 17).cast("string"))).alias("lang"),
        F.col("id").alias("n_chars"), F.lit("x").alias("text"))
    check(docs)


def test_copies_of_one_row(spark):
    one = spark.range(700, numPartitions=4).select(F.lit(3).cast("long").alias("doc_id"), F.lit("s").alias("source"), F.lit("de").alias("lang"),
                                                   F.lit(1).cast("long").alias("n_chars"), F.lit("same").alias("text"))
    check(one)


def test_paths_fold_to_the_root_and_tampering_shows(spark):
    out = mr.manifest(odd_docs(spark), COLUMNS, tree="lang", order="doc_id").withColumns({
        "good": mr.folded(F.col("leaf"), F.col("path")) == F.col("root"),
        "bad": mr.folded(F.sha2(F.lit("x").cast("binary"), 256), F.col("path")) == F.col("root"),
        "proof": mr.proof_hash(F.col("path"))})
    rows = out.collect()
    assert all(r["good"] and not r["bad"] for r in rows)
    assert all(r["proof"] == sha("".join(a + b for a, b in r["path"])) for r in rows)


def test_no_joins_emit_proofs(spark):
    plan = mr.manifest(odd_docs(spark), COLUMNS, tree="lang", order="doc_id")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate explode" in plan


def test_empty_table(spark):
    assert mr.manifest(no_docs(spark), COLUMNS, tree="lang", order="doc_id").count() == 0

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from copair.llm import cp_lsh, rp_forest, vectors

SCHEMA = "vec_id long, embedding array<float>, label int"
NAN = float("nan")


def cloud(n, dims, seed, groups=0, spread=0.02):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dims))
    for g in range(groups):
        start = rng.standard_normal(dims)
        x[g * 12:(g + 1) * 12] = start + spread * math.sqrt(dims) * rng.standard_normal((12, dims))
    return x.astype(np.float32).astype(float)


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(c) for c in v], 0) for i, v in enumerate(x)], SCHEMA)


def odd_vectors(spark, dims):
    """Null, zero, broken, short and repeated vectors, and clashing extra columns."""
    one = [1.0] + [0.0] * (dims - 1)
    rows = [(9001, None, 0), (9002, [0.0] * dims, 0), (9003, [NAN] + [1.0] * (dims - 1), 0), (9004, [None] + [1.0] * (dims - 1), 0),
            (9005, [math.inf] + [1.0] * (dims - 1), 0), (9006, [1.0, 2.0], 0), (9007, [], 0), (None, one, 0),
            (9010, one, 0), (9050, one, 1), (9011, one, 2), (9011, one, 2), (9012, [2.0] + [0.0] * (dims - 1), 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit("x") for c in ("id", "v", "vid", "n", "copies", "t", "code", "q", "score")})


def plain(df):
    return df.select("vec_id", "embedding", "label")


def test_groups_stay_whole_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = spark.range(200).select((F.col("id") % 13).alias("k"), "id")
        out = vectors.by_group(rows, ["k"], ["id"], "k long, n long", ["k", "id"],
                               lambda t, b: iter([{"k": t.column("k").to_numpy()[b[:-1]], "n": np.diff(b)}])).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r["k"], r["n"]) for r in out) == [(k, len(range(k, 200, 13))) for k in range(13)]


def test_hadamard_is_orthonormal():
    h = cp_lsh.hadamard(np.eye(16))
    assert np.allclose(h @ h.T, np.eye(16)) and np.allclose(np.abs(h), 0.25)


def brute_links(rows, least=0.95):
    """Ids of usable rows, links per row and components over all pairs."""
    x = np.array([v for _, v in rows])
    s = np.array([vectors.cosine(np.repeat(x[i:i + 1], len(x), 0), x) for i in range(len(x))])
    linked = s >= least
    np.fill_diagonal(linked, False)
    label = np.array([i for i, _ in rows])
    while True:
        low = np.array([min([label[i], *label[linked[i]]]) for i in range(len(x))])
        if (low == label).all():
            return linked.sum(1), label
        label = low


@pytest.mark.parametrize("chunk_rows", [2000, 5])
def test_near_duplicates_against_brute_force(spark, chunk_rows):
    x = cloud(150, 24, 1, groups=6)
    odd = odd_vectors(spark, 24)
    df = frame(spark, x).unionByName(plain(odd))
    usable = [(r["vec_id"], r["embedding"]) for r in df.collect()
              if r["vec_id"] is not None and (r["vec_id"] < 9000 or r["vec_id"] > 9009)]
    links, label = brute_links(usable)
    want = sorted(zip([i for i, _ in usable], links.tolist(), label.tolist()))
    out = cp_lsh.near_duplicates(df, chunk_rows=chunk_rows).collect()
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in out if r["vec_id"] in dict(usable))
    assert got == want and max(links) > 5
    alone = [r for r in out if r["vec_id"] not in dict(usable)]
    assert len(alone) == 8 and all(r["n_links"] == 0 and r["component_id"] == r["vec_id"] and r["kept"] for r in alone)


def two_lengths(spark):
    """101 vectors of 6 and 200 of 8 components, near copies and equal vectors among both."""
    short, long = cloud(101, 6, 5, groups=2), cloud(200, 8, 6, groups=3)
    short[60] = short[50]
    return list(enumerate([*short.tolist(), *long.tolist()]))


def test_near_duplicates_of_two_lengths(spark):
    rows = two_lengths(spark)
    want = []
    for n in (6, 8):
        of_length = [r for r in rows if len(r[1]) == n]
        links, label = brute_links(of_length)
        want += zip([i for i, _ in of_length], links.tolist(), label.tolist())
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    got = [(r["vec_id"], r["n_links"], r["component_id"]) for r in cp_lsh.near_duplicates(df).collect()]
    assert sorted(got) == sorted(want)
    assert {(50, 1, 50), (60, 1, 50)} <= set(got)


def test_near_duplicates_with_extra_columns_and_empty(spark):
    assert cp_lsh.near_duplicates(odd_vectors(spark, 8)).count() == 13
    assert cp_lsh.near_duplicates(odd_vectors(spark, 8).limit(0)).count() == 0


def test_recall_at_the_threshold():
    rng = np.random.default_rng(4)
    a = vectors.unit(rng.standard_normal((2000, 64)))
    z = rng.standard_normal((2000, 64))
    z = vectors.unit(z - (z * a).sum(1, keepdims=True) * a)
    b = 0.951 * a + math.sqrt(1 - 0.951 ** 2) * z
    found = np.zeros(2000, dtype=bool)
    for t in range(5):
        p, q = cp_lsh.probe_codes(a, t, 3), cp_lsh.probe_codes(b, t, 3)
        found |= (p[:, :1] == q).any(1) | (q[:, :1] == p).any(1)
    assert found.mean() > 0.99


def brute_nearest(rows, k):
    out = {}
    for q, v in rows:
        if q % 50 == 0:
            a = np.array([v])
            near = {(-float(vectors.cosine(a, np.array([w]))[0]), i) for i, w in rows if i != q}
            out[q] = [i for _, i in sorted(near)[:k]]
    return out


def test_search_reaches_recall_and_exact_order(spark):
    x = cloud(1500, 16, 2, groups=20)
    df = frame(spark, x)
    out = rp_forest.search(df, F.col("id") % 50 == 0, leaf_rows=64).collect()
    want = brute_nearest(list(enumerate(x.tolist())), 5)
    got = {}
    for r in sorted(out, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got.keys() == want.keys() and all(len(v) == 5 for v in got.values())
    assert np.mean([len(set(got[q]) & set(want[q])) / 5 for q in want]) >= 0.9
    for r in out:
        assert r["score"] == pytest.approx(float(vectors.cosine(x[[r["query_id"]]], x[[r["vec_id"]]])[0]), abs=1e-15)


def test_search_of_two_lengths_and_few_rows(spark):
    rows = two_lengths(spark)
    rows += [(900 + i, [1.0 + i, 2.0, -float(i)]) for i in range(4)]  # fewer than five candidates
    out = rp_forest.search(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA), F.col("id") % 50 == 0, leaf_rows=16)
    got = {}
    for r in out.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    size = {i: len(v) for i, v in rows}
    want = {}
    for n in (3, 6, 8):
        want |= brute_nearest([r for r in rows if len(r[1]) == n], 5)
    assert got.keys() == want.keys() == {0, 50, 100, 150, 200, 250, 300, 900}
    assert all(size[c] == size[q] for q, near in got.items() for c in near)
    assert {q: len(near) for q, near in got.items()} == {q: len(near) for q, near in want.items()}
    assert np.mean([len(set(got[q]) & set(want[q])) / len(want[q]) for q in want]) >= 0.9


def test_queue_goes_on_until_a_tree_holds_enough(spark):
    forest = rp_forest.fit(vectors.unit(cloud(256, 8, 7)), 256, 4, 8, 1)
    leaves = 1 << forest.depth
    held = np.zeros((4, leaves), dtype=np.int64)
    held[2, leaves - 1] = 6
    q = vectors.unit(cloud(1, 8, 8))[0]
    assert len(forest.visits(q, 1)) == 1 and leaves > 4
    seen = forest.visits(q, 1, held, 6)
    assert (2, leaves - 1) == seen[-1]
    assert len(forest.visits(q, 1, held, 7)) == 4 * leaves == len(set(forest.visits(q, 1, held, 7)))


def test_search_of_odd_vectors(spark):
    out = rp_forest.search(odd_vectors(spark, 8), F.col("id") % 50 == 0).orderBy("rank").collect()
    # 9050 asks; 9010, 9011 and 9012 are all at cosine 1, smaller ids first
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in out] == [(9050, 9010, 1.0), (9050, 9011, 1.0), (9050, 9012, 1.0)]


def test_search_with_many_copies(spark):
    same = [[1.0, 0.0, 0.5, 0.0]] * 400
    df = frame(spark, np.vstack([same, cloud(50, 4, 3)]))
    out = rp_forest.search(df, F.col("id") % 50 == 0)
    got = {}
    for r in out.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got[0] == [1, 2, 3, 4, 5] and got[100] == [0, 1, 2, 3, 4] and len(got) == 9


def test_search_of_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert rp_forest.search(empty, F.col("id") % 50 == 0).count() == 0
    no_query = frame(spark, cloud(5, 4, 1), first=1)
    assert rp_forest.search(no_query, F.col("id") % 50 == 0).count() == 0

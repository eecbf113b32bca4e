import numpy as np
import pytest
from pyspark.sql import functions as F

from copair.llm import spectrum_slicing as ss


def symmetric(seed):
    """Random, low-rank, clustered and diagonal matrices."""
    rng = np.random.default_rng(seed)
    d = int(rng.integers(1, 40))
    kind = seed % 4
    if kind == 0:
        a = rng.standard_normal((d, d))
        return a @ a.T
    if kind == 1:
        a = rng.standard_normal((d, int(rng.integers(1, d + 1))))
        return a @ a.T
    if kind == 2:
        q, _ = np.linalg.qr(rng.standard_normal((d, d)))
        return q @ np.diag(np.r_[np.full(min(3, d), 5.0), np.linspace(1, 2, max(0, d - 3))]) @ q.T
    return np.diag(rng.integers(0, 3, d).astype(float))


@pytest.mark.parametrize("seed", range(32))
def test_counts_and_pairs_of_symmetric_matrices(seed):
    v = symmetric(seed)
    v = (v + v.T) / 2
    true = np.linalg.eigvalsh(v)[::-1]
    for shift in np.random.default_rng(seed).uniform(-1, true[0] + 1, 5):
        assert ss.inertia(v - shift * np.eye(len(v)))[0] == (true > shift).sum()
    values, vectors = ss.leading(v, 16)
    true = true[:16]
    true = true[true > 1e-11 * v.diagonal().max()] if v.any() else true[:0]
    assert len(values) == len(true) and np.allclose(values, true, rtol=1e-11)
    assert np.abs(vectors @ vectors.T - np.eye(len(values))).max(initial=0) < 1e-10
    assert np.abs(v @ vectors.T - vectors.T * values).max(initial=0) < 1e-10 * max(1.0, np.trace(v))


def vectors_table(spark, seed=0, n=300, d=20):
    rng = np.random.default_rng(seed)
    x = (rng.standard_normal((n, d)) * np.linspace(2, 0.5, d)).astype(np.float32)
    x[5] = x[6]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    rows += [(900, None), (901, [1.0] * (d - 1) + [None]), (902, [float("nan")] + [0.0] * (d - 1)),
             (903, [float("inf")] * d), (904, []), (905, [0.0] * d), (3, rows[3][1]), (None, rows[4][1])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def plain(rows, k=16):
    """Brute force over all rows: (id, component) -> (n, deviation, |whitened|, explained)."""
    x = np.floor(64 * np.array([r[1] for r in rows], dtype=float)).astype(int) + 1_000_000
    u = np.unique(x, axis=0)
    n, total = len(u), u.sum(axis=0)
    c = u - total / n
    v = c.T @ c / n
    e, w = np.linalg.eigh(v)
    e, w = e[::-1][:k], w[:, ::-1][:, :k]
    out = []
    for (key, _), xi in zip(rows, x):
        dev = sum(int(t) ** 2 for t in n * xi.astype(object) - total)
        for j in range(len(e)):
            out.append((key, j + 1, n, dev, abs((xi - total / n) @ w[:, j]) / np.sqrt(e[j]), e[j] / np.trace(v)))
    return out


def test_whitening_equals_brute_force(spark):
    table = vectors_table(spark).withColumns({c: F.lit(1) for c in ("id", "x", "i", "cells", "component")})
    good = [(r["vec_id"], r["embedding"]) for r in table.collect()
            if r["embedding"] and all(c is not None and np.isfinite(c) for c in r["embedding"])]
    got = sorted(((r["id"], r["component"], r["n"], int(r["deviation"]), abs(r["whitened"]), r["explained"])
                  for r in ss.whiten(table).collect()), key=repr)
    want = sorted(plain(good), key=repr)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert np.allclose([g[4:] for g in got], [w[4:] for w in want], rtol=1e-9, atol=1e-9)


def test_identity_and_one_sign_for_all(spark):
    rows = ss.whiten(vectors_table(spark, 1)).collect()
    assert {r["identity_error"] for r in rows} == {rows[0]["identity_error"]} and rows[0]["identity_error"] < 1e-9
    by_id = {}
    for r in rows:
        by_id.setdefault(r["id"], {})[r["component"]] = r["whitened"]
    assert len(by_id[5]) == 16 and all(np.isclose(by_id[5][c], by_id[6][c], rtol=1e-12) for c in by_id[5])


def test_few_dimensions_one_vector_and_none(spark):
    flat = spark.createDataFrame([(i, [float(i % 7), 2.0, float(i % 7)]) for i in range(50)], "vec_id long, embedding array<float>")
    rows = ss.whiten(flat).collect()
    assert {r["component"] for r in rows} == {1} and len(rows) == 50 and abs(rows[0]["explained"] - 1) < 1e-12
    assert ss.whiten(flat.where("vec_id = 3")).count() == 0
    assert ss.whiten(flat.limit(0)).count() == 0


def test_widths_are_whitened_apart(spark):
    a, b = vectors_table(spark, 2, 80, 6), vectors_table(spark, 3, 60, 4)
    both = ss.whiten(a.unionByName(b)).agg(F.count(F.lit(1)), F.collect_set("n")).first()
    apart = [ss.whiten(t).agg(F.count(F.lit(1)), F.max("n")).first() for t in (a, b)]
    assert both[0] == apart[0][0] + apart[1][0] and set(both[1]) == {apart[0][1], apart[1][1]}


def test_deviations_beyond_64_bits_are_exact(spark):
    rows = [(i, [float(v) for v in np.random.default_rng(i).integers(-10 ** 9, 10 ** 9, 3)]) for i in range(40)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["id"], r["component"]): int(r["deviation"]) for r in ss.whiten(table).collect()}
    assert got == {(w[0], w[1]): w[3] for w in plain(rows)} and max(got.values()) > 1 << 63

import numpy as np
from pyspark.sql import functions as F

from copair.llm import cube_mix
from tests.llm.helpers import no_docs, odd_docs, rows_of


def test_targets_cap_and_share_again():
    plan = cube_mix.plan_targets([("b", 100, 1), ("a", 10, 1), (None, 50, 1), ("c", 40, 1)])
    by = {s.name: s.target for s in plan}
    assert [s.name for s in plan] == ["a", "b", "c", None]
    assert by["a"] == 30  # weight 5, capped at 3 x 10; the other 170 go 2 : 1 : 5 to b, c and null
    assert np.isclose(by["b"], 200 * 2 / 8 - 30 * 2 / 8) and np.isclose(by[None], 170 * 5 / 8)
    assert np.isclose(sum(by.values()), 200)


def test_targets_of_empty_sources():
    assert cube_mix.plan_targets([]) == []
    assert [s.target for s in cube_mix.plan_targets([("a", 0, 3), ("b", 0, 1)])] == [0, 0]


def test_flight_keeps_totals():
    rng = np.random.default_rng(0)
    size = rng.integers(0, 900, 500).astype(float).tolist()
    prob = [0.37] * 500
    out = cube_mix.flight(prob, size, np.random.default_rng(1))
    assert sum(1e-9 < p < 1 - 1e-9 for p in out) <= 2
    assert np.isclose(sum(out), sum(prob)) and np.isclose(np.dot(out, size), np.dot(prob, size))


def test_flight_is_unbiased():
    size = [5.0, 1.0, 8.0, 3.0, 3.0, 9.0]
    prob = [0.2, 0.5, 0.7, 0.4, 0.9, 0.3]
    mean = np.mean([cube_mix.flight(prob, size, np.random.default_rng(s)) for s in range(4000)], axis=0)
    assert np.abs(mean - prob).max() < 0.03


def test_mix_of_odd_documents(spark):
    docs = odd_docs(spark)
    taken, plan = cube_mix.mix(docs)
    rows = taken.collect()
    assert len(rows) == docs.count()
    assert all(0 <= r["copies"] <= 3 for r in rows)
    size = {r["id"]: r["size"] for r in rows}
    assert size[3] == size[4] == size[5] == 0 and size[6] == 30000 and size[8] == 1 and size[None] == 5
    again, _ = cube_mix.mix(docs.repartition(7))
    assert rows_of(taken, "id", "size", "copies") == rows_of(again, "id", "size", "copies")


def test_many_blocks_meet_targets(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"),
                                    F.repeat(F.lit("w "), (F.col("id") * 7919 % 101).cast("int")).alias("text"))
    taken, plan = cube_mix.mix(docs, block_rows=200)
    got = {r[0]: r[1] for r in taken.groupBy("src").agg(F.sum(F.col("size") * F.col("copies"))).collect()}
    for s in plan:
        assert abs(got[s.index] - s.target) <= 2
    mixed = cube_mix.mixed_rows(docs, block_rows=200)
    assert mixed.columns == docs.columns
    words = {r[0]: r[1] for r in mixed.groupBy("source").agg(F.sum(cube_mix.word_count(F.col("text")))).collect()}
    assert words == {s.name: got[s.index] for s in plan}


def test_mixed_rows_repeat_whole_rows(spark):
    docs = odd_docs(spark)
    taken, _ = cube_mix.mix(docs)
    out = cube_mix.mixed_rows(docs)
    assert out.columns == docs.columns
    assert out.count() == taken.agg(F.sum("copies")).first()[0]


def test_empty_table(spark):
    taken, plan = cube_mix.mix(no_docs(spark))
    assert taken.count() == 0 and plan == []
    assert cube_mix.mixed_rows(no_docs(spark)).count() == 0


def nearly_same_docs(spark, n=3000, parts=6):
    return spark.range(n, numPartitions=parts).select(
        F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 2).alias("source"),
        F.concat(F.lit("n"), "id", F.repeat(F.lit(" w"), (F.col("id") % 6 * 3).cast("int"))).alias("text"))


def test_rows_without_ids_meet_their_own_decisions(spark):
    docs = nearly_same_docs(spark)
    rows, names = cube_mix.identified(docs)
    taken, plan = cube_mix._mix(rows, names, "doc_id", "text", "source", 100, 20)
    copies = {tuple(r[c] for c in names): r["copies"] for r in taken.collect()}
    assert len(copies) == 3000
    want = sorted(r["text"] for r in rows.collect() for _ in range(copies[tuple(r[c] for c in names)]))
    mixed = cube_mix.mixed_rows(docs, block_rows=100)
    assert want == sorted(r["text"] for r in mixed.collect())
    words = {r[0]: r[1] for r in mixed.groupBy("source").agg(F.sum(cube_mix.word_count(F.col("text")))).collect()}
    for s in plan:
        assert abs(words[s.name] - s.target) <= 20
    per_text = mixed.groupBy("text").count().agg(F.max("count")).first()[0]
    assert per_text <= max(s.copies for s in plan) + 1
    assert "collect_list" not in mixed._jdf.queryExecution().toString()


def test_reruns_agree_on_any_partitioning(spark):
    takes = []
    for parts in (3, 11):
        taken, _ = cube_mix.mix(nearly_same_docs(spark, parts=parts), block_rows=100)
        takes.append(rows_of(taken, "id", "src", "size", "copies"))
    assert takes[0] == takes[1]


def test_equal_rows_are_split_into_blocks(spark):
    docs = spark.range(2000, numPartitions=4).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a").alias("source"),
                                                     F.lit("v w x y z").alias("text"))
    taken, plan = cube_mix.mix(docs.unionByName(docs.limit(700).withColumn("source", F.lit("b"))), block_rows=50)
    assert taken.count() == 2700
    for s in plan:
        got = taken.where(F.col("src") == s.index).agg(F.sum(F.col("size") * F.col("copies"))).first()[0]
        assert abs(got - s.target) <= 5


def test_landing_equals_all_roundings():
    rng = np.random.default_rng(4)
    for _ in range(30):
        n = int(rng.integers(1, 9))
        prob, size = rng.random(n).tolist(), rng.integers(0, 50, n).astype(float).tolist()
        out = cube_mix.landing(prob, size)
        miss = lambda c: abs(np.dot(np.array(c) - prob, size)) + abs(np.sum(np.array(c) - prob))
        best = min(miss([(k >> j) & 1 for j in range(n)]) for k in range(1 << n))
        assert set(out) <= {0.0, 1.0} and miss(out) <= best + 1e-6


def test_names_of_users_columns_are_kept(spark):
    docs = odd_docs(spark).withColumns({c: F.lit(7) for c in ("__file", "__at", "__times", "__tie", "__part")})
    out = cube_mix.mixed_rows(docs)
    assert out.columns == docs.columns and out.select("__file", "__at", "__times").distinct().collect() == [(7, 7, 7)]

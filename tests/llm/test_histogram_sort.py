import numpy as np
from pyspark.sql import functions as F

from copair.llm import histogram_sort
from tests.llm.helpers import no_docs, odd_docs


def check_slots(rows, shards):
    for s in range(shards):
        assert sorted(r["__slot"] for r in rows if r["__shard"] == s) == list(range(sum(r["__shard"] == s for r in rows)))


def test_odd_documents(spark):
    docs = odd_docs(spark)
    out = histogram_sort.shard(docs)
    rows = out.collect()
    assert len(rows) == docs.count() and set(docs.columns) < set(out.columns)
    check_slots(rows, 8)


def test_bytes_are_near_equal_with_a_hot_group(spark):
    docs = spark.range(9000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, F.lit("same " * 20)).otherwise(F.repeat(F.col("id").cast("string"), 30)).alias("text"))
    out = histogram_sort.shard(docs, bytes_per_range=20_000).withColumn("size", histogram_sort.byte_size(F.col("text")))
    rows = out.collect()
    check_slots(rows, 8)
    size = [sum(r["size"] for r in rows if r["__shard"] == s) for s in range(8)]
    assert max(size) - min(size) <= 0.005 * np.mean(size) + 2 * 200
    # only the hot group is cut
    shards = {}
    for r in rows:
        shards.setdefault(r["text"], set()).add(r["__shard"])
    assert sum(len(s) > 1 for s in shards.values()) <= 3


def test_splitters_against_brute_force(spark):
    rng = np.random.default_rng(2)
    keys = np.r_[rng.integers(-2**62, 2**62, 500), np.full(300, 12345)]
    size = rng.integers(1, 50, 800)
    keyed = spark.createDataFrame([(int(k), int(s)) for k, s in zip(keys, size)], "key long, size long")
    found = histogram_sort.find_splitters(keyed, 8, 1, tolerance=0.0)
    order = np.argsort(keys, kind="stable")
    borders = np.unique(keys)
    below = {int(b): int(size[keys < b].sum()) for b in borders} | {2**63 - 1: int(size.sum())}
    for j, s in enumerate(found, 1):
        target = size.sum() * j / 8
        got = size[keys < s].sum()
        assert abs(got - target) <= min(abs(b - target) for b in below.values()) + 1e-6
    assert len(order) == 800


def test_histogram_counts_exactly(spark):
    keyed = spark.createDataFrame([(k, 10 + k) for k in (-5, 0, 0, 3, 9)], "key long, size long").repartition(3)
    h = histogram_sort.histogram(keyed, np.array([0, 4]))
    assert h[["gap", "bytes", "rows", "low", "high"]].values.tolist() == [[0, 5, 1, -5, -5], [1, 33, 3, 0, 3], [2, 19, 1, 9, 9]]


def test_one_exchange_with_a_task_per_range(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.col("id").cast("string"), 20).alias("text"))
    out = histogram_sort.shard(docs, bytes_per_range=10_000)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Join" not in plan
    size = out.select(histogram_sort.byte_size(F.col("text")).alias("size"), F.spark_partition_id().alias("task"), "__shard")
    tasks = size.groupBy("task").agg(F.sum("size").alias("bytes"), F.countDistinct("__shard").alias("shards")).collect()
    assert len(tasks) >= 24 and max(t["bytes"] for t in tasks) <= 2 * 10_000 and {t["shards"] for t in tasks} == {1}


def test_columns_of_reserved_names_stay(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a", 7, 8, 9, 10), (1, "a", 7, 8, 9, 11), (None, None, 5, 6, 7, 8)],
                                 "doc_id long, text string, __shard int, __slot int, __key int, __place int")
    out = histogram_sort.shard(docs)
    assert out.columns == [*docs.columns, "__shard_", "__slot_"]
    assert sorted(map(str, out.select(*docs.columns).collect())) == sorted(map(str, docs.collect()))
    assert {(r["__shard_"], r["__slot_"]) for r in out.collect()} <= {(s, i) for s in range(8) for i in range(3)}
    histogram_sort.write_shards(out, f"{tmp_path}/s")
    assert spark.read.parquet(f"{tmp_path}/s").count() == 3


def test_empty_table_and_files(spark, tmp_path):
    assert histogram_sort.shard(no_docs(spark)).count() == 0
    out = histogram_sort.shard(odd_docs(spark).where("doc_id < 3"))
    histogram_sort.write_shards(out, f"{tmp_path}/s")
    assert spark.read.parquet(f"{tmp_path}/s").count() == 3

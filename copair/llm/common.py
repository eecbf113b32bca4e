"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from copair.session import checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders that ``written`` made inside the innermost ``committed``.
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


def written(df: DataFrame, over: Iterable[DataFrame] = ()) -> DataFrame:
    """Write ``df`` as a table under the shared checkpoint folder and read it back.

    Cuts lineage: later reads survive lost executors and never recompute what
    lies above.  Parquet keeps column pruning, which ``checkpoint()`` would lose.
    ``over`` are results of ``written`` that nothing reads after this table:
    they are deleted once it is committed.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/copair-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _delete(spark, [t._written_at for t in over])
    if (made := _MADE.get()) is not None:
        made.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def _delete(spark: SparkSession, paths: Iterable[str]) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


def committed(make: Callable[[], DataFrame], over: Iterable[DataFrame] = ()) -> DataFrame:
    """The table ``make()`` gives, written; the tables that were written on the way are deleted
    once it is, and so are those of ``over``.  If it fails, nothing is deleted."""
    token = _MADE.set([])
    try:
        out = written(make())
        inner = [p for p in _MADE.get() if p != out._written_at]
    finally:
        _MADE.reset(token)
    _delete(out.sparkSession, [*inner, *(t._written_at for t in over)])
    if (outer := _MADE.get()) is not None:
        outer.append(out._written_at)
    return out


def free_name(df: DataFrame, wish: str) -> str:
    """``wish``, lengthened until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def identified(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """``df`` with columns that identify each row at every later read, and their names.

    Rows of a plain Parquet table are named by file and row in it, without a copy;
    other tables are written with row numbers.
    """
    names = [free_name(df, "__file"), free_name(df, "__at")]
    plan = df._jdf.queryExecution().analyzed()
    if (plan.getClass().getSimpleName() == "LogicalRelation" and "_metadata" not in df.columns
            and plan.relation().toString() == "parquet"):
        return df.select("*", F.col("_metadata.file_path").alias(names[0]), F.col("_metadata.row_index").alias(names[1])), names
    return written(df.withColumns({names[0]: F.lit(""), names[1]: F.monotonically_increasing_id()})), names


def ranked(df: DataFrame, order: list[str], name: str, within: str | None = None, total: str | None = None) -> DataFrame:
    """``df`` with a gapless number ``name`` from 0 in the order of the columns ``order``.

    With ``within`` (the first column of ``order``) each of its values is numbered by itself.
    ``total`` names a column for the number of rows (of that value).
    One range exchange sorts the rows, equal ones spread by a written row number, so a value
    with a third of all rows is many tasks' work; only counts per task are added up.
    """
    tie, part, at, first = (free_name(df, c) for c in ("__tie", "__part", "__in", "__first"))
    rows = written(df.withColumn(tie, F.monotonically_increasing_id()))
    keys = [part, within] if within else [part]
    dealt = written(rows.repartitionByRange(*order, tie).sortWithinPartitions(*order, tie).drop(tie)
                    .withColumns({part: F.spark_partition_id(), at: F.monotonically_increasing_id()}), over=[rows])
    counts = dealt.groupBy(*keys).agg(F.min(at).alias(first), F.count(F.lit(1)).alias("n"))
    value = Window.partitionBy(*keys[1:])
    before = value.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sums = [F.sum("n").over(value).alias(total)] if total else []
    starts = counts.select(*keys, (F.col(first) - F.coalesce(F.sum("n").over(before), F.lit(0))).alias(first), *sums)
    return dealt.join(starts, keys).select(*df.columns, (F.col(at) - F.col(first)).alias(name), *([total] if total else []))


def crc_of(col: str) -> Column:
    """Unsigned CRC-32 of a column's text form; null counts as empty."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary"))


def hash_sample(df: DataFrame, bound: int, *cols: str) -> DataFrame:
    """About ``bound`` rows of ``df``, chosen by a hash of ``cols`` alone.

    The share kept is ``bound / rows`` to a thousandth of itself, so the sample's size does
    not grow with the input, is never empty for want of resolution, and a rerun picks the same rows.
    """
    rows = df.select(F.count(F.lit(1))).first()[0]
    if rows <= bound:
        return df
    steps = max(1_000_000, 1000 * rows // bound)
    return df.where(F.pmod(F.xxhash64(F.lit(17), *cols), F.lit(steps)) < int(steps * bound / rows))


def tasks_for(rows: int, per_task: int) -> int:
    """Number of groups so that each holds about ``per_task`` rows."""
    return max(1, -(-rows // per_task))

"""FASTA alignments and contact-map CSV files.

Pairing of the two alignments is by record order: files by name, records by their
place in the file.  Both readers use Spark's text source with a record separator
(splittable, works on any file system Spark reads).  Records are parsed once into a
table under the shared checkpoint folder, which fixes their place: a record's number is
its place within its file block plus the records of the blocks before.  Only a count
per block is exchanged, no record is; the text is read once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from copair.operators.checks import check_pairs
from copair.session import stored


def _records(spark: SparkSession, path: str, separator: str, *columns: Column) -> DataFrame:
    """``(n, *columns)``: non-blank records, parsed by ``columns`` of ``value``, numbered from 0 in file order.

    A task reads a block's records one after the other, so their increasing ids have no gap
    once blank records are gone.  The table of block starts has its size on disk, and Spark
    broadcasts it while that is below its threshold."""
    text = spark.read.option("lineSep", separator).text(path)
    filled = text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")).where(
        F.col("value").rlike(r"\S"))
    rows = stored(filled.select("file", "block", F.monotonically_increasing_id().alias("at"), *columns))
    blocks = rows.groupBy("file", "block").agg(F.count(F.lit(1)).alias("rows"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("rows").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = stored(blocks.select("file", "block", (before - F.col("first")).alias("shift")))  # one row per file block
    parsed = [c for c in rows.columns if c not in ("file", "block", "at")]
    return rows.join(starts, ["file", "block"]).select((F.col("at") + F.col("shift")).cast("long").alias("n"), *parsed)


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def read_alignment(spark: SparkSession, path: str) -> DataFrame:
    """Read a FASTA alignment (a file, folder or glob) -> ``(pair_id, header, seq)``.

    Wrapped sequence lines are joined, blank lines and carriage returns dropped."""
    lines = F.split(F.regexp_replace("value", r"^\s*>", ""), "\n")
    body = F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))
    return _records(spark, path, "\n>", _stripped(lines[0]).alias("header"),
                    F.regexp_replace(F.concat_ws("", body), r"\s+", "").alias("seq")).withColumnRenamed("n", "pair_id")


def read_contact_map(spark: SparkSession, path: str) -> DataFrame:
    """Contact-map CSV (rows = positions of A, columns = positions of B)
    -> long ``(pos_a INT, pos_b INT, value, is_contact INT)``; raw values stay in
    ``value`` so that validation can reject anything but 0/1."""
    cells = _records(spark, path, "\n", F.col("value")).select(
        F.col("n").cast("int").alias("pos_a"), F.posexplode(F.split("value", ",")).alias("pos_b", "raw"))
    value = _stripped(F.col("raw")).try_cast("double")
    return cells.select("pos_a", "pos_b", value.alias("value"), value.cast("int").alias("is_contact"))


def pair_alignments(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pair two alignments by record number -> ``(pair_id, header_a, header_b, seq_a, seq_b)``.

    Rows without a partner raise an error (``check_pairs``)."""
    codes = lambda df: df.select("pair_id", F.col("seq").alias("codes"))
    check_pairs(codes(a), codes(b))
    return a.select(
        "pair_id", F.col("header").alias("header_a"), F.col("seq").alias("seq_a")
    ).join(b.select("pair_id", F.col("header").alias("header_b"), F.col("seq").alias("seq_b")), "pair_id")


def write_result(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                 partition_by: list[str] | None = None) -> None:
    """Generic sink used for every result table (encoded pairs, positions,
    contact maps, per-residue log-probabilities, models, couplings, traces)."""
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", "true")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)

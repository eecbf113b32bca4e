"""Session helpers: one place for the Spark settings this library relies on."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, partitions: int = 8, app: str = "copair") -> SparkSession:
    """Return the active session or build a local one for tests and benches.

    On a cluster the session is created by the launcher; this only fills in
    settings for local runs.  The Spark UI stays off (no web server).
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = (
        SparkSession.builder.master(master or "local[*]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.default.parallelism", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.constraintPropagation.enabled", "false")
        .config("spark.driver.memory", os.environ.get("COPAIR_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts.

    Read from the session (``spark.checkpoint.dir`` or the context's
    checkpoint dir).  Only a local-mode session without one gets a fresh
    scratch folder; a cluster session without a shared folder is an error,
    because executor-local folders do not survive executor loss.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir() or conf_dir
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it at a shared folder (HDFS/S3/...) "
            "so that EM iterations can cut lineage safely"
        )
    scratch = tempfile.mkdtemp(prefix="copair-ckpt-", dir=os.environ.get("COPAIR_SCRATCH", "/tmp"))
    sc.setCheckpointDir(scratch)
    return sc.getCheckpointDir() or scratch


def stored(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and read it back: what lies above is computed
    once, column pruning stays, and lost executors cost nothing."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/copair-{uuid.uuid4().hex}"
    (df.write.partitionBy(partition_by) if partition_by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors of a session whose Python path lacks it.

    Task functions are pickled by module name, so workers must be able to import the
    package: install it on every node (``pip install .``), put it on the cluster's
    ``PYTHONPATH``, or call this once per session."""
    sc = spark.sparkContext
    if getattr(sc, "_copair_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="copair-ship-")  # on the driver; Spark copies it to every node
    sc.addPyFile(shutil.make_archive(os.path.join(folder, "copair"), "zip", os.path.dirname(root), os.path.basename(root)))
    sc._copair_shipped = True

"""copair: paired-alignment coevolution analysis on Apache Spark.

Two row-paired alignments (A, B) are read into one wide DataFrame
``(pair_id, a ARRAY<TINYINT>, b ARRAY<TINYINT>)``.  Expectation-maximization
over a coevolution model (per-column sparse logistic regressions on the
opposite side) and an independence model (weighted position frequency
matrix) decides which row pairs interact and which column pairs couple.

Every data-sized step is a Spark job: column statistics are partial
aggregations, scoring is map-only against size-checked broadcast model
tables, and model fitting runs batched distributed gradient passes.
"""

from copair.session import checkpoint_dir, get_spark, ship_package

__all__ = ["checkpoint_dir", "get_spark", "ship_package"]

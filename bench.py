"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query starts from the parquet tables and shares nothing with the others; a
warm-up on one small query comes first, so that session start-up is not timed.
Timed: preprocessing (one statistics scan and the projection), the null model (fit
and scoring), coevolution scoring of given models, couplings with APC, the full-path
fit (all columns x classes x strengths, to its optimality bound), and warm soft EM
to convergence.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from copair import get_spark, ship_package
    from copair.operators import fit
    from copair.plans import derived as D
    from copair.plans import queries as Q

    spark = get_spark(master=f"local[{cpus}]", partitions=int(cpus))
    ship_package(spark)

    def path_fit():
        d = D.derive(spark, sf_dir)
        return fit.fit_columns(fit.fit_rows(d.pairs, "soft", weighted=False), d.prepared.width_a, d.prepared.width_b)

    work = {
        "preprocess": lambda: Q.q_kept_positions(spark, sf_dir).collect(),
        "null_llh": lambda: Q.q_null_llh(spark, sf_dir).agg({"null_llh": "sum"}).collect(),
        "alt_llh_given": lambda: Q.q_alt_llh(spark, sf_dir).agg({"alt_llh": "sum"}).collect(),
        "couplings_apc": lambda: Q.q_apc(spark, sf_dir).collect(),
        "fit_path": path_fit,
        "em_soft": lambda: Q.q_em_soft(spark, sf_dir).groupBy("iter").count().collect(),
    }
    Q.q_null_llh(spark, sf_dir).limit(1).collect()
    times = {}
    for name, fn in work.items():
        spark.catalog.clearCache()
        t0 = time.time()
        fn()
        times[name] = round(time.time() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_headline_sec", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()

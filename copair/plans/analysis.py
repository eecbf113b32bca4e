"""The whole analysis from two alignment files to partitioned result tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from copair.operators import evaluate, labels, prep
from copair.operators.checks import EMOptions
from copair.plans import em
from copair.sources import fasta


@dataclass
class Analysis:
    prepared: prep.Prepared
    runs: list[em.EMResult]  # one per start
    llh: DataFrame  # per start and iteration
    performance: DataFrame | None  # with int_limit and test
    contacts: DataFrame | None  # final couplings of every start, with predict_contacts
    options: EMOptions

    @property
    def trace(self) -> DataFrame:
        return self.runs[0].all_starts.trace


def _all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def run(spark: SparkSession, path_a: str, path_b: str, options: EMOptions | None = None,
        contact_map: str | None = None, out: str | None = None, folder: str | None = None) -> Analysis:
    """Read, pair and check two FASTA alignments, preprocess, run EM, and write every table to ``out``.

    ``options.test`` with ``int_limit`` compares labels with the truth (pairs up to the
    limit interact); ``predict_contacts`` adds the final contact fit of every start;
    ``n_starts`` applies to random starts; ``residues`` adds the per-residue table and
    ``history`` the matrices of labels and log-likelihoods, pairs by iterations, of every start.
    ``folder`` keeps the iterations: a run that ended early goes on from there."""
    options = options or EMOptions()
    aligned = fasta.pair_alignments(fasta.read_alignment(spark, path_a), fasta.read_alignment(spark, path_b))
    cmap = fasta.read_contact_map(spark, contact_map) if contact_map else None
    prepared = prep.preprocess(aligned, options.gap_threshold, cmap, on_unknown=options.on_unknown)
    if options.test:
        labels.check_int_limit(options.int_limit, prepared.pairs.count())
    starts = options.n_starts if options.init == "random" else 1
    runs = em.run_starts(prepared, options, list(range(starts)), folder)
    trace = runs[0].all_starts.trace
    truth = labels.true_label_expr(options.int_limit) if options.test else None  # evaluated on the trace: no join
    result = Analysis(prepared, runs, em.llh_per_iter(trace, truth),
                      evaluate.performance_per_iter(trace, truth, options.mode) if options.test else None,
                      _final_contacts(prepared, runs, options) if options.predict_contacts else None, options)
    if out:
        write(result, out)
    return result


def _final_contacts(prepared: prep.Prepared, runs: list[em.EMResult], options: EMOptions) -> DataFrame:
    return _all([em.predict_contacts(prepared, r.final_state, options)[0].withColumn("start", F.lit(r.start)) for r in runs])


def _matrices(result: Analysis) -> dict:
    """Pairs by iterations of every start, as projections of the history."""
    history = result.runs[0].all_starts.history
    if history is None:
        return {}
    iters = max((r.iters for r in result.runs), key=len)  # the same columns for every start
    of = lambda table: _all([table(history, iters, start=r.start).withColumn("start", F.lit(r.start)) for r in result.runs])
    return {"label_evolution": (of(evaluate.label_evolution), ["start"]), "llh_evolution": (of(evaluate.llh_evolution), ["start"])}


def write(result: Analysis, out: str) -> None:
    """Tables under ``out``, those of iterations partitioned by ``start, iter``."""
    p = result.prepared
    by_iter = ["start", "iter"]
    tables_of_run = result.runs[0].all_starts
    tables = {
        "encoded": (p.pairs, None), "one_hot": (prep.one_hot_long(p.pairs), ["side"]), "positions": (p.positions, None),
        "labels": (result.trace.select("start", "iter", "pair_id", "z"), by_iter),
        "llh_pairs": (em.weighted_llh(result.trace), by_iter), "llh": (result.llh, None),
        "models": (tables_of_run.models, by_iter),
        "couplings": (tables_of_run.couplings, by_iter),
        "residue_logprobs": (tables_of_run.residues, ["model", *by_iter]),
        "contact_map": (p.contact_map, None), "rejected": (p.rejected, None), "performance": (result.performance, None), "contacts": (result.contacts, None),
    } | _matrices(result)
    for name, (df, partition_by) in tables.items():
        if df is not None:
            fasta.write_result(df, f"{out}/{name}", partition_by=partition_by)

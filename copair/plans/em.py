"""Expectation-maximization over the wide pair state, all starts in shared passes.

A row of the state is a pair with its label per start.  Each iteration fits the null
models (one grouped aggregate) and the coevolution models (data passes that reduce to
model-sized results) of every start still open, then scores all of them in one map-only
Arrow pass that also derives the posteriors: no iteration shuffles pair rows.  The pass
that writes an iteration observes what the convergence test and the next M-step need.

Every iteration leaves a folder ``states/iter=k``, the model tables of all its starts and,
last, a commit record.  A run that is given the folder of an earlier one goes on after the
last committed iteration.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from copair.functions.prob import harden_expr, posterior_expr
from copair.operators import alt_model, contacts, evaluate, fit, labels, null_model
from copair.operators.checks import EMOptions
from copair.operators.prep import Prepared
from copair.session import checkpoint_dir


@dataclass
class EMResult:
    trace: DataFrame  # (start, iter, pair_id, z, alt_llh, null_llh)
    couplings: DataFrame  # (start, iter, pos_a, pos_b, strength, apc, name)
    models: DataFrame  # (start, iter, side, pos, alpha, kind, classes, df)
    alphas: dict
    n_iters: int
    converged: bool
    iters: list = field(default_factory=list)
    final_sides: dict | None = None
    final_state: DataFrame | None = None  # (pair_id, a, b, z)
    fits_converged: bool = True  # every fitted model met its optimality bound
    start: int = 0
    all_starts: "EMTables | None" = None


@dataclass
class EMTables:
    """Tables of all starts of a run, each read once."""

    folder: str
    trace: DataFrame
    couplings: DataFrame
    models: DataFrame
    residues: DataFrame | None  # (model, iter, start, pair_id, side, pos, logp), with ``options.residues``
    history: DataFrame | None = None  # (pair_id, history), a row per pair, with ``options.history``


_STATE = ("pair_id bigint, a array<tinyint>, b array<tinyint>, starts array<int>, z array<double>, z_prev array<double>, "
          "alt_llh array<double>, null_llh array<double>")
_RESIDUES = [f"{m}_{s}" for m in ("alt", "null") for s in "ab"]
_TABLES = {
    "models": "start int, side string, pos int, alpha double, kind string, classes array<int>, df bigint",
    "coefs": "start int, side string, pos int, alpha double, cls int, feat_pos int, feat_aa int, value double",
    "intercepts": "start int, side string, pos int, alpha double, cls int, value double",
}
_COMMIT = "start int, converged boolean, fits_converged boolean"


@dataclass
class _Start:
    """What the driver knows of a start between iterations."""

    number: int
    sides: dict | None = None
    alphas: dict | None = None
    converged: bool = False
    fits_converged: bool = True
    iters: list = field(default_factory=list)


def _pick(column: str, at: list[int]) -> F.Column:
    return F.array(*[F.col(column)[i] for i in at])


def _new_labels(state: DataFrame, opts: EMOptions) -> DataFrame:
    """E-step: the label of every start from its two log-likelihoods; the old one becomes ``z_prev``."""
    def label(alt, null):
        z = posterior_expr(alt, null, opts.int_frac)
        return harden_expr(z, "pair_id", opts.seed).cast("double") if opts.mode == "hard" else z

    return state.withColumn("z_prev", F.col("z")).withColumn("z", F.zip_with("alt_llh", "null_llh", label))


def _pwm(state: DataFrame, mode: str, width_a: int, width_b: int) -> dict:
    """``pwm_arrays`` of the null model of ``state(a, b, z)``."""
    return null_model.pwm_arrays(null_model.fit_null(state, mode), width_a, width_b)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def run_starts(prepared: Prepared, opts: EMOptions, starts: list[int], folder: str | None = None) -> list[EMResult]:
    """Run EM from the given starts (seeds ``opts.seed + start``) in shared passes.

    Warm starts do not depend on the seed, so ``starts`` is then one number.  ``folder``
    (default: a new one under the shared checkpoint folder) holds every table of the run;
    iterations that it has committed are not run again.  The options and pairs must be those
    of the run that wrote it."""
    spark = prepared.pairs.sparkSession
    root = (folder or f"{checkpoint_dir(spark).rstrip('/')}/copair-em-{uuid.uuid4().hex}").rstrip("/")
    La, Lb = prepared.width_a, prepared.width_b
    runs = [_Start(s) for s in starts]
    schema = _STATE + "".join(f", {c} array<array<double>>" for c in _RESIDUES) * opts.residues
    schema += f", history {evaluate.HISTORY}" * opts.history
    options = {"dfmax": opts.dfmax, "tol": opts.fit_tol}

    def step(state: DataFrame, open_: list[_Start], k: int) -> tuple[DataFrame, dict]:
        """Write iteration ``k`` and its models, commit it; the state as written and the observed sums."""
        nulls = F.array(*[F.lit(None).cast("double") for _ in open_])
        state = state.withColumn("starts", F.array(*[F.lit(r.number) for r in open_]))
        columns = [F.col(c) if c in state.columns else nulls.alias(c) for c in
                   ("pair_id", "a", "b", "starts", "z", "z_prev", "alt_llh", "null_llh")]
        columns += [F.col(c) if c in state.columns else F.lit(None).cast("array<array<double>>").alias(c)
                    for c in _RESIDUES if opts.residues]
        if opts.history:  # the entries of this iteration follow those that the row has
            now = F.arrays_zip("starts", "z", "alt_llh", "null_llh") if "alt_llh" in state.columns else F.arrays_zip("starts", "z")
            value = lambda e, c: e[c] if "alt_llh" in state.columns else F.lit(None).cast("double")
            entries = F.transform(now, lambda e: F.struct(e["starts"].alias("start"), F.lit(k).alias("iter"), e["z"].alias("z"),
                                                          value(e, "alt_llh").alias("alt_llh"), value(e, "null_llh").alias("null_llh")))
            before = F.col("history") if "history" in state.columns else F.array().cast(evaluate.HISTORY)
            columns.append(F.concat(before, entries).alias("history"))
        seen = Observation(f"em-{uuid.uuid4().hex}")
        sums = [F.count(F.lit(1)).alias("n")]
        for i in range(len(open_)):
            sums += [F.sum(F.abs(F.col("z")[i] - F.col("z_prev")[i])).alias(f"moved{i}"), F.sum(F.col("z")[i]).alias(f"ones{i}")]
        state.select(*columns).observe(seen, *sums).write.mode("overwrite").parquet(f"{root}/states/iter={k}")
        got = seen.get
        for i, r in enumerate(open_):
            moved = got[f"moved{i}"]
            r.converged = moved is not None and (moved == 0 if opts.mode == "hard" else moved / got["n"] < opts.tol)
            r.iters.append(k)
        fitted = [r for r in open_ if r.sides is not None]
        for name, ddl in _TABLES.items():
            parts = [alt_model.model_tables(spark, r.sides)[list(_TABLES).index(name)].withColumn("start", F.lit(r.number)) for r in fitted]
            table = _union(parts) if parts else spark.createDataFrame([], ddl)
            table.select(*[c.split()[0] for c in ddl.split(", ")]).coalesce(1).write.mode("overwrite").parquet(f"{root}/{name}/iter={k}")
        spark.createDataFrame([(r.number, r.converged, r.fits_converged) for r in open_], _COMMIT).coalesce(1).write.mode(
            "overwrite").parquet(f"{root}/commits/iter={k}")
        return spark.read.schema(schema).parquet(f"{root}/states/iter={k}"), got

    def check_classes(state: DataFrame, open_: list[_Start], got: dict | None) -> None:
        if got is None:
            got = state.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("z")[i]).alias(f"ones{i}") for i in range(len(open_))]).first().asDict()
        for i, r in enumerate(open_):
            ones = int(got[f"ones{i}"] or 0)
            if not 0 < ones < got["n"]:
                raise ValueError(f"one class is empty: {ones} interacting and {got['n'] - ones} other pairs (start {r.number})")

    base = prepared.pairs.select("pair_id", "a", "b").persist()
    try:
        n_all = options["n_all"] = base.count()
        k, got = _resumed(spark, root, runs, schema, La, Lb)
        if k is None:
            k = 0
            if opts.init == "warm":
                st = base.withColumn("z", F.array(F.lit(1.0)))
                one = fit.fit_starts(st.select("a", "b", F.col("z").alias("w")), La, Lb, [None], [None], members=False,
                                     max_iter=opts.max_init_iters, **options)[0]
                runs[0].sides, runs[0].alphas, runs[0].fits_converged = one.sides, one.alphas, one.converged
                # no pair is known to interact yet: the first null model has all of them at full weight
                st = st.withColumn("z", F.array(F.lit(0.0)))
                pwms = null_model.pwms_of_starts(st, 1, La, Lb)
                scored = alt_model.score_starts(st, [one.sides], pwms, La, Lb, opts.residues)
                st, got = step(_new_labels(scored, opts).drop("z_prev"), runs, 0)
            else:
                first = F.array(*[labels.random_labels_expr(opts.int_frac, opts.mode, opts.seed + r.number) for r in runs])
                st, got = step(base.withColumn("z", first), runs, 0)
        else:
            st = spark.read.schema(schema).parquet(f"{root}/states/iter={k}")
        while k < opts.max_iters and any(not r.converged for r in runs):
            held = [r for r in runs if r.iters[-1] == k]  # the starts whose labels ``st`` has
            if opts.mode == "hard":
                check_classes(st, held, got)
            open_ = [r for r in held if not r.converged]
            kept = ["history"] if opts.history else []
            st = st.select("pair_id", "a", "b", _pick("z", [i for i, r in enumerate(held) if not r.converged]).alias("z"), *kept)
            k += 1
            searched = open_[0].alphas is None
            res = fit.fit_starts(st.select("a", "b", F.col("z").alias("w")), La, Lb, [r.alphas for r in open_], [r.sides for r in open_],
                                 members=opts.mode == "hard", max_iter=opts.max_init_iters if searched else opts.max_reg_iters, **options)
            for r, one in zip(open_, res):
                r.sides, r.alphas, r.fits_converged = one.sides, one.alphas, r.fits_converged and one.converged
            pwms = null_model.pwms_of_starts(st, len(open_), La, Lb)
            scored = alt_model.score_starts(st, [r.sides for r in open_], pwms, La, Lb, opts.residues)
            st, got = step(_new_labels(scored, opts), open_, k)
    finally:
        base.unpersist()
    tables = _tables(spark, root, schema, La, Lb, opts.residues)
    if opts.history:  # the last iteration's rows hold those before
        tables.history = spark.read.schema(schema).parquet(f"{root}/states/iter={k}").select("pair_id", "history")
    return [_result(spark, root, schema, tables, r) for r in runs]


def _resumed(spark: SparkSession, root: str, runs: list[_Start], schema: str, width_a: int, width_b: int):
    """Bring ``runs`` to the last committed iteration of ``root``; ``(None, None)`` if there is none."""
    if not _exists(spark, f"{root}/commits"):
        return None, None
    commits = spark.read.schema(f"{_COMMIT}, iter int").parquet(f"{root}/commits").collect()  # starts x iterations
    if not commits:
        return None, None
    for r in runs:
        mine = sorted((c for c in commits if c.start == r.number), key=lambda c: c.iter)
        if not mine:
            raise ValueError(f"the run in {root} has no start {r.number}")
        r.iters, r.converged, r.fits_converged = [c.iter for c in mine], mine[-1].converged, mine[-1].fits_converged
        tables = [spark.read.schema(ddl).parquet(f"{root}/{name}/iter={mine[-1].iter}").where(F.col("start") == r.number)
                  for name, ddl in _TABLES.items()]
        sides = alt_model.sides_from_tables(*tables, width_a, width_b)
        if any(len(sm.gpos) for sm in sides.values()):
            r.sides = sides
            r.alphas = {s: {int(p): float(a) for p, a in zip(sm.gpos, sm.galpha)} for s, sm in sides.items()}
    return max(c.iter for c in commits), None


def _tables(spark: SparkSession, root: str, schema: str, width_a: int, width_b: int, residues: bool) -> EMTables:
    # with the partition column: a filter on iter reads that iteration's files alone
    states = spark.read.schema(f"{schema}, iter int").parquet(f"{root}/states")
    trace = states.select("iter", "pair_id", F.inline(F.arrays_zip("starts", "z", "alt_llh", "null_llh"))).select(
        "iter", "pair_id", "z", "alt_llh", "null_llh", F.col("starts").alias("start"))
    models = spark.read.schema(f"{_TABLES['models']}, iter int").parquet(f"{root}/models")
    coefs = spark.read.schema(f"{_TABLES['coefs']}, iter int").parquet(f"{root}/coefs")
    cmap = contacts.couplings(coefs, width_a, width_b, models.select("start", "iter").distinct())
    long = None
    if residues:
        long = _union([
            states.select(F.lit(m).alias("model"), "iter", "pair_id", F.lit(s.upper()).alias("side"),
                          F.inline(F.arrays_zip("starts", F.col(f"{m}_{s}").alias("cells")))).select(
                "model", "iter", F.col("starts").alias("start"), "pair_id", "side", F.posexplode("cells").alias("pos", "logp"))
            for m in ("alt", "null") for s in "ab"])
    return EMTables(root, trace, contacts.apc(cmap, keys=("start", "iter")), models, long)


def _result(spark: SparkSession, root: str, schema: str, tables: EMTables, r: _Start) -> EMResult:
    mine = F.col("start") == r.number
    last = spark.read.schema(schema).parquet(f"{root}/states/iter={r.iters[-1]}")
    at = F.array_position("starts", r.number)
    final = last.select("pair_id", "a", "b", F.element_at("z", at.cast("int")).alias("z"))
    return EMResult(tables.trace.where(mine), tables.couplings.where(mine), tables.models.where(mine), r.alphas, r.iters[-1],
                    r.converged, r.iters, r.sides, final, r.fits_converged, r.number, tables)


def run_em(prepared: Prepared, opts: EMOptions, start: int = 0, folder: str | None = None) -> EMResult:
    """One EM run (warm or random start) -> trace, couplings and models per iteration."""
    return run_starts(prepared, opts, [start], folder)[0]


def _union(dfs: list[DataFrame]) -> DataFrame:
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out


def em_multistart(prepared: Prepared, opts: EMOptions, folder: str | None = None) -> list[EMResult]:
    """``n_starts`` random starts, each with its own outputs (no best-of selection);
    the seed of start s is ``seed + s``.  A converged start takes no part in later passes."""
    return run_starts(prepared, opts, list(range(opts.n_starts)), folder)


def predict_contacts(prepared: Prepared, state: DataFrame, opts: EMOptions):
    """C4: final fit on hard z = 1 / soft z >= 0.5 rows (weights z) with a fresh alpha
    search (BIC counts those rows), then couplings and APC."""
    La, Lb = prepared.width_a, prepared.width_b
    sel = labels.select_for_contacts(state, opts.mode)
    rows = sel.select("a", "b", (F.lit(1.0) if opts.mode == "hard" else F.col("z").cast("double")).alias("w"))
    res = fit.fit_columns(rows, La, Lb, dfmax=opts.dfmax, max_iter=opts.max_init_iters, tol=opts.fit_tol)
    _, coefs, _ = alt_model.model_tables(state.sparkSession, res.sides)
    cmap = contacts.apc(contacts.couplings(coefs, La, Lb))
    return cmap, res


# --------------------------------------------------------------------------
# log-likelihood tables
# --------------------------------------------------------------------------

def weighted_llh(trace: DataFrame, truth: DataFrame | Column | None = None) -> DataFrame:
    """``z*alt`` and ``(1-z)*null`` per pair and iteration; with truth (a table, an expression
    or a column ``y`` of the trace), the same with the true labels."""
    out = trace.withColumn("alt_int", F.col("z") * F.col("alt_llh")).withColumn(
        "null_nonint", (F.lit(1.0) - F.col("z")) * F.col("null_llh"))
    if truth is not None or "y" in trace.columns:
        out = evaluate.with_truth(out, truth, "left").withColumn(
            "alt_true", F.col("y") * F.col("alt_llh")).withColumn(
            "null_true", (F.lit(1.0) - F.col("y")) * F.col("null_llh"))
    return out


def llh_per_iter(trace: DataFrame, truth: DataFrame | Column | None = None) -> DataFrame:
    """E5: per-iteration sums: alt, null, z-weighted alt, (1-z)-weighted null,
    total, and the truth variants when given."""
    keys = [c for c in ("start", "iter") if c in trace.columns]
    w = weighted_llh(trace, truth)
    known = "y" in w.columns
    aggs = [
        F.sum("alt_llh").alias("sum_alt"), F.sum("null_llh").alias("sum_null"),
        F.sum("alt_int").alias("sum_alt_int"), F.sum("null_nonint").alias("sum_null_nonint"),
    ]
    if known:
        aggs += [F.sum("alt_true").alias("true_alt"), F.sum("null_true").alias("true_null")]
    out = w.groupBy(*keys).agg(*aggs).withColumn("total", F.col("sum_alt_int") + F.col("sum_null_nonint"))
    if known:
        out = out.withColumn("true_total", F.col("true_alt") + F.col("true_null"))
    return out


def llh_monotonic(per_iter: DataFrame) -> DataFrame:
    """Is the total strictly increasing over iterations (per start)?"""
    part = [c for c in ("start",) if c in per_iter.columns]
    w = Window.partitionBy(*part).orderBy("iter")
    lagged = per_iter.withColumn("prev", F.lag("total").over(w))
    return lagged.groupBy(*part).agg(
        F.coalesce(F.bool_and(F.when(F.col("prev").isNotNull(), F.col("total") > F.col("prev"))), F.lit(True))
        .alias("monotonic"),
        F.count(F.lit(1)).cast("long").alias("n_iters"),
    )

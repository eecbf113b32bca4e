"""Shared building blocks of the registered queries on the test tables.

Everything starts from the whole ``documents`` table (alignment derived
from letter counts of the full texts), ``labels`` (truth) and
``embeddings`` (given coefficient tables for the model operators).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from copair.functions.alphabet import ALPHA_PATH
from copair.operators import alt_model, evaluate, null_model
from copair.functions.prob import posterior_expr
from copair.operators.prep import Prepared, long_view, preprocess, stored_pairs
from copair.session import stored
from copair.sources.documents import alignment_from_documents, load_table

INT_FRAC = 0.75
GAP_THRESHOLD = 0.5


@dataclass
class Derived:
    spark: SparkSession
    sf_dir: str
    prepared: Prepared

    @property
    def pairs(self) -> DataFrame:
        return self.prepared.pairs

    def residues(self) -> DataFrame:
        return long_view(self.pairs)

    def truth(self) -> DataFrame:
        lab = load_table(self.spark, self.sf_dir, "labels")
        return lab.select(F.col("doc_id").cast("long").alias("pair_id"), F.col("quality").cast("int").alias("y"))

    def prior(self) -> DataFrame:
        """State with prior labels, another rule than the truth: soft z = 0.9 for
        pair_id % 10 < 7, else 0.1; hard z = 1 / 0."""
        high = F.col("pair_id") % 10 < 7
        return self.pairs.select("pair_id", "a", "b", F.when(high, F.lit(0.9)).otherwise(F.lit(0.1)).alias("z"),
                                 F.when(high, F.lit(1.0)).otherwise(F.lit(0.0)).alias("z_hard"))


def derive(spark: SparkSession, sf_dir: str) -> Derived:
    # plans carry constant PWM arrays; constraint inference over them is
    # costly and buys nothing here
    spark.conf.set("spark.sql.constraintPropagation.enabled", "false")
    docs = load_table(spark, sf_dir, "documents")
    prepared = preprocess(alignment_from_documents(docs), GAP_THRESHOLD)
    return Derived(spark, sf_dir, prepared)


def raw_encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_pairs(alignment_from_documents(load_table(spark, sf_dir, "documents")))[0]


def strange_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived alignment with letters outside the alphabet: X in A's first column for
    pair_id % 10 = 3, Z in B's second one for pair_id % 15 = 4."""
    aligned = alignment_from_documents(load_table(spark, sf_dir, "documents"))
    put = lambda c, at, ch: F.overlay(c, F.lit(ch), at, 1)
    return aligned.select(
        "pair_id", F.when(F.col("pair_id") % 10 == 3, put("seq_a", 1, "X")).otherwise(F.col("seq_a")).alias("seq_a"),
        F.when(F.col("pair_id") % 15 == 4, put("seq_b", 2, "Z")).otherwise(F.col("seq_b")).alias("seq_b"))


# ---------------------------------------------------------------------------
# given models from the embeddings table
# ---------------------------------------------------------------------------

def given_models(d: Derived):
    """Model tables from every embedding row and the column statistics.

    row -> side A (even vec_id) / B (odd), t = vec_id div 2, pos = t % L_side,
    class = the column's code of rank (t div L_side) % 5 + 1 by frequency (ties: smaller
    code), alpha = path[label % 19].  A model's classes are the column's codes; for
    label 8 the two most frequent ones (binary) and for label 9 the most frequent one
    (constant).  Intercepts are the logits of the class frequencies.
    dimension k, j = k % (7 (label + 1)) -> feat_pos = (j + rank) % L_opp, feat_aa = (j div L_opp + 4 rank) % 20,
    so weaker alphas have more features;
    three times the sum of the values that share a key.  Only classes that have coefficients in
    their kind keep them (binary: the larger code; constant: none)."""
    La, Lb = d.prepared.width_a, d.prepared.width_b
    emb = load_table(d.spark, d.sf_dir, "embeddings")
    counts = d.residues().groupBy("side", "pos", "aa").agg(F.count(F.lit(1)).alias("n"))
    by_n = Window.partitionBy("side", "pos").orderBy(F.col("n").desc(), "aa")
    total = F.sum("n").over(Window.partitionBy("side", "pos"))
    ranked = counts.select("side", "pos", "aa", "n", F.row_number().over(by_n).alias("rank"), total.alias("total")).cache()
    alpha_arr = F.array(*[F.lit(float(a)) for a in ALPHA_PATH])
    even = F.col("vec_id") % 2 == 0
    lside, lopp = F.when(even, F.lit(La)).otherwise(F.lit(Lb)), F.when(even, F.lit(Lb)).otherwise(F.lit(La))
    t = F.expr("vec_id div 2")
    rows = emb.select(
        F.when(even, F.lit("A")).otherwise(F.lit("B")).alias("side"),
        (t % lside).cast("int").alias("pos"),
        (F.floor(t / lside) % 5 + 1).cast("int").alias("rank"),
        F.element_at(alpha_arr, (F.col("label") % len(ALPHA_PATH) + 1).cast("int")).alias("alpha"),
        F.when(F.col("label") == 8, 2).when(F.col("label") == 9, 1).otherwise(1000).alias("most"),
        lopp.alias("lopp"), (7 * (F.col("label") + 1)).alias("fold"), "embedding",
    )
    wanted = rows.select("side", "pos", "alpha", "most").distinct()
    members = wanted.join(F.broadcast(ranked), ["side", "pos"]).where("rank <= most")
    models = members.groupBy("side", "pos", "alpha").agg(F.array_sort(F.collect_list("aa")).alias("classes")).withColumn(
        "kind", F.when(F.size("classes") > 2, "ovr").when(F.size("classes") == 2, "binary").otherwise("constant"))
    logit = F.log(F.col("n") / (F.col("total") - F.col("n")))
    keys = ["side", "pos", "alpha", "cls"]
    fitted = members.select("side", "pos", "alpha", "rank", F.col("aa").alias("cls"), logit.alias("value")).join(
        models, ["side", "pos", "alpha"]).where(
        "kind = 'ovr' OR (kind = 'binary' AND cls = element_at(classes, -1))")
    cells = rows.select("side", "pos", "alpha", "rank", "lopp", "fold", F.posexplode("embedding").alias("k", "v"))
    cells = cells.withColumn("k", F.col("k") % F.col("fold"))
    coefs = cells.join(F.broadcast(fitted.select("side", "pos", "alpha", "rank", "cls")), ["side", "pos", "alpha", "rank"]).select(
        *keys, ((F.col("k") + F.col("rank")) % F.col("lopp")).cast("int").alias("feat_pos"),
        ((F.floor(F.col("k") / F.col("lopp")) + 4 * F.col("rank")) % 20).cast("int").alias("feat_aa"),
        F.col("v").cast("double").alias("v"),
    ).groupBy(*keys, "feat_pos", "feat_aa").agg((F.lit(3.0) * F.sum("v")).alias("value"))
    # five consumers and more: each table is computed once
    return stored(models), stored(coefs), stored(fitted.select(*keys, "value"))


def fixed_alt_residues(d: Derived, sides: dict, n_iter: int = 3) -> DataFrame:
    """``(iter, model, pair_id, side, pos, logp)``: what every residue adds to the log-likelihoods of
    the iterations of ``fixed_alt_trace``, from the scoring pass that gives these."""
    La, Lb = d.prepared.width_a, d.prepared.width_b
    st, out = d.prior().select("pair_id", "a", "b", F.array("z").alias("z")), []
    for k in range(n_iter):
        pwms = null_model.pwms_of_starts(st, 1, La, Lb)
        scored = stored(alt_model.score_starts(st, [sides], pwms, La, Lb, residues=True))
        for m in ("alt", "null"):
            for s in "ab":
                out.append(scored.select(F.lit(k).alias("iter"), F.lit(m).alias("model"), "pair_id", F.lit(s.upper()).alias("side"),
                                         F.posexplode(F.col(f"{m}_{s}")[0]).alias("pos", "logp")))
        st = scored.select("pair_id", "a", "b", F.zip_with(
            "alt_llh", "null_llh", lambda alt, null: posterior_expr(alt, null, INT_FRAC)).alias("z"))
    res = out[0]
    for o in out[1:]:
        res = res.unionByName(o)
    return res


# ---------------------------------------------------------------------------
# a fixed-coevolution-model EM trace (null M-step + E-step, 3 iterations)
# ---------------------------------------------------------------------------

def fixed_alt_history(d: Derived, sides: dict, truth: DataFrame | None = None, n_iter: int = 3) -> DataFrame:
    """``(pair_id, history)``, with ``truth`` also ``y``: iteration 0 uses the prior labels; the null
    model is refitted with weights 1 - z each iteration and the posterior (pi = 0.75) gives the next labels.

    The labels are joined once, to the pairs; every later step keeps the rows where they are."""
    La, Lb = d.prepared.width_a, d.prepared.width_b
    st = d.prior().select("pair_id", "a", "b", "z")
    if truth is not None:
        st = evaluate.with_truth(st, truth, "left")
    keys = [c for c in ("pair_id", "y") if c in st.columns]
    st = alt_model.score_alt(st, sides, La, Lb).withColumn("history", F.array().cast(evaluate.HISTORY))
    for k in range(n_iter):
        if k > 0:
            st = st.withColumn("z", F.lit(1.0) / (F.lit(1.0) + F.exp(
                F.col("null_llh") - F.col("alt_llh") + F.lit(math.log((1 - INT_FRAC) / INT_FRAC))))).drop("null_llh")
        pwm = null_model.fit_null(st.select("pair_id", "a", "b", "z"), "soft")
        st = null_model.null_llh(st, null_model.pwm_arrays(pwm, La, Lb))
        entry = F.struct(F.lit(0).alias("start"), F.lit(k).alias("iter"), "z", "alt_llh", "null_llh")
        st = stored(st.withColumn("history", F.concat("history", F.array(entry))))
    return st.select(*keys, "history")


def fixed_alt_trace(d: Derived, sides: dict, truth: DataFrame | None = None, n_iter: int = 3) -> DataFrame:
    """``(iter, pair_id, z, alt_llh, null_llh)``, with ``truth`` also ``y``: the history, a row per iteration."""
    return evaluate.unrolled(fixed_alt_history(d, sides, truth, n_iter)).drop("start")

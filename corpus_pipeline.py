"""From raw documents to packed training sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor
kept; ``run`` writes every stage's result as Parquet and rereads it.  All stages
but the last return the columns of ``documents``; the last returns the placement
of every piece (see ``copair.llm.packing.pack``).

Nulls, empty texts, repeated rows and empty tables are handled as the operators
say; a null text is never toxic by itself, is a fingerprint-0 document for the
near-duplicate stage, and stays null through masking.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from copair.llm import cube_mix, packing, pii_crf, simhash_ring, toxicity_gbt
from copair.llm.common import committed, free_name, table
from copair.llm.queries import TOKENIZER

TOXIC_AT = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated toxicity is below one half stay."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("__id"), F.col("toxic").alias("toxic"))
    labelled = docs.select("doc_id", "text").join(labels, F.col("doc_id") == F.col("__id"))
    model = toxicity_gbt.learn(labelled)
    return docs.where(toxicity_gbt.score_column("text", model) < TOXIC_AT)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays (3-word shingles, at most 3 bits)."""
    return simhash_ring.keep_one(docs, width=3, max_bits=3)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become ``<KIND>``; ``n_chars`` follows the text."""
    pii = free_name(docs, "__pii")
    found = docs.withColumn(pii, pii_crf.pii_column("text", pii_crf.learn(docs), masked=True))
    masked = F.col(f"{pii}.masked")
    changed = {"text": masked.alias("text"), "n_chars": F.length(masked).alias("n_chars")}
    return found.select(*[changed.get(c, F.col(c)) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the balanced sample takes it."""
    return cube_mix.mixed_rows(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens, placed in sequences."""
    return packing.pack(packing.token_pieces(docs, TOKENIZER))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("personal_data", mask_personal_data),
    ("source_mix", mix_sources),
    ("packing", pack_sequences),
]

#: Models, hashes of another engine and a tokenizer take part: SQL can't express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows.  A stage's scratch tables and its predecessor's result go when its own result is committed."""
    docs, before = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES:
        docs = committed(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), over=before)
        before = [docs]
    return docs

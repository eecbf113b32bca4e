"""Fixtures shared by the operator tests: one odd table of documents."""

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

ODD = [
    (1, "The quick brown fox jumps over the lazy dog", "en", "a", 43),
    (2, "The quick brown fox jumps over the lazy dog", "en", "a", 43),
    (2, "The quick brown fox jumps over the lazy dog", "en", "a", 43),
    (3, None, None, None, None),
    (4, "", "en", "b", 0),
    (5, " \t\n ", "de", "b", 4),
    (6, "word " * 30000, "en", "c", 150000),
    (7, "Ünïcödé ñandú 漢字 \U0001f600 ok", "es", "c", 20),
    (8, "x" * 50000, None, "a", 50000),
    (None, "no id here at all", "en", None, 17),
]


def odd_docs(spark):
    """Nulls, empty and very long texts, repeats, and extra columns with clashing names."""
    df = spark.createDataFrame(ODD, SCHEMA)
    return df.withColumns({c: F.lit("extra") for c in (
        "id", "size", "key", "src", "block", "fp", "root", "label", "score", "base", "piece", "shard", "slot", "prob", "n", "v")})


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def save(spark, path, **tables):
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}.parquet")
    return str(path)

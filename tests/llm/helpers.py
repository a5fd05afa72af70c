"""Small tables with the cases that every operator must bear."""

from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
                     T.StructField("score", T.StringType()), T.StructField("size", T.StringType()), T.StructField("row_hash", T.StringType()), T.StructField("fp", T.StringType())])


def odd_docs(spark):
    """Nulls in every column, empty, blank and long texts, repeated rows and ids, and columns named like outputs."""
    long = "alpha beta gamma delta " * 30_000
    rows = [(1, "the quick brown fox jumps over the lazy dog", "en", "a", 43), (2, "the quick brown fox jumps over the lazy dog", "en", "a", 43),
            (2, "the quick brown fox jumps over the lazy dog", "en", "a", 43), (3, None, "en", "b", None), (4, "", None, None, 0), (5, " \t\n ", "fr", "b", 4),
            (None, "le chat dort sur la table de la cuisine", "fr", "a", 39), (None, None, None, None, None), (6, long, "en", "b", len(long)),
            (7, "le chat dort sur la table de la cuisine", "fr", None, 39), (8, "12345 67890 !!", "fr", "c", 14), (9, "été \U0001f600 日本語", "fr", "c", 7)]
    return spark.createDataFrame([(*r, "x", "y", "z", "w") for r in rows], DOCS)


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)

"""Corpus pipeline: language ID, SimHash near-dedup, benchmark decontamination, mixing, token blocks.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each stage's rows as Parquet in the shared folder and reads them back as the
next stage's documents. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dwellframe.llm import decontam, langid, mixing, simhash, tokens
from dwellframe.llm.common import stored
from dwellframe.llm.queries import tokenizer_path
from dwellframe.sources.tables import table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised: texts without letters, unlike every labelled language of the table, or with no language above one half, go.

    "Unlike" is measured by the labelled rows of ``docs`` alone (``langid.predict(floor=True)``): in a table of invented words, ordinary prose is unlike.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"))
    kept = langid.predict(rows, langid.train(docs), floor=True).where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= 0.5))
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest id) of each group of near copies stays."""
    return simhash.keep_one(docs, shingle=3, radius=3)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's repetition rate says."""
    return mixing.mix(docs)


def token_blocks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-id blocks are written; their documents are returned: doc_id, start, n_tokens, ids_crc32."""
    return tokens.write_and_read(docs, tokenizer_path())


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
    ("token_blocks", token_blocks),
]

#: SQL expresses neither the classifier nor the tokenizer; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

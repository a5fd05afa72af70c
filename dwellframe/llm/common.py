"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dwellframe.session import ensure_checkpoint_dir

#: ASCII white space; words are what stands between.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of lower-cased text: what is neither alphanumeric ASCII nor part of a longer character stands for a space.
_CLEAN = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words between white space and ASCII punctuation."""
    return (text or "").lower().encode().translate(_CLEAN).split()


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder named by ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a cut of the lineage that outlives executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1024) -> Iterator[None]:
    """Actions within hand Python batches of at most ``rows`` rows: of long texts, ten thousand fill both sides' memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(was)) if int(was) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, was)


def crc_fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text modulo ``folds``; null for a null id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(folds))


def text_udf(make: Callable[[], Callable[[list], list[tuple]]], schema: str, rows: int = 256) -> Callable[[Column], Column]:
    """A vectorised function of one text column that returns a struct.

    ``make`` is called once in each task and gives a function from a list of at
    most ``rows`` texts (None for null) to as many tuples, so what a task holds
    besides its Arrow batch is bounded by ``rows`` texts.
    """
    names = [part.strip().split(" ")[0].split(":")[0] for part in _fields(schema)]

    @F.pandas_udf(schema)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        apply = make()
        for texts in batches:
            out: list[tuple] = []
            values = texts.to_numpy(dtype=object)
            for k in range(0, len(values), rows):
                out += apply([x if isinstance(x, (str, bytes)) else None for x in values[k:k + rows]])
            yield pd.DataFrame({n: [row[i] for row in out] for i, n in enumerate(names)}, columns=names)

    return run


def _fields(schema: str) -> list[str]:
    """Top-level fields of a DDL string (commas inside <> do not split)."""
    parts, depth = [""], 0
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            parts.append("")
        else:
            parts[-1] += c
    return parts


def others(docs: DataFrame, names: tuple[str, ...]) -> list[Column]:
    """The columns of ``docs`` but those named like one of ``names`` (Spark's names ignore case)."""
    low = {n.lower() for n in names}
    return [F.col(f"`{c}`") for c in docs.columns if c.lower() not in low]


def with_struct(docs: DataFrame, out: Column, names: tuple[str, ...]) -> DataFrame:
    """``docs`` and the fields of one struct column; columns of the same name are replaced."""
    held = f"out_{uuid.uuid4().hex}"
    kept = others(docs, names)
    return docs.select(*kept, out.alias(held)).select(*kept, *[F.col(held)[n].alias(n) for n in names])

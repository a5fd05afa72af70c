"""Mixing sources to target weights (DataFrame functions only).

Sizes are counted in words and added up for each source. Targets share
``epochs`` times all sizes by weight, but stop at ``most`` times the source's
own size; what is cut off is shared again among the others until none is above.
The repetition rate of a source is target / size: each of its documents is
emitted floor(rate) times, and once more if a hash of seed and id falls below
the fraction.

Only the per-source sums are shuffled (combined in each task first), so a
source that holds most rows costs no more than any other. Ranks of sources come
from a range partitioning with offsets, not from one ordered task.

Defined results: a null text has size 0; rows without a source are a source of
their own, ordered last; rows with equal ids get the same draw (a null id draws
by its text); a source of size 0 has target 0 and its documents are not taken;
repeated rows count each. Input columns named like an output column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, others, stored

WEIGHTS = (5, 2, 1)
PLAN = ("size", "source_size", "target", "rate", "copies")


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: float = 1.5, most: int = 2) -> DataFrame:
    """(source, source_size, target) from (source, size) rows."""
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    dealt = stored(per_source.repartitionByRange(F.asc_nulls_last("source")).withColumn("part", F.spark_partition_id()), "sources")
    before = dealt.groupBy("part").agg(F.count("*").alias("n")).select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    place = F.row_number().over(W.partitionBy("part").orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.pmod(F.col("place"), F.lit(len(weights))) + 1).cast("int"))
    ranked = stored(dealt.withColumn("at", place).join(before, "part").withColumn("place", F.col("before") + F.col("at"))
                    .select("source", "source_size", weight.alias("w"), (F.col("source_size") * most).alias("cap")), "ranked")
    # One number decides all targets: target = min(cap, level * weight), the shares of what the capped sources leave.
    total = ranked.agg(F.sum("source_size").alias("n")).first()["n"] or 0
    level, capped = 0.0, -1
    while True:
        over = F.col("cap") < F.lit(level) * F.col("w")
        row = ranked.agg(F.sum(F.when(over, F.col("cap")).otherwise(0)).alias("cut"), F.sum(F.when(over, 0).otherwise(F.col("w"))).alias("w"), F.count(F.when(over, 1)).alias("n")).first()
        if row["n"] == capped or not row["w"]:
            break
        capped, level = row["n"], (epochs * total - row["cut"]) / row["w"]
    return ranked.select("source", "source_size", F.least(F.col("cap").cast("double"), F.lit(level) * F.col("w")).alias("target"))


def _planned(docs: DataFrame, text: str, source: str, key: str, seed: int, options: dict) -> DataFrame:
    """row (all columns of ``docs``) and the columns of the plan."""
    size = word_count(text)
    targets = source_targets(docs.select(F.col(f"`{source}`").alias("source"), size.alias("size")), **options)
    # 32 bits of an md5 of seed and id, as a number in [0, 1)
    name = F.coalesce(F.col(f"`{key}`").cast("string"), F.concat(F.lit("text:"), F.col(f"`{text}`")), F.lit("none"))
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name)), 1, 8), 16, 10).cast("double") / 4294967296.0
    rows = docs.select(F.struct(*others(docs, ())).alias("row"), F.col(f"`{source}`").alias("of"), size.alias("size"), drawn.alias("drawn"))
    rate = F.coalesce(F.try_divide("target", F.col("source_size").cast("double")), F.lit(0.0))
    copies = F.floor("rate") + F.when(F.col("drawn") < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    return (rows.join(targets, F.col("of").eqNullSafe(F.col("source"))).withColumn("rate", rate)
            .select("row", "size", "source_size", "target", "rate", copies.cast("long").alias("copies")))


def plan(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", seed: int = 17, **options) -> DataFrame:
    """``docs`` with size, source_size, target (its source's), rate and copies."""
    kept = [c for c in docs.columns if c.lower() not in PLAN]
    return _planned(docs, text, source, key, seed, options).select(*[F.col("row")[c].alias(c) for c in kept], *PLAN)


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", seed: int = 17, **options) -> DataFrame:
    """The rows of ``docs``, each as often as its plan says."""
    taken = _planned(docs, text, source, key, seed, options).where("copies > 0")
    return taken.select("row", F.explode(F.expr("array_repeat(1, cast(copies as int))"))).select(*[F.col("row")[c].alias(c) for c in docs.columns])

"""Structured Streaming intake and scoring.

Arriving patient records are derived, checked and scored with the same
stateless ``select``s as the batch path, so no state store and no watermark
are needed.  Per-patient aggregates that do not arrive with the record (labs,
dialysate shifts) are joined as static frames (stream-static joins).
Output goes to a file sink in the shared checkpoint folder with its own
streaming checkpoint, so a restarted query resumes exactly once.  Tests use
``Trigger.AvailableNow``.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cohort as cohort_ops
from ..operators import intake as I
from ..operators import quality as Q
from ..session import ensure_checkpoint_dir
from ..sources import dictionaries as D
from ..sources import tables
from ..sources.views import VIEW_SQL


def table_stream(spark: SparkSession, sf_dir: str, name: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """File stream over one driver table (its folder filtered to the table's files).

    A micro-batch takes all new files unless the caller limits it: the static
    sides are joined once for each batch.
    """
    schema = tables.table(spark, sf_dir, name).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
    if max_files_per_trigger:
        stream = stream.option("maxFilesPerTrigger", max_files_per_trigger)
    return stream.parquet(sf_dir)


def _private_views(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """Register the order stream and the static customers under names private to this stream,
    so the batch ``orders`` / ``customer`` views of the session are never shadowed."""
    tag = uuid.uuid4().hex[:12]
    o, c = f"__stream_orders_{tag}", f"__static_customer_{tag}"
    table_stream(spark, sf_dir, "orders").createOrReplaceTempView(o)
    tables.table(spark, sf_dir, "customer").createOrReplaceTempView(c)
    return o, c


def _on(sql: str, o: str, c: str) -> str:
    return sql.replace("from orders o join customer c", f"from {o} o join {c} c")


def cohort_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streaming patient records: the cohort shaping over a stream of orders joined to static customers."""
    o, c = _private_views(spark, sf_dir)
    return spark.sql(_on(VIEW_SQL["cohort"], o, c))


def derive_and_validate(records: DataFrame, osm: DataFrame, labs: DataFrame, key: str = "patient_id",
                        guards: Sequence[tuple[str, float, float]] = (), keep_all: bool = False) -> DataFrame:
    """H19 + B10 + B11 on a (streaming or batch) frame; per-patient aggregates joined as static frames.

    ``guards`` (field, min, max) add ``warnings``: the fields of the record that
    lie outside, in this order, joined by commas.  ``keep_all`` keeps the other
    columns of the records too.
    """
    from ..functions import parse as P
    base = cohort_ops.derive_features(records)
    named = [key, "age", "height_cm", "weight_kg", "bmi", "charlson_index", "inflow", "outflow"]
    rec = (base.select(*named, *[c for c in base.columns if keep_all and c not in named])
           .withColumn("dwell_time_minutes", P.dwell_minutes(F.col("inflow"), F.col("outflow")))
           .join(osm.select(key, "pdf_osmolarity"), key, "left")
           .join(labs, key, "left"))
    v = Q.validity(rec)
    out = v.withColumn("missing", F.concat_ws(",", "missing")).withColumn("errors", F.concat_ws(",", "errors"))
    if guards:
        outside = [F.when((F.col(f) < lo) | (F.col(f) > hi), F.lit(f)) for f, lo, hi in guards if f in out.columns]
        out = out.withColumn("warnings", F.concat_ws(",", *outside))
    return out


def static_aggregates(spark: SparkSession, sf_dir: str, materialize: bool = True):
    """Batch per-patient osmolarity and wide labs (the static side of the stream-static joins).

    The static side of a stream-static join is re-evaluated for every
    micro-batch; with ``materialize`` the two aggregates are computed once and
    kept as reliable checkpoints in the shared folder, so each micro-batch
    reads them instead of re-aggregating the shifts and labs.
    """
    from ..session import cut_lineage
    from ..sources import views
    osm = I.osmolarity(views.view(spark, sf_dir, "regimen"), views.view(spark, sf_dir, "shifts"), D.bags(spark))
    labs = I.labs_wide(I.convert_labs(views.view(spark, sf_dir, "labs_long"), D.lab_units(spark),
                                      D.unit_factors(spark)))
    if materialize:
        osm, labs = cut_lineage(osm.select("patient_id", "pdf_osmolarity")), cut_lineage(labs)
    return osm, labs


def intake_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streaming patient records with their dwell times: orders stream joined to static customers."""
    from ..sources.views import record_stream_sql
    o, c = _private_views(spark, sf_dir)
    return spark.sql(_on(record_stream_sql(), o, c))


def run_to_files(df: DataFrame, name: str, fmt: str = "parquet", partition_by: list[str] | None = None,
                 root: str | None = None) -> str:
    """Run a streaming frame to completion (AvailableNow) into a file sink; returns the data path."""
    spark = df.sparkSession
    base = (root or ensure_checkpoint_dir(spark)).rstrip("/") + f"/streams/{name}/{uuid.uuid4().hex}"
    w = (df.writeStream.format(fmt).option("path", f"{base}/data")
         .option("checkpointLocation", f"{base}/checkpoint").outputMode("append").trigger(availableNow=True))
    if partition_by:
        w = w.partitionBy(*partition_by)
    q = w.start()
    q.awaitTermination()
    return f"{base}/data"

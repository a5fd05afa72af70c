"""Sinks: prediction audit JSON, selection summary, evaluation tables, preparation state.

All writers take a path on shared storage (on a cluster, never a machine-local
folder); ``default_root`` is the session's ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def default_root(spark: SparkSession, *parts: str) -> str:
    return "/".join([ensure_checkpoint_dir(spark).rstrip("/"), *parts])


def run_root(spark: SparkSession, *parts: str) -> str:
    """A fresh folder of this run: a run never overwrites what another one still reads."""
    return default_root(spark, *parts, uuid.uuid4().hex)


# ----------------------------------------------------------------- audit (A8)
def record_id(*cols, deterministic: bool = True) -> Column:
    """Row id: sha-256 of the key column's text (deterministic), or a random UUID.

    Several columns are joined with their lengths in front, so that different keys never read alike.
    """
    if not deterministic:
        return F.uuid()
    texts = [F.col(c).cast("string") for c in cols]
    if len(texts) == 1:
        return F.sha2(F.coalesce(texts[0], F.lit("")), 256)
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def audit_records(df: DataFrame, version: str, request_cols: Sequence[str], response_cols: Sequence[str],
                  key: str = "patient_id") -> DataFrame:
    """One audit row per prediction: version, record_id, generated_at and the JSON document
    ``{version, generated_at, request, response}``."""
    req = F.struct(*[F.col(c) for c in request_cols])
    resp = F.struct(*[F.col(c) for c in response_cols])
    ts = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    doc = F.to_json(F.struct(F.lit(version).alias("version"), ts.alias("generated_at"),
                             req.alias("request"), resp.alias("response")))
    return df.select(F.lit(version).alias("version"), record_id(key).alias("record_id"), F.col(key),
                     doc.alias("payload"))


def write_audit(audit: DataFrame, path: str, mode: str = "append") -> None:
    audit.write.mode(mode).partitionBy("version").json(path)


# ------------------------------------------------------------ selection (A7)
def write_selection(selection: DataFrame, path: str) -> None:
    """target -> selected features, coefficients, alpha, as JSON lines (one document per target)."""
    doc = selection.groupBy("target").agg(
        F.array_sort(F.collect_list(F.when(F.col("selected"), F.col("feature")))).alias("selected_features"),
        F.map_from_entries(F.collect_list(F.when(F.col("selected"), F.struct("feature", "coefficient"))))
        .alias("coefficients"),
        F.first("alpha").alias("alpha"))
    doc.write.mode("overwrite").json(path)


# ------------------------------------------------------------ evaluation (A9)
def write_evaluation(tables: dict[str, DataFrame], path: str) -> None:
    """Each evaluation table as parquet under ``path/<name>``."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")


# ---------------------------------------------------------- prep state (A10)
PREP_STATE_VERSION = 2


def write_prep_state(model, spark: SparkSession, path: str) -> None:
    """Parameter table plus option rows (JSON values, one the format's version), as parquet."""
    params = model.params_frame(spark)
    opts = spark.createDataFrame(
        [("__option__", "option", None, None, None, None, None, json.dumps(v), None, k) for k, v in {
            "version": PREP_STATE_VERSION, "numeric": list(model.numeric), "categorical": list(model.categorical),
            "targets": list(model.targets), "imputation": model.imputation, "scaling": model.scaling,
            "encoding": model.encoding, "log_features": list(model.log_features),
            "derive": bool(model.derive), "feature_columns": list(model.feature_columns)}.items()],
        params.schema)
    params.unionByName(opts).write.mode("overwrite").parquet(path)


def read_prep_state(spark: SparkSession, path: str):
    """Rebuild a fitted preparation from its parameter table (a bounded table: features + categories)."""
    from ..operators.prep import PrepModel
    rows = [r.asDict() for r in spark.read.parquet(path).collect()]
    opts = {r["source"]: json.loads(r["category"]) for r in rows if r["kind"] == "option"}
    if opts.get("version") != PREP_STATE_VERSION:
        raise ValueError(f"preparation state of version {opts.get('version')}; this reads {PREP_STATE_VERSION}")
    params = [r for r in rows if r["kind"] != "option"]
    order = {"numeric": 0}
    params.sort(key=lambda p: (order.get(p["kind"], 1), p["source"] or "", p["ordinal"] or 0))
    m = PrepModel(opts["numeric"], opts["categorical"], opts["targets"], params, opts["imputation"], opts["scaling"],
                  opts["encoding"], opts["log_features"], opts["derive"], opts["feature_columns"])
    num_order = {c: i for i, c in enumerate(m.numeric)}
    m.params.sort(key=lambda p: (0, num_order.get(p["feature"], 0), 0) if p["kind"] == "numeric"
                  else (1, m.categorical.index(p["source"]), p["ordinal"]))
    return m

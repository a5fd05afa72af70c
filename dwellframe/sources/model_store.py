"""Fitted models as one versioned table in shared storage.

A model is a row of options (JSON), one row a coefficient, and one row a tree
node; a model made of others (quantiles, a stack) holds theirs under paths below
its own.  MLlib models inside keep MLlib's own format in a folder beside the
table.  Every save goes to a folder of its own, named by a run id, so it never
overwrites what another run reads; numbers come back exactly.
"""

from __future__ import annotations

import json
import uuid
from importlib import import_module

import numpy as np
from pyspark.sql import SparkSession

from ..operators import models as M
from ..operators.boosting import NODES, TreeTable
from ..operators.training import QuantileModels
from .sinks import default_root

VERSION = 1
SCHEMA = f"version int, path string, part string, place long, name string, value double, text string, node struct<{NODES.replace(' ', ': ').replace(',:', ',')}>"


def _children(model) -> dict[str, object]:
    if isinstance(model, QuantileModels):
        return {f"q{i}": m for i, m in enumerate(model.models.values())}
    if isinstance(model, M.StackedModel):
        return {f"base{i}": m for i, m in enumerate(model.bases)} | {"meta": model.meta}
    return {}


def _options(model) -> dict:
    kinds = {M.LinearModel: ("features", "intercept", "kind", "lacking"), M.BoostedTrees: ("features", "base", "kind", "quantile"),
             M.DistributionBoosting: ("features", "dist", "mu0", "log_s0", "kind"), M.StackedModel: ("features", "kind"), QuantileModels: ("features", "kind"),
             M.MLModel: ("features", "kind", "lacking"), M.ForestModel: ("features", "kind", "lacking")}
    if type(model) not in kinds:
        raise TypeError(f"models of type {type(model).__name__} cannot be saved")
    out = {name: getattr(model, name) for name in kinds[type(model)]} | {"type": type(model).__name__}
    if isinstance(model, QuantileModels):
        out["quantiles"] = list(model.models)
    if isinstance(model, M.StackedModel):
        out["bases"] = len(model.bases)
    if isinstance(model, M.ForestModel):
        out["importances"] = [float(x) for x in model.model.featureImportances.toArray()]
    elif isinstance(model, M.MLModel):
        out["class"] = [type(model.model).__module__, type(model.model).__name__]
    return out


def _rows(model, path: str, root: str) -> list[tuple]:
    rows = [(VERSION, path, "options", 0, None, None, json.dumps(_options(model)), None)]
    if isinstance(model, M.LinearModel):
        rows += [(VERSION, path, "coefficient", i, c, float(b), None, None) for i, (c, b) in enumerate(zip(model.features, model.coef, strict=True))]
    if isinstance(model, (M.BoostedTrees, M.DistributionBoosting, M.ForestModel)):
        rows += [(VERSION, path, "node", i, None, None, None, node) for i, node in enumerate(model.table.rows())]
    if type(model) is M.MLModel:
        model.model.write().save(f"{root}/mllib/{path.replace('/', '-')}")
    for name, child in _children(model).items():
        rows += _rows(child, f"{path}/{name}", root)
    return rows


def save(model, spark: SparkSession, root: str | None = None, run_id: str | None = None) -> str:
    """Write the model under ``root``/``run_id`` (by default a fresh folder of the shared storage); returns its path."""
    folder = f"{(root or default_root(spark, 'models')).rstrip('/')}/{run_id or uuid.uuid4().hex}"
    spark.createDataFrame(_rows(model, "model", folder), SCHEMA).write.parquet(f"{folder}/table")  # as large as the model, whatever the data
    return folder


def load(spark: SparkSession, folder: str):
    """The model that :func:`save` wrote to ``folder``."""
    rows = spark.read.schema(SCHEMA).parquet(f"{folder.rstrip('/')}/table").collect()
    if {r["version"] for r in rows} != {VERSION}:
        raise ValueError(f"model table of versions {sorted({r['version'] for r in rows})}; this reads {VERSION}")
    parts: dict[tuple[str, str], list] = {}
    for r in sorted(rows, key=lambda r: (r["path"], r["part"], r["place"])):
        parts.setdefault((r["path"], r["part"]), []).append(r)
    return _build(spark, folder.rstrip("/"), parts, "model")


def _build(spark: SparkSession, folder: str, parts: dict, path: str):
    o = json.loads(parts[path, "options"][0]["text"])
    child = lambda name: _build(spark, folder, parts, f"{path}/{name}")
    kind = o["type"]
    if kind == "LinearModel":
        return M.LinearModel(o["features"], np.array([r["value"] for r in parts.get((path, "coefficient"), [])]), o["intercept"], o["kind"], o["lacking"])
    if kind == "QuantileModels":
        return QuantileModels(o["features"], {q: child(f"q{i}") for i, q in enumerate(o["quantiles"])}, o["kind"])
    if kind == "StackedModel":
        return M.StackedModel(o["features"], [child(f"base{i}") for i in range(o["bases"])], child("meta"), o["kind"])
    if kind == "MLModel":
        module, name = o["class"]
        return M.MLModel(o["features"], getattr(import_module(module), name).load(f"{folder}/mllib/{path.replace('/', '-')}"), o["kind"], o["lacking"])
    table = TreeTable.from_rows(o["features"], [tuple(r["node"]) for r in parts.get((path, "node"), [])])
    if kind == "ForestModel":
        return M.ForestModel(o["features"], M.ForestImportances(M.DenseVector(o["importances"])), o["kind"], o["lacking"], table)
    if kind == "BoostedTrees":
        return M.BoostedTrees(o["features"], o["base"], table, o["kind"], o["quantile"])
    return M.DistributionBoosting(o["features"], o["dist"], o["mu0"], o["log_s0"], table, o["kind"])

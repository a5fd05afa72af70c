"""Boosted-tree ensembles: model JSON -> node table -> batch scoring.

* Source: the model JSON is parsed by Spark (``from_json``, ``posexplode`` of
  trees, ``arrays_zip`` + ``posexplode`` of node arrays) into a node table
  ``(tree_id, class_idx, node_id, left, right, feature, threshold,
  default_left, leaf)``.
* Scoring: ``Ensemble.score`` compiles the node table into one nested ``when``
  expression per tree, so scoring is a single projection with no UDF and no
  shuffle; the expression grows with the model.  ``score_arrow`` is the choice
  for models of any size and depth: vectorised over rows, level by level.
* Semantics: missing (NULL/NaN) follows ``default_left``; otherwise
  ``x < threshold`` goes left; a leaf returns its base weight; per class the
  raw score is the base margin plus its trees; softmax, argmax and top-2 follow.
"""

from __future__ import annotations

import json
import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scores as SC

_RESOURCE = Path(__file__).resolve().parents[1] / "sources" / "resources" / "toy_tree_model.json"

_TREE = T.StructType([
    T.StructField("left_children", T.ArrayType(T.LongType())),
    T.StructField("right_children", T.ArrayType(T.LongType())),
    T.StructField("split_indices", T.ArrayType(T.LongType())),
    T.StructField("split_conditions", T.ArrayType(T.DoubleType())),
    T.StructField("base_weights", T.ArrayType(T.DoubleType())),
    T.StructField("default_left", T.ArrayType(T.LongType())),
])
MODEL_SCHEMA = T.StructType([T.StructField("learner", T.StructType([
    T.StructField("feature_names", T.ArrayType(T.StringType())),
    T.StructField("learner_model_param", T.MapType(T.StringType(), T.StringType())),
    T.StructField("objective", T.StructType([T.StructField("softmax_multiclass_param",
                                                           T.MapType(T.StringType(), T.StringType()))])),
    T.StructField("gradient_booster", T.StructType([T.StructField("model", T.StructType([
        T.StructField("tree_info", T.ArrayType(T.LongType())),
        T.StructField("trees", T.ArrayType(_TREE)),
    ]))])),
]))])


def toy_model_text() -> str:
    return _RESOURCE.read_text(encoding="utf-8")


def model_frame(spark: SparkSession, text: str | None = None, path: str | None = None) -> DataFrame:
    """One-row frame of the parsed model (from shared storage ``path`` or JSON text)."""
    if path:
        return spark.read.schema(MODEL_SCHEMA).json(path, multiLine=True)
    raw = spark.createDataFrame([(text or toy_model_text(),)], "doc string")
    return raw.select(F.from_json("doc", MODEL_SCHEMA).alias("m")).select("m.*")


def base_margin(base_score: float | None) -> float:
    """0 < b < 1 -> logit(b); other finite b -> b; otherwise 0."""
    if base_score is None or not math.isfinite(base_score):
        return 0.0
    if 0.0 < base_score < 1.0:
        return math.log(base_score / (1.0 - base_score))
    return float(base_score)


def model_params(mf: DataFrame) -> DataFrame:
    """feature_names, num_class (num_class, else the objective's, else 1), base_margin input."""
    L = F.col("learner")
    ncls = F.coalesce(L["learner_model_param"]["num_class"],
                      L["objective"]["softmax_multiclass_param"]["num_class"], F.lit("1"))
    return mf.select(L["feature_names"].alias("feature_names"),
                     F.greatest(ncls.try_cast("int"), F.lit(1)).alias("num_class"),
                     L["learner_model_param"]["base_score"].try_cast("double").alias("base_score"))


def node_table(mf: DataFrame) -> DataFrame:
    """(tree_id, class_idx, node_id, left, right, feature, threshold, default_left, leaf)."""
    m = F.col("learner.gradient_booster.model")
    t = mf.select(m["tree_info"].alias("info"), F.posexplode(m["trees"]).alias("tree_id", "tree"))
    t = t.select("tree_id", F.coalesce(F.element_at("info", F.col("tree_id") + 1), F.lit(0)).cast("int").alias("class_idx"),
                 F.posexplode(F.arrays_zip(
                     F.col("tree.left_children").alias("left"), F.col("tree.right_children").alias("right"),
                     F.col("tree.split_indices").alias("feature"), F.col("tree.split_conditions").alias("threshold"),
                     F.col("tree.base_weights").alias("leaf"), F.col("tree.default_left").alias("default_left"))
                 ).alias("node_id", "n"))
    return t.select("tree_id", "class_idx", "node_id", F.col("n.left").alias("left"), F.col("n.right").alias("right"),
                    F.col("n.feature").alias("feature"), F.col("n.threshold").alias("threshold"),
                    (F.col("n.default_left") == 1).alias("default_left"), F.col("n.leaf").alias("leaf"))


@dataclass
class Ensemble:
    feature_names: list[str]
    num_class: int
    margin: float
    trees: dict  # tree_id -> (class_idx, {node_id: row dict})

    @classmethod
    def load(cls, spark: SparkSession, text: str | None = None, path: str | None = None) -> "Ensemble":
        """Parse with Spark; the node table (as large as the model, whatever the data) comes to the driver."""
        mf = model_frame(spark, text, path)
        p = model_params(mf).first()
        nodes = node_table(mf)
        trees: dict = defaultdict(lambda: [0, {}])
        for r in nodes.collect():
            trees[r["tree_id"]][0] = r["class_idx"]
            trees[r["tree_id"]][1][r["node_id"]] = r.asDict()
        return cls(list(p["feature_names"]), int(p["num_class"]), base_margin(p["base_score"]),
                   {k: (v[0], v[1]) for k, v in sorted(trees.items())})

    # ------------------------------------------------------------ compiled path
    def _node_expr(self, nodes: dict, nid: int, cols: dict[str, Column]) -> Column:
        n = nodes[nid]
        if n["left"] == -1 and n["right"] == -1:
            return F.lit(float(n["leaf"]))
        x = cols[self.feature_names[n["feature"]]]
        missing = x.isNull() | F.isnan(x)
        below = x < F.lit(float(n["threshold"]))
        # one condition a node: each child stands in the expression once
        goes_left = (missing | below) if n["default_left"] else (~missing & below)
        return F.when(goes_left, self._node_expr(nodes, n["left"], cols)).otherwise(self._node_expr(nodes, n["right"], cols))

    def raw_scores(self, df: DataFrame | None = None) -> Column:
        """array<double> of per-class raw scores as one Column expression."""
        cols = {f: F.col(f).cast("double") for f in self.feature_names}
        per = [F.lit(self.margin) for _ in range(self.num_class)]
        for _, (cls_idx, nodes) in self.trees.items():
            per[cls_idx] = per[cls_idx] + self._node_expr(nodes, 0, cols)
        return F.array(*per)

    def score(self, df: DataFrame, prefix: str = "") -> DataFrame:
        """Adds raw_scores, probs, pred_class and top2 (arrays) to ``df``."""
        d = df.withColumn(f"{prefix}raw_scores", self.raw_scores())
        probs = SC.softmax(F.col(f"{prefix}raw_scores"))
        return (d.withColumn(f"{prefix}probs", probs)
                .withColumn(f"{prefix}pred_class", SC.argmax(F.col(f"{prefix}probs")))
                .withColumn(f"{prefix}top2", SC.top_k(F.col(f"{prefix}probs"), 2)))

    # --------------------------------------------------------------- Arrow path
    def score_arrow(self, df: DataFrame) -> DataFrame:
        """Vectorised scorer for large ensembles: numpy traversal per Arrow batch (no per-row Python).

        Every input row is kept as it is, with ``raw_scores`` beside its columns;
        trees may have any depth.  Rows need no unique key.
        """
        names, ncls, margin = self.feature_names, self.num_class, self.margin
        packed = []
        for _, (cls_idx, nodes) in self.trees.items():
            size = max(nodes) + 1
            arr = {k: np.zeros(size) for k in ("left", "right", "feature", "threshold", "leaf", "dleft")}
            for i, n in nodes.items():
                arr["left"][i], arr["right"][i], arr["feature"][i] = n["left"], n["right"], n["feature"]
                arr["threshold"][i], arr["leaf"][i], arr["dleft"][i] = n["threshold"], n["leaf"], n["default_left"]
            packed.append((cls_idx, {k: v for k, v in arr.items()}))
        bc = df.sparkSession.sparkContext.broadcast(packed)

        @F.pandas_udf("array<double>")
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
            model = bc.value
            for pdf in batches:
                X = np.column_stack([pdf[f].astype("float64").to_numpy() for f in names])
                raw = np.full((len(pdf), ncls), margin)
                rows = np.arange(len(pdf))
                for cls_idx, a in model:
                    node = np.zeros(len(pdf), dtype=np.int64)
                    while not (leaf := (a["left"][node] == -1) & (a["right"][node] == -1)).all():
                        x = X[rows, a["feature"][node].astype(np.int64)]
                        miss = np.isnan(x)
                        go_left = np.where(miss, a["dleft"][node] == 1, x < a["threshold"][node])
                        nxt = np.where(go_left, a["left"][node], a["right"][node]).astype(np.int64)
                        node = np.where(leaf, node, nxt)
                    raw[:, cls_idx] += a["leaf"][node]
                yield pd.Series(list(raw))

        return df.withColumn("raw_scores", run(F.struct(*[F.col(f).cast("double").alias(f) for f in names])))


def raw_score_sql(ens: Ensemble) -> list[str]:
    """Oracle text: per-class raw score as nested CASE expressions (same model, SQL semantics)."""
    def node(nodes, nid):
        n = nodes[nid]
        if n["left"] == -1 and n["right"] == -1:
            return repr(float(n["leaf"])) + "e0" if "e" not in repr(float(n["leaf"])) else repr(float(n["leaf"]))
        x = f"cast({ens.feature_names[n['feature']]} as double)"
        left, right = node(nodes, n["left"]), node(nodes, n["right"])
        miss = left if n["default_left"] else right
        return f"(case when {x} is null or isnan({x}) then {miss} when {x} < {float(n['threshold'])!r} then {left} else {right} end)"

    per = [[f"{ens.margin!r}"] for _ in range(ens.num_class)]
    for _, (cls_idx, nodes) in ens.trees.items():
        per[cls_idx].append(node(nodes, 0))
    return [" + ".join(p) for p in per]


def load_json(text: str) -> dict:
    """Parse model JSON text on the driver (model-sized)."""
    return json.loads(text)


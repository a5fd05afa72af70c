"""Model operators: fit on Spark, score on Spark.

* Linear family (OLS, elastic net, ridge) from one Gram pass; the solver runs
  on p x p statistics.
* Forest from :mod:`forest` (large nodes by shared tables, small ones in one task);
  classifiers from MLlib; squared-error, quantile and distribution
  boosting from :mod:`boosting` (bins once, one aggregate a tree level, one node
  table scored in one pass).
* Stacking: out-of-fold predictions of each base model, then a ridge
  meta-learner on them.
* Random search: seeded sample of a parameter grid scored by ``CrossValidator``
  with an explicit fold column; MLlib's squared-error boosting by its own rules in
  :mod:`boosting`, all candidates of a fold on one state.

Every fitted model carries its own feature list; scoring uses that list.  Rows
without a target are never fitted.  Rows that lack a feature are one rule for
all learners but boosting (which learns a side for them): ``missing="error"``
raises and says how many there are, ``"drop"`` leaves them out, ``"mean"`` puts
the feature's mean in; the model's ``lacking`` holds their number.
"""

from __future__ import annotations

import itertools
import math
import random
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.linalg import DenseVector
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import boosting as B
from . import forest as FO
from . import ranking as R
from . import select as SL

VEC = "features_vec"


def parallel_map(fn, items, parallelism: int = 4) -> list:
    """Run independent fits concurrently from driver threads (Spark schedules their jobs together),
    as ``CrossValidator(parallelism=...)`` does; results keep the input order."""
    from concurrent.futures import ThreadPoolExecutor
    items = list(items)
    if parallelism <= 1 or len(items) <= 1:
        return [fn(x) for x in items]
    with ThreadPoolExecutor(max_workers=min(parallelism, len(items))) as pool:
        return list(pool.map(fn, items))


def assemble(df: DataFrame, features: Sequence[str], out: str = VEC) -> DataFrame:
    """Vector column at the model edge only; NULLs must be imputed before (``handleInvalid='error'``)."""
    d = df.withColumns({c: F.col(c).cast("double") for c in features})
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="error").transform(d)


# ---------------------------------------------------------------- linear family
@dataclass
class LinearModel:
    features: list[str]
    coef: np.ndarray
    intercept: float
    kind: str = "linear"
    lacking: int = 0  # training rows that lacked a feature

    def predict(self, df: DataFrame, out: str = "y_pred") -> DataFrame:
        expr = F.lit(self.intercept)
        for c, b in zip(self.features, self.coef):
            expr = expr + F.lit(float(b)) * F.col(c).cast("double")
        return df.withColumn(out, expr)


def _gram(df: DataFrame, features: Sequence[str], target: str, missing: str) -> tuple[SL.GramStats, int]:
    d, ms, lacking = SL.checked(df, features, target, missing)
    st = SL.collect_gram(d.withColumn("__f", F.lit(0)), list(features), target, "__f", {c: m for c, (m, _) in ms.items()})
    return st, lacking


def _unshift(st: SL.GramStats, b: np.ndarray, b0_shifted: float) -> float:
    return float(b0_shifted + st.y_shift - st.x_shift @ b)


def fit_ols(df: DataFrame, features: Sequence[str], target: str, missing: str = "error") -> LinearModel:
    st, lacking = _gram(df, features, target, missing)
    b, b0 = SL.ols_from_gram(st)
    return LinearModel(list(features), b, b0, "linear_regression", lacking)


def fit_elastic_net(df: DataFrame, features: Sequence[str], target: str, alpha: float = 1.0,
                    l1_ratio: float = 0.5, max_iter: int = 1000, tol: float = 1e-4, missing: str = "error") -> LinearModel:
    """(1/2n)||y - b0 - Xb||² + alpha·l1·||b||₁ + ½·alpha·(1 − l1)·||b||² by coordinate descent on the Gram."""
    st, lacking = _gram(df, features, target, missing)
    n, mx, my, cxx, cxy, _ = SL._centred(st.total())
    b = elastic_net_cd(cxx, cxy, n, alpha, l1_ratio, max_iter, tol)
    return LinearModel(list(features), b, _unshift(st, b, my - mx @ b), "elastic_net", lacking)


def elastic_net_cd(cxx: np.ndarray, cxy: np.ndarray, n: float, alpha: float, l1_ratio: float, max_iter: int = 1000, tol: float = 1e-4) -> np.ndarray:
    """Coordinate descent on centred sums."""
    p = len(cxy)
    b = np.zeros(p)
    l1, l2 = alpha * l1_ratio * n, alpha * (1 - l1_ratio) * n
    for _ in range(max_iter):
        delta, top = 0.0, 0.0
        for j in range(p):
            rho = cxy[j] - cxx[j] @ b + cxx[j, j] * b[j]
            den = cxx[j, j] + l2
            new = 0.0 if den <= 0 else np.sign(rho) * max(abs(rho) - l1, 0.0) / den
            delta, top = max(delta, abs(new - b[j])), max(top, abs(new))
            b[j] = new
        if delta <= tol * max(top, 1e-12):
            break
    return b


def fit_ridge(df: DataFrame, features: Sequence[str], target: str, alpha: float = 1.0, missing: str = "error") -> LinearModel:
    """||y - b0 - Xb||² + alpha·||b||² (closed form on the centred Gram)."""
    st, lacking = _gram(df, features, target, missing)
    n, mx, my, cxx, cxy, _ = SL._centred(st.total())
    b = np.linalg.solve(cxx + alpha * np.eye(len(features)), cxy)
    return LinearModel(list(features), b, _unshift(st, b, my - mx @ b), "ridge", lacking)


def residual_offsets(model, df: DataFrame, target: str, coverage: float = 0.95) -> tuple[float, float]:
    """Exact residual quantiles of a model on ``df``: what to add to a prediction for an interval of that coverage."""
    tail = (1 - coverage) / 2
    scored = model.predict(df.filter(F.col(target).isNotNull()), out="__p").select((F.col(target).cast("double") - F.col("__p")).alias("r"))
    row = R.exact_percentiles(scored, "r", [tail, 1 - tail], names=["lo", "hi"]).first()
    return float(row["lo"]), float(row["hi"])


# ------------------------------------------------------------------ MLlib models
@dataclass
class MLModel:
    features: list[str]
    model: object
    kind: str
    lacking: int = 0

    def predict(self, df: DataFrame, out: str = "y_pred") -> DataFrame:
        cols = df.columns
        scored = self.model.transform(assemble(df, self.features))
        return scored.withColumnRenamed("prediction", out).select(*cols, out)


class ForestImportances:
    """Importances of a forest's features, as MLlib's forests give them."""

    def __init__(self, featureImportances):
        self.featureImportances = featureImportances


@dataclass
class ForestModel(MLModel):
    """Trees whose values add up to their mean prediction; ``model`` holds the importances."""

    table: B.TreeTable | None = None

    def predict(self, df: DataFrame, out: str = "y_pred") -> DataFrame:
        lacks = F.lit(False)
        for c in self.features:
            lacks = lacks | F.col(f"`{c}`").isNull() | F.isnan(F.col(f"`{c}`").cast("double"))
        refused = F.raise_error(F.lit("a row to predict lacks a feature")).cast("double")
        return self.table.add_sums(df, [out]).withColumn(out, F.when(lacks, refused).otherwise(F.col(f"`{out}`")))


def fit_random_forest(df: DataFrame, features: Sequence[str], target: str, num_trees: int = 100,
                      max_depth: int = 12, seed: int = 42, missing: str = "error", **kw) -> MLModel:
    """Bootstrap forest; every split considers all features.

    The depth is 12 unless given; MLlib grows trees to depth 30 at most, so a
    deeper one is refused. Further options go to MLlib's own forest.
    """
    if max_depth > 30:
        raise ValueError(f"max_depth={max_depth}: MLlib's trees end at depth 30")
    if not kw:
        d, _, lacking = SL.checked(df, features, target, missing)
        table, importance = FO.fit(d, features, target, num_trees, max_depth, seed)
        return ForestModel(list(features), ForestImportances(DenseVector(importance)), "random_forest", lacking, table)
    rf = RandomForestRegressor(featuresCol=VEC, labelCol=target, numTrees=num_trees, maxDepth=max_depth,
                               featureSubsetStrategy=kw.pop("featureSubsetStrategy", "all"), seed=seed, **kw)
    d, _, lacking = SL.checked(df, features, target, missing)
    return MLModel(list(features), rf.fit(assemble(d, features)), "random_forest", lacking)


@dataclass
class BoostedTrees:
    """base + the trees' sums; a quantile's booster or a squared-error one."""

    features: list[str]
    base: float
    table: B.TreeTable
    kind: str = "quantile_boosting"
    quantile: float | None = None

    def predict(self, df: DataFrame, out: str = "y_pred") -> DataFrame:
        return self.table.add_sums(df, [out]).withColumn(out, F.lit(self.base) + F.col(f"`{out}`"))

    raw = predict


def fit_gbt(df: DataFrame, features: Sequence[str], target: str, n_estimators: int = 500, max_depth: int = 6,
            learning_rate: float = 0.1, kind: str = "xgboost", l2: float = 1.0, min_rows: int = 1, max_bin: int = 64) -> BoostedTrees:
    """Squared-error gradient boosting for the xgboost / lightgbm / catboost types, which differ by their options."""
    f = B.fit(df, features, target, [B.Squared(l2)], n_estimators, max_depth, learning_rate, min_rows, max_bin)
    return BoostedTrees(list(features), f.starts[0][0], f.tables[0], kind)


def feature_importance(model: MLModel) -> list[tuple[str, float]]:
    """Impurity importances of a forest."""
    imp = model.model.featureImportances.toArray()
    return sorted(zip(model.features, map(float, imp)), key=lambda t: -t[1])


def fit_pet_classifier(df: DataFrame, features: Sequence[str], label: str, kind: str = "forest",
                       seed: int = 42, num_trees: int = 50, max_depth: int = 6, missing: str = "error") -> MLModel:
    """Multi-class PET classifier: forest, or multinomial logistic regression."""
    rows, _, lacking = SL.checked(df, features, label, missing)
    d = assemble(rows, features).withColumn(label, F.col(label).cast("double"))
    if kind == "forest":
        est = RandomForestClassifier(featuresCol=VEC, labelCol=label, numTrees=num_trees, maxDepth=max_depth, seed=seed)
    else:
        est = LogisticRegression(featuresCol=VEC, labelCol=label, family="multinomial", maxIter=100)
    return MLModel(list(features), est.fit(d), f"{kind}_classifier", lacking)


def fit_logistic_l1(df: DataFrame, features: Sequence[str], label: str, alpha: float = 0.01, missing: str = "error") -> MLModel:
    """L1 logistic selection of a binary label (the specified, not the coded, behaviour)."""
    rows, _, lacking = SL.checked(df, features, label, missing)
    d = assemble(rows, features).withColumn(label, F.col(label).cast("double"))
    lr = LogisticRegression(featuresCol=VEC, labelCol=label, elasticNetParam=1.0, regParam=alpha,
                            standardization=True, maxIter=200)
    return MLModel(list(features), lr.fit(d), "logistic_l1", lacking)


def fit_pca(df: DataFrame, features: Sequence[str], k: int = 2, missing: str = "error"):
    rows, _, _ = SL.checked(df, features, None, missing)
    return PCA(k=k, inputCol=VEC, outputCol="pca").fit(assemble(rows, features))


# ------------------------------------------------- quantile and distribution boosting
def fit_quantiles(df: DataFrame, features: Sequence[str], target: str, quantiles: Sequence[float], n_estimators: int = 500, max_depth: int = 3,
                  learning_rate: float = 0.1, min_rows: int = 1, max_bin: int = 64) -> list[BoostedTrees]:
    """Gradient boosting for the pinball loss, all quantiles on one state.

    Round: a tree on the negative gradient q − 1[y < F]; a leaf's value is the
    q-quantile of its residuals y − F; F += lr · value.
    """
    f = B.fit(df, features, target, [B.Quantile(float(q)) for q in quantiles], n_estimators, max_depth, learning_rate, min_rows, max_bin)
    return [BoostedTrees(list(features), start[0], table, "quantile_boosting", float(q)) for q, start, table in zip(quantiles, f.starts, f.tables, strict=True)]


def fit_quantile_boosting(df: DataFrame, features: Sequence[str], target: str, quantile: float = 0.5, **options) -> BoostedTrees:
    """One quantile of :func:`fit_quantiles`."""
    return fit_quantiles(df, features, target, [quantile], **options)[0]


def pinball_loss(df: DataFrame, y: str, p: str, q: float) -> float:
    e = F.col(y) - F.col(p)
    return df.agg(F.avg(F.greatest(q * e, (q - 1) * e)).alias("l")).first()["l"]


@dataclass
class DistributionBoosting:
    """Mean and log standard deviation (of log y for lognormal) as two sums of trees over one node table."""

    features: list[str]
    dist: str
    mu0: float
    log_s0: float
    table: B.TreeTable
    kind: str = "ngboost"

    def params(self, df: DataFrame) -> DataFrame:
        """Adds ``mu`` and ``log_sigma`` (of log y for lognormal) and ``y_pred`` / ``pred_scale``."""
        cols = df.columns
        cur = self.table.add_sums(df, ["mu", "log_sigma"]).withColumns({"mu": F.lit(self.mu0) + F.col("mu"), "log_sigma": F.lit(self.log_s0) + F.col("log_sigma")})
        if self.dist == "lognormal":
            pred = F.exp(F.col("mu") + F.exp(2 * F.col("log_sigma")) / 2)
            scale = F.exp(F.col("log_sigma"))
        else:
            pred, scale = F.col("mu"), F.exp(F.col("log_sigma"))
        return cur.select(*cols, "mu", "log_sigma", pred.alias("y_pred"), scale.alias("pred_scale"))

    def predict(self, df: DataFrame, out: str = "y_pred") -> DataFrame:
        return self.params(df).drop("mu", "log_sigma", "pred_scale").withColumnRenamed("y_pred", out)


def _nll(z, mu, ls):
    return ls + 0.5 * F.pow((z - mu) / F.exp(ls), 2) + 0.5 * math.log(2 * math.pi)


def fit_distribution_boosting(df: DataFrame, features: Sequence[str], target: str, dist: str = "lognormal",
                              n_estimators: int = 500, max_depth: int = 3, learning_rate: float = 0.01,
                              min_rows: int = 1, max_bin: int = 64) -> DistributionBoosting:
    """Natural-gradient boosting of a normal (or lognormal: normal on log y) distribution.

    Per round: natural gradients of the NLL for (mu, log sigma) are
    (y − mu, ((y − mu)²/sigma² − 1)/2); one regression tree per parameter; the
    step scale is chosen by one aggregate over candidate scales (mean NLL).
    """
    if dist not in ("normal", "lognormal"):
        dist = "lognormal"
    y = F.col(target).cast("double")
    refused = F.raise_error(F.concat(F.lit(f"lognormal needs positive {target}, not "), y.cast("string")))
    z = F.when(y > 0, F.log(y)).otherwise(refused.cast("double")) if dist == "lognormal" else y
    d = df.filter(F.col(target).isNotNull()).withColumn("__z", z)
    f = B.fit(d, features, "__z", [B.Normal()], n_estimators, max_depth, learning_rate, min_rows, max_bin)
    (mu0, log_s0), table = f.starts[0], f.tables[0]
    return DistributionBoosting(list(features), dist, mu0, log_s0 + math.log(f.scale), table)


def mean_nll(model: DistributionBoosting, df: DataFrame, target: str) -> float:
    p = model.params(df.filter(F.col(target).isNotNull()))
    z = F.log(F.col(target)) if model.dist == "lognormal" else F.col(target)
    return p.agg(F.avg(_nll(z, F.col("mu"), F.col("log_sigma"))).alias("l")).first()["l"]


# ------------------------------------------------------------------- stacking
@dataclass
class StackedModel:
    features: list[str]
    bases: list
    meta: LinearModel
    kind: str = "stacked"

    def predict(self, df: DataFrame, out: str = "y_pred") -> DataFrame:
        cur = df
        for i, b in enumerate(self.bases):
            cur = b.predict(cur, out=f"__base{i}")
        cur = self.meta.predict(cur, out=out)
        return cur.drop(*[f"__base{i}" for i in range(len(self.bases))])


def fit_stacking(df: DataFrame, features: Sequence[str], target: str, base_fits: Sequence, fold: str = "fold",
                 meta_alpha: float = 1.0, parallelism: int = 4) -> tuple[StackedModel, DataFrame]:
    """K-fold out-of-fold predictions per base model, ridge meta-learner on them.

    ``base_fits`` are callables ``fit(df, features, target) -> model``.  Returns
    the stacked model (bases refit on all rows) and the out-of-fold frame
    (one row per training row: its count equals n).
    """
    d = df.filter(F.col(target).isNotNull()).na.drop(subset=list(features)).persist()
    folds = sorted(r[fold] for r in d.select(fold).distinct().collect())  # k values

    def fold_scores(f):
        train, hold = d.filter(F.col(fold) != f), d.filter(F.col(fold) == f)
        cur = hold
        for i, fit in enumerate(base_fits):
            cur = fit(train, features, target).predict(cur, out=f"__base{i}")
        return cur

    parts = parallel_map(fold_scores, folds, parallelism)
    oof = parts[0]
    for part in parts[1:]:
        oof = oof.unionByName(part)
    oof = cut_lineage(oof)
    meta = fit_ridge(oof, [f"__base{i}" for i in range(len(base_fits))], target, meta_alpha)
    bases = parallel_map(lambda fit: fit(d, features, target), base_fits, parallelism)
    d.unpersist()
    return StackedModel(list(features), bases, meta), oof


# --------------------------------------------------------------- random search
def random_search(df: DataFrame, features: Sequence[str], target: str, estimator, grid: dict, n_iter: int = 20,
                  fold: str = "fold", metric: str = "r2", seed: int = 42, parallelism: int = 4):
    """Seeded sample of ``n_iter`` parameter combinations scored by ``CrossValidator(foldCol=...)``.

    Depths, steps and numbers of trees of MLlib's squared-error boosting are scored by
    :func:`_boosting_scores`, and the best is refitted. Empty grid -> plain fit.
    Returns (best model, score table rows).
    """
    d = assemble(df.filter(F.col(target).isNotNull()).na.drop(subset=list(features)), features) \
        .withColumn(fold, F.col(fold).cast("int"))
    if not grid:
        return estimator.fit(d), []
    keys = list(grid)
    combos = list(itertools.product(*[grid[k] for k in keys]))
    rnd = random.Random(seed)
    picked = combos if len(combos) <= n_iter else rnd.sample(combos, n_iter)
    maps = []
    for combo in picked:
        maps.append({estimator.getParam(k): v for k, v in zip(keys, combo)})
    ev = RegressionEvaluator(labelCol=target, predictionCol="prediction", metricName=metric)
    if _shares_trees(estimator, target, keys, metric):
        scores = _boosting_scores(d, features, target, estimator, [dict(zip(keys, c)) for c in picked], fold, metric, parallelism)
        best = int(np.argmax(scores) if ev.isLargerBetter() else np.argmin(scores))
        rows = [(dict(zip(keys, combo)), s) for combo, s in zip(picked, scores)]
        return estimator.fit(d.select(VEC, target), maps[best]), rows
    k = d.agg(F.max(fold)).first()[0] + 1
    cv = CrossValidator(estimator=estimator, estimatorParamMaps=maps, evaluator=ev, foldCol=fold, numFolds=k,
                        parallelism=parallelism, collectSubModels=False, seed=seed)
    fitted = cv.fit(d)
    rows = [({k.name: v for k, v in pm.items()}, float(s)) for pm, s in zip(maps, fitted.avgMetrics)]
    return fitted.bestModel, rows


def _shares_trees(est, target: str, keys: Sequence[str], metric: str) -> bool:
    """Whether the candidates are MLlib's squared-error boosting on all rows and features, and differ by depth, step and number of trees only."""
    return (type(est) is GBTRegressor and set(keys) <= {"maxDepth", "maxIter", "stepSize"} and metric in ("r2", "mse", "rmse", "mae")
            and est.getLossType().lower() == "squared" and est.getSubsamplingRate() == 1.0 and est.getFeatureSubsetStrategy().lower() == "all"
            and est.getMinInfoGain() == 0.0 and est.getMinWeightFractionPerNode() == 0.0 and est.getMaxBins() <= B.MAX_BINS
            and not est.isSet("weightCol") and not est.isSet("validationIndicatorCol")
            and (est.getFeaturesCol(), est.getLabelCol(), est.getPredictionCol()) == (VEC, target, "prediction"))


def _mllib_edges(values: np.ndarray, bins: int) -> list[float]:
    """Split candidates of a feature as MLlib picks them from all its values: midpoints nearest to even shares of the rows."""
    distinct, counts = np.unique(values + 0.0, return_counts=True)
    middles = (distinct[:-1] + distinct[1:]) / 2
    splits = min(bins, len(values)) - 1
    if len(middles) <= splits:
        return middles.tolist()
    below, stride, out = np.cumsum(counts), len(values) / (splits + 1), []
    goal = stride
    for i, middle in enumerate(middles):
        if abs(below[i] - goal) < abs(below[i + 1] - goal):
            out.append(float(middle))
            goal += stride
    return out


def _boosting_scores(d: DataFrame, features: Sequence[str], target: str, est, cands: list[dict], fold: str, metric: str, parallelism: int) -> list[float]:
    """Mean held-out metric of every candidate, with MLlib's rules of boosting.

    All candidates of a fold grow on one state (a head for each depth and step), and fewer trees
    are the first of more. As in MLlib the first tree counts in full, the others fit twice the
    residual, and a fold of up to 10,000 rows (or bins squared) gets split candidates from all its
    values; where MLlib samples that many rows of a larger one, a quantile sketch reads them all.
    """
    p = len(features)
    names = [f"x{i}" for i in range(p)]
    root = B.scratch(d.sparkSession, "search")
    plain = d.select(*[F.col(f"`{f}`").cast("double").alias(x) for f, x in zip(features, names)], F.col(target).cast("double").alias("y"), F.col(fold).alias("fold"))
    plain.write.parquet(f"{root}/rows")
    plain = d.sparkSession.read.schema(plain.schema).parquet(f"{root}/rows")
    odd = F.isnan("y") | (F.abs("y") == float("inf"))
    rows = {r["fold"]: r for r in plain.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.count_if(odd).alias("odd")).collect()}  # k values
    if any(r["odd"] for r in rows.values()):
        raise ValueError(f"labels must be finite numbers; some of {target} are not")
    if None in rows or len(rows) < 2 or sorted(rows) != list(range(len(rows))):
        raise ValueError(f"folds must be 0, 1, ... without a gap, at least two, not {sorted(rows, key=str)}")
    total = sum(r["n"] for r in rows.values())
    full = [{k: c.get(k, est.getOrDefault(k)) for k in ("maxDepth", "stepSize", "maxIter")} for c in cands]
    kinds = sorted({(c["maxDepth"], c["stepSize"]) for c in full})
    ends = sorted({c["maxIter"] for c in full})
    place = [(kinds.index((c["maxDepth"], c["stepSize"])), ends.index(c["maxIter"])) for c in full]
    bins = est.getMaxBins()

    def of_fold(i: int) -> list[float]:
        train, held = plain.where(F.col("fold") != i), plain.where(F.col("fold") == i)
        edges = None
        if total - rows[i]["n"] <= max(bins * bins, 10_000):
            x = train.select(*names).toPandas().to_numpy()
            edges = [_mllib_edges(x[:, j], bins) for j in range(p)]
        heads = [B.Squared(depth=depth, rate=2 * step, first_rate=1.0) for depth, step in kinds]
        f = B.fit_rows(train, names, heads, ends[-1], max(depth for depth, _ in kinds), 1.0, est.getMinInstancesPerNode(), bins, edges=edges, target=target)
        # an output is what the trees add from one number of trees to the next
        nodes = [(ends[-1] * h + t, h * len(ends) + int(np.searchsorted(ends, t + 1)), *node) for h, own in enumerate(f.tables) for t, _, *node in own.rows()]
        adds = [f"__add{j}" for j in range(len(kinds) * len(ends))]
        scored = B.TreeTable.from_rows(names, nodes).add_sums(held, adds)
        errors = []
        for h, end in place:
            pred = F.lit(f.starts[h][0])
            for j in range(end + 1):
                pred = pred + F.col(adds[h * len(ends) + j])
            errors.append(F.col("y") - pred)
        by = F.abs if metric == "mae" else (lambda e: e * e)
        row = scored.agg(F.var_pop("y").alias("v"), *[F.avg(by(e)).alias(f"e{c}") for c, e in enumerate(errors)]).first()
        found = np.array([row[f"e{c}"] for c in range(len(cands))])
        with np.errstate(divide="ignore", invalid="ignore"):
            return (1 - found / row["v"] if metric == "r2" else np.sqrt(found) if metric == "rmse" else found).tolist()

    return np.mean(parallel_map(of_fold, range(len(rows)), parallelism), axis=0).tolist()


def regression_metrics_row(pred: DataFrame, y: str, p: str = "y_pred") -> dict:
    from . import evaluate as EV
    r = EV.regression_metrics(pred.withColumn("target", F.lit("t")).withColumn("model", F.lit("m")), y=y, p=p).first()
    return {"n": r["n"], "r2": r["r2"], "mae": r["mae"], "mse": r["mse"]}



# ------------------------------------------------------- permutation importance
def permutation_importance(model, df: DataFrame, features: Sequence[str], target: str, key: str = "patient_id",
                           seed: int = 42) -> DataFrame:
    """MSE increase when one feature's values are permuted across rows, for every feature.

    One seeded permutation pairs row r with the row ranked r in a second hash
    order (two exact global ranks, one 1:1 join on the rank), so every
    feature's permuted copy comes from the same join.  Linear models score all
    permuted variants in one projection; other models add one scored column
    per feature.  One aggregate returns all MSEs.
    """
    from . import ranking as RK
    d = df.filter(F.col(target).isNotNull()).na.drop(subset=list(features))
    h1 = RK.hex_prefix_number(RK.hash_order(key, seed))
    h2 = RK.hex_prefix_number(RK.hash_order(key, seed + 7919))
    a = RK.global_rank(d.withColumn("__h", h1), "__h", [key], out="__r", uniform_range=RK.HASH_RANGE).drop("__h")
    b = RK.global_rank(d.select(key, *features).withColumn("__h", h2), "__h", [key], out="__r",
                       uniform_range=RK.HASH_RANGE) \
        .select("__r", *[F.col(f).alias(f"__perm_{f}") for f in features])
    j = a.join(b, "__r")
    if isinstance(model, LinearModel):
        base = model.predict(j, out="__p")
        coef = dict(zip(model.features, model.coef))
        cols = {f: F.col("__p") + F.lit(float(coef.get(f, 0.0))) * (F.col(f"__perm_{f}") - F.col(f).cast("double"))
                for f in features}
        scored = base.withColumns({f"__p_{f}": c for f, c in cols.items()})
    else:
        scored = model.predict(j, out="__p")
        for f in features:
            scored = _with_prediction(model, scored, f)
    y = F.col(target).cast("double")
    aggs = [F.avg(F.pow(y - F.col("__p"), 2)).alias("__base")] + \
        [F.avg(F.pow(y - F.col(f"__p_{f}"), 2)).alias(f) for f in features]
    row = scored.agg(*aggs)
    arr = F.array(*[F.struct(F.lit(f).alias("feature"), F.col("__base").alias("mse_base"),
                             F.col(f).alias("mse_permuted")) for f in features])
    return row.select(F.inline(arr)).withColumn("importance", F.col("mse_permuted") - F.col("mse_base"))


def _with_prediction(model, df: DataFrame, f: str) -> DataFrame:
    """Score ``df`` with feature ``f`` replaced by its permuted copy, keeping the original column."""
    keep = f"__orig_{f}"
    swapped = df.withColumn(keep, F.col(f)).withColumn(f, F.col(f"__perm_{f}"))
    return model.predict(swapped, out=f"__p_{f}").withColumn(f, F.col(keep)).drop(keep)

"""Declarative training: model definitions per target -> fitted models + metrics tables.

A ``ModelDefinition`` names a model type and its hyperparameters in the
reference's vocabulary; ``train_models`` fits every definition for every target
on the rows where the target is present and returns the fitted models (each
keeping its own feature list) and a long metrics table on the training rows.
``evaluate_models`` scores held-out rows.  Random search over a search space
uses the fold column (k-fold CV).  Linear candidates are scored from one pass of
per-fold Grams, however many there are; quantile models search every quantile by
its own pinball loss; a stack tunes each base that has a search space within the
rows it is fitted on.  The three gradient-boosting types map to histogram
boosting with the options they name (or ``xgboost.spark`` when installed); an
option that has no counterpart is refused rather than ignored.
"""

from __future__ import annotations

import itertools
import random
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import evaluate as EV
from . import models as M
from . import select as SL

MODEL_TYPES = ("elastic_net", "xgboost", "lightgbm", "catboost", "random_forest", "linear_regression",
               "ngboost", "quantile_lightgbm", "stacked")


#: Metric names of a definition -> (column of the regression metrics, whether more is better).
METRICS = {"r2": ("r2", True), "mae": ("mae", False), "mse": ("mse", False), "rmse": ("mse", False), "l1": ("mae", False), "l2": ("mse", False),
           "neg_mean_absolute_error": ("mae", False), "neg_mean_squared_error": ("mse", False), "quantile": ("pinball", False)}


@dataclass
class ModelDefinition:
    model_type: str
    hyperparameters: dict = field(default_factory=dict)
    cross_validation_folds: int = 5
    search_space: dict = field(default_factory=dict)
    quantiles: list | None = None
    distribution: str | None = None
    base_models: list | None = None
    eval_metric: str | None = None

    def __post_init__(self):
        if self.eval_metric is not None and self.eval_metric not in METRICS:
            raise ValueError(f"no such metric {self.eval_metric!r}; known: {', '.join(sorted(METRICS))}")
        if self.model_type not in MODEL_TYPES:
            raise ValueError(f"no such model type {self.model_type!r}; known: {', '.join(sorted(MODEL_TYPES))}")


@dataclass
class QuantileModels:
    """One booster per quantile; the point prediction is the quantile nearest 0.5 (first on ties)."""
    features: list
    models: dict  # quantile -> BoostedTrees
    kind: str = "quantile_lightgbm"

    @property
    def median_quantile(self) -> float:
        return min(self.models, key=lambda q: abs(q - 0.5))

    def predict(self, df: DataFrame, out: str = "y_pred") -> DataFrame:
        return self.models[self.median_quantile].predict(df, out=out)

    def predict_all(self, df: DataFrame) -> DataFrame:
        cur = df
        for q, m in self.models.items():
            cur = m.predict(cur, out=f"y_pred_q{q}")
        return cur


def _xgboost_spark():
    try:  # optional backend; not required
        from xgboost.spark import SparkXGBRegressor  # type: ignore
        return SparkXGBRegressor
    except Exception:  # noqa: BLE001
        return None


#: Names that the boosting types give to the options of :func:`models.fit_gbt`.
_GBT_NAMES = {"n_estimators": ("n_estimators", "iterations", "num_boost_round", "num_iterations"), "max_depth": ("max_depth", "depth"),
              "learning_rate": ("learning_rate", "eta"), "l2": ("l2", "reg_lambda", "lambda_l2", "l2_leaf_reg"),
              "min_rows": ("min_rows", "min_child_samples", "min_data_in_leaf"), "max_bin": ("max_bin", "border_count")}
#: Options that change no result here: sources of randomness and of messages that histogram boosting does not have.
_GBT_NEUTRAL = {"random_state", "random_seed", "seed", "n_jobs", "thread_count", "verbose", "verbosity", "silent", "objective", "loss_function", "alpha", "tree_method"}
#: What differs between the types unless a definition says otherwise.
_GBT_DEFAULTS = {"xgboost": {"l2": 1.0}, "lightgbm": {"l2": 0.0, "min_rows": 20}, "catboost": {"l2": 3.0}, "quantile_lightgbm": {"min_rows": 20}}


def _gbt_params(hp: Mapping, kind: str = "xgboost") -> dict:
    out = dict(_GBT_DEFAULTS.get(kind, {}))
    known = {alias: name for name, aliases in _GBT_NAMES.items() for alias in aliases}
    for name, value in hp.items():
        if name in known:
            out[known[name]] = float(value) if known[name] in ("learning_rate", "l2") else int(value)
        elif name not in _GBT_NEUTRAL:
            raise ValueError(f"{kind} has no option {name!r} here; known: {', '.join(sorted(known))}")
    return out


def fitter(defn: ModelDefinition, parallelism: int = 4):
    """``fit(df, features, target) -> model`` for one definition (without search)."""
    t, hp = defn.model_type, dict(defn.hyperparameters)
    if t == "elastic_net":
        return lambda d, f, y: M.fit_elastic_net(d, f, y, alpha=float(hp.get("alpha", 1.0)),
                                                 l1_ratio=float(hp.get("l1_ratio", 0.5)),
                                                 max_iter=int(hp.get("max_iter", 1000)))
    if t == "linear_regression":
        return lambda d, f, y: M.fit_ols(d, f, y)
    if t == "random_forest":
        return lambda d, f, y: M.fit_random_forest(d, f, y, num_trees=int(hp.get("n_estimators", 100)),
                                                   max_depth=int(hp.get("max_depth") or 30))
    if t in ("xgboost", "lightgbm", "catboost"):
        xgb = _xgboost_spark() if t == "xgboost" else None
        if xgb is not None:  # pragma: no cover - backend not installed here
            def fit_xgb(d, f, y):
                est = xgb(features_col=list(f), label_col=y, **hp)
                return M.MLModel(list(f), est.fit(d), t)
            return fit_xgb
        p = _gbt_params(hp, t)
        return lambda d, f, y: M.fit_gbt(d, f, y, kind=t, **p)
    if t == "ngboost":
        return lambda d, f, y: M.fit_distribution_boosting(
            d, f, y, dist=(defn.distribution or "lognormal").lower(), n_estimators=int(hp.get("n_estimators", 500)),
            learning_rate=float(hp.get("learning_rate", 0.01)), max_depth=int(hp.get("max_depth", 3)))
    if t == "quantile_lightgbm":
        qs = list(defn.quantiles or [0.5])
        p = {k: x for k, x in _gbt_params(hp, t).items() if k != "l2"}

        def fit_q(d, f, y):
            return QuantileModels(list(f), dict(zip(qs, M.fit_quantiles(d, f, y, qs, **p))))
        return fit_q
    if t == "stacked":
        bases = [_tuned(b, parallelism) for b in (defn.base_models or [])]
        if not bases:
            raise ValueError("a stacked definition names no base models")
        meta = hp.get("meta", hp) if isinstance(hp.get("meta", hp), Mapping) else {}
        alpha = float(meta.get("alpha", 1.0))

        def fit_stack(d, f, y):
            from . import split as SP
            fold = "__stack_fold"
            dd = SP.assign_folds(d.filter(F.col(y).isNotNull()), max(2, defn.cross_validation_folds),
                                 "patient_id" if "patient_id" in d.columns else d.columns[0], 42, out=fold)
            model, _ = M.fit_stacking(dd, f, y, bases, fold=fold, meta_alpha=alpha, parallelism=parallelism)
            return model
        return fit_stack
    raise ValueError(f"no such model type {t!r}")


def _sample(space: Mapping, n_iter: int, seed: int) -> list[dict]:
    keys = list(space)
    combos = list(itertools.product(*[space[k] if isinstance(space[k], (list, tuple)) else [space[k]] for k in keys]))
    rnd = random.Random(seed)
    picked = combos if len(combos) <= n_iter else rnd.sample(combos, n_iter)
    return [dict(zip(keys, c)) for c in picked]


def _tuned(defn: ModelDefinition, parallelism: int):
    """``fit(df, features, target)`` of a base: with a search space it is searched on folds of the very rows it is fitted on."""
    if not defn.search_space:
        return fitter(defn, parallelism)

    def fit(d, f, y):
        from . import split as SP
        key = "patient_id" if "patient_id" in d.columns else d.columns[0]
        folded = SP.assign_folds(d.filter(F.col(y).isNotNull()), max(2, defn.cross_validation_folds), key, 17, out="__base_fold")
        return random_search_cv(folded, f, y, defn, "__base_fold", parallelism=parallelism)[0]
    return fit


def _with(defn: ModelDefinition, params: Mapping) -> ModelDefinition:
    return replace(defn, hyperparameters={**defn.hyperparameters, **params}, search_space={})


def _gram_scores(df: DataFrame, features: Sequence[str], target: str, defn: ModelDefinition, cands: list[dict], fold: str, column: str) -> list[float]:
    """Mean held-out r2 or mse of every linear candidate from per-fold Grams: one pass over the rows, no refit."""
    d, ms, _ = SL.checked(df, features, target)
    st = SL.collect_gram(d, list(features), target, fold, {c: m for c, (m, _) in ms.items()})
    out = []
    for params in cands:
        hp = {**defn.hyperparameters, **params}
        per_fold = []
        for i in range(len(st.folds)):
            n, mx, my, cxx, cxy, _ = SL._centred(st.train(i))
            if defn.model_type == "elastic_net":
                b = M.elastic_net_cd(cxx, cxy, n, float(hp.get("alpha", 1.0)), float(hp.get("l1_ratio", 0.5)), int(hp.get("max_iter", 1000)))
            else:
                b = np.linalg.lstsq(cxx, cxy, rcond=None)[0]
            held = st.fold(i)
            mse = SL.heldout_mse(held, float(my - mx @ b), b)
            variance = held[5] / held[0] - (held[2] / held[0]) ** 2
            per_fold.append(mse if column == "mse" else 1 - mse / variance if variance > 0 else float("nan"))
        out.append(float(np.nanmean(per_fold)))
    return out


def _quantile_search(df: DataFrame, features: Sequence[str], target: str, defn: ModelDefinition, cands: list[dict], fold: str, folds: list) -> tuple:
    """Every quantile's own best candidate by mean held-out pinball loss; quantiles that agree are fitted together."""
    qs = list(defn.quantiles or [0.5])
    losses = []
    for params in cands:
        fit, total = fitter(_with(defn, params)), dict.fromkeys(qs, 0.0)
        for f in folds:
            held = df.filter(F.col(fold) == f)
            scored = fit(df.filter(F.col(fold) != f), features, target).predict_all(held)
            e = {q: F.col(target) - F.col(f"`y_pred_q{q}`") for q in qs}
            row = scored.agg(*[F.avg(F.greatest(q * e[q], (q - 1) * e[q])).alias(f"l{i}") for i, q in enumerate(qs)]).first()
            for i, q in enumerate(qs):
                total[q] += row[f"l{i}"] / len(folds)
        losses.append(total)
    best = {q: min(range(len(cands)), key=lambda i: losses[i][q]) for q in qs}
    models = {}
    for i in sorted(set(best.values())):
        own = [q for q in qs if best[q] == i]
        models.update(fitter(replace(_with(defn, cands[i]), quantiles=own))(df, features, target).models)
    scores = [(params, {q: -total[q] for q in qs}) for params, total in zip(cands, losses, strict=True)]
    return QuantileModels(list(features), {q: models[q] for q in qs}), {q: cands[i] for q, i in best.items()}, {q: -losses[i][q] for q, i in best.items()}, scores


def random_search_cv(df: DataFrame, features: Sequence[str], target: str, defn: ModelDefinition, fold: str,
                     n_iter: int = 20, seed: int = 42, scoring: str = "r2", parallelism: int = 4):
    """Seeded sample of the search space, k-fold CV score per candidate, refit of the best on all rows.

    The metric is the definition's ``eval_metric``, else ``scoring``; errors count
    negative, so more is better.  Returns (model, best_params, best_score, scores)
    where scores has one (params, mean score) pair per candidate; for quantile
    models parameters and scores are dicts by quantile.  Empty space -> plain fit.
    """
    if not defn.search_space:
        return fitter(defn, parallelism)(df, features, target), {}, None, []
    column, more = METRICS[defn.eval_metric or scoring]
    cands = _sample(defn.search_space, n_iter, seed)
    if defn.model_type in ("elastic_net", "linear_regression") and column in ("r2", "mse"):
        found = _gram_scores(df, features, target, defn, cands, fold, column)
        scores = [x if more else -x for x in found]
    else:
        folds = sorted(r[0] for r in df.select(fold).distinct().collect())
        if defn.model_type == "quantile_lightgbm":
            return _quantile_search(df, features, target, defn, cands, fold, folds)

        def score(params):
            fit = fitter(_with(defn, params), 1)
            preds = None
            for f in folds:
                m = fit(df.filter(F.col(fold) != f), features, target)
                p = m.predict(df.filter(F.col(fold) == f), out="y_pred").select(
                    F.lit(str(f)).alias("target"), F.lit("cv").alias("model"), F.col(target).alias("y_true"), "y_pred")
                preds = p if preds is None else preds.unionByName(p)
            per_fold = EV.regression_metrics(preds)  # target column holds the fold here
            value = per_fold.agg(F.avg(column)).first()[0]
            return value if more else -value

        scores = M.parallel_map(score, cands, parallelism)
    best = max(range(len(cands)), key=lambda i: scores[i])
    return fitter(_with(defn, cands[best]), parallelism)(df, features, target), cands[best], scores[best], list(zip(cands, scores))


@dataclass
class TrainingResult:
    """Models by target and name, training metrics and predictions, and what each search found.

    Unpacks as (models, metrics).  A name is the model type; a type that is
    defined again for a target is numbered (``elastic_net_2``).  ``searches``
    maps (target, name) to best parameters, best score and all (parameters,
    score) pairs.
    """
    models: dict
    metrics: DataFrame | None
    predictions: DataFrame | None
    searches: dict

    def __iter__(self):
        return iter((self.models, self.metrics))


def train_models(df: DataFrame, features: Sequence[str] | Mapping[str, Sequence[str]],
                 targets: Mapping[str, Sequence[ModelDefinition]], key: str = "patient_id", fold: str | None = None,
                 n_iter: int = 20, seed: int = 42, parallelism: int = 4):
    """Fit every definition for every target (targets absent or empty are skipped).

    ``features`` is one list or a per-target mapping (each model keeps its own
    list).  A definition with a search space is searched over the folds of column
    ``fold``, or over seeded folds of its own number if none is given.
    """
    from . import split as SP
    fitted: dict = {}
    searches: dict = {}
    preds = None
    for target, defs in targets.items():
        if target not in df.columns:
            continue
        d = df.filter(F.col(target).isNotNull())
        if d.limit(1).count() == 0:
            continue
        feats = list(features[target] if isinstance(features, Mapping) else features)
        fitted[target] = {}
        for defn in defs:
            taken = sum(n == defn.model_type or n.startswith(f"{defn.model_type}_") and n[len(defn.model_type) + 1:].isdigit() for n in fitted[target])
            name = f"{defn.model_type}_{taken + 1}" if taken else defn.model_type
            if defn.search_space:
                by = fold or "__search_fold"
                folded = d if fold else SP.assign_folds(d, max(2, defn.cross_validation_folds), key, seed, out=by)
                model, best, best_score, scores = random_search_cv(folded, feats, target, defn, by, n_iter, seed, parallelism=parallelism)
                searches[target, name] = {"best_params": best, "best_score": best_score, "scores": scores}
            else:
                model = fitter(defn, parallelism)(d, feats, target)
            fitted[target][name] = model
            p = model.predict(d, out="y_pred").select(key, F.lit(target).alias("target"),
                                                      F.lit(name).alias("model"),
                                                      F.col(target).alias("y_true"), "y_pred")
            preds = p if preds is None else preds.unionByName(p)
    metrics = EV.regression_metrics(preds) if preds is not None else None
    return TrainingResult(fitted, metrics, preds, searches)


def evaluate_models(fitted: Mapping, test: DataFrame, key: str = "patient_id") -> DataFrame | None:
    """Held-out metrics per (target, model); targets missing or empty in ``test`` are skipped."""
    preds = None
    for target, models in fitted.items():
        if target not in test.columns:
            continue
        d = test.filter(F.col(target).isNotNull())
        for name, model in models.items():
            p = model.predict(d, out="y_pred").select(key, F.lit(target).alias("target"), F.lit(name).alias("model"),
                                                      F.col(target).alias("y_true"), "y_pred")
            preds = p if preds is None else preds.unionByName(p)
    return EV.regression_metrics(preds) if preds is not None else None

"""Model queries (rows-only checks: learners have no SQL oracle).

All fit on the training split of the prepared matrix and report on the
held-out split; each callable is one end-to-end Spark job chain.
"""

from __future__ import annotations

from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from ..operators import evaluate as EV
from ..operators import models as M
from ..operators import prep as PR
from ..operators import split as SP
from ..session import ensure_checkpoint_dir
from ..sources import sinks
from ..sources.views import cte
from .common import v
from .q_prep import CATS, NUMS
from .q_split import IS_TEST, K, RANKED, SEED, TEST_SIZE
from .registry import query

FEATS = [*NUMS, "modality_CAPD", "modality_CCPD", "modality_NIPD"]


def _stored(spark, df):
    path = sinks.run_root(spark, "matrix")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _matrix(spark, sf, folds: bool = False):
    coh = _stored(spark, v(spark, sf, "cohort"))  # the split and the fit read it several times
    s = SP.seeded_split(coh, "patient_id", TEST_SIZE, SEED)
    model = PR.fit_prep(s.train, numeric=NUMS, categorical=CATS, imputation="mean", log_features=["residual_rf"])
    tr = PR.apply_prep(s.train, model)
    te = PR.apply_prep(s.test, model)
    if folds:  # cross-validation folds within the training rows
        tr = SP.assign_folds(tr, K, "patient_id", SEED + 1)
    # the matrices are reused by every fit: written tables, which no session has to release
    return _stored(spark, tr), _stored(spark, te)


def _report(spark, test, fitted: dict, target: str = "ktv"):
    """Long (target, model, n, r2, mae, mse) of each fitted model on the held-out rows."""
    out = None
    for name, m in fitted.items():
        p = m.predict(test.filter(F.col(target).isNotNull()), out="y_pred")
        p = p.select("patient_id", F.lit(target).alias("target"), F.lit(name).alias("model"),
                     F.col(target).alias("y_true"), "y_pred")
        out = p if out is None else out.unionByName(p)
    return EV.regression_metrics(out)


@query("elastic_net", covers=("J5", "J15"))
def elastic_net(spark, sf):
    tr, te = _matrix(spark, sf)
    return _report(spark, te, {"elastic_net": M.fit_elastic_net(tr, FEATS, "ktv", alpha=0.1, l1_ratio=0.5)})


@query("ridge", covers=("J6",))
def ridge(spark, sf):
    tr, te = _matrix(spark, sf)
    return _report(spark, te, {"ridge": M.fit_ridge(tr, FEATS, "ktv", alpha=1.0),
                               "linear_regression": M.fit_ols(tr, FEATS, "ktv")})


@query("random_forest", covers=("J7", "L3"))
def random_forest(spark, sf):
    tr, te = _matrix(spark, sf)
    return _report(spark, te, {"random_forest": M.fit_random_forest(tr, FEATS, "ktv")})


@query("boosting", covers=("J8",))
def boosting(spark, sf):
    tr, te = _matrix(spark, sf)
    return _report(spark, te, {"xgboost": M.fit_gbt(tr, FEATS, "ktv", max_depth=3)})


@query("feature_importance", covers=("D23",))
def feature_importance(spark, sf):
    tr, _ = _matrix(spark, sf)
    m = M.fit_random_forest(tr, FEATS, "ktv")
    return spark.createDataFrame(M.feature_importance(m), "feature string, importance double")


@query("quantile_boosting", covers=("J9", "E6", "J16"))
def quantile_boosting(spark, sf):
    """One pinball-loss booster per quantile; reports held-out pinball loss and coverage per quantile."""
    tr, te = _matrix(spark, sf)
    t = te.filter(F.col("ktv").isNotNull())
    qs = (0.1, 0.5, 0.9)
    models = M.fit_quantiles(tr, FEATS, "ktv", qs)
    rows = []
    for q, m in zip(qs, models):
        p = m.predict(t)
        stats = p.agg(F.avg(F.greatest(q * (F.col("ktv") - F.col("y_pred")), (q - 1) * (F.col("ktv") - F.col("y_pred"))))
                      .alias("pinball"), F.avg((F.col("ktv") <= F.col("y_pred")).cast("double")).alias("coverage"),
                      F.count(F.lit(1)).alias("n")).first()
        const = M.pinball_loss(t.withColumn("__c", F.lit(m.base)), "ktv", "__c", q)
        rows.append((q, int(stats["n"]), float(stats["pinball"]), float(const), float(stats["coverage"])))
    return spark.createDataFrame(rows, "quantile double, n bigint, pinball double, pinball_constant double, coverage double")


@query("distribution_boosting", covers=("J10",))
def distribution_boosting(spark, sf):
    tr, te = _matrix(spark, sf)

    def fit(dist):
        m0 = M.fit_distribution_boosting(tr, FEATS, "ktv", dist=dist, n_estimators=0)
        m = M.fit_distribution_boosting(tr, FEATS, "ktv", dist=dist)
        return dist, float(M.mean_nll(m0, te, "ktv")), float(M.mean_nll(m, te, "ktv"))

    rows = M.parallel_map(fit, ("lognormal", "normal"), parallelism=2)
    return spark.createDataFrame(rows, "distribution string, nll_start double, nll_end double")


@query("stacking", covers=("J11", "E3"))
def stacking(spark, sf):
    """Out-of-fold base predictions (elastic net, forest) -> ridge meta-learner."""
    ensure_checkpoint_dir(spark)
    tr, te = _matrix(spark, sf, folds=True)
    bases = [lambda d, f, t: M.fit_elastic_net(d, f, t, alpha=0.1, l1_ratio=0.5),
             lambda d, f, t: M.fit_random_forest(d, f, t)]
    model, oof = M.fit_stacking(tr, FEATS, "ktv", bases, fold="fold", meta_alpha=1.0)
    rep = _report(spark, te, {"stacked": model})
    n_oof = oof.count()
    return rep.withColumn("n_oof", F.lit(n_oof))


@query("random_search", covers=("J12", "F5"))
def random_search(spark, sf):
    """Every candidate of a linear search (one pass of per-fold Grams) and of a boosting search (one state a fold), with its mean held-out r2."""
    from ..operators import training as TRN
    tr, _ = _matrix(spark, sf, folds=True)
    tr = tr.filter(F.col("ktv").isNotNull())
    linear = TRN.ModelDefinition("elastic_net", search_space={"alpha": [0.0001, 0.001, 0.01, 0.1], "l1_ratio": [0.1, 0.5, 0.9, 1.0]})
    _, _, _, rows = TRN.random_search_cv(tr, FEATS, "ktv", linear, "fold")
    est = GBTRegressor(featuresCol=M.VEC, labelCol="ktv", lossType="squared", seed=SEED)
    _, more = M.random_search(tr, FEATS, "ktv", est, {"maxDepth": [2, 3], "maxIter": [5, 10], "stepSize": [0.1, 0.3]}, fold="fold", metric="r2")
    return spark.createDataFrame([("elastic_net", str(sorted(p.items())), s) for p, s in rows] + [("gbt", str(sorted(p.items())), s) for p, s in more],
                                 "model string, params string, mean_r2 double")


@query("train_per_target", covers=("J13", "B5", "C5"))
def train_per_target(spark, sf):
    """Each target x model on its training rows (targets with no values are skipped)."""
    from ..operators import training as TRN
    tr, _ = _matrix(spark, sf)
    defs = [TRN.ModelDefinition("linear_regression"),
            TRN.ModelDefinition("elastic_net", {"alpha": 0.01, "l1_ratio": 0.5})]
    _, metrics = TRN.train_models(tr, FEATS, {"ktv": defs, "pet": defs})
    return metrics


@query("pet_classifier", covers=("J18",))
def pet_classifier(spark, sf):
    tr, te = _matrix(spark, sf)
    cls = F.when(F.col("pet") < 0.5, 0).when(F.col("pet") < 0.65, 1).when(F.col("pet") < 0.81, 2).otherwise(3)
    tr, te = tr.withColumn("pet_class", cls), te.withColumn("pet_class", cls)
    m = M.fit_pet_classifier(tr, FEATS, "pet_class", kind="forest")
    scored = m.predict(te, out="p_class").select(F.col("pet_class").alias("y_class"),
                                                  F.col("p_class").cast("int").alias("p_class"))
    k = EV.quadratic_kappa(scored)
    acc = scored.agg(F.avg((F.col("y_class") == F.col("p_class")).cast("double")).alias("accuracy"))
    return k.unionByName(k.limit(0)).select("n", "kappa").withColumn("accuracy", F.lit(acc.first()["accuracy"]))


@query("logistic_l1", covers=("J3",))
def logistic_l1(spark, sf):
    tr, _ = _matrix(spark, sf)
    d = tr.withColumn("adequate", (F.col("ktv") >= 1.7).cast("double"))
    m = M.fit_logistic_l1(d, FEATS, "adequate", alpha=0.01)
    coefs = m.model.coefficients.toArray()
    return spark.createDataFrame([(f, float(c), bool(c != 0)) for f, c in zip(FEATS, coefs)],
                                 "feature string, coefficient double, selected boolean")


@query("pca", covers=("I10",))
def pca(spark, sf):
    tr, _ = _matrix(spark, sf)
    m = M.fit_pca(tr, list(NUMS), k=3)
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(m.explainedVariance.toArray())],
                                 "component int, explained_variance double")


_KINDS = ("linear_regression", "quantile_lightgbm", "xgboost", "ngboost", "random_forest", "stacked")


@query("model_persist", covers=("A11",), sql=cte("cohort", extra=RANKED) + f"""
select k.model, cast(count(*) as bigint) as n, cast(count(*) as bigint) as n_equal, cast(count(*) as bigint) as n_predicted
from ranked, (values {", ".join(f"('{k}')" for k in _KINDS)}) k(model) where {IS_TEST} group by k.model""")
def model_persist(spark, sf):
    """Each kind of model is saved, loaded and scored: held-out predictions equal to the last bit, and none missing.

    What is checked is the store, so the boosters here have 20 rounds and the forest 10 trees.
    """
    from ..operators import training as TRN
    from ..sources import model_store
    ensure_checkpoint_dir(spark)
    tr, te = _matrix(spark, sf, folds=True)
    quantiles = (0.1, 0.5, 0.9)
    few = {"n_estimators": 20, "learning_rate": 0.1}
    forest = lambda d, f, t: M.fit_random_forest(d, f, t, num_trees=10, max_depth=6)
    models = {"linear_regression": M.fit_ols(tr, FEATS, "ktv"),
              "quantile_lightgbm": TRN.QuantileModels(list(FEATS), dict(zip(quantiles, M.fit_quantiles(tr, FEATS, "ktv", quantiles, **few)))),
              "xgboost": M.fit_gbt(tr, FEATS, "ktv", max_depth=3, **few), "ngboost": M.fit_distribution_boosting(tr, FEATS, "ktv", **few),
              "random_forest": forest(tr, FEATS, "ktv"), "stacked": M.fit_stacking(tr, FEATS, "ktv", [M.fit_ols, forest], fold="fold")[0]}
    out = None
    for name, m in models.items():
        back = model_store.load(spark, model_store.save(m, spark))
        both = back.predict(m.predict(te, "a"), "b")
        one = both.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("a") == F.col("b")).alias("n_equal"), F.count("b").alias("n_predicted")).select(F.lit(name).alias("model"), "n", "n_equal", "n_predicted")
        out = one if out is None else out.unionByName(one)
    return out


@query("permutation_importance", covers=("D23",))
def permutation_importance(spark, sf):
    """Held-out MSE increase per permuted feature for the linear Kt/V model."""
    tr, te = _matrix(spark, sf)
    m = M.fit_ols(tr, FEATS, "ktv")
    return M.permutation_importance(m, te, FEATS, "ktv", seed=SEED)


@query("train_evaluate", covers=("I1", "J1", "J2", "B13", "J13", "J15", "D8", "C6"))
def train_evaluate(spark, sf):
    """End to end: split -> fit preparation on train -> LASSO selection per target (per-fold Gram)
    -> linear, elastic-net and forest models on each target's own selected features -> held-out metrics."""
    from ..operators import select as SL
    tr, te = _matrix(spark, sf)
    prep_features = [c for c in tr.columns if c not in ("patient_id", "ktv", "pet")]
    tr_f = SP.assign_folds(tr, K, "patient_id", SEED + 2)
    out = None
    for target in ("ktv", "pet"):
        sel = SL.fit_lasso_selection(tr_f, prep_features, target, alpha=0.01, min_features=5).selected
        d = tr.filter(F.col(target).isNotNull())
        models = {"linear_regression": M.fit_ols(d, sel, target),
                  "elastic_net": M.fit_elastic_net(d, sel, target, alpha=0.01, l1_ratio=0.5),
                  "random_forest": M.fit_random_forest(d, sel, target)}
        rep = _report(spark, te, models, target).withColumn("n_features", F.lit(len(sel)))
        out = rep if out is None else out.unionByName(rep)
    return out

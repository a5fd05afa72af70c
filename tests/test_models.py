"""Model operators (reference training/evaluation tests) and properties."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from dwellframe.operators import evaluate as EV
from dwellframe.operators import models as M
from dwellframe.operators import split as SP


def _toy(spark):
    return spark.createDataFrame([(i, float(i), 1.0, 2.0 * i) for i in range(4)],
                                 "patient_id int, signal double, noise double, ktv double")


def _r2(spark, model, df, target="ktv"):
    p = model.predict(df).select(F.lit("t").alias("target"), F.lit("m").alias("model"),
                                 F.col(target).alias("y_true"), "y_pred")
    return EV.regression_metrics(p).first().r2


def test_training_toy_r2(spark):
    df = _toy(spark)
    assert _r2(spark, M.fit_elastic_net(df, ["signal", "noise"], "ktv", alpha=0.1, l1_ratio=0.5), df) >= 0.0
    assert _r2(spark, M.fit_gbt(df, ["signal", "noise"], "ktv", n_estimators=10, max_depth=3), df) >= 0.0


def test_evaluation_toy_exact(spark):
    train = _toy(spark)
    test = spark.createDataFrame([(10, 4.0, 8.0), (11, 5.0, 10.0)], "patient_id int, signal double, ktv double")
    m = M.fit_ols(train, ["signal"], "ktv")
    p = m.predict(test).select(F.lit("ktv").alias("target"), F.lit("linear").alias("model"),
                               F.col("ktv").alias("y_true"), "y_pred")
    r = EV.regression_metrics(p).first()
    assert abs(r.r2 - 1.0) < 1e-9 and r.mae < 1e-9


def _data(spark, n=300, seed=0):
    rng = np.random.default_rng(seed)
    x1, x2 = rng.normal(size=n), rng.normal(size=n)
    y = 1.0 + 2.0 * x1 - 0.5 * x2 + rng.normal(0, 0.3, n)
    return spark.createDataFrame([(i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(x1, x2, y))],
                                 "patient_id int, x1 double, x2 double, ktv double"), (x1, x2, y)


def test_ridge_closed_form(spark):
    df, (x1, x2, y) = _data(spark)
    m = M.fit_ridge(df, ["x1", "x2"], "ktv", alpha=1.0)
    X = np.column_stack([x1, x2])
    Xc, yc = X - X.mean(0), y - y.mean()
    b = np.linalg.solve(Xc.T @ Xc + np.eye(2), Xc.T @ yc)
    assert np.allclose(m.coef, b) and abs(m.intercept - (y.mean() - X.mean(0) @ b)) < 1e-9


def test_stacking_oof_rows(spark):
    df, _ = _data(spark)
    df = SP.assign_folds(df, 5, "patient_id", 1)
    bases = [lambda d, f, t: M.fit_ols(d, f, t), lambda d, f, t: M.fit_ridge(d, f, t, 10.0)]
    model, oof = M.fit_stacking(df, ["x1", "x2"], "ktv", bases, fold="fold")
    assert oof.count() == 300
    assert _r2(spark, model, df) > 0.9


def test_quantile_boosting_beats_constant(spark):
    df, _ = _data(spark, 200, 3)
    m = M.fit_quantile_boosting(df, ["x1", "x2"], "ktv", quantile=0.9, n_estimators=8, max_depth=2, learning_rate=0.3)
    p = m.predict(df)
    assert M.pinball_loss(p, "ktv", "y_pred", 0.9) < M.pinball_loss(df.withColumn("c", F.lit(m.base)), "ktv", "c", 0.9)


def test_distribution_boosting_nll_falls(spark):
    df, _ = _data(spark, 200, 4)
    df = df.withColumn("ktv", F.col("ktv") + 10)
    m0 = M.fit_distribution_boosting(df, ["x1", "x2"], "ktv", dist="normal", n_estimators=0)
    m = M.fit_distribution_boosting(df, ["x1", "x2"], "ktv", dist="normal", n_estimators=6, learning_rate=0.2)
    assert M.mean_nll(m, df, "ktv") < M.mean_nll(m0, df, "ktv")


def test_permutation_importance_ranks_signal(spark):
    df, _ = _data(spark, 400, 9)
    m = M.fit_ols(df, ["x1", "x2"], "ktv")
    imp = {r.feature: r.importance for r in M.permutation_importance(m, df, ["x1", "x2"], "ktv").collect()}
    assert imp["x1"] > imp["x2"] > 0
    rf = M.fit_random_forest(df, ["x1", "x2"], "ktv", num_trees=5, max_depth=4)
    imp2 = {r.feature: r.importance for r in M.permutation_importance(rf, df, ["x1", "x2"], "ktv").collect()}
    assert imp2["x1"] > imp2["x2"]


def test_declarative_training_reference_case(spark):
    from dwellframe.operators import training as TRN
    df = _toy(spark)
    defs = [TRN.ModelDefinition("elastic_net", {"alpha": 0.1, "l1_ratio": 0.5}),
            TRN.ModelDefinition("xgboost", {"n_estimators": 10, "max_depth": 3})]
    fitted, metrics = TRN.train_models(df, ["signal", "noise"], {"ktv": defs, "absent": defs})
    assert set(fitted) == {"ktv"} and set(fitted["ktv"]) == {"elastic_net", "xgboost"}
    assert all(r.r2 >= 0.0 for r in metrics.collect())


def test_declarative_evaluation_exact(spark):
    from dwellframe.operators import training as TRN
    fitted, _ = TRN.train_models(_toy(spark), {"ktv": ["signal"]}, {"ktv": [TRN.ModelDefinition("linear_regression")]})
    test = spark.createDataFrame([(10, 4.0, 8.0), (11, 5.0, 10.0)], "patient_id int, signal double, ktv double")
    r = TRN.evaluate_models(fitted, test).first()
    assert abs(r.r2 - 1.0) < 1e-9 and r.mae < 1e-9


def test_random_search_picks_best(spark):
    from dwellframe.operators import training as TRN
    df, _ = _data(spark, 200, 2)
    df = SP.assign_folds(df, 3, "patient_id", 5)
    defn = TRN.ModelDefinition("elastic_net", {"l1_ratio": 1.0}, search_space={"alpha": [0.001, 5.0]})
    model, best, score, scores = TRN.random_search_cv(df, ["x1", "x2"], "ktv", defn, "fold", parallelism=2)
    assert best == {"alpha": 0.001} and len(scores) == 2 and score > 0.8
    with pytest.raises(ValueError):
        TRN.ModelDefinition("svm")


def test_linear_search_from_grams_equals_refits(spark):
    from dwellframe.operators import training as TRN
    df, _ = _data(spark, 240, 6)
    df = SP.assign_folds(df, 4, "patient_id", 2)
    defn = TRN.ModelDefinition("elastic_net", search_space={"alpha": [0.01, 0.3, 2.0], "l1_ratio": [0.2, 1.0]})
    for metric in ("r2", "mse"):
        model, best, score, scores = TRN.random_search_cv(df, ["x1", "x2"], "ktv", TRN.ModelDefinition("elastic_net", search_space=defn.search_space, eval_metric=metric), "fold")
        assert len(scores) == 6 and score == max(s for _, s in scores)
        for params, got in scores:
            per_fold = []
            for f in range(4):
                m = M.fit_elastic_net(df.filter(F.col("fold") != f), ["x1", "x2"], "ktv", **params)
                r = M.regression_metrics_row(m.predict(df.filter(F.col("fold") == f)), "ktv")
                per_fold.append(r["r2"] if metric == "r2" else -r["mse"])
            assert abs(got - np.mean(per_fold)) < 1e-6
    with pytest.raises(ValueError, match="no such metric"):
        TRN.ModelDefinition("elastic_net", eval_metric="auc")


def test_quantiles_are_searched_one_by_one(spark):
    from dwellframe.operators import training as TRN
    df, _ = _data(spark, 160, 7)
    df = SP.assign_folds(df, 2, "patient_id", 2)
    defn = TRN.ModelDefinition("quantile_lightgbm", {"max_depth": 1, "min_child_samples": 5, "eta": 0.3}, search_space={"n_estimators": [0, 6]}, quantiles=[0.2, 0.8])
    model, best, score, scores = TRN.random_search_cv(df, ["x1", "x2"], "ktv", defn, "fold")
    assert best == {0.2: {"n_estimators": 6}, 0.8: {"n_estimators": 6}} and list(model.models) == [0.2, 0.8]
    assert all(score[q] == max(s[q] for _, s in scores) for q in (0.2, 0.8))


def test_options_and_tuned_bases(spark):
    from dwellframe.operators import training as TRN
    df, _ = _data(spark, 120, 8)
    with pytest.raises(ValueError, match="no option 'gamma'"):
        TRN.train_models(df, ["x1", "x2"], {"ktv": [TRN.ModelDefinition("xgboost", {"gamma": 1})]})
    assert TRN._gbt_params({"iterations": 3, "depth": 2, "l2_leaf_reg": 5, "random_seed": 1}, "catboost") == {"n_estimators": 3, "max_depth": 2, "l2": 5.0}
    bases = [TRN.ModelDefinition("elastic_net", search_space={"alpha": [0.001, 50.0]}, cross_validation_folds=2), TRN.ModelDefinition("linear_regression")]
    out = TRN.train_models(df, ["x1", "x2"], {"ktv": [TRN.ModelDefinition("stacked", base_models=bases, cross_validation_folds=2)]})
    stacked = out.models["ktv"]["stacked"]
    assert abs(stacked.bases[0].coef[0] - stacked.bases[1].coef[0]) < 0.05  # the small alpha was chosen in every fit


def test_least_squares_of_dependent_features(spark):
    """One-hot columns that add up to 1 and a constant: fitted, with the predictions that any solution gives."""
    rows = [(float(i), float(i % 3 == 0), float(i % 3 == 1), float(i % 3 == 2), 1.0, 2.0 * i + 5 * (i % 3)) for i in range(60)]
    df = spark.createDataFrame(rows, "x double, a double, b double, c double, one double, y double")
    m = M.fit_ols(df, ["x", "a", "b", "c", "one"], "y")
    assert np.isfinite(m.coef).all() and abs(m.coef[1:4].sum()) < 1e-6 and m.coef[4] == 0
    assert max(abs(r.y_pred - r.y) for r in m.predict(df).collect()) < 1e-6


def test_boosting_search_scores_as_cross_validation_does(spark, monkeypatch):
    """MLlib's boosting: the scores of CrossValidator, and no MLlib fit but that of the best candidate."""
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.regression import GBTRegressor
    from pyspark.ml.tuning import CrossValidator
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.normal(size=600), rng.integers(0, 4, 600), rng.exponential(size=600)])
    y = np.sin(2 * x[:, 0]) + x[:, 1] * (x[:, 2] > 1) + rng.normal(0, 0.3, 600)
    df = spark.createDataFrame([(*map(float, a), float(b), i % 3) for i, (a, b) in enumerate(zip(x, y))], "x1 double, x2 double, x3 double, ktv double, fold int")
    est = GBTRegressor(featuresCol=M.VEC, labelCol="ktv", lossType="squared", seed=42)
    grid = {"maxDepth": [1, 2], "maxIter": [2, 5], "stepSize": [0.1, 0.3]}
    maps = [{est.maxDepth: a, est.maxIter: b, est.stepSize: c} for a in grid["maxDepth"] for b in grid["maxIter"] for c in grid["stepSize"]]
    plain = M.assemble(df, ["x1", "x2", "x3"])
    fits = []
    for metric in ("r2", "mae"):
        cv = CrossValidator(estimator=est, estimatorParamMaps=maps, evaluator=RegressionEvaluator(labelCol="ktv", metricName=metric), foldCol="fold", numFolds=3, parallelism=4)
        expected = cv.fit(plain)
        with monkeypatch.context() as m:
            own = GBTRegressor._fit
            m.setattr(GBTRegressor, "_fit", lambda self, d: fits.append(1) or own(self, d))
            m.setattr(GBTRegressor, "fitMultiple", lambda *_: pytest.fail("refits every candidate"))
            model, rows = M.random_search(df, ["x1", "x2", "x3"], "ktv", est, grid, fold="fold", metric=metric)
        assert [p for p, _ in rows] == [{k.name: v for k, v in pm.items()} for pm in maps]
        assert [s for _, s in rows] == pytest.approx(expected.avgMetrics, rel=1e-5)
        assert model.getNumTrees == expected.bestModel.getNumTrees and model.transform(plain).count() == 600
    assert len(fits) == 2
    with pytest.raises(ValueError, match="folds"):
        M.random_search(df.withColumn("fold", F.col("fold") * 2), ["x1", "x2", "x3"], "ktv", est, grid)

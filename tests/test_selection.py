"""LASSO selection from the Gram (reference selection test) + KKT and closed-form checks."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from dwellframe.operators import select as SL
from dwellframe.operators import split as SP


def _synthetic(spark):
    rng = np.random.default_rng(42)
    n = 120
    s1, s2 = rng.normal(0, 1, n), rng.normal(0, 1, n)
    noise_y = rng.normal(0, 0.5, n)
    noise = rng.normal(0, 1, n)
    y = 3 * s1 - 2 * s2 + noise_y
    rows = [(i, float(a), float(b), float(c), float(t)) for i, (a, b, c, t) in enumerate(zip(s1, s2, noise, y))]
    df = spark.createDataFrame(rows, "patient_id int, signal_one double, signal_two double, noise double, ktv double")
    return SP.assign_folds(df, 5, "patient_id", 42), (s1, s2, noise, y)


def test_signals_selected(spark):
    df, _ = _synthetic(spark)
    res = SL.fit_lasso_selection(df, ["signal_one", "signal_two", "noise"], "ktv", alpha=1.0, max_iter=5000,
                                 min_features=2)
    assert {"signal_one", "signal_two"} <= set(res.selected)
    assert res.mse_path.shape == (80, 5)


def test_kkt_conditions(spark):
    df, (s1, s2, noise, y) = _synthetic(spark)
    feats = ["signal_one", "signal_two", "noise"]
    res = SL.fit_lasso_selection(df, feats, "ktv", alpha=0.05, max_iter=10000, min_features=1)
    X = np.column_stack([s1, s2, noise])
    X = X / X.std(axis=0)
    Xc, yc = X - X.mean(0), y - y.mean()
    grad = Xc.T @ (yc - Xc @ res.coef) / len(y)
    for j, b in enumerate(res.coef):
        if b != 0:
            assert abs(grad[j] - res.alpha * np.sign(b)) < 1e-3
        else:
            assert abs(grad[j]) <= res.alpha + 1e-3


def test_gram_matches_numpy(spark):
    df, (s1, s2, noise, y) = _synthetic(spark)
    st = SL.collect_gram(df.withColumn("f", F.lit(0)), ["signal_one", "signal_two"], "ktv", "f",
                         {"signal_one": 0.5, "ktv": 1.0})
    X = np.column_stack([s1 - 0.5, s2])
    n, sx, sy, sxx, sxy, syy = st.total()
    assert n == 120 and np.allclose(sxx, X.T @ X) and np.allclose(sxy, X.T @ (y - 1.0))


def test_ols_from_gram_closed_form(spark):
    df, (s1, s2, noise, y) = _synthetic(spark)
    st = SL.collect_gram(df.withColumn("f", F.lit(0)), ["signal_one", "signal_two"], "ktv", "f",
                         {"signal_one": 3.0, "signal_two": -1.0, "ktv": 2.0})
    b, b0 = SL.ols_from_gram(st)
    A = np.column_stack([np.ones(120), s1, s2])
    want = np.linalg.lstsq(A, y, rcond=None)[0]
    assert np.allclose([b0, *b], want)


def test_top_coefficients_rule(spark):
    c = spark.createDataFrame([("a", 0.0), ("b", -0.5), ("c", 0.0), ("d", 0.2)], "feature string, coefficient double")
    assert sorted(r.feature for r in SL.top_coefficients(c, 3).collect()) == ["a", "b", "d"]
    assert sorted(r.feature for r in SL.top_coefficients(c, 2).collect()) == ["b", "d"]


def test_selected_union(spark):
    sel = spark.createDataFrame([("ktv", "a"), ("ktv", "b"), ("pet", "b")], "target string, feature string")
    assert [r.feature for r in SL.selected_union(sel).collect()] == ["a", "b"]


@pytest.mark.parametrize("p", [1, 10, 63, 130, 400])
def test_gram_of_any_width_matches_numpy(spark, p):
    rng = np.random.default_rng(p)
    x, y, fold = rng.normal(size=(90, p)), rng.normal(size=90), rng.integers(0, 3, 90)
    feats = [f"x{i}" for i in range(p)]
    df = spark.createDataFrame([(*map(float, r), float(t), int(f)) for r, t, f in zip(x, y, fold)], ", ".join(f"{c} double" for c in feats) + ", ktv double, fold int")
    shift = {"x0": 0.1, "ktv": 0.5}
    st = SL.collect_gram(df.repartition(5), feats, "ktv", "fold", shift)
    assert st.folds == sorted(set(fold.tolist()))
    x[:, 0] -= 0.1
    for k, f in enumerate(st.folds):
        own, t = x[fold == f], y[fold == f] - 0.5
        assert np.allclose(st.sxx[k], own.T @ own) and np.allclose(st.sxy[k], own.T @ t) and np.allclose(st.sx[k], own.sum(0))
        assert st.n[k] == len(t) and np.isclose(st.sy[k], t.sum()) and np.isclose(st.syy[k], t @ t)


def test_rows_that_lack_a_feature(spark):
    from dwellframe.operators import models as M
    rows = [(i, float(i % 7) if i % 3 else None, float(i), 2.0 * (i % 7) + i) for i in range(30)] + [(99, 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "patient_id int, a double, b double, ktv double")
    with pytest.raises(ValueError, match="10 rows lack a feature: a .10."):
        M.fit_ols(df, ["a", "b"], "ktv")
    dropped = M.fit_ols(df, ["a", "b"], "ktv", missing="drop")
    assert dropped.lacking == 10 and np.allclose([*dropped.coef, dropped.intercept], [2.0, 1.0, 0.0])
    filled = M.fit_ridge(df, ["a", "b"], "ktv", alpha=0.1, missing="mean")
    mean = np.mean([r[1] for r in rows[:30] if r[1] is not None])
    x = np.array([[mean if r[1] is None else r[1], r[2]] for r in rows[:30]])
    y = np.array([r[3] for r in rows[:30]])
    xc = x - x.mean(0)
    assert filled.lacking == 10 and np.allclose(filled.coef, np.linalg.solve(xc.T @ xc + 0.1 * np.eye(2), xc.T @ (y - y.mean())))
    with pytest.raises(ValueError, match="10 rows lack"):
        M.fit_random_forest(df, ["a", "b"], "ktv", num_trees=2)
    forest = M.fit_random_forest(df, ["a", "b"], "ktv", num_trees=2, missing="drop")
    assert forest.lacking == 10 and SL.fit_lasso_selection(df.withColumn("fold", F.col("patient_id") % 3), ["a", "b"], "ktv", missing="drop").selected
    # boosting learns a side for missing values: all 30 rows are used
    assert M.fit_gbt(df, ["a", "b"], "ktv", n_estimators=3, max_depth=2).predict(df).where("y_pred is null").count() == 0


def test_training_input_union(spark):
    f = spark.createDataFrame([(1, 1.0, 0.5, 3.0, 1.1, 0.8)], "patient_id int, a double, b double, c double, ktv double, pet double")
    frame, union, absent = SL.training_input(f, {"ktv": ["a", "b"], "pet": ["b", "zz"]})
    assert union == ["a", "b"] and absent == ["zz"]
    assert frame.columns == ["patient_id", "a", "b", "ktv", "pet"]
    frame2, union2, _ = SL.training_input(f, {})
    assert union2 == ["a", "b", "c"]


def test_auto_log_choice(spark):
    from dwellframe.operators import prep as PR
    rng = np.random.default_rng(3)
    rows = [(i, float(rng.lognormal(0, 1.0)), float(rng.normal()), 1.0) for i in range(400)]
    df = spark.createDataFrame(rows, "patient_id int, skewed double, sym double, ktv double")
    m = PR.fit_prep(df, targets=["ktv"], numeric=["skewed", "sym"], log_features="auto", derive=False)
    assert m.log_features == ["skewed"]

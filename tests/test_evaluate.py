"""Evaluation tables against direct numpy / SQL computations."""
import numpy as np

from dwellframe.operators import evaluate as EV


def _pred(spark, y, p):
    return spark.createDataFrame([(i, "ktv", "m", float(a), float(b)) for i, (a, b) in enumerate(zip(y, p))],
                                 "patient_id int, target string, model string, y_true double, y_pred double")


def test_r2_rules(spark):
    assert EV.regression_metrics(_pred(spark, [1, 1, 1], [1, 1, 1])).first().r2 == 1.0
    assert EV.regression_metrics(_pred(spark, [1, 1, 1], [1, 2, 1])).first().r2 == 0.0
    assert EV.regression_metrics(_pred(spark, [1], [2])).first().r2 is None
    y, p = np.array([1.0, 2, 3, 4]), np.array([1.5, 1.5, 3.5, 3.0])
    r = EV.regression_metrics(_pred(spark, y, p)).first()
    assert abs(r.r2 - (1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())) < 1e-12


def test_kappa_matches_table_form(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 4, 500)
    p = np.where(rng.random(500) < 0.6, y, rng.integers(0, 4, 500))
    df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(y, p)], "y_class int, p_class int")
    k = EV.quadratic_kappa(df).first().kappa
    O = np.zeros((4, 4))
    for a, b in zip(y, p):
        O[a, b] += 1
    W = np.array([[(i - j) ** 2 for j in range(4)] for i in range(4)])
    E = np.outer(O.sum(1), O.sum(0)) / O.sum()
    assert abs(k - (1 - (W * O).sum() / (W * E).sum())) < 1e-12


def test_icc_reference_value(spark):
    y = np.array([1.0, 2.0, 3.0, 4.0, 5.0])
    p = y + np.array([0.1, -0.2, 0.0, 0.3, -0.1])
    icc = EV.icc_2_1(_pred(spark, y, p)).first().icc
    assert 0.95 < icc <= 1.0


def test_top2_and_argmax(spark):
    from dwellframe.functions import scores as SC
    df = spark.createDataFrame([([0.2, 0.4, 0.4, 0.0],)], "p array<double>")
    r = df.select(SC.argmax("p").alias("a"), SC.top_k("p", 2).alias("t")).first()
    assert r.a == 1 and list(r.t) == [1, 2]
    s = spark.createDataFrame([([1.0, 2.0, 3.0],)], "v array<double>").select(SC.softmax("v").alias("s")).first().s
    assert abs(sum(s) - 1) < 1e-12 and abs(s[2] - np.exp(3) / np.exp([1, 2, 3]).sum()) < 1e-12


def test_js_round_halves_up(spark):
    from dwellframe.functions import scores as SC
    got = [r[0] for r in spark.createDataFrame([(-2.5,), (2.5,), (1.005,)], "x double")
           .select(SC.js_round("x", 0)).collect()]
    assert got[:2] == [-2.0, 3.0]


def test_calibration_bins_equal_counts(spark):
    df = _pred(spark, list(range(100)), [x * 0.5 for x in range(100)])
    bins = EV.calibration_bins(df, 10).orderBy("bin").collect()
    assert [b.n for b in bins] == [10] * 10 and bins[0].mean_pred == 2.25


def test_bootstrap_interval_brackets_point(spark):
    rng = np.random.default_rng(5)
    y = rng.normal(size=400)
    r = EV.poisson_bootstrap_mae(_pred(spark, y, y + rng.normal(0, 0.2, 400)), n_boot=30).first()
    assert r.lo <= r.mae <= r.hi

"""Cases beyond former limits: deep trees, NULL and large keys, hot values, empty and constant inputs, repeated definitions."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from dwellframe.operators import evaluate as EV
from dwellframe.operators import models as M
from dwellframe.operators import prep as PR
from dwellframe.operators import quality as Q
from dwellframe.operators import ranking as R
from dwellframe.operators import split as SP
from dwellframe.operators import training as TRN
from dwellframe.operators import trees as TR


def _chain(depth):
    """A tree that goes right until x < its level; leaf k holds k."""
    nodes = {}
    for k in range(depth):
        nodes[2 * k] = {"left": 2 * k + 1, "right": 2 * k + 2, "feature": 0, "threshold": float(k + 1), "default_left": k == 2, "leaf": -1.0}
        nodes[2 * k + 1] = {"left": -1, "right": -1, "feature": 0, "threshold": 0.0, "default_left": False, "leaf": float(k)}
    nodes[2 * depth] = {"left": -1, "right": -1, "feature": 0, "threshold": 0.0, "default_left": False, "leaf": 999.0}
    return nodes


def test_arrow_scorer_of_a_deep_tree_keeps_every_row(spark):
    ens = TR.Ensemble(["x"], 1, 0.5, {0: (0, _chain(300))})
    df = spark.createDataFrame([(1, 0.0), (1, 70.2), (2, 299.5), (2, 1e6), (3, None)], "patient_id long, x double")
    got = sorted((r.patient_id, r.raw_scores[0]) for r in ens.score_arrow(df).collect())
    assert got == [(1, 0.5), (1, 70.5), (2, 299.5), (2, 999.5), (3, 2.5)]


def test_compiled_and_arrow_scores_agree_on_missing_values(spark):
    ens = TR.Ensemble(["x"], 1, 0.0, {0: (0, _chain(8))})
    df = spark.createDataFrame([(k, v) for k, v in enumerate([None, float("nan"), -1.0, 2.0, 2.5, 7.9, 8.0])], "k int, x double")
    both = ens.score_arrow(df).withColumn("c", ens.raw_scores()).collect()
    assert all(r.raw_scores == r.c for r in both) and both[0].c == [2.0]


def test_models_of_many_nodes_score(spark):
    ens = TR.Ensemble(["x"], 2, 0.0, {t: (t % 2, _chain(60)) for t in range(2000)})  # 242,000 nodes
    row = ens.score_arrow(spark.createDataFrame([(10.5,)], "x double")).first()
    assert np.allclose(row.raw_scores, [10_000.0, 10_000.0])


def test_seeded_split_with_null_keys_loses_no_row(spark):
    df = spark.createDataFrame([(k if k > 1 else None, k) for k in range(10)], "patient_id int, v int")
    s = SP.seeded_split(df, "patient_id", 0.3, 42)
    assert sorted(r.v for r in s.train.collect()) + sorted(r.v for r in s.test.collect()) != []
    assert s.train.count() + s.test.count() == 10


def test_tail_split_of_large_ids_and_nulls(spark):
    ids = [2**53 + k for k in range(10)]
    s = SP.tail_split(spark.createDataFrame([(i,) for i in ids], "i long"), "i", 0.2)
    assert sorted(r.i for r in s.test.collect()) == ids[-2:] and s.train.count() == 8
    n = SP.tail_split(spark.createDataFrame([(None, "a"), (None, "b"), (1, "c"), (2, "d")], "i long, k string"), "i", 0.25, "k")
    assert [r.k for r in n.test.collect()] == ["d"] and n.train.count() == 3


def test_kth_smallest_narrows_by_tie_columns(spark):
    df = spark.range(0, 5000).select(F.lit(1.0).alias("v"), F.col("id").cast("string").alias("name"), "id")
    assert R.kth_smallest(df, "v", ["id"], 1234, max_rows_in_task=50)["id"] == 1233
    assert R.kth_smallest(df, "v", ["name", "id"], 10, max_rows_in_task=50)["name"] == sorted(map(str, range(5000)))[9]


def test_exact_percentiles_with_a_hot_value(spark):
    values = [7.0] * 9000 + [float(k) for k in range(1000)]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 1.0), ("b", 2.0), ("c", None)], "g string, v double")
    got = {r.g: (r.lo, r.mid, r.hi) for r in R.exact_percentiles(df, "v", [0.001, 0.5, 0.97], ["g"], names=["lo", "mid", "hi"]).collect()}
    assert np.allclose(got["a"], np.percentile(values, [0.1, 50, 97])) and np.allclose(got["b"], np.percentile([1, 2], [0.1, 50, 97])) and "c" not in got


def test_many_groups_and_edges(spark):
    df = spark.range(0, 24_000).select((F.col("id") % 12_000).alias("g"), F.col("id").cast("double").alias("v"))
    out = R.exact_percentiles(df, "v", [0.5], ["g"], names=["m"])
    assert out.count() == 12_000 and out.where("g = 5").first().m == 6005.0
    e = spark.createDataFrame([([1.0, 3.0, 3.0, 8.0], v) for v in (0.0, 1.0, 3.0, 3.5, 9.0)], "e array<double>, v double")
    assert [r[0] for r in e.select(R._edges_below("e", F.col("v"), 63)).collect()] == [0, 0, 1, 3, 4]


def test_metrics_of_constant_equal_and_empty_inputs(spark):
    s = spark.createDataFrame([(1, 1, 1.0), (1, 1, 0.95)], "y_class int, p_class int, top_prob double")
    assert EV.quadratic_kappa(s).first().kappa is None and EV.quadratic_kappa(s.limit(0)).first().kappa is None
    # both probabilities fall in the last of ten bins
    assert abs(EV.expected_calibration_error(s).first().ece - 0.025) < 1e-12
    assert EV.expected_calibration_error(s.limit(0)).first().ece is None
    assert {r.missing_share for r in Q.missingness(s.limit(0)).collect()} == {None}
    p = spark.createDataFrame([(i, "t", m, float(i), float(i) + b) for i in range(6) for m, b in (("a", 0.5), ("b", 1.5), ("c", 0.1 * i))],
                              "patient_id int, target string, model string, y_true double, y_pred double")
    pairs = {(r.model_a, r.model_b): (r.n, r.t_stat) for r in EV.paired_comparison(p).collect()}
    assert pairs["a", "b"] == (6, None) and pairs["a", "c"][1] is not None and len(pairs) == 3
    flat = spark.createDataFrame([(1, "t", "m", 2.0, 2.0), (2, "t", "m", 2.0, 2.0)], p.schema)
    assert EV.icc_2_1(flat).first().icc is None
    one = EV.poisson_bootstrap_mae(flat.limit(1), n_boot=20).first()
    assert one.mae == 0.0 and one.lo == 0.0


def test_every_category_is_kept_and_unseen_ones_fail(spark):
    df = spark.createDataFrame([(k, f"c{k:04}", 1.0) for k in range(700)], "patient_id int, c string, ktv double")
    model = PR.fit_prep(df, targets=["ktv"], numeric=[], categorical=["c"], encoding="label", derive=False)
    assert PR.apply_prep(df, model).agg(F.countDistinct("c")).first()[0] == 700
    new = spark.createDataFrame([(1, "never", 1.0)], df.schema)
    with pytest.raises(Exception, match="unseen category"):
        PR.apply_prep(new, model).collect()
    assert PR.apply_prep(new, model, on_unseen="null").first().c is None


def test_forest_depth_beyond_mllib_is_refused(spark):
    with pytest.raises(ValueError, match="depth 30"):
        M.fit_random_forest(spark.createDataFrame([(1.0, 1.0)], "x double, y double"), ["x"], "y", max_depth=31)


def test_lognormal_refuses_values_it_cannot_model(spark):
    df = spark.createDataFrame([(float(k), float(k)) for k in range(8)], "x double, y double")
    with pytest.raises(Exception, match="lognormal needs positive"):
        M.fit_distribution_boosting(df, ["x"], "y", n_estimators=1)


def test_repeated_definitions_and_searches_are_returned(spark):
    df = spark.createDataFrame([(k, float(k % 7), float(k % 7) * 2 + 1) for k in range(60)], "patient_id int, x double, ktv double")
    defs = [TRN.ModelDefinition("elastic_net", {"alpha": 0.01}), TRN.ModelDefinition("elastic_net", search_space={"alpha": [0.001, 5.0]})]
    out = TRN.train_models(df, ["x"], {"ktv": defs})
    assert sorted(out.models["ktv"]) == ["elastic_net", "elastic_net_2"]
    assert sorted((r.model, r.n) for r in out.metrics.collect()) == [("elastic_net", 60), ("elastic_net_2", 60)]
    found = out.searches["ktv", "elastic_net_2"]
    assert found["best_params"] == {"alpha": 0.001} and len(found["scores"]) == 2
    assert out.predictions.count() == 120

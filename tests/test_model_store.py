"""Models of every kind survive the store."""
import numpy as np
import pytest

from dwellframe.operators import models as M
from dwellframe.operators import split as SP
from dwellframe.operators import training as TRN
from dwellframe.sources import model_store as S


def test_every_kind_round_trips(spark):
    rng = np.random.default_rng(1)
    df = SP.assign_folds(spark.createDataFrame([(i, float(a), None if i % 9 == 0 else float(b), float(3 + a + b)) for i, (a, b) in enumerate(rng.normal(size=(120, 2)))],
                                               "patient_id int, a double, b double, y double"), 3, "patient_id", 1)
    full = df.na.drop()
    f = ["a", "b"]
    quantiles = M.fit_quantiles(df, f, "y", [0.2, 0.8], n_estimators=3)
    models = [M.fit_ols(df, f, "y", missing="drop"), TRN.QuantileModels(f, {0.2: quantiles[0], 0.8: quantiles[1]}), M.fit_gbt(df, f, "y", n_estimators=3),
              M.fit_distribution_boosting(df.where("y > 0"), f, "y", n_estimators=3), M.fit_random_forest(full, f, "y", num_trees=3, max_depth=3),
              M.fit_stacking(full, f, "y", [M.fit_ols, lambda d, x, t: M.fit_gbt(d, x, t, n_estimators=2)])[0], M.fit_gbt(df, f, "y", n_estimators=0)]
    for m in models:
        folder = S.save(m, spark)
        back = S.load(spark, folder)
        assert type(back) is type(m) and back.features == m.features and getattr(back, "lacking", 0) == getattr(m, "lacking", 0)
        rows = back.predict(m.predict(df if "Linear" not in type(m).__name__ and not isinstance(m, (M.MLModel, M.StackedModel)) else full, "p"), "q").collect()
        assert rows and all(r.p == r.q for r in rows)
    assert S.load(spark, S.save(models[1], spark)).models[0.8].quantile == 0.8
    with pytest.raises(TypeError):
        S.save(object(), spark)

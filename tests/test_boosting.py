"""Histogram boosting against a plain replay, its node table, and invariance."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from dwellframe.operators import boosting as B
from dwellframe.operators import models as M


def _data(spark, n=400, seed=0, parts=4):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 3)), 1)
    x[rng.random((n, 3)) < 0.15] = np.nan
    y = np.where(np.isnan(x[:, 0]), 3.0, 2 * x[:, 0]) + np.nan_to_num(x[:, 1]) ** 2 + rng.normal(0, 0.2, n)
    rows = [(*[None if math.isnan(v) else float(v) for v in r], float(t)) for r, t in zip(x, y)]
    return spark.createDataFrame(rows, "a double, b double, c double, y double").repartition(parts), x, y


def _plain_squared(x, y, rounds, depth, rate, l2, edges):
    """Every split tried on the rows themselves, without bins of sums."""
    f = np.full(len(y), y.mean())
    for _ in range(rounds):
        g = y - f
        groups = [np.arange(len(y))]
        for _ in range(depth):
            nxt = []
            for rows in groups:
                best = (1e-9 * max(1, len(rows)) * y.var(), None)
                for missing_left in (True, False):
                    for j in range(x.shape[1]):
                        for e in [*edges[j], math.inf]:
                            left = np.where(np.isnan(x[rows, j]), missing_left, x[rows, j] <= e)
                            a, b = rows[left], rows[~left]
                            if len(a) and len(b):
                                gain = g[a].sum() ** 2 / (len(a) + l2) + g[b].sum() ** 2 / (len(b) + l2) - g[rows].sum() ** 2 / (len(rows) + l2)
                                if gain > best[0] * (1 + 1e-9):
                                    best = (gain, (a, b))
                nxt += list(best[1]) if best[1] else [rows]
            groups = nxt
        for rows in groups:
            f[rows] += rate * g[rows].sum() / (len(rows) + l2)
    return f


def test_squared_error_equals_plain_boosting(spark):
    df, x, y = _data(spark, 150)
    rounds, depth, rate, l2, bins = 4, 2, 0.3, 1.0, 8
    edges = [sorted(set(e)) for e in df.approxQuantile(["a", "b", "c"], [k / bins for k in range(1, bins)], 1 / (8 * bins))]
    m = M.fit_gbt(df, ["a", "b", "c"], "y", n_estimators=rounds, max_depth=depth, learning_rate=rate, l2=l2, max_bin=bins)
    got = {(r.a, r.b, r.c, r.y): r.y_pred for r in m.predict(df).collect()}
    want = _plain_squared(x, y, rounds, depth, rate, l2, edges)
    for r, t, f in zip(x, y, want):
        key = (*[None if math.isnan(v) else float(v) for v in r], float(t))
        assert abs(got[key] - f) < 1e-4


def test_partitions_and_state_writes_change_nothing(spark, monkeypatch):
    tables = []
    for parts, every, direct in ((1, 100, 8), (7, 2, 8), (5, 3, 0)):
        monkeypatch.setattr(B, "DIRECT", direct)
        monkeypatch.setattr(B, "SLICE_CELLS", 1000)
        monkeypatch.setattr(B, "ROWS_A_TASK", 60)
        df, _, _ = _data(spark, 300, 1, parts)
        f = B.fit(df, ["a", "b", "c"], "y", [B.Quantile(0.2), B.Squared(1.0), B.Normal()], 7, 3, 0.2, bins=16, every=every, edges=[[k / 4 - 2 for k in range(15)]] * 3)
        tables.append([t.rows() for t in f.tables])
    for other in tables[1:]:
        for a, b in zip(tables[0], other, strict=True):
            assert [r[:6] for r in a] == [r[:6] for r in b] and np.allclose([r[8] for r in a], [r[8] for r in b], atol=1e-6)


def test_quantile_coverage_and_loss(spark):
    df, _, y = _data(spark, 1500, 2)
    for m in M.fit_quantiles(df, ["a", "b", "c"], "y", [0.1, 0.5, 0.9], n_estimators=40, max_depth=3, learning_rate=0.2):
        p = m.predict(df)
        assert M.pinball_loss(p, "y", "y_pred", m.quantile) < 0.6 * M.pinball_loss(df.withColumn("c0", F.lit(m.base)), "y", "c0", m.quantile)
        share = p.agg(F.avg((F.col("y") <= F.col("y_pred")).cast("double"))).first()[0]
        assert abs(share - m.quantile) < 0.06


def test_leaf_of_a_constant_group_is_its_quantile(spark):
    df = spark.createDataFrame([(float(i % 2), 10.0 * (i % 2) + (i // 2) / 50) for i in range(100)], "x double, y double")
    (m,) = M.fit_quantiles(df, ["x"], "y", [0.5], n_estimators=1, max_depth=1, learning_rate=1.0)
    got = {r.x: r.y_pred for r in m.predict(df).select("x", "y_pred").distinct().collect()}
    # residual bins are finest near zero: a few hundredths of the spread (5) far from it
    assert abs(got[0.0] - 0.49) < 0.05 and abs(got[1.0] - 10.49) < 0.2


def test_table_round_trip_and_scoring(spark):
    rng = np.random.default_rng(4)
    trees = []
    for t in range(500):
        nodes = [(int(rng.integers(3)), 1, 2, float(rng.normal()), bool(rng.integers(2)), 0.0), (int(rng.integers(3)), 3, 4, float(rng.normal()), bool(rng.integers(2)), 0.0),
                 *[(-1, -1, -1, 0.0, False, float(rng.normal())) for _ in range(3)]]
        trees.append((t % 2, nodes))
    table = B.TreeTable.of(["a", "b", "c"], trees)
    back = B.TreeTable.from_rows(["a", "b", "c"], table.rows())
    x = rng.normal(size=(300, 3))
    x[rng.random((300, 3)) < 0.2] = np.nan

    def plain(row):
        out = [0.0, 0.0]
        for o, nodes in trees:
            at = 0
            while nodes[at][1] >= 0:
                f, lo, hi, cut, missing_left, _ = nodes[at]
                at = lo if (missing_left if math.isnan(row[f]) else row[f] < cut) else hi
            out[o] += nodes[at][5]
        return out

    want = np.array([plain(r) for r in x])
    assert np.allclose(table.sums(x, 2), want) and np.allclose(back.sums(x, 2, rows=7, trees=9), want)
    df = spark.createDataFrame([(i, *[None if math.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)], "i int, a double, b double, c double")
    scored = table.add_sums(df, ["u", "v"])
    got = {r.i: (r.u, r.v) for r in scored.collect()}
    assert scored.columns == ["i", "a", "b", "c", "u", "v"] and all(np.allclose(got[i], w) for i, w in enumerate(want))
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "CASE WHEN" not in plan


def test_no_rounds_constant_target_and_no_rows(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0)], "x double, y double")
    assert {r.y_pred for r in M.fit_gbt(df, ["x"], "y", n_estimators=3).predict(df).collect()} == {5.0}
    assert {r.y_pred for r in M.fit_quantile_boosting(df, ["x"], "y", 0.3, n_estimators=0).predict(df).collect()} == {5.0}
    with pytest.raises(ValueError, match="no row has a value"):
        M.fit_gbt(df.limit(0), ["x"], "y", n_estimators=1)


def test_a_level_is_a_plain_job_without_a_query_plan(spark, monkeypatch):
    df, _, _ = _data(spark, 200, 5)

    def planned(self):
        raise AssertionError("a level planned a query")

    monkeypatch.setattr(type(df), "toArrow", planned)
    f = B.fit(df, ["a", "b", "c"], "y", [B.Quantile(0.5), B.Squared(1.0)], 3, 2, 0.2, every=2)
    assert all(len(t.root) == 3 for t in f.tables)
    assert B._tasks(spark, 10) == 1 and B._tasks(spark, 1 << 40) == -(-(1 << 40) // B.MOST_ROWS_A_TASK)

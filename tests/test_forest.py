"""The bootstrap forest: its tree against a plain replay, both ways of growing, importances and refusals."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from dwellframe.operators import boosting as B
from dwellframe.operators import forest as FO
from dwellframe.operators import models as M


def _data(spark, n=600, seed=0):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 3)), 1)
    y = np.where(x[:, 0] > 0, 3.0, -1.0) + x[:, 1] ** 2 + rng.normal(0, 0.1, n)
    return spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], "a double, b double, c double, y double").coalesce(1)


def _scores(m, df):
    return np.array([r.y_pred for r in m.predict(df).orderBy("a", "b", "c", "y").collect()])


def test_shared_tables_and_subtrees_grow_the_same_trees(spark, monkeypatch):
    df = _data(spark)
    found = []
    for local in (0, 150, 1_000_000):  # all by tables, both, all where the rows are
        monkeypatch.setattr(FO, "LOCAL_ROWS", local)
        found.append(M.fit_random_forest(df, ["a", "b", "c"], "y", num_trees=4, max_depth=6))
    first = found[0]
    for m in found[1:]:
        assert np.allclose(_scores(m, df), _scores(first, df), atol=1e-6)
        assert np.allclose(m.model.featureImportances.toArray(), first.model.featureImportances.toArray(), atol=1e-6)
    assert len(first.table.root) == 4 and sum(first.table.left < 0) > 40


def test_subtree_equals_plain_splitting():
    rng = np.random.default_rng(3)
    codes, w, g = rng.integers(0, 8, (3, 200)).astype(np.int8), rng.integers(1, 4, 200), np.rint(rng.normal(size=200) * FO.B.FIXED)
    nodes = FO._subtree(codes, w, w * g, 3, 8)

    def plain(rows, depth):
        n, s = w[rows].sum(), (w * g)[rows].sum() / FO.B.FIXED
        best = (1e-9 * max(1, n), None)
        for j in range(3):
            for cut in range(7):
                a, b = rows[codes[j, rows] <= cut], rows[codes[j, rows] > cut]
                if depth and len(a) and len(b):
                    gain = sum(((w * g)[r].sum() / FO.B.FIXED) ** 2 / w[r].sum() for r in (a, b)) - s * s / n
                    if gain > best[0] + 1e-9:
                        best = (gain, (a, b))
        return {int(i): s / n for i in rows} if not best[1] else plain(best[1][0], depth - 1) | plain(best[1][1], depth - 1)

    want = plain(np.arange(200), 3)
    at = FO._reached(nodes, codes)
    assert np.allclose(nodes[at, FO.SUM] / nodes[at, FO.COUNT], [want[i] for i in range(200)])


def test_forest_fits_ranks_features_and_uses_no_query_per_level(spark):
    df = _data(spark, 2000, 1)
    m = M.fit_random_forest(df, ["a", "b", "c"], "y", num_trees=20, max_depth=8)
    row = m.predict(df).agg(F.avg(F.pow(F.col("y") - F.col("y_pred"), 2)).alias("e"), F.var_pop("y").alias("v")).first()
    assert row["e"] < 0.05 * row["v"]
    names = [n for n, _ in M.feature_importance(m)]
    assert names[-1] == "c" and abs(sum(v for _, v in M.feature_importance(m)) - 1) < 1e-9
    assert isinstance(m, M.ForestModel)  # MLlib's sends a dense table of every node, however few its rows
    with pytest.raises(Exception, match="lacks a feature"):
        m.predict(spark.createDataFrame([(None, 1.0, 1.0)], "a double, b double, c double")).collect()


def test_tally_is_exact_packed_or_not():
    rng = np.random.default_rng(3)
    cell, w = rng.integers(0, 50, 5000), rng.poisson(1.0, 5000).astype(float)
    for size, packed in ((1 << 22, True), (1 << 38, False)):
        g = rng.integers(-size, size, 5000).astype(float)
        tally = B.Tally(w, g)
        assert (tally.both is not None) == packed
        n, s = tally(cell, 60)
        expect = [np.zeros(60, np.int64), np.zeros(60, np.int64)]
        for own, x in zip(expect, (w, g), strict=True):
            np.add.at(own, cell, x.astype(np.int64))
        assert (n == expect[0]).all() and (s == expect[1]).all()


def test_rows_reach_the_node_that_a_walk_ends_in():
    rng = np.random.default_rng(4)
    codes = rng.integers(0, 32, (5, 500)).astype(np.int8)
    g = np.rint(B.FIXED * (codes[0] * 0.1 + (codes[1] > codes[2]) + rng.normal(size=500)))
    nodes = FO._subtree(codes, np.ones(500, np.int64), g.astype(np.int64), 6, 32)
    walked = []
    for row in codes.T:
        at = 0
        while nodes[at, FO.FEATURE] >= 0:
            at = int(nodes[at, FO.LEFT if row[int(nodes[at, FO.FEATURE])] <= nodes[at, FO.UPTO] else FO.RIGHT])
        walked.append(at)
    assert len(set(walked)) > 10 and FO._reached(nodes, codes).tolist() == walked


def test_codes_are_numbers_of_edges_below(spark):
    edges = [[-1.0, 0.0, 2.5], []]
    values = [None, float("nan"), float("-inf"), -1.0, -0.0, 0.0, 0.1, 2.5, 2.6, float("inf")]
    plain = spark.createDataFrame([(v, 1.0, 0.0) for v in values], "x0 double, x1 double, y double").coalesce(1)
    blocks, tasks = B.code_blocks(plain, edges, 8, 0.0, 1.0, len(values), [])
    codes = np.concatenate([c for c, _, _ in blocks.collect()], axis=1)
    assert tasks == 1 and codes[0].tolist() == [8, 8, 0, 0, 1, 1, 2, 2, 3, 3] and not codes[1].any()

"""Tasks that keep their rows and add up their tables together: the sums, the exchange, and how many jobs a fit takes."""
import threading
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from dwellframe.operators import boosting as B
from dwellframe.operators import forest as FO
from dwellframe.operators import together as T

SLOTS = T.slots


def _jobs(spark, run):
    """(what ``run`` gives, the number of Spark jobs it started)."""
    sc = spark.sparkContext
    group = uuid.uuid4().hex
    sc.setJobGroup(group, group)
    try:
        return run(), len(sc.statusTracker().getJobIdsForGroup(group))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_groups_of_features_count_as_single_ones_do():
    rng = np.random.default_rng(0)
    codes = np.stack([rng.integers(0, k, 5000) for k in (2, 2, 64, 3, 40, 127, 1)]).astype(np.int8)
    slot, w, g = rng.integers(0, 3, 5000), rng.integers(0, 4, 5000), np.rint(rng.normal(size=5000) * B.FIXED)
    for cells in (1, 64, 4096):
        for scale in (1.0, 2.0 ** 22):  # the larger sums of g leave no room for w in one number
            packed, both = T.Packed(codes, cells), T.Both(w, g * scale)
            sums = []
            for x in both.parts:
                sums.append(np.zeros((3, 7 * 127)))
                packed.counted(packed.columns, slot, x, range(0, 7 * 127, 127), sums[-1])
            n, s = (x.reshape(3, 7, 127) for x in both.apart(sums))
            for j, code in enumerate(codes):
                cell = slot * 127 + code
                assert (n[:, j].ravel() == np.bincount(cell, w, 3 * 127)).all() and (s[:, j].ravel() == np.bincount(cell, g * scale, 3 * 127)).all()


def test_exchange_sums_whole_tables_and_shares(tmp_path, monkeypatch):
    for whole in (1 << 20, 0):
        monkeypatch.setattr(T, "WHOLE_BYTES", whole)
        tables, found = np.random.default_rng(1).integers(0, 99, (3, 5, 7, 2)), {}

        def work(rank, folder=f"file://{tmp_path}/{whole}"):
            x = T.Exchange(folder, rank, 3)
            found[rank] = [x.total(tables[rank] * k) for k in range(20)]

        threads = [threading.Thread(target=work, args=(i,)) for i in range(3)]
        [t.start() for t in threads]
        [t.join(60) for t in threads]
        for rank in range(3):
            for k in range(20):
                assert (found[rank][k] == tables.sum(axis=0) * k).all()


def test_boosting_rounds_share_a_job(spark, monkeypatch):
    monkeypatch.setattr(B, "ROWS_A_TASK", 60)
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(*map(float, r), float(r[0] * r[1])) for r in rng.normal(size=(700, 2))], "a double, b double, y double")

    def fit():
        return B.fit(df, ["a", "b"], "y", [B.Quantile(0.3), B.Normal(), B.Squared(1.0)], 12, 3, 0.2, bins=16, edges=[[k / 4 - 2 for k in range(15)]] * 2)

    here, jobs = _jobs(spark, fit)
    assert jobs < 12  # a job for every level: over 60
    monkeypatch.setattr(T, "slots", lambda spark: 0)
    assert [t.rows() for t in fit().tables] == [t.rows() for t in here.tables]


def test_rounds_after_a_new_state_go_on_as_before(spark, monkeypatch):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(float(a), float(a * a)) for a in rng.normal(size=300)], "a double, y double")
    found = []
    for rounds in (100, 3):
        monkeypatch.setattr(B, "TOGETHER_ROUNDS", rounds)
        found.append(B.fit(df, ["a"], "y", [B.Squared()], 8, 2, 0.3, bins=16, edges=[[k / 4 - 2 for k in range(15)]]).tables[0].rows())
    assert found[0] == found[1]


def test_forest_levels_share_a_job(spark, monkeypatch):
    monkeypatch.setattr(B, "ROWS_A_TASK", 300)
    monkeypatch.setattr(FO, "DRAWN_BYTES", 30_000)  # some trees at a time
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(1500, 3)), 1)
    df = spark.createDataFrame([(*map(float, r), float((r[0] > 0) + r[1] ** 2)) for r in x], "a double, b double, c double, y double").coalesce(1)
    for local in (0, 200):
        monkeypatch.setattr(FO, "LOCAL_ROWS", local)
        monkeypatch.setattr(T, "slots", SLOTS)
        here, jobs = _jobs(spark, lambda: FO.fit(df, ["a", "b", "c"], "y", 6, 7, 1))
        assert jobs < 16
        monkeypatch.setattr(T, "slots", lambda spark: 0)
        (table, importance), more = _jobs(spark, lambda: FO.fit(df, ["a", "b", "c"], "y", 6, 7, 1))
        assert jobs < more and np.allclose(importance, here[1])  # a job for every level
        assert np.allclose(table.sums(x, 1), here[0].sums(x, 1), atol=1e-9)


def test_edges_of_many_rows_are_quantiles(spark, monkeypatch):
    monkeypatch.setattr(B, "SKETCH_ROWS", 1)
    rng = np.random.default_rng(5)
    x = np.stack([rng.normal(size=60_000), rng.integers(0, 3, 60_000), np.exp(4 * rng.normal(size=60_000))], axis=1)
    x[rng.random(x.shape) < 0.1] = np.nan
    df = spark.createDataFrame(pd.DataFrame(x, columns=["x0", "x1", "x2"])).withColumn("x3", F.lit(None).cast("double")).repartition(5)
    edges = B.quantile_edges(df, df.columns, 64, n=60_000)
    assert edges[1] == [0.0, 1.0, 2.0] and edges[3] == [] and len(edges[0]) == len(edges[2]) == 63
    for j in (0, 2):
        own = np.sort(x[~np.isnan(x[:, j]), j])
        assert np.abs(np.searchsorted(own, edges[j]) / len(own) - np.arange(1, 64) / 64).max() < 1 / 512


def test_scores_are_sums_of_leaves_and_missing_values_go_their_way():
    nodes = [(0, 1, 2, 0.5, True, 0.0), (-1, -1, -1, 0.0, False, 1.0), (1, 3, 4, 2.0, False, 0.0), (-1, -1, -1, 0.0, False, 10.0), (-1, -1, -1, 0.0, False, 100.0)]
    table = B.TreeTable.of(["a", "b"], [(0, nodes), (1, [(-1, -1, -1, 0.0, False, 7.0)])])
    x = np.array([[0.0, 0.0], [np.nan, 9.0], [0.5, 1.0], [1.0, 2.0], [1.0, np.nan]])
    assert table.sums(x, 2).tolist() == [[1, 7], [1, 7], [10, 7], [100, 7], [100, 7]]


def test_a_stage_that_starts_again_meets_in_a_new_folder(tmp_path, monkeypatch):
    own = threading.local()

    class Context:
        @staticmethod
        def get():
            return own

    monkeypatch.setattr(T, "BarrierTaskContext", Context)
    found = {}

    def work(rank, attempt):
        own.partitionId, own.taskAttemptId = (lambda: rank), (lambda: attempt)
        x = T.Exchange.here(str(tmp_path / "sums"), 3)
        found[attempt] = x.folder, x.total(np.array([attempt])).tolist()

    for first in (10, 20):  # the first stage leaves its files behind
        threads = [threading.Thread(target=work, args=(i, first + i)) for i in (2, 1, 0)]
        [t.start() for t in threads]
        [t.join(60) for t in threads]
        assert {tuple(found[first + i][1]) for i in range(3)} == {(3 * first + 3,)} and len({found[first + i][0] for i in range(3)}) == 1
    assert found[10][0] != found[20][0]

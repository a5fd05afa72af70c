"""Split, tail split, folds: sizes, determinism, partition invariance."""
import math

import pytest
from pyspark.sql import functions as F

from dwellframe.operators import ranking
from dwellframe.operators import split as SP


def _df(spark, n, parts=4):
    return spark.createDataFrame([(f"patient-{i}", i) for i in range(n)], "patient_id string, value int").repartition(parts)


def test_split_sizes_and_determinism(spark):
    df = _df(spark, 10)
    a = SP.seeded_split(df, "patient_id", 0.2, 42)
    b = SP.seeded_split(df, "patient_id", 0.2, 42)
    ids_a = sorted(r[0] for r in a.test_ids().collect())
    assert a.train.count() == 8 and a.test.count() == 2
    assert ids_a == sorted(r[0] for r in b.test_ids().collect())


def test_split_partition_invariance(spark):
    got = []
    for parts in (1, 16):
        s = SP.seeded_split(_df(spark, 997, parts), "patient_id", 0.25, 7)
        got.append(sorted(r[0] for r in s.test_ids().collect()))
    assert got[0] == got[1] and len(got[0]) == 250   # ceil(997 * 0.25)


def test_split_matches_hash_rank(spark):
    df = _df(spark, 300)
    s = SP.seeded_split(df, "patient_id", 0.3, 42)
    h = sorted(((r.h, r.patient_id) for r in df.select(
        "patient_id", F.md5(F.concat("patient_id", F.lit(":42"))).alias("h")).collect()))
    want = sorted(p for _, p in h[:90])
    assert sorted(r[0] for r in s.test_ids().collect()) == want


def test_tail_split(spark):
    df = spark.createDataFrame([(i,) for i in range(5)], "value int")
    s = SP.seeded_split(df, "value", 0.4, 1, shuffle=False, order_col="value")
    assert sorted(r.value for r in s.test.collect()) == [3, 4]


def test_folds_sizes(spark):
    f = SP.assign_folds(_df(spark, 103, 7), 5, "patient_id", 42)
    sizes = sorted(r["count"] for r in f.groupBy("fold").count().collect())
    assert sizes == [20, 20, 21, 21, 21] and f.count() == 103


def test_no_leakage(spark):
    s = SP.seeded_split(_df(spark, 50), "patient_id", 0.2, 3)
    assert SP.leakage_count(s.train, s.test) == 0
    assert SP.heldout_anti(_df(spark, 50), s.test).count() == 40


def test_kth_smallest_small_task_bound(spark):
    from dwellframe.operators import ranking as R
    df = spark.createDataFrame([(float(i % 50), i) for i in range(2000)], "v double, k int")
    row = R.kth_smallest(df, "v", ["k"], 777, n_buckets=8, max_rows_in_task=100)
    want = sorted((r.v, r.k) for r in df.collect())[776]
    assert (row.v, row.k) == want
    same = spark.createDataFrame([(1.0, 5)] * 500, "v double, k int")
    assert R.kth_smallest(same, "v", ["k"], 300, n_buckets=4, max_rows_in_task=10).v == 1.0


def test_missing_keys_are_divided(spark):
    df = spark.createDataFrame([(None if i < 5 else f"p{i}", i) for i in range(10)], "patient_id string, value int")
    for seed in range(12):
        s = SP.seeded_split(df, "patient_id", 0.2, seed)
        test, train = s.test.collect(), s.train.collect()
        assert (len(test), len(train), s.n_test) == (2, 8, 2)
        assert sorted(r.value for r in test + train) == list(range(10))


def test_tied_tail_is_exact(spark):
    df = spark.createDataFrame([("a" if i < 15 else "b", i) for i in range(20)], "o string, value int")
    for share, want in ((0.1, 2), (0.3, 6), (0.5, 10)):
        s = SP.tail_split(df, "o", share)
        test = s.test.collect()
        assert len(test) == want == s.n_test and s.train.count() == 20 - want
        assert sum(r.o == "b" for r in test) == min(5, want)


def test_equal_rows_are_divided(spark):
    """Rows equal in every column, more than the side takes; and maps, which have no hash."""
    same = spark.range(1000).selectExpr("1 as patient_id", "'x' as t").repartition(7)
    s = SP.seeded_split(same, "patient_id", 0.25, 3)
    assert (s.test.count(), s.train.count()) == (250, 750) and s.test.columns == same.columns
    maps = spark.range(40).selectExpr("cast(null as bigint) as patient_id", "map('k', id) as m").repartition(3)
    s = SP.seeded_split(maps, "patient_id", 0.3, 3)
    got = [r.m["k"] for r in s.test.collect()] + [r.m["k"] for r in s.train.collect()]
    assert s.test.count() == 12 and sorted(got) == list(range(40))
    sizes = SP.assign_folds(same, 3, "patient_id").groupBy("fold").count().collect()
    assert sorted(r["count"] for r in sizes) == [333, 333, 334]


def test_cut_at_counts_equal_rows(spark):
    from dwellframe.operators import ranking as R
    df = spark.createDataFrame([(float(i % 4), None if i % 2 else i) for i in range(40)], "v double, k int")
    rows = sorted(((r.v, r.k is not None, r.k or 0) for r in df.collect()))
    for k in (1, 7, 15, 16, 33, 40):
        for most in (3, 1000):
            row, place, same = R.cut_at(df, "v", ["k"], k, n_buckets=4, max_rows_in_task=most)
            at = (row.v, row.k is not None, row.k or 0)
            assert at == rows[k - 1] and same == rows.count(at) and place == k - rows.index(at)


@pytest.mark.parametrize("values", [[5.0] * 1000 + [6.0 + k for k in range(20)], [float("-inf")] * 900 + [1.0] * 30 + [2.0], [3.0] * 500 + [float("nan")] * 600, [-1.0] + [0.0] * 2000 + [0.5, float("inf")]])
def test_cut_parts_a_value_that_most_rows_share(spark, monkeypatch, values):
    calls = []

    def counted(*a, **kw):
        calls.append(a)
        assert len(calls) < 30, "the bucket of the wanted row does not get smaller"
        return bucketize(*a, **kw)

    bucketize = ranking.bucketize
    monkeypatch.setattr(ranking, "bucketize", counted)
    df = spark.createDataFrame([(x, i % 3) for i, x in enumerate(values)], "x double, t int")
    ordered = sorted(((x, i % 3) for i, x in enumerate(values)), key=lambda r: (math.isnan(r[0]), 0.0 if math.isnan(r[0]) else r[0], r[1]))
    for k in (1, len(values) // 2, len(values) - 1, len(values)):
        row, place, same = ranking.cut_at(df, "x", ["t"], k, n_buckets=16, max_rows_in_task=10)
        want = ordered[k - 1]
        equal = [i for i, r in enumerate(ordered, 1) if repr(r) == repr(want)]
        assert (repr(row["x"]), row["t"], place, same) == (repr(want[0]), want[1], k - equal[0] + 1, len(equal))

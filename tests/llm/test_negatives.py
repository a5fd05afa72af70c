import random

import numpy as np
import pytest
from dwellframe.llm import negatives
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, id long, score double"


def plain(rows, k=5, n=5, low=80, high=100):
    """Every score of every anchor in Python's integers; rows (id, vector, label)."""
    fine = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v], y) for i, v, y in rows
            if i is not None and y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    anchors = {(i, y, tuple(v)) for i, v, y in fine if i % 100 == 0}
    out = []
    for i, y, v in anchors:
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j, z) for j, w, z in fine if j != i)
        others = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j) for j, w, z in fine if z != y)
        for s, j in [(s, j) for s, j, z in scored if z == y][:k]:
            window = [(t, m) for t, m in others if low * -s <= 100 * -t <= high * -s][:n]
            out += [(i, j, r, m, -s, -t) for r, (t, m) in enumerate(window, 1)]
    return sorted(out)


def mined(spark, rows, **options):
    table = spark.createDataFrame([(*r, 0, 1, 2.0) for r in rows], SCHEMA)
    got = negatives.mine(table, F.col("id") % 100 == 0, F.col("vec_id"), F.col("embedding"), F.col("label"), **options)
    return sorted(map(tuple, got.collect()))


def vectors(n, dims, seed, labels=4):
    rng = np.random.default_rng(seed)
    return [(i, [float(x) for x in np.float32(rng.normal(size=dims) / dims ** 0.5 + 0.1)], int(rng.integers(labels))) for i in range(n)]


@pytest.mark.parametrize("dims", [1, 7, 16, 40])
def test_equals_all_scores(spark, dims):
    rows = vectors(420, dims, dims)
    assert mined(spark, rows) == plain(rows)


def test_anchor_blocks_and_small_row_blocks_change_nothing(spark):
    rows = vectors(900, 24, 2)
    want = plain(rows)
    assert mined(spark, rows, anchor_block=2) == want


def test_ties_and_common_vectors(spark):
    same = [0.5, -0.25, 0.125, 0.0]
    rows = [(i, same if i % 3 else [0.4, 0.0, 0.1, 0.2], i % 2) for i in range(300)]
    assert mined(spark, rows) == plain(rows)


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.5], 1), (0, [1.0, 0.5], 1), (0, [0.5, 0.5], 2), (100, [], 1), (200, None, 1), (300, [1.0, None], 1), (400, [1.0, float("nan")], 1), (500, [float("inf"), 1.0], 1),
            (None, [1.0, 1.0], 1), (600, [1.0, 1.0], None), (1, [1.0, 0.5, 0.25], 1), (2, [0.9], 2), (3, [0.9, 0.4], 2), (3, [0.9, 0.4], 2), (4, [-1.0, -1.0], 1), (5, [0.0, 0.0], 2), (6, [0.8, 0.5], 1),
            (700, [-1.0, -0.5], 1), (800, [0.0, 0.0], 1), (9, [1e9, -1e9], 2), (10, [1e9, 1e9], 1)]
    assert mined(spark, rows) == plain([r for k, r in enumerate(rows) if k != 1] + [rows[1]])


def test_large_components_are_exact(spark):
    rng = random.Random(4)
    rows = [(i, [float(np.float32(rng.uniform(-1, 1) * 2.0 ** 20)) for _ in range(6)], i % 2) for i in range(210)]
    assert mined(spark, rows) == plain(rows)


def test_other_widths_of_the_window(spark):
    rows = vectors(300, 8, 9)
    assert mined(spark, rows, positives=2, negatives=3, low=50, high=95) == plain(rows, 2, 3, 50, 95)


def test_no_rows_and_no_anchors(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []


def test_scan_prunes_before_the_last_dimension():
    """With one strong dimension, most rows leave the bitmap after the first dimensions are read."""
    rng = np.random.default_rng(0)
    cells = rng.integers(-3, 4, size=(64, 2000))
    cells[40] = rng.permutation(2000) * 5
    block = negatives.Block(np.arange(2000), np.zeros(2000, np.int64), cells.astype(float), cells.min(axis=1).astype(float), cells.max(axis=1).astype(float))
    anchor, seen = np.ones(64, np.int64), []
    anchor[40] = 50

    def keep(low, high, at):
        seen.append(len(at))
        return high >= np.sort(low)[-5]

    at, scores = negatives.scan(block, anchor, 0, 2000, keep)
    exact = anchor @ cells
    assert seen[0] == seen[1] == 2000 and seen[2] < 50 and set(np.argsort(-exact)[:5]) <= set(at.tolist())
    assert (scores == exact[at]).all()

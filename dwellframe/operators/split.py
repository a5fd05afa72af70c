"""Deterministic train/test split, tail split and k-fold assignment.

The seeded split ranks rows by ``md5("<key>:<seed>")`` and sends the first
``ceil(n * test_size)`` rows to the test side (exact size, like the reference;
NumPy's permutation itself is not reproduced).  ``randomSplit`` is not used:
its sizes are inexact and depend on partitioning.  The cut is an exact order
statistic (:func:`ranking.cut_at`), and rows before it are found by a narrow
filter.  Only where rows with equal keys straddle it are these rows stored, and
divided by the hash of the whole row and at last by their place, so sizes are
exact for repeated and missing keys too, and no single-partition window is needed.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import ranking as R

HASH, HNUM, ROW, PLACE = "__h", "__hn", "__row", "__place"


@dataclass
class SplitResult:
    train: DataFrame
    test: DataFrame
    n_total: int
    n_test: int

    def test_ids(self, key: str = "patient_id") -> DataFrame:
        """Held-out ids as text; stays distributed."""
        return self.test.select(F.col(key).cast("string").alias(key))


MIN_TEST_SIZE, MAX_TEST_SIZE = 0.05, 0.5  # allowed test fraction


def test_count(n: int, test_size: float) -> int:
    """Held-out rows: ceil(n * test_size); the fraction must lie in [0.05, 0.5]."""
    if not MIN_TEST_SIZE <= test_size <= MAX_TEST_SIZE:
        raise ValueError(f"test_size must be between {MIN_TEST_SIZE} and {MAX_TEST_SIZE}")
    return int(math.ceil(n * test_size))


def with_hash_order(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Hash order of the key; rows without a key share the place of the empty text."""
    h = R.hash_order(key, seed)
    return df.withColumn(HASH, h).withColumn(HNUM, R.hex_prefix_number(F.col(HASH)))


def _divide(df: DataFrame, num: str, ties: list[str], k, extra: list[str], uniform_range=None) -> tuple[DataFrame, DataFrame]:
    """(the first k rows by (num, *ties), the others), without the columns ``extra``; rows equal in all of these go by the hash of the whole row."""
    cut, place, same = R.cut_at(df, num, ties, k, uniform_range=uniform_range)
    cols = [num, *ties]
    at = [cut[c] for c in cols]
    first = R.lex_le(cols, at)
    if place == same:
        return df.filter(first).drop(*extra), df.filter(~first).drop(*extra)
    equal = R.lex_eq(cols, at)
    some, others = _divide_tied(df.filter(equal).drop(*extra), place)
    return df.filter(first & ~equal).drop(*extra).unionByName(some), df.filter(~first).drop(*extra).unionByName(others)


def _divide_tied(tied: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(k of these rows, the others): by the hash of the whole row, and among equal rows by their place, which storing them keeps."""
    d = cut_lineage(tied).withColumn(PLACE, F.monotonically_increasing_id()).withColumn(ROW, R.row_hash(tied)).withColumn(HNUM, F.col(ROW).cast("double"))
    extra = [PLACE, ROW, HNUM]
    cut, place, same = R.cut_at(d, HNUM, [ROW], k)
    at = [cut[HNUM], cut[ROW]]
    first, equal = R.lex_le([HNUM, ROW], at), R.lex_eq([HNUM, ROW], at)
    if place < same:
        part = F.shiftright(PLACE, 33)
        left, upto = place, (-1, 0)
        for r in d.filter(equal).groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).orderBy("p").collect():  # one row a partition
            if left <= r["n"]:
                upto = (r["p"], left)
                break
            left -= r["n"]
        # within the partition that is divided, the k-th place of its equal rows
        own = d.filter(equal & (part == upto[0]))
        last = R.cut_at(own.withColumn("__at", F.col(PLACE).bitwiseAND((1 << 33) - 1).cast("double")), "__at", [PLACE], upto[1])[0][PLACE]
        first = (first & ~equal) | (equal & (F.col(PLACE) <= last))
    return d.filter(first).drop(*extra), d.filter(~first).drop(*extra)


def seeded_split(df: DataFrame, key: str = "patient_id", test_size: float = 0.2, seed: int = 42,
                 shuffle: bool = True, order_col: str | None = None) -> SplitResult:
    """Exact-size deterministic split; ``shuffle=False`` takes the last rows by ``order_col``.

    Rows without a key share one place of the key's order, and rows with equal
    keys another; among these the hash of the whole row decides.
    """
    if not shuffle:
        return tail_split(df, order_col or key, test_size, key)
    test_count(1, test_size)  # validates the fraction before any job
    hd = with_hash_order(df, key, seed)
    seen = {}

    def k_of(n):
        seen["n"], seen["k"] = n, test_count(n, test_size)
        return seen["k"]

    if df.limit(1).count() == 0:
        return SplitResult(df, df, 0, 0)
    test, train = _divide(hd, HNUM, [HASH, key], k_of, [HASH, HNUM], R.HASH_RANGE)
    return SplitResult(train, test, seen["n"], seen["k"])


def tail_split(df: DataFrame, order_col: str, test_size: float, key: str | None = None) -> SplitResult:
    """Without shuffling the last ``ceil(n * test_size)`` rows by ``order_col`` are the test side.

    Rows are compared in the column's own type (its double only sorts them into
    ranges), then by ``key``, then by the hash of the whole row; NULLs come first,
    so they are training rows.
    """
    n = df.count()
    k = test_count(n, test_size)
    num = "__ord"
    tie = [order_col, *([key] if key and key != order_col else [])]
    if n - k == 0:
        return SplitResult(df.limit(0), df, n, k)
    train, test = _divide(df.withColumn(num, R._monotone(df, order_col)), num, tie, n - k, [num])
    return SplitResult(train, test, n, k)


def assign_folds(df: DataFrame, k: int = 5, key: str = "patient_id", seed: int = 42,
                 out: str = "fold") -> DataFrame:
    """Contiguous folds over the seeded order (0-based); the first n mod k folds get one more row."""
    n = df.count()
    hd = with_hash_order(df, key, seed)
    ranked = R.global_rank(hd, HNUM, [HASH, key], out="__rank", n_rows=n, uniform_range=R.HASH_RANGE)
    return ranked.withColumn(out, R.ntile_from_rank("__rank", n, k) - 1).drop("__rank", HASH, HNUM)


def heldout_anti(df: DataFrame, test_ids: DataFrame, key: str = "patient_id") -> DataFrame:
    """Rows whose key is not held out (left anti join)."""
    return df.join(test_ids.select(key).distinct(), key, "left_anti")


def leakage_count(train: DataFrame, test: DataFrame, key: str = "patient_id") -> int:
    """Number of training rows whose key is also held out (must be 0)."""
    return train.join(test.select(key), key, "left_semi").count()

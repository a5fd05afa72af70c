"""Feature selection: one-pass Gram statistics and a cross-validated LASSO path.

The data pass adds up, per fold, the cross products of (1, mean-shifted
features, target) in square blocks, in each task and then by block in Spark,
whatever the number of features.  Everything after it runs on those p x p
statistics:

* training statistics of fold f = total - fold f (no rescan per fold);
* coordinate descent for ``(1/2n)||y - b0 - Xb||² + alpha·||b||₁`` on the centred
  Gram (the objective scikit-learn's Lasso minimises);
* held-out MSE of fold f from fold f's raw sums;
* 80 alphas = logspace(-4, 2) x alpha, warm-started from large to small;
  ties in the mean CV error go to the larger alpha.

Features are scaled by their population standard deviation over all rows
(no centring), as the reference does before LassoCV.  Folds come from the
seeded hash order (contiguous row order does not exist in Spark).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import clinical as C

N_ALPHAS = 80


# ------------------------------------------------------------------- Gram (D12)
@dataclass
class GramStats:
    features: list[str]
    folds: list[int]
    n: np.ndarray        # (k,)
    sx: np.ndarray       # (k, p)   sums of shifted x
    sy: np.ndarray       # (k,)
    sxx: np.ndarray      # (k, p, p)
    sxy: np.ndarray      # (k, p)
    syy: np.ndarray      # (k,)
    x_shift: np.ndarray  # (p,)
    y_shift: float

    def total(self):
        return (self.n.sum(), self.sx.sum(0), self.sy.sum(), self.sxx.sum(0), self.sxy.sum(0), self.syy.sum())

    def fold(self, i):
        return self.n[i], self.sx[i], self.sy[i], self.sxx[i], self.sxy[i], self.syy[i]

    def train(self, i):
        t = self.total()
        f = self.fold(i)
        return tuple(a - b for a, b in zip(t, f))


def gram_long(blocks: DataFrame, names: Sequence[str]) -> DataFrame:
    """Blocks -> long (fold, row_name, col_name, value) of the upper triangle over ``names`` (1, features, target), staying in Spark."""
    size = len(names)
    width = F.least(F.lit(GRAM_BLOCK), F.lit(size) - F.col("j"))
    cells = blocks.select("fold", "i", "j", width.alias("w"), F.posexplode("cells").alias("at", "value"))
    place = cells.select("fold", (F.col("i") + F.floor(F.col("at") / F.col("w"))).cast("int").alias("r"), (F.col("j") + F.col("at") % F.col("w")).cast("int").alias("c"), "value").where("r <= c")
    label = F.array(*[F.lit(n) for n in names])
    return place.select("fold", label[F.col("r")].alias("row_name"), label[F.col("c")].alias("col_name"), "value")


def means_and_scales(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """(mean, population std) per column, one aggregate."""
    aggs = []
    for c in cols:
        aggs += [F.avg(F.col(c).cast("double")).alias(f"{c}__m"), F.stddev_pop(F.col(c).cast("double")).alias(f"{c}__s")]
    row = df.agg(*aggs).first()
    return {c: (row[f"{c}__m"] or 0.0, row[f"{c}__s"] or 0.0) for c in cols}


def checked(df: DataFrame, features: Sequence[str], target: str | None, missing: str = "error") -> tuple[DataFrame, dict[str, tuple[float, float]], int]:
    """Rows with a target, (mean, population std) of every column, and how many rows lack a feature; one aggregate.

    ``missing`` says what happens to those: "error" raises with their number,
    "drop" leaves them out, "mean" puts the feature's mean in.
    """
    if missing not in ("error", "drop", "mean"):
        raise ValueError(f"missing={missing!r}: error, drop or mean")
    d = df.filter(F.col(target).isNotNull()) if target else df
    nulls = {c: F.col(c).isNull() | F.isnan(F.col(c).cast("double")) for c in features}
    values = {c: F.when(~nulls[c], F.col(c).cast("double")) if c in nulls else F.col(c).cast("double") for c in [*features, *([target] if target else [])]}
    lacks = F.lit(False)
    for x in nulls.values():
        lacks = lacks | x
    row = d.agg(F.count_if(lacks).alias("lacking"), *[F.count_if(x).alias(f"{c}__n") for c, x in nulls.items()],
                *[a for c, x in values.items() for a in (F.avg(x).alias(f"{c}__m"), F.stddev_pop(x).alias(f"{c}__s"))]).first()
    stats = {c: (row[f"{c}__m"] or 0.0, row[f"{c}__s"] or 0.0) for c in values}
    if row["lacking"] and missing == "error":
        which = ", ".join(f"{c} ({row[f'{c}__n']})" for c in features if row[f"{c}__n"])
        raise ValueError(f"{row['lacking']} rows lack a feature: {which}; impute them first, or say missing='drop' or 'mean'")
    if row["lacking"] and missing == "drop":
        d = d.filter(~lacks)
    elif row["lacking"]:
        d = d.withColumns({c: F.when(nulls[c], F.lit(stats[c][0])).otherwise(F.col(c).cast("double")) for c in features if row[f"{c}__n"]})
    return d, stats, row["lacking"]




#: Side of the square blocks in which cross products travel and are summed.
GRAM_BLOCK = 64


def gram_blocks(df: DataFrame, features: Sequence[str], target: str, fold: str, shift: dict[str, float]) -> DataFrame:
    """Cross products of (1, features, target) per fold in blocks: (fold, row block, column block, values array<double>).

    Each task adds up its rows' products in numpy and sends one row a fold and
    block; blocks are keys, so Spark sums them in as many tasks as it likes
    and no task or row ever holds the whole p² table.
    """
    p = len(features)
    shifts = np.array([0.0, *[shift.get(c, 0.0) for c in features], shift.get(target, 0.0)])
    size = p + 2
    edges = list(range(0, size, GRAM_BLOCK))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int, int], np.ndarray] = {}
        names: list = []
        for batch in batches:
            folds = batch.column(0).to_pylist()
            place = {}
            for f in folds:
                if f not in place:
                    place[f] = names.index(f) if f in names else len(names)
                    if place[f] == len(names):
                        names.append(f)
            which = np.array([place[f] for f in folds])
            x = np.column_stack([np.ones(len(folds)), *[batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, size)]]) - shifts
            for k in np.unique(which).tolist():
                own = x[which == k]
                for i in edges:
                    for j in edges:
                        if j >= i:
                            block = own[:, i:i + GRAM_BLOCK].T @ own[:, j:j + GRAM_BLOCK]
                            held[k, i, j] = held[k, i, j] + block if (k, i, j) in held else block
        for (k, i, j), block in held.items():
            yield pa.RecordBatch.from_pydict({"fold": pa.array([names[k]], kind), "i": pa.array([i], pa.int32()), "j": pa.array([j], pa.int32()),
                                              "cells": pa.array([block.reshape(-1).tolist()], pa.list_(pa.float64()))})

    sel = df.select(F.col(fold), *[F.col(c).cast("double") for c in features], F.col(target).cast("double"))
    field = sel.schema.fields[0].dataType
    kind = to_arrow_type(field)
    schema = f"fold {field.simpleString()}, i int, j int, cells array<double>"
    cells = sel.mapInArrow(part, schema).select("fold", "i", "j", F.posexplode("cells").alias("at", "v"))
    summed = cells.groupBy("fold", "i", "j", "at").agg(F.sum("v").alias("v"))
    return summed.groupBy("fold", "i", "j").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda c: c["v"]).alias("cells"))


def collect_gram(df: DataFrame, features: Sequence[str], target: str, fold: str, shift: dict[str, float]) -> GramStats:
    """Per-fold statistics of (shifted) features and target, read block by block: k x O(p²) numbers, as the solvers need them."""
    p = len(features)
    size = p + 2
    full: dict = {}
    for r in gram_blocks(df, features, target, fold, shift).toLocalIterator():
        m = full.setdefault(r["fold"], np.zeros((size, size)))
        rows, cols = min(GRAM_BLOCK, size - r["i"]), min(GRAM_BLOCK, size - r["j"])
        block = np.array(r["cells"]).reshape(rows, cols)
        m[r["i"]:r["i"] + rows, r["j"]:r["j"] + cols] = block
        m[r["j"]:r["j"] + cols, r["i"]:r["i"] + rows] = block.T
    folds = sorted(full)
    stack = np.stack([full[f] for f in folds]) if folds else np.zeros((0, size, size))
    return GramStats(list(features), folds, stack[:, 0, 0], stack[:, 0, 1:p + 1], stack[:, 0, p + 1], stack[:, 1:p + 1, 1:p + 1], stack[:, 1:p + 1, p + 1], stack[:, p + 1, p + 1],
                     np.array([shift.get(c, 0.0) for c in features]), shift.get(target, 0.0))


# --------------------------------------------------------------- LASSO solver
def _centred(stats):
    n, sx, sy, sxx, sxy, syy = stats
    mx, my = sx / n, sy / n
    cxx = sxx - n * np.outer(mx, mx)
    cxy = sxy - n * mx * my
    cyy = syy - n * my * my
    return n, mx, my, cxx, cxy, cyy


def lasso_cd(cxx: np.ndarray, cxy: np.ndarray, n: float, alpha: float, beta0: np.ndarray | None = None,
             max_iter: int = 1000, tol: float = 1e-4) -> np.ndarray:
    """Coordinate descent on centred sums for (1/2n)||y - Xb||² + alpha||b||₁."""
    p = cxy.shape[0]
    b = np.zeros(p) if beta0 is None else beta0.copy()
    diag = np.diag(cxx).copy()
    lam = alpha * n
    for _ in range(max_iter):
        max_delta, max_b = 0.0, 0.0
        for j in range(p):
            if diag[j] <= 0:
                b[j] = 0.0
                continue
            rho = cxy[j] - cxx[j] @ b + diag[j] * b[j]
            new = np.sign(rho) * max(abs(rho) - lam, 0.0) / diag[j]
            max_delta = max(max_delta, abs(new - b[j]))
            b[j] = new
            max_b = max(max_b, abs(new))
        if max_delta <= tol * max(max_b, 1e-12):
            break
    return b


def heldout_mse(test_stats, b0: float, b: np.ndarray) -> float:
    """Mean of (y - b0 - xᵀb)² over a fold, from its raw sums."""
    n, sx, sy, sxx, sxy, syy = test_stats
    if n == 0:
        return float("nan")
    pred_sq = b0 * b0 * n + 2 * b0 * (sx @ b) + b @ sxx @ b
    cross = b0 * sy + sxy @ b
    return float((syy - 2 * cross + pred_sq) / n)


@dataclass
class LassoResult:
    target: str
    features: list[str]
    coef: np.ndarray
    intercept: float
    alpha: float
    alphas: np.ndarray
    mse_path: np.ndarray  # (n_alphas, k)
    selected: list[str]


def lasso_path_cv(stats: GramStats, scales: np.ndarray, alpha: float = 0.01, max_iter: int = 1000,
                  min_features: int = 5, tol: float = 1e-4) -> LassoResult:
    """CV over 80 alphas from per-fold Gram statistics; refit at the best alpha on all rows."""
    s = np.where(scales > 0, scales, 1.0)
    scale_mat = np.outer(s, s)

    def scaled(st):
        n, sx, sy, sxx, sxy, syy = st
        return n, sx / s, sy, sxx / scale_mat, sxy / s, syy

    alphas = np.logspace(-4, 2, num=N_ALPHAS)[::-1] * alpha
    k = len(stats.folds)
    mse = np.zeros((len(alphas), k))
    for f in range(k):
        tr = _centred(scaled(stats.train(f)))
        te = scaled(stats.fold(f))
        b = np.zeros(len(stats.features))
        for a_i, a in enumerate(alphas):
            b = lasso_cd(tr[3], tr[4], tr[0], a, b, max_iter, tol)
            b0 = tr[2] - tr[1] @ b
            mse[a_i, f] = heldout_mse(te, b0, b)
    mean = mse.mean(axis=1)
    best = int(np.nanargmin(mean))  # first minimum = largest alpha (alphas descending)
    full = _centred(scaled(stats.total()))
    b = np.zeros(len(stats.features))
    for a in alphas[: best + 1]:
        b = lasso_cd(full[3], full[4], full[0], a, b, max_iter, tol)
    b0 = full[2] - full[1] @ b
    sel = select_features(stats.features, b, min_features)
    return LassoResult("", stats.features, b, float(b0), float(alphas[best]), alphas, mse, sel)


def select_features(names: Sequence[str], coef: np.ndarray, min_features: int) -> list[str]:
    """Non-zero coefficients; fewer than ``min_features`` -> the top ``min_features`` by |coef| (ties by name)."""
    nz = [n for n, c in zip(names, coef) if c != 0.0]
    if len(nz) >= min_features:
        return nz
    order = sorted(zip(names, coef), key=lambda t: (-abs(t[1]), t[0]))
    return [n for n, _ in order[:min_features]]


def fit_lasso_selection(df: DataFrame, features: Sequence[str], target: str, *, fold: str = "fold",
                        alpha: float = 0.01, max_iter: int = 1000, min_features: int = 5,
                        problem_type: str = "regression", threshold: float | None = None, missing: str = "error") -> LassoResult:
    """Target filter -> (binary label) -> scale by all-rows population std -> per-fold Gram -> CV path."""
    ms = means_and_scales(df, [*features, target])
    scales = np.array([ms[c][1] for c in features])
    d, _, _ = checked(df, features, target, missing)
    if problem_type == "binary" and threshold is not None:
        d = d.withColumn(target, C.adequate(target, threshold).cast("double"))
        ms[target] = (0.0, 0.0)
    shift = {c: ms[c][0] for c in features}
    shift[target] = ms[target][0]
    stats = collect_gram(d, features, target, fold, shift)
    if stats.n.sum() == 0:
        raise ValueError(f"no row has a value of {target!r}")
    res = lasso_path_cv(stats, scales, alpha, max_iter, min_features)
    res.target = target
    return res


def selection_frame(spark: SparkSession, results: Sequence[LassoResult]) -> DataFrame:
    """(target, feature, coefficient, selected, alpha) — the JSON summary as a table."""
    rows = []
    for r in results:
        for name, c in zip(r.features, r.coef):
            rows.append((r.target, name, float(c), name in r.selected, r.alpha))
    return spark.createDataFrame(rows, "target string, feature string, coefficient double, selected boolean, alpha double")


def cv_curve_frame(spark: SparkSession, results: Sequence[LassoResult]) -> DataFrame:
    rows = []
    for r in results:
        mean = r.mse_path.mean(axis=1)
        for a, m in zip(r.alphas, mean):
            rows.append((r.target, float(a), float(m), bool(a == r.alpha)))
    return spark.createDataFrame(rows, "target string, alpha double, mean_mse double, is_best boolean")


# ------------------------------------------------------ relational selections
def univariate_lasso(df: DataFrame, features: Sequence[str], target: str, lam: float) -> DataFrame:
    """Per feature, the one-feature LASSO on standardised data: soft-threshold of corr(x, y).

    Long (feature, coefficient) from one aggregate of correlations.
    """
    d = df.filter(F.col(target).isNotNull())
    row = d.agg(*[F.corr(F.col(c).cast("double"), F.col(target).cast("double")).alias(c) for c in features])
    arr = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("r")) for c in features])
    x = row.select(F.inline(arr))
    coef = F.signum("r") * F.greatest(F.abs("r") - F.lit(lam), F.lit(0.0))
    return x.select("feature", F.coalesce(coef, F.lit(0.0)).alias("coefficient"))


def top_coefficients(coefs: DataFrame, min_features: int, by: Sequence[str] = ()) -> DataFrame:
    """Non-zero coefficients, or the top ``min_features`` by |coef| (ties by name) when fewer are non-zero.

    ``coefs`` has one row per (group, feature): its size is the feature count.
    """
    from pyspark.sql import Window
    w = Window.partitionBy(*by).orderBy(F.abs("coefficient").desc(), F.col("feature")) if by else \
        Window.orderBy(F.abs("coefficient").desc(), F.col("feature"))
    wn = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    r = (coefs.withColumn("__rk", F.row_number().over(w))
         .withColumn("__nz", F.sum((F.col("coefficient") != 0).cast("int")).over(wn)))
    keep = F.when(F.col("__nz") >= min_features, F.col("coefficient") != 0).otherwise(F.col("__rk") <= min_features)
    return r.filter(keep).drop("__rk", "__nz")


def selected_union(selections: DataFrame, always_keep: Sequence[str] = ()) -> DataFrame:
    """Sorted distinct union of features selected for any target, plus always-kept names."""
    u = selections.select("feature").distinct()
    if always_keep:
        keep = selections.sparkSession.createDataFrame([(k,) for k in always_keep], "feature string")
        u = u.union(keep).distinct()
    return u.orderBy("feature")


def linear_attribution(df: DataFrame, coefs: dict[str, float]) -> DataFrame:
    """Mean |coef · (x − mean(x))| per feature (the bar plot's data): two aggregates."""
    feats = list(coefs)
    means = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in feats]).first()
    aggs = [F.avg(F.abs(F.lit(coefs[c]) * (F.col(c).cast("double") - F.lit(means[c])))).alias(c) for c in feats]
    row = df.agg(*aggs)
    arr = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("mean_abs_contribution")) for c in feats])
    return row.select(F.inline(arr))


def least_squares(cxx: np.ndarray, cxy: np.ndarray) -> np.ndarray:
    """Solution of the centred normal equations; of least norm on standardised features where they are (nearly) singular."""
    unit = np.sqrt(np.diag(cxx))
    unit = np.where(unit > 0, unit, 1.0)
    scaled = cxx / np.outer(unit, unit)
    if np.linalg.cond(scaled) < 1 / np.finfo(float).eps / len(cxy):
        return np.linalg.solve(cxx, cxy)
    return np.linalg.lstsq(scaled, cxy / unit, rcond=1e-12)[0] / unit


def ols_from_gram(stats: GramStats) -> tuple[np.ndarray, float]:
    """Least squares with intercept from the total Gram: solve the centred normal equations.

    Where features depend on each other (one-hot columns that add up to 1, a
    constant) the solution of least norm on standardised features is taken.
    """
    n, mx, my, cxx, cxy, _ = _centred(stats.total())
    b = least_squares(cxx, cxy)
    b0 = my - mx @ b
    # undo the shift: y - ys = b0 + (x - xs)b  ->  intercept in original units
    return b, float(b0 + stats.y_shift - stats.x_shift @ b)


def training_input(features: DataFrame, selections: dict[str, Sequence[str]], key: str = "patient_id",
                   targets: Sequence[str] = ("ktv", "pet"), always_keep: Sequence[str] = ()):
    """Project the sorted union of features selected for any target (plus always-kept names).

    Returns (frame, union, absent): selected names missing from the frame are
    reported (and skipped); no selection at all keeps every column.
    """
    if not selections:
        return features, [c for c in features.columns if c not in (key, *targets)], []
    union = sorted({f for fs in selections.values() for f in fs} | set(always_keep))
    absent = [f for f in union if f not in features.columns]
    keep = [f for f in union if f in features.columns]
    cols = ([key] if key in features.columns else []) + keep + [t for t in targets if t in features.columns]
    return features.select(*cols), keep, absent

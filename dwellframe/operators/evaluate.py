"""Evaluation tables over long prediction frames.

Input is long: ``(patient_id, target, model, y_true, y_pred)``.  Every metric
is one ``groupBy`` of sums with map-side partial aggregation: a model whose
predictions cover the whole cohort is still combined per partition before the
shuffle, so no group lands whole in one task.  Binning (calibration) uses the
exact grouped rank of :mod:`ranking`, not a per-model window.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clinical as C
from . import ranking as R

GROUP = ("target", "model")


def _err(y: str, p: str) -> Column:
    return F.col(y) - F.col(p)


def r2_expr(y: str = "y_true", p: str = "y_pred") -> Column:
    """Coefficient of determination 1 - SSE/SST (SST = n * var_pop(y)).

    SST = 0 gives 1.0 when SSE = 0 else 0.0; fewer than 2 rows give NULL.
    Not ``regr_r2`` (a squared correlation).
    """
    e = _err(y, p)
    sse = F.sum(e * e)
    sst = F.var_pop(y) * F.count(F.lit(1))
    return (F.when(F.count(F.lit(1)) < 2, F.lit(None).cast("double"))
            .when(sst == 0, F.when(sse == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
            .otherwise(F.lit(1.0) - sse / sst))


def regression_metrics(pred: DataFrame, by: Sequence[str] = GROUP, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """n, R², MAE, MSE per group (rows with a NULL truth or prediction are skipped)."""
    d = pred.filter(F.col(y).isNotNull() & F.col(p).isNotNull())
    e = _err(y, p)
    return d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), r2_expr(y, p).alias("r2"),
                              F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"))


def subgroup_metrics(pred: DataFrame, dims: Sequence[str] = ("model", "gender"), y: str = "y_true",
                     p: str = "y_pred") -> DataFrame:
    """Regression metrics for every combination of ``dims`` (``cube``), totals with NULL keys."""
    d = pred.filter(F.col(y).isNotNull() & F.col(p).isNotNull())
    e = _err(y, p)
    return d.cube(*dims).agg(F.count(F.lit(1)).alias("n"), r2_expr(y, p).alias("r2"),
                             F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"))


AGE_BANDS = (50.0, 65.0)
COMORBIDITY_BANDS = (3, 5)


def with_bands(df: DataFrame, age: str = "age", index: str = "charlson_index") -> DataFrame:
    """Age and comorbidity bands for subgroup tables: below, between and from the cut points; NULL is "unknown"."""
    def band(c, cuts):
        x = F.when(F.col(c).isNull(), "unknown")
        low = "-"
        for k in cuts:
            x = x.when(F.col(c) < k, f"{low}..{k:g}")
            low = f"{k:g}"
        return x.otherwise(f"{low}..")
    return df.withColumns({"age_band": band(age, AGE_BANDS), "comorbidity_band": band(index, COMORBIDITY_BANDS)})


def icc_2_1(pred: DataFrame, by: Sequence[str] = GROUP, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """ICC(2,1) of truth vs prediction as two raters, from one aggregate of sums (ANOVA mean squares)."""
    d = pred.filter(F.col(y).isNotNull() & F.col(p).isNotNull())
    n = F.count(F.lit(1)).cast("double")
    my, mp = F.avg(y), F.avg(p)
    agg = d.groupBy(*by).agg(
        n.alias("n"), my.alias("my"), mp.alias("mp"),
        F.var_samp((F.col(y) + F.col(p)) / 2).alias("v_row"),
        F.sum(F.col(y) * F.col(y) + F.col(p) * F.col(p)).alias("ss"))
    msr = 2 * F.col("v_row")
    msc = F.col("n") * F.pow(F.col("my") - F.col("mp"), 2) / 2
    sst = F.col("ss") - 2 * F.col("n") * F.pow((F.col("my") + F.col("mp")) / 2, 2)
    # one row or constant data leave no variance: the result is NULL
    mse = F.try_divide(sst - msr * (F.col("n") - 1) - msc, F.col("n") - 1)
    icc = F.try_divide(msr - mse, msr + mse + 2 * (msc - mse) / F.col("n"))
    return agg.select(*by, F.col("n").cast("bigint").alias("n"), icc.alias("icc"))


def calibration_bins(pred: DataFrame, n_bins: int = 10, by: Sequence[str] = GROUP, y: str = "y_true",
                     p: str = "y_pred", key: str = "patient_id") -> DataFrame:
    """Equal-count bins of the prediction (exact ``ntile``), mean predicted vs mean observed per bin."""
    if n_bins < 3:
        raise ValueError("calibration needs at least 3 bins")
    d = pred.filter(F.col(y).isNotNull() & F.col(p).isNotNull())
    b = R.grouped_ntile(d, list(by), p, n_bins, tie_cols=[key], out="bin")
    return b.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_pred"),
                                     F.avg(y).alias("mean_obs"))


def adequacy_share(pred: DataFrame, threshold: float = C.KTV_ADEQUATE, by: Sequence[str] = GROUP,
                   y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """Share predicted adequate vs share truly adequate, and the 2x2 counts."""
    d = pred.filter(F.col(y).isNotNull() & F.col(p).isNotNull())
    py, pp = F.col(y) >= threshold, F.col(p) >= threshold
    return d.groupBy(*by).agg(
        F.avg(pp.cast("double")).alias("share_pred"), F.avg(py.cast("double")).alias("share_true"),
        F.count_if(pp & py).alias("tp"), F.count_if(pp & ~py).alias("fp"),
        F.count_if(~pp & py).alias("fn"), F.count_if(~pp & ~py).alias("tn"))


def confusion_matrix(scores: DataFrame, y: str = "y_class", p: str = "p_class") -> DataFrame:
    """(y, p, n): at most k² rows."""
    return scores.groupBy(y, p).agg(F.count(F.lit(1)).alias("n"))


def quadratic_kappa(scores: DataFrame, y: str = "y_class", p: str = "p_class") -> DataFrame:
    """Quadratic weighted kappa in one aggregate.

    With w = (i - j)², the expected weighted count under independent marginals
    expands to Σy² + Σp² - 2·Σy·Σp / N (sums over rows), and the observed one is
    Σ(y - p)²; so kappa = 1 - observed / expected without building the k x k
    table.  (Normalising w by (k-1)² cancels.)
    """
    d = scores.filter(F.col(y).isNotNull() & F.col(p).isNotNull()).select(
        F.col(y).cast("double").alias("y"), F.col(p).cast("double").alias("p"))
    a = d.agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("y").alias("sy"), F.sum("p").alias("sp"),
              F.sum(F.col("y") * F.col("y")).alias("syy"), F.sum(F.col("p") * F.col("p")).alias("spp"),
              F.sum(F.pow(F.col("y") - F.col("p"), 2)).alias("obs"))
    exp = F.col("syy") + F.col("spp") - F.try_divide(2 * F.col("sy") * F.col("sp"), F.col("n"))  # zero (NULL kappa) if all rows share one class
    return a.select(F.col("n").cast("bigint").alias("n"), (F.lit(1.0) - F.try_divide("obs", exp)).alias("kappa"))


def expected_calibration_error(scores: DataFrame, n_bins: int = 10, y: str = "y_class", p: str = "p_class",
                               conf: str = "top_prob") -> DataFrame:
    """ECE of the top-class probability: bins floor(conf·n_bins) (1.0 in the last one), Σ n·|acc − conf| / N."""
    d = scores.filter(F.col(conf).isNotNull())
    bins = d.groupBy(F.least(F.floor(F.col(conf) * n_bins), F.lit(n_bins - 1)).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col(y) == F.col(p)).cast("double")).alias("acc"),
        F.avg(conf).alias("conf"))
    return bins.agg(F.try_divide(F.sum(F.col("n") * F.abs(F.col("acc") - F.col("conf"))), F.sum("n")).alias("ece"),
                    F.sum("n").alias("n"))


def model_names(pred: DataFrame, col: str = "model") -> list[str]:
    """Distinct model names: the columns of the comparison tables (one small name for each fitted model)."""
    return sorted(r[0] for r in pred.select(col).distinct().collect() if r[0] is not None)


def paired_comparison(pred: DataFrame, models: Sequence[str] | None = None, key: str = "patient_id",
                      target: str = "target", y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """Paired difference of absolute errors between models on the same rows (t statistic).

    One aggregation by (target, key) puts each patient's errors side by side;
    the sums of all model pairs are columns of one second aggregate, unfolded at
    the end.  No self-join, no pairs of rows, two shuffles for any number of
    models.  Models that differ by a constant have a NULL statistic.
    """
    d = pred.filter(F.col(y).isNotNull() & F.col(p).isNotNull())
    models = list(models) if models is not None else model_names(d)
    ae = F.abs(_err(y, p))
    # one conditional aggregation per (target, key): one shuffle, partial aggregation map-side
    wide = d.groupBy(target, key).agg(*[F.max(F.when(F.col("model") == m, ae)).alias(m) for m in models])
    pairs = [(a, b, F.col(f"`{a}`") - F.col(f"`{b}`")) for i, a in enumerate(models) for b in models[i + 1:]]
    each = [F.struct(F.lit(a).alias("model_a"), F.lit(b).alias("model_b"), F.count(diff).alias("n"), F.avg(diff).alias("mean_diff"),
                     F.stddev_samp(diff).alias("sd_diff")) for a, b, diff in pairs]
    none = F.expr("cast(array() as array<struct<model_a:string,model_b:string,n:bigint,mean_diff:double,sd_diff:double>>)")
    flat = wide.groupBy(target).agg((F.array(*each) if each else none).alias("__all")).select(target, F.inline("__all")).filter("n > 0")
    return flat.withColumn("t_stat", F.try_divide("mean_diff", F.col("sd_diff") / F.sqrt(F.col("n"))))


def comparison_pivot(metrics: DataFrame, metric: str, models: Sequence[str] | None = None,
                     target: str = "target") -> DataFrame:
    """One metric with the models side by side (model list given or read from the metrics table)."""
    models = list(models) if models is not None else model_names(metrics)
    return metrics.groupBy(target).pivot("model", models).agg(F.first(metric))


LOWER_IS_BETTER = {"mae", "mse", "rmse"}


def champion(metrics: DataFrame, metric: str = "r2", target: str = "target") -> DataFrame:
    """Best model per target by the primary metric (R² high, errors low); ties -> model name.

    ``metrics`` has one row per (target, model): a window over it is small.
    """
    order = F.col(metric).asc_nulls_last() if metric in LOWER_IS_BETTER else F.col(metric).desc_nulls_last()
    w = Window.partitionBy(target).orderBy(order, F.col("model"))
    return metrics.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def median_quantile(qpred: DataFrame, by: Sequence[str] = GROUP, q: str = "quantile", pos: str = "q_pos") -> DataFrame:
    """Keep, per (target, model), the quantile nearest 0.5 (tie -> first in list order).

    The choice is made on the distinct (group, quantile) list, bounded by the
    number of fitted quantiles, then joined back onto the predictions.
    """
    qs = qpred.select(*by, q, pos).distinct()
    w = Window.partitionBy(*by).orderBy(F.abs(F.col(q) - 0.5), F.col(pos))
    pick = qs.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").select(*by, q)
    return qpred.join(pick, [*by, q], "left_semi")


def residual_interval(pred: DataFrame, coverage: float = 0.95, by: Sequence[str] = GROUP, y: str = "y_true",
                      p: str = "y_pred") -> DataFrame:
    """Empirical interval per row: prediction + exact residual quantiles of its (target, model)."""
    d = pred.filter(F.col(y).isNotNull() & F.col(p).isNotNull()).withColumn("__res", _err(y, p))
    a = (1.0 - coverage) / 2
    qs = R.exact_percentiles(d, "__res", [a, 1 - a], list(by), names=["res_lo", "res_hi"])
    return pred.join(qs, list(by), "left").select(
        *pred.columns, (F.col(p) + F.col("res_lo")).alias("pi_lo"), (F.col(p) + F.col("res_hi")).alias("pi_hi"))


def pet_class(value, cuts: Sequence[float]) -> Column:
    """Class index from caller-given ascending cut points (no default exists in the reference)."""
    v = value if isinstance(value, Column) else F.col(value)
    if list(cuts) != sorted(cuts):
        raise ValueError("cut points must be ascending")
    expr = F.when(v.isNull(), F.lit(None).cast("int"))
    for i, c in enumerate(cuts):
        expr = expr.when(v < c, F.lit(i))
    return expr.otherwise(F.lit(len(cuts)))


# Cumulative Poisson(1) probabilities P(K <= k), e^-1 · Σ 1/i!; a draw above 11 (probability 6e-11) counts as 12.
def _poisson1_cdf(kmax: int = 11) -> list[float]:
    out, term, acc = [], math.exp(-1.0), 0.0
    for k in range(kmax + 1):
        acc += term
        out.append(acc)
        term /= (k + 1)
    return out


def poisson_weight(key, replicate, seed: int) -> Column:
    """Poisson(1) draw by inverse CDF of a uniform taken from xxhash64(key, replicate, seed)."""
    k = F.col(key) if isinstance(key, str) else key
    r = F.col(replicate) if isinstance(replicate, str) else F.lit(replicate)
    h = F.xxhash64(k, r, F.lit(seed))
    u = (F.pmod(h, F.lit(1 << 53)).cast("double") + 0.5) / float(1 << 53)
    cdf = _poisson1_cdf()
    expr = None
    for n, c in enumerate(cdf):
        expr = F.when(u <= c, F.lit(n)) if expr is None else expr.when(u <= c, F.lit(n))
    return expr.otherwise(F.lit(len(cdf))).cast("double")


def poisson_bootstrap_mae(pred: DataFrame, n_boot: int = 100, seed: int = 42, by: Sequence[str] = GROUP,
                          key: str = "patient_id", y: str = "y_true", p: str = "y_pred",
                          coverage: float = 0.95) -> DataFrame:
    """Point MAE and a percentile interval over ``n_boot`` Poisson-weighted replicates.

    Each row meets every replicate id (``explode(sequence)``) inside the map
    task and is folded at once by the partial aggregate of
    ``groupBy(group, replicate)``: a task emits groups x n_boot partial sums,
    never n_boot copies of its rows.  The replicate table then has exactly
    ``n_boot`` values per group, so its exact percentiles are bounded.
    """
    d = pred.filter(F.col(y).isNotNull() & F.col(p).isNotNull()).select(
        *by, key, F.abs(_err(y, p)).alias("__ae"))
    point = d.groupBy(*by).agg(F.avg("__ae").alias("mae"))
    x = d.select(*by, key, "__ae", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("__b"))
    w = poisson_weight(key, "__b", seed)
    # a replicate that draws no row has no value and is left out of the percentiles
    reps = x.groupBy(*by, "__b").agg(F.try_divide(F.sum(w * F.col("__ae")), F.sum(w)).alias("rep")).filter("rep is not null")
    a = (1 - coverage) / 2
    q = reps.groupBy(*by).agg(F.percentile("rep", F.array(F.lit(a), F.lit(1 - a))).alias("__q"))
    return (point.join(q, list(by), "left")
            .select(*by, "mae", F.col("__q")[0].alias("lo"), F.col("__q")[1].alias("hi"))
            .withColumn("n_boot", F.lit(n_boot)))

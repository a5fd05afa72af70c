"""Fit/apply feature preparation with a reusable parameter table.

``fit_prep`` runs one aggregate job over the training rows for no or mean
imputation (mean imputation changes only the variance, by n_nonnull / n), or
two for median / most-frequent imputation (statistics, then scaler statistics
after imputation), plus one bounded ``distinct`` job for all vocabularies.  All
statistics come back as a parameter table with one row per feature or
category.  That table is small, writable and joinable.

``apply_prep`` is a pure ``select`` generated from the parameters.  It works on
batch and streaming frames alike and needs no shuffle.

Semantics kept from the reference: population standard deviation with scale
1 for a constant column; min-max to ``[lo, hi]`` with a constant column going
to ``lo``; one-hot columns ``{col}_{category}`` sorted, none dropped, NULL ->
"missing", unseen -> all zeros; no clipping of unseen ranges.  Fixes (stated):
label encoding maps NULL to "missing" (the reference produced the text "nan");
dates and free text never enter the matrix.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import clinical as C
from . import cohort as cohort_ops
from . import ranking as R

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
                 T.DecimalType)
MISSING = "missing"

PARAM_SCHEMA = ("feature string, kind string, impute_value double, centre double, scale double, "
                "lo double, hi double, category string, ordinal int, source string")


@dataclass
class PrepModel:
    numeric: list[str]
    categorical: list[str]
    targets: list[str]
    params: list[dict]
    imputation: str = "none"
    scaling: str = "standard"
    encoding: str = "one_hot"
    log_features: list[str] = field(default_factory=list)
    derive: bool = True
    feature_columns: list[str] = field(default_factory=list)

    def params_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(p.get("feature"), p.get("kind"), p.get("impute_value"), p.get("centre"), p.get("scale"),
                 p.get("lo"), p.get("hi"), p.get("category"), p.get("ordinal"), p.get("source"))
                for p in self.params]
        return spark.createDataFrame(rows, PARAM_SCHEMA)


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """All numeric columns (flags, CCI and intervals included) except ``exclude``."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NUMERIC_TYPES) and f.name not in exclude]


def log1p_violations(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    """Count of values < -1 per column (one aggregate); callers raise on any."""
    cols = [c for c in columns if c in df.columns]
    if not cols:
        return {}
    row = df.agg(*[F.count_if(F.col(c) < -1).alias(c) for c in cols]).first()
    return {c: int(row[c]) for c in cols}


def _transform_base(df: DataFrame, model: PrepModel, *, check_log: bool = True) -> DataFrame:
    """Derivations, then log1p.  With ``check_log`` a value < -1 fails the job that reads it
    (``raise_error`` inside the projection: no separate validation pass); without it (streams)
    such a value becomes NULL."""
    if model.derive:
        df = cohort_ops.derive_features(df)
    logs = [c for c in model.log_features if c in df.columns]
    if logs:
        fn = (lambda c: C.log1p_checked(F.col(c).cast("double"), c)) if check_log else \
            (lambda c: C.log1p_guarded(F.col(c).cast("double")))
        df = df.withColumns({c: fn(c) for c in logs})
    return df


def fit_prep(df: DataFrame, *, targets: Sequence[str] = ("ktv", "pet"), numeric: Sequence[str] | None = None,
             categorical: Sequence[str] = (), imputation: str = "none", scaling: str = "standard",
             minmax_range: tuple[float, float] = (0.0, 1.0), encoding: str = "one_hot",
             log_features: Sequence[str] | str = (), key: str = "patient_id", derive: bool = True,
             check_log: bool = True, auto_log_skew: float = 0.5) -> PrepModel:
    """Fit imputation, scaling and encoding on ``df`` (the training rows).

    ``log_features='auto'`` chooses log1p columns from the skewness profile
    (|skewness| > ``auto_log_skew``); the choice is stored in the model.
    """
    if imputation not in ("none", "mean", "median", "most_frequent"):
        raise ValueError(f"unknown imputation {imputation!r}")
    missing_t = [t for t in targets if t not in df.columns]
    if missing_t:
        raise KeyError(f"target columns missing: {missing_t}")
    if log_features == "auto":  # I9: log1p for numeric columns whose |skewness| exceeds the threshold
        pre = cohort_ops.derive_features(df) if derive else df
        cand = list(numeric) if numeric is not None else numeric_columns(pre, exclude=[key, *targets, *categorical])
        prof = distribution_profile(pre, cand, skew_threshold=auto_log_skew).filter("log_recommended").collect()
        log_features = [r["column"] for r in prof]
    model = PrepModel([], list(categorical), list(targets), [], imputation, scaling, encoding,
                      list(log_features), derive)
    base = _transform_base(df, model, check_log=check_log)
    num = list(numeric) if numeric is not None else numeric_columns(base, exclude=[key, *targets, *categorical])
    num = [c for c in num if c in base.columns]
    model.numeric = num
    x = base.select(*[C.nan_to_null(F.col(c).cast("double")).alias(c) for c in num],
                    *[F.col(c) for c in categorical if c in base.columns])
    # (a) imputation statistics: one aggregate job for all columns
    impute: dict[str, float | None] = {c: None for c in num}
    stats = {}
    if imputation in ("none", "mean") and num:
        # one pass: mean imputation keeps mean, min and max, and turns the population variance
        # into var * n_nonnull / n (imputed points add no squared deviation)
        aggs = [F.count(F.lit(1)).alias("__n")]
        for c in num:
            aggs += [F.avg(c).alias(f"{c}__mu"), F.var_pop(c).alias(f"{c}__var"), F.count(c).alias(f"{c}__cnt"),
                     F.min(c).alias(f"{c}__min"), F.max(c).alias(f"{c}__max")]
        row = x.agg(*aggs).first().asDict()
        for c in num:
            var, cnt = row[f"{c}__var"], row[f"{c}__cnt"]
            if imputation == "mean":
                impute[c] = None if row[f"{c}__mu"] is None else float(row[f"{c}__mu"])
                var = None if var is None else var * cnt / row["__n"]
            stats[f"{c}__mu"] = row[f"{c}__mu"]
            stats[f"{c}__sd"] = None if var is None else max(var, 0.0) ** 0.5
            stats[f"{c}__min"], stats[f"{c}__max"] = row[f"{c}__min"], row[f"{c}__max"]
    elif imputation in ("median", "most_frequent") and num:
        long = x.select(*num).unpivot([], num, "column", "value")
        if imputation == "median":
            st = R.exact_percentiles(long, "value", [0.5], ["column"], names=["stat"])
        else:
            st = R.column_modes(long).withColumnRenamed("mode", "stat")
        got = {r["column"]: r["stat"] for r in st.collect()}  # one row per feature
        impute = {c: (None if got.get(c) is None else float(got[c])) for c in num}
    # (b) scaler statistics after imputation: one aggregate job (median / mode imputation only)
    filled = {c: (F.coalesce(F.col(c), F.lit(impute[c])) if impute[c] is not None else F.col(c)) for c in num}
    if num and not stats:
        aggs = []
        for c in num:
            aggs += [F.avg(filled[c]).alias(f"{c}__mu"), F.stddev_pop(filled[c]).alias(f"{c}__sd"),
                     F.min(filled[c]).alias(f"{c}__min"), F.max(filled[c]).alias(f"{c}__max")]
        stats = x.agg(*aggs).first().asDict()
    lo, hi = minmax_range
    for c in num:
        mu, sd, mn, mx = (stats[f"{c}__mu"], stats[f"{c}__sd"], stats[f"{c}__min"], stats[f"{c}__max"])
        if scaling == "standard":
            centre, scale = mu, (sd if sd not in (None, 0.0) else 1.0)
        else:
            rng = (mx - mn) if (mx is not None and mn is not None) else None
            centre, scale = mn, (rng if rng not in (None, 0.0) else None)
        model.params.append({"feature": c, "kind": "numeric", "impute_value": impute[c], "centre": centre,
                             "scale": scale, "lo": lo, "hi": hi, "source": c})
    # vocabulary: one distributed job for all categorical columns; the fitted state holds every category
    cats = [c for c in categorical if c in base.columns]
    if cats:
        vocab = vocabulary(base, cats).collect()
        for c in cats:
            for r in sorted((r for r in vocab if r["column"] == c), key=lambda r: r["ordinal"]):
                model.params.append({"feature": f"{c}_{r['category']}" if encoding == "one_hot" else c,
                                     "kind": encoding, "category": r["category"], "ordinal": r["ordinal"],
                                     "source": c})
    model.feature_columns = feature_columns(model)
    return model


def feature_columns(model: PrepModel) -> list[str]:
    cols = list(model.numeric)
    for c in model.categorical:
        ps = [p for p in model.params if p.get("source") == c and p["kind"] in ("one_hot", "label")]
        if model.encoding == "one_hot":
            cols += [p["feature"] for p in ps]
        elif ps:
            cols.append(c)
    return cols


def _numeric_expr(p: dict, col: Column, scaling: str) -> Column:
    x = col
    if p["impute_value"] is not None:
        x = F.coalesce(x, F.lit(p["impute_value"]))
    if p["centre"] is None:
        return x
    if scaling == "standard":
        return (x - F.lit(p["centre"])) / F.lit(p["scale"])
    if p["scale"] is None:  # constant column -> lower bound
        return F.when(x.isNotNull(), F.lit(p["lo"]))
    return (x - F.lit(p["centre"])) / F.lit(p["scale"]) * F.lit(p["hi"] - p["lo"]) + F.lit(p["lo"])


def apply_prep(df: DataFrame, model: PrepModel, *, key: str = "patient_id", keep_targets: bool = True,
               on_unseen: str = "error", check_log: bool = True, passthrough: Sequence[str] = ()) -> DataFrame:
    """Apply fitted parameters; output ``key``, features in fitted order, then targets.

    Missing numeric inputs are NULL before impute/scale; a fitted feature that
    cannot be produced is 0.0; extra columns are dropped unless named in
    ``passthrough`` (carried unchanged after the targets).  A category that label
    encoding has not seen fails the job, or is NULL with ``on_unseen="null"``.
    """
    base = _transform_base(df, model, check_log=check_log)
    out: list[Column] = [F.col(key)] if key in base.columns else []
    for p in model.params:
        if p["kind"] != "numeric":
            continue
        src = p["source"]
        col = C.nan_to_null(F.col(src).cast("double")) if src in base.columns else F.lit(None).cast("double")
        out.append(_numeric_expr(p, col, model.scaling).alias(p["feature"]))
    for c in model.categorical:
        ps = [p for p in model.params if p.get("source") == c and p["kind"] in ("one_hot", "label")]
        present = c in base.columns
        val = F.coalesce(F.col(c).cast("string"), F.lit(MISSING)) if present else F.lit(None).cast("string")
        if model.encoding == "one_hot":
            for p in ps:
                out.append((F.coalesce(val == F.lit(p["category"]), F.lit(False))).cast("double")
                           .alias(p["feature"]))
        elif ps:
            m = F.create_map(*[x for p in ps for x in (F.lit(p["category"]), F.lit(p["ordinal"]))])
            code = m[val]
            if on_unseen == "error":
                code = F.when(code.isNull(), F.raise_error(F.concat(F.lit(f"unseen category in {c}: "), val))) \
                    .otherwise(code)
            out.append(code.cast("double").alias(c))
    produced = {p["feature"] for p in model.params if p["kind"] == "numeric"} | {
        p["feature"] for p in model.params if p["kind"] == "one_hot"} | (
        set(model.categorical) if model.encoding == "label" else set())
    for fcol in model.feature_columns:
        if fcol not in produced:
            out.append(F.lit(0.0).alias(fcol))
    if keep_targets:
        out += [F.col(t) for t in model.targets if t in base.columns]
    out += [F.col(c) for c in passthrough if c in base.columns]
    return base.select(*out)


# ----------------------------------------------------------- statistics tables
def _long(row: dict, cols: Sequence[str], stats: Sequence[str], spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([(c, *[row[f"{c}__{s}"] for s in stats]) for c in cols], schema)


def impute_statistics(df: DataFrame, cols: Sequence[str], approx: bool = False, accuracy: int = 10_000) -> DataFrame:
    """Long (column, mean, median, mode); mode keeps the lowest value on ties.

    The median is exact (distributed order statistic) unless ``approx``, which
    uses ``percentile_approx`` (one pass, bounded sketch, rank error <= n/accuracy).
    """
    long = _long_values(df, cols).persist()  # read the input once for the three statistics
    means = long.groupBy("column").agg(F.avg("value").alias("mean"))
    med = (long.groupBy("column").agg(F.percentile_approx("value", 0.5, accuracy).cast("double").alias("median"))
           if approx else R.exact_percentiles(long, "value", [0.5], ["column"], names=["median"]))
    modes = R.column_modes(long)
    # three tables with one row per column: joins of bounded size, materialised before unpersisting
    res = means.join(med, "column", "left").join(modes, "column", "left").select("column", "mean", "median", "mode")
    rows = res.collect()
    long.unpersist()
    return df.sparkSession.createDataFrame(rows, "column string, mean double, median double, mode double")


def _long_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    x = df.select(*[C.nan_to_null(F.col(c).cast("double")).alias(c) for c in cols])
    return x.unpivot([], list(cols), "column", "value")


def _unpivot_stats(wide: DataFrame, cols: Sequence[str], stats: Sequence[str]) -> DataFrame:
    """Wide one-row statistics -> long table, staying in Spark (array of structs + inline)."""
    rows = F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"{c}__{s}").cast("double").alias(s)
                                                           for s in stats]) for c in cols])
    return wide.select(F.inline(rows))


def scaler_statistics(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Long (column, mean, std_pop, scale, min, max, range): population std, zero std -> scale 1."""
    x = df.select(*[C.nan_to_null(F.col(c).cast("double")).alias(c) for c in cols])
    aggs = []
    for c in cols:
        sd = F.stddev_pop(c)
        aggs += [F.avg(c).alias(f"{c}__mean"), sd.alias(f"{c}__std_pop"),
                 F.coalesce(F.nullif(sd, F.lit(0.0)), F.lit(1.0)).alias(f"{c}__scale"),
                 F.min(c).alias(f"{c}__min"), F.max(c).alias(f"{c}__max"),
                 F.nullif(F.max(c) - F.min(c), F.lit(0.0)).alias(f"{c}__range")]
    return _unpivot_stats(x.agg(*aggs), cols, ["mean", "std_pop", "scale", "min", "max", "range"])


def vocabulary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Long (column, category, ordinal): sorted distinct per column, NULL -> "missing".

    The ordinal is a window partitioned by column over the distinct categories
    (one row each, however many rows hold them).
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("column"),
                               F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias("category")) for c in cols])
    parts = df.select(F.inline(pairs)).distinct()  # one shuffle for all columns (partial distinct map-side)
    from pyspark.sql import Window
    w = Window.partitionBy("column").orderBy("category")
    return parts.withColumn("ordinal", (F.dense_rank().over(w) - 1).cast("int"))


def distribution_profile(df: DataFrame, cols: Sequence[str], skew_threshold: float = 0.5) -> DataFrame:
    """Long (column, n, mean, variance, skewness, median, log_recommended) in one aggregate."""
    x = df.select(*[C.nan_to_null(F.col(c).cast("double")).alias(c) for c in cols])
    aggs = []
    for c in cols:
        aggs += [F.count(c).alias(f"{c}__n"), F.avg(c).alias(f"{c}__mean"),
                 F.var_samp(c).alias(f"{c}__variance"), F.skewness(c).alias(f"{c}__skewness")]
    vals = _long_values(df, cols).persist()
    long = _unpivot_stats(x.agg(*aggs), cols, ["n", "mean", "variance", "skewness"])
    med = R.exact_percentiles(vals, "value", [0.5], ["column"], names=["median"])
    rows = long.join(med, "column", "left").collect()  # one row per column
    vals.unpersist()
    long = df.sparkSession.createDataFrame(
        rows, "column string, n double, mean double, variance double, skewness double, median double")
    return long.select("column", F.col("n").cast("bigint").alias("n"), "mean", "variance", "skewness", "median",
                       F.coalesce(F.abs("skewness") > skew_threshold, F.lit(False)).alias("log_recommended"))

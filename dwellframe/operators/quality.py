"""Row checks: range rules, guard bands, required fields, chronology, completeness.

All checks are narrow (per-row) expressions or a broadcast join with a
dimension table of fixed size; none shuffles the patient table.  Violations
come back as long tables (one row per offending value) that stay distributed.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clinical as C
from ..session import ensure_checkpoint_dir

# The 14 fields the calculator requires, and its BMI warning band.
REQUIRED_FIELDS: tuple[str, ...] = (
    "age", "height_cm", "weight_kg", "bmi", "charlson_index", "pdf_osmolarity",
    "dwell_time_minutes", "pdf_urea", "pdf_creatinine", "pdf_protein",
    "urine_protein_creatinine", "blood_creatinine", "blood_albumin", "blood_protein",
)
BMI_WARN_RANGE = (10.0, 60.0)

DEFAULT_CHRONOLOGY: tuple[tuple[str, str], ...] = (
    ("egfr_date", "pd_start_date"),
    ("tki_date", "pd_start_date"),
    ("pd_start_date", "assessment_date"),
)


def _num(c: str) -> Column:
    return C.nan_to_null(F.col(c).try_cast("double"))


def range_violations(df: DataFrame, rules: Mapping[str, tuple[float, float]], key: str = "patient_id",
                     mode: str = "flag") -> DataFrame:
    """Values outside inclusive ``[min, max]`` as (key, field, value, min, max).

    Absent columns are skipped; NULL/NaN never violate; the column itself is
    not changed.  ``mode='flag'`` returns the violations frame. ``'fail'`` writes
    it whole to the shared checkpoint folder and raises ``ValueError`` with the
    exact count of each field and that path; without violations it returns ``df``.
    """
    items = []
    for field, (lo, hi) in rules.items():
        if field not in df.columns:
            continue
        v = _num(field)
        items.append(F.when(v.isNotNull() & ((v < lo) | (v > hi)),
                            F.struct(F.lit(field).alias("field"), v.alias("value"),
                                     F.lit(float(lo)).alias("min"), F.lit(float(hi)).alias("max"))))
    if not items:
        return df.sparkSession.createDataFrame(
            [], f"{key} {dict(df.dtypes)[key]}, field string, value double, min double, max double")
    out = (df.select(key, F.explode(F.filter(F.array(*items), lambda x: x.isNotNull())).alias("v"))
           .select(key, "v.field", "v.value", "v.min", "v.max"))
    if mode == "fail":
        spark = df.sparkSession
        path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/range-violations-{uuid.uuid4().hex}"
        out.write.parquet(path)
        bad = spark.read.parquet(path).groupBy("field", "min", "max").agg(F.count(F.lit(1)).alias("n")).orderBy("field").collect()
        if bad:
            said = "; ".join(f"{r['field']}: {r['n']} outside [{r['min']}, {r['max']}]" for r in bad)
            raise ValueError(f"out of range ({said}); all violations are in {path}")
        return df
    return out


def complete_case(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Drop rows NULL (or NaN) in any required column that exists."""
    subset = [c for c in required if c in df.columns]
    if not subset:
        return df
    return df.na.drop(subset=subset)


def target_present(df: DataFrame, target: str) -> DataFrame:
    if target not in df.columns:
        raise KeyError(f"there is no column {target!r} to select targets by")
    return df.filter(F.col(target).isNotNull() & ~F.isnan(F.col(target)))


def guard_warnings(long_values: DataFrame, guards: DataFrame, key: str = "patient_id") -> DataFrame:
    """Equi join on field + theta on bounds: one row per value outside its guard band.

    ``long_values`` is (key, field, value); ``guards`` is (field, min, max), a
    fixed-size dimension, broadcast.  Non-finite values never warn; bounds are
    inclusive (a value equal to min or max is fine).
    """
    g = guards.alias("g")
    v = long_values.alias("v")
    cond = (F.col("v.field") == F.col("g.field")) & C.is_finite(F.col("v.value")) & (
        (F.col("v.value") < F.col("g.min")) | (F.col("v.value") > F.col("g.max")))
    j = v.join(g, cond, "inner")
    below = F.col("v.value") < F.col("g.min")
    bound = F.when(below, F.col("g.min")).otherwise(F.col("g.max"))
    return j.select(
        F.col(f"v.{key}").alias(key), F.col("v.field").alias("field"), F.col("v.value").alias("value"),
        F.when(below, F.lit("below")).otherwise(F.lit("above")).alias("kind"),
        bound.alias("bound"),
        F.format_string("%s %s guard %s (%s).", F.regexp_replace(F.col("v.field"), "_", " "),
                        F.when(below, F.lit("below")).otherwise(F.lit("above")),
                        F.when(below, F.lit("minimum")).otherwise(F.lit("maximum")),
                        number_text(bound)).alias("message"))


def number_text(c) -> Column:
    """JS-like ``String(number)`` for guard bounds: integers without '.0'."""
    c = C._c(c)
    return F.when(c == F.floor(c), c.cast("bigint").cast("string")).otherwise(c.cast("string"))


def to_long(df: DataFrame, fields: Sequence[str], key: str = "patient_id") -> DataFrame:
    """Unpivot numeric fields to (key, field, value)."""
    present = [f for f in fields if f in df.columns]
    return df.select(key, *[F.col(f).cast("double").alias(f) for f in present]).unpivot(
        key, present, "field", "value")


def required_missing(df: DataFrame, fields: Sequence[str] = REQUIRED_FIELDS) -> Column:
    """array<string> of required fields that are NULL/NaN/absent (0 is present)."""
    items = []
    for f in fields:
        if f in df.columns:
            v = F.col(f).cast("double")
            items.append(F.when(v.isNull() | F.isnan(v), F.lit(f)))
        else:
            items.append(F.lit(f))
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def record_errors(osmolarity: str = "pdf_osmolarity", dwell: str = "dwell_time_minutes") -> Column:
    """Blocking errors: osmolarity or dwell not computable."""
    return F.filter(F.array(
        F.when(~C.is_finite(F.col(osmolarity)), F.lit(osmolarity)),
        F.when(~C.is_finite(F.col(dwell)), F.lit(dwell))), lambda x: x.isNotNull())


def bmi_warning(bmi: str = "bmi") -> Column:
    b = F.col(bmi)
    lo, hi = BMI_WARN_RANGE
    return C.is_finite(b) & ((b < lo) | (b > hi))


def validity(df: DataFrame, fields: Sequence[str] = REQUIRED_FIELDS) -> DataFrame:
    """Add ``missing``, ``errors``, ``bmi_warning`` and ``is_valid`` (warnings never block)."""
    return (df.withColumn("missing", required_missing(df, fields))
            .withColumn("errors", record_errors())
            .withColumn("bmi_warning", bmi_warning())
            .withColumn("is_valid", (F.size("missing") == 0) & (F.size("errors") == 0)))


def chronology_violations(df: DataFrame, pairs: Sequence[tuple[str, str]] = DEFAULT_CHRONOLOGY,
                          key: str = "patient_id") -> DataFrame:
    """(key, first_field, second_field, first_date, second_date, days) where first > second."""
    items = []
    types = dict(df.dtypes)
    for a, b in pairs:
        if a in df.columns and b in df.columns:
            kind = C.time_kind(types[a]) if types[a] == types[b] else "timestamp"
            items.append(F.when(F.col(a) > F.col(b), F.struct(
                F.lit(a).alias("first_field"), F.lit(b).alias("second_field"),
                F.col(a).cast("date").alias("first_date"), F.col(b).cast("date").alias("second_date"),
                C.days_between(F.col(a), F.col(b), kind).alias("days"))))
    return (df.select(key, F.explode(F.filter(F.array(*items), lambda x: x.isNotNull())).alias("v"))
            .select(key, "v.*"))


def plausibility(predictions: DataFrame, target_col: str = "target", value_col: str = "y_pred",
                 by: Sequence[str] = ("target", "model"), unknown: str = "raise") -> DataFrame:
    """Per group: all predictions within the target's clinical range (a NULL prediction counts as outside).

    A target without a known range fails the job that reads it; with
    ``unknown="null"`` its group says NULL, and none of its rows counts as outside.
    """
    if unknown not in ("raise", "null"):
        raise ValueError(f"unknown={unknown!r}: raise or null")
    t, v = F.col(target_col), F.col(value_col)
    no_range = F.raise_error(F.concat(F.lit("no clinical range is known for "), F.coalesce(t.cast("string"), F.lit("a missing target"))))
    ok = no_range.cast("boolean") if unknown == "raise" else F.lit(None).cast("boolean")
    for name, (lo, hi) in C.PREDICTION_RANGES.items():
        ok = F.when(t == name, C.in_range(v, lo, hi)).otherwise(ok)
    return (predictions.groupBy(*by)
            .agg(F.bool_and(ok).alias("all_in_range"),
                 F.count_if(~ok).alias("n_outside"), F.count(F.lit(1)).alias("n")))


def validate_prediction_ranges(predictions: DataFrame, target: str, value_col: str = "y_pred") -> bool:
    """True when every prediction lies in the target's inclusive clinical range (one aggregate).

    NULL/NaN count as outside; an empty frame is valid; an unknown target raises ``ValueError``.
    """
    if target not in C.PREDICTION_RANGES:
        raise ValueError(f"no clinical range is known for {target!r}")
    lo, hi = C.PREDICTION_RANGES[target]
    row = predictions.agg(F.coalesce(F.bool_and(C.in_range(F.col(value_col), lo, hi)), F.lit(True)).alias("ok")).first()
    return bool(row["ok"])


def is_missing(df: DataFrame, column: str) -> Column:
    """NULL, or NaN in a column of floating-point numbers: what :func:`complete_case` drops."""
    missing = F.col(column).isNull()
    return missing | F.isnan(F.col(column)) if dict(df.dtypes)[column] in ("double", "float") else missing


def missingness(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One pass: per column NULL count, share missing, and a completeness score (long table; shares are NULL without rows)."""
    cols = list(columns or df.columns)
    aggs = [F.count(F.lit(1)).alias("__n")]
    for c in cols:
        aggs.append(F.count_if(is_missing(df, c)).alias(c))
    wide = df.agg(*aggs)
    long = wide.unpivot("__n", cols, "column", "n_missing")
    return long.select("column", F.col("n_missing").cast("bigint").alias("n_missing"),
                       F.col("__n").alias("n_rows"),
                       F.try_divide("n_missing", "__n").alias("missing_share"),
                       (F.lit(1.0) - F.try_divide("n_missing", "__n")).alias("completeness"))


def row_counts(df: DataFrame, required: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Records ingested, kept by the complete-case rule and dropped, in one pass."""
    present = [c for c in required if c in df.columns]
    ok = F.lit(True)
    for c in present:
        ok = ok & ~is_missing(df, c)
    g = df.groupBy(*by) if by else df.groupBy()
    return g.agg(F.count(F.lit(1)).alias("n_ingested"), F.count_if(ok).alias("n_kept"),
                 F.count_if(~ok).alias("n_dropped"))

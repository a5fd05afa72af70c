"""Queries over the patient table: cohort summary and the clinical scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clinical as C
from ..functions import parse as P
from ..operators import cohort as cohort_ops
from ..operators import quality as Q
from ..sources import dictionaries as D
from ..sources.views import cte
from . import sqlfrag as S
from .common import r6, v
from .registry import query

REQUIRED = ("patient_id", "age", "ktv", "pd_start_date")


@query("cohort_summary", covers=("A13", "H1", "H2", "H5", "H7", "B4", "D11"), sql=cte("cohort") + f"""
select modality, count(*) as n_patients, round(avg(bmi), 6) + 0e0 as mean_bmi,
  round(avg(charlson_index), 6) + 0e0 as mean_cci,
  round(avg(pd_period_days), 6) + 0e0 as mean_pd_period_days,
  round(avg(case when ktv >= 1.7e0 then 1e0 else 0e0 end), 6) + 0e0 as adequacy_share
from (select *, {S.DERIVED} from cohort
      where patient_id is not null and age is not null and ktv is not null and pd_start_date is not null) t
group by modality
""")
def cohort_summary(spark, sf):
    """Flagship: derive features, complete-case filter, per-modality summary (one shuffle)."""
    df = cohort_ops.derive_features(v(spark, sf, "cohort"))
    df = Q.complete_case(df, REQUIRED)
    out = df.groupBy("modality").agg(
        F.count(F.lit(1)).alias("n_patients"), F.avg("bmi").alias("mean_bmi"),
        F.avg("charlson_index").alias("mean_cci"), F.avg("pd_period_days").alias("mean_pd_period_days"),
        F.avg(C.adequate("ktv").cast("double")).alias("adequacy_share"))
    return r6(out)


@query("cohort_view", covers=("A13",), sql=cte("cohort") + "select * from cohort")
def cohort_view(spark, sf):
    return v(spark, sf, "cohort")


@query("bmi_bsa", covers=("H1", "H2", "H3"), sql=cte("cohort") + f"""
select patient_id, round({S.BMI}, 6) + 0e0 as bmi, round({S.BSA}, 6) + 0e0 as bsa,
  round(case when height_cm > 0 then weight_kg / power(height_cm / 100e0, 2) end, 6) + 0e0 as bmi_helper
from cohort""")
def bmi_bsa(spark, sf):
    df = v(spark, sf, "cohort")
    m = C.body_metrics("weight_kg", "height_cm")
    return r6(df.select("patient_id", m["bmi"].alias("bmi"), m["bsa"].alias("bsa"),
                        C.bmi("weight_kg", "height_cm").alias("bmi_helper")))


_CUSTOM = {"any_tumor": 3}
_CCI_CUSTOM_SQL = S.CCI.replace("coalesce(malignancy <> 0, false) then 2", "coalesce(malignancy <> 0, false) then 3")
_CCI_NO_AGE_RENAL = S.CCI.replace(f" + 2 + coalesce({S.AGE_POINTS}, 0)", "")


@query("charlson", covers=("H4", "H5", "C4", "D6"), sql=cte("cohort") + f"""
select patient_id, {S.AGE_POINTS} as age_points, cast({S.CCI} as integer) as charlson_index,
  cast({_CCI_NO_AGE_RENAL} as integer) as cci_no_age_no_renal,
  cast({_CCI_CUSTOM_SQL} as integer) as cci_custom
from cohort""")
def charlson(spark, sf):
    df = v(spark, sf, "cohort")
    codes = cohort_ops.flag_codes_for(df, cohort_ops.COHORT_FLAGS)
    return df.select(
        "patient_id", C.age_points("age").alias("age_points"),
        C.charlson_index(codes, F.col("age")).alias("charlson_index"),
        C.charlson_index(codes, F.col("age"), include_renal=False, include_age=False).alias("cci_no_age_no_renal"),
        C.charlson_index(codes, F.col("age"), weights=_CUSTOM).alias("cci_custom"))


@query("cci_long", covers=("C4", "D6"), sql=cte("cohort") + f"""
select patient_id, cast({S.CCI} as integer) as charlson_index from cohort""")
def cci_long(spark, sf):
    """Long form: unpivot every flag, join the (broadcast) code and weight tables, sum the weights
    of the true flags per patient (one shuffle; every patient keeps its rows, so no join back)."""
    df = v(spark, sf, "cohort")
    codes = cohort_ops.flag_codes_for(df, cohort_ops.COHORT_FLAGS)
    fmap = spark.createDataFrame(list(codes.items()), "flag string, code string")
    weights = D.cci_weights(spark)
    long = (df.select("patient_id", "age", *[F.col(c).cast("double").alias(c) for c in codes])
            .unpivot(["patient_id", "age"], list(codes), "flag", "flag_value")
            .join(F.broadcast(fmap), "flag").join(F.broadcast(weights), "code", "left"))
    w = F.when(C.flag_true(F.col("flag_value")), F.coalesce(F.col("weight"), F.lit(0))).otherwise(F.lit(0))
    per = long.groupBy("patient_id", "age").agg(F.sum(w).alias("w"))
    renal = C.CCI_BASE_WEIGHTS[C.RENAL_CODE]
    return per.select("patient_id", (F.col("w") + F.lit(renal)
                                     + F.coalesce(C.age_points("age"), F.lit(0))).cast("int").alias("charlson_index"))


@query("code_list", covers=("H17",), sql=cte("cohort") + """
select patient_id, concat_ws(',',
  case when coalesce(mi <> 0, false) then 'myocardial_infarction' end,
  case when coalesce(chf <> 0, false) then 'congestive_heart_failure' end,
  case when coalesce(dm_cx <> 0, false) then 'diabetes_with_end_organ_damage' end,
  case when coalesce(malignancy <> 0, false) then 'any_tumor' end) as codes
from cohort""")
def code_list(spark, sf):
    df = v(spark, sf, "cohort")
    codes = cohort_ops.flag_codes_for(df, cohort_ops.COHORT_FLAGS)
    return df.select("patient_id", F.concat_ws(",", C.charlson_code_list(codes)).alias("codes"))


@query("time_intervals", covers=("H7",), sql=cte("cohort") + f"""
select patient_id, {S.FAILURE} as failure_period_days, {S.WAITING} as waiting_period_days,
  {S.PD_PERIOD} as pd_period_days from cohort""")
def time_intervals(spark, sf):
    df = v(spark, sf, "cohort")
    kinds = {c: C.time_kind(t) for c, t in df.dtypes}
    return df.select("patient_id", *[c.alias(n) for n, c in C.time_intervals(kinds=kinds).items()])


@query("log1p", covers=("H8",), sql=cte("cohort") + """
select patient_id, round(case when residual_rf > -1 then ln(1 + residual_rf) end, 6) + 0e0 as log_residual_rf,
  round(case when ktv - 2e0 > -1 then ln(1 + (ktv - 2e0)) end, 6) + 0e0 as log_ktv_shift,
  coalesce(ktv - 2e0 < -1, false) as below_minus_one
from cohort""")
def log1p(spark, sf):
    df = v(spark, sf, "cohort")
    x = F.col("ktv") - 2.0
    return r6(df.select("patient_id", C.log1p_guarded("residual_rf").alias("log_residual_rf"),
                        C.log1p_guarded(x).alias("log_ktv_shift"),
                        F.coalesce(x < -1, F.lit(False)).alias("below_minus_one")))


@query("body_units", covers=("H9", "H10"), sql=cte("intake_units") + """
select patient_id,
  round(case when height_unit = 'cm' then height_value when height_unit = 'in' then height_value * 2.54e0 end, 6) + 0e0 as height_cm,
  round(case when weight_unit = 'kg' then weight_value when weight_unit = 'lb' then weight_value / 2.20462e0 end, 6) + 0e0 as weight_kg
from intake_units""")
def body_units(spark, sf):
    df = v(spark, sf, "intake_units")
    return r6(df.select("patient_id", C.normalize_height("height_value", "height_unit").alias("height_cm"),
                        C.normalize_weight("weight_value", "weight_unit").alias("weight_kg")))


_NUM = r"'^\s*([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)'"
_INT = r"'^\s*([+-]?\d+)'"


@query("parse_numbers", covers=("H13", "H14", "H30"), sql=cte("raw_text") + f"""
select patient_id, line_no,
  case when isfinite(try_cast(nullif(trim(raw_value), '') as double))
       then try_cast(nullif(trim(raw_value), '') as double) end as value_number,
  try_cast(nullif(regexp_extract(raw_value, {_NUM}, 1), '') as double) as value_prefix,
  try_cast(nullif(regexp_extract(raw_count, {_INT}, 1), '') as bigint) as count_prefix,
  coalesce(isfinite(try_cast(nullif(regexp_extract(raw_value, {_NUM}, 1), '') as double)), false) as value_is_finite
from raw_text""")
def parse_numbers(spark, sf):
    df = v(spark, sf, "raw_text")
    pref = P.number_prefix("raw_value")
    return df.select("patient_id", "line_no", P.to_number("raw_value").alias("value_number"),
                     pref.alias("value_prefix"), P.int_prefix("raw_count").alias("count_prefix"),
                     C.is_finite(pref).alias("value_is_finite"))


@query("numeric_coercion", covers=("B1",), sql=cte("raw_text") + """
select patient_id, line_no,
  case when isfinite(try_cast(nullif(trim(raw_value), '') as double))
       then try_cast(nullif(trim(raw_value), '') as double) end as value_number,
  case when isfinite(try_cast(nullif(trim(raw_count), '') as double))
       then try_cast(nullif(trim(raw_count), '') as double) end as count_number
from raw_text""")
def numeric_coercion(spark, sf):
    df = v(spark, sf, "raw_text")
    return df.select("patient_id", "line_no", P.to_number("raw_value").alias("value_number"),
                     P.to_number("raw_count").alias("count_number"))


@query("parse_dates", covers=("H6",), sql=cte("raw_text") + """
select patient_id, line_no,
  cast(coalesce(try_strptime(raw_date, '%Y-%m-%d %H:%M:%S'), try_strptime(raw_date, '%Y-%m-%dT%H:%M:%S'),
                try_strptime(raw_date, '%Y-%m-%d'), try_strptime(raw_date, '%Y/%m/%d'),
                try_strptime(raw_date, '%d.%m.%Y')) as varchar) as parsed
from raw_text""")
def parse_dates(spark, sf):
    df = v(spark, sf, "raw_text")
    return df.select("patient_id", "line_no", P.parse_timestamp("raw_date").cast("string").alias("parsed"))


@query("adequacy_label", covers=("B12", "B5"), sql=cte("cohort") + """
select patient_id, cast(ktv >= 1.7e0 as integer) as adequate from cohort where ktv is not null""")
def adequacy_label(spark, sf):
    df = Q.target_present(v(spark, sf, "cohort"), "ktv")
    return df.select("patient_id", C.adequate("ktv").alias("adequate"))

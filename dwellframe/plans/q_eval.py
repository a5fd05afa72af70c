"""Evaluation queries over the long prediction tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as TX
from ..operators import cohort as cohort_ops
from ..operators import evaluate as EV
from ..sources.views import cte
from . import sqlfrag as S
from .common import r6, v
from .registry import query

MODELS = ("linear", "forest", "boosted")
PRED_OK = "y_true is not null and y_pred is not null"
E = "(y_true - y_pred)"


def _r(x):
    return f"round({x}, 6) + 0e0"


R2_SQL = (f"case when count(*) < 2 then null when var_pop(y_true) * count(*) = 0 then "
          f"case when sum({E} * {E}) = 0 then 1e0 else 0e0 end "
          f"else 1e0 - sum({E} * {E}) / (var_pop(y_true) * count(*)) end")
METRICS_SQL = (f"count(*) as n, {_r(R2_SQL)} as r2, {_r(f'avg(abs({E}))')} as mae, "
               f"{_r(f'avg({E} * {E})')} as mse")


def _metrics(spark, sf):
    return EV.regression_metrics(v(spark, sf, "predictions"))


@query("regression_metrics", covers=("D8", "C7", "J15"), sql=cte("predictions") + f"""
select target, model, {METRICS_SQL} from predictions where {PRED_OK} group by target, model""")
def regression_metrics(spark, sf):
    return r6(_metrics(spark, sf))


@query("subgroup_metrics", covers=("D16",), sql=cte("predictions") + f"""
select model, gender, {METRICS_SQL} from predictions where {PRED_OK} group by cube(model, gender)""")
def subgroup_metrics(spark, sf):
    return r6(EV.subgroup_metrics(v(spark, sf, "predictions"), ("model", "gender")))


@query("subgroup_bands", covers=("D16",), sql=cte("predictions", "cohort", extra=[("pb", f"""
select p.target, p.model, p.y_true, p.y_pred,
  case when c.age is null then 'unknown' when c.age < 50 then '-..50' when c.age < 65 then '50..65' else '65..' end as age_band,
  case when c.cci is null then 'unknown' when c.cci < 3 then '-..3' when c.cci < 5 then '3..5' else '5..' end as comorbidity_band
from predictions p join (select patient_id, age, {S.CCI} as cci from cohort) c on p.patient_id = c.patient_id""")]) + f"""
select target, model, age_band, comorbidity_band, {METRICS_SQL} from pb where {PRED_OK}
group by cube(target, model, age_band, comorbidity_band)""")
def subgroup_bands(spark, sf):
    """Error metrics of every combination of target, model, age band and comorbidity band, and their totals."""
    bands = EV.with_bands(cohort_ops.derive_features(v(spark, sf, "cohort"))).select("patient_id", "age_band", "comorbidity_band")
    pred = v(spark, sf, "predictions").join(bands, "patient_id")
    return r6(EV.subgroup_metrics(pred, ("target", "model", "age_band", "comorbidity_band")))


@query("icc", covers=("D9",), sql=cte("predictions") + f"""
select target, model, n, {_r('(msr - mse) / (msr + mse + 2 * (msc - mse) / n)')} as icc from (
  select target, model, n, msr, msc, (sst - msr * (n - 1) - msc) / (n - 1) as mse from (
    select target, model, count(*) as n, 2 * var_samp((y_true + y_pred) / 2) as msr,
      count(*) * power(avg(y_true) - avg(y_pred), 2) / 2 as msc,
      sum(y_true * y_true + y_pred * y_pred) - 2 * count(*) * power((avg(y_true) + avg(y_pred)) / 2, 2) as sst
    from predictions where {PRED_OK} group by target, model) a) b""")
def icc(spark, sf):
    return r6(EV.icc_2_1(v(spark, sf, "predictions")))


@query("calibration_bins", covers=("D10", "E5"), sql=cte("predictions") + f"""
select target, model, bin, count(*) as n, {_r('avg(y_pred)')} as mean_pred, {_r('avg(y_true)')} as mean_obs
from (select *, cast(ntile(10) over (partition by target, model order by y_pred, patient_id) as integer) as bin
      from predictions where {PRED_OK}) t group by target, model, bin""")
def calibration_bins(spark, sf):
    return r6(EV.calibration_bins(v(spark, sf, "predictions"), 10))


@query("adequacy_share", covers=("D11",), sql=cte("predictions") + f"""
select target, model, {_r('avg(case when y_pred >= 1.7e0 then 1e0 else 0e0 end)')} as share_pred,
  {_r('avg(case when y_true >= 1.7e0 then 1e0 else 0e0 end)')} as share_true,
  count(case when y_pred >= 1.7e0 and y_true >= 1.7e0 then 1 end) as tp,
  count(case when y_pred >= 1.7e0 and y_true < 1.7e0 then 1 end) as fp,
  count(case when y_pred < 1.7e0 and y_true >= 1.7e0 then 1 end) as fn,
  count(case when y_pred < 1.7e0 and y_true < 1.7e0 then 1 end) as tn
from predictions where {PRED_OK} group by target, model""")
def adequacy_share(spark, sf):
    return r6(EV.adequacy_share(v(spark, sf, "predictions")))


@query("kappa", covers=("D13",), sql=cte("pet_scores") + """
select n, round(1e0 - sum(w * o) / sum(w * r * c / n), 6) + 0e0 as kappa from (
  select cast(t.n as bigint) as n, power(rm.y_class - cm.p_class, 2) as w, rm.r, cm.c, coalesce(ob.o, 0) as o
  from (select y_class, count(*) as r from pet_scores group by y_class) rm
  cross join (select p_class, count(*) as c from pet_scores group by p_class) cm
  cross join (select count(*) as n from pet_scores) t
  left join (select y_class, p_class, count(*) as o from pet_scores group by y_class, p_class) ob
    on ob.y_class = rm.y_class and ob.p_class = cm.p_class) x group by n""")
def kappa(spark, sf):
    return r6(EV.quadratic_kappa(v(spark, sf, "pet_scores")))


@query("confusion_matrix", covers=("D24",), sql=cte("pet_scores") + """
select y_class, p_class, count(*) as n from pet_scores group by y_class, p_class""")
def confusion_matrix(spark, sf):
    return EV.confusion_matrix(v(spark, sf, "pet_scores"))


@query("ece", covers=("D14",), sql=cte("pet_scores") + """
select round(sum(n * abs(acc - conf)) / sum(n), 6) + 0e0 as ece, cast(sum(n) as bigint) as n from (
  select floor(top_prob * 10) as bin, count(*) as n, avg(case when y_class = p_class then 1e0 else 0e0 end) as acc,
    avg(top_prob) as conf from pet_scores where top_prob is not null group by floor(top_prob * 10)) b""")
def ece(spark, sf):
    return r6(EV.expected_calibration_error(v(spark, sf, "pet_scores")))


def _pairs_sql():
    parts = []
    names = sorted(MODELS)  # pairs (a, b) with a < b, as the operator orders discovered models
    for i, a in enumerate(names):
        for b in names[i + 1:]:
            d = f"({a} - {b})"
            parts.append(f"""select target, '{a}' as model_a, '{b}' as model_b, count(*) as n,
  {_r(f'avg({d})')} as mean_diff, {_r(f'stddev_samp({d})')} as sd_diff,
  {_r(f'avg({d}) / (stddev_samp({d}) / sqrt(count(*)))')} as t_stat
  from w where {d} is not null group by target""")
    return " union all ".join(parts)


@query("paired_comparison", covers=("D21",), sql=cte("predictions", extra=[("w", f"""
select target, patient_id, """ + ", ".join(f"max(case when model = '{m}' then abs({E}) end) as {m}" for m in MODELS)
    + f" from predictions where {PRED_OK} group by target, patient_id")]) + _pairs_sql())
def paired_comparison(spark, sf):
    return r6(EV.paired_comparison(v(spark, sf, "predictions")))


@query("comparison_pivot", covers=("D22",), sql=cte("predictions") + "select target, " + ", ".join(
    f"max(case when model = '{m}' then r2 end) as {m}" for m in MODELS)
    + f" from (select target, model, {_r(R2_SQL)} as r2 from predictions where {PRED_OK} group by target, model) t"
    + " group by target")
def comparison_pivot(spark, sf):
    return EV.comparison_pivot(r6(_metrics(spark, sf)), "r2")


@query("champion", covers=("E4",), sql=cte("predictions") + f"""
select target, model, r2 from (
  select target, model, r2, row_number() over (partition by target order by r2 desc nulls last, model) as rn
  from (select target, model, {_r(R2_SQL)} as r2 from predictions where {PRED_OK} group by target, model) m) t
where rn = 1""")
def champion(spark, sf):
    return EV.champion(r6(_metrics(spark, sf)), "r2").select("target", "model", "r2")


@query("median_quantile", covers=("E6", "J9"), sql=cte("quantile_preds") + """
select q.patient_id, q.target, q.model, q.quantile, round(q.y_pred, 6) + 0e0 as y_pred from quantile_preds q join (
  select target, model, quantile from (
    select target, model, quantile, row_number() over (partition by target, model order by abs(quantile - 0.5e0), q_pos) as rn
    from (select distinct target, model, quantile, q_pos from quantile_preds) d) r where rn = 1) p
  on q.target = p.target and q.model = p.model and q.quantile = p.quantile""")
def median_quantile(spark, sf):
    out = EV.median_quantile(v(spark, sf, "quantile_preds"))
    return r6(out.select("patient_id", "target", "model", "quantile", "y_pred"), ["y_pred"])


@query("residual_interval", covers=("J16",), sql=cte("predictions") + f"""
select p.patient_id, p.target, p.model, round(p.y_pred + q.res_lo, 6) + 0e0 as pi_lo,
  round(p.y_pred + q.res_hi, 6) + 0e0 as pi_hi
from predictions p left join (
  select target, model, quantile_cont({E}, 0.025) as res_lo, quantile_cont({E}, 0.975) as res_hi
  from predictions where {PRED_OK} group by target, model) q on p.target = q.target and p.model = q.model""")
def residual_interval(spark, sf):
    out = EV.residual_interval(v(spark, sf, "predictions"), 0.95)
    return r6(out.select("patient_id", "target", "model", "pi_lo", "pi_hi"))


PET_CUTS = (0.5, 0.65, 0.81)


@query("pet_class", covers=("J17", "H23"), sql=cte("cohort") + f"""
select patient_id, cls as pet_class,
  case cls when 0 then 'Low' when 1 then 'Low Average' when 2 then 'High Average' when 3 then 'High'
    else 'Class ' || cast(cls as varchar) end as pet_label
from (select patient_id, case when pet is null then null when pet < {PET_CUTS[0]}e0 then 0
  when pet < {PET_CUTS[1]}e0 then 1 when pet < {PET_CUTS[2]}e0 then 2 else 3 end as cls from cohort) t""")
def pet_class(spark, sf):
    df = v(spark, sf, "cohort").select("patient_id", EV.pet_class("pet", PET_CUTS).alias("pet_class"))
    return df.withColumn("pet_label", TX.class_label(F.col("pet_class")))


@query("class_label", covers=("H23",), sql=cte("pet_scores") + """
select patient_id, cast(y_class + p_class as integer) as idx,
  case y_class + p_class when 0 then 'Low' when 1 then 'Low Average' when 2 then 'High Average' when 3 then 'High'
    else 'Class ' || cast(y_class + p_class as varchar) end as label
from pet_scores""")
def class_label(spark, sf):
    p = v(spark, sf, "pet_scores").select("patient_id", (F.col("y_class") + F.col("p_class")).cast("int").alias("idx"))
    return p.withColumn("label", TX.class_label(F.col("idx")))


@query("bootstrap_interval", covers=("D21",))
def bootstrap_interval(spark, sf):
    """Poisson-bootstrap 95% intervals of MAE per model: replicate weights from a seeded key hash,
    all replicates summed in one aggregate (no row duplication)."""
    return EV.poisson_bootstrap_mae(v(spark, sf, "predictions"), n_boot=100, seed=42)

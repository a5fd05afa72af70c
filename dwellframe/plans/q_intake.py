"""Queries for row checks and intake derivations (shifts, labs, dwell, wide record)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parse as P
from ..operators import intake as I
from ..operators import quality as Q
from ..sources import dictionaries as D
from ..sources.views import cte
from . import sqlfrag as S
from .common import FACTORS_SQL, GUARDS_SQL, LAB_UNITS_SQL, r6, v
from .registry import query

# ----------------------------------------------------------------- oracle CTEs
_INT = r"'^\s*([+-]?\d+)'"
SHIFT_CTES = [
    ("sj", """select s.patient_id, b.osm, s.volume_l * cast(s.cycles as double) as vol,
  coalesce(s.bag_no is not null and b.osm is not null and isfinite(b.osm) and s.volume_l > 0 and s.cycles > 0, false) as ok
  from shifts s left join bags_num b on s.bag_no = b.bag_no"""),
    ("sagg", """select patient_id, sum(case when ok then osm * vol end) as weighted_osm,
  sum(case when ok then vol end) as total_volume_l, count(case when ok then 1 end) as n_valid_shifts, count(*) as n_shifts
  from sj group by patient_id"""),
]
OSM_CTES = SHIFT_CTES + [
    ("osm", """select r.patient_id, r.modality,
  case upper(r.modality) when 'CAPD' then bc.osm when 'NIPD' then a.shift_osmolarity
    when 'CCPD' then case when r.ccpd_day_bag_no is not null then bd.osm else a.shift_osmolarity end end as pdf_osmolarity,
  case when r.modality is null then 'Select modality'
    when upper(r.modality) = 'CAPD' then case when r.capd_bag_no is null then 'Select bag' when bc.osm is null then 'Unknown bag' end
    when upper(r.modality) = 'NIPD' then case when a.shift_osmolarity is null then 'Add night cycles' end
    when upper(r.modality) = 'CCPD' then case when r.ccpd_day_bag_no is not null then (case when bd.osm is null then 'Unknown bag' end)
      when a.shift_osmolarity is null then 'Add night cycles' end
    else 'Unsupported modality' end as osm_reason
  from regimen r left join bags_num bc on r.capd_bag_no = bc.bag_no
  left join bags_num bd on r.ccpd_day_bag_no = bd.bag_no
  left join (select patient_id, case when total_volume_l > 0 then weighted_osm / total_volume_l end as shift_osmolarity
             from sagg) a on r.patient_id = a.patient_id"""),
]
CONV_CTES = [
    ("conv0", f"""select l.patient_id, l.analyte, l.value,
  coalesce(nullif(trim(u.expected), ''), nullif(trim(l.unit), '')) as to_unit,
  coalesce(nullif(trim(l.unit), ''), nullif(trim(u.expected), '')) as from_unit
  from labs_long l left join {LAB_UNITS_SQL} u on l.analyte = u.analyte"""),
    ("conv1", f"""select c.*, f.factor, f.op, coalesce(lower(c.from_unit) = lower(c.to_unit), false) as same
  from conv0 c left join {FACTORS_SQL} f
  on c.analyte = f.analyte and lower(c.from_unit) = f.from_unit and lower(c.to_unit) = f.to_unit"""),
    ("conv", """select patient_id, analyte, value, from_unit, to_unit,
  case when value is null then null when factor is null or same then value
       when op = 'mul' then value * factor else value / factor end as value_converted,
  coalesce(factor is not null and not same and value is not null, false) as converted,
  not coalesce(lower(from_unit) = lower(to_unit), from_unit is null and to_unit is null) as unit_changed
  from conv1"""),
]
LW_CTES = CONV_CTES + [
    ("lw", "select patient_id, " + ", ".join(
        f"avg(case when analyte = '{a}' then value_converted end) as {a}" for a in D.LAB_FIELDS)
     + " from conv group by patient_id"),
]


def _tp(col):
    return f"try_cast(nullif(regexp_extract(split_part({col}, ':', {{i}}), {_INT}, 1), '') as bigint)"


DWELL_CTES = [
    ("dw0", f"""select patient_id, {_tp('inflow').format(i=1)} as ih, {_tp('inflow').format(i=2)} as im,
  {_tp('outflow').format(i=1)} as oh, {_tp('outflow').format(i=2)} as om from times"""),
    ("dw", """select patient_id, cast(case when ih between 0 and 23 and im between 0 and 59
      and oh between 0 and 23 and om between 0 and 59 then
      case when (oh * 60 + om) - (ih * 60 + im) <= 0 then (oh * 60 + om) - (ih * 60 + im) + 1440
           else (oh * 60 + om) - (ih * 60 + im) end end as integer) as dwell_time_minutes from dw0"""),
]
REC_CTES = OSM_CTES + LW_CTES + DWELL_CTES + [
    ("rec", f"""select c.patient_id, c.age, c.height_cm, c.weight_kg, {S.BMI.replace('weight_kg', 'c.weight_kg').replace('height_cm', 'c.height_cm')} as bmi,
  cast({S.CCI} as integer) as charlson_index, o.pdf_osmolarity, d.dwell_time_minutes,
  {', '.join('lw.' + a for a in D.LAB_FIELDS)}
  from cohort c left join osm o on c.patient_id = o.patient_id
  left join dw d on c.patient_id = d.patient_id left join lw on c.patient_id = lw.patient_id"""),
]
REC_VIEWS = ("cohort", "regimen", "shifts", "bags_num", "times", "labs_long")


def _record(spark, sf):
    return I.derived_record(v(spark, sf, "cohort"), v(spark, sf, "regimen"), v(spark, sf, "shifts"),
                            v(spark, sf, "times"), v(spark, sf, "labs_long"), D.bags(spark),
                            D.lab_units(spark), D.unit_factors(spark))


@query("derived_meta", covers=("H19", "H17", "H18"), sql=cte(*REC_VIEWS, extra=REC_CTES) + """
select r.patient_id, concat_ws(',',
    case when coalesce(c.mi <> 0, false) then 'myocardial_infarction' end,
    case when coalesce(c.chf <> 0, false) then 'congestive_heart_failure' end,
    case when coalesce(c.dm_cx <> 0, false) then 'diabetes_with_end_organ_damage' end,
    case when coalesce(c.malignancy <> 0, false) then 'any_tumor' end) as comorbidity_codes,
  o.osm_reason, t.inflow || ' → ' || t.outflow as dwell_source
from rec r join cohort c on r.patient_id = c.patient_id left join osm o on r.patient_id = o.patient_id
left join times t on r.patient_id = t.patient_id""")
def derived_meta(spark, sf):
    """The ``_meta`` part of the derived record: comorbidity codes, why osmolarity is missing, source of the dwell time."""
    rec = I.derived_record(v(spark, sf, "cohort"), v(spark, sf, "regimen"), v(spark, sf, "shifts"), v(spark, sf, "times"),
                           v(spark, sf, "labs_long"), D.bags(spark), D.lab_units(spark), D.unit_factors(spark), with_meta=True)
    return rec.select("patient_id", F.concat_ws(",", "_meta.comorbidity_codes").alias("comorbidity_codes"),
                      F.col("_meta.osm_reason").alias("osm_reason"), F.col("_meta.dwell_source").alias("dwell_source"))


# -------------------------------------------------------------------- quality
RULES = {"age": (18.0, 90.0), "weight_kg": (40.0, 120.0), "ktv": (0.5, 4.0), "pet": (0.1, 1.0)}


@query("range_violations", covers=("B2", "B15"), sql=cte("cohort") + " union all ".join(
    f"select patient_id, '{f}' as field, {f} as value, {lo}e0 as min, {hi}e0 as max from cohort "
    f"where {f} is not null and ({f} < {lo}e0 or {f} > {hi}e0) " for f, (lo, hi) in RULES.items()))
def range_violations(spark, sf):
    return Q.range_violations(v(spark, sf, "cohort"), RULES, mode="flag")


@query("complete_case", covers=("B4", "B5", "A4"), sql=cte("cohort") + """
select patient_id, modality, ktv, pet from cohort
where age is not null and weight_kg is not null and ktv is not null and assessment_date is not null
  and pet is not null""")
def complete_case(spark, sf):
    df = Q.complete_case(v(spark, sf, "cohort"), ["age", "weight_kg", "ktv", "assessment_date"])
    return Q.target_present(df, "pet").select("patient_id", "modality", "ktv", "pet")


@query("row_counts", covers=("D7", "B4"), sql=cte("cohort", extra=[("c", """select *, age is not null and weight_kg is not null and ktv is not null
  and assessment_date is not null and patient_id % 7 <> 0 as kept from cohort""")]) + """
select modality, count(*) as n_ingested, count(case when kept then 1 end) as n_kept, count(case when not kept then 1 end) as n_dropped,
  count(case when kept then 1 end) as n_complete from c group by modality""")
def row_counts(spark, sf):
    """Every seventh weight is NaN: counted as missing, as the complete-case filter drops it."""
    required = ["age", "weight_kg", "ktv", "assessment_date"]
    coh = v(spark, sf, "cohort").withColumn("weight_kg", F.when(F.col("patient_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("weight_kg").cast("double")))
    kept = Q.complete_case(coh, required).groupBy("modality").agg(F.count(F.lit(1)).alias("n_complete"))
    return Q.row_counts(coh, required, by=["modality"]).join(kept.withColumnRenamed("modality", "m"), F.col("modality").eqNullSafe(F.col("m")), "left").drop("m").fillna(0, ["n_complete"])


_MISS_COLS = ("age", "gender", "weight_kg", "height_cm", "malignancy", "esrd_cause", "assessment_date",
              "ktv", "pet")


@query("missingness", covers=("D15",), sql=cte("cohort") + " union all ".join(
    f"select '{c}' as \"column\", count(case when {c} is null then 1 end) as n_missing, count(*) as n_rows, "
    f"round(count(case when {c} is null then 1 end) / count(*), 6) + 0e0 as missing_share, "
    f"round(1e0 - count(case when {c} is null then 1 end) / count(*), 6) + 0e0 as completeness from cohort "
    for c in _MISS_COLS))
def missingness(spark, sf):
    return r6(Q.missingness(v(spark, sf, "cohort"), _MISS_COLS))


@query("chronology_violations", covers=("B8",), sql=cte("cohort") + " union all ".join(
    f"select patient_id, '{a}' as first_field, '{b}' as second_field, {a} as first_date, {b} as second_date, "
    f"cast(date_diff('day', {a}, {b}) as double) as days from cohort where {a} > {b} "
    for a, b in Q.DEFAULT_CHRONOLOGY))
def chronology_violations(spark, sf):
    return Q.chronology_violations(v(spark, sf, "cohort"))


@query("plausibility", covers=("B9",), sql=cte("predictions") + """
select target, model,
  bool_and(case when target = 'ktv' then coalesce(y_pred >= 0.5e0 and y_pred <= 4e0, false)
                when target = 'pet' then coalesce(y_pred >= 0.1e0 and y_pred <= 1e0, false) end) as all_in_range,
  count(case when not case when target = 'ktv' then coalesce(y_pred >= 0.5e0 and y_pred <= 4e0, false)
                           when target = 'pet' then coalesce(y_pred >= 0.1e0 and y_pred <= 1e0, false) end then 1 end) as n_outside,
  count(*) as n
from (select target, model, y_pred from predictions
      union all select 'albumin', model, 1e9 from predictions where target = 'pet'
      union all select 'ktv', 'no value', cast(null as double) from predictions where target = 'pet') p
group by target, model""")
def plausibility(spark, sf):
    """Predictions as given, for a target without a known range, and without a value."""
    pred = v(spark, sf, "predictions").select("target", "model", "y_pred")
    pet = pred.where("target = 'pet'")
    more = pet.select(F.lit("albumin").alias("target"), "model", F.lit(1e9).alias("y_pred")).unionByName(
        pet.select(F.lit("ktv").alias("target"), F.lit("no value").alias("model"), F.lit(None).cast("double").alias("y_pred")))
    return Q.plausibility(pred.unionByName(more), unknown="null")


# --------------------------------------------------------------------- intake
@query("dimension_bags", covers=("A5",), sql=cte("shifts", "bags_num") + """
select b.bag_no, count(s.patient_id) as n_shifts, round(sum(s.volume_l * s.cycles), 6) + 0e0 as total_volume_l,
  b.osm from bags_num b left join shifts s on s.bag_no = b.bag_no group by b.bag_no, b.osm""")
def dimension_bags(spark, sf):
    """Dictionary source (JSON parsed by Spark) joined with shift usage from the given tables."""
    bags = D.bags(spark)
    use = (v(spark, sf, "shifts").groupBy("bag_no")
           .agg(F.count(F.lit(1)).alias("n_shifts"),
                F.sum(F.col("volume_l") * F.col("cycles")).alias("total_volume_l")))
    out = F.broadcast(bags).join(use, "bag_no", "left").select(
        "bag_no", F.coalesce("n_shifts", F.lit(0)).alias("n_shifts"), "total_volume_l", "osm")
    return r6(out)


@query("bag_lookup", covers=("C1",), sql=cte("shifts", "bags_num") + """
select s.patient_id, s.bag_no, s.volume_l, s.cycles, b.osm from shifts s left join bags_num b on s.bag_no = b.bag_no""")
def bag_lookup(spark, sf):
    return I.bag_lookup(v(spark, sf, "shifts"), D.bags(spark)).select(
        "patient_id", "bag_no", "volume_l", "cycles", "osm")


@query("valid_shifts", covers=("B14",), sql=cte("shifts", "bags_num", extra=SHIFT_CTES[:1]) + """
select s.patient_id, s.bag_no, s.volume_l, s.cycles, b.osm from shifts s join bags_num b on s.bag_no = b.bag_no
where s.volume_l > 0 and s.cycles > 0 and isfinite(b.osm)""")
def valid_shifts(spark, sf):
    return I.valid_shifts(v(spark, sf, "shifts"), D.bags(spark)).select(
        "patient_id", "bag_no", "volume_l", "cycles", "osm")


@query("osmolarity", covers=("D5", "H18", "C1", "B14", "L4"),
       sql=cte("regimen", "shifts", "bags_num", extra=OSM_CTES) + """
select patient_id, modality, round(pdf_osmolarity, 6) + 0e0 as pdf_osmolarity, osm_reason from osm""")
def osmolarity(spark, sf):
    return r6(I.osmolarity(v(spark, sf, "regimen"), v(spark, sf, "shifts"), D.bags(spark)))


@query("lab_conversion", covers=("C2", "H11", "H27"), sql=cte("labs_long", extra=CONV_CTES) + """
select patient_id, analyte, value, from_unit, to_unit, round(value_converted, 6) + 0e0 as value_converted,
  converted, unit_changed from conv""")
def lab_conversion(spark, sf):
    out = I.convert_labs(v(spark, sf, "labs_long"), D.lab_units(spark), D.unit_factors(spark))
    return r6(out.select("patient_id", "analyte", "value", "from_unit", "to_unit", "value_converted",
                         "converted", "unit_changed"), ["value_converted"])


@query("labs_wide", covers=("H12",), sql=cte("labs_long", extra=LW_CTES) + "select patient_id, " + ", ".join(
    f"round({a}, 6) + 0e0 as {a}" for a in D.LAB_FIELDS) + " from lw")
def labs_wide(spark, sf):
    conv = I.convert_labs(v(spark, sf, "labs_long"), D.lab_units(spark), D.unit_factors(spark))
    return r6(I.labs_wide(conv))


@query("dwell", covers=("H15", "H16"), sql=cte("times", extra=DWELL_CTES) + """
select t.patient_id, t.inflow, t.outflow, d.dwell_time_minutes from times t join dw d on t.patient_id = d.patient_id""")
def dwell(spark, sf):
    t = v(spark, sf, "times")
    return t.select("patient_id", "inflow", "outflow",
                    P.dwell_minutes(F.col("inflow"), F.col("outflow")).alias("dwell_time_minutes"))


_REC_COLS = ["patient_id", "age", "height_cm", "weight_kg", "bmi", "charlson_index", "pdf_osmolarity",
             "dwell_time_minutes", *D.LAB_FIELDS]


@query("derived_record", covers=("H19", "C9", "L5"), sql=cte(*REC_VIEWS, extra=REC_CTES) + "select "
       + ", ".join(c if c in ("patient_id", "charlson_index", "dwell_time_minutes") else f"round({c}, 6) + 0e0 as {c}"
                   for c in _REC_COLS) + " from rec")
def derived_record(spark, sf):
    return r6(_record(spark, sf).select(*_REC_COLS))


_GUARD_FIELDS = ["age", "height_cm", "weight_kg", *D.LAB_FIELDS]


@query("guard_warnings", covers=("B3", "C3"), sql=cte(*REC_VIEWS, extra=REC_CTES + [
    ("lv", " union all ".join(f"select patient_id, '{f}' as field, cast({f} as double) as value from rec"
                              for f in _GUARD_FIELDS)),
    ("gw", f"""select lv.patient_id, lv.field, lv.value, case when lv.value < g.min then 'below' else 'above' end as kind,
  case when lv.value < g.min then g.min else g.max end as bound
  from lv join {GUARDS_SQL} g on lv.field = g.field and isfinite(lv.value) and (lv.value < g.min or lv.value > g.max)""")]) + """
select patient_id, field, round(value, 6) + 0e0 as value, kind, bound,
  concat(replace(field, '_', ' '), ' ', kind, ' guard ', case when kind = 'below' then 'minimum' else 'maximum' end,
         ' (', case when bound = floor(bound) then cast(cast(bound as bigint) as varchar) else cast(bound as varchar) end, ').') as message
from gw""")
def guard_warnings(spark, sf):
    rec = _record(spark, sf)
    out = Q.guard_warnings(Q.to_long(rec, _GUARD_FIELDS), D.guards(spark))
    return r6(out, ["value"])


_MISSING_SQL = "concat_ws(',', " + ", ".join(f"case when {f} is null then '{f}' end" for f in Q.REQUIRED_FIELDS) + ")"
_NMISS_SQL = " + ".join(f"case when {f} is null then 1 else 0 end" for f in Q.REQUIRED_FIELDS)


@query("required_missing", covers=("B10",), sql=cte(*REC_VIEWS, extra=REC_CTES) + f"""
select patient_id, {_MISSING_SQL} as missing, cast({_NMISS_SQL} as integer) as n_missing from rec""")
def required_missing(spark, sf):
    rec = _record(spark, sf)
    m = Q.required_missing(rec)
    return rec.select("patient_id", F.concat_ws(",", m).alias("missing"), F.size(m).alias("n_missing"))


@query("row_validity", covers=("B11",), sql=cte(*REC_VIEWS, extra=REC_CTES) + f"""
select patient_id, cast({_NMISS_SQL} as integer) as n_missing,
  cast((case when pdf_osmolarity is null then 1 else 0 end) + (case when dwell_time_minutes is null then 1 else 0 end) as integer) as n_errors,
  coalesce(bmi < 10e0 or bmi > 60e0, false) as bmi_warning,
  ({_NMISS_SQL}) = 0 and pdf_osmolarity is not null and dwell_time_minutes is not null as is_valid
from rec""")
def row_validity(spark, sf):
    rec = Q.validity(_record(spark, sf))
    return rec.select("patient_id", F.size("missing").alias("n_missing"), F.size("errors").alias("n_errors"),
                      "bmi_warning", "is_valid")

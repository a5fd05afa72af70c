"""Intake derivations: dialysate osmolarity, lab unit conversion, dwell time, wide record.

Lookups against the dictionaries are broadcast joins (the dictionaries have a
size fixed by configuration).  Per-patient aggregates (osmolarity over shifts,
lab averages) are a single ``groupBy(patient_id)`` each with map-side partial
aggregation, so a patient holding a large share of rows is combined before the
shuffle.  The wide record joins per-patient frames on ``patient_id``; the
aggregated sides arrive hash-partitioned on that key already.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clinical as C
from ..functions import parse as P
from ..sources import dictionaries as D
from . import cohort as cohort_ops


def _as_double(df: DataFrame, c: str, parser) -> Column:
    return parser(F.col(c)) if dict(df.dtypes)[c] == "string" else F.col(c).cast("double")


# --------------------------------------------------------------------- shifts
def bag_lookup(shifts: DataFrame, bags: DataFrame, on: str = "bag_no") -> DataFrame:
    """Left equi-join of shifts with the (broadcast) bag dictionary; unknown bag -> NULL osm."""
    b = bags.select(on, "osm")
    return shifts.join(b, on, "left")


def shift_is_valid(df: DataFrame, bag: str = "bag_no", osm: str = "osm", volume: str = "volume_l",
                   cycles: str = "cycles") -> Column:
    """A shift counts when it has a known bag with finite osmolarity, volume > 0 and count > 0."""
    vol = _as_double(df, volume, P.number_prefix)
    cnt = P.int_prefix(F.col(cycles)) if dict(df.dtypes)[cycles] == "string" else F.col(cycles)
    return F.coalesce(F.col(bag).isNotNull() & C.is_finite(F.col(osm)) & (vol > 0) & (cnt > 0),
                      F.lit(False))


def valid_shifts(shifts: DataFrame, bags: DataFrame) -> DataFrame:
    """Shifts that enter the osmolarity average (bag known, osm finite, volume and count > 0)."""
    j = bag_lookup(shifts, bags)
    return j.filter(shift_is_valid(j))


def shift_osmolarity(shifts: DataFrame, bags: DataFrame, key: str = "patient_id", on: str = "bag_no") -> DataFrame:
    """Per patient: volume-weighted mean osmolarity sum(osm*v*n)/sum(v*n) over valid shifts.

    Zero valid volume -> NULL.  One aggregate with partial (map-side) combine.
    """
    j = bag_lookup(shifts, bags, on)
    ok = shift_is_valid(j, bag=on)
    vol = _as_double(j, "volume_l", P.number_prefix) * F.col("cycles").cast("double")
    return (j.groupBy(key)
            .agg(F.sum(F.when(ok, F.col("osm") * vol)).alias("weighted_osm"),
                 F.sum(F.when(ok, vol)).alias("total_volume_l"),
                 F.count_if(ok).alias("n_valid_shifts"),
                 F.count(F.lit(1)).alias("n_shifts"))
            .withColumn("shift_osmolarity",
                        F.when(F.col("total_volume_l") > 0,
                               F.col("weighted_osm") / F.col("total_volume_l"))))


def osmolarity(regimen: DataFrame, shifts: DataFrame, bags: DataFrame, key: str = "patient_id",
               modality: str = "modality", capd_bag: str = "capd_bag_no",
               day_bag: str = "ccpd_day_bag_no", on: str = "bag_no") -> DataFrame:
    """Modality dispatch (upper-cased): CAPD -> its bag; NIPD -> shifts; CCPD -> day bag if set,
    else night shifts; other -> NULL.  Adds ``pdf_osmolarity`` and ``osm_reason``."""
    agg = shift_osmolarity(shifts, bags, key, on).select(key, "shift_osmolarity", "total_volume_l")
    b = bags.select(on, "osm")
    r = (regimen.join(b.withColumnRenamed(on, capd_bag).withColumnRenamed("osm", "capd_osm"),
                      capd_bag, "left")
         .join(b.withColumnRenamed(on, day_bag).withColumnRenamed("osm", "day_osm"), day_bag, "left")
         .join(agg, key, "left"))
    m = F.upper(F.col(modality))
    capd_val = F.when(C.is_finite(F.col("capd_osm")), F.col("capd_osm"))
    day_val = F.when(C.is_finite(F.col("day_osm")), F.col("day_osm"))
    value = (F.when(m == "CAPD", capd_val)
             .when(m == "NIPD", F.col("shift_osmolarity"))
             .when(m == "CCPD", F.when(F.col(day_bag).isNotNull(), day_val)
                   .otherwise(F.col("shift_osmolarity"))))

    def bag_reason(bag_col, osm_col):
        return (F.when(F.col(bag_col).isNull(), F.lit("Select bag"))
                .when(F.col(osm_col).isNull(), F.lit("Unknown bag")))

    reason = (F.when(F.col(modality).isNull(), F.lit("Select modality"))
              .when(m == "CAPD", bag_reason(capd_bag, "capd_osm"))
              .when(m == "NIPD", F.when(F.col("shift_osmolarity").isNull(), F.lit("Add night cycles")))
              .when(m == "CCPD", F.when(F.col(day_bag).isNotNull(), bag_reason(day_bag, "day_osm"))
                    .when(F.col("shift_osmolarity").isNull(), F.lit("Add night cycles")))
              .otherwise(F.lit("Unsupported modality")))
    return r.select(key, modality, value.alias("pdf_osmolarity"), reason.alias("osm_reason"))


# ----------------------------------------------------------------------- labs
def convert_labs(labs: DataFrame, lab_units: DataFrame, factors: DataFrame,
                 analyte: str = "analyte", value: str = "value", unit: str = "unit") -> DataFrame:
    """Lab values in the configured unit.

    Target unit = configured unit of the analyte, else the row's own unit;
    source unit = trimmed row unit, else the target.  Rule lookup is a left
    equi-join on (analyte, lower(from), lower(to)) with the broadcast factor
    table; no rule or equal units (ignoring case) -> value unchanged.
    """
    u = lab_units.select(F.col("analyte").alias("__a"), F.col("expected").alias("__exp"))
    f = factors.select(F.col("analyte").alias("__fa"), "from_unit", "to_unit", "factor", "op")
    own = F.nullif(F.trim(F.col(unit)), F.lit(""))
    x = labs.join(u, F.col(analyte) == F.col("__a"), "left")
    to_u = F.coalesce(F.nullif(F.trim(F.col("__exp")), F.lit("")), own)
    x = x.withColumn("to_unit_", to_u).withColumn("from_unit_", F.coalesce(own, to_u))
    x = x.join(f, (F.col(analyte) == F.col("__fa"))
               & (F.lower(F.col("from_unit_")) == F.col("from_unit"))
               & (F.lower(F.col("to_unit_")) == F.col("to_unit")), "left")
    v = P.to_number(F.col(value)) if dict(labs.dtypes)[value] == "string" else C.nan_to_null(
        F.col(value).cast("double"))
    same = F.coalesce(F.lower(F.col("from_unit_")) == F.lower(F.col("to_unit_")), F.lit(False))
    rule = F.col("factor").isNotNull() & ~same
    conv = (F.when(~rule, v).when(F.col("op") == "mul", v * F.col("factor"))
            .otherwise(v / F.col("factor")))
    keep = [c for c in labs.columns if c not in (value, unit)]
    return x.select(*keep, v.alias("value"), F.col("from_unit_").alias("from_unit"),
                    F.col("to_unit_").alias("to_unit"),
                    F.when(v.isNotNull(), conv).alias("value_converted"),
                    (rule & v.isNotNull()).alias("converted"),
                    (~F.coalesce(F.lower(F.col("from_unit_")) == F.lower(F.col("to_unit_")),
                                 F.col("from_unit_").isNull() & F.col("to_unit_").isNull()))
                    .alias("unit_changed"),
                    conversion_note(v, F.col("from_unit_"), F.when(v.isNotNull(), conv), F.col("to_unit_")).alias("note"))


def conversion_note(value, from_unit, converted, to_unit) -> Column:
    """"<v> <from> → <converted> <to>" when the units differ (ignoring case), even without a rule; else NULL."""
    from ..functions import text as TX
    differ = ~F.coalesce(F.lower(from_unit) == F.lower(to_unit), from_unit.isNull() & to_unit.isNull())
    return F.when(differ & value.isNotNull(), F.concat_ws(
        " ", TX.adaptive_number(value), F.coalesce(from_unit, F.lit("")), F.lit("→"),
        TX.adaptive_number(converted), F.coalesce(to_unit, F.lit(""))))


def labs_wide(converted: DataFrame, key: str = "patient_id", fields: Sequence[str] = D.LAB_FIELDS,
              value: str = "value_converted") -> DataFrame:
    """Average per (patient, analyte) as one column per analyte.

    The analyte list is fixed by configuration, so this is one conditional
    aggregation (one shuffle on the key, partial aggregation map-side) rather
    than ``pivot``'s two-level aggregation.
    """
    return converted.groupBy(key).agg(*[F.avg(F.when(F.col("analyte") == f, F.col(value))).alias(f)
                                        for f in fields])


# ------------------------------------------------------------------ record
def derived_record(cohort: DataFrame, regimen: DataFrame, shifts: DataFrame, times: DataFrame,
                   labs_long: DataFrame, bags: DataFrame, lab_units: DataFrame, factors: DataFrame,
                   key: str = "patient_id", with_meta: bool = False) -> DataFrame:
    """One wide row per patient: demographics, body metrics, CCI, osmolarity, dwell, labs.

    ``with_meta`` adds ``_meta`` struct<comorbidity_codes, osm_reason, dwell_source>.
    """
    from ..functions import text as TX
    base = cohort_ops.derive_features(cohort)
    osm = osmolarity(regimen, shifts, bags, key)
    dwell = times.select(key, P.dwell_minutes(F.col("inflow"), F.col("outflow")).alias("dwell_time_minutes"),
                         TX.dwell_text("inflow", "outflow").alias("__dwell_src"))
    labs = labs_wide(convert_labs(labs_long, lab_units, factors), key)
    codes = C.charlson_code_list(cohort_ops.flag_codes_for(cohort))
    out = (base.select(key, "age", "height_cm", "weight_kg", "bmi", "charlson_index", codes.alias("__codes"))
           .join(osm.select(key, "pdf_osmolarity", F.col("osm_reason").alias("__osm_reason")), key, "left")
           .join(dwell, key, "left")
           .join(labs, key, "left"))
    if with_meta:
        out = out.withColumn("_meta", F.struct(F.col("__codes").alias("comorbidity_codes"),
                                               F.col("__osm_reason").alias("osm_reason"),
                                               F.col("__dwell_src").alias("dwell_source")))
    return out.drop("__codes", "__osm_reason", "__dwell_src")


# ------------------------------------------------------------ nested records
INTAKE_SCHEMA = (
    "record_id string, "
    "patient struct<age:string,heightValue:string,heightUnit:string,weightValue:string,weightUnit:string>, "
    "comorbidities map<string,boolean>, "
    "regimen struct<modality:string,capdBagId:string,capdVolumeL:string,"
    "nipdShifts:array<struct<bagId:string,volumeL:string,count:string>>,ccpdDayBagId:string,"
    "ccpdNightShifts:array<struct<bagId:string,volumeL:string,count:string>>>, "
    "times struct<inflow:string,outflow:string>, "
    "labs map<string,struct<value:string,unit:string>>"
)


def _literal_map(pairs) -> Column:
    items = [x for k, v in pairs for x in (F.lit(k), F.lit(v))]
    return F.create_map(*items) if items else F.create_map()


def derive_nested(records: DataFrame, bags: DataFrame, lab_units: DataFrame, factors: DataFrame,
                  default_height_unit: str = "cm", default_weight_unit: str = "kg") -> DataFrame:
    """Intake form records (nested, as in ``INTAKE_SCHEMA``) -> one wide derived row each.

    Shifts and labs are short arrays/maps inside one record, so they are
    handled with higher-order functions (``filter``/``aggregate``/map lookups)
    — no explode, no shuffle.  The dictionaries (fixed size) become map
    literals.
    """
    bag_osm = _literal_map((r["bag_id"], float(r["osm"])) for r in bags.select("bag_id", "osm").collect())
    expected = _literal_map((r["analyte"], r["expected"]) for r in lab_units.collect())
    fac = F.create_map(*[x for r in factors.collect() for x in (
        F.lit(f"{r['analyte']}:{r['from_unit']}->{r['to_unit']}"),
        F.struct(F.lit(float(r["factor"])).alias("factor"), F.lit(r["op"]).alias("op")))])

    pt = F.col("patient")
    age = P.to_number(pt["age"])
    h_unit = F.coalesce(F.nullif(pt["heightUnit"], F.lit("")), F.lit(default_height_unit))
    w_unit = F.coalesce(F.nullif(pt["weightUnit"], F.lit("")), F.lit(default_weight_unit))
    height = C.normalize_height(P.to_number(pt["heightValue"]), h_unit)
    weight = C.normalize_weight(P.to_number(pt["weightValue"]), w_unit)
    bmi = F.when(C.is_finite(weight) & C.is_finite(height) & (height > 0), weight / F.pow(height / 100.0, 2))

    com = F.col("comorbidities")
    w = C.CCI_BASE_WEIGHTS
    cci = F.lit(0)
    for flag, code in C.CALCULATOR_FLAG_CODES.items():
        cci = cci + F.when(F.coalesce(com[flag], F.lit(False)), F.lit(w.get(code, 0))).otherwise(F.lit(0))
    cci = (cci + F.lit(w[C.RENAL_CODE]) + F.coalesce(F.when(C.is_finite(age), C.age_points(age)), F.lit(0))).cast("int")

    def shifts_mean(arr):
        def vol(s):
            return P.number_prefix(s["volumeL"])

        def cnt(s):
            return P.int_prefix(s["count"])

        ok = F.filter(F.coalesce(arr, F.array().cast(arr_type)), lambda s: F.coalesce(
            (F.coalesce(s["bagId"], F.lit("")) != "") & bag_osm[s["bagId"]].isNotNull() & (vol(s) > 0) & (cnt(s) > 0),
            F.lit(False)))
        tot = F.aggregate(ok, F.lit(0.0), lambda a, s: a + vol(s) * cnt(s))
        wsum = F.aggregate(ok, F.lit(0.0), lambda a, s: a + bag_osm[s["bagId"]] * vol(s) * cnt(s))
        return F.when(tot > 0, wsum / tot)

    arr_type = "array<struct<bagId:string,volumeL:string,count:string>>"
    rg = F.col("regimen")
    m = F.upper(rg["modality"])
    has = lambda c: F.coalesce(c != "", F.lit(False))
    osm = (F.when(m == "CAPD", F.when(has(rg["capdBagId"]), bag_osm[rg["capdBagId"]]))
           .when(m == "NIPD", shifts_mean(rg["nipdShifts"]))
           .when(m == "CCPD", F.when(has(rg["ccpdDayBagId"]), bag_osm[rg["ccpdDayBagId"]])
                 .otherwise(shifts_mean(rg["ccpdNightShifts"]))))

    tm = F.col("times")
    dwell = F.when(has(tm["inflow"]) & has(tm["outflow"]), P.dwell_minutes(tm["inflow"], tm["outflow"]))

    labs = {}
    for field in D.LAB_FIELDS:
        payload = F.col("labs")[field]
        to_u = F.trim(F.coalesce(F.nullif(expected[field], F.lit("")), F.nullif(payload["unit"], F.lit("")), F.lit("")))
        from_u = F.trim(F.coalesce(F.nullif(payload["unit"], F.lit("")), to_u))
        v = P.to_number(payload["value"])
        rule = fac[F.concat(F.lit(field + ":"), F.lower(from_u), F.lit("->"), F.lower(to_u))]
        same = F.lower(from_u) == F.lower(to_u)
        conv = (F.when((from_u == "") | (to_u == "") | same | rule.isNull(), v)
                .when(rule["op"] == "mul", v * rule["factor"]).otherwise(v / rule["factor"]))
        labs[field] = F.when(payload.isNotNull() & v.isNotNull(), conv)

    return records.select("record_id", age.alias("age"), height.alias("height_cm"), weight.alias("weight_kg"),
                          bmi.alias("bmi"), cci.alias("charlson_index"), osm.alias("pdf_osmolarity"),
                          dwell.alias("dwell_time_minutes"), *[c.alias(k) for k, c in labs.items()])

"""CRF export scan queries: the cohort written as a two-row-header CSV folder, then ingested."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import crf
from ..sources import sinks
from ..sources.views import cte
from .common import v
from .registry import query

GROUPS = ["", "Person", "", "Measures", "Therapy", "Result"]
FIELDS = ["Record", " Years of life ", "Sex", "Mass kg", "First exchange", "Weekly clearance"]
NOTE = ',\n"see note"\n'
RENAMES = {"Unnamed: 0_level_0::Record": "patient_id", "Person::Years of life": "age", "Measures::Mass kg": "weight_kg",
           "Therapy::First exchange": "pd_start_date", "Result::Weekly clearance": "ktv"}
REQUIRED = ["patient_id", "age", "ktv", "pd_start_date"]


def _export(spark, sf) -> str:
    # every fifth cell of the text column holds a line break, a comma and quotes
    noted = F.when(F.col("patient_id") % 5 == 0, F.concat("gender", F.lit(NOTE))).otherwise(F.col("gender"))
    coh = v(spark, sf, "cohort").withColumn("gender", noted).select("patient_id", "age", "gender", "weight_kg", "pd_start_date", "ktv")
    path = sinks.run_root(spark, "crf_export")
    crf.write_crf(coh, path, [GROUPS, FIELDS])
    return path


@query("scan_rename_required", covers=("A1", "A2", "A3", "A4", "H6", "B1", "B2", "B4", "H29"), sql=cte("cohort") + """
select patient_id, age, weight_kg, cast(cast(pd_start_date as timestamp) as varchar) as pd_start_date, ktv
from cohort where age is not null and ktv is not null and pd_start_date is not null""")
def scan_rename_required(spark, sf):
    """Cohort exported as CSV with a two-row header, scanned back: flatten, rename, drop, require,
    parse dates, coerce numbers, validate ranges (fail mode), drop incomplete rows, key column."""
    path = _export(spark, sf)
    df = crf.ingest_crf(spark, path, renames=RENAMES, drop=["Person::Sex"], required=REQUIRED,
                        date_columns=["pd_start_date"], numeric_columns=["age", "weight_kg", "ktv"],
                        rules={"ktv": (0.5, 4.0)}, key="patient_id")
    return df.select(F.col("patient_id").cast("bigint").alias("patient_id"), "age", "weight_kg",
                     F.col("pd_start_date").cast("string").alias("pd_start_date"), "ktv")


_FLAT = {"Unnamed: 0_level_0::Record": "patient_id", "Person::Years of life": "age", "Person::Sex": "gender",
         "Measures::Mass kg": "weight_kg", "Therapy::First exchange": "pd_start_date", "Result::Weekly clearance": "ktv"}


@query("flatten_header", covers=("A1", "A2", "H29"), sql=cte("cohort", extra=[("noted", """select * replace (
  case when patient_id % 5 = 0 then concat(gender, ',', chr(10), '"see note"', chr(10)) else gender end as gender) from cohort""")]) + " union all ".join(
    f"select cast({k} as integer) as position, '{n}' as name, count({c}) as n_filled, count(distinct {c}) as n_distinct from noted"
    for k, (n, c) in enumerate(_FLAT.items())))
def flatten_header(spark, sf):
    """Flattened columns of the export as scanned back: place, name, cells filled and distinct texts."""
    df = crf.read_crf(spark, _export(spark, sf))
    counts = df.agg(*[x for k, c in enumerate(df.columns) for x in (F.count(F.col(f"`{c}`")).alias(f"n{k}"), F.countDistinct(F.col(f"`{c}`")).alias(f"d{k}"))])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(k).alias("position"), F.lit(c).alias("name"), F.col(f"n{k}").alias("n_filled"),
                                                     F.col(f"d{k}").alias("n_distinct")) for k, c in enumerate(df.columns)])))

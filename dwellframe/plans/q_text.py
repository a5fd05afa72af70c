"""Display-text queries (labels, titles, unit equality, joined notes)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as TX
from ..sources import dictionaries as D
from ..sources.views import cte
from .common import LAB_UNITS_SQL, v
from .registry import query


def _title_sql(x):
    return f"array_to_string(list_transform(string_split({x}, ' '), lambda w: upper(w[1:1]) || w[2:]), ' ')"


@query("labels_text", covers=("H25", "H27", "H28"), sql=cte("labs_long", "times", extra=[
    ("lu", f"select * from {LAB_UNITS_SQL} u")]) + f"""
select l.patient_id, l.analyte, {_title_sql("replace(l.analyte, '_', ' ')")} as analyte_label,
  {_title_sql("lower(trim(l.unit))")} as unit_title,
  lower(coalesce(trim(l.unit), '')) = lower(coalesce(u.expected, '')) as same_unit,
  case when coalesce(t.inflow, '') <> '' and coalesce(t.outflow, '') <> '' then t.inflow || ' → ' || t.outflow
       else 'Incomplete' end as dwell_text
from labs_long l left join lu u on l.analyte = u.analyte left join times t on l.patient_id = t.patient_id""")
def labels_text(spark, sf):
    labs = v(spark, sf, "labs_long")
    units = F.broadcast(D.lab_units(spark).select("analyte", "expected"))
    times = v(spark, sf, "times")
    j = labs.join(units, "analyte", "left").join(times, "patient_id", "left")
    return j.select("patient_id", "analyte", TX.feature_label("analyte").alias("analyte_label"),
                    TX.title_case(F.trim("unit")).alias("unit_title"),
                    TX.units_equal(F.trim("unit"), F.col("expected")).alias("same_unit"),
                    TX.dwell_text("inflow", "outflow").alias("dwell_text"))


@query("format_numbers", covers=("H24", "H26"))
def format_numbers(spark, sf):
    """Number texts (rows-only check: text rounding differs between engines)."""
    p = v(spark, sf, "pet_scores")
    return p.select("patient_id", TX.format_number("top_prob", 2).alias("prob_2dp"),
                    TX.format_probability("top_prob").alias("prob_pct"),
                    TX.format_integer(F.col("top_prob") * 100).alias("prob_int"),
                    TX.adaptive_number(F.col("top_prob") * F.col("patient_id")).alias("adaptive"),
                    TX.reliability_text(F.lit(0.39), F.lit("mild under-confidence")).alias("reliability"))

"""Clinical-shaped stand-in inputs over the driver tables.

These views only shape rows of the driver tables into the schemas the
operators expect (a patient table, long labs, dialysate shifts, dwell times,
prediction and class-score tables).  They do none of an operator's work; the
same SQL text is used as a CTE prefix of every DuckDB oracle query, so the
Spark job and its oracle start from identical input.

The SQL is accepted unchanged by Spark 4 (ANSI) and DuckDB.  Doubles are
written ``1e0``-style: ``1.0`` is DECIMAL in Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import tables

VIEW_SQL: dict[str, str] = {
    "cohort": """
select o.o_orderkey as patient_id,
  case when o.o_orderkey % 61 = 0 then null else 18e0 + o.o_custkey % 75 end as age,
  case when o.o_orderkey % 2 = 0 then 'F' else 'M' end as gender,
  case when o.o_orderkey % 53 = 0 then null else 40e0 + (o.o_orderkey % 900) / 10e0 end as weight_kg,
  case when o.o_orderkey % 997 = 0 then 0e0 else 130e0 + (o.o_custkey % 700) / 10e0 end as height_cm,
  case when o.o_orderkey % 7 = 0 then 1 else 0 end as mi,
  case when o.o_orderkey % 11 = 0 then 1 else 0 end as chf,
  case when o.o_orderkey % 5 = 0 then 1 else 0 end as dm_cx,
  case when o.o_orderkey % 97 = 0 then null when o.o_orderkey % 13 = 0 then 1 else 0 end as malignancy,
  case when o.o_orderkey % 29 = 0 then null else c.c_mktsegment end as esrd_cause,
  case o.o_orderkey % 3 when 0 then 'CAPD' when 1 then 'NIPD' else 'CCPD' end as modality,
  cast(o.o_orderdate as date) as pd_start_date,
  cast(o.o_orderdate as date) - cast(o.o_orderkey % 90 as int) as egfr_date,
  cast(o.o_orderdate as date) - cast(o.o_orderkey % 30 - 2 as int) as tki_date,
  case when o.o_orderkey % 71 = 0 then null
       else cast(o.o_orderdate as date) + cast(o.o_orderkey % 200 as int) end as assessment_date,
  o.o_totalprice / 1000e0 as residual_rf,
  case when o.o_orderkey % 41 = 0 then null
       else 1e0 + (o.o_orderkey % 17) / 20e0 + (o.o_custkey % 75) / 100e0 end as ktv,
  case when o.o_orderkey % 503 = 0 then 1.2e0 else 0.3e0 + (o.o_orderkey % 65) / 100e0 end as pet
from orders o join customer c on o.o_custkey = c.c_custkey
""",
    "labs_long": """
select l_orderkey as patient_id,
  case l_linenumber when 1 then 'pdf_urea' when 2 then 'pdf_creatinine' when 3 then 'pdf_protein'
    when 4 then 'urine_protein_creatinine'
    when 5 then case when l_orderkey % 2 = 0 then 'blood_protein' else 'blood_urea' end when 6 then 'blood_creatinine'
    else 'blood_albumin' end as analyte,
  l_quantity as value,
  case l_returnflag when 'R' then ' MG/DL ' when 'A' then 'mmol/L' else 'g/dL' end as unit
from lineitem
""",
    "shifts": """
select l_orderkey as patient_id, l_suppkey % 6 as bag_no,
  1.5e0 + (l_partkey % 4) * 0.5e0 as volume_l, cast(l_quantity as bigint) % 4 as cycles
from lineitem
""",
    "bags_num": """
select 0 as bag_no, 346e0 as osm union all select 1, 396e0 union all select 2, 284e0
union all select 3, 347e0 union all select 4, 398e0
""",
    "times": """
select o_orderkey as patient_id,
  {inflow} as inflow,
  {outflow} as outflow
from orders
""",
    "regimen": """
select o_orderkey as patient_id,
  case when o_orderkey % 101 = 0 then 'HD' when o_orderkey % 3 = 0 then 'capd'
       when o_orderkey % 3 = 1 then 'NIPD' else 'CCPD' end as modality,
  case when o_orderkey % 9 = 0 then null else o_custkey % 6 end as capd_bag_no,
  case when o_orderkey % 4 = 0 then o_custkey % 6 end as ccpd_day_bag_no
from orders
""",
    "intake_units": """
select o_orderkey as patient_id,
  case o_orderkey % 4 when 0 then (130e0 + (o_custkey % 700) / 10e0) / 2.54e0
    else 130e0 + (o_custkey % 700) / 10e0 end as height_value,
  case o_orderkey % 4 when 0 then 'in' when 3 then 'ft' else 'cm' end as height_unit,
  case o_orderkey % 5 when 0 then (40e0 + (o_orderkey % 900) / 10e0) * 2.20462e0
    else 40e0 + (o_orderkey % 900) / 10e0 end as weight_value,
  case o_orderkey % 5 when 0 then 'lb' when 4 then 'st' else 'kg' end as weight_unit
from orders
""",
    "raw_text": """
select l_orderkey as patient_id, l_linenumber as line_no,
  case l_linenumber % 4
    when 0 then concat(cast(cast(l_quantity as bigint) as varchar(20)), '.', cast(l_linenumber as varchar(20)))
    when 1 then concat(cast(cast(l_quantity as bigint) as varchar(20)), '.5L')
    when 2 then ''
    else concat(' ', cast(cast(l_quantity as bigint) as varchar(20)), ' ') end as raw_value,
  case when l_linenumber % 3 = 0 then 'abc'
    when l_linenumber % 5 = 0 then concat('-', cast(l_linenumber as varchar(20)), 'x')
    else concat(cast(l_linenumber as varchar(20)), ' cycles') end as raw_count,
  case when l_orderkey % 5 = 0 then 'invalid'
    when l_orderkey % 7 = 0 then replace(cast(cast(l_shipdate as date) as varchar(20)), '-', '/')
    else cast(cast(l_shipdate as date) as varchar(20)) end as raw_date
from lineitem
""",
    "predictions": """
select patient_id, 'ktv' as target, 'linear' as model, gender, ktv as y_true, 0.9e0 * ktv + 0.15e0 + ((patient_id % 21) - 10) / 50e0 as y_pred
from cohort where ktv is not null
union all select patient_id, 'ktv', 'forest', gender, ktv, 0.9e0 * ktv + 0.05e0 + ((patient_id % 21) - 10) / 80e0 from cohort where ktv is not null
union all select patient_id, 'ktv', 'boosted', gender, ktv, 0.9e0 * ktv + 0.2e0 + ((patient_id % 21) - 10) / 120e0 from cohort where ktv is not null
union all select patient_id, 'pet', 'linear', gender, pet, 0.8e0 * pet + 0.1e0 + ((patient_id % 17) - 8) / 100e0 from cohort where pet is not null
union all select patient_id, 'pet', 'forest', gender, pet, 0.85e0 * pet + 0.08e0 + ((patient_id % 17) - 8) / 160e0 from cohort where pet is not null
""",
    "quantile_preds": """
select patient_id, target, model, 0.1e0 as quantile, 0 as q_pos, y_true, y_pred - 0.16e0 as y_pred from predictions
union all select patient_id, target, model, 0.45e0, 1, y_true, y_pred - 0.02e0 from predictions
union all select patient_id, target, model, 0.55e0, 2, y_true, y_pred + 0.02e0 from predictions
union all select patient_id, target, model, 0.9e0, 3, y_true, y_pred + 0.16e0 from predictions
""",
    "pet_scores": """
select o_orderkey as patient_id, o_orderkey % 4 as y_class,
  case when o_orderkey % 5 = 0 then (o_orderkey + 1) % 4 else o_orderkey % 4 end as p_class,
  0.4e0 + (o_custkey % 60) / 100e0 as top_prob
from orders
""",
}

# every sixth patient has a whole panel, so some records are complete
VIEW_SQL["labs_long"] += " union all ".join(["", *[
    f"select o_orderkey, '{a}', cast(o_custkey % 40 + 5 as double), ' {u}' from orders where o_orderkey % 6 = 0 "
    for a, u in (("pdf_urea", "mmol/L"), ("pdf_creatinine", "mg/dL"), ("pdf_protein", "g/L"), ("urine_protein_creatinine", "mg/g"),
                 ("blood_creatinine", "umol/L"), ("blood_albumin", "g/dL"), ("blood_protein", "g/L"))]])

TIMES_EXPR = {
    "inflow": "concat(lpad(cast({p}o_orderkey % 25 as varchar(4)), 2, '0'), ':', "
              "lpad(cast({p}o_orderkey % 60 as varchar(4)), 2, '0'))",
    "outflow": "concat(lpad(cast({p}o_custkey % 24 as varchar(4)), 2, '0'), ':', "
               "lpad(cast({p}o_custkey % 60 as varchar(4)), 2, '0'))",
}
VIEW_SQL["times"] = VIEW_SQL["times"].format(inflow=TIMES_EXPR["inflow"].format(p=""),
                                             outflow=TIMES_EXPR["outflow"].format(p=""))


def record_stream_sql() -> str:
    """Cohort shaping plus the dwell times of the same order row (one projection, no second stream)."""
    extra = ",\n  ".join(f"{e.format(p='o.')} as {n}" for n, e in TIMES_EXPR.items())
    return VIEW_SQL["cohort"].replace("\nfrom orders o join customer c", f",\n  {extra}\nfrom orders o join customer c")


# view -> views/tables it reads
VIEW_DEPS: dict[str, tuple[str, ...]] = {
    "cohort": ("orders", "customer"),
    "labs_long": ("lineitem", "orders"),
    "shifts": ("lineitem",),
    "bags_num": (),
    "times": ("orders",),
    "regimen": ("orders",),
    "intake_units": ("orders",),
    "raw_text": ("lineitem",),
    "predictions": ("cohort",),
    "pet_scores": ("orders",),
    "quantile_preds": ("predictions",),
}


def _closure(names) -> list[str]:
    order: list[str] = []

    def visit(n):
        for d in VIEW_DEPS.get(n, ()):
            visit(d)
        if n in VIEW_SQL and n not in order:
            order.append(n)

    for n in names:
        visit(n)
    return order


def cte(*names: str, extra: list[tuple[str, str]] | None = None) -> str:
    """``WITH`` prefix defining the named views (and what they read) for an oracle query,
    followed by ``extra`` (name, sql) CTEs."""
    parts = [(n, VIEW_SQL[n].strip()) for n in _closure(names)] + list(extra or [])
    if not parts:
        return ""
    return "with " + ",\n".join(f"{n} as ({q.strip()})" for n, q in parts) + "\n"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Build one stand-in view over the tables in ``sf_dir`` as a DataFrame."""
    needed = _closure([name])
    base = sorted({d for n in needed for d in VIEW_DEPS[n] if d not in VIEW_SQL})
    tables.register(spark, sf_dir, *base)
    df = None
    for n in needed:
        df = spark.sql(VIEW_SQL[n])
        df.createOrReplaceTempView(n)
    return df

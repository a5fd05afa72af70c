"""SQL fragments shared by oracle queries (DuckDB dialect, also valid Spark SQL)."""

BMI = "case when weight_kg > 0 and height_cm > 0 then weight_kg / power(height_cm / 100e0, 2) end"
BSA = ("case when weight_kg > 0 and height_cm > 0 then "
       "0.007184e0 * power(weight_kg, 0.425e0) * power(height_cm, 0.725e0) end")
AGE_POINTS = ("case when age is null then null when age < 50 then 0 when age < 60 then 1 "
              "when age < 70 then 2 when age < 80 then 3 when age < 90 then 4 else 5 end")
CCI = ("(case when coalesce(mi <> 0, false) then 1 else 0 end"
       " + case when coalesce(chf <> 0, false) then 1 else 0 end"
       " + case when coalesce(dm_cx <> 0, false) then 2 else 0 end"
       " + case when coalesce(malignancy <> 0, false) then 2 else 0 end"
       f" + 2 + coalesce({AGE_POINTS}, 0))")
FAILURE = "cast(date_diff('day', egfr_date, pd_start_date) as double)"
WAITING = "cast(date_diff('day', tki_date, pd_start_date) as double)"
PD_PERIOD = "cast(date_diff('day', pd_start_date, assessment_date) as double)"

DERIVED = (f"{BMI} as bmi, {BSA} as bsa, cast({CCI} as integer) as charlson_index, "
           f"{FAILURE} as failure_period_days, {WAITING} as waiting_period_days, "
           f"{PD_PERIOD} as pd_period_days")


def r6(expr: str) -> str:
    return f"round({expr}, 6)"

"""Patient-table derivations: body metrics, Charlson index, time intervals.

One ``select`` over the patient table: no shuffle, all expressions in a single
whole-stage-codegen stage.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clinical as C

# Cohort flag columns -> Charlson codes, taken from the calculator map.
COHORT_FLAGS: tuple[str, ...] = ("mi", "chf", "dm_cx", "malignancy")


def flag_codes_for(df: DataFrame, flags: Sequence[str] | Mapping[str, str] | None = None) -> dict[str, str]:
    if isinstance(flags, Mapping):
        return {c: code for c, code in flags.items() if c in df.columns}
    names = flags if flags is not None else [c for c in df.columns if c in C.CALCULATOR_FLAG_CODES]
    return {c: C.CALCULATOR_FLAG_CODES[c] for c in names if c in df.columns}


def derive_features(df: DataFrame, *, weight="weight_kg", height="height_cm", age="age",
                    flags: Sequence[str] | Mapping[str, str] | None = None,
                    cci_weights: Mapping[str, int] | None = None,
                    include_age_in_cci: bool = True,
                    dates: Mapping[str, str] | None = None) -> DataFrame:
    """Add ``bmi``, ``bsa``, ``charlson_index`` and the three interval columns.

    Body metrics are added only when both weight and height columns exist; the
    interval columns only when a date map is given or the cohort date columns
    exist (a date map naming an absent column raises, as in the reference).
    """
    cols: dict = {}
    if weight in df.columns and height in df.columns:
        w = F.col(weight).try_cast("double")
        h = F.col(height).try_cast("double")
        cols.update(C.body_metrics(w, h))
    default_dates = {"egfr": "egfr_date", "pd_start": "pd_start_date", "tki": "tki_date",
                     "assessment": "assessment_date"}
    dmap = dates if dates is not None else (
        default_dates if all(v in df.columns for v in default_dates.values()) else None)
    if dmap:
        missing = [v for v in dmap.values() if v not in df.columns]
        if missing:
            raise KeyError(f"time intervals need columns {missing}")
        types = dict(df.dtypes)
        cols.update(C.time_intervals(**dmap, kinds={c: C.time_kind(types[c]) for c in dmap.values()}))
    codes = flag_codes_for(df, flags)
    cols["charlson_index"] = C.charlson_index(
        codes, F.col(age) if age in df.columns else None, weights=cci_weights,
        include_age=include_age_in_cci)
    return df.withColumns(cols)

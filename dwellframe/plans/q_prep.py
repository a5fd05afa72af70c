"""Preparation queries: statistics tables and fit-on-train / apply-on-test."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cohort as cohort_ops
from ..operators import prep as PR
from ..operators import split as SP
from ..sources.views import cte
from . import sqlfrag as S
from .common import r6, v
from .q_split import IS_TEST, RANKED, SEED, TEST_SIZE
from .registry import query

STAT_COLS = ("age", "weight_kg", "height_cm", "residual_rf", "ktv", "pet")
NUMS = ("age", "weight_kg", "height_cm", "residual_rf", "bmi", "bsa", "charlson_index",
        "failure_period_days", "waiting_period_days", "pd_period_days", "mi", "chf", "dm_cx", "malignancy")
CATS = ("modality", "gender", "esrd_cause")
# category values of the stand-in cohort, used only by the oracle text
VOCAB = {"modality": ("CAPD", "CCPD", "NIPD"), "gender": ("F", "M"),
         "esrd_cause": ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "missing")}


def _r(x):
    return f"round({x}, 6) + 0e0"


@query("impute_stats", covers=("D1",), sql=cte("cohort") + " union all ".join(
    f"select '{c}' as \"column\", {_r(f'avg({c})')} as mean, {_r(f'median({c})')} as median, "
    f"(select {_r(c)} from cohort where {c} is not null group by {c} order by count(*) desc, {c} limit 1) as mode "
    f"from cohort" for c in STAT_COLS))
def impute_stats(spark, sf):
    return r6(PR.impute_statistics(v(spark, sf, "cohort"), STAT_COLS))


_SC = ("age", "weight_kg", "height_cm", "residual_rf", "bmi", "bsa", "charlson_index", "mi")


@query("scaler_stats", covers=("D2", "D3"), sql=cte("cohort") + " union all ".join(
    f"select '{c}' as \"column\", {_r(f'avg({c})')} as mean, {_r(f'stddev_pop({c})')} as std_pop, "
    f"{_r(f'coalesce(nullif(stddev_pop({c}), 0e0), 1e0)')} as scale, {_r(f'min({c})')} as min, "
    f"{_r(f'max({c})')} as max, {_r(f'nullif(max({c}) - min({c}), 0e0)')} as range "
    f"from (select cast({c} as double) as {c} from (select *, {S.DERIVED} from cohort) b) t" for c in _SC))
def scaler_stats(spark, sf):
    df = cohort_ops.derive_features(v(spark, sf, "cohort"))
    return r6(PR.scaler_statistics(df, _SC))


@query("vocabulary", covers=("D4",), sql=cte("cohort") + " union all ".join(
    f"select '{c}' as \"column\", category, cast(dense_rank() over (order by category) - 1 as integer) as ordinal "
    f"from (select distinct coalesce({c}, 'missing') as category from cohort) t" for c in CATS))
def vocabulary(spark, sf):
    return PR.vocabulary(v(spark, sf, "cohort"), CATS)


def _dist_sql(c):
    return (f"select '{c}' as \"column\", count({c}) as n, {_r(f'avg({c})')} as mean, {_r(f'var_samp({c})')} as variance, "
            f"{_r(f'avg(power({c} - mu, 3)) / power(avg(power({c} - mu, 2)), 1.5e0)')} as skewness, "
            f"{_r(f'median({c})')} as median, "
            f"coalesce(abs(avg(power({c} - mu, 3)) / power(avg(power({c} - mu, 2)), 1.5e0)) > 0.5e0, false) as log_recommended "
            f"from (select cast({c} as double) as {c}, mu from (select *, {S.DERIVED} from cohort) b, "
            f"(select avg(cast({c} as double)) as mu from (select *, {S.DERIVED} from cohort) b2) m) t")


_DC = ("age", "residual_rf", "ktv", "pet", "bmi", "pd_period_days")


@query("distribution_profile", covers=("D19", "I9"), sql=cte("cohort") + " union all ".join(_dist_sql(c) for c in _DC))
def distribution_profile(spark, sf):
    df = cohort_ops.derive_features(v(spark, sf, "cohort"))
    return r6(PR.distribution_profile(df, _DC))


@query("log_chooser", covers=("I9",), sql=cte("cohort") + "select \"column\" from (" + " union all ".join(
    _dist_sql(c) for c in _DC) + ") p where log_recommended")
def log_chooser(spark, sf):
    df = cohort_ops.derive_features(v(spark, sf, "cohort"))
    return PR.distribution_profile(df, _DC).filter("log_recommended").select("column")


def _prep_sql():
    fill = {c: f"coalesce(cast({c} as double), m.{c}__mu)" for c in NUMS}
    m = ", ".join(f"avg(cast({c} as double)) as {c}__mu" for c in NUMS)
    s = ", ".join(f"avg({fill[c]}) as {c}__c, stddev_pop({fill[c]}) as {c}__sd" for c in NUMS)
    feats = ", ".join(
        f"{_r(f'(coalesce(cast(t.{c} as double), m.{c}__mu) - s.{c}__c) / coalesce(nullif(s.{c}__sd, 0e0), 1e0)')} as {c}"
        for c in NUMS)
    onehot = ", ".join(f"cast(coalesce(coalesce(t.{c}, 'missing') = '{k}', false) as double) as {c}_{k}"
                       for c in CATS for k in VOCAB[c])
    extra = RANKED + [
        ("base", f"select c.* replace (case when c.residual_rf > -1 then ln(1 + c.residual_rf) end as residual_rf), "
                 f"{S.DERIVED} from cohort c"),
        ("train", f"select b.* from base b join ranked r on b.patient_id = r.patient_id where not ({IS_TEST})"),
        ("test", f"select b.* from base b join ranked r on b.patient_id = r.patient_id where {IS_TEST}"),
        ("m", f"select {m} from train"),
        ("s", f"select {s} from train, m"),
    ]
    return cte("cohort", extra=extra) + f"select t.patient_id, {feats}, {onehot}, t.ktv, t.pet from test t, m, s"


_MODE = {c: f"(select cast({c} as double) from cohort where {c} is not null group by {c} order by count(*) desc, {c} limit 1)"
         for c in ("age", "weight_kg", "malignancy")}


@query("impute_mode_apply", covers=("I3",), sql=cte("cohort", extra=[
    ("filled", "select patient_id, " + ", ".join(f"coalesce(cast({c} as double), {m}) as {c}" for c, m in _MODE.items()) + " from cohort")])
    + "select patient_id, " + ", ".join(
        f"{_r(f'({c} - avg({c}) over ()) / coalesce(nullif(stddev_pop({c}) over (), 0e0), 1e0)')} as {c}" for c in _MODE) + " from filled")
def impute_mode_apply(spark, sf):
    """Most-frequent imputation (lowest value on ties), then standard scaling, of the whole cohort."""
    df = v(spark, sf, "cohort")
    model = PR.fit_prep(df, targets=[], numeric=list(_MODE), imputation="most_frequent", derive=False)
    return r6(PR.apply_prep(df, model), list(_MODE))


@query("preprocess_fit_apply", covers=("I1", "I2", "I3", "I4", "I5", "I7", "B6", "B7", "A10", "L1", "L2"),
       sql=_prep_sql())
def preprocess_fit_apply(spark, sf):
    """Fit derive -> log1p -> mean impute -> standard scale -> one-hot on the train split, apply to test."""
    s = SP.seeded_split(v(spark, sf, "cohort"), "patient_id", TEST_SIZE, SEED)
    model = PR.fit_prep(s.train, numeric=NUMS, categorical=CATS, imputation="mean", scaling="standard",
                        log_features=["residual_rf"])
    return r6(PR.apply_prep(s.test, model), list(NUMS))


@query("label_encode", covers=("I6",), sql=cte("cohort", extra=RANKED) + " select c.patient_id, " + ", ".join(
    f"cast(case coalesce(c.{k}, 'missing') " + " ".join(f"when '{cat}' then {i}" for i, cat in enumerate(VOCAB[k]))
    + f" end as double) as {k}" for k in CATS) + f" from cohort c join ranked r on c.patient_id = r.patient_id where {IS_TEST}")
def label_encode(spark, sf):
    """Label encoding fitted on train (sorted codes 0..k-1, NULL -> "missing"), applied to test."""
    s = SP.seeded_split(v(spark, sf, "cohort"), "patient_id", TEST_SIZE, SEED)
    model = PR.fit_prep(s.train, numeric=[], categorical=CATS, encoding="label", derive=False)
    return PR.apply_prep(s.test, model, keep_targets=False).select("patient_id", *CATS)


_AL_NUMS = ("age", "weight_kg", "residual_rf", "charlson_index")


def _align_sql():
    stats = ", ".join(f"avg(cast({c} as double)) as {c}__m, stddev_pop(cast({c} as double)) as {c}__s" for c in _AL_NUMS)
    feats = []
    for c in _AL_NUMS:
        if c == "weight_kg":
            feats.append(f"cast(null as double) as {c}")
        else:
            feats.append(f"{_r(f'(cast(t.{c} as double) - s.{c}__m) / coalesce(nullif(s.{c}__s, 0e0), 1e0)')} as {c}")
    onehot = ", ".join(f"cast(coalesce(coalesce(t.modality, 'missing') = '{k}', false) as double) as modality_{k}"
                       for k in VOCAB["modality"])
    extra = RANKED + [
        ("base", f"select c.* replace (case when c.residual_rf > -1 then ln(1 + c.residual_rf) end as residual_rf), "
                 f"{S.DERIVED} from cohort c"),
        ("train", f"select b.* from base b join ranked r on b.patient_id = r.patient_id where not ({IS_TEST})"),
        ("test", f"select b.* from base b join ranked r on b.patient_id = r.patient_id where {IS_TEST}"),
        ("s", f"select {stats} from train")]
    return cte("cohort", extra=extra) + f"select t.patient_id, {', '.join(feats)}, {onehot} from test t, s"


@query("align_columns", covers=("B6", "B7", "B16", "C9", "I7"), sql=_align_sql())
def align_columns(spark, sf):
    """Fitted preparation applied to new rows that lack a fitted input (weight) and carry extra columns:
    the missing numeric input is NULL before scaling, extra columns are dropped, fitted order kept."""
    s = SP.seeded_split(v(spark, sf, "cohort"), "patient_id", TEST_SIZE, SEED)
    model = PR.fit_prep(s.train, numeric=_AL_NUMS, categorical=["modality"], imputation="none",
                        log_features=["residual_rf"])
    new_rows = s.test.drop("weight_kg").withColumn("unexpected_column", F.lit("x"))
    return r6(PR.apply_prep(new_rows, model, keep_targets=False))


@query("row_alignment", covers=("C5",), sql=cte("cohort", extra=RANKED) + f"""
select c.patient_id, c.pet from cohort c join ranked r on c.patient_id = r.patient_id
where {IS_TEST} and c.pet is not null and c.ktv is not null""")
def row_alignment(spark, sf):
    """Feature rows aligned to the rows that have both targets (equi-join on the unique key)."""
    s = SP.seeded_split(v(spark, sf, "cohort"), "patient_id", TEST_SIZE, SEED)
    model = PR.fit_prep(s.train, numeric=["age"], categorical=[], imputation="mean")
    x = PR.apply_prep(s.test, model, keep_targets=False)
    y = s.test.filter(F.col("pet").isNotNull() & F.col("ktv").isNotNull()).select("patient_id", "pet")
    return x.join(y, "patient_id").select("patient_id", "pet")  # keys are unique: the join aligns rows


_MM = ("age", "weight_kg", "bmi", "charlson_index", "mi")


def _minmax_sql():
    stats = ", ".join(f"min(cast({c} as double)) as {c}__lo, max(cast({c} as double)) as {c}__hi" for c in _MM)
    feats = ", ".join(
        f"{_r(f'case when s.{c}__hi - s.{c}__lo = 0 then case when t.{c} is not null then -1e0 end else (cast(t.{c} as double) - s.{c}__lo) / (s.{c}__hi - s.{c}__lo) * 2e0 + -1e0 end')} as {c}"
        for c in _MM)
    extra = RANKED + [
        ("base", f"select c.*, {S.DERIVED} from cohort c"),
        ("train", f"select b.* from base b join ranked r on b.patient_id = r.patient_id where not ({IS_TEST}) and b.mi = 0"),
        ("test", f"select b.* from base b join ranked r on b.patient_id = r.patient_id where {IS_TEST}"),
        ("s", f"select {stats} from train")]
    return cte("cohort", extra=extra) + f"select t.patient_id, {feats} from test t, s"


@query("minmax_scale", covers=("D3", "I4"), sql=_minmax_sql())
def minmax_scale(spark, sf):
    """Min-max to [-1, 1] fitted on train rows (constant column ``mi`` there -> lower bound), applied to test."""
    s = SP.seeded_split(v(spark, sf, "cohort"), "patient_id", TEST_SIZE, SEED)
    train = s.train.filter(F.col("mi") == 0)
    model = PR.fit_prep(train, numeric=_MM, categorical=[], imputation="none", scaling="minmax",
                        minmax_range=(-1.0, 1.0))
    return r6(PR.apply_prep(s.test, model, keep_targets=False))

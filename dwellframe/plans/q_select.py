"""Feature-selection queries: Gram statistics, LASSO path, top-k, union, attribution, OLS."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cohort as cohort_ops
from ..operators import select as SL
from ..operators import split as SP
from ..sources.views import cte
from . import sqlfrag as S
from .common import r6, v
from .q_split import K, SEED
from .registry import query

MODALITIES = ("CAPD", "CCPD", "NIPD")
SEL_FEATS = ("age", "weight_kg", "height_cm", "residual_rf", "bmi", "bsa", "charlson_index",
             "failure_period_days", "waiting_period_days", "pd_period_days",
             "mi", "chf", "dm_cx", "malignancy", *[f"modality_{m}" for m in MODALITIES])
DERIVED = S.DERIVED + "".join(f", case when modality = '{m}' then 1 else 0 end as modality_{m}" for m in MODALITIES)
LAM = 0.05
MIN_FEATURES = 3


def _r(x):
    return f"round({x}, 6) + 0e0"


def _features(spark, sf, with_folds=True):
    coh = v(spark, sf, "cohort")
    if with_folds:
        coh = SP.assign_folds(coh, K, "patient_id", SEED)
    one_hot = {f"modality_{m}": F.when(F.col("modality") == m, 1).otherwise(0) for m in MODALITIES}
    return cohort_ops.derive_features(coh).withColumns(one_hot)


FOLDS_CTE = [("fl", f"""select patient_id, cast(ntile({K}) over (order by md5(concat(cast(patient_id as varchar(20)),
  ':{SEED}')), patient_id) - 1 as integer) as fold from cohort"""),
             ("base", f"select c.*, {DERIVED}, fl.fold from cohort c join fl on c.patient_id = fl.patient_id")]


def _gram_sql():
    f = list(SEL_FEATS)
    mu = ", ".join(f"avg(cast({c} as double)) as m_{c}" for c in [*f, "ktv"])
    xs = ", ".join(f"cast({c} as double) - m_{c} as {c}" for c in f)
    notnull = " and ".join(f"{c} is not null" for c in [*f, "ktv"])
    items = [("__one", "__one", "count(*)"), ("__one", "__y", "sum(y)"), ("__y", "__y", "sum(y * y)")]
    for i, a in enumerate(f):
        items += [("__one", a, f"sum({a})"), (a, "__y", f"sum({a} * y)")]
        for b in f[i:]:
            items.append((a, b, f"sum({a} * {b})"))
    sums = ", ".join(f"{e} as s{k}" for k, (_, _, e) in enumerate(items))
    rows = ", ".join(f"{{'row_name': '{r}', 'col_name': '{c}', 'value': {_r(f's{k} / n')}}}" for k, (r, c, _) in enumerate(items))
    body = f"select fold, n, u.row_name, u.col_name, u.value from (select fold, n, unnest([{rows}]) as u from (select fold, count(*) as n, {sums} from d group by fold) g) t"
    extra = FOLDS_CTE + [("mu", f"select {mu} from base"),
                         ("d", f"select fold, {xs}, cast(ktv as double) - m_ktv as y from base, mu where {notnull}")]
    return cte("cohort", extra=extra) + body


@query("gram", covers=("D12",), sql=_gram_sql())
def gram(spark, sf):
    """Per-fold Gram of mean-shifted features and target, summed block by block (entries divided by fold size)."""
    df = _features(spark, sf)
    d, _, _ = SL.checked(df, SEL_FEATS, "ktv", "drop")
    shift = SL.means_and_scales(df, [*SEL_FEATS, "ktv"])
    names = ["__one", *SEL_FEATS, "__y"]
    blocks = SL.gram_blocks(d, SEL_FEATS, "ktv", "fold", {c: m for c, (m, _) in shift.items()}).persist()  # a few blocks a fold, read twice
    long = SL.gram_long(blocks, names)
    n = long.filter("row_name = '__one' and col_name = '__one'").select(F.col("fold").alias("f"), F.col("value").cast("bigint").alias("n"))
    return r6(long.join(n, F.col("fold") == F.col("f")).select("fold", "n", "row_name", "col_name", (F.col("value") / F.col("n")).alias("value")))


def _lasso_results(spark, sf):
    df = _features(spark, sf)
    return [SL.fit_lasso_selection(df, SEL_FEATS, "ktv", alpha=0.01, min_features=5, missing="drop"),
            SL.fit_lasso_selection(df, SEL_FEATS, "pet", alpha=0.01, min_features=5, missing="drop")]


@query("lasso_selection", covers=("J1", "J2", "A7", "F4"))
def lasso_selection(spark, sf):
    """Cross-validated LASSO per target from one Gram pass; rows-only (coefficients checked by KKT in tests)."""
    return SL.selection_frame(spark, _lasso_results(spark, sf))


@query("cv_error_curve", covers=("D20",))
def cv_error_curve(spark, sf):
    return SL.cv_curve_frame(spark, _lasso_results(spark, sf))


@query("adequacy_selection", covers=("B12", "J1"))
def adequacy_selection(spark, sf):
    """Binary adequacy (ktv >= 1.7) selected with linear LASSO on the 0/1 label, as the reference does."""
    df = _features(spark, sf)
    res = SL.fit_lasso_selection(df, SEL_FEATS, "ktv", alpha=0.01, min_features=5, missing="drop", problem_type="binary",
                                 threshold=1.7)
    res.target = "ktv_adequate"
    return SL.selection_frame(spark, [res])


def _uni_sql(target):
    parts = " union all ".join(
        f"select '{target}' as target, '{c}' as feature, corr(cast({c} as double), {target}) as r from b where {target} is not null"
        for c in SEL_FEATS)
    return f"select target, feature, coalesce(sign(r) * greatest(abs(r) - {LAM}e0, 0e0), 0e0) as coefficient from ({parts}) u"


_TOPK_SQL = cte("cohort", extra=[("b", f"select c.*, {DERIVED} from cohort c"),
                                 ("u", _uni_sql("ktv") + " union all " + _uni_sql("pet")),
                                 ("rk", """select *, row_number() over (partition by target order by abs(coefficient) desc, feature) as rk,
  sum(case when coefficient <> 0 then 1 else 0 end) over (partition by target) as nz from u"""),
                                 ("top", f"""select target, feature, coefficient from rk
  where case when nz >= {MIN_FEATURES} then coefficient <> 0 else rk <= {MIN_FEATURES} end""")])


def _top(spark, sf):
    df = _features(spark, sf, with_folds=False)
    parts = [SL.univariate_lasso(df, SEL_FEATS, t, LAM).withColumn("target", F.lit(t)) for t in ("ktv", "pet")]
    coefs = parts[0].unionByName(parts[1])
    return SL.top_coefficients(coefs, MIN_FEATURES, by=["target"])


@query("top_coefficients", covers=("F1",), sql=_TOPK_SQL + f"select target, feature, {_r('coefficient')} as coefficient from top")
def top_coefficients(spark, sf):
    return r6(_top(spark, sf).select("target", "feature", "coefficient"))


@query("selected_union", covers=("B13", "D17", "G2", "B16", "G4"),
       sql=_TOPK_SQL + "select feature from top union select 'age'")
def selected_union(spark, sf):
    return SL.selected_union(_top(spark, sf), always_keep=["age"])


@query("linear_attribution", covers=("D18",), sql=cte("cohort", extra=[
    ("b", f"select c.*, {DERIVED} from cohort c"), ("u", _uni_sql("ktv"))]) + " union all ".join(
    f"select '{c}' as feature, {_r(f'avg(abs(u.coefficient * (cast(b.{c} as double) - m.mu)))')} as mean_abs_contribution "
    f"from b, (select avg(cast({c} as double)) as mu from b) m, u where u.feature = '{c}'" for c in SEL_FEATS))
def linear_attribution(spark, sf):
    df = _features(spark, sf, with_folds=False)
    coefs = {r["feature"]: r["coefficient"] for r in SL.univariate_lasso(df, SEL_FEATS, "ktv", LAM).collect()}
    return r6(SL.linear_attribution(df, coefs))


@query("ols_single", covers=("J4",), sql=cte("cohort", extra=[("b", f"select c.*, {DERIVED} from cohort c")]) + " union all ".join(
    f"select '{t}' as target, 'bmi' as feature, {_r(f'regr_slope({t}, bmi)')} as slope, {_r(f'regr_intercept({t}, bmi)')} as intercept "
    f"from b where {t} is not null and bmi is not null" for t in ("ktv", "pet")))
def ols_single(spark, sf):
    """Ordinary least squares from the Gram (closed form), one feature per target."""
    df = _features(spark, sf, with_folds=False)
    rows = []
    for t in ("ktv", "pet"):
        d = df.filter(F.col(t).isNotNull() & F.col("bmi").isNotNull()).withColumn("__f", F.lit(0))
        ms = SL.means_and_scales(d, ["bmi", t])
        st = SL.collect_gram(d, ["bmi"], t, "__f", {c: m for c, (m, _) in ms.items()})
        b, b0 = SL.ols_from_gram(st)
        rows.append((t, "bmi", float(b[0]), b0))
    return r6(spark.createDataFrame(rows, "target string, feature string, slope double, intercept double"))

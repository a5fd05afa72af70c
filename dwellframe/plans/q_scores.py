"""Scoring queries: tree-ensemble batch scoring, score vectors, baseline scores, drivers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores as SC
from ..operators import cohort as cohort_ops
from ..operators import trees as TR
from ..sources.views import cte
from . import sqlfrag as S
from .common import r6, v
from .q_intake import REC_CTES, REC_VIEWS, _record
from .registry import query


def _r(x):
    return f"round({x}, 6) + 0e0"


def _softmax_sql(logits: list[str], prefix: str = "p") -> str:
    m = f"greatest({', '.join(logits)})"
    den = " + ".join(f"exp({l} - {m})" for l in logits)
    return ", ".join(f"exp({l} - {m}) / ({den}) as {prefix}{i}" for i, l in enumerate(logits))


def _rank_sql(ps: list[str]) -> tuple[str, str, str]:
    """argmax (first max), top1, top2 with ties to the lower index, as SQL expressions."""
    k = len(ps)

    def rank(i):  # number of entries ranked before i
        return " + ".join(f"(case when {ps[j]} > {ps[i]} or ({ps[j]} = {ps[i]} and {j} < {i}) then 1 else 0 end)"
                          for j in range(k) if j != i)

    top = lambda r: "case " + " ".join(f"when {rank(i)} = {r} then {i}" for i in range(k)) + " end"
    return top(0), top(0), top(1)


_ENS_CACHE: dict = {}


def _toy(spark):
    if "toy" not in _ENS_CACHE:
        _ENS_CACHE["toy"] = TR.Ensemble.load(spark)
    return _ENS_CACHE["toy"]


def _tree_sql():
    import json
    doc = json.loads(TR.toy_model_text())["learner"]
    ens = TR.Ensemble(doc["feature_names"], int(doc["learner_model_param"]["num_class"]),
                      TR.base_margin(float(doc["learner_model_param"]["base_score"])), {})
    trees = {}
    info = doc["gradient_booster"]["model"]["tree_info"]
    for t_id, t in enumerate(doc["gradient_booster"]["model"]["trees"]):
        nodes = {}
        for i in range(len(t["left_children"])):
            nodes[i] = {"left": t["left_children"][i], "right": t["right_children"][i],
                        "feature": t["split_indices"][i], "threshold": t["split_conditions"][i],
                        "leaf": t["base_weights"][i], "default_left": t["default_left"][i] == 1}
        trees[t_id] = (info[t_id], nodes)
    ens.trees = trees
    raws = TR.raw_score_sql(ens)
    ps = [f"p{i}" for i in range(len(raws))]
    am, t1, t2 = _rank_sql(ps)
    return cte("cohort", extra=[
        ("b", f"select c.*, {S.DERIVED} from cohort c"),
        ("r", "select patient_id, " + ", ".join(f"{x} as l{i}" for i, x in enumerate(raws)) + " from b"),
        ("s", "select patient_id, " + _softmax_sql([f"l{i}" for i in range(len(raws))]) + " from r"),
    ]) + f"select patient_id, {', '.join(_r(p) + ' as ' + p for p in ps)}, cast({am} as integer) as pred_class, " \
         f"cast({t1} as integer) as top1, cast({t2} as integer) as top2 from s"


@query("tree_toy_score", covers=("J14", "H22", "A6", "C8", "H20", "F2", "F3"), sql=_tree_sql())
def tree_toy_score(spark, sf):
    """Score every cohort row with a boosted-tree model parsed from JSON (compiled to Column expressions)."""
    ens = _toy(spark)
    df = cohort_ops.derive_features(v(spark, sf, "cohort"))
    s = ens.score(df)
    return r6(s.select("patient_id", *[F.col("probs")[i].alias(f"p{i}") for i in range(ens.num_class)],
                       "pred_class", F.col("top2")[0].cast("int").alias("top1"),
                       F.col("top2")[1].cast("int").alias("top2")))


@query("tree_arrow_score", covers=("J14", "C8", "L3"), sql=cte("cohort") + """
select count(*) as n, cast(0 as bigint) as n_mismatch from cohort""")
def tree_arrow_score(spark, sf):
    """Same model through the Arrow (mapInPandas) scorer; rows where it disagrees with the compiled scorer."""
    ens = _toy(spark)
    df = cohort_ops.derive_features(v(spark, sf, "cohort"))
    a = ens.score_arrow(df).select("patient_id", F.col("raw_scores").alias("arrow"))
    b = df.select("patient_id", ens.raw_scores().alias("compiled"))
    diff = F.aggregate(F.zip_with("arrow", "compiled", lambda x, y: F.abs(x - y)), F.lit(0.0),
                       lambda acc, x: F.greatest(acc, x))
    return a.join(b, "patient_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(diff > 1e-12).alias("n_mismatch"))


_LOGITS = {"l0": "coalesce(bmi, 0e0) / 10e0", "l1": "coalesce(cast(charlson_index as double), 0e0)",
           "l2": "coalesce(pdf_osmolarity, 0e0) / 100e0", "l3": "coalesce(cast(dwell_time_minutes as double), 0e0) / 300e0"}


def _logits_spark():
    g = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    return F.array(g("bmi") / 10.0, g("charlson_index"), g("pdf_osmolarity") / 100.0, g("dwell_time_minutes") / 300.0)


_SOFTMAX_SQL = cte(*REC_VIEWS, extra=REC_CTES + [
    ("lg", "select patient_id, " + ", ".join(f"{e} as {k}" for k, e in _LOGITS.items()) + " from rec"),
    ("sm", "select patient_id, " + _softmax_sql(list(_LOGITS)) + " from lg")])


@query("softmax", covers=("H20",), sql=_SOFTMAX_SQL + "select patient_id, " + ", ".join(
    f"{_r(f'p{i}')} as p{i}" for i in range(4)) + " from sm")
def softmax(spark, sf):
    rec = _record(spark, sf).withColumn("probs", SC.softmax(_logits_spark()))
    return r6(rec.select("patient_id", *[F.col("probs")[i].alias(f"p{i}") for i in range(4)]))


_AM, _T1, _T2 = _rank_sql([f"p{i}" for i in range(4)])


@query("argmax_top2", covers=("F2", "F3"), sql=_SOFTMAX_SQL + f"""
select patient_id, cast({_AM} as integer) as pred_class, cast({_T1} as integer) as top1,
  cast({_T2} as integer) as top2 from sm""")
def argmax_top2(spark, sf):
    rec = _record(spark, sf).withColumn("probs", SC.softmax(_logits_spark()))
    t = SC.top_k(F.col("probs"), 2)
    return rec.select("patient_id", SC.argmax("probs").alias("pred_class"), t[0].cast("int").alias("top1"),
                      t[1].cast("int").alias("top2"))


def _jsr(x, d):
    f = 10 ** d
    return f"floor(({x}) * {f}e0 + 0.5e0) / {f}e0"


@query("clamp_round", covers=("H21",), sql=cte("cohort", extra=[("b", f"select c.*, {S.DERIVED} from cohort c")]) + f"""
select patient_id, {_jsr('bmi', 2)} as bmi_2dp, {_jsr('waiting_period_days / 4e0', 0)} as waiting_quarter,
  least(greatest(ktv * 1.5e0, 0.5e0), 3.5e0) as ktv_clamped from b""")
def clamp_round(spark, sf):
    df = cohort_ops.derive_features(v(spark, sf, "cohort"))
    return df.select("patient_id", SC.js_round("bmi", 2).alias("bmi_2dp"),
                     SC.js_round(F.col("waiting_period_days") / 4.0, 0).alias("waiting_quarter"),
                     SC.clamp(F.col("ktv") * 1.5, 0.5, 3.5).alias("ktv_clamped"))


_KTV_RAW = ("1.2e0 + 0.002e0 * coalesce(cast(dwell_time_minutes as double), 0e0) / 60 "
            "+ 0.001e0 * (coalesce(pdf_osmolarity, 0e0) - 300) - 0.02e0 * (coalesce(bmi, 0e0) - 24)")
_PET_RAW = ("-3e0 + 0.015e0 * coalesce(blood_creatinine, 0e0) + -0.04e0 * coalesce(blood_albumin, 0e0) "
            "+ 0.002e0 * coalesce(cast(dwell_time_minutes as double), 0e0) + 0.003e0 * coalesce(pdf_osmolarity, 0e0) "
            "+ 0.01e0 * coalesce(bmi, 0e0)")


@query("baseline_scores", covers=("H32", "H21", "H20"), sql=cte(*REC_VIEWS, extra=REC_CTES + [
    ("k", f"select patient_id, least(greatest({_jsr(_KTV_RAW, 2)}, 0.5e0), 3.5e0) as ktv_pred, ({_PET_RAW}) as s from rec"),
    ("pp", "select patient_id, ktv_pred, " + _softmax_sql(["s - 1e0", "s", "s + 0.5e0", "s + 1.2e0"]) + " from k")]) + f"""
select patient_id, {_r('ktv_pred')} as ktv_pred, {_r('least(greatest(ktv_pred - 0.25e0, 0.3e0), 4e0)')} as pi_lo,
  {_r('least(greatest(ktv_pred + 0.25e0, 0.3e0), 4e0)')} as pi_hi, """ + ", ".join(
    f"{_r(_jsr(f'p{i}', 3))} as p{i}" for i in range(4)) + f""",
  cast({_rank_sql([f'p{i}' for i in range(4)])[0]} as integer) as pred_class from pp""")
def baseline_scores(spark, sf):
    """Calculator baseline (linear Kt/V with clamped interval, PET softmax over offset logits)."""
    rec = _record(spark, sf)
    k = SC.ktv_baseline()
    probs = SC.softmax_score(SC.pet_baseline_score(), SC.PET_OFFSETS)
    out = rec.select("patient_id", k.alias("ktv_pred"), probs.alias("probs"))
    iv = SC.interval(F.col("ktv_pred"), *SC.KTV_INTERVAL)
    return r6(out.select("patient_id", "ktv_pred", iv[0].alias("pi_lo"), iv[1].alias("pi_hi"),
                         *[SC.js_round(F.col("probs")[i], 3).alias(f"p{i}") for i in range(4)],
                         SC.argmax("probs").alias("pred_class")))


@query("drivers", covers=("F7",), sql=cte(*REC_VIEWS, extra=REC_CTES) + "select patient_id, concat_ws('|', " + ", ".join(
    f"case when {f} is not null then '{f}:{'+' if w >= 0 else '-'}{abs(w)}' end" for f, w in SC.KTV_DRIVERS)
    + ") as ktv_drivers from rec")
def drivers(spark, sf):
    """Template drivers kept when the feature is present (NULL counts as absent)."""
    rec = _record(spark, sf)
    d = SC.drivers(SC.KTV_DRIVERS, rec.columns)
    txt = F.transform(d, lambda s: F.concat(s["feature"], F.lit(":"), s["direction"], s["weight"].cast("string")))
    return rec.select("patient_id", F.concat_ws("|", txt).alias("ktv_drivers"))

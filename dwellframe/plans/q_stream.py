"""Streaming, audit and sink queries (rows-only checks)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import evaluate as EV
from ..operators import models as M
from ..operators import prep as PR
from ..operators import split as SP
from ..sources import dictionaries as D
from ..sources import sinks
from ..streaming import intake as SI
from ..streaming import scoring as SS
from ..sources.views import cte
from .common import guard_rows, r6, v
from .q_prep import CATS, NUMS
from .q_split import IS_TEST, RANKED, SEED, TEST_SIZE
from .registry import query

VERSION = D.packaged_config()["version"]


def _intake_sql():
    from ..operators import quality as Q
    from ..sources.views import cte
    from .q_intake import REC_CTES, REC_VIEWS
    miss = "concat_ws(',', " + ", ".join(f"case when r.{f} is null then '{f}' end" for f in Q.REQUIRED_FIELDS) + ")"
    nmiss = " + ".join(f"case when r.{f} is null then 1 else 0 end" for f in Q.REQUIRED_FIELDS)
    errs = ("concat_ws(',', case when r.pdf_osmolarity is null then 'pdf_osmolarity' end, "
            "case when r.dwell_time_minutes is null then 'dwell_time_minutes' end)")
    warn = "concat_ws(',', " + ", ".join(f"case when r.{f} < {lo}e0 or r.{f} > {hi}e0 then '{f}' end" for f, lo, hi in guard_rows()) + ")"
    dbl = ["age", "height_cm", "weight_kg", "bmi", "pdf_osmolarity", *D.LAB_FIELDS]
    cols = ", ".join([f"round(r.{c}, 6) + 0e0 as {c}" for c in dbl])
    return cte(*REC_VIEWS, extra=REC_CTES) + f"""
select r.patient_id, {cols}, r.charlson_index, t.inflow, t.outflow, r.dwell_time_minutes,
  {miss} as missing, {errs} as errors, {warn} as warnings, coalesce(r.bmi < 10e0 or r.bmi > 60e0, false) as bmi_warning,
  ({nmiss}) = 0 and r.pdf_osmolarity is not null and r.dwell_time_minutes is not null as is_valid
from rec r join times t on r.patient_id = t.patient_id"""


@query("stream_intake", covers=("K1", "H19", "B3", "B10", "B11"), sql=_intake_sql())
def stream_intake(spark, sf):
    """Orders arrive as a file stream; each record is derived, validated and held against the guard bands; results land in a file sink."""
    osm, labs = SI.static_aggregates(spark, sf)
    out = SI.derive_and_validate(SI.intake_records(spark, sf), osm, labs, guards=guard_rows())
    path = SI.run_to_files(out, "intake")
    return r6(spark.read.parquet(path))


def _fitted(spark, sf, residuals: bool = False):
    s = SP.seeded_split(v(spark, sf, "cohort"), "patient_id", TEST_SIZE, SEED)
    prep = PR.fit_prep(s.train, numeric=NUMS, categorical=CATS, imputation="mean", log_features=["residual_rf"])
    train = PR.apply_prep(s.train, prep).persist()  # fitted on, then scored for its residuals
    ktv = M.fit_ols(train, prep.feature_columns, "ktv")
    offsets = M.residual_offsets(ktv, train, "ktv") if residuals else None
    train.unpersist()
    return prep, ktv, offsets


@query("stream_scoring", covers=("K2", "A8", "I7"))
def stream_scoring(spark, sf):
    """Arriving valid records are scored with state fitted in batch (preparation + linear Kt/V model) and the
    tree-ensemble PET classifier; the stream writes one audit JSON document per record, partitioned by version."""
    from ..operators import trees as TR
    prep, ktv, offsets = _fitted(spark, sf, residuals=True)  # state fitted in batch; the stream only applies it (pure projections)
    osm, labs = SI.static_aggregates(spark, sf)
    records = SI.derive_and_validate(SI.intake_records(spark, sf), osm, labs, keep_all=True)
    audit = SS.score_stream(records, prep, ktv, VERSION, pet_ensemble=TR.Ensemble.load(spark), residuals=offsets)
    path = SI.run_to_files(audit, "scoring", fmt="json", partition_by=["version"])
    return spark.read.json(path)


_AUDIT_SCHEMA = T.StructType([
    T.StructField("version", T.StringType()), T.StructField("generated_at", T.StringType()),
    T.StructField("request", T.StructType([T.StructField("patient_id", T.LongType())])),
    T.StructField("response", T.StructType([T.StructField("model", T.StringType()),
                                            T.StructField("prediction", T.DoubleType())]))])


@query("audit_json", covers=("A8", "A12", "H31"), sql=cte("cohort") + """
select count(*) as n, count(*) as n_consistent, count(*) as n_ids from cohort""")
def audit_json(spark, sf):
    """Batch audit: write JSON per version, read back, decode, and check ids and values survive."""
    prep, ktv, _ = _fitted(spark, sf)
    x = PR.apply_prep(v(spark, sf, "cohort"), prep, keep_targets=False)
    scored = ktv.predict(x, out="prediction").withColumn("model", F.lit(ktv.kind))
    audit = sinks.audit_records(scored, VERSION, ["patient_id", *prep.feature_columns], ["model", "prediction"])
    path = sinks.run_root(spark, "audit")
    sinks.write_audit(audit, path, mode="overwrite")
    back = spark.read.json(path).withColumn("doc", F.from_json("payload", _AUDIT_SCHEMA))
    ok = (F.col("doc.request.patient_id") == F.col("patient_id")) & (F.col("doc.version") == F.col("version")) & \
         (F.col("record_id") == F.sha2(F.col("patient_id").cast("string"), 256))
    return back.agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("n_consistent"),
                    F.countDistinct("record_id").alias("n_ids"))


@query("prep_state_roundtrip", covers=("A10",), sql=cte("cohort", extra=RANKED) + f"""
select count(*) as n, cast(0 as bigint) as n_different, {len(NUMS) + 11} as n_features from ranked where {IS_TEST}""")
def prep_state_roundtrip(spark, sf):
    """Write the fitted parameter table, rebuild the preparation from it, compare outputs on held-out rows."""
    s = SP.seeded_split(v(spark, sf, "cohort"), "patient_id", TEST_SIZE, SEED)
    prep = PR.fit_prep(s.train, numeric=NUMS, categorical=CATS, imputation="median", log_features=["residual_rf"])
    path = sinks.run_root(spark, "prep_state")
    sinks.write_prep_state(prep, spark, path)
    back = sinks.read_prep_state(spark, path)
    a = PR.apply_prep(s.test, prep)
    b = PR.apply_prep(s.test, back)
    cols = prep.feature_columns
    same = F.lit(True)
    for c in cols:
        same = same & F.coalesce(F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) < 1e-12,
                                 F.col(f"a.{c}").isNull() & F.col(f"b.{c}").isNull())
    j = a.alias("a").join(b.alias("b"), "patient_id")
    return j.agg(F.count(F.lit(1)).alias("n"), F.count_if(~same).alias("n_different"),
                 F.lit(len(cols)).alias("n_features"))


@query("selection_sink", covers=("A7",))
def selection_sink(spark, sf):
    from .q_select import _lasso_results
    from ..operators import select as SL
    sel = SL.selection_frame(spark, _lasso_results(spark, sf))
    path = sinks.run_root(spark, "selection")
    sinks.write_selection(sel, path)
    return spark.read.json(path)


def _eval_sink_sql():
    from .q_eval import METRICS_SQL, PRED_OK
    return cte("predictions") + f"""
select target, model, {METRICS_SQL}, cast(10 as bigint) as n_bins
from predictions where {PRED_OK} group by target, model"""


@query("evaluation_sink", covers=("A9",), sql=_eval_sink_sql())
def evaluation_sink(spark, sf):
    pred = v(spark, sf, "predictions")
    path = sinks.run_root(spark, "evaluation")
    sinks.write_evaluation({"metrics": EV.regression_metrics(pred), "calibration": EV.calibration_bins(pred, 10)}, path)
    m = spark.read.parquet(f"{path}/metrics")
    c = spark.read.parquet(f"{path}/calibration")
    return r6(m.join(c.groupBy("target", "model").agg(F.count(F.lit(1)).alias("n_bins")), ["target", "model"]))

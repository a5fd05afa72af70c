"""Streaming scoring with a JSON audit trail (fitted state applied to arriving records)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import prep as PR
from ..sources import sinks


def score_stream(records: DataFrame, prep_model, ktv_model, version: str, key: str = "patient_id",
                 pet_ensemble=None, residuals: tuple[float, float] | None = None) -> DataFrame:
    """Records -> fitted preparation (pure select) -> linear Kt/V model [+ tree-ensemble PET class] -> audit rows.

    ``records`` may be streaming: where a batch fails on a value below -1 of a
    log1p feature, the stream goes on, and that record's document names the
    feature under ``error`` and holds no prediction.  If the records were
    validated (column ``is_valid``) only valid ones are scored.  ``pi_95`` adds
    the model's residual quantiles (``models.residual_offsets``) to the
    prediction; without them it is NULL.  The
    PET ensemble scores the derived (unscaled) features in the same
    projection: probabilities, class and top-2.
    """
    from ..operators import cohort as cohort_ops
    carry = []
    if "is_valid" in records.columns:
        records = records.filter("is_valid")
    if pet_ensemble is not None:
        records = pet_ensemble.score(cohort_ops.derive_features(records), prefix="pet_")
        carry = ["pet_probs", "pet_pred_class", "pet_top2"]
    below = [F.when(F.col(c).cast("double") < -1, F.lit(f"{c} is below -1")) for c in prep_model.log_features if c in records.columns]
    records = records.withColumn("error", F.nullif(F.concat_ws("; ", *below), F.lit("")) if below else F.lit(None).cast("string"))
    x = PR.apply_prep(records, prep_model, key=key, check_log=False, keep_targets=False, passthrough=[*carry, "error"])
    scored = ktv_model.predict(x, out="prediction").withColumn("prediction", F.when(F.col("error").isNull(), F.col("prediction")))
    lo, hi = residuals or (None, None)
    iv = F.when(F.col("prediction").isNotNull() & F.lit(residuals is not None), F.array(*[F.col("prediction") + F.lit(d).cast("double") for d in (lo, hi)]))
    scored = scored.withColumn("pi_95", iv).withColumn("model", F.lit(ktv_model.kind))
    return sinks.audit_records(scored, version, [key, *prep_model.feature_columns], ["model", "prediction", "pi_95", *carry, "error"],
                               key)

"""Score-vector functions on array columns (higher-order functions, no UDF)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .clinical import _c


def softmax(arr) -> Column:
    """exp(v − max) / Σ exp(v − max) over an array<double>."""
    a = _c(arr)
    m = F.array_max(a)
    e = F.transform(a, lambda v: F.exp(v - m))
    s = F.aggregate(e, F.lit(0.0), lambda acc, v: acc + v)
    return F.transform(e, lambda v: v / s)


def argmax(arr) -> Column:
    """First index (0-based) of the maximum."""
    a = _c(arr)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def top_k(arr, k: int = 2) -> Column:
    """Indices of the k largest values, descending; ties go to the lower index (stable order)."""
    a = _c(arr)
    pairs = F.transform(a, lambda v, i: F.struct((-v).alias("neg"), i.alias("idx")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda s: s["idx"])


def js_round(c, digits: int = 2) -> Column:
    """Math.round(x·10^d)/10^d: halves go towards +infinity (Spark's round would go away from zero)."""
    f = float(10 ** digits)
    return (F.floor(_c(c) * f + 0.5).cast("double") / f)


def clamp(c, lo: float, hi: float) -> Column:
    return F.least(F.greatest(_c(c), F.lit(lo)), F.lit(hi))


def linear_score(weights: Mapping[str, float], bias: float) -> Column:
    """bias + Σ w·x with missing x counted as 0 (the calculator's ``x || 0``)."""
    expr = F.lit(float(bias))
    for c, w in weights.items():
        expr = expr + F.lit(float(w)) * F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    return expr


def interval(center, half_width: float, lo: float, hi: float) -> Column:
    """[clamp(c − d), clamp(c + d)] as array<double>."""
    c = _c(center)
    return F.array(clamp(c - half_width, lo, hi), clamp(c + half_width, lo, hi))


def softmax_score(score, offsets: Sequence[float]) -> Column:
    """Class probabilities of logits score + offset_k."""
    s = _c(score)
    return softmax(F.array(*[s + F.lit(float(o)) for o in offsets]))


def drivers(template: Sequence[tuple[str, float]], present: Sequence[str]) -> Column:
    """array<struct<feature, direction, weight>> of template entries whose feature is present (not NULL)."""
    items = []
    for feat, w in template:
        st = F.struct(F.lit(feat).alias("feature"), F.lit("+" if w >= 0 else "-").alias("direction"),
                      F.lit(abs(float(w))).alias("weight"))
        items.append(F.when(F.col(feat).isNotNull(), st) if feat in present else F.lit(None).cast(
            "struct<feature:string,direction:string,weight:double>"))
    return F.filter(F.array(*items), lambda x: x.isNotNull())


# ---------------------------------------------------------------------------
# The calculator's linear baseline (offline mock service),
# re-aimed as a baseline score; never presented as a trained model.
# ---------------------------------------------------------------------------
KTV_BASELINE_BIAS = 1.2
KTV_BASELINE = {"dwell_time_minutes": 0.002 / 60, "pdf_osmolarity": 0.001, "bmi": -0.02}
KTV_BASELINE_CENTRES = {"pdf_osmolarity": 300.0, "bmi": 24.0}
KTV_RANGE = (0.5, 3.5)
KTV_INTERVAL = (0.25, 0.3, 4.0)
PET_BASELINE_BIAS = -3.0
PET_BASELINE = {"blood_creatinine": 0.015, "blood_albumin": -0.04, "dwell_time_minutes": 0.002,
                "pdf_osmolarity": 0.003, "bmi": 0.01}
PET_OFFSETS = (-1.0, 0.0, 0.5, 1.2)
KTV_DRIVERS = (("blood_creatinine", -0.12), ("pdf_urea", 0.08), ("bmi", -0.06))
PET_DRIVERS = (("blood_creatinine", 0.11), ("dwell_time_minutes", 0.09), ("pdf_osmolarity", 0.05))


def ktv_baseline() -> Column:
    """clamp(round2(1.2 + 0.002·dwell/60 + 0.001·(osm − 300) − 0.02·(bmi − 24)), 0.5, 3.5); missing -> 0."""
    g = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    raw = (F.lit(KTV_BASELINE_BIAS) + F.lit(0.002) * g("dwell_time_minutes") / 60
           + F.lit(0.001) * (g("pdf_osmolarity") - 300) - F.lit(0.02) * (g("bmi") - 24))
    return clamp(js_round(raw, 2), *KTV_RANGE)


def pet_baseline_score() -> Column:
    return linear_score(PET_BASELINE, PET_BASELINE_BIAS)

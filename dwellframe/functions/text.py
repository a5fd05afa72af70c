"""Display text as Column expressions: class labels, number formats, titles, joined notes.

Text rounding is engine specific (Spark formats the decimal expansion, a
browser the binary value), so checks compare the numbers, not these strings.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .clinical import _c, is_finite

# PET class labels (index -> label), fallback dash, note separator.
PET_CLASS_LABELS: tuple[str, ...] = ("Low", "Low Average", "High Average", "High")
DASH = "–"
SEP = " · "
ARROW = " → "


def class_label(idx) -> Column:
    """0..3 -> PET class label; any other index -> "Class n"; NULL -> NULL."""
    i = _c(idx)
    expr = F.when(i.isNull(), F.lit(None).cast("string"))
    for k, lab in enumerate(PET_CLASS_LABELS):
        expr = expr.when(i == k, F.lit(lab))
    return expr.otherwise(F.concat(F.lit("Class "), i.cast("string")))


def format_number(c, digits: int = 2, fallback: str = DASH) -> Column:
    """Fixed decimals; NULL/NaN -> fallback."""
    x = _c(c).cast("double")
    return F.when(x.isNull() | F.isnan(x), F.lit(fallback)).otherwise(
        F.format_string(f"%.{digits}f", x))


def format_integer(c, fallback: str = DASH) -> Column:
    """Rounded half up (towards +inf) to an integer text; non-finite -> fallback."""
    x = _c(c).cast("double")
    return F.when(~is_finite(x), F.lit(fallback)).otherwise(F.floor(x + 0.5).cast("bigint").cast("string"))


def format_probability(c, fallback: str = "0.0%") -> Column:
    x = _c(c).cast("double")
    return F.when(~is_finite(x), F.lit(fallback)).otherwise(F.concat(F.format_string("%.1f", x * 100), F.lit("%")))


def adaptive_number(c) -> Column:
    """0 -> "0"; |x| >= 1000 -> 1 decimal; >= 10 -> 2 decimals; else 3 decimals."""
    x = _c(c).cast("double")
    a = F.abs(x)
    return (F.when(~is_finite(x), x.cast("string"))
            .when(a == 0, F.lit("0"))
            .when(a >= 1000, F.format_string("%.1f", x))
            .when(a >= 10, F.format_string("%.2f", x))
            .otherwise(F.format_string("%.3f", x)))


def title_case(c) -> Column:
    """Lower-case, then upper-case the first letter of every space-separated word."""
    s = F.lower(_c(c))
    words = F.split(s, " ")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 2**31 - 1))), " ")


def feature_label(c) -> Column:
    """"blood_creatinine" -> "Blood Creatinine": '_' -> ' ', a-z after a non-word character upper-cased."""
    words = F.split(F.replace(_c(c), F.lit("_"), F.lit(" ")), "(?<=[^A-Za-z0-9_])", -1)  # each with the character that ends it
    letters = "abcdefghijklmnopqrstuvwxyz"
    return F.array_join(F.transform(words, lambda w: F.concat(F.translate(F.substring(w, 1, 1), letters, letters.upper()), F.substring(w, 2, 2**31 - 1))), "")


def units_equal(a, b) -> Column:
    """Case-insensitive equality, missing treated as the empty text."""
    return F.lower(F.coalesce(_c(a), F.lit(""))) == F.lower(F.coalesce(_c(b), F.lit("")))


def dwell_text(inflow, outflow) -> Column:
    """"HH:mm → HH:mm" or "Incomplete" when a time is missing or empty."""
    i, o = _c(inflow), _c(outflow)
    ok = F.coalesce(i != "", F.lit(False)) & F.coalesce(o != "", F.lit(False))
    return F.when(ok, F.concat(i, F.lit(ARROW), o)).otherwise(F.lit("Incomplete"))


def reliability_text(ece, note) -> Column:
    """"Reliability: ECE 0.39 · note"; no parts -> "Reliability: –"."""
    e = _c(ece).cast("double")
    parts = F.filter(F.array(F.when(is_finite(e), F.concat(F.lit("ECE "), format_number(e, 2))),
                             F.nullif(_c(note), F.lit(""))), lambda x: x.isNotNull())
    return F.when(F.size(parts) == 0, F.lit(f"Reliability: {DASH}")).otherwise(
        F.concat(F.lit("Reliability: "), F.array_join(parts, SEP)))

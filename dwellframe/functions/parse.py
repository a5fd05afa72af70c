"""Text parsing as Column expressions (ANSI-safe: ``try_*`` never fails a job)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .clinical import _c, is_finite

NUMBER_PREFIX = r"^\s*([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)"
INT_PREFIX = r"^\s*([+-]?\d+)"
DEFAULT_DATE_FORMATS: tuple[str, ...] = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd",
                                         "yyyy/MM/dd", "dd.MM.yyyy")


def to_number(c) -> Column:
    """Coerce to double; blank/unparseable/non-finite -> NULL (``to_numeric(errors='coerce')``)."""
    v = F.trim(_c(c).cast("string"))
    d = F.nullif(v, F.lit("")).try_cast("double")
    return F.when(is_finite(d), d)


def number_prefix(c) -> Column:
    """Leading number of a text ("2.5L" -> 2.5), like ``parseFloat``; none -> NULL."""
    m = F.regexp_extract(_c(c).cast("string"), NUMBER_PREFIX, 1)
    return F.nullif(m, F.lit("")).try_cast("double")


def int_prefix(c) -> Column:
    """Leading integer of a text ("3.7" -> 3), like ``parseInt(x, 10)``; none -> NULL."""
    m = F.regexp_extract(_c(c).cast("string"), INT_PREFIX, 1)
    return F.nullif(m, F.lit("")).try_cast("bigint")


def parse_time_minutes(c) -> Column:
    """"HH:mm" -> minutes since midnight; hours 0-23, minutes 0-59, else NULL."""
    s = _c(c).cast("string")
    hh = int_prefix(F.split_part(s, F.lit(":"), F.lit(1)))
    mm = int_prefix(F.split_part(s, F.lit(":"), F.lit(2)))
    ok = hh.between(0, 23) & mm.between(0, 59)
    return F.when(ok, (hh * 60 + mm).cast("int"))


def dwell_minutes(inflow, outflow) -> Column:
    """outflow - inflow in minutes; <= 0 wraps past midnight (+1440, equal times -> 1440)."""
    i, o = parse_time_minutes(inflow), parse_time_minutes(outflow)
    d = o - i
    return F.when(d <= 0, d + 1440).otherwise(d)


def parse_timestamp(c, formats: Sequence[str] = DEFAULT_DATE_FORMATS) -> Column:
    """First format that parses wins; unparseable -> NULL (``errors='coerce'``)."""
    s = _c(c)
    return F.coalesce(*[F.try_to_timestamp(s.cast("string"), F.lit(f)) for f in formats])

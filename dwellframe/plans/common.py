"""Helpers shared by the query plans."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import dictionaries as D
from ..sources import views

DIGITS = 6


def v(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return views.view(spark, sf, name)


def round_binary(c, digits: int = DIGITS):
    """Round half away from zero on the binary value: sign(x) * floor(|x| * 10^d + 0.5) / 10^d.

    This is how the DuckDB oracle rounds doubles (``round(x, d)``); Spark's own
    ``round`` rounds the shortest decimal text instead, so the two disagree on
    values such as 2.0440875.  Magnitudes beyond 1e12 are left as they are.
    """
    x = F.col(c) if isinstance(c, str) else c
    m = float(10 ** digits)
    r = F.signum(x) * F.floor(F.abs(x) * m + 0.5).cast("double") / m
    return F.when(F.abs(x) < 1e12, r).otherwise(x) + F.lit(0.0)


def r6(df: DataFrame, cols: Iterable[str] | None = None, digits: int = DIGITS) -> DataFrame:
    """Round double columns for engine-independent comparison (``+ 0.0`` folds -0.0)."""
    names = set(cols) if cols is not None else {c for c, t in df.dtypes if t in ("double", "float")}
    return df.select(*[round_binary(c, digits).alias(c) if c in names else F.col(c) for c in df.columns])


def values_sql(rows: Sequence[Sequence], cols: Sequence[str]) -> str:
    """A DuckDB ``VALUES`` relation for a fixed dictionary (oracle side)."""

    def lit(x):
        if x is None:
            return "null"
        if isinstance(x, bool):
            return "true" if x else "false"
        if isinstance(x, (int,)):
            return str(x)
        if isinstance(x, float):
            return repr(float(x)) + ("e0" if "e" not in repr(float(x)) else "")
        return "'" + str(x).replace("'", "''") + "'"

    body = ", ".join("(" + ", ".join(lit(x) for x in r) + ")" for r in rows)
    return f"(select * from (values {body}) t({', '.join(cols)}))"


def lab_units_rows() -> list[tuple[str, str]]:
    doc = D.packaged_config()
    return [(k, v["expected"]) for k, v in doc["units"]["labs"].items()]


def guard_rows() -> list[tuple[str, float, float]]:
    doc = D.packaged_config()
    g = doc["guards"]
    out = [(k, float(v["min"]), float(v["max"])) for k, v in g.items() if k != "labs"]
    out += [(k, float(v["min"]), float(v["max"])) for k, v in g["labs"].items()]
    return out


LAB_UNITS_SQL = values_sql(lab_units_rows(), ["analyte", "expected"])
FACTORS_SQL = values_sql([r for r in D.UNIT_FACTORS], ["analyte", "from_unit", "to_unit", "factor", "op"])
GUARDS_SQL = values_sql(guard_rows(), ["field", "min", "max"])

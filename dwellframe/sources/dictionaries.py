"""Reference dictionaries (bags, lab units, guard bands, Charlson weights, unit factors).

The calculator configuration is JSON.  It is parsed by Spark (``from_json`` +
``posexplode``) into small dimension tables; their size is fixed by the
configuration, so joining them with ``F.broadcast`` has a proven bound.

On a cluster pass ``path`` on shared storage (read with ``spark.read.json``);
without a path the packaged configuration text is parsed.
"""

from __future__ import annotations

import json
from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.clinical import CCI_BASE_WEIGHTS

_RESOURCE = Path(__file__).parent / "resources" / "calculator.json"

# ---------------------------------------------------------------------------
# Laboratory unit conversions (analyte, from unit, to unit,
# factor, applied as multiply or divide), as in the calculator.
# ---------------------------------------------------------------------------
CREATININE_MOLAR_MASS = 113.12
UNIT_FACTORS: tuple[tuple[str, str, str, float, str], ...] = (
    ("pdf_urea", "mg/dl", "mmol/l", 0.1665, "mul"),
    ("pdf_urea", "mmol/l", "mg/dl", 0.1665, "div"),
    ("blood_urea", "mg/dl", "mmol/l", 0.1665, "mul"),
    ("blood_urea", "mmol/l", "mg/dl", 0.1665, "div"),
    ("pdf_creatinine", "umol/l", "mg/dl", 88.4, "div"),
    ("pdf_creatinine", "mg/dl", "umol/l", 88.4, "mul"),
    ("blood_creatinine", "umol/l", "mg/dl", 88.4, "div"),
    ("blood_creatinine", "mg/dl", "umol/l", 88.4, "mul"),
    ("pdf_protein", "g/l", "g/dl", 10.0, "div"),
    ("pdf_protein", "g/dl", "g/l", 10.0, "mul"),
    ("blood_albumin", "g/l", "g/dl", 10.0, "div"),
    ("blood_albumin", "g/dl", "g/l", 10.0, "mul"),
    ("blood_protein", "g/l", "g/dl", 10.0, "div"),
    ("blood_protein", "g/dl", "g/l", 10.0, "mul"),
    ("urine_protein_creatinine", "mg/mg", "mg/mmol", CREATININE_MOLAR_MASS, "mul"),
    ("urine_protein_creatinine", "mg/mmol", "mg/mg", CREATININE_MOLAR_MASS, "div"),
)

LAB_FIELDS: tuple[str, ...] = ("pdf_urea", "pdf_creatinine", "pdf_protein", "urine_protein_creatinine",
                               "blood_urea", "blood_creatinine", "blood_albumin", "blood_protein")

_BAG = T.StructType([T.StructField("id", T.StringType()), T.StructField("brand", T.StringType()),
                     T.StructField("concentration", T.StringType()),
                     T.StructField("osm_mOsmL", T.DoubleType())])
_UNIT = T.StructType([T.StructField("expected", T.StringType()),
                      T.StructField("options", T.ArrayType(T.StringType()))])
_GUARD = T.StructType([T.StructField("min", T.DoubleType()), T.StructField("max", T.DoubleType())])
CONFIG_SCHEMA = T.StructType([
    T.StructField("version", T.StringType()),
    T.StructField("bags", T.ArrayType(_BAG)),
    T.StructField("units", T.StructType([T.StructField("labs", T.MapType(T.StringType(), _UNIT))])),
    T.StructField("guards", T.MapType(T.StringType(), T.StringType())),
])


@lru_cache(maxsize=1)
def config_text() -> str:
    return _RESOURCE.read_text(encoding="utf-8")


def config_frame(spark: SparkSession, path: str | None = None) -> DataFrame:
    """One-row frame of the parsed calculator configuration."""
    if path:
        return spark.read.schema(CONFIG_SCHEMA).json(path, multiLine=True)
    raw = spark.createDataFrame([(config_text(),)], "doc string")
    return raw.select(F.from_json("doc", CONFIG_SCHEMA).alias("c")).select("c.*")


def check_config(doc: dict) -> None:
    """Driver-side validation of a configuration document (bags non-empty, ids present)."""
    bags = doc.get("bags") or []
    if not bags:
        raise ValueError("configuration has no dialysate bags")
    for b in bags:
        if not b.get("id"):
            raise ValueError("bag without id")


def _packaged(df: DataFrame, path: str | None) -> DataFrame:
    """The packaged dictionaries have a fixed few rows, so joins may broadcast them; a caller's own are left to Spark."""
    return df if path else df.hint("broadcast")


def bags(spark: SparkSession, path: str | None = None) -> DataFrame:
    """bag_no (position), bag_id, brand, concentration, osm."""
    return _packaged(config_frame(spark, path)
                     .select(F.posexplode("bags").alias("bag_no", "b"))
                     .select(F.col("bag_no").cast("int"), F.col("b.id").alias("bag_id"), "b.brand",
                             "b.concentration", F.col("b.osm_mOsmL").alias("osm")), path)


def lab_units(spark: SparkSession, path: str | None = None) -> DataFrame:
    """analyte, expected unit, options text."""
    return _packaged(config_frame(spark, path)
                     .select(F.explode("units.labs").alias("analyte", "u"))
                     .select("analyte", F.col("u.expected").alias("expected"),
                             F.concat_ws("|", "u.options").alias("options")), path)


def guards(spark: SparkSession, path: str | None = None) -> DataFrame:
    """field, min, max for the demographic and laboratory guard bands."""
    g = config_frame(spark, path).select(F.explode("guards").alias("k", "v"))
    pair = T.StructType([T.StructField("min", T.DoubleType()), T.StructField("max", T.DoubleType())])
    labs = T.MapType(T.StringType(), pair)
    top = g.filter(F.col("k") != "labs").select(
        F.col("k").alias("field"), F.from_json("v", pair).alias("g"))
    lab = g.filter(F.col("k") == "labs").select(F.explode(F.from_json("v", labs)).alias("field", "g"))
    return _packaged(top.unionByName(lab).select("field", F.col("g.min").alias("min"), F.col("g.max").alias("max")), path)


def cci_weights(spark: SparkSession, weights: dict[str, int] | None = None) -> DataFrame:
    """code, weight (19 base weights, optionally overridden)."""
    w = {**CCI_BASE_WEIGHTS, **(weights or {})}
    return spark.createDataFrame(sorted(w.items()), "code string, weight int")


def unit_factors(spark: SparkSession) -> DataFrame:
    """analyte, from_unit, to_unit (lower case), factor, op ('mul' | 'div')."""
    return _packaged(spark.createDataFrame(list(UNIT_FACTORS),
                                           "analyte string, from_unit string, to_unit string, factor double, op string"), None)


def packaged_config() -> dict:
    doc = json.loads(config_text())
    check_config(doc)
    return doc

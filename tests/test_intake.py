"""Calculator feature derivation (reference JS tests) through the Spark operators."""
from pyspark.sql import functions as F

from dwellframe.functions import clinical as C
from dwellframe.functions import parse as P
from dwellframe.operators import intake as I
from dwellframe.operators import quality as Q
from dwellframe.sources import dictionaries as D


def test_derive_features_reference_case(spark):
    pat = spark.createDataFrame([(1, "57", 168.0, "cm", 70.0, "kg", "NIPD", None, None, "20:00", "08:00")],
                                "patient_id int, age string, hv double, hu string, wv double, wu string, modality string, "
                                "capd_bag_no string, ccpd_day_bag_no string, inflow string, outflow string")
    flags = {k: k in ("chf", "dm_cx") for k in C.CALCULATOR_FLAG_CODES}
    pat = pat.withColumns({k: F.lit(v) for k, v in flags.items()})
    h, w = C.normalize_height("hv", "hu"), C.normalize_weight("wv", "wu")
    rec = pat.select("patient_id", P.to_number("age").alias("age"), h.alias("height_cm"), w.alias("weight_kg"),
                     C.bmi(w, h).alias("bmi"),
                     C.charlson_index(C.CALCULATOR_FLAG_CODES, P.to_number("age")).alias("charlson_index"),
                     P.dwell_minutes(F.col("inflow"), F.col("outflow")).alias("dwell"))
    r = rec.first()
    assert abs(r.bmi - 24.8) < 0.05 and r.charlson_index == 6 and r.dwell == 720

    bags = spark.createDataFrame([("bag_a", 346.0), ("bag_b", 396.0)], "bag_id string, osm double")
    shifts = spark.createDataFrame([(1, "bag_a", "2", "3"), (1, "bag_b", "2", "2")],
                                   "patient_id int, bag_id string, volume_l string, cycles string")
    regimen = pat.select("patient_id", "modality", "capd_bag_no", "ccpd_day_bag_no")
    osm = I.osmolarity(regimen, shifts, bags, on="bag_id", capd_bag="capd_bag_no", day_bag="ccpd_day_bag_no").first()
    assert abs(osm.pdf_osmolarity - 366) < 0.2 and osm.osm_reason is None

    labs = spark.createDataFrame([
        (1, "pdf_urea", 10.2, "mmol/L"), (1, "pdf_creatinine", 0.9, "mg/dL"), (1, "pdf_protein", 0.15, "g/dL"),
        (1, "urine_protein_creatinine", 12.0, "mg/mg"), (1, "blood_urea", 25.0, "mg/dL"),
        (1, "blood_creatinine", 7.2, "mg/dL"), (1, "blood_albumin", 3.6, "g/dL"), (1, "blood_protein", 6.5, "g/dL")],
        "patient_id int, analyte string, value double, unit string")
    wide = I.labs_wide(I.convert_labs(labs, D.lab_units(spark), D.unit_factors(spark))).first()
    assert abs(wide.pdf_creatinine - 0.9 * 88.4) < 0.01
    assert abs(wide.pdf_protein - 1.5) < 0.01
    assert abs(wide.urine_protein_creatinine - 12 * 113.12) < 0.5
    assert abs(wide.blood_urea - 25 * 0.1665) < 0.01
    assert abs(wide.blood_creatinine - 7.2 * 88.4) < 0.05
    assert abs(wide.blood_albumin - 36) < 0.01 and abs(wide.blood_protein - 65) < 0.1
    assert wide.pdf_urea == 10.2


def test_unknown_unit_rule_keeps_value(spark):
    labs = spark.createDataFrame([(1, "pdf_creatinine", 5.0, "g/dL"), (1, "blood_albumin", None, "g/dL")],
                                 "patient_id int, analyte string, value double, unit string")
    rows = {r.analyte: r for r in I.convert_labs(labs, D.lab_units(spark), D.unit_factors(spark)).collect()}
    assert rows["pdf_creatinine"].value_converted == 5.0 and not rows["pdf_creatinine"].converted
    assert rows["pdf_creatinine"].unit_changed
    assert rows["blood_albumin"].value_converted is None


def test_shift_validity_and_modalities(spark):
    bags = D.bags(spark)
    shifts = spark.createDataFrame([(1, 5, 2.0, 1), (1, 0, 0.0, 1), (2, 1, 2.0, 0), (3, 0, 2.0, 1)],
                                   "patient_id int, bag_no int, volume_l double, cycles int")
    reg = spark.createDataFrame([(1, "nipd", None, None), (2, "CCPD", None, None), (3, "CCPD", None, 7),
                                 (4, "capd", 1, None), (5, "HD", None, None)],
                                "patient_id int, modality string, capd_bag_no int, ccpd_day_bag_no int")
    out = {r.patient_id: (r.pdf_osmolarity, r.osm_reason) for r in I.osmolarity(reg, shifts, bags).collect()}
    assert out[1] == (None, "Add night cycles")      # unknown bag and zero volume skipped
    assert out[2] == (None, "Add night cycles")      # zero count skipped
    assert out[3] == (None, "Unknown bag")           # CCPD day bag set but unknown
    assert out[4] == (396.0, None)
    assert out[5] == (None, "Unsupported modality")


def _features(spark, creat, bcreat):
    cols = dict(age=57.0, height_cm=168.0, weight_kg=70.0, bmi=24.8, charlson_index=6, pdf_osmolarity=366.6,
                dwell_time_minutes=720, pdf_urea=10.2, pdf_creatinine=creat, pdf_protein=1.5,
                urine_protein_creatinine=450.0, blood_creatinine=bcreat, blood_albumin=36.0, blood_protein=65.0)
    schema = ", ".join(f"{k} double" for k in cols)
    return spark.createDataFrame([tuple(float(v) if v is not None else None for v in cols.values())], schema) \
        .withColumn("patient_id", F.lit(1))


def test_validation_reference_case(spark):
    guards = spark.createDataFrame([("age", 18.0, 110.0), ("height_cm", 120.0, 220.0), ("weight_kg", 30.0, 200.0),
                                    ("blood_creatinine", 200.0, 1800.0)], "field string, min double, max double")
    bad = Q.validity(_features(spark, None, 1900.0)).first()
    assert "pdf_creatinine" in bad.missing and not bad.is_valid
    warn = Q.guard_warnings(Q.to_long(_features(spark, None, 1900.0), list(Q.REQUIRED_FIELDS)), guards).collect()
    assert [w.field for w in warn] == ["blood_creatinine"]
    assert warn[0].message == "blood creatinine above guard maximum (1800)."
    good = Q.validity(_features(spark, 0.9, 650.0)).first()
    assert good.is_valid and len(good.missing) == 0


def test_range_violations_fail_mode(spark):
    import pytest
    df = spark.createDataFrame([(1, 5.5), (2, None)], "patient_id int, ktv double")
    assert Q.range_violations(df, {"ktv": (0.5, 4.0), "absent": (0, 1)}).count() == 1
    with pytest.raises(ValueError):
        Q.range_violations(df, {"ktv": (0.5, 4.0)}, mode="fail")


def test_nested_record_matches_reference_case(spark):
    flags = {k: k in ("chf", "dm_cx") for k in C.CALCULATOR_FLAG_CODES}
    rec = ("r1", ("57", "168", "cm", "70", "kg"), flags,
           ("NIPD", "", "", [("bag_a", "2", "3"), ("bag_b", "2", "2")], "", []),
           ("20:00", "08:00"),
           {"pdf_urea": ("10.2", "mmol/L"), "pdf_creatinine": ("0.9", "mg/dL"), "pdf_protein": ("0.15", "g/dL"),
            "urine_protein_creatinine": ("12", "mg/mg"), "blood_urea": ("25", "mg/dL"),
            "blood_creatinine": ("7.2", "mg/dL"), "blood_albumin": ("3.6", "g/dL"), "blood_protein": ("6.5", "g/dL")})
    df = spark.createDataFrame([rec], I.INTAKE_SCHEMA)
    bags = spark.createDataFrame([("bag_a", 346.0), ("bag_b", 396.0)], "bag_id string, osm double")
    r = I.derive_nested(df, bags, D.lab_units(spark), D.unit_factors(spark)).first()
    assert abs(r.bmi - 24.8) < 0.05 and r.charlson_index == 6
    assert abs(r.pdf_osmolarity - 366) < 0.2 and r.dwell_time_minutes == 720
    assert abs(r.pdf_creatinine - 79.56) < 0.01 and abs(r.pdf_protein - 1.5) < 0.01
    assert abs(r.urine_protein_creatinine - 1357.44) < 0.5 and abs(r.blood_urea - 4.1625) < 0.01
    assert abs(r.blood_creatinine - 636.48) < 0.05 and abs(r.blood_albumin - 36) < 0.01
    assert abs(r.blood_protein - 65) < 0.1 and r.pdf_urea == 10.2


def test_nested_equals_long_form(spark):
    """Same shifts through the nested (higher-order functions) and long (explode-free join + groupBy) paths."""
    bags = D.bags(spark)
    ids = [r.bag_id for r in bags.orderBy("bag_no").collect()]
    shifts = [[(ids[0], "2", "3"), (ids[1], "1.5L", "2")], [(ids[2], "2", "0"), ("unknown", "2", "1")],
              [(ids[3], "2.5", "1"), (ids[4], "1", "4"), (ids[0], "0", "2")]]
    recs = [(f"r{i}", ("60", "170", "cm", "70", "kg"), {}, ("NIPD", None, None, s, None, None), ("10:00", "12:00"), {})
            for i, s in enumerate(shifts)]
    nested = {r.record_id: r.pdf_osmolarity for r in
              I.derive_nested(spark.createDataFrame(recs, I.INTAKE_SCHEMA), bags, D.lab_units(spark),
                              D.unit_factors(spark)).collect()}
    long = spark.createDataFrame([(f"r{i}", b, v, c) for i, s in enumerate(shifts) for b, v, c in s],
                                 "patient_id string, bag_id string, volume_l string, cycles string")
    agg = {r.patient_id: r.shift_osmolarity for r in I.shift_osmolarity(long, bags, on="bag_id").collect()}
    assert set(nested) == set(agg)
    for k in nested:
        assert (nested[k] is None and agg[k] is None) or abs(nested[k] - agg[k]) < 1e-9


def test_prediction_range_check(spark):
    import pytest
    ok = spark.createDataFrame([(1.2,), (2.5,), (3.8,)], "y_pred double")
    bad = spark.createDataFrame([(0.05,), (0.9,)], "y_pred double")
    assert Q.validate_prediction_ranges(ok, "ktv") and not Q.validate_prediction_ranges(bad, "pet")
    with pytest.raises(ValueError):
        Q.validate_prediction_ranges(ok, "urea")


def test_conversion_note(spark):
    labs = spark.createDataFrame([(1, "pdf_creatinine", 0.9, "mg/dL"), (1, "pdf_urea", 10.2, "MMOL/l")],
                                 "patient_id int, analyte string, value double, unit string")
    rows = {r.analyte: r for r in I.convert_labs(labs, D.lab_units(spark), D.unit_factors(spark)).collect()}
    assert rows["pdf_creatinine"].note == "0.900 mg/dL → 79.56 umol/L"
    assert rows["pdf_urea"].note is None

"""Goldens of the reference's clinical helpers plus edge rows."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from dwellframe.functions import clinical as C
from dwellframe.operators import cohort as CO
from dwellframe.operators import quality as Q


def test_bmi_bsa_goldens(spark):
    r = spark.createDataFrame([(70.0, 175.0)], "w double, h double").select(
        C.bmi("w", "h").alias("bmi"), C.bsa_du_bois("w", "h").alias("bsa")).first()
    assert round(r.bmi, 2) == 22.86
    assert round(r.bsa, 4) == 1.8481


def test_body_metrics_invalid_are_null_together(spark):
    rows = [(70.0, 0.0), (0.0, 170.0), (None, 170.0), (-5.0, 170.0)]
    out = spark.createDataFrame(rows, "w double, h double").select(
        *[c.alias(n) for n, c in C.body_metrics("w", "h").items()], C.bmi("w", "h").alias("helper")).collect()
    assert all(r.bmi is None and r.bsa is None for r in out)
    assert out[0].helper is None          # height <= 0 -> missing
    assert out[1].helper == 0.0           # weight 0 alone is allowed by the BMI helper


@pytest.mark.parametrize("age,pts", [(49.99, 0), (50.0, 1), (59.0, 1), (65.0, 2), (79.9, 3), (89.99, 4), (90.0, 5),
                                     (None, None)])
def test_age_points(spark, age, pts):
    r = spark.createDataFrame([(age,)], "a double").select(C.age_points("a").alias("p")).first()
    assert r.p == pts


def test_charlson_goldens(spark):
    df = spark.createDataFrame([(1, 1, 65.0, "x")], "dm int, mi int, age double, custom string")
    six = df.select(C.charlson_index({"dm": "diabetes", "mi": "myocardial_infarction"}, F.col("age"))).first()[0]
    assert six == 6
    three = df.select(C.charlson_index({"custom": "custom"}, None, weights={"custom": 3}, include_renal=False,
                                       replace_weights=True)).first()[0]
    # "custom" is a text flag: only TRUE / non-zero numbers count -> 0 here
    assert three == 0
    three = spark.createDataFrame([(1,)], "custom int").select(
        C.charlson_index({"custom": "custom"}, None, weights={"custom": 3}, include_renal=False,
                         replace_weights=True)).first()[0]
    assert three == 3


def test_charlson_missing_values(spark):
    df = spark.createDataFrame([(None, None), (0, 49.0)], "mi int, age double")
    got = [r[0] for r in df.select(C.charlson_index({"mi": "myocardial_infarction"}, F.col("age"))).collect()]
    assert got == [2, 2]   # NULL flag not present; NULL age adds 0; renal constant always
    assert df.select(C.charlson_index({}, F.col("age"))).first()[0] == 0   # no mapping -> 0 for everybody


def test_time_interval_goldens(spark):
    d = lambda s: dt.datetime.fromisoformat(s)
    df = spark.createDataFrame([(d("2023-01-01"), d("2023-01-11"), d("2022-12-20"), d("2023-02-10")),
                                (d("2023-01-10"), d("2023-01-20"), d("2023-01-05"), d("2023-02-15"))],
                               "egfr timestamp, pd timestamp, tki timestamp, assess timestamp")
    out = df.select(*[c.alias(n) for n, c in C.time_intervals("egfr", "pd", "tki", "assess").items()]).collect()
    assert out[0].failure_period_days == 10
    assert out[1].waiting_period_days == 15
    assert out[0].pd_period_days == 30


def test_interval_floor_with_clock_times(spark):
    df = spark.createDataFrame([(dt.datetime(2023, 1, 2, 12), dt.datetime(2023, 1, 1, 18))], "s timestamp, e timestamp")
    assert df.select(C.days_between("s", "e")).first()[0] == -1.0   # floor of -18 h


def test_plausibility(spark):
    df = spark.createDataFrame([("ktv", "m", 1.2), ("ktv", "m", 2.5), ("ktv", "m", 3.8),
                                ("pet", "m", 0.05), ("pet", "m", 0.9)], "target string, model string, y_pred double")
    res = {r.target: r.all_in_range for r in Q.plausibility(df).collect()}
    assert res == {"ktv": True, "pet": False}


def test_derive_features_columns(spark):
    df = spark.createDataFrame(
        [(60.0, 70.0, 170.0, 1, 0, dt.date(2023, 1, 1), dt.date(2023, 1, 15), dt.date(2022, 12, 20), dt.date(2023, 3, 1))],
        "age double, weight_kg double, height_cm double, mi int, chf int, egfr_date date, pd_start_date date, "
        "tki_date date, assessment_date date")
    out = CO.derive_features(df)
    for c in ("bmi", "bsa", "charlson_index", "failure_period_days", "waiting_period_days", "pd_period_days"):
        assert c in out.columns
    assert out.first().charlson_index == 1 + 2 + 2


def test_day_intervals_ignore_daylight_saving(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.createDataFrame([(dt.date(2023, 3, 11), dt.date(2023, 3, 13),
                                     dt.datetime(2023, 3, 11, 12), dt.datetime(2023, 3, 13, 11))],
                                   "s date, e date, sn timestamp_ntz, en timestamp_ntz")
        r = df.select(C.days_between("s", "e", "date").alias("d"),
                      C.days_between("sn", "en", "timestamp_ntz").alias("n")).first()
        assert r.d == 2.0 and r.n == 1.0
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_feature_label_visits_words_not_characters(spark):
    from dwellframe.functions import text as TX
    texts = ["blood_creatinine", "", None, "_a__b", "a-b.c d", "1a b2c", "Äa éa", "x\ny", "😀z q😀", "ABC_dEF", " lead", "trail_", "-", "it's"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.u for r in df.select("i", TX.feature_label("t").alias("u")).orderBy("i").collect()]

    def plain(t):
        t = t.replace("_", " ")
        ok = "abcdefghijklmnopqrstuvwxyz"
        word = ok + ok.upper() + "0123456789_"
        return "".join(ch.upper() if ch in ok and (i == 0 or t[i - 1] not in word) else ch for i, ch in enumerate(t))

    assert got == [None if t is None else plain(t) for t in texts]
    plan = df.select(TX.feature_label("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan.upper()

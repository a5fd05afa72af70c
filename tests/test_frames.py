"""Header flattening, rename/require, date coercion, CRF ingest."""
import pytest
from pyspark.sql import functions as F

from dwellframe.functions import parse as P
from dwellframe.sources import crf


def test_flatten_multi_row_header():
    assert crf.flatten_header([["Visit", "Visit"], ["Site", "Nurse"]]) == ["Visit::Site", "Visit::Nurse"]
    assert crf.flatten_header([["", "Visit", ""], ["Record", "Site", "Nurse"]]) == \
        ["Unnamed: 0_level_0::Record", "Visit::Site", "Visit::Nurse"]


def test_flatten_single_row_strips():
    assert crf.flatten_header([[" Clinic", "Ward  "]]) == ["Clinic", "Ward"]


def test_rename_and_require(spark):
    df = spark.createDataFrame([(7, "x", 9)], "wt int, note string, ht int")
    out = crf.rename_and_select(df, {"wt": "weight", "never": "seen"}, ["note", "nowhere"], ["weight", "ht"])
    assert out.columns == ["weight", "ht"]
    with pytest.raises(KeyError, match="bmi"):
        crf.rename_and_select(df, {}, [], ["bmi", "ht"])


def test_parse_dates_invalid_is_null(spark):
    df = spark.createDataFrame([("2019-11-30",), ("soon",), (None,)], "d string")
    out = [r.t for r in df.select(P.parse_timestamp("d").alias("t")).collect()]
    assert (out[0].year, out[0].month, out[0].day) == (2019, 11, 30) and out[1:] == [None, None]


HEADER = [["", "Visit", "", "Outcome"], ["Record", "Weight", "Ward", "Clearance"]]
NAMES = {"Unnamed: 0_level_0::Record": "record", "Visit::Weight": "weight", "Outcome::Clearance": "clearance"}


def _write(spark, rows, header, folder):
    df = spark.createDataFrame(rows, ",".join(f"c{i} string" for i in range(len(header[0]))))
    crf.write_crf(df.coalesce(1), folder, header)


def test_ingest_drops_missing_outcomes(spark, tmp_path):
    rows = [("r-17", "81.5", "north, upper", "2.2"), ("r-18", "66", 'the "new" one', None), ("r-19", None, "east", "1.1")]
    _write(spark, rows, HEADER, str(tmp_path / "a"))
    df = crf.ingest_crf(spark, str(tmp_path / "a"), renames=NAMES, drop=["Visit::Ward"], required=["record", "clearance"],
                        numeric_columns=["weight", "clearance"], rules={"clearance": (0.5, 4.0)}, key="record")
    assert sorted((r.record, r.weight, r.clearance) for r in df.collect()) == [("r-17", 81.5, 2.2), ("r-19", None, 1.1)]
    assert {r["Visit::Ward"] for r in crf.read_crf(spark, str(tmp_path / "a")).collect()} == {"north, upper", 'the "new" one', "east"}


def test_ingest_range_error_counts_every_violation(spark, tmp_path):
    _write(spark, [(f"r{k}", "1", "w", "9.75") for k in range(30)], HEADER, str(tmp_path / "a"))
    with pytest.raises(ValueError, match="clearance: 30 outside"):
        crf.ingest_crf(spark, str(tmp_path / "a"), renames=NAMES, required=["record", "clearance"], numeric_columns=["clearance"],
                       rules={"clearance": (0.5, 4.0)}, key="record")


def test_each_file_is_read_by_its_own_header(spark, tmp_path):
    _write(spark, [("r1", "70", "n", "1.5")], HEADER, str(tmp_path / "a"))
    # other column order, one column less, and a data row equal to a header line of the first file
    _write(spark, [("2.5", "r2", "71"), ("Clearance", "Record", "Weight")], [["Outcome", "", "Visit"], ["Clearance", "Record", "Weight"]], str(tmp_path / "b"))
    folder = tmp_path / "all"
    folder.mkdir()
    for sub in ("a", "b"):
        for f in (tmp_path / sub).glob("part-*"):
            (folder / f"{sub}-{f.stem}.csv").write_bytes(f.read_bytes())
    df = crf.read_crf(spark, str(folder))
    # a header cell without a group takes the label to its left; a leading one has none
    assert set(df.columns) == {"Unnamed: 0_level_0::Record", "Visit::Weight", "Visit::Ward", "Outcome::Clearance", "Outcome::Record"}
    rows = {tuple(r[c] for c in ("Unnamed: 0_level_0::Record", "Outcome::Record", "Visit::Weight", "Visit::Ward", "Outcome::Clearance")) for r in df.collect()}
    assert rows == {("r1", None, "70", "n", "1.5"), (None, "r2", "71", None, "2.5"), (None, "Record", "Weight", None, "Clearance")}


def test_date_formats_and_unread_dates(spark):
    df = spark.createDataFrame([("03-Nov-2020", "2020-11-03"), ("2020-11-03", ""), ("later", None)], "a string, b string")
    assert {r.column: r.n_unread for r in crf.unread_dates(df, ["a", "b"]).collect()} == {"a": 2, "b": 0}
    wider = [*P.DEFAULT_DATE_FORMATS, "dd-MMM-yyyy"]
    assert {r.column: r.n_unread for r in crf.unread_dates(df, ["a", "b"], wider).collect()} == {"a": 1, "b": 0}


def test_number_parsing(spark):
    df = spark.createDataFrame([("2.5L", "3.7"), ("", "x"), (" 4 ", "12 cycles")], "v string, n string")
    out = df.select(P.number_prefix("v").alias("a"), P.int_prefix("n").alias("b"), P.to_number("v").alias("c")).collect()
    assert [(r.a, r.b, r.c) for r in out] == [(2.5, 3, None), (None, None, None), (4.0, 12, 4.0)]


def test_dwell_minutes(spark):
    df = spark.createDataFrame([("20:00", "08:00"), ("10:00", "10:00"), ("24:00", "08:00"), ("", "08:00")],
                               "i string, o string")
    got = [r[0] for r in df.select(P.dwell_minutes(F.col("i"), F.col("o"))).collect()]
    assert got == [720, 1440, None, None]


def test_cells_with_line_breaks_stay_one_record(spark, tmp_path):
    rows = [("r1", "1", "two\nlines", "2.0"), ("r2", "2", 'a "quoted"\n\nword, and more', "2.5"), ("r3", "3", None, "3.0"), ("Record", "Weight", "Ward", "Clearance")]
    _write(spark, rows, HEADER, str(tmp_path / "a"))
    got = {tuple(r) for r in crf.read_crf(spark, str(tmp_path / "a")).collect()}
    assert got == set(rows)


def test_many_files_in_one_task_lose_only_their_headers(spark, tmp_path):
    folder = tmp_path / "all"
    folder.mkdir()
    for k in range(12):
        (folder / f"f{k}.csv").write_text(",Visit,,Outcome\nRecord,Weight,Ward,Clearance\n" + "".join(f"f{k}-{i},1,\"w\n{i}\",2\n" for i in range(5)) + "\n , ,,\n")
    (folder / "empty.csv").write_text(",Visit,,Outcome\nRecord,Weight,Ward,Clearance\n")
    got = crf.read_crf(spark, str(folder)).collect()
    assert sorted((r[0], r["Visit::Ward"]) for r in got) == sorted((f"f{k}-{i}", f"w\n{i}") for k in range(12) for i in range(5))

import datetime
import re

import pytest

from dwellframe.llm import pii
from dwellframe.llm.queries import op8_pii_pseudonyms

from .helpers import SF, empty_docs, odd_docs


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return (sum(d[0::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def run(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in sorted(pii.pseudonymise(docs, "k").collect(), key=lambda r: r.doc_id)]


def test_formats_validity_and_links(spark):
    out = run(spark, ["card 4111 1111 1111 1111.", "4111111111111111", "4111-1111-1111-1111", "bad 4111111111111112", "mail ann.lee+7@mail.example.com!", "tel +1 (017) 555-7713", "017-555-7713",
                      "2024-02-29", "29/02/2024", "2023-02-29", "1799-01-01", "123-45-6789", "666-45-6789", "000-45-6789", "ip 10.1.2.3.", "300.1.2.3", "1.2.3", "7536784127813050 4845168114407329"])
    card = re.sub(r"\D", "", out[0])
    assert re.fullmatch(r"card \d{4} \d{4} \d{4} \d{4}\.", out[0]) and luhn(card) and card != "4111111111111111"
    assert out[1] == card and out[2].replace("-", "") == card
    assert out[3] == "bad 4111111111111112"
    assert re.fullmatch(r"mail [a-z]{3}\.[a-z]{3}\+\d@mail\.example\.com!", out[4]) and "ann.lee+7" not in out[4]
    assert re.fullmatch(r"tel \+1 \(\d{3}\) \d{3}-\d{4}", out[5]) and re.sub(r"\D", "", out[5])[1:] == out[6].replace("-", "") != "0175557713"
    day = datetime.date.fromisoformat(out[7])
    assert day.strftime("%d/%m/%Y") == out[8] and day != datetime.date(2024, 2, 29) and 1800 <= day.year <= 2199
    assert out[9:11] == ["2023-02-29", "1799-01-01"]
    assert re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}", out[11]) and out[11] != "123-45-6789"
    assert out[12:14] == ["666-45-6789", "000-45-6789"]
    assert all(int(x) < 256 for x in out[14][3:-1].split(".")) and out[14] != "ip 10.1.2.3."
    assert out[15:17] == ["300.1.2.3", "1.2.3"]
    assert all(luhn(x) for x in out[17].split()) and "7536784127813050" not in out[17] and "4845168114407329" not in out[17]


@pytest.mark.parametrize("texts", [[f"{a:03}-45-0007" for a in range(1, 900)], [(datetime.date(1800, 1, 1) + datetime.timedelta(97 * k)).isoformat() for k in range(1500)],
                                   [f"10.0.{k // 256}.{k % 256}" for k in range(1000)], [f"{k:02}@a.example.com" for k in range(100)], ["%040x" % (k + (10 << 156)) for k in range(300)]])
def test_permutations_are_one_to_one(spark, texts):
    out = run(spark, texts)
    assert len(set(out)) == len(texts) and sum(a == b for a, b in zip(texts, out, strict=True)) <= 6
    if len(texts) == 100:  # all two-digit local parts: a permutation of the whole domain
        assert sorted(out) == texts


def test_query_replaces_valid_values_and_nothing_else(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = 0
    for r in op8_pii_pseudonyms(spark, SF).collect():
        parts = re.split(pii.PATTERN, docs[r.doc_id])
        values = re.findall(f"(?:{pii.PATTERN})", docs[r.doc_id])
        left = r.text
        for p in parts:
            assert p in left
            left = left[left.index(p) + len(p):]
        for v in values:
            valid = not re.fullmatch(pii.CARD, v) or luhn(v)
            found += valid
            assert (v in r.text) != valid
        if not values:
            assert r.text == docs[r.doc_id] and r.n_values == 0
    assert found > 3


def test_odd_and_empty_tables(spark):
    docs = odd_docs(spark)
    out = pii.pseudonymise(docs, "k")
    assert out.columns == [*docs.columns, "pseudonyms", "n_values"]
    assert sorted(((r.doc_id, r.text, r.score) for r in out.collect()), key=repr) == sorted(((r.doc_id, r.text, r.score) for r in docs.collect()), key=repr)
    again = pii.pseudonymise(docs.withColumnRenamed("score", "n_values"), "k")
    assert again.columns.count("n_values") == 1 and again.count() == docs.count()
    assert pii.pseudonymise(empty_docs(spark), "k").count() == 0


def test_planted_values_of_other_forms(spark):
    """Values written out here, not built from the module's patterns: none may stay, equal ones stay linked."""
    planted = ["31.12.2020", "7/4/1985", "07/31/1985", "1.2.1999", "555 123 4567", "+1 555 123 4567", "+33 1 42 68 53 00", "+49 30 1234567", "+44-20-7946-0958", "3782 822463 10005", "3782-822463-10005",
               "DEADBEEF0123456789ABCDEF01234567", "deadbeef0123456789abcdef01234567"]
    out = run(spark, [f"see {v}, thanks" for v in planted])
    for v, t in zip(planted, out, strict=True):
        assert v not in t and t.startswith("see ") and t.endswith(", thanks"), (v, t)
        new = t[4:-8]
        assert re.sub(r"[0-9A-Fa-f]", "x", new) == re.sub(r"[0-9A-Fa-f]", "x", v) or "/" in v or "." in v
    got = dict(zip(planted, (t[4:-8] for t in out), strict=True))
    assert datetime.datetime.strptime(got["31.12.2020"], "%d.%m.%Y") and datetime.datetime.strptime(got["07/31/1985"], "%m/%d/%Y") and re.fullmatch(r"\d{1,2}/\d{1,2}/\d{4}", got["7/4/1985"])
    assert got["+1 555 123 4567"] == "+1 " + got["555 123 4567"]
    assert got["+33 1 42 68 53 00"][:4] == "+33 " and got["+49 30 1234567"][:4] == "+49 "
    assert luhn(got["3782 822463 10005"]) and got["3782 822463 10005"].replace(" ", "") == got["3782-822463-10005"].replace("-", "")
    assert got["DEADBEEF0123456789ABCDEF01234567"] == got["deadbeef0123456789abcdef01234567"].upper()
    same = run(spark, ["2020-12-31", "31/12/2020"])
    assert datetime.date.fromisoformat(same[0]).strftime("%d.%m.%Y") == got["31.12.2020"] and datetime.date.fromisoformat(same[0]).strftime("%d/%m/%Y") == same[1]
    stay = ["version 1.2.3", "32.13.2020", "13/13/1985", "+12 34", "3782 822463 10006", "chapter 3.4.20211", "a+33 x"]
    assert run(spark, stay) == stay


def test_columns_of_any_name_stay(spark):
    docs = spark.createDataFrame([(1, "on 2020-12-31", "p", "m")], "doc_id long, text string, __parts string, __made string")
    row = pii.pseudonymise(docs, "k").first()
    assert (row["__parts"], row["__made"], row.n_values) == ("p", "m", 1)

import hashlib
import re
from collections import Counter

from pyspark.sql import functions as F

from dwellframe.llm import cws
from dwellframe.llm.queries import op2_document_fingerprints

from .helpers import SF, empty_docs, odd_docs


def edited_texts(rows):
    """(id, n_chars, edited, next text) of (id, text) rows in descending order of id."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for k, (i, t) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        cut = len(t) // 3
        out.append((i, len(t), t[:len(t) - cut] + following[:cut], following))
    return out


def jaccard(a, b):
    a, b = (Counter(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in (a, b))
    either = sum((a | b).values())
    return sum((a & b).values()) / either if either else 1.0


def test_query_against_plain_edits_and_exact_similarity(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: r for r in op2_document_fingerprints(spark, SF).collect()}
    assert len(got) == len(docs)
    text, off_edited, off_next = dict(docs), [], []
    for i, n, edited, following in edited_texts(docs):
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        off_edited.append(r.near_edited - jaccard(text[i], edited))
        off_next.append(r.near_next - jaccard(text[i], following))
    for off in (off_edited, off_next):
        # the share of equal samples is an unbiased estimate
        assert abs(sum(off) / len(off)) < 0.02 and max(map(abs, off)) < 0.45
    prints = {}
    for i, t in docs:
        assert prints.setdefault(t, got[i].fingerprint) == got[i].fingerprint


def test_collision_rate_is_the_generalised_jaccard_similarity(spark):
    a, b = "x " * 6 + "y y z p q", "x " * 3 + "y y y z z r"
    rows = spark.createDataFrame([(0, a), (1, b)], "i long, text string")
    prints = {r.i: r.fingerprint for r in cws.fingerprint(rows, ["i"], samples=96).collect()}
    same = sum(prints[0][8 * k:8 * k + 8] == prints[1][8 * k:8 * k + 8] for k in range(96)) / 96
    assert abs(same - jaccard(a, b)) < 0.16


def test_weighted_terms(spark):
    text = "b a b\tc b\n a"
    row = spark.createDataFrame([(text,), ("",), (None,), (" ",)], "text string").select(
        cws.weighted_terms(F.coalesce(F.col("text"), F.lit(""))).alias("t"), F.xxhash64(F.lit("a")).alias("a"), F.xxhash64(F.lit("b")).alias("b"), F.xxhash64(F.lit("c")).alias("c")).collect()
    keep = lambda h: (h >> 24) << 24
    assert set(row[0].t) == {keep(row[0].a) | 2, keep(row[0].b) | 3, keep(row[0].c) | 1}
    assert [r.t for r in row[1:]] == [[], [], []]


def test_odd_and_empty_tables(spark):
    docs = odd_docs(spark)
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    got = cws.compare_edited(docs).collect()
    assert len(got) == len(rows)
    # rows of one id may stand in any order: ids with one row have one possible successor id
    want = {(i, n) for i, n, _, _ in edited_texts(rows)}
    assert {(r.doc_id, r.n_chars) for r in got} == want
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, r)
    assert by_id[3].fingerprint == by_id[4].fingerprint == by_id[5].fingerprint == "f" * 8 * cws.K
    assert by_id[1].fingerprint == by_id[2].fingerprint and by_id[4].near_next == 1.0 and by_id[6].near_next == 0.0
    assert cws.compare_edited(empty_docs(spark)).count() == 0
    one = docs.where("doc_id = 7")
    assert [(r.near_edited, r.near_next) for r in cws.compare_edited(one).collect()][0][1] == 1.0

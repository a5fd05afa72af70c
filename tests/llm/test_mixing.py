import re
from collections import defaultdict

from dwellframe.llm import mixing
from dwellframe.llm.queries import op1_source_mixing

from .helpers import empty_docs, odd_docs


def plain_targets(sizes):
    """Share, cut, share again, as the contract says it."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(sizes.values())
    while free:
        level = left / sum(weight[s] for s in free)
        above = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not above:
            return target | {s: level * weight[s] for s in free}
        target |= {s: 2.0 * sizes[s] for s in above}
        left -= sum(2.0 * sizes[s] for s in above)
        free -= above
    return target


def check(got, docs):
    words = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in docs}
    sizes = defaultdict(int)
    for i, t, s in docs:
        sizes[s] += words[i]
    target = plain_targets(sizes)
    for r in got:
        s = next(s for i, _, s in docs if i == r.doc_id)
        assert (r.size, r.source_size) == (words[r.doc_id], sizes[s]) and abs(r.target - target[s]) < 1e-6 * (1 + target[s])
        rate = target[s] / sizes[s] if sizes[s] else 0
        assert r.taken in (r.size * int(rate), r.size * (int(rate) + (rate % 1 > 0)))


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()]
    got = op1_source_mixing(spark, sf).collect()
    assert len(got) == len(docs)
    check(got, docs)
    assert sorted(map(tuple, got)) == sorted(map(tuple, op1_source_mixing(spark, sf).collect()))
    assert abs(sum(r.taken for r in got) / (1.5 * sum(r.size for r in got)) - 1) < 0.1


def test_targets_of_many_sources(spark):
    sizes = {f"s{k:03}": (k * 7919) % 1000 for k in range(300)} | {None: 50}
    got = {r.source: r for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()}
    want = plain_targets(sizes)
    assert all(abs(got[s].target - want[s]) < 1e-6 * (1 + want[s]) for s in sizes)


def test_mix_emits_whole_rows(spark):
    docs = odd_docs(spark)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    planned = mixing.plan(docs.drop("size")).selectExpr("sum(copies)").first()[0]
    assert mixed.count() == planned


def test_odd_and_empty_tables(spark):
    docs = odd_docs(spark)
    got = mixing.plan(docs).collect()
    assert len(got) == docs.count()
    assert all(r.size == 0 and r.copies >= 0 for r in got if r.text is None)
    assert mixing.plan(empty_docs(spark)).count() == 0 and mixing.mix(empty_docs(spark)).count() == 0
    zero = docs.where("text is null")
    assert {r.target for r in mixing.plan(zero).collect()} == {0.0}

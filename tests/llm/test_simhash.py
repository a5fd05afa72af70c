import random

import numpy as np
import xxhash

from dwellframe.llm import simhash
from dwellframe.llm.components import components
from dwellframe.llm.queries import op7_simhash_near_dedup
from .helpers import SF, empty_docs, odd_docs


def plain_fingerprint(text, n=3):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[k:k + n]) for k in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, fps):
    """Smallest id reachable, by a search over all pairs."""
    f = np.array(fps, np.uint64)
    label = np.arange(len(f))
    near = np.bitwise_count(f[:, None] ^ f[None, :]) <= 3
    while True:
        new = np.where(near, label[None, :], len(f)).min(axis=1)
        if (new == label).all():
            break
        label = new
    best = {}
    for i, k in zip(ids, label.tolist(), strict=True):
        if i is not None:
            best[k] = min(i, best.get(k, i))
    return [best.get(k) for k in label.tolist()]


def expect(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    fps = [plain_fingerprint(t) for _, t in rows]
    return sorted(zip([i for i, _ in rows], [f"{f:016x}" for f in fps], plain_components([i for i, _ in rows], fps), strict=True), key=repr)


def test_query_against_all_pairs(spark):
    got = sorted(map(tuple, op7_simhash_near_dedup(spark, SF).collect()), key=repr)
    assert got == expect(spark.read.parquet(f"{SF}/documents.parquet"))


def test_odd_and_empty_tables(spark):
    assert sorted(map(tuple, simhash.fingerprint_table(odd_docs(spark)).collect()), key=repr) == expect(odd_docs(spark))
    assert simhash.fingerprint_table(empty_docs(spark)).count() == 0
    assert simhash.keep_one(empty_docs(spark)).count() == 0


def test_keep_one_keeps_one_row_of_each_component(spark):
    docs = odd_docs(spark)
    left = simhash.keep_one(docs)
    assert left.columns == docs.columns
    # 1 = 2 = 2; null and 7 are one text, 7 has the id; null, empty and blank texts share fingerprint zero
    assert sorted((r.doc_id for r in left.collect()), key=repr) == [1, 3, 6, 7, 8, 9]


def test_hot_roots_are_split_without_losing_links(spark):
    rng = random.Random(1)
    centre = rng.getrandbits(64)
    fps = {centre ^ (1 << i) ^ (1 << j) for i in range(64) for j in range(64)} | {rng.getrandbits(64) for _ in range(300)}
    signed = [f - (1 << 64) if f >> 63 else f for f in sorted(fps)]
    table = spark.createDataFrame([(f,) for f in signed], "fp long")
    found = {r.u: r.root for r in components(simhash.links(table, max_group=100)).collect()}
    f = np.array(signed, np.int64).view(np.uint64)
    want = plain_components(signed, f)
    groups = {}
    for s, w in zip(signed, want, strict=True):
        groups.setdefault(found.get(s, s), set()).add(w)
    assert all(len(v) == 1 for v in groups.values()) and len(groups) == len(set(want))


def test_components_of_a_long_path_and_a_star(spark):
    links = [(k, k + 1) for k in range(200)] + [(1000, 1000 + k) for k in range(1, 300)] + [(5000, 5000)]
    got = {r.u: r.root for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(1, 201)} | {1000 + k: 1000 for k in range(1, 300)}

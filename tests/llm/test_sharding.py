import zlib
from collections import Counter, defaultdict

from dwellframe.llm import sharding
from dwellframe.llm.queries import op13_balanced_shards

from .helpers import SF, empty_docs, odd_docs


def check(rows, shards):
    """Counts at most one apart, slots gapless; returns the shards of every text."""
    slots, groups = defaultdict(list), defaultdict(set)
    for shard, slot, text in rows:
        slots[shard].append(slot)
        groups[text].add(shard)
    counts = [len(slots[s]) for s in range(shards)]
    assert set(slots) <= set(range(shards)) and max(counts) - min(counts) <= 1
    assert all(sorted(own) == list(range(len(own))) for own in slots.values())
    return groups


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = op13_balanced_shards(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        raw = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "rows", None)
    groups = check([(r.shard, r.slot, docs[r.doc_id]) for r in got], 24)
    copies = Counter(docs.values())
    split = [t for t, s in groups.items() if copies[t] > 1 and len(s) > 1]
    assert len(split) <= 1 + sum(copies[t] > len(docs) // 24 for t in copies)


def test_odd_and_empty_tables(spark):
    docs = odd_docs(spark)
    got = sharding.assign(docs, shards=3).collect()
    assert len(got) == docs.count()
    check([(r.shard, r.slot, r.text_hash) for r in got], 3)
    assert sorted(r.size for r in got if r.doc_id is None) == [8, 47] and {r.text_crc32 for r in got if r.size == 8} == {0}
    assert sharding.assign(empty_docs(spark)).count() == 0


def test_a_text_with_a_third_of_all_rows(spark):
    rows = [(i, "common") for i in range(2000)] + [(i, f"pair {i // 2}") for i in range(2000, 4000)] + [(i, f"own {i}") for i in range(4000, 6000)]
    got = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    text = dict(rows)
    groups = check([(r.shard, r.slot, text[r.doc_id]) for r in got], 24)
    before = defaultdict(set)
    for r in got:
        before[text[r.doc_id]].add(r.first_shard)
    # 250 rows a shard: the common text gathers in full shards, and hardly a pair is parted.
    near = {name: sum(n * n for n in Counter(getattr(r, name) for r in got if text[r.doc_id] == "common").values()) for name in ("first_shard", "shard")}
    assert len(before["common"]) == 24 and len(groups["common"]) <= 16 and near["shard"] > 1.7 * near["first_shard"]
    parted = sum(len(s) > 1 for t, s in groups.items() if t.startswith("pair"))
    assert parted <= 50 and sum(len(s) > 1 for t, s in before.items() if t.startswith("pair")) > 900


def test_all_rows_linked(spark):
    rows = [(i, f"group {i % 50}") for i in range(1000)]
    got = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string"), shards=10).collect()
    text = dict(rows)
    groups = check([(r.shard, r.slot, text[r.doc_id]) for r in got], 10)
    kept = sum(max(Counter(r.shard for r in got if text[r.doc_id] == t).values()) for t in groups)
    first = sum(max(Counter(r.first_shard for r in got if text[r.doc_id] == t).values()) for t in groups)
    assert kept > 1.5 * first


def test_quotas_never_overfill():
    demand = {(0, 1): 30, (1, 0): 10, (2, 1): 30, (2, 0): 5, (0, 2): 1}
    room = [0, 20, 3]
    quota = sharding._quotas(demand, room)
    for t in range(3):
        inflow = sum(n for (f, to), n in quota.items() if to == t)
        swapped = sum(min(demand[f, to], demand.get((to, f), 0)) for (f, to) in demand if to == t)
        assert inflow <= room[t] + swapped and all(n <= demand[p] for p, n in quota.items())


def test_written_shards_hold_every_document(spark, tmp_path):
    docs = odd_docs(spark)
    path = f"{tmp_path}/shards"
    sharding.write(docs, path, shards=4)
    back = spark.read.parquet(path)
    assert set(back.columns) == set(docs.columns) | {"shard", "slot"}
    key = ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(map(repr, back.select(key).collect())) == sorted(map(repr, docs.select(key).collect()))
    check([(r.shard, r.slot, None) for r in back.select("shard", "slot").collect()], 4)

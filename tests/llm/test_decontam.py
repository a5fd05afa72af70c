import random
from collections import Counter

from dwellframe.llm import decontam
from dwellframe.llm.queries import op10_benchmark_decontamination

from .helpers import empty_docs, odd_docs


def plain_matches(text, items, least=0.8):
    """Every window of the item's length, by exact similarity."""
    words, out = decontam.words_of(text), {}
    for i, t in items:
        own = decontam.words_of(t)
        if not own or not words:
            continue
        s, n = min(5, len(own)), min(len(own), len(words))
        a = Counter(tuple(own[k:k + s]) for k in range(len(own) - s + 1))
        if not a.keys() & {tuple(words[k:k + s]) for k in range(len(words) - s + 1)}:
            continue  # every window has similarity 0
        for p in range(len(words) - n + 1):
            w = words[p:p + n]
            b = Counter(tuple(w[k:k + s]) for k in range(n - s + 1))
            both = sum((a & b).values())
            sim = both / (sum(a.values()) + sum(b.values()) - both)
            if sim >= least:
                out[i] = max(sim, out.get(i, 0))
    return out


def test_query_against_every_window(spark):
    sf = "/root/testdata/sf0.001"
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = {(d.doc_id, i): s for d in spark.read.parquet(f"{sf}/documents.parquet").collect() for i, s in plain_matches(d.text, items).items()}
    got = {(r.doc_id, r.item_id): r.similarity for r in op10_benchmark_decontamination(spark, sf).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_edited_passages_are_found_and_others_left():
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(5000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(12, 60)))) for i in range(60)]
    index = decontam.Index(items)
    missed = wanted = 0
    for i, t in items:
        words = t.split()
        for _ in range(8):
            edited = list(words)
            edited[rng.randrange(len(edited))] = "changed"
            text = " ".join(rng.choices(vocabulary, k=80) + edited + rng.choices(vocabulary, k=40))
            want = plain_matches(text, items)
            got = {m[0]: m[1] for m in index.matches(text, 0.8)}
            wanted += len(want)
            missed += len(want.keys() - got.keys())
            assert got.keys() <= want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    assert wanted > 100 and missed <= 0.01 * wanted
    assert index.matches(" ".join(rng.choices(vocabulary, k=500)), 0.8) == []


def test_fingerprints_within_the_radius_are_always_candidates():
    rng = random.Random(2)
    for _ in range(200):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), decontam.RADIUS):
            y ^= 1 << b
        rows = [v.to_bytes(8, "big") for v in (x, y)]
        assert any(b in decontam._NEAR[a] for a, b in zip(*rows, strict=True))


def test_blocks_short_items_and_odd_tables(spark):
    items = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog"), (2, None), (3, ""), (4, "chat dort"), (None, "dort sur"), (5, "QUICK brown fox, jumps over the lazy dog")], "item_id long, text string")
    docs = odd_docs(spark)
    for chars in (16_000_000, 40):
        got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, items, block_chars=chars).collect()}
        assert got == {(d, i) for d in (1, 2) for i in (1, 5)} | {(d, i) for d in (None, 7) for i in (4, None)}
    left = decontam.clean(docs, items)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {3, 4, 5, None, 6, 8, 9}
    assert decontam.contaminated(empty_docs(spark), items).count() == 0
    assert decontam.clean(docs, items.limit(0)).count() == docs.count()


def test_runs_of_a_repeated_word_do_not_hide_an_item():
    rng = random.Random(8)
    missed = wanted = 0
    for k in range(12):
        length, run = ((116, 14), (280, 34), (60, 7))[k % 3]
        body = [f"w{k}x{i}" for i in range(length)]
        item = [*body, *["aaa"] * run]
        items = [(1, " ".join(item)), (2, " ".join(body))]
        for edited in ([*body, *["bbb"] * run], [*body[:-run], *["ccc"] * run], item):
            text = " ".join([*(f"p{rng.random()}" for _ in range(20)), *edited, *["bbb"] * rng.choice([0, 40]), "end"])
            want = plain_matches(text, items, 0.75)
            got = {m[0]: m[1] for m in decontam.Index(items).matches(text, 0.75)}
            wanted += len(want)
            missed += len(want.keys() - got.keys())
            assert got.keys() <= want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in got)
    assert wanted > 30 and not missed


def test_places_of_repeats():
    rng = random.Random(9)
    for n in (1, 2, 5, 30):
        h = decontam.np.array([rng.randrange(25) for _ in range(30)], decontam.np.uint64)
        assert decontam._repeats(h, n).tolist()[:30 - n + 1] == [len(set(h[k:k + n].tolist())) < n for k in range(30 - n + 1)]

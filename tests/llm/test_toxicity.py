import random
import zlib

import pyarrow.parquet as pq

from dwellframe.llm import toxicity
from dwellframe.llm.queries import op4_toxicity

from .helpers import empty_docs, odd_docs


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in op4_toxicity(spark, sf).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in got.items())
    held = [(got[i].predicted, y) for i, y in labels.items() if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(p == y for p, y in held) >= 0.93 * len(held)
    assert sum(p for p, y in held if y) >= 0.5 * sum(y for _, y in held)
    assert sum(p for p, y in held if not y) <= 0.02 * sum(not y for _, y in held)


def test_odd_and_empty_tables(spark):
    docs = odd_docs(spark)
    labels = spark.createDataFrame([(1, 0), (2, 0), (2, 1), (7, 0), (3, 1), (None, 1), (8, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    rows = toxicity.predict(docs, model)
    assert rows.columns == [c for c in docs.columns if c != "score"] + ["score", "predicted"]
    found = rows.collect()
    assert len(found) == docs.count() and all(0 <= r.score <= 1 for r in found)
    assert len({r.score for r in found if not (r.text or "").strip()}) == 1
    assert {r.score for r in toxicity.predict(docs, toxicity.train(docs, labels.limit(0))).collect()} == {0.0}
    assert {r.score for r in toxicity.predict(docs, toxicity.train(docs, labels.where("toxic = 1"))).collect()} == {1.0}
    assert toxicity.predict(empty_docs(spark), model).count() == 0


def test_words_of_one_class_are_learned():
    ordinary = [f"alpha beta gamma delta number{k} epsilon zeta" for k in range(200)]
    toxic = [f"alpha beta horrible delta number{k} epsilon zeta" for k in range(200)]
    model = toxicity.fit(ordinary + toxic, [0] * 200 + [1] * 200)
    score = model.open().score
    assert score("number7 horrible epsilon gamma") > 0.5 > score("beta gamma delta number900")


def test_short_and_rare_words_and_long_runs_are_learned():
    rng = random.Random(3)
    syllables = ["ba", "co", "di", "fu", "ge", "hi", "lo", "mu", "ne", "po", "ra", "si", "ta", "vu"]
    prose = lambda n: ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(n)]

    def mixed(*words):
        out = prose(40)
        for w in words:
            out.insert(rng.randrange(len(out)), w)
        return " ".join(out)

    def unspaced(*words):
        return "".join(chr(0x4E00 + rng.randrange(300)) for _ in range(60)) + "".join(words) + "".join(chr(0x4E00 + rng.randrange(300)) for _ in range(60))

    bad, rare, joined = ["trash", "scum", "moron", "idiot"], "schmutzkerl", "贱人垃圾"
    ordinary = [mixed() for _ in range(1500)] + [unspaced() for _ in range(300)]
    toxic = [mixed(*rng.sample(bad, 2)) for _ in range(500)] + [mixed(rare, rare) for _ in range(8)] + [unspaced(joined) for _ in range(60)]
    score = toxicity.fit(ordinary + toxic, [0] * len(ordinary) + [1] * len(toxic)).open().score
    assert sum(score(mixed(*rng.sample(bad, 2))) >= 0.5 for _ in range(100)) >= 95
    assert sum(score(mixed(rare, rare)) >= 0.5 for _ in range(50)) >= 45
    assert sum(score(unspaced(joined)) >= 0.5 for _ in range(50)) >= 40
    assert sum(score(t) >= 0.5 for t in [mixed() for _ in range(100)] + [unspaced() for _ in range(50)]) <= 5


def test_held_out_recall_by_language():
    sf = "/root/testdata/sf0.1"
    docs = {r["doc_id"]: r for r in pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text", "lang"]).to_pylist()}
    rows = [(docs[r["doc_id"]], r["toxic"], zlib.crc32(str(r["doc_id"]).encode()) % 5) for r in pq.read_table(f"{sf}/labels.parquet").to_pylist() if r["doc_id"] in docs]
    learned = [(d["text"], y) for d, y, k in rows if k and y is not None and d["text"] is not None]
    score = toxicity.fit([t for t, _ in learned], [y for _, y in learned]).open().score
    held = [(d["lang"], y, score(d["text"]) >= 0.5) for d, y, k in rows if not k]
    for lang in ("en", "de", "es", "fr"):
        toxic = [p for g, y, p in held if g == lang and y]
        assert sum(toxic) >= 0.8 * len(toxic), lang
    assert sum(p for _, y, p in held if not y) <= 0.01 * sum(not y for _, y, _ in held)

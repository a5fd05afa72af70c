import math
from collections import Counter, defaultdict

from dwellframe.llm import quality
from dwellframe.llm.queries import op3_quality_perplexity

from .helpers import SF, empty_docs, odd_docs

TEXTS = ["abracadabra abra", "a cab, a cad", "bad dad had a 1 2", "abba abba cab", "dab a cab"]


def plain_model(texts):
    """Interpolated modified Kneser-Ney, from its definition."""
    top = Counter()
    for t in texts:
        body = quality.prepared(t)
        for i in range(quality.ORDER - 1, len(body)):
            top[body[i - quality.ORDER + 1:i + 1]] += 1
    counts = {quality.ORDER: top}
    for n in range(quality.ORDER - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    discount = {}
    for n, c in counts.items():
        of = Counter(c.values())
        y = of[1] / (of[1] + 2 * of[2]) if of[1] else 0
        discount[n] = [min(k, max(0.0, k - (k + 1) * y * of[k + 1] / of[k])) if of[k] and of[k + 1] else 0.5 for k in (1, 2, 3)]
    def p(h, w, n):
        if n == 0:
            return 1 / (len(counts[1]) + 1)
        h = h[len(h) - n + 1:] if n > 1 else ""
        after = {g: c for g, c in counts[n].items() if g[:-1] == h}
        if not after:
            return p(h, w, n - 1)
        total = sum(after.values())
        cut = sum(discount[n][min(c, 3) - 1] for c in after.values())
        c = after.get(h + w, 0)
        return max(c - (discount[n][min(c, 3) - 1] if c else 0), 0) / total + cut / total * p(h, w, n - 1)
    return p


def plain_perplexity(p, text):
    body = quality.prepared(text)
    logs = [math.log(p(body[i - quality.ORDER + 1:i], body[i], quality.ORDER)) for i in range(quality.ORDER - 1, len(body))]
    return math.exp(-sum(logs) / len(logs))


def test_perplexity_against_the_definition(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string")
    model = quality.train(docs.select("lang", "text"))
    p = plain_model(TEXTS)
    probes = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*TEXTS, "cadabra", "zebra zz", "a"])], docs.schema)
    want = {r.doc_id: plain_perplexity(p, r.text) for r in probes.collect()}
    for bound in (10**6, 40):  # one shard, and several
        got = {r.doc_id: r.perplexity for r in quality.score(probes, model, max_entries=bound).collect()}
        assert all(abs(got[i] / want[i] - 1) < 1e-4 for i in want), bound


def test_probabilities_sum_to_one(spark):
    p = plain_model(TEXTS)
    letters = sorted({c for t in TEXTS for c in quality.prepared(t)[quality.ORDER - 1:]})
    assert abs(sum(p("abra", w, quality.ORDER) for w in [*letters, "?"]) - 1) < 1e-9


def test_query(spark):
    rows = op3_quality_perplexity(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    good = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = defaultdict(list)
    for r in rows:
        kept[good.get(r.doc_id)].append(r.keep)
    assert sum(kept[1]) >= 0.9 * len(kept[1]) and sum(kept[0]) <= 0.6 * len(kept[0])


def test_odd_and_empty_tables(spark):
    docs = odd_docs(spark)
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (None, 1), (6, 0), (6, 1), (9, None)], "doc_id long, quality int")
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == docs.count() and all(r.keep is not None for r in rows)
    assert all(r.perplexity is None and r.keep for r in rows if r.doc_id in (3, 4, 5))
    assert quality.classify(empty_docs(spark), labels).count() == 0
    assert all(r.keep for r in quality.classify(docs, labels.limit(0)).collect())
    model = quality.train(docs.where("lang = 'en'").select("lang", "text"))
    several = quality.score(docs, model, max_entries=20)
    assert sorted(map(str, several.select("doc_id", "n_symbols").collect())) == sorted(map(str, quality.score(docs, model).select("doc_id", "n_symbols").collect()))

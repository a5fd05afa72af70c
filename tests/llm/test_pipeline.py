import hashlib
import math
import re
import zlib
from collections import defaultdict

import numpy as np

import corpus_pipeline
from dwellframe.llm import langid
from dwellframe.llm.queries import QUERIES, SQL, tokenizer_path

from .helpers import SF, empty_docs, odd_docs
from .test_decontam import plain_matches
from .test_mixing import plain_targets
from .test_simhash import plain_components, plain_fingerprint


def replay(spark, docs, items):
    """The five stages in plain Python over (id, text, source) rows; only the language model is the library's."""
    frame = spark.createDataFrame([(d.doc_id, d.text, d.lang) for d in docs], "doc_id long, text string, lang string")
    model = langid.train(frame).block(0)
    rows = [(d.doc_id, d.text, d.source) for d in docs if (best := langid.best_of(model, d.text))[0] and best[3] >= 0 and math.exp(best[1] - best[2]) >= 0.5]
    component = plain_components([i for i, _, _ in rows], [plain_fingerprint(t) for _, t, _ in rows])
    rows = [r for r, c in zip(rows, component, strict=True) if r[0] == c]
    rows = [r for r in rows if not plain_matches(r[1], items)]
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t, _ in rows}
    sizes = defaultdict(int)
    for i, _, s in rows:
        sizes[s] += size[i]
    target, out = plain_targets(sizes), []
    for i, t, s in rows:
        rate = target[s] / sizes[s] if sizes[s] else 0.0
        drawn = int(hashlib.md5(f"17:{i}".encode()).hexdigest()[:8], 16) / 2**32
        out += [(i, t)] * (int(rate) + (drawn < rate - int(rate)))
    from tokenizers import Tokenizer
    tokenizer, start, found = Tokenizer.from_file(tokenizer_path()), 0, []
    for i, t in sorted(out):
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 0]
        found.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return found


def test_run_against_a_replay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()), key=lambda r: r[1])
    assert got == replay(spark, docs, items)


def test_every_stage_bears_odd_and_empty_tables(spark):
    for docs in (odd_docs(spark), empty_docs(spark)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns, name
            assert out.count() <= 2 * docs.count(), name
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()
    assert {r.doc_id for r in corpus_pipeline.language_id(spark, odd_docs(spark), SF).collect()} == {None, 1, 2, 6, 7, 9}


def test_queries_are_registered():
    import __spark_entry__ as entry
    found = entry.queries()
    assert {*QUERIES, "pipeline"} <= set(found) and {re.match(r"op(\d+)_", n)[1] for n in QUERIES} == {str(k) for k in range(1, 14)}
    assert SQL.keys() <= entry.oracle_sql().keys()

import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from dwellframe.llm import tokens
from dwellframe.llm.queries import op9_token_blocks, tokenizer_path

from .helpers import SF, empty_docs, odd_docs

PATH = tokenizer_path()


def expect(rows):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(PATH)
    out, start = [], 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query_against_plain_encoding(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, op9_token_blocks(spark, SF).collect())) == expect([tuple(r) for r in docs])


def test_odd_and_empty_tables(spark):
    docs = odd_docs(spark)
    got = sorted(map(tuple, tokens.write_and_read(docs, PATH).collect()), key=lambda r: r[1])
    want = expect([(r.doc_id, r.text) for r in docs.collect()])
    assert [r[0] for r in got] == [r[0] for r in want]
    assert sorted((r[0], r[2], r[3]) for r in got if r[0]) == sorted((r[0], r[2], r[3]) for r in want if r[0])
    assert [b[1] for b in got] == np.cumsum([0, *[r[2] for r in got[:-1]]]).tolist()
    assert tokens.write_and_read(empty_docs(spark), PATH).count() == 0


def test_random_access(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    path = str(tmp_path / "blocks")
    tokens.write(docs, path, PATH, block_ids=500)
    blocks = spark.read.parquet(path)
    text = docs.where("doc_id = 17").first().text
    from tokenizers import Tokenizer
    want = [*Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids, 0]
    assert [x.tolist() for x in tokens.document(blocks, 17)] == [want]
    assert blocks.selectExpr("max(bits)").first()[0] == 16


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 32).flatmap(lambda b: st.tuples(st.just(b), st.lists(st.integers(0, (1 << b) - 1), max_size=70))), st.data())
def test_pack_round_trip(case, data):
    bits, ids = case
    packed = tokens.pack(np.array(ids, np.uint64), bits)
    assert len(packed) == -(-len(ids) * bits // 8)
    a = data.draw(st.integers(0, len(ids)))
    b = data.draw(st.integers(a, len(ids)))
    assert tokens.unpack(packed, bits, a, b).tolist() == ids[a:b]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab' \n\t \x1cé日1!Ġ\0")), max_size=40))
def test_pieces_give_the_ids_of_the_whole_text(text):
    encoder = tokens.encoder_of(PATH)
    ids, sizes = encoder.encode(pa.array([text, None, text + " " + text]))
    want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in (text, text + " " + text)]
    assert ids.tolist() == [*want[0], *want[1]] and sizes.tolist() == [len(want[0]), 0, len(want[1])]


@pytest.mark.parametrize("text", ["a <|endoftext|> b", "<|endoftext|>x y", "it's 12 345's  end "])
def test_special_strings(text):
    encoder = tokens.encoder_of(PATH)
    ids, sizes = encoder.encode(pa.array([text, None, text + " " + text]))
    want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in (text, text + " " + text)]
    assert ids.tolist() == [*want[0], *want[1]] and sizes.tolist() == [len(want[0]), 0, len(want[1])]


def test_generations_of_pieces_give_the_same_ids(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 40)
    encoder = tokens.Encoder(tokenizer_path())
    texts = [" ".join(f"{a}ung{b}.\n{b.title()}" for b in ("ab", "cd", "Zs", f"x{k}")) + f" ende{k}," for k, a in enumerate(["Ver", "be", "ent", "zer", "Ver", "be"] * 3)]
    for k in range(0, len(texts), 2):
        ids, sizes = encoder.encode(pa.array(texts[k:k + 2]))
        want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts[k:k + 2]]
        assert ids.tolist() == [i for w in want for i in w] and sizes.tolist() == list(map(len, want))
    assert encoder.before.numbers


def test_another_kind_of_vocabulary_encodes_whole_texts():
    import public_tokenizers

    encoder = tokens.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["The Cat  sat.", "on\nthe mat", ""]
    ids, sizes = encoder.encode(pa.array(texts))
    want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert not encoder.cuts and ids.tolist() == [i for w in want for i in w] and sizes.tolist() == list(map(len, want))


def test_a_task_encodes_small_parts_of_a_batch():
    texts = ["some words of a text " * 5000] * 100  # 10 MB
    batch = pa.RecordBatch.from_pydict({"id": pa.array(range(100)), "t": pa.array(texts)})
    parts = list(tokens._chunks([batch]))
    assert [x for p in parts for x in p.column(0).to_pylist()] == list(range(100))
    assert max(sum(map(len, p.column(1).to_pylist())) for p in parts) <= (2 << 20) + len(texts[0])


def test_writing_hands_python_small_batches(spark, tmp_path):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was, seen = spark.conf.get(name), []
    rows = spark.range(3000).selectExpr("id as doc_id", "concat('text ', id) as text")
    with tokens.small_batches(spark):
        sizes = rows.coalesce(1).mapInArrow(lambda batches: (b.slice(0, 1) for b in batches), rows.schema).count()
        seen.append(int(spark.conf.get(name)))
    assert seen == [1024] and sizes == 3 and spark.conf.get(name) == was
    tokens.write(rows, str(tmp_path / "blocks"), PATH)
    assert spark.conf.get(name) == was

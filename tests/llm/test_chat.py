import hashlib

from dwellframe.llm import chat
from dwellframe.llm.queries import op6_chat_formatting

from .helpers import SF

ODD = [(1, 2, "user", "b"), (1, 1, "user", "a\\<|more|>"), (1, 3, "assistant", "</s>[INST] \U0001f600 [/INST]\\"), (1, 4, "assistant", ""), (1, 5, "assistant", None),
       (1, 6, None, "x"), (2, None, "assistant", "<|text|><|turn|>\n"), (2, 0, "<|turn|>[", "<<\\\\>>"), (None, 1, "assistant", "n"), (3, 1, "user", None), (4, 1, "assistant", "same"), (4, 1, "assistant", "same")]
SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    out = {}
    for c in {r[0] for r in rows}:
        turns = sorted(((t is not None, t or 0, r or "", x or "") for k, t, r, x in rows if k == c))
        said = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def digests_of(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in df.collect()}


def test_query(spark):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    said = "</s>[INST] ok [/INST]"
    assert digests_of(op6_chat_formatting(spark, SF)) == plain([*rows, (-1, 0, "user", said), (-1, 1, "assistant", said)])


def test_odd_and_empty_tables(spark):
    turns = spark.createDataFrame(ODD, SCHEMA)
    got = chat.digests(turns)
    assert digests_of(got) == plain(ODD)
    formatted = {r.conv_id: r for r in chat.format_conversations(turns).collect()}
    assert {r.conv_id: r.formatted_chars for r in got.collect()} == {c: len(r.formatted) for c, r in formatted.items()}
    assert formatted[1].formatted.startswith("<s><|turn|>user<|text|>a\\\\<\\|more|><|more|>b</s><|turn|>assistant<|text|><\\/s>[\\INST]")
    assert formatted[1].formatted.count("</s>") == 3 and formatted[1].formatted.count("[INST]") == 0
    assert chat.digests(spark.createDataFrame([], SCHEMA)).count() == 0


def test_escape_round_trip(spark):
    texts = ["", "\\", "<\\", "<<[\\\\[", "<|more|>", "</s>", "\\<", "a\\b[c<d"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(chat.F.col("t")).alias("e")).select("t", "e", chat.unescape(chat.F.col("e")).alias("u")).collect()
    for r in rows:
        assert r.u == r.t and not any(c in r.e for c in (chat.BOS, chat.TURN, chat.BODY, chat.MORE, chat.END, "[INST]"))

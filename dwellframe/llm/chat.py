"""Chat formatting with Spark expressions only.

    <s><|turn|>role<|text|>text<|more|>text</s><|turn|>role<|text|>text</s>...

Turns are collected and sorted (turn, role, text); adjacent turns of one role
are merged into one block whose texts stand between ``<|more|>``, so reading
back gives every turn. Inside roles and texts each ``<``, ``[`` and backslash is
followed by a backslash: no control string of this template (nor ``[INST]`` and
the like) can occur there, and dropping that backslash gives the text again.
``loss`` holds start and length (code points) of each assistant text in the
formatted string.

A conversation is one row of the result, so its turns meet in one task; the fold
that merges them copies arrays of pointers only.

Defined results: null roles and texts are empty; turns without a number come
first; equal numbers are ordered by role and text; repeated rows are repeated
turns; rows without a conversation id form one conversation with a null id; an
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOS, TURN, BODY, MORE, END = "<s>", "<|turn|>", "<|text|>", "<|more|>", "</s>"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"([<\[\\])", r"$1\\")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"([<\[\\])\\", "$1")


def format_conversations(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss: array of struct(start, length)."""
    rows = turns.select(F.col(key).alias("conv_id"), F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"))
    sorted_turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))

    def merge(acc: Column, t: Column) -> Column:
        own = F.array(escape(t.text))
        return (F.when(acc.role == t.role, F.struct(acc.done.alias("done"), acc.role.alias("role"), F.concat(acc.texts, own).alias("texts")))
                .otherwise(F.struct(F.concat(acc.done, closed(acc)).alias("done"), t.role.alias("role"), own.alias("texts"))))

    def closed(acc: Column) -> Column:
        return F.filter(F.array(F.struct(acc.role.alias("role"), acc.texts.alias("texts"))), lambda b: b.role.isNotNull())

    nothing = F.struct(F.expr("cast(array() as array<struct<role:string,texts:array<string>>>)").alias("done"), F.lit(None).cast("string").alias("role"), F.expr("cast(array() as array<string>)").alias("texts"))
    blocks = sorted_turns.select("conv_id", F.aggregate("turns", nothing, merge, lambda acc: F.concat(acc.done, closed(acc))).alias("blocks"))
    head = lambda b: F.concat(F.lit(TURN), escape(b.role), F.lit(BODY))
    whole = F.concat(F.lit(BOS), F.array_join(F.transform("blocks", lambda b: F.concat(head(b), F.array_join(b.texts, MORE), F.lit(END))), ""))
    # What stands before each text, and the text's own length.
    pieces = F.flatten(F.transform("blocks", lambda b, i: F.transform(b.texts, lambda t, k: F.struct(
        F.when(k > 0, len(MORE)).otherwise(F.char_length(head(b)) + F.when(i > 0, len(END)).otherwise(len(BOS))).alias("skip"),
        F.char_length(t).alias("length"), (b.role == trained).alias("loss")))))

    def span(acc: Column, p: Column) -> Column:
        own = F.array(F.struct((acc.at + p.skip).alias("start"), p.length.alias("length")))
        return F.struct((acc.at + p.skip + p.length).alias("at"), F.when(p.loss, F.concat(acc.spans, own)).otherwise(acc.spans).alias("spans"))

    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,length:int>>)").alias("spans"))
    return blocks.select("conv_id", whole.alias("formatted"), F.aggregate(pieces, start, span, lambda acc: acc.spans).alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role, text) and loss_text, from formatted strings and their loss mask alone."""
    blocks = F.filter(F.split(F.substring("formatted", len(BOS) + 1, 2**31 - 1), END), lambda b: b != "")

    def turns(b: Column) -> Column:
        head = F.substring_index(b, BODY, 1)
        role = unescape(head.substr(F.lit(len(TURN) + 1), F.char_length(head)))
        body = b.substr(F.char_length(head) + len(BODY) + 1, F.char_length(b))
        return F.transform(F.split(body, r"<\|more\|>"), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    masked = F.array_join(F.transform("loss", lambda s: unescape(F.col("formatted").substr(s.start + 1, s.length))), "")
    return formatted.select("conv_id", "formatted", F.flatten(F.transform(blocks, turns)).alias("turns"), masked.alias("loss_text"))


def digests(turns: DataFrame, **options) -> DataFrame:
    """Digests of what reading back gives, for each conversation."""
    back = read_back(format_conversations(turns, **options))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                       F.char_length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
                       F.char_length("formatted").cast("long").alias("formatted_chars"))

"""One query for each operator, over its whole table (``QUERIES``), and DuckDB SQL where SQL can express it (``SQL``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dwellframe.sources.tables import table

from . import chat, cws, decontam, langid, mixing, negatives, pii, quality, repair, sharding, simhash, tokens, toxicity
from .common import crc_fold


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix all documents: size, source size, target of the source and words taken, for every document."""
    planned = mixing.plan(table(spark, sf_dir, "documents"))
    return planned.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and how alike these and the next documents' are."""
    return cws.compare_edited(table(spark, sf_dir, "documents"))


def op3_quality_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of every document under the model of its language, and whether its language's threshold keeps it."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; documents of fold 0 of 5 are held out of training."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(crc_fold("doc_id", 5) != 0))
    rows = docs.select("doc_id", "text", F.coalesce(crc_fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"))
    return toxicity.predict(rows, model).select("doc_id", "held_out", "score", "predicted")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; documents of fold 2 of 4 are held out of training."""
    docs = table(spark, sf_dir, "documents")
    fold = crc_fold("doc_id", 4)
    model = langid.train(docs.where(fold != 2))
    return langid.predict(docs.select("doc_id", "text", F.coalesce(fold == 2, F.lit(False)).alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format all conversations and one that says control strings; digests of what reading back gives."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.digests(turns.unionByName(extra))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document: three-word shingles, at most three differing bits."""
    return simhash.fingerprint_table(table(spark, sf_dir, "documents"), shingle=3, radius=3)


def op8_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal values replaced by pseudonyms."""
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), key="example key")


def op9_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode, pack, write and read back all documents."""
    return tokens.write_and_read(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item: doc_id, item_id, similarity, first word and number of words."""
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector against all vectors."""
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(vectors, F.col("id") % 100 == 0, F.col("vec_id"), F.col("embedding"), label)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damage all conversations, then find and repair their faults at least cost."""
    turns = table(spark, sf_dir, "conversations")
    report, repaired = repair.repair(repair.damage(turns))
    found = report.join(repair.digests(repaired).withColumnRenamed("conv_id", "d"), F.col("conv_id").eqNullSafe(F.col("d")), "left").drop("d").withColumnRenamed("conv_id", "c")
    every = turns.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    return every.select("conv_id", *[F.coalesce(F.col(x), F.lit(0).cast("long")).alias(x) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def op13_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards whose row counts are at most one apart; equal texts stay together."""
    placed = sharding.assign(table(spark, sf_dir, "documents"), shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


OP1_SQL = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (
  select source, source_size, 2 * source_size as cap,
         [5, 2, 1][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as w from s),
o as (
  select *, cap / w as ratio, sum(cap) over (order by cap / w, source nulls last rows between unbounded preceding and current row) - cap as cut,
         sum(w) over () - (sum(w) over (order by cap / w, source nulls last rows between unbounded preceding and current row) - w) as rest,
         1.5::double * sum(source_size) over () as goal from w),
l as (
  select ((goal - cut) / rest)::double as level from o
  where cap >= ((goal - cut) / rest)::double * w order by ratio, source nulls last limit 1),
t as (
  select source, source_size, least(cap::double, (select level from l) * w) as target,
         case when source_size > 0 then least(cap::double, (select level from l) * w) / source_size::double else 0 end as rate from w)
select d.doc_id, d.size, t.source_size, t.target,
       d.size * (floor(t.rate)::bigint + case when ('0x' || substr(md5('17:' || coalesce(d.doc_id::varchar, 'none')), 1, 8))::bigint / 4294967296.0::double
                                                   < t.rate - floor(t.rate) then 1 else 0 end) as taken
from d join t on d.source is not distinct from t.source
"""

OP6_SQL = r"""
with r as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (
  select *, length(regexp_replace(role, '([<\[\\])', '\1.', 'g')) as role_chars, length(regexp_replace(text, '([<\[\\])', '\1.', 'g')) as text_chars,
         coalesce(lag(role) over (partition by conv_id order by turn nulls first, role, text) = role, false) as merged from r)
select conv_id, count(*)::bigint as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
       sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars,
       sha256(string_agg(case when role = 'assistant' then text else '' end, '' order by turn nulls first, role, text)) as loss_sha256,
       (3 + sum(text_chars + case when merged then 8 else 8 + role_chars + 8 + 4 end))::bigint as formatted_chars
from e group by conv_id
"""

OP11_SQL = r"""
with v as materialized (
  select vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as q
  from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as materialized (
  select a.id as anchor_id, b.id, a.label = b.label as own, list_dot_product(a.q, b.q)::bigint as score
  from v a join v b on a.id <> b.id where a.id % 100 = 0),
p as (select * from s where own qualify row_number() over (partition by anchor_id order by score desc, id) <= 5)
select p.anchor_id, p.id as positive_id, (row_number() over (partition by p.anchor_id, p.id order by n.score desc, n.id))::int as rank,
       n.id as negative_id, p.score as positive_score, n.score as negative_score
from p join s n on n.anchor_id = p.anchor_id and not n.own and 80 * p.score <= 100 * n.score and 100 * n.score <= 100 * p.score
qualify row_number() over (partition by p.anchor_id, p.id order by n.score desc, n.id) <= 5
"""

# crc32 byte by byte; then the cheapest edits from the last row to the first, for each state (0 none, 1 system, 2 user, 3 assistant),
# as one text: cost in nine digits, edits, character 1, repaired lines. The least text is the cheapest, ASCII-least way.
OP12_SQL = r"""
with recursive t as materialized (
  select list(c order by i) as tab from (
    select i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c
    from (select i::bigint as i from range(256) r(i)))),
k as (select *, concat(coalesce(conv_id::varchar, ' '), ':', coalesce(turn::varchar, ' ')) as key from conversations),
z as materialized (
  select key, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(key, ''), lambda x: ascii(x)::bigint)),
                              lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 20 as z
  from (select distinct key from k), t),
d as (
  select conv_id, turn, case when z = 4 then 'user' else coalesce(role, ' ') end as role,
         case when z = 1 then '' when z = 2 then regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') else coalesce(text, ' ') end as text,
         unnest(case when z = 3 then [0, 1] else [0] end) as copy
  from k join z using (key) where z <> 0),
o as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as p,
         row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as seen,
         left(role, 1) as i, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as body from d),
f as materialized (
  select *, body = '' as blank, body <> '' and seen > 1 as duplicate, body <> '' and seen = 1 and right(body, 1) not in ('.', '!', '?') as truncated,
         coalesce(lag(i) over (partition by conv_id order by p) || i not in ('su', 'ua', 'au'), false) as illegal,
         chr(10) || role || ':' || text as line, chr(10) || 'user:' || text as u_line, chr(10) || 'assistant:' || text as a_line,
         case when truncated then 5 else 0 end as more, blank or duplicate as gone from o),
r as (
  select conv_id, max(p) + 1 as p, '000000000' || chr(1) as x0, '000000010II' || chr(1) || chr(10) || 'user:' || chr(10) || 'assistant:' as x1,
         '000000005I' || chr(1) || chr(10) || 'assistant:' as x2, '000000000' || chr(1) as x3 from f group by conv_id
  union all
  select conv_id, p, least(y0, y0i, y0ii), least(y1, y0i, y0ii), least(y2, y2i), least(y3, y3i) from (
    select *, chr(1) as e,
           lpad((left(y2, 9)::int + 5)::varchar, 9, '0') || 'I' || split_part(substr(y2, 10), chr(1), 1) || chr(1) || chr(10) || 'user:' || substr(y2, 10 + instr(substr(y2, 10), chr(1))) as y3i,
           lpad((left(y3, 9)::int + 5)::varchar, 9, '0') || 'I' || split_part(substr(y3, 10), chr(1), 1) || chr(1) || chr(10) || 'assistant:' || substr(y3, 10 + instr(substr(y3, 10), chr(1))) as y2i,
           y3i as y0i, lpad((left(y3, 9)::int + 10)::varchar, 9, '0') || 'II' || split_part(substr(y3, 10), chr(1), 1) || chr(1) || chr(10) || 'user:' || chr(10) || 'assistant:' || substr(y3, 10 + instr(substr(y3, 10), chr(1))) as y0ii
    from (
      select conv_id, p,
             least(del0, case when not gone and i = 's' then keep1 end, case when not gone and i = 'u' then keep2 end, case when not gone then re2 end) as y0,
             least(del1, case when not gone and i = 'u' then keep2 end, case when not gone then re2 end) as y1,
             least(del2, case when not gone and i = 'a' then keep3 end, case when not gone then re3 end) as y2,
             least(del3, case when not gone and i = 'u' then keep2 end, case when not gone then re2 end) as y3
      from (
        select f.*,
               lpad((left(x0, 9)::int + 2)::varchar, 9, '0') || 'D' || substr(x0, 10) as del0, lpad((left(x1, 9)::int + 2)::varchar, 9, '0') || 'D' || substr(x1, 10) as del1,
               lpad((left(x2, 9)::int + 2)::varchar, 9, '0') || 'D' || substr(x2, 10) as del2, lpad((left(x3, 9)::int + 2)::varchar, 9, '0') || 'D' || substr(x3, 10) as del3,
               lpad((left(x1, 9)::int + more)::varchar, 9, '0') || 'K' || split_part(substr(x1, 10), chr(1), 1) || chr(1) || line || substr(x1, 10 + instr(substr(x1, 10), chr(1))) as keep1,
               lpad((left(x2, 9)::int + more)::varchar, 9, '0') || 'K' || split_part(substr(x2, 10), chr(1), 1) || chr(1) || line || substr(x2, 10 + instr(substr(x2, 10), chr(1))) as keep2,
               lpad((left(x3, 9)::int + more)::varchar, 9, '0') || 'K' || split_part(substr(x3, 10), chr(1), 1) || chr(1) || line || substr(x3, 10 + instr(substr(x3, 10), chr(1))) as keep3,
               lpad((left(x2, 9)::int + more + 1)::varchar, 9, '0') || 'R' || split_part(substr(x2, 10), chr(1), 1) || chr(1) || u_line || substr(x2, 10 + instr(substr(x2, 10), chr(1))) as re2,
               lpad((left(x3, 9)::int + more + 1)::varchar, 9, '0') || 'R' || split_part(substr(x3, 10), chr(1), 1) || chr(1) || a_line || substr(x3, 10 + instr(substr(x3, 10), chr(1))) as re3
        from r join f on f.conv_id is not distinct from r.conv_id and f.p = r.p - 1)))),
g as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps, sum(blank::int)::bigint as blank, sum(duplicate::int)::bigint as duplicate,
         sum(truncated::int)::bigint as truncated, sum(illegal::int)::bigint as illegal from f group by conv_id)
select c.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
       coalesce(left(x0, 9)::bigint, 0) as cost, coalesce(split_part(substr(x0, 10), chr(1), 1), '') as audit,
       sha256(coalesce(substr(x0, 11 + instr(substr(x0, 10), chr(1))), '')) as repaired_sha256
from (select distinct conv_id from conversations) c
left join g on g.conv_id is not distinct from c.conv_id
left join r on r.conv_id is not distinct from c.conv_id and r.p = 1
"""

QUERIES = {
    "op1_source_mixing": op1_source_mixing,
    "op2_document_fingerprints": op2_document_fingerprints,
    "op3_quality_perplexity": op3_quality_perplexity,
    "op4_toxicity": op4_toxicity,
    "op5_language_id": op5_language_id,
    "op6_chat_formatting": op6_chat_formatting,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_pii_pseudonyms": op8_pii_pseudonyms,
    "op9_token_blocks": op9_token_blocks,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_balanced_shards": op13_balanced_shards,
}

SQL = {"op1_source_mixing": OP1_SQL, "op6_chat_formatting": OP6_SQL, "op11_hard_negatives": OP11_SQL, "op12_conversation_repair": OP12_SQL}

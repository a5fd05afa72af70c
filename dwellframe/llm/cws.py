"""Document fingerprints by consistent weighted sampling (DataFrame functions only).

Terms are the words of a text, weighted by their counts. For each of ``K``
samples a term's hash yields two Gamma(2, 1) variates r and c and a uniform b;
with t = floor(ln w / r + b) the term with the smallest
ln c - r (t + 1 - b) is drawn, and (term, t) is the sample. Two texts draw the
same sample with a probability that equals their generalised Jaccard similarity
(sum of the smaller weights over sum of the larger).

A sample is one 64-bit number, the rank in the upper and a hash of (term, t) in
the lower half, so drawing is a ``min`` that is combined in each task.

``compare_edited`` deals the documents once into buckets of consecutive ids. The
document that follows a bucket's last one is sent along with the bucket, so
neighbours, samples and comparisons need no other shuffle.

Defined results: a null text is empty; texts without words have one fingerprint
of their own (alike 1 among themselves, 0 to others); rows without an id come
after all others; rows of one id are ordered by a hash of their text; repeated
rows give equal rows; an empty table gives none. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE, stored

K = 32
#: Bits of a term key that hold its weight; the rest holds its hash.
WEIGHT_BITS = 24


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def weighted_terms(text: Column) -> Column:
    """Array of keys, each the hash of a word and its count in one number; counts end at 2^24 - 1."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    hashes = F.array_sort(F.transform(words, lambda w: F.shiftleft(F.shiftrightunsigned(F.xxhash64(w), WEIGHT_BITS), WEIGHT_BITS)))

    def counted(s: Column) -> Column:
        ends = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == F.size(s)) | (F.get(s, i) != F.get(s, i - 1)))
        keys = let(ends, lambda e: F.transform(e, lambda at, j: F.get(s, at - 1).bitwiseOR(
            F.least(at - F.when(j == 0, 0).otherwise(F.get(e, j - 1)), F.lit((1 << WEIGHT_BITS) - 1)).cast("long"))))
        return F.when(F.size(s) > 0, keys).otherwise(F.expr("cast(array() as array<bigint>)"))

    return let(hashes, counted)


def _sample(k: int) -> Column:
    """Rank and identity of the term (columns h, lw) under sample k."""
    x = F.xxhash64("h", F.lit(k))
    unit = lambda shift, bits: (F.shiftrightunsigned(x, shift).bitwiseAND(F.lit((1 << bits) - 1).cast("long")).cast("double") + 0.5) / float(1 << bits)
    r = -F.log(unit(0, 13) * unit(13, 13))
    log_c = F.log(-F.log(unit(26, 13) * unit(39, 13)))
    b = unit(52, 12)
    t = F.floor(F.col("lw") / r + b)
    rank = ((log_c - r * (t.cast("double") + 1.0 - b) + 64.0) * float(1 << 24)).cast("long")
    return F.shiftleft(rank, 32).bitwiseOR(F.hash("h", t).cast("long").bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))


def _signature(samples: list[Column]) -> Column:
    """Eight hex digits for each sample; the samples of a text without words are the largest number."""
    return F.concat(*[F.lower(F.lpad(F.hex(F.coalesce(s, F.lit(-1).cast("long")).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))), 8, "0")) for s in samples])


def likeness(a: Column, b: Column, samples: int = K) -> Column:
    """Share of equal samples of two fingerprints."""
    same = [F.when(F.substring(a, 8 * k + 1, 8) == F.substring(b, 8 * k + 1, 8), 1).otherwise(0) for k in range(samples)]
    return sum(same[1:], same[0]) / F.lit(float(samples))


def fingerprint(docs: DataFrame, key: list[str], text: str = "text", samples: int = K) -> DataFrame:
    """``key`` columns (which must name a row) and fingerprint of every text."""
    terms = docs.select(*key, F.explode_outer(weighted_terms(F.coalesce(F.col(text), F.lit("")))).alias("term"))
    found = _weighed(terms, key).groupBy(*key).agg(*[F.min(_sample(k)).alias(f"s{k}") for k in range(samples)])
    return found.select(*key, _signature([F.col(f"s{k}") for k in range(samples)]).alias("fingerprint"))


def _weighed(terms: DataFrame, kept: list[str]) -> DataFrame:
    weight = F.col("term").bitwiseAND(F.lit((1 << WEIGHT_BITS) - 1).cast("long"))
    return terms.select(*kept, F.shiftrightunsigned("term", WEIGHT_BITS).alias("h"), F.log(weight.cast("double")).alias("lw"))


def _bucketed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """id, text, bucket, ghost: every row in the bucket of its id, and the first row of a bucket again in the one before it in descending order."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    edges = rows.select("id").agg(F.percentile_approx("id", [k / n for k in range(1, n)], 20 * n).alias("e")).first()["e"] or []
    splits = [float("-inf"), *(sorted({float(e) for e in edges}) or [0.0]), float("inf")]
    from pyspark.ml.feature import Bucketizer

    place = Bucketizer(splits=splits, inputCol="x", outputCol="y", handleInvalid="keep")
    rows = place.transform(rows.withColumn("x", F.coalesce(F.col("id").cast("double"), F.lit(0.0))))
    rows = rows.select("id", "text", F.xxhash64("text").alias("th"), F.when(F.col("id").isNull(), -1).otherwise(F.col("y").cast("int")).alias("b"))
    tops = rows.groupBy("b").agg(F.max(F.struct("id", "th")).alias("top"))
    # One row for each bucket: the bucket of larger ids that it follows (the last, null or smallest ids are followed by the first).
    above = F.coalesce(F.lead("b").over(W.orderBy("b")), F.min("b").over(W.partitionBy(F.lit(1))))
    tops = stored(tops.select("b", F.col("top.id").alias("top_id"), F.col("top.th").alias("top_th"), above.alias("above")), "tops")
    first = (F.col("th") == F.col("top_th")) & F.col("id").eqNullSafe(F.col("top_id"))
    both = rows.join(tops, "b", "left").select("id", "text", "th", F.explode(F.when(first, F.array(
        F.struct(F.col("b").alias("b"), F.lit(0).alias("ghost")), F.struct(F.col("above").alias("b"), F.lit(1).alias("ghost"))))
        .otherwise(F.array(F.struct(F.col("b").alias("b"), F.lit(0).alias("ghost"))))).alias("p"))
    return both.select("id", "text", "th", "p.b", "p.ghost").repartitionByRange("b")


def compare_edited(docs: DataFrame, key: str = "doc_id", text: str = "text", samples: int = K) -> DataFrame:
    """Fingerprints of every text and of its edited text (its last third replaced by the start of the next document)."""
    order = W.partitionBy("b").orderBy("ghost", F.desc_nulls_last("id"), F.desc("th"))
    rows = _bucketed(docs, key, text).select("b", "ghost", "id", "text", F.row_number().over(order).alias("seq"), F.lead("text").over(order).alias("next"))
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), n - third), F.coalesce(F.col("next"), F.col("text")).substr(F.lit(1), third))
    rows = rows.select("b", "ghost", "id", "seq", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    part = lambda k: F.conv(F.substring(F.sha2("edited", 256), 16 * k + 1, 16), 16, -10).cast("long")
    own, other = weighted_terms(F.col("text")), weighted_terms(F.col("edited"))
    rows = rows.select("b", "ghost", "id", "seq", "n_chars", *[part(k).alias(f"sha{k}") for k in range(4)], own.alias("own"), other.alias("other"))
    # A term of equal weight in both texts is drawn for once and serves both.
    flagged = lambda a, f: F.transform(a, lambda k: F.struct(k.alias("term"), F.lit(f).alias("f")))
    terms = F.concat(flagged(F.array_intersect("own", "other"), 3), flagged(F.array_except("own", "other"), 1), flagged(F.array_except("other", "own"), 2))
    kept = ["b", "ghost", "id", "seq", "n_chars", "sha0", "sha1", "sha2", "sha3"]
    rows = rows.select(*kept, F.explode_outer(terms).alias("x")).select(*kept, "x.term", "x.f")
    rows = _weighed(rows, [*kept, "f"])
    carried = [F.max(c).alias(c) for c in kept if c not in ("b", "seq")]
    drawn = rows.groupBy("b", "seq", "f").agg(*carried, *[F.min(_sample(k)).alias(f"s{k}") for k in range(samples)])
    mine = [F.min(F.when(F.col("f") != 2, F.col(f"s{k}"))).alias(f"s{k}") for k in range(samples)]
    its = [F.min(F.when(F.col("f") != 1, F.col(f"s{k}"))).alias(f"e{k}") for k in range(samples)]
    drawn = drawn.groupBy("b", "seq").agg(*carried, *mine, *its)
    sha = F.concat(*[F.lower(F.lpad(F.hex(f"sha{k}"), 16, "0")) for k in range(4)])
    prints = drawn.select("b", "seq", "ghost", "id", "n_chars", sha.alias("edited_sha256"),
                          _signature([F.col(f"s{k}") for k in range(samples)]).alias("fingerprint"), _signature([F.col(f"e{k}") for k in range(samples)]).alias("edited_fingerprint"))
    following = F.lead("fingerprint").over(W.partitionBy("b").orderBy("seq"))
    out = prints.withColumn("following", following).where("ghost = 0")
    return out.select(F.col("id").alias(key), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                      likeness(F.col("fingerprint"), F.col("edited_fingerprint"), samples).alias("near_edited"),
                      likeness(F.col("fingerprint"), F.col("following"), samples).alias("near_next"))

"""Quality by perplexity under an interpolated modified Kneser-Ney model of characters.

For each language a model of order ``ORDER`` is trained on all trusted texts.
Tasks count the n-grams of their texts, Spark adds the counts up (sharded by
n-gram), and every order is derived by joins of count tables: continuation
counts from the distinct n-grams of the order above, totals and discounts from
contexts, and interpolated probabilities by joining each order to its contexts
and to the order below. Nothing but counts is shuffled, never a text.

The finished table (log probability of each stored n-gram, log weight of each
context) is broadcast in shards of at most ``max_entries`` entries: those whose
last context character hashes to the shard, which is all that scoring a
character needs. One pass over the documents is made for each shard; its sums
are added up by document. So memory is bounded whatever the vocabulary.

``decide`` sets a threshold for each language: the quantile ``q`` of the
perplexity of trusted texts that were held out of training.

Defined results: runs of white space count as one space and digits as 0; a text
without characters, or in a language without trusted text, has no perplexity
(null) and is kept; so is one whose language has no threshold; a null language
is a language of its own; repeated rows are scored alike and all returned.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_fold, stored, text_udf

ORDER = 5
START, END = "\x02", "\x03"
BLOCK = 1 << 20
NO_LANG = "\x00"
_MIX = np.uint64(0x9E3779B97F4A7C15)
_DIGITS = re.compile(r"\d")


def prepared(text: str | None) -> str:
    """The characters that the model sees; empty if there are none."""
    body = " ".join((text or "").replace(START, " ").replace(END, " ").split())
    return START * (ORDER - 1) + _DIGITS.sub("0", body) + END if body else ""


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)


def _hashed(points: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n characters that end at each place (place included)."""
    h = np.full(len(at), n + 1, np.uint64)
    for k in range(n - 1, -1, -1):
        h = (h ^ points[at - k]) * _MIX
        h ^= h >> np.uint64(31)
    return h * _MIX


def count_grams(trusted: DataFrame) -> DataFrame:
    """(lang, g, c) of all ORDER-grams of the rows (lang, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[str]] = {}
        size = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                body = prepared(text)
                # A long text in slices that share ORDER - 1 characters: each n-gram is in one of them.
                for k in range(0, len(body), BLOCK):
                    part = body[max(0, k - ORDER + 1):k + BLOCK]
                    held.setdefault(lang, []).append(part)
                    size += len(part)
                    if size >= BLOCK:
                        yield from flush(held)
                        held, size = {}, 0
        yield from flush(held)

    def flush(held: dict[str, list[str]]) -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            whole = "".join(parts)
            ends = np.cumsum([len(p) for p in parts])
            last = np.ones(len(whole), bool)  # places that end an n-gram within their own text
            for e, p in zip(ends.tolist(), parts, strict=True):
                last[e - len(p):e - len(p) + ORDER - 1] = False
            at = np.flatnonzero(last)
            _, first, times = np.unique(_hashed(_points(whole), at, ORDER), return_index=True, return_counts=True)
            places = at[first].tolist()
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(places), pa.string()), "g": pa.array([whole[i - ORDER + 1:i + 1] for i in places], pa.string()), "c": pa.array(times, pa.int64())})

    return trusted.mapInArrow(count, "lang string, g string, c long").groupBy("lang", "g").agg(F.sum("c").alias("c"))


def discounts(counts: DataFrame) -> dict[str, tuple[float, float, float]]:
    """Modified Kneser-Ney discounts of one order, for each language, from its counts of counts."""
    seen: dict[str, dict[int, int]] = {}
    for r in counts.where("c <= 4").groupBy("lang", "c").agg(F.count("*").alias("n")).collect():
        seen.setdefault(r.lang, {})[r.c] = r.n
    out = {}
    for lang, n in seen.items():
        n = [n.get(k, 0) for k in range(1, 5)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
        # A count of counts of zero leaves a formula without value; half a count is taken off then.
        out[lang] = tuple(min(k, max(0.0, k - (k + 1) * y * n[k] / n[k - 1])) if n[k - 1] and n[k] else 0.5 for k in (1, 2, 3))
    return out


def _by_count(d: dict[str, tuple], one: Column, two: Column, more: Column) -> Column:
    """Discount for counts of one, two and more, by language."""
    pick = lambda k: F.coalesce(F.create_map(*[F.lit(v) for lang, x in d.items() for v in (lang, float(x[k]))])[F.col("lang")] if d else F.lit(None), F.lit(0.5))
    return pick(0) * one + pick(1) * two + pick(2) * more


def train(trusted: DataFrame) -> DataFrame:
    """(lang, n, g, value): log probability of n-grams, and log weight of contexts (n = minus their length - 1)."""
    counts = {ORDER: stored(count_grams(trusted), "grams")}
    for n in range(ORDER - 1, 0, -1):
        counts[n] = stored(counts[n + 1].groupBy("lang", F.substring("g", 2, n).alias("g")).agg(F.count("*").alias("c")), "grams")
    below = None
    entries = []
    is_ = lambda k: (F.col("c") == k if k < 3 else F.col("c") >= 3).cast("double")
    for n in range(1, ORDER + 1):
        d = discounts(counts[n])
        left = _by_count(d, is_(1), is_(2), is_(3))
        contexts = counts[n].groupBy("lang", F.substring("g", 1, n - 1).alias("h")).agg(F.sum("c").alias("total"), F.sum(left).alias("cut"), F.count("*").alias("kinds"))
        contexts = stored(contexts.select("lang", "h", "total", (F.col("cut") / F.col("total")).alias("w"), "kinds"), "contexts")
        own = counts[n].select("lang", "g", F.substring("g", 1, n - 1).alias("h"), (F.col("c") - left).alias("kept"))
        own = own.join(contexts, ["lang", "h"])
        if below is None:
            rest = F.lit(1.0) / (F.col("kinds") + 1)  # uniform over the characters seen and one for all others
        else:
            own = own.withColumn("lower", F.substring("g", 2, n - 1)).join(below.select("lang", F.col("g").alias("lower"), F.col("p").alias("q")), ["lang", "lower"])
            rest = F.col("q")
        below = stored(own.select("lang", "g", (F.col("kept") / F.col("total") + F.col("w") * rest).alias("p")), "probabilities")
        entries.append(below.select("lang", F.lit(n).alias("n"), "g", F.log("p").alias("value")))
        weight = F.log(F.greatest(F.col("w"), F.lit(1e-12)))
        entries.append(contexts.select("lang", F.lit(-n).alias("n"), F.col("h").alias("g"), (weight - F.log(F.col("kinds") + 1.0) if n == 1 else weight).alias("value")))
    out = entries[0]
    for e in entries[1:]:
        out = out.union(e)
    return stored(out, "model")


class Table:
    """Values by 64-bit hash: keys sorted, and the first key of each run of equal top bits."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order].astype(np.float32)
        bits = max(1, min(24, int(len(keys)).bit_length()))
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(self.keys >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Value of each hash, nan where there is none."""
        out = np.full(len(h), np.nan, np.float32)
        top = (h >> self.shift).astype(np.int64)
        at, stop = self.first[top], self.first[top + 1]
        left = np.flatnonzero(at < stop)
        while len(left):
            same = self.keys[at[left]] == h[left]
            out[left[same]] = self.values[at[left[same]]]
            left = left[~same]
            at[left] += 1
            left = left[at[left] < stop[left]]
        return out


def hashed_entries(model: DataFrame) -> DataFrame:
    """(lang, n, key, value): entries with the 64-bit hash of their characters, as scoring looks them up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order, grams = batch.column(1).to_numpy(), np.array(batch.column(2).to_pylist(), object)
            keys = np.zeros(len(order), np.uint64)
            for n in np.unique(order).tolist():
                mine = np.flatnonzero(order == n)
                if size := n if n > 0 else -n - 1:
                    keys[mine] = _hashed(_points("".join(grams[mine].tolist())), np.arange(len(mine)) * size + size - 1, size)
            yield pa.RecordBatch.from_pydict({"lang": batch.column(0), "n": batch.column(1), "key": pa.array(keys.view(np.int64)), "value": batch.column(3).cast(pa.float32())})

    return model.select("lang", F.col("n").cast("int").alias("n"), "g", "value").mapInArrow(run, "lang string, n int, key long, value float")


class Model:
    """One shard of the hashed entries of a trained table."""

    def __init__(self, rows: pa.Table, shard: int, shards: int):
        self.shard, self.shards = shard, shards
        self.tables: dict[tuple[str, int], Table] = {}
        self.unseen: dict[str, float] = {}
        names = rows.column("lang").combine_chunks().dictionary_encode() if rows.num_rows else None
        order, keys, value = (rows.column(c).to_numpy() for c in ("n", "key", "value"))
        for k, name in enumerate(names.dictionary.to_pylist() if names else ()):
            own = names.indices.to_numpy() == k
            for n in range(-ORDER, ORDER + 1):
                mine = np.flatnonzero(own & (order == n))
                if n == -1:
                    self.unseen[name] = float(value[mine[0]]) if len(mine) else 0.0
                elif n and len(mine):
                    self.tables[name, n] = Table(keys[mine].view(np.uint64), value[mine])

    def log_probability(self, lang: str, text: str | None) -> tuple[float, int] | None:
        """Sum over the characters of a text whose context belongs to this shard, and their number; None without a model."""
        body = prepared(text)
        if not body or lang not in self.unseen:
            return None
        total, n = 0.0, 0
        for k in range(ORDER - 1, len(body), BLOCK):
            part = body[k - ORDER + 1:k + BLOCK]
            points = _points(part)
            at = np.arange(ORDER - 1, len(points))
            if self.shards > 1:
                before, which = np.unique(points[at - 1], return_inverse=True)
                own = np.array([zlib.crc32(chr(int(c)).encode()) % self.shards == self.shard for c in before])
                at = at[own[which]]
            n += len(at)
            for order in range(ORDER, 0, -1):
                if not len(at):
                    break
                table = self.tables.get((lang, order))
                value = table.find(_hashed(points, at, order)) if table else np.full(len(at), np.nan)
                miss = np.isnan(value)
                total += float(value[~miss].sum(dtype=np.float64))
                at = at[miss]
                if order == 1:
                    total += self.unseen[lang] * len(at)
                elif len(at) and (weights := self.tables.get((lang, -order))):
                    total += float(np.nansum(weights.find(_hashed(points, at - 1, order - 1)), dtype=np.float64))
        return total, n


def _language(lang: str) -> Column:
    return F.coalesce(F.col(f"`{lang}`"), F.lit(NO_LANG))


def score(docs: DataFrame, model: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", max_entries: int = 4_000_000) -> DataFrame:
    """doc_id, lang, n_symbols, perplexity of every row."""
    n = model.count()
    shards = max(1, -(-n // max_entries))
    last = F.when(F.col("n") > 0, F.substring("g", -2, 1)).otherwise(F.substring("g", -1, 1))
    place = F.pmod(F.crc32(last.cast("binary")), F.lit(shards))
    everywhere = F.col("n").isin(1, -1)
    spark, parts = docs.sparkSession, []
    for s in range(shards):
        shared = spark.sparkContext.broadcast(Model(hashed_entries(model.where(everywhere | (place == s))).toArrow(), s, shards))

        def make(shared=shared):
            def run(texts: list) -> list[tuple]:
                out = []
                for t in texts:
                    found = shared.value.log_probability(*(t.split("\x1f", 1) if t is not None else (NO_LANG, None)))
                    out.append((None, 0) if found is None else found)
                return out

            return run

        both = F.concat(_language(lang), F.lit("\x1f"), F.coalesce(F.col(f"`{text}`"), F.lit("")))
        scored = text_udf(make, "total double, n long")(both)
        parts.append(docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{lang}`").alias("lang"), F.xxhash64(f"`{text}`").alias("h") if shards > 1 else F.lit(0).alias("h"), scored.alias("s")).select("doc_id", "lang", "h", "s.total", "s.n"))
    if shards == 1:
        sums = parts[0]
    else:
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.union(p)
        # Rows equal in id, language and text have equal parts: they are added up once and given as often as they came.
        sums = whole.groupBy("doc_id", "lang", "h").agg(F.sum("total").alias("total"), F.sum("n").alias("n"), (F.count("*") / shards).cast("int").alias("copies"))
        sums = sums.select("doc_id", "lang", (F.col("total") / F.col("copies")).alias("total"), (F.col("n") / F.col("copies")).cast("long").alias("n"), F.explode(F.expr("array_repeat(1, copies)")))
    return sums.select("doc_id", "lang", F.col("n").alias("n_symbols"), F.exp(-F.try_divide("total", F.col("n").cast("double"))).alias("perplexity"))


def trusted_ids(labels: DataFrame, key: str = "doc_id", label: str = "quality") -> DataFrame:
    """Ids that a label trusts and none distrusts."""
    return labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("trusted_id")).agg(F.min(label).alias("least")).where("least > 0").select("trusted_id")


def classify(docs: DataFrame, labels: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", q: float = 0.995, folds: int = 10,
             max_broadcast_ids: int = 1_000_000, max_entries: int = 4_000_000) -> DataFrame:
    """doc_id, lang, n_symbols, perplexity, threshold, keep of every row.

    Trusted rows of fold 0 of ``folds`` (by crc32 of the id) set the thresholds,
    the others train. Up to ``max_broadcast_ids`` trusted ids are broadcast to
    the documents; more are joined by a shuffle.
    """
    trusted = stored(trusted_ids(labels, key), "trusted")
    few = trusted.count() <= max_broadcast_ids
    rows = docs.select(F.col(f"`{key}`").alias("trusted_id"), _language(lang).alias("lang"), F.col(f"`{text}`").alias("text")).where(F.coalesce(crc_fold("trusted_id", folds), F.lit(0)) != 0)
    rows = rows.join(F.broadcast(trusted) if few else trusted, "trusted_id", "left_semi")
    scored = stored(score(docs, train(rows.select("lang", "text")), text, lang, key, max_entries), "scored")
    held_out = scored.where(crc_fold("doc_id", folds) == 0).join(trusted, F.col("doc_id") == F.col("trusted_id"), "left_semi").where("perplexity is not null")
    limits = held_out.groupBy(F.col("lang").alias("of")).agg(F.percentile_approx("perplexity", q, 10_000).alias("threshold"))
    out = scored.join(F.broadcast(limits), F.col("lang").eqNullSafe(F.col("of")), "left")
    return out.select("doc_id", "lang", "n_symbols", "perplexity", "threshold", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)).alias("keep"))

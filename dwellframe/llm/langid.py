"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of every labelled row (``max_rows`` bounds them for each
language where it is given). A document that
holds an n-gram n times counts as log(1 + n), so that one very long text cannot
outweigh its language; each task adds up a dense count vector for each language
it meets and sends only its non-zero cells. The log-probability matrix (buckets x
languages, float32) is broadcast in blocks of at most ``block_langs`` languages
(64 MB by default), however many languages are labelled. Up to that many
are scored in one pass; beyond it each block is a pass of its own, and the best
language and the log-sum so far are kept for every document. Scoring gathers and
sums rows in numpy, slice by slice of ``SLICE`` code points, so a very long text
needs bounded memory.

The posterior says which learned language fits best, not whether it fits: it is
about 1 for any text of some letters. ``predict(..., floor=True)`` also holds the
mean log-likelihood per n-gram under the best language (with ``PRIOR_GRAMS``
typical n-grams more, which a very short text needs) against the language's
floor. The floor comes from all training documents of each language, each scored
without its own counts (quantiles of a sketch of ``ACCURACY``): it lies as far below their quantile
``low`` as that lies below their median. It is learned from the labelled rows
alone: a real text of a learned language whose words the training rows hardly
know also falls below it.

Defined results: a null text or one without letters is ``und`` with score 0; so is
one below the floor, where asked for, and every text if nothing was learned (empty
table, no labelled row). Repeated rows get equal predictions; equal scores go to the
language that sorts first. Rows with a null id, text or lang are never learned from.
Input columns named like an output column are replaced.
"""

from __future__ import annotations

import functools
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, text_udf, with_struct

ORDERS = (1, 2, 3, 4)
SLICE = 1 << 20
#: Code points hashed at once, and code points below which the hash's first step is looked up.
BLOCK, FEW = 1 << 13, 1 << 10
UNKNOWN = "und"
#: Damped counts are added up as whole numbers of 1/DAMP, so sums do not depend on their order.
DAMP = 1024
LOW, PRIOR_GRAMS, ACCURACY = 0.001, 16, 100_000
BEST_FIELDS = "lang string, total double, lse double, margin double"
BEST = f"struct<{BEST_FIELDS.replace(' ', ': ').replace(',:', ',')}>"
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class LangBlock:
    """Languages and the matrix of log P(bucket | language); log class shares of all training rows; typical and least mean log-likelihood per n-gram."""

    langs: tuple[str, ...]
    log_p: np.ndarray
    log_prior: np.ndarray
    typical: np.ndarray
    floor: np.ndarray


@dataclass(frozen=True)
class LangModel:
    """All learned languages, sorted; ``block(k)`` gives the k-th block of them, read from the stored counts if there are several."""

    langs: tuple[str, ...]
    blocks: int
    block: Callable[[int], LangBlock]


@functools.lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """For code points below 2**16: 0 for what ``_NOT_LETTERS`` matches, 3 for letters, 1 for other word characters."""
    chars = list(map(chr, range(1 << 16)))
    word = np.array([c.isalnum() and not c.isdecimal() for c in chars])
    return (word + 2 * np.array([c.isalpha() for c in chars]) * word).astype(np.uint8)


def _clean_points(text: str) -> np.ndarray | None:
    """Code points of the letters of a text, runs of others as one space, one space at both ends; None without letters."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), np.uint32)
    if points.max() < 1 << 16:
        kind = _kinds()[points]
        if not (kind & 2).any():
            return None
        kept = kind > 0
        kept[1:] |= kept[:-1]  # the first of the others behind a word stands for all of them
        kept[0] = True
        if not kind[1]:  # as do those before the first word
            first = int(np.argmax(kind > 0))
            kept[1:first] = False
        return np.where(kind > 0, points, np.uint32(32))[kept]
    clean = _NOT_LETTERS.sub(" ", text.lower()).strip()
    if not any(map(str.isalpha, clean)):  # other word characters, such as superscripts, are no letters
        return None
    return np.frombuffer(f" {clean} ".encode("utf-32-le"), np.uint32)


def gram_buckets(text: str, buckets: int) -> Iterator[np.ndarray]:
    """Hashed n-gram buckets of the letters of a text (other runs count as one space), in slices."""
    if len(text) < SLICE:
        points = _clean_points(text)
        if points is not None:
            yield from _slice_buckets(points, 0, buckets)
        return
    clean = _NOT_LETTERS.sub(" ", text.lower()).strip()
    if not any(map(str.isalpha, clean)):
        return
    clean = f" {clean} "
    for start in range(0, len(clean), SLICE):
        part = clean[max(0, start - ORDERS[-1] + 1):start + SLICE]
        own = min(start, ORDERS[-1] - 1)  # code points repeated from the slice before
        yield from _slice_buckets(np.frombuffer(part.encode("utf-32-le"), np.uint32), own, buckets)


def _mixed(h: np.ndarray) -> np.ndarray:
    """One step of the hash, in place."""
    h *= _MIX
    h ^= h >> np.uint64(29)
    return h


@functools.lru_cache(maxsize=1)
def _first_steps() -> dict[int, np.ndarray]:
    """The first step for the code points below ``FEW``, by order."""
    return {n: _mixed(np.arange(FEW, dtype=np.uint64) ^ np.uint64(n)) for n in ORDERS}


def _slice_buckets(points: np.ndarray, own: int, buckets: int) -> Iterator[np.ndarray]:
    """The buckets of the n-grams of some code points but for those within the first ``own``; in blocks that stay in the processor's cache."""
    shift = np.uint64(64 - (buckets.bit_length() - 1))
    few = bool(points.max(initial=0) < FEW)
    starts = _first_steps()
    for at in range(0, len(points), BLOCK):
        some = points[max(0, at - ORDERS[-1] + 1) if at else 0:at + BLOCK]
        skip = min(at, ORDERS[-1] - 1) if at else own
        wide = some.astype(np.uint64)
        for n in ORDERS:
            first = max(0, skip - n + 1)
            size = len(some) - n + 1 - first
            if size < 1:
                continue
            h = starts[n].take(some[first:first + size]) if few else _mixed(wide[first:first + size] ^ np.uint64(n))
            for k in range(1, n):
                h ^= wide[first + k:first + k + size]
                _mixed(h)
            h *= _MIX
            h >>= shift
            yield h.view(np.int64)


def train(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", max_rows: int | None = None,
          buckets: int = 1 << 17, block_langs: int = 128, alpha: float = 0.5, low: float = LOW) -> LangModel:
    """Fit on all labelled rows, or on about ``max_rows`` for each language; ``buckets`` is a power of two."""
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")).where("k is not null and t is not null and l is not null")
    classes = rows.groupBy("l").agg(F.count("*").alias("n")).orderBy("l").collect()  # one row a language
    langs = tuple(sorted(r.l for r in classes))
    rows_of = {r.l: r.n for r in classes}
    sampled = sum(min(max_rows or n, n) for n in rows_of.values())
    parts = [langs[k:k + block_langs] for k in range(0, len(langs), block_langs)]

    @functools.lru_cache(maxsize=1)
    def block(k: int) -> LangBlock:
        return _fit_block(rows, parts[k], rows_of, sampled, max_rows, buckets, alpha, low)

    if len(parts) == 1:
        block(0)
    return LangModel(langs, len(parts), block)


def _sample(rows: DataFrame, langs: tuple[str, ...], rows_of: dict[str, int], most: int | None) -> DataFrame:
    """The rows (l, t) of the languages, or about ``most`` of each, chosen by the hash of their ids."""
    if most is None:
        return rows.where(F.col("l").isin(*langs)).select("l", "t")
    share = F.create_map(*[F.lit(v) for name in langs for v in (name, min(1.0, most / rows_of[name]))])[F.col("l")]
    return rows.where(F.pmod(F.xxhash64(F.col("k").cast("string")), F.lit(1 << 20)) < share * (1 << 20)).select("l", "t")


def _fit_block(rows: DataFrame, langs: tuple[str, ...], rows_of: dict[str, int], sampled: int, max_rows: int | None, buckets: int, alpha: float, low: float) -> LangBlock:
    place = {name: i for i, name in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for name, cells in held.items():
                at = np.flatnonzero(cells)
                yield pa.RecordBatch.from_pydict({"l": pa.array([name] * len(at), pa.string()), "b": pa.array(at, pa.int64()), "c": pa.array(cells[at], pa.int64())})
            held.clear()

        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if name not in held and len(held) >= 16:
                    yield from flush()
                cells = held.setdefault(name, np.zeros(buckets, np.int64))
                at, times = _times(body, buckets)
                cells[at] += _damped(times)
        yield from flush()

    found = _sample(rows, langs, rows_of, max_rows).mapInArrow(count, "l string, b long, c long").groupBy("l", "b").agg(F.sum("c").alias("c")).toArrow()
    counts = np.zeros((buckets, len(langs)))
    which = np.array([place[x] for x in found.column("l").to_pylist()], np.int64)
    counts[found.column("b").to_numpy(), which] = found.column("c").to_numpy() / DAMP
    log_p = np.log(counts + alpha) - np.log(counts.sum(axis=0) + alpha * buckets)
    prior = np.log(np.array([min(max_rows or rows_of[name], rows_of[name]) for name in langs], float) / sampled)
    bare = LangBlock(langs, log_p.astype(np.float32), prior, np.zeros(len(langs)), np.full(len(langs), -np.inf))
    sizes_of = counts.sum(axis=0)
    del counts, log_p
    shared = rows.sparkSession.sparkContext.broadcast((bare, sizes_of))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, total = shared.value
        for batch in batches:
            out = [_without_own(m, total, alpha, place[name], body) for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            fine = [x for x in out if x]
            yield pa.RecordBatch.from_pydict({"k": pa.array([x[0] for x in fine], pa.int32()), "n": pa.array([x[1] for x in fine], pa.int64()), "s": pa.array([x[2] for x in fine], pa.float64())})

    fits = stored(_sample(rows, langs, rows_of, max_rows).mapInArrow(fit, "k int, n long, s double"), "fits")
    typical, floor = bare.typical, bare.floor
    for r in fits.groupBy("k").agg(F.percentile_approx(F.col("s") / F.col("n"), 0.5, ACCURACY).alias("m")).collect():  # one row a language
        typical[r["k"]] = r["m"]
    usual = F.get(F.array(*[F.lit(float(x)) for x in typical]), F.col("k"))
    mean = (F.col("s") + PRIOR_GRAMS * usual) / (F.col("n") + PRIOR_GRAMS)
    for r in fits.groupBy("k").agg(F.percentile_approx(mean, [low, 0.5], ACCURACY).alias("m")).collect():
        least, median = r["m"]
        floor[r["k"]] = least - max(0.0, median - least)
    shared.unpersist()
    return bare


def _times(text: str, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text and how often it holds each."""
    found, held = [], 0
    for at in gram_buckets(text, buckets):
        found.append((at.astype(np.int32), np.ones(0)))
        held += len(at)
        if held >= SLICE:
            found, held = [_counted(found)], 0
    if not found:
        return np.zeros(0, np.int64), np.zeros(0)
    place, times = _counted(found)
    return place.astype(np.int64), times


def _counted(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets and how often each occurs, of (buckets, their times; none: once each) parts."""
    whole = [(at, times) for at, times in found if len(times)]
    single = np.concatenate([at for at, times in found if not len(times)] or [np.zeros(0, np.int32)])
    single.sort()
    first = np.flatnonzero(np.append(True, single[1:] != single[:-1])) if len(single) else np.zeros(0, np.int64)
    place, times = single[first], np.diff(np.append(first, len(single))).astype(float)
    if not whole:
        return place, times
    place, back = np.unique(np.concatenate([place, *[at for at, _ in whole]]), return_inverse=True)
    return place, np.bincount(back, weights=np.concatenate([times, *[n for _, n in whole]]))


def _damped(times: np.ndarray) -> np.ndarray:
    """log(1 + n) in whole units of 1/DAMP."""
    table = _damp_table()
    if times.max(initial=0) < len(table):
        return table[times.astype(np.int64)]
    return np.rint(DAMP * np.log1p(times)).astype(np.int64)


@functools.lru_cache(maxsize=1)
def _damp_table() -> np.ndarray:
    return np.rint(DAMP * np.log1p(np.arange(4096.0))).astype(np.int64)


def _without_own(m: LangBlock, total: np.ndarray, alpha: float, own: int, text: str) -> tuple[int, int, float] | None:
    """Best language, n-grams and log-likelihood of a training text by the counts of all others; None without n-grams."""
    at, times = _times(text, len(m.log_p))
    if not len(at):
        return None
    log_p = m.log_p[at].astype(float)
    mine, size = _damped(times) / DAMP, total[own] + alpha * len(m.log_p)
    left = np.maximum(0.0, np.exp(log_p[:, own]) * size - alpha - mine)
    log_p[:, own] = np.log(left + alpha) - np.log(size - mine.sum())
    sums = times @ log_p
    best = int(np.argmax(sums))
    return best, int(times.sum()), float(sums[best])


def predict(docs: DataFrame, model: LangModel, text: str = "text", floor: bool = False) -> DataFrame:
    """``docs`` with lang_pred and score (posterior probability of the prediction, 0 for ``und``); ``floor``: texts unlike every learned language are ``und``."""
    held = f"best_{uuid.uuid4().hex}"
    best = F.lit(None).cast(BEST)
    for k in range(model.blocks):
        block = model.block(k)
        if k:
            docs = stored(docs.withColumn(held, best), "languages")
        now = _scorer(docs, block)(F.col(f"`{text}`"))
        best = _better(F.col(held), now) if k else now
    fits = (best["margin"] >= 0) if floor else F.lit(True)
    known = best["lang"].isNotNull() & fits
    out = F.struct(F.when(known, best["lang"]).otherwise(F.lit(UNKNOWN)).alias("lang_pred"), F.when(known, F.exp(best["total"] - best["lse"])).otherwise(F.lit(0.0)).alias("score"))
    return with_struct(docs, out, ("lang_pred", "score")).drop(held)


def _scorer(docs: DataFrame, block: LangBlock) -> Callable[[Column], Column]:
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def make():
        m = shared.value
        columns = _columns(m)

        def score(texts: list) -> list[tuple]:
            return [best_of(m, t, columns) for t in texts]

        return score

    return text_udf(make, BEST_FIELDS)


def _better(a: Column, b: Column) -> Column:
    """Two blocks' results as one; languages of the first sort before those of the second."""
    most, least = F.greatest(a["lse"], b["lse"]), F.least(a["lse"], b["lse"])
    first = a["total"] >= b["total"]
    return F.struct(*[F.when(first, a[x]).otherwise(b[x]).alias(x) for x in ("lang", "total")], (most + F.log1p(F.exp(least - most))).alias("lse"), F.when(first, a["margin"]).otherwise(b["margin"]).alias("margin"))


def _columns(m: LangBlock) -> list[np.ndarray] | None:
    """The matrix as one array a language, if there are few: sums of single columns are faster than of short rows."""
    return [np.ascontiguousarray(m.log_p[:, k]) for k in range(len(m.langs))] if len(m.langs) <= 16 else None


def best_of(m: LangBlock, text: str | None, columns: list[np.ndarray] | None = None) -> tuple[str | None, float | None, float | None, float | None]:
    """Best language of a block, its log-probability, the log-sum over the block, and how far the fit lies above the floor; nulls without letters."""
    total, n = m.log_prior.astype(float).copy(), 0
    for at in gram_buckets(text, len(m.log_p)) if text and m.langs else ():
        total += m.log_p[at].sum(axis=0, dtype=np.float64) if columns is None else [c.take(at).sum(dtype=np.float64) for c in columns]
        n += len(at)
    if not n:
        return None, None, None, None
    best = int(np.argmax(total))
    mean = (total[best] - m.log_prior[best] + PRIOR_GRAMS * m.typical[best]) / (n + PRIOR_GRAMS)
    return m.langs[best], float(total[best]), float(total[best] + np.log(np.exp(total - total[best]).sum())), float(max(-1e300, min(1e300, mean - m.floor[best])))

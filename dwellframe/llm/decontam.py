"""Benchmark decontamination by SimHash of item-sized windows.

Words are lower-cased runs between white space and ASCII punctuation; shingles
are five words (a shorter item is one shingle of all its words). For an item of
L words every window of L words of a document that holds at least one of the
item's shingles gets a 64-bit SimHash (any other window has similarity 0 and
cannot be found). A multi-index over eight 8-bit blocks returns every item of
that length whose fingerprint differs in at most ``RADIUS`` bits: of two such
fingerprints one block differs in at most RADIUS // 8 = 2 bits. What it returns
is verified by the exact weighted Jaccard similarity of shingle counts.

At similarity 0.8 equal-sized windows share 8/9 of their shingles, so a bit
differs with probability of about 0.15: 9.7 of 64 bits on average, standard
deviation 2.9. ``RADIUS`` 22 lies more than four deviations above. This holds
where all shingles of both are distinct. The votes of a repeated shingle move
together and the distance spreads, so an item or a window that holds a shingle
twice does without fingerprints: the shingles it shares with each window are
counted, by prefix sums over the places of the item's shingles.

Items are read in blocks of at most ``block_chars`` characters (one longer item
is a block of its own); each block is broadcast and held against all documents,
so the benchmark may have any size.

Defined results: null or empty texts and items never match; a document shorter
than an item is one window; repeated items are found each; items with a null id
count under null; of equally similar windows the first is given.
"""

from __future__ import annotations

from collections import Counter
from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import others, text_udf, words_of

SHINGLE = 5
RADIUS = 22
BLOCKS = 8
_NEAR = [[v for v in range(256) if (v ^ x).bit_count() <= RADIUS // BLOCKS] for x in range(256)]
_MUL = np.uint64(0x9E3779B97F4A7C15)


def _hashes(words: list[bytes], size: int) -> np.ndarray:
    """A hash of every run of ``size`` words (used within one process only)."""
    w = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    n = len(words) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    h = np.full(n, size, np.uint64)
    for k in range(size):
        h = (h ^ w[k:n + k]) * _MUL
        h ^= h >> np.uint64(31)
    return h


def _prints(h: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """SimHash of the runs h[s:s+n] as rows of eight bytes."""
    bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    sums = np.zeros((len(h) + 1, 64), np.int32)
    np.cumsum(bits, axis=0, out=sums[1:], dtype=np.int32)
    return np.packbits((sums[starts + n] - sums[starts]) * 2 > n, axis=1)


class Index:
    """One block of items: shingle anchors, and for each item length a multi-index of fingerprints."""

    def __init__(self, items: list[tuple]):
        self.ids = [i for i, _ in items]
        self.words = [words_of(t) for _, t in items]
        self.size = np.array([min(SHINGLE, len(w)) for w in self.words], np.int64)
        self.length = np.array([len(w) for w in self.words], np.int64)
        self.repeats = np.zeros(len(items), bool)
        self.counts = [Counter(_shingles(w, s)) for w, s in zip(self.words, self.size.tolist(), strict=True)]
        self.anchors: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.tables: dict[int, list[dict[int, list[int]]]] = {}
        self.prints = np.zeros((len(items), BLOCKS), np.uint8)
        keys: dict[int, list[tuple[np.ndarray, int]]] = {}
        for k, w in enumerate(self.words):
            if not w:
                continue
            h = _hashes(w, s := int(self.size[k]))
            keys.setdefault(s, []).append((np.unique(h), k))
            self.repeats[k] = len(keys[s][-1][0]) < len(h)
            self.prints[k] = _prints(h, np.zeros(1, np.int64), len(h))[0]
            table = self.tables.setdefault(len(w), [{} for _ in range(BLOCKS)])
            for b in range(BLOCKS):
                for v in _NEAR[self.prints[k, b]]:
                    table[b].setdefault(v, []).append(k)
        for s, found in keys.items():
            h = np.concatenate([x for x, _ in found])
            item = np.repeat([k for _, k in found], [len(x) for x, _ in found])
            order = np.argsort(h, kind="stable")
            shift = np.uint64(max(36, 64 - int(len(h) * 16).bit_length()))
            seen = np.zeros(1 << (64 - int(shift)), bool)
            seen[(h >> shift).astype(np.int64)] = True
            self.anchors[s] = h[order], item[order], (seen, shift)

    def matches(self, text: str | None, least: float) -> list[tuple]:
        """(item_id, similarity, start, words) of every item found in the text."""
        words = words_of(text)
        found: dict[int, tuple[float, int, int]] = {}
        for s, (keys, item, (seen, shift)) in self.anchors.items():
            h = _hashes(words, s)
            at = np.flatnonzero(seen[(h >> shift).astype(np.int64)])
            low, high = np.searchsorted(keys, h[at], "left"), np.searchsorted(keys, h[at], "right")
            count = high - low
            if not count.sum():
                continue
            place = np.repeat(at, count)
            hit = item[np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
            for length in np.unique(self.length[hit]).tolist():
                mine = self.length[hit] == length
                self._of_length(words, s, length, h, place[mine], hit[mine], least, found)
        return [(self.ids[k], sim, start, n) for k, (sim, start, n) in sorted(found.items())]

    def _of_length(self, words: list[bytes], s: int, length: int, h: np.ndarray, place: np.ndarray, hit: np.ndarray, least: float, found: dict) -> None:
        n = min(length, len(words)) - s + 1
        cover = np.zeros(len(h) + 1, np.int64)
        np.add.at(cover, np.maximum(0, place - n + 1), 1)
        np.add.at(cover, np.minimum(place, len(h) - n) + 1, -1)
        starts = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
        items = set(hit.tolist())
        twice = _repeats(h, n)[starts]
        if twice.any() or any(self.repeats[k] for k in items):
            order = np.argsort(hit, kind="stable")
            each, first = np.unique(hit[order], return_index=True)
            for k, at in zip(each.tolist(), np.split(place[order], first[1:]), strict=True):
                self._counted(words, s, h, n, at, starts if self.repeats[k] else starts[twice], k, least, found)
        starts = starts[~twice]
        items = {k for k in items if not self.repeats[k]}
        if not items or not len(starts):
            return
        prints = _prints(h, starts, n)
        table = self.tables[length]
        for start, row in zip(starts.tolist(), prints, strict=True):
            near = items.intersection(chain.from_iterable(table[b].get(v, ()) for b, v in enumerate(row.tolist())))
            for k in near:
                if int(np.bitwise_count(self.prints[k] ^ row).sum()) > RADIUS:
                    continue
                sim = _similarity(Counter(_shingles(words[start:start + n + s - 1], s)), self.counts[k])
                if sim >= least and (k not in found or (sim, -start) > (found[k][0], -found[k][1])):
                    found[k] = sim, start, n + s - 1

    def _counted(self, words: list[bytes], s: int, h: np.ndarray, n: int, place: np.ndarray, starts: np.ndarray, k: int, least: float, found: dict) -> None:
        """Item ``k`` in the windows at ``starts`` by counts of common shingles; ``place`` says where its shingles are."""
        total = int(self.length[k]) - s + 1 + n
        place = np.sort(place)
        need = least / (1 + least) * total - 1e-6
        starts = starts[np.searchsorted(place, starts + n) - np.searchsorted(place, starts) >= need]
        if not len(starts):
            return
        both = np.zeros(len(starts), np.int64)
        own = dict(zip(*(x.tolist() for x in np.unique(_hashes(self.words[k], s), return_counts=True)), strict=True))
        order = np.argsort(h[place], kind="stable")
        values, first = np.unique(h[place][order], return_index=True)
        for value, at in zip(values.tolist(), np.split(place[order], first[1:]), strict=True):
            both += np.minimum(np.searchsorted(at, starts + n) - np.searchsorted(at, starts), own[value])
        start = int(starts[np.argmax(both)])
        sim = _similarity(Counter(_shingles(words[start:start + n + s - 1], s)), self.counts[k])
        if sim >= least and (k not in found or sim > found[k][0]):
            found[k] = sim, start, n + s - 1


def _repeats(h: np.ndarray, n: int) -> np.ndarray:
    """For each place: does the run of ``n`` hashes that starts here hold one twice?"""
    order = np.argsort(h, kind="stable")
    same = np.flatnonzero(h[order][1:] == h[order][:-1])
    following = np.full(len(h), len(h) + n, np.int64)
    following[order[same]] = order[same + 1]
    return np.minimum.accumulate(following[::-1])[::-1] < np.arange(len(h)) + n


def _shingles(words: list[bytes], size: int) -> list[tuple]:
    return [tuple(words[k:k + size]) for k in range(len(words) - size + 1)] if words else []


def _similarity(a: Counter, b: Counter) -> float:
    both = sum(min(n, b[x]) for x, n in a.items())
    either = sum(a.values()) + sum(b.values()) - both
    return both / either if either else 0.0


def blocks_of(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", block_chars: int = 16_000_000) -> list[DataFrame]:
    """The items in blocks of about ``block_chars`` characters."""
    rows = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(text).alias("t")).where("t is not null")
    total = rows.agg(F.sum(F.length("t") + 16).alias("n")).first()["n"] or 0
    n = -(-int(total) // block_chars)
    part = F.pmod(F.xxhash64("i", "t"), F.lit(max(n, 1)))
    return [rows.where(part == k) for k in range(n)]


def matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", least: float = 0.8, block_chars: int = 16_000_000) -> Column:
    """Array column of struct(item_id, similarity, start, words): the items found in each text of ``docs``."""
    found = []
    for block in blocks_of(benchmark, item_id, item_text, block_chars):
        items = [(r.i, r.t) for r in block.orderBy("i", "t").collect()]
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def make(shared=shared):
            index = Index(shared.value)
            return lambda texts: [([dict(zip(("item_id", "similarity", "start", "words"), m, strict=True)) for m in index.matches(t, least)],) for t in texts]

        found.append(text_udf(make, "m array<struct<item_id:long,similarity:double,start:int,words:int>>")(F.col(text))["m"])
    return F.concat(*found) if found else F.expr("cast(array() as array<struct<item_id:bigint,similarity:double,start:int,words:int>>)")


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """(doc_id, item_id, similarity, start, words): one row for each document and item found in it."""
    found = docs.select(F.col(key).alias("doc_id"), matches(docs, benchmark, **options).alias("m"))
    return found.select("doc_id", F.explode("m").alias("m")).select("doc_id", "m.item_id", "m.similarity", "m.start", "m.words")


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` in which no item is found."""
    rows = docs.select(F.struct(*others(docs, ())).alias("row"), F.size(matches(docs, benchmark, **options)).alias("n"))
    return rows.where("n = 0").select(*[F.col("row")[c].alias(c) for c in docs.columns])

"""Toxicity by compression distance: a zstandard dictionary of toxic text against one of ordinary text.

A window is one word with a space on either side; a word of more than
``2 * PIECE`` bytes, as in scripts without spaces, is cut into overlapping pieces
of ``PIECE`` bytes. A window is compressed with either dictionary together with
``FRAME``, a run that both hold: a few bytes alone never pay for the header of a
compressed block, so words of up to six letters would look alike. Its plain
length and the two compressed lengths make a cell, and
the calibrated evidence of a cell is the log of its share among windows of toxic
documents over that among ordinary ones. The evidence of a document's windows
(all of its text) gives a few sums, means and maxima, which a logistic curve fitted to the
training rows turns into a score; 0.5 is its threshold.

Training text of the toxic dictionary: the windows of toxic documents that hold a
byte run (5, 6, 8 or 10 bytes) which is at least ``exp(CONTRAST)`` times as
frequent, by documents, as in ordinary ones, where chance explains that with a
log-likelihood ratio below ``SURPRISE`` only. No share of all toxic documents is
asked for, so words of a rare language count too. Each such window stands once
in the toxic dictionary, those of most documents last (the zstandard trainer stops
at repeats of frequent words and would leave rare ones out: README has the recall
of dictionaries trained on windows of several words). Its size is bounded by the
sample, nothing is cut off it. A dictionary trained
on ordinary documents is the ordinary one; the toxic one holds it as well, so
that the two lengths differ by toxic text alone. Training reads a bounded sample of labelled rows: at most
about ``max_rows`` of each class, chosen by a hash of the id, and about
``max_chars`` characters of each class. Everything is scored.

Defined results: a text without words (null, empty, punctuation) gets the score
of a document without evidence; if a class has no training row every score is
the share of toxic rows (0 without any); several labels of one id count as
toxic if one does; null labels and ids are not learned from; repeated rows get
equal scores. Input columns named like an output column are replaced.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_udf, with_struct, words_of

RUNS = (5, 6, 8, 10)
RUN_BITS = 22
CONTRAST = 2.5
SURPRISE = 8.0
DICTIONARY = 32768
LEVEL = 12
PIECE = 24
CELLS = 64
#: Control characters: no word holds them.
FRAME = bytes(range(1, 32))
SMOOTH = 20.0
MEMO = 500_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _runs(text: bytes) -> np.ndarray:
    """Hashed places of all byte runs of a text."""
    points = np.frombuffer(text, np.uint8).astype(np.uint64)
    found = [np.zeros(0, np.int64)]
    for n in RUNS:
        if len(points) >= n:
            h = np.full(len(points) - n + 1, n, np.uint64)
            for k in range(n):
                h = (h ^ points[k:len(h) + k]) * _MIX
                h ^= h >> np.uint64(31)
            found.append((h >> np.uint64(64 - RUN_BITS)).astype(np.int64))
    return np.concatenate(found)


def _windows(text: str | None) -> list[bytes]:
    out = []
    for w in words_of(text):
        out += [b" " + w + b" "] if len(w) <= 2 * PIECE else [b" " + w[k:k + PIECE] + b" " for k in range(0, len(w) - PIECE // 2, PIECE // 2)]
    return out


def _dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; too few samples to train on stand for themselves."""
    try:
        return zstandard.train_dictionary(DICTIONARY, samples, k=32, d=6).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY:]


@dataclass
class ToxicModel:
    toxic: bytes = b""
    ordinary: bytes = b""
    evidence: np.ndarray = field(default_factory=lambda: np.zeros(CELLS**3, np.float32))
    mean: np.ndarray = field(default_factory=lambda: np.zeros(8))
    scale: np.ndarray = field(default_factory=lambda: np.ones(8))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(9))
    share: float | None = None

    def open(self) -> Scorer:
        return Scorer(self)


class Scorer:
    """Compressors and the evidence of windows met so far (at most ``MEMO`` of them)."""

    def __init__(self, model: ToxicModel):
        self.model = model
        self.known: dict[bytes, int] = {}
        self.pair = []
        for held in (model.ordinary + FRAME, model.ordinary + model.toxic + FRAME):
            options = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=2 * CELLS, dict_size=len(held), format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0)
            content = zstandard.ZstdCompressionDict(held, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.pair.append(zstandard.ZstdCompressor(dict_data=content, compression_params=options).compress)

    def cells(self, text: str | None) -> np.ndarray:
        windows = _windows(text)
        if len(self.known) > MEMO:
            self.known.clear()
        known, (plain, toxic) = self.known, self.pair
        for w in windows:
            if w not in known:
                known[w] = (min(CELLS - 1, len(w)) * CELLS + min(CELLS - 1, len(plain(w + FRAME)))) * CELLS + min(CELLS - 1, len(toxic(w + FRAME)))
        return np.fromiter(map(known.__getitem__, windows), np.int64, len(windows))

    def features(self, cells: np.ndarray) -> np.ndarray:
        e = self.model.evidence[cells].astype(float)
        n, strong = max(1, len(e)), float((e > 1.5).sum())
        top = np.sort(np.partition(e, -3)[-3:] if len(e) > 3 else e)[::-1]
        return np.array([e.sum(), e.sum() / n**0.5, e.sum() / n, top[:1].sum(), top.sum(), strong / n, np.log1p(strong), np.log(n)])

    def score(self, text: str | None) -> float:
        m = self.model
        if m.share is not None:
            return m.share
        x = (self.features(self.cells(text)) - m.mean) / m.scale
        return float(1 / (1 + np.exp(-np.clip(m.weights[0] + x @ m.weights[1:], -40, 40))))


def fit(texts: list[str], labels: list[int], odds: float | None = None) -> ToxicModel:
    """A model of labelled texts; ``odds`` of toxic to ordinary rows where the sample was drawn (the sample's own if None)."""
    y = np.array(labels, int)
    n = np.array([(y == 0).sum(), (y == 1).sum()])
    if not n.all():
        return ToxicModel(share=float(y.mean()) if len(y) else 0.0)
    seen = np.zeros((2, 1 << RUN_BITS), np.int32)
    for text, label in zip(texts, labels, strict=True):
        seen[label][np.unique(_runs(b" " + b" ".join(words_of(text)) + b" "))] += 1
    contrast = np.log((seen[1] + 0.5) / (n[1] + 1)) - np.log((seen[0] + 0.5) / (n[0] + 1))
    both = np.maximum(seen.sum(axis=0), 1)
    surprise = sum(seen[k] * np.log(np.maximum(seen[k], 1) / (both * n[k] / n.sum())) for k in (0, 1))
    marks = (contrast >= CONTRAST) & (surprise >= SURPRISE)
    marked: dict[bytes, bool] = {}
    toxic, ordinary = Counter(), []
    for text, label in zip(texts, labels, strict=True):
        windows = _windows(text)
        for w in dict.fromkeys(windows) if label else ():
            if w not in marked:
                marked[w] = bool(marks[_runs(w)].any())
            toxic[w] += marked[w]
        ordinary.append(b"" if label else b"".join(windows))
    ranked = sorted((w for w, c in toxic.items() if c), key=lambda w: (toxic[w], w))
    model = ToxicModel(b"".join(ranked), _dictionary([s[k:k + 4096] for s in ordinary if s for k in range(0, len(s), 4096)]))
    scorer = model.open()
    cells = [scorer.cells(t) for t in texts]
    count = np.zeros((2, CELLS**3))
    for c, label in zip(cells, labels, strict=True):
        np.add.at(count[label], c, 1)
    base = count.sum(axis=0) / max(1, count.sum())
    share = (count + SMOOTH * base) / (count.sum(axis=1, keepdims=True) + SMOOTH)
    model.evidence = np.where(base > 0, np.log(np.maximum(share[1], 1e-12) / np.maximum(share[0], 1e-12)), 0).astype(np.float32)
    x = np.array([scorer.features(c) for c in cells])
    spread = x.std(axis=0)
    model.mean, model.scale = x.mean(axis=0), np.where(spread > 1e-6, spread, 1.0)
    a = np.c_[np.ones(len(x)), (x - model.mean) / model.scale]
    weights = np.zeros(a.shape[1])
    for _ in range(30):  # Newton steps of ridge-penalised logistic regression
        p = 1 / (1 + np.exp(-np.clip(a @ weights, -40, 40)))
        weights += np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.eye(len(weights)), a.T @ (y - p) - weights)
    weights[0] += np.log(odds * n[0] / n[1]) if odds else 0.0  # classes are sampled at different rates
    model.weights = weights
    return model


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", max_rows: int = 3000, max_chars: int = 8_000_000) -> ToxicModel:
    """Fit on a bounded sample of the rows of ``labels`` and their texts."""
    marked = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg((F.max(label) > 0).cast("int").alias("y"))
    n = {r.y: r.n for r in marked.groupBy("y").agg(F.count("*").alias("n")).collect()}
    part = F.pmod(F.xxhash64(F.col("k").cast("string")), F.lit(1 << 20))
    share = F.create_map(*[F.lit(v) for y, c in n.items() for v in (y, min(1.0, max_rows / c))]) if n else None
    if share is None:
        return fit([], [])
    chosen = marked.where(part < share[F.col("y")] * (1 << 20))  # about max_rows of each class: bounded, so broadcast
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where("t is not null").join(F.broadcast(chosen), "k").groupBy("k", "y").agg(F.min("t").alias("t"))
    sizes = {r.y: r.c for r in rows.groupBy("y").agg(F.sum(F.length("t")).alias("c")).collect()} if max_chars else {}
    cut = F.create_map(*[F.lit(v) for y, c in sizes.items() for v in (y, min(1.0, max_chars / max(1, c)))]) if sizes else None
    if cut is None:
        return fit([], [])
    other = F.pmod(F.xxhash64(F.concat(F.lit("c"), F.col("k").cast("string"))), F.lit(1 << 20))
    found = rows.where(other < cut[F.col("y")] * (1 << 20)).orderBy("k").toArrow()
    return fit(found.column("t").to_pylist(), found.column("y").to_pylist(), n[1] / n[0] if n.get(0) and n.get(1) else None)


def predict(docs: DataFrame, model: ToxicModel, text: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 if the score is 0.5 or more)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = shared.value.open()

        def score(texts: list) -> list[tuple]:
            scores = [scorer.score(t) for t in texts]
            return [(s, int(s >= 0.5)) for s in scores]

        return score

    return with_struct(docs, text_udf(make, "score double, predicted int")(F.col(text)), ("score", "predicted"))

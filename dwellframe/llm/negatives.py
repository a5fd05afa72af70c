"""Hard negatives by a vertical scan (BOND: branch and bound on decomposed data).

Rows are rounded to integers, ``floor(scale * x)``, and written as blocks of
columns: one run of values for each dimension, with its least and greatest
value. For an anchor, a block is read dimension by dimension in descending order
of the anchor's magnitudes. After every ``STEP`` dimensions a row's score lies
between its partial sum plus the least and plus the greatest that the remaining
dimensions can add (block minimum and maximum times the anchor's component). Rows
that can no longer be in the answer leave the candidate bitmap; those that stay
to the end have exact scores. Nothing is approximate.

Two scans of the blocks for each bounded block of anchors: the first finds every
anchor's ``positives`` best rows of its own label; their scores are the upper
edges of windows ``low * p <= 100 * n <= high * p``, and the second finds the
best ``negatives`` rows of other labels within each window. A task sends at most
that many rows for an anchor and window, and Spark merges them. Anchors are
dealt into blocks of about ``anchor_block`` rows by their hash; one block (at most a
few megabytes) is sent to the tasks at a time and its result is written before
the next is read, so neither driver nor task ever holds more than one.

Defined results: rows without an id, a label or a vector, or with a null or
non-finite component take no part; a shorter vector counts as if zeros followed;
an empty vector scores 0; ties go to the smaller id; repeated rows are rows of
their own, but rows with the anchor's id are never its positives; equal anchor
rows count once; an empty table, or one without anchors, gives no rows; other
columns are ignored. Ids and labels are integers; a score has to fit a long.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import shared_path, stored

STEP = 16
BLOCK_ROWS = 4096
BLOCKS = "n int, dims int, width int, ids binary, labels binary, cells binary, least array<long>, most array<long>"
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
#: Sums below this are exact in doubles; beyond it Python's integers are used.
EXACT = 1 << 53


def whole_rows(rows: DataFrame, ident: Column, vector: Column, label: Column, scale: int) -> DataFrame:
    """(id, label, q) of the rows that take part; q holds floor(scale * x)."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    taken = rows.select(ident.cast("long").alias("id"), label.cast("long").alias("label"), vector.alias("v"), fine.alias("fine")).where("id is not null and label is not null and fine")
    return taken.select("id", "label", F.transform("v", lambda x: F.floor(x.cast("double") * scale)).alias("q"))


def _matrix(lists: pa.ListArray, dims: int) -> np.ndarray:
    """Rows of a list column as an int64 matrix; short rows end in zeros."""
    offsets = lists.offsets.to_numpy()
    flat = lists.values.to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), dims), np.int64)
    out[np.arange(dims)[None, :] < sizes[:, None]] = flat[offsets[0]:offsets[-1]]
    return out


def _block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, label, q) as blocks of columns, sorted by label within a block."""
    for batch in batches:
        for k in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(k, BLOCK_ROWS)
            ids, labels = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (0, 1))
            vectors = pa.array(part.column(2))
            dims = int(np.diff(vectors.offsets.to_numpy()).max())
            cells = _matrix(vectors, dims)
            order = np.argsort(labels, kind="stable")
            cells = np.ascontiguousarray(cells[order].T)
            least, most = (cells.min(axis=1), cells.max(axis=1)) if dims else (np.zeros(0, np.int64),) * 2
            bound = max([0, *np.abs(np.concatenate([least, most])).tolist()])
            width = next(w for w in (2, 4, 8) if bound < 1 << (8 * w - 1))
            yield pa.RecordBatch.from_pydict({
                "n": pa.array([len(ids)], pa.int32()), "dims": pa.array([dims], pa.int32()), "width": pa.array([width], pa.int32()),
                "ids": pa.array([ids[order].tobytes()], pa.binary()), "labels": pa.array([labels[order].tobytes()], pa.binary()),
                "cells": pa.array([cells.astype(f"<i{width}").tobytes()], pa.binary()),
                "least": pa.array([least.tolist()], pa.list_(pa.int64())), "most": pa.array([most.tolist()], pa.list_(pa.int64()))})


@dataclass
class Block:
    """Columns of a block as numbers in which every score of an anchor block is exact."""

    ids: np.ndarray
    labels: np.ndarray
    cells: np.ndarray
    least: np.ndarray
    most: np.ndarray

    @classmethod
    def of(cls, row: dict, magnitude: int) -> Block:
        """``magnitude``: the largest sum of absolute components of an anchor."""
        least, most = np.array(row["least"], np.int64), np.array(row["most"], np.int64)
        bound = max([0, *map(abs, row["least"]), *map(abs, row["most"])]) * magnitude
        kind = np.float64 if bound < EXACT else object
        cells = np.frombuffer(row["cells"], f"<i{row['width']}").reshape(row["dims"], row["n"]).astype(np.int64).astype(kind)
        return cls(np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64), cells, least.astype(kind), most.astype(kind))


def scan(block: Block, anchor: np.ndarray, first: int, last: int, keep) -> tuple[np.ndarray, np.ndarray]:
    """Places and exact scores of the rows first to last that ``keep`` lets through.

    ``keep(low, high, at)`` gets bounds of the scores of the rows at places ``at`` and says which stay candidates.
    """
    dims = min(len(anchor), len(block.cells))
    order = np.argsort(-np.abs(anchor[:dims]), kind="stable")
    a = anchor[:dims].astype(block.cells.dtype)[order]
    ends = np.stack([a * block.least[order], a * block.most[order]]) if dims else np.zeros((2, 0), block.cells.dtype)
    add_low, add_high = (np.append(np.cumsum(x[::-1])[::-1], 0) for x in (ends.min(axis=0), ends.max(axis=0))) if dims else (np.zeros(1),) * 2
    at, total = np.arange(first, last), np.zeros(last - first, block.cells.dtype)
    k, whole = 0, True
    while True:
        stay = keep(total + add_low[k], total + add_high[k], at)
        if not stay.all():
            at, total, whole = at[stay], total[stay], False
        if k == dims or not len(at):
            return at, total
        some = order[k:k + STEP]
        columns = block.cells[some, first:last] if whole else block.cells[np.ix_(some, at)]
        total = total + a[k:k + STEP] @ columns
        k = min(k + STEP, dims)


def _kth(values: np.ndarray, k: int):
    """The k-th largest value, None if there are fewer."""
    return None if len(values) < k else np.sort(values)[-k] if values.dtype == object else np.partition(values, len(values) - k)[len(values) - k]


def _best(found: list[tuple[int, int]], scores: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The k best (-score, id) of those found before and these."""
    if (least := _kth(scores, k)) is not None:
        some = scores >= least
        scores, ids = scores[some], ids[some]
        if len(ids) > k:
            some = np.lexsort((ids, -scores))[:k]
            scores, ids = scores[some], ids[some]
    return sorted([*found, *((-int(s), int(i)) for s, i in zip(scores, ids, strict=True))])[:k]


def _own_label(block: Block, label: int) -> tuple[int, int]:
    return int(np.searchsorted(block.labels, label, "left")), int(np.searchsorted(block.labels, label, "right"))


def positives_in(block: Block, ident: int, label: int, anchor: np.ndarray, k: int, found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The k best rows (-score, id) of the anchor's label, with those found in earlier blocks."""
    first, last = _own_label(block, label)
    floor = -found[-1][0] if len(found) == k else None

    def keep(low: np.ndarray, high: np.ndarray, at: np.ndarray) -> np.ndarray:
        other = block.ids[at] != ident
        least = [x for x in (floor, _kth(low[other], k)) if x is not None]
        return other & (high >= max(least)) if least else other

    at, scores = scan(block, anchor, first, last, keep)
    return _best(found, scores, block.ids[at], k)


def negatives_in(block: Block, label: int, anchor: np.ndarray, windows: list[tuple[int, int]], k: int, found: list[list[tuple[int, int]]]) -> list[list[tuple[int, int]]]:
    """For each window (least, greatest score): the k best rows (-score, id) of other labels in it, with those found before."""
    first, last = _own_label(block, label)
    floors = [max([lo, *([-f[-1][0]] if len(f) == k else [])]) for (lo, _), f in zip(windows, found, strict=True)]

    def keep(low: np.ndarray, high: np.ndarray, at: np.ndarray) -> np.ndarray:
        other = (at < first) | (at >= last)
        alive = np.zeros(len(at), bool)
        for (lo, hi), floor in zip(windows, floors, strict=True):
            sure = _kth(low[other & (low >= lo) & (high <= hi)], k)
            alive |= (high >= (floor if sure is None else max(floor, sure))) & (low <= hi)
        return other & alive

    at, scores = scan(block, anchor, 0, len(block.ids), keep)
    out = []
    for (lo, hi), f in zip(windows, found, strict=True):
        some = (scores >= lo) & (scores <= hi)
        out.append(_best(f, scores[some], block.ids[at][some], k))
    return out


def _rows(columns: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*columns, strict=True) if columns else [()] * len(names))], names=names)


def mine(rows: DataFrame, anchors: Column, ident: Column, vector: Column, label: Column, positives: int = 5, negatives: int = 5,
         low: int = 80, high: int = 100, scale: int = 256, anchor_block: int = 4096) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; ``anchors`` is a condition on the column ``id``."""
    spark = rows.sparkSession
    whole = whole_rows(rows, ident, vector, label, scale)
    blocks = stored(whole.mapInArrow(_block, BLOCKS), "columns")
    asked = stored(whole.where(anchors).distinct(), "anchors")
    n_blocks = -(-asked.count() // anchor_block)
    path = shared_path(spark, "negatives")
    spark.createDataFrame([], RESULT).write.parquet(f"{path}/block=-1")
    for number in range(n_blocks):
        mine_block(blocks, asked.where(F.pmod(F.xxhash64("id", "label", "q"), F.lit(n_blocks)) == number), positives, negatives, low, high).write.parquet(f"{path}/block={number}")
    return spark.read.schema(RESULT).parquet(path).select(*[part.split()[0] for part in RESULT.split(", ")])


def mine_block(blocks: DataFrame, asked: DataFrame, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """The answer for one bounded block of anchors (id, label, q)."""
    spark = blocks.sparkSession
    held = asked.orderBy("id", "label", "q").toArrow()
    ids, labels = held.column(0).to_pylist(), held.column(1).to_pylist()
    vectors = [np.array(q, np.int64) for q in held.column(2).to_pylist()]
    magnitude = max([0, *(sum(map(abs, v.tolist())) for v in vectors)])
    sent = spark.sparkContext.broadcast((ids, labels, vectors, magnitude))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield Block.of(batch.slice(k, 1).to_pylist()[0], sent.value[3])

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, vectors, _ = sent.value
        found: list[list] = [[] for _ in ids]
        for block in read(batches):
            for a, (ident, own, vector) in enumerate(zip(ids, labels, vectors, strict=True)):
                found[a] = positives_in(block, ident, own, vector, positives, found[a])
        yield _rows([(a, ids[a], i, -s) for a, f in enumerate(found) for s, i in f], ["a", "anchor_id", "positive_id", "positive_score"])

    near = stored(blocks.mapInArrow(nearest, "a long, anchor_id long, positive_id long, positive_score long")
                  .withColumn("place", F.row_number().over(W.partitionBy("a").orderBy(F.desc("positive_score"), "positive_id"))).where(F.col("place") <= positives), "positives")
    # At most ``positives`` rows for each anchor of the block.
    windows: list[list[int]] = [[] for _ in ids]
    for a, score in near.select("a", "positive_score").distinct().toLocalIterator():
        windows[a].append(score)
    edges = spark.sparkContext.broadcast([sorted((p, -(-low * p // 100), high * p // 100) for p in scores) for scores in windows])

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, labels, vectors, _ = sent.value
        found: list[list[list]] = [[[] for _ in w] for w in edges.value]
        for block in read(batches):
            for a, (own, vector) in enumerate(zip(labels, vectors, strict=True)):
                if edges.value[a]:
                    found[a] = negatives_in(block, own, vector, [w[1:] for w in edges.value[a]], negatives, found[a])
        yield _rows([(a, edges.value[a][w][0], i, -s) for a, f in enumerate(found) for w, best in enumerate(f) for s, i in best], ["b", "p", "negative_id", "negative_score"])

    # The number of an anchor within the block stands for it (several rows may share an id), a positive's score for its window.
    best = (blocks.mapInArrow(below, "b long, p long, negative_id long, negative_score long")
            .withColumn("rank", F.row_number().over(W.partitionBy("b", "p").orderBy(F.desc("negative_score"), "negative_id"))).where(F.col("rank") <= negatives))
    return (near.join(best, (F.col("a") == F.col("b")) & (F.col("positive_score") == F.col("p")))
            .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"))

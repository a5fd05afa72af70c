"""Histogram gradient boosting: bins once, then one aggregate a tree level.

* The training rows (features and target) are written once; every feature is
  binned by its quantiles to a byte code, with a code of its own for a missing
  value. Codes, target and predictions are the state: an RDD of numpy blocks, held
  and checkpointed, so that a level is one plain RDD job with nothing to plan.
* A tree grows level by level. For a level, each task adds up row counts and
  gradient sums by (tree, node, feature, bin) in numpy and Spark sums the tasks'
  tables; the driver gets one bounded table (nodes x features x bins) and picks
  the splits. Missing values go to the side that gains more.
* All heads of a fit (several quantiles, or mean and spread) share the state and
  the aggregates, so three quantiles cost the jobs of one.
* Where all tasks of a pass can run at the same time (:func:`together.slots`), many
  rounds are one barrier job: the tasks keep their rows and predictions in memory,
  add up their tables through the shared folder and pick the same splits. The
  state is checkpointed anew every ``TOGETHER_ROUNDS`` rounds.
* Elsewhere a level is a job. Predictions are brought up to date in the tasks from
  the trees since the state was checkpointed; it is checkpointed anew every ``every``
  rounds, so lineage stays short and a lost executor costs at most that many trees.
* Sums are of fixed-point numbers, so with given bin edges a fit does not depend on
  partitions or order; edges that are not given come from a quantile sketch.

Fitted trees are one node table (:class:`TreeTable`), scored in one vectorised
pass however many there are, and stored as a table.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from . import together as T

#: Codes below the number of bins are bins, that number stands for a missing value (a signed byte holds both).
MAX_BINS = 126
#: Gradients are summed in units of 1/FIXED of the target's standard deviation.
FIXED = 1 << 20
#: Residual bins of a leaf: logarithmic on both sides of zero.
RESIDUAL_BINS, NEAR, FAR = 1024, 0.003, 1e4
STEPS = (0.5, 1.0, 2.0, 4.0, 8.0)
#: Fewer rows than this are not worth a task of their own, more than this are not left to one while there are others.
ROWS_A_TASK, MOST_ROWS_A_TASK = 16_000, 1_000_000
#: Rounds of a barrier job: a failure costs so many at most. Its tasks are worth as many times ROWS_A_TASK rows each.
TOGETHER_ROUNDS, TOGETHER_ROWS = 100, 4
#: Edges of so many rows and more come from sketches of so many values a column, made in numpy.
SKETCH_ROWS, SKETCH = 200_000, 4096


# ------------------------------------------------------------------ tree table
NODES = "tree int, output int, node int, feature int, left int, right int, threshold double, default_left boolean, value double"


@dataclass
class TreeTable:
    """Trees of one or more outputs as flat node arrays; a leaf has no children (-1).

    ``x < threshold`` goes left, a missing value where ``default_left`` says.
    """

    features: list[str]
    output: np.ndarray
    root: np.ndarray
    feature: np.ndarray
    left: np.ndarray
    right: np.ndarray
    threshold: np.ndarray
    default_left: np.ndarray
    value: np.ndarray

    @classmethod
    def of(cls, features: Sequence[str], trees: Sequence[tuple[int, list[tuple]]]) -> TreeTable:
        """From (output, nodes) pairs; a node is (feature, left, right, threshold, default_left, value), children numbered within the tree."""
        output, root, flat = [], [], []
        for out, nodes in trees:
            base = len(flat)
            output.append(out)
            root.append(base)
            flat += [(f, lo + base if lo >= 0 else -1, hi + base if hi >= 0 else -1, t, d, v) for f, lo, hi, t, d, v in nodes]
        columns = list(zip(*flat, strict=True)) if flat else [()] * 6
        kinds = (np.int64, np.int64, np.int64, float, bool, float)
        return cls(list(features), np.array(output, np.int64), np.array(root, np.int64), *(np.array(c, k) for c, k in zip(columns, kinds, strict=True)))

    def rows(self) -> list[tuple]:
        """Rows of ``NODES``; children are numbered within their tree."""
        starts, out = [*self.root.tolist(), len(self.value)], []
        for t, (a, b) in enumerate(zip(starts, starts[1:], strict=False)):
            for i in range(a, b):
                lo, hi = (int(x[i]) - a if x[i] >= 0 else -1 for x in (self.left, self.right))
                out.append((t, int(self.output[t]), i - a, int(self.feature[i]), lo, hi, float(self.threshold[i]), bool(self.default_left[i]), float(self.value[i])))
        return out

    @classmethod
    def from_rows(cls, features: Sequence[str], rows: Sequence) -> TreeTable:
        trees: dict[int, tuple[int, list[tuple]]] = {}
        for tree, out, _, *node in sorted(map(tuple, rows), key=lambda r: (r[0], r[2])):
            trees.setdefault(tree, (out, []))[1].append(tuple(node))
        return cls.of(features, [trees[t] for t in sorted(trees)])

    def sums(self, x: np.ndarray, outputs: int, rows: int = 1024, trees: int = 64) -> np.ndarray:
        """Sum of leaf values by output for the rows of a feature matrix (NaN: missing)."""
        out = np.zeros((len(x), outputs))
        inner = self.left >= 0
        # a leaf is its own child; a node's children and a row's features are looked up in flat arrays
        here = np.arange(len(inner))
        child = np.column_stack([np.where(inner, c, here) for c in (self.left, self.right)]).ravel()
        feature = np.where(inner, self.feature, 0)
        depth, at = 0, self.root
        while len(at := at[inner[at]]):
            at, depth = np.concatenate([self.left[at], self.right[at]]), depth + 1
        for a in range(0, len(x), rows):
            part = np.ascontiguousarray(x[a:a + rows])
            flat, some_lack = part.ravel(), bool(np.isnan(part).any())
            start = (np.arange(len(part)) * part.shape[1])[:, None]
            for k in range(0, len(self.root), trees):
                node = np.broadcast_to(self.root[k:k + trees], (len(part), len(self.root[k:k + trees])))
                for _ in range(depth):
                    value = flat[start + feature[node]]
                    goes_left = value < self.threshold[node]
                    if some_lack:
                        goes_left |= np.isnan(value) & self.default_left[node]
                    node = child[2 * node + ~goes_left]
                for o in range(outputs):
                    mine = self.output[k:k + trees] == o
                    out[a:a + rows, o] += self.value[node[:, mine]].sum(axis=1)
        return out

    def add_sums(self, df: DataFrame, names: Sequence[str]) -> DataFrame:
        """``df`` with one column of summed leaf values for each output: one Python pass for all trees."""
        if not len(self.root):
            return df.withColumns({n: F.lit(0.0) for n in names})
        sent = df.sparkSession.sparkContext.broadcast(self)
        features, outputs = self.features, len(names)

        @F.pandas_udf("array<double>")
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
            table = sent.value
            for pdf in batches:
                x = np.column_stack([pdf[str(i)].to_numpy(dtype="float64", na_value=np.nan) for i in range(len(features))])
                yield pd.Series(list(table.sums(x, outputs)))

        held = f"sums_{uuid.uuid4().hex}"
        scored = df.withColumn(held, run(F.struct(*[F.col(f"`{f}`").cast("double").alias(str(i)) for i, f in enumerate(features)])))
        return scored.withColumns({n: F.col(held)[i] for i, n in enumerate(names)}).drop(held)


# ----------------------------------------------------------------------- heads
@dataclass
class Quantile:
    """Pinball loss: gradient q - 1[z < F]; a leaf holds the q-quantile of its residuals."""

    q: float
    width: int = 1

    def gradients(self, z: np.ndarray, f: list[np.ndarray]) -> list[np.ndarray]:
        return [np.rint(FIXED * (self.q - (z < f[0]))).astype(np.int64)]


@dataclass
class Squared:
    """Squared error: gradient z - F; a leaf holds the mean residual, shrunk by ``l2`` rows.

    A head may have a depth and a rate of its own, and another rate for its first tree.
    """

    l2: float = 0.0
    width: int = 1
    depth: int | None = None
    rate: float | None = None
    first_rate: float | None = None

    def gradients(self, z: np.ndarray, f: list[np.ndarray]) -> list[np.ndarray]:
        return [np.rint(FIXED * (z - f[0])).astype(np.int64)]


@dataclass
class Normal:
    """Normal likelihood: natural gradients of mean and log standard deviation, one tree each; a common step by line search."""

    width: int = 2

    def gradients(self, z: np.ndarray, f: list[np.ndarray]) -> list[np.ndarray]:
        r = z - f[0]
        spread = (np.square(r / np.exp(f[1])) - 1) / 2
        return [np.rint(FIXED * np.clip(g, -1e6, 1e6)).astype(np.int64) for g in (r, spread)]

    @staticmethod
    def loss(z: np.ndarray, mu: np.ndarray, ls: np.ndarray) -> np.ndarray:
        return ls + 0.5 * np.square((z - mu) / np.exp(ls)) + 0.5 * math.log(2 * math.pi)


@dataclass
class _Tree:
    """A tree over codes, nodes numbered as in a heap from 1; feature -1: not split."""

    depth: int
    missing: int
    feature: np.ndarray = None
    upto: np.ndarray = None
    missing_left: np.ndarray = None
    value: np.ndarray = None

    def __post_init__(self):
        n = 2 << self.depth
        self.feature, self.upto = np.full(n, -1), np.zeros(n, np.int64)
        self.missing_left, self.value = np.zeros(n, bool), np.zeros(n)

    def nodes(self, codes: np.ndarray) -> np.ndarray:
        """Heap number of the node that each row ends in."""
        kind = np.int8 if self.depth < 6 else np.int32
        return np.broadcast_to(self._fold(codes, 1, kind), (codes.shape[1],))

    def values(self, codes: np.ndarray) -> np.ndarray:
        return self.value[self.nodes(codes)]

    def leaf_numbers(self) -> np.ndarray:
        """Number of each leaf among the leaves (0 for other nodes)."""
        inner = self.feature >= 0
        reached = np.zeros(len(self.value), bool)
        reached[1] = True
        for at in range(2, len(reached)):
            reached[at] = reached[at // 2] and inner[at // 2]
        leaves = reached & ~inner
        return np.where(leaves, np.cumsum(leaves) - 1, 0)

    def _fold(self, codes: np.ndarray, at: int, kind: type):
        """The rows' nodes below ``at``: whole columns are compared, node by node."""
        f = self.feature[at]
        if f < 0:
            return kind(at)
        left = codes[f] <= self.upto[at]
        if self.missing_left[at]:
            left |= codes[f] == self.missing
        return np.where(left, self._fold(codes, 2 * at, kind), self._fold(codes, 2 * at + 1, kind))

    def table_nodes(self, edges: list[list[float]], scale: float) -> list[tuple]:
        """Nodes for :class:`TreeTable`: a code up to b is a value below the next number after edge b."""
        out: list[tuple] = []

        def add(at: int) -> int:
            place = len(out)
            out.append(())
            f = int(self.feature[at])
            if f < 0:
                out[place] = (-1, -1, -1, 0.0, False, float(scale * self.value[at]))
            else:
                b = int(self.upto[at])
                cut = math.nextafter(edges[f][b], math.inf) if b < len(edges[f]) else math.inf
                lo = add(2 * at)
                out[place] = (f, lo, add(2 * at + 1), cut, bool(self.missing_left[at]), 0.0)
            return place

        add(1)
        return out


# ---------------------------------------------------------------------- engine
@dataclass
class _State:
    """The checkpointed state and the trees since (for each round: the trees of each head)."""

    blocks: RDD
    tasks: int
    p: int
    bins: int
    heads: list
    recent: list = field(default_factory=list)

    def summed(self, shape: tuple[int, ...], task, *sent) -> np.ndarray:
        return _summed(self, shape, task, *sent)


#: A block of rows on its way into the state: codes (features x rows, bytes), target and predictions (outputs x rows, doubles).
BLOCKS = "n int, codes binary, z binary, f binary"


def _arrays(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row["codes"], np.int8).reshape(-1, row["n"]), np.frombuffer(row["z"]), np.frombuffer(row["f"]).reshape(-1, row["n"])


def _up_to_date(codes: np.ndarray, f: np.ndarray, heads: list, recent: list) -> list[list[np.ndarray]]:
    """Predictions of every head, with the trees since the state was written."""
    flat = [x.copy() for x in f]
    for round_ in recent:
        for column, tree in zip(flat, (t for own in round_ for t in own), strict=True):
            column += tree.values(codes)
    at = iter(flat)
    return [[next(at) for _ in range(h.width)] for h in heads]


#: Tables of so many tasks are added up by the driver; those of more are summed in slices by Spark first.
DIRECT, SLICE_CELLS = 32, 1 << 18


def _summed(state: _State, shape: tuple[int, ...], task, *sent) -> np.ndarray:
    """The sum over all rows of the int64 tables that ``task(codes, z, f, *sent)`` gives for a block."""
    heads, recent = state.heads, state.recent
    size = int(np.prod(shape))
    direct = state.tasks <= DIRECT
    slices = 1 if direct else -(-size // SLICE_CELLS)

    def work(blocks: Iterator[tuple]) -> Iterator[tuple[int, np.ndarray]]:
        total = None
        for codes, z, f in blocks:
            table = task(codes, z, _up_to_date(codes, f, heads, recent), *sent)
            total = table if total is None else total + table
        if total is not None:
            yield from enumerate(np.array_split(total.reshape(-1), slices))

    tables = state.blocks.mapPartitions(work)
    if not direct:
        tables = tables.reduceByKey(np.add, slices)
    parts = np.array_split(np.zeros(size, np.int64), slices)
    for i, cells in tables.collect():
        parts[i] += cells
    return np.concatenate(parts).reshape(shape)


class _Here:
    """The state in the memory of one of the tasks that grow trees together."""

    def __init__(self, blocks: list[tuple], p: int, bins: int, heads: list, recent: list, exchange: T.Exchange):
        if blocks:
            self.codes, self.z, f = (np.concatenate(x, axis=-1) for x in zip(*blocks, strict=True))
        else:
            self.codes, self.z, f = np.zeros((0, 0), np.int8), np.zeros(0), np.zeros((sum(h.width for h in heads), 0))
        blocks.clear()
        self.f = list(f)
        self.p, self.bins, self.heads, self.exchange = p, bins, heads, exchange
        self.packed = T.Packed(self.codes)
        self.parts = [slice(a, a + T.ROWS) for a in range(0, len(self.z), T.ROWS)]
        for trees in recent:
            self.add(trees)

    def _own(self, part: slice) -> list[list[np.ndarray]]:
        at = iter(self.f)
        return [[next(at)[part] for _ in range(h.width)] for h in self.heads]

    def add(self, trees: list[list[_Tree]]) -> None:
        """The predictions with one more round."""
        for part in self.parts:
            codes = self.codes[:, part]
            for f, tree in zip(self.f, (t for own in trees for t in own), strict=True):
                f[part] += tree.values(codes)

    def summed(self, shape: tuple[int, ...], task, *sent) -> np.ndarray:
        total = np.zeros(shape, np.int64)
        for k, part in enumerate(self.parts):
            if task is _level:
                self._count(k, part, *sent, total)
            else:
                total += task(self.codes[:, part], self.z[part], self._own(part), *sent)
        return self.exchange.total(total)

    def _count(self, k: int, part: slice, heads: list, trees: list[list[_Tree]], level: int, total: np.ndarray) -> None:
        """Adds a part's table of :func:`_level`; the gradients of a round are kept for its levels."""
        if level == 0:
            own = [g for head, f in zip(heads, self._own(part), strict=True) for g in head.gradients(self.z[part], f)]
            self.both = ([] if k == 0 else self.both) + [[T.Both(None, g.astype(float)) for g in own]]
        codes, columns = self.codes[:, part], [x[part] for x in self.packed.columns]
        n_nodes = 1 << level
        for t, tree in enumerate(tree for own in trees for tree in own):
            both = self.both[k][t]
            node = tree.nodes(codes).astype(np.int64) - n_nodes
            some = node >= 0  # rows of leaves above this level wait there
            parts = both.parts
            if not some.all():
                node, parts = np.where(some, node, 0), both.masked(some)
            sums = []
            for x in parts:
                sums.append(np.zeros((n_nodes, self.p * (self.bins + 1))))
                self.packed.counted(columns, node, x, range(0, sums[-1].shape[1], self.bins + 1), sums[-1])
            for i, x in enumerate(both.apart(sums)):
                total[t, ..., i] += x.reshape(total.shape[1:4])


class Tally:
    """Sums of whole numbers w >= 0 and g by cell. Both are added up as one number, w in the units above the
    largest sum of g, where doubles hold that exactly (below 2**53), else each by itself (a block's sums stay below it)."""

    def __init__(self, w: np.ndarray, g: np.ndarray):
        self.w, self.g = w, g
        self.unit = 2.0 ** (math.frexp(float(np.abs(g).sum()))[1] + 1)
        self.both = w * self.unit + g if (float(w.sum()) + 1) * self.unit < 2.0 ** 53 else None

    def __call__(self, cell: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        if self.both is None:
            return tuple(np.bincount(cell, weights=x, minlength=size).astype(np.int64) for x in (self.w, self.g))
        total = np.bincount(cell, weights=self.both, minlength=size)
        n = np.rint(total / self.unit)
        return n.astype(np.int64), (total - n * self.unit).astype(np.int64)


def _level(codes, z, f, heads, trees, level):
    """Counts and gradient sums by (tree, node of the level, feature, code)."""
    n_nodes, width = 1 << level, trees[0][0].missing + 1
    out = np.zeros((sum(h.width for h in heads), n_nodes, len(codes), width, 2), np.int64)
    t = 0
    for head, own, grown in zip(heads, f, trees, strict=True):
        for g, tree in zip(head.gradients(z, own), grown, strict=True):
            node = tree.nodes(codes).astype(np.int64) - n_nodes
            some = node >= 0  # rows of leaves above this level wait there
            everyone = bool(some.all())
            base = width * (node if everyone else node[some])
            tally = Tally(np.ones(len(base)), (g if everyone else g[some]).astype(float))
            for j, code in enumerate(codes):
                cell = base + (code if everyone else code[some])
                for k, x in enumerate(tally(cell, n_nodes * width)):
                    out[t, :, j, :, k] = x.reshape(n_nodes, -1)
            t += 1
    return out


def _residual_bin(r: np.ndarray) -> np.ndarray:
    """Bin of a residual in standard deviations: logarithmic from NEAR on, up to FAR."""
    half = RESIDUAL_BINS // 2
    t = np.sign(r) * np.log1p(np.abs(r) / NEAR) * (half - 1) / math.log1p(FAR / NEAR)
    return (np.clip(np.rint(t), 1 - half, half - 1) + half).astype(np.int64)


def _leaf_residuals(codes, z, f, heads, trees):
    """Rows by (quantile head, leaf, residual bin), and the sum of their residuals."""
    pairs = [(own[0], grown[0]) for head, own, grown in zip(heads, f, trees, strict=True) if isinstance(head, Quantile)]
    out = np.zeros((len(pairs), 1 << pairs[0][1].depth, RESIDUAL_BINS, 2), np.int64)
    for k, (own, tree) in enumerate(pairs):
        r = z - own
        cell = tree.leaf_numbers()[tree.nodes(codes)] * RESIDUAL_BINS + _residual_bin(r)
        for i, x in enumerate(Tally(np.ones(len(r)), np.rint(FIXED * np.clip(r, -1e6, 1e6)))(cell, out[k, :, :, 0].size)):
            out[k, :, :, i] += x.reshape(out.shape[1:3])
    return out


def _step_losses(codes, z, f, heads, trees):
    """Sum of losses of every head at each candidate step."""
    out = np.zeros((len(heads), len(STEPS), 1), np.int64)
    for k, (head, own, grown) in enumerate(zip(heads, f, trees, strict=True)):
        if not isinstance(head, Normal):
            continue
        moves = [t.values(codes) for t in grown]
        for s, step in enumerate(STEPS):
            loss = head.loss(z, *[c + step * m for c, m in zip(own, moves, strict=True)])
            out[k, s, 0] = int(np.rint(FIXED * np.clip(loss, -1e6, 1e6)).sum())
    return out


def _split(table: np.ndarray, tree: _Tree, level: int, min_rows: int, l2: float, edges: list[list[float]]) -> bool:
    """Split the nodes of a level by the best gain; says whether any was split."""
    any_split = False
    for node in range(1 << level):
        n, g = table[node, :, :, 0].astype(float), table[node, :, :, 1] / FIXED
        total_n, total_g = n[0].sum(), g[0].sum()
        at = (1 << level) + node
        if level and tree.feature[at // 2] < 0 or total_n < 2 * min_rows:
            continue
        left_n, left_g = np.cumsum(n[:, :tree.missing], axis=1), np.cumsum(g[:, :tree.missing], axis=1)
        best = (1e-9 * max(1.0, total_n), None)
        for missing_left in (True, False):
            ln = left_n + (n[:, tree.missing:] if missing_left else 0)
            lg = left_g + (g[:, tree.missing:] if missing_left else 0)
            rn, rg = total_n - ln, total_g - lg
            fine = (ln >= min_rows) & (rn >= min_rows) & (ln > 0) & (rn > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(fine, lg ** 2 / (ln + l2) + rg ** 2 / (rn + l2) - total_g ** 2 / (total_n + l2), -np.inf)
            place = int(np.argmax(gain))
            if gain.flat[place] > best[0]:
                best = (gain.flat[place], (*divmod(place, tree.missing), missing_left))
        if best[1]:
            tree.feature[at], tree.upto[at], tree.missing_left[at] = best[1]
            any_split = True
    return any_split


def _means(tables: list[np.ndarray], tree: _Tree, l2: float) -> None:
    """Leaf values: mean gradient, from the tables of the levels on which the tree grew."""
    stats = {1: (tables[0][0, 0, :, 0].sum(), tables[0][0, 0, :, 1].sum() / FIXED)}
    for level, table in enumerate(tables):
        for node in range(1 << level):
            at = (1 << level) + node
            f = tree.feature[at]
            if f < 0:
                continue
            n, g = table[node, f, :, 0], table[node, f, :, 1] / FIXED
            left = np.arange(tree.missing + 1) <= tree.upto[at]
            left[tree.missing] = tree.missing_left[at]
            stats[2 * at], stats[2 * at + 1] = (n[left].sum(), g[left].sum()), (n[~left].sum(), g[~left].sum())
    for at, (n, g) in stats.items():
        if tree.feature[at] < 0 and n:
            tree.value[at] = g / (n + l2)


def _quantile_of_bins(table: np.ndarray, q: float) -> float:
    """The q-quantile of binned residuals: the mean residual of the bin that holds it."""
    counts = table[:, 0]
    total = counts.sum()
    if not total:
        return 0.0
    b = int(np.searchsorted(np.cumsum(counts), max(1, math.ceil(q * total))))
    return float(table[b, 1] / FIXED / counts[b])


@dataclass
class Fitted:
    """What a fit gives: first predictions of the heads (in units of the target) and their trees."""

    starts: list[list[float]]
    tables: list[TreeTable]
    rows: int
    center: float
    scale: float


def fit(df: DataFrame, features: Sequence[str], target: str, heads: list, rounds: int, depth: int, rate: float,
        min_rows: int = 1, bins: int = 64, every: int = 10, edges: list[list[float]] | None = None) -> Fitted:
    """Boost all heads on the rows of ``df`` with a target (features may be missing)."""
    spark = df.sparkSession
    root = scratch(spark, "boosting")
    y = F.col(f"`{target}`").cast("double")
    plain = df.where(y.isNotNull() & ~F.isnan(y)).select(*[F.col(f"`{f}`").cast("double").alias(f"x{i}") for i, f in enumerate(features)], y.alias("y"))
    plain.write.parquet(f"{root}/rows")  # the only read of the source
    plain = spark.read.schema(plain.schema).parquet(f"{root}/rows")
    return fit_rows(plain, features, heads, rounds, depth, rate, min_rows, bins, every, edges, target)


def fit_rows(plain: DataFrame, features: Sequence[str], heads: list, rounds: int, depth: int, rate: float, min_rows: int = 1, bins: int = 64,
             every: int = 10, edges: list[list[float]] | None = None, target: str = "y") -> Fitted:
    """Boost all heads on stored rows x0, x1, ..., y."""
    p, bins = len(features), min(bins, MAX_BINS)
    stats = plain.agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("m"), F.stddev_pop("y").alias("s")).first()
    n, center, scale = stats["n"], stats["m"] or 0.0, stats["s"] if stats["s"] and stats["s"] > 0 else 1.0
    if not n:
        raise ValueError(f"no row has a value of {target}")
    edges = quantile_edges(plain, [f"x{i}" for i in range(p)], bins, edges, n)
    quantiles = [h.q for h in heads if isinstance(h, Quantile)]
    levels = plain.agg(F.percentile_approx("y", quantiles, 100_000).alias("q")).first()["q"] if quantiles else []
    starts = []
    for h in heads:
        starts.append([(levels[quantiles.index(h.q)] - center) / scale] if isinstance(h, Quantile) else [0.0] * h.width)
    flat = [v for own in starts for v in own]
    together = _together(plain.sparkSession, n, n * (3 * p + 32 * len(flat)), TOGETHER_ROWS * ROWS_A_TASK)
    blocks, tasks = code_blocks(plain, edges, bins, center, scale, n, flat, together)
    state = _State(blocks, tasks, p, bins, heads)
    grown: list[list[tuple[int, list[tuple]]]] = [[] for _ in heads]
    folder = f"{scratch(plain.sparkSession, 'sums')}" if together else ""
    r = 0
    while r < rounds:
        if together:
            rates = [[_rate(h, rate, i) for h in heads] for i in range(r, min(r + TOGETHER_ROUNDS, rounds))]
            found = _rounds_together(state, depth, rates, min_rows, edges, f"{folder}/{r}")
        else:
            found = [_round(state, depth, [_rate(h, rate, r) for h in heads], min_rows, edges)]
        for trees in found:
            for k, own in enumerate(trees):
                grown[k] += [(i, t.table_nodes(edges, scale if i == 0 else 1.0)) for i, t in enumerate(own)]
        state.recent += found
        r += len(found)
        if len(state.recent) >= (TOGETHER_ROUNDS if together else every) and r < rounds:
            old, state.blocks = state.blocks, _held(_advanced(state))
            state.recent = []
            old.unpersist()
    state.blocks.unpersist()
    units = [[center + scale * own[0], *own[1:]] for own in starts]
    return Fitted(units, [TreeTable.of(features, own) for own in grown], n, center, scale)


def scratch(spark, kind: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def quantile_edges(plain: DataFrame, names: list[str], bins: int, given: list[list[float]] | None = None, n: int = 0) -> list[list[float]]:
    """Sorted distinct edges of every feature, from a quantile sketch (of numpy's from SKETCH_ROWS of the ``n`` rows on) unless they are given."""
    shares = [k / bins for k in range(1, bins)]
    found = given or (_quantiles(plain.select(*names), shares) if n >= SKETCH_ROWS else plain.approxQuantile(names, shares, 1 / (8 * bins)))
    return [sorted({e for e in own if math.isfinite(e)})[:bins - 1] for own in found]


def _fewer(values: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At most SKETCH of these values, in order, at even shares of their weights."""
    order = np.argsort(values)
    values, weights = values[order], weights[order]
    if len(values) <= SKETCH:
        return values, weights
    upto = np.cumsum(weights)
    at = np.searchsorted(upto, (np.arange(SKETCH) + 0.5) / SKETCH * upto[-1])
    return values[np.minimum(at, len(values) - 1)], np.full(SKETCH, upto[-1] / SKETCH)


def _quantiles(plain: DataFrame, shares: list[float]) -> list[list[float]]:
    """Quantiles of every column (missing values aside): each time that values become SKETCH of them, a rank moves by half a SKETCH-th of the rows at most."""
    p = len(plain.columns)

    def merged(a: list, b: list) -> list:
        return [_fewer(*map(np.concatenate, zip(x, y, strict=True))) for x, y in zip(a, b, strict=True)]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held, rows = [(np.zeros(0), np.zeros(0))] * p, [[] for _ in range(p)], 0

        def settled() -> list:
            own = []
            for columns in held:
                x = np.sort(np.concatenate([np.zeros(0), *columns]))
                x = x[:np.searchsorted(x, math.nan)]  # missing values come last
                if len(x) > SKETCH:
                    own.append((x[((np.arange(SKETCH) + 0.5) / SKETCH * len(x)).astype(np.int64)], np.full(SKETCH, len(x) / SKETCH)))
                else:
                    own.append((x, np.ones(len(x))))
                columns.clear()
            return merged(found, own)

        for batch in batches:
            for columns, x in zip(held, batch.columns, strict=True):
                columns.append(x.to_numpy(zero_copy_only=False).astype(float, copy=False))
            rows += batch.num_rows
            if rows >= 64 * SKETCH:
                found, rows = settled(), 0
        found = settled()
        yield pa.RecordBatch.from_pydict({"v": pa.array([x.tobytes() for x, _ in found], pa.binary()), "w": pa.array([w.tobytes() for _, w in found], pa.binary()), "i": pa.array(range(p), pa.int32())})

    sketches = plain.mapInArrow(part, "v binary, w binary, i int").rdd.mapPartitions(_sketches)
    total = sketches.treeReduce(merged)
    out = []
    for values, weights in total:
        upto = np.cumsum(weights)
        at = np.searchsorted(upto, np.array(shares) * (upto[-1] if len(upto) else 0.0))
        out.append(values[np.minimum(at, len(values) - 1)].tolist() if len(values) else [])
    return out


def _sketches(rows: Iterator) -> Iterator[list]:
    own = sorted(rows, key=lambda r: r["i"])
    if own:
        yield [(np.frombuffer(r["v"]), np.frombuffer(r["w"])) for r in own]


def code_blocks(plain: DataFrame, edges: list[list[float]], bins: int, center: float, scale: float, n: int, flat: list[float], tasks: int = 0) -> tuple[RDD, int]:
    """The held blocks (codes, standardised target, first predictions) of rows x0, x1, ..., y, and their number of tasks (by the rows, unless given)."""
    p = len(edges)
    names = [f"x{i}" for i in range(p)]
    held = [np.array(own, float) for own in edges]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False).astype(float, copy=False) for i in range(p)]
            coded = [np.where(np.isnan(x), bins, np.searchsorted(own, x)).astype(np.int8) for x, own in zip(columns, held, strict=True)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, coded), batch.column(p)], names=[*names, "z"])

    def blocks(columns: list[np.ndarray], most: int) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(columns[p]), most):
            own = [x[a:a + most] for x in columns]
            n_rows = len(own[p])
            arrays = np.stack(own[:p]).astype(np.int8), own[p], np.repeat(np.array(flat)[:, None], n_rows, axis=1)
            yield pa.RecordBatch.from_pydict({"n": pa.array([n_rows], pa.int32()), **{name: pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for name, x in zip(("codes", "z", "f"), arrays, strict=True)}})

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from blocks([x.to_numpy(zero_copy_only=False) for x in batch.columns], max(1, batch.num_rows))

    def code_and_pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in code(batches):
            yield from blocks([x.to_numpy(zero_copy_only=False) for x in batch.columns], most)

    tasks = tasks or _tasks(plain.sparkSession, n)
    rows = plain.select(*names, ((F.col("y") - center) / scale).alias("z"))
    if tasks == 1:
        packed = rows.mapInArrow(code, ", ".join([*(f"{x} tinyint" for x in names), "z double"])).coalesce(1).mapInArrow(pack, BLOCKS)
    else:  # blocks, not rows, are dealt in even shares
        most = max(1, min(10_000, -(-n // (32 * tasks))))
        packed = rows.mapInArrow(code_and_pack, BLOCKS).repartition(tasks)
    return _held(packed.rdd.map(_arrays)), tasks


def _tasks(spark, rows: int) -> int:
    """Tasks of a pass: as many as run at once, with no fewer than ROWS_A_TASK rows each and about MOST_ROWS_A_TASK at most."""
    return max(1, min(-(-rows // ROWS_A_TASK), max(spark.sparkContext.defaultParallelism, -(-rows // MOST_ROWS_A_TASK))))


def _together(spark, rows: int, size: int, rows_a_task: int) -> int:
    """Tasks that hold so many rows of so many bytes in all and work on them together; 0 where they cannot."""
    most = min(T.slots(spark), DIRECT, T.MOST_TASKS)
    tasks = min(most, -(-rows // rows_a_task))
    return tasks if tasks and size <= tasks * T.MOST_BYTES else 0


def _rounds_together(state: _State, depth: int, rates: list[list[float]], min_rows: int, edges: list[list[float]], folder: str) -> list[list[list[_Tree]]]:
    """The trees of as many rounds as there are rates, from one barrier job."""
    bins, heads, recent, tasks = state.bins, state.heads, state.recent, state.tasks

    def grow(blocks: Iterator[tuple]) -> Iterator[list[list[_Tree]]]:
        here = _Here(list(blocks), len(edges), bins, heads, recent, T.Exchange.here(folder, tasks))
        found = []
        for own in rates:
            found.append(_round(here, depth, own, min_rows, edges))
            here.add(found[-1])
        if here.exchange.rank == 0:
            yield from found

    return (state.blocks.barrier() if tasks > 1 else state.blocks).mapPartitions(grow).collect()


def _held(blocks: RDD) -> RDD:
    """The blocks, persisted and checkpointed in the shared folder."""
    blocks.persist(StorageLevel.MEMORY_AND_DISK)
    blocks.checkpoint()
    blocks._jrdd.count()  # in the JVM: no row comes back to Python
    return blocks


def _advanced(state: _State) -> RDD:
    """The state with up-to-date predictions."""
    heads, recent = state.heads, state.recent
    return state.blocks.map(lambda b: (b[0], b[1], np.stack([x for own in _up_to_date(b[0], b[2], heads, recent) for x in own])))


def _rate(head, rate: float, r: int) -> float:
    """The rate of a head's tree of round ``r``."""
    own = getattr(head, "first_rate", None) if r == 0 else None
    own = getattr(head, "rate", None) if own is None else own
    return rate if own is None else own


def _round(state: _State | _Here, depth: int, rates: list[float], min_rows: int, edges: list[list[float]]) -> list[list[_Tree]]:
    """One tree for each output of each head, with leaf values."""
    heads, p = state.heads, state.p
    trees = [[_Tree(depth, state.bins) for _ in range(h.width)] for h in heads]
    flat = [(h, t) for h, own in zip(heads, trees, strict=True) for t in own]
    tables: list[np.ndarray] = []
    for level in range(depth):
        table = state.summed((len(flat), 1 << level, p, state.bins + 1, 2), _level, heads, trees, level)
        tables.append(table)
        most = [depth if getattr(h, "depth", None) is None else h.depth for h, _ in flat]
        split = [level < most[k] and _split(table[k], t, level, min_rows, getattr(h, "l2", 0.0), edges) for k, (h, t) in enumerate(flat)]
        if not any(split):
            break
    for k, (h, t) in enumerate(flat):
        if not isinstance(h, Quantile):
            _means([x[k] for x in tables], t, getattr(h, "l2", 0.0))
    if (leaf_heads := [k for k, h in enumerate(heads) if isinstance(h, Quantile)]):
        counts = state.summed((len(leaf_heads), 1 << depth, RESIDUAL_BINS, 2), _leaf_residuals, heads, trees)
        for own, k in zip(counts, leaf_heads, strict=True):
            tree = trees[k][0]
            tree.value[:] = np.array([_quantile_of_bins(leaf, heads[k].q) for leaf in own])[tree.leaf_numbers()]
    if any(isinstance(h, Normal) for h in heads):
        losses = state.summed((len(heads), len(STEPS), 1), _step_losses, heads, trees)
        for k, h in enumerate(heads):
            if isinstance(h, Normal):
                for t in trees[k]:
                    t.value *= STEPS[int(np.argmin(losses[k, :, 0]))]
    for own, rate in zip(trees, rates, strict=True):
        for t in own:
            t.value *= rate
    return trees

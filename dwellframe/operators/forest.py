"""Bootstrap regression forest on byte codes: large nodes by shared tables, small ones finished where their rows are.

* Features are binned by their quantiles once; codes and target are an RDD of numpy
  blocks. A row's weight in a tree is Poisson(1), drawn from the seed, the tree and
  the block's place, so it is never stored.
* A node with more than ``LOCAL_ROWS`` rows is split by a table of counts and sums by
  (feature, code), added up over the tasks by tree; the splits are picked in the
  tasks that hold the sums, and only they reach the driver.
* The rows of a smaller node move to one task, which grows the rest of that subtree
  in numpy: no table of a small node is ever sent, and no task gets more rows of a
  node than ``LOCAL_ROWS``.
* Where all tasks can run at the same time (:func:`together.slots`), the large nodes of
  all trees are split in one barrier job: a task keeps its rows, draws a tree's weights
  once and sends every drawn row down the tree, and the tasks add up their tables
  through the shared folder. Elsewhere a level of some trees is a job.

Sums are of fixed-point numbers, so they do not depend on the order of the rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosting as B
from . import together as T

LOCAL_ROWS = 50_000
#: Bytes of tables that a task holds in one pass, and of rows that a task of subtrees receives.
TABLE_BYTES, SUBTREE_BYTES = 64 << 20, 64 << 20
#: Bytes of drawn rows that a task holds for the trees it grows at a time, and about so many a row.
DRAWN_BYTES, DRAWN_ROW = 128 << 20, 20
#: Cells that the features of a group are counted into where there are many nodes.
FEW_CELLS = 64
#: Columns of a node: feature (-1: a leaf), left, right, last code that goes left, count, sum, gain.
FEATURE, LEFT, RIGHT, UPTO, COUNT, SUM, GAIN = range(7)
OPEN, SENT = -2.0, -3.0


def _weights(seed: int, tree: int, place: tuple[int, int], rows: int) -> np.ndarray:
    return np.random.default_rng([seed, tree, *place]).poisson(1.0, rows)


def _reached(nodes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The node that each row ends in."""
    inner = nodes[:, FEATURE] >= 0
    # a leaf is its own child; the rows' codes and the children are looked up in flat arrays
    child = np.where(inner[:, None], nodes[:, [LEFT, RIGHT]], np.arange(len(nodes))[:, None]).astype(np.int64).ravel()
    start, upto = np.where(inner, nodes[:, FEATURE], 0).astype(np.int64) * codes.shape[1], nodes[:, UPTO].astype(np.int8)
    at, line, flat = np.zeros(codes.shape[1], np.int64), np.arange(codes.shape[1]), codes.ravel()
    while inner[at].any():
        at = child[2 * at + (flat[start[at] + line] > upto[at])]
    return at


def _table(slot: np.ndarray, n_slots: int, codes: np.ndarray, w: np.ndarray, g: np.ndarray, bins: int) -> np.ndarray:
    """Counts and sums by (slot, feature, code)."""
    out = np.zeros((n_slots, len(codes), bins, 2), np.int64)
    base, tally = slot * bins, B.Tally(w.astype(float), g.astype(float))
    for j, code in enumerate(codes):
        for k, x in enumerate(tally(base + code, n_slots * bins)):
            out[:, j, :, k] = x.reshape(n_slots, bins)
    return out


def _best(table: np.ndarray) -> np.ndarray:
    """For each slot: feature (-1: none), last code of the left, gain, and counts and sums of left and right."""
    n, g = table[..., 0].astype(float), table[..., 1] / B.FIXED
    ln, lg = np.cumsum(n, axis=2)[..., :-1], np.cumsum(g, axis=2)[..., :-1]
    total_n, total_g = n[:, :1].sum(axis=2, keepdims=True), g[:, :1].sum(axis=2, keepdims=True)
    rn, rg = total_n - ln, total_g - lg
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where((ln > 0) & (rn > 0), lg ** 2 / ln + rg ** 2 / rn - total_g ** 2 / total_n, -np.inf)
    flat = gain.reshape(len(gain), -1)
    best = flat.argmax(axis=1)
    s = np.arange(len(gain))
    feature, upto = np.divmod(best, gain.shape[2])
    fine = flat[s, best] > 1e-9 * np.maximum(1.0, total_n[:, 0, 0])
    pick = lambda x: x[s, feature, upto]
    return np.column_stack([np.where(fine, feature, -1), upto, flat[s, best], pick(ln), pick(lg), pick(rn), pick(rg)])


def _split(nodes: np.ndarray, at: np.ndarray, best: np.ndarray, kind: float) -> np.ndarray:
    """The nodes with those at ``at`` split where it gains; children are of ``kind``."""
    inner = best[:, 0] >= 0
    nodes[at[~inner], FEATURE] = -1
    at, best = at[inner], best[inner]
    first = len(nodes) + 2 * np.arange(len(at))
    nodes[at, FEATURE], nodes[at, LEFT], nodes[at, RIGHT], nodes[at, UPTO], nodes[at, GAIN] = best[:, 0], first, first + 1, best[:, 1], best[:, 2]
    children = np.zeros((2 * len(at), 7))
    children[:, FEATURE] = kind
    children[0::2, COUNT], children[0::2, SUM], children[1::2, COUNT], children[1::2, SUM] = best[:, 3], best[:, 4], best[:, 5], best[:, 6]
    return np.concatenate([nodes, children])


def _child(nodes: np.ndarray, node: np.ndarray, codes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The children of their nodes that rows (places in ``codes``) go to; those of a leaf stay."""
    inner = nodes[:, FEATURE] >= 0
    child = np.where(inner[:, None], nodes[:, [LEFT, RIGHT]], np.arange(len(nodes))[:, None]).astype(np.int64).ravel()
    start, upto = np.where(inner, nodes[:, FEATURE], 0).astype(np.int64) * codes.shape[1], nodes[:, UPTO].astype(np.int8)
    return child[2 * node + (codes.reshape(-1)[start[node] + rows] > upto[node])]


def _subtree(codes: np.ndarray, w: np.ndarray, g: np.ndarray, depth: int, bins: int) -> np.ndarray:
    """The tree of at most ``depth`` levels on these rows."""
    nodes = np.zeros((1, 7))
    nodes[0] = OPEN, 0, 0, 0, w.sum(), g.sum() / B.FIXED, 0
    node = np.zeros(len(w), np.int64)
    for _ in range(depth):
        at = np.flatnonzero(nodes[:, FEATURE] == OPEN)
        if not len(at):
            break
        slot = np.full(len(nodes), -1)
        slot[at] = np.arange(len(at))
        few = max(1, TABLE_BYTES // (16 * len(codes) * bins))
        best = []
        own = slot[node]
        for k in range(0, len(at), few):
            mine = (own >= k) & (own < k + few) if len(at) > few else slice(None)
            best.append(_best(_table(own[mine] - k, min(few, len(at) - k), codes[:, mine], w[mine], g[mine], bins)))
        nodes = _split(nodes, at, np.concatenate(best), OPEN)
        node = _child(nodes, node, codes, np.arange(len(w)))
        stays = nodes[node, FEATURE] == OPEN  # rows of leaves have done their part
        if not stays.all():
            codes, w, g, node = codes[:, stays], w[stays], g[stays], node[stays]
    nodes[nodes[:, FEATURE] == OPEN, FEATURE] = -1
    return nodes


def fit(df: DataFrame, features: Sequence[str], target: str, num_trees: int, max_depth: int, seed: int, bins: int = 32) -> tuple[B.TreeTable, np.ndarray]:
    """(trees whose values add up to the prediction, importance of each feature); rows have all features and the target."""
    p, spark = len(features), df.sparkSession
    root = B.scratch(spark, "forest")
    y = F.col(f"`{target}`").cast("double")
    df.select(*[F.col(f"`{f}`").cast("double").alias(f"x{i}") for i, f in enumerate(features)], y.alias("y")).write.parquet(f"{root}/rows")
    plain = spark.read.parquet(f"{root}/rows")
    stats = plain.agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("m"), F.stddev_pop("y").alias("s")).first()
    if not stats["n"]:
        raise ValueError(f"no row has a value of {target}")
    n, center, scale = stats["n"], stats["m"], stats["s"] if stats["s"] and stats["s"] > 0 else 1.0
    edges = B.quantile_edges(plain, [f"x{i}" for i in range(p)], bins, n=n)
    together = B._together(spark, n, n * (4 * p + 40), B.ROWS_A_TASK)
    state, tasks = B.code_blocks(plain, edges, bins, center, scale, n, [], together)
    if together:
        trees = _grown_together(state, tasks, [len(own) + 1 for own in edges], n, num_trees, max_depth, seed, bins, B.scratch(spark, "sums"))
    else:
        trees = _grown_by_levels(state, tasks, p, n, num_trees, max_depth, seed, bins)
    state.unpersist()
    for nodes in trees:  # a node that no drawn row reached
        nodes[nodes[:, FEATURE] < 0, FEATURE] = -1
    return _as_table(features, trees, edges, center, scale), _importance(trees, p)


def _parts(n: int, p: int, num_trees: int, tasks: int) -> int:
    """Tasks that grow subtrees."""
    return max(4 * tasks, math.ceil(0.64 * n * num_trees * (p + 9) / SUBTREE_BYTES))


def _graft(trees: list[np.ndarray], t: int, at: int, own: np.ndarray) -> None:
    """Puts a subtree into its tree; its root takes the place of the node."""
    off = len(trees[t]) - 1
    inner = own[:, FEATURE] >= 0
    own[inner, LEFT] += off
    own[inner, RIGHT] += off
    trees[t][at] = own[0]
    trees[t] = np.concatenate([trees[t], own[1:]])


class _Drawn:
    """A task's drawn rows of one tree in nodes that are still to be split, and the tree so far."""

    def __init__(self, t: int, first: np.ndarray, w: np.ndarray, z: np.ndarray):
        self.t, self.nodes, self.sent = t, first, []
        rows = np.flatnonzero(w)
        self.parts = []
        for a in range(0, len(rows), T.ROWS):
            own = rows[a:a + T.ROWS]
            node, drawn = np.zeros(len(own), np.int64), w[own]
            self.parts.append([own, node, T.Both(drawn, drawn * z[own])])
        self.w = w.astype(np.uint8 if w.size == 0 or w.max() < 256 else np.int64)
        self.settle()

    def settle(self) -> None:
        """Rows whose nodes are not to be split here are put aside."""
        for k, (rows, node, both) in enumerate(self.parts):
            kind = self.nodes[node, FEATURE]
            if not (stays := kind == OPEN).all():
                goes = kind == SENT
                self.sent.append((rows[goes], node[goes]))
                both.parts = [x[stays] for x in both.parts]
                self.parts[k][:2] = rows[stays], node[stays]
        self.parts = [x for x in self.parts if len(x[0])]

    def count(self, packs: dict[int, T.Packed], starts: np.ndarray, z: np.ndarray, out: np.ndarray) -> None:
        """Adds counts and sums by (open node, code of a feature) to ``out``."""
        slot = np.full(len(self.nodes), -1)
        slot[self.nodes[:, FEATURE] == OPEN] = np.arange(len(out))
        packed = packs[T.CELLS if len(out) * T.CELLS <= 4 * T.ROWS else FEW_CELLS]
        parts, many = self.parts, 1
        if out[..., 0].size > 4 * T.ROWS:  # more cells than rows in a part: many parts at a time, as two numbers
            many = -(-out[..., 0].size // T.ROWS)
        for a in range(0, len(parts), many):
            rows, node, both = parts[a]
            if many > 1:
                rows, node = (np.concatenate([x[i] for x in parts[a:a + many]]) for i in (0, 1))
                both = T.Both(self.w[rows], self.w[rows] * z[rows])
            own, sums, columns = slot[node], [], [x[rows] for x in packed.columns]
            for x in both.parts:
                sums.append(np.zeros(out.shape[:2]))
                packed.counted(columns, own, x, starts, sums[-1])
            for i, x in enumerate(both.apart(sums)):
                out[..., i] += x

    def split(self, best: np.ndarray, kind: float, local: float, codes: np.ndarray) -> None:
        nodes = self.nodes = _split(self.nodes, np.flatnonzero(self.nodes[:, FEATURE] == OPEN), best, kind)
        nodes[(nodes[:, FEATURE] == OPEN) & (nodes[:, COUNT] <= local), FEATURE] = SENT
        for part in self.parts:
            part[1] = _child(nodes, part[1], codes, part[0])
        self.settle()

    def pieces(self, codes: np.ndarray, z: np.ndarray) -> Iterator[tuple]:
        """The rows of every node that is sent: ((tree, node), (its depth, codes, weights, targets))."""
        if not self.sent:
            return
        rows, node = (np.concatenate(x) for x in zip(*self.sent, strict=True))
        order = np.argsort(node, kind="stable")
        rows, node, depth = rows[order], node[order], _depths(self.nodes)
        own_codes, w, own_z = codes[:, rows], self.w[rows], z[rows]
        if len(own_z) and np.abs(own_z).max() < 1 << 31:
            own_z = own_z.astype(np.int32)
        ends = [0, *(np.flatnonzero(np.diff(node)) + 1).tolist(), len(node)]
        for a, b in zip(ends, ends[1:], strict=False):
            if a < b:
                yield (self.t, int(node[a])), (int(depth[node[a]]), np.ascontiguousarray(own_codes[:, a:b]), w[a:b], own_z[a:b])


def _grown_together(state, tasks: int, widths: list[int], n: int, num_trees: int, max_depth: int, seed: int, bins: int, folder: str) -> list[np.ndarray]:
    """The trees: large nodes by one barrier job whose tasks keep their rows, subtrees of small ones where their rows are dealt to."""
    p = len(widths)
    starts = np.cumsum([0, *widths])
    # rows of a node with so many levels to go are sent if they are no more, or no more bytes than the tables of these levels
    local = [min(LOCAL_ROWS, (2.0 ** d - 1) * 16 * int(starts[-1]) * tasks / (p + 5)) for d in range(max_depth + 1)]
    first = np.array([[(OPEN if n > local[-1] else SENT) if max_depth else -1.0, 0, 0, 0, n, 0, 0]])
    batch = max(1, int(DRAWN_BYTES // (0.64 * DRAWN_ROW * -(-n // tasks))))
    most = max(1, TABLE_BYTES // (16 * int(starts[-1])))

    def tables_split(drawn: list[_Drawn], left: int, codes: np.ndarray, z: np.ndarray, packs: dict, exchange: T.Exchange) -> None:
        """Splits the open nodes of these trees; the children have ``left`` levels to go."""
        ends = np.cumsum([0, *((own.nodes[:, FEATURE] == OPEN).sum() for own in drawn)])
        table = np.zeros((ends[-1], starts[-1], 2), np.int64)
        for own, a, b in zip(drawn, ends, ends[1:], strict=False):
            own.count(packs, starts, z, table[a:b])
        mine = exchange.share(table)[1]
        wide = np.zeros((len(mine), p, max(bins, *widths), 2), np.int64)
        for j in range(p):
            wide[:, j, :widths[j]] = mine[:, starts[j]:starts[j + 1]]
        best = np.concatenate(exchange.gather(_best(wide) if len(mine) else np.zeros((0, 7)))).reshape(-1, 7)
        for own, a, b in zip(drawn, ends, ends[1:], strict=False):
            own.split(best[a:b], OPEN if left else -1.0, local[left], codes)

    def grow(blocks) -> Iterator[tuple]:
        exchange = T.Exchange.here(folder, tasks)
        held, rank = list(blocks), exchange.rank
        lengths = [len(z) for _, z, _ in held]
        codes = np.concatenate([x for x, _, _ in held], axis=1) if held else np.zeros((p, 0), np.int8)
        z = np.concatenate([np.rint(B.FIXED * x) for _, x, _ in held]) if held else np.zeros(0)
        held.clear()
        packs = {cells: T.Packed(codes, cells) for cells in (T.CELLS, FEW_CELLS)} if n > local[-1] else {}
        for a in range(0, num_trees, batch):
            drawn = []
            for t in range(a, min(a + batch, num_trees)):
                w = np.concatenate([_weights(seed, t, (rank, k), rows) for k, rows in enumerate(lengths)] or [np.zeros(0, np.int64)])
                drawn.append(_Drawn(t, first.copy(), w, z))
            for level in range(max_depth):
                todo = [own for own in drawn if (own.nodes[:, FEATURE] == OPEN).any()]
                while todo:
                    some, size = [], 0
                    while todo and (not some or size < most):
                        size += int((todo[0].nodes[:, FEATURE] == OPEN).sum())
                        some.append(todo.pop(0))
                    tables_split(some, max_depth - level - 1, codes, z, packs, exchange)
            for own in drawn:
                if rank == 0:
                    yield (own.t, -1), own.nodes
                yield from own.pieces(codes, z)

    def finish(pieces) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
        held: dict[tuple[int, int], list] = {}
        for key, piece in pieces:
            if key[1] < 0:
                yield key, piece
            else:
                held.setdefault(key, []).append(piece)
        for key in list(held):
            (depth, *_), *_ = own = held.pop(key)
            codes, w, z = (np.concatenate([x[i] for x in own], axis=-1) for i in (1, 2, 3))
            w = w.astype(np.int64)
            yield key, _subtree(codes, w, w * z, max_depth - depth, bins)

    dealt = (state.barrier() if tasks > 1 else state).mapPartitions(grow).partitionBy(_parts(n, p, num_trees, tasks))
    found = sorted(dealt.mapPartitions(finish).collect(), key=lambda x: x[0])
    trees = [own for (_, at), own in found if at < 0]
    for (t, at), own in found:
        if at >= 0:
            _graft(trees, t, at, own)
    return trees


def _grown_by_levels(state, tasks: int, p: int, n: int, num_trees: int, max_depth: int, seed: int, bins: int) -> list[np.ndarray]:
    """The same trees by one job for a level of some of them."""
    numbered = state.mapPartitionsWithIndex(lambda part, own: (((part, k), codes, np.rint(B.FIXED * z)) for k, (codes, z, _) in enumerate(own)))
    trees = [np.array([[OPEN if max_depth else -1.0, 0, 0, 0, n, 0, 0]]) for _ in range(num_trees)]

    def table_of(batch: list[int], held) -> Iterator[tuple[int, np.ndarray]]:
        opened = {t: np.flatnonzero(trees_now[t][:, FEATURE] == OPEN) for t in batch}

        sums: dict[int, np.ndarray] = {}
        for place, codes, z in held:
            for t in batch:
                slot = np.full(len(trees_now[t]), -1)
                slot[opened[t]] = np.arange(len(opened[t]))
                w, at = _weights(seed, t, place, len(z)), slot[_reached(trees_now[t], codes)]
                mine = (w > 0) & (at >= 0)
                one = _table(at[mine], len(opened[t]), codes[:, mine], w[mine], (w * z)[mine], bins)
                sums[t] = sums[t] + one if t in sums else one
        yield from sums.items()

    for level in range(max_depth):
        todo = [t for t in range(num_trees) if (trees[t][:, FEATURE] == OPEN).any()]
        if level == 0 and n <= LOCAL_ROWS:
            for t in todo:
                trees[t][:, FEATURE] = SENT
            break
        if not todo:
            break
        while todo:
            batch, size = [], 0
            while todo and (not batch or size < TABLE_BYTES):
                size += 16 * p * bins * int((trees[todo[0]][:, FEATURE] == OPEN).sum())
                batch.append(todo.pop(0))
            trees_now = {t: trees[t] for t in batch}
            found = numbered.mapPartitions(lambda held, b=batch: table_of(b, held)).reduceByKey(np.add, min(len(batch), 4 * tasks)).mapValues(_best).collect()
            for t, best in found:
                at = np.flatnonzero(trees[t][:, FEATURE] == OPEN)
                trees[t] = _split(trees[t], at, best, OPEN if level + 1 < max_depth else -1.0)
        for nodes in trees:
            nodes[(nodes[:, FEATURE] == OPEN) & (nodes[:, COUNT] <= LOCAL_ROWS), FEATURE] = SENT
    depths = [_depths(nodes) for nodes in trees]
    sent = state.context.broadcast((trees, depths))

    def deal(held) -> Iterator[tuple]:
        grown, _ = sent.value
        for place, codes, z in held:
            for t, nodes in enumerate(grown):
                if not (nodes[:, FEATURE] == SENT).any():
                    continue
                w, at = _weights(seed, t, place, len(z)), _reached(nodes, codes)
                rows = np.flatnonzero((w > 0) & (nodes[at, FEATURE] == SENT))
                rows = rows[np.argsort(at[rows], kind="stable")]
                ends = np.flatnonzero(np.diff(at[rows])) + 1
                for own in np.split(rows, ends) if len(rows) else ():
                    yield (t, int(at[own[0]])), (codes[:, own], w[own].astype(np.uint8), z[own])

    def finish(key: tuple[int, int], parts) -> tuple[tuple[int, int], np.ndarray]:
        codes, w, z = (np.concatenate(x, axis=-1) for x in zip(*parts, strict=True))
        w = w.astype(np.int64)
        return key, _subtree(codes, w, w * z, max_depth - int(sent.value[1][key[0]][key[1]]), bins)

    for (t, at), own in numbered.flatMap(lambda x: deal([x])).groupByKey(_parts(n, p, num_trees, tasks)).map(lambda x: finish(*x)).collect():
        _graft(trees, t, at, own)
    sent.unpersist()
    return trees


def _depths(nodes: np.ndarray) -> np.ndarray:
    depth = np.zeros(len(nodes), np.int64)
    for i in np.flatnonzero(nodes[:, FEATURE] >= 0):  # children come after their parents
        depth[nodes[i, [LEFT, RIGHT]].astype(np.int64)] = depth[i] + 1
    return depth


def _as_table(features: Sequence[str], trees: list[np.ndarray], edges: list[list[float]], center: float, scale: float) -> B.TreeTable:
    roots = np.cumsum([0, *[len(x) for x in trees]])[:-1]
    nodes = np.concatenate(trees)
    base = np.repeat(roots, [len(x) for x in trees])
    inner = nodes[:, FEATURE] >= 0
    child = lambda c: np.where(inner, nodes[:, c] + base, -1).astype(np.int64)
    cut = np.zeros(len(nodes))
    cut[inner] = [math.nextafter(edges[int(f)][int(b)], math.inf) for f, b in nodes[inner][:, [FEATURE, UPTO]]]
    mean = center + scale * nodes[:, SUM] / np.maximum(nodes[:, COUNT], 1)
    return B.TreeTable(list(features), np.zeros(len(trees), np.int64), roots, nodes[:, FEATURE].astype(np.int64), child(LEFT), child(RIGHT), cut, np.zeros(len(nodes), bool), np.where(inner, 0.0, mean / len(trees)))


def _importance(trees: list[np.ndarray], p: int) -> np.ndarray:
    """Gains by feature, every tree's adding up to 1, and so the mean of them."""
    total = np.zeros(p)
    for nodes in trees:
        inner = nodes[nodes[:, FEATURE] >= 0]
        own = np.bincount(inner[:, FEATURE].astype(np.int64), weights=inner[:, GAIN], minlength=p)
        total += own / own.sum() if own.sum() > 0 else 0
    return total / total.sum() if total.sum() > 0 else total

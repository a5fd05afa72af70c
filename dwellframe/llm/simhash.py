"""SimHash near-duplicates by a Gray-order hierarchical index.

Fingerprints: 64 bits of the XXH64 hashes of word shingles; a bit is set if it
is set in over half of them. Two documents are linked if their fingerprints
differ in at most three bits; a component is what links reach.

Search over the distinct fingerprints (equal ones are grouped first, so copies
cost one row): the 64 bits are cut into five blocks. Of any two fingerprints
that differ in at most three bits at least two blocks agree, so each of the ten
pairs of blocks is the masked bit pattern of the root nodes of one index, and
every link lies under a common root in one of them. Under a root (one Spark
shuffle key) the fingerprints are sorted by the Gray rank of the permuted bits;
upper nodes hold the bits that a run of neighbours shares, and a pair of nodes
is dropped with all below it once the accumulated differences exceed three.
Each task returns a spanning forest of the links it finds, never all pairs.

A root with more than ``max_group`` fingerprints is cut into chunks by hash and
every pair of chunks becomes a group of its own, so no task holds more than two
chunks and no pair is lost.

Defined results: null and empty texts have fingerprint zero and are linked like
any other; fewer words than a shingle make one shingle; rows without an id get
the smallest id of their component (null if it has none); repeated rows are
kept. Input columns named like an output column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import others, stored, text_udf
from .components import components

SEED = 42
WIDTHS = (13, 13, 13, 13, 12)
OFFSETS = tuple(64 - sum(WIDTHS[:k + 1]) for k in range(5))
ROOTS = tuple(combinations(range(5), 2))
#: Bits of the permuted fingerprint that the nodes of each level share; the last level is the fingerprint.
LEVELS = (34, 42, 50, 57, 64)
SLICE = 100_000


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The fingerprint as a signed 64-bit integer."""
    words = (text or "").encode().lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))[:n].tolist()
    stops = (ends[-n:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for k in range(0, n, SLICE):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[k:k + SLICE], stops[k:k + SLICE], strict=True)], ">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n).view(">i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 3) -> Column:
    """The fingerprint (bigint) of a text column."""

    def make():
        return lambda texts: [(fingerprint(t, shingle),) for t in texts]

    return text_udf(make, "fp long")(F.col(text))["fp"]


def permuted(fp: np.ndarray, root: int) -> np.ndarray:
    """Fingerprints (uint64) with the two blocks of a root pattern moved to the top."""
    first = ROOTS[root]
    out, at = np.zeros(len(fp), np.uint64), 64
    for b in (*first, *[k for k in range(5) if k not in first]):
        at -= WIDTHS[b]
        out |= ((fp >> np.uint64(OFFSETS[b])) & np.uint64((1 << WIDTHS[b]) - 1)) << np.uint64(at)
    return out


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each word in the reflected Gray order."""
    for k in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(k))
    return x


def _forest(group: np.ndarray, code: np.ndarray, radius: int, piece: int = 1 << 20) -> np.ndarray:
    """For each row the smallest row it is joined to, directly or not, among rows of its group.

    ``code`` is sorted by (group, Gray rank). Pairs of nodes are expanded level
    by level, at most ``piece`` at a time (depth first), so memory is bounded.
    """
    n = len(code)
    label = np.arange(n)
    starts = [np.flatnonzero(np.r_[True, group[1:] != group[:-1]])]
    for bits in LEVELS:
        cut = code >> np.uint64(64 - bits)
        starts.append(np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (cut[1:] != cut[:-1])]))
    children = [np.r_[np.searchsorted(low, up), len(low)] for up, low in zip(starts, starts[1:], strict=False)]
    roots = np.arange(len(starts[0]))
    stack = [(0, roots, roots)]
    while stack:
        level, a, b = stack.pop()
        kids = children[level]
        size = (kids[a + 1] - kids[a]) * (kids[b + 1] - kids[b])
        if len(a) > 1 and size.sum() > piece:
            half = max(1, min(len(a) - 1, int(np.searchsorted(np.cumsum(size), size.sum() / 2))))
            stack += [(level, a[half:], b[half:]), (level, a[:half], b[:half])]
            continue
        pair = np.repeat(np.arange(len(a)), size)
        within = np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size)
        wide = (kids[b + 1] - kids[b])[pair]
        x, y = kids[a][pair] + within // wide, kids[b][pair] + within % wide
        keep = x <= y if level < len(LEVELS) - 1 else x < y
        x, y = x[keep], y[keep]
        low = starts[level + 1]
        apart = np.bitwise_count((code[low[x]] ^ code[low[y]]) >> np.uint64(64 - LEVELS[level])) <= radius
        x, y = x[apart], y[apart]
        if level + 1 < len(LEVELS):
            if len(x):
                stack.append((level + 1, x, y))
            continue
        p, q = low[x], low[y]
        while len(p):
            p, q = label[p], label[q]
            differ = p != q
            p, q = p[differ], q[differ]
            np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
            while (label[label] != label).any():
                label = label[label]
    return label


def _links_of(root: np.ndarray, group: np.ndarray, fp: np.ndarray, radius: int) -> pa.RecordBatch:
    """Links of whole groups: every fingerprint to the first of what it is joined to."""
    us, vs = [], []
    for r in np.unique(root):
        mine = root == r
        g, f = group[mine], fp[mine]
        code = permuted(f, int(r))
        order = np.lexsort((gray_rank(code), g))
        g, f, code = g[order], f[order], code[order]
        label = _forest(g, code, radius)
        moved = np.flatnonzero(label != np.arange(len(label)))
        us.append(f[moved])
        vs.append(f[label[moved]])
    u, v = np.concatenate(us or [np.zeros(0, np.uint64)]).view(np.int64), np.concatenate(vs or [np.zeros(0, np.uint64)]).view(np.int64)
    return pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def links(fps: DataFrame, radius: int = 3, max_group: int = 2048) -> DataFrame:
    """Links (u, v) that join what lies within ``radius`` (at most 3) bits among the distinct values of ``fps.fp``."""
    if not 0 <= radius <= 3:
        raise ValueError("five blocks, two of which agree, hold for at most three differing bits")

    def block(k: int) -> Column:
        return F.shiftrightunsigned("fp", OFFSETS[k]).bitwiseAND(F.lit((1 << WIDTHS[k]) - 1).cast("long"))

    keys = F.array(*[F.struct(F.lit(r).cast("int").alias("r"), F.shiftleft(block(a), WIDTHS[b]).bitwiseOR(block(b)).alias("k")) for r, (a, b) in enumerate(ROOTS)])
    under = fps.select("fp", F.explode(keys).alias("n")).select("fp", "n.r", "n.k")
    hot = under.groupBy("r", "k").count().where(F.col("count") > max_group).select("r", "k", F.ceil(F.col("count") / max_group).cast("int").alias("s"))
    chunk = F.pmod(F.xxhash64("fp"), F.col("s")).cast("int")
    dealt = (under.join(hot, ["r", "k"], "left").withColumn("s", F.coalesce("s", F.lit(1))).withColumn("c", chunk)
             .select("fp", "r", "k", F.explode(F.transform(F.sequence(F.lit(0), F.col("s") - 1), lambda o: F.struct(F.least(F.col("c"), o).alias("i"), F.greatest(F.col("c"), o).alias("j")))).alias("p")))
    grouped = (dealt.select("r", "k", "p.i", "p.j", "fp").repartition("r", "k", "i", "j").sortWithinPartitions("r", "k", "i", "j"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in range(5)])
            ends = np.flatnonzero((rows[:4, 1:] != rows[:4, :-1]).any(axis=0)) + 1
            if held and (rows[:4, 0] != held[-1][:4, -1]).any():
                ends = np.r_[0, ends]
            if not len(ends):
                held.append(rows)
                continue
            yield whole(np.concatenate([*held, rows[:, :ends[-1]]], axis=1))
            held = [rows[:, ends[-1]:]]
        if held:
            yield whole(np.concatenate(held, axis=1))

    def whole(rows: np.ndarray) -> pa.RecordBatch:
        new = np.r_[True, (rows[:4, 1:] != rows[:4, :-1]).any(axis=0)] if rows.shape[1] else np.zeros(0, bool)
        return _links_of(rows[0], np.cumsum(new), rows[4].view(np.uint64), radius)

    return grouped.mapInArrow(search, "u long, v long")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 3, radius: int = 3) -> DataFrame:
    """One row per document: ``key``, row_hash, fp and component_id (smallest id within reach)."""
    rows = stored(docs.select(F.col(key), _row_hash(docs).alias("row_hash"), fingerprints(docs, text, shingle).alias("fp")), "fingerprints")
    fps = stored(rows.groupBy("fp").agg(F.min(key).alias("least")), "distinct")
    roots = components(links(fps, radius))
    linked = stored(fps.join(roots, fps.fp == roots.u, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "roots")
    smallest = stored(linked.groupBy("root").agg(F.min("least").alias("component_id")), "smallest")
    classes = stored(linked.join(smallest, "root").select("fp", "root", "component_id"), "classes")
    return rows.join(classes, "fp").select(key, "row_hash", "fp", "root", "component_id")


def fingerprint_table(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits) and component_id of every row."""
    found = near_duplicates(docs, text, key, shingle, radius)
    return found.select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 3, radius: int = 3) -> DataFrame:
    """The rows of ``docs`` of which one document of each component stays: the one with the smallest id.

    A component without ids keeps the row whose content hash is smallest; of
    rows equal in every column one stays.
    """
    columns = docs.columns
    found = stored(near_duplicates(docs, text, key, shingle, radius), "found")
    order = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"), F.col("row_hash").alias("h"))
    first = found.groupBy("root").agg(F.min(order).alias("b")).select("b.id", "b.h").distinct()
    several = found.groupBy(F.col(key).alias("id2"), F.col("row_hash").alias("h2")).agg(F.count("*").alias("copies")).where("copies > 1")
    stay = stored(first.join(several, F.col("id").eqNullSafe(F.col("id2")) & (F.col("h") == F.col("h2")), "left").select("id", "h", F.coalesce("copies", F.lit(1)).alias("copies")), "stay")
    hashed = docs.select(_row_hash(docs).alias("row_hash"), F.col(key).alias("row_id"), F.struct(*others(docs, ())).alias("row"))
    same = F.col("row_id").eqNullSafe(F.col("id")) & (F.col("row_hash") == F.col("h"))
    single = hashed.join(stay.where("copies = 1"), same, "left_semi").select("row")
    repeated = hashed.join(stay.where("copies > 1"), same, "left_semi").groupBy("row_id", "row_hash").agg(F.first("row").alias("row")).select("row")
    return single.union(repeated).select(*[F.col("row")[c].alias(c) for c in columns])


def _row_hash(docs: DataFrame) -> Column:
    return F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind])

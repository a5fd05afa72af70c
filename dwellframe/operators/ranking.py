"""Exact global order statistics without a single-partition window.

``Window.orderBy`` without ``partitionBy`` moves every row into one task.  The
helpers here keep the work spread out:

* rows are cut into ``n_buckets`` contiguous ranges of the leading (numeric)
  order column, with boundaries from one ``approxQuantile`` pass (a bounded
  list of ``n_buckets - 1`` doubles comes back to the driver);
* the per-bucket counts (``n_buckets`` rows) give exact offsets;
* a rank inside each bucket is a window partitioned by bucket.

The result is exact because buckets are monotone in the order and the order
inside a bucket is total (leading column, then tie-break columns).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

BUCKET = "__bucket"
CUT_BUCKETS = 256


def hash_order(key, seed: int) -> Column:
    """Seeded pseudo-random order key: md5 of "<key>:<seed>" (hex text, engine independent; a NULL key counts as empty text)."""
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.coalesce(k.cast("string"), F.lit("")), F.lit(f":{seed}")))


def hex_prefix_number(h) -> Column:
    """First 15 hex digits as a (monotone) number for range bucketing of a hex order key."""
    h = F.col(h) if isinstance(h, str) else h
    return F.conv(F.substring(h, 1, 15), 16, 10).cast("bigint").cast("double")


def default_buckets(df: DataFrame) -> int:
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "8")) * 2)


def _splits(df: DataFrame, num_col: str, n_buckets: int) -> list[float]:
    probs = [i / n_buckets for i in range(1, n_buckets)]
    qs = df.approxQuantile(num_col, probs, 1.0 / (4 * n_buckets)) if probs else []
    inner = sorted({float(q) for q in qs if q is not None and math.isfinite(q)})
    return [-math.inf, *inner, math.inf]


HASH_RANGE = (0.0, float(1 << 60))  # hex_prefix_number of an md5 is uniform on this range


def bucketize(df: DataFrame, num_col: str, n_buckets: int, uniform_range: tuple[float, float] | None = None) -> DataFrame:
    """Add ``__bucket``: contiguous, monotone ranges of ``num_col`` (double).

    With ``uniform_range`` (values known to be spread evenly, e.g. a hash)
    the buckets are equal-width and no quantile pass is needed.
    """
    if uniform_range is not None:
        lo, hi = uniform_range
        w = (hi - lo) / n_buckets
        b = F.floor((F.col(num_col) - F.lit(lo)) / F.lit(w))
        return df.withColumn(BUCKET, F.least(F.greatest(b, F.lit(0)), F.lit(n_buckets - 1)).cast("double"))
    splits = _splits(df, num_col, n_buckets)
    return Bucketizer(splits=splits, inputCol=num_col, outputCol=BUCKET,
                      handleInvalid="keep").transform(df)


def _with_own_values(df: DataFrame, num_col: str, n_buckets: int) -> DataFrame:
    """Add ``__bucket``: the ranges between quantiles of ``num_col`` (even numbers) and the quantiles themselves (odd ones)."""
    probs = [i / n_buckets for i in range(1, n_buckets)]
    edges = sorted({float(q) for q in df.approxQuantile(num_col, probs, 1.0 / (4 * n_buckets)) if q is not None and not math.isnan(q)})
    if not edges:
        return df.withColumn(BUCKET, F.lit(0))
    held, x = F.array(*[F.lit(e) for e in edges]), F.col(num_col)
    place = _edges_below(held, x, len(edges))
    return df.withColumn(BUCKET, 2 * place + F.coalesce(F.get(held, place) == x, F.lit(False)).cast("int"))


def global_rank(df: DataFrame, num_col: str, tie_cols: Sequence[str] = (), out: str = "rank",
                n_buckets: int | None = None, n_rows: int | None = None,
                uniform_range: tuple[float, float] | None = None) -> DataFrame:
    """Exact 1-based rank by (num_col, *tie_cols) ascending; ``num_col`` must be a non-null double.

    One quantile pass, one tiny count aggregate, one shuffle by bucket.  With
    ``n_rows`` known the bucket count gives ~2M rows per bucket (at least
    twice the shuffle partitions).
    """
    nb = n_buckets or default_buckets(df)
    if n_buckets is None and n_rows:
        nb = max(nb, math.ceil(n_rows / 2_000_000))
    b = bucketize(df, num_col, nb, uniform_range)
    counts = b.groupBy(BUCKET).agg(F.count(F.lit(1)).alias("__cnt"))
    # n_buckets rows: an unpartitioned window over them is bounded by n_buckets
    offs = counts.select(BUCKET, (F.sum("__cnt").over(Window.orderBy(BUCKET)) - F.col("__cnt")).alias("__off"))
    w = Window.partitionBy(BUCKET).orderBy(*[F.col(c) for c in (num_col, *tie_cols)])
    return (b.join(offs, BUCKET)
            .withColumn(out, F.row_number().over(w) + F.col("__off"))
            .drop("__off", BUCKET))


def ntile_from_rank(rank, n, k: int) -> Column:
    """SQL ``ntile(k)`` from a 1-based rank and the row count (first n mod k tiles one larger)."""
    r = F.col(rank) if isinstance(rank, str) else rank
    n = F.lit(n) if isinstance(n, int) else n
    q = F.floor(n / k)
    rem = n - q * k
    big = rem * (q + 1)
    return F.when(r <= big, F.floor((r - 1) / (q + 1)) + 1) \
        .otherwise(rem + F.floor((r - big - 1) / F.greatest(q, F.lit(1))) + 1).cast("int")


def kth_smallest(df: DataFrame, num_col: str, tie_cols: Sequence[str], k,
                 n_buckets: int | None = None, max_rows_in_task: int = 1_000_000,
                 uniform_range: tuple[float, float] | None = None):
    """The k-th (1-based) row by (num_col, *tie_cols) as a ``Row`` of those columns; see :func:`cut_at`."""
    return cut_at(df, num_col, tie_cols, k, n_buckets, max_rows_in_task, uniform_range)[0]


def cut_at(df: DataFrame, num_col: str, tie_cols: Sequence[str], k,
           n_buckets: int | None = None, max_rows_in_task: int = 1_000_000,
           uniform_range: tuple[float, float] | None = None):
    """(k-th row, its place among the rows equal to it, how many are equal to it), by (num_col, *tie_cols).

    ``k`` may be a function of the row count (evaluated on the first bucket
    counts, so no separate ``count()`` pass is needed).  With ``uniform_range``
    (an evenly spread key such as a hash) buckets are equal-width, so each
    narrowing step is a single counting pass with no quantile pass.  Narrows to the bucket
    holding the k-th row until it has at most ``max_rows_in_task`` rows, then
    ranks that bucket alone.  Only bucket counts and the final row reach the
    driver.  A bucket whose rows all share one value is narrowed by the tie
    columns in turn (numbers by value, text by its first six bytes).  A value at a
    boundary is a bucket of its own, so a value that most rows share is parted
    from its neighbours however few these are.
    """
    cols = [num_col, *tie_cols]
    cur = df.select(*cols)
    nb = n_buckets or max(CUT_BUCKETS, default_buckets(df))
    total = None
    rng = uniform_range
    by, later, it = num_col, list(tie_cols), -1
    while True:
        it += 1
        b = bucketize(cur, by, nb, rng) if rng is not None else _with_own_values(cur, by, nb)
        counts = sorted((int(r[BUCKET]), int(r["c"])) for r in
                        b.groupBy(BUCKET).agg(F.count(F.lit(1)).alias("c")).collect())
        total = sum(c for _, c in counts)
        if it == 0 and callable(k):
            k = k(total)
        if k < 1 or k > total:
            raise ValueError(f"k={k} outside 1..{total}")
        acc = 0
        for bid, c in counts:
            if acc + c >= k:
                break
            acc += c
        k -= acc
        cur = b.filter(F.col(BUCKET) == bid).drop(BUCKET)
        if rng is not None:  # narrow the equal-width range to the chosen bucket
            w = (rng[1] - rng[0]) / nb
            rng = (rng[0] + bid * w, rng[0] + (bid + 1) * w)
        if c <= max_rows_in_task:
            break
        if len(counts) > 1 and (rng is not None or bid % 2 == 0):
            continue
        ends = cur.agg(F.min(by).alias("a"), F.max(by).alias("b")).first()
        if ends["a"] == ends["b"]:
            # the bucket cannot be split on this column: go on with the next one
            lo = cur.agg(*[F.min(x).alias(x) for x in cols]).first()
            hi = cur.agg(*[F.max(x).alias(x) for x in cols]).first()
            whole = cur.agg(*[F.count(x).alias(x) for x in cols]).first()
            if all(lo[x] == hi[x] and whole[x] in (0, c) for x in cols):
                return lo, k, c
            if not later:
                break  # text that differs behind its first six bytes only
            cur, by, rng = cur.withColumn("__next", _monotone(cur, later[0])), "__next", None
            later = later[1:]
        elif len(counts) == 1:
            if rng is None:
                break  # values that no boundary parts (not numbers)
            if rng[1] - rng[0] <= math.ulp(max(map(abs, rng))) * nb:
                rng = None  # a range as narrow as its numbers are exact: by quantiles from here on
    # at most max_rows_in_task rows, unless they differ only where no column can part them
    counted = cur.groupBy(*cols).agg(F.count(F.lit(1)).alias("__same"))
    upto = counted.withColumn("__upto", F.sum("__same").over(Window.orderBy(*[F.col(c) for c in cols])))
    row = upto.filter((F.col("__upto") >= k) & (F.col("__upto") - F.col("__same") < k)).first()
    return Row(**{c: row[c] for c in cols}), k - (row["__upto"] - row["__same"]), row["__same"]


def _monotone(df: DataFrame, col: str) -> Column:
    """A double that never falls as the column rises: the number itself, or the first six bytes of its text; NULL is least."""
    if dict(df.dtypes)[col] == "string":
        head = F.rpad(F.hex(F.substring(F.encode(col, "UTF-8"), 1, 6)), 12, "0")
        number = F.conv(head, 16, 10).cast("double")
    else:
        number = F.col(col).cast("double")
    return F.coalesce(number, F.lit(-math.inf))


def lex_le(cols: Sequence[str], values: Sequence) -> Column:
    """Lexicographic (c1, c2, ...) <= (v1, v2, ...) as a Column; NULL is smaller than any value."""
    c0, v0 = F.col(cols[0]), values[0]
    less = F.lit(False) if v0 is None else F.coalesce(c0 < F.lit(v0), F.lit(True))
    same = c0.isNull() if v0 is None else F.coalesce(c0 == F.lit(v0), F.lit(False))
    if len(cols) == 1:
        return less | same
    return less | (same & lex_le(cols[1:], values[1:]))


def lex_eq(cols: Sequence[str], values: Sequence) -> Column:
    """All columns equal to the values; NULL equals NULL."""
    same = F.lit(True)
    for c, x in zip(cols, values, strict=True):
        same = same & (F.col(c).isNull() if x is None else F.coalesce(F.col(c) == F.lit(x), F.lit(False)))
    return same


def row_hash(df: DataFrame, seed: int = 0) -> Column:
    """64-bit hash of all columns that can be hashed (maps cannot)."""
    parts = [F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    return F.xxhash64(F.lit(seed), *parts)


# ------------------------------------------------------------- grouped ranks
GKEY = "__gk"


ROWS_PER_BUCKET = 2_000_000


def _edges_below(edges: str | Column, value: Column, n: int) -> Column:
    """Number of edges (sorted array of at most n) below the value, by binary search."""
    steps = [1 << k for k in reversed(range(n.bit_length()))]
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0),
                       lambda at, s: F.when(F.coalesce(F.get(edges, at + s - 1) < value, F.lit(False)), at + s).otherwise(at))


def _grouped_buckets(df: DataFrame, group_cols: Sequence[str], num_col: str, n_buckets: int | None, size_out: str):
    """Per-group edges (one ``percentile_approx`` pass, persisted: groups x n_buckets doubles) and the
    rows tagged with their bucket (count of edges below the value).  Spark chooses how to join them.

    ``n_buckets=None`` starts with 64 buckets and, only when the largest group
    (known from the same pass) exceeds 64 x ``ROWS_PER_BUCKET`` rows, redoes
    the edges with enough buckets; the sketch accuracy grows with the bucket
    count so bucket sizes stay balanced.
    """
    g = list(group_cols) or [GKEY]
    d = df if group_cols else df.withColumn(GKEY, F.lit(0))

    def edges_for(nb):
        probs = [i / nb for i in range(1, nb)]
        accuracy = max(10_000, 20 * nb)
        e = d.groupBy(*g).agg(F.percentile_approx(F.col(num_col).cast("double"), probs, accuracy).alias("__edges"),
                              F.count(F.lit(1)).alias(size_out)).persist()
        return e, e.agg(F.max(size_out)).first()[0] or 0

    nb = n_buckets or 64
    edges, biggest = edges_for(nb)
    if n_buckets is None and biggest > nb * ROWS_PER_BUCKET:
        # a very large group: redo the edges with enough buckets (~ROWS_PER_BUCKET rows each)
        edges.unpersist()
        nb = math.ceil(biggest / ROWS_PER_BUCKET)
        edges, _ = edges_for(nb)
    b = d.join(edges, g).withColumn(BUCKET, _edges_below("__edges", F.col(num_col).cast("double"), nb)).drop("__edges")
    return g, b, edges


def _bucket_offsets(b: DataFrame, g: Sequence[str], weight: Column | None = None) -> DataFrame:
    """(group, bucket, __cnt, __off): rows (or their weight) in the bucket and in earlier buckets of the group."""
    counts = b.groupBy(*g, BUCKET).agg(F.sum(F.lit(1) if weight is None else weight).alias("__cnt"))
    return counts.select(*g, BUCKET, "__cnt", (F.sum("__cnt").over(Window.partitionBy(*g).orderBy(BUCKET))
                                               - F.col("__cnt")).alias("__off"))


def grouped_rank(df: DataFrame, group_cols: Sequence[str], num_col: str, tie_cols: Sequence[str] = (),
                 out: str = "rank", size_out: str = "group_n", n_buckets: int | None = None) -> DataFrame:
    """Exact 1-based rank by (num_col, *tie_cols) within each group, plus the group size.

    Per-group bucket edges come from one ``percentile_approx`` aggregate; the
    edge table (groups x n_buckets doubles) is joined.  Rows then shuffle by (group, bucket), so a large
    group is spread over ``n_buckets`` tasks instead of one (by default enough
    buckets for ~2M rows each).  Offsets come from the per-bucket counts.
    ``num_col`` must be non-null.
    """
    g, b, _ = _grouped_buckets(df, group_cols, num_col, n_buckets, size_out)
    offs = _bucket_offsets(b, g).drop("__cnt")
    w = Window.partitionBy(*g, BUCKET).orderBy(*[F.col(c) for c in (num_col, *tie_cols)])
    res = (b.join(offs, [*g, BUCKET])
           .withColumn(out, F.row_number().over(w) + F.col("__off"))
           .drop("__off", BUCKET))
    return res if group_cols else res.drop(GKEY)


def grouped_ntile(df: DataFrame, group_cols: Sequence[str], num_col: str, k: int, tie_cols: Sequence[str] = (),
                  out: str = "ntile") -> DataFrame:
    """SQL ``ntile(k) over (partition by group order by num_col, ties)`` without a per-group task."""
    r = grouped_rank(df, group_cols, num_col, tie_cols, out="__r", size_out="__n")
    return r.withColumn(out, ntile_from_rank("__r", F.col("__n"), k)).drop("__r", "__n")


def exact_percentiles(df: DataFrame, value_col: str, probs: Sequence[float],
                      group_cols: Sequence[str] = (), names: Sequence[str] | None = None,
                      n_buckets: int | None = None) -> DataFrame:
    """Exact linear-interpolation percentiles (numpy/``percentile``/``quantile_cont``) per group.

    Rows are counted by (group, value) first (combined in each task), so a
    value that holds most rows is one row from there on and no row is ever
    ranked.  Per-bucket counts say where ranks ⌊h⌋+1 and ⌈h⌉+1 (h = (n − 1)·p)
    fall; only those buckets' values are summed up in order, and the two
    neighbours interpolated.  No group is collected into one task.
    """
    names = list(names or [f"p{int(round(p * 100))}" for p in probs])
    d = df.withColumn("__v", F.col(value_col).cast("double")).filter(F.col("__v").isNotNull() & ~F.isnan("__v"))
    counted = d.groupBy(*group_cols, "__v").agg(F.count(F.lit(1)).alias("__c")).persist()
    g, b, _ = _grouped_buckets(counted, group_cols, "__v", n_buckets, "__values")
    offs = _bucket_offsets(b, g, F.col("__c"))
    total = offs.groupBy(*g).agg(F.sum("__cnt").alias("__n"))
    want = total.select(*g, "__n", F.explode(F.array(*[
        F.struct(F.lit(nm).alias("__p"), F.lit(float(p)).alias("__q")) for p, nm in zip(probs, names)])).alias("t"))
    h = (F.col("__n") - 1) * F.col("t.__q")
    want = want.select(*g, F.col("t.__p").alias("__p"), (h - F.floor(h)).alias("__f"),
                       F.explode(F.array((F.floor(h) + 1).cast("long"), (F.ceil(h) + 1).cast("long"))).alias("__rk"))
    # which bucket holds each wanted rank (groups x probs x 2 rows against groups x buckets rows)
    loc = want.join(offs, g).filter((F.col("__rk") > F.col("__off")) & (F.col("__rk") <= F.col("__off") + F.col("__cnt")))
    loc = loc.select(*g, BUCKET, "__p", "__f", "__rk", (F.col("__rk") - F.col("__off")).alias("__local"))
    rows = b.join(loc.select(*g, BUCKET).distinct(), [*g, BUCKET], "left_semi").select(*g, BUCKET, "__v", "__c")
    upto = rows.withColumn("__upto", F.sum("__c").over(Window.partitionBy(*g, BUCKET).orderBy("__v")))
    hit = loc.join(upto, [*g, BUCKET]).filter((F.col("__local") <= F.col("__upto")) & (F.col("__local") > F.col("__upto") - F.col("__c")))
    per = hit.groupBy(*g, "__p").agg(F.min_by("__v", "__rk").alias("__lo"), F.max_by("__v", "__rk").alias("__hi"),
                                     F.first("__f").alias("__f"))
    val = (F.col("__lo") + F.col("__f") * (F.col("__hi") - F.col("__lo"))).cast("double")
    wide = per.groupBy(*g).pivot("__p", names).agg(F.first(val))
    out = wide.select(*g, *names)
    return out if group_cols else out.drop(GKEY)


def column_modes(long_df: DataFrame, group_col: str = "column", value_col: str = "value") -> DataFrame:
    """Most frequent value per group, lowest value on ties (distributed: count per value, then max)."""
    cnt = long_df.filter(F.col(value_col).isNotNull()).groupBy(group_col, value_col).agg(F.count(F.lit(1)).alias("c"))
    best = cnt.groupBy(group_col).agg(F.max(F.struct(F.col("c"), (-F.col(value_col)).alias("neg"))).alias("m"))
    return best.select(group_col, (-F.col("m.neg")).alias("mode"))

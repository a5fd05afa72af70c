"""Shards of equal row counts that keep equal texts together, by balanced label propagation.

Every row starts in a shard that its place in a hashed order gives; all shards
hold the same number of rows, or one more. Rows of equal text are neighbours.
The state of the propagation is one row for each (text, shard) with the number
of documents there, so a text with a third of all rows is at most ``shards``
rows. In each round

1. a text's documents vote: the shards with most of them and with room left are
   its targets (one for each shard that its documents could fill);
2. its documents in shards with fewer votes ask to move to a target; where none of its
   shards has room, all ask for one that has;
3. each shard admits as many as it has room for; its room is what unlinked
   documents hold, as those can live anywhere and change places with the
   newcomers. Shards that have no room exchange equal numbers pairwise. Who is
   first is drawn anew each round, and the last text to fit may be split.

Rounds end when no document moves. A shard full of other linked documents is not
emptied for a larger text, so a text of many shards may end in more of them than
it could fill. Then the documents of a text take the shards
its votes say, and unlinked documents fill every shard to its exact count.
Voting, demand and admission are aggregates and joins; only the table of
demands between shards (``shards`` squared numbers) is read by the driver.

Ranks are drawn in buckets of a hashed order with the buckets' sums before them,
so no window holds a whole shard or a whole group of copies.

Defined results: a null text counts as an empty one (size 8, checksum 0); rows
without an id and rows with equal ids are rows like any other; an empty table
gives no rows; other columns are ignored. Texts are told apart by 64-bit hashes:
two texts of one hash would be kept together, and no law depends on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import shared_path, stored

#: Rows of a bucket in which ranks are drawn; more where there would be over BUCKETS of them.
WIDTH, BUCKETS = 512, 100_000


def _bucket(rank: Column, rows: int) -> Column:
    return F.floor(rank / F.lit(max(WIDTH, rows // BUCKETS)))


def numbered(rows: DataFrame, by: list[str], order: list[Column], name: str) -> DataFrame:
    """``rows`` with a gapless number from 0 within each group ``by``; the column ``bucket`` spreads a group over tasks."""
    counts = rows.groupBy(*by, "bucket").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(W.partitionBy(*by).orderBy("bucket")) - F.col("_n")).drop("_n")
    own = F.row_number().over(W.partitionBy(*by, "bucket").orderBy(*order)) - 1
    return rows.join(before, [*by, "bucket"]).withColumn(name, (own + F.col("_before")).cast("long")).drop("_before")


def _votes(cells: DataFrame) -> DataFrame:
    """One row a text: its cells, most documents first."""
    return cells.groupBy("hub").agg(F.sort_array(F.collect_list(F.struct("n", "shard")), asc=False).alias("cells"), F.sum("n").alias("total"))


def _requests(cells: DataFrame, room: list[int], capacity: int, round_: int) -> DataFrame:
    """(hub, f, t, n): documents that ask to move from shard f to shard t."""
    open_ = F.array(*[F.lit(t) for t, r in enumerate(room) if r > 0]) if any(room) else F.array().cast("array<int>")
    full = not any(room)
    votes = _votes(cells).withColumn("k", F.greatest(F.ceil(F.col("total") / capacity).cast("int"), F.lit(1)))
    # Equal votes: a draw by text, so that texts do not all choose the same shard.
    drawn = F.transform("cells", lambda c: F.struct((-c["n"]).alias("less"), F.pmod(F.xxhash64("hub", c["shard"]), F.lit(1 << 30)).alias("draw"), c["shard"].alias("shard"), c["n"].alias("n")))
    ranked = votes.withColumn("cells", F.array_sort(drawn))
    wanted = F.col("cells") if full else F.filter("cells", lambda c: F.array_contains(open_, c["shard"]))
    best = F.slice(wanted, 1, F.col("k"))
    # A parted text none of whose shards has room: all of it asks for one that has, drawn anew each round.
    drawn_open = F.element_at(open_, (F.pmod(F.xxhash64("hub", F.lit(round_)), F.greatest(F.size(open_), F.lit(1))) + 1).cast("int"))
    elsewhere = F.array(F.struct(F.lit(1).cast("long").alias("less"), F.lit(0).cast("long").alias("draw"), drawn_open.alias("shard"), F.lit(0).cast("long").alias("n")))
    aimed = ranked.withColumn("targets", best if full else F.when(F.size(best) > 0, best).when(F.size("cells") > 1, elsewhere)).where(F.size("targets") > 0)
    least = F.element_at(F.col("targets"), -1)
    moving = F.filter("cells", lambda c: (least["n"] == 0) | (F.struct(c["less"], c["draw"]) > F.struct(least["less"], least["draw"])))
    asks = aimed.select("hub", "targets", F.posexplode(moving).alias("place", "c"))
    target = F.element_at("targets", (F.pmod(F.col("place") + round_, F.size("targets")) + 1).cast("int"))
    return asks.select("hub", F.col("c.shard").alias("f"), target["shard"].alias("t"), F.col("c.n").alias("n"))


def _quotas(demand: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], int]:
    """How many documents may move from f to t: pairs exchange equal numbers, and room is shared by demand."""
    quota = {(f, t): min(n, demand.get((t, f), 0)) for (f, t), n in demand.items()}
    for t, free in enumerate(room):
        wants = {f: n - quota[f, t] for (f, to), n in sorted(demand.items()) if to == t and n > quota[f, t]}
        total = sum(wants.values())
        for f, n in wants.items():
            given = n if total <= free else n * free // total
            quota[f, t] += given
        left = free - sum(n if total <= free else n * free // total for n in wants.values())
        for f, n in wants.items():
            extra = min(left, demand[f, t] - quota[f, t])
            quota[f, t] += extra
            left -= extra
    return {pair: n for pair, n in quota.items() if n}


def _admitted(requests: DataFrame, quota: dict[tuple[int, int], int], texts: int, round_: int) -> DataFrame:
    """The requests that fit their pair's quota, in an order drawn for this round; the last may fit in part."""
    limits = F.create_map(*[F.lit(x) for (f, t), n in sorted(quota.items()) for x in (f"{f}>{t}", n)])
    pair = F.concat_ws(">", "f", "t")
    allowed = requests.withColumn("quota", F.coalesce(limits[pair], F.lit(0))).where("quota > 0")
    spread = allowed.withColumn("draw", F.xxhash64("hub", F.lit(round_))).withColumn("bucket", F.pmod("draw", F.lit(max(1, texts // WIDTH))))
    sums = spread.groupBy("f", "t", "bucket").agg(F.sum("n").alias("_n"))
    before = sums.withColumn("_before", F.sum("_n").over(W.partitionBy("f", "t").orderBy("bucket")) - F.col("_n")).drop("_n")
    own = F.sum("n").over(W.partitionBy("f", "t", "bucket").orderBy("draw", "hub").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")
    placed = spread.join(before, ["f", "t", "bucket"]).withColumn("at", own + F.col("_before"))
    return placed.select("hub", "f", "t", F.least("n", F.col("quota") - F.col("at")).alias("n")).where("n > 0")


def propagate(cells: DataFrame, counts: list[int], rounds: int) -> tuple[DataFrame, list[int]]:
    """Move linked documents until no round moves any; (cells, linked documents of each shard)."""
    shards, texts = len(counts), cells.select("hub").distinct().count()
    for round_ in range(rounds + 1):
        held = {r.shard: r.n for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # one row a shard
        linked = [held.get(t, 0) for t in range(shards)]
        if round_ == rounds or not texts:
            break
        room = [c - n for c, n in zip(counts, linked, strict=True)]
        requests = stored(_requests(cells, room, max(1, min(counts)), round_), "requests")
        demand = {(r.f, r.t): r.n for r in requests.groupBy("f", "t").agg(F.sum("n").alias("n")).collect()}  # at most shards squared rows
        quota = _quotas(demand, room)
        if not quota:
            break
        moves = _admitted(requests, quota, texts, round_)
        change = moves.select("hub", F.explode(F.array(F.struct(F.col("f").alias("shard"), (-F.col("n")).alias("n")), F.struct(F.col("t").alias("shard"), F.col("n").alias("n")))).alias("x")).select("hub", "x.shard", "x.n")
        cells = stored(cells.select("hub", "shard", "n").unionByName(change).groupBy("hub", "shard").agg(F.sum("n").alias("n")).where("n > 0"), "cells")
    return cells, linked


def assign(docs: DataFrame, shards: int = 24, rounds: int = 12, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, text_hash, first_shard (before the propagation), shard, slot of every row."""
    said = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    lean = stored(docs.select(F.col(f"`{key}`").alias("id"), (F.octet_length(said) + 8).cast("long").alias("size"), F.crc32(said).alias("crc"), F.xxhash64(said).alias("hub"),
                              F.monotonically_increasing_id().alias("row")), "lean")
    return _assign(lean, shards, rounds).select(F.col("id").alias(key), "size", F.col("crc").alias("text_crc32"), F.col("hub").alias("text_hash"), "first_shard", "shard", "slot")


def _assign(lean: DataFrame, shards: int, rounds: int) -> DataFrame:
    """``lean`` (row, hub, ...) with rank, first_shard, shard, slot."""
    rows = lean.count()
    counts = [(rows - t + shards - 1) // shards for t in range(shards)]
    order = [F.xxhash64("row", F.lit(7)), F.col("row")]
    drawn = lean.withColumn("bucket", F.pmod(order[0], F.lit(max(1, min(BUCKETS, rows // WIDTH)))))
    ranked = numbered(drawn.withColumn("all", F.lit(0)), ["all"], order, "rank").drop("all", "bucket")
    ranked = stored(ranked.withColumn("first_shard", F.pmod("rank", F.lit(shards)).cast("int")), "ranked")
    start = ranked.groupBy("hub", F.col("first_shard").alias("shard")).agg(F.count("*").alias("n"))
    linked_hubs = start.groupBy("hub").agg(F.sum("n").alias("total")).where("total > 1").select("hub")
    cells, linked = propagate(stored(start.join(linked_hubs, "hub"), "cells"), counts, rounds)

    # Each text's shards as running totals: the document of rank r within its text takes the first that exceeds r.
    runs = _votes(cells).select("hub", F.transform("cells", lambda c, i: F.struct(F.aggregate(F.slice("cells", 1, i + 1), F.lit(0).cast("long"), lambda s, x: s + x["n"]).alias("end"), c["shard"].alias("shard"))).alias("runs"))
    free, ends = 0, []
    for t in range(shards):
        free += counts[t] - linked[t]
        ends.append((free, t))
    singles = F.array(*[F.struct(F.lit(e).cast("long").alias("end"), F.lit(t).alias("shard")) for e, t in ends])
    placed = ranked.join(runs, "hub", "left").withColumns({"bucket": _bucket(F.col("rank"), rows), "group": F.when(F.col("runs").isNull(), F.lit(0)).otherwise(F.col("hub")), "single": F.col("runs").isNull()})
    within = numbered(placed, ["single", "group"], [F.col("rank")], "own")
    pick = F.filter(F.coalesce("runs", singles), lambda r: r["end"] > F.col("own"))
    sharded = within.withColumn("shard", pick[0]["shard"].cast("int")).drop("runs", "group", "single", "own", "bucket")
    return numbered(sharded.withColumn("bucket", _bucket(F.col("rank"), rows)), ["shard"], [F.col("rank")], "slot").drop("bucket")


def write(docs: DataFrame, path: str, shards: int = 24, rounds: int = 12, text: str = "text") -> None:
    """Write whole documents to ``path``, one folder a shard, with their slots; a shard may have many files."""
    held = f"row_{shared_path(docs.sparkSession, 'x').rpartition('-')[2]}"
    kept = stored(docs.withColumn(held, F.monotonically_increasing_id()), "documents")
    said = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    places = _assign(kept.select(F.col(held).alias("row"), F.xxhash64(said).alias("hub")), shards, rounds).select(F.col("row").alias(held), F.col("shard").alias("to_shard"), F.col("slot").alias("to_slot"))
    names = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    kept.join(places, held).select(*[F.col(f"`{c}`") for c in names], F.col("to_shard").alias("shard"), F.col("to_slot").alias("slot")).write.partitionBy("shard").parquet(path)

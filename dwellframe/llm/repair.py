"""Repair of conversation structure: the cheapest edits that give ``(s?(ua)+)?``, by an auction for shortest paths.

A conversation is a lattice: node (i, state) stands for i rows read and the role
written last (none, system, user, assistant); its arcs keep, rerole or delete
row i, or insert an empty turn, at integer costs. ``solve`` runs the auction
algorithm on it: every node has a price, a path grows from the origin along the
arc of least cost plus price, and where the price of its end is below that sum
the price rises and the path contracts. Prices stay a feasible dual, so when the
path reaches the end, all arcs of all shortest paths are tight (price = cost +
price of the head). The trace takes the ASCII-least label among tight arcs that
reach the end.

Faults of a row, first match counts: blank (no character but ASCII white space),
duplicate (role and text seen earlier in the conversation), truncated (its last
character that is not white space is none of ``.!?``). Costs: keep 0, rerole 1,
delete 2 (blank and duplicate rows must go), insert 5, a truncated row that
stays adds 5. Roles count by their initials s, u, a.

How it is spread: equal rows are counted before they move (a row repeated a
million times is one row with a count); rows are dealt by ranges of
(conversation, turn, role, text), so one long conversation lies in many
partitions; a task cuts its sorted rows into segments of at most ``SEGMENT``
rows. Only one byte a row meets in a conversation's task: the segments are solved from the
right, each with the prices that the next one left at its border, and then
traced from the left. Texts meet their edits again by (conversation, segment).

Defined results: null roles and texts are one space; null turns come first;
rows with equal turns are ordered by role, then text; all rows without a
conversation id are one conversation; a role of another initial, or empty, can
only be reroled or deleted; an empty table gives no rows; columns beside the
four are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

SEGMENT = 64
START, SYSTEM, USER, ASSISTANT = range(4)
DELETE, KEEP, REROLE, INSERT, CUT_OFF = 2, 0, 1, 5, 5
#: Turn that may follow a state by insertion or rerole, and the state it leads to.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
FOLLOWS = {b"su", b"ua", b"au"}
SEGMENTS = ("c long, place long, codes binary, roles array<string>, texts array<string>, head string, tail string, "
            "first_turn long, last_turn long, turns long, blank long, duplicate long, truncated long, illegal long")
REPORT = "c long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, pieces array<struct<place: long, state: int, edits: string>>"


def _arcs(code: int, state: int) -> list[tuple[str, int, int]]:
    """(label, state, cost) of the arcs that read a row. Codes: initial of the role (o: other), upper case if truncated, d: must be deleted."""
    found = [("D", state, DELETE)]
    letter = chr(code)
    if letter != "d":
        more = CUT_OFF * letter.isupper()
        keeps = {"s": SYSTEM, "u": USER, "a": ASSISTANT}.get(letter.lower())
        if keeps == NEXT[state] or (keeps == SYSTEM and state == START):
            found.append(("K", keeps, KEEP + more))
        found.append(("R", NEXT[state], REROLE + more))
    return found


_ARCS = {(code, state): _arcs(code, state) for code in b"suaoSUAOd" for state in range(4)}
_LEAST = {code: min(cost for state in range(4) for _, _, cost in _ARCS[code, state]) for code in b"suaoSUAOd"}


def _lattice(codes: bytes, ends: tuple, last: bool) -> list[list[tuple[str, int, int]]]:
    """Arcs (label, head, cost) of every node 4i + state; the end is node 4n + 4. Borders inside a conversation leave insertions to the next segment."""
    n = len(codes)
    out: list[list[tuple[str, int, int]]] = []
    for i in range(n + 1):
        for state in range(4):
            arcs = []
            if i < n:
                arcs = [(label, 4 * i + 4 + to, cost) for label, to, cost in _ARCS[codes[i], state]]
            elif ends[state] is not None:
                arcs = [("", 4 * n + 4, ends[state])]
            if i < n or last:
                arcs.append(("I", 4 * i + NEXT[state], INSERT))
            out.append(arcs)
    return [*out, []]


def _auction(out: list, price: list[int], origin: int, target: int) -> None:
    """Raise ``price`` (a feasible dual) until a path of tight arcs joins ``origin`` with ``target``."""
    path = [origin]
    while (i := path[-1]) != target:
        best, head = min((cost + price[j], j) for _, j, cost in out[i])
        if price[i] < best:
            price[i] = best
            if len(path) > 1:
                path.pop()
        else:
            path.append(head)


@lru_cache(maxsize=1 << 15)
def solve(codes: bytes, ends: tuple, last: bool, origins: tuple = (START, SYSTEM, USER, ASSISTANT)) -> dict[int, tuple[int, str, int]]:
    """For each state before the rows: (cost, edits, state behind them) of the cheapest path, ASCII-least among equals.

    ``ends`` holds what each state behind the rows costs from there on (None: no way).
    """
    n = len(codes)
    out, target = _lattice(codes, ends, last), 4 * n + 4
    price, rest = [0] * (target + 1), min(e for e in ends if e is not None)
    for i in range(n, -1, -1):  # first prices: what the remaining rows cost at least
        rest += _LEAST[codes[i]] if i < n else 0
        price[4 * i:4 * i + 4] = [rest] * 4
    for origin in origins:
        _auction(out, price, origin, target)
    tight = [[(label, j) for label, j, cost in arcs if price[i] == cost + price[j]] for i, arcs in enumerate(out)]
    back: list[list[int]] = [[] for _ in out]
    for i, arcs in enumerate(tight):
        for _, j in arcs:
            back[j].append(i)
    reaches, stack = {target}, [target]
    while stack:
        for i in back[stack.pop()]:
            if i not in reaches:
                reaches.add(i)
                stack.append(i)
    found = {}
    for origin in origins:
        i, edits, behind = origin, [], origin
        while i != target:
            behind = i % 4
            label, i = min(arc for arc in tight[i] if arc[1] in reaches)
            edits.append(label)
        found[origin] = (price[origin], "".join(edits), behind)
    return found


#: What the states behind the last row cost: a conversation ends empty or with an assistant.
_ACCEPT = (0, None, None, 0)


def plan(segments: list[bytes]) -> tuple[int, list[tuple[int, str]]]:
    """Cost, and (state before it, edits) of every segment; edits behind the last row join the last segment's."""
    closing = solve(b"", _ACCEPT, True)
    ends, tables = tuple(closing[s][0] for s in range(4)), []
    for k in range(len(segments) - 1, -1, -1):
        base = min(ends)
        table = solve(segments[k], tuple(e - base for e in ends), False, (START,) if k == 0 else (START, SYSTEM, USER, ASSISTANT))
        tables.append(table)
        cost = table[START][0] + base
        if k:
            ends = tuple(table[s][0] + base for s in range(4))
    state, pieces = START, []
    for table in reversed(tables):
        pieces.append((state, table[state][1]))
        state = table[state][2]
    pieces[-1] = (pieces[-1][0], pieces[-1][1] + closing[state][1])
    return cost, pieces


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut the sorted rows (c, t, role, text, m, blank, repeated, truncated) of a partition into segments."""
    from pyspark import TaskContext

    place = TaskContext.get().partitionId() << 32
    fields = [part.split()[0] for part in SEGMENTS.split(", ")]
    done: list[dict] = []
    now: dict | None = None

    def fresh(c: int | None) -> dict:
        nonlocal place
        place += 1
        return {"c": c, "place": place, "codes": bytearray(), "roles": [], "texts": [], "head": None, "tail": None, "first_turn": None, "last_turn": None,
                "turns": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}

    def flush() -> pa.RecordBatch:
        rows = [s | {"codes": bytes(s["codes"])} for s in done]
        done.clear()
        return pa.RecordBatch.from_pydict({f: pa.array([r[f] for r in rows], _ARROW[f]) for f in fields})

    for batch in batches:
        for k in range(batch.num_rows):
            c, t, role, text, m, blank, repeated, cut = (batch.column(i)[k].as_py() for i in range(8))
            copy = 0
            while copy < m:
                if now is None or now["c"] != c or len(now["codes"]) >= SEGMENT:
                    if now is not None:
                        done.append(now)
                    now = fresh(c)
                room = 1 if copy == 0 else min(m - copy, SEGMENT - len(now["codes"]))
                initial = role[:1]
                pair = (now["tail"] or "") + initial
                now["illegal"] += (now["tail"] is not None and pair.encode() not in FOLLOWS) + room - 1
                now["head"], now["tail"] = initial if now["head"] is None else now["head"], initial
                if t is not None and t != now["last_turn"]:
                    now["turns"] += 1
                    now["first_turn"] = t if now["first_turn"] is None else now["first_turn"]
                    now["last_turn"] = t
                if blank or repeated or copy:
                    now["blank" if blank else "duplicate"] += room
                    now["codes"] += b"d" * room
                else:
                    letter = initial if initial in ("s", "u", "a") else "o"
                    now["truncated"] += cut
                    now["codes"] += (letter.upper() if cut else letter).encode()
                    now["roles"].append(role)
                    now["texts"].append(text)
                copy += room
            if len(done) >= 256:
                yield flush()
    if now is not None:
        done.append(now)
        yield flush()


_ARROW = {"c": pa.int64(), "place": pa.int64(), "codes": pa.binary(), "roles": pa.list_(pa.string()), "texts": pa.list_(pa.string()), "head": pa.string(), "tail": pa.string(),
          **dict.fromkeys(("first_turn", "last_turn", "turns", "blank", "duplicate", "truncated", "illegal"), pa.int64())}


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Solve whole conversations from the codes of their segments."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            parts = sorted(row["parts"], key=lambda p: p["place"])
            illegal, turns, last = row["illegal"], row["turns"], None
            for a, b in zip(parts, parts[1:], strict=False):
                illegal += (a["tail"] + b["head"]).encode() not in FOLLOWS
            for p in parts:  # a turn on both sides of a border counts once
                turns -= p["first_turn"] is not None and p["first_turn"] == last
                last = p["last_turn"] if p["last_turn"] is not None else last
            gaps = 0 if row["least"] is None else row["most"] - row["least"] + 1 - turns
            cost, pieces = plan([p["codes"] for p in parts])
            yield pa.RecordBatch.from_pydict({
                "c": pa.array([row["c"]], pa.int64()), **{name: pa.array([value], pa.int64()) for name, value in (
                    ("gaps", gaps), ("blank", row["blank"]), ("duplicate", row["duplicate"]), ("truncated", row["truncated"]), ("illegal", illegal), ("cost", cost))},
                "audit": pa.array(["".join(e for _, e in pieces)], pa.string()),
                "pieces": pa.array([[{"place": p["place"], "state": s, "edits": e} for p, (s, e) in zip(parts, pieces, strict=True)]],
                                   pa.list_(pa.struct([("place", pa.int64()), ("state", pa.int32()), ("edits", pa.string())])))})


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edit the rows of segments (c, place, codes, roles, texts, state, edits)."""
    for batch in batches:
        rows: list[tuple] = []
        for k in range(batch.num_rows):
            c, place, codes, roles, texts, state, edits = (batch.column(i)[k].as_py() for i in range(7))
            own, at = iter(zip(roles, texts, strict=True)), 0
            for pos, edit in enumerate(edits):
                if edit == "I":
                    state = NEXT[state]
                    rows.append((c, place, pos, ROLE[state], ""))
                    continue
                role, text = (None, None) if codes[at] == ord("d") else next(own)
                at += 1
                if edit == "K":
                    state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
                elif edit == "R":
                    state = NEXT[state]
                    role = ROLE[state]
                if edit != "D":
                    rows.append((c, place, pos, role, text))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string()), strict=True)],
                                         names=["c", "place", "pos", "role", "text"])


def segments(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The table of segments, written to the shared folder: all later steps read it."""
    named = [F.col(f"`{conv}`").cast("long").alias("c"), F.col(f"`{turn}`").cast("long").alias("t"),
             *[F.coalesce(F.col(f"`{name}`"), F.lit(" ")).alias(as_) for name, as_ in ((role, "role"), (text, "text"))]]
    rows = turns.select(*named)
    digest = F.sha2(F.col("text").cast("binary"), 256).alias("d")
    counted = rows.groupBy("c", "t", "role", "text").agg(F.count("*").alias("m")).select("*", digest)
    # Role and text at more than one turn: the first of these turns (nulls first).
    seen = (rows.select("c", "t", F.col("role").alias("r2"), digest).groupBy(F.col("c").alias("c2"), "r2", F.col("d").alias("d2"))
            .agg(F.min(F.struct(F.col("t").isNotNull().alias("known"), "t")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    flagged = counted.join(seen, F.col("c").eqNullSafe(F.col("c2")) & (F.col("role") == F.col("r2")) & (F.col("d") == F.col("d2")), "left").select(
        "c", "t", "role", "text", "m",
        (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"),
        F.coalesce(F.col("first").isNotNull() & ~F.col("first.t").eqNullSafe(F.col("t")), F.lit(False)).alias("repeated"),
        (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("cut"))
    # Ranges are found on the first characters; whole texts decide within a partition.
    order: list[Column] = [F.asc_nulls_first("c"), F.asc_nulls_first("t"), F.asc("role")]
    dealt = flagged.repartitionByRange(*order, F.asc(F.substring("text", 1, 64))).sortWithinPartitions(*order, F.asc("text"))
    return stored(dealt.mapInArrow(_segments, SEGMENTS), "segments")


def repair(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(report, turns): faults, cost and audit of every conversation; and its repaired turns: conv_id, place, pos (their order), role, text."""
    parts = segments(turns, conv, turn, role, text)
    lean = F.struct("place", "codes", "head", "tail", "first_turn", "last_turn")
    # A number of partitions of its own: the codes are few bytes but each conversation is work, which sizes do not show.
    tasks = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grouped = parts.select("c", "place", "codes", "head", "tail", "first_turn", "last_turn", "turns", "blank", "duplicate", "truncated", "illegal").repartition(tasks, "c").groupBy("c").agg(F.collect_list(lean).alias("parts"), *[F.sum(x).alias(x) for x in ("turns", "blank", "duplicate", "truncated", "illegal")],
                                     F.min("first_turn").alias("least"), F.max("last_turn").alias("most"))
    decided = stored(grouped.mapInArrow(_decide, REPORT), "repairs")
    report = decided.select(F.col("c").alias(conv), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    edits = decided.select(F.explode("pieces").alias("p")).select(F.col("p.place").alias("at"), F.col("p.state").alias("state"), F.col("p.edits").alias("edits"))
    edited = (parts.join(edits, F.col("place") == F.col("at")).select("c", "place", "codes", "roles", "texts", "state", "edits")
              .mapInArrow(_apply, "c long, place long, pos int, role string, text string"))
    return report, edited.withColumnRenamed("c", conv)


def digests(turns: DataFrame, conv: str = "conv_id") -> DataFrame:
    """SHA-256 of every conversation's ``role:text`` lines, newline-joined, streamed in order: a task holds one row at a time."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, out = None, None, []

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], pa.int64()), pa.array([h for _, h in out], pa.string())], names=["c", "repaired_sha256"])
            out.clear()
            return batch

        for batch in batches:
            for k in range(batch.num_rows):
                c, role, text = (batch.column(i)[k].as_py() for i in (0, 3, 4))
                if state is None or c != now:
                    if state is not None:
                        out.append((now, state.hexdigest()))
                    now, state = c, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            if len(out) >= 4096:
                yield flush()
        if state is not None:
            out.append((now, state.hexdigest()))
            yield flush()

    rows = turns.select(F.col(f"`{conv}`").alias("c"), "place", "pos", "role", "text")
    return rows.repartition("c").sortWithinPartitions("c", "place", "pos").mapInArrow(stream, "c long, repaired_sha256 string").withColumnRenamed("c", conv)


def damage(turns: DataFrame) -> DataFrame:
    """Conversations with planted faults, chosen by crc32 of ``conv_id:turn`` modulo 20 (nulls: one space)."""
    keyed = F.concat_ws(":", *[F.coalesce(F.col(x).cast("string"), F.lit(" ")) for x in ("conv_id", "turn")])
    z = F.crc32(keyed.cast("binary")) % 20
    said, role = F.coalesce(F.col("text"), F.lit(" ")), F.coalesce(F.col("role"), F.lit(" "))
    text = F.when(z == 1, F.lit("")).when(z == 2, F.regexp_replace(said, "[.!?]", "")).otherwise(said)
    copies = F.when(z == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return turns.where(z != 0).select("conv_id", "turn", F.when(z == 4, F.lit("user")).otherwise(role).alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")

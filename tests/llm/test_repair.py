import hashlib
import random

from dwellframe.llm import repair
from dwellframe.llm.queries import op12_conversation_repair
from pyspark.sql import functions as F

from .helpers import SF

SCHEMA = "conv_id long, turn long, role string, text string, audit string, place long, c long"


def cheapest(codes):
    """(cost, edits) by trying every way from the last row to the first."""

    def with_inserts(ways):
        for _ in range(3):
            for state, to in repair.NEXT.items():
                if to in ways:
                    way = (ways[to][0] + 5, "I" + ways[to][1])
                    ways[state] = min(ways.get(state, way), way)
        return ways

    best = with_inserts({repair.START: (0, ""), repair.ASSISTANT: (0, "")})
    for code in reversed(codes):
        ways = {}
        for state in range(4):
            letter = chr(code)
            options = [(2, "D", state)]
            if letter != "d":
                more = 5 if letter.isupper() else 0
                after = {0: "su", 1: "u", 2: "a", 3: "u"}[state]
                if letter.lower() in after:
                    options.append((more, "K", "?sua".index(letter.lower())))
                options.append((more + 1, "R", {0: 2, 1: 2, 2: 3, 3: 2}[state]))
            ways[state] = min((cost + best[to][0], label + best[to][1]) for cost, label, to in options)
        best = with_inserts(ways)
    return best[repair.START]


def plain(rows):
    """Report and repaired text of each conversation of damaged rows (conv, turn, role, text)."""
    out = {}
    for c in {r[0] for r in rows}:
        own = sorted(((t is not None, t or 0, " " if r is None else r, " " if x is None else x) for k, t, r, x in rows if k == c))
        seen, codes, counts, illegal = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}, 0
        for k, (_, _, role, text) in enumerate(own):
            body = text.strip(" \t\n\v\f\r")
            initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            codes.append("d" if fault in ("blank", "duplicate") else initial.upper() if fault else initial)
            illegal += k > 0 and own[k - 1][2][:1] + role[:1] not in ("su", "ua", "au")
        cost, audit = cheapest("".join(codes).encode())
        lines, place, state = [], 0, 0
        for edit in audit:
            if edit == "I":
                state = repair.NEXT[state]
                lines.append(repair.ROLE[state] + ":")
                continue
            role, text = own[place][2:]
            place += 1
            if edit == "R":
                state = repair.NEXT[state]
                role = repair.ROLE[state]
            elif edit == "K":
                state = "?sua".index(role[0])
            if edit != "D":
                lines.append(f"{role}:{text}")
        turns = [t for known, t, *_ in own if known]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[c] = (gaps, *counts.values(), illegal, cost, audit, "\n".join(lines))
    return out


def repaired(spark, rows):
    turns = spark.createDataFrame([(*r, "x", 0, 9) for r in rows], SCHEMA)
    report, texts = repair.repair(turns)
    said = {}
    for r in sorted(texts.collect(), key=lambda r: (r.place, r.pos)):
        said.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    found = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, "\n".join(said.get(r.conv_id, []))) for r in report.collect()}
    digests = {r.conv_id: r.repaired_sha256 for r in repair.digests(texts).collect()}
    assert digests == {c: hashlib.sha256("\n".join(lines).encode()).hexdigest() for c, lines in said.items()}
    return found


def test_auction_finds_the_least_of_all_ways():
    rng = random.Random(5)
    for _ in range(1500):
        codes = bytes(rng.choice(b"suaoSUAOduaua") for _ in range(rng.choice([1, 2, 3, 5, 9, 20])))
        size = rng.choice([1, 3, 64])
        cost, pieces = repair.plan([codes[k:k + size] for k in range(0, len(codes), size)])
        assert (cost, "".join(e for _, e in pieces)) == cheapest(codes)


def test_prices_are_a_dual():
    codes = b"uUsoaAdu"
    out = repair._lattice(codes, (0, 10, 5, 0), False)
    price = [0] * len(out)
    repair._auction(out, price, 0, len(out) - 1)
    assert all(price[i] <= cost + price[j] for i, arcs in enumerate(out) for _, j, cost in arcs)
    assert price[0] == repair.solve(codes, (0, 10, 5, 0), False)[0][0]


def test_odd_rows(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Hi."), (1, 2, "assistant", "cut off"), (1, 9, "assistant", "Done. \n"), (2, None, None, None), (2, 1, "", "A."), (2, 1, "tool", "B!"),
            (None, 1, "user", "q?"), (None, None, "assistant", "a."), (3, 5, "assistant", ""), (4, 1, "user", "x."), (4, 1, "user", "x."), (4, 1, "user", "x."), (4, None, "system", "s."),
            (5, 1, "user", "wo.\u0085"), (5, 2, "assistant", "a. " * 40_000), (6, 1, "assistant", "b."), (6, 1, "assistant", "a."), (6, 1, "user", " .")]
    assert repaired(spark, rows) == plain(rows)


def test_empty_table(spark):
    assert repaired(spark, []) == {}


def test_one_conversation_holds_most_rows(spark):
    rng = random.Random(3)
    rows = [(7, t, rng.choice(["user", "assistant", "system", "x"]), rng.choice(["Yes.", "No", f"Turn {t}.", f"{t}", " "])) for t in range(700)]
    rows += [(7, 13, "user", "again.")] * 300 + [(c, 1, "user", "q.") for c in range(100, 140)]
    assert repaired(spark, rows) == plain(rows)


def test_query_against_plain_damage(spark):
    import zlib

    rows = []
    source = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    for r in source:
        z = zlib.crc32(f"{r.conv_id}:{r.turn}".encode()) % 20
        text = "" if z == 1 else "".join(x for x in r.text if x not in ".!?") if z == 2 else r.text
        rows += [(r.conv_id, r.turn, "user" if z == 4 else r.role, text)] * (0 if z == 0 else 2 if z == 3 else 1)
    want = plain(rows)
    none = (0, 0, 0, 0, 0, 0, "", "")
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in op12_conversation_repair(spark, SF).collect()}
    assert got == {c: (*(w := want.get(c, none))[:7], hashlib.sha256(w[7].encode()).hexdigest()) for c in {r.conv_id for r in source}}


def test_damage_of_nulls(spark):
    turns = spark.createDataFrame([(None, None, None, None)] + [(1, t, "assistant", None) for t in range(60)], "conv_id long, turn long, role string, text string")
    got = repair.damage(turns)
    assert got.where("role is null or text is null").count() == 0 and got.select(F.count_distinct("role")).first()[0] >= 2

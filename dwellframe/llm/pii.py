"""Format-preserving pseudonyms for personal data (DataFrame functions only).

One pattern finds candidates; a candidate that proves valid is replaced by a
keyed permutation of its value within its format, anything else stays:

    card    13 to 19 digits, four groups of four, or groups of 4, 6 and 5, with a valid Luhn digit: all other digits are permuted, the Luhn digit is made anew
    date    year-month-day, or day and month with slashes or dots before the year (one or two digits each; month first only where no
            day-first date fits), of the years 1800 to 2199: the day is permuted among the 146,097 days of these 400 years and printed in the same order
    ssn     ddd-dd-dddd of an issued range: permuted among the issued ranges
    ip      four numbers up to 255: permuted among the 2^32 addresses
    phone   ten digits, grouped, with or without country code: the ten digits are permuted; other numbers with a plus sign and country code,
            grouped, of 8 to 15 digits: those behind the code are permuted
    email   letters and digits of the part before the at sign are permuted, each within its kind
    token   32 or more hexadecimal digits of one case: permuted, alike in both cases

Permutations are Feistel networks of ``ROUNDS`` rounds whose round function is
SHA-512 (or SHA-256) of key, kind, round and the other half. They are one to one
for each kind, so equal values have equal pseudonyms in all documents, however
they are grouped, and different values have different ones. A pseudonym can be
permuted back by whoever has the key (a month-first date's may read like a
day-first one). The key is part of the query plan: keep
plans and event logs as secret as the key.

Defined results: a null text stays null, an empty one empty; a text without
valid values is unchanged; repeated rows and values are treated alike; input
columns named like an output column are replaced.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import others

ROUNDS = 10
# Digit groups of the formats.
DIGITS, LOWER, UPPER, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
TOKEN = r"(?<![A-Za-z0-9])(?:(?=[0-9a-f]*[a-f])[0-9a-f]{32,}|(?=[0-9A-F]*[A-F])[0-9A-F]{32,})(?![A-Za-z0-9])"
IP = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
ISO_DATE = r"(?<![0-9-])(?:1[89]|2[01])[0-9]{2}-[0-9]{2}-[0-9]{2}(?![0-9-])"
DAY_DATE = r"(?<![0-9/])[0-9]{1,2}/[0-9]{1,2}/(?:1[89]|2[01])[0-9]{2}(?![0-9/])"
DOT_DATE = r"(?<![0-9.])[0-9]{1,2}\.[0-9]{1,2}\.(?:1[89]|2[01])[0-9]{2}(?![0-9]|\.[0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
PHONE = r"(?<![0-9])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"
ABROAD = r"(?<![0-9+])\+(?=(?:[ .-]?[0-9]){8,15}(?![ .-]?[0-9]))[1-9][0-9]{0,2}(?:[ .-][0-9]{1,12}){1,6}(?![0-9])"
CARD = r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4} [0-9]{4} [0-9]{4} [0-9]{4}|[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{4}|[0-9]{4}[ ][0-9]{6}[ ][0-9]{5}|[0-9]{4}-[0-9]{6}-[0-9]{5})(?![0-9])"
KINDS = (("email", EMAIL), ("token", TOKEN), ("ip", IP), ("date", f"{ISO_DATE}|{DAY_DATE}|{DOT_DATE}"), ("ssn", SSN), ("card", CARD), ("phone", f"{PHONE}|{ABROAD}"))
PATTERN = "|".join(p for _, p in KINDS)
FIRST_DAY, DAYS = "1800-01-01", (189, 773)


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _chars(s: Column) -> Column:
    return F.when(F.char_length(s) > 0, F.transform(F.sequence(F.lit(1), F.char_length(s)), lambda i: s.substr(i, F.lit(1)))).otherwise(F.expr("cast(array() as array<string>)"))


def _shifted(half: Column, stream: Column, alphabets: tuple[str, ...]) -> Column:
    """Every character moved on within its alphabet, by four hexadecimal digits of the stream for each."""

    def move(c: Column, i: Column) -> Column:
        by = F.conv(stream.substr(4 * i + 1, F.lit(4)), 16, 10).cast("int")
        out = c
        for a in alphabets:
            at = F.position(c, F.lit(a))
            out = F.when(at > 0, F.lit(a).substr((F.pmod(at - 1 + by, F.lit(len(a))) + 1).cast("int"), F.lit(1))).otherwise(out)
        return out

    return F.array_join(F.transform(_chars(half), move), "")


def permute_text(value: Column, kind: str, key: str, alphabets: tuple[str, ...] = (DIGITS, LOWER, UPPER)) -> Column:
    """Permutation of all strings with this pattern of alphabets; other characters stay where they are."""

    def step(acc: Column, r: Column) -> Column:
        stream = F.array_join(F.transform(F.sequence(F.lit(0), F.floor(F.char_length(acc.a) / 32).cast("int")),
                                          lambda j: F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), r, j, acc.b), 512)), "")
        return F.struct(acc.b.alias("a"), let(stream, lambda s: _shifted(acc.a, s, alphabets)).alias("b"))

    half = F.floor(F.char_length(value) / 2).cast("int")
    start = F.struct(value.substr(F.lit(1), half).alias("a"), value.substr(half + 1, F.char_length(value)).alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda acc: F.concat(acc.a, acc.b))


def permute_pair(a: Column, b: Column, m: int, n: int, kind: str, key: str) -> Column:
    """Permutation of the pairs (a, b) with a below m and b below n."""

    def step(acc: Column, r: Column) -> Column:
        by = lambda x: F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), r, x), 256), 1, 15), 16, 10).cast("long")
        return F.when(r % 2 == 1, F.struct(F.pmod(acc.a + by(acc.b), F.lit(m)).cast("long").alias("a"), acc.b.alias("b"))).otherwise(
            F.struct(acc.a.alias("a"), F.pmod(acc.b + by(acc.a), F.lit(n)).cast("long").alias("b")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), step)


def luhn_sum(digits: Column, doubled: int) -> Column:
    """Luhn sum, where digits at places of parity ``doubled`` from the right (0 first) count double."""
    each = F.transform(_chars(F.reverse(digits)), lambda c, i: let(c.cast("int") * F.when(i % 2 == doubled, 2).otherwise(1), lambda d: F.when(d > 9, d - 9).otherwise(d)))
    return F.aggregate(each, F.lit(0), lambda a, d: a + d)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _card(m: Column, key: str) -> Column:
    def new(d: Column) -> Column:
        body = permute_text(d.substr(F.lit(1), F.char_length(d) - 1), "card", key, (DIGITS,))
        made = let(body, lambda p: F.concat(p, F.pmod(10 - luhn_sum(p, 0) % 10, F.lit(10)).cast("string")))
        sep = m.substr(F.lit(5), F.lit(1))
        four = lambda p, k: p.substr(F.lit(k), F.lit(4))
        grouped = lambda p: F.concat(four(p, 1), sep, four(p, 5), sep, four(p, 9), sep, four(p, 13))
        three = lambda p: F.concat(four(p, 1), sep, p.substr(F.lit(5), F.lit(6)), sep, p.substr(F.lit(11), F.lit(5)))
        shown = lambda p: F.when(m.rlike("^[0-9]+$"), p).when(F.char_length(p) == 15, three(p)).otherwise(grouped(p))
        return F.when(luhn_sum(d, 1) % 10 == 0, let(made, shown))

    return let(_digits(m), new)


def _date(m: Column, key: str) -> Column:
    def new(form: str) -> Column:
        def moved(i: Column) -> Column:
            pair = permute_pair(F.floor(i / DAYS[1]), F.pmod(i, F.lit(DAYS[1])), *DAYS, "date", key)
            return let(pair, lambda p: F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), (p.a * DAYS[1] + p.b).cast("int")), form))

        return let(F.datediff(F.try_to_date(m, form), F.lit(FIRST_DAY).cast("date")), lambda i: F.when(i.isNotNull(), moved(i)))

    def by_length(day: str, month: str, sep: str) -> Column:
        """Two digits where all have two, else as many as they need."""
        return F.when(m.rlike(r"^[0-9]{2}.[0-9]{2}.[0-9]{4}$"), new(f"{day * 2}{sep}{month * 2}{sep}yyyy")).otherwise(new(f"{day}{sep}{month}{sep}yyyy"))

    return F.when(m.contains("-"), new("yyyy-MM-dd")).when(m.contains("/"), F.coalesce(by_length("d", "M", "/"), by_length("M", "d", "/"))).otherwise(by_length("d", "M", "."))


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (m.substr(F.lit(a), F.lit(n)).cast("int") for a, n in ((1, 3), (5, 2), (8, 4)))
    rank = F.when(area > 666, area - 2).otherwise(area - 1)
    pair = permute_pair(rank * 99 + group - 1, serial - 1, 898 * 99, 9999, "ssn", key)

    def shown(p: Column) -> Column:
        r = F.floor(p.a / 99)
        pad = lambda x, n: F.lpad(x.cast("int").cast("string"), n, "0")
        return F.concat_ws("-", pad(F.when(r >= 665, r + 2).otherwise(r + 1), 3), pad(F.pmod(p.a, F.lit(99)) + 1, 2), pad(p.b + 1, 4))

    return F.when((area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0), let(pair, shown))


def _ip(m: Column, key: str) -> Column:
    def new(o: Column) -> Column:
        n = lambda k: F.get(o, F.lit(k)).cast("int")
        pair = permute_pair(n(0) * 256 + n(1), n(2) * 256 + n(3), 65536, 65536, "ip", key)
        shown = lambda p: F.concat_ws(".", F.floor(p.a / 256).cast("string"), F.pmod(p.a, F.lit(256)).cast("string"), F.floor(p.b / 256).cast("string"), F.pmod(p.b, F.lit(256)).cast("string"))
        return F.when(F.forall(o, lambda x: (x.cast("int") < 256) & ~x.rlike("^0.")), let(pair, shown))

    return let(F.split(m, r"\."), new)


def _phone(m: Column, key: str) -> Column:
    def new(d: Column) -> Column:
        """The last ten digits, or those behind the country code, permuted and put in the old places."""
        code = F.char_length(F.regexp_extract(m, r"^\+([0-9]+)", 1))
        kept = F.when(m.rlike(f"^(?:{PHONE})$"), F.char_length(d) - 10).otherwise(code)

        def filled(p: Column) -> Column:
            def place(c: Column, i: Column) -> Column:
                at = F.char_length(_digits(m.substr(F.lit(1), i + 1))) - kept
                return F.when(c.rlike("[0-9]") & (at > 0), p.substr(at, F.lit(1))).otherwise(c)

            return F.array_join(F.transform(_chars(m), place), "")

        return let(permute_text(d.substr(kept + 1, F.char_length(d)), "phone", key, (DIGITS,)), filled)

    return let(_digits(m), new)


def _token(m: Column, key: str) -> Column:
    made = permute_text(F.lower(m), "token", key, (HEX,))
    return F.when(m.rlike("[A-F]"), F.upper(made)).otherwise(made)


def _email(m: Column, key: str) -> Column:
    return F.concat(permute_text(F.substring_index(m, "@", 1), "email", key), F.lit("@"), F.substring_index(m, "@", -1))


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of one candidate; null if it is not valid."""
    made = {"email": _email, "token": _token, "ip": _ip, "date": _date, "ssn": _ssn, "card": _card, "phone": _phone}
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(KINDS):
        out = F.when(m.rlike(f"^(?:{pattern})$"), made[kind](m, key)).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with valid values replaced in ``text``; pseudonyms (array, in order) and n_values."""
    names = ("pseudonyms", "n_values")
    kept = others(docs, names)
    body = F.col(f"`{text}`")
    part, new = (f"{name}_{uuid.uuid4().hex}" for name in ("parts", "made"))
    may = body.rlike("[0-9@]|[a-f]{32}|[A-F]{32}")  # most texts hold no candidate
    parts = docs.select(*kept, F.struct(F.when(may, F.split(body, PATTERN)).otherwise(F.array(body)).alias("pieces"),
                                        F.when(may, F.regexp_extract_all(body, F.lit(PATTERN), F.lit(0))).otherwise(F.expr("cast(array() as array<string>)")).alias("found")).alias(part))
    made = parts.select(*kept, part, F.transform(F.col(part)["found"], lambda m: pseudonym(m, key)).alias(new))
    said = F.zip_with(F.col(part)["found"], new, lambda m, p: F.coalesce(p, m))
    whole = F.array_join(F.zip_with(F.col(part)["pieces"], F.concat(said, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    shown = [F.when(body.isNull(), None).otherwise(whole).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns if c.lower() not in names]
    valid = F.filter(new, lambda p: p.isNotNull())
    return made.select(*shown, valid.alias("pseudonyms"), F.size(valid).alias("n_values"))

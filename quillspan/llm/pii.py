"""Format-preserving Feistel pseudonyms for personal data, in Spark's built-in functions alone.

A value found in a text is checked (Luhn sum, octets up to 255, calendar, numbering
plan) and, if valid, replaced by the image of a keyed permutation of its format's own
domain: a card number gives a valid card number, a date a date. The permutation depends
on the key and the kind only, so equal values stay linked across documents, no two
values meet in one, and whoever has the key can undo it. Separators stay where they are.

A number below a * b is held as two digits, of radix a and of radix b; each round adds to
one a keyed hash of the other. Text (the local part of an address, a key) is
held as two halves; letters and digits shift within a-z, A-Z and 0-9, by a keyed hash of the other half
and the number of the block that they are in, so no part of the key stream comes twice. A text of one letter has an
empty other half: all such are shifted alike.

Kinds: card numbers of 13 to 19 digits (first digit kept, check digit recomputed), IPv4
addresses, North American phone and social security numbers, dates from 1900 to 2099
(yyyy-mm-dd, yyyy/mm/dd, dd.mm.yyyy; also in front of T and a time), e-mail addresses
(domain kept), access keys and the values of any length of token, password, secret and
api_key assignments in any case. Numbers that fail their
check are left alone, but for phone numbers marked as such by +1 or brackets: those with
a code that can't be assigned are permuted among their like.

Nothing is shuffled. The patterns look at each character a bounded number of times, so
very long texts and words take time in proportion.

Cases: a null text stays null, an empty one empty, both with nothing replaced. Repeated
rows give equal results. An empty table gives an empty result. All other columns are
kept; input columns named like the count column are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import LOWER, UPPER, fresh
from quillspan.sources.tables import read_table

ROUNDS = 8
#: Characters of a text that one hash moves.
BLOCK = 31
DIGITS = "0123456789"

# Formats. Each begins at a character that is checked first, and has bounded or possessive repeats.
_CARD = r"\d{13,19}|\d{4} \d{4} \d{4} \d{4}|\d{4}-\d{4}-\d{4}-\d{4}"
_PHONE = r"(?:\+1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}"
_IP = r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"
_SSN = r"\d{3}-\d{2}-\d{4}"
_DATE = r"\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}\.\d{2}\.\d{4}"
_NUMBER = rf"(?:{_CARD}|{_PHONE}|{_IP}|{_SSN}|{_DATE})(?![0-9A-Za-z_])(?![.-][0-9])"
NUMBERS = rf"(?=[0-9+(])(?<![0-9A-Za-z_+])(?<![0-9][.-])(?:{_NUMBER}|(?:{_DATE})(?=T[0-9]))"
EMAILS = (
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+){0,8}?\.[A-Za-z]{2,24}(?![A-Za-z0-9-])"
)
_SECRET_WORDS = r"(?i:token|password|secret|api_key)"
SECRETS = rf"\bAKIA[A-Z0-9]{{16}}\b|\b{_SECRET_WORDS}[ \t]*+[=:][ \t]*+[\"']?[A-Za-z0-9+/_-]{{8,}}+"
_SECRET_PREFIX = rf"^((?:{_SECRET_WORDS}[ \t]*+[=:][ \t]*+[\"']?)?)"
_FIRST_DAY, _DAYS = "1900-01-01", 365 * 200


def _hash(*parts: Column | str | int) -> Column:
    """60 bits of a keyed hash."""
    joined = F.concat_ws("|", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts))
    return F.conv(F.substring(F.sha2(joined, 256), 1, 15), 16, 10).cast("long")


def _rounds(undo: bool) -> Column:
    return F.array(*(F.lit(i) for i in (reversed(range(ROUNDS)) if undo else range(ROUNDS))))


def permute(x: Column, a: Column, b: Column, key: str, kind: str | Column, undo: bool = False) -> Column:
    """Keyed permutation of the numbers below a * b."""
    sign = -1 if undo else 1

    def step(pair: Column, i: Column) -> Column:
        left, right = pair["left"], pair["right"]
        even = i % 2 == 0
        moved = F.when(even, F.pmod(left + sign * F.pmod(_hash(key, kind, i, right), a), a)).otherwise(
            F.pmod(right + sign * F.pmod(_hash(key, kind, i, left), b), b)
        )
        return F.struct(F.when(even, moved).otherwise(left).alias("left"), F.when(even, right).otherwise(moved).alias("right"))

    start = F.struct(F.call_function("div", x, b).alias("left"), (x % b).alias("right"))
    return F.reduce(_rounds(undo), start, step, lambda pair: pair["left"] * b + pair["right"])


def _shift_block(block: Column, by: Column, sign: int) -> Column:
    """Move each letter and digit of up to ``BLOCK`` characters within its own alphabet by the hexadecimal digits of ``by``."""

    def moved(c: Column, i: Column) -> Column:
        amount = F.conv(F.substr(by, i * 2 + 1, F.lit(2)), 16, 10).cast("int")
        out = c
        for alphabet in (DIGITS, LOWER, UPPER):
            at = F.instr(F.lit(alphabet), c)
            turned = F.substr(F.lit(alphabet), F.pmod(at - 1 + sign * amount, F.lit(len(alphabet))).cast("int") + 1, F.lit(1))
            out = F.when((at > 0) & (c != ""), turned).otherwise(out)
        return out

    return F.array_join(F.transform(F.split(block, ""), moved), "")


def _shift(half: Column, stream: Column, sign: int) -> Column:
    """Move the characters of ``half`` by a key stream in counter mode: each block's is a hash of ``stream`` and its number."""

    def in_blocks(s: Column) -> Column:
        blocks = F.regexp_extract_all(half, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
        by = lambda i: F.sha2(F.concat_ws("|", s, i.cast("string")), 256)
        moved = lambda block, i: F.transform(F.array(by(i)), lambda h: _shift_block(block, h, sign))[0]
        return F.array_join(F.transform(blocks, moved), "")

    return F.transform(F.array(stream), in_blocks)[0]


def permute_text(text: Column, key: str, kind: str, undo: bool = False) -> Column:
    """Keyed permutation of the texts with the same classes of character at the same places."""
    sign = -1 if undo else 1

    def step(pair: Column, i: Column) -> Column:
        left, right = pair["left"], pair["right"]
        even = i % 2 == 0
        stream = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), F.when(even, right).otherwise(left)), 256)
        moved = _shift(F.when(even, left).otherwise(right), stream, sign)
        return F.struct(F.when(even, moved).otherwise(left).alias("left"), F.when(even, right).otherwise(moved).alias("right"))

    middle = F.call_function("div", F.length(text), F.lit(2)).cast("int")
    start = F.struct(F.substr(text, F.lit(1), middle).alias("left"), F.substr(text, middle + 1, F.length(text)).alias("right"))
    return F.reduce(_rounds(undo), start, step, lambda pair: F.concat(pair["left"], pair["right"]))


def _digit_sum(digits: Column, doubled_from_right: int) -> Column:
    """Luhn sum of a string of digits; ``doubled_from_right`` is 0 if the last digit counts double, 1 if the one before."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        digit = F.substr(digits, i, F.lit(1)).cast("int")
        double = digit * 2 - F.when(digit > 4, 9).otherwise(0)
        return total + F.when((n - i) % 2 == doubled_from_right, double).otherwise(digit)

    return F.reduce(F.sequence(F.lit(1), n), F.lit(0), add)


def _refill(template: Column, digits: Column) -> Column:
    """``template`` with its digits replaced in order."""

    def put(state: Column, c: Column) -> Column:
        is_digit = (c != "") & (F.instr(F.lit(DIGITS), c) > 0)
        out = F.concat(state["out"], F.when(is_digit, F.substr(digits, state["next"], F.lit(1))).otherwise(c))
        return F.struct(out.alias("out"), (state["next"] + is_digit.cast("int")).alias("next"))

    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("next"))
    return F.reduce(F.split(template, ""), start, put, lambda state: state["out"])


def _padded(x: Column, width: Column | int) -> Column:
    return F.lpad(x.cast("string"), width, "0")


def _number(text: Column, start: int, width: int) -> Column:
    return F.substr(text, F.lit(start), F.lit(width)).cast("long")


def _card(m: Column, key: str, undo: bool) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    n = F.length(digits)
    half = F.call_function("div", n - 2, F.lit(2))
    power = lambda k: F.pow(F.lit(10.0), k).cast("long")  # noqa: E731  exact up to 10 ** 15
    body = permute(F.substr(digits, F.lit(2), n - 2).cast("long"), power(n - 2 - half), power(half), key, "card", undo)
    front = F.concat(F.substr(digits, F.lit(1), F.lit(1)), _padded(body, n - 2))
    check = F.pmod(10 - _digit_sum(front, 0) % 10, F.lit(10))
    valid = (_digit_sum(digits, 1) % 10 == 0) & (F.regexp_replace(digits, "0", "") != "")
    return F.when(valid, _refill(m, F.concat(front, check.cast("string")))).otherwise(m)


def _phone(m: Column, key: str, undo: bool) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    last = F.substr(digits, F.length(digits) - 9, F.lit(10))
    area, exchange, line = _number(last, 1, 3), _number(last, 4, 3), _number(last, 7, 4)
    # Three closed domains: assignable numbers, area codes below 200, and exchanges below 200.
    pick = lambda *of_kind: F.when((area >= 200) & (exchange >= 200), of_kind[0]).when(area < 200, of_kind[1]).otherwise(of_kind[2])
    long = lambda n: F.lit(n).cast("long")
    a, b = pick(long(80_000), long(50_000), long(40_000)), pick(long(80_000), long(40_000), long(40_000))
    place = pick((area - 200) * 800 + exchange - 200, area * 1000 + exchange, (area - 200) * 200 + exchange)
    x = permute(place * 10_000 + line, a, b, key, pick(F.lit("phone"), F.lit("phone area"), F.lit("phone exchange")), undo)

    def written(v: Column) -> Column:
        front = F.call_function("div", v, long(10_000))
        code = pick(*(F.call_function("div", front, long(n)) for n in (800, 1000, 200))) + pick(long(200), long(0), long(200))
        rest = pick(front % 800 + 200, front % 1000, front % 200)
        return F.concat(F.substr(digits, F.lit(1), F.length(digits) - 10), _padded(code, 3), _padded(rest, 3), _padded(v % 10_000, 4))

    marked = F.contains(m, F.lit("(")) | F.contains(m, F.lit("+"))
    made = _refill(m, F.transform(F.array(x), written)[0])
    return F.when(((area >= 200) & (exchange >= 200)) | marked, made).otherwise(m)


def _ip(m: Column, key: str, undo: bool) -> Column:
    octets = F.transform(F.split(m, r"\."), lambda o: o.cast("long"))
    x = ((octets[0] * 256 + octets[1]) * 256 + octets[2]) * 256 + octets[3]
    side = F.lit(65_536).cast("long")
    made = F.transform(
        F.array(permute(x, side, side, key, "ip", undo)),
        lambda v: F.concat_ws(".", *(F.shiftright(v, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0))),
    )[0]
    plain = F.concat_ws(".", F.transform(octets, lambda o: o.cast("string"))) == m
    return F.when((F.array_max(octets) <= 255) & plain, made).otherwise(m)


def _ssn(m: Column, key: str, undo: bool) -> Column:
    area, group, serial = _number(m, 1, 3), _number(m, 5, 2), _number(m, 8, 4)
    place = F.when(area < 666, area - 1).otherwise(area - 2)
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    x = permute((place * 99 + group - 1) * 9999 + serial - 1, F.lit(898 * 99).cast("long"), F.lit(9999).cast("long"), key, "ssn", undo)

    def written(v: Column) -> Column:
        index = F.call_function("div", v, F.lit(99 * 9999))
        number = F.when(index < 665, index + 1).otherwise(index + 2)
        return F.concat_ws("-", _padded(number, 3), _padded(F.call_function("div", v, F.lit(9999)) % 99 + 1, 2), _padded(v % 9999 + 1, 4))

    return F.when(valid, F.transform(F.array(x), written)[0]).otherwise(m)


def _date(m: Column, key: str, undo: bool) -> Column:
    day_first = F.substr(m, F.lit(3), F.lit(1)) == "."
    iso = F.when(day_first, F.concat_ws("-", F.substr(m, F.lit(7), F.lit(4)), F.substr(m, F.lit(4), F.lit(2)), F.substr(m, F.lit(1), F.lit(2))))
    day = F.try_to_date(iso.otherwise(F.replace(m, F.lit("/"), F.lit("-"))), "yyyy-MM-dd")
    at = F.datediff(day, F.lit(_FIRST_DAY).cast("date")).cast("long")
    most = permute(at, F.lit(365).cast("long"), F.lit(200).cast("long"), key, "date", undo)
    rest = permute(at - _DAYS, F.lit(7).cast("long"), F.lit(7).cast("long"), key, "late date", undo) + _DAYS
    x = F.when(at < _DAYS, most).otherwise(rest)
    written = F.transform(
        F.array(F.date_add(F.lit(_FIRST_DAY).cast("date"), x.cast("int"))),
        lambda d: F.when(day_first, F.date_format(d, "dd.MM.yyyy"))
        .when(F.contains(m, F.lit("/")), F.date_format(d, "yyyy/MM/dd"))
        .otherwise(F.date_format(d, "yyyy-MM-dd")),
    )[0]
    return F.when(at.between(0, _DAYS + 48), written).otherwise(m)


def _number_of_any_kind(m: Column, key: str, undo: bool) -> Column:
    kinds = ((_IP, _ip), (_DATE, _date), (_SSN, _ssn), (_PHONE, _phone))
    out = _card(m, key, undo)
    for pattern, replace in reversed(kinds):
        out = F.when(m.rlike(f"^(?:{pattern})$"), replace(m, key, undo)).otherwise(out)
    return out


def _email(m: Column, key: str, undo: bool) -> Column:
    at = F.instr(m, "@")
    return F.concat(permute_text(F.substr(m, F.lit(1), at - 1), key, "email", undo), F.substr(m, at, F.length(m)))


def _secret(m: Column, key: str, undo: bool) -> Column:
    front = F.when(F.startswith(m, F.lit("AKIA")), F.lit("AKIA")).otherwise(F.regexp_extract(m, _SECRET_PREFIX, 1))
    return F.concat(front, permute_text(F.substr(m, F.length(front) + 1, F.length(m)), key, "secret", undo))


def _with(replace, key: str, undo: bool):
    return lambda m: replace(m, key, undo)


def pseudonymise(docs: DataFrame, key: str, text: str = "text", count: str = "n_replaced", undo: bool = False) -> DataFrame:
    """``docs`` with the personal data of ``text`` replaced, and how many values were in ``count``.

    ``undo`` with the same key gives the original texts back.
    """
    passes = (
        (NUMBERS, _number_of_any_kind, lambda t: t.rlike("[0-9]")),
        (EMAILS, _email, lambda t: F.contains(t, F.lit("@"))),
        (SECRETS, _secret, lambda t: t.rlike(f"AKIA|{_SECRET_WORDS}")),
    )
    columns = [c for c in docs.columns if c != count]
    now, found, made, total = (fresh(docs, name) for name in ("now", "found", "made", "total"))
    out = docs.withColumns({now: F.col(text), total: F.lit(0)})
    for pattern, replace, guard in reversed(passes) if undo else passes:
        out = out.withColumn(found, F.when(guard(F.col(now)), F.regexp_extract_all(F.col(now), F.lit(pattern), F.lit(0))))
        out = out.withColumn(made, F.transform(F.col(found), _with(replace, key, undo)))
        between = F.split(F.col(now), pattern, -1)
        woven = F.zip_with(between, F.concat(F.col(made), F.array(F.lit(""))), lambda a, b: F.concat(a, b))
        changed = F.size(F.filter(F.zip_with(F.col(found), F.col(made), lambda a, b: a != b), lambda differs: differs))
        some = F.size(F.col(found)) > 0
        out = out.withColumns(
            {
                total: F.col(total) + F.when(some, changed).otherwise(0),
                now: F.when(some, F.array_join(woven, "")).otherwise(F.col(now)),
            }
        )
    return out.select(*(F.col(now).alias(c) if c == text else F.col(c) for c in columns), F.col(total).alias(count))


#: Stands in for the secret that a deployment passes.
KEY = "change me"


def op1_pii(spark, sf_dir: str) -> DataFrame:
    """Every document with its personal data under pseudonyms."""
    docs = read_table(spark, sf_dir, "documents")
    return pseudonymise(docs.select("doc_id", "text"), KEY)

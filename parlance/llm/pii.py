"""PII: validated numbers, dates and addresses become keyed pseudonyms of the same format, in DataFrame functions only.

One pattern finds candidates; each is validated (Luhn digit, octets, calendar, area numbers) and then permuted within its
format by a Feistel network over two residues, keyed by SHA-256. A permutation keeps distinct values distinct and maps
equal values alike in every document, so links survive. The rounds run in an `aggregate` over a literal array.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

ROUNDS = 8
#: Patterns of the kinds, in the order in which they are tried at a place.
PATTERNS = {
    "secret": r"""(?i:\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth)\b\s{0,3}[=:]\s{0,3}["']?)[A-Za-z0-9+/_.-]{8,}+""",
    "aws_key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "ipv6": r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?)(?![0-9A-Za-z:.])",
    "iso_date": r"(?<![0-9-])(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}(?![0-9-])",
    "date": r"(?<![0-9/.-])[0-9]{1,2}([/.])[0-9]{1,2}\1(?:19|20)[0-9]{2}(?![0-9/-])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\) ?|[0-9]{3}[ .-])[0-9]{3,4}[ .-][0-9]{4}(?![0-9])",
    "intl_phone": r"(?<![0-9A-Za-z+])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9A-Za-z.-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9]|-[0-9])",
}
FIRST_DAY, DAYS, YEARS = "1900-01-01", 73_049, 200  # through 2099-12-31
#: Days after the twelfth of their month in those years: 19, 18, 17 or 16 a month.
LATE_DAYS = DAYS - 12 * 12 * YEARS


def _long(c: Column) -> Column:
    return c.try_cast("long")


def _hash(key: str, kind: str, round_: Column, value: Column) -> Column:
    """60 bits of SHA-256, as a long."""
    text = F.concat_ws("|", F.lit(key), F.lit(kind), round_.cast("string"), value.cast("string"))
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def feistel(a: Column, b: Column, size_a: int | Column, size_b: int | Column, key: str, kind: str) -> Column:
    """A keyed permutation of pairs (a, b) with 0 <= a < size_a and 0 <= b < size_b, as a struct of a and b.

    Even rounds add a hash of b to a modulo size_a, odd rounds a hash of a to b modulo size_b; each can be undone.
    """

    def turn(s: Column, r: Column) -> Column:
        even = r % 2 == 0
        h = _hash(key, kind, r, F.when(even, s["b"]).otherwise(s["a"]))
        return F.struct(F.when(even, (s["a"] + h % size_a) % size_a).otherwise(s["a"]).alias("a"), F.when(even, s["b"]).otherwise((s["b"] + h % size_b) % size_b).alias("b"))

    start = F.struct(F.coalesce(a, F.lit(0)).cast("long").alias("a"), F.coalesce(b, F.lit(0)).cast("long").alias("b"))
    return F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), start, turn)


def permuted(index: Column, size: int, key: str, kind: str) -> Column:
    """A keyed permutation of 0 .. size - 1: one of a rectangle that holds them, taken again wherever it leads outside."""
    side = math.isqrt(size - 1) + 1
    other = -(-size // side)

    def once(i: Column) -> Column:
        pair = feistel(F.floor(i / other), i % other, side, other, key, kind)
        return F.aggregate(F.array(pair), F.lit(0).cast("long"), lambda _, p: p["a"] * other + p["b"])

    outside = side * other - size  # a walk meets each place outside once at most
    if not outside:
        return once(index)
    return F.aggregate(F.array_repeat(F.lit(0), outside), once(index), lambda s, _: F.when(s >= size, once(s)).otherwise(s))


def _padded(n: Column, width: int) -> Column:
    return F.lpad(n.cast("string"), width, "0")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _refill(template: Column, digits: Column) -> Column:
    """`template` with its digits replaced by those of `digits`, in order."""

    def put(s: Column, c: Column) -> Column:
        hit = c.between("0", "9")
        return F.struct(F.concat(s["out"], F.when(hit, F.substring(digits, s["at"] + 1, 1)).otherwise(c)).alias("out"), F.when(hit, s["at"] + 1).otherwise(s["at"]).alias("at"))

    return F.aggregate(F.split(template, ""), F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), put)["out"]


def permuted_digits(digits: Column, width: int, key: str, kind: str) -> Column:
    """The keyed permutation of the `width` digit strings."""
    half = width // 2
    pair = feistel(_long(F.substring(digits, 1, half)), _long(F.substring(digits, half + 1, width - half)), 10**half, 10 ** (width - half), key, kind)
    return F.aggregate(F.array(pair), F.lit(""), lambda s, p: F.concat(s, _padded(p["a"], half), _padded(p["b"], width - half)))


def _permuted_any(digits: Column, key: str, kind: str) -> Column:
    """The keyed permutation of the digit strings of each length up to 34."""
    n = F.length(digits)
    half = F.floor(n / 2).cast("int")
    power = lambda width: F.rpad(F.lit("1"), width + 1, "0").cast("long")
    pair = feistel(_long(F.substring(digits, F.lit(1), half)), _long(F.substring(digits, half + 1, n - half)), power(half), power(n - half), key, kind)
    padded = lambda v, width: F.when(width > 0, F.lpad(v.cast("string"), width, F.lit("0"))).otherwise("")
    return F.aggregate(F.array(pair), F.lit(""), lambda s, p: F.concat(s, padded(p["a"], half), padded(p["b"], n - half)))


def _luhn_sum(digits: Column, double_last: bool) -> Column:
    """Sum of the Luhn digits; every second digit counts double, from the last or from the one before it."""
    values = F.transform(F.reverse(F.split(digits, "")), lambda c, i: F.when((i % 2 == (0 if double_last else 1)), F.coalesce(_long(c), F.lit(0)) * 2).otherwise(F.coalesce(_long(c), F.lit(0))))
    return F.aggregate(values, F.lit(0).cast("long"), lambda s, v: s + F.when(v > 9, v - 9).otherwise(v))


def _by_width(digits: Column, low: int, high: int, make) -> Column:
    out = F.lit(None).cast("string")
    for n in range(low, high + 1):
        out = F.when(F.length(digits) == n, make(n)).otherwise(out)
    return out


def _card(m: Column, key: str) -> Column:
    """First digit kept, the middle permuted, the check digit made anew."""
    d = _digits(m)
    ok = (_luhn_sum(d, False) % 10 == 0) & (F.length(d).between(13, 19)) & ~F.rlike(d, F.lit(r"^(\d)\1*$"))
    body = F.concat(F.substring(d, 1, 1), _by_width(d, 13, 19, lambda n: permuted_digits(F.substring(d, 2, n - 2), n - 2, key, "card")))
    full = F.aggregate(F.array(body), F.lit(""), lambda s, b: F.concat(s, b, ((10 - _luhn_sum(b, True) % 10) % 10).cast("string")))
    return F.when(ok, _refill(m, full)).otherwise(m)


def _phone(m: Column, key: str) -> Column:
    """The last seven to ten digits permuted; a country code stays."""
    d = _digits(m)
    n = F.length(d)
    tail = F.when(n >= 10, 10).otherwise(7)
    head = F.substring(d, F.lit(1), n - tail)
    rest = F.substring(d, n - tail + 1, tail)
    new = F.when(n >= 10, permuted_digits(rest, 10, key, "phone")).otherwise(permuted_digits(rest, 7, key, "phone"))
    return F.when(n.between(7, 15), _refill(m, F.concat(head, new))).otherwise(m)


def _ssn(m: Column, key: str) -> Column:
    """Areas 001-899 but 666, groups 01-99 and serials 0001-9999 are permuted among themselves."""
    area, group, serial = (_long(F.substring(m, i, n)) for i, n in ((1, 3), (5, 2), (8, 4)))
    ok = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    index = F.when(area > 666, area - 2).otherwise(area - 1)
    pair = feistel(index * 99 + group - 1, serial - 1, 898 * 99, 9999, key, "ssn")

    def show(_: Column, p: Column) -> Column:
        at = F.floor(p["a"] / 99)
        return F.concat(_padded(F.when(at >= 665, at + 2).otherwise(at + 1), 3), F.lit("-"), _padded(p["a"] % 99 + 1, 2), F.lit("-"), _padded(p["b"] + 1, 4))

    return F.when(ok, F.aggregate(F.array(pair), F.lit(""), show)).otherwise(m)


def _ip(m: Column, key: str) -> Column:
    octets = F.transform(F.split(m, r"\."), lambda c: F.coalesce(_long(c), F.lit(256)))
    ok = F.forall(octets, lambda o: o <= 255)
    pair = feistel(octets[0] * 256 + octets[1], octets[2] * 256 + octets[3], 65_536, 65_536, key, "ip")
    show = lambda _, p: F.concat_ws(".", F.floor(p["a"] / 256), p["a"] % 256, F.floor(p["b"] / 256), p["b"] % 256)
    return F.when(ok, F.aggregate(F.array(pair), F.lit(""), show)).otherwise(m)


def _ipv6(m: Column, key: str) -> Column:
    """Network and host half are permuted apart, so that hosts of one network stay in one; shown as eight groups, whatever
    the spelling. An address of one group, or without a digit, names nobody and stays."""
    halves = F.split(m, "::", -1)
    groups = lambda t: F.filter(F.split(t, ":", -1), lambda g: g != "")
    given = F.when(F.size(halves) == 2, F.concat(groups(halves[0]), groups(F.get(halves, F.lit(1))))).otherwise(groups(m))
    filled = F.concat(groups(halves[0]), F.array_repeat(F.lit("0"), 8 - F.size(given)), groups(F.get(halves, F.lit(1))))
    whole = F.when(F.size(halves) == 2, filled).otherwise(given)
    words = F.transform(whole, lambda g: F.conv(g, 16, 10).cast("long"))
    ok = (F.size(whole) == 8) & (F.size(given) >= 2) & F.rlike(m, F.lit("[0-9]"))
    half = lambda i, kind: feistel(words[i] * 65_536 + words[i + 1], words[i + 2] * 65_536 + words[i + 3], 1 << 32, 1 << 32, key, kind)
    shown = lambda p: F.array(F.floor(p["a"] / 65_536), p["a"] % 65_536, F.floor(p["b"] / 65_536), p["b"] % 65_536)
    every = F.flatten(F.transform(F.array(half(0, "ipv6/net"), half(4, "ipv6/host")), shown))
    return F.when(ok, F.array_join(F.transform(every, lambda n: F.lower(F.hex(n.cast("long")))), ":")).otherwise(m)


def _day(day: Column, key: str) -> Column:
    """The permutation of the days of two centuries; null for other days."""
    index = F.datediff(day, F.to_date(F.lit(FIRST_DAY)))
    return F.when(index.between(0, DAYS - 1), F.date_add(F.to_date(F.lit(FIRST_DAY)), permuted(index, DAYS, key, "date").cast("int")))


def _iso_date(m: Column, key: str) -> Column:
    return F.coalesce(_day(F.try_to_date(m, "yyyy-MM-dd"), key).cast("string"), m)


def _late_day(day: Column, key: str, kind: str) -> Column:
    """The permutation of the days after the twelfth of their months."""
    first = F.to_date(F.lit(FIRST_DAY))
    start = lambda month: F.datediff(F.add_months(first, month), first) - 12 * month
    index = start((F.year(day) - 1900) * 12 + F.month(day) - 1) + F.dayofmonth(day) - 13
    moved = permuted(index, LATE_DAYS, key, kind)

    def show(_: Column, n: Column) -> Column:
        guess = F.floor(n * 12 * YEARS / LATE_DAYS).cast("int")  # the month, or one beside it
        month = F.when(start(guess + 1) <= n, guess + 1).when(start(guess) <= n, guess).otherwise(guess - 1)
        return F.aggregate(F.array(month), F.lit(None).cast("date"), lambda _, mo: F.date_add(F.add_months(first, mo), (n - start(mo) + 12).cast("int")))

    return F.aggregate(F.array(moved), F.lit(None).cast("date"), show)


def _date(m: Column, key: str) -> Column:
    """Three sets of strings are each permuted among themselves, as what is written does not say which number is the day:
    both at most 12; the first over 12, so day first; the second over 12, so month first. Day and month get two digits."""
    parts = F.split(m, "[/.]")
    a, b, year = (_long(parts[i]) for i in range(3))
    sep = F.regexp_extract(m, "([/.])", 1)
    joined = lambda x, y, z: F.concat(x, sep, y, sep, z)
    make = lambda d, mo: F.try_to_date(F.concat_ws("-", parts[2], F.lpad(mo, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")
    late = lambda day, kind, shape: F.aggregate(F.array(_late_day(day, key, kind)), F.lit(""), lambda _, d: joined(*[F.date_format(d, part) for part in shape]))
    early = permuted(((year - 1900) * 12 + a - 1) * 12 + b - 1, 144 * YEARS, key, "date/either")
    both = F.aggregate(F.array(early), F.lit(""), lambda _, n: joined(_padded(F.floor(n / 12) % 12 + 1, 2), _padded(n % 12 + 1, 2), (F.floor(n / 144) + 1900).cast("string")))
    day_first, month_first = make(parts[0], parts[1]), make(parts[1], parts[0])
    out = F.when(a.between(1, 12) & b.between(1, 12), both).when((a > 12) & day_first.isNotNull(), late(day_first, "date/day", ("dd", "MM", "yyyy")))
    return out.when((b > 12) & month_first.isNotNull(), late(month_first, "date/month", ("MM", "dd", "yyyy"))).otherwise(m)


def _token(text: Column, key: str, kind: str) -> Column:
    """Each letter and digit becomes one of its class by a keyed hash of the whole text: one-way, as there is no number to permute."""

    def put(c: Column, i: Column, own: Column) -> Column:
        h = _hash(key, kind, i, own)
        pick = lambda letters: F.substring(F.lit(letters), (h % len(letters) + 1).cast("int"), 1)
        return F.when(c.between("0", "9"), pick("0123456789")).when(F.rlike(c, F.lit("^[a-f]$")), pick("abcdef")).when(F.rlike(c, F.lit("^[A-F]$")), pick("ABCDEF")).when(c.between("a", "z"), pick("ghijklmnopqrstuvwxyz")).when(c.between("A", "Z"), pick("GHIJKLMNOPQRSTUVWXYZ")).otherwise(c)

    # A long text is hashed once, not for each of its characters.
    short = F.when(F.length(text) <= 200, text).otherwise(F.sha2(text, 256))
    return F.transform(F.array(short), lambda own: F.array_join(F.transform(F.split(text, ""), lambda c, i: put(c, i, own)), ""))[0]


def _email(m: Column, key: str) -> Column:
    """The local part and the name of the host get hashes; the top-level domain becomes `invalid`."""
    h = F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(m)), 256)
    return F.concat(F.lit("user."), F.substring(h, 1, 12), F.lit("@mail."), F.substring(h, 13, 6), F.lit(".invalid"))


def _secret(m: Column, key: str) -> Column:
    head = F.regexp_extract(m, r"(?is)^([a-z_-]+\s*[=:]\s*[\"']?)", 1)
    return F.concat(head, _token(F.substring(m, F.length(head) + 1, F.length(m)), key, "secret"))


def _iban(m: Column, key: str) -> Column:
    """Valid by its check digits modulo 97: all digits after the bank's letters are permuted, later letters are moved within
    theirs by a hash of the digits and the letters before, and it is checked anew. Only country and bank letters stay.
    """
    flat = F.replace(m, F.lit(" "), F.lit(""))

    def rest(text: Column) -> Column:
        return F.aggregate(F.split(text, ""), F.lit(0).cast("long"), lambda s, c: F.when(c.between("0", "9"), (s * 10 + F.coalesce(_long(c), F.lit(0))) % 97).otherwise((s * 100 + F.ascii(c) - 55) % 97))

    ok = rest(F.concat(F.substring(flat, 5, 40), F.substring(flat, 1, 4))) == 1
    account = F.substring(flat, 5, 40)
    bank = F.when(F.rlike(account, F.lit("[0-9]")), F.regexp_extract(account, "^[A-Z]*", 0)).otherwise("")
    tail = F.substring(account, F.length(bank) + 1, F.length(account))

    def move(s: Column, c: Column) -> Column:
        digit = c.between("0", "9")
        h = _hash(key, "iban", F.length(s["out"]), F.concat_ws("|", s["old"], s["letters"]))
        letter = F.char(F.lit(65) + (F.ascii(c) - 65 + h % 26) % 26)
        new = F.when(digit, F.substring(s["new"], s["at"], 1)).otherwise(letter)
        return F.struct(F.concat(s["out"], new).alias("out"), F.when(digit, s["at"] + 1).otherwise(s["at"]).alias("at"), F.when(digit, s["letters"]).otherwise(F.concat(s["letters"], c)).alias("letters"), s["old"].alias("old"), s["new"].alias("new"))

    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"), F.lit("").alias("letters"), _digits(tail).alias("old"), _permuted_any(_digits(tail), key, "iban").alias("new"))
    body = F.concat(bank, F.aggregate(F.filter(F.split(tail, ""), lambda c: c != ""), start, move)["out"])
    made = F.aggregate(F.array(body), F.lit(""), lambda _, b: F.concat(F.substring(flat, 1, 2), _padded(98 - rest(F.concat(b, F.substring(flat, 1, 2), F.lit("00"))), 2), b))

    def put(s: Column, c: Column) -> Column:
        space = c == " "
        return F.struct(F.concat(s["out"], F.when(space, c).otherwise(F.substring(s["new"], s["at"], 1))).alias("out"), F.when(space, s["at"]).otherwise(s["at"] + 1).alias("at"), s["new"].alias("new"))

    spaced = F.aggregate(F.split(m, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("at"), made.alias("new")), put)["out"]
    return F.when(ok, spaced).otherwise(m)


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of one match; a match that is not valid stays as it is."""
    whole = lambda kind: F.rlike(m, F.lit(f"^(?:{PATTERNS[kind]})$"))
    made = {"secret": _secret(m, key), "aws_key": F.concat(F.substring(m, 1, 4), _token(F.substring(m, 5, 16), key, "aws")), "email": _email(m, key), "iban": _iban(m, key), "ip": _ip(m, key), "ipv6": _ipv6(m, key), "iso_date": _iso_date(m, key), "date": _date(m, key), "ssn": _ssn(m, key), "card": _card(m, key), "phone": _phone(m, key), "intl_phone": _phone(m, key)}
    out = F.lit(None).cast("string")
    for kind in reversed(list(made)):
        out = F.when(whole(kind), made[kind]).otherwise(out)
    return F.coalesce(out, m)


def scrub(docs: DataFrame, key: str, text_col: str = "text", changed_col: str = "n_pii") -> DataFrame:
    """All rows and columns of `docs`, with PII in the text replaced, and the number of values replaced.

    Who knows `key` can undo a permutation, so it is to be kept secret; equal values get equal pseudonyms under one key.
    A null text stays null with count 0; empty texts and texts without PII stay as they are; repeated rows and null ids pass
    through; an empty table gives no rows. If `docs` has a column named like the count, the new one gets a leading
    underscore. The text's other columns (its length, say) are not recomputed.
    """
    count, found, made = fresh(docs, changed_col, "pii_found", "pii_made")
    pattern = "|".join(f"(?:{p})" for p in PATTERNS.values()).replace(r"([/.])[0-9]{1,2}\1", r"(?:/[0-9]{1,2}/|\.[0-9]{1,2}\.)")
    text = F.col(f"`{text_col}`").cast("string")
    # Every kind needs one of these characters; texts without any skip the long pattern.
    df = docs.withColumn(found, F.when(F.rlike(text, F.lit("[0-9@=:]")), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))))
    df = df.withColumn(made, F.transform(F.coalesce(found, F.array().cast("array<string>")), lambda m: pseudonym(m, key)))
    gaps = F.split(text, pattern, -1)
    joined = F.concat(gaps[0], F.array_join(F.transform(F.col(made), lambda m, i: F.concat(m, gaps[i + 1])), ""))
    df = df.withColumn(text_col, F.when(F.size(made) > 0, joined).otherwise(text))
    changed = F.size(F.filter(F.zip_with(found, made, lambda a, b: a != b), lambda c: c))
    return df.withColumn(count, F.when(F.size(made) > 0, changed).otherwise(0).cast("long")).drop(found, made)

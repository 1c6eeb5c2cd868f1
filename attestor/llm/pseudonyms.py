"""PII: format-preserving Feistel pseudonyms, in DataFrame functions only.

E-mail addresses, phone numbers, payment card numbers, social security numbers, IPv4 addresses and dates are found by
two patterns and validated (Luhn check, octets up to 255, calendar dates, digit counts). Each is replaced by a keyed
permutation of its own format: letters stay letters of their case, digits digits, punctuation in place, a card
number passes the Luhn check, a date is a date, an address is an address. The permutation is a Feistel network of
``ROUNDS`` rounds under ``key``, so equal values have equal pseudonyms in all documents, different ones have
different pseudonyms, and whoever has the key can undo it. Only an address may change its length, by its octets.

Of card and phone numbers the digits alone are permuted and then laid into the spelling they had, so every
spelling of a number leads to the same digits. A phone number keeps its country code, whether a space follows it or not,
and its national digits are the same with and without the code. Social security numbers become such numbers (area 001 to 899
but 666, group and serial not zero), taxpayer numbers (area from 900) taxpayer numbers; other digits of that form
stay. The case of a mail address is part of its value. IBANs, IPv6 addresses and names are not looked for.

Everything happens inside the row: no shuffle. Texts without a digit or an at sign are not looked at further.

Card numbers are sought last, in the text that no other value has taken: of each run of digit groups with one space
or hyphen between them, every stretch of whole groups with 13 to 19 digits is tried, so a number beside a card does not
hide it. Of overlapping stretches that pass the Luhn check the leftmost, then longest counts; one in ten of other
digit stretches passes too. A slash date is read as dd/mm/yyyy, and as mm/dd/yyyy where that is no day; either form has
a permutation of its own. Of an ISO timestamp the date is replaced, the time stays.

Defined cases: a null text stays null, an empty one empty; what fails its validation stays as it is; matches do not
overlap, the leftmost longest kind in the order of ``PATTERNS`` wins; repeated rows are treated alike; further
columns are kept.
"""
from __future__ import annotations

import calendar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
KEY = "attestor"  # the query's; callers pass their own

# The formats looked for. A start inside a longer token is refused, so each token is read once.
EMAIL = r"(?<![A-Za-z0-9._%+\-@])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)+"
PHONE = r"(?<![A-Za-z0-9+])\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .\-]?\d{2,4}){2,4}(?![A-Za-z0-9])|(?<![A-Za-z0-9(])\(\d{3}\) ?\d{3}[ .\-]\d{4}(?![A-Za-z0-9])|(?<![A-Za-z0-9.\-])\d{3}[.\-]\d{3}[.\-]\d{4}(?![A-Za-z0-9])"
DIGITS = r"(?<![A-Za-z0-9.\-])(?=\d(?:[ \-]?\d){12})\d++(?![A-Za-z0-9])(?:[ \-]\d++(?![A-Za-z0-9]))*+"  # groups that may hold card numbers
SSN = r"(?<![A-Za-z0-9.\-])\d{3}-\d{2}-\d{4}(?![A-Za-z0-9\-])"
IPV4 = r"(?<![A-Za-z0-9.\-])\d{1,3}(?:\.\d{1,3}){3}(?![A-Za-z0-9])(?!\.\d)"
DATE = r"(?<![A-Za-z0-9.\-/])(?:\d{4}-\d{2}-\d{2}(?=[Tt]\d{2})|\d{4}-\d{2}-\d{2}(?![A-Za-z0-9/])|(?:\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![A-Za-z0-9/]))"
# country codes of E.164: 1 and 7, these of two digits, else three
COUNTRY = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
PATTERNS = {"email": EMAIL, "phone": PHONE, "ssn": SSN, "date": DATE, "ip": IPV4}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
FIRST_DAY, DAYS_HIGH, DAYS_LOW = "1900-01-01", 17, 4297  # 17 * 4297 days: to 2099-12-31
# days that only mm/dd names, of years without the 29th of February, and the years with one (49 = 7 * 7)
MONTH_DAYS = [f"{m:02d}/{d:02d}" for m in range(1, 13) for d in range(13, calendar.monthrange(1900, m)[1] + 1)]
LEAP_YEARS = [y for y in range(1900, 2100) if calendar.isleap(y)]


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _hash(key: str, kind: str, turn: Column, half: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), half.cast("string")), 256)


def _number(digest: Column, at, length: int) -> Column:
    return F.conv(F.substr(digest, at if isinstance(at, Column) else F.lit(at), F.lit(length)), 16, 10).cast("long")


def _shifted(text: Column, digest: Column) -> Column:
    """Each letter or digit moved on within its class by the digest's bytes."""

    def one(i: Column) -> Column:
        c = F.substr(text, i, F.lit(1))
        code = F.ascii(c)
        by = _number(digest, (i - 1) % 32 * 2 + 1, 2)
        moved = lambda first, size: F.char(first + (code - first + by) % size)
        return F.when(code.between(48, 57), moved(48, 10)).when(code.between(65, 90), moved(65, 26)).when(code.between(97, 122), moved(97, 26)).otherwise(c)

    return F.when(F.length(text) == 0, text).otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), one), ""))


def permuted_text(text: Column, key: str, kind: str) -> Column:
    """A keyed permutation of all strings with the same letter cases, digits and other characters in their places."""
    half = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(F.substr(text, F.lit(1), half).alias("l"), F.substr(text, half + 1, F.length(text)).alias("r"))
    step = lambda s, i: F.struct(s["r"].alias("l"), _shifted(s["l"], _hash(key, kind, i, s["r"])).alias("r"))
    # an even number of rounds leaves either half at its own place
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda s: F.concat(s["l"], s["r"]))


def permuted_number(x: Column, high: int, low: int, key: str, kind: str) -> Column:
    """A keyed permutation of 0 .. high * low - 1: the two digits of x in mixed radix move each other."""
    start = F.struct(F.floor(x / low).cast("long").alias("l"), (x % low).cast("long").alias("r"))

    def step(s, i):
        l = (s["l"] + _number(_hash(key, kind, i, s["r"]), 1, 12)) % high
        return let(l, lambda l: F.struct(l.alias("l"), ((s["r"] + _number(_hash(key, kind, -i, l), 1, 12)) % low).alias("r")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda s: s["l"] * low + s["r"])


def luhn_sum(digits: Column) -> Column:
    """Sum of the digits, every second one from the right (the last one not) doubled with its digits added."""

    def one(i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int")
        doubled = d * 2 - F.when(d > 4, 9).otherwise(0)
        return F.when((F.length(digits) - i) % 2 == 1, doubled).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), one), F.lit(0), lambda a, x: a + x)


def _laid(m: Column, digits: Column) -> Column:
    """``m`` with its digits replaced one by one."""
    return F.array_join(F.zip_with(F.split(m, "[0-9]", -1), F.regexp_extract_all(digits, F.lit("[0-9]"), F.lit(0)), lambda p, d: F.concat(p, F.coalesce(d, F.lit("")))), "")


def _card(m: Column, key: str) -> Column:
    """All digits but the last permuted, the last one made right."""
    digits = F.regexp_replace(m, r"\D", "")
    body = permuted_text(F.substr(digits, F.lit(1), F.length(digits) - 1), key, "card")
    return let(body, lambda b: _laid(m, F.concat(b, ((10 - luhn_sum(F.concat(b, F.lit("0"))) % 10) % 10).cast("string"))))


def _phone(m: Column, key: str) -> Column:
    digits = F.regexp_replace(m, r"\D", "")
    code = F.when(m.startswith("+"), F.length(F.regexp_extract(F.concat(F.lit("+"), digits), COUNTRY, 0)) - 1).otherwise(0)
    return let(F.struct(digits.alias("d"), code.alias("n")), lambda x: _laid(m, F.concat(F.substr(x["d"], F.lit(1), x["n"]), permuted_text(F.substr(x["d"], x["n"] + 1, F.length(x["d"])), key, "phone"))))


def _social(m: Column, key: str) -> Column:
    """The replacement of a social security or taxpayer number; null for other digits of that form."""
    area, group, serial = (F.substr(m, F.lit(k), F.lit(n)).cast("long") for k, n in ((1, 3), (5, 2), (8, 4)))
    # areas 1 to 899 without 666 are 0 to 897; 900 to 999 are a permutation of their own
    place = area - F.when(area > 666, 2).otherwise(1)
    written = lambda a, g, n: F.format_string("%03d-%02d-%04d", a.cast("long"), g.cast("long"), n.cast("long"))
    usual = let(permuted_number((place * 99 + group - 1) * 9999 + serial - 1, 898 * 99, 9999, key, "ssn"), lambda x: let(
        F.floor(x / (99 * 9999)), lambda a: written(a + F.when(a >= 665, 2).otherwise(1), F.floor(x / 9999) % 99 + 1, x % 9999 + 1)))
    tax = let(permuted_number(((area - 900) * 99 + group - 1) * 9999 + serial - 1, 100 * 99, 9999, key, "itin"), lambda x: written(F.floor(x / (99 * 9999)) + 900, F.floor(x / 9999) % 99 + 1, x % 9999 + 1))
    real = (area > 0) & (area != 666) & (group > 0) & (serial > 0)
    return F.when(real, F.when(area < 900, usual).otherwise(tax))


def _ip(m: Column, key: str) -> Column:
    octet = lambda k: F.element_at(F.split(m, r"\."), k).cast("long")
    moved = permuted_number(((octet(1) * 256 + octet(2)) * 256 + octet(3)) * 256 + octet(4), 65536, 65536, key, "ip")
    return let(moved, lambda x: F.concat_ws(".", *[(F.floor(x / 256**k) % 256).cast("string") for k in (3, 2, 1, 0)]))


def _day(m: Column) -> Column:
    """The date of a match, null when there is no such day."""
    year, month, day = (F.when(m.rlike(r"^\d{4}-"), F.substr(m, F.lit(a), F.lit(n))).otherwise(F.substr(m, F.lit(b), F.lit(n))) for a, b, n in ((1, 7, 4), (6, 4, 2), (9, 1, 2)))
    return F.try_to_timestamp(F.concat_ws("-", year, month, day), F.lit("yyyy-MM-dd")).cast("date")


def _date(m: Column, key: str) -> Column:
    number = F.datediff(_day(m), F.to_date(F.lit(FIRST_DAY)))
    moved = F.date_add(F.to_date(F.lit(FIRST_DAY)), permuted_number(number, DAYS_HIGH, DAYS_LOW, key, "date").cast("int"))
    return let(moved, lambda d: F.when(m.contains("-"), F.date_format(d, "yyyy-MM-dd")).when(m.contains("/"), F.date_format(d, "dd/MM/yyyy")).otherwise(F.date_format(d, "dd.MM.yyyy")))


def _month_first(m: Column, key: str) -> Column:
    """The replacement of an mm/dd/yyyy date whose day is above 12, by another such date; null for other matches."""
    days, leaps, n = F.lit(MONTH_DAYS), F.lit(LEAP_YEARS), len(MONTH_DAYS)
    month_day, year = F.substr(m, F.lit(1), F.lit(5)), F.substr(m, F.lit(7), F.lit(4)).try_cast("int")
    at, leap = F.array_position(days, month_day) - 1, F.array_position(leaps, year) - 1
    usual = let(permuted_number((year - 1900) * n + at, 200, n, key, "mm/dd"), lambda x: F.concat_ws("/", F.get(days, (x % n).cast("int")), (F.floor(x / n) + 1900).cast("string")))
    extra = let(permuted_number(leap, 7, 7, key, "02/29"), lambda x: F.concat_ws("/", F.lit("02/29"), F.get(leaps, x.cast("int")).cast("string")))
    return F.when(m.contains("/") & year.between(1900, 2099), F.when(at >= 0, usual).when((month_day == "02/29") & (leap >= 0), extra))


def _cards(run: Column, key: str) -> Column:
    """(text, at, n) of a run of digit groups: ``n`` card numbers replaced, ``at`` the group after the last of them."""
    groups = F.regexp_extract_all(run, F.lit(r"[ \-]?\d+"), F.lit(0))
    joined = lambda g, a, b: F.array_join(F.slice(g, a, b - a + 1), "")

    def valid(g: Column, a: Column, b: Column) -> Column:
        digits = F.regexp_replace(joined(g, a, b), r"\D", "")
        return let(digits, lambda d: F.when(F.length(d).between(13, 19), luhn_sum(d) % 10 == 0).otherwise(False))

    def found(g: Column) -> Column:
        last = lambda a: F.sequence(F.least(F.size(g), a + 18), a, F.lit(-1))
        each = lambda a: F.transform(F.filter(last(a), lambda b: valid(g, a, b)), lambda b: F.struct(a.alias("a"), b.alias("b")))
        return F.flatten(F.transform(F.sequence(F.lit(1), F.size(g)), each))

    def replaced(g: Column) -> Column:
        def step(s: Column, c: Column) -> Column:
            body = joined(g, c["a"], c["b"])
            mark = F.regexp_extract(body, r"^[ \-]?", 0)
            card = F.concat(mark, _card(F.substr(body, F.length(mark) + 1, F.length(body)), key))
            taken = F.struct(F.concat(s["text"], joined(g, s["at"], c["a"] - 1), card).alias("text"), (c["b"] + 1).alias("at"), (s["n"] + 1).alias("n"))
            return F.when(c["a"] >= s["at"], taken).otherwise(s)

        start = F.struct(F.lit("").alias("text"), F.lit(1).alias("at"), F.lit(0).alias("n"))
        rest = lambda s: F.struct(F.concat(s["text"], joined(g, s["at"], F.size(g))).alias("text"), s["n"].alias("n"))
        return F.aggregate(found(g), start, step, rest)

    return let(groups, replaced)


def _without_cards(text: Column, key: str) -> Column:
    """(text, n) of a stretch of text: card numbers replaced, and how many."""
    new = F.transform(F.regexp_extract_all(text, F.lit(DIGITS), F.lit(0)), lambda m: _cards(m, key))
    filled = lambda new: F.struct(
        F.array_join(F.flatten(F.zip_with(F.split(text, DIGITS, -1), new, lambda p, m: F.array(p, F.coalesce(m["text"], F.lit(""))))), "").alias("text"),
        F.aggregate(new, F.lit(0), lambda n, m: n + m["n"]).alias("n"),
    )
    return F.when(text.rlike(DIGITS), let(new, filled)).otherwise(F.struct(text.alias("text"), F.lit(0).alias("n")))


def pseudonym(m: Column, key: str) -> Column:
    """The replacement of one match; null where it does not validate."""
    digits = F.regexp_replace(m, r"\D", "")
    whole = lambda p: m.rlike("^(?:" + p + ")$")
    top = F.length(m) - F.locate(".", F.reverse(m)) + 1  # place of the last dot
    email = F.concat(permuted_text(F.substr(m, F.lit(1), top - 1), key, "email"), F.substr(m, top, F.length(m)))
    octets = F.forall(F.split(m, r"\."), lambda o: o.cast("int") <= 255)
    in_range = _day(m).between(F.to_date(F.lit(FIRST_DAY)), F.to_date(F.lit("2099-12-31")))
    return (
        F.when(m.contains("@"), email)
        .when(whole(PHONE), F.when(F.length(digits).between(10, 15), _phone(m, key)))
        .when(whole(SSN), _social(m, key))
        .when(whole(DATE), F.when(in_range, _date(m, key)).otherwise(_month_first(m, key)))
        .when(whole(IPV4), F.when(octets, _ip(m, key)))
    )


def pseudonymised(docs: DataFrame, key: str = KEY, column: str = "text", count: str | None = None) -> DataFrame:
    """``docs`` with the values in ``column`` replaced; ``count`` names a column for how many were."""
    text = F.col(f"`{column}`")
    looked_at = text.rlike("[0-9@]")
    found = F.when(looked_at, F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    new = F.transform("__found", lambda m: pseudonym(m, key))
    done = F.array_compact(F.transform("__new", lambda m, i: F.when(m.isNotNull(), i)))
    # the text between replaced values; what did not validate is part of it
    parts = F.slice(F.flatten(F.zip_with(F.split(text, ANY, -1), "__found", lambda p, m: F.array(p, F.coalesce(m, F.lit(""))))), F.lit(1), 2 * F.size("__found") + 1)
    first = lambda k: F.coalesce(F.get("__done", k - 1) * 2 + 3, F.lit(1))
    last = lambda k: F.coalesce(F.get("__done", k) * 2 + 1, 2 * F.size("__found") + 1)
    between = let(parts, lambda x: F.transform(F.sequence(F.lit(0), F.size("__done")), lambda k: F.array_join(F.slice(x, first(k), last(k) - first(k) + 1), "")))
    rest = F.transform(F.when(looked_at, between), lambda t: _without_cards(t, key))
    joined = F.array_join(F.flatten(F.transform("__rest", lambda t, k: F.array(t["text"], F.coalesce(F.get("__new", F.get("__done", k)), F.lit(""))))), "")
    own = list(docs.columns)
    out = docs.withColumn("__found", found).withColumn("__new", new).withColumn("__done", done).withColumn("__rest", rest)
    cols = [F.coalesce(joined, text).alias(c) if c == column else F.col(f"`{c}`") for c in own if c != count]
    if count:
        changed = F.size("__done") + F.coalesce(F.aggregate("__rest", F.lit(0), lambda n, t: n + t["n"]), F.lit(0))
        cols.append(F.when(text.isNull(), 0).otherwise(changed).alias(count))
    return out.select(*cols)

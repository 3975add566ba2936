"""Format-preserving Feistel pseudonyms (operator 2, DataFrame functions only).

Numbers, dates and the like are found by pattern, validated, and permuted
within their format by a keyed Feistel network, so that an equal value has an
equal pseudonym in every document and no two values share one. What fails
validation stays as it is.

* card: 13 to 19 digits that pass the Luhn test; all digits but the last are
  permuted, the check digit is made anew.
* iban: passes mod 97; country kept, account permuted, check digits made anew.
* date: year-month-day or day-month-year (month-day-year if only that is a
  date), a real date from 1000 on; permuted within its period of 400 years,
  again and again until the year has four digits and, where the month stands
  first, the day is over 12, so that a pseudonym is read in the order it has.
* ssn: a valid area, group and serial; permuted among the valid ones.
* ip: four octets without leading zeros, permuted as one number of 32 bits;
  IPv6, its hexadecimal digits.
* phone: the digits after the country code.
* email: letters and digits of the part before the @, each within its class.
* secret: 32 to 64 hexadecimal digits, with a letter and a digit among them
  (with letters of both cases, each within its class); access keys of known
  prefixes, all behind the prefix within its class.

A network of an even number of rounds changes its two halves in turn by adding
a keyed SHA-512 digest of the other half, per character in its own alphabet or
modulo the half's size, which is a permutation for any digest.

Results for odd input: a null text stays null; texts without such values stay
as they are; repeated rows give repeated results; other columns pass through
``pseudonymise`` as they are; ``pseudonym_report`` counts null as 0 values.
Patterns look a bounded way ahead, so texts without white space take linear
time. Without a key, one is drawn at random for that call alone.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
#: Steps in which a date is permuted until it fits; one of 10^9 or fewer needs more.
WALK = 64

EDGE, AFTER = r"(?<![A-Za-z0-9])", r"(?![A-Za-z0-9])"
DATE_YMD = r"[1-9][0-9]{3}([-/.])[0-9]{1,2}\1[0-9]{1,2}"
DATE_DMY = r"[0-9]{1,2}([-/.])[0-9]{1,2}\1[1-9][0-9]{3}"
#: Behind a date and a sign of a range.
RANGE = r"(?<=(?<![0-9])(?:[1-9][0-9]{3}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.][1-9][0-9]{3})[-/])"
#: Kind and pattern, the first that fits at a place counts.
KINDS = [
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,63}"),
    ("token", EDGE + r"(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[opsu]_[0-9A-Za-z]{36}|xox[abp]-[0-9A-Za-z-]{10,64}|sk-[0-9A-Za-z]{20,64})" + AFTER),
    ("ipv6", r"(?<![A-Za-z0-9:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![A-Za-z0-9:])"),
    ("secret", EDGE + r"[0-9A-Fa-f]{32,64}" + AFTER),
    ("iban", EDGE + r"[A-Z]{2}[0-9]{2}(?:[0-9A-Z]{11,30}|(?: [0-9A-Z]{4}){2,7}(?: [0-9A-Z]{1,3})?)" + AFTER),
    ("phone", r"(?<![A-Za-z0-9+])(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])|(?<![A-Za-z0-9+])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])|(?<![A-Za-z0-9.-])[0-9]{3}([.-])[0-9]{3}\1[0-9]{4}(?![0-9])|(?<![A-Za-z0-9+.-])(?:1[ .-])?[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"),
    ("date", r"(?:(?<![A-Za-z0-9./-])|" + RANGE + ")(?:" + DATE_YMD.replace(r"\1", r"[-/.]").replace("([-/.])", "[-/.]") + "|" + DATE_DMY.replace(r"\1", r"[-/.]").replace("([-/.])", "[-/.]") + r")(?:(?![A-Za-z0-9])|(?=T[0-9]{2}:?[0-9]{2}))"),
    ("ip", r"(?<![A-Za-z0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![A-Za-z0-9]|\.[0-9])"),
    ("ssn", r"(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-])"),
    ("card", EDGE + r"(?:[0-9]{13,19}|[0-9]{4}(?: [0-9]{4}){3}|[0-9]{4}(?:-[0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})" + AFTER),
]
#: No value starts inside a word, and it holds a digit or @ among its first signs; this rules out most places at once.
GATE = r"(?<![A-Za-z0-9])(?=[0-9A-Za-z+(._%-])(?=\S{0,72}?[0-9@])"
ANY = GATE + "(?:" + ("|".join(f"(?:{p})" for _, p in KINDS) + ")").replace(r"([.-])[0-9]{3}\1", r"[.-][0-9]{3}[.-]")
_PATTERN = {k: p.replace(r"([.-])[0-9]{3}\1", r"[.-][0-9]{3}[.-]") for k, p in KINDS}


def _sub(s, start, length) -> Column:
    wrap = lambda x: F.lit(x) if isinstance(x, int) else x
    return s.substr(wrap(start), wrap(length))


def _let(value: Column, use) -> Column:
    """use(value), with the value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _digest(key: str, kind: str, r, other) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), r.cast("string"), other.cast("string")), 512)


def _number(digest, start: int, digits: int) -> Column:
    return F.conv(_sub(digest, start, digits), 16, 10).cast("bigint")


def _shifted(part: Column, digest: Column, hexadecimal: bool) -> Column:
    """Each character of part moved within its alphabet by its own 16 bits of the digest; at most 32 characters."""

    def one(i, digest):
        c = _sub(part, i, F.lit(1))
        by = F.conv(_sub(digest, (i - 1) * 4 + 1, F.lit(4)), 16, 10).cast("int")
        if hexadecimal:
            place = F.conv(c, 16, 10).cast("int")
            return F.lower(F.conv(((place + by) % 16).cast("string"), 10, 16))
        a = F.ascii(c)
        moved = lambda low, n: F.char((a - low + by) % n + low)
        return F.when(a < 58, moved(48, 10)).when(a < 91, moved(65, 26)).otherwise(moved(97, 26))

    return F.when(F.char_length(part) > 0, _let(digest, lambda d: F.array_join(F.transform(_chars(part), lambda i: one(i, d)), ""))).otherwise(F.lit(""))


def permuted_text(value: Column, key: str, kind: str, hexadecimal: bool = False) -> Column:
    """A keyed permutation of the strings of letters and digits of one shape, up to 64 characters."""
    half = lambda v: (F.char_length(v) / 2).cast("int")
    start = _let(value, lambda v: F.struct(_sub(v, F.lit(1), half(v)).alias("l"), _sub(v, half(v) + 1, F.char_length(v)).alias("r")))

    def step(s, r):
        even = r % 2 == 0
        left = F.when(even, _shifted(s["l"], _digest(key, kind, r, s["r"]), hexadecimal)).otherwise(s["l"])
        right = F.when(even, s["r"]).otherwise(_shifted(s["r"], _digest(key, kind, r, s["l"]), hexadecimal))
        return F.struct(left.alias("l"), right.alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: F.concat(s["l"], s["r"]))


def permuted_number(value: Column, a: int, b: int, key: str, kind: str) -> Column:
    """A keyed permutation of 0 .. a*b-1."""
    start = _let(value, lambda v: F.struct((v / b).cast("bigint").alias("l"), (v % b).cast("bigint").alias("r")))

    def step(s, r):
        even = r % 2 == 0
        left = F.when(even, (s["l"] + _number(_digest(key, kind, r, s["r"]), 1, 12)) % a).otherwise(s["l"])
        right = F.when(even, s["r"]).otherwise((s["r"] + _number(_digest(key, kind, r, s["l"]), 1, 12)) % b)
        return F.struct(left.alias("l"), right.alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: s["l"] * b + s["r"])


def _chars(s: Column) -> Column:
    """A place for every character; never empty."""
    return F.sequence(F.lit(1), F.greatest(F.char_length(s), F.lit(1)))


def _luhn(digits: Column, at_end: int) -> Column:
    """The Luhn sum; at_end is 0 with the check digit and 1 without."""

    def add(total, i, s):
        d = F.ascii(_sub(s, i, F.lit(1))) - 48
        twice = (F.char_length(s) - i + at_end) % 2 == 1
        return total + F.when(twice & (d > 4), d * 2 - 9).when(twice, d * 2).otherwise(d)

    return _let(digits, lambda s: F.aggregate(_chars(s), F.lit(0), lambda total, i: add(total, i, s)))


def _mod97(s: Column) -> Column:
    def add(total, i, s):
        a = F.ascii(_sub(s, i, F.lit(1)))
        return F.when(a < 58, (total * 10 + a - 48) % 97).otherwise((total * 100 + a - 55) % 97)

    return _let(s, lambda x: F.aggregate(_chars(x), F.lit(0), lambda total, i: add(total, i, x)))


def _into(original: Column, new: Column) -> Column:
    """original with its letters and digits replaced, in order, by those of new."""

    def one(i, x):
        c = _sub(x["old"], i, F.lit(1))
        nth = F.char_length(F.regexp_replace(_sub(x["old"], F.lit(1), i), "[^0-9A-Za-z]", ""))
        return F.when(c.rlike("[0-9A-Za-z]"), _sub(x["new"], nth, F.lit(1))).otherwise(c)

    return _let(F.struct(original.alias("old"), new.alias("new")), lambda x: F.array_join(F.transform(_chars(x["old"]), lambda i: one(i, x)), ""))


def _card(m: Column, key: str) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    body = permuted_text(_sub(digits, F.lit(1), F.char_length(digits) - 1), key, "card")
    check = lambda b: ((F.lit(10) - _luhn(b, 1) % 10) % 10).cast("string")
    return F.when(_luhn(digits, 0) % 10 == 0, _into(m, _let(body, lambda b: F.concat(b, check(b))))).otherwise(m)


def _iban(m: Column, key: str) -> Column:
    plain = F.replace(m, F.lit(" "), F.lit(""))
    country, account = _sub(plain, 1, 2), _sub(plain, F.lit(5), F.char_length(plain))
    moved = permuted_text(account, key, "iban")
    check = lambda a: F.lpad((F.lit(98) - _mod97(F.concat(a, country, F.lit("00")))).cast("string"), 2, "0")
    valid = (_mod97(F.concat(account, _sub(plain, 1, 4))) == 1) & (F.char_length(plain) <= 34)
    return F.when(valid, _into(m, _let(moved, lambda a: F.concat(country, check(a), a)))).otherwise(m)


def _date(m: Column, key: str) -> Column:
    part = lambda i: F.regexp_extract(m, r"([0-9]+)[-/.]([0-9]+)[-/.]([0-9]+)", i)
    ymd = F.char_length(part(1)) == 4
    year = F.when(ymd, part(1)).otherwise(part(3))
    made = lambda mm, dd: F.try_to_date(F.concat_ws("-", year, F.lpad(mm, 2, "0"), F.lpad(dd, 2, "0")), "yyyy-MM-dd")
    dmy = made(part(2), part(1))
    day = F.when(ymd, made(part(2), part(3))).otherwise(F.coalesce(dmy, made(part(1), part(2))))
    first, month_first = F.lit("1000-01-01").cast("date"), ~ymd & dmy.isNull()

    def moved(days):
        era = F.floor(days / 146097)  # the Gregorian calendar repeats after 400 years of 146,097 days

        def at(x):
            return F.date_add(first, (era * 146097 + x).cast("int"))

        def walked(x):
            fits = (F.year(at(x)) <= 9999) & (~month_first | (F.dayofmonth(at(x)) > 12))
            return F.when(fits, x).otherwise(permuted_number(x, 189, 773, key, "date"))

        start = permuted_number(days - era * 146097, 189, 773, key, "date")
        return at(F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), start, lambda x, _: walked(x)))

    wide = lambda x, like: F.lpad(x.cast("string"), F.char_length(like), F.lit("0"))
    loose = (F.char_length(part(2)) == 1) | (F.when(ymd, F.char_length(part(3))).otherwise(F.char_length(part(1))) == 1)
    two = lambda x: F.when(loose, x.cast("string")).otherwise(F.lpad(x.cast("string"), 2, "0"))
    s1, s2 = F.regexp_extract(m, r"([-/.])", 1), F.regexp_extract(m, r"[-/.][0-9]+([-/.])", 1)

    def out(new):
        y, mo, d = wide(F.year(new), year), two(F.month(new)), two(F.dayofmonth(new))
        made = F.when(ymd, F.concat(y, s1, mo, s2, d)).when(dmy.isNotNull(), F.concat(d, s1, mo, s2, y)).otherwise(F.concat(mo, s1, d, s2, y))
        return F.when(new.isNotNull() & F.year(new).between(1000, 9999), made).otherwise(m)

    return F.when(s1 == s2, _let(_let(F.datediff(day, first), moved), out)).otherwise(m)


def _ssn(m: Column, key: str) -> Column:
    n = lambda start, length: _sub(m, start, length).cast("int")
    area, group, serial = n(1, 3), n(5, 2), n(8, 4)
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    index = (area - F.when(area > 666, 2).otherwise(1)).cast("bigint") * 989901 + (group - 1) * 9999 + (serial - 1)
    new = permuted_number(index, 898, 989901, key, "ssn")
    pad = lambda x, k: F.lpad(x.cast("string"), k, "0")

    def out(new):
        a, rest = F.floor(new / 989901), new % 989901
        return F.concat(pad(a + F.when(a >= 665, 2).otherwise(1), 3), F.lit("-"), pad(F.floor(rest / 9999) + 1, 2), F.lit("-"), pad(rest % 9999 + 1, 4))

    return F.when(valid, _let(new, out)).otherwise(m)


def _ip(m: Column, key: str) -> Column:
    parts = F.split(m, r"\.")
    octet = lambda i: F.get(parts, F.lit(i)).cast("bigint")
    valid = F.forall(parts, lambda p: p.rlike("^(0|[1-9][0-9]{0,2})$") & (p.cast("int") < 256))
    new = permuted_number(octet(0) * 16777216 + octet(1) * 65536 + octet(2) * 256 + octet(3), 65536, 65536, key, "ip")
    out = lambda new: F.concat_ws(".", *[(F.shiftright(new, s) % 256).cast("string") for s in (24, 16, 8, 0)])
    return F.when(valid, _let(new, out)).otherwise(m)


def _phone(m: Column, key: str) -> Column:
    country = F.regexp_extract(m, r"^(\+[0-9]{1,3}(?=[^0-9])|\+1(?=[0-9])|\+[0-9]{2}(?=[0-9])|1(?=[ .-])|)", 1)
    rest = _sub(m, F.char_length(country) + 1, F.char_length(m))
    digits = F.regexp_replace(rest, "[^0-9]", "")
    fits = F.char_length(digits).between(6, 15)
    return F.when(fits, F.concat(country, _into(rest, permuted_text(digits, key, "phone")))).otherwise(m)


def _email(m: Column, key: str) -> Column:
    local = F.substring_index(m, "@", 1)
    plain = F.regexp_replace(local, "[^0-9A-Za-z]", "")
    return F.when(F.char_length(plain) > 0, F.concat(_into(local, permuted_text(plain, key, "email")), _sub(m, F.char_length(local) + 1, F.char_length(m)))).otherwise(m)


def _secret(m: Column, key: str) -> Column:
    valid, both = m.rlike("[A-Fa-f]") & m.rlike("[0-9]"), m.rlike("[a-f]") & m.rlike("[A-F]")
    new = permuted_text(F.lower(m), key, "secret", True)
    one_case = F.when(m.rlike("[A-F]"), F.upper(new)).otherwise(new)
    return F.when(valid, F.when(both, permuted_text(m, key, "secret")).otherwise(one_case)).otherwise(m)


def _token(m: Column, key: str) -> Column:
    prefix = F.regexp_extract(m, "^(A[KS]IA|gh[opsu]_|xox[abp]-|sk-)", 1)
    rest = _sub(m, F.char_length(prefix) + 1, F.char_length(m))
    return F.concat(prefix, _into(rest, permuted_text(F.regexp_replace(rest, "[^0-9A-Za-z]", ""), key, "token")))


def _ipv6(m: Column, key: str) -> Column:
    digits = F.regexp_replace(m, ":", "")
    new = permuted_text(F.lower(digits), key, "ipv6", True)
    valid = m.rlike("[0-9]") & (F.size(F.filter(F.split(m, ":"), lambda g: F.char_length(g) > 0)) <= 8) & ~(m.rlike("[a-f]") & m.rlike("[A-F]"))
    return F.when(valid, _into(m, F.when(m.rlike("[A-F]"), F.upper(new)).otherwise(new))).otherwise(m)


def pseudonym(m: Column, key: str | None = None) -> Column:
    """The pseudonym of one found value; itself where it isn't valid."""
    key = key or secrets.token_hex(16)
    out = F.lit(None).cast("string")
    makers = {"email": _email, "token": _token, "ipv6": _ipv6, "secret": _secret, "iban": _iban, "phone": _phone, "date": _date, "ip": _ip, "ssn": _ssn, "card": _card}
    for kind, _ in reversed(KINDS):
        # A found value stands without its surroundings here, so the whole of it has to fit.
        out = F.when(m.rlike(f"^(?:{_PATTERN[kind]})$"), makers[kind](m, key)).otherwise(out)
    return F.coalesce(out, m)


def _replaced(docs: DataFrame, key: str | None) -> DataFrame:
    """The columns of docs, with __text and __changed (how many values have pseudonyms)."""
    key = key or secrets.token_hex(16)
    text = F.col("text").cast("string")
    found = F.when(text.rlike("[0-9]") | F.contains(text, F.lit("@")), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
    rows = docs.withColumn("__found", found)
    rows = rows.withColumn("__new", F.when(F.size("__found") > 0, F.transform("__found", lambda m: pseudonym(m, key))))
    parts = F.split(text, ANY, -1)
    joined = F.array_join(F.zip_with(parts, F.col("__new"), lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), "")
    changed = F.size(F.filter(F.zip_with("__found", "__new", lambda a, b: a != b), lambda x: x))
    rows = rows.withColumn("__text", F.when(F.col("__new").isNotNull(), joined).otherwise(text))
    return rows.withColumn("__changed", F.when(F.col("__new").isNotNull(), changed).otherwise(0).cast("long"))


def pseudonymise(docs: DataFrame, key: str | None = None) -> DataFrame:
    """The documents with pseudonyms in ``text``; all columns as they are."""
    out = _replaced(docs, key)
    return out.select(*[F.col("__text").alias("text") if c == "text" else F.col(c) for c in docs.columns])


def pseudonym_report(docs: DataFrame, key: str | None = None) -> DataFrame:
    """doc_id, text with pseudonyms and n_replaced."""
    return _replaced(docs.select("doc_id", "text"), key).select("doc_id", F.col("__text").alias("text"), F.col("__changed").alias("n_replaced"))

"""Format-preserving pseudonyms for personal data by keyed Feistel permutations.

Numbers and dates that are valid as such are replaced by others of the same format: a card number by one that passes the
Luhn test too, a date by a date, an address by an address. Each format is permuted by a Feistel network whose round
function is a keyed SHA-256 digest, so a value has one pseudonym wherever it stands, two values never share one, and
whoever has the key can go back by restored(). Only DataFrame functions run here; a text never leaves its row.

Formats: e-mail addresses (the local part; digits stay digits, a-z and A-Z stay so, letters of other scripts stay in their
script, as far as RANGES has it), IPv4 addresses with octets up to 255, IPv6 addresses (eight groups, or :: among three or
more, with a digit), dates of the years 1800 to 2199 (2001-12-31, 31.12.2001, 31/12/2001, read day first; 12/31/2001,
month first where day first isn't valid), social security numbers with valid parts, phone numbers (+1 (234) 555-0199 with
any country code, (234) 555-0199, 234-555-0199, 234 555 0199, these also after 1 and a space, dot or hyphen), bank account
numbers (IBAN, plain or in groups of four) with valid check digits, card numbers of 13 to 19 digits that pass the Luhn
test, plain or grouped by 4-4-4-4, 4-6-5 or 4-6-4, hexadecimal secrets of 32 to 64 digits named as token, secret, key or
password, and access keys of AKIA or ASIA and 16 characters.
What only looks like one of these, such as a number that fails its test, is left as it is, and so is all other text.

Two exceptions. A date is permuted as the day it is, so that it stays linked in all notations; a day or month written
with one digit comes out with two. A local part with a letter or mark outside RANGES becomes a token of 32 hexadecimal
digits, from which there is no way back.

Cases: null stays null; a text without such data stays as it is. Equal rows change alike, whatever their ids. A text of any
length is changed whole, in its row. Empty tables stay empty. Other columns are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, let, named

#: The key of the queries here. Real use passes a secret.
KEY = "example-key"
ROUNDS = 8

# Fixed patterns, tried in this order at each position.
EMAIL = r"(?<![\p{L}\p{M}\p{N}._%+\-])[\p{L}\p{N}][\p{L}\p{M}\p{N}._%+\-]{0,63}@(?:[A-Za-z0-9\-]{1,63}\.){1,10}[A-Za-z]{2,}"
IPV4 = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)"
DATE_YMD = r"(?<![\d\-])\d{4}-\d{2}-\d{2}(?![\d\-])"
DATE_DMY = r"(?<![\d./])\d{1,2}([./])\d{1,2}\1\d{4}(?!\d|[./]\d)"
SSN = r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"
PHONE = r"(?<![\w+])\+\d{1,3}[ .\-]?(?:\(\d{2,4}\)|\d{2,4})(?:[ .\-]?\d{2,4}){2,4}(?!\d)|(?<![\w(])\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d\-.])\d{3}[\-.]\d{3}[\-.]\d{4}(?![\d\-])" \
    r"|(?<![\w\-.+])(?<!\d )1[ .\-](?:\(\d{3}\) ?|\d{3}[ .\-])\d{3}[ .\-]\d{4}(?![\d\-]| \d)|(?<![\d\-.])(?<!\d )\d{3} \d{3} \d{4}(?![\d\-]| \d)"
CARD = r"(?<!\d)\d{4}(?: \d{4}){3}(?!\d)|(?<!\d)\d{4}(?:-\d{4}){3}(?!\d)|(?<!\d)\d{4} \d{6} \d{4,5}(?!\d)|(?<!\d)\d{4}-\d{6}-\d{4,5}(?!\d)|(?<!\d)\d{13,19}(?!\d)"
SECRET = r"(?<=(?i:token|secret|key|password)[ ]{0,3}[=:][ ]{0,3}[\"']?)[0-9A-Fa-f]{32,64}(?![0-9A-Za-z])"
IPV6 = r"(?<![\w:.])(?=[0-9A-Fa-f:]*\d)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){2,6}(?::[0-9A-Fa-f]{1,4}){1,5})(?![\w:]|\.\d)"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}| [A-Z0-9]{4}(?: (?=[A-Z0-9]{0,3}\d)[A-Z0-9]{4}){1,6}(?: \d{1,3})?)(?![A-Za-z0-9])"
ACCESS = r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])"
ALL = "|".join((EMAIL, SECRET, IPV6, ACCESS, IBAN, IPV4, DATE_YMD, DATE_DMY, SSN, PHONE, CARD))
#: What every match has.
SIGN = "[0-9@]|AKIA|ASIA"
#: Letters outside a-z and A-Z that move among themselves, as first and last code point: Latin, Greek, Cyrillic (capitals
#: and small letters apart), Armenian, Hebrew, Arabic, Devanagari, Thai, Georgian, kana, Han and Hangul.
RANGES = (
    (0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0xC0, 0xD6), (0xD8, 0xDE), (0xDF, 0xF6), (0xF8, 0xFF), (0x100, 0x17F), (0x391, 0x3A1), (0x3A3, 0x3AB), (0x3AC, 0x3CE), (0x400, 0x42F), (0x430, 0x45F),
    (0x531, 0x556), (0x561, 0x586), (0x5D0, 0x5EA), (0x621, 0x63A), (0x641, 0x64A), (0x905, 0x939), (0xE01, 0xE2E), (0x10D0, 0x10F0), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3),
)

#: 400 years have 146,097 days, whatever years they are: 27 times 5,411.
EPOCH, DAYS = "1800-01-01", (27, 5411)
LEAP_YEARS = [y for y in range(1800, 2200) if y % 4 == 0 and (y % 100 or y % 400 == 0)]
LONG_MONTHS = [1, 3, 5, 7, 8, 10, 12]


def _digest(key: str, kind: str, r: Column, other: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{key}|{kind}|"), r.cast("string"), F.lit("|"), other.cast("string")), 256)


def _number(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def _rounds(back: bool) -> Column:
    return F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if back else F.sequence(F.lit(0), F.lit(ROUNDS - 1))


def permute_pair(a: Column, b: Column, sizes: tuple[int, int], key: str, kind: str, back: bool = False) -> Column:
    """A permutation of the pairs of a in [0, sizes[0]) and b in [0, sizes[1]), as a struct of a and b; back: its inverse."""
    moved = lambda x, by, n: F.pmod(x - by if back else x + by, F.lit(n).cast("bigint"))

    def step(s: Column, r: Column) -> Column:
        left, right = s["a"], s["b"]
        return F.when(r % 2 == 0, F.struct(moved(left, _number(_digest(key, kind, r, right)), sizes[0]).alias("a"), right.alias("b"))).otherwise(
            F.struct(left.alias("a"), moved(right, _number(_digest(key, kind, r, left)), sizes[1]).alias("b"))
        )

    start = F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b"))
    return F.aggregate(_rounds(back), start, step)


def _in_classes(classes: list[str], back: bool):
    """A character moved on within its class by two digits of a digest d, those of place i; others as they are."""

    def of(c: Column, i: Column, d: Column) -> Column:
        by = F.conv(F.substr(d, i % 32 * 2 + 1, F.lit(2)), 16, 10).cast("int")
        out = c
        for x in classes:
            at = F.position(c, F.lit(x))
            to = F.pmod(at - 1 - by if back else at - 1 + by, F.lit(len(x)))
            out = F.when(at > 0, F.substr(F.lit(x), to + 1, F.lit(1))).otherwise(out)
        return out

    return of


def _in_ranges(back: bool):
    """A character moved on within its range of code points by four digits of a digest."""

    def of(c: Column, i: Column, d: Column) -> Column:
        by = F.conv(F.substr(d, i % 16 * 4 + 1, F.lit(4)), 16, 10).cast("int")
        put = lambda n: F.decode(F.unhex(F.lpad(F.hex(n.cast("bigint")), 4, "0")), "UTF-16BE")

        def chosen(p: Column) -> Column:
            out = c
            for low, high in RANGES:
                to = F.pmod(p - low - by if back else p - low + by, F.lit(high - low + 1)) + low
                out = F.when(p.between(low, high), put(to)).otherwise(out)
            return out

        return let(F.ascii(c), chosen)

    return of


def permute_text(text: Column, key: str, kind: str, hexadecimal: bool = False, back: bool = False, ranges: bool = False) -> Column:
    """A permutation of the texts of the same form: digits stay digits, a-z and A-Z stay so, all else stays as it is.

    The two halves of the text take turns: each character of one is moved on within its class by the other's digest.
    ranges: letters of RANGES move too. back: the inverse.
    """
    digits = "0123456789abcdef" if hexadecimal else "0123456789"
    classes = [digits, "ABCDEF"] if hexadecimal else [digits, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]
    of = _in_ranges(back) if ranges else _in_classes(classes, back)

    def moved(half: Column, other: Column, r: Column) -> Column:
        chars = lambda d: F.array_join(F.transform(F.split(half, ""), lambda c, i: of(c, i, d)), "")
        return F.when(F.length(half) == 0, half).otherwise(let(_digest(key, kind, r, other), chars))

    def step(s: Column, r: Column) -> Column:
        a, b = s["a"], s["b"]
        return F.when(r % 2 == 0, F.struct(moved(a, b, r).alias("a"), b.alias("b"))).otherwise(F.struct(a.alias("a"), moved(b, a, r).alias("b")))

    half = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(F.substr(text, F.lit(1), half).alias("a"), F.substr(text, half + 1).alias("b"))
    return let(F.aggregate(_rounds(back), start, step), lambda s: F.concat(s["a"], s["b"]))


def permute_local(local: Column, key: str, back: bool = False) -> Column:
    """The local part of an address: by classes if it is ASCII, by ranges if they have all of it, else a token."""
    known = "".join(f"\\x{{{low:x}}}-\\x{{{high:x}}}" for low, high in RANGES)
    token = F.substring(F.sha2(F.concat(F.lit(f"{key}|email|"), local), 256), 1, 32)
    return (
        F.when(local.rlike(r"^[\x00-\x7f]*$"), permute_text(local, key, "email", back=back))
        .when(local.rlike(rf"^[{known}._%+\-]*$"), permute_text(local, key, "email", back=back, ranges=True))
        .otherwise(local if back else token)
    )


def check_digits(rest: Column) -> Column:
    """The remainder by 97 of digits and letters A-Z read as 10 to 35."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

    def add(a: Column, c: Column) -> Column:
        at = F.position(c, F.lit(letters))
        return F.when(at > 0, (a * 100 + at + 9) % 97).otherwise((a * 10 + F.coalesce(c.try_cast("int"), F.lit(0))) % 97)

    return F.aggregate(F.split(rest, ""), F.lit(0), add)


def permute_iban(iban: Column, key: str, back: bool = False) -> Column:
    """A bank account number with valid check digits for one that has them; others as they are."""

    def of(x: Column) -> Column:
        country, body = F.substr(x, F.lit(1), F.lit(2)), F.substr(x, F.lit(5))
        check = lambda y: F.lpad((98 - check_digits(F.concat(y, country, F.lit("00")))).cast("string"), 2, "0")
        new = let(permute_text(body, key, "iban", back=back), lambda y: F.concat(country, check(y), y))
        valid = check(body) == F.substr(x, F.lit(3), F.lit(2))
        return F.when(~valid, iban).when(iban.contains(" "), F.regexp_replace(new, "(.{4})(?=.)", "$1 ")).otherwise(new)

    return let(F.translate(iban, " ", ""), of)


def luhn_sum(digits: Column, doubled_first: Column) -> Column:
    """The Luhn sum of digits from the right; doubled_first: whether the last one counts double."""
    n = F.length(digits)

    def of(c: Column, i: Column) -> Column:
        d = c.cast("int")
        double = ((n - 1 - i) % 2 == 0) == doubled_first
        return F.when(double, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.transform(F.split(digits, ""), of), F.lit(0), lambda a, x: a + x)


def permute_card(card: Column, key: str, back: bool = False) -> Column:
    """A card number that passes the Luhn test, for one that does; others as they are. Groups stay as written."""

    def of(d: Column) -> Column:
        n = F.length(d)
        new = let(permute_text(F.substr(d, F.lit(1), n - 1), key, "card", back=back), lambda x: F.concat(x, ((10 - luhn_sum(x, F.lit(True)) % 10) % 10).cast("string")))
        sep = F.substr(card, F.lit(5), F.lit(1))
        grouped = let(new, lambda x: F.concat(F.substr(x, F.lit(1), F.lit(4)), sep, F.substr(x, F.lit(5), F.lit(4)), sep, F.substr(x, F.lit(9), F.lit(4)), sep, F.substr(x, F.lit(13))))
        wide = let(new, lambda x: F.concat(F.substr(x, F.lit(1), F.lit(4)), sep, F.substr(x, F.lit(5), F.lit(6)), sep, F.substr(x, F.lit(11))))
        return F.when(luhn_sum(d, F.lit(False)) % 10 != 0, card).when(F.length(card) == n, new).when(n < 16, wide).otherwise(grouped)

    return let(F.regexp_replace(card, "[^0-9]", ""), of)


def permute_ip(ip: Column, key: str, back: bool = False) -> Column:
    """An IPv4 address for one whose octets are 255 at most; others as they are."""

    def of(p: Column) -> Column:
        o = F.transform(p, lambda x: x.cast("int"))
        pair = let(o, lambda v: permute_pair(v[0] * 256 + v[1], v[2] * 256 + v[3], (65536, 65536), key, "ip", back))
        text = let(pair, lambda s: F.concat_ws(".", F.floor(s["a"] / 256).cast("string"), (s["a"] % 256).cast("string"), F.floor(s["b"] / 256).cast("string"), (s["b"] % 256).cast("string")))
        return F.when(F.exists(o, lambda x: x > 255), ip).otherwise(text)

    return let(F.split(ip, r"\."), of)


def permute_month_first(day: Column, key: str, back: bool = False) -> Column:
    """MM/dd/yyyy for a date of the years 1800 to 2199 whose day is after the 12th, by another such date.

    The days up to the 28th, the 29th and 30th, the 31st and 29 February are permuted each among themselves, so that no
    result can be read day first.
    """
    y, m, d = F.year(day) - 1800, F.month(day), F.dayofmonth(day)
    put = lambda year, month, dom: F.concat_ws("/", F.lpad(month.cast("int").cast("string"), 2, "0"), dom.cast("int").cast("string"), (year + 1800).cast("int").cast("string"))
    pair = lambda a, b, sizes, kind, then: let(permute_pair(a, b, sizes, key, kind, back), then)
    longs, leaps = (F.array(*map(F.lit, x)) for x in (LONG_MONTHS, LEAP_YEARS))
    usual = pair(y * 12 + m - 1, d - 13, (4800, 16), "month first", lambda s: put(F.floor(s["a"] / 12), s["a"] % 12 + 1, s["b"] + 13))
    late = pair(y * 11 + m - F.when(m > 2, 2).otherwise(1), d - 29, (4400, 2), "month first late", lambda s: put(F.floor(s["a"] / 11), let(s["a"] % 11, lambda x: x + F.when(x > 0, 2).otherwise(1)), s["b"] + 29))
    last = pair(y, F.array_position(longs, m) - 1, (400, 7), "month first last", lambda s: put(s["a"], F.get(longs, s["b"].cast("int")), F.lit(31)))
    leap = pair(F.array_position(leaps, y + 1800) - 1, F.lit(0), (len(LEAP_YEARS), 1), "month first leap", lambda s: put(F.get(leaps, s["a"].cast("int")) - 1800, F.lit(2), F.lit(29)))
    return F.when(d <= 28, usual).when(d == 31, last).when(m == 2, leap).otherwise(late)


def permute_date(date: Column, key: str, back: bool = False) -> Column:
    """A date in the same notation for a date of the years 1800 to 2199; others as they are."""
    iso = F.substr(date, F.lit(5), F.lit(1)) == "-"
    plain = F.when(iso, date).otherwise(F.regexp_replace(date, r"^(\d+)[./](\d+)[./](\d+)$", "$3-$2-$1"))
    american = F.try_to_date(F.regexp_replace(date, r"^(\d+)/(\d+)/(\d+)$", "$3-$1-$2"), "yyyy-M-d")
    day = F.datediff(F.try_to_date(plain, "yyyy-M-d"), F.lit(EPOCH).cast("date"))

    def of(n: Column) -> Column:
        size = DAYS[0] * DAYS[1]
        new = let(permute_pair(n % DAYS[0], F.floor(n / DAYS[0]), DAYS, key, "date", back), lambda s: F.date_add(F.lit(EPOCH).cast("date"), (s["b"] * DAYS[0] + s["a"]).cast("int")))
        sep = F.regexp_extract(date, "[./]", 0)
        put = let(new, lambda d: F.when(iso, F.date_format(d, "yyyy-MM-dd")).otherwise(F.concat(F.date_format(d, "dd"), sep, F.date_format(d, "MM"), sep, F.date_format(d, "yyyy"))))
        month_first = let(american, lambda x: F.when(F.year(x).between(1800, 2199), permute_month_first(x, key, back)).otherwise(date))
        return F.when(n.isNull() & date.contains("/"), month_first).when(n.isNull() | (n < 0) | (n >= size), date).otherwise(put)

    return let(day, of)


def permute_ssn(ssn: Column, key: str, back: bool = False) -> Column:
    """A valid number for a valid one: area 001 to 899 but 666, group 01 to 99, serial 0001 to 9999."""
    area, group, serial = (F.substr(ssn, F.lit(at), F.lit(n)).cast("int") for at, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area >= 1) & (area <= 899) & (area != 666) & (group >= 1) & (serial >= 1)
    rank = area - 1 - F.when(area > 666, 1).otherwise(0)

    def put(s: Column) -> Column:
        a = s["a"] + 1 + F.when(s["a"] + 1 >= 666, 1).otherwise(0)
        return F.concat_ws("-", F.lpad(a.cast("string"), 3, "0"), F.lpad((F.floor(s["b"] / 9999) + 1).cast("string"), 2, "0"), F.lpad((s["b"] % 9999 + 1).cast("string"), 4, "0"))

    return F.when(valid, let(permute_pair(rank, (group - 1) * 9999 + serial - 1, (898, 99 * 9999), key, "ssn", back), put)).otherwise(ssn)


def pseudonym(m: Column, key: str, back: bool = False) -> Column:
    """What a match of ALL is replaced by; itself if it isn't valid. back: the value that a pseudonym stands for."""
    local = F.regexp_extract(m, "^[^@]*", 0)
    country = F.regexp_extract(m, r"^\+\d+|^1(?=[ .\-])", 0)
    return (
        F.when(m.contains("@"), F.concat(permute_local(local, key, back), F.regexp_extract(m, "@.*$", 0)))
        .when(m.rlike(r"^[0-9A-Fa-f]{32,64}$"), permute_text(m, key, "secret", hexadecimal=True, back=back))
        .when(m.contains(":"), permute_text(m, key, "ipv6", hexadecimal=True, back=back))
        .when(m.rlike(r"^A[KS]IA[0-9A-Z]{16}$"), F.concat(F.substr(m, F.lit(1), F.lit(4)), permute_text(F.substr(m, F.lit(5)), key, "access", back=back)))
        .when(m.rlike(r"^[A-Z]{2}\d{2}"), permute_iban(m, key, back))
        .when(m.rlike(r"^(\d{1,3}\.){3}\d{1,3}$"), permute_ip(m, key, back))
        .when(m.rlike(r"^\d{4}-\d{2}-\d{2}$|^\d{1,2}[./]\d{1,2}[./]\d{4}$"), permute_date(m, key, back))
        .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), permute_ssn(m, key, back))
        .when(m.rlike(r"^\d{4}[ \-]?\d{4}[ \-]?\d{4}[ \-]?\d{1,7}$|^\d{4}[ \-]\d{6}[ \-]\d{4,5}$|^\d{13,19}$"), permute_card(m, key, back))
        .otherwise(F.concat(country, permute_text(F.substr(m, F.length(country) + 1), key, "phone", back=back)))
    )


def replaced(text: Column, key: str = KEY, back: bool = False) -> Column:
    """A struct of the text with its personal data replaced and n_replaced, how many values were. back: with it restored."""

    def of(found: Column) -> Column:
        new = F.transform(found, lambda m: pseudonym(m, key, back))
        rest = F.split(text, ALL, -1)
        n = let(new, lambda x: F.struct(
            let(rest, lambda r: F.array_join(F.transform(r, lambda piece, i: F.concat(piece, F.coalesce(F.get(x, i), F.lit("")))), "")).alias("text"),
            F.size(F.filter(F.zip_with(found, x, lambda a, b: a != b), lambda y: y)).cast("bigint").alias("n_replaced"),
        ))
        return F.when(F.size(found) == 0, F.struct(text.alias("text"), F.lit(0).cast("bigint").alias("n_replaced"))).otherwise(n)

    plain = F.struct(text.alias("text"), F.lit(0).cast("bigint").alias("n_replaced"))
    return F.when(text.rlike(SIGN), let(F.regexp_extract_all(text, F.lit(ALL), F.lit(0)), of)).otherwise(plain)


def replace_pii(docs: DataFrame, text: str = "text", key: str = KEY, count: str | None = None, back: bool = False) -> DataFrame:
    """docs with the text column replaced; with count, a column of that name tells how many values were."""
    (made,) = fresh([*docs.columns, count or ""], "replaced")
    out = docs.withColumn(made, replaced(named(text), key, back)).withColumn(text, F.col(f"{made}.text"))
    return (out.withColumn(count, F.col(f"{made}.n_replaced")) if count else out).drop(made)


def restored(docs: DataFrame, text: str = "text", key: str = KEY) -> DataFrame:
    """docs with the values that replace_pii() replaced by this key, but for the exceptions above."""
    return replace_pii(docs, text, key, back=True)

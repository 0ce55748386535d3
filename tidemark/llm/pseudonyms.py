"""Format-preserving pseudonyms by a keyed Feistel permutation, as DataFrame expressions only.

A value is read as a number of its format's domain, split into two halves, and permuted by
``ROUNDS`` Feistel rounds whose round function is HMAC-SHA-256 (for mail boxes HMAC-SHA-512); the
result is written back in the same format. The permutation depends on the key and the format
alone, so equal values stay equal across documents however they are spelt, different values stay
different, and whoever has the key can invert it.

Formats and their domains:

- card: 13 to 19 digits, alone or in groups joined by single spaces or hyphens, valid under the
  Luhn check. All digits but the last are permuted, the last is the new check digit.
- phone: 7 to 15 digits after a plus sign, or ten digits as ``(ddd) ddd-dddd`` or ``ddd-ddd-dddd``
  (also with dots, and with ``1`` in front), which are numbers of country code 1. The digits after
  the country code are permuted, by one permutation a code and length, whatever stands between them;
  a trunk zero in brackets after the code stays and is no digit of the number.
- national id (ddd-dd-dddd): all digits.
- ip: four numbers of 0 to 255; the 32 bits are permuted.
- date: year-month-day, also with slashes; day/month/year, also with dots and of one digit; and
  month/day/year where day/month is no date. Real days of 1900 to 2099; days are permuted, those
  of the last form among the days after the twelfth, so that it stays apart from the others.
- email: letters and digits of the mail box, of any length, are permuted, each among the letters
  of its own alphabet (``ALPHABETS``) or the digits; letters of other scripts, signs and the
  domain stay, and so do signs in front.

Not covered: names, postal addresses, IBAN, IPv6, dates with names of months.
"""

from __future__ import annotations

import hashlib
import secrets
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import DOC_COLUMNS, free_name, read_documents

ROUNDS = 8
_KEY = "spark.tidemark.pseudonym.key"
MARK = "\u0001"

# Formats, the most specific first.
_EMAIL = r"(?<![\p{L}\p{N}._%+'-])[\p{L}\p{N}._%+'-]++(?<=[\p{L}\p{N}][._%+'-]{0,64})@[\p{L}\p{N}][\p{L}\p{N}.-]*\.\p{L}{2,63}(?![\p{L}\p{N}])"
_IP = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)"
_DATE = r"(?<![\d/.-])(?:(?:19|20)\d\d-[01]\d-[0-3]\d|(?:19|20)\d\d/[01]\d/[0-3]\d|[0-3]?\d/[0-3]?\d/(?:19|20)\d\d|[0-3]?\d\.[01]?\d\.(?:19|20)\d\d)(?![\d/-]|\.\d)"
_NATIONAL = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
_CARD = r"(?<!\d)(?<!\d\.)(?:\d{4}(?:[ -]\d{4}){2}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})(?!\d)"
_PHONE = r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<!\d)(?<!\d[.-])(?:1[ .-]?)?\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<!\d)(?<!\d[.-])(?:1[ .-])?\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])"
_ANY = "|".join([_EMAIL, _IP, _DATE, _NATIONAL, _CARD, _PHONE])
# Country calling codes of one and two digits; all others have three.
_COUNTRY = r"^(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
# First and last letter of the alphabets of mail boxes.
ALPHABETS = [
    "az", "àö", "øÿ", "ÀÖ", "ØÞ", "Āſ", "ΑΡ", "ΣΩ", "αω", "ая", "АЯ", "ѐџ", "ЀЏ", "ԱՖ", "աֆ", "את", "ءغ",
    "في", "अह", "กะ", "აჰ", "ぁゖ", "ァヺ", "一鿿", "가힣",
]
#: Days of 1900-01-01 to 2099-12-31; the halves' product, 73051, exceeds them by two.
_FIRST_DAY, _DAYS, _DAYS_A, _DAYS_B = "1900-01-01", 73049, 229, 319
#: How often a number outside the domain is permuted again: all steps fail once in 10^25 values of the smallest domain.
_WALK = 64


def mac(key: str, message: Column, bits: int = 256) -> Column:
    """HMAC of a string under the key, as hexadecimal digits."""
    block = 64 if bits == 256 else 128
    raw = key.encode("utf-8")
    raw = (hashlib.new(f"sha{bits}", raw).digest() if len(raw) > block else raw).ljust(block, b"\0")
    inner, outer = (F.lit(bytes(x ^ pad for x in raw)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), bits))), bits)


def feistel(value: Column, a: Column, b: Column, key: str, tag: Column) -> Column:
    """Keyed permutation of 0 .. a*b - 1: the halves below a and b take turns in being shifted."""

    def step(s: Column, i: Column) -> Column:
        def shift(half: str, other: str, size: str) -> Column:
            f = F.conv(F.substring(mac(key, F.concat_ws("|", tag, i.cast("string"), s[other].cast("string"))), 1, 13), 16, 10).cast("long")
            return F.pmod(s[half] + f, s[size])

        even = i % 2 == 0
        return F.struct(
            F.when(even, shift("l", "r", "a")).otherwise(s["l"]).alias("l"),
            F.when(even, s["r"]).otherwise(shift("r", "l", "b")).alias("r"),
            s["a"].alias("a"),
            s["b"].alias("b"),
        )

    a, b = a.cast("long"), b.cast("long")
    start = F.struct(F.floor(value / b).cast("long").alias("l"), F.pmod(value, b).alias("r"), a.alias("a"), b.alias("b"))
    return F.aggregate(F.array(*(F.lit(i) for i in range(ROUNDS))), start, step, lambda s: s["l"] * s["b"] + s["r"])


def _power(n: Column) -> Column:
    return F.rpad(F.lit("1"), (n + 1).cast("int"), F.lit("0")).cast("long")


def _permute_digits(digits: Column, key: str, tag: Column) -> Column:
    """A string of 1 to 18 digits, permuted among the strings of its length."""
    n = F.length(digits)
    half = F.floor(n / 2).cast("int")
    out = feistel(digits.cast("long"), _power(n - half), _power(half), key, F.concat(tag, n.cast("string")))
    return F.lpad(out.cast("string"), n, F.lit("0"))


def _luhn_sum(digits: Column, skip: int) -> Column:
    """Luhn sum; every second digit from the right is doubled, beginning with the last if skip is 0."""
    rev = F.split(F.reverse(digits), "(?!^)(?!$)")
    parts = F.transform(rev, lambda x, i: F.when((i + skip) % 2 == 1, x.cast("int")).otherwise(x.cast("int") * 2 - F.when(x.cast("int") > 4, F.lit(9)).otherwise(F.lit(0))))
    return F.aggregate(parts, F.lit(0), lambda s, x: s + x)


def _refill(shape: Column, digits: Column) -> Column:
    """The shape's characters with its digits replaced, in order."""
    cells = F.split(shape, "(?!^)(?!$)")
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    step = lambda s, c: F.struct(
        F.concat(s["out"], F.when(c.rlike("^[0-9]$"), F.substring(digits, s["at"], F.lit(1))).otherwise(c)).alias("out"),
        (s["at"] + F.when(c.rlike("^[0-9]$"), 1).otherwise(0)).alias("at"),
    )
    return F.aggregate(cells, start, step, lambda s: s["out"])


def _card(v: Column, key: str) -> Column:
    digits = F.regexp_replace(v, "[^0-9]", "")
    body = F.substring(digits, F.lit(1), F.length(digits) - 1)
    new = _permute_digits(body, key, F.lit("card"))
    check = F.pmod(10 - _luhn_sum(new, 0) % 10, F.lit(10)).cast("string")
    return F.when((_luhn_sum(digits, 1) % 10 == 0) & F.length(digits).between(13, 19), _refill(v, F.concat(new, check)))


def _phone(v: Column, key: str) -> Column:
    digits = F.regexp_replace(v, "[^0-9]", "")
    abroad = v.startswith("+")
    code = F.when(abroad, F.regexp_extract(digits, _COUNTRY, 1)).otherwise("1")
    trunk = abroad & v.rlike(r"^\+\d{1,3}[ .-]?\(0\)") & F.substring(digits, F.length(code) + 1, F.lit(1)).eqNullSafe(F.lit("0"))
    written = F.when(trunk, F.concat(code, F.lit("0"))).when(abroad | (F.length(digits) == 11), code).otherwise("")
    rest = F.substring(digits, F.length(written) + 1, F.length(digits))
    new = F.concat(written, _permute_digits(rest, key, F.concat(F.lit("phone"), code, F.lit("/"))))
    return F.when(F.length(digits).between(7, 15) & (F.length(rest) > 3), _refill(v, new))


def _ip(v: Column, key: str) -> Column:
    n = F.aggregate(F.split(v, r"\."), F.lit(0).cast("long"), lambda s, x: s * 256 + x.cast("long"))
    p = feistel(n, F.lit(65536), F.lit(65536), key, F.lit("ip"))
    return F.concat_ws(".", *(F.pmod(F.floor(p / d), F.lit(256)).cast("string") for d in (16777216, 65536, 256, 1)))


def _day(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")


def _date(v: Column, key: str) -> Column:
    parts = F.split(v, "[-/.]")
    year_first = v.rlike(r"^\d{4}")
    plain = F.when(year_first, _day(parts[0], parts[1], parts[2])).otherwise(_day(parts[2], parts[1], parts[0]))
    american = F.when(plain.isNull() & v.contains("/") & ~year_first, _day(parts[2], parts[0], parts[1]))
    first = F.lit(_FIRST_DAY).cast("date")
    real = F.coalesce(plain, american)
    late = plain.isNull()
    tag = F.when(late, "date late").otherwise("date")

    def walk(n: Column, i: Column) -> Column:
        good = (i > 0) & (n < _DAYS) & (~late | (F.day(F.date_add(first, n.cast("int"))) > 12))
        return F.when(good, n).otherwise(feistel(n, F.lit(_DAYS_A), F.lit(_DAYS_B), key, tag))

    n = F.aggregate(F.sequence(F.lit(0), F.lit(_WALK)), F.datediff(real, first).cast("long"), walk)
    p = F.date_add(first, n.cast("int"))
    wide = v.rlike(r"\b\d\d[/.]\d\d[/.]")
    sep = F.when(v.contains("-"), "-").when(v.contains("/"), "/").otherwise(".")
    number = lambda x: F.when(year_first | wide, F.lpad(x.cast("string"), 2, "0")).otherwise(x.cast("string"))
    y, m, d = F.year(p).cast("string"), number(F.month(p)), number(F.day(p))
    joined = lambda *x: F.concat(x[0], sep, x[1], sep, x[2])
    shape = F.when(year_first, joined(y, m, d)).when(late, joined(m, d, y)).otherwise(joined(d, m, y))
    return F.when(real.isNotNull() & real.between(first, F.lit("2099-12-31").cast("date")), shape)


def _email(v: Column, key: str) -> Column:
    """The mail box, letter by letter: each step's shift depends on the whole of the other half."""
    whole, domain = F.substring_index(v, "@", 1), F.substring_index(v, "@", -1)
    lead = F.regexp_extract(whole, r"^[._%+'-]*", 0)
    spelt = F.substring(whole, F.length(lead) + 1, F.length(whole))
    box = F.translate(spelt, ascii_uppercase, ascii_lowercase)
    n = F.length(box)
    half = F.greatest(F.floor(n / 2), F.lit(1)).cast("int")
    start = F.struct(F.substring(box, F.lit(1), half).alias("l"), F.substring(box, half + 1, n).alias("r"))
    alphabets = F.array(*(F.struct(F.lit(ord(x[0])).alias("a"), F.lit(ord(x[1]) - ord(x[0]) + 1).alias("n")) for x in ALPHABETS))

    def moved(part: Column, other: Column, i: Column) -> Column:
        pad = mac(key, F.concat_ws("|", F.lit("email"), i.cast("string"), other, F.lower(domain), n.cast("string")), 512)
        cells = F.split(part, "(?!^)(?!$)")

        def cell(c: Column, at: Column) -> Column:
            f = F.conv(F.substring(pad, (at % 32) * 4 + 1, F.lit(4)), 16, 10).cast("int")
            code = F.ascii(c)
            shifted = lambda base, size: F.char(base + F.pmod(code - base + f, F.lit(size)))
            own = F.get(F.filter(alphabets, lambda x: (code >= x["a"]) & (code < x["a"] + x["n"])), F.lit(0))
            far = own["a"] + F.pmod(code - own["a"] + f, own["n"])
            far = F.decode(F.unhex(F.lpad(F.hex(far), 4, "0")), "UTF-16BE")
            plain = F.when(c.rlike("^[a-z]$"), shifted(97, 26)).when(c.rlike("^[0-9]$"), shifted(48, 10))
            return plain.when(code > 127, F.coalesce(far, c)).otherwise(c)

        return F.array_join(F.transform(cells, cell), "")

    def step(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(F.when(even, moved(s["l"], s["r"], i)).otherwise(s["l"]).alias("l"), F.when(even, s["r"]).otherwise(moved(s["r"], s["l"], i)).alias("r"))

    new = F.aggregate(F.array(*(F.lit(i) for i in range(ROUNDS))), start, step, lambda s: F.concat(s["l"], s["r"]))
    cells = lambda x: F.split(x, "(?!^)(?!$)")
    cased = F.array_join(F.zip_with(cells(spelt), cells(new), lambda old, c: F.when(old.rlike("^[A-Z]$"), F.upper(c)).otherwise(c)), "")
    return F.concat(lead, cased, F.lit("@"), domain)


def pseudonym(v: Column, key: str) -> Column:
    """The pseudonym of one matched value; the value itself where its format's check fails."""
    whole = lambda p: v.rlike(f"^(?:{p})$")
    out = (
        F.when(v.contains("@"), _email(v, key))
        .when(whole(_IP), _ip(v, key))
        .when(whole(_DATE), _date(v, key))
        .when(whole(_NATIONAL), _refill(v, _permute_digits(F.regexp_replace(v, "-", ""), key, F.lit("national"))))
        .when(whole(_CARD), _card(v, key))
        .otherwise(_phone(v, key))
    )
    return F.coalesce(out, v)


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """Replaces the personal data of every text by pseudonyms of the same format.

    Keeps all rows and columns of ``docs`` (only ``text`` is needed), with the new ``text`` and two
    more columns, ``n_found`` (values that look like one of the formats) and ``n_replaced`` (those
    whose check held and that changed). A null text stays null with 0 and 0; texts without such
    values stay byte for byte as they are, also if they hold the character U+0001. ``key`` is the
    secret, and not empty: equal keys give equal pseudonyms in every run. Columns of the two new
    names are replaced. Repeated rows change alike.
    """
    if not key:
        raise ValueError("pseudonyms need a secret key")
    text = F.col("text")
    safe = F.replace(F.replace(text, F.lit("\u0002"), F.lit("\u00022")), F.lit(MARK), F.lit("\u00021"))
    split = F.split(F.regexp_replace(safe, f"({_ANY})", f"{MARK}$1{MARK}"), MARK, -1)
    hit = F.when(text.rlike(r"[0-9@]"), split)
    rows = docs.drop("n_found", "n_replaced")
    parts, new = (free_name(x, rows.columns) for x in ("parts", "new"))
    rows = rows.withColumn(parts, F.when(F.size(hit) > 1, hit))
    rows = rows.withColumn(new, F.transform(parts, lambda x, i: F.when(i % 2 == 1, pseudonym(x, key)).otherwise(x)))
    out = F.replace(F.replace(F.array_join(new, ""), F.lit("\u00021"), F.lit(MARK)), F.lit("\u00022"), F.lit("\u0002"))
    changed = F.size(F.filter(F.arrays_zip(F.col(parts).alias("a"), F.col(new).alias("b")), lambda x: x["a"] != x["b"]))
    none = F.col(parts).isNull()
    return (
        rows.withColumn("text", F.when(none, text).otherwise(out))
        .withColumn("n_found", F.when(none, 0).otherwise(((F.size(parts) - 1) / 2).cast("int")))
        .withColumn("n_replaced", F.when(none, 0).otherwise(changed))
        .drop(parts, new)
    )


def secret(spark: SparkSession) -> str:
    """The key of the registered queries, ``spark.tidemark.pseudonym.key``; where it is unset, a random one that the
    session keeps: its pseudonyms are linked within the session, and nobody can invert them afterwards."""
    key = spark.conf.get(_KEY, "")
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set(_KEY, key)
    return key


def op10_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(read_documents(spark, sf_dir), secret(spark)).select(*DOC_COLUMNS, "n_found", "n_replaced")

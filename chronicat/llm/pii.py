"""PII: format-preserving Feistel pseudonyms, in DataFrame functions only.

Numbers and dates are found, validated and replaced by a keyed permutation of
their own format, so equal values stay linked across documents, different ones
stay apart, and nothing can be read back without the key. The domains:

- card numbers: the digits between the first and the check digit; length, layout
  and a valid check digit stay;
- phone numbers: area 200 to 999 and, apart from each other, exchanges from 200
  on and below; country code and layout stay;
- social-security numbers: area 001 to 899 without 666, group 01 to 99, serial
  0001 to 9999;
- IPv4 addresses: all; dates: 1700-01-01 to 2099-12-31, in the same notation;
- local parts of mail addresses, access keys and ``password=`` values: each
  letter or digit within its class (a-z, A-Z, 0-9), all of them depending on
  all others; other characters and the mail domain stay.

Defined cases: null text stays null; values that fail validation stay; where
two patterns match at one place the first of ANY counts; repeated rows get the
same text; very long texts are searched whole; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

ROUNDS = 8
#: The setting that op7 takes its key from, and the key of tests and checks.
KEY_CONF, EXAMPLE_KEY = "spark.chronicat.pii.key", "example key; give your own"

EMAIL = r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9](?:[A-Za-z0-9-]{0,62}\.){1,8}[A-Za-z]{2,24}"
PHONE = r"(?<![\w+])(?:\+1 ?)?(?:\([2-9]\d{2}\) ?|[2-9]\d{2}[-. ])\d{3}[-. ]\d{4}(?!\d)"
IP = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.]*\d)"
DATE = r"(?<!\d)(?:1[7-9]|20)\d{2}[-/](?:0[1-9]|1[0-2])[-/](?:0[1-9]|[12]\d|3[01])(?!\d)"
SSN = r"(?<![\d-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\d-])"
CARD = r"(?<![\w.])[2-6]\d{3}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?![\w])"
SECRET = r"AKIA[0-9A-Z]{16}|(?<=password=)\w+"
ANY = "|".join((EMAIL, SECRET, PHONE, DATE, SSN, IP, CARD))
#: Every match of ANY holds one of these, or stands behind it.
NEEDED = r"[0-9@]|AKIA|password="


def prf(key: str, *parts: Column) -> Column:
    """A keyed pseudo-random number below 16**12."""
    text = F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts], F.lit(key))
    return F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("long")


def feistel(key: str, tweak: Column, value: Column, left: Column, right: Column) -> Column:
    """A permutation of 0 .. left * right - 1: value is a * right + b; rounds
    add a keyed number of one half to the other, in turn."""
    a, b = F.floor(value / right).cast("long"), F.pmod(value, right)
    start = F.struct(a.alias("a"), b.alias("b"))

    def turn(s: Column, i: Column) -> Column:
        x, y = s["a"], s["b"]
        even = F.pmod(x + prf(key, tweak, i, y), left)
        odd = F.pmod(y + prf(key, tweak, i, x), right)
        return F.when(i % 2 == 0, F.struct(even.alias("a"), y.alias("b"))).otherwise(F.struct(x.alias("a"), odd.alias("b")))

    done = F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), start, turn)
    return done["a"] * right + done["b"]


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def permuted(key: str, kind: str, digits: Column) -> Column:
    """A digit string of 1 to 18 places, permuted among those of its length."""
    n = F.length(digits)
    half = F.floor(n / 2).cast("int")
    left, right = F.pow(F.lit(10), n - half).cast("long"), F.pow(F.lit(10), half).cast("long")
    out = feistel(key, F.concat(F.lit(kind), n.cast("string")), digits.cast("long"), left, right)
    return F.lpad(out.cast("string"), n, "0")


def poured(layout: Column, digits: Column) -> Column:
    """The digits in place of those of a text, in order."""
    places = F.split(layout, "")
    step = F.aggregate(
        places,
        F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        lambda s, c: F.when(c.rlike(r"^\d$"), F.struct(F.concat(s["out"], F.substr(digits, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at"))),
    )
    return step["out"]


def luhn(digits: Column) -> Column:
    """Luhn sum modulo 10 of a digit string with its check digit."""
    turned = F.split(F.reverse(digits), "")
    each = F.transform(turned, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda s, x: s + x) % 10


def card(key: str, m: Column) -> Column:
    """All but the check digit is permuted, the first digit kept."""
    d = digits_of(m)
    body = F.concat(F.substr(d, F.lit(1), F.lit(1)), permuted(key, "card", F.substr(d, F.lit(2), F.length(d) - 2)))
    check = F.pmod(F.lit(10) - luhn(F.concat(body, F.lit("0"))), F.lit(10))
    return F.when((F.length(d) >= 13) & (F.length(d) <= 19) & (luhn(d) == 0), poured(m, F.concat(body, check.cast("string")))).otherwise(m)


def phone(key: str, m: Column) -> Column:
    """Ten digits; before them a country code may stand, which stays."""
    d = digits_of(m)
    own = F.right(d, F.lit(10))
    area, exchange = F.substring(own, 1, 3).cast("long") - 200, F.substring(own, 4, 3).cast("long")
    line = F.substring(own, 7, 4).cast("long")

    def moved(kind: str, least: int, many: int) -> Column:
        out = feistel(key, F.lit(kind), (area * many + exchange - least) * 10000 + line, F.lit(800), F.lit(many * 10000))
        rest = F.pmod(out, F.lit(many * 10000))
        parts = F.floor(out / (many * 10000)) + 200, F.floor(rest / 10000) + least, F.pmod(rest, F.lit(10000))
        return F.concat(*[F.lpad(x.cast("long").cast("string"), n, "0") for x, n in zip(parts, (3, 3, 4), strict=True)])

    new = F.when(exchange >= 200, moved("phone", 200, 800)).otherwise(moved("phone low", 0, 200))
    return poured(m, F.concat(F.substr(d, F.lit(1), F.length(d) - 10), new))


def ssn(key: str, m: Column) -> Column:
    d = digits_of(m)
    area, group, serial = F.substring(d, 1, 3).cast("long"), F.substring(d, 4, 2).cast("long"), F.substring(d, 6, 4).cast("long")
    rank = ((area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1) * 9999 + serial - 1
    out = feistel(key, F.lit("ssn"), rank, F.lit(898 * 99), F.lit(9999))
    first = F.floor(out / (99 * 9999)) + 1
    parts = F.when(first >= 666, first + 1).otherwise(first), F.pmod(F.floor(out / 9999), F.lit(99)) + 1, F.pmod(out, F.lit(9999)) + 1
    return F.concat_ws("-", *[F.lpad(x.cast("long").cast("string"), n, "0") for x, n in zip(parts, (3, 2, 4), strict=True)])


def address(key: str, m: Column) -> Column:
    p = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    value = ((p[0] * 256 + p[1]) * 256 + p[2]) * 256 + p[3]
    out = feistel(key, F.lit("ip"), value, F.lit(65536), F.lit(65536))
    return F.concat_ws(".", *[F.pmod(F.floor(out / (256**i)), F.lit(256)).cast("string") for i in (3, 2, 1, 0)])


def date(key: str, m: Column) -> Column:
    """The 400 years hold 146097 = 189 * 773 days, the domain."""
    day = F.try_to_date(F.regexp_replace(m, "/", "-"), "yyyy-MM-dd")
    first = F.to_date(F.lit("1700-01-01"))
    out = feistel(key, F.lit("date"), F.datediff(day, first).cast("long"), F.lit(189), F.lit(773))
    new = F.date_format(F.date_add(first, out.cast("int")), "yyyy-MM-dd")
    return F.when(day.isNull(), m).otherwise(F.when(F.substring(m, 5, 1) == "/", F.regexp_replace(new, "-", "/")).otherwise(new))


def shaped(key: str, kind: str, m: Column) -> Column:
    """A permutation of the strings of one layout: letters and digits at even
    places are shifted within their class by keyed numbers of those at odd
    places, and the other way round, in turn."""

    def moved(c: Column, by: Column) -> Column:
        within = lambda least, n: F.char(F.lit(least) + F.pmod(F.ascii(c) - least + by, F.lit(n)))
        return F.when(c.between("a", "z"), within(97, 26)).when(c.between("A", "Z"), within(65, 26)).when(c.between("0", "9"), within(48, 10)).otherwise(c)

    def turn(chars: Column, i: Column) -> Column:
        other = F.array_join(F.filter(chars, lambda c, at: F.pmod(at + i, F.lit(2)) == 1), "")
        return F.transform(chars, lambda c, at: F.when(F.pmod(at + i, F.lit(2)) == 1, c).otherwise(moved(c, prf(key, F.lit(kind), F.length(m), i, at, other))))

    return F.array_join(F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), F.split(m, ""), turn), "")


def email(key: str, m: Column) -> Column:
    local = F.substring_index(m, "@", 1)
    return F.concat(shaped(key, "mail", local), F.lit("@"), F.substring_index(m, "@", -1))


def pseudonym(key: str, m: Column) -> Column:
    whole = lambda p: m.rlike(f"^(?:{p})$")
    return (
        F.when(F.instr(m, "@") > 0, email(key, m))
        .when(whole(r"AKIA[0-9A-Z]{16}"), F.concat(F.lit("AKIA"), shaped(key, "secret", F.substr(m, F.lit(5)))))
        .when(whole(r"[12]\d{3}[-/]\d{2}[-/]\d{2}"), date(key, m))
        .when(whole(r"\d{3}-\d{2}-\d{4}"), ssn(key, m))
        .when(whole(r"\d{1,3}(?:\.\d{1,3}){3}"), address(key, m))
        .when(whole(r"(?:\+1 ?)?(?:\(\d{3}\) ?|\d{3}[-. ])\d{3}[-. ]\d{4}"), phone(key, m))
        .when(whole(r"\d[\d -]{11,22}"), card(key, m))
        .otherwise(shaped(key, "secret", m))
    )


def pseudonymised(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text with pseudonyms, n_found of every row. Who has the key can
    undo the pseudonyms."""
    if not key:
        raise ValueError("pseudonyms need a key")
    text = F.col("text").cast("string")
    may = text.rlike(NEEDED)
    found = F.when(may, F.regexp_extract_all(text, F.lit(f"({ANY})"), F.lit(1)))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), found.alias("found"))
    fresh = F.transform("found", lambda m: pseudonym(key, m))
    between = F.split("text", ANY, -1)
    new = F.array_join(F.zip_with(between, F.concat(fresh, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    n = F.when(F.col("found").isNull(), 0).otherwise(F.size("found"))
    return d.select("doc_id", F.when(n > 0, new).otherwise(F.col("text")).alias("text"), n.cast("long").alias("n_found"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymised(C.read_table(spark, sf_dir, "documents"), spark.conf.get(KEY_CONF, EXAMPLE_KEY))


SQL: dict[str, str] = {}

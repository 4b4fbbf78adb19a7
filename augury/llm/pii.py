"""Format-preserving pseudonyms for personal data by keyed Feistel networks.

Card numbers (Luhn), IPv4 addresses (octets), phone and social-security numbers (digit counts and ranges), calendar dates and
the local parts of e-mail addresses and long hexadecimal secrets are found by one pattern and validated.  Each valid value is
moved by a keyed permutation of the values of its own format: a card becomes another valid card of as many digits, a date
another date, so equal values get equal pseudonyms in all documents and different values different ones.  Whoever has the key
can move them back (``inverse``).

The work is string and array functions in the scan: no shuffle, no Python.  Only texts with a digit or an at sign are searched.

Dates are yyyy-mm-dd, dd.mm.yyyy, and dd/mm/yyyy or mm/dd/yyyy: with slashes, a number over 12 tells the day, and if both can be
months the day is read first.  Whether the day is over 12 stays as it is, so a pseudonym is read in the order of its date.  Four
numbers after a word such as "version" are no address.

The key is the caller's: whoever knows it can undo the pseudonyms, and there is no default.  It is written, padded for keyed
hashes (HMAC with SHA-512), as a one-row file to the shared folder and joined from there, so that plans, logs and the UI show the
file's path and never the key; who may read that folder can undo the pseudonyms too.

Defined results: null texts stay null, empty ones empty; values that do not validate (a card number with a wrong check digit,
an octet above 255, 31 February) stay; dates outside 1800-01-01 to 2199-09-26 stay; very long texts are searched whole;
repeated rows get equal results; a column of the caller's keeps its name and values, and the count takes the next free name.
"""

from __future__ import annotations

import hashlib
import secrets
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from augury.llm.common import free_name, shared_dir

ROUNDS = 8
_WALKS = 64  # steps of a walk through dates; all leave the same half of a month with a chance below 1e-13
FIRST_DAY, DAYS_A, DAYS_B = "1800-01-01", 365, 400  # the range of dates is DAYS_A x DAYS_B days

# What each kind of value looks like (Java patterns).  Every repetition is bounded or possessive.
KINDS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)+",
    "secret": r"(?<![0-9A-Za-z])(?=[A-Za-z]{0,31}[0-9])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![0-9A-Za-z])",
    "ip": r"(?<![0-9A-Za-z.])(?<!(?i:\bversion|\brelease|\bbuild|\bver\.?)[ :]{1,2}v?)(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9A-Za-z])",
    "date": r"(?<![0-9A-Za-z./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9A-SU-Za-z]|T(?![0-9]{2}:)|[./-][0-9])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])",
    "phone": r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{3}\)[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9A-Za-z])|(?<![0-9A-Za-z])\+[0-9]{1,3}(?:[ .-][0-9]{2,4}){2,4}(?![0-9A-Za-z]|[ .-]?[0-9])|(?<![0-9A-Za-z.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9A-Za-z]|[.-][0-9])",
    "card": r"(?<![0-9A-Za-z.-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z]|[.-][0-9])",
}
_ANY = "|".join(KINDS.values())


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _shift(text: Column, stream: Column, alphabet: str, sign: int) -> Column:
    """Move each character within its own class by the bytes of ``stream`` (64 bytes in hex, used again after that)."""

    def move(p: Column) -> Column:
        ch = F.substring(text, p, F.lit(1))
        by = F.conv(F.substring(stream, (p - 1) % 64 * 2 + 1, F.lit(2)), 16, 10).cast("int") * sign

        def within(first: str, n: int) -> Column:
            return F.char(F.pmod(F.ascii(ch) - F.ascii(F.lit(first)) + by, F.lit(n)) + F.ascii(F.lit(first)))

        if alphabet == "hex":
            at = F.conv(ch, 16, 10).cast("int")
            return F.substring(F.lit("0123456789abcdef"), F.pmod(at + by, F.lit(16)) + 1, F.lit(1))
        return F.when(ch.rlike("[0-9]"), within("0", 10)).when(ch.rlike("[a-z]"), within("a", 26)).when(ch.rlike("[A-Z]"), within("A", 26)).otherwise(ch)

    return F.when(F.length(text) > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.length(text)), move), "")).otherwise(F.lit(""))


Key = tuple[Column, Column]  # the key with the inner and with the outer pad


def pads(key: str) -> tuple[bytes, bytes]:
    """A key padded for HMAC with SHA-512, whose blocks have 128 bytes."""
    raw = key.encode()
    raw = (hashlib.sha512(raw).digest() if len(raw) > 128 else raw).ljust(128, b"\0")
    return bytes(x ^ 0x36 for x in raw), bytes(x ^ 0x5C for x in raw)


def keyed_hash(key: Key, *parts: Column) -> Column:
    """HMAC of the parts, with a bar between them, in hex."""
    inner, outer = key
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.concat_ws("|", *parts).cast("binary")), 512))), 512)


def _key_row(spark: SparkSession, key: str) -> DataFrame:
    path = f"{shared_dir(spark)}/augury-key-{uuid.uuid4().hex}"
    spark.createDataFrame([tuple(map(bytearray, pads(key)))], "inner binary, outer binary").write.parquet(path)
    return spark.read.schema("inner binary, outer binary").parquet(path).agg(F.struct(F.max("inner").alias("inner"), F.max("outer").alias("outer")).alias("key"))  # one row


def _rounds(inverse: bool) -> Column:
    return F.sequence(F.lit(ROUNDS), F.lit(1), F.lit(-1)) if inverse else F.sequence(F.lit(1), F.lit(ROUNDS))


def permute_text(value: Column, key: Key, tweak: str, alphabet: str = "class", inverse: bool = False) -> Column:
    """Feistel network over a string's halves; digits stay digits and letters letters of their case, the rest stays.

    The stream of a round depends on the other half in lower case, so a value in capitals gets its pseudonym in capitals.
    """
    half = F.floor(F.length(value) / 2).cast("int")
    start = F.struct(F.substring(value, F.lit(1), half).alias("l"), F.substring(value, half + 1, F.length(value)).alias("r"))
    sign = -1 if inverse else 1

    def one(s: Column, i: Column) -> Column:
        stream = lambda other: keyed_hash(key, F.lit(tweak), F.length(s["l"]).cast("string"), F.length(s["r"]).cast("string"), i.cast("string"), F.lower(other))
        return F.when(i % 2 == 1, F.struct(_shift(s["l"], stream(s["r"]), alphabet, sign).alias("l"), s["r"].alias("r"))).otherwise(F.struct(s["l"].alias("l"), _shift(s["r"], stream(s["l"]), alphabet, sign).alias("r")))

    return F.aggregate(_rounds(inverse), start, one, lambda s: F.concat(s["l"], s["r"]))


def permute_number(value: Column, a: int, b: int, key: Key, tweak: str, inverse: bool = False) -> Column:
    """Feistel network over 0 .. a * b - 1."""
    start = F.struct((value / b).cast("long").alias("l"), (value % b).cast("long").alias("r"))
    sign = -1 if inverse else 1

    def one(s: Column, i: Column) -> Column:
        stream = lambda other: F.conv(F.substring(keyed_hash(key, F.lit(tweak), i.cast("string"), other.cast("string")), 1, 12), 16, 10).cast("long") * sign
        return F.when(i % 2 == 1, F.struct(F.pmod(s["l"] + stream(s["r"]), F.lit(a)).alias("l"), s["r"].alias("r"))).otherwise(F.struct(s["l"].alias("l"), F.pmod(s["r"] + stream(s["l"]), F.lit(b)).alias("r")))

    return F.aggregate(_rounds(inverse), start, one, lambda s: s["l"] * b + s["r"])


def _luhn_sum(digits: Column, doubled_parity: int) -> Column:
    """Luhn sum of a digit string; the digits whose distance from the end has the given parity are doubled."""
    n = F.length(digits)

    def term(p: Column) -> Column:
        d = F.substring(digits, p, F.lit(1)).cast("int")
        twice = d * 2
        return F.when((n - p) % 2 == doubled_parity, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda total, p: total + term(p))


def _like(digits: Column, shape: Column) -> Column:
    """``digits`` put in the places that digits have in ``shape``."""
    spread = F.array_join(F.transform(F.sequence(F.lit(1), F.length(shape)), lambda p: F.when(F.substring(shape, p, F.lit(1)).rlike("[0-9]"), F.substring(digits, F.length(_digits(F.substring(shape, F.lit(1), p))), F.lit(1))).otherwise(F.substring(shape, p, F.lit(1)))), "")
    return F.when(F.length(digits) == F.length(shape), digits).otherwise(spread)


def _card(m: Column, key: Key, inverse: bool) -> Column:
    d = _digits(m)
    body = permute_text(F.substring(d, F.lit(1), F.length(d) - 1), key, "card", inverse=inverse)
    whole = _let(body, lambda x: F.concat(x, F.pmod(10 - _luhn_sum(x, 0) % 10, F.lit(10)).cast("string")))
    return F.when(_luhn_sum(d, 1) % 10 == 0, _like(whole, m))


def _ip(m: Column, key: Key, inverse: bool) -> Column:
    octets = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    value = F.aggregate(octets, F.expr("0L"), lambda total, x: total * 256 + x)
    moved = permute_number(value, 65536, 65536, key, "ip", inverse)
    text = _let(moved, lambda v: F.concat_ws(".", *[(F.floor(v / 256**k) % 256).cast("string") for k in (3, 2, 1, 0)]))
    # Octets with leading zeros would not come back in their form.
    return F.when(F.forall(octets, lambda x: x <= 255) & ~m.rlike(r"(^|\.)0[0-9]"), text)


def _date(m: Column, key: Key, inverse: bool) -> Column:
    first_day = F.lit(FIRST_DAY).cast("date")
    whole = lambda v: F.date_add(first_day, v.cast("int"))
    late = lambda v: F.dayofmonth(whole(v)) > 12

    def step(v: Column) -> Column:
        return permute_number(v, DAYS_A, DAYS_B, key, "date", inverse)

    def walked(v: Column) -> Column:
        # Cycle walking within the dates whose day is over 12, or within the others; a step leaves them about every second time.
        start = F.struct(step(v).alias("at"), late(v).alias("late"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(_WALKS)), start, lambda s, _: F.when(late(s["at"]) == s["late"], s).otherwise(F.struct(step(s["at"]).alias("at"), s["late"].alias("late"))), lambda s: s["at"])

    def move(form: str) -> Column:
        day = F.datediff(F.try_to_timestamp(m, F.lit(form)).cast("date"), first_day).cast("long")
        return _let(day, lambda v: F.when((v >= 0) & (v < DAYS_A * DAYS_B), _let(walked(v), lambda w: F.date_format(whole(w), form))))

    american = m.rlike("^(0[1-9]|1[0-2])/(1[3-9]|2[0-9]|3[01])/")
    return F.when(m.rlike("^[0-9]{4}-"), move("yyyy-MM-dd")).when(american, move("MM/dd/yyyy")).when(m.rlike("^[0-9]{2}/"), move("dd/MM/yyyy")).otherwise(move("dd.MM.yyyy"))


def _phone(m: Column, key: Key, inverse: bool) -> Column:
    d = _digits(m)
    kept = F.greatest(F.length(d) - 10, F.lit(0))  # the country code and what stands before the last ten digits stay
    moved = F.concat(F.substring(d, F.lit(1), kept), permute_text(F.substring(d, kept + 1, F.lit(10)), key, "phone", inverse=inverse))
    return F.when(F.length(d).between(8, 15), _let(moved, lambda x: _like(x, m)))


def _email(m: Column, key: Key, inverse: bool) -> Column:
    local = F.substring_index(m, "@", 1)
    return F.concat(permute_text(local, key, "email", inverse=inverse), F.substring(m, F.length(local) + 1, F.length(m)))


def _secret(m: Column, key: Key, inverse: bool) -> Column:
    moved = permute_text(F.lower(m), key, "secret", "hex", inverse)
    return F.when(m.rlike("[A-F]"), F.upper(moved)).otherwise(moved)


def _ssn(m: Column, key: Key, inverse: bool) -> Column:
    valid = lambda d: ~d.rlike("^(000|666|9)|^[0-9]{3}00|0000$")
    move = lambda d: permute_text(d, key, "ssn", inverse=inverse)
    # Cycle walking: a step that leaves the valid numbers (about one in nine) is followed by another.
    moved = F.aggregate(F.sequence(F.lit(1), F.lit(16)), move(_digits(m)), lambda d, _: F.when(valid(d), d).otherwise(move(d)))
    return F.when(valid(_digits(m)), _let(moved, lambda x: _like(x, m)))


def pseudonym(m: Column, key: Key, inverse: bool = False) -> Column:
    """The pseudonym of one found value; null if the value does not validate."""
    whole = lambda kind: m.rlike(f"^(?:{KINDS[kind]})$")
    return (
        F.when(F.contains(m, F.lit("@")), _email(m, key, inverse))
        .when(whole("secret"), _secret(m, key, inverse))
        .when(whole("ip"), _ip(m, key, inverse))
        .when(whole("date"), _date(m, key, inverse))
        .when(whole("ssn"), _ssn(m, key, inverse))
        .when(whole("phone"), _phone(m, key, inverse))
        .otherwise(_card(m, key, inverse))
    )


def pseudonymise(docs: DataFrame, key: str, inverse: bool = False) -> DataFrame:
    """All columns of ``docs`` with ``text`` pseudonymised, and pii_found (values replaced; under the next free name if
    ``docs`` has such a column)."""
    if not key:
        raise ValueError("pseudonyms need a key")
    count = free_name(docs.columns, "pii_found")
    held = free_name([*docs.columns, count], "moved")
    given = free_name([*docs.columns, count, held], "key")
    docs = docs.crossJoin(F.broadcast(_key_row(docs.sparkSession, key).withColumnRenamed("key", given)))  # one row
    padded = F.col(f"{given}.inner"), F.col(f"{given}.outer")
    found = F.regexp_extract_all(F.col("text"), F.lit(f"({_ANY})"), F.lit(1))
    moved = F.transform(found, lambda m: pseudonym(m, padded, inverse))
    swapped = F.zip_with(found, F.col(held), lambda old, new: F.coalesce(new, old))
    rows = docs.withColumn(held, F.when(F.col("text").rlike("[0-9@]"), moved))
    between = F.split(F.col("text"), _ANY, -1)
    joined = F.array_join(F.zip_with(between, swapped, lambda gap, value: F.concat(gap, F.coalesce(value, F.lit("")))), "")
    n = F.coalesce(F.size(F.filter(held, lambda x: x.isNotNull())), F.lit(0))
    hit = F.coalesce(F.exists(held, lambda x: x.isNotNull()), F.lit(False))
    return rows.withColumn("text", F.when(hit, joined).otherwise(F.col("text"))).withColumn(count, F.when(hit, n).otherwise(F.lit(0))).drop(held, given)


def session_key(spark: SparkSession) -> str:
    """The key that the session names in ``spark.augury.pseudonymSecret`` (settings of such a name are redacted in the UI and in
    logs); a secret of this run alone where it names none."""
    return spark.conf.get("spark.augury.pseudonymSecret", None) or secrets.token_hex(32)

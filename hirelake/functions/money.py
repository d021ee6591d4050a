"""Amounts, salaries and signatures."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from hirelake.functions.text import NEGOTIABLE

MILLION = 1_000_000


def _missing(amount: Column) -> Column:
    return amount.isNull() | (amount == 0)


def dotted(amount: Column) -> Column:
    """A whole number with dots between thousands."""
    return F.regexp_replace(amount.cast("decimal(38,0)").cast("string"), r"\B(?=(\d{3})+(?!\d))", ".")


def currency(amount: Column) -> Column:
    """Dotted; none or zero is negotiable."""
    return F.when(_missing(amount), F.lit(NEGOTIABLE)).otherwise(dotted(amount))


def one_decimal(x: Column) -> Column:
    """A double of at least 1 with one decimal. The double itself is rounded, halves to the even digit, as printf of SQL and C
    does; Spark's format_string rounds the shortest decimal that stands for it, halves upwards (1.25 and 1.45)."""
    whole = F.floor(x)
    # Of a double from 1 on the fraction is a multiple of 2^-52, so these are exact.
    part = ((x - whole) * (1 << 52)).cast("long") * 10
    tenths, rest = F.shiftright(part, 52), part.bitwiseAND((1 << 52) - 1)
    up = (rest > 1 << 51) | ((rest == 1 << 51) & (tenths % 2 == 1))
    found = whole * 10 + tenths + up.cast("long")
    text = F.concat(F.floor(found / 10).cast("string"), F.lit("."), (found % 10).cast("string"))
    return F.when(x < 1 << 49, text).otherwise(F.format_string("%.1f", x))


def currency_short(amount: Column) -> Column:
    """From a million on in millions, with one decimal unless it is 0."""
    millions = F.regexp_replace(one_decimal((amount / MILLION).cast("double")), r"\.0$", "")
    return F.when(_missing(amount), F.lit("0")).when(amount >= MILLION, F.concat(millions, F.lit(" Triệu"))).otherwise(currency(amount))


def currency_local(amount: Column) -> Column:
    return F.concat(dotted(amount), F.lit(" đ"))


def salary_band(low: Column, high: Column) -> Column:
    """10M - 15M, one side alone, or negotiable; zero counts as none. Halves go to the even million."""

    def side(x: Column) -> Column:
        return F.when(~_missing(x), F.format_string("%.0fM", F.rint((x / MILLION).cast("double"))))

    return F.when(~_missing(low) & ~_missing(high), F.concat(side(low), F.lit(" - "), side(high))).otherwise(F.coalesce(side(low), side(high), F.lit(NEGOTIABLE)))


def kilobytes(size: Column) -> Column:
    return F.floor(size / 1024 + 0.5).cast("long")


def clamped(x: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(x, F.lit(high)))


def rounded(x: Column, step) -> Column:
    """To the nearest multiple of step, halves upwards."""
    return F.floor(x / step + 0.5) * step


def minor_units(amount: Column) -> Column:
    """Hundredths of a whole amount, exact."""
    return (amount.cast("decimal(18,0)") * 100).cast("decimal(20,0)")


def transaction_reference(prefix: str, receipt_id: Column, at: Column) -> Column:
    return F.concat(F.lit(prefix + "_"), receipt_id.cast("string"), F.lit("_"), F.unix_timestamp(at).cast("string"))


def query_string(parameters: Column) -> Column:
    """A map as form-encoded pairs in the order of their keys."""
    # url_encode leaves * and encodes ~, where a form of this kind does the opposite.
    encode = lambda c: F.replace(F.replace(F.url_encode(c), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))
    pairs = F.transform(F.array_sort(F.map_entries(parameters)), lambda e: F.concat(encode(e["key"]), F.lit("="), encode(e["value"])))
    return F.array_join(pairs, "&")


def hmac_hex(message: Column, key: str, digest: str = "sha512") -> Column:
    """Keyed digest (sha224 to sha512) of a text, in hex. The key is a parameter, so its two paddings are constants and Spark's
    own digests do the rest."""
    bits = int(digest.removeprefix("sha"))
    block = 128 if bits > 256 else 64
    secret = key.encode()
    if len(secret) > block:
        secret = hashlib.new(digest, secret).digest()
    padded = lambda byte: F.lit(bytearray(b ^ byte for b in secret.ljust(block, b"\0")))
    inner = F.sha2(F.concat(padded(0x36), message.cast("binary")), bits)
    return F.sha2(F.concat(padded(0x5C), F.unhex(inner)), bits)


def signature_valid(parameters: Column, key: str, field: str = "secure_hash", digest: str = "sha512") -> Column:
    """Whether the field of a map is the signature of all its others; a map without it is not valid."""
    given = F.try_element_at(parameters, F.lit(field))
    others = F.map_filter(parameters, lambda k, v: k != field)
    return F.coalesce(given == hmac_hex(query_string(others), key, digest), F.lit(False))

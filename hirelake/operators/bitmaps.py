"""A bitmap of new keys as a filter of a large table before it is shuffled.

Keys are hashed to bits; bits are gathered into bitmaps of 32,768 by Spark's bitmap aggregates, so all of them take BITS / 8
bytes at most and can be broadcast. A row whose bit isn't set has none of the keys; the few others that pass are told apart
by the join that follows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits in all: a bound of 2 MB on what is broadcast.
BITS = 1 << 24


def place(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BITS))


def bitmaps(keys: DataFrame, key: str) -> DataFrame:
    """part and bits: the bitmaps of a column of keys; nulls are left out."""
    at = place(F.col(key))
    return keys.where(F.col(key).isNotNull()).groupBy(F.bitmap_bucket_number(at).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))


def united(*parts: DataFrame) -> DataFrame:
    """Bitmaps of several sets of keys as those of all of them."""
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.groupBy("part").agg(F.bitmap_or_agg("bits").alias("bits"))


def maybe_among(df: DataFrame, key: str, maps: DataFrame) -> DataFrame:
    """The rows whose key may be among those of the bitmaps, in a pass without a shuffle."""
    at = place(F.col(key))
    bit = F.bitmap_bit_position(at)
    # Bits are counted from the lowest of each byte.
    byte = F.ascii(F.decode(F.substring(F.col("bits"), (bit / 8).cast("int") + 1, F.lit(1)), "ISO-8859-1"))
    met = df.join(F.broadcast(maps.select(F.col("part").alias("of_part"), "bits")), F.bitmap_bucket_number(at) == F.col("of_part"))
    return met.where((F.floor(byte / F.pow(F.lit(2), bit % 8)) % 2) == 1).drop("of_part", "bits")

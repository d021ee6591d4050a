"""Ranks and pages of all rows at once, without a window in a single task and without rows in the driver.

Rows are dealt out by ranges of the keys and sorted within each; a row's rank is the number of rows in all earlier ranges
and its own place in its range. The driver only sees one count for each range.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.operators.search import MAX_PAGE, PAGE, sort_keys
from hirelake.sources.storage import checkpointed

#: monotonically_increasing_id() has the partition above and the place in it below this bit.
_PLACE_BITS = 33


def numbered(df: DataFrame, keys: Iterable[Column], name: str = "rank") -> DataFrame:
    """All rows with their rank (long, from 0) in the order of keys, which should tell all rows apart: rows that tie may
    take each other's rank. The result is stored, so ranks stay as they are whatever is lost later."""
    keys = list(keys)
    placed = checkpointed(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(name, F.monotonically_increasing_id()))
    part = F.shiftright(F.col(name), _PLACE_BITS)
    sizes = sorted((r[0], r[1]) for r in placed.groupBy(part).agg(F.count("*")).collect())
    before = dict(zip((p for p, _ in sizes), accumulate((n for _, n in sizes), initial=0), strict=False))
    if not before:
        return placed
    place = F.col(name).bitwiseAND((1 << _PLACE_BITS) - 1)
    # As many rows as there are partitions.
    table = df.sparkSession.createDataFrame(list(before.items()), "of_part long, rows_before long")
    return placed.join(F.broadcast(table), part == F.col("of_part")).withColumn(name, F.col("rows_before") + place).drop("of_part", "rows_before")


def paged(df: DataFrame, names: list[str], size: int = PAGE, most: int | None = MAX_PAGE, rank: str = "rank", number: str = "page") -> DataFrame:
    """All rows with their rank and the number of their page, from 1, in the order of names (as sort_names() gives them).
    A size above the most is cut to it."""
    if size < 1:
        raise ValueError("pages hold a row at least")
    size = size if most is None else min(size, most)
    return numbered(df, sort_keys(names), rank).withColumn(number, F.floor(F.col(rank) / size).cast("long") + 1)


def envelopes(pages: DataFrame, number: str = "page") -> DataFrame:
    """What is said of each page: its number, the count of all rows, and the pages next and previous, if there are any."""
    sizes = pages.groupBy(number).agg(F.count("*").alias("n"))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("count"), F.max(number).alias("last"))
    here = F.col(number)
    return sizes.join(F.broadcast(total)).select(here, "count", F.when(here < F.col("last"), here + 1).alias("next"), F.when(here > 1, here - 1).alias("previous"))

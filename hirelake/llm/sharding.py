"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns many points on a ring, and the arc before each point. A document belongs to the shard of the arc that
its key falls in. Loads are bounded: when a shard is full, further keys go on clockwise to the next shard with room.
Capacities add up to the number of documents and differ by at most one, so counts of shards do too.

Only counts by arc reach the driver, which walks the ring once a round and cuts each arc into ranges of ranks by shard.
Documents are then placed by their rank within their arc, where rows that are alike are one row with a count. So no arc,
and no key, is more than ROWS_PER_ARC different rows in a task, by expectation.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hirelake.llm._common import read

SHARDS = 24
#: Points of each shard on the ring, at least; there are more for more rows than shards * points arcs should hold.
POINTS, ROWS_PER_ARC = 128, 1_000_000
#: Rows that are alike are written in pieces of so many.
PIECE = 100_000


def ring(shards: int, points: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (signed 64-bit) of all points in order, and the shard of each. A shard's points don't depend on others."""
    found = sorted((int.from_bytes(hashlib.blake2b(f"{s}:{p}".encode(), digest_size=8).digest(), "big", signed=True), s) for s in range(shards) for p in range(points))
    return np.array([x[0] for x in found]), np.array([x[1] for x in found])


def cut_arcs(counts: list[int], owners: list[int], capacity: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Bounded loads. Returns ranges (arc, first rank, end rank, shard, slot of the first): in round k the keys of an
    arc that have no shard yet try the owner of the k-th point from theirs; a shard takes arcs in ring order, and of an
    arc the lowest ranks, as far as it has room."""
    n, room = len(counts), list(capacity)
    used, done = defaultdict(int), [0] * n
    out = []
    waiting = [a for a in range(n) if counts[a]]
    for hop in range(n):
        for arc in waiting:
            shard = owners[(arc + hop) % n]
            if take := min(room[shard], counts[arc] - done[arc]):
                out.append((arc, done[arc], done[arc] + take, shard, used[shard]))
                done[arc] += take
                used[shard] += take
                room[shard] -= take
        if not (waiting := [a for a in waiting if done[a] < counts[a]]):
            break
    return out


def shard_documents(documents: DataFrame, shards: int = SHARDS, points: int = POINTS) -> DataFrame:
    """Places every row of documents. Returns doc_id, size, text_crc32, law, shard, slot, grown_shard, home_shard.

    The law is "rows": shards hold counts of at most one apart; the first shards in number hold one more. slot numbers
    a shard's rows from 0 without gaps. home_shard is the shard before bounds, so rows with another shard have moved on.
    The key is doc_id with a digest of the text, so null or repeated ids spread out as well; rows alike in both are
    interchangeable. A null text has size 8 and the checksum of the empty text. No rows give none. Other columns are
    ignored.

    A very long text only counts by its size and checksum. Rows that tie in their key are ordered by id, checksum and size.

    points is a lower bound for the points of a shard: there are as many more as keep arcs at about ROWS_PER_ARC rows. The
    driver holds one count for each arc.
    """
    points = max(points, -(-documents.count() // (shards * ROWS_PER_ARC)))
    spots, owners = ring(shards, points)
    text = F.coalesce("text", F.lit(""))

    @F.pandas_udf("int")
    def arc_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(spots, key.to_numpy()) % len(spots), dtype="int32")

    rows = documents.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64("doc_id", "text").alias("key")).withColumn("arc", arc_of("key"))
    found = {r["arc"]: r["n"] for r in rows.groupBy("arc").agg(F.count("*").alias("n")).collect()}
    counts = [found.get(a, 0) for a in range(len(spots))]
    total = sum(counts)
    capacity = [total // shards + (s < total % shards) for s in range(shards)]
    ranges = cut_arcs(counts, owners.tolist(), capacity)

    spark = documents.sparkSession
    # As many ranges as arcs and, at most, one more each time a shard fills up: bounded by the ring alone.
    plan = spark.createDataFrame([(int(a), int(lo), int(hi), int(s), int(base)) for a, lo, hi, s, base in ranges] or [], "arc int, low long, high long, shard int, base long")
    homes = spark.createDataFrame([(a, int(s)) for a, s in enumerate(owners)], "arc int, home_shard int")
    plan = plan.groupBy("arc").agg(F.sort_array(F.collect_list(F.struct("low", "high", "shard", "base"))).alias("ranges"))
    # Rows alike in all of this are interchangeable, so they have their ranks together.
    kinds = rows.groupBy("arc", "key", "doc_id", "text_crc32", "size").agg(F.count("*").alias("n"))
    so_far = Window.partitionBy("arc").orderBy("key", "doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = kinds.withColumn("end", F.sum("n").over(so_far)).select("arc", "doc_id", "text_crc32", "size", (F.col("end") - F.col("n")).alias("low"), "end")
    pieces = F.explode(F.sequence(F.col("low"), F.col("end") - 1, F.lit(PIECE).cast("long")))
    ranked = ranked.withColumn("from", pieces).withColumn("rank", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + PIECE, "end") - 1)))
    placed = ranked.join(F.broadcast(plan.join(F.broadcast(homes), "arc")), "arc").withColumn("own", F.filter("ranges", lambda r: (r["low"] <= F.col("rank")) & (F.col("rank") < r["high"]))[0])
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("own.shard").alias("shard"),
        (F.col("own.base") + F.col("rank") - F.col("own.low")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "home_shard",
    )


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 24 shards, by the law of even counts of rows."""
    return shard_documents(read(spark, sf_dir, "documents"))

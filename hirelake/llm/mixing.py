"""Mixing sources to target weights by weighted fair queueing.

Each source has a share of the total budget; its documents, shuffled by a digest of their ids, make a queue that is served
again from the start if the share is larger than the source. A document's virtual finish time is what its source has been
given up to its end, divided by the source's target: so at each time all sources have had the same part of their targets,
and at time 1 all of them. All documents are then sorted by that time in ranges, and words are taken until the budget is
used up. The document that a source's target ends in is cut there, and finishes at time 1.

Both orders, in a source and of all, are made by range partitions and prefix sums of their totals. Rows alike are one row
with a count until their places are known, so neither a source nor a document that is repeated is one task's.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from hirelake.llm._common import checkpointed, read
from hirelake.operators.ranks import numbered

WEIGHTS = (5, 2, 1)
#: How often a document may be taken.
MOST_PASSES = 3
SEED = 42
#: Sources up to this number go to all tasks; more are joined.
MAX_BROADCAST = 100_000
#: Copies of a row are written in pieces of so many.
PIECE = 100_000


def word_count(text: Column) -> Column:
    """Words between ASCII white space. Each becomes one character, so a long text makes no list of its words."""
    marks = F.regexp_replace(text, r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++", "x")
    return F.coalesce(F.length(F.rtrim(marks, F.lit(" \t\n\x0b\x0c\r"))), F.lit(0)).cast("long")


def running_totals(df: DataFrame, keys: Sequence[str], value: str, group: str | None = None, name: str = "start", row: str | None = None) -> DataFrame:
    """Rows with the total of value (long) before them, in the order of keys, within their group (int) if there is one; row,
    if given, is a column that numbers rows. Rows that tie in all keys must be alike.

    Rows are dealt out by ranges of the keys. Tasks add up their own range; what came before it is added to the group that
    a range begins with, which is at most one value for each range.
    """
    keys = [*([group] if group else []), *keys]
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    added = [StructField(n, LongType()) for n in (name, "part", *([row] if row else []))]
    schema = StructType([*ranged.schema.fields, *added])

    def add(batches):
        part, last, total, count = TaskContext.get().partitionId(), None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            values = batch.column(value).to_numpy()
            groups = batch.column(group).to_numpy() if group else np.zeros(len(values), np.int32)
            before = np.cumsum(values) - values
            first = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
            base = before[first].copy()
            if groups[0] == last:
                base[0] -= total
            before -= np.repeat(base, np.diff(np.append(first, len(values))))
            last, total = groups[-1], int(before[-1] + values[-1])
            columns = [*batch.columns, pa.array(before), pa.array(np.full(len(values), part, np.int64))]
            if row:
                columns.append(pa.array((part << 33) + count + np.arange(len(values))))
            count += len(values)
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    found = checkpointed(ranged.mapInArrow(add, schema))
    of_group = F.col(group) if group else F.lit(0)
    totals = found.groupBy("part", of_group.alias("in_group")).agg(F.sum(value).alias("total"))
    so_far = Window.partitionBy("in_group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = totals.withColumn("earlier", F.sum("total").over(so_far)).where("earlier IS NOT NULL").select(F.col("part").alias("of_part"), "in_group", "earlier")
    out = found.join(F.broadcast(earlier), (F.col("part") == F.col("of_part")) & (of_group == F.col("in_group")), "left")
    return out.withColumn(name, F.col(name) + F.coalesce("earlier", F.lit(0))).drop("of_part", "in_group", "earlier", "part")


def targets(sources: DataFrame, weights: Sequence[int], budget: int, most: int) -> DataFrame:
    """sources (rank, source_size) with target (double) and words (long, its whole part): the budget by weights, where what a
    source has beyond most times its size goes to the others by weight. Adds up over sources in Spark; capped ones only
    become more from round to round."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    # Decimals, since products of sizes and weights may pass what a long holds.
    exact = {"weight": weight.cast("decimal(10,0)"), "cap": (most * F.col("source_size")).cast("decimal(18,0)")}
    weighed = checkpointed(sources.withColumns(exact))
    level, seen = Fraction(0), -1
    while True:
        # The first round caps none; a source is capped if its part would be above its cap.
        part = F.col("weight") * F.lit(Decimal(level.numerator)).cast("decimal(20,0)")
        capped = F.lit(seen >= 0) & (F.col("cap") * F.lit(Decimal(level.denominator)).cast("decimal(12,0)") <= part)
        n, held, rest = weighed.agg(F.count_if(capped), F.coalesce(F.sum(F.when(capped, F.col("cap"))), F.lit(0)), F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0))).first()
        if n == seen or not rest:
            break
        seen, level = n, Fraction(budget - int(held), int(rest))
    divisor = F.lit(Decimal(level.denominator)).cast("decimal(12,0)")
    return weighed.withColumns({
        "target": F.when(capped, F.col("cap").cast("double")).otherwise(part.cast("double") / divisor.cast("double")),
        "words": F.when(capped, F.col("cap").cast("long")).otherwise(((part - part % divisor) / divisor).cast("long")),
    })


def fair_queue(documents: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_PASSES, share: Fraction = Fraction(1), seed: int = SEED) -> DataFrame:
    """The mix of documents: a row for each time that a document is served, and one for each that isn't.

    Sources in the order of their code points, null last, weigh as weights say, in turns, and get share of all words
    (what is between ASCII white space) by weight; none gets more than most times its own. Returns doc_id, source, size,
    source_size, target (of the source), row and copy (longs that together tell rows of documents apart), pass (from
    0), finish (virtual time of the end; 1 is the end of the mix), place (words of the mix before it, if all were served)
    and words (taken; 0 if it isn't served). In the order of finish, source, pass and place, the words of a source up to
    any time are its target times that time, but for the one document in service.

    A null text has no words. A source without words gets none, and documents without words are there with 0. Null and
    repeated ids are told apart by a digest of the text; rows alike in both are interchangeable, and take their turns one
    after another. No rows give none. Other columns are ignored, whatever their names. A very long text only counts by its
    words, and is cut where its source's target ends. Reruns agree.
    """
    key = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 16)
    rows = documents.select("doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("key"), F.xxhash64("doc_id", "text").alias("digest"))
    kinds = checkpointed(rows.groupBy("source", "key", "doc_id", "digest", "size").agg(F.count("*").alias("n")))
    sizes = kinds.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    sources = numbered(sizes, [F.col("source").asc_nulls_last()], "rank").withColumn("rank", F.col("rank").cast("int"))
    total, n_sources = kinds.agg(F.coalesce(F.sum(F.col("size") * F.col("n")), F.lit(0))).first()[0], sources.count()
    budget = int(total * share)
    shares = checkpointed(targets(sources, weights, budget, most)).select(F.col("source").alias("of_source"), "rank", "source_size", "target", F.col("words").alias("share"))
    shares = F.broadcast(shares) if n_sources <= MAX_BROADCAST else shares
    queued = kinds.join(shares, F.col("source").eqNullSafe(F.col("of_source"))).drop("of_source").withColumn("together", F.col("size") * F.col("n"))
    queued = running_totals(queued, ("key", "doc_id", "digest", "size"), "together", "rank", "start", "row")
    # Rows alike, one after another.
    pieces = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(PIECE).cast("long")))
    each = queued.withColumn("from", pieces).withColumn("copy", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + PIECE, "n") - 1)))
    each = each.withColumn("start", F.col("start") + F.col("copy") * F.col("size")).drop("key", "digest", "n", "together", "from")
    # Passes of a document: those that start before the share of its source is used up, and the first in any case.
    passes = F.greatest(F.lit(1), F.when((F.col("size") > 0) & (F.col("share") > F.col("start")), F.expr("(share - start - 1) div source_size + 1")).otherwise(1))
    served = each.withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), passes.cast("long") - 1)))
    begin = F.col("start") + F.col("pass") * F.col("source_size")
    asked = F.greatest(F.lit(0), F.least(F.col("size"), F.col("share") - begin)).cast("long")
    cut = (asked < F.col("size")) & (begin < F.col("share"))
    finish = F.when(F.col("target") > 0, F.when(cut, F.lit(1.0)).otherwise((begin + F.col("size")) / F.col("target"))).otherwise(F.lit(float("inf")))
    served = served.withColumns({"asked": asked, "finish": finish}).drop("share")
    placed = running_totals(served, ("finish", "rank", "pass", "start", "row", "copy"), "asked", name="place")
    taken = F.greatest(F.lit(0), F.least(F.col("asked"), F.lit(budget) - F.col("place"))).cast("long")
    return placed.select("doc_id", "source", "size", "source_size", "target", "row", "copy", "pass", "finish", "place", taken.alias("words"))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, and how many of its words the mix of all sources takes."""
    mix = fair_queue(read(spark, sf_dir, "documents"))
    whole = [F.first(c).alias(c) for c in ("doc_id", "size", "source_size", "target")]
    return mix.groupBy("row", "copy").agg(*whole, F.sum("words").alias("taken")).drop("row", "copy")


OP13_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size, substr(md5('42:' || doc_id), 1, 16) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM d GROUP BY source),
turns AS (SELECT *, row_number() OVER w AS turn, sum(3 * source_size) OVER w - 3 * source_size AS held, sum(weight) OVER () - sum(weight) OVER w + weight AS rest, sum(source_size) OVER () AS budget FROM s WINDOW w AS (ORDER BY 3 * source_size / weight, source NULLS LAST)),
level AS (SELECT (budget - held)::BIGINT AS top, rest::BIGINT AS bottom FROM turns WHERE 3 * source_size::HUGEINT * rest > weight * (budget - held) ORDER BY turn LIMIT 1),
shares AS (SELECT source, source_size, CASE WHEN 3 * source_size::HUGEINT * bottom <= weight * top THEN (3 * source_size)::DOUBLE ELSE (weight * top)::DOUBLE / bottom::DOUBLE END AS target, CASE WHEN 3 * source_size::HUGEINT * bottom <= weight * top THEN 3 * source_size ELSE weight * top // bottom END AS share FROM s, level),
queue AS (SELECT d.doc_id, d.size, s.source_size, s.target, s.share, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d JOIN shares s ON d.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, size, source_size, target, (CASE WHEN source_size = 0 THEN 0 ELSE share // source_size * size + greatest(0, least(size, share % source_size - start)) END)::BIGINT AS taken FROM queue
"""

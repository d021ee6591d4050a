"""Substring search by a stored index of trigrams.

Texts are folded so that what compares equal under the collation folds alike, and every three letters or digits in a row
become a posting. A needle's rarest trigrams are looked up, and texts that have all of them are compared by the
collation itself. So results are those of contains(), whatever the folding.

The folding is not written down: it is asked of Spark's collation, once for a session. Characters that equal one letter or
digit become it, those that equal two or three letters (such as a ligature) become these, and those that equal nothing are
dropped. A text with a character that stands for something else with letters in it is not filed but always compared, and so
is every text for a needle without three letters or digits in a row.

Postings are packed: a task takes some texts together and writes, for each trigram, the list of their keys. Texts are kept
with their plain form if they have one: folded letter by letter, they are ASCII (and sharp s) alone. Then equal under the
collation means equal bytes, so plain needles are looked for in plain texts by these, and by the collation in all others.
"""

from __future__ import annotations

import re
import string
import unicodedata
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property, reduce
from itertools import product
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from hirelake.operators.ranks import numbered
from hirelake.operators.search import ANY_CASE_AND_ACCENT, any_contains
from hirelake.sources.storage import checkpointed

ALPHABET = string.ascii_lowercase + string.digits
GRAM = 3
#: Postings are filed in so many folders by trigram, texts by key.
BUCKETS = 64
#: Trigrams of a needle that are looked up; the comparison does the rest.
LOOKED_UP = 3
#: Needles up to this number go to all tasks, more are joined.
MAX_BROADCAST = 100_000
#: Needles without trigrams that are compared in one pass.
SHORT_AT_ONCE = 100
#: Characters of texts that are packed together.
PACKED = 2_000_000
#: Code points that are asked about; those beyond have no letters of this alphabet.
CODE_POINTS = (*range(1, 0xD800), *range(0xE000, 0x20000), *range(0xE0000, 0xE01F0))


@dataclass(frozen=True)
class Folding:
    """letters[i] folds to folded[i], a key of expanded to its letters, dropped characters to nothing; texts with one of
    several don't fold."""

    letters: str
    folded: str
    dropped: str
    several: str
    expanded: dict[str, str]

    @cached_property
    def _one(self) -> dict[int, str]:
        return str.maketrans(self.letters, self.folded)

    @cached_property
    def _all(self) -> dict[int, str]:
        return self._one | str.maketrans(self.expanded | dict.fromkeys(self.dropped, ""))

    @cached_property
    def _unfolded(self) -> re.Pattern:
        return re.compile(f"[{re.escape(self.several)}]" if self.several else "(?!)")

    def fold(self, text: str) -> str | None:
        """None if it doesn't fold."""
        return None if not text.isascii() and self._unfolded.search(text) else text.translate(self._all)

    def plain(self, text: str | None) -> str | None:
        one = None if text is None else text.translate(self._one)
        return one if one is not None and _PLAIN(one) else None

    def plain_needle(self, text: str) -> str | None:
        """Sharp s is two letters to a collation, so a needle with both, or with itself, is left to that."""
        one = self.plain(text)
        return one if one is not None and one.isascii() and "ss" not in one else None


_PLAIN = re.compile(r"[\t\n -~ß]*").fullmatch
_CODES = np.full(256, -1, np.int64)
_CODES[list(ALPHABET.encode())] = np.arange(len(ALPHABET))
_FOLDINGS: dict[str | None, Folding] = {}


def folding(spark: SparkSession, collation: str | None = ANY_CASE_AND_ACCENT) -> Folding:
    """How texts fold under a collation; None is lower case alone, as contains() has it."""
    if collation not in _FOLDINGS:
        chars = spark.createDataFrame([(chr(c),) for c in CODE_POINTS], "c string")
        if collation is None:
            rows = chars.select("c", F.lower("c").alias("s")).where((F.length("s") == 1) & F.lit(ALPHABET).contains(F.col("s"))).collect()
        else:
            # A collated join finds what each character equals, among nothing, one, two and three letters.
            some = ["", *ALPHABET, *("".join(p) for n in (2, 3) for p in product(string.ascii_lowercase, repeat=n))]
            texts = spark.createDataFrame([(s,) for s in some], "s string")
            rows = chars.join(F.broadcast(texts), F.collate("c", collation) == F.collate("s", collation)).collect()
        found = {r["c"]: r["s"] for r in rows}
        one = sorted(c for c, s in found.items() if len(s) == 1)
        none = {c for c, s in found.items() if not s}
        several = set()
        # More letters than three, or letters and others: what the character is composed of, by Unicode.
        for c in map(chr, CODE_POINTS):
            parts = [found.get(p, p) for p in unicodedata.normalize("NFKD", c) if p not in none]
            if c not in found and len(parts) > 1 and any(p in ALPHABET for p in parts):
                several.add(c)
        _FOLDINGS[collation] = Folding("".join(one), "".join(found[c] for c in one), "".join(sorted(none)), "".join(sorted(several)), {c: s for c, s in found.items() if len(s) > 1})
    return _FOLDINGS[collation]


def occurrences(folded: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """The trigrams of folded texts as numbers, with the text's place; each once, in order."""
    texts = [t.encode("utf-8", "replace") for t in folded]
    codes = _CODES[np.frombuffer(b"\n".join([*texts, b""]), np.uint8)]
    place = np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    a, b, c = (codes[k : len(codes) - (GRAM - 1) + k] for k in range(GRAM))
    there = (a >= 0) & (b >= 0) & (c >= 0)
    base = len(ALPHABET)
    both = np.unique((((a * base + b) * base + c)[there] << 32) | place[: len(there)][there])
    return both >> 32, both & 0xFFFFFFFF


def gram_of(code: int) -> str:
    base = len(ALPHABET)
    return ALPHABET[code // base**2] + ALPHABET[code // base % base] + ALPHABET[code % base]


def grams(folded: str) -> list[str]:
    """The different trigrams of a folded text."""
    return [gram_of(code) for code in occurrences([folded])[0].tolist()]


@dataclass(frozen=True)
class Index:
    """Where an index lies, and what it was made with."""

    path: str
    columns: tuple[str, ...]
    key_type: str
    collation: str | None
    buckets: int

    def postings(self, spark: SparkSession) -> DataFrame:
        """Packed: the keys of some texts that have a trigram. Those that aren't filed are under an empty one."""
        return spark.read.schema(f"gram string, keys array<{self.key_type}>, bucket int").parquet(f"{self.path}/postings")

    def plain(self) -> list[str]:
        return [f"plain_{k}_{c}" for k, c in enumerate(self.columns)]

    def texts(self, spark: SparkSession) -> DataFrame:
        columns = ", ".join(f"`{c}` string" for c in (*self.columns, *self.plain()))
        return spark.read.schema(f"key {self.key_type}, {columns}, bucket int").parquet(f"{self.path}/texts")


def _bucket(value: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(buckets)).cast("int")


def with_plain(df: DataFrame, columns: Sequence[str], names: Sequence[str], how: Folding) -> DataFrame:
    """df with plain forms of its columns."""
    at = [df.columns.index(c) for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [pa.array(map(how.plain, batch.column(k).to_pylist()), pa.string()) for k in at]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *names])

    return df.mapInArrow(run, StructType([*df.schema.fields, *(StructField(n, StringType()) for n in names)]))


def packed(texts: DataFrame, how: Folding) -> DataFrame:
    """gram and keys, some texts at a time. texts has key and, for each column of text, the text or its plain form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, at, held = batch.column(0), 0, 0
            folded: list[str | None] = []
            for row in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                parts = [how.fold(t) for t in row if t is not None]
                folded.append(None if None in parts else "\n".join(parts))
                held += len(folded[-1] or "")
                if held >= PACKED:
                    yield of(keys.slice(at, len(folded)), folded)
                    at, held, folded = at + len(folded), 0, []
            if folded:
                yield of(keys.slice(at), folded)

    def of(keys: pa.Array, folded: list[str | None]) -> pa.RecordBatch:
        codes, places = occurrences([t or "" for t in folded])
        unfiled = np.array([k for k, t in enumerate(folded) if t is None], np.int64)
        starts = np.flatnonzero(np.diff(codes, prepend=-1))
        names = [*map(gram_of, codes[starts].tolist()), *([""] if len(unfiled) else [])]
        ends = [*starts.tolist(), len(codes), *([len(codes) + len(unfiled)] if len(unfiled) else [])]
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), keys.take(pa.array(np.concatenate([places, unfiled]))))
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), lists], names=["gram", "keys"])

    return texts.mapInArrow(run, StructType([StructField("gram", StringType()), StructField("keys", ArrayType(texts.schema["key"].dataType))]))


def described(needles: DataFrame, how: Folding) -> DataFrame:
    """needle_id and needle with its plain form and its trigrams, none if it doesn't fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            plain = pa.array(map(how.plain_needle, texts), pa.string())
            found = pa.array((grams(how.fold(t) or "") for t in texts), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, plain, found], names=["needle_id", "needle", "plain", "grams"])

    return needles.mapInArrow(run, StructType([*needles.schema.fields, StructField("plain", StringType()), StructField("grams", ArrayType(StringType()))]))


def build(df: DataFrame, folder: str, columns: Sequence[str], key: str = "id", collation: str | None = ANY_CASE_AND_ACCENT, buckets: int = BUCKETS) -> Index:
    """Writes an index of text columns of df under folder; keys are unique. Each task files the texts that it has, so a
    trigram that every text has is written by many tasks, and no posting is shuffled."""
    spark = df.sparkSession
    index = Index(f"{folder}/{uuid.uuid4().hex}", tuple(columns), df.schema[key].dataType.simpleString(), collation, buckets)
    how = folding(spark, collation)
    kept = with_plain(df.select(F.col(key).alias("key"), *columns), columns, index.plain(), how)
    kept.withColumn("bucket", _bucket(F.col("key"), buckets)).repartition(buckets, "bucket").write.partitionBy("bucket").parquet(f"{index.path}/texts")
    each = index.texts(spark).select("key", *(F.coalesce(p, c).alias(c) for c, p in zip(columns, index.plain(), strict=True)))
    packed(each, how).withColumn("bucket", _bucket(F.col("gram"), buckets)).write.partitionBy("bucket").parquet(f"{index.path}/postings")
    index.postings(spark).groupBy("gram").agg(F.sum(F.size("keys")).alias("n")).write.parquet(f"{index.path}/counts")
    return index


def lookup(index: Index, needles: DataFrame, looked_up: int = LOOKED_UP) -> DataFrame:
    """Which texts have which needles (needle_id, needle): needle_id and key of each match, once. Null needles match none,
    and an empty one all texts that aren't null."""
    spark = needles.sparkSession
    how = folding(spark, index.collation)
    needles = checkpointed(needles.select("needle_id", "needle").where("needle IS NOT NULL").distinct())
    asked = checkpointed(described(needles, how))
    long = asked.where(F.size("grams") > 0)
    # There are at most as many different trigrams as the alphabet allows, so their counts are small. One that no text has
    # counts 0, and comes first.
    counts = F.broadcast(spark.read.schema("gram string, n long").parquet(f"{index.path}/counts"))
    each = long.select("needle_id", "needle", "plain", F.explode("grams").alias("gram")).join(counts, "gram", "left")
    rarest = each.groupBy("needle_id", "needle", "plain").agg(F.slice(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))), 1, looked_up)["gram"].alias("grams"))
    # Needles go by their number, so no text is shuffled with a posting.
    rarest = numbered(rarest, [F.col("needle_id"), F.col("needle")])
    wanted = rarest.select("rank", F.size("grams").alias("of"), F.explode("grams").alias("gram"))
    buckets = [r[0] for r in wanted.select(_bucket(F.col("gram"), index.buckets).alias("b")).distinct().collect()]
    postings = index.postings(spark).where(F.col("bucket").isin(buckets))
    small = rarest.count() <= MAX_BROADCAST
    met = postings.join(F.broadcast(wanted) if small else wanted, "gram").select("rank", "of", F.explode("keys").alias("key"))
    # A text is listed once under each of its trigrams.
    found = met.groupBy("rank", "key").agg(F.count("*").alias("n"), F.first("of").alias("of")).where("n >= of").select("rank", "key")
    always = index.postings(spark).where((F.col("bucket") == _bucket(F.lit(""), index.buckets)) & (F.col("gram") == "")).select(F.explode("keys").alias("key")).distinct()
    found = checkpointed(found)
    blocks = [r[0] for r in found.select(_bucket(F.col("key"), index.buckets).alias("b")).distinct().collect()]
    texts = index.texts(spark)
    named = rarest.select("rank", "needle_id", "needle", "plain")
    named = found.join(F.broadcast(named) if small else named, "rank")
    met = named.join(texts.where(F.col("bucket").isin(blocks)), "key").where(has(index, F.col("needle"), F.col("plain"))).select("needle_id", "key")
    # Texts that aren't filed meet each needle, and needles that can't be looked up each text, some needles in a pass.
    parts = [met, *scanned(index, texts, asked.where(F.size("grams") == 0))]
    if not always.isEmpty():
        parts += scanned(index, texts.join(always, "key", "left_semi"), long)
    return reduce(DataFrame.unionByName, parts).distinct()


def has(index: Index, needle: Column, plain: Column) -> Column:
    """Whether a column of text contains the needle under the index's collation, by bytes where both are plain."""

    def one(column: str, own: str) -> Column:
        by_bytes = F.contains(F.col(own), plain)
        return F.coalesce(F.when(by_bytes.isNotNull(), by_bytes).otherwise(any_contains([F.col(column)], needle, index.collation)), F.lit(False))

    return reduce(or_, map(one, index.columns, index.plain()))


def scanned(index: Index, texts: DataFrame, needles: DataFrame) -> list[DataFrame]:
    """Needles (as described) compared with every text, SHORT_AT_ONCE in a pass: what no index can answer. Needles are
    numbered where they are, so the driver only sees how many there are."""
    if needles.isEmpty() or texts.isEmpty():
        return []
    ranked, out = numbered(needles.select("needle_id", "needle", "plain"), [F.col("needle_id"), F.col("needle")]), []
    for low in range(0, ranked.count(), SHORT_AT_ONCE):
        # One row, which holds a bounded number of needles.
        some = ranked.where(F.col("rank").between(low, low + SHORT_AT_ONCE - 1)).agg(F.collect_list(F.struct("needle_id", "needle", "plain")).alias("asked"))
        each = texts.join(F.broadcast(some))
        hits = F.filter("asked", lambda n: has(index, n["needle"], n["plain"]))
        out.append(each.select("key", F.explode(hits).alias("hit")).select(F.col("hit.needle_id").alias("needle_id"), "key"))
    return out

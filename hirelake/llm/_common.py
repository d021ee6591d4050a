"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from hirelake.sources.storage import checkpointed, shared_folder

__all__ = ["ascii_lower", "checkpointed", "crc32_of_id", "free_name", "map_rows", "read", "sample_by_id", "shared_folder"]

#: A-Z to a-z and nothing else; SQL lower() also changes letters outside ASCII.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. Texts of ASCII alone, where lower() does the same, take the faster function."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


#: A batch of output rows ends at this many rows or bytes of text.
BATCH_ROWS, BATCH_BYTES = 4096, 4 << 20


def map_rows(df: DataFrame, schema: str, start: Callable[[], Callable[..., Iterable[tuple]]]) -> DataFrame:
    """Runs a row function over Arrow batches: start() is called once per task and gives a function from the values of
    a row to output rows. Output is cut into batches by rows and by bytes, so a task holds little at a time."""
    names = df.columns
    fields = [(f.name, f.type) for f in to_arrow_schema(StructType.fromDDL(schema))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = start()
        out: list[tuple] = []
        held = 0
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
            for at in range(0, batch.num_rows, 64):
                for row in zip(*(c.slice(at, 64).to_pylist() for c in columns), strict=True):
                    for made in each(*row):
                        out.append(made)
                        held += sum(len(v) for v in made if isinstance(v, (str, bytes, list)))
                        if len(out) >= BATCH_ROWS or held >= BATCH_BYTES:
                            yield to_batch(out)
                            out, held = [], 0
        if out:
            yield to_batch(out)

    def to_batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])

    return df.mapInArrow(run, schema)


def free_name(df: DataFrame, name: str) -> str:
    """The name, with marks behind until no column of df has it; names don't differ by case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc32_of_id(doc_id: Column) -> Column:
    """CRC-32 of an id written as text; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")))


def sample_by_id(df: DataFrame, rows: int, seed: int) -> DataFrame:
    """About that many rows, and never more than twice as many, chosen by a digest of doc_id: the same in every run, but if
    one id has more rows than that. Rows without an id are chosen by their other columns. Needs a count, but no sort or
    shuffle."""
    if (n := df.count()) <= rows:
        return df.limit(2 * rows)
    bound = -(1 << 63) + (rows << 64) // n  # digests are spread over all signed 64-bit numbers
    others = [c for c in df.columns if c != "doc_id"]
    digest = F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit(seed), *others)).otherwise(F.xxhash64(F.lit(seed), "doc_id"))
    return df.where(digest < bound).limit(2 * rows)

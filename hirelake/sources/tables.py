"""Reading and writing tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake.sources.schema import ORDERS, schema


def parquet(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A table of the recruiting model. Its schema is declared, so nothing is inferred and no footers are merged."""
    return spark.read.schema(schema(table)).parquet(f"{folder}/{table}.parquet")


def jdbc(spark: SparkSession, url: str, table: str, key: str = "id", parts: int = 32, **options: str) -> DataFrame:
    """A table of a database, read in parts of about equal size by ranges of its whole-numbered key, whose driver must be on
    the class path. Filters on columns go to the database. Rows without a key are a part of their own."""
    cuts = even_cuts(spark, url, table, key, parts, **options)
    ends = [None, *cuts, None]
    bounds = [" AND ".join([f"{key} >= {low}"] * (low is not None) + [f"{key} < {high}"] * (high is not None)) or f"{key} IS NOT NULL" for low, high in zip(ends, ends[1:], strict=False)]
    return spark.read.jdbc(url, table, predicates=[*bounds, f"{key} IS NULL"], properties=options)


def even_cuts(spark: SparkSession, url: str, table: str, key: str, parts: int, **options: str) -> list[int]:
    """Keys at which a table falls into parts, none of over twice the average unless one key alone is. The database counts
    rows in equal ranges of keys, and again in those that hold more than a part should: only counts are sent."""

    def ask(sql: str) -> list:
        return spark.read.format("jdbc").options(url=url, query=sql, **options).load().collect()

    low, high, total = ask(f"SELECT MIN({key}) AS a, MAX({key}) AS b, COUNT({key}) AS n FROM {table}")[0]
    if not total or parts < 2:
        return []
    most, ranges = -(-int(total) // (2 * parts)), []
    waiting = [(int(low), int(high), int(total))]
    while waiting:
        low, high, n = waiting.pop()
        if n <= most or low == high:
            ranges.append((low, n))
            continue
        width = -(-(high - low + 1) // (4 * parts))
        sql = f"SELECT place, COUNT(*) AS n FROM (SELECT ({key} - {low}) / {width} AS place FROM {table} WHERE {key} >= {low} AND {key} <= {high}) placed GROUP BY place"
        waiting += [(low + int(p) * width, min(high, low + (int(p) + 1) * width - 1), int(count)) for p, count in ask(sql)]
    cuts, held = [], 0
    for low, n in sorted(ranges):
        if held and held + n > 2 * most:
            cuts.append(low)
            held = 0
        held += n
    return cuts


def by_key(df: DataFrame, key, column: str = "id") -> DataFrame:
    """The rows with a key; at most two, which is enough to tell one from several."""
    return df.where(F.col(column) == F.lit(key)).limit(2)


def single(df: DataFrame, column: str, value) -> DataFrame:
    """The only row with a value; none or several raise LookupError."""
    found = by_key(df, value, column)
    if (n := found.count()) != 1:
        raise LookupError(f"{'no' if n == 0 else 'more than one'} row with {column} = {value!r}")
    return found


def none_of(df: DataFrame) -> DataFrame:
    """The table without any rows."""
    return df.limit(0)


def in_order(df: DataFrame, table: str) -> DataFrame:
    """The rows of a table in the order that it has unless another is asked for."""
    return df.orderBy(*(F.col(c).desc() if descending else F.col(c).asc() for c, descending in ORDERS[table]))


def first_row(df: DataFrame, *keys: str) -> DataFrame:
    return df.orderBy(*keys).limit(1)


def as_json(df: DataFrame) -> DataFrame:
    """Rows as JSON objects in the column value; nulls are written out."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def dimension(df: DataFrame, key: str = "id", name: str = "name") -> DataFrame:
    """Keys and names of a small table."""
    return df.select(F.col(key).alias("id"), F.col(name).alias("name"))


def inserted(df: DataFrame, new: DataFrame) -> DataFrame:
    """The table with further rows; columns that they lack are null."""
    return df.unionByName(new, allowMissingColumns=True)


def day(c: Column) -> Column:
    """Midnight of a date, as a timestamp without a zone."""
    return c.cast("date").cast("timestamp_ntz")

"""A table that can be changed in place: hash buckets of its key, of which a change rewrites only those that it touches.

Each write puts the buckets it has changed into a folder of its own, and then one more manifest, a small file that names the
folder of every bucket. A table is what its latest manifest names, so a write that ends before its manifest has changed
nothing, and those who read meanwhile keep what they have begun with. Writers of one version exclude each other: the folder
of a version's manifest can be made only once.

    path/data/<write>/bucket=<n>/part-...parquet
    path/manifest/version=<n>/part-...json
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hirelake.operators.mutations import merged
from hirelake.sources.storage import checkpointed

BUCKETS = 64
_MANIFEST = "bucket int, folder string, key string, buckets int, columns string"


class Conflict(RuntimeError):
    """Somebody else has written this version."""


@dataclass(frozen=True)
class Version:
    """What a manifest says. Buckets without a row have no folder."""

    path: str
    number: int
    key: str
    buckets: int
    columns: StructType
    folders: dict[int, str]

    def read(self, spark: SparkSession, only: list[int] | None = None) -> DataFrame:
        """The rows of all buckets, or of some."""
        places = [f"{self.path}/data/{folder}/bucket={b}" for b, folder in sorted(self.folders.items()) if only is None or b in only]
        return spark.read.schema(self.columns).parquet(*places) if places else spark.createDataFrame([], self.columns)


def bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def latest(spark: SparkSession, path: str) -> Version:
    """The latest version of a table; its manifest has a row for each bucket. LookupError if there is no table."""
    try:
        rows = spark.read.schema(_MANIFEST + ", version int").json(f"{path}/manifest")
    except AnalysisException:
        raise LookupError(f"there is no table at {path}") from None
    top = rows.agg(F.max("version")).first()[0]
    if top is None:
        raise LookupError(f"there is no table at {path}")
    found = rows.where(F.col("version") == top).collect()
    head = found[0]
    return Version(path, top, head["key"], head["buckets"], StructType.fromJson(json.loads(head["columns"])), {r["bucket"]: r["folder"] for r in found if r["bucket"] is not None})


def read(spark: SparkSession, path: str) -> DataFrame:
    return latest(spark, path).read(spark)


def create(df: DataFrame, path: str, key: str = "id", buckets: int = BUCKETS) -> Version:
    """A new table of the rows of df; a key, which isn't to be null, is there once."""
    new = Version(path, 0, key, buckets, df.schema, {})
    return _commit(df.sparkSession, new, _written(df, new), range(buckets))


def upserted(spark: SparkSession, path: str, changes: DataFrame, insert: bool = False, before_commit=None) -> Version:
    """The next version: columns of changes, which holds a key once, replace those of the rows with the same key where they
    aren't null, as mutations.merged() says; with insert, other keys become rows. Buckets without a change are neither read
    nor written. before_commit, if given, is called when the data are written and the manifest isn't."""
    now = latest(spark, path)
    # The changes are read for their buckets and again for their rows, which have to be the same ones.
    changes = checkpointed(changes)
    touched = [r[0] for r in changes.select(bucket(F.col(now.key), now.buckets).alias("b")).distinct().collect()]
    old = now.read(spark, touched)
    new = merged(old, changes, now.key)
    if insert:
        fresh = changes.join(old.select(F.col(now.key).alias("known_key")), F.col(now.key) == F.col("known_key"), "left_anti")
        new = new.unionByName(fresh, allowMissingColumns=True).select(*now.columns.fieldNames())
    return _next(spark, now, new, touched, before_commit)


def deleted(spark: SparkSession, path: str, keys: DataFrame, before_commit=None) -> Version:
    """The next version, without the rows whose key is in the first column of keys."""
    now = latest(spark, path)
    gone = checkpointed(keys.select(F.col(keys.columns[0]).alias("gone_key")))
    touched = [r[0] for r in gone.select(bucket(F.col("gone_key"), now.buckets).alias("b")).distinct().collect()]
    return _next(spark, now, now.read(spark, touched).join(gone, F.col(now.key) == F.col("gone_key"), "left_anti"), touched, before_commit)


def _next(spark: SparkSession, now: Version, rows: DataFrame, touched: list[int], before_commit) -> Version:
    folder = _written(rows, now)
    if before_commit:
        before_commit()
    return _commit(spark, replace(now, number=now.number + 1), folder, touched)


def _written(rows: DataFrame, version: Version) -> str:
    """Writes rows under a folder of their own, a folder in it for each bucket."""
    folder, name = uuid.uuid4().hex, "bucket"
    placed = rows.withColumn(name, bucket(F.col(version.key), version.buckets))
    placed.repartition(version.buckets, name).write.partitionBy(name).parquet(f"{version.path}/data/{folder}")
    return folder


def _commit(spark: SparkSession, version: Version, folder: str, touched) -> Version:
    """Names the folder for the buckets that it has, and writes the manifest, as one file."""
    try:
        made = {r[0] for r in spark.read.parquet(f"{version.path}/data/{folder}").select("bucket").distinct().collect()}
    except AnalysisException:  # nothing was written
        made = set()
    kept = {b: f for b, f in version.folders.items() if b not in set(touched)}
    new = replace(version, folders=kept | dict.fromkeys(made, folder))
    about = (version.key, version.buckets, version.columns.json())
    rows = [(b, f, *about) for b, f in sorted(new.folders.items())] or [(None, None, *about)]
    try:
        spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("error").json(f"{version.path}/manifest/version={version.number}")
    except AnalysisException as taken:
        if "PATH_ALREADY_EXISTS" not in str(taken):
            raise
        raise Conflict(f"version {version.number} of {version.path} is there already") from None
    return new

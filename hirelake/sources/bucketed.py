"""Tables written in hash buckets of a key, so that joins by it need no shuffle of either side.

Two tables of one number of buckets, each by the column that they are joined by, meet bucket by bucket. The shuffle is paid
once, when a table is written; each task writes one bucket, in the order of the key.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.sources.storage import shared_folder

BUCKETS = 64


def bucketed(df: DataFrame, key: str, buckets: int = BUCKETS, folder: str | None = None) -> DataFrame:
    """Writes df in buckets of key under folder (the shared one unless given) and reads it as such. Spark keeps what it knows
    of buckets in its catalog, so the table gets a name there that nobody else has."""
    spark, name = df.sparkSession, f"bucketed_{uuid.uuid4().hex}"
    path = f"{folder or shared_folder(spark)}/{name}"
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return spark.table(name)


def applications_with_jobs(applications: DataFrame, jobs: DataFrame) -> DataFrame:
    """Applications with the owner and title of their jobs; both sides in equal buckets, by job_id and id, aren't shuffled.
    The hint keeps the join by buckets where one side would be broadcast."""
    named = jobs.select(F.col("id").alias("id_of_job"), "posted_by_id", "title")
    return applications.join(named.hint("merge"), applications["job_id"] == named["id_of_job"]).drop("id_of_job")

"""Reports from a stored rollup: counts of applications by owner, category and month, in a partition for each day of arrival.

Counts add up, so a new day is one more partition, and a day that is written again replaces itself. The reports by year,
quarter and month come from one pass over the rollup, which has a row for each owner, category, month and day of arrival
instead of one for each application.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake.plans.reports import BUCKETS, filled

SCHEMA = "posted_by_id long, category_id long, month date, applications long, day date"


def partial(applications: DataFrame, jobs: DataFrame) -> DataFrame:
    """Counts of applications by owner, category and month. Applications are grouped by job before jobs are joined."""
    by_job = applications.groupBy("job_id", F.trunc("created_date", "month").alias("month")).agg(F.count("*").alias("n"))
    owned = by_job.join(jobs.select(F.col("id").alias("job_id"), "posted_by_id", F.col("category_id").cast("long").alias("category_id")), "job_id")
    return owned.groupBy("posted_by_id", "category_id", "month").agg(F.sum("n").alias("applications"))


def store_day(path: str, day: date, applications: DataFrame, jobs: DataFrame) -> None:
    """Writes the counts of what arrived on a day, in place of what was written for it before."""
    partial(applications, jobs).write.mode("overwrite").parquet(f"{path}/day={day.isoformat()}")


def stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def compacted(spark: SparkSession, path: str, target: str) -> None:
    """A rollup of the same counts with all days in one partition, that of the last day."""
    rows = stored(spark, path)
    last = rows.agg(F.max("day")).first()[0]
    rows.groupBy("posted_by_id", "category_id", "month").agg(F.sum("applications").alias("applications")).write.mode("overwrite").parquet(f"{target}/day={last.isoformat()}")


def reports(rollup: DataFrame, jobs: DataFrame, year: int, category_id: int | None = None) -> DataFrame:
    """The three reports of plans.reports.employer_report() in one, with period, from a rollup. Every count is read once; its
    year, quarter and month are grouping sets."""
    if category_id is not None:
        jobs, rollup = jobs.where(F.col("category_id") == category_id), rollup.where(F.col("category_id") == category_id)
    first, last = f"{year - 2}-01-01", f"{year + 3}-01-01"
    near = rollup.where((F.col("month") >= F.lit(first).cast("date")) & (F.col("month") < F.lit(last).cast("date")))
    in_year = F.year("month") == year
    keyed = near.select("posted_by_id", "applications", F.year("month").alias("of_year"), F.when(in_year, F.quarter("month")).alias("of_quarter"), F.when(in_year, F.month("month")).alias("of_month"))
    levels = {"year": "of_year", "quarter": "of_quarter", "month": "of_month"}
    sets = [[F.col("posted_by_id"), F.col(c)] for c in levels.values()]
    level = F.grouping_id().alias("level")
    counted = keyed.groupingSets(sets, F.col("posted_by_id"), *map(F.col, levels.values())).agg(level, F.sum("applications").alias("applications"))
    # grouping_id has a bit for each column that a set leaves out: the last three are year, quarter and month.
    which = {"year": 0b011, "quarter": 0b101, "month": 0b110}
    period = F.when(F.col("level") == which["year"], "year").when(F.col("level") == which["quarter"], "quarter").otherwise("month")
    bucket = F.coalesce(*(F.when(F.col("level") == which[p], F.col(c)) for p, c in levels.items()))
    counted = counted.select("posted_by_id", period.alias("period"), bucket.alias("bucket"), "applications").where("bucket IS NOT NULL")
    return filled(counted, jobs, {p: (year - 2 if p == "year" else 1, n) for p, n in BUCKETS.items()})

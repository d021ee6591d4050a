"""Reports and dashboards: one plan each, whatever the number of buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.functions.dates import in_year, month_label, period_label

PER_JOB = 500_000
BUCKETS = {"year": 5, "quarter": 4, "month": 12}


def type_counts(jobs: DataFrame) -> DataFrame:
    """Remote, full-time and part-time jobs, counted in one pass."""
    names = ("REMOTE", "FULL_TIME", "PART_TIME")
    return jobs.agg(*(F.count_if(F.col("employment_type") == n).alias(f"{n.lower()}_count") for n in names))


def totals(jobs: DataFrame, candidates: DataFrame, employers: DataFrame, applications: DataFrame) -> DataFrame:
    """One row of counts, inactive rows included, and the revenue as a fixed price for each job."""
    named = {"jobs": jobs, "candidates": candidates, "employers": employers, "applications": applications}
    parts = [df.select(F.lit(n).alias("name")) for n, df in named.items()]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    out = rows.agg(*(F.count_if(F.col("name") == n).alias(n) for n in named))
    return out.withColumn("synthetic_revenue", F.col("jobs") * PER_JOB)


def month_chart(jobs: DataFrame, year: int) -> DataFrame:
    """Jobs created in each month of a year that has any."""
    months = jobs.where(in_year(F.col("created_date"), year)).groupBy(F.trunc("created_date", "month").alias("month")).agg(F.count("*").alias("n"))
    return months.withColumn("label", month_label(F.col("month")))


def recent(jobs: DataFrame, employers: DataFrame, k: int = 5) -> DataFrame:
    """The newest jobs with their companies; the few are chosen before the join."""
    newest = jobs.orderBy(F.col("created_date").desc(), F.col("id")).limit(k)
    company = employers.select(F.col("user_id").alias("posted_by_id"), F.col("company_name").alias("company"))
    return newest.join(company, "posted_by_id")


def bucket(at: Column, period: str) -> Column:
    return {"year": F.year, "quarter": F.quarter, "month": F.month}[period](at)


def efficiency(applications: Column, views: Column) -> Column:
    """Applications for a hundred views, to one decimal, halves upwards; 0 without applications or views."""
    return F.when((applications == 0) | (F.coalesce(views, F.lit(0)) == 0), 0.0).otherwise(F.floor(applications * 1000.0 / views + 0.5) / 10)


def employer_report(applications: DataFrame, jobs: DataFrame, period: str, year: int, category_id: int | None = None) -> DataFrame:
    """For each owner of a job and each bucket of the period: label, applications and efficiency.

    Years are the two before and after; buckets without applications are there with zero. Inactive jobs count. Views are
    those of the owner's jobs. Applications are grouped by job before owners are joined, so jobs join once each.
    """
    if period not in BUCKETS:
        raise ValueError(f"{period!r} is no period")
    if category_id is not None:
        jobs = jobs.where(F.col("category_id") == category_id)
    first, last = (year - 2, year + 2) if period == "year" else (year, year)
    start = in_year(F.col("created_date"), first)
    for y in range(first + 1, last + 1):
        start = start | in_year(F.col("created_date"), y)
    by_job = applications.where(start).groupBy("job_id", bucket(F.col("created_date"), period).alias("bucket")).agg(F.count("*").alias("n"))
    owned = by_job.join(jobs.select(F.col("id").alias("job_id"), "posted_by_id"), "job_id").groupBy("posted_by_id", "bucket").agg(F.sum("n").alias("applications"))
    return filled(owned.withColumn("period", F.lit(period)), jobs, {period: (first if period == "year" else 1, BUCKETS[period])}).drop("period")


def filled(counted: DataFrame, jobs: DataFrame, periods: dict[str, tuple[int, int]]) -> DataFrame:
    """Counts (posted_by_id, period, bucket, applications) with a row for every owner of jobs and every bucket: periods says
    where each period begins and how many buckets it has. Labels and efficiency are added."""
    spans = F.array(*(F.struct(F.lit(p).alias("period"), F.lit(low + k).alias("bucket")) for p, (low, n) in periods.items() for k in range(n)))
    spine = jobs.groupBy("posted_by_id").agg(F.sum("views").alias("views")).withColumn("span", F.explode(spans)).select("posted_by_id", "views", "span.*")
    out = spine.join(counted, ["posted_by_id", "period", "bucket"], "left").withColumn("applications", F.coalesce("applications", F.lit(0).cast("bigint")))
    label = F.coalesce(*(F.when(F.col("period") == p, period_label(p, F.col("bucket"))) for p in periods))
    return out.select("period", "posted_by_id", F.col("bucket").cast("bigint").alias("bucket"), label.alias("label"), "applications", efficiency(F.col("applications"), F.col("views")).alias("efficiency"))


def category_counts(categories: DataFrame, jobs: DataFrame) -> DataFrame:
    """Jobs in each category, those without any included."""
    counted = jobs.groupBy("category_id").agg(F.count("*").alias("n"))
    return categories.join(counted, F.col("id") == F.col("category_id"), "left").select("id", "name", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def with_all(categories: DataFrame, label: str = "Tất cả") -> DataFrame:
    """Choices of a category, with one for all in front; ids become text."""
    first = categories.sparkSession.createDataFrame([("all", label)], "id string, name string")
    return first.unionByName(categories.select(F.col("id").cast("string").alias("id"), "name"))

"""Joins between tables of the recruiting model. Small sides are left to Spark, which broadcasts by measured size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def prefixed(df: DataFrame, prefix: str, *columns: str) -> DataFrame:
    return df.select(*(F.col(c).alias(f"{prefix}_{c}") for c in columns))


def nested(df: DataFrame, key: str, name: str, *columns: str) -> DataFrame:
    """key, and the columns as one struct."""
    return df.select(F.col(key).alias(f"{name}_key"), F.struct(*columns).alias(name))


def with_struct(df: DataFrame, on: str, other: DataFrame, name: str, *columns: str, key: str = "id", how: str = "inner") -> DataFrame:
    """df with a struct of the other table's columns. With how left, rows without a partner have a null."""
    return df.join(nested(other, key, name, *columns), F.col(on) == F.col(f"{name}_key"), how).drop(f"{name}_key")


def children(df: DataFrame, parent: str, *columns: str, order: tuple[str, ...] = (), descending: bool = False, most: int | None = None) -> DataFrame:
    """parent and items: its rows as an array of structs, in order. Rows are gathered by parent once, before any join, so
    several kinds of children never multiply. most keeps the first ones of each parent, which are chosen before they are
    gathered: for parents that may have more children than an array should hold."""
    sort = order or columns[:1]
    if most is not None:
        by = [F.col(c).desc() if descending else F.col(c).asc() for c in dict.fromkeys((*sort, *columns))]
        df = df.withColumn("child_place", F.row_number().over(Window.partitionBy(parent).orderBy(*by))).where(F.col("child_place") <= most)
    packed = F.struct(F.struct(*sort).alias("at"), F.struct(*columns).alias("item"))
    return df.groupBy(F.col(parent).alias("parent")).agg(F.transform(F.sort_array(F.collect_list(packed), asc=not descending), lambda x: x["item"]).alias("items"))


def with_children(df: DataFrame, key: str, found: DataFrame, name: str) -> DataFrame:
    """df with an array column of children; those without any have an empty one."""
    kind = found.schema["items"].dataType.simpleString()
    renamed = found.select(F.col("parent").alias(f"{name}_parent"), F.col("items").alias(name))
    out = df.join(renamed, F.col(key) == F.col(f"{name}_parent"), "left").drop(f"{name}_parent")
    return out.withColumn(name, F.coalesce(name, F.from_json(F.lit("[]"), kind)))


def through_bridge(bridge: DataFrame, left: str, right: str, other: DataFrame, *columns: str) -> DataFrame:
    """The other side's rows of each left key of a many-to-many table, as children()."""
    rows = bridge.select(F.col(left).alias("parent_key"), F.col(right).alias("other_key")).distinct()
    return children(rows.join(other, F.col("other_key") == F.col("id")), "parent_key", *columns)


def first_by(df: DataFrame, keys: list[str], order: Column, *columns: str) -> DataFrame:
    """Of each group the columns of the row with the greatest order."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*columns), order).alias("first")).select(*keys, "first.*")


def bookmark_ids(jobs: DataFrame, bookmarks: DataFrame, user_id: int, key: str = "id") -> DataFrame:
    """jobs with bookmark_id, that of a user's newest bookmark, and saved. Bookmarks of the user are a filter below the
    join, so it is one join for all rows."""
    own = first_by(bookmarks.where(F.col("user_id") == user_id), ["job_id"], F.struct("created_date", "id"), "id")
    own = own.select(F.col("job_id").alias("marked_job"), F.col("id").alias("bookmark_id"))
    return jobs.join(own, F.col(key) == F.col("marked_job"), "left").drop("marked_job").withColumn("saved", F.col("bookmark_id").isNotNull())


def existing(df: DataFrame, on: str, other: DataFrame, key: str) -> DataFrame:
    """Rows that have a partner."""
    return df.join(other.select(F.col(key).alias("partner")), F.col(on) == F.col("partner"), "left_semi")


def missing(df: DataFrame, on: str, other: DataFrame, key: str) -> DataFrame:
    """Rows that have none, those with a null among them."""
    return df.join(other.select(F.col(key).alias("partner")), F.col(on) == F.col("partner"), "left_anti")


def flagged(df: DataFrame, on: str, other: DataFrame, key: str, name: str) -> DataFrame:
    """df with whether a row has a partner."""
    found = other.select(F.col(key).alias("partner")).where(F.col("partner").isNotNull()).distinct()
    return df.join(found, F.col(on) == F.col("partner"), "left").withColumn(name, F.col("partner").isNotNull()).drop("partner")


def job_with_dimensions(jobs: DataFrame, categories: DataFrame, locations: DataFrame) -> DataFrame:
    return with_struct(with_struct(jobs, "category_id", categories, "category", "id", "name"), "location_id", locations, "location", "id", "name")


def applications_of_employer(applications: DataFrame, jobs: DataFrame, candidates: DataFrame, users: DataFrame) -> DataFrame:
    """Applications with their job, candidate and user, flat."""
    job = prefixed(jobs, "job", "id", "title", "posted_by_id")
    candidate = prefixed(candidates, "candidate", "user_id", "specialization", "experience_years", "resume")
    user = prefixed(users, "user", "id", "first_name", "last_name", "username", "email", "phone", "avatar")
    out = applications.withColumnsRenamed({"job_id": "applied_job_id", "candidate_id": "applicant_id"})
    return out.join(job, F.col("applied_job_id") == F.col("job_id")).join(candidate, F.col("applicant_id") == F.col("candidate_user_id")).join(user, F.col("applicant_id") == F.col("user_id"))


def employers_with_users(employers: DataFrame, users: DataFrame) -> DataFrame:
    """Employers with their user and, if there is one, the user who verified them."""
    fields = ("id", "username", "first_name", "last_name", "email", "avatar")
    out = with_struct(employers, "user_id", users, "user", *fields)
    return with_struct(out, "verified_by", users, "verifier", *fields, how="left")


def bookmarks_with_jobs(bookmarks: DataFrame, jobs: DataFrame, user_id: int) -> DataFrame:
    """A user's bookmarks, each with its job."""
    return with_struct(bookmarks.where(F.col("user_id") == user_id), "job_id", jobs, "job", "id", "title", "company_name", "salary_min", "salary_max", "deadline", "active")


def receipts_with_packs(receipts: DataFrame, packs: DataFrame, jobs: DataFrame) -> DataFrame:
    """Receipts with their pack and job, either of which may be missing."""
    out = with_struct(receipts, "service_pack_id", packs, "service_pack", "id", "name", "price", "duration_days", how="left")
    return with_struct(out, "related_job_id", jobs, "related_job", "id", "title", how="left")

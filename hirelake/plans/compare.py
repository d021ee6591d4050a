"""Comparison of a few jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.functions.money import salary_band
from hirelake.functions.text import compare_cell, enum_title, strip_html
from hirelake.operators.relations import job_with_dimensions


def same_category(jobs: DataFrame, *by: str) -> DataFrame:
    """Whether all jobs (of each group) are of one category; there is no row for no jobs."""
    return jobs.groupBy(*by).agg(F.count("*").alias("n_jobs"), (F.count_distinct("category_id") == 1).alias("same_category")).where("n_jobs > 0")


def parse_id_list(text: str) -> list[int]:
    """Ids of a list such as "1, 2,x": what is no number is left out, as is one too large for an id."""
    return [int(x) for part in text.split(",") if (x := part.strip()).isdecimal() and int(x) < 1 << 63]


def compared(jobs: DataFrame, categories: DataFrame, locations: DataFrame, ids: str) -> DataFrame:
    """Cells of the active jobs with the ids in a list, and whether they share a category."""
    chosen = jobs.where(F.col("id").isin(parse_id_list(ids)) & F.col("active"))
    rows = job_with_dimensions(chosen, categories, locations)
    return rows.join(same_category(chosen)).select(
        "id",
        compare_cell(F.col("title")).alias("title"),
        compare_cell(F.col("category.name")).alias("category"),
        compare_cell(F.col("location.name")).alias("location"),
        compare_cell(enum_title(F.col("employment_type"))).alias("employment_type"),
        compare_cell(enum_title(F.col("experience_level"))).alias("experience_level"),
        salary_band(F.col("salary_min"), F.col("salary_max")).alias("salary"),
        *(compare_cell(strip_html(F.col(c))).alias(c) for c in ("description", "requirements", "benefits")),
        "same_category",
    )

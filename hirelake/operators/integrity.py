"""Rules as queries for what breaks them."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.functions.text import file_has_type, filled, is_verified
from hirelake.sources.schema import DOMAINS, LENGTHS, UNIQUE

MAX_RESUME_BYTES = 5 * 1024 * 1024


def breaking(df: DataFrame, rule: Column) -> DataFrame:
    """Rows for which a rule is false. One that is unknown, for a null, counts as kept, as a check constraint does."""
    return df.where(~F.coalesce(rule, F.lit(True)))


def salary_ordered() -> Column:
    return F.col("salary_min").isNull() | F.col("salary_max").isNull() | (F.col("salary_min") <= F.col("salary_max"))


def deadline_ahead(as_of: Column) -> Column:
    return F.col("deadline") >= as_of


def levels_in_range() -> Column:
    return F.col("oral_level").between(0, 10) & F.col("written_level").between(0, 10)


def rating_in_range() -> Column:
    return F.col("rating").isNull() | F.col("rating").between(1, 5)


def education_ordered() -> Column:
    return F.col("end_date") >= F.col("start_date")


def in_domain(table: str, column: str) -> Column:
    return F.col(column).isin(*DOMAINS[table, column])


def at_most(column: str, n: int) -> Column:
    return F.length(column) <= n


def broken_columns(df: DataFrame, table: str, key: str = "id") -> DataFrame:
    """key and column for each value that is too long or outside its domain, by what is declared for the table."""
    rules = [(c, at_most(c, n)) for (t, c), n in LENGTHS.items() if t == table and c in df.columns]
    rules += [(c, in_domain(table, c)) for t, c in DOMAINS if t == table and c in df.columns]
    found = F.array_distinct(F.array_compact(F.array(F.lit(None).cast("string"), *(F.when(~rule, F.lit(c)) for c, rule in rules))))
    return df.select(F.col(key).alias("key"), F.explode(found).alias("column"))


def resume_accepted(name: Column, size: Column) -> Column:
    return file_has_type(name) & (size <= MAX_RESUME_BYTES)


def repeated(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Values of the columns that occur more than once, and how often; nulls never repeat."""
    present = reduce(and_, (F.col(c).isNotNull() for c in columns))
    return df.where(present).groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1")


def all_repeated(tables: dict[str, DataFrame]) -> dict[tuple[str, tuple[str, ...]], DataFrame]:
    return {(t, columns): repeated(tables[t], columns) for t, sets in UNIQUE.items() if t in tables for columns in sets}


def closed_applications(applications: DataFrame, jobs: DataFrame, as_of: Column) -> DataFrame:
    """Applications for a job that is inactive or past its deadline; one without a deadline is open."""
    job = jobs.select(F.col("id").alias("of_job"), F.col("active").alias("job_active"), F.col("deadline").alias("job_deadline"))
    is_open = F.col("job_active") & (F.col("job_deadline").isNull() | (F.col("job_deadline") >= as_of))
    return applications.join(job, F.col("job_id") == F.col("of_job")).where(~is_open).drop("of_job", "job_active", "job_deadline")


def taken_emails(new: DataFrame, users: DataFrame) -> DataFrame:
    """New or changed users (id, email) whose address another user has."""
    other = users.select(F.col("id").alias("other_id"), F.col("email").alias("other_email"))
    return new.join(other, (F.col("email") == F.col("other_email")) & (F.col("id").isNull() | (F.col("id") != F.col("other_id"))), "left_semi")


#: Gates that a role opens; staff opens to superusers as well, and approved to employers whose profile is.
GATES = {"admin": "ADMIN", "employer": "EMPLOYER", "candidate": "CANDIDATE"}


def admitted(users: DataFrame, employers: DataFrame, gate: str) -> DataFrame:
    """Users who pass a gate: admin, employer, candidate, approved or staff. One who isn't active passes none."""
    active = users.where(F.coalesce("is_active", F.lit(True)))
    if gate in GATES:
        return active.where(F.col("role") == GATES[gate])
    if gate == "staff":
        return active.where(F.coalesce("is_staff", F.lit(False)) | F.coalesce("is_superuser", F.lit(False)))
    if gate != "approved":
        raise ValueError(f"{gate!r} is no gate")
    approved = employers.where(is_verified(F.col("status"))).select(F.col("user_id").alias("employer"))
    return active.where(F.col("role") == GATES["employer"]).join(approved, F.col("id") == F.col("employer"), "left_semi")


def unapproved_posts(jobs: DataFrame, employers: DataFrame) -> DataFrame:
    """Jobs of employers who aren't approved."""
    approved = employers.where(F.col("status") == "APPROVED").select(F.col("user_id").alias("employer"))
    return jobs.join(approved, F.col("posted_by_id") == F.col("employer"), "left_anti")


# Messages that users see.
BLANK = {
    "title": "- Tiêu đề công việc không được để trống.",
    "address": "- Địa chỉ chi tiết không được để trống.",
    "description": "- Mô tả công việc không được để trống.",
    "requirements": "- Yêu cầu ứng viên không được để trống.",
    "benefits": "- Quyền lợi không được để trống.",
}
NOT_A_NUMBER = {"salary_min": "- Lương tối thiểu phải là số.", "salary_max": "- Lương tối đa phải là số."}
NEGATIVE = {"salary_min": "- Lương tối thiểu không được âm.", "salary_max": "- Lương tối đa không được âm."}
NOT_ORDERED = "- Lương tối thiểu không được lớn hơn lương tối đa."
PAST = "- Hạn nộp hồ sơ phải là ngày trong tương lai."
NO_DATE = "- Chưa chọn hạn nộp hồ sơ."


def form_errors(as_of: Column) -> Column:
    """Messages on a job form whose fields are strings, but for deadline, a date; in a fixed order."""
    number = {c: F.regexp_extract(F.col(c), r"^\s*([+-]?\d+)", 1).try_cast("bigint") for c in NOT_A_NUMBER}
    blank = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\s", "") == ""
    checks = [(blank(c), m) for c, m in BLANK.items()]
    checks += [(filled(F.col(c)).isNotNull() & number[c].isNull(), m) for c, m in NOT_A_NUMBER.items()]
    checks += [(number[c] < 0, m) for c, m in NEGATIVE.items()]
    checks += [(number["salary_min"] > number["salary_max"], NOT_ORDERED), (F.col("deadline") < as_of, PAST), (F.col("deadline").isNull(), NO_DATE)]
    return F.array_compact(F.array(*(F.when(wrong, F.lit(m)) for wrong, m in checks)))


def orphans(df: DataFrame, column: str, parents: DataFrame, key: str) -> DataFrame:
    """Rows that refer to no row there is. A null refers to none and is no orphan."""
    return df.where(F.col(column).isNotNull()).join(parents.select(F.col(key).alias("parent_key")), F.col(column) == F.col("parent_key"), "left_anti")

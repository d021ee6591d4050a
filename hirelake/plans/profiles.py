"""Nested documents: job cards and details, candidate profiles, and how clients show them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.functions.dates import date_label, elapsed_label, end_label, job_state
from hirelake.functions.money import salary_band
from hirelake.functions.text import COUNTRY, default_avatar, degree_label, drop_blank, enum_label, full_name, media_url, or_default, strip_html
from hirelake.operators.relations import bookmark_ids, children, job_with_dimensions, through_bridge, with_children, with_struct

CARD = ("id", "title", "company_name", "category", "location", "tags", "employment_type", "experience_level", "salary_min", "salary_max", "deadline", "is_featured", "employer_logo", "created_date", "bookmark_id", "saved")

#: Users without their secrets.
USER = ("id", "username", "first_name", "last_name", "full_name", "email", "bio", "avatar", "phone", "role", "email_notifications", "push_notifications")


def users(df: DataFrame) -> DataFrame:
    first, last, name = F.col("first_name"), F.col("last_name"), F.col("username")
    return df.withColumns({"full_name": full_name(first, last, name), "avatar": media_url(F.col("avatar"), default_avatar(first, last, name))}).select(*USER)


def cards(tables: dict[str, DataFrame], jobs: DataFrame, user_id: int) -> DataFrame:
    """Jobs as cards: category, location and tags nested, the owner's picture, and the user's bookmark."""
    out = job_with_dimensions(jobs, tables["job_category"], tables["location"])
    out = with_children(out, "id", through_bridge(tables["job_tags"], "job_id", "tag_id", tables["tag"], "id", "name"), "tags")
    logo = tables["user"].select(F.col("id").alias("owner"), media_url(F.col("avatar")).alias("employer_logo"))
    out = out.join(logo, F.col("posted_by_id") == F.col("owner"), "left").drop("owner")
    return bookmark_ids(out, tables["bookmark_job"], user_id).select(*CARD)


def details(tables: dict[str, DataFrame], jobs: DataFrame, user_id: int) -> DataFrame:
    """Cards with texts and the company."""
    texts = jobs.select("id", "description", "requirements", "benefits", "posted_by_id")
    out = cards(tables, jobs, user_id).join(texts, "id")
    return with_struct(out, "posted_by_id", tables["employer_profile"], "company", "user_id", "company_name", "website", "description", "address", "tax_code", key="user_id")


def shown_cards(found: DataFrame, now: Column) -> DataFrame:
    """Cards as a list shows them."""
    return found.select(
        "id", "title", F.col("company_name").alias("company"),
        or_default(F.col("employer_logo"), "https://via.placeholder.com/60").alias("logo"),
        or_default(F.col("location.name"), COUNTRY).alias("location"),
        salary_band(F.col("salary_min"), F.col("salary_max")).alias("salary"),
        drop_blank(F.concat(F.array(F.col("category.name"), enum_label(F.col("employment_type"))), F.col("tags.name"))).alias("tags"),
        elapsed_label(F.col("created_date"), now).alias("posted"), job_state(F.col("deadline"), now.cast("date")).alias("state"), "bookmark_id", "saved",
    )


def shown_details(found: DataFrame, now: Column) -> DataFrame:
    """Details as a page shows them."""
    texts = {"description": "Đang tải chi tiết...", "requirements": "Đang tải yêu cầu...", "benefits": "Chưa có thông tin đãi ngộ"}
    return found.select(
        "id", "title", or_default(F.col("company_name"), "Unknown Company").alias("company"), or_default(F.col("location.name"), COUNTRY).alias("location"),
        *(or_default(strip_html(F.col(c)), d).alias(c) for c, d in texts.items()), salary_band(F.col("salary_min"), F.col("salary_max")).alias("salary"),
        or_default(enum_label(F.col("employment_type")), "Full Time").alias("employment_type"), date_label(F.col("deadline")).alias("deadline"), "bookmark_id",
    )


def application_list(applications: DataFrame, found: DataFrame) -> DataFrame:
    """A candidate's applications with cards of their jobs nested."""
    rows = with_struct(applications, "job_id", found, "job", *CARD)
    return rows.select("id", "job", "status", "created_date")


def application_details(applications: DataFrame, found: DataFrame) -> DataFrame:
    """The same with details of their jobs, the papers and what the employer notes."""
    rows = with_struct(applications, "job_id", found, "job", *found.columns)
    return rows.select("id", "job", media_url(F.col("cv")).alias("cv"), "cover_letter", "status", "employer_note", "created_date", "updated_date")


CHILDREN = {
    "work_experience": (("id", "job_title", "company", "start_date", "end_date", "is_current", "description"), "start_date"),
    "education": (("id", "institution", "level", "field_of_study", "start_date", "end_date", "is_current", "description"), "start_date"),
    "language": (("id", "language", "oral_level", "written_level", "is_first_language"), None),
    "appreciation": (("id", "award_name", "category", "end_date", "description"), "end_date"),
}


def candidate_profiles(tables: dict[str, DataFrame]) -> DataFrame:
    """Candidates with their user, skills, work, education, languages and awards nested, the latest first. Each kind of
    children is gathered before it is joined, so none multiplies another."""
    account = users(tables["user"])
    out = with_struct(tables["candidate_profile"], "user_id", account, "user", *USER)
    out = with_children(out, "user_id", through_bridge(tables["candidate_skills"], "candidate_id", "skill_id", tables["skill"], "id", "name"), "skills")
    for table, (columns, latest) in CHILDREN.items():
        found = children(tables[table], "candidate_id", *columns, order=(latest, "id") if latest else ("id",), descending=bool(latest))
        out = with_children(out, "user_id", found, table)
    return out


def shown_profiles(profiles: DataFrame) -> DataFrame:
    """Profiles as a page shows them."""
    return profiles.select(
        "user_id", F.col("user.full_name").alias("full_name"), or_default(F.col("address"), "Chưa cập nhật").alias("location"), F.col("skills.name").alias("skills"),
        F.transform("work_experience", lambda w: F.struct(w["id"].alias("id"), w["job_title"].alias("title"), w["company"].alias("company"), w["start_date"].alias("start"), end_label(w["end_date"]).alias("end"), w["description"].alias("description"))).alias("work"),
        F.transform("education", lambda e: F.struct(e["id"].alias("id"), degree_label(e["level"], e["field_of_study"]).alias("degree"), e["institution"].alias("school"), e["start_date"].alias("start"), end_label(e["end_date"]).alias("end"))).alias("education"),
        F.transform("appreciation", lambda a: F.struct(a["id"].alias("id"), a["award_name"].alias("title"), a["category"].alias("subtitle"), a["end_date"].alias("year"), a["description"].alias("description"))).alias("appreciation"),
        F.when(F.col("resume").isNotNull(), or_default(F.col("resume_name"), "My Resume.pdf")).alias("resume"),
    )


def flagged_languages(languages: DataFrame, flags: DataFrame, default: str) -> DataFrame:
    """Languages with a flag's address by name; one that isn't known gets the default."""
    known = flags.select(F.col("name").alias("flag_name"), F.col("flag"))
    return languages.join(known, F.col("language") == F.col("flag_name"), "left").drop("flag_name").withColumn("flag", F.coalesce("flag", F.lit(default)))

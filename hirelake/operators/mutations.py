"""Changes of state as functions from a table to its next state. Writing the result is the caller's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.operators.ranks import numbered
from hirelake.operators.relations import missing
from hirelake.sources.tables import inserted


def overlaid(df: DataFrame, where: Column, **values: Column) -> DataFrame:
    """Columns replaced in the rows that a condition holds for."""
    hit = F.coalesce(where, F.lit(False))
    return df.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})


def merged(df: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Columns of changes replace those of the rows with the same key, where they aren't null. changes holds a key once."""
    columns = [c for c in changes.columns if c != key]
    new = changes.select(F.col(key).alias("changed_key"), *(F.col(c).alias(f"new_{c}") for c in columns))
    out = df.join(new, F.col(key) == F.col("changed_key"), "left")
    return out.withColumns({c: F.coalesce(f"new_{c}", c) for c in columns}).select(*df.columns)


def soft_deleted(jobs: DataFrame, owner: int, job_id: int) -> DataFrame:
    return overlaid(jobs, (F.col("id") == job_id) & (F.col("posted_by_id") == owner), active=F.lit(False))


def without(df: DataFrame, key: str, value) -> DataFrame:
    """Rows but those with a value; a null key stays."""
    return df.where(~F.col(key).eqNullSafe(F.lit(value)))


def jobs_created(jobs: DataFrame, new: DataFrame, employers: DataFrame, now: Column) -> DataFrame:
    """Further jobs with the name of their employer's company; those of employers who aren't approved are left out."""
    company = employers.where(F.col("status") == "APPROVED").select(F.col("user_id").alias("employer"), F.col("company_name").alias("company"))
    rows = new.join(company, F.col("posted_by_id") == F.col("employer")).drop("employer")
    rows = rows.withColumns({"company_name": F.col("company"), "active": F.lit(True), "created_date": now, "updated_date": now}).drop("company")
    return inserted(jobs, rows)


def links_replaced(bridge: DataFrame, parent: str, child: str, new: DataFrame) -> DataFrame:
    """A many-to-many table after setting the children of the parents in new. A parent with a null child alone loses all."""
    kept = missing(bridge, parent, new.select(F.col(parent).alias("set_parent")), "set_parent")
    return kept.unionByName(new.where(F.col(child).isNotNull()).select(parent, child).distinct())


def job_updated(jobs: DataFrame, bridge: DataFrame, changes: DataFrame, tags: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Jobs with the fields in changes that aren't null, and job_tags; tags (job_id, tag_id), if given, replace those of the
    jobs in it."""
    return merged(jobs, changes), bridge if tags is None else links_replaced(bridge, "job_id", "tag_id", tags)


def profile_updated(tables: dict[str, DataFrame], changes: DataFrame, skills: DataFrame | None = None) -> dict[str, DataFrame]:
    """candidate_profile, user, skill and candidate_skills after changes to profiles (user_id, any of their columns, and
    bio, which is the user's). skills (user_id, name), if given, replace the skills of the users in it; names that are
    new become skills. A user with a null name alone loses all."""
    out = dict(tables)
    out["candidate_profile"] = merged(tables["candidate_profile"], changes.drop("bio"), "user_id")
    if "bio" in changes.columns:
        out["user"] = merged(tables["user"], changes.select(F.col("user_id").alias("id"), "bio"))
    if skills is not None:
        out["skill"] = got_or_created(tables["skill"], skills.where(F.col("name").isNotNull()))
        known = out["skill"].groupBy("name").agg(F.min("id").alias("skill_id"))
        links = skills.select(F.col("user_id").alias("candidate_id"), F.trim("name").alias("name")).join(known, "name", "left")
        out["candidate_skills"] = links_replaced(tables["candidate_skills"], "candidate_id", "skill_id", links.select("candidate_id", "skill_id"))
    return out


def got_or_created(df: DataFrame, names: DataFrame, key: str = "id", name: str = "name") -> DataFrame:
    """The table with a row for each name that it lacks, blanks around it left out. New keys go on from the greatest one in
    the order of the names, so each evaluation gives the same."""
    new = names.select(F.trim(F.col(name)).alias(name)).where(F.col(name) != "").distinct().join(df.select(F.col(name).alias("known")), F.col(name) == F.col("known"), "left_anti")
    top = df.agg(F.coalesce(F.max(key), F.lit(0)).alias("top"))
    ranked = numbered(new, [F.col(name)], "place").join(F.broadcast(top))
    return inserted(df, ranked.select((F.col("top") + F.col("place") + 1).alias(key), name))


def bookmarked(bookmarks: DataFrame, new: DataFrame, jobs: DataFrame) -> DataFrame:
    """Bookmarks with new ones (user_id, job_id, ...) of active jobs; those that exist already are left out."""
    active = jobs.where("active").select(F.col("id").alias("active_job"))
    fresh = new.join(active, F.col("job_id") == F.col("active_job"), "left_semi").dropDuplicates(["user_id", "job_id"])
    known = bookmarks.select(F.col("user_id").alias("known_user"), F.col("job_id").alias("known_job"))
    fresh = fresh.join(known, (F.col("user_id") == F.col("known_user")) & (F.col("job_id") == F.col("known_job")), "left_anti")
    return inserted(bookmarks, fresh)


def bookmark_removed(bookmarks: DataFrame, user: int, job: int | None = None) -> DataFrame:
    """Without a user's bookmark of a job, or without all of theirs."""
    hit = F.col("user_id") == user
    return bookmarks.where(~F.coalesce(hit if job is None else hit & (F.col("job_id") == job), F.lit(False)))


def employers_judged(employers: DataFrame, keys: DataFrame, approve: bool, admin: int, now: Column, reason: str = "") -> DataFrame:
    """Employers whose user_id is in keys, approved or rejected. updated_date stays, as in any set-based update."""
    hit = keys.select(F.col(keys.columns[0]).alias("judged")).distinct()
    out = employers.join(hit, F.col("user_id") == F.col("judged"), "left")
    out = overlaid(out, F.col("judged").isNotNull(), status=F.lit("APPROVED" if approve else "REJECTED"), verified_at=now, verified_by=F.lit(admin).cast("long"), reject_reason=F.lit("" if approve else reason))
    return out.drop("judged")


def affected(df: DataFrame, where: Column) -> DataFrame:
    """How many rows a change would touch, as one row."""
    return df.where(where).agg(F.count("*").alias("n"))


def application_changed(applications: DataFrame, candidate: int, application: int, **values: Column) -> DataFrame:
    """A candidate's own application, as long as nobody has looked at it."""
    own = (F.col("id") == application) & (F.col("candidate_id") == candidate)
    return overlaid(applications, own & (F.col("status") == "SUBMITTED"), **values)


def application_withdrawn(applications: DataFrame, candidate: int, application: int) -> DataFrame:
    own = (F.col("id") == application) & (F.col("candidate_id") == candidate) & (F.col("status") == "SUBMITTED")
    return applications.where(~F.coalesce(own, F.lit(False)))


def application_reviewed(applications: DataFrame, reviews: DataFrame) -> DataFrame:
    """Reviews (id and any of status, employer_note, rating) by employers; nothing else can be changed."""
    return merged(applications, reviews.select("id", *(c for c in ("status", "employer_note", "rating") if c in reviews.columns)))


def resume_cleared(candidates: DataFrame, user: int) -> DataFrame:
    return overlaid(candidates, F.col("user_id") == user, resume=F.lit(None).cast("string"), resume_name=F.lit(None).cast("string"))


def education_normalised(education: DataFrame) -> DataFrame:
    """What goes on has no end."""
    return overlaid(education, F.col("is_current"), end_date=F.lit(None).cast("date"))


def registered(users: DataFrame, profiles: DataFrame, new_users: DataFrame, new_profiles: DataFrame, role: str) -> tuple[DataFrame, DataFrame]:
    """Users and profiles with new ones; those whose email is taken are left out of both."""
    taken = users.select(F.col("email").alias("taken"))
    fresh = new_users.join(taken, F.col("email") == F.col("taken"), "left_anti").dropDuplicates(["email"]).withColumn("role", F.lit(role))
    own = new_profiles.join(fresh.select(F.col("id").alias("fresh")), F.col("user_id") == F.col("fresh"), "left_semi")
    return inserted(users, fresh), inserted(profiles, own)


def bounded_choice(ids: Column, least: int = 2, most: int = 5) -> Column:
    """Whether as many are chosen as may be compared."""
    return F.size(ids).between(least, most)

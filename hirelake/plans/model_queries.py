"""Queries of the whole recruiting model on the driver's tables, with SQL for each.

Here the driver's tables make up tables of the model under its own names and columns, so that the library's functions run
on them as they are: customers are employers, suppliers candidates (with ids from a billion on), orders jobs, lineitems
applications, bookmarks, work and education, parts tags, skills and service packs.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake.functions import dates, money, text
from hirelake.operators import bitmaps, deletes, integrity, mutations, ranks, relations, search, trigrams
from hirelake.plans import compare, payments, profiles
from hirelake.sources import bucketed, generator, tables, upserts
from hirelake.sources.storage import shared_folder
from hirelake.streaming import settlement

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TODAY = "1999-06-01"
CANDIDATES = 1_000_000_000
#: The candidate and the employer whose rows some queries show.
ME, OWNER = CANDIDATES + 7, 7

#: Each table of the model as SQL that both sides understand: columns from a driver's table.
MODEL = {
    "user": f"""
        SELECT c_custkey AS id, c_name AS username, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS first_name, CASE WHEN c_custkey % 4 <> 0 THEN concat('N', c_nationkey) END AS last_name,
               lower(concat(c_name, '@example.org')) AS email, 'bio' AS bio, CASE WHEN c_custkey % 5 = 0 THEN concat('https://img/', c_custkey) END AS avatar, '090' AS phone, CASE WHEN c_custkey % 50 = 1 THEN 'ADMIN' ELSE 'EMPLOYER' END AS role,
               true AS email_notifications, false AS push_notifications, c_custkey % 11 <> 0 AS is_active, c_custkey % 97 = 0 AS is_staff, c_custkey % 101 = 0 AS is_superuser FROM customer
        UNION ALL
        SELECT {CANDIDATES} + s_suppkey, s_name, 'An', CASE WHEN s_suppkey % 4 <> 0 THEN concat('S', s_nationkey) END, lower(concat(s_name, '@example.org')), NULL, NULL, NULL, 'CANDIDATE', true, true, true, false, false FROM supplier""",
    "employer_profile": "SELECT c_custkey AS user_id, c_name AS company_name, concat('T', c_custkey % 1400) AS tax_code, concat('https://', c_custkey, '.example.org') AS website, c_mktsegment AS description, concat('Road ', c_nationkey) AS address, CASE c_mktsegment WHEN 'BUILDING' THEN 'APPROVED' WHEN 'MACHINERY' THEN 'REJECTED' ELSE 'PENDING' END AS status, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey % 3 AS BIGINT) END AS verified_by FROM customer",
    "candidate_profile": f"SELECT {CANDIDATES} + s_suppkey AS user_id, 'MALE' AS gender, CASE WHEN s_suppkey % 2 = 0 THEN concat('Road ', s_nationkey) ELSE '' END AS address, CAST(s_nationkey AS INT) AS experience_years, CAST('1990-01-01' AS DATE) AS dob, concat('Field ', s_nationkey) AS specialization, CASE WHEN s_suppkey % 3 = 0 THEN concat('cv', s_suppkey, '.pdf') END AS resume, CASE WHEN s_suppkey % 6 = 0 THEN concat('cv', s_suppkey, '.PDF') END AS resume_name, 'STUDYING' AS education_status FROM supplier",
    "location": "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name FROM nation",
    "job_category": "SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS name FROM region",
    "tag": "SELECT p_partkey AS id, p_name AS name FROM part",
    "skill": "SELECT p_partkey AS id, concat(p_name, ' ', p_partkey) AS name FROM part",
    "job": """
        SELECT o_orderkey AS id, o_custkey AS posted_by_id, o_orderpriority AS title, concat('<p>Text ', o_orderkey % 10, '</p>') AS description, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'a<br>b' END AS requirements, CASE WHEN o_orderkey % 2 = 0 THEN '<b>B</b>' END AS benefits, c_name AS company_name, o_orderkey % 5 = 0 AS is_featured,
               CAST(n_regionkey AS BIGINT) AS category_id, CAST(n_nationkey AS BIGINT) AS location_id, CASE o_orderstatus WHEN 'O' THEN 'REMOTE' WHEN 'F' THEN 'FULL_TIME' ELSE 'PART_TIME' END AS employment_type, CASE WHEN o_orderkey % 7 = 0 THEN 'BOSS' ELSE 'JUNIOR' END AS experience_level, CAST(o_orderkey % 100 AS INT) AS views,
               CAST(o_orderkey % 30 AS BIGINT) * 1000000 AS salary_min, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderkey % 50 AS BIGINT) * 1000000 END AS salary_max, CASE WHEN o_orderkey % 9 <> 0 THEN CAST(o_orderdate AS DATE) END AS deadline, o_orderstatus <> 'P' AS active, o_orderdate AS created_date
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "job_tags": "SELECT l_orderkey AS job_id, l_partkey AS tag_id FROM lineitem",
    "bookmark_job": f"SELECT l_orderkey * 100 + l_linenumber AS id, {CANDIDATES} + l_suppkey AS user_id, l_orderkey AS job_id, l_shipdate AS created_date FROM lineitem WHERE l_returnflag = 'R'",
    "application": f"SELECT l_orderkey * 100 + l_linenumber AS id, {CANDIDATES} + l_suppkey AS candidate_id, l_orderkey AS job_id, CASE l_returnflag WHEN 'A' THEN 'SUBMITTED' WHEN 'R' THEN 'REVIEWED' ELSE 'APPROVED' END AS status, concat('note ', l_linenumber) AS employer_note, CASE WHEN l_linenumber > 1 THEN CAST(l_linenumber AS INT) END AS rating, 'letter' AS cover_letter, CASE WHEN l_linenumber = 1 THEN 'https://cv/1' END AS cv, l_shipdate AS created_date, l_shipdate AS updated_date FROM lineitem",
    "candidate_skills": f"SELECT {CANDIDATES} + l_suppkey AS candidate_id, l_partkey AS skill_id FROM lineitem WHERE l_quantity > 45",
    "work_experience": f"SELECT l_orderkey * 100 + l_linenumber AS id, {CANDIDATES} + l_suppkey AS candidate_id, concat('Job ', l_linenumber) AS job_title, concat('Company ', l_orderkey % 10) AS company, CAST(l_shipdate AS DATE) AS start_date, CASE WHEN l_linenumber > 2 THEN CAST(l_shipdate AS DATE) END AS end_date, l_linenumber <= 2 AS is_current, '' AS description FROM lineitem WHERE l_quantity < 3",
    "education": f"SELECT l_orderkey * 100 + l_linenumber AS id, {CANDIDATES} + l_suppkey AS candidate_id, concat('School ', l_orderkey % 10) AS institution, CASE WHEN l_linenumber > 1 THEN 'Master' ELSE '' END AS level, concat('Field ', l_linenumber) AS field_of_study, CAST(l_shipdate AS DATE) AS start_date, CAST(CASE WHEN l_linenumber > 4 THEN '1996-01-01' ELSE '2005-01-01' END AS DATE) AS end_date, l_linenumber <= 2 AS is_current, '' AS description FROM lineitem WHERE l_quantity BETWEEN 10 AND 11",
    "language": f"SELECT s_suppkey AS id, {CANDIDATES} + s_suppkey AS candidate_id, concat('Language ', s_nationkey) AS language, CAST(s_suppkey % 13 AS INT) AS oral_level, CAST(s_suppkey % 12 AS INT) AS written_level, s_suppkey % 2 = 0 AS is_first_language FROM supplier",
    "appreciation": f"SELECT s_suppkey AS id, {CANDIDATES} + s_suppkey AS candidate_id, 'Award' AS award_name, 'Category' AS category, CAST('2020-01-01' AS DATE) AS end_date, '' AS description FROM supplier WHERE s_suppkey % 2 = 0",
    "service_pack": "SELECT p_partkey AS id, p_name AS name, CAST(p_retailprice AS DECIMAL(12, 0)) AS price, CAST(p_size AS INT) AS duration_days FROM part",
    "receipt": "SELECT c_custkey AS id, c_custkey AS user_id, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey % 120 END AS service_pack_id, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey * 5 END AS related_job_id, CAST(c_custkey % 7 AS DECIMAL(12, 0)) AS amount, 'VNPAY' AS payment_method, 'PENDING' AS status, c_mktsegment = 'BUILDING' AS is_paid, concat('REF_', c_custkey) AS transaction_id, TIMESTAMP '1999-01-01 00:00:00' AS created_date FROM customer",
}
_SOURCES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
Tables = dict[str, DataFrame]


class _Model(dict):
    """Tables of the model, made as they are asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __missing__(self, name: str) -> DataFrame:
        sql = MODEL[name]
        used = [s for s in _SOURCES if f" {s} " in f"{sql} ".replace("\n", " ")]
        # Braces of spark.sql name DataFrames, so no view is registered.
        for s in used:
            sql = sql.replace(f"FROM {s}", f"FROM {{{s}}}").replace(f"JOIN {s} ", f"JOIN {{{s}}} ")
        self[name] = self.spark.sql(sql, **{s: self.raw(s) for s in used})
        return self[name]


def query(sql: str | None = None, *names: str):
    """Registers a query; its SQL sees the tables of the model that are named, the user's as users."""

    def register(f: Callable[[_Model], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(_Model(spark, sf_dir))
        if sql:
            made = ", ".join(f"{'users' if n == 'user' else n} AS ({MODEL[n]})" for n in names)
            ORACLES[f.__name__] = f"WITH {made}{', ' if made and sql.startswith('+') else ''}{sql.removeprefix('+')}" if made else sql
        return f

    return register


def joined(items, name: str = "name"):
    return F.array_join(F.transform(items, lambda x: x[name]), ",")


# --- projections -----------------------------------------------------------------------------------------------------------

_AVATAR = "CASE WHEN coalesce(avatar, '') <> '' THEN avatar ELSE 'https://ui-avatars.com/api/?name=' || replace(url_encode(CASE WHEN trim(coalesce(last_name, '') || ' ' || first_name) <> '' THEN trim(coalesce(last_name, '') || ' ' || first_name) ELSE username END), '%2F', '/') || '&background=random&color=fff&size=512&font-size=0.5' END"
_FULL_NAME = "CASE WHEN first_name <> '' AND last_name <> '' THEN last_name || ' ' || first_name WHEN first_name <> '' THEN first_name WHEN last_name <> '' THEN last_name ELSE username END"


@query(f" SELECT id, username, {_FULL_NAME} AS full_name, {_AVATAR} AS avatar, role FROM users", "user")
def user_accounts(t):
    return profiles.users(t["user"]).select("id", "username", "full_name", "avatar", "role")


_CARD = f"""+
marks AS (SELECT job_id, arg_max(id, (created_date, id)) AS bookmark_id FROM bookmark_job WHERE user_id = {ME} GROUP BY 1),
tagged AS (SELECT job_id, string_agg(name, ',' ORDER BY id) AS tags FROM (SELECT DISTINCT job_id, id, name FROM job_tags JOIN tag ON tag_id = id) GROUP BY 1),
cards AS (
  SELECT j.*, c.name AS category, l.name AS location, coalesce(tagged.tags, '') AS tags, coalesce(u.avatar, '') AS employer_logo, bookmark_id, bookmark_id IS NOT NULL AS saved
  FROM job j JOIN job_category c ON j.category_id = c.id JOIN location l ON j.location_id = l.id LEFT JOIN tagged ON tagged.job_id = j.id LEFT JOIN users u ON u.id = j.posted_by_id LEFT JOIN marks ON marks.job_id = j.id
)"""
_CARD_TABLES = ("job", "job_category", "location", "job_tags", "tag", "bookmark_job", "user")
_SHORT = "CASE WHEN salary_min <> 0 AND salary_max <> 0 THEN printf('%.0fM', salary_min / 1e6) || ' - ' || printf('%.0fM', salary_max / 1e6) WHEN salary_min <> 0 THEN printf('%.0fM', salary_min / 1e6) WHEN salary_max <> 0 THEN printf('%.0fM', salary_max / 1e6) ELSE 'Thỏa thuận' END"
_STATE = f"CASE WHEN deadline IS NULL THEN 'Đang tuyển' WHEN deadline < DATE '{TODAY}' THEN 'Hết hạn' WHEN deadline <= DATE '{TODAY}' + 3 THEN 'Sắp hết hạn' ELSE 'Đang tuyển' END"


@query(_CARD + " SELECT id, title, company_name, category, location, tags, employment_type, employer_logo, bookmark_id, saved FROM cards", *_CARD_TABLES)
def nested_job_cards(t):
    return profiles.cards(t, t["job"], ME).select("id", "title", "company_name", F.col("category.name").alias("category"), F.col("location.name").alias("location"), joined("tags").alias("tags"), "employment_type", "employer_logo", "bookmark_id", "saved")


@query(_CARD + " SELECT c.id, c.tags, c.description, c.requirements, c.benefits, e.company_name AS company, e.website, e.description AS about FROM cards c JOIN employer_profile e ON c.posted_by_id = e.user_id", *_CARD_TABLES, "employer_profile")
def nested_job_details(t):
    return profiles.details(t, t["job"], ME).select("id", joined("tags").alias("tags"), "description", "requirements", "benefits", F.col("company.company_name").alias("company"), F.col("company.website").alias("website"), F.col("company.description").alias("about"))


@query(_CARD + f" SELECT id, company_name AS company, CASE WHEN employer_logo = '' THEN 'https://via.placeholder.com/60' ELSE employer_logo END AS logo, location, {_SHORT} AS salary, category || ',' || replace(employment_type, '_', ' ') || CASE WHEN tags = '' THEN '' ELSE ',' || tags END AS tags, {_STATE} AS state FROM cards", *_CARD_TABLES)
def cards_as_shown(t):
    shown = profiles.shown_cards(profiles.cards(t, t["job"], ME), F.lit(TODAY).cast("timestamp_ntz"))
    return shown.select("id", "company", "logo", "location", "salary", F.array_join("tags", ",").alias("tags"), "state")


@query(f" SELECT id, 'Text ' || id % 10 AS description, CASE WHEN requirements = '' THEN 'Đang tải yêu cầu...' ELSE 'a' || chr(10) || 'b' END AS requirements, CASE WHEN benefits IS NULL THEN 'Chưa có thông tin đãi ngộ' ELSE 'B' END AS benefits, {_SHORT} AS salary, replace(employment_type, '_', ' ') AS employment_type, coalesce(strftime(deadline, '%d/%m/%Y'), 'Không thời hạn') AS deadline FROM job", "job")
def details_as_shown(t):
    shown = profiles.shown_details(profiles.details(t, t["job"], ME), F.lit(TODAY).cast("timestamp_ntz"))
    return shown.select("id", "description", "requirements", "benefits", "salary", "employment_type", "deadline")


@query(f" SELECT a.id, a.job_id, j.title AS job_title, a.candidate_id, u.email, u.username, p.specialization, a.status FROM application a JOIN job j ON a.job_id = j.id JOIN users u ON a.candidate_id = u.id JOIN candidate_profile p ON p.user_id = u.id WHERE j.posted_by_id = {OWNER}", "application", "job", "user", "candidate_profile")
def applications_to_owner(t):
    rows = relations.applications_of_employer(t["application"], t["job"], t["candidate_profile"], t["user"])
    return search.owned_by(rows, "job_posted_by_id", OWNER).select("id", "job_id", "job_title", F.col("applicant_id").alias("candidate_id"), F.col("user_email").alias("email"), F.col("user_username").alias("username"), F.col("candidate_specialization").alias("specialization"), "status")


@query(" SELECT a.id, a.candidate_id, a.status, j.posted_by_id, j.title FROM application a JOIN job j ON a.job_id = j.id", "application", "job")
def applications_by_buckets(t):
    """All applications with their jobs, from tables in equal buckets of the job."""
    applications = bucketed.bucketed(t["application"].select("id", "candidate_id", "job_id", "status"), "job_id", 16)
    jobs = bucketed.bucketed(t["job"].select("id", "posted_by_id", "title"), "id", 16)
    return bucketed.applications_with_jobs(applications, jobs).select("id", "candidate_id", "status", "posted_by_id", "title")


@query(f" SELECT id, title FROM job WHERE posted_by_id = {OWNER} AND contains(lower(title), 'high') ORDER BY created_date DESC, id LIMIT 20", "job")
def own_jobs(t):
    mine = search.owned_by(t["job"], "posted_by_id", OWNER).where(search.contains(F.col("title"), "HIGH"))
    return tables.in_order(mine, "job").limit(20).select("id", "title")


@query(_CARD + f", mine AS (SELECT * FROM application WHERE candidate_id = {ME}) SELECT a.id, c.title, c.category, c.tags, a.status FROM mine a JOIN cards c ON a.job_id = c.id", *_CARD_TABLES, "application")
def own_application_list(t):
    found = profiles.application_list(search.owned_by(t["application"], "candidate_id", ME), profiles.cards(t, t["job"], ME))
    return found.select("id", F.col("job.title").alias("title"), F.col("job.category.name").alias("category"), joined("job.tags").alias("tags"), "status")


@query(f" SELECT a.id, j.description, e.website, coalesce(a.cv, '') AS cv, a.cover_letter, a.employer_note FROM application a JOIN job j ON a.job_id = j.id JOIN employer_profile e ON j.posted_by_id = e.user_id WHERE candidate_id = {ME}", "application", "job", "employer_profile")
def own_application_details(t):
    found = profiles.application_details(search.owned_by(t["application"], "candidate_id", ME), profiles.details(t, t["job"], ME))
    return found.select("id", F.col("job.description").alias("description"), F.col("job.company.website").alias("website"), "cv", "cover_letter", "employer_note")


@query(f" SELECT b.id, b.job_id, j.title, j.company_name, j.active FROM bookmark_job b JOIN job j ON b.job_id = j.id WHERE b.user_id = {ME}", "bookmark_job", "job")
def saved_jobs(t):
    found = relations.bookmarks_with_jobs(t["bookmark_job"], t["job"], ME)
    return found.select("id", "job_id", F.col("job.title").alias("title"), F.col("job.company_name").alias("company_name"), F.col("job.active").alias("active"))


@query(" SELECT r.id, r.amount, p.name AS pack, p.duration_days AS days, j.title AS job FROM receipt r LEFT JOIN service_pack p ON r.service_pack_id = p.id LEFT JOIN job j ON r.related_job_id = j.id", "receipt", "service_pack", "job")
def receipts_and_packs(t):
    found = relations.receipts_with_packs(t["receipt"], t["service_pack"], t["job"])
    return found.select("id", "amount", F.col("service_pack.name").alias("pack"), F.col("service_pack.duration_days").alias("days"), F.col("related_job.title").alias("job"))


@query(" SELECT e.user_id, u.username, v.username AS verifier FROM employer_profile e JOIN users u ON e.user_id = u.id LEFT JOIN users v ON e.verified_by = v.id", "employer_profile", "user")
def employers_with_accounts(t):
    found = relations.employers_with_users(t["employer_profile"], t["user"])
    return found.select("user_id", F.col("user.username").alias("username"), F.col("verifier.username").alias("verifier"))


@query(f"""+
skilled AS (SELECT candidate_id, string_agg(name, ',' ORDER BY id) AS skills FROM (SELECT DISTINCT candidate_id, id, name FROM candidate_skills JOIN skill ON skill_id = id) GROUP BY 1),
worked AS (SELECT candidate_id, string_agg(job_title || '/' || coalesce(CAST(end_date AS VARCHAR), 'Present'), ',' ORDER BY start_date DESC, id DESC) AS work FROM work_experience GROUP BY 1),
learned AS (SELECT candidate_id, string_agg(CASE WHEN level = '' THEN field_of_study ELSE level || ' - ' || field_of_study END, ',' ORDER BY start_date DESC, id DESC) AS education FROM education GROUP BY 1)
SELECT p.user_id, {_FULL_NAME} AS full_name, CASE WHEN address = '' THEN 'Chưa cập nhật' ELSE address END AS location, coalesce(skills, '') AS skills, coalesce(work, '') AS work, coalesce(education, '') AS education, (SELECT count(*) FROM appreciation a WHERE a.candidate_id = p.user_id) AS awards,
       CASE WHEN resume IS NOT NULL THEN coalesce(resume_name, 'My Resume.pdf') END AS resume
FROM candidate_profile p JOIN users u ON p.user_id = u.id LEFT JOIN skilled ON skilled.candidate_id = p.user_id LEFT JOIN worked ON worked.candidate_id = p.user_id LEFT JOIN learned ON learned.candidate_id = p.user_id
""", "candidate_profile", "user", "candidate_skills", "skill", "work_experience", "education", "appreciation")
def profiles_as_shown(t):
    shown = profiles.shown_profiles(profiles.candidate_profiles({n: t[n] for n in ("candidate_profile", "user", "candidate_skills", "skill", *profiles.CHILDREN)}))
    return shown.select("user_id", "full_name", "location", F.array_join("skills", ",").alias("skills"), F.array_join(F.transform("work", lambda w: F.concat(w["title"], F.lit("/"), w["end"])), ",").alias("work"), joined("education", "degree").alias("education"), F.size("appreciation").cast("bigint").alias("awards"), "resume")


@query(" SELECT candidate_id, string_agg(job_title, ',' ORDER BY k) AS latest FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY start_date DESC, id DESC) AS k FROM work_experience) WHERE k <= 3 GROUP BY 1", "work_experience")
def latest_work(t):
    found = relations.children(t["work_experience"], "candidate_id", "id", "job_title", order=("start_date", "id"), descending=True, most=3)
    return found.select(F.col("parent").alias("candidate_id"), joined("items", "job_title").alias("latest"))


@query(" SELECT l.id, l.language, coalesce(n.n_name, 'none') AS flag FROM language l LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 2 = 0) n ON l.language = 'Language ' || n.n_nationkey", "language")
def languages_with_flags(t):
    flags = t.raw("nation").where("n_nationkey % 2 = 0").select(F.concat(F.lit("Language "), "n_nationkey").alias("name"), F.col("n_name").alias("flag"))
    return profiles.flagged_languages(t["language"], flags, "none").select("id", "language", "flag")


@query("SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name FROM nation")
def location_choices(t):
    return tables.dimension(t.raw("nation"), "n_nationkey", "n_name").select(F.col("id").cast("bigint").alias("id"), "name")


_IDS = "12, 5,x,²,0,99999999999999999999,40,7, 33"


@query(" SELECT id, title, coalesce(c.name, '---') AS category, upper(left(employment_type, 1)) || lower(replace(substr(employment_type, 2), '_', ' ')) AS employment_type, " + _SHORT + " AS salary, CASE WHEN requirements = '' THEN '---' ELSE 'a' || chr(10) || 'b' END AS requirements, (SELECT count(DISTINCT category_id) = 1 FROM job WHERE id IN (12, 5, 0, 40, 7, 33) AND active) AS same_category FROM job JOIN (SELECT id AS cid, name FROM job_category) c ON category_id = cid WHERE id IN (12, 5, 0, 40, 7, 33) AND active", "job", "job_category")
def compared_jobs(t):
    return compare.compared(t["job"], t["job_category"], t["location"], _IDS).select("id", "title", "category", "employment_type", "salary", "requirements", "same_category")


@query(" SELECT id, title FROM job WHERE id IN (12, 5, 0, 40, 7, 33)", "job")
def chosen_jobs(t):
    return search.among(t["job"], compare.parse_id_list(_IDS)).select("id", "title")


# --- search ------------------------------------------------------------------------------------------------------------


@query("SELECT doc_id FROM documents WHERE contains(lower(strip_accents(text)), 'etion') OR contains(lower(strip_accents(source)), 'etion')")
def documents_in_any_case_and_accent(t):
    return t.raw("documents").where(search.any_contains([F.col("text"), F.col("source")], "ÉtIoN")).select("doc_id")


_NEEDLES = "SELECT item_id AS needle_id, CASE WHEN length(text) % 3 = 0 THEN upper(substr(text, 30, 24)) WHEN length(text) % 3 = 1 THEN substr(text, 10, 40) ELSE substr(text, 1, 6) END AS needle FROM benchmark UNION ALL SELECT -1, 'çr'"


@query(f"SELECT needle_id, doc_id FROM ({_NEEDLES}) JOIN documents ON contains(lower(strip_accents(text)), lower(strip_accents(needle)))")
def needles_looked_up(t):
    """Pieces of all benchmark items, looked up in an index of all documents."""
    index = trigrams.build(t.raw("documents"), f"{shared_folder(t.spark)}/trigrams", ["text"], "doc_id")
    return trigrams.lookup(index, t.spark.sql(_NEEDLES.replace("FROM benchmark", "FROM {benchmark}"), benchmark=t.raw("benchmark"))).select("needle_id", F.col("key").alias("doc_id"))


@query("SELECT doc_id, strip_accents(text) AS plain FROM documents WHERE text IS NOT NULL")
def documents_without_accents(t):
    return t.raw("documents").where("text IS NOT NULL").select("doc_id", text.strip_accents(F.col("text")).alias("plain"))


@query(" SELECT j.id FROM job j JOIN location l ON j.location_id = l.id WHERE active AND deadline >= DATE '1997-06-01' AND contains(lower(title), 'medium') AND contains(lower(l.name), '_1') AND salary_min >= 3000000 AND salary_max <= 40000000 AND employment_type = 'REMOTE' AND experience_level = 'JUNIOR' AND created_date >= TIMESTAMP '1997-05-01'", "job", "location")
def form_search(t):
    form = {"search": "medium", "location": "_1", "salary": {"min": 3, "max": 40}, "job_types": ["remote", "full"], "experience": "1_3", "last_update": "month"}
    today = F.lit("1997-06-01").cast("date")
    found, _ = search.search_jobs(t["job"], t["location"], search.FilterSpec.from_form(form, today), today)
    return found.select("id")


@query(" SELECT id, title, k AS rank, k // 20 + 1 AS page FROM (SELECT id, title, row_number() OVER (ORDER BY salary_max DESC NULLS LAST, salary_min NULLS FIRST, id) - 1 AS k FROM job)", "job")
def pages_appended(t):
    """All pages of all jobs, as a list that grows page by page shows them."""
    return ranks.paged(t["job"], search.sort_names("-salary_max,salary_min")).select("id", "title", "rank", "page")


@query(" SELECT page, count(*) OVER () AS of_pages, total AS count, CASE WHEN page * 100 < total THEN page + 1 END AS next, CASE WHEN page > 1 THEN page - 1 END AS previous FROM (SELECT count(*) AS total FROM users), range(1, total // 100 + CASE WHEN total % 100 > 0 THEN 2 ELSE 1 END) r(page)", "user")
def page_envelopes(t):
    """What is said of each page of users, a hundred to a page."""
    found = ranks.envelopes(ranks.paged(t["user"], ["username", "id"], 500))
    return found.select("page", F.lit(found.count()).cast("bigint").alias("of_pages"), "count", "next", "previous")


@query("SELECT count(*) AS count, CASE WHEN count(*) > 60 THEN 4::BIGINT END AS next, 2::BIGINT AS previous FROM orders")
def page_envelope(t):
    found = search.page(t["job"], search.ordering(None), 3).envelope()
    return t.spark.createDataFrame([found], "count long, next long, previous long")


@query(" SELECT id, title FROM job ORDER BY created_date DESC, id LIMIT 50", "job")
def newest_jobs(t):
    return tables.in_order(t["job"], "job").limit(50).select("id", "title")


@query(" SELECT id FROM users WHERE NOT is_superuser", "user")
def users_without_superusers(t):
    return mutations.without(t["user"], "is_superuser", True).select("id")


@query(" SELECT 'admin' AS gate, id FROM users WHERE is_active AND role = 'ADMIN' UNION ALL SELECT 'employer', id FROM users WHERE is_active AND role = 'EMPLOYER' UNION ALL SELECT 'candidate', id FROM users WHERE is_active AND role = 'CANDIDATE' UNION ALL SELECT 'staff', id FROM users WHERE is_active AND (is_staff OR is_superuser) UNION ALL SELECT 'approved', id FROM users JOIN employer_profile ON id = user_id WHERE is_active AND role = 'EMPLOYER' AND status = 'APPROVED'", "user", "employer_profile")
def users_by_gate(t):
    return reduce(DataFrame.unionByName, (integrity.admitted(t["user"], t["employer_profile"], gate).select(F.lit(gate).alias("gate"), "id") for gate in (*integrity.GATES, "staff", "approved")))


@query(" SELECT id FROM application WHERE created_date >= TIMESTAMP '1998-12-01' AND created_date < TIMESTAMP '1999-01-01'", "application")
def applications_of_a_month(t):
    return t["application"].where(dates.in_month(F.col("created_date"), 1998, 12)).select("id")


@query(" SELECT user_id, sum(CAST(n BETWEEN 2 AND 5 AS BIGINT)) = count(*) AS may_compare FROM (SELECT user_id, count(DISTINCT job_id) AS n FROM bookmark_job GROUP BY 1) GROUP BY 1", "bookmark_job")
def comparable_bookmarks(t):
    chosen = t["bookmark_job"].groupBy("user_id").agg(F.collect_set("job_id").alias("ids"))
    return chosen.select("user_id", mutations.bounded_choice(F.col("ids")).alias("may_compare"))


# --- rules -------------------------------------------------------------------------------------------------------------


@query(" SELECT 'salary' AS rule, id FROM job WHERE salary_min > salary_max UNION ALL SELECT 'deadline', id FROM job WHERE deadline < DATE '1999-06-01' UNION ALL SELECT 'rating', id FROM application WHERE rating NOT BETWEEN 1 AND 5 UNION ALL SELECT 'levels', id FROM language WHERE oral_level NOT BETWEEN 0 AND 10 OR written_level NOT BETWEEN 0 AND 10 UNION ALL SELECT 'education', id FROM education WHERE end_date < start_date", "job", "application", "language", "education")
def rows_breaking_rules(t):
    rules = {"salary": ("job", integrity.salary_ordered()), "deadline": ("job", integrity.deadline_ahead(F.lit(TODAY).cast("date"))), "rating": ("application", integrity.rating_in_range()), "levels": ("language", integrity.levels_in_range()), "education": ("education", integrity.education_ordered())}
    return reduce(DataFrame.unionByName, (integrity.breaking(t[table], rule).select(F.lit(name).alias("rule"), "id") for name, (table, rule) in rules.items()))


@query(" SELECT 'job' AS of_table, id AS key, 'experience_level' AS column FROM job WHERE experience_level = 'BOSS' UNION ALL SELECT 'tag', p_partkey, 'name' FROM part WHERE len(p_name || repeat('x', p_size)) > 50", "job")
def values_out_of_bounds(t):
    long = t.raw("part").select(F.col("p_partkey").alias("id"), F.concat("p_name", F.repeat(F.lit("x"), F.col("p_size"))).alias("name"))
    return integrity.broken_columns(t["job"], "job").select(F.lit("job").alias("of_table"), "*").unionByName(integrity.broken_columns(long, "tag").select(F.lit("tag").alias("of_table"), "*"))


@query(" SELECT 'application' AS of_table, count(*) AS n FROM (SELECT 1 FROM application GROUP BY candidate_id, job_id HAVING count(*) > 1) UNION ALL SELECT 'bookmark_job', count(*) FROM (SELECT 1 FROM bookmark_job GROUP BY user_id, job_id HAVING count(*) > 1) UNION ALL SELECT 'employer_profile', count(*) FROM (SELECT 1 FROM employer_profile GROUP BY tax_code HAVING count(*) > 1) UNION ALL SELECT 'tag', count(*) FROM (SELECT 1 FROM tag GROUP BY name HAVING count(*) > 1) UNION ALL SELECT 'language', count(*) FROM (SELECT 1 FROM language GROUP BY candidate_id, language HAVING count(*) > 1)", "application", "bookmark_job", "employer_profile", "tag", "language")
def repeats_by_table(t):
    found = integrity.all_repeated({n: t[n] for n in ("application", "bookmark_job", "employer_profile", "tag", "language")})
    return reduce(DataFrame.unionByName, (df.agg(F.count("*").alias("n")).select(F.lit(name).alias("of_table"), "n") for (name, _), df in found.items()))


@query("SELECT p_partkey AS id, regexp_matches(lower(name), '\\.(pdf|doc|docx)$') AND p_size * 150000 <= 5242880 AS accepted FROM (SELECT *, 'cv.' || CASE p_partkey % 4 WHEN 0 THEN 'PDF' WHEN 1 THEN 'docx' WHEN 2 THEN 'exe' ELSE 'pdf.zip' END AS name FROM part)")
def resumes_accepted(t):
    kind = F.element_at(F.array(*map(F.lit, ("PDF", "docx", "exe", "pdf.zip"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return t.raw("part").select(F.col("p_partkey").alias("id"), integrity.resume_accepted(F.concat(F.lit("cv."), kind), F.col("p_size") * 150_000).alias("accepted"))


@query(" SELECT s_suppkey AS id FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN (SELECT min(email) FROM users) ELSE 'free@example.org' END AS email FROM supplier) WHERE email IN (SELECT email FROM users u WHERE u.id <> s_suppkey)", "user")
def addresses_taken(t):
    least = t["user"].agg(F.min("email").alias("least"))
    new = t.raw("supplier").select(F.col("s_suppkey").alias("id")).crossJoin(F.broadcast(least)).select("id", F.when(F.col("id") % 2 == 0, F.col("least")).otherwise("free@example.org").alias("email"))
    return integrity.taken_emails(new, t["user"]).select("id")


@query(f"""
SELECT o_orderkey AS id, array_to_string(list_filter([CASE WHEN o_orderkey % 5 = 0 THEN '- Tiêu đề công việc không được để trống.' END, CASE WHEN o_orderkey % 7 = 0 THEN '- Lương tối thiểu phải là số.' END, CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 11 = 0 THEN '- Lương tối thiểu không được âm.' END,
  CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 AND o_orderkey % 100 > 50 THEN '- Lương tối thiểu không được lớn hơn lương tối đa.' END, CASE WHEN CAST(o_orderdate AS DATE) < DATE '{TODAY}' AND o_orderkey % 9 <> 0 THEN '- Hạn nộp hồ sơ phải là ngày trong tương lai.' END, CASE WHEN o_orderkey % 9 = 0 THEN '- Chưa chọn hạn nộp hồ sơ.' END], lambda x: x IS NOT NULL), chr(10)) AS messages FROM orders
""")
def form_messages(t):
    n = F.col("id")
    low = F.when(n % 7 == 0, "abc").when(n % 11 == 0, "-5").otherwise((n % 100).cast("string"))
    form = t["job"].select("id", F.when(n % 5 == 0, " \n").otherwise("x").alias("title"), *(F.lit("y").alias(c) for c in ("address", "description", "requirements", "benefits")), low.alias("salary_min"), F.lit("50").alias("salary_max"), "deadline")
    return form.select("id", F.array_join(integrity.form_errors(F.lit(TODAY).cast("date")), "\n").alias("messages"))


@query(" SELECT id, CASE WHEN service_pack_id NOT BETWEEN 0 AND 9 THEN service_pack_id END AS service_pack_id FROM receipt", "receipt")
def packs_deleted(t):
    """Receipts of packs that go lose their reference."""
    gone = t["service_pack"].where("id < 10").select("id")
    return deletes.deleted({"service_pack": t["service_pack"], "receipt": t["receipt"]}, "service_pack", gone)["receipt"].select("id", "service_pack_id")


@query(" SELECT 'job_category' AS of_table, count(*) > 0 AS refused FROM job WHERE category_id IN (SELECT id FROM job_category) UNION ALL SELECT 'user', count(*) > 0 FROM employer_profile WHERE user_id IN (SELECT id FROM users)", "job", "job_category", "employer_profile", "user")
def deletes_refused(t):
    """Categories are protected by their jobs, and users restricted by their employer's profile."""
    out = []
    for table, key in (("job_category", "id"), ("user", "id")):
        try:
            deletes.deleted({n: t[n] for n in ("job_category", "job", "user", "employer_profile")}, table, t[table].select(key))
            out.append((table, False))
        except deletes.Refused:
            out.append((table, True))
    return t.spark.createDataFrame(out, "of_table string, refused boolean")


_OF_CANDIDATES = {"candidate_profile": "user_id", "application": "candidate_id", "bookmark_job": "user_id", "work_experience": "candidate_id", "education": "candidate_id", "language": "candidate_id", "appreciation": "candidate_id"}


@query(" SELECT 'user' AS of_table, count(*) AS n FROM users WHERE id NOT IN (SELECT user_id FROM candidate_profile WHERE experience_years >= 20)" + "".join(f" UNION ALL SELECT '{n}', count(*) FROM {n} WHERE {c} NOT IN (SELECT user_id FROM candidate_profile WHERE experience_years >= 20)" for n, c in _OF_CANDIDATES.items()), "user", *_OF_CANDIDATES)
def users_deleted(t):
    """Rows left in each table after deleting the users who are experienced candidates: profiles go with users, and what
    belongs to a profile with it."""
    names = ("user", "employer_profile", "receipt", *_OF_CANDIDATES)
    out = deletes.deleted({n: t[n] for n in names}, "user", t["candidate_profile"].where("experience_years >= 20").select("user_id"))
    return reduce(DataFrame.union, (out[n].agg(F.count("*").alias("n")).select(F.lit(n).alias("of_table"), "n") for n in ("user", *_OF_CANDIDATES)))


@query("+gone AS (SELECT user_id FROM employer_profile WHERE description = 'BUILDING'), gone_jobs AS (SELECT id FROM job WHERE posted_by_id IN (SELECT user_id FROM gone)) SELECT 'application' AS of_table, count(*) AS n FROM application WHERE job_id NOT IN (SELECT id FROM gone_jobs) UNION ALL SELECT 'bookmark_job', count(*) FROM bookmark_job WHERE job_id NOT IN (SELECT id FROM gone_jobs) UNION ALL SELECT 'employer_profile', count(*) FROM employer_profile WHERE user_id NOT IN (SELECT user_id FROM gone) UNION ALL SELECT 'job', count(*) FROM job WHERE id NOT IN (SELECT id FROM gone_jobs) UNION ALL SELECT 'receipt', count(related_job_id) FROM receipt WHERE related_job_id NOT IN (SELECT id FROM gone_jobs)", "application", "bookmark_job", "employer_profile", "job", "receipt")
def employers_deleted(t):
    """Rows left, and receipts that still refer to a job, after deleting the employers of one branch."""
    counted = {"application": "id", "bookmark_job": "id", "employer_profile": "user_id", "job": "id", "receipt": "related_job_id"}
    out = deletes.deleted({n: t[n] for n in counted}, "employer_profile", t["employer_profile"].where("description = 'BUILDING'").select("user_id"))
    return reduce(DataFrame.union, (out[n].agg(F.count(c).alias("n")).select(F.lit(n).alias("of_table"), "n") for n, c in counted.items()))


# --- changes -------------------------------------------------------------------------------------------------------------


@query(" SELECT id, active AND NOT (id = 70 AND posted_by_id = (SELECT posted_by_id FROM job WHERE id = 70)) AS active FROM job", "job")
def job_soft_deleted(t):
    owner = t["job"].where("id = 70").select("posted_by_id").first()[0]
    return mutations.soft_deleted(t["job"], owner, 70).select("id", "active")


@query(" SELECT CASE WHEN status = 'APPROVED' THEN user_id + 1000000 END AS id, company_name, true AS active FROM employer_profile WHERE status = 'APPROVED' AND user_id % 3 = 0", "employer_profile")
def jobs_posted(t):
    new = t["employer_profile"].where("user_id % 3 = 0").select((F.col("user_id") + 1_000_000).alias("id"), F.col("user_id").alias("posted_by_id"), F.lit("New").alias("title"))
    out = mutations.jobs_created(t["job"], new, t["employer_profile"], F.lit(TODAY).cast("timestamp_ntz"))
    return out.where("title = 'New'").select("id", "company_name", "active")


@query(" SELECT job.id, CASE WHEN id % 10 = 0 THEN 'Renamed' ELSE title END AS title, salary_min, (SELECT count(*) FROM (SELECT DISTINCT tag_id FROM job_tags WHERE job_id = job.id AND job.id % 10 <> 0)) + CASE WHEN id % 10 = 0 THEN 1 ELSE 0 END AS n_tags FROM job", "job", "job_tags")
def jobs_updated(t):
    some = t["job"].where("id % 10 = 0")
    changes = some.select("id", F.lit("Renamed").alias("title"), F.lit(None).cast("bigint").alias("salary_min"))
    jobs, bridge = mutations.job_updated(t["job"], t["job_tags"].distinct(), changes, some.select(F.col("id").alias("job_id"), F.lit(1).cast("bigint").alias("tag_id")))
    counted = bridge.groupBy("job_id").agg(F.count("*").alias("n"))
    return jobs.join(counted, F.col("id") == F.col("job_id"), "left").select("id", "title", "salary_min", F.coalesce("n", F.lit(0).cast("bigint")).alias("n_tags"))


@query(" SELECT id, CASE WHEN id % 10 = 0 THEN 'Renamed' ELSE title END AS title, salary_min, active FROM job WHERE id % 21 <> 0 UNION ALL SELECT id + 1000000000, 'Added', NULL, NULL FROM job WHERE id % 50 = 0", "job")
def jobs_upserted(t):
    """Jobs in a table of buckets: a tenth are renamed, others are added, and some deleted, in three versions."""
    path, key = f"{shared_folder(t.spark)}/jobs-{uuid.uuid4().hex}", F.col("id")
    upserts.create(t["job"].select("id", "title", "salary_min", "active"), path, buckets=16)
    upserts.upserted(t.spark, path, t["job"].where("id % 10 = 0").select("id", F.lit("Renamed").alias("title"), F.lit(None).cast("bigint").alias("salary_min")))
    upserts.upserted(t.spark, path, t["job"].where("id % 50 = 0").select((key + 1_000_000_000).alias("id"), F.lit("Added").alias("title")), insert=True)
    upserts.deleted(t.spark, path, t["job"].where("id % 21 = 0").select("id"))
    return upserts.read(t.spark, path)


@query(" SELECT user_id, CASE WHEN user_id % 5 = 0 THEN 'Moved' ELSE address END AS address, CASE WHEN user_id % 5 = 0 THEN 'New bio' ELSE bio END AS bio, CASE WHEN user_id % 5 = 0 THEN 'Spark' ELSE (SELECT coalesce(string_agg(name, ',' ORDER BY name), '') FROM (SELECT DISTINCT name FROM candidate_skills JOIN skill ON skill_id = skill.id WHERE candidate_id = user_id)) END AS skills FROM candidate_profile JOIN users ON user_id = users.id", "candidate_profile", "user", "candidate_skills", "skill")
def profiles_updated(t):
    some = t["candidate_profile"].where("user_id % 5 = 0")
    out = mutations.profile_updated({n: t[n] for n in ("candidate_profile", "user", "skill", "candidate_skills")}, some.select("user_id", F.lit("Moved").alias("address"), F.lit("New bio").alias("bio")), some.select("user_id", F.lit(" Spark ").alias("name")))
    skills = relations.through_bridge(out["candidate_skills"], "candidate_id", "skill_id", out["skill"], "name")
    rows = relations.with_children(out["candidate_profile"], "user_id", skills, "skills").join(out["user"].select("id", "bio"), F.col("user_id") == F.col("id"))
    return rows.select("user_id", "address", "bio", joined("skills").alias("skills"))


_MINE = f"SELECT id, candidate_id, status FROM application WHERE candidate_id = {ME}"


@query(f"+ mine AS ({_MINE}), chosen AS (SELECT (SELECT min(id) FROM mine WHERE status = 'SUBMITTED') AS a, (SELECT min(id) FROM mine WHERE status = 'REVIEWED') AS b, (SELECT max(id) FROM mine WHERE status = 'SUBMITTED') AS c) SELECT id, CASE WHEN id = a THEN 'changed' ELSE 'letter' END AS cover_letter FROM mine, chosen WHERE id <> c OR status <> 'SUBMITTED'", "application")
def own_applications_changed(t):
    """One that nobody has looked at is changed, a reviewed one isn't, and another one is withdrawn."""
    mine = search.owned_by(t["application"], "candidate_id", ME)
    a, b, c = mine.agg(F.min(F.when(F.col("status") == "SUBMITTED", F.col("id"))), F.min(F.when(F.col("status") == "REVIEWED", F.col("id"))), F.max(F.when(F.col("status") == "SUBMITTED", F.col("id")))).first()
    for chosen in (a, b):
        mine = mutations.application_changed(mine, ME, chosen, cover_letter=F.lit("changed"))
    return mutations.application_withdrawn(mutations.application_withdrawn(mine, ME, b), ME, c).select("id", "cover_letter")


@query("+ chosen AS (SELECT id, min(status) AS status, min(rating) AS rating, min(cover_letter) AS cover_letter FROM application GROUP BY 1) SELECT id, CASE WHEN id % 10 = 1 THEN 'REJECTED' ELSE status END AS status, CASE WHEN id % 10 = 1 THEN 5 ELSE rating END AS rating, cover_letter FROM chosen", "application")
def applications_reviewed(t):
    """Employers set status, note and rating; the letter isn't theirs."""
    rows = t["application"].groupBy("id").agg(*(F.min(c).alias(c) for c in ("status", "rating", "cover_letter")))
    reviews = rows.where("id % 10 = 1").select("id", F.lit("REJECTED").alias("status"), F.lit(5).alias("rating"), F.lit("not theirs").alias("cover_letter"))
    return mutations.application_reviewed(rows, reviews).select("id", "status", "rating", "cover_letter")


@query(f"+ marks AS (SELECT count(*) AS n, count(*) FILTER (WHERE user_id = {ME}) AS mine, count(*) FILTER (WHERE user_id = {ME} AND job_id = (SELECT min(job_id) FROM bookmark_job WHERE user_id = {ME})) AS one FROM bookmark_job) SELECT n - one AS without_one, n - mine AS without_all FROM marks", "bookmark_job")
def bookmarks_removed(t):
    job = t["bookmark_job"].where(F.col("user_id") == ME).agg(F.min("job_id")).first()[0]
    count = lambda df, name: df.agg(F.count("*").alias(name))
    return count(mutations.bookmark_removed(t["bookmark_job"], ME, job), "without_one").join(count(mutations.bookmark_removed(t["bookmark_job"], ME), "without_all"))


@query(f" SELECT user_id, CASE WHEN user_id <> {CANDIDATES + 6} THEN resume END AS resume, CASE WHEN user_id <> {CANDIDATES + 6} THEN resume_name END AS resume_name FROM candidate_profile", "candidate_profile")
def resume_removed(t):
    return mutations.resume_cleared(t["candidate_profile"], CANDIDATES + 6).select("user_id", "resume", "resume_name")


@query(" SELECT id, CASE WHEN NOT is_current THEN CAST(end_date AS VARCHAR) ELSE 'Present' END AS end_label FROM education", "education")
def education_without_open_ends(t):
    return mutations.education_normalised(t["education"]).select("id", dates.end_label(F.col("end_date")).alias("end_label"))


@query(" SELECT (SELECT count(*) FROM users) + (SELECT count(*) FROM customer WHERE c_custkey % 2 = 1) AS users, (SELECT count(*) FROM candidate_profile) + (SELECT count(*) FROM customer WHERE c_custkey % 2 = 1) AS profiles, (SELECT count(*) FROM users WHERE role = 'CANDIDATE') + (SELECT count(*) FROM customer WHERE c_custkey % 2 = 1) AS candidates", "user", "candidate_profile")
def candidates_registered(t):
    """Half of the newcomers bring an address that is taken."""
    new = t["user"].where("id < 1000000000").select((F.col("id") + 2_000_000_000).alias("id"), F.when(F.col("id") % 2 == 0, F.col("email")).otherwise(F.concat(F.lit("new."), "email")).alias("email"))
    users, own = mutations.registered(t["user"], t["candidate_profile"], new, new.select(F.col("id").alias("user_id")), "CANDIDATE")
    count = lambda df, name: df.agg(F.count("*").alias(name))
    return count(users, "users").join(count(own, "profiles")).join(count(users.where("role = 'CANDIDATE'"), "candidates"))


# --- payments ------------------------------------------------------------------------------------------------------------


@query(" SELECT s_suppkey AS id, p.price AS amount, 'PENDING' AS status, CASE WHEN s_suppkey % 2 = 0 THEN 'PAY_' || s_suppkey || '_928195200' END AS transaction_id FROM supplier JOIN service_pack p ON s_suppkey % 150 = p.id", "service_pack")
def receipts_requested(t):
    requests = t.raw("supplier").selectExpr("s_suppkey AS id", "s_suppkey AS user_id", "s_suppkey % 150 AS pack_id", "s_suppkey AS job_id", "CASE WHEN s_suppkey % 2 = 0 THEN 'VNPAY' ELSE 'CASH' END AS method")
    out = payments.receipts_created(t["receipt"].limit(0), requests, t["service_pack"], "PAY", F.lit(TODAY).cast("timestamp"))
    return out.select("id", "amount", "status", "transaction_id")


_SENT = """+ sent AS (SELECT event_id, 'REF_' || user_id AS ref, CASE WHEN event_type = 'purchase' THEN '00' ELSE '24' END AS code, (user_id % 7 + CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END) * 100 AS amount, event_type <> 'error' AS valid FROM events),
tried AS (SELECT *, CASE WHEN NOT valid THEN '97' WHEN r.id IS NULL THEN '01' WHEN sent.amount <> r.amount * 100 THEN '04' WHEN is_paid THEN '02' ELSE '00' END AS reply, r.id AS receipt FROM sent LEFT JOIN receipt r ON ref = transaction_id),
replied AS (SELECT *, CASE WHEN reply = '00' AND coalesce(max(CAST(reply = '00' AND code = '00' AS INT)) OVER (PARTITION BY ref ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 THEN '02' ELSE reply END AS answer FROM tried)"""


def _sent(t):
    return t.raw("events").select("event_id", F.concat(F.lit("REF_"), F.col("user_id")).alias("reference"), ((F.col("user_id") % 7 + F.when(F.col("event_id") % 5 == 0, 1).otherwise(0)) * 100).cast("string").alias("amount"), F.when(F.col("event_type") == "purchase", "00").otherwise("24").alias("code"), (F.col("event_type") != "error").alias("valid"))


@query(_SENT + " SELECT r.id, CASE WHEN s.paid IS NULL THEN 'PENDING' WHEN s.paid THEN 'SUCCESS' ELSE 'FAILED' END AS status, coalesce(s.paid, r.is_paid) AS is_paid FROM receipt r LEFT JOIN (SELECT receipt, bool_or(code = '00') AS paid FROM replied WHERE answer = '00' GROUP BY 1) s ON r.id = s.receipt", "receipt")
def receipts_after_payments(t):
    return payments.receipts_settled(t["receipt"], payments.replies(_sent(t), t["receipt"], None, F.col("event_id"))).select("id", "status", "is_paid")


@query(_SENT + " SELECT event_id, answer AS reply, CASE WHEN valid THEN receipt END AS receipt_id FROM replied", "receipt")
def replies_by_state(t):
    """Answers of the stream, whose events come in four parts, each to a run of its own that starts from the checkpoint."""
    folder = f"{shared_folder(t.spark)}/settlement-{uuid.uuid4().hex}"
    sent = _sent(t).join(t.raw("events").select("event_id", F.col("ts").cast("timestamp").alias("at")), "event_id").withColumnRenamed("event_id", "number")
    cuts = [int(c) for c in sent.approxQuantile("number", [0.25, 0.5, 0.75], 0.01)]
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        part = sent if low is None else sent.where(F.col("number") >= low)
        (part if high is None else part.where(F.col("number") < high)).write.mode("append").parquet(f"{folder}/in")
        stream = t.spark.readStream.schema(sent.schema).parquet(f"{folder}/in")
        settlement.settle(settlement.answers(stream, t["receipt"], fixed=True), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    found = t.spark.read.schema(settlement.ANSWER).parquet(f"{folder}/out")
    return found.select(F.col("number").alias("event_id"), "reply", F.when(F.col("reply") != payments.BAD_SIGNATURE, F.col("receipt_id")).alias("receipt_id"))


@query(_SENT + " SELECT id, is_featured OR id IN (SELECT related_job_id FROM replied WHERE answer = '00' AND code = '00' AND related_job_id IS NOT NULL AND service_pack_id IS NOT NULL) AS is_featured FROM job", "receipt", "job")
def jobs_after_payments(t):
    return payments.jobs_featured(t["job"], payments.replies(_sent(t), t["receipt"], None, F.col("event_id"))).select("id", "is_featured")


@query(_SENT + " SELECT r.id, CASE WHEN s.paid IS NULL THEN 'PENDING' WHEN s.paid THEN 'SUCCESS' ELSE 'FAILED' END AS status FROM receipt r LEFT JOIN (SELECT ref, bool_or(code = '00') AS paid FROM sent GROUP BY 1) s ON r.transaction_id = s.ref", "receipt")
def receipts_after_returns(t):
    """What browsers bring back, for a caller who trusts it."""
    return payments.receipts_returned(t["receipt"], _sent(t), trusted=True).select("id", "status")


def _blob(pad: int) -> str:
    """The key, padded and combined with a byte, as SQL for a blob."""
    return "'" + "".join(f"\\x{b ^ pad:02X}" for b in b"a key of tests".ljust(64, b"\0")) + "'::BLOB"


@query(f"SELECT c_custkey AS id, sha256({_blob(0x5C)} || unhex(sha256({_blob(0x36)} || c_name::BLOB))) AS signature FROM customer")
def signatures(t):
    return t.raw("customer").select(F.col("c_custkey").alias("id"), money.hmac_hex(F.col("c_name"), "a key of tests", "sha256").alias("signature"))


_QUERY = "'amount=' || c_custkey * 100 || '&code=00&note=a+%26%2Ab~&reference=' || replace(c_name, '#', '%23')"


@query(f"SELECT c_custkey AS id, {_QUERY} AS sent, c_custkey % 3 = 0 AS valid, CASE WHEN c_custkey % 3 <> 1 THEN sha256({_blob(0x5C)} || unhex(sha256({_blob(0x36)} || ({_QUERY})::BLOB))) END AS given FROM customer")
def signed_parameters(t):
    """Parameters of each customer: a third are signed, a third unsigned, and a third changed after they were signed."""
    key, text_of = F.col("c_custkey"), lambda c: c.cast("string")
    names = [F.lit("reference"), F.col("c_name"), F.lit("code"), F.lit("00"), F.lit("note"), F.lit("a &*b~"), F.lit("amount")]
    good = F.create_map(*names, text_of(key * 100))
    df = t.raw("customer").select("c_custkey", good.alias("good"), F.when(key % 3 == 2, F.create_map(*names, text_of(key * 100 + 1))).otherwise(good).alias("parameters"))
    given = F.when(key % 3 != 1, money.hmac_hex(money.query_string(F.col("good")), "a key of tests", "sha256"))
    signed = F.when(key % 3 == 1, F.col("parameters")).otherwise(F.map_concat("parameters", F.create_map(F.lit("secure_hash"), given)))
    return df.select(key.alias("id"), money.query_string(F.col("good")).alias("sent"), money.signature_valid(signed, "a key of tests", digest="sha256").alias("valid"), given.alias("given"))


# --- functions of a row ------------------------------------------------------------------------------------------------


@query(" SELECT 'job' AS of_table, id, title || ' - ' || company_name AS label FROM job UNION ALL SELECT 'user', id, first_name || ' (' || email || ')' FROM users UNION ALL SELECT 'candidate', id, CASE WHEN trim(first_name || ' ' || coalesce(last_name, '')) <> '' THEN trim(first_name || ' ' || coalesce(last_name, '')) ELSE username END FROM users UNION ALL SELECT 'education', id, level || ' - ' || institution FROM education UNION ALL SELECT 'language', id, language || CASE WHEN is_first_language THEN ' (Native)' ELSE '' END || ' - Oral: ' || oral_level || ', Written: ' || written_level FROM language UNION ALL SELECT 'service_pack', id, name || ' - ' || CAST(price AS BIGINT) || ' VND' FROM service_pack UNION ALL SELECT 'receipt', r.id, 'Receipt #' || r.id || ' - ' || u.username || ' - ' || CAST(amount AS BIGINT) FROM receipt r JOIN users u ON r.user_id = u.id UNION ALL SELECT 'bookmark_job', b.id, u.username || ' bookmarked ' || j.title FROM bookmark_job b JOIN users u ON b.user_id = u.id JOIN job j ON b.job_id = j.id", "job", "user", "education", "language", "service_pack", "receipt", "bookmark_job")
def row_labels(t):
    c = F.col
    named = t["user"].select(c("id").alias("of_user"), "username")
    made = {
        "job": (t["job"], text.job_label(c("title"), c("company_name"))),
        "user": (t["user"], text.user_label(c("first_name"), c("email"))),
        "candidate": (t["user"], text.candidate_label(c("first_name"), c("last_name"), c("username"))),
        "education": (t["education"], text.education_label(c("level"), c("institution"))),
        "language": (t["language"], text.language_label(c("language"), c("is_first_language"), c("oral_level"), c("written_level"))),
        "service_pack": (t["service_pack"], text.pack_label(c("name"), c("price"))),
        "receipt": (t["receipt"].join(named, c("user_id") == c("of_user")), text.receipt_label(c("id"), c("username"), c("amount"))),
        "bookmark_job": (t["bookmark_job"].join(named, c("user_id") == c("of_user")).join(t["job"].select(c("id").alias("of_job"), "title"), c("job_id") == c("of_job")), text.bookmark_label(c("username"), c("title"))),
    }
    return reduce(DataFrame.unionByName, (df.select(F.lit(name).alias("of_table"), "id", label.alias("label")) for name, (df, label) in made.items()))


@query(" SELECT user_id, status = 'APPROVED' AS is_verified, upper(left(status, 1)) || lower(substr(status, 2)) AS label, CASE status WHEN 'PENDING' THEN '#FFC107' WHEN 'APPROVED' THEN '#28A745' ELSE '#DC3545' END AS colour, CASE status WHEN 'APPROVED' THEN '#E8FAEF' WHEN 'REJECTED' THEN '#FFEBEB' ELSE '#FFF4E5' END AS applicant_colour FROM employer_profile", "employer_profile")
def employer_states(t):
    status = F.col("status")
    return t["employer_profile"].select("user_id", text.is_verified(status).alias("is_verified"), text.status_label(status).alias("label"), text.status_colour(status).alias("colour"), text.application_colour(F.lower(status)).alias("applicant_colour"))


@query("SELECT p_partkey AS id, array_to_string(list_filter(list_transform(string_split(list, ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS items, CASE WHEN p_size > 20 THEN p_size || '' ELSE p_size || ',' || p_partkey END AS ids, CASE WHEN p_size > 40 THEN '---' ELSE p_brand || ', ' || p_type END AS names FROM (SELECT *, p_name || ', ,' || p_brand || ' ,' AS list FROM part)")
def lists_parsed(t):
    size, key = F.col("p_size"), F.col("p_partkey")
    ids = F.concat(size.cast("string"), F.lit(" , x1,"), F.when(size > 20, F.lit("99999999999999999999")).otherwise(key.cast("string")))
    names = F.when(size <= 40, F.array("p_brand", "p_type"))
    return t.raw("part").select(key.alias("id"), F.array_join(text.parse_commas(F.concat("p_name", F.lit(", ,"), "p_brand", F.lit(" ,"))), "|").alias("items"), F.array_join(F.transform(text.parse_ids(ids), lambda x: x.cast("string")), ",").alias("ids"), text.compare_list(names).alias("names"))


@query("SELECT o_orderkey AS id, strftime(o_orderdate, '%b') AS month, CAST(month(o_orderdate) AS BIGINT) AS number, strftime(o_orderdate, '%Y-%m-01') AS first_day, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN strftime(o_orderdate, '%b') || ' ' || year(o_orderdate) END AS parts, CAST(epoch(o_orderdate) AS BIGINT) + 36000 AS expires, (o_orderdate >= TIMESTAMP '1998-05-25' AND o_orderdate < TIMESTAMP '1998-06-02') AS in_week FROM orders")
def months_and_moments(t):
    at = F.col("created_date")
    month = dates.month_name(F.month(at))
    given = F.when(F.col("id") % 3 == 0, text.PRESENT).when(F.col("id") % 3 == 1, F.date_format(at, "yyyy-MM-dd")).otherwise("no date")
    parts = dates.month_and_year(given)
    now = F.lit("1998-06-01").cast("date")
    recent = (at >= dates.recent_from("week", now).cast("timestamp_ntz")) & (at < F.date_add(now, 1).cast("timestamp_ntz"))
    return t["job"].select("id", month.alias("month"), dates.month_number(month).cast("bigint").alias("number"), dates.first_of_month(F.year(at), F.month(at)).cast("string").alias("first_day"), F.when(parts.isNotNull(), F.concat(parts["month"], F.lit(" "), parts["year"].cast("string"))).alias("parts"), F.unix_timestamp(dates.plus_seconds(at, 36_000).cast("timestamp")).alias("expires"), recent.alias("in_week"))


@query("SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN '10.0.0.' || user_id % 256 ELSE '127.0.0.1' END AS ip, 'image/png' AS kind, 'image' AS bare, round(floor(value / 5 + 0.5) * 5, 6)::DOUBLE AS steps FROM events WHERE value IS NOT NULL")
def client_details(t):
    forwarded = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("10.0.0."), F.col("user_id") % 256, F.lit(",10.1.1.1"))).otherwise("")
    return t.raw("events").where("value IS NOT NULL").select(F.col("event_id").alias("id"), text.client_ip(forwarded, F.lit("127.0.0.1")).alias("ip"), text.image_type(F.lit("file:///a/b.png")).alias("kind"), text.image_type(F.lit("file:///a/b")).alias("bare"), money.rounded(F.col("value"), 5).cast("double").alias("steps"))


# --- sources -------------------------------------------------------------------------------------------------------------


@query("SELECT CAST(r_regionkey AS VARCHAR) || ':' || r_name AS row, '{\"id\":' || r_regionkey || ',\"name\":\"' || r_name || '\",\"none\":null}' AS value FROM region")
def regions_as_json(t):
    rows = t.raw("region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"), F.lit(None).cast("string").alias("none"))
    parsed = F.from_json("value", "id bigint, name string")
    return tables.as_json(rows).select(F.concat(parsed["id"].cast("string"), F.lit(":"), parsed["name"]).alias("row"), "value")


@query("SELECT 'key' AS how, n_nationkey::BIGINT AS id FROM nation WHERE n_nationkey = 3 UNION ALL SELECT 'single', n_nationkey FROM nation WHERE n_name = 'NATION_7' UNION ALL SELECT 'first', min(n_nationkey) FROM nation WHERE n_regionkey = (SELECT min(n_regionkey) FROM nation)")
def rows_looked_up(t):
    nation = t.raw("nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("name"), "n_regionkey")
    found = {"key": tables.by_key(nation, 3), "single": tables.single(nation, "name", "NATION_7"), "first": tables.first_row(nation, "n_regionkey", "id"), "none": tables.none_of(nation)}
    return reduce(DataFrame.unionByName, (df.select(F.lit(how).alias("how"), "id") for how, df in found.items()))


@query("SELECT 'user' AS of_table, (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS n UNION ALL SELECT 'employer_profile', (SELECT count(*) FROM supplier) UNION ALL SELECT 'candidate_profile', (SELECT count(*) FROM customer) UNION ALL SELECT 'job', (SELECT count(*) FROM orders) UNION ALL SELECT 'job_tags', (SELECT 2 * count(*) FROM orders) UNION ALL SELECT 'applied twice', 0 UNION ALL SELECT 'candidates with three to five', (SELECT count(*) FROM customer)")
def generated_rows(t):
    """A seeded set of all tables of the size of the driver's: customers apply to orders of suppliers, to none of them twice."""
    made = generator.generate(t.spark, 5, *(t.raw(n).count() for n in ("supplier", "customer", "orders")))
    by_candidate = made["application"].groupBy("candidate_id").agg(F.count("*").alias("n"), F.count_distinct("job_id").alias("different"))
    counted = made | {"applied twice": by_candidate.where("different < n"), "candidates with three to five": by_candidate.where("n BETWEEN 3 AND 5")}
    return reduce(DataFrame.unionByName, (counted[n].agg(F.count("*").alias("n")).select(F.lit(n).alias("of_table"), "n") for n in ("user", "employer_profile", "candidate_profile", "job", "job_tags", "applied twice", "candidates with three to five")))


@query(" SELECT id AS customer FROM users WHERE username IN (SELECT 'Customer#' || lpad(CAST(user_id * 7 AS VARCHAR), 9, '0') FROM events)", "user")
def users_maybe_known(t):
    """Users that are among the names of events, the users filtered by a bitmap of these names before they are shuffled."""
    names = t.raw("events").select(F.concat(F.lit("Customer#"), F.lpad((F.col("user_id") * 7).cast("string"), 9, "0")).alias("name"))
    near = bitmaps.maybe_among(t["user"], "username", bitmaps.bitmaps(names, "name"))
    return near.join(names.hint("shuffle_hash"), F.col("username") == F.col("name"), "left_semi").select(F.col("id").alias("customer"))

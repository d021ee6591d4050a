"""The operators on the driver's tables, which stand in for those of the recruiting model, with SQL for each.

Orders are jobs, customers employers, suppliers candidates, lineitems applications, parts tags, nations locations, regions
categories, and events payment notifications.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake.functions import dates, money, text
from hirelake.operators import deletes, integrity, mutations, relations, search
from hirelake.plans import compare, payments, reports, rollup
from hirelake.sources.storage import shared_folder

YEAR = 1998
TODAY = "1999-06-01"
Tables = dict[str, DataFrame]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def model(spark: SparkSession, sf_dir: str) -> Tables:
    """Lazy views of the driver's tables under the model's names."""
    get = lambda n: table(spark, sf_dir, n)
    kind = F.when(F.col("o_orderstatus") == "O", "REMOTE").when(F.col("o_orderstatus") == "F", "FULL_TIME").otherwise("PART_TIME")
    customer = get("customer").select("c_custkey", F.col("c_name").alias("company_name"), F.col("c_nationkey").alias("location_id"))
    nation = get("nation").select("n_nationkey", F.col("n_regionkey").alias("category_id"))
    jobs = get("orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("posted_by_id"), F.col("o_orderpriority").alias("title"), kind.alias("employment_type"),
        F.col("o_orderpriority").alias("experience_level"), F.floor("o_totalprice").cast("bigint").alias("salary_min"), (F.floor("o_totalprice").cast("bigint") + 50_000).alias("salary_max"),
        F.floor(F.col("o_totalprice") / 1000).cast("bigint").alias("views"), F.col("o_orderdate").alias("created_date"), F.col("o_orderdate").cast("date").alias("deadline"), (F.col("o_orderstatus") != "P").alias("active"),
    )
    return {
        "job": jobs,
        "job_full": jobs.join(customer, F.col("posted_by_id") == F.col("c_custkey")).join(nation, F.col("location_id") == F.col("n_nationkey")).drop("c_custkey", "n_nationkey"),
        "employer": get("customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("company_name"), F.col("c_mktsegment").alias("status"), F.col("c_nationkey").alias("location_id"), F.col("c_acctbal").alias("balance")),
        "candidate": get("supplier").select(F.col("s_suppkey").alias("user_id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("location_id")),
        "application": get("lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_suppkey").alias("candidate_id"), F.col("l_partkey").alias("tag_id"), F.col("l_linenumber").alias("number"), F.col("l_shipdate").alias("created_date"), F.col("l_returnflag").alias("status")),
        "location": get("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")),
        "category": get("region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name")),
        "tag": get("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")),
    }


JOBS = """jobs AS (
  SELECT o_orderkey AS id, o_custkey AS posted_by_id, o_orderpriority AS title, CASE o_orderstatus WHEN 'O' THEN 'REMOTE' WHEN 'F' THEN 'FULL_TIME' ELSE 'PART_TIME' END AS employment_type,
         CAST(floor(o_totalprice) AS BIGINT) AS salary_min, CAST(floor(o_totalprice) AS BIGINT) + 50000 AS salary_max, CAST(floor(o_totalprice / 1000) AS BIGINT) AS views,
         o_orderdate AS created_date, CAST(o_orderdate AS DATE) AS deadline, o_orderstatus <> 'P' AS active, c_name AS company_name, c_nationkey AS location_id, n_regionkey AS category_id, n_name AS location_name, r_name AS category_name
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""


def query(sql: str | None = None):
    def register(f: Callable[[Tables], DataFrame]):
        name = f.__name__
        QUERIES[name] = lambda spark, sf_dir: f(model(spark, sf_dir) | {"_": (spark, sf_dir)})
        if sql:
            ORACLES[name] = sql.replace("{JOBS}", JOBS)
        return f

    return register


def raw(t: Tables, name: str) -> DataFrame:
    return table(*t["_"], name)


# --- reports -----------------------------------------------------------------------------------------------------------

_REPORT = """
WITH {JOBS}, owned AS (
  SELECT posted_by_id, CAST(%(part)s(l_shipdate) AS BIGINT) AS bucket, count(*) AS applications
  FROM lineitem JOIN jobs ON l_orderkey = id WHERE l_shipdate >= TIMESTAMP '%(low)s-01-01' AND l_shipdate < TIMESTAMP '%(high)s-01-01' GROUP BY 1, 2
), spine AS (
  SELECT posted_by_id, views, unnest(range(%(first)s, %(end)s)) AS bucket FROM (SELECT posted_by_id, CAST(sum(views) AS BIGINT) AS views FROM jobs GROUP BY 1)
)
SELECT posted_by_id, bucket, %(label)s AS label, coalesce(applications, 0) AS applications,
       CASE WHEN coalesce(applications, 0) = 0 OR coalesce(views, 0) = 0 THEN 0.0::DOUBLE ELSE floor(applications * 1000.0::DOUBLE / views + 0.5::DOUBLE) / 10 END AS efficiency
FROM spine LEFT JOIN owned USING (posted_by_id, bucket)
"""


def _report_sql(**values) -> str:
    return _REPORT % values


@query(_report_sql(part="month", low=YEAR, high=YEAR + 1, first=1, end=13, label="'T' || bucket"))
def report_by_month(t):
    return reports.employer_report(t["application"], t["job"], "month", YEAR)


@query(_report_sql(part="quarter", low=YEAR, high=YEAR + 1, first=1, end=5, label="'Quý ' || bucket"))
def report_by_quarter(t):
    return reports.employer_report(t["application"], t["job"], "quarter", YEAR)


@query(_report_sql(part="year", low=YEAR - 2, high=YEAR + 3, first=YEAR - 2, end=YEAR + 3, label="CAST(bucket AS VARCHAR)"))
def report_by_year(t):
    return reports.employer_report(t["application"], t["job"], "year", YEAR)


@query(" UNION ALL ".join(f"SELECT '{p}' AS period, * FROM ({ORACLES[f'report_by_{p}']})" for p in ("year", "quarter", "month")))
def reports_from_rollup(t):
    """All three reports from stored counts: those of all but the last year of applications, and then of the rest as a day's."""
    path = f"{shared_folder(t['job'].sparkSession)}/rollup-{uuid.uuid4().hex}"
    at, cut = F.col("created_date"), F.lit("1998-01-01").cast("timestamp_ntz")
    for day, some in ((dt.date(1998, 1, 1), at < cut), (dt.date(1998, 1, 2), at >= cut)):
        rollup.store_day(path, day, t["application"].where(some), t["job_full"])
    return rollup.reports(rollup.stored(t["job"].sparkSession, path), t["job"], YEAR)


@query("WITH {JOBS} SELECT count(*) FILTER (WHERE employment_type = 'REMOTE') AS remote_count, count(*) FILTER (WHERE employment_type = 'FULL_TIME') AS full_time_count, count(*) FILTER (WHERE employment_type = 'PART_TIME') AS part_time_count FROM jobs WHERE active AND deadline >= DATE '1999-06-01'")
def job_type_counts(t):
    return reports.type_counts(search.public(t["job"], F.lit(TODAY).cast("date")))


@query("SELECT (SELECT count(*) FROM orders) AS jobs, (SELECT count(*) FROM supplier) AS candidates, (SELECT count(*) FROM customer) AS employers, (SELECT count(*) FROM lineitem) AS applications, (SELECT count(*) FROM orders) * 500000 AS synthetic_revenue")
def dashboard_totals(t):
    return reports.totals(t["job"], t["candidate"], t["employer"], t["application"])


@query(f"SELECT strftime(o_orderdate, '%Y-%m-01') AS month, count(*) AS n, 'T' || lpad(CAST(month(o_orderdate) AS VARCHAR), 2, '0') AS label FROM orders WHERE o_orderdate >= TIMESTAMP '{YEAR}-01-01' AND o_orderdate < TIMESTAMP '{YEAR + 1}-01-01' GROUP BY 1, 3")
def dashboard_month_chart(t):
    return reports.month_chart(t["job"], YEAR).withColumn("month", F.col("month").cast("string"))


@query("SELECT o_orderkey AS id, o_custkey AS posted_by_id, c_name AS company FROM (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 5) JOIN customer ON o_custkey = c_custkey")
def dashboard_recent_jobs(t):
    return reports.recent(t["job"], t["employer"]).select("id", "posted_by_id", "company")


@query("WITH {JOBS} SELECT r_regionkey AS id, r_name AS name, count(jobs.id) AS n FROM region LEFT JOIN jobs ON category_id = r_regionkey GROUP BY 1, 2")
def category_counts(t):
    return reports.category_counts(t["category"], t["job_full"])


@query("SELECT 'all' AS id, 'Tất cả' AS name UNION ALL SELECT CAST(r_regionkey AS VARCHAR), r_name FROM region")
def category_choices(t):
    return reports.with_all(t["category"])


# --- search ------------------------------------------------------------------------------------------------------------

_SPEC = search.FilterSpec(search="urgent", location="a", min_salary=20_000, max_salary=400_000, created_after="1996-01-01", created_before="2000-12-31", employment_type="REMOTE", collation=None)
_SEARCH = "FROM jobs WHERE active AND deadline >= DATE '1997-06-01' AND contains(lower(location_name), 'a') AND (contains(lower(title), 'urgent') OR contains(lower(company_name), 'urgent')) AND salary_min >= 20000 AND salary_max <= 400000 AND created_date >= TIMESTAMP '1996-01-01' AND created_date <= TIMESTAMP '2000-12-31' AND employment_type = 'REMOTE'"


@query("WITH {JOBS} SELECT id, location_id, location_name, salary_min, salary_max " + _SEARCH)
def public_job_search(t):
    found, _ = search.search_jobs(t["job_full"], t["location"], _SPEC, F.lit("1997-06-01").cast("date"))
    return found.select("id", "location_id", "location_name", "salary_min", "salary_max")


@query("WITH {JOBS} SELECT id, salary_max, created_date " + _SEARCH + " ORDER BY salary_max DESC, created_date, id LIMIT 20 OFFSET 40")
def public_job_page(t):
    found, keys = search.search_jobs(t["job_full"], t["location"], _SPEC, F.lit("1997-06-01").cast("date"), "-salary_max,password,created_date")
    return search.page(found, keys, 3).rows.select("id", "salary_max", "created_date")


@query("SELECT p_partkey AS id, p_name AS name FROM part ORDER BY p_name, p_partkey LIMIT 250 OFFSET 250")
def skill_page(t):
    return search.page(t["tag"], search.ordering("name", ("name",)), 2, 250, most=None).rows


@query("SELECT p_partkey AS id, p_name AS name FROM part WHERE contains(lower(p_name), 'r') AND contains(lower(p_name), 'e')")
def skill_search(t):
    return t["tag"].where(search.matches_terms([F.col("name")], "R, e", None))


@query("WITH {JOBS} SELECT id, company_name FROM jobs WHERE employment_type = 'REMOTE' AND title = '1-URGENT' AND contains(lower(company_name), '7')")
def job_facets(t):
    found = search.facets(t["job_full"], employment_type="REMOTE", title="1-URGENT", active=None)
    return found.where(search.any_contains([F.col("company_name")], "7", None)).select("id", "company_name")


# --- joins and projections -----------------------------------------------------------------------------------------------

_BAND = "CASE WHEN salary_min <> 0 AND salary_max <> 0 THEN printf('%.0fM', salary_min / 1e6) || ' - ' || printf('%.0fM', salary_max / 1e6) WHEN salary_min <> 0 THEN printf('%.0fM', salary_min / 1e6) WHEN salary_max <> 0 THEN printf('%.0fM', salary_max / 1e6) ELSE 'Thỏa thuận' END"


@query("WITH {JOBS} SELECT id, company_name, category_name, location_name, replace(employment_type, '_', ' ') AS type_label, " + _BAND + " AS salary, strftime(deadline, '%d/%m/%Y') AS deadline_label FROM jobs")
def job_cards(t):
    rows = relations.job_with_dimensions(t["job_full"], t["category"], t["location"])
    return rows.select("id", "company_name", F.col("category.name").alias("category_name"), F.col("location.name").alias("location_name"), text.enum_label(F.col("employment_type")).alias("type_label"), money.salary_band(F.col("salary_min"), F.col("salary_max")).alias("salary"), dates.date_label(F.col("deadline")).alias("deadline_label"))


@query("WITH tags AS (SELECT DISTINCT l_orderkey, p_partkey, p_name FROM lineitem JOIN part ON l_partkey = p_partkey) SELECT o_orderkey AS id, coalesce(string_agg(p_name, ', ' ORDER BY p_partkey), '') AS tags, count(p_partkey) AS n_tags FROM orders LEFT JOIN tags ON o_orderkey = l_orderkey GROUP BY 1")
def job_tags(t):
    found = relations.through_bridge(t["application"].select("job_id", "tag_id"), "job_id", "tag_id", t["tag"], "id", "name")
    rows = relations.with_children(t["job"].select("id"), "id", found, "tags")
    return rows.select("id", F.array_join(F.col("tags.name"), ", ").alias("tags"), F.size("tags").cast("bigint").alias("n_tags"))


@query("SELECT l_orderkey AS job_id, l_linenumber AS number, o_custkey AS posted_by_id, s_name AS candidate, n_name AS candidate_location, l_returnflag AS status, strftime(l_shipdate, '%Y-%m-%d') AS applied FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey")
def employer_applications(t):
    job = t["job"].select(F.col("id").alias("job_id"), "posted_by_id")
    at = t["location"].withColumnRenamed("name", "candidate_location")
    candidate = t["candidate"].withColumnRenamed("name", "candidate").join(at, F.col("location_id") == F.col("id")).select(F.col("user_id").alias("candidate_id"), "candidate", "candidate_location")
    return t["application"].join(job, "job_id").join(candidate, "candidate_id").select("job_id", "number", "posted_by_id", "candidate", "candidate_location", "status", F.col("created_date").cast("date").cast("string").alias("applied"))


@query("WITH {JOBS} SELECT l_suppkey AS candidate_id, l_orderkey AS job_id, l_linenumber AS number, company_name, category_name, location_name, l_returnflag AS status FROM lineitem JOIN jobs ON l_orderkey = id")
def candidate_applications(t):
    jobs = relations.job_with_dimensions(t["job_full"], t["category"], t["location"]).select(F.col("id").alias("job_id"), "company_name", F.col("category.name").alias("category_name"), F.col("location.name").alias("location_name"))
    return t["application"].join(jobs, "job_id").select("candidate_id", "job_id", "number", "company_name", "category_name", "location_name", "status")


@query("SELECT o_orderkey AS id, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS applied FROM orders")
def already_applied(t):
    return relations.flagged(t["job"].select("id"), "id", t["application"].where(F.col("status") == "R"), "job_id", "applied")


@query("SELECT c_custkey AS user_id, c_name AS company_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def employers_with_jobs(t):
    return relations.existing(t["employer"], "user_id", t["job"], "posted_by_id").select("user_id", "company_name")


@query("SELECT o_orderkey AS id FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def jobs_without_applications(t):
    return relations.missing(t["job"].select("id"), "id", t["application"], "job_id")


@query("SELECT l_orderkey AS job_id, l_suppkey AS candidate_id, l_linenumber AS number FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_suppkey DESC, l_linenumber DESC) AS k FROM lineitem) WHERE k = 1")
def latest_application(t):
    return relations.first_by(t["application"], ["job_id"], F.struct("created_date", "candidate_id", "number"), "candidate_id", "number")


@query("SELECT c_custkey AS user_id, c_name AS company_name, n_name AS location, s.n AS verifiers FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) s ON s_nationkey = c_nationkey")
def employers_and_verifiers(t):
    counted = t["candidate"].groupBy(F.col("location_id").alias("at")).agg(F.count("*").alias("n"))
    rows = relations.with_struct(t["employer"], "location_id", t["location"], "location", "id", "name")
    rows = relations.with_struct(rows, "location_id", counted, "verifier", "n", key="at", how="left")
    return rows.select("user_id", "company_name", F.col("location.name").alias("location"), F.col("verifier.n").alias("verifiers"))


@query("SELECT conv_id, string_agg(coalesce(role, ''), '>' ORDER BY turn, role, text) AS roles, count(*) AS turns, count(*) > 2 AS has_more FROM conversations GROUP BY 1")
def nested_turns(t):
    found = relations.children(raw(t, "conversations"), "conv_id", "turn", "role", "text", order=("turn", "role", "text"))
    shown = text.first_and_more(F.col("items"), 2)
    return found.select(F.col("parent").alias("conv_id"), F.array_join(F.transform("items", lambda x: F.coalesce(x["role"], F.lit(""))), ">").alias("roles"), F.size("items").cast("bigint").alias("turns"), (shown["more"] > 0).alias("has_more"))


_PROFILE = """
WITH a AS (SELECT l_suppkey AS id, count(*) AS n_applications, count(DISTINCT l_orderkey) AS n_jobs FROM lineitem GROUP BY 1),
     b AS (SELECT id, string_agg(flag, ',' ORDER BY flag) AS states FROM (SELECT DISTINCT l_suppkey AS id, l_returnflag AS flag FROM lineitem) GROUP BY 1)
SELECT s_suppkey AS user_id, s_name AS name, n_name AS location, coalesce(n_applications, 0) AS n_applications, coalesce(n_jobs, 0) AS n_jobs, coalesce(states, '') AS states
FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN a ON a.id = s_suppkey LEFT JOIN b ON b.id = s_suppkey
"""


@query(_PROFILE)
def candidate_profiles(t):
    counted = t["application"].groupBy("candidate_id").agg(F.count("*").alias("n_applications"), F.count_distinct("job_id").alias("n_jobs"))
    states = relations.children(t["application"].select("candidate_id", "status").distinct(), "candidate_id", "status")
    rows = relations.with_children(relations.with_struct(t["candidate"], "location_id", t["location"], "location", "id", "name"), "user_id", states, "states")
    rows = rows.join(counted, F.col("user_id") == F.col("candidate_id"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return rows.select("user_id", "name", F.col("location.name").alias("location"), zero("n_applications"), zero("n_jobs"), F.array_join(F.col("states.status"), ",").alias("states"))


@query("WITH {JOBS} SELECT posted_by_id, count(*) AS n_jobs, count(DISTINCT title) = 1 AS same_category FROM jobs WHERE active GROUP BY 1")
def compared_by_owner(t):
    return compare.same_category(t["job"].where("active").withColumn("category_id", F.col("title")), "posted_by_id")


# --- rules -------------------------------------------------------------------------------------------------------------


@query("SELECT l_orderkey AS job_id, l_suppkey AS candidate_id, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def repeated_applications(t):
    return integrity.repeated(t["application"], ("job_id", "candidate_id"))


@query("SELECT o_orderkey AS id FROM orders WHERE NOT (floor(o_totalprice) BETWEEN 1000 AND 300000) OR NOT (o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM'))")
def broken_rules(t):
    rule = F.col("salary_min").between(1_000, 300_000) & F.col("title").isin("1-URGENT", "2-HIGH", "3-MEDIUM")
    return integrity.breaking(t["job"], rule).select("id")


@query("SELECT l_orderkey AS job_id, l_linenumber AS number, l_suppkey AS candidate_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P' OR CAST(o_orderdate AS DATE) < DATE '1999-06-01'")
def closed_applications(t):
    return integrity.closed_applications(t["application"], t["job"], F.lit(TODAY).cast("date")).select("job_id", "number", "candidate_id")


@query("SELECT n_nationkey AS id FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 9000)")
def orphan_locations(t):
    rich = t["employer"].where((F.col("status") == "BUILDING") & (F.col("balance") > 9000))
    return integrity.orphans(t["location"], "id", rich, "location_id").select("id")


@query("SELECT o_orderkey AS id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def unapproved_posts(t):
    employers = t["employer"].withColumn("status", F.when(F.col("status") == "MACHINERY", "APPROVED").otherwise("PENDING"))
    return integrity.unapproved_posts(t["job"], employers).select("id")


@query("SELECT (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')) AS jobs, (SELECT count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'))) AS applications, (SELECT count(*) FROM customer WHERE c_mktsegment <> 'BUILDING') AS employers")
def cascaded_delete(t):
    tables = {"employer_profile": t["employer"], "job": t["job"], "application": t["application"]}
    out = deletes.deleted(tables, "employer_profile", t["employer"].where(F.col("status") == "BUILDING").select("user_id"))
    n = lambda df, c: df.agg(F.count("*").alias(c))
    return n(out["job"], "jobs").join(n(out["application"], "applications")).join(n(out["employer_profile"], "employers"))


# --- changes -------------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey AS id, o_orderstatus <> 'P' AND NOT o_orderpriority = '5-LOW' AS active FROM orders")
def jobs_deactivated(t):
    return mutations.overlaid(t["job"], F.col("title") == "5-LOW", active=F.lit(False)).select("id", "active")


@query("SELECT c_custkey AS user_id, CASE WHEN c_acctbal > 5000 THEN 'APPROVED' ELSE c_mktsegment END AS status, CASE WHEN c_acctbal > 5000 THEN 1::BIGINT ELSE 0::BIGINT END AS verified_by FROM customer")
def employers_approved(t):
    rows = t["employer"].withColumns({"verified_at": F.lit(None).cast("timestamp"), "verified_by": F.lit(0).cast("bigint"), "reject_reason": F.lit("")})
    out = mutations.employers_judged(rows, t["employer"].where("balance > 5000").select("user_id"), True, 1, F.lit(TODAY).cast("timestamp"))
    return out.select("user_id", "status", "verified_by")


@query("SELECT p_partkey AS id, CASE WHEN p_size > 25 THEN upper(p_brand) ELSE p_name END AS name FROM part")
def names_merged(t):
    changes = raw(t, "part").where("p_size > 25").select(F.col("p_partkey").alias("id"), F.upper("p_brand").alias("name"))
    return mutations.merged(t["tag"], changes)


@query("SELECT DISTINCT job_id, tag_id FROM (SELECT l_orderkey AS job_id, l_partkey AS tag_id FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') UNION ALL SELECT o_orderkey, o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def tags_replaced(t):
    bridge = t["application"].select("job_id", "tag_id").distinct()
    return mutations.links_replaced(bridge, "job_id", "tag_id", t["job"].where("title = '1-URGENT'").select(F.col("id").alias("job_id"), F.col("posted_by_id").alias("tag_id")))


@query("SELECT name FROM (SELECT p_name AS name FROM part UNION SELECT trim(s_name) FROM supplier)")
def skills_created(t):
    return mutations.got_or_created(t["tag"], t["candidate"].select("name")).select("name").distinct()


@query("SELECT job_id, candidate_id FROM (SELECT DISTINCT l_orderkey AS job_id, l_suppkey AS candidate_id FROM lineitem WHERE l_returnflag = 'A' UNION SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' AND o_orderstatus <> 'P')")
def bookmarks_added(t):
    pairs = lambda flag: t["application"].where(F.col("status") == flag).select(F.col("candidate_id").alias("user_id"), "job_id").distinct()
    return mutations.bookmarked(pairs("A"), pairs("R"), t["job"]).select("job_id", F.col("user_id").alias("candidate_id"))


@query("SELECT count(*) AS n FROM lineitem WHERE l_returnflag = 'N'")
def applications_affected(t):
    return mutations.affected(t["application"], F.col("status") == "N")


# --- payments ------------------------------------------------------------------------------------------------------------

_PAID = """
WITH r AS (SELECT c_custkey AS id, 'REF_' || c_custkey AS ref, CAST(c_custkey % 7 AS DECIMAL(12, 0)) AS amount, c_mktsegment = 'BUILDING' AS is_paid FROM customer),
n AS (SELECT event_id, event_type, 'REF_' || user_id AS ref, (user_id % 7 + CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END) * 100 AS sent FROM events),
tried AS (
  SELECT event_id, ref, event_type = 'purchase' AS pays, CASE WHEN event_type = 'error' THEN '97' WHEN r.id IS NULL THEN '01' WHEN sent <> amount * 100 THEN '04' WHEN is_paid THEN '02' ELSE '00' END AS reply, r.id AS receipt_id
  FROM n LEFT JOIN r USING (ref)
), paid AS (SELECT ref, min(event_id) AS first FROM tried WHERE reply = '00' AND pays GROUP BY 1)
SELECT event_id, CASE WHEN reply = '00' AND event_id > first THEN '02' ELSE reply END AS reply, receipt_id FROM tried LEFT JOIN paid USING (ref)
"""


@query(_PAID)
def payment_replies(t):
    receipts = t["employer"].select(F.col("user_id").alias("id"), F.concat(F.lit("REF_"), F.col("user_id")).alias("transaction_id"), (F.col("user_id") % 7).cast("decimal(12,0)").alias("amount"), (F.col("status") == "BUILDING").alias("is_paid"), F.col("user_id").alias("related_job_id"), F.lit(1).alias("service_pack_id"))
    sent = raw(t, "events").select("event_id", F.concat(F.lit("REF_"), F.col("user_id")).alias("reference"), ((F.col("user_id") % 7 + F.when(F.col("event_id") % 5 == 0, 1).otherwise(0)) * 100).cast("string").alias("amount"), F.when(F.col("event_type") == "purchase", "00").otherwise("24").alias("code"), (F.col("event_type") != "error").alias("valid"))
    return payments.replies(sent, receipts, None, F.col("event_id")).select("event_id", "reply", "receipt_id")


# --- functions of a row ------------------------------------------------------------------------------------------------


@query(r"""
WITH t AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?i)<br\s*/?>', chr(10), 'g'), '(?i)</p>', chr(10) || chr(10), 'g'), '(?i)</li>', chr(10), 'g'), '<[^>]+>', '', 'g') AS x, html FROM pages)
SELECT page_id, regexp_replace(regexp_replace(replace(replace(replace(replace(replace(x, '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '^\s+', ''), '\s+$', '') AS content, coalesce(regexp_matches(html, '(?i)<[a-z](.|\n)*>'), false) AS is_html FROM t
""")
def pages_as_text(t):
    return raw(t, "pages").select("page_id", text.strip_html(F.col("html")).alias("content"), text.looks_like_html(F.col("html")).alias("is_html"))


@query(r"""
SELECT doc_id, len(items)::BIGINT AS n_items, coalesce(items[1], '') AS first_item, coalesce(items[len(items)], '') AS last_item FROM (
  SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), CASE WHEN contains(coalesce(text, ''), chr(10)) THEN chr(10) ELSE '.' END), lambda x: regexp_replace(regexp_replace(x, '^\s+', ''), '\s+$', '')), lambda x: x <> '') AS items FROM documents)
""")
def document_items(t):
    rows, items = raw(t, "documents").select("doc_id", text.parse_lines(F.col("text")).alias("items")), F.col("items")
    one = lambda k: F.coalesce(F.try_element_at(items, F.lit(k)), F.lit(""))
    return rows.select("doc_id", F.size(items).cast("bigint").alias("n_items"), one(1).alias("first_item"), one(-1).alias("last_item"))


@query(r"""
SELECT page_id, coalesce(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page, regexp_extract(url, '[^/]*$') AS file, regexp_matches(lower(url), '\.(pdf|doc|docx)$') AS is_text FROM pages WHERE url IS NOT NULL
""")
def page_links(t):
    url = F.col("url")
    return raw(t, "pages").where(url.isNotNull()).select("page_id", F.coalesce(text.link_parameter(url, "page"), F.lit("")).alias("page"), text.file_name(url).alias("file"), text.file_has_type(url).alias("is_text"))


@query(r"""
SELECT p_partkey AS id, p_name AS name, CASE WHEN len(w) > 1 THEN w[len(w)] ELSE '' END AS first_name, CASE WHEN len(w) > 1 THEN array_to_string(w[1:len(w) - 1], ' ') ELSE w[1] END AS last_name,
       upper(left(w[1], 1) || CASE WHEN len(w) > 1 THEN left(w[len(w)], 1) ELSE '' END) AS initials, p_brand || ' - ' || p_type AS degree, p_brand AS level, p_type AS field
FROM (SELECT *, string_split(trim(p_name), ' ') AS w FROM part)
""")
def name_parts(t):
    part = raw(t, "part")
    names, degree = text.split_full_name(F.col("p_name")), text.degree_label(F.col("p_brand"), F.col("p_type"))
    return part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), names["first_name"].alias("first_name"), names["last_name"].alias("last_name"), text.initials(F.col("p_name")).alias("initials"), degree.alias("degree"), text.split_degree(degree)["level"].alias("level"), text.split_degree(degree)["field"].alias("field"))


@query("""
SELECT o_orderkey AS id, CASE WHEN d < 0 THEN 'Hết hạn' WHEN d <= 3 THEN 'Sắp hết hạn' ELSE 'Đang tuyển' END AS state, 'T' || lpad(CAST(month(o_orderdate) AS VARCHAR), 2, '0') AS month_label,
       strftime(o_orderdate, '%d/%m/%Y') AS day_label, CAST(day(last_day(CAST(o_orderdate AS DATE))) AS INTEGER) AS days,
       CASE WHEN s < 60 THEN 'Vừa xong' WHEN s < 3600 THEN (s // 60) || ' phút trước' WHEN s < 86400 THEN (s // 3600) || ' giờ trước' WHEN s < 604800 THEN (s // 86400) || ' ngày trước' WHEN s < 2419200 THEN (s // 604800) || ' tuần trước' ELSE day(o_orderdate) || '/' || month(o_orderdate) || '/' || year(o_orderdate) END AS elapsed
FROM (SELECT *, date_diff('day', DATE '1999-06-01', CAST(o_orderdate AS DATE)) AS d, CAST(epoch(TIMESTAMP '1999-06-01') - epoch(o_orderdate) AS BIGINT) AS s FROM orders)
""")
def date_labels(t):
    at, today = F.col("created_date"), F.lit(TODAY).cast("timestamp_ntz")
    return t["job"].select("id", dates.job_state(F.col("deadline"), F.lit(TODAY).cast("date")).alias("state"), dates.month_label(at).alias("month_label"), dates.date_label(at).alias("day_label"), F.size(dates.days_in_month(F.year(at), F.month(at))).alias("days"), dates.elapsed_label(at, today).alias("elapsed"))


@query(r"""
SELECT o_orderkey AS id, CASE WHEN v = 0 THEN 'Thỏa thuận' ELSE dots END AS amount, CASE WHEN v = 0 THEN '0' WHEN v >= 1000000 THEN regexp_replace(printf('%.1f', v / 1e6), '\.0$', '') || ' Triệu' ELSE dots END AS short_amount, dots || ' đ' AS local_amount, v * 100 AS minor, CAST(floor(v / 1024 + 0.5) AS BIGINT) AS kb, greatest(1000, least(v, 5000000)) AS clamped
FROM (SELECT *, replace(format('{:,}', v), ',', '.') AS dots FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) * (o_orderkey % 40) AS v FROM orders))
""")
def amounts(t):
    v = (F.col("salary_min") * (F.col("id") % 40)).alias("v")
    rows = t["job"].select("id", v)
    v = F.col("v")
    return rows.select("id", money.currency(v).alias("amount"), money.currency_short(v).alias("short_amount"), money.currency_local(v).alias("local_amount"), money.minor_units(v).cast("bigint").alias("minor"), money.kilobytes(v).alias("kb"), money.clamped(v, 1000, 5_000_000).alias("clamped"))


@query("""
SELECT c_custkey AS id, CASE WHEN a <> '' AND b <> '' THEN b || ' ' || a WHEN a <> '' THEN a WHEN b <> '' THEN b ELSE c_name END AS full_name, CASE WHEN a <> '' THEN a ELSE c_name END AS display_name,
       'https://ui-avatars.com/api/?name=' || replace(url_encode(CASE WHEN trim(b || ' ' || a) <> '' THEN trim(b || ' ' || a) ELSE c_name END), '%2F', '/') || '&background=random&color=fff&size=512&font-size=0.5' AS avatar
FROM (SELECT *, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS a, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'Bé/' || c_nationkey END AS b FROM customer)
""")
def user_names(t):
    key, name = F.col("user_id"), F.col("company_name")
    first = F.when(key % 3 == 0, "").otherwise(F.col("status"))
    last = F.when(key % 4 == 0, "").otherwise(F.concat(F.lit("Bé/"), F.col("location_id")))
    return t["employer"].select(key.alias("id"), text.full_name(first, last, name).alias("full_name"), text.display_name(first, name).alias("display_name"), text.default_avatar(first, last, name).alias("avatar"))


@query("""
SELECT l_orderkey AS job_id, array_to_string(list_sort(CASE WHEN list_contains(s, 'R') THEN list_filter(s, lambda x: x <> 'R') ELSE list_append(s, 'R') END), ',') AS toggled, array_to_string(list_sort(list_distinct(list_append(s, 'X'))), ',') AS added
FROM (SELECT l_orderkey, list(DISTINCT l_returnflag) AS s FROM lineitem GROUP BY 1)
""")
def toggled_states(t):
    rows = t["application"].groupBy("job_id").agg(F.collect_set("status").alias("s"))
    joined = lambda c: F.array_join(F.sort_array(c), ",")
    return rows.select("job_id", joined(text.toggled(F.col("s"), F.lit("R"))).alias("toggled"), joined(text.with_item(F.col("s"), F.lit("X"))).alias("added"))

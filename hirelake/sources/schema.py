"""Tables of the recruiting model: schemas, domains, keys, and which column refers to which table."""

from __future__ import annotations

from pyspark.sql.types import StructType

BASE = "active boolean, created_date timestamp, updated_date timestamp"

#: Columns by table; base columns follow for tables in WITH_BASE.
COLUMNS = {
    "user": "id bigint, username string, first_name string, last_name string, email string, bio string, avatar string, phone string, role string, email_notifications boolean, push_notifications boolean, is_active boolean, is_staff boolean, is_superuser boolean, date_joined timestamp, last_login timestamp",
    "candidate_profile": "user_id bigint, gender string, address string, experience_years int, dob date, specialization string, school_name string, resume string, resume_name string, education_status string",
    "employer_profile": "user_id bigint, company_name string, tax_code string, website string, description string, address string, status string, reject_reason string, verified_at timestamp, verified_by bigint",
    "skill": "id bigint, name string",
    "candidate_skills": "candidate_id bigint, skill_id bigint",
    "work_experience": "id bigint, candidate_id bigint, job_title string, company string, start_date date, end_date date, is_current boolean, description string",
    "education": "id bigint, candidate_id bigint, institution string, level string, field_of_study string, start_date date, end_date date, is_current boolean, description string",
    "language": "id bigint, candidate_id bigint, language string, oral_level int, written_level int, is_first_language boolean",
    "appreciation": "id bigint, candidate_id bigint, award_name string, category string, end_date date, description string",
    "job_category": "id bigint, name string",
    "location": "id bigint, name string",
    "tag": "id bigint, name string",
    "job": "id bigint, posted_by_id bigint, title string, description string, requirements string, benefits string, company_name string, is_featured boolean, category_id bigint, location_id bigint, address string, employment_type string, experience_level string, views int, salary_min bigint, salary_max bigint, deadline date",
    "job_tags": "job_id bigint, tag_id bigint",
    "bookmark_job": "id bigint, user_id bigint, job_id bigint",
    "application": "id bigint, candidate_id bigint, job_id bigint, status string, employer_note string, rating int, cover_letter string, cv string",
    "service_pack": "id bigint, name string, price decimal(12,0), duration_days int, description string, pack_type string",
    "receipt": "id bigint, user_id bigint, service_pack_id bigint, related_job_id bigint, amount decimal(12,0), payment_method string, status string, is_paid boolean, transaction_id string",
}
WITHOUT_BASE = {"candidate_skills", "job_category", "location", "job_tags"}

#: Values that a column may take.
DOMAINS = {
    ("job", "employment_type"): ("FULL_TIME", "PART_TIME", "INTERN", "REMOTE"),
    ("job", "experience_level"): ("INTERN", "FRESHER", "JUNIOR", "MIDDLE", "SENIOR", "EXPERT"),
    ("application", "status"): ("SUBMITTED", "REVIEWED", "APPROVED", "REJECTED"),
    ("user", "role"): ("ADMIN", "EMPLOYER", "CANDIDATE"),
    ("employer_profile", "status"): ("PENDING", "APPROVED", "REJECTED"),
    ("candidate_profile", "education_status"): ("STUDYING", "GRADUATED", "DROPOUT"),
    ("candidate_profile", "gender"): ("MALE", "FEMALE"),
    ("receipt", "payment_method"): ("CASH", "VNPAY"),
    ("receipt", "status"): ("PENDING", "SUCCESS", "FAILED", "CANCELLED"),
}

#: Sets of columns without repeats; rows with a null in one are left alone.
UNIQUE = {
    "bookmark_job": [("user_id", "job_id")],
    "application": [("candidate_id", "job_id")],
    "language": [("candidate_id", "language")],
    "user": [("email",)],
    "skill": [("name",)],
    "employer_profile": [("tax_code",)],
    "job_category": [("name",)],
    "location": [("name",)],
    "tag": [("name",)],
}

#: Characters that a column may have at most.
LENGTHS = {
    ("job_category", "name"): 120, ("location", "name"): 120, ("tag", "name"): 50, ("skill", "name"): 100, ("job", "title"): 255, ("job", "company_name"): 255,
    ("job", "employment_type"): 20, ("job", "experience_level"): 20, ("user", "phone"): 30, ("user", "role"): 20, ("candidate_profile", "gender"): 10,
    ("candidate_profile", "address"): 255, ("candidate_profile", "specialization"): 255, ("candidate_profile", "school_name"): 255, ("candidate_profile", "resume_name"): 255,
    ("candidate_profile", "education_status"): 20, ("employer_profile", "company_name"): 255, ("employer_profile", "tax_code"): 50, ("employer_profile", "address"): 500,
    ("employer_profile", "status"): 20, ("work_experience", "job_title"): 255, ("work_experience", "company"): 255, ("education", "institution"): 255, ("education", "level"): 100,
    ("education", "field_of_study"): 255, ("language", "language"): 100, ("appreciation", "award_name"): 255, ("appreciation", "category"): 255, ("service_pack", "name"): 100,
    ("service_pack", "pack_type"): 20, ("receipt", "payment_method"): 20, ("receipt", "status"): 20, ("receipt", "transaction_id"): 100, ("application", "status"): 20,
}

CASCADE, PROTECT, RESTRICT, SET_NULL = "cascade", "protect", "restrict", "set null"

#: (table, column): (table referred to, its key, what deleting there does here).
REFERENCES = {
    ("candidate_profile", "user_id"): ("user", "id", CASCADE),
    ("employer_profile", "user_id"): ("user", "id", RESTRICT),
    ("employer_profile", "verified_by"): ("user", "id", SET_NULL),
    ("work_experience", "candidate_id"): ("candidate_profile", "user_id", CASCADE),
    ("education", "candidate_id"): ("candidate_profile", "user_id", CASCADE),
    ("language", "candidate_id"): ("candidate_profile", "user_id", CASCADE),
    ("appreciation", "candidate_id"): ("candidate_profile", "user_id", CASCADE),
    ("job", "posted_by_id"): ("employer_profile", "user_id", CASCADE),
    ("job", "category_id"): ("job_category", "id", PROTECT),
    ("job", "location_id"): ("location", "id", PROTECT),
    ("bookmark_job", "user_id"): ("user", "id", CASCADE),
    ("bookmark_job", "job_id"): ("job", "id", CASCADE),
    ("application", "candidate_id"): ("candidate_profile", "user_id", CASCADE),
    ("application", "job_id"): ("job", "id", CASCADE),
    ("receipt", "user_id"): ("user", "id", CASCADE),
    ("receipt", "service_pack_id"): ("service_pack", "id", SET_NULL),
    ("receipt", "related_job_id"): ("job", "id", SET_NULL),
}

#: Orders that tables have unless another is asked for: column, whether it descends. The key decides ties.
ORDERS = {
    "job": (("created_date", True), ("id", False)),
    "application": (("created_date", True), ("id", False)),
    "bookmark_job": (("created_date", True), ("id", False)),
    "receipt": (("created_date", True), ("id", False)),
    "work_experience": (("start_date", True), ("id", False)),
    "education": (("start_date", True), ("id", False)),
    "appreciation": (("end_date", True), ("id", False)),
    "skill": (("name", False), ("id", False)),
}


def schema(table: str) -> StructType:
    return StructType.fromDDL(COLUMNS[table] + ("" if table in WITHOUT_BASE else ", " + BASE))
